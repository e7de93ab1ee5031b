"""Approximate nearest neighbours: stable projections, a kd-tree over them, and a chi-square stop.

A projection onto m Gaussian directions is stable: the squared distance of two projected points, over their
squared distance, follows the chi-square law of m degrees, whatever the vectors. A query therefore takes
projected neighbours in the order of their projected distance and verifies each on the original vectors. It
stops when a vector as near as the kth one found would, with probability ``certainty``, have come already:
when chi-square(next projected distance^2 / kth distance^2) reaches it. There is no other end, so no budget
of candidates is set.

Upper nodes of the kd-tree are fitted on a bounded sample and cut the projected space into cells; lower
nodes are built over all rows of a cell, or of an equal part of a large cell, in the task that holds them.
A query is first answered in its own part, in the place where the data are, and then sent, with the distance that it has to
beat, to those parts only whose box its stopping radius meets.

Equal vectors are searched once and have their ids joined to the answers, so copies cost nothing.
"""

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from halocline.llm.common import stored

#: Rows of a part, about, and queries that meet it in one task.
PART_ROWS, QUERY_ROWS = 8192, 4096
#: Rows on which the upper tree is fitted, and its leaves, at most. Larger data have more parts in a cell.
SAMPLE_ROWS, MOST_CELLS = 16384, 4096
LEAF_ROWS = 256
#: Candidates verified between two looks at the stopping test.
STEP = 64


@dataclass(frozen=True)
class Projection:
    """Directions, certainty of the stop, and seed of the directions."""

    size: int = 16
    certainty: float = 0.97
    seed: int = 11

    def matrix(self, dims):
        return np.random.default_rng(self.seed).standard_normal((dims, self.size))

    def reach(self):
        """Projected over true squared distance that a share ``certainty`` of all pairs does not exceed."""
        return chi_square_quantile(self.certainty, self.size)


def chi_square(x, m):
    """Distribution function of the chi-square law of m degrees (series of the incomplete gamma function)."""
    if x <= 0:
        return 0.0
    a, h = m / 2, x / 2
    term = total = 1 / a
    n = 0
    while term > total * 1e-16:
        n += 1
        term *= h / (a + n)
        total += term
    return min(1.0, total * math.exp(a * math.log(h) - h - math.lgamma(a)))


def chi_square_quantile(p, m):
    low, high = 0.0, 1.0
    while chi_square(high, m) < p:
        high *= 2
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_square(mid, m) < p else (low, mid)
    return high


def matrix(column, dims):
    """Rows of an Arrow list column as doubles; shorter vectors are extended by zeros."""
    ends = np.asarray(column.offsets)
    sizes = np.diff(ends)
    values = np.asarray(column.values)[ends[0] : ends[-1]].astype(float)
    if (sizes == dims).all():
        return values.reshape(-1, dims)
    out = np.zeros((len(sizes), dims))
    out[np.arange(dims) < sizes[:, None]] = values
    return out


class KdTree:
    """Median cuts along the widest direction; rows of a leaf stand together in ``order``."""

    def __init__(self, points, leaf_rows, most_leaves=1 << 30):
        self.axis, self.cut, self.child, self.leaf = [], [], [], []
        self.order = np.arange(len(points))
        self.spans = []
        todo, leaves = [(self._node(), 0, len(points))], 1
        # largest node first, so that a limit on leaves leaves them of like size
        while todo:
            todo.sort(key=lambda t: t[2] - t[1])
            node, start, stop = todo.pop()
            own = points[self.order[start:stop]]
            spread = np.ptp(own, axis=0) if len(own) else np.zeros(points.shape[1])
            axis = int(spread.argmax())
            if stop - start <= leaf_rows or leaves >= most_leaves or not spread[axis] > 0:
                self.leaf[node] = len(self.spans)
                self.spans.append((start, stop))
                continue
            values = own[:, axis]
            cut = float(np.median(values))
            if not (values > cut).any():
                cut = float(values[values < cut].max())
            right = values > cut
            self.order[start:stop] = np.concatenate([self.order[start:stop][~right], self.order[start:stop][right]])
            middle = stop - int(right.sum())
            self.axis[node], self.cut[node] = axis, cut
            self.child[node] = (self._node(), self._node())
            todo += [(self.child[node][0], start, middle), (self.child[node][1], middle, stop)]
            leaves += 1

    def _node(self):
        self.axis.append(0)
        self.cut.append(0.0)
        self.child.append((-1, -1))
        self.leaf.append(-1)
        return len(self.axis) - 1

    def leaf_of(self, points):
        """The leaf in whose region each point lies, also of points that were not there when it was built."""
        axis, cut, child, leaf = (np.array(v) for v in (self.axis, self.cut, self.child, self.leaf))
        node = np.zeros(len(points), np.int64)
        while True:
            open_ = np.flatnonzero(leaf[node] < 0)
            if not len(open_):
                return leaf[node]
            at = node[open_]
            node[open_] = child[at, (points[open_, axis[at]] > cut[at]).astype(int)]


def to_boxes(point, low, high):
    """Squared distances of a point to boxes."""
    apart = np.maximum(np.maximum(low - point, point - high), 0)
    return np.einsum("ij,ij->i", apart, apart)


class Part:
    """A kd-tree over the projections of some vectors, for incremental search."""

    def __init__(self, vectors, least, projection):
        self.projection = projection
        self.directions = projection.matrix(vectors.shape[1])
        near = vectors @ self.directions
        tree = KdTree(near, LEAF_ROWS)
        self.order = tree.order
        self.vectors, self.near, self.least = vectors[tree.order], near[tree.order], least[tree.order]
        self.spans = tree.spans
        self.low = np.array([self.near[a:b].min(axis=0) for a, b in tree.spans])
        self.high = np.array([self.near[a:b].max(axis=0) for a, b in tree.spans])

    def _incremental(self, point, radius):
        """Batches of (projected squared distances, rows), in the order of projected distance.

        Leaves are opened by the distance of their boxes; what lies nearer than the next box is in order. ``radius`` tells
        the squared projected distance beyond which nothing is wanted at the time.
        """
        boxes = to_boxes(point, self.low, self.high)
        leaves = np.argsort(boxes, kind="stable")
        waiting = np.zeros(0), np.zeros(0, np.int64)
        for k, leaf in enumerate(leaves):
            if boxes[leaf] > radius():
                break
            a, b = self.spans[leaf]
            apart = self.near[a:b] - point
            apart = np.einsum("ij,ij->i", apart, apart)
            own = np.flatnonzero(apart <= radius())
            distance = np.concatenate([waiting[0], apart[own]])
            rows = np.concatenate([waiting[1], own + a])
            ready = distance <= (boxes[leaves[k + 1]] if k + 1 < len(leaves) else np.inf)
            waiting = distance[~ready], rows[~ready]
            distance, rows = distance[ready], rows[ready]
            by = np.argsort(distance, kind="stable")
            for start in range(0, len(by), STEP):
                yield distance[by[start : start + STEP]], rows[by[start : start + STEP]]
        by = np.argsort(waiting[0], kind="stable")
        for start in range(0, len(by), STEP):
            yield waiting[0][by[start : start + STEP]], waiting[1][by[start : start + STEP]]

    def nearest(self, query, k, bound=np.inf):
        """(distances, rows) of the k nearest vectors found that are not farther than ``bound``."""
        reach = self.projection.reach()
        # rounding of the projected distances must not cut off copies, whose bound is zero
        slack = 1e-9 * (1 + float(query @ query))
        worst = bound
        best, held = np.zeros(0), np.zeros(0, np.int64)
        for projected, rows in self._incremental(query @ self.directions, lambda: reach * worst * worst + slack):
            if projected[0] > reach * worst * worst + slack:
                break
            apart = self.vectors[rows] - query
            distance = np.sqrt((apart * apart).sum(axis=1))
            good = distance <= worst
            best, held = np.concatenate([best, distance[good]]), np.concatenate([held, rows[good]])
            keep = np.lexsort((self.least[held], best))[:k]
            best, held = best[keep], held[keep]
            if len(best) == k:
                worst = min(worst, best[-1])
        return best, held


_FOUND = "q1 long, q2 long, n1 long, n2 long, least long, distance double"


def _answers(part, queries, q1, q2, bounds, n1, n2, k):
    """A table of what the queries find in a part."""
    rows = [[], [], [], [], [], []]
    for i, query in enumerate(queries):
        distance, held = part.nearest(query, k, bounds[i])
        own = part.order[held]
        for column, value in zip(rows, (np.full(len(own), q1[i]), np.full(len(own), q2[i]), n1[own], n2[own], part.least[held], distance)):
            column.append(value)
    types = [pa.int64()] * 5 + [pa.float64()]
    arrays = [pa.array(np.concatenate(c) if c else [], t) for c, t in zip(rows, types)]
    return pa.table(arrays, names=["q1", "q2", "n1", "n2", "least", "distance"])


def _longs(table, *names):
    return [table.column(n).to_numpy() for n in names]


def _within(k, dims, projection):
    """What the queries of a part find in it."""

    def run(table):
        vectors = matrix(table.column("vector").combine_chunks(), dims)
        k1, k2, least = _longs(table, "k1", "k2", "least")
        asked = np.flatnonzero(table.column("asked").to_numpy())
        if not len(asked):
            return _answers(None, (), (), (), (), k1, k2, k)
        part = Part(vectors, least, projection)
        return _answers(part, vectors[asked], k1[asked], k2[asked], np.full(len(asked), np.inf), k1, k2, k)

    return run


def _across(k, dims, projection):
    """What queries from elsewhere find in a part."""

    def run(left, right):
        if not left.num_rows or not right.num_rows:
            return _answers(None, (), (), (), (), (), (), k)
        queries = matrix(left.column("vector").combine_chunks(), dims)
        vectors = matrix(right.column("vector").combine_chunks(), dims)
        n1, n2, least = _longs(right, "k1", "k2", "least")
        part = Part(vectors, least, projection)
        return _answers(part, queries, *_longs(left, "k1", "k2", "bound"), n1, n2, k)

    return run


def _dealt(dims, projection, tree):
    """Cell of each row, and a running number of the task that splits large cells evenly."""

    def run(batches):
        directions, seen = projection.matrix(dims), 0
        for batch in batches:
            near = matrix(batch.column(batch.schema.get_field_index("vector")), dims) @ directions
            number = np.arange(seen, seen + batch.num_rows)
            seen += batch.num_rows
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tree.leaf_of(near), pa.int64()), pa.array(number), pa.FixedSizeListArray.from_arrays(near.ravel(), projection.size).cast(pa.list_(pa.float64()))],
                names=[*batch.schema.names, "cell", "number", "near"],
            )

    return run


def _routed(dims, projection, cells):
    """Parts that a query with its bound has to visit, without the one it comes from."""
    reach = projection.reach()
    names, parts, low, high = cells

    def run(batches):
        directions = projection.matrix(dims)
        for batch in batches:
            vectors = matrix(batch.column(batch.schema.get_field_index("vector")), dims)
            cell, part, bound = (batch.column(batch.schema.get_field_index(c)).to_numpy() for c in ("cell", "part", "bound"))
            near = vectors @ directions
            rows, to_cell, to_part = [], [], []
            for i in range(batch.num_rows):
                slack = 1e-9 * (1 + float(vectors[i] @ vectors[i]))
                met = np.flatnonzero(to_boxes(near[i], low, high) <= reach * bound[i] * bound[i] + slack)
                to = np.repeat(met, parts[met])
                no = np.arange(len(to)) - np.repeat(np.cumsum(parts[met]) - parts[met], parts[met])
                other = (names[to] != cell[i]) | (no != part[i])
                rows.append(np.full(int(other.sum()), i))
                to_cell.append(names[to][other])
                to_part.append(no[other])
            took = np.concatenate([np.zeros(0, np.int64), *rows])
            # a query goes to many parts, so its vector is copied in small batches
            cells_, parts_ = np.concatenate([np.zeros(0, np.int64), *to_cell]), np.concatenate([np.zeros(0, np.int64), *to_part])
            source = batch.select(["k1", "k2", "vector", "bound"])
            for start in range(0, len(took), QUERY_ROWS):
                piece = source.take(pa.array(took[start : start + QUERY_ROWS]))
                yield pa.RecordBatch.from_arrays(
                    [*piece.columns, pa.array(cells_[start : start + QUERY_ROWS]), pa.array(parts_[start : start + QUERY_ROWS])],
                    names=[*piece.schema.names, "cell", "part"],
                )

    return run


def usable(rows, id_column="vec_id", vector="embedding"):
    """``id``, vector and two keys of it; without null ids and vectors that are null, zero, empty or not finite."""
    value = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    rows = rows.select(F.col(id_column).alias("id"), F.col(vector).alias("vector"))
    rows = rows.where("id is not null and vector is not null")
    rows = rows.where(~F.exists("vector", value)).where(F.exists("vector", lambda x: x != 0))
    return rows.select("id", "vector", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit("second"), "vector").alias("k2"))


def _cells(rows, size):
    """(cell, number of parts, box) of every cell; at most MOST_CELLS x directions numbers."""
    stats = rows.groupBy("cell").agg(
        F.count("*").alias("n"), *[F.min(F.col("near")[j]).alias(f"l{j}") for j in range(size)], *[F.max(F.col("near")[j]).alias(f"h{j}") for j in range(size)]
    ).collect()
    table = np.array([list(r) for r in stats], float).reshape(len(stats), 2 + 2 * size)
    parts = np.maximum(1, -(-table[:, 1].astype(np.int64) // PART_ROWS))
    return table[:, 0].astype(np.int64), parts, table[:, 2 : 2 + size], table[:, 2 + size :]


def nearest_vectors(distinct, k, projection=Projection()):
    """For each row of ``distinct`` with ``asked``, the k nearest of its rows, itself included.

    ``distinct`` has k1, k2, vector, least (smallest id) and asked, a row per vector. Returns
    q1, q2, n1, n2, least and distance, in no order.
    """
    distinct = stored(distinct, "knn-vectors")
    count, dims = distinct.agg(F.count("*"), F.max(F.size("vector"))).first()
    if not count:
        return distinct.sparkSession.createDataFrame([], _FOUND)
    spark = distinct.sparkSession
    # a sample by hash; twice the rows wanted are looked at so that the limit seldom falls short
    hash_ = F.xxhash64(F.lit(projection.seed), "k1", "k2")
    share = min(1.0, 2 * SAMPLE_ROWS / count)
    sample = distinct.where(hash_ <= F.lit(int(-(2**63) + share * (2**64 - 1))) if share < 1 else F.lit(True))
    sample = sample.orderBy(hash_).limit(SAMPLE_ROWS).select("vector").toArrow()
    points = matrix(sample.column("vector").combine_chunks(), dims) @ projection.matrix(dims)
    leaves = min(MOST_CELLS, -(-count // (PART_ROWS // 2)))
    tree = KdTree(points, 1, leaves)
    schema = T.StructType(list(distinct.schema.fields)).add("cell", "long").add("number", "long").add("near", T.ArrayType(T.DoubleType()))
    dealt = stored(distinct.mapInArrow(_dealt(dims, projection, tree), schema), "knn-cells")
    cells = _cells(dealt, projection.size)
    sizes = spark.createDataFrame([(int(c), int(p)) for c, p in zip(cells[0], cells[1])], "cell long, parts long")
    dealt = dealt.drop("near").join(F.broadcast(sizes), "cell")
    dealt = dealt.withColumn("part", F.col("number") % F.col("parts")).drop("number", "parts")
    own = stored(dealt.groupBy("cell", "part").applyInArrow(_within(k, dims, projection), _FOUND), "knn-own")
    # the kth distance so far; without k rows there is none, and every part is visited
    bounds = own.groupBy("q1", "q2").agg(F.count("*").alias("n"), F.max("distance").alias("far"))
    bounds = bounds.select(F.col("q1").alias("k1"), F.col("q2").alias("k2"), F.when(F.col("n") >= k, F.col("far")).otherwise(F.lit(float("inf"))).alias("bound"))
    queries = dealt.where("asked").join(bounds, ["k1", "k2"]).select("k1", "k2", "vector", "bound", "cell", "part")
    fields = {f.name: f for f in distinct.schema.fields}
    schema = T.StructType([fields["k1"], fields["k2"], fields["vector"]]).add("bound", "double").add("cell", "long").add("part", "long")
    routed = stored(queries.mapInArrow(_routed(dims, projection, cells), schema), "knn-routes")
    # parts that many queries visit are repeated for groups of them
    place = ["cell", "part"]
    groups = routed.groupBy(place).agg(F.ceil(F.count("*") / QUERY_ROWS).cast("long").alias("groups"))
    routed = routed.join(groups, place).withColumn("group", F.pmod(F.col("k1"), F.col("groups"))).drop("groups")
    visited = dealt.join(groups, place).withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1))).drop("groups")
    key = [*place, "group"]
    across = routed.groupBy(key).cogroup(visited.groupBy(key)).applyInArrow(_across(k, dims, projection), _FOUND)
    order = W.partitionBy("q1", "q2").orderBy("distance", "least")
    both = own.unionByName(across).withColumn("_row", F.row_number().over(order))
    return both.where(F.col("_row") <= k).drop("_row")


def nearest(rows, k=10, every=100, id_column="vec_id", vector="embedding", projection=Projection()):
    """query_id, rank, ``id_column`` and score of the k nearest rows found for each query.

    Queries are the rows whose id is divisible by ``every``; candidates are all rows but the query's own. score is the
    Euclidean distance of the original vectors in double precision; ties go to the smaller id. Null ids and
    vectors that are null, empty, zero or hold null or non-finite numbers take no part. Shorter vectors are
    extended by zeros. Rows alike in id and vector count once; an id that comes with several vectors is a query of
    each. Fewer than k candidates are all returned, and no rows give no rows. Other columns are not looked at.
    """
    table = stored(usable(rows, id_column, vector), "knn-rows")
    asked = F.col("id") % every == 0
    distinct = table.groupBy("k1", "k2").agg(F.first("vector").alias("vector"), F.min("id").alias("least"), F.max(asked).alias("asked"))
    found = nearest_vectors(distinct, k + 1, projection).drop("least")
    # of a vector with many copies only the smallest ids can be among the nearest
    names = table.select("k1", "k2", "id")
    queries = names.where(asked).distinct().select(F.col("k1").alias("q1"), F.col("k2").alias("q2"), F.col("id").alias("query_id"))
    names = names.distinct().withColumn("_row", F.row_number().over(W.partitionBy("k1", "k2").orderBy("id")))
    names = names.where(F.col("_row") <= k + 1).select(F.col("k1").alias("n1"), F.col("k2").alias("n2"), F.col("id").alias("_id"))
    pairs = found.join(names, ["n1", "n2"]).join(queries, ["q1", "q2"])
    pairs = pairs.where("not (query_id = _id and q1 = n1 and q2 = n2)")
    order = W.partitionBy("query_id", "q1", "q2").orderBy("distance", "_id")
    pairs = pairs.withColumn("rank", F.row_number().over(order).cast("int")).where(F.col("rank") <= k)
    return pairs.select("query_id", "rank", F.col("_id").alias(id_column), F.col("distance").alias("score"))
