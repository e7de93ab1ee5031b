"""Exact top-k by inner product: dual-tree search over cover trees of queries and data.

Vectors are scaled and floored to whole numbers. Data are dealt to blocks around pivots, and so are queries to
groups; a block or group has a bounded number of rows, and large or common neighbourhoods are split by
hash. Every query group first meets the block nearest in score, which gives a lower bound of its worst kth
score; it then meets every block whose centre and radius allow a score as high. Each meeting searches the
block's and the group's cover trees together and drops node pairs by their covering radii. Sums are exact
while they stay below 2**53, and integers of any size are taken beyond.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from halocline.llm.common import stored

BLOCK_ROWS, GROUP_ROWS = 4096, 512
#: Pivots, chosen by hash from the vectors; the only thing that is fitted on a sample.
PIVOTS = 64
LEAF = 96


class CoverTree:
    """Nodes with a centre point, the radius that covers their points, and children of half the radius.

    Children are chosen farthest first, so centres of one level lie farther apart than their radius
    allows, and the first child keeps its parent's centre. Points of a node are a range of ``order``.
    """

    def __init__(self, points):
        self.points = points
        self.order = np.arange(len(points))
        self.start, self.stop, self.centre, self.radius, self.children = [], [], [], [], []
        if len(points):
            self._build()
        self.vectors = points[self.order]

    def _node(self, start, stop, centre, distance):
        self.start.append(start)
        self.stop.append(stop)
        self.centre.append(centre)
        self.radius.append(float(distance.max(initial=0.0)))
        self.children.append([])
        return len(self.start) - 1

    def _build(self):
        centre = 0
        distance = np.linalg.norm(self.points - self.points[centre], axis=1)
        todo = [(self._node(0, len(self.points), centre, distance), distance)]
        while todo:
            node, distance = todo.pop()
            start, stop = self.start[node], self.stop[node]
            if stop - start <= LEAF or self.radius[node] == 0:
                continue
            own = self.order[start:stop]
            points, limit = self.points[own], self.radius[node] / 2
            nearest, owner, centres = distance.copy(), np.zeros(len(own), np.int64), [self.centre[node]]
            # in many dimensions halving the radius may need nearly as many centres as points
            while nearest.max() > limit and len(centres) < max(2, len(own) // (LEAF // 4)):
                far = int(nearest.argmax())
                apart = np.linalg.norm(points - points[far], axis=1)
                closer = apart < nearest
                owner[closer], nearest[closer] = len(centres), apart[closer]
                centres.append(own[far])
            if len(centres) == 1:
                continue
            by = np.argsort(owner, kind="stable")
            self.order[start:stop] = own[by]
            sizes = np.bincount(owner, minlength=len(centres))
            at = start
            for k, n in enumerate(sizes):
                if n:
                    part = nearest[by][at - start : at - start + n]
                    child = self._node(at, at + n, centres[k], part)
                    self.children[node].append(child)
                    todo.append((child, part))
                    at += n


def scaled(vectors, scale):
    return np.floor(vectors * scale)


def exact_products(a, b):
    """Inner products of whole-number matrices, as 64-bit integers; formed of integers of any size where floats
    could round, and of those beyond 64 bits the nearest 64-bit number."""
    most = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * max(1, a.shape[1])
    if most < 2.0**53:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m], object).reshape(m.shape)
    most = 2**63 - 1
    return np.minimum(np.maximum(whole(a) @ whole(b).T, -most), most).astype(np.int64)


def dual_tree_top(queries, query_ids, data, data_ids, k, floor=None):
    """The k best of ``data`` for each query, as {position: sorted list of (-score, id)}.

    Rows with the query's own id are no candidates; ties go to the smaller id. ``floor`` holds a score per
    query that k others are known to reach; only data that may reach it are searched, ties included.
    """
    tops = [[] for _ in range(len(queries))]
    worst = np.full(len(queries), -np.inf) if floor is None else np.asarray(floor, float).copy()
    if not len(queries) or not len(data):
        return tops
    left, right = CoverTree(queries), CoverTree(data)
    norm_l = np.linalg.norm(queries, axis=1)
    norm_r = np.linalg.norm(data, axis=1)

    def bounds(q, nodes):
        """Highest score that a query of node q and a point of each node can have."""
        c = np.array([right.centre[n] for n in nodes])
        r = np.array([right.radius[n] for n in nodes])
        cq, rq = left.centre[q], left.radius[q]
        value = data[c] @ queries[cq] + norm_l[cq] * r + norm_r[c] * rq + rq * r
        return value + 1e-9 * (np.abs(value) + 1)

    stack = [(0, 0, np.inf)]
    while stack:
        q, p, bound = stack.pop()
        own = left.order[left.start[q] : left.stop[q]]
        if bound < worst[own].min():
            continue
        q_children, p_children = left.children[q], right.children[p]
        if p_children and (not q_children or right.radius[p] >= left.radius[q]):
            values = bounds(q, p_children)
            stack += [(q, p_children[j], values[j]) for j in np.argsort(values)]
        elif q_children:
            for child in q_children:
                stack.append((child, p, bounds(child, [p])[0]))
        else:
            span = right.order[right.start[p] : right.stop[p]]
            scores = exact_products(queries[own], data[span])
            ids = data_ids[span]
            for row, i in enumerate(own):
                good = np.flatnonzero((scores[row] >= worst[i]) & (ids != query_ids[i]))
                if len(good):
                    if len(good) > 4 * k:
                        # all above the kth score and the smallest ids at it
                        keep = np.lexsort((ids[good], -scores[row][good]))[:k]
                        good = good[keep]
                    best = sorted(tops[i] + [(-int(scores[row][g]), int(ids[g])) for g in good])[:k]
                    tops[i] = best
                    if len(best) == k:
                        worst[i] = max(worst[i], -best[-1][0])
    return tops


def _pack(matrix):
    return np.ascontiguousarray(matrix, "<f8").tobytes()


def _unpack(data, rows):
    return np.frombuffer(data, "<f8").reshape(rows, -1) if rows else np.zeros((0, 0))


def _same_width(a, b):
    width = max(a.shape[1], b.shape[1])
    grow = lambda m: m if m.shape[1] == width else np.pad(m, ((0, 0), (0, width - m.shape[1])))
    return grow(a), grow(b)


def usable(embeddings, column="embedding"):
    """vec_id and vector (doubles), without rows whose id or vector is null, empty or not finite throughout."""
    v = F.transform(F.col(column), lambda x: x.cast("double"))
    rows = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("vector"))
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf")))
    return rows.where(F.col("vec_id").isNotNull() & (F.size("vector") > 0) & ~F.exists("vector", bad))


def _pivots(rows, scale):
    """At most PIVOTS vectors, spread over those with the smallest hashes."""
    sample = rows.orderBy(F.xxhash64("vec_id", F.lit(5)), "vec_id").limit(8 * PIVOTS).collect()
    if not sample:
        return np.zeros((0, 1))
    width = max(len(r["vector"]) for r in sample)
    points = scaled(np.array([[*r["vector"], *[0.0] * (width - len(r["vector"]))] for r in sample]), scale)
    chosen, nearest = [0], np.linalg.norm(points - points[0], axis=1)
    while len(chosen) < PIVOTS and nearest.max() > 0:
        chosen.append(int(nearest.argmax()))
        nearest = np.minimum(nearest, np.linalg.norm(points - points[chosen[-1]], axis=1))
    return points[chosen]


def _dealt(rows, pivots, scale):
    """Add the nearest pivot of every vector."""

    def run(batches):
        for batch in batches:
            ids, vectors = batch.columns
            near = []
            for v in vectors.to_pylist():
                v = scaled(np.array(v), scale)
                width = min(len(v), pivots.shape[1])
                near.append(int(((pivots[:, :width] - v[:width]) ** 2).sum(axis=1).argmin()))
            yield pa.RecordBatch.from_arrays([ids, vectors, pa.array(near, pa.int32())], names=["vec_id", "vector", "pivot"])

    return rows.mapInArrow(run, "vec_id long, vector array<double>, pivot int")


def _blocks(rows, size, scale):
    """Rows in blocks of about ``size`` around one pivot: block, ids, packed vectors, centre and radius."""
    counts = rows.groupBy("pivot").agg(F.count("*").alias("n")).withColumn("parts", F.ceil(F.col("n") / size))
    rows = rows.join(F.broadcast(counts), "pivot")  # one row a pivot
    rows = rows.withColumn("part", F.pmod(F.xxhash64("vec_id", F.lit(9)), F.col("parts")))

    def pack(table):
        vectors = table["vector"].to_pylist()
        width = max(len(v) for v in vectors)
        points = scaled(np.array([[*v, *[0.0] * (width - len(v))] for v in vectors]), scale)
        centre = points.mean(axis=0)
        radius = float(np.linalg.norm(points - centre, axis=1).max())
        block = (table["pivot"][0].as_py() << 32) + table["part"][0].as_py()
        return pa.table(
            {
                "block": pa.array([block], pa.int64()), "rows": pa.array([len(points)], pa.int64()),
                "ids": pa.array([table["vec_id"].to_numpy().astype("<i8").tobytes()], pa.binary()),
                "points": pa.array([_pack(points)], pa.binary()),
                "centre": pa.array([list(map(float, centre))], pa.list_(pa.float64())),
                "radius": pa.array([radius], pa.float64()),
            }
        )

    return rows.groupBy("pivot", "part").applyInArrow(
        pack, "block long, rows long, ids binary, points binary, centre array<double>, radius double"
    )


def _meet(pairs, k):
    """Best rows of each (query group, block) pair: query_id, vec_id, score."""

    def run(batches):
        for batch in batches:
            out = ([], [], [])
            for q_rows, q_ids, q_points, floor, d_rows, d_ids, d_points in zip(*[c.to_pylist() for c in batch.columns]):
                queries, data = _same_width(_unpack(q_points, q_rows), _unpack(d_points, d_rows))
                query_ids, data_ids = np.frombuffer(q_ids, "<i8"), np.frombuffer(d_ids, "<i8")
                bound = None if floor is None else np.frombuffer(floor, "<f8")
                for i, best in enumerate(dual_tree_top(queries, query_ids, data, data_ids, k, bound)):
                    for negative, vec_id in best:
                        out[0].append(int(query_ids[i]))
                        out[1].append(vec_id)
                        out[2].append(-negative)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=["query_id", "vec_id", "score"])

    return pairs.select("q_rows", "q_ids", "q_points", "floor", "rows", "ids", "points").mapInArrow(
        run, "query_id long, vec_id long, score long"
    )


def _floors(groups, first, k):
    """Each group with its queries' kth scores so far (minus infinity without k), packed in their order."""
    best = first.groupBy("query_id").agg(F.array_agg("score").alias("s"))
    kth = best.select("query_id", F.get(F.reverse(F.array_sort("s")), k - 1).cast("double").alias("kth"))

    def ids(batches):
        for batch in batches:
            rows = [(b, int(q), i) for b, data in zip(*[c.to_pylist() for c in batch.columns]) for i, q in enumerate(np.frombuffer(data, "<i8"))]
            columns = list(zip(*rows)) or [(), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["q_block", "query_id", "at"])

    listed = groups.select("q_block", "q_ids").mapInArrow(ids, "q_block long, query_id long, at long").join(kth, "query_id", "left")

    def pack(table):
        order = np.argsort(table["at"].to_numpy())
        values = np.array([-np.inf if x is None else x for x in table["kth"].to_pylist()])[order]
        return pa.table({"q_block": table["q_block"][:1], "floor": pa.array([values.astype("<f8").tobytes()], pa.binary()), "least": pa.array([float(values.min())])})

    return groups.join(listed.groupBy("q_block").applyInArrow(pack, "q_block long, floor binary, least double"), "q_block")


def _dot(a, b):
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)


def _norm(a):
    return F.sqrt(_dot(a, a))


def top_scores(embeddings, every=50, k=5, scale=256.0):
    """query_id, rank, vec_id, score: the k best of all other rows for each id divisible by ``every``.

    Vectors that are null or empty, or hold null or non-finite components, take no part, nor do null ids.
    Vectors of different lengths are compared over the shorter length. Rows that repeat a query's id are
    its own, and a query id with several vectors has the best scores of any of them. Other rows that repeat
    are candidates each. An empty table gives no rows. Scores beyond 64 bits count as the
    nearest 64-bit number, so such ties go to the smaller id.
    """
    rows = usable(embeddings)
    pivots = _pivots(rows, scale)
    if not len(pivots):
        return rows.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0).cast("long").alias("score")).where("false")
    dealt = stored(_dealt(rows, pivots, scale), "vectors")
    blocks = stored(_blocks(dealt, BLOCK_ROWS, scale), "vector-blocks")
    groups = _blocks(dealt.where(F.pmod("vec_id", F.lit(every)) == 0).distinct(), GROUP_ROWS, scale)
    groups = stored(groups.select(*[F.col(c).alias("q_" + c) for c in groups.columns]), "query-groups")
    # summaries of the query groups are numbered, and those of the blocks repeated for each number
    numbered = groups.select("q_block", "q_centre", "q_radius", F.row_number().over(W.orderBy("q_block")).alias("number"))
    each = F.explode(F.sequence(F.lit(1), F.lit(max(1, groups.count()))))
    sides = blocks.select("block", "centre", "radius").withColumn("number", each)
    middle = _dot(F.col("q_centre"), F.col("centre"))
    pairs = sides.join(numbered, "number").select(
        "q_block",
        "block",
        middle.alias("middle"),
        (
            middle
            + _norm(F.col("q_centre")) * F.col("radius")
            + _norm(F.col("centre")) * F.col("q_radius")
            + F.col("q_radius") * F.col("radius")
        ).alias("most"),
    )
    pairs = stored(pairs, "block-pairs")
    home = pairs.groupBy("q_block").agg(F.max_by("block", F.struct("middle", "block")).alias("block"))
    group_data = groups.select("q_block", "q_rows", "q_ids", "q_points")
    block_data = blocks.select("block", "rows", "ids", "points")
    at_home = home.join(group_data, "q_block").join(block_data, "block")
    first = stored(_meet(at_home.withColumn("floor", F.lit(None).cast("binary")), k), "first-scores")
    floored = stored(_floors(group_data, first, k), "query-floors")
    rest = (
        pairs.join(home.withColumnRenamed("block", "home"), "q_block")
        .where("block <> home")
        .join(floored, "q_block")
        .where(F.col("most") + F.abs("most") * 1e-9 + 1e-6 >= F.col("least"))
        .join(block_data, "block")
    )
    found = first.unionByName(_meet(rest, k))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return best.select("query_id", "rank", "vec_id", "score")
