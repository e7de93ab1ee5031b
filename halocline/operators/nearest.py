"""Nearest stored time and nearest grid cell for any number of targets."""

from functools import reduce
from math import floor, log2

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.numeric import degrees_between

CHUNK_SECONDS = 86_400
#: Targets of one key and chunk that meet in one task; more are spread.
TASK_TARGETS = 500_000


def _micros(time):
    return F.unix_micros(F.col(time).cast("timestamp"))


def _same(a, b, keys):
    return reduce(lambda x, y: x & y, [F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys])


def nearest_in_time(targets, stored, values=(), keys=(), time="time", out="nearest", chunk_seconds=CHUNK_SECONDS, task_targets=TASK_TARGETS):
    """Each target with ``out``: the time and ``values`` of the stored row of its keys that is nearest in time.

    Ties go to the earlier time. Of stored rows with equal keys and time the least values count. A target
    without a time, or without any stored row of its keys, gets NULL. NULL keys are equal.

    Both sides are put in chunks of time and meet there in one ordered pass forward and one backward. What lies
    beyond a chunk is known from its edges: the last stored row of the chunks before and the first one of the
    chunks after, carried over a table of one row per chunk. A chunk with very many targets is spread
    over several tasks, each with the stored rows of the chunk, which are as few as its distinct times.
    """
    keys = list(keys)
    place = [*keys, "_chunk"]
    width = int(chunk_seconds * 1_000_000)
    chunk = F.expr(f"(_at - pmod(_at, {width}L)) div {width}L").alias("_chunk")
    value = F.struct(F.col(time).alias("time"), *values)
    right = (
        stored.where(F.col(time).isNotNull())
        .groupBy(*keys, _micros(time).alias("_at"))
        .agg(F.min(value).alias("_value"))
        .select(*keys, chunk, F.struct("_at", "_value").alias("_stored"))
    )
    left = targets.select(F.struct("*").alias("_row"), *keys, _micros(time).alias("_at")).select("*", chunk)
    dated = left.where("_at is not null")
    counts = dated.groupBy(place).agg(F.ceil(F.count("*") / task_targets).cast("int").alias("_spread"))
    ends = right.groupBy(place).agg(F.min("_stored").alias("_first"), F.max("_stored").alias("_last"))
    table = counts.unionByName(ends, allowMissingColumns=True).groupBy(place).agg(
        *[F.first(c, ignorenulls=True).alias(c) for c in ("_spread", "_first", "_last")]
    )
    passed = [Window.unboundedPreceding, -1]
    before = F.last("_last", True).over(Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(*passed))
    after = F.last("_first", True).over(Window.partitionBy(*keys).orderBy(F.desc("_chunk")).rowsBetween(*passed))
    edges = table.withColumn("_stored", F.array(before, after)).where("_spread is not null")
    edges = edges.select(*place, "_spread", F.explode("_stored").alias("_stored")).where("_stored is not null")
    # only chunks that are spread; there are at most as many as targets / task_targets
    hot = counts.where("_spread > 1")

    def spread(df):
        cut = df.alias("rows").join(hot.alias("hot"), _same("rows", "hot", place), "left")
        return cut.select("rows.*", F.coalesce("hot._spread", F.lit(1)).alias("_spread"))

    copies = F.explode(F.sequence(F.lit(0), F.col("_spread") - 1)).alias("_part")
    shown = spread(right).unionByName(edges).select(*place, "_stored", copies)
    shown = shown.select(*place, "_part", F.col("_stored._at").alias("_at"), F.lit(0).alias("_kind"), "_stored")
    asking = spread(dated).select(*place, F.pmod(F.xxhash64("_row"), F.col("_spread")).cast("int").alias("_part"), "_at", F.lit(1).alias("_kind"), "_row")
    both = shown.unionByName(asking, allowMissingColumns=True)
    meet = Window.partitionBy(*place, "_part")
    until = [Window.unboundedPreceding, Window.currentRow]
    both = both.withColumns(
        {
            "_before": F.last("_stored", True).over(meet.orderBy("_at", "_kind").rowsBetween(*until)),
            "_after": F.last("_stored", True).over(meet.orderBy(F.desc("_at"), "_kind").rowsBetween(*until)),
        }
    )
    later = F.col("_after._at") - F.col("_at") < F.col("_at") - F.col("_before._at")
    chosen = F.when(F.col("_before").isNull() | later, F.col("_after._value")).otherwise(F.col("_before._value"))
    found = both.where("_kind = 1").select("_row", chosen.alias(out))
    undated = left.where("_at is null").select("_row", F.lit(None).cast(found.schema[out].dataType).alias(out))
    return found.unionByName(undated).select("_row.*", out)


def cell_spacing(cells):
    """The side of a square that holds one cell on average, from the extent of the cells and their number."""
    n, height, width = cells.select("lat", "lon").distinct().agg(
        F.count(F.lit(1)), F.max("lat") - F.min("lat"), F.max("lon") - F.min("lon")
    ).first()
    return ((height or 0.0) * (width or 0.0) / n) ** 0.5 if n else 0.0


def _square(lat, lon, side):
    return F.floor(F.col(lat) / side).alias("_x"), F.floor(F.col(lon) / side).alias("_y")


def _to_square(side):
    """(least, greatest) distance in degrees of a target to a cell of the square (_x, _y)."""

    def axis(c, i):
        low, high = F.col(i) * side - F.col(c), F.col(c) - (F.col(i) + 1) * side
        return F.greatest(low, high, F.lit(0.0)), F.greatest(-low, -high)

    (near_a, far_a), (near_b, far_b) = axis("lat", "_x"), axis("lon", "_y")
    return F.sqrt(near_a * near_a + near_b * near_b), F.sqrt(far_a * far_a + far_b * far_b)


def candidate_squares(targets, spots, keys, radius, levels):
    """(keys, lat, lon, _x, _y): squares of side radius / 2**levels that may hold a target's nearest cell.

    Squares around a target are halved level by level. Of those that hold cells, one farther than another
    one's farthest corner is dropped, so as many stay as the ring around the target's distance meets,
    however fine the cells are.
    """
    own = [*keys, "lat", "lon"]
    around = F.sequence(F.lit(-1), F.lit(1))
    x, y = (F.floor(F.col(c) / radius) for c in ("lat", "lon"))
    found = targets.select(*own).where("lat is not null and lon is not null")
    found = found.select(*own, F.explode(F.transform(around, lambda k: x + k)).alias("_x"))
    found = found.select(*own, "_x", F.explode(F.transform(around, lambda k: y + k)).alias("_y"))
    for level in range(levels):
        side = radius / 2**level
        near, far = _to_square(side)
        held = spots.select(*_square("cell_lat", "cell_lon", side)).distinct()
        found = found.join(held, ["_x", "_y"]).select(*own, F.struct("_x", "_y", near.alias("near"), far.alias("far")).alias("s"))
        found = found.where(F.col("s.near") < radius).groupBy(*own).agg(F.collect_list("s").alias("all"), F.min("s.far").alias("limit"))
        kept = F.filter("all", lambda s: s["near"] <= F.col("limit") + 1e-9)
        halves = F.sequence(F.lit(0), F.lit(1))
        found = found.select(*own, F.explode(kept).alias("s"))
        found = found.select(*own, "s", F.explode(F.transform(halves, lambda k: F.col("s._x") * 2 + k)).alias("_x"))
        found = found.select(*own, "_x", F.explode(F.transform(halves, lambda k: F.col("s._y") * 2 + k)).alias("_y"))
    return found


def nearest_cell(targets, cells, keys, radius=2.0, spacing=None):
    """The nearest cell within ``radius`` degrees of each target; lowest cell on ties.

    Cells may be any set of points. ``spacing`` is about their distance; it is taken from the cells if not
    given. The search starts in squares of the radius and halves them down to the spacing, so that the
    pairs of a target and a cell do not grow with the resolution. Best-so-far is combined map-side.
    """
    spots = cells.select(F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon")).where("cell_lat is not null and cell_lon is not null").distinct()
    if spacing is None:
        spacing = cell_spacing(cells)
    levels = max(0, min(20, floor(log2(radius / spacing)))) if spacing > 0 else 0
    squares = candidate_squares(targets, spots, keys, radius, levels)
    placed = spots.select("*", *_square("cell_lat", "cell_lon", radius / 2**levels))
    d = degrees_between(F.col("lat"), F.col("lon"), F.col("cell_lat"), F.col("cell_lon"))
    pairs = squares.join(placed, ["_x", "_y"]).withColumn("distance", d).where(F.col("distance") < radius)
    return pairs.groupBy(*keys).agg(
        F.min(F.struct("distance", "cell_lat", "cell_lon")).alias("best")
    ).select(*keys, "best.cell_lat", "best.cell_lon", "best.distance")


def nearest_reading(targets, grid, values, keys, radius=2.0, spacing=None, out="nearest"):
    """Each target with ``out``: the values of the nearest cell within ``radius``, at the nearest time.

    The cell is chosen first; rows of the grid without any of the values do not count. Targets that repeat in
    ``keys`` share a cell. A target without a cell or a time gets NULL.
    """
    cells = grid.select("lat", "lon")
    found = nearest_cell(targets, cells, keys, radius, spacing).select(*keys, "cell_lat", "cell_lon")
    placed = targets.join(found, list(keys), "left")
    rows = grid.where(F.coalesce(*[F.col(v) for v in values]).isNotNull())
    rows = rows.withColumnsRenamed({"lat": "cell_lat", "lon": "cell_lon"})
    far = placed.where("cell_lat is null")
    near = nearest_in_time(placed.where("cell_lat is not null"), rows, values, ["cell_lat", "cell_lon"], out=out, chunk_seconds=30 * CHUNK_SECONDS)
    return near.unionByName(far.withColumn(out, F.lit(None).cast(near.schema[out].dataType)))
