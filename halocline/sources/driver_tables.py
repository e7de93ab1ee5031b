"""The shipped star-schema tables mapped onto grids, profiles and index series.

Each mapping is one SQL text that runs unchanged on Spark and on a SQL oracle. All but the grouped
ones are plain projections, so filters and column pruning reach the scan.
"""

TABLES = ["lineitem", "orders", "events", "conversations"]

LAT = "CAST(-30 + 10 * (l_suppkey % 4) AS DOUBLE)"
LON = "CAST(40 + 15 * (l_partkey % 5) AS DOUBLE)"
DAC = "CONCAT('dac', CAST(l_partkey % 8 AS VARCHAR(4)))"
# Unique up to rows whose level values are equal: order, line, then discount and tax in cents.
LEVEL = (
    "(l_orderkey * 8 + l_linenumber) * 10000 + CAST(floor(l_discount * 100 + 0.5E0) AS BIGINT) * 100"
    " + CAST(floor(l_tax * 100 + 0.5E0) AS BIGINT)"
)
PRES = "CASE WHEN l_quantity = 50 THEN 99999.0E0 ELSE l_quantity * 16.0E0 END"
TEMP = "floor((28.0E0 - l_quantity * 0.4E0 + l_discount * 5.0E0) * 10000 + 0.5E0) / 10000"
PSAL = (
    "CASE WHEN l_linenumber = 7 AND l_tax > 0.075 THEN 99999.0E0"
    " ELSE floor((34.0E0 + l_quantity * 0.02E0 + l_tax * 2.0E0) * 10000 + 0.5E0) / 10000 END"
)

MAPPINGS = {
    "grid": f"""SELECT CAST(l_shipdate AS DATE) AS time, {LAT} AS lat, {LON} AS lon,
 CASE WHEN avg(l_quantity) > 49 THEN NULL ELSE round(20 + avg(l_quantity) * 0.2, 4) END AS sst
 FROM lineitem GROUP BY 1, 2, 3""",
    "surface": f"""SELECT CAST(l_shipdate AS DATE) AS time, {LAT} AS lat, {LON} AS lon,
 round(avg(l_quantity) * 0.4 - 10, 4) AS u10, round(avg(l_linenumber) * 2.0 - 8, 4) AS v10,
 round(avg(l_suppkey % 100) * 2.0 + 50, 4) AS ssr, round(-40 - avg(l_partkey % 10) * 4.0, 4) AS str,
 round(-60 - avg(l_orderkey % 50) * 2.0, 4) AS slhf, round(-5 - avg(l_orderkey % 7), 4) AS sshf
 FROM lineitem GROUP BY 1, 2, 3""",
    "sla": f"""SELECT CAST(l_shipdate AS DATE) AS time, {LAT} AS lat, {LON} AS lon,
 round(avg(l_linenumber) * 0.05 - 0.2, 4) AS sla FROM lineitem GROUP BY 1, 2, 3""",
    "levels": f"""SELECT {DAC} AS dac, l_partkey AS profile_idx, {LEVEL} AS level_idx,
 {PRES} AS pres, {TEMP} AS temp, {PSAL} AS psal FROM lineitem""",
    "levels_adjusted": f"""SELECT {DAC} AS dac, l_partkey AS profile_idx, {LEVEL} AS level_idx,
 {PRES} AS pres, {TEMP} AS temp, {PSAL} AS psal,
 CASE WHEN l_returnflag <> 'N' THEN {PRES} END AS pres_adjusted,
 CASE WHEN l_partkey % 8 < 3 OR l_linenumber = 1 THEN round({TEMP} - 0.002E0, 4) END AS temp_adjusted,
 CASE WHEN l_partkey % 8 > 5 OR l_linenumber < 5 THEN round({PSAL} + 0.01E0, 4) END AS psal_adjusted
 FROM lineitem""",
    "profiles": f"""SELECT {DAC} AS dac, l_partkey AS profile_idx,
 round(-36 + 12 * (l_partkey % 6) + (l_partkey % 10) * 0.1E0, 2) AS lat,
 round(45 + 15 * (l_partkey % 4) + (l_partkey % 8) * 0.1E0, 2) AS lon,
 max(l_shipdate) AS time FROM lineitem GROUP BY l_partkey""",
    "floats": """SELECT CONCAT('f', CAST(l_suppkey % 50 AS VARCHAR(4))) AS float_id, l_orderkey * 8 + l_linenumber AS profile_idx,
 l_shipdate AS time, min(round(-30 + (l_partkey % 40) * 1.5E0, 2)) AS lat, min(round(45 + (l_orderkey % 30) * 2.0E0, 2)) AS lon
 FROM lineitem GROUP BY 1, 2, 3""",
    "indices": """SELECT CAST(o_orderdate AS DATE) AS time,
 (avg(CAST(round(o_totalprice) AS BIGINT)) - 250000) / 60000 AS enso,
 (avg(o_orderkey % 1000) - 500) / 150 AS dmi, (avg(o_custkey % 100) - 50) / 15 AS pdo
 FROM orders GROUP BY 1""",
    "observations": """SELECT ts AS time, CAST(-30 + 10 * (user_id % 4) AS DOUBLE) AS lat,
 CAST(40 + 15 * (user_id % 5) AS DOUBLE) AS lon, value AS sst FROM events""",
}

SOURCE = {"indices": "orders", "observations": "events"}


def table(spark, sf_dir, name):
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def mapped(spark, sf_dir, name):
    """One mapped table as a DataFrame."""
    source = SOURCE.get(name, "lineitem")
    text = MAPPINGS[name].replace(f"FROM {source}", f"FROM {{{source}}}")
    return spark.sql(text, **{source: table(spark, sf_dir, source)})
