"""The physical plans that matter at scale."""

import re

from halocline.operators import detect, profiles, quantiles, regions
from halocline.plans import pipeline
from halocline.sources import sinks
from halocline.sources.driver_tables import mapped

SF_DIR = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_profile_measures_combine_before_the_shuffle(spark):
    text = plan(profiles.profile_measures(profiles.valid_levels(mapped(spark, SF_DIR, "levels"))))
    assert text.count("Exchange hashpartitioning") == 2
    assert "SortAggregate(key=[dac#" not in text.split("Exchange hashpartitioning(dac")[-1]
    read = re.search(r"FileScan parquet \[([^\]]*)\]", text).group(1)
    assert "l_shipdate" not in read and "l_extendedprice" not in read


def test_heatwave_days_shuffle_the_grid_once_by_cell(spark):
    text = plan(detect.heatwave_days(mapped(spark, SF_DIR, "grid"), mapped(spark, SF_DIR, "indices")))
    assert len(re.findall(r"Exchange hashpartitioning\(knownfloating\w+\(normalizenanandzero\(lat#", text)) == 1
    assert "REPARTITION_BY_COL" not in text
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_quantiles_use_no_global_group(spark):
    text = plan(quantiles.exact_quantiles(mapped(spark, SF_DIR, "grid"), "sst", [0.5], ["lat"]))
    assert "CartesianProduct" not in text and "percentile(" not in text


def test_anomaly_and_quantile_share_one_placement(spark):
    text = plan(regions.basin_heatwaves_of(mapped(spark, SF_DIR, "grid")))
    by_cell = [line for line in text.splitlines() if "Exchange hashpartitioning(cell" in line]
    assert len(by_cell) == 1 and len(re.findall(r"Exchange hashpartitioning\(.*lat#", text)) == 0


def test_basin_metrics_place_the_grid_once(spark):
    measured = profiles.with_confidence(profiles.profile_physics(mapped(spark, SF_DIR, "levels"), mapped(spark, SF_DIR, "profiles")))
    text = plan(regions.basin_metrics_of(spark, measured, mapped(spark, SF_DIR, "grid")))
    by_cell = [line for line in text.splitlines() if "Exchange hashpartitioning(cell" in line]
    assert len(by_cell) == 1 and len(re.findall(r"Exchange hashpartitioning\(.*lat#", text)) == 0


def test_the_whole_run_computes_its_grids_once(spark, tmp_path, monkeypatch):
    """What comes after the first product of an input reads that product, with the same rows."""
    source, base, seen = str(tmp_path / "source"), str(tmp_path / "products"), {}
    day = "DATE '2020-01-01' + CAST(id % 5 AS INT) AS time, CAST(id % 3 AS DOUBLE) AS lat, CAST(id % 2 AS DOUBLE) AS lon"
    flux = ", ".join(f"CAST(id AS DOUBLE) AS {c}" for c in ("ssr", "str", "slhf", "sshf"))
    spark.sql(f"SELECT {day}, IF(id = 0, NULL, CAST(id AS DOUBLE)) AS sst, 1.0D AS u10, IF(id = 9, NULL, 2.0D) AS v10, {flux} FROM range(31)").write.parquet(source)
    rows = spark.read.parquet(source)
    sst, surface = rows.select("time", "lat", "lon", "sst"), rows.drop("sst")
    write = sinks.write_grid

    def write_grid(grid, path):
        seen[path.rsplit("/", 1)[1]] = grid.inputFiles()
        write(grid, path)

    def stop(base, sst, indices, physics):
        seen["later"] = sst.inputFiles()
        raise InterruptedError(sorted(map(str, sst.collect())))

    monkeypatch.setattr(sinks, "write_grid", write_grid)
    monkeypatch.setattr(pipeline, "run_detection", stop)
    levels, heads = mapped(spark, SF_DIR, "levels"), mapped(spark, SF_DIR, "profiles")
    try:
        pipeline.run_all(base, sst, surface, None, levels, heads, None)
    except InterruptedError as stopped:
        assert stopped.args[0] == sorted(map(str, sst.collect()))
    assert all("/wind_stress/" in f for f in seen["qnet"]) and all("/sst_anomaly/" in f for f in seen["later"])
    assert seen["qnet"] and seen["later"]
    qnet = spark.read.parquet(f"{base}/qnet").select(*surface.columns)
    assert sorted(map(str, qnet.collect())) == sorted(map(str, surface.collect()))
    assert pipeline._given(surface.withColumn("wind_speed", surface.u10), qnet, pipeline.ADDED).inputFiles() == rows.inputFiles()
