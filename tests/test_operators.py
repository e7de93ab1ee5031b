import datetime as dt
import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from halocline.operators import axes, detect, events, fields, grid, nearest, profiles, quantiles, scans, series, thresholds, tracks
from halocline.sources import sinks, tables

DAY = dt.date(2020, 1, 1)


def levels(spark, rows):
    return spark.createDataFrame(rows, "dac string, profile_idx long, level_idx long, pres double, temp double, psal double")


def steps_from_density(spark, rho, pres):
    rows = [("a", 1, i, float(p), 10.0, r) for i, (p, r) in enumerate(zip(pres, rho))]
    df = levels(spark, [(a, b, c, p, t, 35.0) for a, b, c, p, t, _ in rows])
    table = spark.createDataFrame([(c, r) for _, _, c, _, _, r in rows], "level_idx long, rho double")
    return profiles.vertical_steps(profiles.unique_pressures(df.join(table, "level_idx")))


def mixed_depth(spark, rho, pres):
    s = steps_from_density(spark, rho, pres).where("mixed_depth is not null").orderBy("pres").first()
    return None if s is None else s["mixed_depth"]


def test_mixed_layer_threshold_crossed(spark):
    assert mixed_depth(spark, [1020.00, 1020.01, 1020.05], [0, 10, 20]) == pytest.approx(15.0)


def test_mixed_layer_never_crossed(spark):
    assert mixed_depth(spark, [1020.0] * 3, [0, 10, 20]) is None


def test_first_level_wins_at_equal_pressure(spark):
    df = levels(spark, [("a", 1, 5, 10.0, 9.0, 35.0), ("a", 1, 2, 10.0, 8.0, 35.0)])
    row = profiles.unique_pressures(profiles.with_density(df)).first()
    assert (row["temp"], row["n"], row["sum_temp"]) == (8.0, 2, 17.0)


def brute_profile(rows):
    """Plain NumPy version of the profile measures."""
    rows = sorted(rows)
    t, s, p = (np.array([r[i] for r in rows], float) for i in (2, 3, 1))
    ok = (p >= 0) & (p <= 10000) & (t > -5) & (t < 45) & (s > 0) & (s < 50)
    t, s, p = t[ok], s[ok], p[ok]
    if len(p) < 5:
        return None
    surf = p <= 20
    out = {"sst_argo": t[surf].mean() if surf.any() else None, "n": len(p)}
    u, first = np.unique(p, return_index=True)
    tu = t[first]
    keep = u <= 700
    out["ohc"] = 1025 * 3985 * np.trapezoid(tu[keep], u[keep]) if keep.sum() >= 2 else None
    deep = u >= 10
    td, ud = tu[deep], u[deep]
    grad = np.diff(td) / np.diff(ud)
    out["thermo"] = (ud[:-1] + ud[1:])[np.argmin(grad)] / 2 if len(ud) >= 3 else None
    return out


def test_profiles_match_brute_force_with_one_hot_profile(spark):
    rng = random.Random(3)
    rows = []
    for prof in range(12):
        n = 4000 if prof == 0 else rng.randint(3, 60)
        for i in range(n):
            pres = 99999.0 if rng.random() < 0.05 else rng.choice([2.0, 5.0, 12.0]) * rng.randint(0, 80)
            rows.append(("a", prof, i, pres, round(28 - pres * 0.01 + rng.random(), 3), round(34 + rng.random(), 3)))
    got = {r["profile_idx"]: r for r in profiles.profile_measures(profiles.valid_levels(levels(spark, rows))).collect()}
    for prof in range(12):
        want = brute_profile([(r[2], r[3], r[4], r[5]) for r in rows if r[1] == prof])
        if want is None:
            assert prof not in got
            continue
        g = got[prof]
        assert g["n_valid_levels"] == want["n"]
        for name, key in (("sst_argo", "sst_argo"), ("ohc_700m", "ohc"), ("thermocline", "thermo")):
            assert g[name] == (None if want[key] is None else pytest.approx(want[key]))


def daily(spark, shares):
    rows = [(DAY + dt.timedelta(days=i), s) for i, s in enumerate(shares)]
    return spark.createDataFrame(rows, "date date, frac_mhw double")


def test_persistence_starts_on_day_five(spark):
    d = series.with_persistence(daily(spark, [0.1] * 5 + [0.0] + [None])).orderBy("date")
    assert [r["is_mhw"] for r in d.collect()] == [False] * 4 + [True, False, False]
    b = series.with_persistence(daily(spark, [0.0] + [0.1] * 5 + [0.0]), backfill=True).orderBy("date")
    assert [r["is_mhw"] for r in b.collect()] == [False] + [True] * 5 + [False]


def event_days(spark, flags):
    rows = [
        (DAY + dt.timedelta(days=i), bool(f), 1.0, 0.5, 0.2, 1, p, "Neutral IOD")
        for i, (f, p) in enumerate(zip(flags, "AABBAABB"))
    ]
    return spark.createDataFrame(
        rows, "date date, is_mhw boolean, max_intensity double, mean_intensity double, frac_mhw double, mhw_category int, enso_phase string, iod_phase string"
    )


def test_event_open_at_end_first_peak_and_mode_tie(spark):
    got = events.heatwave_events(event_days(spark, [0, 1, 1, 0, 0, 1, 1, 1])).orderBy("event_id").collect()
    assert [(r["event_id"], r["duration_days"]) for r in got] == [(1, 2), (2, 3)]
    assert got[1]["end_date"] == DAY + dt.timedelta(days=7)
    assert got[0]["peak_date"] == DAY + dt.timedelta(days=1)
    assert got[0]["dominant_enso"] == "A" and got[0]["mean_confidence"] == 0.5


def test_event_days_add_up(spark):
    days = event_days(spark, [1, 0, 1, 1, 0, 0, 1, 1])
    assert events.heatwave_events(days).agg(F.sum("duration_days")).first()[0] == days.where("is_mhw").count()


def test_zero_spread_gives_no_score(spark):
    t = dt.datetime(2020, 3, 1)
    p = spark.createDataFrame([("a", 1, 1.0, 50.0, t, 20.0), ("a", 2, 9.0, 50.0, t, 20.0), ("a", 3, 9.0, 50.0, t, 20.0)],
                              "dac string, profile_idx long, lat double, lon double, time timestamp, mld double")
    idx = spark.createDataFrame([(DAY, 0.0, 0.0, 0.0)], "time date, enso double, dmi double, pdo double")
    for r in detect.unusual_mixed_layers(p, idx).collect():
        assert r["mld_zscore"] is None and r["mld_unusual"] is False and r["enso"] is None


def months(spark, values):
    rows = [(dt.date(2018 + i // 12, i % 12 + 1, 28), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "month_end date, v double")


def test_trend_rules(spark):
    flat = series.linear_trend(months(spark, [3.0] * 8), "v", "month_end").first()
    assert (flat["slope_per_year"], flat["r2"]) == (0.0, 0.0)
    assert series.linear_trend(months(spark, [1.0, 2.0, None, 3.0]), "v", "month_end").first()["slope_per_year"] is None
    gap = series.linear_trend(months(spark, [0.0, 1.0, None, 2.0, 3.0, 4.0, 5.0]), "v", "month_end").first()
    assert gap["slope_per_year"] == pytest.approx(12.0)


def test_centred_window(spark):
    v = [float(i * i % 7) for i in range(15)]
    got = series.with_centred_mean(months(spark, v), "v", "m").orderBy("month_end").collect()
    for i, r in enumerate(got):
        part = v[max(0, i - 6): i + 6]
        assert r["m"] == (pytest.approx(sum(part) / len(part)) if len(part) >= 6 else None)


def test_short_series_are_not_decomposed(spark):
    assert series.decompose(months(spark, [1.0] * 12), "v").count() == 0
    assert series.decompose(months(spark, [1.0] * 13), "v").count() == 13


def test_metrics_keep_or_drop_empty_days(spark):
    rows = [(DAY, 0.0, 0.0, 1.0), (DAY, 0.0, 1.0, -1.0), (DAY + dt.timedelta(days=1), 0.0, 0.0, None)]
    g = spark.createDataFrame(rows, "time date, lat double, lon double, intensity double")
    assert grid.daily_heatwave_metrics(g).count() == 1
    kept = grid.daily_heatwave_metrics(g, keep_empty=True).orderBy("date").collect()
    assert kept[0]["frac_mhw"] == 0.5 and kept[0]["mean_intensity"] == 1.0
    assert kept[1]["frac_mhw"] is None and kept[1]["max_intensity"] == 0.0 and kept[1]["mhw_category"] == 0


def test_exact_quantiles_with_ties_and_a_hot_key(spark):
    rng = random.Random(5)
    rows = [("hot", rng.choice([1.0, 1.0, rng.random() * 100])) for _ in range(6000)]
    rows += [("cold", rng.random()) for _ in range(37)] + [("one", 4.0), ("hot", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.05, 0.5, 0.77, 0.95, 1.0]
    got = {(r["k"], r["prob"]): r["quantile"] for r in quantiles.exact_quantiles(df, "v", probs, ["k"]).collect()}
    for k in ("hot", "cold", "one"):
        want = np.quantile([v for key, v in rows if key == k and v is not None], probs)
        for p, w in zip(probs, want):
            assert got[(k, p)] == pytest.approx(w)
    whole = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, "v", probs).collect()}
    assert list(whole[p] for p in probs) == pytest.approx(list(np.quantile([v for _, v in rows if v is not None], probs)))


def positions(spark):
    rng = random.Random(9)
    rows = [(f"f{0 if rng.random() < 0.4 else rng.randint(1, 6)}", i, dt.datetime(2020, 1, 1) + dt.timedelta(hours=rng.randint(0, 5000)), rng.randint(0, 40) / 2, rng.randint(80, 120) / 2) for i in range(900)]
    return rows, spark.createDataFrame(rows, "float_id string, profile_idx long, time timestamp, lat double, lon double")


def test_previous_position_over_months(spark):
    rows, df = positions(spark)
    got = {r["profile_idx"]: (r["prev_lat"], r["prev_lon"]) for r in tracks.with_previous_position(df).collect()}
    by_float = {}
    for r in sorted(rows, key=lambda r: (r[0], r[2], r[1])):
        before = by_float.get(r[0], (None, None))
        assert got[r[1]] == before
        by_float[r[0]] = (r[3], r[4])
    assert len(got) == len(rows)


def test_nearest_cell_matches_brute_force(spark):
    rows, df = positions(spark)
    cells = [(float(a), float(b)) for a in range(0, 20, 3) for b in range(40, 62, 3) if (a + b) % 4]
    grid_cells = spark.createDataFrame(cells, "lat double, lon double")
    got = {r["profile_idx"]: (r["cell_lat"], r["cell_lon"]) for r in nearest.nearest_cell(df, grid_cells, ["profile_idx"]).collect()}
    for r in rows:
        best = min((np.hypot(r[3] - a, r[4] - b), a, b) for a, b in cells)
        if best[0] < 2:
            assert got[r[1]] == best[1:]
        else:
            assert r[1] not in got


def test_nearest_cell_on_a_fine_grid(spark):
    """Cells 0.04 degrees apart with a hole; targets inside, in the hole and far outside."""
    rng = random.Random(3)
    targets = [(i, rng.uniform(-3, 7), rng.uniform(-3, 7)) for i in range(300)] + [(300, None, 1.0), (301, 60.0, 60.0)]
    df = spark.createDataFrame(targets, "i long, lat double, lon double")
    pairs = []
    for step in (16, 4):
        cells = [(k * step / 100, j * step / 100) for k in range(400 // step) for j in range(400 // step) if not (1 < k * step / 100 < 3 and 1 < j * step / 100 < 3)]
        fine = spark.createDataFrame(cells, "lat double, lon double")
        got = {r["i"]: (r["cell_lat"], r["cell_lon"]) for r in nearest.nearest_cell(df, fine, ["i"]).collect()}
        a = np.array(cells)
        for i, lat, lon in targets[:300]:
            d = np.sqrt((lat - a[:, 0]) ** 2 + (lon - a[:, 1]) ** 2)
            best = d.min()
            assert (i in got) == (best < 2)
            if i in got:
                assert np.hypot(lat - got[i][0], lon - got[i][1]) == pytest.approx(best, abs=1e-12)
        assert 300 not in got and 301 not in got
        spots = fine.select(F.col("lat").alias("cell_lat"), F.col("lon").alias("cell_lon"))
        levels = int(np.log2(2 / (step / 100)))
        pairs.append(nearest.candidate_squares(df, spots, ["i"], 2.0, levels).count())
    # sixteen times the cells, and about as many squares to look into
    assert pairs[1] < 2 * pairs[0] and pairs[1] < 302 * 60


def brute_time(targets, stored):
    out = {}
    for i, key, t in targets:
        own = sorted((s, v) for k, s, v in stored if k == key and s is not None)
        out[i] = None if t is None or not own else min(own, key=lambda r: (abs((r[0] - t).total_seconds()), r[0], r[1]))
    return out


@pytest.mark.parametrize("task_targets", [500_000, 7])
def test_nearest_in_time_matches_brute_force(spark, task_targets):
    """Keys that are NULL or have no rows, gaps over many chunks, ties, equal times, and one hot hour."""
    rng = random.Random(4)
    at = lambda: dt.datetime(2020, 1, 1) + dt.timedelta(minutes=30 * rng.randint(0, 4000))
    stored = [(rng.choice(["a", "b", None]), at(), rng.random()) for _ in range(60)] + [("a", None, 1.0), ("a", dt.datetime(2019, 1, 1), 0.5)]
    targets = [(i, rng.choice(["a", "b", None, "none"]), at()) for i in range(400)]
    targets += [(400 + i, "a", dt.datetime(2020, 1, 5, 10, i % 60)) for i in range(200)] + [(600, "a", None), (601, "b", dt.datetime(2031, 1, 1)), (602, "b", dt.datetime(1969, 5, 1))]
    left = spark.createDataFrame(targets, "i long, key string, time timestamp")
    right = spark.createDataFrame(stored, "key string, time timestamp, v double")
    got = nearest.nearest_in_time(left, right, ["v"], ["key"], task_targets=task_targets)
    assert got.columns == ["i", "key", "time", "nearest"]
    want = brute_time(targets, stored)
    assert {r["i"]: r["nearest"] and tuple(r["nearest"]) for r in got.collect()} == want
    keyless = nearest.nearest_in_time(left, right.drop("key"), ["v"], task_targets=task_targets)
    want = brute_time([(i, 0, t) for i, _, t in targets], [(0, s, v) for _, s, v in stored])
    assert {r["i"]: r["nearest"] and tuple(r["nearest"]) for r in keyless.collect()} == want
    assert {r["nearest"] for r in nearest.nearest_in_time(left, right.limit(0), ["v"]).collect()} == {None}


def test_seasonal_threshold_goes_round_new_year(spark):
    days = [("2019-12-30", 1.0), ("2019-12-31", 2.0), ("2020-12-31", 5.0), ("2020-01-01", 3.0), ("2021-01-02", 4.0), ("2020-07-01", 9.0), ("2020-07-02", None)]
    rows = [(dt.date.fromisoformat(d), 0.0, 0.0, v) for d, v in days] + [(dt.date(2020, 1, 1), 1.0, 0.0, 7.0)]
    df = spark.createDataFrame(rows, "time date, lat double, lon double, sst double")
    got = {(r["lat"], r["doy"]): r["threshold"] for r in thresholds.seasonal_threshold(df, "sst", 0.5, 1).collect()}
    # days 364, 365, 366, 1 and 2 of the ring: each pools itself and its two neighbours
    assert got == {(0.0, 364): 1.5, (0.0, 365): 2.0, (0.0, 366): 3.0, (0.0, 1): 4.0, (0.0, 2): 3.5, (0.0, 183): 9.0, (1.0, 1): 7.0}
    hot = {(r["lat"], str(r["time"])): r["intensity"] for r in thresholds.with_seasonal_intensity(df, "sst", 0.5, 1).collect()}
    assert hot[(0.0, "2020-01-01")] == -1.0 and hot[(0.0, "2020-12-31")] == 2.0 and hot[(0.0, "2020-07-02")] is None
    assert len(hot) == len(rows)


def test_merged_sketches_are_near_the_whole_record(spark, tmp_path):
    rng = random.Random(8)
    rows = [(dt.date(2000 + y, 1 + k // 28 % 12, 1 + k % 28), float(c), 0.0, rng.gauss(c, 3)) for c in range(3) for y in range(4) for k in range(700)]
    df = spark.createDataFrame(rows, "time date, lat double, lon double, sst double")
    path, target = str(tmp_path / "sketches"), str(tmp_path / "limits")
    for version, years in enumerate(((2000, 2001, 2002), (2003,))):
        thresholds.append_sketches(thresholds.yearly_sketches(df.where(F.year("time").isin(*years)), "sst"), path, version)
        thresholds.renew_thresholds(spark, path, target)
    # a year that comes again replaces its sketch
    thresholds.append_sketches(thresholds.yearly_sketches(df.where("year(time) = 2003"), "sst"), path, 2)
    assert thresholds.newest_sketches(spark, path).count() == 12
    for r in thresholds.newest_thresholds(spark, target).collect():
        own = np.array([v for _, c, _, v in rows if c == r["lat"]])
        assert (own < r["threshold"]).mean() <= 0.9 + thresholds.RANK_ERROR and (own <= r["threshold"]).mean() >= 0.9 - thresholds.RANK_ERROR


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("keys", [[], ["k"]])
def test_scans_give_the_rows_of_the_windows(spark, keys):
    """Runs over chunk borders, whole chunks of one kind, gaps of years, NULL keys and values."""
    rng = random.Random(12)
    start, rows = dt.datetime(2019, 11, 3), []
    for k in ("a", "b", None) if keys else ("a",):
        for i in range(700):
            share = 0.5 if 60 < i < 190 else rng.choice([0.0, 0.2, 0.3, None])
            rows.append((k, start + dt.timedelta(days=i + (2000 if i > 500 else 0), hours=5), share))
    df = spark.createDataFrame(rows, "k string, date timestamp, frac_mhw double").repartition(5)
    took = lambda d: sorted(map(str, d.select(*keys, "date", *[c for c in ("is_mhw", "event_id", "x") if c in d.columns]).collect()))
    flagged = series.with_persistence(df, keys=keys)
    long = scans.with_persistence(df, keys=keys)
    assert took(long) == took(flagged)
    runs = scans.with_event_start(flagged, keys=keys)
    assert took(runs) == took(events.with_event_start(flagged, keys))
    assert took(scans.with_ordinal(df, "frac_mhw", "date", keys)) == took(series.with_ordinal(df, "frac_mhw", "date", keys))
    trends = [t.select(*keys, F.round("slope_per_year", 9), F.round("r2", 9), "n_months") for t in (scans.linear_trend(df, "frac_mhw", "date", keys), series.linear_trend(df, "frac_mhw", "date", keys))]
    assert sorted(map(str, trends[0].collect())) == sorted(map(str, trends[1].collect()))
    import re

    for d in (long, scans.with_event_start(df.withColumn("is_mhw", F.col("frac_mhw") > 0.1), keys=keys), trends[0]):
        for window in re.findall(r"\n[^\n]*Window \[[^\n]*", plan_of(d)):
            assert "_chunk" in window


def test_axes_number_values_in_order(spark, tmp_path):
    rng = random.Random(6)
    values = [rng.choice([None, *[k / 4 for k in range(-200, 300)]]) for _ in range(4000)]
    df = spark.createDataFrame([(v, DAY + dt.timedelta(days=i % 50)) for i, v in enumerate(values)], "lat double, time date").withColumn("lon", F.lit(0.0)).repartition(3)
    want = sorted({v for v in values if v is not None})
    for ranges in (2, 64):
        assert [(r["lat"], r["position"]) for r in axes.numbered(df, "lat", ranges).orderBy("lat").collect()] == [(v, k) for k, v in enumerate(want)]
    axes.write_axes(df, str(tmp_path))
    stored = axes.read_axis(spark, str(tmp_path), "time")
    last = spark.range(1).select(axes.value_at(stored, "time", -1).alias("a"), axes.value_at(stored, "time", 2).alias("b"), axes.value_at(stored, "time", 99).alias("c")).first()
    assert tuple(last) == (DAY + dt.timedelta(days=49), DAY + dt.timedelta(days=2), None)
    assert {r["lat"] for r in grid.spatial_stride(df, 7).collect()} == set(want[::7])
    kept = grid.spatial_stride(df, 7, stored=str(tmp_path))
    assert kept.columns == df.columns and {r["lat"] for r in kept.collect()} == set(want[::7])
    assert len({r["time"] for r in grid.time_stride(df, 9).collect()}) == 9


def test_axes_of_a_derived_field_take_one_pass(spark, tmp_path):
    rows = [(DAY + dt.timedelta(days=d), float(a), float(b), 3.0 + d, 4.0) for d in range(5) for a in range(3) for b in range(4)]
    for k in range(2):  # a source of two rows per cell, from which the field is made
        spark.createDataFrame(rows, "time date, lat double, lon double, u10 double, v10 double").write.mode("append").parquet(f"{tmp_path}/source")
    field = spark.read.parquet(f"{tmp_path}/source").groupBy("time", "lat", "lon").agg(F.avg("u10").alias("u10"), F.avg("v10").alias("v10"))
    got = fields.stress_vectors(fields.wind_fields(field), -1, 2)
    rest = [grid.spatial_stride(field, 2), grid.time_stride(field, 2)]
    for df in (got, *rest):
        assert plan_of(df).count(str(tmp_path)[:40]) == 1  # plans cut long paths
    kept = {(r.time, r.lat, r.lon) for r in got.collect()}
    assert kept == {(DAY + dt.timedelta(days=4), a, b) for a in (0.0, 2.0) for b in (0.0, 2.0)}
    assert rest[0].count() == 5 * 4 and {r.time for r in rest[1].collect()} == {DAY, DAY + dt.timedelta(days=3)}


def test_quantiles_of_few_ranges_are_exact(spark):
    rng = random.Random(2)
    rows = [(rng.choice(["a", None]), float(rng.choice([rng.randint(0, 40), rng.gauss(0, 9)]))) for _ in range(3000)]
    df = spark.createDataFrame(rows, "k string, v double")
    probs = [0.0, 0.05, 0.5, 0.951, 1.0]
    for values in (10, 700, 10**6):
        for r in quantiles.exact_quantiles(df, "v", probs, ["k"], values).collect():
            assert r["quantile"] == pytest.approx(np.quantile([v for k, v in rows if k == r["k"]], r["prob"]), abs=1e-12)
        got = {r["prob"]: r["quantile"] for r in quantiles.exact_quantiles(df, "v", probs, range_values=values).collect()}
        assert got == pytest.approx({p: np.quantile([v for _, v in rows], p) for p in probs}, abs=1e-12)


def test_merge_in_two_batches_is_one_batch(spark):
    days = [(DAY + dt.timedelta(days=i), i) for i in range(10)]
    df = spark.createDataFrame(days, "date date, v int")
    old, new = df.where("v < 6").withColumn("v", F.lit(-1)), df.where("v >= 4")
    merged = sinks.merge_from_cutoff(old, new).orderBy("date").collect()
    assert [r["v"] for r in merged] == [-1] * 4 + list(range(4, 10))
    assert sinks.merge_from_cutoff(old, new.limit(0)).count() == 6


def test_reader_prunes_store_and_years(spark, tmp_path):
    df = levels(spark, [(f"dac{i % 3}", i, 0, 1.0, 2.0, 3.0) for i in range(30)])
    df.write.partitionBy("dac").parquet(str(tmp_path / "levels"))
    one = tables.read_profiles(spark, str(tmp_path / "levels"), "dac1")
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(dac" in plan and one.count() == 10
    with pytest.raises(FileNotFoundError):
        sinks.write_years(daily(spark, [0.1]), str(tmp_path / "years"))
        tables.read_years(spark, str(tmp_path / "years"), [1999])


def test_upload_without_valid_rows_fails(spark):
    have = spark.createDataFrame([(dt.datetime(2020, 1, 1), 1.0)], "time timestamp, lat double")
    bad = spark.createDataFrame([("soon", 1.0)], "time string, lat double")
    with pytest.raises(ValueError):
        sinks.append_upload(have, bad)


def test_lagged_correlation_of_constant_is_zero(spark):
    rows = [(DAY + dt.timedelta(days=i), 1.0, float(i % 5)) for i in range(40)]
    df = spark.createDataFrame(rows, "date date, enso double, m double")
    assert {r["m"] for r in series.lagged_correlation(df, ["enso"], ["m"]).collect()} == {0.0}


def test_keyed_sample_is_the_same_on_every_layout(spark):
    from halocline.operators import listing

    df = spark.range(500).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v"))
    want = set(sorted(range(500), key=lambda k: hashlib.md5(str(k).encode()).hexdigest())[:40])
    for pieces in (1, 7):
        assert {r["k"] for r in listing.top_sample(df.repartition(pieces), ["k"], 40).collect()} == want
    assert listing.top_sample(df, ["k"], 1000).count() == 500


def test_observation_threshold_equals_cell_threshold(spark):
    rng = random.Random(1)
    rows = [(float(rng.choice([0, 0, 0, 10])), 50.0, rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "lat double, lon double, sst double")
    a = {(r["lat"], r["lon"]): r["threshold"] for r in grid.observation_threshold(df, "sst").collect()}
    b = {(r["lat"], r["lon"]): r["threshold"] for r in grid.cell_threshold(df, "sst").collect()}
    assert a.keys() == b.keys() and all(a[k] == pytest.approx(b[k]) for k in a)


def test_running_persistence_drops_late_days(spark, tmp_path):
    from halocline.streaming import incremental, persistence

    src, out, ck = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for shares in ([(0, 0.1), (1, 0.1), (2, 0.1)], [(1, 0.0), (3, 0.1), (4, 0.1)], [(5, 0.0), (6, 0.2)]):
        rows = [("s", DAY + dt.timedelta(days=i), v) for i, v in shares]
        spark.createDataFrame(rows, "series string, date date, frac_mhw double").write.mode("append").parquet(src)
        stream = incremental.open_stream(spark, src)
        incremental.process_available(persistence.with_running_persistence(stream), out, ck)
    got = {r["date"]: r["is_mhw"] for r in spark.read.parquet(out).collect()}
    assert got == {DAY + dt.timedelta(days=i): i == 4 for i in range(7)}


def test_orders_put_missing_values_last(spark):
    from halocline.operators import listing, regions

    basins = spark.createDataFrame([("a", 0.1), ("b", None), ("c", 0.3)], "basin string, sst_trend_per_yr double")
    assert [r["basin"] for r in regions.rank_basins(basins).collect()] == ["c", "a", "b"]
    rows = [(f"p{i}", dt.datetime(2020, 1, 1 + i % 4), None if i % 5 == 0 else float(i % 3)) for i in range(20)]
    p = spark.createDataFrame(rows, "profile_id string, time timestamp, sst_argo double")
    got = [r["profile_id"] for r in listing.order_profiles(p, "sst_desc").collect()]
    want = sorted(rows, key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
    assert got == [r[0] for r in want]
    newest = listing.order_profiles(p)
    pages = [r["profile_id"] for k in (1, 2, 3) for r in listing.page(newest, k, 7).collect()]
    assert pages == [r["profile_id"] for r in newest.collect()]
    last = newest.offset(6).first()
    after = [r["profile_id"] for r in listing.page_after(p, str(last["time"]), last["profile_id"], 7).collect()]
    assert after == pages[7:14]


def test_event_orders(spark):
    rows = [(1, dt.date(2020, 1, 1), 5, 2.0), (2, dt.date(2020, 2, 1), 9, 1.0), (3, dt.date(2020, 3, 1), 7, 3.0)]
    e = spark.createDataFrame(rows, "event_id int, start_date date, duration_days int, peak_intensity double")
    order = {s: [r["event_id"] for r in events.order_events(e, s).collect()] for s in ("date", "intensity", "duration")}
    assert order == {"date": [3, 2, 1], "intensity": [3, 1, 2], "duration": [2, 3, 1]}


def test_quantiles_keep_a_null_key(spark):
    df = spark.createDataFrame([(None, 1.0), (None, 3.0), ("a", 5.0)], "k string, v double")
    rows = {r.k: r.quantile for r in quantiles.exact_quantiles(df, "v", [0.5], ["k"]).collect()}
    assert rows == {None: 2.0, "a": 5.0}


def test_frames_span_the_record(spark):
    df = spark.createDataFrame([(DAY + dt.timedelta(days=k),) for k in range(47)], "time date")
    days = sorted((r.time - DAY).days for r in grid.time_stride(df, 24).collect())
    assert days == list(range(0, 47, 2)) and grid.time_stride(df, None).count() == 47


def test_grid_rows_of_a_fine_grid(spark):
    points = [(0.05 * i, 0.05 * j, float(i + j)) for i in range(3) for j in range(3)]
    df = spark.createDataFrame(points, "latitude double, longitude double, sst_anomaly double")
    rows = {r.lat: list(r.row_values) for r in grid.grid_rows(df).collect()}
    assert len(rows) == 3 and rows[0.05] == [1.0, 2.0, 3.0]


def test_confidence_counts_every_day(spark):
    sst = spark.createDataFrame([(DAY + dt.timedelta(days=k), 0.0, 0.0, None if k == 40 else 20.0) for k in range(60)], "time date, lat double, lon double, sst double")
    sla = spark.createDataFrame([(DAY + dt.timedelta(days=k), float(k)) for k in range(60)], "time date, sla double")
    qnet = spark.createDataFrame([(1.0,), (2.0,)], "qnet double")
    wind = spark.createDataFrame([(1.0,), (2.0,)], "wind_speed double")
    rows = {r.field: r for r in grid.grid_uncertainty(sst, qnet, wind, sla).collect()}
    assert rows["sst"].min_confidence == 0.0 and rows["sla"].sla_mean_m == 29.5


def test_rows_without_a_date_are_written_once(spark, tmp_path):
    df = spark.createDataFrame([(DAY, 1), (None, 2)], "date date, v int")
    for _ in range(2):
        rows = sinks.write_years(df, str(tmp_path / "years"))
    assert sorted((r.v, r.year) for r in rows.collect()) == [(1, 2020), (2, None)]
    with pytest.raises(ValueError):
        sinks.relayout(rows.withColumnRenamed("v", "lat"), str(tmp_path / "years"))


def test_named_columns_keep_one_depth_and_years_are_pruned(spark, tmp_path):
    rows = [(dt.datetime(y, 5, 1), 1.0, 2.0, z, 20.0 + z) for y in (2019, 2020, 2021) for z in (0.0, 10.0)]
    df = spark.createDataFrame(rows, "time timestamp, latitude double, longitude double, zlev double, sst double")
    sinks.write_grid(df.withColumnsRenamed({"latitude": "lat", "longitude": "lon"}), str(tmp_path / "grid"))
    read = tables.read_grid(spark, str(tmp_path / "grid"), ["time", "sst"], start="2020-01-01", end="2020-12-31", box=(0, 3, 0, 3))
    assert [r.sst for r in read.collect()] == [20.0]
    text = read._jdf.queryExecution().executedPlan().toString()
    assert "year" in text.split("PartitionFilters: [")[1].split("]")[0]


def test_running_persistence_takes_late_pieces_of_a_batch(spark, tmp_path):
    from halocline.streaming import persistence

    days = [("s", DAY + dt.timedelta(days=k), 0.5) for k in reversed(range(10))]
    spark.createDataFrame(days, "series string, date date, frac_mhw double").coalesce(1).write.parquet(str(tmp_path / "in"))
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        stream = spark.readStream.schema("series string, date date, frac_mhw double").parquet(str(tmp_path / "in"))
        query = (
            persistence.with_running_persistence(stream).writeStream.format("parquet")
            .option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start(str(tmp_path / "out"))
        )
        query.awaitTermination()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    rows = spark.read.parquet(str(tmp_path / "out")).orderBy("date").collect()
    assert [r.is_mhw for r in rows] == [False] * 4 + [True] * 6


def test_a_cluster_needs_a_shared_folder(spark):
    from halocline import session

    class Fake:
        def __init__(self, master):
            self.values = {"spark.master": master}
            self.conf = self

        def get(self, key, default=None):
            return self.values.get(key, default)

        def set(self, key, value):
            self.values[key] = value

    with pytest.raises(ValueError):
        session.shared_dir(Fake("spark://host:7077"), "x")
    assert session.shared_dir(Fake("local[4]"), "x")


def test_raw_levels_and_times_are_taken_as_they_come(spark):
    rows = [("a", 1, k, 10.0 * k, 20.0 - k, 35.0, 10.0 * k, 19.0 - k) for k in range(12)]
    names = "dac string, profile_idx long, level_idx long, pres double, temp double, psal double, pres_adjusted double, temp_adjusted double"
    raw = spark.createDataFrame(rows, names)
    heads = spark.createDataFrame([("a", 1, 5.0, 70.0, 1_600_000_000_123_456_789)], "dac string, profile_idx long, lat double, lon double, juld long")
    row = profiles.profile_physics(raw, heads).first()
    assert row.sst_argo == pytest.approx(18.0) and row.time.year == 2020
    plain = raw.drop("pres_adjusted", "temp_adjusted")
    assert profiles.choose_adjusted(plain).columns == plain.columns
    assert profiles.choose_adjusted(raw.withColumn("dac", F.lit(None).cast("string"))).count() == 12


def test_folding_keeps_the_merged_rows(spark, tmp_path):
    from halocline.streaming import incremental

    old, new = str(tmp_path / "old"), str(tmp_path / "new")
    batches = [[(1, "a"), (2, "a"), (3, "a")], [(2, "b"), (4, "b")], [(4, "c"), (5, "c")]]
    frames = [spark.createDataFrame([(DAY + dt.timedelta(days=d), v) for d, v in b], "date date, v string") for b in batches]
    for k, df in enumerate(frames[:2]):
        incremental.write_batch(df, k, old, "date")
    incremental.fold_merged(spark, old, new)
    for target in (old, new):
        incremental.write_batch(frames[2], 2, target, "date")
    rows = [sorted(tuple(r) for r in incremental.read_merged(spark, t).collect()) for t in (old, new)]
    assert rows[0] == rows[1] and [v for _, v in rows[0]] == ["a", "b", "c", "c"]


def test_ordered_persistence_over_late_days_and_restarts(spark, tmp_path):
    """Reordered, late, repeated and undated rows, a restart between batches, and a timer that closes the rest."""
    from halocline.streaming import incremental, late

    path, target, checkpoint = (str(tmp_path / n) for n in ("in", "out", "mark"))
    day = lambda k: DAY + dt.timedelta(days=k)
    batches = [
        [("a", day(k), 0.5) for k in (3, 0, 2, 1, 4)] + [("b", day(0), None)],
        [("a", day(k), 0.5) for k in (6, 5, 0)] + [("a", None, 0.1), ("a", day(6), 0.7), ("b", day(9), 0.9)],
        [("a", day(9), 0.0), ("a", day(7), 0.5), ("a", day(2), 0.5)],
        [("c", day(0), 0.5)],
    ]
    idle = "spark.sql.streaming.noDataMicroBatches.enabled"
    before = {c: spark.conf.get(c) for c in (late.STORE_CONF, idle)}
    spark.conf.set(late.STORE_CONF, late.STORE)
    spark.conf.set(idle, "false")
    try:
        for rows in batches:
            spark.createDataFrame(rows, "series string, date date, frac_mhw double").coalesce(1).write.mode("append").parquet(path)
            stream = late.with_ordered_persistence(incremental.open_stream(spark, path), delay_days=2, idle_seconds=0)
            incremental.process_available(stream, target, checkpoint, state_partitions=2)
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    got = sorted((tuple(r) for r in spark.read.parquet(target).collect()), key=str)
    days = {(s, d): f for s, d, _, f, kind in got if kind == "day"}
    assert {d for s, d in days if s == "a"} == {day(k) for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)}
    flags = [days[("a", day(k))] for k in (0, 1, 2, 3, 4, 5, 6, 7, 9)]
    assert flags == [False] * 4 + [True] * 4 + [False]
    assert sorted((s, d, x) for s, d, x, f, kind in got if kind == "late") == [("a", day(0), 0.5), ("a", day(2), 0.5)]
    assert [(s, d, x) for s, d, x, f, kind in got if kind == "repeated"] == [("a", day(6), 0.7)]
    assert [(s, d, x) for s, d, x, f, kind in got if kind == "undated"] == [("a", None, 0.1)]
    assert days[("b", day(0))] is False and ("b", day(9)) in days


def test_no_table_is_written_onto_its_own_folder(spark, tmp_path):
    path = str(tmp_path / "grid")
    df = spark.createDataFrame([(DAY, 0.0, 1.0, 2.0)], "time date, lat double, lon double, sst double")
    sinks.write_grid(df, path)
    sinks.write_grid(df, path)
    stored = spark.read.parquet(path)
    for write in (sinks.write_grid, sinks.write_result):
        with pytest.raises(ValueError):
            write(stored, path)
    assert stored.count() == 1
