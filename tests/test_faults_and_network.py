"""Dislocations, grid search, sinks, upserts, coverage."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from geostream.operators import faults, network, series
from geostream.sources import sinks


def test_infinite_strike_slip():
    """A very long vertical fault from the surface to depth D: v = s / pi * atan(D / x)."""
    x = np.array([2.0, 5.0, 20.0])
    n = len(x)
    got = faults.displacement(np.full(n, 1e5), np.full(n, 10.0), np.full(n, 10.0), np.full(n, 90.0), np.zeros(n), np.zeros(n), np.zeros(n), (1.0, 0.0, 0.0), x, np.zeros(n))
    assert np.abs(got[:, 1]) == pytest.approx(np.arctan(10 / x) / math.pi, rel=1e-3)


def test_published_case():
    """Okada (1985), table 2, case 2: x=2, y=3, d=4, dip 70, L=3, W=2, unit slips."""
    one = [np.array([v]) for v in (3.0, 2.0, 4.0, 70.0, 90.0, 1.5, 0.0)]
    expected = {(1.0, 0.0, 0.0): (-8.689e-3, -4.298e-3, -2.747e-3), (0.0, 1.0, 0.0): (-4.682e-3, -3.527e-2, -3.564e-2), (0.0, 0.0, 1.0): (-2.660e-4, 1.056e-2, 3.214e-3)}
    for slips, values in expected.items():
        assert faults.displacement(*one, slips, np.array([2.0]), np.array([3.0]))[0] == pytest.approx(values, rel=2e-3)


def test_unphysical_moves_nothing():
    one = [np.array([v]) for v in (3.0, 20.0, 4.0, 70.0, 90.0, 1.5, 0.0)]
    assert not faults.displacement(*one, (1.0, 0.0, 0.0), np.array([2.0]), np.array([3.0])).any()


def test_grid_recovers_slip(spark):
    stations = spark.createDataFrame([(f"s{i}", float(x)) for i, x in enumerate((-40, -20, -8, -3, 4, 9, 25, 50))], "sites string, dist_km double")
    grid = faults.parameter_grid(spark, {"depth": [0.0, 2.0], "width": [8.0, 12.0], "dip": [-95.0, -90.0]})
    assert grid.count() == 8 and grid.select("depth", "width", "dip").distinct().count() == 8
    names = {"length": 1000.0, "width": "width", "depth": "depth", "dip": "dip", "strike": 0.0, "east": 0.0, "north": 0.0, "x": "dist_km", "y": 0.0}
    moved = faults.with_green(faults.expand_grid(stations, grid), names)
    true = moved.filter("grid_id = 5").select("sites", (F.col("green_n") * 3).alias("d"))
    scored = faults.score_grid(moved.join(true, "sites").withColumn("err", F.lit(1.0)), ["grid_id"]).withColumn("rate", F.lit(30.0))
    best = faults.best_by_wrms(scored).collect()
    assert [b.grid_id for b in best] == [5] and best[0].slip == pytest.approx(3.0)


def test_patches_identity(spark):
    fault = spark.createDataFrame([(50.0, 10.0, 10.0, 45.0, 75.0, 1.0, 2.0)], "length double, width double, depth double, dip double, strike double, east double, north double")
    one = faults.patches(fault, 1, 1).first()
    assert (one.length, one.width, one.depth, one.east, one.north) == pytest.approx((50.0, 10.0, 10.0, 1.0, 2.0))
    assert sorted({round(p.depth, 4) for p in faults.patches(fault, 2, 2).collect()}) == [6.4645, 10.0]


def test_velocity_recovery(spark):
    rng = np.random.default_rng(3)
    t = np.linspace(2010, 2016, 800)
    e = np.where(t < 2013, 0.010 * t, 0.020 * t + 1) + rng.normal(0, 1e-5, 800)
    e[100] += 1.0
    rows = spark.createDataFrame([("ABCD", float(a), float(b), float(-0.005 * a), 0.0) for a, b in zip(t, e)], "station string, t double, east_m double, north_m double, up_m double")
    offsets = spark.createDataFrame([("ABCD", 2013.0), ("ABCD", 2099.0)], "station string, date double")
    got = series.estimate_velocity(rows, offsets).orderBy("segment").collect()
    assert [x.ve_mm_yr for x in got] == pytest.approx([10, 20], abs=0.05) and got[0].vn_mm_yr == pytest.approx(-5)
    assert len(got[0].outlier_epochs) == 1 and got[1].outlier_epochs == []
    assert series.final_velocity(series.estimate_velocity(rows, offsets)).first().segment == 1
    assert series.estimate_velocity(rows, offsets, mode="legacy").count() == 2


def test_ranges_and_gaps(spark):
    days = spark.createDataFrame([("A", 2024, d) for d in (1, 2, 3, 7, 366)], "station string, year int, doy int")
    row = network.coverage_report(days).first()
    assert (row.with_data, row.gaps, row.n_days, row.year_days) == ("1---3, 7, 366", "4---6, 8---365", 5, 366)


def test_log_and_upsert(spark):
    log = spark.createDataFrame([("h1", "a", "pending", 1), ("h2", "b", "pending", 1)], "file_hash string, filename string, status string, seq long")
    results = spark.createDataFrame([("h1", True, None, 10, 1, 0.1, 0.2), ("h2", False, "bad", None, None, None, None)], "file_hash string, ok boolean, error_message string, obs_count int, cycle_slips int, mp1_rms double, mp2_rms double")
    state = {r.file_hash: r for r in network.current_state(network.advance_log(log, results)).collect()}
    assert state["h1"].status == "success" and state["h1"].qc_obs_count == 10 and state["h2"].error_message == "bad"
    old = spark.createDataFrame([("A", "old", "x")], "station_code string, name string, agency string")
    new = spark.createDataFrame([("A", "new", "y"), ("B", "b", "y")], "station_code string, name string, agency string")
    assert sorted(map(tuple, network.upsert_stations(old, new).collect())) == [("A", "new", "x"), ("B", "b", "y")]


def test_missing_products(spark):
    files = spark.createDataFrame([("COD0OPSFIN_20223310000_01D_05M_ORB.SP3.gz",)], "file_name string")
    got = network.missing_products(spark, "2022-11-20", "2022-11-27", files)
    assert [(str(x.date), x.content) for x in got.collect()] == [("2022-11-27", "CLK")]


def test_appends_are_idempotent(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "S", 1.0), ("2024-01-01 00:00:01", "S", 2.0)], "time string, station_code string, v_east double").withColumn("time", F.col("time").cast("timestamp"))
    path = str(tmp_path / "v")
    for df in (rows, rows, rows.withColumn("v_east", F.lit(9.0))):
        sinks.append_velocities(df, path)
    assert sorted(r.v_east for r in spark.read.parquet(path).collect()) == [1.0, 2.0]
    assert sinks.apply_retention(spark, path, "2024-03-15", 60).count() == 0


def test_cleaned_series(spark, tmp_path):
    rows = spark.createDataFrame([("ABCD", 2010.0 + i / 100, 0.0, 0.0, 0.0) for i in range(5)], "station string, t double, east_m double, north_m double, up_m double")
    selection = spark.createDataFrame([("ABCD", 2010.01004)], "station string, t double")
    assert sinks.write_cleaned_series(rows, selection, str(tmp_path)) == 1 == sinks.write_cleaned_series(rows, selection, str(tmp_path))
    sinks.write_outliers(selection, str(tmp_path / "o"))
    assert spark.read.text(str(tmp_path / "o")).first()[0] == "ABCD 2010.0100"


def test_models_of_equal_shape_share_their_sums(spark):
    import random

    from pyspark.sql import functions as F

    from geostream.operators import faults

    rnd = random.Random(3)
    rows = [(i, float(i % 5 - 2), None if i == 7 else rnd.uniform(-40, 40), rnd.uniform(0.1, 1)) for i in range(40)]
    profile = spark.createDataFrame(rows, "sites int, dist_km double, v_across double, err double")
    points = [(i, float(i % 3 + 5), None if i == 11 else float(i % 4 + 25)) for i in range(60)]
    grid = spark.createDataFrame(points, "grid_id int, lock double, rate double")
    seen = []

    def green(df):
        seen.append(df.count())
        return df.withColumn("green_n", F.atan(F.col("dist_km") / F.col("lock")))

    by = ["grid_id", "lock", "rate"]
    own = {r["grid_id"]: r for r in faults.score_models(profile, grid, by, ["lock"], green).collect()}
    expanded = faults.back_slip(faults.expand_grid(profile, grid), F.col("rate")).withColumn("green_n", F.atan(F.col("dist_km") / F.col("lock")))
    whole = {r["grid_id"]: r for r in faults.score_grid(expanded, by).collect()}
    assert seen == [3 * 5]  # shapes x distances
    assert own.keys() == whole.keys() and len(own) == 60
    for k, r in whole.items():
        assert all(abs(own[k][c] - r[c]) <= 1e-9 * (1 + abs(r[c])) for c in ("slip", "chi2", "rchi2", "wrms")), (k, r, own[k])
