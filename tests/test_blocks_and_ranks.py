"""The bootstrap as a product of matrices, exact quartiles by brackets, lines over splits, headers that stop, odd paths, the velocity job."""

import gzip
import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from test_paths import header
from test_sources import put

from geostream import schemas
from geostream.operators import draws, faults, network, series
from geostream.plans import jobs
from geostream.sources import coordinates, headers, lines, reports
from geostream.sources import telemetry as sentences

# --- bootstrap ---

AXES = {"depth": [12.0, 14.0, 9.0], "width": [8.0, 12.0], "dip": [80.0, 90.0, 95.0], "east": [-3.0, 0.0]}
RATES = (18.0, 21.0, 40.0)
PROFILE = "sites string, dist_km double, v_across double, err double"


def stations(n, seed):
    """Two blocks that slip 20 past each other, a dislocation between them, and noise."""
    r = random.Random(seed)
    at = [r.uniform(-40, 40) for _ in range(n)]
    green = draws.strike_slip()({"depth": np.array([[12.0]]), "width": np.array([[11.0]]), "dip": np.array([[85.0]]), "east": np.array([[-1.0]])}, np.array([at]))[0]
    return [(f"s{i:02d}", x, (20 if x >= 0 else 0) + 15 * g + r.gauss(0, 0.5), r.uniform(0.5, 2)) for i, (x, g) in enumerate(zip(at, green.tolist()))]


def brute_best(spark, rows, ref, n_draws, size, seed):
    """Best models of each draw by a plain sum over the draw's stations."""
    n = len(rows)
    grid = [tuple(r) for r in faults.parameter_grid(spark, AXES).orderBy("grid_id").collect()]
    own = rows + ref
    x = np.array([r[1] for r in own])
    kernel = np.array([draws.strike_slip()({k: np.array([[v]]) for k, v in zip(AXES, g[1:])}, x[None, :])[0] for g in grid])
    out = {}
    for draw in range(n_draws):
        taken = [int(hashlib.md5(f"{seed}:{draw}:{p}".encode()).hexdigest()[:8], 16) % n for p in range(size or n)] + list(range(n, len(own)))
        models = []
        for g, k in zip(grid, kernel):
            for rate in RATES:
                d = np.array([own[i][2] - (rate if own[i][1] >= 0 else 0) for i in taken])
                w = np.array([1 / own[i][3] ** 2 for i in taken])
                gg = (w * k[taken] ** 2).sum()
                slip = (w * k[taken] * d).sum() / gg if gg else 0.0
                if slip <= rate:
                    models.append((math.sqrt((w * (d - slip * k[taken]) ** 2).sum() / w.sum()), g[0], rate, slip))
        if models:
            least = min(models)[0]
            out[draw] = sorted((g, rate) for wrms, g, rate, _ in models if wrms <= least * (1 + 1e-12))
    return out


@pytest.mark.parametrize("size", [None, 5])
def test_bootstrap_job_by_blocks_and_by_join(spark, size):
    rows, ref = stations(9, 3), [("ref", -0.5, 0.0, 0.1)]
    expected = brute_best(spark, rows, ref, 12, size, 4)
    profile, reference = spark.createDataFrame(rows, PROFILE), spark.createDataFrame(ref, PROFILE)
    assert len(expected) > 6 and len({str(x) for x in expected.values()}) > 2
    for most in (1 << 22, 1):
        best, bounds = jobs.bootstrap_uncertainty(profile, reference, AXES, RATES, n_draws=12, size=size, seed=4, most=most)
        got = {}
        for r in best.collect():
            got.setdefault(r.draw, []).append((r.grid_id, r.rate))
        assert {d: sorted(v) for d, v in got.items()} == expected
        assert {r.parameter for r in bounds.collect()} == {*AXES, "rate", "slip"}


def test_ties_of_a_draw_all_stay_over_blocks(spark):
    rows = stations(6, 8)
    grid = spark.createDataFrame([(i, 15.0, 10.0 + i % 2, 90.0) for i in range(500)], "grid_id long, depth double, width double, dip double")
    w = draws.weights(spark.createDataFrame(rows, PROFILE), None, 4, None, 1)
    best = draws.best_by_draw(grid, w, draws.strike_slip(turn=0.0), ("depth", "width", "dip"), (40.0,), block=16)
    assert all(r["count"] == 250 for r in best.groupBy("draw").count().collect()) and best.count() >= 250


def test_near_perfect_fits_rank_by_residuals(spark):
    """Of two models that leave 1e-9 and 3e-9 of the first sum, the difference of sums can't tell the better; residuals can."""
    x = np.linspace(-30, 30, 12)
    kernel = {0: np.arctan(x / 10) / np.pi, 1: np.arctan(x / (10 * (1 + 1e-8))) / np.pi}
    rows = [(f"s{i:02d}", float(a), float(20 * k), 1.0) for i, (a, k) in enumerate(zip(x, kernel[0] * (1 + 1e-7 * np.cos(7 * x))))]
    w = draws.weights(spark.createDataFrame([(s, -1.0 - i, v, e) for i, (s, _, v, e) in enumerate(rows)], PROFILE), None, 3, None, 2)
    grid = spark.createDataFrame([(0, 0.0), (1, 1.0)], "grid_id long, which double")
    best = draws.best_by_draw(grid, w, lambda c, _: np.array([kernel[int(i)] for i in c["which"][:, 0]]), ("which",), (1000.0,)).collect()
    for r in best:
        exact = []
        for k in (0, 1):
            times = w.counts[:, r.draw]
            s = (times * kernel[k] * w.v).sum() / (times * kernel[k] ** 2).sum()
            exact.append((times * (w.v - s * kernel[k]) ** 2).sum())
        assert r.grid_id == int(np.argmin(exact)) and r.chi2 == pytest.approx(min(exact), rel=1e-6)


def test_weights_of_nothing(spark):
    assert draws.weights(spark.createDataFrame([], PROFILE), None, 3, None, 1) is None


# --- quartiles ---


@pytest.mark.parametrize("accuracy", [20, 200, 10000])
def test_quantiles_by_brackets_are_exact(spark, accuracy):
    r = random.Random(accuracy)
    groups = {"many": [r.gauss(0, 1) for _ in range(3000)], "tied": [float(r.randrange(3)) for _ in range(2000)], "few": [1.5, -2.0, 9.0], "one": [4.0], "same": [7.0] * 100, "twin": [1.0] * 50 + [2.0] * 50, None: [0.5, 1.5]}
    rows = [(g, v, None if i % 3 else -v) for g, values in groups.items() for i, v in enumerate(values)] + [("void", None, None)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, "g string, a double, b double").repartition(4)
    qs = (0.0, 0.25, 0.5, 0.75, 1.0)
    got = {x.g: x for x in series.group_quantiles(df, ["g"], ["a", "b"], qs, accuracy).collect()}
    for g, values in groups.items():
        assert got[g].q_a == pytest.approx(np.quantile(values, qs), abs=1e-12)
        assert got[g].q_b == pytest.approx(np.quantile([-v for i, v in enumerate(values) if i % 3 == 0], qs), abs=1e-12)
    assert "void" not in got


def test_velocities_are_the_same_with_and_without_large_segments(spark):
    r = random.Random(2)
    rows = [(s, 2010 + i / 100, *(r.gauss(0, 1) * (50 if r.random() < 0.02 else 1) for _ in range(3))) for s, n in (("AAAA", 700), ("BBBB", 40), ("CCCC", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "station string, t double, east_m double, north_m double, up_m double")
    offsets = spark.createDataFrame([("AAAA", 2012.0)], "station string, date double")
    key = lambda x: (x.station, x.segment)
    one, two = (sorted(series.estimate_velocity(df, offsets, limit=limit).collect(), key=key) for limit in (1 << 17, 50))
    assert len(one) == 3 and one == two and any(x.outlier_epochs for x in one)
    flagged = [sorted((x.station, x.t, x.is_outlier) for x in series.flag_residual_iqr(df, limit=limit).collect()) for limit in (1 << 17, 50)]
    assert flagged[0] == flagged[1]


def test_velocities_from_coordinates(spark, tmp_path):
    """Files of daily positions to final velocities: a station that moves 10 mm/yr north and 20 east of a reference, with an outlier day and a jump."""
    lat, lon, radius = math.radians(14), math.radians(121), 6378137.0
    east = np.array([-math.sin(lon), math.cos(lon), 0])
    north = np.array([-math.sin(lat) * math.cos(lon), -math.sin(lat) * math.sin(lon), math.cos(lat)])
    ref = radius * np.array([math.cos(lat) * math.cos(lon), math.cos(lat) * math.sin(lon), math.sin(lat)])
    rng = np.random.default_rng(1)
    for year in (22, 23, 24):
        for day in range(1, 366, 8):
            t = 2000 + year + (day - 1) / 365.25
            move = 0.020 * (t - 2022) * east + 0.010 * (t - 2022) * north + rng.normal(0, 1e-4, 3) + (0.5 * east if t >= 2023.5 else 0) + (3 * north if (year, day) == (24, 97) else 0)
            body = "".join(f"{i + 1:3d}  {name:<16}{p[0]:15.5f}{p[1]:15.5f}{p[2]:15.5f}    A\n" for i, (name, p) in enumerate((("REFS 99001M001", ref), ("PBIS", ref + 1000 * east + move))))
            put(tmp_path, f"FIN_{year}{day:03d}.CRD", f"title\n\nNUM  STATION NAME\n{body}")
    offsets = spark.createDataFrame([("PBIS", 2023.5)], "station string, date double")
    got = jobs.velocities_from_coordinates(spark, str(tmp_path), "REFS", offsets).collect()
    assert [(x.station, x.segment, x.n_points, len(x.outlier_epochs)) for x in got] == [("PBIS", 1, got[0].n_points, 1)]
    assert (got[0].ve_mm_yr, got[0].vn_mm_yr) == pytest.approx((20, 10), abs=0.5) and abs(got[0].vu_mm_yr) < 0.5
    every = jobs.velocities_from_coordinates(spark, str(tmp_path), "REFS", offsets, selection=coordinates.read_offsets(spark, put(tmp_path / "none", "o", "")).select("station", F.col("date").alias("t")), mode="legacy").collect()
    assert abs(every[0].vn_mm_yr - 10) > 1


# --- lines and headers ---


def numbered(text):
    parts = text.split("\n")
    parts = parts[:-1] if parts[-1] == "" else parts
    return [(i, p.removesuffix("\r")) for i, p in enumerate(parts, 1)]


def test_lines_over_splits_have_the_numbers_of_the_file(spark, tmp_path):
    r = random.Random(7)
    texts = {"big": "".join("x" * r.randrange(0, 90) + r.choice(["\n", "\r\n", "\n\n"]) for _ in range(4000)), "open": "a\nb\r\nc", "none": "", "blank": "\n\n", "return": "a\rb\nc\n", "wide": "y" * 70_000 + "\n" + "z"}
    for name, text in texts.items():
        put(tmp_path / "in" / name, "f.txt", text)
    (tmp_path / "in" / "zip").mkdir()
    (tmp_path / "in" / "zip" / "f.txt.gz").write_bytes(gzip.compress(texts["big"].encode()))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        for whole in (lines.WHOLE, 1000, -1):
            df = lines.read_lines(spark, str(tmp_path / "in"), whole=whole)
            got = {}
            for x in df.collect():
                got.setdefault(x.file_path.split("/")[-2], []).append((x.line_no, x.line))
            assert {k: sorted(v) for k, v in got.items()} == {k: numbered(t) for k, t in [*texts.items(), ("zip", texts["big"])] if t}
        parts = spark.read.text(str(tmp_path / "in" / "big")).rdd.getNumPartitions()
        assert parts > 10
        plan = lines.read_lines(spark, str(tmp_path / "in"), whole=1000)._jdf.queryExecution().toString()
        assert "file_size" in plan
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)


ODD = ["plain", "with blank", "per%20cent", "plus+plus", "a b+c%é", "ünï", "100%"]


def test_paths_are_the_files_own(spark, tmp_path):
    for name in ODD:
        put(tmp_path / name, f"{name} PBIS0010.23o", header("PBIS", 30))
        put(tmp_path / "nmea" / name, f"{name}_1.txt", "$GNLVM\n")
    expected = {str(tmp_path / name / f"{name} PBIS0010.23o") for name in ODD}
    glob = "*.23o"
    assert {x.file_path for x in reports.scan_rinex_headers(spark, str(tmp_path), glob).collect()} == expected
    assert {x.file_path for x in lines.read_lines(spark, str(tmp_path), glob).collect()} == expected == {x.file_path for x in lines.read_lines(spark, str(tmp_path), glob, whole=-1).collect()}
    assert {x.file_path for x in lines.whole_files(spark, str(tmp_path), glob).collect()} == expected
    assert {x.file_path for x in reports.scan_qc_reports(spark, str(tmp_path), glob, with_path=True).collect()} == expected
    names = {f"{name}_1.txt" for name in ODD}
    assert {x.file_name for x in sentences.read_nmea(spark, str(tmp_path / "nmea")).collect()} == names
    stream = sentences.stream_nmea(spark, str(tmp_path / "nmea" / "*"))
    query = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert {x.file_name for x in spark.read.parquet(str(tmp_path / "out")).collect()} == names


def test_ingest_of_odd_paths(spark, tmp_path):
    for i, name in enumerate(ODD):
        put(tmp_path / name, f"{name} PBIS0010.23o", header("PBIS", 30 + i))
    empty = spark.createDataFrame([], schemas.INGESTION_LOG)
    new, failed, log = jobs.ingest(spark, str(tmp_path), empty, spark.createDataFrame([("PBIS",)], "station_code string"))
    assert {x.filepath for x in new.collect()} == {str(tmp_path / name / f"{name} PBIS0010.23o") for name in ODD} and failed.count() == 0
    assert {x.status for x in network.current_state(log).collect()} == {"success"}
    digest = {x.filepath: x.file_hash for x in new.collect()}
    assert all(hashlib.sha256(open(p, "rb").read()).hexdigest() == h for p, h in digest.items())


def test_headers_are_read_to_their_ends_and_no_further(spark, tmp_path):
    for i in range(5):
        put(tmp_path, f"f{i}.23o", header(f"ST{i:02d}", i) + "observations " * 200_000)
    put(tmp_path, "_hidden.23o", header("NONE", 1))
    put(tmp_path, "endless.23o", "x" * 500_000)
    put(tmp_path, "empty.23o", "")
    (tmp_path / "z.23o.gz").write_bytes(gzip.compress(header("GZIP", 7).encode()[:100]) + gzip.compress(header("GZIP", 7).encode()[100:] + b"data " * 100_000))
    got = {x.file_name: x for x in headers.read_headers(spark, str(tmp_path), chunk=4096, most=10_000).collect()}
    assert set(got) == {*(f"f{i}.23o" for i in range(5)), "endless.23o", "empty.23o", "z.23o.gz"}
    assert all(got[f"f{i}.23o"].bytes_read == 4096 and got[f"f{i}.23o"].size_bytes > 2_000_000 and got[f"f{i}.23o"].lines[-1].startswith(" " * 60 + "END OF HEADER") for i in range(5))
    assert got["endless.23o"].bytes_read <= 10_000 + 4096 and sum(map(len, got["endless.23o"].lines)) == 10_000
    assert {x.file_hash for x in got.values()} == {None}
    hashed = {x.file_name: x for x in headers.read_headers(spark, f"file://{tmp_path}", with_hash=True, taskBytes=1).collect()}
    for name, x in hashed.items():
        data = (tmp_path / name).read_bytes()
        assert (x.file_hash, x.bytes_read) == (hashlib.sha256(data).hexdigest(), len(data))
    scanned = {x.station_code for x in reports.scan_rinex_headers(spark, str(tmp_path)).collect()}
    assert scanned == {f"ST{i:02d}" for i in range(5)} | {"GZIP", None}


def test_review_fit_of_one_epoch_is_as_in_sql(spark, tmp_path):
    from datetime import datetime

    import duckdb

    from geostream.queries import ORACLE_SQL, QUERIES

    day, later = datetime(1995, 3, 1), datetime(1996, 3, 1)
    rows = [(1, 1, day, 1000.0), (2, 1, day, 2000.0), (3, 1, day, 4000.0), (4, 2, day, 1000.0), (5, 3, day, 1000.0), (6, 3, later, 3000.0), (7, 4, day, None), (8, 4, day, None)]
    df = spark.createDataFrame(rows, "o_orderkey long, o_custkey long, o_orderdate timestamp_ntz, o_totalprice double")
    df.write.parquet(f"{tmp_path}/orders.parquet")
    own = {r["station"]: str(r["rate"]) for r in QUERIES["review_fit"](spark, str(tmp_path)).collect()}
    c = duckdb.connect()
    c.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet/*.parquet'")
    assert own == {station: str(rate) for station, rate in c.execute(ORACLE_SQL["review_fit"]).fetchall()}
    assert own["1"] == "nan" and own["2"] == own["4"] == "0.0"
