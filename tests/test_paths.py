"""Files of equal names in different folders, ingestion, retention, running sums, gaps."""

import random

import pytest
from pyspark.sql import functions as F
from test_sources import put

from geostream import schemas
from geostream.operators import archive, faults, network, ordered
from geostream.plans import jobs
from geostream.sources import coordinates as c
from geostream.sources import reports as r
from geostream.sources import shared, sinks
from geostream.sources import telemetry as s


def line(value, label):
    return f"{value:<60}{label:<20}\n"


def header(station, interval, mark=True):
    text = line("     2.11", "RINEX VERSION / TYPE") if mark else line("", "COMMENT")
    return text + line(station, "MARKER NAME") + line(f"{interval:10.3f}", "INTERVAL") + line("", "END OF HEADER") + "data\n" * 50 + line("LATER", "MARKER NAME")


def test_headers_of_equal_names(spark, tmp_path):
    put(tmp_path / "2023", "PBIS0010.23o", header("PBIS", 30))
    put(tmp_path / "2024", "PBIS0010.23o", header("CUSV", 15, mark=False))
    got = {(x.station_code, x.sampling_interval, x.has_marker, x.file_path.split("/")[-2]) for x in r.scan_rinex_headers(spark, str(tmp_path)).collect()}
    assert got == {("PBIS", 30.0, True, "2023"), ("CUSV", 15.0, False, "2024")}


def test_mark_has_to_be_early(spark, tmp_path):
    put(tmp_path, "a.23o", line("", "COMMENT") * 9 + header("AAAA", 1))
    put(tmp_path, "b.23o", line("", "COMMENT") * 10 + header("BBBB", 1))
    assert {x.station_code: x.has_marker for x in r.scan_rinex_headers(spark, str(tmp_path)).collect()} == {"AAAA": True, "BBBB": False}


def test_tables_of_equal_names(spark, tmp_path):
    for folder, x in (("a", 1), ("b", 5)):
        put(tmp_path / "lines" / folder, "line.txt", f"> s\n{x} 2\n{x + 1} 4\n")
        put(tmp_path / "geometry" / folder, "t.txt", f"{x} 2 3 4 5\n{x + 1} 2 3 4 5\n")
        for axis in "xyz":
            put(tmp_path / axis / folder, "t.txt", f"{x} 1 2 3\n{x} 4 5 6\n")
        put(tmp_path / "slips" / folder, "t.txt", f"0 0 {x}\n0 0 {x}\n")
        put(tmp_path / "sta" / folder, "f.STA", f"TYPE 00{2 if x == 1 else 1}:\n" + f"{folder * 4:<69}{'REC':<52}{'ANT':<20}\n")
        put(tmp_path / "crd" / folder, "FIN_23001.CRD", f" 1  {folder * 4}   {x}.5 2.5 3.5\n")
        put(tmp_path / "nmea" / folder, "PBIS_1.txt", f"${folder}\n$z\n")
        put(tmp_path / "qc" / folder, "q.txt", f"# obs : {x}\n")
    points = c.read_polylines(spark, str(tmp_path / "lines")).orderBy("file_path", "seq").collect()
    assert [(p.segment_id, p.seq, p.lon) for p in points] == [(1, 1, 1.0), (1, 2, 2.0), (1, 1, 5.0), (1, 2, 6.0)]
    patches = c.read_patches(spark, *[str(tmp_path / x) for x in ("geometry", "x", "y", "z", "slips")]).collect()
    assert sorted((p.row, p.length, p.x1, p.slip) for p in patches) == [(1, 1.0, 1.0, 1.0), (1, 5.0, 5.0, 5.0), (2, 2.0, 1.0, 1.0), (2, 6.0, 5.0, 5.0)]
    assert [x.station_code for x in r.scan_station_info(spark, str(tmp_path / "sta")).collect()] == ["aaaa"]
    assert {(x.station, x.file_path.split("/")[-2]) for x in c.read_crd(spark, str(tmp_path / "crd")).collect()} == {("AAAA", "a"), ("BBBB", "b")}
    rows = s.read_nmea(spark, str(tmp_path / "nmea")).orderBy("file_name", "file_path", "line_no").collect()
    assert [x.sentence for x in rows] == ["$a", "$z", "$b", "$z"]
    assert {(x.obs_count, x.file_path.split("/")[-2]) for x in r.scan_qc_reports(spark, str(tmp_path / "qc"), with_path=True).collect()} == {(1, "a"), (5, "b")}


def test_ingest(spark, tmp_path):
    """New files are catalogued, a done one is left alone, and each failure has its reason; the log learns of all."""
    put(tmp_path / "a", "PBIS0010.23o", header("PBIS", 30))
    put(tmp_path / "b", "PBIS0010.23o", header("CUSV", 15))
    put(tmp_path / "c", "XXXX0010.23o", header("XXXX", 15))
    put(tmp_path / "d", "MARK0010.23o", header("PBIS", 1, mark=False))
    put(tmp_path / "e", "DONE0010.23o", header("PBIS", 5))
    put(tmp_path / "e", "notes.txt", "x")
    stations = spark.createDataFrame([("PBIS",), ("CUSV",)], "station_code string")
    empty = spark.createDataFrame([], schemas.INGESTION_LOG)
    _, _, first = jobs.ingest(spark, str(tmp_path / "e"), empty, stations)
    assert [x.status for x in network.current_state(first).collect()] == ["success"]
    qc = spark.createDataFrame([(f"file:{tmp_path}/a/PBIS0010.23o", "q", 7, 1, 0.5, 0.25)], "file_path string, file_name string, obs_count int, cycle_slips int, mp1_rms double, mp2_rms double")
    new, failed, log = jobs.ingest(spark, str(tmp_path), first, stations, qc)
    assert sorted((x.station_code, x.sampling_interval, x.obs_count) for x in new.collect()) == [("CUSV", 15.0, None), ("PBIS", 30.0, 7)]
    assert {(x.filename, x.error_message) for x in failed.collect()} == {("XXXX0010.23o", "unknown station XXXX"), ("MARK0010.23o", "no format marker")}
    state = {x.filepath.split("/")[-2]: (x.status, x.qc_obs_count, x.seq) for x in network.current_state(log).collect()}
    assert state == {"a": ("success", 7, 2), "b": ("success", None, 2), "c": ("failed", None, 2), "d": ("failed", None, 2), "e": ("success", None, 2)}
    again, failed, _ = jobs.ingest(spark, str(tmp_path), log, stations)
    assert again.count() == 0 and failed.count() == 2


def test_expired_partitions_go(spark, tmp_path):
    path = str(tmp_path / "v")
    rows = spark.range(100).select(F.expr("timestamp'2024-01-01' + make_interval(0, 0, 0, int(id))").alias("time"), F.lit("S").alias("station_code"))
    sinks.append_velocities(rows, path)
    gone = sinks.drop_expired(spark, path, "2024-04-01", 30)
    assert gone[0] == "2024-01-01" and gone[-1] == "2024-03-01" and spark.read.parquet(path).count() == 100 - len(gone)
    assert sinks.drop_expired(spark, path, "2024-04-01", 30) == [] and sinks.apply_retention(spark, path, "2024-04-01", 30).count() == 100 - len(gone)


def test_running_sums_over_many_ranges(spark):
    r = random.Random(1)
    rows = [(i, r.randrange(100)) for i in range(500)]
    r.shuffle(rows)
    got = ordered.running_sum(spark.createDataFrame(rows, "i int, x int").repartition(7), ("i",), F.col("x"), "total").orderBy("i").collect()
    total = 0
    for row, (_, x) in zip(got, sorted(rows)):
        total += x
        assert row.total == total
    assert [x.n for x in ordered.number_rows(spark.createDataFrame(rows, "i int, x int"), ("i",), "n").orderBy("i").collect()] == list(range(1, 501))


def test_inconsistent_from_where_the_sum_exceeds(spark):
    rows = spark.createDataFrame([("a", 5), ("b", None), ("c", 4), ("d", 2)], "path string, size_bytes long")
    assert [(x.path, x.claimed_bytes, x.inconsistent) for x in archive.flag_inconsistent(rows, 8).orderBy("path").collect()] == [("a", 5, False), ("b", 5, False), ("c", 9, True), ("d", 11, True)]


def test_gaps_are_complements(spark):
    r = random.Random(2)
    rows = [("S", y, d) for y in (2023, 2024) for d in range(1, 366) if r.random() < 0.7] + [("E", 2024, 366), ("F", 2023, 1), ("W", 2023, 200), ("W", 2023, 200)]
    days = spark.createDataFrame(rows, "station string, year int, doy int")
    missing = {(s, y, d) for s, y in {(s, y) for s, y, _ in rows} for d in range(1, (367 if y == 2024 else 366))} - set(rows)
    assert {tuple(x) for x in network.day_gaps(days).collect()} == missing
    whole = spark.createDataFrame([("S", 2023, d) for d in range(1, 366)], "station string, year int, doy int")
    assert network.coverage_report(whole).select("share", "with_data", "gaps").collect() == [(1.0, "1---365", "")]


def test_residuals_of_near_perfect_fits(spark):
    """Where the one-pass sum cancels, the second pass doesn't."""
    rows = [(1, g, 3e4 * g + e, 1.0) for g, e in ((1.0, 1e-5), (2.0, -2e-5), (3.0, 1e-5), (4.0, 0.0))]
    df = spark.createDataFrame(rows, "grid_id int, green_n double, d double, err double")
    scored = faults.score_grid(df, ["grid_id"])
    exact = faults.residual_chi2(df, scored, ["grid_id"])
    assert exact.columns == scored.columns and exact.first().chi2 == pytest.approx(6e-10, rel=1e-3)


def test_scratch_is_in_the_shared_folder(spark):
    path = shared.scratch_path(spark, "x")
    assert path.startswith(shared.shared_dir(spark)) and shared.staged(spark.range(3), "y").count() == 3

    class Cluster:
        conf = type("Conf", (), {"get": lambda self, name, default=None: default})()
        sparkContext = type("Context", (), {"master": "spark://host:7077"})()  # noqa: N815

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared.shared_dir(Cluster())
