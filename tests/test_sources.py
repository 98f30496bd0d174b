"""Text and binary corpora, names, times, positions."""

import struct

import pytest
from pyspark.sql import functions as F

from geostream.functions import geodesy, times
from geostream.operators import archive, network, series
from geostream.sources import archive as files
from geostream.sources import coordinates as c
from geostream.sources import reports as r


def put(folder, name, text):
    folder.mkdir(exist_ok=True, parents=True)
    (folder / name).write_bytes(text if isinstance(text, bytes) else text.encode())
    return str(folder)


def test_crd_and_local(spark, tmp_path):
    row = " {:3d}  {} {}   {:.4f} {:.4f} {:.4f}  A\n"
    put(tmp_path, "FIN_23001.CRD", "header\n" + row.format(1, "REFS", "12345E001", -3322225.5, 5225842.3, 1522954.2) + row.format(2, "pbis", "", -3322125.5, 5225842.3, 1522954.2) + "  x  bad 1 2 3\n")
    path = put(tmp_path, "FIN_23002.CRD", row.format(1, "PBIS", "", -3322115.5, 5225842.3, 1522954.2))
    rows = c.read_crd(spark, path)
    assert sorted((x.file_name[-9:-4], x.station, x.x) for x in rows.collect()) == [("23001", "PBIS", -3322125.5), ("23001", "REFS", -3322225.5), ("23002", "PBIS", -3322115.5)]
    fixed = series.to_local(rows, "REFS").orderBy("decimal_year").collect()
    assert [round(x.decimal_year, 6) for x in fixed] == [2023.0, round(2023 + 1 / 365.25, 6)]
    assert (fixed[0].east_m ** 2 + fixed[0].north_m ** 2 + fixed[0].up_m ** 2) ** 0.5 == pytest.approx(100, abs=1e-6)
    assert series.to_local(rows, "REFS", "per_session").count() == 1
    with pytest.raises(Exception, match="occurs in no file"):
        series.to_local(rows, "NONE").collect()
    assert series.to_local(rows, lla=(14.0, 122.0, 0.0)).count() == 3


def test_kin(spark, tmp_path):
    head = "a\nb\nc\nd\ne\n"
    path = put(tmp_path, "COOR160350.KIN", head + " GUNG GUNG        1882  345600.   -3322225.5387   5225842.3668   1522954.2702 K\n GUNG x\n")
    (row,) = c.read_kin(spark, path).collect()
    assert (row.session, row.station, str(row.time), row.z) == ("16035", "GUNG", "2016-02-04 00:00:00", 1522954.2702)


def test_small_texts(spark, tmp_path):
    path = put(tmp_path / "o", "offsets", "# c\n\nabcd 2010.5 eq\nabcd x EQ\nefgh 2011.25 ZZ\nshort\n")
    assert sorted(map(tuple, c.read_offsets(spark, path).collect())) == [("ABCD", 2010.5, "EQ"), ("EFGH", 2011.25, "UK")]
    path = put(tmp_path / "p", "lines", "> a\n1 2\n3 4\n> b\n5 6\n")
    assert [(x.segment_id, x.seq, x.lon) for x in c.read_polylines(spark, path).orderBy("segment_id", "seq").collect()] == [(1, 1, 1.0), (1, 2, 3.0), (2, 1, 5.0)]
    path = put(tmp_path / "s", "SITE.txt", "2010.0 1 2 3\nbad\n2011.0 2 3 4\n")
    assert c.read_series(spark, path).count() == 2
    path = put(tmp_path / "v", "vel", "120.1 14.2 1 2 0.1 0.2 0.0 ABCD\nbad\n")
    assert c.read_velocity_field(spark, path).first().site == "ABCD"


def test_headers(spark, tmp_path):
    def line(value, label):
        return f"{value:<60}{label:<20}\n"

    text = line("     2.11           OBSERVATION DATA", "RINEX VERSION / TYPE") + line("pbis extra", "MARKER NAME") + line(f"{'123':<20}{'TRIMBLE NETRS':<20}", "REC # / TYPE / VERS") + line(f"{'1':<20}{'TRM41249.00     NONE':<20}", "ANT # / TYPE") + line("    30.000", "INTERVAL") + line("  2024     1     2     0     0    0.0000000     GPS", "TIME OF FIRST OBS") + line("", "END OF HEADER") + line("zzzz", "MARKER NAME")
    path = put(tmp_path, "pbis0020.24o", text)
    (h,) = r.scan_rinex_headers(spark, path).collect()
    assert (h.station_code, h.receiver_type, h.antenna_type, h.sampling_interval, str(h.start_time)) == ("PBIS", "TRIMBLE NETRS", "TRM41249.00     NONE", 30.0, "2024-01-02 00:00:00")
    assert spark.createDataFrame([(text,)], "t string").select(r.has_format_marker(F.col("t"))).first()[0]


def test_reports(spark, tmp_path):
    qc = put(tmp_path / "q", "a", "# obs       :  85321  84000\n# slips  (all)    :    127\nMP1             :   0.352\nMP2 : 0.413\n")
    put(tmp_path / "q", "b", "Total obs   : 42000\nSlips : 55\nMP1 : 0.29\n")
    put(tmp_path / "q", "c", "done\n")
    got = [tuple(x)[1:] for x in r.scan_qc_reports(spark, qc).orderBy("file_name").collect()]
    assert got == [(85321, 127, 0.352, 0.413), (42000, 55, 0.29, None), (None, None, None, None)]
    spp = put(tmp_path / "s", "a", " USED OBSERVATIONS   :     43330\n BAD OBSERVATIONS    :         1.02 %\n RMS OF UNIT WEIGHT  :         1.03 M\n  CUSV 21904S001    X             -1132915.14     -1132915.19           -0.05         0.01\n  (MARKER)          Y              6092528.50      6092528.26           -0.24         0.02\n                    Z              1504633.10      1504633.01           -0.09         0.01\n")
    x = network.triage_positions(r.scan_spp_reports(spark, spp)).first()
    assert (x.station, x.rms_m, x.bad_pct, x.used_obs, x.dx, x.dy, x.dz, x.triage) == ("CUSV", 1.03, 1.02, 43330, -0.05, -0.24, -0.09, "ok") and x.shift_m == pytest.approx(0.261, abs=1e-3)
    summary = put(tmp_path / "m", "a", "  72 FILES, MAX. RMS:    2.58 M    FOR STATION: PSRF 22032M001\n            MAX. BAD:    4.54 %    FOR STATION: PAPI 22055M001\n")
    assert tuple(r.scan_spp_summary(spark, summary).first())[1:] == (2.58, "PSRF", 4.54, "PAPI")
    log = put(tmp_path / "l", "a", "BPE finished\nStations accepted : 12\nFixing rate : 87.5 %\nHELMCHK : failed\n")
    assert tuple(r.scan_run_logs(spark, log).first())[1:] == (True, 12, 0.875, True, False)


def test_deleted_metadata(spark, tmp_path):
    micros = 1_600_000_000_000_000
    filetime = (micros + 11644473600000000) * 10
    one = struct.pack("<qqq", 1, 77, filetime) + "D:\\a\\f.22o".encode("utf-16-le").ljust(520, b"\0")
    text = "C:\\b.22o\0"
    two = struct.pack("<qqqi", 2, 88, filetime, len(text)) + text.encode("utf-16-le")
    for name, data in (("$I1.22o", one), ("$I2.22o", two), ("$I3.22o", b"short"), ("$I4.22o", struct.pack("<qqq", 9, 1, filetime)), ("other", one)):
        put(tmp_path, name, data)
    rows = {x.meta_path[-7:]: x for x in files.scan_deleted_metadata(spark, str(tmp_path)).collect()}
    assert rows["$I1.22o"].original_path == "D:\\a\\f.22o" and rows["$I1.22o"].size_bytes == 77 and str(rows["$I1.22o"].deleted_at) == "2020-09-13 12:26:40"
    assert rows["$I2.22o"].original_path == "C:\\b.22o" and rows["$I3.22o"].error == "truncated" and rows["$I4.22o"].error == "version" and len(rows) == 4


def test_catalog_and_names(spark, tmp_path):
    put(tmp_path, "site0010.05o", "x")
    put(tmp_path / "sub", "pic.JPG", "yy")
    put(tmp_path / "sub", "raw.m01", "zz")
    catalog = archive.classify_files(files.catalog_files(spark, str(tmp_path)))
    assert {x.name: x.category for x in catalog.collect()} == {"site0010.05o": "GNSS Data", "pic.JPG": "Image", "raw.m01": "GNSS Raw (Leica)"}
    fields = {x.name: x.fields for x in archive.extract_name_fields(catalog).collect()}
    assert fields["site0010.05o"]["doy"] == "1" and fields["pic.JPG"] is None
    assert files.discover_files(spark, str(tmp_path)).count() == 1
    row = archive.verdict(archive.flag_corrupt(catalog, 1)).first()
    assert row.corrupt_entries == 2 and row.gnss_files == 1 and row.verdict.endswith("keep")


def test_times(spark):
    one = spark.createDataFrame([("AB23001", "2024-02-29"), ("F1_80366", "1999-12-31"), ("none", "2022-11-27")], "name string, d string").withColumn("d", F.col("d").cast("date"))
    got = one.select(times.session_year(times.session_of(F.col("name"))), times.gps_week(F.col("d")), times.gps_day(F.col("d")), times.product_name("COD", "CLK", F.col("d"))).collect()
    assert got[0][0] == 2023.0 and got[1][0] == pytest.approx(2080 + 365 / 365.25) and got[2][0] is None
    assert (got[1][1], got[1][2], got[1][3]) == (1042, 5, "cod10425.clk.Z") and got[2][3] == "COD0OPSFIN_20223310000_01D_30S_CLK.CLK.gz"


def test_antenna_height(spark):
    h = spark.range(1).select(geodesy.antenna_height(F.lit("TRM41249.00"), [F.lit(1.5)] * 4), geodesy.antenna_height(F.lit("?"), [F.lit(1.5)] * 4)).first()
    assert h[0] == pytest.approx((1.5**2 - 0.1698**2) ** 0.5 - 0.0443) and h[1] is None


def test_folders_are_dealt_by_their_number(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from geostream.sources import sinks
    from geostream.sources.lines import read_lines

    monkeypatch.setattr(sinks, "FOLDERS", 3)
    path = str(tmp_path / "a b" / "tree")
    names = [f"S{i:03d}" for i in range(60)] + ["x:y/z", None]
    rows = spark.createDataFrame([(n, f"{n} {i}") for n in names for i in (2, 1)], "site string, value string")
    for some in (rows.withColumn("value", F.lit("old")), rows):
        sinks.write_folders(some, path, "site", ("value",))
    files = sorted(p.relative_to(path).as_posix() for p in (tmp_path / "a b" / "tree").rglob("*") if p.is_file())
    assert files == sorted([f"site={n}/part-00000.txt" for n in names[:60]] + ["site=x%3Ay%2Fz/part-00000.txt", "site=__HIVE_DEFAULT_PARTITION__/part-00000.txt"])
    assert [(r.line_no, r.line) for r in read_lines(spark, path).filter("file_path like '%S007%'").orderBy("line_no").collect()] == [(1, "S007 1"), (2, "S007 2")]
    assert sorted(r.line for r in read_lines(spark, path).collect()) == sorted(r.value for r in rows.collect())


def test_listing_takes_few_tasks_for_many_folders(spark, tmp_path):
    from geostream.sources.lines import read_lines

    for i in range(120):
        (tmp_path / f"d{i}").mkdir()
        (tmp_path / f"d{i}" / "x.txt").write_text("a\n")
    spark.sparkContext.setJobGroup("listing", "listing")
    read_lines(spark, str(tmp_path))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    tracker = spark.sparkContext.statusTracker()
    stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup("listing") for s in tracker.getJobInfo(j).stageIds]
    assert stages and max(s.numTasks for s in stages) <= 4 * spark.sparkContext.defaultParallelism
