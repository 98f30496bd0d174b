"""Live telemetry: station configuration, the wired job, alerts, replays, rejects."""

from pyspark.sql import functions as F
from test_telemetry import LDM, LVM, random_rows, sentence, telemetry

from geostream.operators import telemetry as t
from geostream.plans import jobs
from geostream.sources import sinks
from geostream.streaming import telemetry as live

STATIONS = "station_code string, threshold_mm_s double, filter struct<enabled: boolean, decay: double>"


def two_stations(spark, n=200):
    """The same rows at a station with a low threshold and decay, and at one that the stations' table doesn't know."""
    rows = telemetry(spark, random_rows(9, n))
    own = rows.select("file_name", "line_no", "kind", "time", "east", "north", "up", "overall_completeness")
    both = own.withColumn("station_code", F.lit("AAAA")).unionByName(own.withColumn("station_code", F.lit("BBBB")))
    return both, spark.createDataFrame([("AAAA", 1.0, (True, 0.9)), ("CCCC", 1.0, (False, 0.5))], STATIONS)


def test_configuration_joins_by_station(spark):
    rows = spark.createDataFrame([("AAAA",), ("CCCC",), ("DDDD",)], "station_code string")
    got = t.with_config(rows, two_stations(spark, 5)[1], 15.0, 0.8).collect()
    assert {x.station_code: (x.mm_s, x.decay) for x in got} == {"AAAA": (1.0, 0.9), "CCCC": (1.0, 1.0), "DDDD": (15.0, 0.8)}


def test_stream_equals_batch_for_each_station(spark, tmp_path):
    rows, stations = two_stations(spark)
    rows = t.with_config(rows, stations)
    for lo, hi in ((0, 90), (90, 1000)):
        rows.filter(F.col("line_no").between(lo, hi - 1)).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.backfill(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    v = rows.filter("kind = 'LVM'").withColumnsRenamed({"east": "vE", "north": "vN", "up": "vU"}).drop("kind", "overall_completeness")
    d = rows.filter("kind = 'LDM'").withColumnsRenamed({"east": "dE", "north": "dN", "up": "dU"}).drop("kind")
    v, d = t.process_telemetry(v, d, mm_s="mm_s", decay="decay")
    for station in ("AAAA", "BBBB"):
        mine = sorted((r.source, round(r.east, 9)) for r in got.filter(f"kind = 'displacement' and station_code = '{station}'").collect())
        assert mine == sorted((r.displacement_source, round(r.dE, 9)) for r in d.filter(f"station_code = '{station}'").collect())
        events = sorted(round(r.peak_velocity, 6) for r in got.filter(f"kind = 'event' and station_code = '{station}'").collect())
        assert events == sorted(round(r.peak_velocity_horizontal, 6) for r in t.detect_events(v, d, "mm_s").filter(f"station_code = '{station}'").collect())
    sources = {s: [r[0] for r in d.filter(f"station_code = '{s}'").orderBy("line_no").select("displacement_source").collect()] for s in ("AAAA", "BBBB")}
    assert sources["AAAA"] != sources["BBBB"]


def test_decay_column_matches_number(spark):
    rows = telemetry(spark, random_rows(5)).filter("kind = 'LVM'").withColumnsRenamed({"east": "vE", "north": "vN", "up": "vU"})
    for decay in (0.9, 1.0):
        one = t.integrate(t.with_dt(rows), decay).orderBy("line_no").select("iE").collect()
        two = t.integrate(t.with_dt(rows).withColumn("k", F.lit(decay)), "k").orderBy("line_no").select("iE").collect()
        assert all(abs(a[0] - b[0]) < 1e-9 for a, b in zip(one, two))


def test_live_job(spark, tmp_path):
    """Files fall into a folder; every batch goes to all sinks; a replay after a restart adds nothing."""
    (tmp_path / "in").mkdir()
    fast = ("113805.50", "030215", "0.0500", "0.0021", "0.0015", *LVM[5:])
    for i, station in enumerate(("PBIS", "AAAA")):
        lines = [sentence("LVM", "1138%02d.00" % k, *(fast if 3 <= k < 6 else LVM)[1:]) for k in range(10)] + [sentence("LDM", *LDM), sentence("LVM", *LVM)[:-2] + "00", "noise"]
        (tmp_path / "in" / f"{station}_{i}.txt").write_text("\n".join(lines))
    stations = spark.createDataFrame([("PBIS", 60.0, None)], STATIONS)
    seen = []
    for _ in range(2):
        for query in jobs.live_telemetry(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), stations, every=None, files_per_trigger=1, sinks=[lambda df, batch: seen.append(df.count())]):
            query.awaitTermination()
    read = lambda name: spark.read.parquet(str(tmp_path / "out" / name))
    assert read("velocities").groupBy("station_code").count().orderBy("station_code").collect() == [("AAAA", 10), ("PBIS", 10)]
    assert read("displacements").count() == 2 and sum(seen) == 23
    events = read("events").collect()
    assert [(e.station_code, round(e.peak_velocity_horizontal, 2), e.duration_seconds) for e in events] == [("AAAA", 50.04, 3.0)]  # 60 mm/s at PBIS
    assert {r.reason: r["count"] for r in read("rejects").collect()} == {"checksum": 2}
    v, d, e, rejects = jobs.telemetry_backfill(spark, str(tmp_path / "in"), stations)
    assert (v.count(), d.count(), e.count(), rejects.count()) == (20, 2, 1, 2) and e.first().station_code == "AAAA"


def test_processing_time_trigger(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PBIS_0.txt").write_text(sentence("LVM", *LVM))
    queries = jobs.live_telemetry(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), spark.createDataFrame([], STATIONS), every="1 second")
    try:
        for query in queries:
            query.processAllAvailable()
        assert spark.read.parquet(str(tmp_path / "out" / "velocities")).count() == 1
    finally:
        for query in queries:
            query.stop()


def test_alert_stream_fires_after_two_windows(spark, tmp_path):
    rows = telemetry(spark, [("LVM", sec, 0.02, 0, 0, 1.0) for sec in (0, 5, 12, 25, 31, 55)]).withColumn("v_horizontal", F.col("east"))
    means = t.alert_means(rows).select("bucket", "station_code", "mean_v", "breach")
    means.filter("bucket < '1970-01-01 00:00:20'").coalesce(1).write.parquet(str(tmp_path / "in"))
    means.filter("bucket >= '1970-01-01 00:00:20'").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(means.schema).parquet(str(tmp_path / "in"))
    live.alert_stream(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).orderBy("bucket").collect()
    assert [r.firing for r in got] == [r.firing for r in t.alert_holds(t.alert_means(rows)).orderBy("bucket").collect()] == [False, True, True, True, False]


def test_replayed_rows_are_dropped(spark, tmp_path):
    rows = telemetry(spark, [("LVM", sec, 0.02, 0, 0, 1.0) for sec in range(1, 7)]).select("station_code", "time", "east")
    for _ in range(2):
        rows.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = live.dedupe_stream(live.with_event_time(spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))))
    stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "check")).trigger(availableNow=True).start().awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 6


def test_fan_out_gives_all_rows_to_each_sink(spark):
    seen = {"a": 0, "b": 0}

    def sink(name):
        def write(df, batch):
            seen[name] += df.count()

        return write

    sinks.fan_out([sink("a"), sink("b")])(spark.range(7), 0)
    assert seen == {"a": 7, "b": 7}
