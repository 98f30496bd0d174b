"""Sentences, the station state machine in batch and as a stream, events, alerts."""

import math
import random

import pytest
from pyspark.sql import functions as F

from geostream.functions.text import xor_checksum
from geostream.operators import telemetry as t
from geostream.plans import jobs
from geostream.sources import telemetry as s
from geostream.streaming import telemetry as live


def sentence(kind, *fields):
    body = ",".join([f"GN{kind}", *fields])
    check = 0
    for c in body:
        check ^= ord(c)
    return f"${body}*{check:02X}"


LVM = ("113805.50", "030215", "0.0011", "0.0021", "0.0015", "0.1", "0.2", "0.3", " 0.00012", "0.5", "0.6", "0.7", "19")
LDM = ("113805.50", "030215", "113800.00", "030215", "0.0101", "0.0202", "0.0459", "1", "2", "3", "4", "5", "6", "0.02", "18", "0", "0.9", "0.8")


def lines(spark, *sentences):
    return spark.createDataFrame([("f", i, x) for i, x in enumerate(sentences)], "file_name string, line_no int, sentence string")


def test_parse_and_reject(spark):
    good, bad = s.parse_lvm(s.route_sentences(lines(spark, sentence("LVM", *LVM), sentence("LVM", *LVM)[:-2] + "00", sentence("LVM", *LVM[:9]), sentence("LVM", "113805.9999999", *LVM[1:]), "$GPGGA,1*00")))
    row = good.collect()
    assert len(row) == 1 and (row[0].vE, row[0].covEN, row[0].n_sats) == (0.0011, 0.00012, 19)
    assert str(row[0].time) == "2015-03-02 11:38:05.500000"
    assert sorted(r.reason for r in bad.collect()) == ["checksum", "fields", "fields"]
    good, bad = s.parse_ldm(lines(spark, sentence("LDM", *LDM)))
    row = good.first()
    assert (row.dU, row.overall_completeness, row.reset_indicator) == (0.0459, 0.8, 0) and bad.count() == 0


def test_checksum_of_empty(spark):
    assert spark.range(1).select(xor_checksum(F.lit("A"))).first()[0] == "41"


def telemetry(spark, rows):
    """rows: (kind, seconds, e, n, u, completeness)."""
    df = spark.createDataFrame([("S", "f", i, k, *map(float, (sec, e, n, u, c))) for i, (k, sec, e, n, u, c) in enumerate(rows)], "station_code string, file_name string, line_no int, kind string, sec double, east double, north double, up double, overall_completeness double")
    return df.withColumn("time", F.timestamp_micros((F.col("sec") * 1_000_000).cast("long"))).drop("sec")


def batch(df, **params):
    v = df.filter("kind = 'LVM'").withColumnsRenamed({"east": "vE", "north": "vN", "up": "vU"}).drop("kind", "overall_completeness")
    d = df.filter("kind = 'LDM'").withColumnsRenamed({"east": "dE", "north": "dN", "up": "dU"}).drop("kind")
    return t.process_telemetry(v, d, **params)


def reference(rows, mm_s=15.0, decay=1.0):
    """The state machine written as a loop, for comparison."""
    mode, bad, good, suspect, frozen, pos, last, lv = "R", 0, 0, 0, False, [0.0] * 3, None, None
    out = []
    for kind, sec, e, n, u, c in rows:
        if kind == "LVM":
            lv = (e, n)
            if last is not None and 0 < sec - last < 5 and not frozen:
                pos = [p * decay + x * (sec - last) for p, x in zip(pos, (e, n, u))]
            last = sec
        elif c >= 0.5:
            low = False
            if lv:
                if abs(lv[0] - e) < 1e-9 and abs(lv[1] - n) < 1e-9:
                    bad, good, suspect = bad + 1, 0, 0
                    mode = "M" if bad >= 5 else mode
                    frozen = False
                elif math.hypot(*lv) * 1000 >= mm_s:
                    bad, good, suspect = 0, good + 1, 0
                    mode = "R" if good >= 30 else mode
                    frozen = False
                else:
                    bad, good, suspect, low = 0, 0, suspect + 1, True
                    mode = "M" if suspect >= 3 else mode
                    frozen = mode == "M"
            out.append(("INTEGRATOR" if mode == "M" else "RECEIVER_SUSPECT" if low else "RECEIVER", *(pos if mode == "M" else (e, n, u))))
    return out


def random_rows(seed, n=400):
    r, sec = random.Random(seed), 0.0
    rows = [("LVM", 0.0, 0.001, 0.0, 0.0, 1.0), ("LDM", 0.0, 0.3, 0.0, 0.0, 1.0), ("LDM", 0.0, 0.3, 0.0, 0.0, 1.0)]
    state = "same"
    while len(rows) < n:
        if r.random() < 0.05:
            state = r.choice(["same", "high", "low"])
        sec += r.choice([1.0, 1.0, 1.0, 0.0, 7.0])
        v = r.uniform(0.02, 0.05) if state == "high" else r.uniform(0, 0.005)
        rows.append(("LVM", sec, v, 0.0, 0.001, 1.0))
        for _ in range(1 + (state == "high")):
            rows.append(("LDM", sec, v if state == "same" else v + 0.5, 0.0, 0.2, r.choice([1.0, 1.0, 0.4])))
    return rows


@pytest.mark.parametrize("decay", [1.0, 0.9])
def test_state_machine_matches_loop(spark, decay):
    rows = random_rows(5)
    _, d = batch(telemetry(spark, rows), decay=decay)
    got = [(r.displacement_source, r.dE, r.dN, r.dU) for r in d.orderBy("line_no").collect()]
    expected = reference(rows, decay=decay)
    assert [g[0] for g in got] == [e[0] for e in expected] and {"INTEGRATOR", "RECEIVER", "RECEIVER_SUSPECT"} <= {g[0] for g in got}
    assert all(math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-12) for g, e in zip(got, expected) for a, b in zip(g[1:], e[1:]))


def test_integrator_step(spark):
    rows = spark.createDataFrame([("S", 1, True, 1.0, 10.0), ("S", 2, True, 1.0, 0.5)], "station_code string, i int, gate boolean, dt double, vE double").withColumn("vN", F.col("vE")).withColumn("vU", F.col("vE"))
    assert t.integrate(rows, 0.9, ("i",)).orderBy("i").collect()[1].iE == pytest.approx(9.5)


def test_events(spark):
    df = telemetry(spark, [("LVM", 0, 0.001, 0, 0, 1.0), ("LVM", 1, 0.02, 0, 0, 1.0), ("LDM", 1, 0.5, 0, 0, 1.0), ("LVM", 2, 0.03, 0, 0, 1.0), ("LVM", 3, 0.001, 0, 0, 1.0), ("LDM", 3, 0.9, 0, 0, 1.0), ("LVM", 4, 0.05, 0, 0, 1.0)])
    v, d = batch(df)
    (event,) = t.detect_events(v, d).collect()
    assert (event.peak_velocity_horizontal, event.peak_displacement_horizontal, event.duration_seconds) == (30.0, 500.0, 2.0)


def test_stream_equals_batch(spark, tmp_path):
    rows = random_rows(9, 200)
    df = telemetry(spark, rows).select("station_code", "file_name", "line_no", "kind", "time", "east", "north", "up", "overall_completeness")
    df.filter("line_no < 90").coalesce(1).write.parquet(str(tmp_path / "in"))
    df.filter("line_no >= 90").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 2).parquet(str(tmp_path / "in"))
    live.backfill(stream, str(tmp_path / "out"), str(tmp_path / "check"))
    got = spark.read.parquet(str(tmp_path / "out"))
    v, d = batch(df)
    assert got.filter("kind = 'velocity'").count() == v.count()
    mine = sorted((r.source, round(r.east, 9)) for r in got.filter("kind = 'displacement'").collect())
    assert mine == sorted((r.displacement_source, round(r.dE, 9)) for r in d.collect())
    events = sorted(round(r.peak_velocity, 6) for r in got.filter("kind = 'event'").collect())
    assert events == sorted(round(r.peak_velocity_horizontal, 6) for r in t.detect_events(v, d).collect())


def test_alerts_hold(spark):
    rows = telemetry(spark, [("LVM", sec, 0.02, 0, 0, 1.0) for sec in (0, 5, 12, 25, 31, 55)]).withColumn("v_horizontal", F.col("east"))
    got = t.alert_holds(t.alert_means(rows)).orderBy("bucket").collect()
    assert [r.firing for r in got] == [False, True, True, True, False]


def test_midnight(spark):
    rows = spark.createDataFrame([("f", i, c) for i, c in enumerate(["23:59:58", "23:59:59", "00:00:00", "00:00:01"])], "file_name string, line_no int, clock string")
    got = [str(r.time) for r in t.resolve_dates(rows, "2024-01-01").orderBy("line_no").collect()]
    assert got[1:3] == ["2024-01-01 23:59:59", "2024-01-02 00:00:00"]


def test_backfill_from_files(spark, tmp_path):
    (tmp_path / "PBIS_1.txt").write_text("\n".join([sentence("LVM", *LVM), "", "  ", sentence("LDM", *LDM), "noise"]) + "\n")
    v, d, e, rejects = jobs.telemetry_backfill(spark, str(tmp_path))
    assert (v.count(), d.count(), e.count(), rejects.count()) == (1, 1, 0, 0) and v.first().station_code == "PBIS"


def test_stream_reader_and_rollup(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "PBIS_1.txt").write_text("\n".join(sentence("LVM", f"1138{i:02d}.00", *LVM[1:]) for i in range(10)))
    good, _ = s.parse_lvm(s.route_sentences(s.stream_nmea(spark, str(tmp_path / "in"), 1)))
    rows = s.to_velocity_rows(good.withColumn("station_code", F.lit("PBIS")))
    query = live.stream_rollup(rows, "1 minute")
    q = query.writeStream.format("memory").queryName("rolled").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("rolled").first().sample_count == 10
