"""Reorder buffer and replays in the live job, alerts that end by silence, the ledger, rollup states, bitmaps, spells by blocks."""

import random
import time
from datetime import date, datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_telemetry import LVM, random_rows, sentence, telemetry

from geostream.operators import network, rollups
from geostream.operators import telemetry as t
from geostream.plans import jobs
from geostream.sources import sinks
from geostream.sources.ledger import Ledger, Table, replace_file
from geostream.streaming import telemetry as live

STATIONS = "station_code string, threshold_mm_s double, filter struct<enabled: boolean, decay: double>"

# --- live job ---


def motion(spark, n=300, seed=9):
    """Rows of both kinds in order of time, all times different, an event every now and then."""
    rows = telemetry(spark, random_rows(seed, n)).select("station_code", "file_name", "kind", "east", "north", "up", "overall_completeness")
    rows = [tuple(r) for r in rows.collect()]
    at = datetime(2024, 5, 1)
    return [(*r, i, at + timedelta(seconds=i // 2, milliseconds=300 * (i % 2))) for i, r in enumerate(rows)]


SCHEMA = "station_code string, file_name string, kind string, east double, north double, up double, overall_completeness double, line_no long, time timestamp"


def streamed(spark, tmp_path, files, **params):
    """Output of the station machine over files of rows, one a batch."""
    for i, rows in enumerate(files):
        spark.createDataFrame([(r[0], f"{i:03d}", *r[2:]) for r in rows], SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        time.sleep(0.05)  # files are taken by their times
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    live.backfill(stream, str(tmp_path / "out"), str(tmp_path / "check"), **params)
    return spark.read.parquet(str(tmp_path / "out"))


def batch(spark, rows, mm_s):
    df = spark.createDataFrame(rows, SCHEMA)
    order = ("time", "line_no")
    v = df.filter("kind = 'LVM'").withColumnsRenamed({"east": "vE", "north": "vN", "up": "vU"}).drop("kind", "overall_completeness")
    d = df.filter("kind = 'LDM'").withColumnsRenamed({"east": "dE", "north": "dN", "up": "dU"}).drop("kind")
    v, d = t.process_telemetry(v, d, mm_s=mm_s, order=order)
    return v, d, t.detect_events(v, d, mm_s, order)


def same(spark, got, rows, mm_s):
    v, d, e = batch(spark, rows, mm_s)
    key = lambda *x: sorted(tuple(round(y, 9) if isinstance(y, float) else y for y in row) for row in x)
    assert key(*[(r.time, r.east) for r in got.filter("kind = 'velocity'").collect()]) == key(*[(r.time, r.vE) for r in v.collect()])
    assert key(*[(r.time, r.source, r.east) for r in got.filter("kind = 'displacement'").collect()]) == key(*[(r.time, r.displacement_source, r.dE) for r in d.collect()])
    events = key(*[(r.time, r.peak_velocity, r.peak_displacement, r.duration) for r in got.filter("kind = 'event'").collect()])
    assert events == key(*[(r.detection_time, r.peak_velocity_horizontal, r.peak_displacement_horizontal, r.duration_seconds) for r in e.collect()]) and events


def test_shuffled_files_give_the_events_of_the_batch_form(spark, tmp_path):
    """Rows arrive up to 20 seconds out of order, some twice; one comes after its time was released."""
    rows = motion(spark)
    shuffled = sorted(rows, key=lambda r, rng=random.Random(3): r[-2] + rng.uniform(0, 40))
    files = [shuffled[i : i + 60] for i in range(0, len(shuffled), 60)]
    files[2] = files[2] + files[1][:20]  # a replay
    end = (*rows[-1][:-2], 10_000, rows[-1][-1] + timedelta(hours=1))
    late = (*rows[4][:-2], 5, rows[4][-1] + timedelta(milliseconds=1))
    got = streamed(spark, tmp_path, [*files, [end], [late, rows[7]]], mm_s=1.0, reorder=30.0, remember=7200.0).cache()
    same(spark, got.filter(f"time < timestamp'{end[-1] - timedelta(minutes=1)}'"), rows, 1.0)
    assert [(r.time, r.source) for r in got.filter("kind = 'late'").collect()] == [(late[-1], late[2])]


def test_replays_change_nothing_in_order_of_arrival(spark, tmp_path):
    rows = motion(spark, 200, 4)
    files = [rows[:80], rows[40:120], rows[:60], rows[120:]]
    old = (*rows[0][:-2], 0, rows[0][-1] - timedelta(days=2))
    got = streamed(spark, tmp_path, [*files, [old]], mm_s=1.0, remember=600.0).cache()
    same(spark, got.filter("kind != 'late'"), rows, 1.0)
    assert [r.time for r in got.filter("kind = 'late'").collect()] == [old[-1]]
    numbers = sorted(r.seq for r in got.collect())
    assert numbers == list(range(len(numbers)))


def until(query, done, seconds=90):
    end = time.time() + seconds
    try:
        while not done() and time.time() < end:
            time.sleep(0.5)
    finally:
        query.stop()
    assert done()


def memory(stream, name, tmp_path):
    return stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / "check")).outputMode("append").trigger(processingTime="200 milliseconds").start()


def test_a_silent_station_empties_its_buffer(spark, tmp_path):
    rows = motion(spark, 40, 5)
    spark.createDataFrame(rows[::-1], SCHEMA).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = live.process_station_stream(spark.readStream.schema(SCHEMA).parquet(str(tmp_path / "in")), reorder=3600.0, idle_ms=1000, ttl_ms=3_600_000)
    query = memory(stream, "silent_buffer", tmp_path)
    until(query, lambda: spark.table("silent_buffer").filter("kind = 'velocity'").count() == sum(r[2] == "LVM" for r in rows))
    times = [r.time for r in spark.table("silent_buffer").filter("kind = 'velocity'").orderBy("seq").collect()]
    assert times == sorted(times)


def test_silence_ends_an_alert(spark, tmp_path):
    at = datetime(2024, 5, 1)
    rows = [("AAAA", at + timedelta(seconds=10 * i), 0.1, True) for i in range(3)] + [("BBBB", at, 0.001, False)]
    spark.createDataFrame(rows, "station_code string, bucket timestamp, mean_v double, breach boolean").coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("station_code string, bucket timestamp, mean_v double, breach boolean").parquet(str(tmp_path / "in"))
    query = memory(live.alert_stream(stream, silence=1.0), "silent_alert", tmp_path)
    until(query, lambda: spark.table("silent_alert").count() == 5)
    got = [tuple(r) for r in spark.table("silent_alert").filter("station_code = 'AAAA'").orderBy("bucket").collect()]
    assert [(r[1], r[3], r[4]) for r in got] == [(at, True, False), (at + timedelta(seconds=10), True, True), (at + timedelta(seconds=20), True, True), (at + timedelta(seconds=30), False, False)]
    assert got[-1][2] is None


def test_replayed_files_under_new_names(spark, tmp_path):
    """The same sentences again in another file, in a later run of the job: nothing is added, the integrator isn't moved."""
    (tmp_path / "in").mkdir()
    lines = [sentence("LVM", "1138%02d.00" % k, *LVM[1:]) for k in range(20)]
    stations = spark.createDataFrame([], STATIONS)
    for name in ("PBIS_1", "PBIS_2", "PBIS_3"):
        (tmp_path / "in" / f"{name}.txt").write_text("\n".join(lines[: 20 if name == "PBIS_3" else 15]))
        for query in jobs.live_telemetry(spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "check"), stations, every=None):
            query.awaitTermination()
    ledger = jobs.live_ledger(spark, str(tmp_path / "out"))
    assert ledger.read("velocities").count() == 20 and ledger.read("late") is None
    assert ledger.read("velocities").agg(F.count_distinct("time")).first()[0] == 20


# --- ledger ---

TABLES = {"a": Table(("k",), "time", ("seq",)), "b": Table(("k", "time"), "time")}


def numbers(spark, rows):
    return spark.createDataFrame([(k, datetime(2024, 1, 1 + k % 3), v, s) for k, v, s in rows], "k long, time timestamp, v string, seq long")


def content(ledger, name="a"):
    df = ledger.read(name)
    return None if df is None else sorted((r.k, r.v) for r in df.collect())


def test_a_crash_between_two_tables_leaves_no_half_batch(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), TABLES)
    assert content(ledger) is None
    one = numbers(spark, [(1, "late", 9), (1, "first", 2), (2, "x", 1), (1, "mid", 5)])
    assert ledger.append("0", {"a": one, "b": one.drop("seq")})
    assert content(ledger) == [(1, "first"), (2, "x")]
    broken = numbers(spark, [(3, "y", 1)]).withColumn("v", F.raise_error(F.lit("lost")).cast("string"))
    with pytest.raises(Exception, match="lost"):
        ledger.append("1", {"a": numbers(spark, [(3, "half", 1), (1, "again", 0)]), "b": broken.drop("seq")})
    assert (content(ledger), content(ledger, "b")) == ([(1, "first"), (2, "x")], [(1, "first"), (2, "x")])
    whole = numbers(spark, [(3, "y", 1), (1, "again", 0)])
    assert ledger.append("1", {"a": whole, "b": whole.drop("seq")})
    assert content(ledger) == [(1, "first"), (2, "x"), (3, "y")] == content(ledger, "b")
    assert not ledger.append("1", {"a": numbers(spark, [(8, "no", 1)])})
    assert ledger.append("2", {"a": whole.limit(0)}) and content(ledger) == [(1, "first"), (2, "x"), (3, "y")]


def test_compaction_keeps_what_is_published(spark, tmp_path):
    ledger = Ledger(spark, str(tmp_path), TABLES)
    for i in range(4):
        ledger.append(str(i), {"a": numbers(spark, [(i, "v", 1), (i + 1, "w", 1)])})
    before = content(ledger)
    ledger.compact("0003")
    assert content(ledger) == before and ledger.published() == ["upto-0003"]
    ledger.append("4", {"a": numbers(spark, [(4, "no", 1), (9, "v", 1)])})
    ledger.compact("0004")
    assert content(ledger) == sorted([*before, (9, "v")]) and len(ledger.clean()) == 6 and content(ledger) == sorted([*before, (9, "v")])
    assert not ledger.append("2", {"a": numbers(spark, [(77, "no", 1)])})
    with pytest.raises(ValueError):
        ledger.append("upto-9", {})


def test_a_file_is_replaced_whole(spark, tmp_path):
    for n in (3, 5):
        replace_file(spark.range(n), str(tmp_path / "r"), "counts.parquet")
        assert spark.read.parquet(str(tmp_path / "r")).count() == n
    assert [x.name for x in (tmp_path / "r").iterdir() if x.name[0] not in "._"] == ["counts.parquet"]


def test_first_of_a_batch_wins(spark, tmp_path):
    rows = spark.createDataFrame([(datetime(2024, 1, 1), "A", float(9 - i), i) for i in range(9)] + [(datetime(2024, 1, 1), "B", None, 2), (datetime(2024, 1, 1), "B", 1.0, 3)], "time timestamp, station_code string, v double, seq long").repartition(4)
    sinks.append_velocities(rows, str(tmp_path / "v"), ("seq",))
    got = spark.read.parquet(str(tmp_path / "v"))
    assert {(r.station_code, r.v) for r in got.collect()} == {("A", 9.0), ("B", None)} and "seq" not in got.columns


# --- rollups and coverage ---


def test_a_late_row_changes_one_day_and_no_other_file(spark, tmp_path):
    r = random.Random(1)
    at = datetime(2024, 3, 1)
    rows = [(at + timedelta(minutes=r.randrange(60 * 24 * 40)), f"S{i % 3}", *(r.uniform(0, 1) if r.random() < 0.9 else None for _ in range(4))) for i in range(600)]
    schema = "time timestamp, station_code string, v_horizontal double, v_east double, v_north double, v_up double"
    store = rollups.RollupStore(spark, str(tmp_path / "s"))
    assert store.read() is None and store.refresh() == []
    store.log("a", spark.createDataFrame(rows, schema))
    assert len(store.refresh()) == 40
    files = lambda: {x: x.stat().st_mtime_ns for x in (tmp_path / "s" / "state").rglob("part-*")}
    before = files()
    late = [(at + timedelta(days=2, seconds=5), "S1", 7.0, 1.0, None, 2.0)]
    for _ in range(2):
        store.log("b", spark.createDataFrame(late, schema))
        assert store.refresh() in (["2024-03-03"], [])
    after = files()
    assert {k: after[k] for k in before} == before and len(after) == len(before) + 1
    store.forget()
    assert len(files()) == len(before)
    key = lambda df: sorted((x.bucket, x.station_code, x.sample_count, *(None if v is None else round(v, 9) for v in (x.v_horizontal_max, x.v_horizontal_avg, x.v_east_avg, x.v_north_avg, x.v_up_avg))) for x in df.collect())
    for width, wide in (("1 minute", None), ("1 hour", "1 hour"), ("1 day", "1 day")):
        assert key(store.read(wide)) == key(t.rollup(spark.createDataFrame(rows + late, schema), width))


def test_a_refresh_that_fails_counts_nothing_twice(spark, tmp_path, monkeypatch):
    schema = "time timestamp, station_code string, v_horizontal double, v_east double, v_north double, v_up double"
    rows = spark.createDataFrame([(datetime(2024, 3, 1), "S", 1.0, 1.0, 1.0, 1.0)], schema)
    store = rollups.RollupStore(spark, str(tmp_path / "s"))
    store.log("a", rows)
    store.refresh()
    store.log("b", rows)
    monkeypatch.setattr(store.folder, "publish", lambda *a: (_ for _ in ()).throw(OSError("gone")))
    with pytest.raises(OSError):
        store.refresh()
    assert store.read().first().sample_count == 1
    monkeypatch.undo()
    again = rollups.RollupStore(spark, str(tmp_path / "s"))
    again.refresh()
    assert again.read().first().sample_count == 2


def test_coverage_from_appended_bitmaps(spark, tmp_path):
    r = random.Random(6)
    days = [(f"S{i % 4}", 2019 + i % 3, r.randrange(1, 367 if (2019 + i % 3) % 4 == 0 else 366)) for i in range(500)] + [("FULL", 2021, d) for d in range(1, 366)] + [("ONE", 2020, 366), ("ONE", 2020, 1)]
    schema = "station string, year int, doy int"
    path = str(tmp_path / "bits")
    for part in (days[:200], days[150:], days[:50], []):
        stored = rollups.append_days(spark, path, spark.createDataFrame(part, schema))
    got = {(x.station, x.year): (x.n_days, x.year_days, x.with_data, x.gaps) for x in network.coverage_of_bits(stored).collect()}
    report = network.coverage_report(spark.createDataFrame(days, schema).distinct())
    assert got == {(x.station, x.year): (x.n_days, x.year_days, x.with_data, x.gaps) for x in report.collect()}
    assert got["FULL", 2021] == (365, 365, "1---365", "") and got["ONE", 2020][2:] == ("1, 366", "2---365")
    other = [x for x in (tmp_path / "bits").rglob("part-*") if "year=2020" not in str(x)]
    times = {x: x.stat().st_mtime_ns for x in other}
    rollups.append_days(spark, path, spark.createDataFrame([("NEW", 2020, 5)], schema))
    assert {x: x.stat().st_mtime_ns for x in other} == times


# --- spells ---


def test_spells_by_blocks_are_those_of_the_inequality(spark):
    r = random.Random(8)
    day = lambda: date(1990, 1, 1) + timedelta(days=r.randrange(4000))
    spells = []
    for i in range(400):
        begin = day()
        spells.append((f"S{i % 2}", i, begin if i % 50 else None, None if i % 7 == 0 else begin + timedelta(days=r.choice([0, 1, 2, 30, 1000, -5]))))
    probes = [(f"S{i % 3}", i, day() if i % 40 else None) for i in range(300)]
    history = spark.createDataFrame(spells, "station_code string, serial long, date_installed date, date_removed date")
    asked = spark.createDataFrame(probes, "station_code string, probe long, date date")
    expected = sorted((p[1], s[1]) for p in probes for s in spells if p[0] == s[0] and p[2] and s[2] and s[2] <= p[2] and (s[3] is None or p[2] < s[3]))
    for few in (0, 10_000):
        got = network.equipment_at(history, asked, few)
        assert sorted((x.probe, x.serial) for x in got.collect()) == expected and got.columns == ["station_code", "probe", "date", "serial", "date_installed", "date_removed"]
    assert network.equipment_at(history, asked.limit(0), 0).count() == 0 == network.equipment_at(history.limit(0), asked, 0).count()


def test_a_station_with_many_spells_and_probes_makes_no_product(spark):
    n, m = 20_000, 100_000
    history = spark.range(n).select(F.lit("S").alias("station_code"), F.col("id").alias("serial"), F.date_add(F.lit("1950-01-01"), F.col("id").cast("int")).alias("date_installed"), F.date_add(F.lit("1950-01-02"), F.col("id").cast("int")).alias("date_removed"))
    asked = spark.range(m).select(F.lit("S").alias("station_code"), F.col("id").alias("probe"), F.date_add(F.lit("1950-01-01"), (F.col("id") % n).cast("int")).alias("date"))
    got = network.equipment_at(history, asked).filter("serial = probe % 20000")
    assert got.count() == m


def test_blocks_cover_their_days(spark):
    r = random.Random(2)
    pairs = [(0, 0), (0, 1), (5, 5), (7, 3), (1, 1 << 22)] + [tuple(sorted((r.randrange(1 << 12), r.randrange(1 << 12)))) for _ in range(100)]
    for x in spark.createDataFrame(pairs, "lo long, hi long").withColumn("c", network.cover(F.col("lo"), F.col("hi"))).collect():
        spans = sorted((b.node << b.level, (b.node + 1) << b.level) for b in x.c)
        if x.lo >= x.hi:
            assert spans == []
        else:
            assert spans[0][0] == x.lo and spans[-1][1] == x.hi and all(a[1] == b[0] for a, b in zip(spans, spans[1:])) and len(spans) <= 44


def test_bitmaps_have_small_buffers_and_ranges_by_neighbours(spark):
    from geostream.operators import network, rollups

    had = {("A", 2000): [1, 2, 3, 56, 57, 111, 112, 113, 366], ("B", 2001): [365], ("C", 2001): [8, 9, 16, 55, 56], ("D", 2001): list(range(1, 366)), ("E", 2000): list(range(2, 366, 2))}
    days = spark.createDataFrame([(s, y, d) for (s, y), own in had.items() for d in own + own[:2]] + [("A", 2000, None), ("A", 2000, 0)], "station string, year int, doy int")
    bits = rollups.day_bits(days)
    assert "bitmap_" not in bits._jdf.queryExecution().toString() and "HashAggregate" in bits._jdf.queryExecution().executedPlan().toString()
    stored = {(r["station"], r["year"]): bytes(r["bits"]) for r in bits.collect()}
    assert all(len(b) == 46 for b in stored.values())
    assert {k: [d for d in range(1, 367) if b[d // 8] >> d % 8 & 1] for k, b in stored.items()} == had
    parts = rollups.day_bits(days.filter("doy % 2 = 0")).unionByName(rollups.day_bits(days.filter("doy % 2 = 1 or doy > 300")))
    assert {(r["station"], r["year"]): bytes(r["bits"]) for r in rollups.merged_bits(parts).collect()} == stored
    by = ("station", "year")
    want = {tuple(r) for r in network.coverage_report(days.filter("doy > 0")).select(*by, "n_days", "year_days", "share", "with_data", "gaps").collect()}
    assert {tuple(r) for r in network.coverage_of_bits(bits).collect()} == want


def test_splits_of_lines_grow_with_the_files(spark, tmp_path, monkeypatch):
    from pyspark.sql import functions as F

    from geostream import state_queries

    n = F.col("id")
    spark.range(150_000).select((n % 80).alias("l_suppkey"), n.alias("l_orderkey"), F.lit(1).alias("l_linenumber"), (n / 7).alias("l_extendedprice")).write.parquet(f"{tmp_path}/lineitem.parquet")
    seen, read = [], state_queries.lines.read_lines
    monkeypatch.setattr(state_queries.lines, "read_lines", lambda s, path, **k: seen.append(s.conf.get("spark.sql.files.maxPartitionBytes")) or read(s, path, **k))
    rows = state_queries.lines_over_splits(spark, str(tmp_path))
    assert int(seen[0]) > 4096
    assert rows.count() == 150_000 and rows.agg(F.max("line_no")).first()[0] == 3750
