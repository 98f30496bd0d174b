"""Queries of what keeps state: streams over files written from the events, stored rollups and bitmaps, sentences of displacements, deleted files.

Streams run over all that is there and stop (availableNow). See queries.py for the conventions.
"""

from __future__ import annotations

import pyarrow as pa
from pyarrow.fs import FileSystem
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.functions import geodesy, text
from geostream.operators import archive, network, ordered, rollups, series, telemetry
from geostream.plans import jobs
from geostream.queries import _DAYS, _RUNS, _days, _query, _rollup_sql, _spread, _table, _velocities
from geostream.file_queries import _once
from geostream.sources import archive as archive_sources
from geostream.sources import coordinates, lines
from geostream.sources import telemetry as sentences
from geostream.sources.shared import scratch_path, staged
from geostream.streaming import telemetry as live

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
PROVIDER = "spark.sql.streaming.stateStore.providerClass"


def _run(stream: DataFrame, label: str) -> DataFrame:
    """The rows that a stream in append mode yields of what is there."""
    spark = stream.sparkSession
    path = scratch_path(spark, label)
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        stream.writeStream.format("parquet").option("path", f"{path}/out").option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


def _landed(spark: SparkSession, sf_dir: str, times: int = 1) -> DataFrame:
    """Velocities as a stream of files in order of time, which land the given number of times."""

    def write(path: str) -> None:
        rows = _velocities(spark, sf_dir)
        for _ in range(times):
            rows.repartitionByRange(4, "time").sortWithinPartitions("time").write.mode("append").parquet(path)

    return spark.readStream.schema(_velocities(spark, sf_dir).schema).parquet(_once(spark, sf_dir, f"landed-{times}", write))


def _ntz(name: str) -> Column:
    return F.col(name).cast("timestamp_ntz").alias(name)


@_query(f"SELECT * FROM ({_rollup_sql('1 hour')}) WHERE bucket + INTERVAL '1 hour' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)")
def stream_rollup_1hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours that are complete by the watermark."""
    rolled = _run(live.stream_rollup(_landed(spark, sf_dir), "1 hour"), "stream-rollup")
    return rolled.select(_ntz("bucket"), "station_code", F.round("v_horizontal_max", 9).alias("v_max"), F.round("v_horizontal_avg", 9).alias("v_avg"), F.round("v_east_avg", 9).alias("e_avg"), "sample_count")


@_query("SELECT DISTINCT ts AS time, user_id::VARCHAR AS station_code, event_id, round(value / 1000, 9) AS v FROM events")
def stream_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that land twice, once each."""
    rows = live.dedupe_stream(live.with_event_time(_landed(spark, sf_dir, 2)), ("time", "station_code", "event_id"))
    return _run(rows, "stream-dedupe").select(_ntz("time"), "station_code", "event_id", F.round("v_horizontal", 9).alias("v"))


@_query("""WITH m AS (SELECT time_bucket(INTERVAL '10 seconds', ts) AS bucket, user_id::VARCHAR AS station_code, avg(value / 1000) AS mean_v, avg(value / 1000) > 0.1 AS breach FROM events GROUP BY 1, 2),
l AS (SELECT *, coalesce(lag(breach) OVER w AND lag(bucket) OVER w + INTERVAL '10 seconds' = bucket, FALSE) AS held FROM m WINDOW w AS (PARTITION BY station_code ORDER BY bucket))
SELECT bucket, station_code, round(mean_v, 9) AS mean_v, breach, breach AND held AS firing FROM l WHERE bucket + INTERVAL '10 seconds' <= (SELECT max(ts) - INTERVAL '10 minutes' FROM events)""")
def stream_alerts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts of a stream of ten-second means, each with the state of the window before."""
    means = telemetry.alert_means(live.with_event_time(_landed(spark, sf_dir)), limit=0.1)
    return _run(live.alert_stream(means), "stream-alerts").select(_ntz("bucket"), "station_code", F.round("mean_v", 9).alias("mean_v"), "breach", "firing")


def _number(x: Column) -> Column:
    return F.format_string("%.6f", x)


def _motion(e: DataFrame) -> DataFrame:
    """Events as sentences: views as displacements with a start time and completeness, others as velocities."""
    clock = [F.date_format("ts", "HHmmss.SS"), F.date_format("ts", "MMddyy")]
    parts = [_number(F.col("value") * k) for k in (0.0006, 0.0008, 0.0001)] + [F.lit("0.00000")] * 6 + [F.lit("0.0100"), (F.col("user_id") % 30).cast("string")]
    begin = F.expr("ts - interval 90 seconds")
    ldm = F.concat_ws(",", F.lit("GPLDM"), *clock, F.date_format(begin, "HHmmss.SS"), F.date_format(begin, "MMddyy"), *parts, (F.col("event_id") % 2).cast("string"), F.lit("0.90"), F.format_string("%.2f", F.col("event_id") % 100 / 100))
    lvm = F.concat_ws(",", F.lit("GNLVM"), *clock, *parts)
    body = F.when(F.col("event_type") == "view", ldm).otherwise(lvm)
    return lines.bound(e, _body=body, sentence=F.concat(F.lit("$"), F.col("_body"), F.lit("*"), text.xor_checksum(F.col("_body")))).drop("_body")


@_query("""SELECT event_id, make_timestamp(epoch_us(ts) // 10000 * 10000) AS time, make_timestamp(epoch_us(ts) // 10000 * 10000 - 90000000) AS start_time, round(value * 0.0006, 6) AS d_east, round(value * 0.0008, 6) AS d_north, round(value * 0.0001, 6) AS d_up,
round(hypot_, 6) AS d_horizontal, (event_id % 2)::INT AS reset_indicator, round(event_id % 100 / 100, 2) AS overall_completeness, 0.01::DOUBLE AS quality, 'RECEIVER' AS displacement_source
FROM (SELECT *, sqrt(round(value * 0.0006, 6) ** 2 + round(value * 0.0008, 6) ** 2) AS hypot_ FROM events) WHERE event_type = 'view'""")
def ldm_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Displacements written as sentences, parsed, and named as in their table."""
    made = _motion(_spread(_table(spark, sf_dir, "events"))).select("event_id", F.col("user_id").cast("string").alias("station_code"), "sentence")
    good, _ = sentences.parse_ldm(sentences.route_sentences(made).filter("kind = 'LDM'"))
    keys = good.select("event_id", "station_code", "time", _ntz("start_time"), "reset_indicator")
    rows = sentences.to_displacement_rows(good.withColumn("station_code", F.col("event_id").cast("string"))).withColumnsRenamed({"station_code": "event_id", "time": "_time"})
    joined = keys.join(rows.withColumn("event_id", F.col("event_id").cast("long")), "event_id")
    return joined.select("event_id", _ntz("time"), "start_time", *[F.round(c, 6).alias(c) for c in ("d_east", "d_north", "d_up", "d_horizontal")], "reset_indicator", F.round("overall_completeness", 2).alias("overall_completeness"), "quality", "displacement_source")


@_query("""WITH v AS (SELECT (user_id % 50)::VARCHAR AS station_code, make_timestamp(epoch_us(ts) // 10000 * 10000) AS time, min(event_id) AS event_id FROM events WHERE event_type <> 'view' GROUP BY 1, 2)
SELECT station_code, time, round(value * 0.0006, 6) AS v_east, round(value * 0.0008, 6) AS v_north FROM v JOIN events USING (event_id)""")
def live_velocities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The velocities that the live job publishes of files of sentences, each of which lands twice under two names; of equal times the first."""

    def write(path: str) -> None:
        e = _motion(_spread(_table(spark, sf_dir, "events").filter("user_id is not null")))
        rows = e.select((F.col("user_id") % 50).cast("string").alias("station_code"), "event_id", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("copy"), F.col("sentence").alias("value"))
        rows = rows.withColumn("name", F.concat_ws("_", "station_code", "copy"))
        _files(rows.groupBy("name").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", "value"))), lambda x: x["value"]), "\n").alias("content")), path)

    folder, out = _once(spark, sf_dir, "sentences", write), scratch_path(spark, "live")
    before = spark.conf.get(PROVIDER, None)
    spark.conf.set(PROVIDER, ROCKS)
    try:
        none = spark.createDataFrame([], "station_code string, threshold_mm_s double, filter struct<enabled: boolean, decay: double>")
        for query in jobs.live_telemetry(spark, folder, f"{out}/tables", f"{out}/state", none, every=None, files_per_trigger=1_000_000, delay=40 * 86400.0):
            query.awaitTermination()
    finally:
        spark.conf.unset(PROVIDER) if before is None else spark.conf.set(PROVIDER, before)
    rows = jobs.live_ledger(spark, f"{out}/tables").read("velocities")
    return rows.select("station_code", _ntz("time"), F.round("v_east", 6).alias("v_east"), F.round("v_north", 6).alias("v_north"))


def _files(df: DataFrame, folder: str) -> None:
    """A file for each row (name, content) of df, written by tasks."""

    def run(batches):
        for batch in batches:
            for name, content in zip(batch.column("name").to_pylist(), batch.column("content").to_pylist()):
                system, at = FileSystem.from_uri(f"{folder}/{name}")
                with system.open_output_stream(at, compression=None) as out:
                    out.write(content if isinstance(content, bytes) else content.encode())
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows], pa.int64())], ["n"])

    there = FileSystem.from_uri(folder)
    there[0].create_dir(there[1], recursive=True)
    df.select("name", "content").mapInArrow(run, "n long").agg(F.sum("n")).collect()


@_query(_rollup_sql("1 hour"))
def late_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours from states by minute that were refreshed after each of three batches, the last with late rows of all days, the second logged twice."""
    rows = _velocities(spark, sf_dir)
    store = rollups.RollupStore(spark, scratch_path(spark, "rollup"))
    part = F.when(F.col("event_id") % 10 == 0, "c").when(F.col("event_id") % 2 == 0, "a").otherwise("b")
    for batch in "abcb":
        store.log(batch, rows.filter(part == batch))
        store.refresh()
    rolled = store.read("1 hour")
    return rolled.select(_ntz("bucket"), "station_code", F.round("v_horizontal_max", 9).alias("v_max"), F.round("v_horizontal_avg", 9).alias("v_avg"), F.round("v_east_avg", 9).alias("e_avg"), "sample_count")


@_query(f"""WITH {_DAYS}, {_RUNS.format(src='d', name='with_data')}, y AS (SELECT station, year, count(*) AS n_days, CASE WHEN year % 4 = 0 THEN 366 ELSE 365 END AS year_days FROM d GROUP BY 1, 2),
a AS (SELECT station, year, unnest(range(1, year_days + 1))::INT AS doy FROM y), p AS (SELECT * FROM a ANTI JOIN d USING (station, year, doy)),
{_RUNS.format(src='p', name='gaps').replace('i AS', 'i2 AS').replace('FROM i ', 'FROM i2 ').replace('u AS', 'u2 AS').replace('FROM u ', 'FROM u2 ').replace('c AS', 'c2 AS')}
SELECT station, year, n_days, year_days, round(n_days / year_days, 6) AS share, with_data, coalesce(gaps, '') AS gaps FROM y JOIN c USING (station, year) LEFT JOIN c2 USING (station, year)""")
def coverage_appended(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage from stored bitmaps to which days were appended in three parts that overlap."""
    days = _days(spark, sf_dir).withColumn("station", F.col("station").cast("string"))
    path = scratch_path(spark, "bitmaps") + "/table"
    for part in ("doy <= 150", "doy > 300", "doy > 100"):
        stored = rollups.append_days(spark, path, days.filter(part))
    shown = network.coverage_of_bits(stored)
    return shown.select(F.col("station").cast("long").alias("station"), "year", "n_days", "year_days", F.round("share", 6).alias("share"), "with_data", "gaps")


@_query("""WITH d AS (SELECT DISTINCT c_nationkey AS station, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy FROM orders JOIN customer ON o_custkey = c_custkey),
a AS (SELECT station, year, unnest(range(1, CASE WHEN year % 4 = 0 THEN 367 ELSE 366 END))::INT AS doy FROM (SELECT DISTINCT station, year FROM d)) SELECT * FROM a ANTI JOIN d USING (station, year, doy)""")
def missing_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days of each year without an order of a nation, a row each."""
    orders = _table(spark, sf_dir, "orders").join(_table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey"), "o_custkey")
    days = network.distinct_days(orders.select(F.col("c_nationkey").alias("station"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy")))
    return network.day_gaps(days)


@_query("""WITH o AS (SELECT c_nationkey AS station_code, o_orderkey, o_orderdate::DATE AS d FROM orders JOIN customer ON o_custkey = c_custkey),
h AS (SELECT station_code, o_orderkey AS serial_number, d AS date_installed, lead(d, 2) OVER (PARTITION BY station_code ORDER BY d, o_orderkey) AS date_removed FROM o)
SELECT l_orderkey, l_linenumber, count(*) AS n, min(serial_number) AS first, max(serial_number) AS last FROM lineitem JOIN o ON l_orderkey = o_orderkey JOIN h ON h.station_code = o.station_code AND l_shipdate::DATE >= date_installed AND (date_removed IS NULL OR l_shipdate::DATE < date_removed) GROUP BY 1, 2""")
def equipment_of_nation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment in place at each line item's date where a station, a nation, has spells from each order to the next but one: many, overlapping."""
    customers = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_nationkey").alias("station_code"))
    orders = _table(spark, sf_dir, "orders").join(customers, "o_custkey").select("station_code", "o_orderkey", F.col("o_orderdate").cast("date").alias("date_installed"))
    history = ordered.lead_by_ranges(orders, ("station_code",), ("date_installed", "o_orderkey"), "date_installed", 2, "date_removed", rows=_table(spark, sf_dir, "orders").count())
    history = history.select("station_code", F.col("o_orderkey").alias("serial_number"), "date_installed", "date_removed")
    items = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))
    n = items.count()
    probes = series.dealt(items, "o_orderkey", rows=n).join(orders.select("o_orderkey", "station_code"), "o_orderkey").withColumnRenamed("o_orderkey", "l_orderkey")
    return series.dealt(network.equipment_at(history, probes), "l_orderkey", "l_linenumber", rows=n).groupBy("l_orderkey", "l_linenumber").agg(F.count("*").alias("n"), F.min("serial_number").alias("first"), F.max("serial_number").alias("last"))


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE 'D:\\' || s_suppkey || '.05o' END AS original_path, CASE WHEN s_suppkey % 5 = 0 THEN NULL ELSE s_nationkey::BIGINT END AS size_bytes, CASE WHEN s_suppkey % 5 = 0 THEN 'truncated' END AS error FROM supplier")
def deleted_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata files of deleted files as they lie in folders, one for each supplier, scanned; every fifth is cut short."""

    def write(path: str) -> None:
        little = lambda x, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(x), 2 * size, "0"), F.lit("(..)"), F.lit(0))), ""))
        name = F.concat(F.lit("D:\\"), F.col("s_suppkey").cast("string"), F.lit(".05o"))
        content = F.concat(little(F.lit(2), 8), little(F.col("s_nationkey"), 8), little(F.lit((1_600_000_000_000_000 + 11644473600000000) * 10), 8), little(F.length(name) + 1, 4), F.encode(F.concat(name, F.lit("\x00")), "UTF-16LE"))
        files = _table(spark, sf_dir, "supplier").select(F.concat(F.lit("$I"), F.col("s_suppkey").cast("string")).alias("name"), F.when(F.col("s_suppkey") % 5 == 0, F.substring(content, 1, 20)).otherwise(content).alias("content"))
        _files(files, path)

    found = archive_sources.scan_deleted_metadata(spark, _once(spark, sf_dir, "deleted", write))
    return found.select(F.regexp_extract("meta_path", r"\$I([0-9]+)$", 1).cast("long").alias("s_suppkey"), "original_path", "size_bytes", "error")


@_query("SELECT url, CASE WHEN url LIKE '%.html' THEN 'page' END AS kind, CASE WHEN url LIKE '%.html' THEN regexp_extract(url, '^[a-z]+://([^/]+)', 1) END AS host FROM pages")
def own_extractor(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of page addresses by an extractor that is added for them and taken off again."""
    archive.register_extractor(lambda name: F.endswith(name, F.lit(".html")), lambda name: F.create_map(F.lit("kind"), F.lit("page"), F.lit("host"), F.regexp_extract(name, "^[a-z]+://([^/]+)", 1)))
    try:
        rows = archive.extract_name_fields(_table(spark, sf_dir, "pages").select(F.col("url").alias("name")))
    finally:
        archive.EXTRACTORS.pop(0)
    return rows.select(F.col("name").alias("url"), F.col("fields")["kind"].alias("kind"), F.col("fields")["host"].alias("host"))


@_query("""SELECT l_returnflag, l_linestatus, round(quantile_cont(l_extendedprice, 0.25::DOUBLE), 6) AS price_low, round(quantile_cont(l_extendedprice, 0.75::DOUBLE), 6) AS price_high, round(quantile_cont(l_quantity, 0.25::DOUBLE), 6) AS quantity_low, round(quantile_cont(l_quantity, 0.75::DOUBLE), 6) AS quantity_high FROM lineitem GROUP BY 1, 2""")
def large_quartiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact quartiles of few, large groups: ranks bracketed by a sketch, one column with many ties."""
    q = series.group_quantiles(_table(spark, sf_dir, "lineitem"), ("l_returnflag", "l_linestatus"), ("l_extendedprice", "l_quantity"), (0.25, 0.75))
    pick = lambda c, i, name: F.round(F.get(f"q_{c}", F.lit(i)), 6).alias(name)
    return q.select("l_returnflag", "l_linestatus", pick("l_extendedprice", 0, "price_low"), pick("l_extendedprice", 1, "price_high"), pick("l_quantity", 0, "quantity_low"), pick("l_quantity", 1, "quantity_high"))


@_query("SELECT l_suppkey % 40 AS file, l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_suppkey % 40 ORDER BY l_orderkey, l_linenumber) AS line_no FROM lineitem")
def lines_over_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line numbers of forty files of line items, read by splits of 4 kB, or of a 500th of the files' bytes if that is more: each split is a task."""

    def write(path: str) -> None:
        rows = _table(spark, sf_dir, "lineitem").select((F.col("l_suppkey") % 40).alias("file"), "l_orderkey", "l_linenumber", F.concat_ws(" ", "l_orderkey", "l_linenumber", "l_extendedprice").alias("value"))
        rows.repartition("file").sortWithinPartitions("file", "l_orderkey", "l_linenumber").select("file", "value").write.partitionBy("file").text(path)

    folder, size = _once(spark, sf_dir, "items", write), "spark.sql.files.maxPartitionBytes"
    there = spark._jvm.org.apache.hadoop.fs.Path(folder)
    total = there.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(there).getLength()
    before = spark.conf.get(size)
    spark.conf.set(size, str(max(4096, total // 500)))
    try:
        read, part = lines.read_lines(spark, folder, whole=-1), F.split("line", " ")
        file = F.regexp_extract("file_path", "file=([0-9]+)/", 1).cast("long")
        return staged(read.select(file.alias("file"), F.get(part, 0).cast("long").alias("l_orderkey"), F.get(part, 1).cast("long").alias("l_linenumber"), "line_no"), "lines")
    finally:
        spark.conf.set(size, before)


@_query("""SELECT c_custkey AS row, c_custkey % 180 + 0.25::DOUBLE AS lon1, c_nationkey + 0.5::DOUBLE AS lat1, c_custkey % 180 + 1.25::DOUBLE AS lon2, c_nationkey + 1.5::DOUBLE AS lat2,
round(c_acctbal, 2) AS obs, round(c_acctbal + 3, 2) AS cal, round(7 - c_acctbal, 2) AS res FROM customer""")
def baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Baselines from four tables that belong together by line."""

    def write(path: str) -> None:
        c = _table(spark, sf_dir, "customer").orderBy("c_custkey").coalesce(1)
        ends = F.format_string("%.2f %.1f %.2f %.1f", F.col("c_custkey") % 180 + 0.25, F.col("c_nationkey") + 0.5, F.col("c_custkey") % 180 + 1.25, F.col("c_nationkey") + 1.5)
        cents = lambda x: F.format_string("%.2f", F.round(x, 2))
        for name, value in (("ends", ends), ("obs", cents(F.col("c_acctbal"))), ("cal", cents(F.col("c_acctbal") + 3)), ("res", cents(7 - F.col("c_acctbal")))):
            c.select(value.alias("value")).write.text(f"{path}/{name}")

    folder = _once(spark, sf_dir, "baselines", write)
    rows = coordinates.read_baselines(spark, *[f"{folder}/{name}/part-*" for name in ("ends", "obs", "cal", "res")])
    first = _table(spark, sf_dir, "customer").agg(F.min("c_custkey").alias("first"))
    return rows.crossJoin(first).select((F.col("row") - 1 + F.col("first")).cast("long").alias("row"), "lon1", "lat1", "lon2", "lat2", "obs", "cal", "res")  # one row


@_query("SELECT event_id, round(value * 0.6 * sin(radians(35)) + value * 0.8 * cos(radians(35)), 6) + 0.0 AS along, round(value * 0.6 * cos(radians(35)) - value * 0.8 * sin(radians(35)), 6) + 0.0 AS across FROM events")
def along_azimuth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of velocities along an azimuth of 35 degrees and to its right."""
    along, across = geodesy.azimuth_components(F.col("value") * 0.6, F.col("value") * 0.8, 35.0)
    return _table(spark, sf_dir, "events").select("event_id", (F.round(along, 6) + 0.0).alias("along"), (F.round(across, 6) + 0.0).alias("across"))
