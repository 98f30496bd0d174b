"""Further operators as queries over the driver's tables, with their SQL; see queries.py for the conventions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.functions import text, times
from geostream.operators import archive, faults, network, series, telemetry
from geostream.queries import _ORDERS, _order_series, _page_files, _PAGES, _query, _table, _velocities
from geostream.sources import archive as archive_sources
from geostream.sources import reports

# --- joins and sets -----------------------------------------------------------------------------------------------


@_query("SELECT c_custkey, c_nationkey AS station_code, CASE WHEN n_nationkey IS NULL THEN 'unknown station ' || c_nationkey END AS error_message FROM customer LEFT JOIN (SELECT * FROM nation WHERE n_regionkey <> 2) ON c_nationkey = n_nationkey")
def resolve_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files resolved against the stations, and the failures with their message."""
    found = _table(spark, sf_dir, "customer").select("c_custkey", F.col("c_nationkey").alias("station_code"))
    stations = _table(spark, sf_dir, "nation").filter("n_regionkey <> 2").select(F.col("n_nationkey").alias("station_code"))
    good, failed = network.resolve_stations(found, stations)
    return good.select("c_custkey", "station_code").withColumn("error_message", F.lit(None).cast("string")).unionByName(failed.select("c_custkey", "station_code", "error_message"))


@_query("WITH n AS (SELECT DISTINCT sha256(text) AS file_hash FROM documents WHERE doc_id % 2 = 0), e AS (SELECT sha256(text) AS file_hash FROM documents WHERE doc_id % 2 = 1) SELECT * FROM n ANTI JOIN e USING (file_hash)")
def new_catalog_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    hashed = _table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.encode("text", "UTF-8")).alias("file_hash"))
    return network.new_catalog_rows(hashed.filter("doc_id % 2 = 0").select("file_hash"), hashed.filter("doc_id % 2 = 1").select("file_hash"))


@_query(f"WITH {_ORDERS}, g AS (SELECT DISTINCT station, round(t, 4) AS r FROM o WHERE o_orderkey % 5 = 0) SELECT station, o_orderkey FROM o WHERE NOT EXISTS (SELECT 1 FROM g WHERE g.station = o.station AND g.r = round(o.t, 4))")
def strip_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_series(spark, sf_dir)
    return series.strip_outliers(rows, rows.filter("o_orderkey % 5 = 0")).select("station", "o_orderkey")


@_query("""WITH d AS (SELECT unnest(range(DATE '2022-11-27', DATE '2023-12-31' + INTERVAL 1 DAY, INTERVAL 1 DAY))::DATE AS date),
x AS (SELECT date, 'ORB' AS content, printf('COD0OPSFIN_%04d%03d0000_01D_05M_ORB.SP3.gz', year(date), dayofyear(date)) AS file_name FROM d UNION ALL SELECT date, 'CLK', printf('COD0OPSFIN_%04d%03d0000_01D_30S_CLK.CLK.gz', year(date), dayofyear(date)) FROM d),
f AS (SELECT DISTINCT printf('COD0OPSFIN_%04d%03d0000_01D_05M_ORB.SP3.gz', year(o_orderdate) + 28, dayofyear(o_orderdate)) AS file_name FROM orders)
SELECT x.* FROM x ANTI JOIN f USING (file_name)""")
def missing_products(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily products of a year that no order, 28 years on, stands for."""
    d = F.col("o_orderdate")
    there = _table(spark, sf_dir, "orders").select(F.format_string("COD0OPSFIN_%04d%03d0000_01D_05M_ORB.SP3.gz", F.year(d) + 28, F.dayofyear(d)).alias("file_name"))
    return network.missing_products(spark, "2022-11-27", "2023-12-31", there)


@_query("SELECT DISTINCT conv_id FROM conversations WHERE conv_id IN (SELECT c_custkey FROM customer WHERE c_custkey % 2 = 0)")
def submitted_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    sheets = _table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("client_uuid"))
    ids = _table(spark, sf_dir, "customer").filter("c_custkey % 2 = 0").select(F.col("c_custkey").alias("client_uuid"))
    return network.submitted(sheets, ids).distinct().withColumnRenamed("client_uuid", "conv_id")


@_query("SELECT l_orderkey AS client_uuid, string_agg(s_name, ',' ORDER BY s_name) AS observers FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY 1")
def logsheet_observers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names on a many-to-many link: orders with status by their suppliers."""
    links = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("client_uuid"), F.col("l_suppkey").alias("staff_id"))
    sheets = links.select("client_uuid").distinct()
    staff = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("staff_id"), F.col("s_name").alias("full_name"))
    return network.logsheet_observers(sheets, links, staff).withColumn("observers", F.array_join("observers", ","))


@_query(f"WITH {_PAGES}, d AS (SELECT path FROM p WHERE page_id % 3 = 0 UNION SELECT path FROM p WHERE page_id % 7 = 0) SELECT page_id, p.path FROM p ANTI JOIN d USING (path)")
def remaining_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths still to be scanned after two checkpoints."""
    files = _page_files(spark, sf_dir).select("page_id", "path")
    return archive.remaining(files, archive.merge_done(files.filter("page_id % 3 = 0"), files.filter("page_id % 7 = 0"))).select("page_id", "path")


@_query("SELECT c_custkey AS station_code, CASE WHEN c_custkey % 3 = 0 THEN 'new ' || c_name ELSE c_name END AS name, c_mktsegment AS agency FROM customer UNION ALL SELECT 1000000 + s_suppkey, s_name, 'added' FROM supplier")
def upsert_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_code"), F.col("c_name").alias("name"), F.col("c_mktsegment").alias("agency"))
    fresh = c.filter("station_code % 3 = 0").select("station_code", F.concat(F.lit("new "), "name").alias("name"), F.lit("ignored").alias("agency"))
    added = _table(spark, sf_dir, "supplier").select((F.col("s_suppkey") + 1000000).alias("station_code"), F.col("s_name").alias("name"), F.lit("added").alias("agency"))
    return network.upsert_stations(c, fresh.unionByName(added))


@_query("SELECT count(*)::BIGINT AS checked, count(*) FILTER (WHERE c_custkey % 7 = 0 AND c_mktsegment <> 'OTHER') AS mismatches, 0 AS missing, (SELECT count(DISTINCT c_custkey) FROM customer WHERE c_nationkey >= 20) AS uncalibrated, FALSE AS ok FROM customer")
def validation_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    headers = c.select(F.col("c_custkey").alias("station_code"), F.col("c_mktsegment").alias("receiver_type"), F.concat(F.col("c_nationkey").cast("string"), F.lit(" NONE")).alias("antenna_type"))
    sta = headers.withColumn("receiver_type", F.when(F.col("station_code") % 7 == 0, "OTHER").otherwise(F.col("receiver_type")))
    antennas = _table(spark, sf_dir, "nation").filter("n_nationkey < 20").select(F.col("n_nationkey").cast("string").alias("antenna_type"))
    report = network.validation_report(network.crosscheck_headers(headers, sta), network.uncalibrated(headers, antennas))
    return report.select("checked", "mismatches", (F.size("missing_headers") + F.size("missing_station_info")).alias("missing"), F.size("uncalibrated").cast("long").alias("uncalibrated"), "ok")


# --- aggregates and windows ---------------------------------------------------------------------------------------


@_query("SELECT max(s_acctbal) AS max_rms, arg_max(s_suppkey, s_acctbal) AS max_rms_station, max(s_nationkey)::DOUBLE AS max_bad, (SELECT max(s_suppkey) FROM supplier WHERE s_nationkey = (SELECT max(s_nationkey) FROM supplier)) AS max_bad_station FROM supplier")
def worst_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station"), F.col("s_acctbal").alias("rms_m"), F.col("s_nationkey").cast("double").alias("bad_pct"))
    return network.worst_stations(rows)


@_query("SELECT l_orderkey AS file_name, count(DISTINCT l_suppkey) AS n_stations FROM lineitem GROUP BY 1")
def stations_per_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.stations_per_solution(_table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("file_name"), F.col("l_suppkey").alias("station")))


@_query("SELECT user_id AS file_hash, arg_max(event_type, event_id) AS status, max(event_id) AS seq FROM events GROUP BY 1")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = _table(spark, sf_dir, "events").select(F.col("user_id").alias("file_hash"), F.col("event_type").alias("status"), F.col("event_id").alias("seq"))
    return network.current_state(log)


@_query("""WITH e AS (SELECT user_id, event_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS v FROM events),
c AS (SELECT user_id, event_id, CASE WHEN v IS NULL THEN NULL WHEN floor(v / 100) = floor(value / 100) THEN 'IDENTICAL' WHEN floor(v / 100) >= 3 THEN 'HIGH_VEL_NEQ' ELSE 'LOW_VEL_NEQ' END AS signal FROM e WHERE event_type <> 'view'),
n AS (SELECT *, CASE WHEN (signal <> lag(signal) OVER w) IS NOT FALSE THEN 1 ELSE 0 END AS fresh FROM c WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM n),
l AS (SELECT *, row_number() OVER (PARTITION BY user_id, run ORDER BY event_id) AS k FROM r),
m AS (SELECT *, coalesce(last_value(CASE WHEN signal = 'IDENTICAL' AND k >= 5 THEN 'MANUAL' WHEN signal = 'LOW_VEL_NEQ' AND k >= 3 THEN 'MANUAL' WHEN signal = 'HIGH_VEL_NEQ' AND k >= 30 THEN 'RECEIVER' END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id), 'RECEIVER') AS mode FROM l)
SELECT user_id AS station_code, event_id, signal, mode, coalesce(mode = 'MANUAL' AND signal = 'LOW_VEL_NEQ', FALSE) AS frozen FROM m""")
def receiver_mode(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Signal classes and receiver modes: views are velocities, all others displacements, in steps of 0.1 m/s."""
    step = F.floor(F.col("value") / 100) / 10.0
    e = _table(spark, sf_dir, "events").select(F.col("user_id").alias("station_code"), "event_id", "event_type", step.alias("e"))
    v = e.filter("event_type = 'view'").select("station_code", "event_id", F.col("e").alias("vE"), F.lit(0.0).alias("vN"))
    d = e.filter("event_type <> 'view'").select("station_code", "event_id", F.col("e").alias("dE"), F.lit(0.0).alias("dN"))
    marked = telemetry.classify_signal(telemetry.asof_last(d, v, ("vE", "vN"), order=("event_id",)), 299.9)
    return telemetry.receiver_mode(marked, ("event_id",)).select("station_code", "event_id", "signal", "mode", "frozen")


@_query(f"WITH {_ORDERS}, n AS (SELECT station, t, row_number() OVER (PARTITION BY station ORDER BY abs(t - 1995.0::DOUBLE), t) AS k FROM o) SELECT o.station, o_orderkey, o.t >= n.t AS after FROM o JOIN n ON o.station = n.station AND k = 1")
def split_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.split_at(_order_series(spark, sf_dir), 1995.0).select("station", "o_orderkey", "after")


@_query("""WITH e AS (SELECT user_id, event_id, (epoch_us(ts) // 1000000) % 86400 AS s FROM events),
b AS (SELECT *, CASE WHEN lag(s) OVER w - s > 43200 THEN 1 ELSE 0 END AS back FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT event_id, TIMESTAMP '2024-01-01' + to_seconds(s + 86400 * sum(back) OVER (PARTITION BY user_id ORDER BY event_id)) AS time FROM b""")
def resolve_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day of each user dated by rollover at midnight."""
    rows = _table(spark, sf_dir, "events").select("user_id", "event_id", F.date_format("ts", "HH:mm:ss").alias("clock"))
    dated = telemetry.resolve_dates(rows, "2024-01-01", by="user_id", order=("event_id",))
    return dated.select("event_id", F.col("time").cast("timestamp_ntz").alias("time"))


@_query("""WITH a AS (SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, user_id::VARCHAR AS station_code, avg(value / 1000) > 0.02 AS breach FROM events GROUP BY 1, 2)
SELECT bucket, station_code, breach AND coalesce(lag(breach) OVER w AND lag(bucket) OVER w + INTERVAL '1 hour' = bucket, FALSE) AS firing FROM a WINDOW w AS (PARTITION BY station_code ORDER BY bucket)""")
def alert_holds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alerts that have lasted through the window before."""
    held = telemetry.alert_holds(telemetry.alert_means(_velocities(spark, sf_dir), "1 hour", 0.02), "1 hour")
    return held.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "station_code", "firing")


@_query("SELECT event_id, round(value, 6) AS v_mm FROM events WHERE user_id = 7 AND ts BETWEEN TIMESTAMP '2024-01-03' AND TIMESTAMP '2024-01-25'")
def series_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = telemetry.series_window(_velocities(spark, sf_dir), "7", "2024-01-03", "2024-01-25", ("v_horizontal",))
    return rows.select("event_id", F.round("v_horizontal", 6).alias("v_mm"))


# --- archive and points -------------------------------------------------------------------------------------------


@_query(rf"WITH {_PAGES} SELECT page_id, regexp_matches(lower(name), '\.(rnx|crx|gz|zip|z|[0-9]{{2}}[od])$') AS observation, (substr(name, 5, 3) = '015' OR contains(name, '2024015') OR contains(name, '20240150')) AS in_session FROM n")
def name_predicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = _page_files(spark, sf_dir)
    return files.select("page_id", archive_sources.is_observation_file(F.col("name")).alias("observation"), archive_sources.matches_session(F.col("name"), 2024, "0150").alias("in_session"))


@_query(rf"WITH {_PAGES} SELECT page_id, path FROM n WHERE NOT starts_with(name, '.') AND NOT list_contains(string_split(path, '/'), 'en') AND NOT regexp_matches(path, '(^|/)[^/]*casino[^/]*(/|$)')")
def scope_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive.scope_catalog(_page_files(spark, sf_dir), excludes=("*casino*",), system=("en",)).select("page_id", "path")


@_query(rf"WITH {_PAGES}, k AS (SELECT coalesce(category, '') AS category, path, row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY path) AS k FROM (SELECT DISTINCT category, path FROM c)) SELECT category, string_agg(path, '|' ORDER BY path) AS paths FROM k WHERE k <= 5 GROUP BY 1")
def itemise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A listing of the first five paths of each category."""
    files = archive.classify_files(_page_files(spark, sf_dir)).select(F.coalesce("category", F.lit("")).alias("category"), "path").distinct()
    return archive.itemise(files).select("category", F.array_join("paths", "|").alias("paths"))


@_query(r"""WITH d AS (SELECT doc_id, substr('abcd', doc_id % 2 + 1, 3) || (doc_id % 10) || lpad((doc_id % 366)::VARCHAR, 3, '0') || '0.' || lpad((doc_id % 30)::VARCHAR, 2, '0') || CASE WHEN doc_id % 3 = 0 THEN 'x' ELSE 'o' END AS name FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 <> 0 THEN substr(name, 1, 4) END AS station, CASE WHEN doc_id % 3 <> 0 THEN (doc_id % 366)::VARCHAR END AS doy FROM d""")
def name_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields of observation file names made from document ids."""
    i = F.col("doc_id")
    name = F.concat(F.when(i % 2 == 0, "abc").otherwise("bcd"), (i % 10).cast("string"), F.lpad((i % 366).cast("string"), 3, "0"), F.lit("0."), F.lpad((i % 30).cast("string"), 2, "0"), F.when(i % 3 == 0, "x").otherwise("o"))
    named = archive.extract_name_fields(_table(spark, sf_dir, "documents").select("doc_id", name.alias("name")))
    return named.select("doc_id", F.try_element_at("fields", F.lit("station")).alias("station"), F.try_element_at("fields", F.lit("doy")).alias("doy"))


@_query("SELECT c_custkey AS id FROM customer WHERE 120 + (c_custkey % 89) / 89.0::DOUBLE > 120.2 AND 120 + (c_custkey % 89) / 89.0::DOUBLE < 120.7 AND 14 + (c_custkey % 97) / 97.0::DOUBLE > 14.1 AND 14 + (c_custkey % 97) / 97.0::DOUBLE < 14.9")
def clip_bbox(spark: SparkSession, sf_dir: str) -> DataFrame:
    points = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), (120 + (F.col("c_custkey") % 89) / 89).alias("lon"), (14 + (F.col("c_custkey") % 97) / 97).alias("lat"))
    return faults.clip_bbox(points, 120.2, 120.7, 14.1, 14.9).select("id")


@_query("""WITH p AS (SELECT p_partkey AS row, (p_partkey % 90)::DOUBLE AS dip, (p_partkey % 360)::DOUBLE AS strike, (p_size - 25)::DOUBLE AS ss, (p_partkey % 13)::DOUBLE AS ds FROM part),
v AS (SELECT row, radians(strike - 90) + CASE WHEN ss = 0 AND ds = 0 THEN 0 ELSE atan2(ss, ds * cos(radians(dip))) END AS b, sqrt(ss * ss + (ds * cos(radians(dip))) ** 2) AS s FROM p)
SELECT row, round(121 + (row % 50 + 1.5) / (111.325 * cos(radians(14.0::DOUBLE))), 6) AS lon, round(14 + (row % 40 + 1) / 111.325, 6) AS lat, round(s * sin(b), 5) + 0.0 AS slip_east, round(s * cos(b), 5) + 0.0 AS slip_north FROM v""")
def patch_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Centroids and surface slip of patches made from parts."""
    k, d = F.col("p_partkey"), "double"
    corners = {f"x{i + 1}": (k % 50 + i).cast(d) for i in range(4)} | {f"y{i + 1}": (k % 40 + (0, 2, 0, 2)[i]).cast(d) for i in range(4)}
    patches = _table(spark, sf_dir, "part").select(k.alias("row"), (k % 90).cast(d).alias("dip"), (k % 360).cast(d).alias("strike"), (F.col("p_size") - 25).cast(d).alias("slip_strike"), (k % 13).cast(d).alias("slip_dip"), *[c.alias(n) for n, c in corners.items()])
    return faults.patch_vectors(patches, 121.0, 14.0).select("row", F.round("lon", 6).alias("lon"), F.round("lat", 6).alias("lat"), (F.round("slip_east", 5) + 0.0).alias("slip_east"), (F.round("slip_north", 5) + 0.0).alias("slip_north"))


@_query("""SELECT o_orderkey, round(CASE WHEN y > 80 THEN y + 1900 ELSE y + 2000 END + (d - 1) / 365.25::DOUBLE, 6) AS decimal_year, CASE WHEN year(o_orderdate) % 4 = 0 THEN 366 ELSE 365 END AS days
FROM (SELECT *, year(o_orderdate) % 100 AS y, dayofyear(o_orderdate) AS d FROM orders)""")
def session_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Decimal years of five-digit sessions in file names."""
    d = F.col("o_orderdate")
    name = F.concat(F.lit("FIN_"), F.format_string("%02d%03d", F.year(d) % 100, F.dayofyear(d)), F.lit(".CRD"))
    return _table(spark, sf_dir, "orders").select("o_orderkey", F.round(times.session_year(times.session_of(name)), 6).alias("decimal_year"), times.year_length(F.year(d)).alias("days"))


# --- columns and small operators ----------------------------------------------------------------------------------


@_query("SELECT event_id, round(sqrt((value * 0.6) ** 2 + (value * 0.8) ** 2), 6) AS horizontal, round(sqrt((value * 0.6) ** 2 + (value * 0.8) ** 2 + (value * 0.1) ** 2), 6) AS whole FROM events WHERE (user_id % 10) / 10.0 >= 0.5")
def magnitudes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Horizontal and three-dimensional magnitude of displacements that are complete enough."""
    rows = _table(spark, sf_dir, "events").select("event_id", ((F.col("user_id") % 10) / 10).alias("overall_completeness"), *[(F.col("value") * k).alias(n) for n, k in (("e", 0.6), ("n", 0.8), ("u", 0.1))])
    rows = telemetry.with_magnitude(telemetry.with_magnitude(telemetry.filter_complete(rows), "e", "n", name="horizontal"), "e", "n", "u", "whole")
    return rows.select("event_id", F.round("horizontal", 6).alias("horizontal"), F.round("whole", 6).alias("whole"))


_SHORT_RUNS = """e AS (SELECT user_id::VARCHAR AS station_code, event_id, ts, event_type = 'click' AS d, value FROM events WHERE event_type IN ('click', 'view')),
o AS (SELECT *, CASE WHEN NOT d THEN value > 250 END AS over FROM e),
a AS (SELECT *, coalesce(last_value(over IGNORE NULLS) OVER (PARTITION BY station_code ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), FALSE) AS active FROM o),
r AS (SELECT *, sum(coalesce(over AND NOT active, FALSE)::INT) OVER (PARTITION BY station_code ORDER BY event_id) AS run FROM a)"""


@_query(f"WITH {_SHORT_RUNS} SELECT station_code, min_by(ts, event_id) AS detection_time, round(max(value) FILTER (WHERE over), 6) AS peak_velocity, round(coalesce(max(value) FILTER (WHERE d), 0), 6) AS peak_displacement FROM r WHERE coalesce(over, FALSE) OR active GROUP BY station_code, run HAVING count(*) FILTER (WHERE NOT over) > 0")
def peak_displacements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events with the largest displacement that arrives within each: views are velocities, clicks are displacements."""
    d = _table(spark, sf_dir, "events").filter("event_type = 'click'").select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").cast("string").alias("station_code"), "event_id", (F.col("value") / 1000).alias("d_horizontal"))
    found = telemetry.detect_events(_velocities(spark, sf_dir, "view"), d, 250.0, ("event_id",))
    return found.select("station_code", F.col("detection_time").cast("timestamp_ntz").alias("detection_time"), F.round("peak_velocity_horizontal", 6).alias("peak_velocity"), F.round("peak_displacement_horizontal", 6).alias("peak_displacement"))


@_query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'INTEGRATOR' WHEN value < 100 THEN 'RECEIVER_SUSPECT' ELSE 'RECEIVER' END AS displacement_source, round(CASE WHEN event_id % 3 = 0 THEN CASE WHEN event_id % 2 = 0 THEN 0 ELSE 1.5 END ELSE value END, 6) AS d_east FROM events")
def displacement_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by mode and signal, components replaced by the integral in manual mode."""
    n, v = F.col("event_id"), F.col("value")
    rows = _table(spark, sf_dir, "events").select(n, F.when(n % 3 == 0, "MANUAL").otherwise("RECEIVER").alias("mode"), F.when(v < 100, telemetry.LOW).otherwise(telemetry.HIGH).alias("signal"), *[v.alias(f"d{a}") for a in "ENU"], *[F.when(n % 2 == 1, 1.5).alias(f"i{a}") for a in "ENU"])
    return telemetry.label_displacement(rows).select("event_id", "displacement_source", F.round("dE", 6).alias("d_east"))


@_query("SELECT kind, count(*) AS n, round(sum(value), 4) AS total FROM (SELECT 'LVM' AS kind, value FROM events WHERE event_type = 'view' UNION ALL SELECT 'LDM', value FROM events WHERE event_type = 'click') GROUP BY 1")
def merged_streams(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    both = telemetry.merge_streams(e.filter("event_type = 'view'").select("event_id", F.col("value").alias("v")), e.filter("event_type = 'click'").select("event_id", F.col("value").alias("d")))
    return both.groupBy("kind").agg(F.count("*").alias("n"), F.round(F.sum(F.coalesce("v", "d")), 4).alias("total"))


@_query(f"WITH {_PAGES}, r AS (SELECT page_id, path, size_bytes, sum(coalesce(size_bytes, 0)) OVER (ORDER BY path, page_id) AS claimed_bytes FROM p) SELECT page_id, claimed_bytes::BIGINT AS claimed_bytes, claimed_bytes > 100000 AS inconsistent FROM r")
def inconsistent_sizes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From which file on the sizes claim more than the volume holds."""
    rows = _page_files(spark, sf_dir).withColumn("place", F.struct("path", "page_id"))
    return archive.flag_inconsistent(rows, 100_000, "place").select("page_id", "claimed_bytes", "inconsistent")


@_query(f"WITH {_PAGES} SELECT count(*) FILTER (WHERE category = 'GNSS Data') AS gnss_files, count(*) FILTER (WHERE size_bytes > 4000) AS corrupt_entries, sum(size_bytes) > 1000 AS inconsistent, CASE WHEN sum(size_bytes) > 1000 THEN 'unreliable metadata: inspect by hand' ELSE 'no GNSS files: wipe candidate' END AS verdict FROM c")
def archive_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive.flag_corrupt(archive.classify_files(_page_files(spark, sf_dir)), 4000)
    return archive.verdict(files, 1000).select("gnss_files", "corrupt_entries", "inconsistent", "verdict")


@_query(f"WITH {_PAGES} SELECT count(*) AS rows, count(*) FILTER (WHERE page_id % 3 = 0) AS orphans, sum(size_bytes)::BIGINT AS total_bytes, count(*) - count(DISTINCT path) AS dest_collisions FROM p")
def manifest_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_files(spark, sf_dir).select(F.when(F.col("page_id") % 3 == 0, "orphan").otherwise("ok").alias("status"), "size_bytes", F.col("path").alias("dest_path"))
    return archive.manifest_stats(rows)


@_query(f"WITH {_PAGES} SELECT page_id FROM c WHERE page_id % 2 = 0 AND page_id % 5 <> 0")
def dispatched_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GNSS files (here every second one) that aren't in an archive."""
    n = F.col("page_id")
    rows = _page_files(spark, sf_dir).select(n, F.when(n % 2 == 0, "GNSS Data").otherwise("Text").alias("category"), (n % 5 == 0).alias("in_archive"))
    return archive.dispatchable(rows).select("page_id")


@_query("SELECT count(*) FILTER (WHERE turn % 4 <> 0) AS done, count(*) FILTER (WHERE turn % 4 = 0) AS failed FROM conversations WHERE role = 'user'")
def callback_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A callback for each classified row; what it raises is counted."""

    def call(row: dict) -> None:
        if row["turn"] % 4 == 0:
            raise ValueError(row["turn"])

    rows = _table(spark, sf_dir, "conversations").select("turn", F.when(F.col("role") == "user", "GNSS Data").alias("category"))
    return archive.for_each_classified(rows, call)


@_query("SELECT o_custkey AS station_code, count(*) AS n, max(o_orderdate)::DATE AS last FROM (SELECT *, row_number() OVER (ORDER BY o_orderdate DESC, o_orderkey) AS k FROM orders) WHERE k <= 50 GROUP BY 1")
def newest_logsheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: the fifty newest sheets, by station."""
    sheets = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_code"), F.col("o_orderkey").alias("client_uuid"), F.col("o_orderdate").alias("visit_date"))
    newest = network.latest_logsheets(sheets, n=50)
    return newest.groupBy("station_code").agg(F.count("*").alias("n"), F.max("visit_date").cast("date").alias("last"))


@_query("SELECT max(c_name) AS file_name FROM customer WHERE c_name LIKE '%7'")
def latest_solution(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.latest_solution(_table(spark, sf_dir, "customer").select(F.col("c_name").alias("file_name")), "7")


@_query("SELECT draw, count(*) AS n, count(*) FILTER (WHERE place = -1) AS reference FROM (SELECT l_linenumber AS draw, 0 AS place FROM lineitem UNION ALL SELECT DISTINCT l_linenumber, -1 FROM lineitem) GROUP BY 1")
def draws_with_reference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each draw with its reference row."""
    draws = _table(spark, sf_dir, "lineitem").select(F.col("l_linenumber").alias("draw"), F.lit(0).alias("place"), F.col("l_orderkey").alias("sites"))
    ref = _table(spark, sf_dir, "region").filter("r_regionkey = 0").select(F.col("r_regionkey").cast("long").alias("sites"))
    return faults.with_reference(draws, ref).groupBy("draw").agg(F.count("*").alias("n"), F.count_if(F.col("place") == -1).alias("reference"))


@_query("SELECT l_orderkey, l_linenumber, l_shipdate + to_seconds(l_linenumber) AS time, l_shipdate + to_hours(8) AS civil, CASE WHEN l_linenumber = 7 THEN NULL ELSE make_timestamp(year(l_shipdate), month(l_shipdate), day(l_shipdate), 1, 2, l_linenumber + 0.5) END AS header FROM lineitem")
def clock_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """GPS time, civil time and header time of each line item; every seventh header time is malformed."""
    d, n = F.col("l_shipdate"), F.col("l_linenumber")
    days = F.datediff(d, F.lit("1980-01-06"))
    header = F.when(n == 7, "2001 x").otherwise(F.concat(F.date_format(d, " yyyy  MM  dd"), F.format_string("  1  2 %.7f", n + 0.5)))
    rows = _table(spark, sf_dir, "lineitem")
    clocks = {"time": times.gps_time(times.gps_week(d), F.pmod(days, F.lit(7)) * 86400 + n), "civil": times.local_civil(d.cast("timestamp")), "header": times.header_time(header)}
    return rows.select("l_orderkey", "l_linenumber", *[c.cast("timestamp_ntz").alias(name) for name, c in clocks.items()])


@_query("SELECT s_suppkey, CASE WHEN s_suppkey % 3 <> 0 THEN round(sqrt((1.5 + s_nationkey / 100.0::DOUBLE) ** 2 - 0.1698::DOUBLE ** 2) - 0.0443::DOUBLE, 6) END AS antenna_height_m, upper(substr(s_name, 1, 4)) || dayofyear(DATE '2024-01-01' + (s_suppkey % 300)::INT) AS session_id FROM supplier")
def campaign_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Antenna height and session of field records."""
    n = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(n, F.substring("s_name", 1, 4).alias("station_code"), F.when(n % 3 != 0, "TRM41249.00").otherwise("OTHER").alias("antenna_model"), F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")).alias("visit_date"), *[(1.5 + F.col("s_nationkey") / 100).alias(f"slant_{d}_m") for d in "nesw"])
    return network.enrich_campaign(rows).select("s_suppkey", F.round("antenna_height_m", 6).alias("antenna_height_m"), "session_id")


@_query("SELECT doc_id, round(n_chars / 1048576.0::DOUBLE, 2) AS mb, upper(substr(trim(source), 1, 4)) AS station, lang = 'en' AS marked FROM documents")
def name_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sizes in MB, station tokens, and the format's mark in the first ten lines."""
    mark = F.when(F.col("lang") == "en", "a\nb RINEX VERSION / TYPE\n").otherwise("\n" * 12 + "RINEX VERSION / TYPE")
    return _table(spark, sf_dir, "documents").select("doc_id", text.size_mb(F.col("n_chars")).alias("mb"), text.station_of(F.col("source")).alias("station"), reports.has_format_marker(mark).alias("marked"))


@_query("SELECT s_suppkey AS station_code, s_name AS name FROM supplier WHERE s_suppkey % 2 = 0")
def active_stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(n.alias("station_code"), F.col("s_name").alias("name"), F.lit(0.0).alias("lat"), F.lit(0.0).alias("lon"), F.when(n % 2 == 0, "active").otherwise("closed").alias("status"))
    return network.active_stations(rows).select("station_code", "name")


@_query("SELECT 'staff' AS list, c_name AS name FROM customer WHERE c_mktsegment = 'BUILDING' UNION ALL SELECT 'item', p_name FROM part WHERE p_partkey = 5 UNION ALL SELECT 'all', p_brand FROM part")
def staff_and_equipment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Active staff, the item with a code, and the inventory."""
    staff = _table(spark, sf_dir, "customer").select(F.col("c_name").alias("full_name"), (F.col("c_mktsegment") == "BUILDING").alias("is_active"))
    items = _table(spark, sf_dir, "part").select(F.col("p_partkey").cast("string").alias("qr_code"), F.col("p_type").alias("equipment_type"), "p_name", "p_brand")
    parts = [("staff", network.active_staff(staff).select("full_name")), ("item", network.lookup_equipment(items, "5").select("p_name")), ("all", network.lookup_equipment(items).select("p_brand"))]
    named = [df.toDF("name").select(F.lit(label).alias("list"), "name") for label, df in parts]
    return named[0].unionByName(named[1]).unionByName(named[2])


@_query("SELECT o_orderkey, CASE WHEN o_orderpriority LIKE '%URGENT%' THEN 1 WHEN o_orderpriority LIKE '%HIGH%' THEN 2 ELSE 0 END AS phase FROM orders")
def event_phases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by the event that their label names."""
    return series.split_event_rows(_table(spark, sf_dir, "orders"), ("URGENT", "HIGH"), "o_orderpriority").select("o_orderkey", "phase")


@_query("SELECT doc_id, sha256(text) AS file_hash, CASE WHEN doc_id % 3 = 1 THEN 'success' ELSE 'failed' END AS status, 2::BIGINT AS seq, CASE WHEN doc_id % 3 <> 1 THEN 'no station' END AS error_message FROM (SELECT min(doc_id) AS doc_id, text FROM documents GROUP BY text)")
def advanced_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log's last state after each pending file has a result."""
    docs = _table(spark, sf_dir, "documents").groupBy(text.content_hash(F.encode("text", "UTF-8")).alias("file_hash")).agg(F.min("doc_id").alias("doc_id"))
    log = docs.select("file_hash", "doc_id", F.lit("pending").alias("status"), F.lit(1).cast("long").alias("seq"), F.lit(None).cast("string").alias("error_message"))
    results = docs.select("file_hash", (F.col("doc_id") % 3 == 1).alias("ok"), F.lit("no station").alias("error_message"), *[F.lit(None).cast("double").alias(c) for c in ("obs_count", "cycle_slips", "mp1_rms", "mp2_rms")])
    return network.current_state(network.advance_log(log, results)).select("doc_id", "file_hash", "status", "seq", "error_message")


@_query("SELECT p_partkey, p_retailprice AS first, p_size AS second FROM part")
def zipped_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables side by side by row number."""
    p = _table(spark, sf_dir, "part")
    return faults.zip_rows([p.select("p_partkey", F.col("p_retailprice").alias("first")), p.select("p_partkey", F.col("p_size").alias("second"))], "p_partkey")


@_query("""WITH s AS (SELECT s_suppkey, s_suppkey % 7 + 2.0::DOUBLE AS length, s_suppkey % 5 + 4.0::DOUBLE AS width, 20.0::DOUBLE AS depth, radians((s_suppkey % 80 + 5)::DOUBLE) AS dip, radians((s_suppkey % 360)::DOUBLE) AS strike FROM supplier),
c AS (SELECT *, i, j, width - width / 2 * j AS up, length / 3 * i - (length + length / 3) / 2 AS along FROM s, range(1, 4) AS a(i), range(1, 3) AS b(j))
SELECT s_suppkey, i::INT AS patch_i, j::INT AS patch_j, round(length / 3, 6) AS length, round(depth - sin(dip) * up, 6) AS depth, round(along * sin(strike) - cos(dip) * up * cos(strike), 6) + 0.0 AS east, round(along * cos(strike) + cos(dip) * up * sin(strike), 6) + 0.0 AS north FROM c""")
def cut_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Faults cut into three by two patches."""
    n = F.col("s_suppkey")
    fault = _table(spark, sf_dir, "supplier").select(n, (n % 7 + 2.0).alias("length"), (n % 5 + 4.0).alias("width"), F.lit(20.0).alias("depth"), (n % 80 + 5).cast("double").alias("dip"), (n % 360).cast("double").alias("strike"), F.lit(0.0).alias("east"), F.lit(0.0).alias("north"))
    return faults.patches(fault, 3, 2).select("s_suppkey", "patch_i", "patch_j", *[(F.round(c, 6) + 0.0).alias(c) for c in ("length", "depth", "east", "north")])


@_query(f"WITH {_ORDERS} SELECT station, count(*) AS n, round(min(t), 6) AS first FROM o GROUP BY 1")
def sorted_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series in order of station and epoch, summed up."""
    rows = series.sort_series(_order_series(spark, sf_dir), t="t")
    return rows.groupBy("station").agg(F.count("*").alias("n"), F.round(F.min("t"), 6).alias("first"))
