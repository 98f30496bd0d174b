"""The reference workloads as queries over the driver's tables, with their SQL.

Tables stand in for the workloads' own: line items are series of a supplier (station), events are telemetry of a user
(station, value in mm/s), orders are days with data of a customer, and so on. Doubles are rounded alike on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostream.functions import geodesy, text, times
from geostream.operators import archive, draws, faults, network, series, telemetry
from geostream.sources import archive as archive_sources
from geostream.sources import sinks
from geostream.sources import telemetry as sentences
from geostream.sources.lines import bound

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _spread(df: DataFrame) -> DataFrame:
    """df dealt to all cores where its files have fewer splits than there are cores, for work that outweighs a shuffle of its rows."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


# --- series -------------------------------------------------------------------------------------------------------

_SERIES = """
s AS (SELECT l_suppkey::VARCHAR AS station, year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25::DOUBLE AS t, l_quantity AS east_m, l_tax AS north_m, l_discount AS up_m, l_orderkey, l_linenumber FROM lineitem)"""
_SEGMENTS = _SERIES + """,
b AS (SELECT station, min(t) AS t0, max(t) AS t1 FROM s GROUP BY 1),
g AS (SELECT s.*, (CASE WHEN 1994.5 > t0 AND 1994.5 < t1 AND 1994.5 <= t THEN 1 ELSE 0 END + CASE WHEN 1997.25 > t0 AND 1997.25 < t1 AND 1997.25 <= t THEN 1 ELSE 0 END)::INT AS segment FROM s JOIN b USING (station))"""


def _series(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_suppkey").cast("string").alias("station"), times.julian_decimal_year(F.col("l_shipdate")).alias("t"), F.col("l_quantity").alias("east_m"), F.col("l_tax").alias("north_m"), F.col("l_discount").alias("up_m"))


def _offsets(df: DataFrame) -> DataFrame:
    return df.select("station").distinct().withColumn("date", F.explode(F.array(F.lit(1994.5), F.lit(1997.25))))


_FIT_SQL = "round(coalesce(regr_slope({c}, t), 0) * 1000, 4) AS v{a}_mm_yr"
_OUT = " OR ".join(f"{c} < q_{c}[1] - 0.5 * (q_{c}[2] - q_{c}[1]) OR {c} > q_{c}[2] + 0.5 * (q_{c}[2] - q_{c}[1])" for c in series.ENU)
_QUANTILES = ", ".join(f"quantile_cont({c}, [0.25::DOUBLE, 0.75::DOUBLE]) AS q_{c}" for c in series.ENU)
_FLAGGED = f"{_SEGMENTS}, q AS (SELECT station, segment, count(*) AS n, {_QUANTILES} FROM g GROUP BY 1, 2), f AS (SELECT g.*, ({_OUT}) AS is_outlier FROM g JOIN q USING (station, segment) WHERE n >= 3)"
_FITS = ", ".join(_FIT_SQL.format(c=c, a=a) for a, c in zip("enu", series.ENU))
_SIGMAS = ", ".join(f"round(coalesce(sqrt(greatest(regr_syy({c}, t) - regr_sxy({c}, t) * regr_sxy({c}, t) / regr_sxx({c}, t), 0) / (count(*) - 2) / regr_sxx({c}, t)), 0) * 1000, 4) AS sig_v{a}_mm_yr" for a, c in zip("enu", series.ENU))


@_query(f"WITH {_FLAGGED}, v AS (SELECT station, segment, {_FITS}, {_SIGMAS}, count(*) AS n_points, row_number() OVER (PARTITION BY station ORDER BY segment DESC) AS k FROM f WHERE NOT is_outlier GROUP BY 1, 2 HAVING count(*) >= 3) SELECT * EXCLUDE (k) FROM v WHERE k = 1")
def velocity_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset-aware final velocities with outliers beyond 0.5 IQR left out."""
    rows = _series(spark, sf_dir)
    fitted = series.final_velocity(series.estimate_velocity(rows, _offsets(rows), k=0.5).filter("error is null"))
    return fitted.select("station", "segment", *[F.round(f"{p}v{a}_mm_yr", 4).alias(f"{p}v{a}_mm_yr") for p in ("", "sig_") for a in "enu"], "n_points")


@_query(f"WITH {_SEGMENTS}, q AS (SELECT station, segment, count(*) AS n, {_FITS} FROM g GROUP BY 1, 2) SELECT station, round(avg(ve_mm_yr), 3) AS ve, round(avg(vn_mm_yr), 3) AS vn, round(avg(vu_mm_yr), 3) AS vu, count(*) AS n_segments FROM q WHERE n >= 3 GROUP BY 1")
def mean_velocity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean of the segments' velocities, all rows fitted."""
    rows = _series(spark, sf_dir)
    fitted = series.estimate_velocity(rows, _offsets(rows), mode="legacy").withColumns({f"v{a}_mm_yr": F.round(f"v{a}_mm_yr", 4) for a in "enu"})
    return series.mean_velocity(fitted).select("station", *[F.round(f"v{a}_mm_yr", 3).alias(f"v{a}") for a in "enu"], "n_segments")


@_query(f"WITH {_FLAGGED} SELECT station, segment, count(*) AS n_rows, count(*) FILTER (WHERE is_outlier) AS n_outliers, round(min(t) FILTER (WHERE is_outlier), 6) AS first_outlier FROM f GROUP BY 1, 2")
def iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _series(spark, sf_dir)
    segmented = series.assign_segments(rows, _offsets(rows))
    size = F.count("*").over(Window.partitionBy("station", "segment"))
    flagged = series.flag_iqr(segmented.withColumn("n", size).filter("n >= 3"), ("station", "segment"), k=0.5, large=series.any_larger(rows, ("station",)))
    return flagged.groupBy("station", "segment").agg(F.count("*").alias("n_rows"), F.count_if("is_outlier").alias("n_outliers"), F.round(F.min(F.when(F.col("is_outlier"), F.col("t"))), 6).alias("first_outlier"))


_ORDERS = "o AS (SELECT o_custkey::VARCHAR AS station, o_orderkey, year(o_orderdate) + (dayofyear(o_orderdate) - 1) / 365.25::DOUBLE AS t, o_totalprice / 1000 AS y FROM orders)"


def _order_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").cast("string").alias("station"), "o_orderkey", times.julian_decimal_year(F.col("o_orderdate")).alias("t"), (F.col("o_totalprice") / 1000).alias("y"))


@_query(f"""WITH {_ORDERS}, f AS (SELECT station, count(*) AS n, regr_slope(y, t) AS a, regr_intercept(y, t) AS b FROM o GROUP BY 1),
r AS (SELECT o.*, n, CASE WHEN n > 1 AND isfinite(a) THEN abs(y - (a * t + b)) * 100 ELSE 0 END AS residual FROM o JOIN f USING (station)),
i AS (SELECT station, quantile_cont(residual, 0.75::DOUBLE) - quantile_cont(residual, 0.25::DOUBLE) AS iqr FROM r GROUP BY 1)
SELECT station, count(*) AS n_rows, count(*) FILTER (WHERE n >= 4 AND iqr > 0 AND residual > 1.5 * iqr) AS n_outliers, round(max(residual), 3) AS worst FROM r JOIN i USING (station) GROUP BY 1""")
def review_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Residual rule of the review."""
    flagged = series.flag_residual_iqr(_order_series(spark, sf_dir), cols=("y",), k=1.5)
    return flagged.groupBy("station").agg(F.count("*").alias("n_rows"), F.count_if("is_outlier").alias("n_outliers"), F.round(F.max("residual"), 3).alias("worst"))


@_query(f"WITH {_ORDERS} SELECT station, round(CASE WHEN count(*) >= 2 THEN coalesce(regr_slope(y, t), 0) ELSE 0 END * 1000, 1) AS rate FROM o GROUP BY 1")
def review_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rates of the review in mm a year."""
    return series.review_fit(_order_series(spark, sf_dir), ("y",)).withColumnRenamed("rate_e", "rate")


@_query(f"WITH {_ORDERS} SELECT station, o_orderkey, round(coalesce(stddev_samp(y) OVER (PARTITION BY station ORDER BY t, o_orderkey ROWS BETWEEN 3 PRECEDING AND 3 FOLLOWING), 0), 6) AS y_std FROM o")
def moving_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _order_series(spark, sf_dir).withColumn("place", F.struct("t", "o_orderkey"))
    return series.moving_std(rows, 7, ("y",), t="place").select("station", "o_orderkey", F.round("y_std", 6).alias("y_std"))


@_query(f"WITH {_ORDERS} SELECT station, round(min(t), 6) AS t_start, round(max(t), 6) AS t_end, count(*) AS n FROM o GROUP BY 1")
def series_span(spark: SparkSession, sf_dir: str) -> DataFrame:
    return series.series_span(_order_series(spark, sf_dir)).select("station", F.round("t_start", 6).alias("t_start"), F.round("t_end", 6).alias("t_end"), "n")


@_query(f"WITH {_ORDERS}, f AS (SELECT station, regr_slope(y, t) AS a, regr_intercept(y, t) AS b FROM o WHERE t < 1997 GROUP BY 1) SELECT station, round(avg(y - (a * t + b)), 3) AS d_y, count(*) AS n FROM o JOIN f USING (station) WHERE t >= 1997 GROUP BY 1")
def event_displacement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean offset of the rows from 1997 on against the line of those before."""
    rows = _order_series(spark, sf_dir).withColumn("phase", (F.col("t") >= 1997).cast("int"))
    return series.event_displacement(rows, ("y",)).select("station", F.round("d_y", 3).alias("d_y"), "n")


# --- telemetry ----------------------------------------------------------------------------------------------------


def _velocities(spark: SparkSession, sf_dir: str, kind: str | None = None) -> DataFrame:
    """Events as velocity rows in m/s; arrival order is event_id."""
    rows = _table(spark, sf_dir, "events")
    rows = rows.filter(F.col("event_type") == kind) if kind else rows
    v = F.col("value") / 1000
    return rows.select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").cast("string").alias("station_code"), "event_id", v.alias("v_horizontal"), (v * 0.6).alias("v_east"), (v * 0.8).alias("v_north"), (v * 0.1).alias("v_up"))


def _rollup_sql(width: str) -> str:
    return f"SELECT time_bucket(INTERVAL '{width}', ts) AS bucket, user_id::VARCHAR AS station_code, round(max(value / 1000), 9) AS v_max, round(avg(value / 1000), 9) AS v_avg, round(avg(value / 1000 * 0.6), 9) AS e_avg, count(*) AS sample_count FROM events GROUP BY 1, 2"


def _rollup(spark: SparkSession, sf_dir: str, width: str) -> DataFrame:
    rolled = telemetry.rollup(_velocities(spark, sf_dir), width)
    return rolled.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "station_code", F.round("v_horizontal_max", 9).alias("v_max"), F.round("v_horizontal_avg", 9).alias("v_avg"), F.round("v_east_avg", 9).alias("e_avg"), "sample_count")


@_query(_rollup_sql("1 minute"))
def telemetry_rollup_1min(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "1 minute")


@_query(_rollup_sql("1 hour"))
def telemetry_rollup_1hr(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rollup(spark, sf_dir, "1 hour")


@_query("SELECT time_bucket(INTERVAL '10 seconds', ts) AS bucket, user_id::VARCHAR AS station_code, round(avg(value / 1000), 9) AS mean_v, avg(value / 1000) > 0.3 AS breach FROM events GROUP BY 1, 2")
def alert_breaches(spark: SparkSession, sf_dir: str) -> DataFrame:
    means = telemetry.alert_means(_velocities(spark, sf_dir), limit=0.3)
    return means.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "station_code", F.round("mean_v", 9).alias("mean_v"), "breach")


_EVENTS = """e AS (SELECT user_id::VARCHAR AS station_code, event_id, ts, value, value > 250 AS over, coalesce(lag(value > 250) OVER w, FALSE) AS active FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
r AS (SELECT *, sum((over AND NOT active)::INT) OVER (PARTITION BY station_code ORDER BY event_id) AS run FROM e),
d AS (SELECT station_code, run, min_by(ts, event_id) AS detection_time, max(value) FILTER (WHERE over) AS peak, max(ts) FILTER (WHERE NOT over) AS ended FROM r WHERE over OR active GROUP BY 1, 2)"""


def _detected(spark: SparkSession, sf_dir: str) -> DataFrame:
    return telemetry.detect_events(_velocities(spark, sf_dir), mm_s=250.0, order=("event_id",))


@_query(f"WITH {_EVENTS} SELECT station_code, detection_time, round(peak, 6) AS peak_velocity, round(epoch(ended - detection_time), 3) AS duration_seconds FROM d WHERE ended IS NOT NULL")
def telemetry_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _detected(spark, sf_dir).select("station_code", F.col("detection_time").cast("timestamp_ntz").alias("detection_time"), F.round("peak_velocity_horizontal", 6).alias("peak_velocity"), F.round("duration_seconds", 3).alias("duration_seconds"))


@_query(f"WITH {_EVENTS} SELECT station_code, detection_time, round(peak, 1) AS peak_velocity FROM d WHERE ended IS NOT NULL AND detection_time BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20' ORDER BY detection_time DESC, station_code LIMIT 50")
def latest_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    latest = telemetry.latest_events(_detected(spark, sf_dir), "2024-01-05", "2024-01-20", 50)
    return latest.select("station_code", F.col("detection_time").cast("timestamp_ntz").alias("detection_time"), F.col("peak_velocity_horizontal").alias("peak_velocity"))


@_query("""WITH e AS (SELECT user_id::VARCHAR AS station_code, event_id, event_type, value, last_value(CASE WHEN event_type = 'view' THEN value END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last_view FROM events)
SELECT station_code, event_id, round(value, 6) AS value, round(last_view, 6) AS last_view FROM e WHERE event_type = 'click'""")
def asof_last(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each click with the station's last view before it, in arrival order."""
    rows = _table(spark, sf_dir, "events").withColumn("station_code", F.col("user_id").cast("string"))
    left = rows.filter("event_type = 'click'").select("station_code", "event_id", "value")
    right = rows.filter("event_type = 'view'").select("station_code", "event_id", F.col("value").alias("last_view"))
    return telemetry.asof_last(left, right, ("last_view",), order=("event_id",)).select("station_code", "event_id", F.round("value", 6).alias("value"), F.round("last_view", 6).alias("last_view"))


@_query("""WITH e AS (SELECT user_id::VARCHAR AS station_code, event_id, epoch_us(ts) AS us, value FROM events WHERE event_type = 'view'),
d AS (SELECT *, (us - lag(us) OVER (PARTITION BY station_code ORDER BY event_id)) / 1e6 AS dt FROM e)
SELECT station_code, event_id, round(dt, 3) AS dt, coalesce(dt > 0 AND dt < 86400, FALSE) AS gate, round(sum(CASE WHEN dt > 0 AND dt < 86400 THEN value / 1000 * 0.6 * dt ELSE 0 END) OVER (PARTITION BY station_code ORDER BY event_id), 4) AS integral FROM d""")
def velocity_integral(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gated integration without decay."""
    rows = _velocities(spark, sf_dir, "view").withColumnsRenamed({"v_east": "vE", "v_north": "vN", "v_up": "vU"})
    moved = telemetry.integrate(telemetry.with_dt(rows, 86400.0, ("event_id",)), 1.0, ("event_id",))
    return moved.select("station_code", "event_id", F.round("dt", 3).alias("dt"), "gate", F.round("iE", 4).alias("integral"))


@_query("SELECT user_id AS station, event_type, min(event_id) AS event_id, arg_min(round(value, 6), event_id) AS value FROM events GROUP BY 1, 2")
def first_write_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "events").select(F.col("user_id").alias("station"), "event_type", "event_id", F.round("value", 6).alias("value"))
    return telemetry.first_wins(rows.unionByName(rows), ("station", "event_type"), ("event_id",))


@_query("SELECT event_id, make_timestamp(epoch_us(ts) // 10000 * 10000) AS time, round(value * 0.0006, 6) AS v_east, round(value * 0.0008, 6) AS v_north, user_id % 30 AS n_sats FROM events")
def nmea_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events written as sentences with checksums and parsed again."""
    e = _spread(_table(spark, sf_dir, "events"))
    number = lambda x: F.format_string("%.6f", x)
    zero = F.lit("0.00000")
    body = F.concat_ws(",", F.lit("GNLVM"), F.date_format("ts", "HHmmss.SS"), F.date_format("ts", "MMddyy"), number(F.col("value") * 0.0006), number(F.col("value") * 0.0008), number(F.col("value") * 0.0001), *[zero] * 6, F.lit("0.0100"), (F.col("user_id") % 30).cast("string"))
    made = bound(e, _body=body, sentence=F.concat(F.lit("$"), F.col("_body"), F.lit("*"), text.xor_checksum(F.col("_body"))))
    lines = made.select("event_id", F.lit("f").alias("file_name"), F.col("event_id").alias("line_no"), "sentence")
    good, _ = sentences.parse_lvm(sentences.route_sentences(lines))
    return good.select("event_id", F.col("time").cast("timestamp_ntz").alias("time"), F.round("vE", 6).alias("v_east"), F.round("vN", 6).alias("v_north"), F.col("n_sats").cast("long").alias("n_sats"))


# --- network ------------------------------------------------------------------------------------------------------

_DAYS = "d AS (SELECT DISTINCT o_custkey AS station, year(o_orderdate)::INT AS year, dayofyear(o_orderdate)::INT AS doy FROM orders)"
_RUNS = """i AS (SELECT *, doy - row_number() OVER (PARTITION BY station, year ORDER BY doy) AS run FROM {src}),
u AS (SELECT station, year, min(doy) AS lo, max(doy) AS hi FROM i GROUP BY station, year, run),
c AS (SELECT station, year, string_agg(CASE WHEN lo = hi THEN lo::VARCHAR ELSE lo || '---' || hi END, ', ' ORDER BY lo) AS {name} FROM u GROUP BY 1, 2)"""


def _days(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders")
    return network.distinct_days(rows.select(F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy")))


@_query(f"WITH {_DAYS}, {_RUNS.format(src='d', name='ranges')}, n AS (SELECT station, year, count(*) AS n_days, CASE WHEN year % 4 = 0 THEN 366 ELSE 365 END AS year_days FROM d GROUP BY 1, 2) SELECT station, year, n_days, year_days, round(n_days / year_days, 6) AS share, ranges FROM n JOIN c USING (station, year)")
def coverage_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _days(spark, sf_dir)
    return network.coverage(days).withColumn("share", F.round("share", 6)).join(network.compact_ranges(days, ("station", "year"), "doy"), ["station", "year"])


@_query(f"WITH {_DAYS}, y AS (SELECT DISTINCT station, year FROM d), a AS (SELECT station, year, unnest(range(1, CASE WHEN year % 4 = 0 THEN 367 ELSE 366 END))::INT AS doy FROM y), p AS (SELECT * FROM a ANTI JOIN d USING (station, year, doy)), {_RUNS.format(src='p', name='gaps')} SELECT * FROM c")
def day_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = network.gap_ranges(_days(spark, sf_dir))
    return gaps.filter("size(gaps) > 0").withColumn("gaps", network.range_text(F.col("gaps")))


_HISTORY = "h AS (SELECT o_custkey AS station_code, o_orderkey AS serial_number, o_orderdate::DATE AS date_installed, lead(o_orderdate::DATE) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS date_removed FROM orders)"


def _history(spark: SparkSession, sf_dir: str) -> DataFrame:
    date = F.col("o_orderdate").cast("date")
    nxt = F.lead(date).over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    return _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_code"), F.col("o_orderkey").alias("serial_number"), date.alias("date_installed"), nxt.alias("date_removed"))


@_query(f"WITH {_HISTORY}, p AS (SELECT o_custkey AS station_code, l_orderkey, l_linenumber, l_shipdate::DATE AS date FROM lineitem JOIN orders ON l_orderkey = o_orderkey) SELECT l_orderkey, l_linenumber, h.station_code, serial_number FROM p JOIN h ON p.station_code = h.station_code AND date >= date_installed AND (date_removed IS NULL OR date < date_removed)")
def equipment_at(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equipment in place at each line item's date."""
    items = _table(spark, sf_dir, "lineitem").join(_table(spark, sf_dir, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    probes = items.select(F.col("o_custkey").alias("station_code"), "l_orderkey", "l_linenumber", F.col("l_shipdate").cast("date").alias("date"))
    return network.equipment_at(_history(spark, sf_dir), probes).select("l_orderkey", "l_linenumber", "station_code", "serial_number")


@_query("""WITH r AS (SELECT DISTINCT o_custkey AS station_code, year(o_orderdate)::INT AS year, (dayofyear(o_orderdate) // 10) AS decade FROM orders),
p AS (SELECT c_custkey AS station_code, y::INT AS year, (c_custkey % 365 + 1)::INT AS doy FROM customer, unnest(range(1992, 1999)) AS t(y))
SELECT p.*, r.decade IS NOT NULL AS available FROM p LEFT JOIN r ON p.station_code = r.station_code AND p.year = r.year AND p.doy // 10 = r.decade""")
def day_available(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days inside available ranges of ten days."""
    decade = F.floor(F.dayofyear("o_orderdate") / 10).cast("int")
    ranges = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_code"), F.year("o_orderdate").alias("processing_year"), F.struct((decade * 10).alias("lo"), (decade * 10 + 9).alias("hi")).alias("r"))
    status = ranges.groupBy("station_code", "processing_year").agg(F.collect_set("r").alias("available_days"))
    probes = _table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("station_code"), F.explode(F.sequence(F.lit(1992), F.lit(1998))).alias("year"), (F.col("c_custkey") % 365 + 1).cast("int").alias("doy"))
    return network.day_available(status, probes)


def _found_files(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.sha2(F.encode("text", "UTF-8"), 256).alias("file_hash"))
    log = docs.filter("doc_id % 3 != 0").select("file_hash", F.when(F.col("doc_id") % 3 == 1, "success").otherwise("failed").alias("status"), F.col("doc_id").alias("seq"))
    return docs, log


_LOG = """f AS (SELECT doc_id, sha256(text) AS file_hash FROM documents),
s AS (SELECT file_hash, arg_max(CASE WHEN doc_id % 3 = 1 THEN 'success' ELSE 'failed' END, doc_id) AS status FROM f WHERE doc_id % 3 <> 0 GROUP BY 1)"""


@_query(f"WITH {_LOG} SELECT doc_id, f.file_hash FROM f LEFT JOIN s USING (file_hash) WHERE status IS DISTINCT FROM 'success'")
def pending_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files whose content isn't logged as done."""
    return network.pending_files(*_found_files(spark, sf_dir))


@_query(f"WITH {_LOG} SELECT CASE WHEN status = 'success' THEN 'skipped' ELSE 'queued' END AS outcome, count(*) AS count FROM f LEFT JOIN s USING (file_hash) GROUP BY 1")
def scan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return network.scan_counts(*_found_files(spark, sf_dir))


@_query("""WITH h AS (SELECT c_custkey AS station_code, c_mktsegment AS r, c_nationkey::VARCHAR || ' NONE' AS a FROM customer WHERE c_custkey % 5 <> 0),
s AS (SELECT c_custkey AS station_code, CASE WHEN c_custkey % 7 = 0 THEN 'OTHER' ELSE c_mktsegment END AS r, CASE WHEN c_custkey % 11 = 0 THEN 'X' ELSE c_nationkey::VARCHAR END || ' DOME' AS a FROM customer WHERE c_custkey % 4 <> 0)
SELECT coalesce(h.station_code, s.station_code) AS station_code, CASE WHEN s.station_code IS NULL THEN 'missing in station information' WHEN h.station_code IS NULL THEN 'no header'
  WHEN h.r <> s.r AND split_part(h.a, ' ', 1) <> split_part(s.a, ' ', 1) THEN 'receiver and antenna mismatch' WHEN h.r <> s.r THEN 'receiver mismatch' WHEN split_part(h.a, ' ', 1) <> split_part(s.a, ' ', 1) THEN 'antenna mismatch' ELSE 'ok' END AS finding
FROM h FULL JOIN s ON h.station_code = s.station_code""")
def crosscheck(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer")
    key, nation = F.col("c_custkey"), F.col("c_nationkey").cast("string")
    headers = c.filter(key % 5 != 0).select(key.alias("station_code"), F.col("c_mktsegment").alias("receiver_type"), F.concat(nation, F.lit(" NONE")).alias("antenna_type"))
    sta = c.filter(key % 4 != 0).select(key.alias("station_code"), F.when(key % 7 == 0, "OTHER").otherwise(F.col("c_mktsegment")).alias("receiver_type"), F.concat(F.when(key % 11 == 0, "X").otherwise(nation), F.lit(" DOME")).alias("antenna_type"))
    return network.crosscheck_headers(headers, sta).select("station_code", "finding")


@_query("SELECT s_suppkey AS station_code, s_nationkey::VARCHAR || ' NONE' AS antenna_type FROM supplier WHERE s_nationkey NOT IN (SELECT n_nationkey FROM nation WHERE n_regionkey < 3)")
def uncalibrated(spark: SparkSession, sf_dir: str) -> DataFrame:
    headers = _table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("station_code"), F.concat(F.col("s_nationkey").cast("string"), F.lit(" NONE")).alias("antenna_type"))
    antennas = _table(spark, sf_dir, "nation").filter("n_regionkey < 3").select(F.concat(F.col("n_nationkey").cast("string"), F.lit(" RADOME")).alias("antenna_type"))
    return network.uncalibrated(headers, antennas).select("station_code", "antenna_type")


@_query("SELECT s_suppkey AS station, CASE WHEN s_suppkey % 17 = 0 THEN 'unknown' WHEN abs(s_acctbal) / 1000 <= 3 THEN 'ok' WHEN sqrt(3 * (s_nationkey / 20.0) ** 2) >= 1 THEN 'bad_apriori' ELSE 'bad_obs' END AS triage FROM supplier")
def triage_positions(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    d = F.col("s_nationkey") / 20
    rows = s.select(F.col("s_suppkey").alias("station"), F.when(F.col("s_suppkey") % 17 != 0, F.abs("s_acctbal") / 1000).alias("rms_m"), d.alias("dx"), d.alias("dy"), d.alias("dz"))
    return network.triage_positions(rows).select("station", "triage")


@_query("""WITH l AS (SELECT c.*, CASE WHEN conv_id % 3 = 0 THEN 'campaign' WHEN conv_id % 3 = 1 THEN 'continuous' ELSE role END AS m, conv_id % 4 = 0 AS no_antenna, turn % 2 = 1 AS no_slant FROM conversations c)
SELECT conv_id, turn, (m NOT IN ('campaign', 'continuous'))::INT + CASE WHEN m = 'campaign' THEN no_antenna::INT + no_slant::INT ELSE 0 END AS n_reasons FROM l WHERE m NOT IN ('campaign', 'continuous') OR (m = 'campaign' AND (no_antenna OR no_slant))""")
def logsheet_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rejected field records with the number of rules that they break."""
    c = _table(spark, sf_dir, "conversations")
    kind = F.when(F.col("conv_id") % 3 == 0, "campaign").when(F.col("conv_id") % 3 == 1, "continuous").otherwise(F.col("role"))
    sheets = c.select("conv_id", "turn", kind.alias("monitoring_method"), F.when(F.col("conv_id") % 4 != 0, "TRM41249.00").alias("antenna_model"), F.when(F.col("turn") % 2 == 0, 1.5).alias("slant_n_m"), *[F.lit(1.5).alias(f"slant_{d}_m") for d in "esw"], F.lit(None).cast("double").alias("battery_voltage_v"), F.lit(None).cast("string").alias("battery_voltage_source"), F.lit(None).cast("double").alias("temperature_c"), F.lit(None).cast("string").alias("temperature_source"))
    _, rejects = network.validate_logsheets(sheets)
    return rejects.select("conv_id", "turn", F.size("reasons").alias("n_reasons"))


@_query("SELECT o_custkey AS station_code, arg_max(o_orderkey, o_orderdate::VARCHAR || lpad(o_orderkey::VARCHAR, 12, '0')) AS solution_id, max(o_orderdate) AS date_computed FROM orders GROUP BY 1")
def latest_product(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station_code"), F.col("o_orderkey").alias("solution_id"), F.col("o_orderdate").alias("date_computed"))
    return network.latest_product(rows)


@_query("""WITH days AS (SELECT DISTINCT o_orderdate::DATE + INTERVAL 28 YEAR AS d FROM orders), p AS (SELECT d::DATE AS date, date_diff('day', DATE '1980-01-06', d::DATE) // 7 AS w FROM days)
SELECT date, w::INT AS gps_week, (date_diff('day', DATE '1980-01-06', date) % 7)::INT AS gps_day,
  CASE WHEN w >= 2238 THEN printf('COD0OPSFIN_%04d%03d0000_01D_05M_ORB.SP3.gz', year(date), dayofyear(date)) ELSE printf('cod%d%d.sp3.Z', w, date_diff('day', DATE '1980-01-06', date) % 7) END AS file_name FROM p""")
def product_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Expected product of each day with orders, 28 years on."""
    days = _table(spark, sf_dir, "orders").select(F.add_months(F.col("o_orderdate").cast("date"), 336).alias("date")).distinct()
    d = F.col("date")
    return days.select("date", times.gps_week(d).alias("gps_week"), times.gps_day(d).cast("int").alias("gps_day"), times.product_name("COD", "ORB", d).alias("file_name"))


@_query("SELECT printf('%-4s %.4f %s', c_custkey::VARCHAR, year(d) + (dayofyear(d) - 1) / dayofyear(make_date(year(d), 12, 31))::DOUBLE, 'EQ') AS value FROM (SELECT o_custkey AS c_custkey, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1)")
def offsets_export(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("station_code")).agg(F.min("o_orderdate").cast("date").alias("event_date")).withColumn("event_type", F.lit("EQ"))
    return sinks.offset_lines(first)


# --- archive ------------------------------------------------------------------------------------------------------


def _page_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as catalog rows: the url's path as file path, html as content."""
    path = F.regexp_extract("url", r"://([^?#]*)", 1)
    rows = _table(spark, sf_dir, "pages").select("page_id", path.alias("path"), F.octet_length("html").cast("long").alias("size_bytes"))
    return rows.withColumns(archive_sources.name_columns(F.col("path")))


_PAGES = r"""p AS (SELECT page_id, regexp_extract(url, '://([^?#]*)', 1) AS path, octet_length(encode(html))::BIGINT AS size_bytes FROM pages),
n AS (SELECT *, regexp_extract(path, '([^/]*)$', 1) AS name FROM p),
x AS (SELECT *, lower(regexp_extract(name, '^.+(\.[^.]+)$', 1)) AS extension FROM n),
c AS (SELECT *, CASE WHEN extension = '.html' THEN 'Text' WHEN extension = '.com' THEN 'Executable' END AS category FROM x)"""


@_query(f"WITH {_PAGES} SELECT coalesce(category, 'Unclassified') AS category, count(*) AS files, sum(size_bytes)::BIGINT AS bytes, sum(CASE WHEN size_bytes > 4000 THEN 0 ELSE size_bytes END)::BIGINT AS sane_bytes FROM (SELECT * REPLACE (CASE WHEN size_bytes > 4000 THEN 'Corrupt' ELSE category END AS category) FROM c) GROUP BY 1 UNION ALL SELECT NULL, count(*), sum(size_bytes)::BIGINT, sum(CASE WHEN size_bytes > 4000 THEN 0 ELSE size_bytes END)::BIGINT FROM c")
def survey(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive.flag_corrupt(archive.classify_files(_page_files(spark, sf_dir)), capacity=4000)
    return archive.survey(files)


@_query(f"WITH {_PAGES}, g AS (SELECT coalesce(category, '') AS category, extension, count(*) AS n, row_number() OVER (PARTITION BY coalesce(category, '') ORDER BY count(*) DESC, extension) AS k FROM c GROUP BY 1, 2), t AS (SELECT category, sum(n)::BIGINT AS files FROM g GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3) SELECT category, files, string_agg(extension, ',' ORDER BY k) AS top_extensions FROM t JOIN g USING (category) WHERE k <= 4 GROUP BY 1, 2")
def top_categories(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A top-k report: three categories with their four extensions."""
    files = archive.classify_files(_page_files(spark, sf_dir)).withColumn("category", F.coalesce("category", F.lit("")))
    return archive.top_categories(files, 3, 4)


@_query("SELECT doc_id, sha256(text) AS file_hash, row_number() OVER (PARTITION BY sha256(text) ORDER BY doc_id) > 1 AS duplicate FROM documents")
def content_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", text.content_hash(F.encode("text", "UTF-8")).alias("file_hash"))
    return archive.flag_duplicates(docs, order="doc_id")


@_query("""WITH d AS (SELECT doc_id, 'X/$RECYCLE.BIN/S-' || doc_id % 7 AS bin FROM documents)
SELECT bin || '/$R' || doc_id || '.05o' AS src_path, CASE WHEN doc_id % 5 = 0 THEN '_orphaned/$R' || doc_id || '.05o' ELSE 'D/data/' || doc_id || '.05o' END AS dest_path, CASE WHEN doc_id % 5 = 0 THEN 'orphan' ELSE 'ok' END AS status FROM d""")
def deleted_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deleted files paired with their metadata; each fifth lacks it or would climb out of the destination."""
    docs = _table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("X/$RECYCLE.BIN/S-"), F.col("doc_id") % 7).alias("bin"))
    key = F.concat(F.col("doc_id").cast("string"), F.lit(".05o"))
    catalog = docs.select(F.concat("bin", F.lit("/$R"), key).alias("path"), F.lit("GNSS Data").alias("category"), F.lit(1).cast("long").alias("size_bytes"))
    where = F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("D:\\..\\"), key)).otherwise(F.concat(F.lit("D:\\data\\"), key))
    meta = docs.filter("doc_id % 10 != 0").select(F.concat("bin", F.lit("/$I"), key).alias("meta_path"), where.alias("original_path"), F.lit(None).cast("timestamp").alias("deleted_at"), F.lit(None).cast("string").alias("error"))
    return archive.pair_deleted(catalog, meta).select("src_path", "dest_path", "status")


# --- coordinates and faults ---------------------------------------------------------------------------------------

_RAD = "radians({0})"


def _ecef_sql(lat: str, lon: str, h: str) -> tuple[str, str, str]:
    n = f"(6378137.0::DOUBLE / sqrt(1 - {geodesy.E2!r}::DOUBLE * sin(radians({lat})) * sin(radians({lat}))))"
    return f"(({n} + {h}) * cos(radians({lat})) * cos(radians({lon})))", f"(({n} + {h}) * cos(radians({lat})) * sin(radians({lon})))", f"(({n} * (1 - {geodesy.E2!r}::DOUBLE) + {h}) * sin(radians({lat})))"


def _enu_sql() -> str:
    x, y, z = _ecef_sql("lat", "lon", "h")
    x0, y0, z0 = _ecef_sql("14.5::DOUBLE", "121.0::DOUBLE", "50.0::DOUBLE")
    p, q = "radians(14.5::DOUBLE)", "radians(121.0::DOUBLE)"
    return f"""WITH c AS (SELECT c_custkey AS station, 14 + (c_custkey % 97) / 97.0::DOUBLE AS lat, 120 + (c_custkey % 89) / 89.0::DOUBLE AS lon, c_acctbal / 100 AS h FROM customer),
d AS (SELECT station, {x} - {x0} AS dx, {y} - {y0} AS dy, {z} - {z0} AS dz FROM c)
SELECT station, round(cos({q}) * dy - sin({q}) * dx, 4) AS east, round(cos({p}) * dz - sin({p}) * (cos({q}) * dx + sin({q}) * dy), 4) AS north, round(cos({p}) * (cos({q}) * dx + sin({q}) * dy) + sin({p}) * dz, 4) AS up FROM d"""


@_query(_enu_sql())
def enu_transform(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Geodetic positions -> local frame."""
    c = _table(spark, sf_dir, "customer")
    lat, lon, h = 14 + (F.col("c_custkey") % 97) / 97, 120 + (F.col("c_custkey") % 89) / 89, F.col("c_acctbal") / 100
    e, n, u = geodesy.geodetic_to_enu(lat, lon, h, F.lit(14.5), F.lit(121.0), F.lit(50.0))
    return c.select(F.col("c_custkey").alias("station"), F.round(e, 4).alias("east"), F.round(n, 4).alias("north"), F.round(u, 4).alias("up"))


@_query("SELECT c_custkey AS station, round(14 + (c_custkey % 97) / 97.0::DOUBLE, 8) AS lat, round(120 + (c_custkey % 89) / 89.0::DOUBLE, 8) AS lon, round(c_acctbal / 100, 4) AS h FROM customer")
def geodetic_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = _table(spark, sf_dir, "customer").select("c_custkey", *[x.alias(n) for n, x in zip("xyz", geodesy.geodetic_to_ecef(14 + (F.col("c_custkey") % 97) / 97, 120 + (F.col("c_custkey") % 89) / 89, F.col("c_acctbal") / 100))])
    lat, lon, h = geodesy.ecef_to_geodetic(F.col("x"), F.col("y"), F.col("z"))
    return c.select(F.col("c_custkey").alias("station"), F.round(lat, 8).alias("lat"), F.round(lon, 8).alias("lon"), F.round(h, 4).alias("h"))


_PROFILE = """p AS (SELECT s_suppkey AS sites, (s_suppkey % 50) * 1000.0::DOUBLE - 20000 AS e, s_nationkey * 500.0::DOUBLE - 5000 AS n, abs(s_acctbal) / 200 AS v, (s_suppkey * 7 % 360)::DOUBLE AS a FROM supplier),
q AS (SELECT sites, (e * sin(radians(60)) + n * cos(radians(60))) / 1000 AS dist, (n * sin(radians(60)) - e * cos(radians(60))) / 1000 AS off, -v * sin(radians(a - 60)) AS v_across, abs(sqrt(1.25::DOUBLE) * sin(radians(a - 60))) + 0.1 AS err FROM p)"""


def _profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _table(spark, sf_dir, "supplier")
    rows = s.select(F.col("s_suppkey").alias("sites"), ((F.col("s_suppkey") % 50) * 1000.0 - 20000).alias("Ecoord"), (F.col("s_nationkey") * 500.0 - 5000).alias("Ncoord"), (F.abs("s_acctbal") / 200).alias("velocity"), (F.col("s_suppkey") * 7 % 360).cast("double").alias("azimuth"), F.lit(1.0).alias("erreast"), F.lit(0.5).alias("errnorth"))
    return faults.project_profile(rows, 60.0, (0.0, 0.0), 15.0).withColumn("err", F.col("err_across") + 0.1)


@_query(f"WITH {_PROFILE} SELECT sites, round(dist, 6) AS dist, round(v_across, 6) + 0.0 AS v_across, k AS rank FROM (SELECT *, row_number() OVER (ORDER BY round(dist, 9), sites) AS k FROM q WHERE abs(off) <= 15) WHERE k > 1")
def profile_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _profile(spark, sf_dir).withColumn("dist_km", F.round("dist_km", 9))
    return faults.order_profile(rows).select("sites", F.round("dist_km", 6).alias("dist"), (F.round("v_across", 6) + 0.0).alias("v_across"), "rank")


_GRID = f"""{_PROFILE}, g AS (SELECT p_partkey AS grid_id, 5.0::DOUBLE + p_size AS lock, (p_partkey % 11 + 25)::DOUBLE AS rate FROM part),
x AS (SELECT grid_id, lock, rate, atan(dist / lock) / pi() AS gr, v_across - CASE WHEN dist >= 0 THEN rate ELSE 0 END AS d, err FROM g, (SELECT * FROM q WHERE abs(off) <= 15)),
s AS (SELECT grid_id, lock, rate, count(*) AS n, sum(gr * gr / (err * err)) AS gg, sum(gr * d / (err * err)) AS gd, sum(d * d / (err * err)) AS dd, sum(1 / (err * err)) AS ww FROM x GROUP BY 1, 2, 3),
r AS (SELECT grid_id, rate, gd / gg AS slip, greatest(dd - gd * gd / gg, 0) AS chi2, n, ww FROM s)"""


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A screw dislocation locked to a depth under the profile, for each part as a grid point."""
    grid = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grid_id"), (5.0 + F.col("p_size")).alias("lock"), (F.col("p_partkey") % 11 + 25).cast("double").alias("rate"))
    green = lambda rows: rows.withColumn("green_n", F.atan(F.col("dist_km") / F.col("lock")) / F.pi())
    return faults.score_models(_profile(spark, sf_dir), grid, ["grid_id", "lock", "rate"], ["lock"], green)


@_query(f"WITH {_GRID} SELECT grid_id, rate, round(slip, 5) AS slip, round(chi2 / n, 4) AS rchi2, round(sqrt(chi2 / ww), 5) AS wrms FROM r")
def grid_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _scored(spark, sf_dir).select("grid_id", "rate", F.round("slip", 5).alias("slip"), F.round("rchi2", 4).alias("rchi2"), F.round("wrms", 5).alias("wrms"))


@_query(f"WITH {_GRID}, w AS (SELECT grid_id, rate, round(slip, 5) AS slip, round(chi2 / n, 4) AS rchi2, round(sqrt(chi2 / ww), 5) AS wrms FROM r), k AS (SELECT * FROM w WHERE slip <= rate) SELECT 'wrms' AS rule, grid_id, slip FROM k WHERE wrms = (SELECT min(wrms) FROM k) UNION ALL (SELECT 'rchi', grid_id, slip FROM k ORDER BY abs(rchi2 - 1), grid_id LIMIT 1)")
def best_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best models by either rule, on rounded scores so that ties are ties."""
    scored = grid_score(spark, sf_dir)
    return faults.best_by_wrms(scored).select(F.lit("wrms").alias("rule"), "grid_id", "slip").unionByName(faults.best_by_rchi(scored).select(F.lit("rchi").alias("rule"), "grid_id", "slip"))


@_query("""WITH b AS (SELECT row_number() OVER (ORDER BY s_suppkey) - 1 AS k, s_acctbal FROM supplier), n AS (SELECT count(*) AS n FROM supplier),
d AS (SELECT i // 50 AS draw, concat('0x', substr(md5(concat('1:', i // 50, ':', i % 50)), 1, 8))::BIGINT % n AS k FROM range(10000) AS t(i), n),
m AS (SELECT draw, avg(s_acctbal) AS mean_bal, max(s_acctbal) AS max_bal FROM d JOIN b USING (k) GROUP BY 1)
SELECT 'mean_bal' AS parameter, round(quantile_cont(mean_bal, 0.16::DOUBLE), 4) AS low, round(quantile_cont(mean_bal, 0.84::DOUBLE), 4) AS high FROM m UNION ALL SELECT 'max_bal', round(quantile_cont(max_bal, 0.16::DOUBLE), 4), round(quantile_cont(max_bal, 0.84::DOUBLE), 4) FROM m""")
def bootstrap_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """200 draws of 50 rows with replacement, and their 68 % bounds."""
    draws = faults.bootstrap(_table(spark, sf_dir, "supplier"), 200, 50, 1, "s_suppkey")
    means = draws.groupBy("draw").agg(F.avg("s_acctbal").alias("mean_bal"), F.max("s_acctbal").alias("max_bal"))
    return faults.confidence_bounds(means, ["mean_bal", "max_bal"]).select("parameter", F.round("low", 4).alias("low"), F.round("high", 4).alias("high"))


@_query("""WITH e AS (SELECT min(p_retailprice) AS lo, max(p_retailprice) AS hi FROM part)
SELECT least(floor((p_retailprice - lo) / ((hi - lo) / 10)), 9)::INT AS bin, count(*) AS n FROM part, e GROUP BY 1""")
def price_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return faults.histogram(_table(spark, sf_dir, "part"), "p_retailprice", 10).select("bin", "n")


@_query("SELECT round(3e23 * sum(l_quantity * l_extendedprice * l_discount) / 1000 / 1e30, 4) AS m0, round(2.0::DOUBLE / 3 * log10(3e23 * sum(l_quantity * l_extendedprice * l_discount) / 1000) - 10.7, 6) AS mw FROM lineitem")
def seismic_moment(spark: SparkSession, sf_dir: str) -> DataFrame:
    patches = _table(spark, sf_dir, "lineitem").select(F.col("l_quantity").alias("length"), F.col("l_extendedprice").alias("width"), F.col("l_discount").alias("slip"))
    return faults.moment(patches).select(F.round(F.col("m0") / 1e30, 4).alias("m0"), F.round("mw", 6).alias("mw"))


_OKADA = """
c AS (SELECT *, unnest([1, -1, -1, 1]) AS sign, unnest([500.0::DOUBLE, 500, -500, -500]) AS xi, unnest([p, p - width, p, p - width]) AS eta FROM (SELECT *, -dist * cd + depth * sd AS p, -dist * sd - depth * cd AS q0 FROM m)),
i AS (SELECT *, -dist * sd - depth * cd AS q, sqrt(xi * xi + eta * eta + q0 * q0) AS rr, sqrt(xi * xi + q0 * q0) AS big, eta * sd - q0 * cd AS dd FROM c),
j AS (SELECT *, 2 * 0.5::DOUBLE / cd * atan((eta * (big + q * cd) + big * (rr + big) * sd) / (xi * (rr + big) * cd)) AS i5 FROM i),
k AS (SELECT *, -0.5::DOUBLE * xi / (cd * (rr + dd)) - sd / cd * i5 AS i1 FROM j)"""


def _okada_sql(source: str, keys: str) -> str:
    """CTEs up to u (keys, green): motion along strike by unit strike slip of the rectangles of source (keys, dist, width, depth, dip in degrees, not upright), 1000 km long, strike 0; eqs. 25-30 of Okada (1985)."""
    return f"""m AS (SELECT *, sin(radians(dip)) AS sd, cos(radians(dip)) AS cd FROM {source}),{_OKADA},
u AS (SELECT {keys}, CASE WHEN bool_or(depth - sd * width < -1e-12) THEN 0 ELSE sum(sign * -(xi * q / (rr * (rr + eta)) + CASE WHEN q = 0 THEN 0 ELSE atan(xi * eta / (q * rr)) END + i1 * sd)) / (2 * pi()) END AS green FROM k GROUP BY ALL)"""


@_query(f"""WITH {_PROFILE}, h AS (SELECT sites, dist, v_across, err FROM q WHERE abs(off) <= 15), n0 AS (
SELECT p_partkey AS grid_id, p_size / 10.0::DOUBLE + 1 AS depth, (p_partkey % 11 + 10)::DOUBLE AS width, (p_partkey % 10 - 100)::DOUBLE AS dip, (p_partkey % 11 + 25)::DOUBLE AS rate, h.* FROM part, h),
{_okada_sql("n0", "grid_id, depth, width, dip, rate, sites, dist, v_across, err")},
x AS (SELECT *, v_across - CASE WHEN dist >= 0 THEN rate ELSE 0 END AS d, 1 / (err * err) AS w FROM u),
s AS (SELECT grid_id, depth, width, dip, rate, coalesce(sum(w * green * d) / nullif(sum(w * green * green), 0), 0) AS slip, count(*) AS n, sum(w) AS ww, sum(w * green * d) AS gd, sum(w * d * d) AS dd FROM x GROUP BY 1, 2, 3, 4, 5)
SELECT grid_id, depth, width, dip, rate, round(slip, 4) AS slip, round((dd - slip * gd) / n, 4) AS rchi2, round(sqrt((dd - slip * gd) / ww), 5) AS wrms FROM s""")
def dislocation_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rectangular dislocations for each part under each station of the profile."""
    grid = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grid_id"), (F.col("p_size") / 10 + 1).alias("depth"), (F.col("p_partkey") % 11 + 10).cast("double").alias("width"), (F.col("p_partkey") % 10 - 100).cast("double").alias("dip"), (F.col("p_partkey") % 11 + 25).cast("double").alias("rate"))
    green = lambda rows: faults.with_green(rows, {"length": 1000.0, "width": "width", "depth": "depth", "dip": "dip", "strike": 0.0, "east": 0.0, "north": 0.0, "x": "dist_km", "y": 0.0})
    scored = faults.score_models(_profile(spark, sf_dir), grid, ["grid_id", "depth", "width", "dip", "rate"], ["depth", "width", "dip"], green)
    return scored.select("grid_id", "depth", "width", "dip", "rate", F.round("slip", 4).alias("slip"), F.round("rchi2", 4).alias("rchi2"), F.round("wrms", 5).alias("wrms"))


_RATES = (25.0, 30.0, 35.0)


@_query(f"""WITH {_PROFILE}, h AS (SELECT s_nationkey AS sites, round(5 * avg(dist), 6) AS dist, round(avg(v_across) / 5 + CASE WHEN avg(dist) >= 0 THEN 30 ELSE 0 END, 6) AS v_across, round(avg(err), 6) AS err FROM q JOIN supplier ON sites = s_suppkey WHERE abs(off) <= 15 GROUP BY 1),
o AS (SELECT *, row_number() OVER (ORDER BY sites) - 1 AS k, count(*) OVER () AS n FROM h),
z AS (SELECT range // (SELECT count(*) FROM h) AS draw, concat('0x', substr(md5(concat('7:', range // (SELECT count(*) FROM h), ':', range % (SELECT count(*) FROM h))), 1, 8))::BIGINT % (SELECT count(*) FROM h) AS k FROM range(100 * (SELECT count(*) FROM h))),
b AS (SELECT draw, sites, count(*) AS times FROM z JOIN o USING (k) GROUP BY 1, 2 UNION ALL SELECT range, -1, 1 FROM range(100)),
a AS (SELECT sites, dist, v_across, err FROM h UNION ALL SELECT -1, -0.001::DOUBLE, 0::DOUBLE, 0.1::DOUBLE),
n0 AS (SELECT p_partkey AS grid_id, p_size / 10.0::DOUBLE + 1 + (p_partkey % 10007) / 100000.0::DOUBLE AS depth, (p_partkey % 11 + 10)::DOUBLE AS width, (p_partkey % 10 - 100)::DOUBLE AS dip, a.* FROM part, a),
{_okada_sql("n0", "grid_id, depth, width, dip, sites, dist, v_across, err")},
g AS (SELECT draw, rate, sum(times / (err * err)) AS ww, sum(times * (v_across - CASE WHEN dist >= 0 THEN rate ELSE 0 END) ** 2 / (err * err)) AS dd FROM b JOIN a USING (sites), (SELECT unnest([25.0::DOUBLE, 30, 35]) AS rate) GROUP BY 1, 2),
f AS (SELECT draw, grid_id, sum(times * green * green / (err * err)) AS gg, sum(times * green * v_across / (err * err)) AS gv, sum(CASE WHEN dist >= 0 THEN times * green / (err * err) ELSE 0 END) AS gf FROM u JOIN b USING (sites) GROUP BY 1, 2),
s AS (SELECT draw, grid_id, rate, coalesce((gv - rate * gf) / nullif(gg, 0), 0) AS slip, dd - coalesce((gv - rate * gf) ** 2 / nullif(gg, 0), 0) AS chi2, ww FROM f JOIN g USING (draw))
SELECT draw::INT AS draw, grid_id, rate, round(slip, 4) AS slip, round(sqrt(chi2 / ww), 5) AS wrms FROM s WHERE slip <= rate QUALIFY chi2 = min(chi2) OVER (PARTITION BY draw)""")
def bootstrap_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best model of 100 draws of the nations' mean velocities on two blocks, each with a reference station, among all parts as grid points and three block rates."""
    rows = _profile(spark, sf_dir).join(_table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("sites"), "s_nationkey"), "sites")
    side = F.when(F.avg("dist_km") >= 0, 30.0).otherwise(0.0)
    profile = rows.groupBy(F.col("s_nationkey").alias("sites")).agg(F.round(5 * F.avg("dist_km"), 6).alias("dist_km"), F.round(F.avg("v_across") / 5 + side, 6).alias("v_across"), F.round(F.avg("err"), 6).alias("err"))
    ref = spark.createDataFrame([(-1, -0.001, 0.0, 0.1)], "sites int, dist_km double, v_across double, err double")
    grid = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("grid_id"), (F.col("p_size") / 10 + 1 + F.col("p_partkey") % 10007 / 100000).alias("depth"), (F.col("p_partkey") % 11 + 10).alias("width"), (F.col("p_partkey") % 10 - 100).alias("dip"))
    best = draws.best_by_draw(grid, draws.weights(profile, ref, 100, None, 7), draws.strike_slip(turn=0.0), ("depth", "width", "dip"), _RATES)
    return best.select("draw", "grid_id", "rate", F.round("slip", 4).alias("slip"), F.round("wrms", 5).alias("wrms"))
