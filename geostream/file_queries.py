"""Readers and sinks as queries: the driver's tables are written in the formats of the workloads, and read again.

Files go to the shared folder and are deleted when the application ends. See queries.py for the conventions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream import schemas
from geostream.functions.geodesy import E2
from geostream.operators import archive, network, series, telemetry
from geostream.queries import _ORDERS, _order_series, _page_files, _PAGES, _query, _table
from geostream.sources import archive as archive_sources
from geostream.sources import coordinates, reports, sinks
from geostream.sources import telemetry as sentences
from geostream.sources.shared import scratch_path

_written: dict[tuple[str, str, str], str] = {}


def _once(spark: SparkSession, sf_dir: str, label: str, write) -> str:
    """The folder that write(folder) has filled, once for each application and data folder."""
    key = (spark.sparkContext.applicationId, sf_dir, label)
    if key not in _written:
        path = scratch_path(spark, label) + "/files"
        write(path)
        _written[key] = path
    return _written[key]


def _code(number: Column) -> Column:
    """A station code of four characters."""
    return F.lpad(F.hex(number), 4, "0")


def _text(df: DataFrame, path: str, by: str | None = None) -> None:
    """Column value as lines; by: a folder for each value of that column."""
    df.write.text(path) if by is None else sinks.write_folders(df, path, by)


# --- coordinates --------------------------------------------------------------------------------------------------

_EPOCHS = """e AS (SELECT printf('%04X', l_suppkey) AS station, year(l_shipdate) AS y, sum(l_quantity) AS q, sum(l_linenumber) AS k FROM lineitem WHERE NOT (l_suppkey = 1 AND year(l_shipdate) = 1996) GROUP BY 1, 2),
c AS (SELECT station, y, round(-3322225.5::DOUBLE + q / 1000, 4) AS x, round(5225842.25::DOUBLE + k / 1000, 4) AS yy, 1522954.5::DOUBLE AS z FROM e)"""


def _crd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily coordinates: a file for each year with a row for each supplier, every second with a DOMES number."""

    def write(path: str) -> None:
        rows = _table(spark, sf_dir, "lineitem").filter(~((F.col("l_suppkey") == 1) & (F.year("l_shipdate") == 1996)))
        rows = rows.groupBy(_code(F.col("l_suppkey")).alias("station"), F.col("l_suppkey").alias("n"), F.year("l_shipdate").alias("y")).agg(F.sum("l_quantity").alias("q"), F.sum("l_linenumber").alias("k"))
        domes = F.when(F.col("n") % 2 == 0, "12345E001").otherwise("")
        line = F.format_string(" %3d  %s %s   %.4f %.4f %.4f  A", "n", F.lower("station"), domes, -3322225.5 + F.col("q") / 1000, 5225842.25 + F.col("k") / 1000, F.lit(1522954.5))
        _text(rows.select(line.alias("value"), F.format_string("FIN_%02d001", F.col("y") % 100).alias("session")), path, "session")

    rows = coordinates.read_crd(spark, _once(spark, sf_dir, "crd", write))
    return rows.withColumn("file_name", F.regexp_extract("file_path", "/session=([^/]+)/", 1))


def _enu(x0: str, y0: str, z0: str, lat: str, lon: str) -> str:
    """East, north and up of (x, yy, z) about an origin, in SQL."""
    dx, dy, dz = f"(x - {x0})", f"(yy - {y0})", f"(z - {z0})"
    inward = f"(cos({lon}) * {dx} + sin({lon}) * {dy})"
    return f"round(cos({lon}) * {dy} - sin({lon}) * {dx}, 3) + 0.0 AS east, round(cos({lat}) * {dz} - sin({lat}) * {inward}, 3) + 0.0 AS north, round(cos({lat}) * {inward} + sin({lat}) * {dz}, 3) + 0.0 AS up"


def _latitude(x: str, y: str, z: str) -> str:
    """Geodetic latitude by iteration of the definition: tan(lat) = (z + e2 N sin(lat)) / r, six times."""
    r = f"sqrt({x} * {x} + {y} * {y})"
    lat = f"atan2({z}, {r} * (1 - {E2!r}::DOUBLE))"
    for _ in range(3):
        lat = f"atan2({z} + {E2!r}::DOUBLE * 6378137.0::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * sin({lat}) * sin({lat})) * sin({lat}), {r})"
    return lat


_LAT0, _LON0 = "radians(14.5::DOUBLE)", "radians(122.0::DOUBLE)"
_N0 = f"(6378137.0::DOUBLE / sqrt(1 - {E2!r}::DOUBLE * sin({_LAT0}) * sin({_LAT0})))"


@_query(f"""WITH {_EPOCHS}, r AS (SELECT y AS ry, x AS rx, yy AS r2, z AS rz FROM c WHERE station = '0001'), f AS (SELECT * FROM r ORDER BY ry % 100 LIMIT 1),
l AS (SELECT *, {_latitude('rx', 'r2', 'rz')} AS la, atan2(r2, rx) AS lo FROM f), p AS (SELECT *, {_latitude('rx', 'r2', 'rz')} AS la, atan2(r2, rx) AS lo FROM r)
SELECT 'fixed_first' AS origin, station, y::DOUBLE AS decimal_year, {_enu('rx', 'r2', 'rz', 'la', 'lo')} FROM c, l WHERE station <> '0001'
UNION ALL SELECT 'per_session', station, y::DOUBLE, {_enu('rx', 'r2', 'rz', 'la', 'lo')} FROM c JOIN p ON y = ry WHERE station <> '0001'
UNION ALL SELECT 'lla', station, y::DOUBLE, {_enu(f'({_N0} * cos({_LAT0}) * cos({_LON0}))', f'({_N0} * cos({_LAT0}) * sin({_LON0}))', f'({_N0} * (1 - {E2!r}::DOUBLE) * sin({_LAT0}))', _LAT0, _LON0)} FROM c""")
def local_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coordinates about the reference's first position, its position in the session, and a given point."""
    rows, parts = _crd(spark, sf_dir), []
    for origin, args in (("fixed_first", {"ref": "0001"}), ("per_session", {"ref": "0001", "origin": "per_session"}), ("lla", {"lla": (14.5, 122.0, 0.0)})):
        own = series.to_local(rows, **args)
        parts.append(own.select(F.lit(origin).alias("origin"), "station", "decimal_year", *[(F.round(f"{n}_m", 3) + 0.0).alias(n) for n in ("east", "north", "up")]))
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@_query("SELECT printf('%04X', l_suppkey) AS station, l_orderkey, l_shipdate + to_seconds(l_linenumber * 30) AS time, l_quantity AS x, l_linenumber::DOUBLE AS z FROM lineitem")
def kin_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinematic coordinates: a file for each supplier, with five lines before the rows."""

    def write(path: str) -> None:
        week, day = F.floor(F.datediff("l_shipdate", F.lit("1980-01-06")) / 7), F.pmod(F.datediff("l_shipdate", F.lit("1980-01-06")), F.lit(7))
        line = F.format_string(" %s %s  %d  %.1f   %.4f   %.4f   %.4f K", _code(F.col("l_suppkey")), F.lit("ABCD"), week, (day * 86400 + F.col("l_linenumber") * 30).cast("double"), F.col("l_quantity"), F.col("l_orderkey").cast("double"), F.col("l_linenumber").cast("double"))
        rows = _table(spark, sf_dir, "lineitem").groupBy(F.col("l_suppkey").alias("s")).agg(F.array_join(F.collect_list(line), "\n").alias("body"))
        _text(rows.select(F.concat(F.lit("a\nb\nc\nd\ne\n"), "body").alias("value"), "s"), path, "s")

    rows = coordinates.read_kin(spark, _once(spark, sf_dir, "kin", write))
    return rows.select("station", F.col("y").cast("long").alias("l_orderkey"), F.col("time").cast("timestamp_ntz").alias("time"), "x", "z")


@_query("SELECT printf('%04X', l_suppkey) AS station, round(year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25::DOUBLE, 6) AS t, l_quantity AS east, l_tax AS north, l_discount AS up FROM lineitem")
def series_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Series written as a folder for each site, and read again."""
    folder = _once(spark, sf_dir, "series", lambda path: sinks.write_series(_site_series(spark, sf_dir), path))
    return coordinates.read_series(spark, f"{folder}/series").select("station", F.round("t", 6).alias("t"), F.col("east_m").alias("east"), F.col("north_m").alias("north"), F.col("up_m").alias("up"))


def _site_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = F.year("l_shipdate") + (F.dayofyear("l_shipdate") - 1) / 365.25
    return _table(spark, sf_dir, "lineitem").select(_code(F.col("l_suppkey")).alias("station"), t.alias("t"), F.col("l_quantity").alias("east_m"), F.col("l_tax").alias("north_m"), F.col("l_discount").alias("up_m"))


@_query("SELECT DISTINCT printf('%04X', l_suppkey) AS site FROM lineitem")
def site_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = _once(spark, sf_dir, "series", lambda path: sinks.write_series(_site_series(spark, sf_dir), path))
    return coordinates.read_sites(spark, f"{folder}/sites")


@_query("SELECT printf('%04X', l_suppkey) AS station, count(*) AS n FROM lineitem WHERE round(year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25::DOUBLE, 4) NOT IN (SELECT round(year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25::DOUBLE, 4) FROM lineitem l2 WHERE l2.l_suppkey = lineitem.l_suppkey AND l2.l_quantity = 50) GROUP BY 1")
def cleaned_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows left of each site after the epochs of its largest values are taken out, as read from the cleaned files."""
    rows, path = _site_series(spark, sf_dir), scratch_path(spark, "cleaned") + "/files"
    sinks.write_cleaned_series(rows, rows.filter("east_m = 50"), path)
    return coordinates.read_series(spark, f"{path}/series").groupBy("station").agg(F.count("*").alias("n"))


@_query("SELECT DISTINCT printf('%-4s %.4f', printf('%04X', l_suppkey), year(l_shipdate) + (dayofyear(l_shipdate) - 1) / 365.25::DOUBLE) AS line FROM lineitem WHERE l_quantity = 50")
def outlier_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch_path(spark, "outliers") + "/files"
    sinks.write_outliers(_site_series(spark, sf_dir).filter("east_m = 50"), path)
    return spark.read.text(path).select(F.col("value").alias("line")).distinct()


@_query("SELECT o_custkey::VARCHAR AS station, round(year(d) + (dayofyear(d) - 1) / dayofyear(make_date(year(d), 12, 31))::DOUBLE, 4) AS date, CASE WHEN o_custkey % 3 = 0 THEN 'EQ' ELSE 'UK' END AS type FROM (SELECT o_custkey, min(o_orderdate)::DATE AS d FROM orders GROUP BY 1)")
def offsets_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Offset events exported as lines and read again; an unknown type becomes UK."""
    first = _table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.min("o_orderdate").cast("date").alias("event_date"))
    first = first.select(F.col("o_custkey").cast("string").alias("station_code"), "event_date", F.when(F.col("o_custkey") % 3 == 0, "eq").otherwise("zz").alias("event_type"))
    return coordinates.read_offsets(spark, _once(spark, sf_dir, "offsets", lambda path: sinks.export_offsets(first, path)))


@_query("SELECT c_custkey AS site, round(c_acctbal, 2) AS ve, c_nationkey::DOUBLE AS vn, 'kept' AS kind FROM customer WHERE c_custkey % 7 <> 0")
def velocity_field(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A velocity field as text; every seventh line is malformed and goes."""

    def write(path: str) -> None:
        c = _table(spark, sf_dir, "customer")
        good = F.format_string("%.4f %.4f %.2f %d 0.1 0.2 0.0 %d", 120 + F.col("c_nationkey") / 100, F.lit(14.5), "c_acctbal", "c_nationkey", "c_custkey")
        _text(c.select(F.when(F.col("c_custkey") % 7 != 0, good).otherwise("x y").alias("value")), path)

    rows = coordinates.read_velocity_field(spark, _once(spark, sf_dir, "field", write))
    return rows.select(F.col("site").cast("long").alias("site"), "ve", "vn", F.lit("kept").alias("kind"))


@_query("""WITH p AS (SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_suppkey, l_partkey) AS seq FROM lineitem),
s AS (SELECT l_orderkey, count(*) AS n FROM p GROUP BY 1) SELECT count(*) AS segments, sum(n)::BIGINT AS points, max(n) AS longest, (SELECT count(*) FROM lineitem WHERE l_linenumber < 4) AS inside FROM s""")
def polylines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A polyline for each order with a point for each of its lines: how many, and how many points a box keeps."""

    def write(path: str) -> None:
        point = F.format_string("%.4f %.4f", F.col("l_linenumber") / 10, F.lit(0.5))
        rows = _table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_join(F.collect_list(point), "\n").alias("points"))
        _text(rows.select(F.concat(F.format_string("> %d\n", "l_orderkey"), "points").alias("value")), path)

    rows = coordinates.read_polylines(spark, _once(spark, sf_dir, "lines", write))
    by = rows.groupBy("file_path", "segment_id").agg(F.max("seq").alias("n"), F.count_if((F.col("lon") > 0) & (F.col("lon") < 0.35)).alias("inside"))
    return by.agg(F.count("*").alias("segments"), F.sum("n").alias("points"), F.max("n").cast("long").alias("longest"), F.sum("inside").alias("inside"))


@_query("SELECT s_suppkey AS row, s_suppkey % 7 + 1.5::DOUBLE AS length, s_suppkey % 5 + 2.5::DOUBLE AS width, (s_suppkey % 90)::DOUBLE AS dip, s_suppkey + 0.5::DOUBLE AS x1, s_suppkey + 0.25::DOUBLE AS z4, round(s_acctbal, 2) AS slip FROM supplier")
def fault_patches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fault patches from five tables that belong together by line."""

    def write(path: str) -> None:
        s, n = _table(spark, sf_dir, "supplier").orderBy("s_suppkey").coalesce(1), F.col("s_suppkey")
        lines = {"geometry": F.format_string("%.1f %.1f 10 %d 45", n % 7 + 1.5, n % 5 + 2.5, n % 90), "slips": F.format_string("1 2 %.2f", "s_acctbal")}
        for axis, shift in (("x", 0.0), ("y", 0.5), ("z", 0.25)):
            lines[axis] = F.format_string("%.2f %.2f %.2f %.2f", *[n + (0.5 - shift * i) for i in (0, 1, 2, 1)])
        for name, line in lines.items():
            s.select(line.alias("value")).write.text(f"{path}/{name}")

    folder = _once(spark, sf_dir, "patches", write)
    rows = coordinates.read_patches(spark, *[f"{folder}/{name}/part-*" for name in ("geometry", "x", "y", "z", "slips")])
    return rows.select((F.col("row") - 1).cast("long").alias("row"), "length", "width", "dip", "x1", "z4", "slip")


@_query("SELECT s_name || ',' AS sites, s_nationkey::DOUBLE AS Ecoord, round(s_acctbal, 2) AS velocity FROM supplier")
def profile_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Profile velocities as CSV with quoted names; the first data row of each file is skipped."""

    def write(path: str) -> None:
        s = _table(spark, sf_dir, "supplier").coalesce(1)
        name = F.concat(F.lit('"'), "s_name", F.lit(',"'))
        row = F.concat_ws(",", name, F.format_string("%d.0,2,3,%.2f,5,6,7,8,9", "s_nationkey", "s_acctbal"))
        head = s.limit(1).select(F.lit("sites,Ecoord,Ncoord,height,velocity,azimuth,Vu,hgt,erreast,errnorth\nskipped,0,0,0,0,0,0,0,0,0").alias("value"))
        _text(head.unionByName(s.select(row.alias("value"))).coalesce(1), path)

    return coordinates.read_profile(spark, _once(spark, sf_dir, "profile", write)).select("sites", "Ecoord", "velocity")


@_query("SELECT p_size::DOUBLE AS East, round(p_retailprice, 2) AS Residual, (p_partkey % 11)::DOUBLE AS Rate, count(*) AS n FROM part GROUP BY 1, 2, 3")
def grid_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid results as blank-separated text with a quoted header."""

    def write(path: str) -> None:
        p, n = _table(spark, sf_dir, "part"), F.col("p_partkey")
        columns = [F.col("p_size").cast("double"), F.lit(1.0), F.lit(2.0), F.lit(3.0), F.round("p_retailprice", 2), (n % 11).cast("double"), F.lit(4.0), F.lit(5.0), F.lit(6.0)]
        names = [c.strip().rsplit(" ", 1)[0].strip("`") for c in schemas.GRID.split(",")]
        p.select(*[c.alias(name) for c, name in zip(columns, names)]).write.csv(path, sep=" ", header=True, quoteAll=True)

    rows = coordinates.read_grid(spark, _once(spark, sf_dir, "grid", write))
    return rows.groupBy("East", "Residual", "Rate").agg(F.count("*").alias("n"))


# --- headers and reports ------------------------------------------------------------------------------------------


def _reports(spark: SparkSession, sf_dir: str) -> str:
    """A text for each supplier that is an observation file with reports behind it; all have the same base name."""

    def write(path: str) -> None:
        s, n = _table(spark, sf_dir, "supplier"), F.col("s_suppkey")
        head = lambda value, label: F.concat(F.rpad(value, 60, " "), F.lit(f"{label:<20}"))
        day = F.date_format(F.date_add(F.lit("2024-01-01").cast("date"), (n % 300).cast("int")), "  yyyy    MM    dd    10    20   30.0000000")
        balance = F.format_string("%.2f", F.abs("s_acctbal"))
        lines = [
            F.when(n % 10 == 0, F.lit("no mark")).otherwise(head(F.lit("     2.11           OBSERVATION DATA"), "RINEX VERSION / TYPE")),
            head(F.concat(_code(n), F.lit(" 001")), "MARKER NAME"),
            head(F.concat(F.lpad("s_suppkey", 20, " "), F.concat(F.lit("RECEIVER "), F.col("s_nationkey").cast("string"))), "REC # / TYPE / VERS"),
            head(F.concat(F.lpad("s_suppkey", 20, " "), F.concat(F.lit("ANT"), F.col("s_nationkey").cast("string"), F.lit("     NONE"))), "ANT # / TYPE"),
            head(F.format_string("%10.3f", (n % 30 + 1).cast("double")), "INTERVAL"),
            head(day, "TIME OF FIRST OBS"),
            head(F.lit(""), "END OF HEADER"),
            head(F.lit("WRONG"), "MARKER NAME"),
            F.concat(F.lit("# obs : "), F.col("s_suppkey").cast("string"), F.lit("  1\n# slips (all) : 12\nMP1 : "), balance),
            F.concat(F.lit(" USED OBSERVATIONS   : "), F.col("s_suppkey").cast("string"), F.lit("\n BAD OBSERVATIONS    : 1.02 %\n RMS OF UNIT WEIGHT  : "), balance, F.lit(" M")),
            F.concat(F.lit("  "), _code(n), F.lit(" 21904S001    X     -1132915.14   -1132915.19   "), F.format_string("%.2f", -F.abs("s_acctbal") / 1000), F.lit("   0.01\n        Y   1.00  2.00  0.50  0.02\n        Z   1.00  2.00  0.25  0.01")),
            F.concat(F.lit("  72 FILES, MAX. RMS: "), balance, F.lit(" M FOR STATION: "), _code(n), F.lit(" X\n  MAX. BAD: 4.54 % FOR STATION: PAPI Y")),
            F.concat(F.when(n % 2 == 0, "BPE finished").otherwise("BPE aborted"), F.lit("\nStations accepted : "), F.col("s_suppkey").cast("string"), F.lit("\nFixing rate : "), F.col("s_nationkey").cast("string"), F.lit(" %\nHELMCHK : "), F.when(n % 3 == 0, "failed").otherwise("ok")),
            F.lit("TYPE 001: NAMES\nIGNORED\nTYPE 002: INFORMATION\n" + "*" * 30),
            F.concat(F.rpad(_code(n), 69, " "), F.rpad(F.concat(F.lit("RECEIVER "), F.col("s_nationkey").cast("string")), 52, " "), F.rpad(F.concat(F.lit("ANT"), F.col("s_nationkey").cast("string")), 30, " ")),
            F.concat(F.rpad(F.concat(F.lit("ANT"), F.col("s_nationkey").cast("string"), F.lit(" NONE")), 60, " "), F.lit("TYPE / SERIAL NO")),
        ]
        _text(s.select(F.concat_ws("\n", *lines).alias("value"), n.alias("folder")), path, "folder")

    return _once(spark, sf_dir, "reports", write)


@_query("SELECT printf('%04X', s_suppkey) AS station_code, (s_suppkey % 30 + 1)::DOUBLE AS sampling_interval, 'RECEIVER ' || s_nationkey AS receiver_type, 'ANT' || s_nationkey || '     NONE' AS antenna_type, TIMESTAMP '2024-01-01 10:20:30' + to_days((s_suppkey % 300)::INT) AS start_time, s_suppkey % 10 <> 0 AS has_marker FROM supplier")
def rinex_headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Headers of files that share a base name; what stands behind the end of a header doesn't count."""
    rows = reports.scan_rinex_headers(spark, _reports(spark, sf_dir))
    return rows.select("station_code", "sampling_interval", "receiver_type", "antenna_type", F.col("start_time").cast("timestamp_ntz").alias("start_time"), "has_marker")


@_query("SELECT s_suppkey::INT AS obs_count, 12 AS cycle_slips, round(abs(s_acctbal), 2) AS mp1_rms, NULL::DOUBLE AS mp2_rms FROM supplier")
def qc_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_qc_reports(spark, _reports(spark, sf_dir)).drop("file_name")


@_query("SELECT printf('%04X', s_suppkey) AS station, round(abs(s_acctbal), 2) AS rms_m, 1.02::DOUBLE AS bad_pct, s_suppkey::INT AS used_obs, 0.5::DOUBLE AS dy, 0.25::DOUBLE AS dz FROM supplier")
def spp_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_spp_reports(spark, _reports(spark, sf_dir)).drop("file_name", "dx")


@_query("SELECT round(abs(s_acctbal), 2) AS max_rms, printf('%04X', s_suppkey) AS max_rms_station, 4.54::DOUBLE AS max_bad, 'PAPI' AS max_bad_station FROM supplier")
def spp_summaries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_spp_summary(spark, _reports(spark, sf_dir)).drop("file_name")


@_query("SELECT s_suppkey % 2 = 0 AS finished, s_suppkey::INT AS stations_accepted, round(s_nationkey / 100.0::DOUBLE, 6) AS fixing_rate, s_suppkey % 3 = 0 AS helmert_failed, FALSE AS comparison_failed FROM supplier")
def run_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_run_logs(spark, _reports(spark, sf_dir)).drop("file_name").withColumn("fixing_rate", F.round("fixing_rate", 6))


@_query("SELECT printf('%04X', s_suppkey) AS station_code, 'RECEIVER ' || s_nationkey AS receiver_type, 'ANT' || s_nationkey AS antenna_type FROM supplier")
def station_information(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The TYPE 002 section of each of many files of the same base name."""
    return reports.scan_station_info(spark, _reports(spark, sf_dir))


@_query("SELECT DISTINCT 'ANT' || s_nationkey || ' NONE' AS antenna_type FROM supplier")
def antenna_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reports.scan_antenna_types(spark, _reports(spark, sf_dir))


@_query("SELECT s_suppkey AS folder, '.txt' AS extension, 1 AS files FROM supplier")
def file_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Files of a tree by folder and extension."""
    files = archive_sources.catalog_files(spark, _reports(spark, sf_dir)).filter("size_bytes > 0")
    return files.groupBy(F.regexp_extract("parent_dir", "folder=([0-9]+)$", 1).cast("long").alias("folder"), "extension").agg(F.count("*").cast("int").alias("files"))


@_query("SELECT s_suppkey AS folder, 64 AS digits, count(*) AS contents FROM supplier GROUP BY 1")
def discovered_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observation files by extension (here .gz), hashed."""

    def write(path: str) -> None:
        s = _table(spark, sf_dir, "supplier").select(F.col("s_name").alias("value"), F.col("s_suppkey").alias("folder"))
        sinks.write_folders(s, path, "folder", compression="gzip")

    found = archive_sources.discover_files(spark, _once(spark, sf_dir, "tree", write))
    return found.groupBy(F.regexp_extract("filepath", "folder=([0-9]+)/", 1).cast("long").alias("folder"), F.length("file_hash").alias("digits")).agg(F.count_distinct("file_hash").alias("contents"))


@_query("""SELECT 'P/$I' || doc_id AS meta_path, CASE WHEN doc_id % 4 <> 3 THEN 'D:\\' || doc_id || '.05o' END AS original_path, CASE WHEN doc_id % 4 <> 3 THEN n_chars END AS size_bytes, CASE WHEN doc_id % 4 <> 3 THEN TIMESTAMP '2020-09-13 12:26:40' END AS deleted_at, CASE WHEN doc_id % 4 = 3 THEN 'version' END AS error FROM documents""")
def deleted_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Metadata records of both versions, built for each document, decoded; every fourth has a version that isn't known."""
    little = lambda x, size: F.unhex(F.array_join(F.reverse(F.regexp_extract_all(F.lpad(F.hex(x), 2 * size, "0"), F.lit("(..)"), F.lit(0))), ""))
    name = F.concat(F.lit("D:\\"), F.col("doc_id").cast("string"), F.lit(".05o"))
    version = F.when(F.col("doc_id") % 4 == 3, 9).when(F.col("doc_id") % 4 == 2, 1).otherwise(2)
    filetime = F.lit((1_600_000_000_000_000 + 11644473600000000) * 10)
    zero = F.lit("\x00")
    front = F.concat(little(version, 8), little(F.col("n_chars"), 8), little(filetime, 8))
    one = F.encode(F.rpad(name, 260, "\x00"), "UTF-16LE")
    two = F.concat(little(F.length(name) + 1, 4), F.encode(F.concat(name, zero), "UTF-16LE"))
    docs = _table(spark, sf_dir, "documents").select(F.concat(F.lit("P/$I"), F.col("doc_id").cast("string")).alias("path"), F.concat(front, F.when(version == 1, one).otherwise(two)).alias("content"))
    rows = archive_sources.decode_deleted_metadata(docs.withColumn("length", F.length("content").cast("long")))
    return rows.withColumn("deleted_at", F.col("deleted_at").cast("timestamp_ntz"))


# --- tables -------------------------------------------------------------------------------------------------------


@_query("""WITH s AS (SELECT s_suppkey::VARCHAR AS station_code, 5.0::DOUBLE + s_nationkey AS own, s_suppkey % 4 <> 0 AS known, s_suppkey % 3 AS f FROM supplier)
SELECT c_custkey, CASE WHEN known THEN own ELSE 15.0 END AS mm_s, CASE WHEN known AND f = 1 THEN 0.99 WHEN known AND f = 2 THEN 1.0 ELSE 0.9 END::DOUBLE AS decay FROM customer LEFT JOIN s ON station_code = (c_custkey % 200)::VARCHAR""")
def station_config(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Threshold and decay of the station of each row, from the stations' file where it is there and says so."""

    def write(path: str) -> None:
        s, n = _table(spark, sf_dir, "supplier").filter("s_suppkey % 4 != 0"), F.col("s_suppkey")
        own = F.when(n % 3 == 1, F.struct(F.lit(True).alias("enabled"), F.lit(0.99).alias("decay"))).when(n % 3 == 2, F.struct(F.lit(False).alias("enabled"), F.lit(0.5).alias("decay")))
        s.select(n.cast("string").alias("station_code"), (5.0 + F.col("s_nationkey")).alias("threshold_mm_s"), own.alias("filter")).write.json(path)

    stations = sentences.read_stations(spark, _once(spark, sf_dir, "stations", write))
    rows = _table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_custkey") % 200).cast("string").alias("station_code"))
    return telemetry.with_config(rows, stations, 15.0, 0.9).select("c_custkey", "mm_s", "decay")


@_query("SELECT o_custkey::VARCHAR AS station_code, year(o_orderdate)::INT AS processing_year, count(DISTINCT dayofyear(o_orderdate))::INT AS n_ranges FROM orders GROUP BY 1, 2")
def processing_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        day = F.dayofyear("o_orderdate")
        rows = _table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").cast("string").alias("station_code"), F.year("o_orderdate").alias("processing_year")).agg(F.collect_set(F.struct(day.alias("lo"), day.alias("hi"))).alias("available_days"))
        rows.withColumns({"status": F.lit("done"), "staff_assigned": F.lit(None).cast("string"), "notes": F.lit(None).cast("string"), "updated_at": F.lit(None).cast("timestamp")}).write.parquet(path)

    rows = sentences.read_processing_status(spark, _once(spark, sf_dir, "status", write))
    return rows.select("station_code", "processing_year", F.size("available_days").alias("n_ranges"))


@_query("SELECT date_trunc('second', ts) AS time, round(value, 2) AS east, count(*) AS n FROM events GROUP BY 1, 2")
def kin_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    def write(path: str) -> None:
        _text(_table(spark, sf_dir, "events").select(F.concat_ws(",", F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.format_string("%.2f,%.2f,%.2f", "value", "value", "value")).alias("value")), path)

    rows = sentences.read_kin_series(spark, _once(spark, sf_dir, "kin-series", write))
    return rows.groupBy(F.col("time").cast("timestamp_ntz").alias("time"), "east").agg(F.count("*").alias("n"))


@_query("""WITH e AS (SELECT event_id, user_id, epoch_us(date_trunc('second', ts))::DOUBLE / 1e6 AS s, hour(ts) * 3600 + minute(ts) * 60 + floor(second(ts)) AS t, value FROM events),
b AS (SELECT *, coalesce(lag(t) OVER w - t > 43200, FALSE)::INT AS back FROM e WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
SELECT user_id, TIMESTAMP '2024-01-01' + to_seconds(t + 86400 * sum(back) OVER (PARTITION BY user_id ORDER BY event_id)) AS time, round(value, 2) AS east FROM b""")
def tod_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Times of day of each user, tab-separated in a file of its own; the date advances where the clock falls back."""

    def write(path: str) -> None:
        line = F.concat_ws("\t", F.date_format("ts", "HH:mm:ss"), F.format_string("%.2f", "value"), F.lit("0"), F.lit("0"))
        rows = _table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("event_id", line.alias("line")))), lambda x: x["line"]), "\n").alias("value"))
        _text(rows, path, "user_id")

    rows = sentences.read_tod_series(spark, _once(spark, sf_dir, "tod", write))
    rows = telemetry.resolve_dates(rows, "2024-01-01", by="file_path")
    return rows.select(F.regexp_extract("file_path", "user_id=([0-9]+)/", 1).cast("long").alias("user_id"), F.col("time").cast("timestamp_ntz").alias("time"), "east")


@_query(f"WITH {_PAGES} SELECT path, name, extension, coalesce(category, 'none') AS category, count(*) AS n FROM c GROUP BY 1, 2, 3, 4")
def catalog_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = archive.classify_files(_page_files(spark, sf_dir)).select("path", "name", "extension", "category", "size_bytes")
    rows = archive_sources.read_catalog(spark, _once(spark, sf_dir, "catalog", lambda path: sinks.write_catalog(files, path)))
    return rows.groupBy("path", "name", "extension", F.coalesce("category", F.lit("none")).alias("category")).agg(F.count("*").alias("n"))


@_query("SELECT year::VARCHAR AS year, station, n_days, year_days, round(n_days / year_days, 6) AS share FROM (SELECT o_custkey AS station, year(o_orderdate) AS year, count(DISTINCT o_orderdate) AS n_days, CASE WHEN year(o_orderdate) % 4 = 0 THEN 366 ELSE 365 END AS year_days FROM orders GROUP BY ALL)")
def coverage_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The coverage report with its ranges, written by year and read again."""
    rows = _table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("station"), F.year("o_orderdate").alias("year"), F.dayofyear("o_orderdate").alias("doy"))
    folder = _once(spark, sf_dir, "coverage", lambda path: sinks.write_coverage(network.coverage_report(rows), path))
    read = spark.read.schema("station long, n_days long, year_days int, share double, with_data string, gaps string, year string").json(folder)
    return read.select("year", "station", "n_days", "year_days", F.round("share", 6).alias("share"))


@_query(f"WITH {_PAGES} SELECT path AS src_path, size_bytes, CASE WHEN page_id % 2 = 0 THEN 'ok' ELSE 'orphan' END AS status FROM p")
def manifest_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _page_files(spark, sf_dir).select(F.col("path").alias("src_path"), "size_bytes", F.when(F.col("page_id") % 2 == 0, "ok").otherwise("orphan").alias("status"))
    folder = _once(spark, sf_dir, "manifest", lambda path: sinks.write_manifest(rows, path))
    return spark.read.csv(folder, sep="\t", header=True, schema="src_path string, size_bytes long, status string")


# --- appends ------------------------------------------------------------------------------------------------------


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = _table(spark, sf_dir, "events")
    return e.select(F.col("ts").cast("timestamp").alias("time"), F.col("user_id").cast("string").alias("station_code"), "event_id", (F.col("value") / 1000).alias("v_horizontal"))


@_query("SELECT ts::DATE AS obs_date, count(DISTINCT (ts, user_id)) AS velocities, count(DISTINCT (ts, user_id)) AS displacements, count(DISTINCT (ts, user_id)) AS events FROM events GROUP BY 1")
def appended_twice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows by day of three tables that a batch with all rows and one with half of them were fanned out to, each twice."""
    path, rows = scratch_path(spark, "appends"), _events(spark, sf_dir)
    detected = lambda df: df.select("station_code", F.col("time").alias("detection_time"), "v_horizontal")
    write = sinks.fan_out([lambda df, batch: sinks.append_velocities(df, f"{path}/velocities"), lambda df, batch: sinks.append_displacements(df, f"{path}/displacements"), lambda df, batch: sinks.append_events(detected(df), f"{path}/events"), lambda df, batch: sinks.dry_run(df)])
    for batch, df in enumerate((rows.filter("event_id % 2 = 0"), rows, rows)):
        write(df, batch)
    parts = [spark.read.parquet(f"{path}/{name}").groupBy("obs_date").agg(F.count("*").alias(name)) for name in ("velocities", "displacements", "events")]
    return parts[0].join(parts[1], "obs_date").join(parts[2], "obs_date")


@_query("SELECT ts::DATE AS obs_date, count(DISTINCT (ts, user_id)) AS n FROM events WHERE ts::DATE >= (SELECT max(ts)::DATE - 10 FROM events) GROUP BY 1")
def retained_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table by day whose partitions beyond ten days were dropped."""
    path, rows = scratch_path(spark, "retention") + "/velocities", _events(spark, sf_dir)
    sinks.append_velocities(rows, path)
    last = rows.agg(F.max(F.to_date("time")).cast("string")).first()[0]
    sinks.drop_expired(spark, path, last, 10)
    return sinks.apply_retention(spark, path, last, 10).groupBy("obs_date").agg(F.count("*").alias("n"))


@_query("SELECT time_bucket(INTERVAL '1 hour', ts) AS bucket, user_id::VARCHAR AS station_code, round(max(value / 1000), 9) AS v_max, count(*) AS sample_count FROM events WHERE ts >= (SELECT date_trunc('day', max(ts)) - INTERVAL 5 DAY FROM events) AND time_bucket(INTERVAL '1 hour', ts) + INTERVAL 1 HOUR <= (SELECT date_trunc('day', max(ts)) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2")
def refreshed_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The trailing days of an hourly rollup, written twice."""
    rows = _events(spark, sf_dir).withColumns({f"v_{c}": F.col("v_horizontal") for c in ("east", "north", "up")})
    last = rows.agg(F.date_trunc("day", F.max("time")).cast("string")).first()[0]
    path = scratch_path(spark, "rollup") + "/hourly"
    for _ in range(2):
        rolled = telemetry.refresh_rollup(rows, path, "1 hour", last, "5 days", "1 day")
    return rolled.select(F.col("bucket").cast("timestamp_ntz").alias("bucket"), "station_code", F.round("v_horizontal_max", 9).alias("v_max"), "sample_count")


@_query("SELECT p_partkey % 5 AS draw, count(*) AS n, round(sum(p_retailprice), 2) AS total FROM part GROUP BY 1")
def grid_by_draw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Grid results by draw; two draws are written again and replace themselves."""
    path = scratch_path(spark, "grid-draws") + "/grid"
    rows = _table(spark, sf_dir, "part").select((F.col("p_partkey") % 5).alias("draw"), "p_retailprice")
    sinks.write_grid(rows, path)
    sinks.append_best(rows.filter("draw < 2"), path)
    return spark.read.parquet(path).groupBy(F.col("draw").cast("long").alias("draw")).agg(F.count("*").alias("n"), F.round(F.sum("p_retailprice"), 2).alias("total"))


@_query(f"WITH {_ORDERS} SELECT station, count(*) AS n FROM o GROUP BY 1")
def velocity_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of the velocity report, one for each station, with the number of points in it."""
    rows = _order_series(spark, sf_dir).groupBy("station").agg(F.count("*").alias("n"))
    lines = rows.select("station", F.lit(0).alias("segment"), *[x for a in "enu" for x in (F.col("n").cast("double").alias(f"v{a}_mm_yr"), F.lit(1.0).alias(f"sig_v{a}_mm_yr"))])
    folder = _once(spark, sf_dir, "velocity-report", lambda path: sinks.write_velocity_report(lines, path))
    parts = F.split(F.trim("value"), r"\s+")
    return spark.read.text(folder).select(F.get(parts, 0).alias("station"), F.get(parts, 3).cast("double").cast("long").alias("n"))


@_query("SELECT count(*) AS segments, count(*) * 2 AS points, sum(round(s_acctbal, 4)) > 0 AS positive FROM supplier")
def segment_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Map-ready segments of two points, written and read as polylines."""
    n = F.col("s_suppkey")
    rows = _table(spark, sf_dir, "supplier").select(n.alias("row"), F.col("s_acctbal").alias("slip"), *[((n % 10) + i).cast("double").alias(f"x{i}") for i in (1, 2)], *[F.lit(float(i)).alias(f"y{i}") for i in (1, 2)])
    folder = _once(spark, sf_dir, "segments", lambda path: sinks.write_segments(rows, path, "slip", [("x1", "y1"), ("x2", "y2")]))
    points = coordinates.read_polylines(spark, folder).groupBy("file_path", "segment_id").agg(F.count("*").alias("n"))
    total = rows.agg((F.sum(F.round("slip", 4)) > 0).alias("positive"))
    return points.agg(F.count("*").alias("segments"), F.sum("n").alias("points")).crossJoin(total)  # one row each
