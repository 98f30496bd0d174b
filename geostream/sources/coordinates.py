"""Daily and kinematic coordinates, series, offsets, sites, velocity fields, polylines and fault patches."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from geostream import schemas
from geostream.functions.text import station_of, token, tokens
from geostream.functions.times import gps_time
from geostream.sources.lines import bytes_of, read_lines
from geostream.sources.shared import staged


def _double(parts: Column, place: int) -> Column:
    return token(parts, place).try_cast("double")


def read_crd(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_path, file_name, station, x, y, z) of rows with a whole number first and five tokens at least.

    A third token that is no decimal number (a DOMES number, also one such as 12345E001) moves the coordinates by one.
    """
    rows = read_lines(spark, path, glob).withColumn("t", tokens(F.col("line")))
    rows = rows.filter((F.size("t") >= 5) & F.regexp_like(token(F.col("t"), 0), F.lit(r"^[+-]?[0-9]+$")))
    plain = F.regexp_like(token(F.col("t"), 2), F.lit(r"^[+-]?[0-9]*\.[0-9]*([eE][+-]?[0-9]+)?$"))
    xyz = [F.when(plain, _double(F.col("t"), 2 + i)).otherwise(_double(F.col("t"), 3 + i)).alias(n) for i, n in enumerate("xyz")]
    return rows.select("file_path", "file_name", station_of(token(F.col("t"), 1)).alias("station"), *xyz).filter("x is not null and y is not null and z is not null")


def read_kin(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_path, file_name, session, station, time, x, y, z, flag) of rows with eight tokens below the first five lines."""
    rows = read_lines(spark, path, glob).filter("line_no > 5").withColumn("t", tokens(F.col("line"))).filter(F.size("t") == 8)
    t = F.col("t")
    return rows.select("file_path", "file_name", F.substring("file_name", 5, 5).alias("session"), station_of(token(t, 0)).alias("station"), gps_time(_double(t, 2), _double(t, 3)).alias("time"), _double(t, 4).alias("x"), _double(t, 5).alias("y"), _double(t, 6).alias("z"), token(t, 7).alias("flag"))


def read_series(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(station, t, east_m, north_m, up_m) of files named by site, or in folders station=SITE as sinks.write_series makes them."""
    t = F.col("t")
    rows = read_lines(spark, path, glob).withColumn("t", tokens(F.col("line"))).filter(F.size("t") >= 4)
    site = F.coalesce(F.nullif(F.regexp_extract("file_path", "/station=([^/]+)/", 1), F.lit("")), F.col("file_name"))
    rows = rows.select(station_of(site).alias("station"), *[_double(t, i).alias(n) for i, n in enumerate(("t", "east_m", "north_m", "up_m"))])
    return rows.filter("t is not null and east_m is not null and north_m is not null and up_m is not null")


def read_offsets(spark: SparkSession, path: str) -> DataFrame:
    """(station, date, type) of 'SITE year TYPE' lines; comments, short and non-numeric lines go, an unknown type is UK."""
    t = F.col("t")
    rows = read_lines(spark, path).filter("trim(line) != '' and ltrim(line) not like '#%'").withColumn("t", tokens(F.col("line"))).filter(F.size("t") >= 2)
    kind = F.upper(F.coalesce(token(t, 2), F.lit("UK")))
    return rows.select(F.upper(token(t, 0)).alias("station"), _double(t, 1).alias("date"), F.when(kind.isin("EQ", "VE", "CE", "UK"), kind).otherwise("UK").alias("type")).filter("date is not null")


def read_sites(spark: SparkSession, path: str) -> DataFrame:
    """(site) of a site list in file order."""
    rows = read_lines(spark, path).filter("trim(line) != ''").select("file_name", "file_path", "line_no", station_of(F.col("line")).alias("site"))
    return rows.orderBy("file_name", "file_path", "line_no").select("site")


def read_profile(spark: SparkSession, path: str, sep: str = ",", skip_first: bool = True) -> DataFrame:
    """Profile velocities; skip_first drops each file's first data row."""
    rows = spark.read.schema(schemas.PROFILE).csv(path, sep=sep, header=True)
    if skip_first:
        names = [x.strip().split()[0] for x in schemas.PROFILE.split(",")]
        lines = read_lines(spark, path).filter("line_no > 2 and trim(line) != ''")
        # from_csv knows quotes and takes the separator as it is.
        fields = F.from_csv(F.col("line"), F.lit(", ".join(f"{n} string" for n in names)), {"sep": sep, "ignoreLeadingWhiteSpace": "true", "ignoreTrailingWhiteSpace": "true"}).alias("f")
        rows = lines.select(fields).select(*[(F.col(f"f.{n}") if i == 0 else F.col(f"f.{n}").try_cast("double")).alias(n) for i, n in enumerate(names)])
    return rows


def read_grid(spark: SparkSession, path: str) -> DataFrame:
    """Grid-search results, blank-separated with a quoted header."""
    return spark.read.schema(schemas.GRID).csv(path, sep=" ", quote='"', header=True)


def read_velocity_field(spark: SparkSession, path: str) -> DataFrame:
    """(lon, lat, ve, vn, se, sn, corr, site)."""
    t = F.col("t")
    rows = read_lines(spark, path).withColumn("t", tokens(F.col("line"))).filter(F.size("t") >= 8)
    return rows.select(*[_double(t, i).alias(n) for i, n in enumerate(("lon", "lat", "ve", "vn", "se", "sn", "corr"))], token(t, 7).alias("site")).filter("lon is not null and lat is not null")


def read_polylines(spark: SparkSession, path: str, block: int = 1 << 16) -> DataFrame:
    """(file_path, file_name, segment_id, seq, lon, lat) of multi-segment text with > between segments.

    Marks and points are counted within blocks of so many lines, which tasks sort; what the blocks before hold is added
    by a row for each block. So no task holds a file or a segment, and a task has some 4 MB of text whatever there is.
    """
    t, keys = F.col("t"), ["file_path", "_block"]
    rows = read_lines(spark, path).filter("trim(line) != ''")
    rows = rows.select("file_path", F.floor(F.col("line_no") / block).alias("_block"), "line_no", "line", F.startswith(F.ltrim("line"), F.lit(">")).alias("mark"))
    tasks = bytes_of(spark, path) >> 22
    rows = rows.repartition(tasks, *keys) if tasks > int(spark.conf.get("spark.sql.shuffle.partitions")) else rows
    upto = Window.partitionBy(*keys).orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_marks": F.count_if("mark").over(upto), "_points": F.count_if(~F.col("mark")).over(upto)})
    rows = rows.withColumn("_at", F.max(F.when(F.col("mark"), F.col("_points"))).over(upto)).withColumn("t", tokens(F.col("line")))
    counted = staged(rows.select(*keys, "mark", "_marks", "_points", "_at", _double(t, 0).alias("lon"), _double(t, 1).alias("lat")), "polylines")
    own = counted.groupBy(*keys).agg(*[F.max(c).alias(f"{c}_in") for c in ("_marks", "_points", "_at")])
    before = Window.partitionBy("file_path").orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    own = own.withColumns({f"{c}_before": F.coalesce(F.sum(f"{c}_in").over(before), F.lit(0)) for c in ("_marks", "_points")})
    own = own.withColumn("_at_before", F.coalesce(F.max(F.col("_points_before") + F.col("_at_in")).over(before), F.lit(0)))
    own = staged(own.select(*keys, "_marks_before", "_points_before", "_at_before"), "polyline-blocks")
    met = counted.filter("not mark and lon is not null and lat is not null").join(own, keys)
    total = F.col("_points_before") + F.col("_points")
    seq = total - F.coalesce(F.col("_points_before") + F.col("_at"), F.col("_at_before"))
    return met.select("file_path", F.regexp_extract("file_path", r"([^/]*)$", 1).alias("file_name"), (F.col("_marks_before") + F.col("_marks")).alias("segment_id"), seq.cast("int").alias("seq"), "lon", "lat")


def read_columns(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    """(file, row, *names) of tables of numbers, row being the place of the line among the numeric ones of its file.

    file: the path below the folder that is read, by which the files of several folders belong together; empty for a file or
    a pattern, which has to stand for one file.
    """
    t = F.col("t")
    rows = read_lines(spark, path).withColumn("t", tokens(F.col("line"))).filter((F.size("t") >= len(names)) & _double(t, 0).isNotNull())
    place = F.row_number().over(Window.partitionBy("file_path").orderBy("line_no"))
    root = re.sub("^[a-z]+:/*", "/", path).rstrip("/")
    file = F.lit("") if re.search(r"[*?\[{]", path) else F.substring_index("file_path", root, -1)
    return rows.select(file.alias("file"), place.alias("row"), *[_double(t, i).alias(n) for i, n in enumerate(names)])


def read_patches(spark: SparkSession, geometry: str, xs: str, ys: str, zs: str, slips: str) -> DataFrame:
    """One row for each fault patch: geometry, four corners and slip, aligned by line, and by file where folders are given."""
    parts = [read_columns(spark, geometry, ["length", "width", "lower", "dip", "strike"])]
    parts += [read_columns(spark, p, [f"{axis}{i}" for i in range(1, 5)]) for axis, p in zip("xyz", (xs, ys, zs))]
    parts.append(read_columns(spark, slips, ["slip_strike", "slip_dip", "slip"]))
    out = parts[0]
    for part in parts[1:]:
        out = out.join(part, ["file", "row"])
    return out


def read_baselines(spark: SparkSession, ends: str, observed: str, calculated: str, residual: str) -> DataFrame:
    """One row for each baseline: end points and observed, calculated and residual change, aligned by line, and by file where folders are given."""
    out = read_columns(spark, ends, ["lon1", "lat1", "lon2", "lat2"])
    for name, path in (("obs", observed), ("cal", calculated), ("res", residual)):
        out = out.join(read_columns(spark, path, [name]), ["file", "row"])
    return out
