"""File trees as catalogs, content hashes, and deleted-file metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream import schemas
from geostream.functions.text import content_hash, size_mb
from geostream.sources.lines import listed


def _tree(spark: SparkSession, root: str) -> DataFrame:
    return listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root))


def name_columns(path: Column) -> dict[str, Column]:
    """name, extension (with dot, lower case, empty if none), parent_dir and depth of a path."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    return {"name": name, "extension": F.lower(F.regexp_extract(name, r"^.+(\.[^.]+)$", 1)), "parent_dir": F.regexp_replace(path, r"/[^/]*$", ""), "depth": F.size(F.split(path, "/")) - 1}


def catalog_files(spark: SparkSession, root: str) -> DataFrame:
    """path, name, extension, size_bytes, size_mb, modified, parent_dir and depth of every file; contents are not read."""
    files = _tree(spark, root).select(F.regexp_replace("path", "^file:", "").alias("path"), F.col("length").alias("size_bytes"), F.col("modificationTime").alias("modified"))
    return files.withColumns(name_columns(F.col("path"))).withColumn("size_mb", size_mb(F.col("size_bytes")))


def is_observation_file(name: Column, variant: str = "ingestion") -> Column:
    """Observation files by extension in any case.

    ingestion: .rnx, .crx, .gz, .zip, .Z and two-digit years with o or d; validator: .rnx, .obs, .rxo and years with o;
    coverage: years with o.
    """
    patterns = {"ingestion": r"\.(rnx|crx|gz|zip|z|[0-9]{2}[od])$", "validator": r"\.(rnx|obs|rxo|[0-9]{2}o)$", "coverage": r"\.[0-9]{2}o$"}
    return F.regexp_like(F.lower(name), F.lit(patterns[variant]))


def matches_session(name: Column, year: int, session: str) -> Column:
    """Characters 5-7 are the day of the session, or the name holds year and day, or year and session."""
    day = session[:3]
    return (F.substring(name, 5, 3) == day) | F.contains(name, F.lit(f"{year}{day}")) | F.contains(name, F.lit(f"{year}{session}"))


def discover_files(spark: SparkSession, root: str) -> DataFrame:
    """filename, filepath and file_hash (SHA-256 of the content) of observation files."""
    files = _tree(spark, root).withColumn("filename", F.regexp_extract("path", r"([^/]*)$", 1)).filter(is_observation_file(F.col("filename")))
    return files.select("filename", F.regexp_replace("path", "^file:", "").alias("filepath"), content_hash(F.col("content")).alias("file_hash"))


def read_catalog(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(schemas.CATALOG).json(path)


def _little_endian(content: Column, at: int) -> Column:
    """Unsigned 64-bit number at a byte position from 1."""
    pairs = F.regexp_extract_all(F.hex(F.substring(content, at, 8)), F.lit("(..)"), F.lit(1))
    return F.conv(F.array_join(F.reverse(pairs), ""), 16, 10).try_cast("decimal(20,0)")


def scan_deleted_metadata(spark: SparkSession, root: str) -> DataFrame:
    """meta_path, original_path, size_bytes, deleted_at, error of $I files.

    Version 1 holds 520 bytes of UTF-16LE path, version 2 its length first. Files of under 24 bytes, other versions, bad
    lengths and empty paths have an error instead.
    """
    files = _tree(spark, root).select("path", "content", "length").filter(F.regexp_like("path", F.lit(r"(^|/)\$I[^/]*$")))
    return decode_deleted_metadata(files)


def decode_deleted_metadata(files: DataFrame) -> DataFrame:
    content = F.col("content")
    version = _little_endian(content, 1)
    chars = F.conv(F.array_join(F.reverse(F.regexp_extract_all(F.hex(F.substring(content, 25, 4)), F.lit("(..)"), F.lit(1))), ""), 16, 10).try_cast("int")
    raw = F.when(version == 1, F.substring(content, 25, 520)).otherwise(F.expr("substring(content, 29)").cast("binary"))
    text = F.when(version == 1, F.decode(raw, "UTF-16LE")).otherwise(F.substring(F.decode(raw, "UTF-16LE"), F.lit(1), F.coalesce(chars, F.lit(0))))
    path = F.substring_index(text, "\x00", 1)
    error = (
        F.when(F.length("content") < 24, "truncated").when(~version.isin(1, 2), "version")
        .when((version == 2) & (chars.isNull() | (chars <= 0) | (28 + 2 * chars > F.length("content"))), "length").when(F.coalesce(path, F.lit("")) == "", "empty path")
    )
    micros = (F.floor(_little_endian(content, 17) / 10) - F.lit(11644473600000000)).cast("long")
    return files.withColumn("error", error).select(
        F.regexp_replace("path", "^file:", "").alias("meta_path"), F.when(F.col("error").isNull(), path).alias("original_path"), F.when(F.col("error").isNull(), _little_endian(content, 9).cast("long")).alias("size_bytes"),
        F.when(F.col("error").isNull(), F.timestamp_micros(micros)).alias("deleted_at"), "error")
