"""Velocity (LVM) and displacement (LDM) sentences: reading, routing, parsing with rejects."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream import schemas
from geostream.functions.text import checksum_ok
from geostream.functions.times import sentence_time
from geostream.sources.lines import bound, named, read_lines

_VELOCITY = ("vE", "vN", "vU", "varE", "varN", "varU", "covEN", "covEU", "covUN", "cq")
_DISPLACEMENT = ("dE", "dN", "dU", "varE", "varN", "varU", "covEN", "covEU", "covUN", "cq")


def read_nmea(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """(file_path, file_name, line_no, sentence): trimmed, without blank lines; arrival order is (file_name, file_path, line_no)."""
    lines = read_lines(spark, path, glob)
    return lines.select("file_path", "file_name", "line_no", F.trim("line").alias("sentence")).filter("sentence != ''")


def stream_nmea(spark: SparkSession, path: str, files_per_trigger: int | None = None) -> DataFrame:
    """The same of files that land in a folder, as a stream; files_per_trigger bounds what a batch admits."""
    reader = spark.readStream
    reader = reader.option("maxFilesPerTrigger", files_per_trigger) if files_per_trigger else reader
    files = reader.text(path, wholetext=True)
    # Paths are decoded once for each file, before its lines are told apart.
    lines = files.select(*named(F.col("value"))).select("file_path", "file_name", F.posexplode(F.split("value", "\r?\n")).alias("pos", "line"))
    return lines.select("file_path", "file_name", (F.col("pos") + 1).cast("long").alias("line_no"), F.trim("line").alias("sentence")).filter("sentence != ''")


def route_sentences(lines: DataFrame) -> DataFrame:
    """lines with kind LVM or LDM; other sentences are dropped."""
    def starts(kind: str) -> Column:
        return F.startswith(F.col("sentence"), F.lit(f"$GN{kind}")) | F.startswith(F.col("sentence"), F.lit(f"$GP{kind}"))

    return lines.withColumn("kind", F.when(starts("LVM"), "LVM").when(starts("LDM"), "LDM")).filter("kind is not null")


def _number(place: int) -> Column:
    return F.trim(F.get("fields", F.lit(place))).try_cast("double")


def _whole(place: int) -> Column:
    return F.trim(F.get("fields", F.lit(place))).try_cast("int")


def _parse(lines: DataFrame, talkers: tuple[str, str], fields: list[tuple[str, Column]]) -> tuple[DataFrame, DataFrame]:
    split = bound(lines, fields=F.split(F.substring_index("sentence", "*", 1), ","))
    found = F.struct(*[col.alias(name) for name, col in fields], F.get("fields", F.lit(0)).isin(*talkers).alias("_ours"), checksum_ok(F.col("sentence")).alias("_sum"))
    parsed = bound(split, _found=found).select(*lines.columns, "_found.*")
    reason = F.when(~F.col("_sum"), "checksum").when(~F.col("_ours"), "talker").when(F.greatest(*[F.col(name).isNull() for name, _ in fields]), "fields")
    parsed = parsed.withColumn("reason", reason).drop("_ours", "_sum")
    good = parsed.filter("reason is null").drop("reason", "sentence")
    return good, parsed.filter("reason is not null").select(*lines.columns, "reason")


def parse_lvm(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects with reason checksum, talker or fields) of velocity sentences."""
    fields = [("time", sentence_time(F.get("fields", F.lit(1)), F.get("fields", F.lit(2))))]
    fields += [(name, _number(3 + i)) for i, name in enumerate(_VELOCITY)] + [("n_sats", _whole(13))]
    return _parse(lines, ("$GNLVM", "$GPLVM"), fields)


def parse_ldm(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows, rejects) of displacement sentences."""
    fields = [("time", sentence_time(F.get("fields", F.lit(1)), F.get("fields", F.lit(2)))), ("start_time", sentence_time(F.get("fields", F.lit(3)), F.get("fields", F.lit(4))))]
    fields += [(name, _number(5 + i)) for i, name in enumerate(_DISPLACEMENT)] + [("n_sats", _whole(15)), ("reset_indicator", _whole(16)), ("epoch_completeness", _number(17)), ("overall_completeness", _number(18))]
    return _parse(lines, ("$GNLDM", "$GPLDM"), fields)


def to_velocity_rows(parsed: DataFrame) -> DataFrame:
    """Parser names -> names of the velocity table."""
    return parsed.select("time", "station_code", F.col("vE").alias("v_east"), F.col("vN").alias("v_north"), F.col("vU").alias("v_up"), F.hypot("vE", "vN").alias("v_horizontal"), F.col("cq").alias("quality"))


def to_displacement_rows(parsed: DataFrame) -> DataFrame:
    """Parser names -> names of the displacement table."""
    source = F.col("displacement_source") if "displacement_source" in parsed.columns else F.lit("RECEIVER")
    return parsed.select("time", "station_code", F.col("dE").alias("d_east"), F.col("dN").alias("d_north"), F.col("dU").alias("d_up"), F.hypot("dE", "dN").alias("d_horizontal"), "overall_completeness", F.col("cq").alias("quality"), source.alias("displacement_source"))


def read_stations(spark: SparkSession, path: str) -> DataFrame:
    """Station dimension with threshold and filter decay of each station."""
    return spark.read.schema(schemas.STATIONS).json(path)


def read_processing_status(spark: SparkSession, path: str) -> DataFrame:
    """Station-year status with ranges of available days."""
    return spark.read.schema(schemas.PROCESSING_STATUS).parquet(path)


def read_kin_series(spark: SparkSession, path: str) -> DataFrame:
    """CSV of yyyy-MM-dd HH:mm:ss, east, north, up."""
    return spark.read.schema(schemas.KIN_SERIES).csv(path, timestampFormat="yyyy-MM-dd HH:mm:ss")


def read_tod_series(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated HH:MM:SS, east, north, up (mm) with line_no; see operators.telemetry.resolve_dates, by file_path, for the day."""
    lines = read_lines(spark, path).filter("trim(line) != ''")
    part = F.split(F.trim("line"), r"\s+")
    return lines.select("file_path", "file_name", "line_no", F.get(part, 0).alias("clock"), *[F.get(part, i + 1).try_cast("double").alias(n) for i, n in enumerate(("east", "north", "up"))])
