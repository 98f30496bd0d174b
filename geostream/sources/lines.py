"""Text corpora as rows of (file_path, file_name, line_no, line), in file order.

Archives repeat base names from folder to folder: the path tells files apart, the name is what a file says of itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def listed(spark: SparkSession, load: Callable[[], DataFrame]) -> DataFrame:
    """What load() yields, whose files are listed by four tasks for each core; Spark would start a task for each folder, up to 10,000 of them."""
    tasks = "spark.sql.sources.parallelPartitionDiscovery.parallelism"
    before = spark.conf.get(tasks)
    spark.conf.set(tasks, str(4 * spark.sparkContext.defaultParallelism))
    try:
        return load()
    finally:
        spark.conf.set(tasks, before)


def _text(spark: SparkSession, path: str, glob: str | None, **options) -> DataFrame:
    reader = spark.read.option("recursiveFileLookup", True)
    reader = reader.option("pathGlobFilter", glob) if glob else reader
    return listed(spark, lambda: reader.text(path, **options))


def bound(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each made once for each row where it stands.

    Of a plain column, filters and projections of its parts make a copy in each place that names it, and filters are moved below
    a repartition with all that they need. The rows of an array of one stay as they are.
    """
    for name, column in columns.items():
        df = df.select("*", F.explode(F.array(column)).alias(name))
    return df


#: Files of up to so many bytes are read as one row, whose lines are an array in a task's memory; larger ones by splits.
WHOLE = 1 << 20


def true_path(path: Column) -> Column:
    """The path that a file really has: _metadata.file_path is percent-encoded (binaryFile's path isn't), and its scheme goes for local files.

    Bytes are decoded from their %XX alone; a plus stays a plus.
    """
    return F.regexp_replace(F.url_decode(F.replace(path, F.lit("+"), F.lit("%2B"))), "^file:/*", "/")


def named(*more: Column) -> list[Column]:
    """file_path and file_name of the file that a row comes from, and more columns."""
    return [true_path(F.col("_metadata.file_path")).alias("file_path"), F.regexp_extract(true_path(F.col("_metadata.file_path")), r"([^/]*)$", 1).alias("file_name"), *more]


def read_lines(spark: SparkSession, path: str, glob: str | None = None, whole: int = WHOLE) -> DataFrame:
    """(file_path, file_name, line_no, line) of all files; lines end at a line feed, a carriage return before it is no part of them, and are numbered from 1. The end of a file's last line begins no further one.

    Files of up to whole bytes are rows that are split, so that lines keep their numbers without a shuffle. Larger ones are
    read by splits: a line's number is its place in its split plus the lines of the splits before. A task reads a split's
    lines one after another, so that the least of its rising ids gives the place; lines are neither sorted nor
    shuffled, but meet a row for each split, of which there are as many as the driver plans tasks. A file that can't be split
    (compressed) is one split.
    """
    # Paths are decoded once for each file or split, before its lines are told apart.
    small = _text(spark, path, glob, wholetext=True).filter(F.col("_metadata.file_size") <= whole).filter("value != ''").select(*named(F.col("value")))
    rows = small.select("file_path", "file_name", F.posexplode(F.split(F.regexp_replace("value", r"\n\z", ""), "\n")).alias("pos", "line"))
    strip = F.regexp_replace("line", r"\r\z", "").alias("line")
    rows = rows.select("file_path", "file_name", (F.col("pos") + 1).cast("long").alias("line_no"), strip)
    splits = _text(spark, path, glob, lineSep="\n").filter(F.col("_metadata.file_size") > whole)
    splits = splits.select(F.col("_metadata.file_path").alias("_path"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("n"), F.col("value").alias("line"))
    counts = splits.groupBy("_path", "block").agg(F.count("*").alias("lines"), F.min("n").alias("first"))
    before = counts.select("_path", true_path(F.col("_path")).alias("file_path"), "block", "first", (F.sum("lines").over(Window.partitionBy("_path").orderBy("block")) - F.col("lines")).alias("before"))
    before = before.withColumn("file_name", F.regexp_extract("file_path", r"([^/]*)$", 1))
    numbered = splits.join(F.broadcast(before), ["_path", "block"])
    large = numbered.select("file_path", "file_name", (F.col("before") + F.col("n") - F.col("first") + 1).alias("line_no"), strip)
    return rows.unionByName(large)


def bytes_of(spark: SparkSession, path: str) -> int:
    """Bytes of all files below path, by a listing."""
    files = listed(spark, lambda: spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path))
    return files.agg(F.coalesce(F.sum("length"), F.lit(0))).first()[0]


def whole_files(spark: SparkSession, path: str, glob: str | None = None) -> DataFrame:
    """(file_path, file_name, text) of each file."""
    files = _text(spark, path, glob, wholetext=True)
    return files.select(*named(F.col("value").alias("text")))
