"""Sinks: keyed appends, files, reports, retention; each can be run again without doubling rows."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Sequence
from datetime import date, timedelta

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow.fs import FileType
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

from geostream.functions.times import calendar_decimal_year
from geostream.operators.series import strip_outliers
from geostream.sources.headers import _system, _whole
from geostream.sources.shared import staged

Sink = Callable[[DataFrame, int], None]


def first_of_keys(df: DataFrame, keys: Sequence[str], order: Sequence[str] = ()) -> DataFrame:
    """The first row of each key by order, which goes; ties, and rows without an order, by all other columns, so that it is always the same row. Groups are aggregated before any shuffle."""
    rest = [c for c in df.columns if c not in keys and c not in order]
    if not rest and not order:
        return df.dropDuplicates(list(keys))
    place = [x for c in order for x in (F.col(c).isNull(), F.col(c))]
    first = F.min_by(F.struct(*rest) if rest else F.lit(1), F.struct(*place, *rest)).alias("_first")
    grouped = df.groupBy(*keys).agg(first)
    kept = [c for c in df.columns if c in keys or c in rest]
    return grouped.select(*[F.col(c) if c in keys else F.col(f"_first.{c}").alias(c) for c in kept])


def _append(df: DataFrame, path: str, keys: Sequence[str], time: str, order: Sequence[str] = ()) -> None:
    """Append rows whose key is new, partitioned by obs_date; of equal keys the first of this batch by order (columns of df that aren't written).

    Only the days of the batch are read of the target.
    """
    rows = first_of_keys(df, keys, order).withColumn("obs_date", F.to_date(time))
    try:
        there = df.sparkSession.read.parquet(path)
    except AnalysisException:
        there = None
    if there is not None:
        days = rows.select("obs_date").distinct()
        rows = rows.join(there.join(days, "obs_date", "left_semi").select(*keys), list(keys), "left_anti")
    rows.sortWithinPartitions("obs_date", *keys).write.mode("append").partitionBy("obs_date").parquet(path)


def append_velocities(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """First write wins on (time, station_code)."""
    _append(df, path, ("time", "station_code"), "time", order)


def append_displacements(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """First write wins on (time, station_code)."""
    _append(df, path, ("time", "station_code"), "time", order)


def append_events(df: DataFrame, path: str, order: Sequence[str] = ()) -> None:
    """Keyed by (station_code, detection_time), so that replays add nothing."""
    _append(df, path, ("station_code", "detection_time"), "detection_time", order)


def fan_out(sinks: Sequence[Sink]) -> Sink:
    """One foreachBatch function that gives each batch to several sinks, computing it once."""
    def write(df: DataFrame, batch: int) -> None:
        df.persist()
        try:
            for sink in sinks:
                sink(df, batch)
        finally:
            df.unpersist()

    return write


def dry_run(df: DataFrame, mode: str = "noop") -> None:
    """Run without keeping: noop discards, console prints."""
    df.write.format(mode).mode("append").save()


#: Folders that one task writes.
FOLDERS = 256


def _folder(by: str, key) -> str:
    """The name of the folder of a value, as Spark writes it."""
    text = "__HIVE_DEFAULT_PARTITION__" if key is None or key == "" else re.sub(r"""[\x01-\x1f"#%'*/:=?\\\x7f{\[\]^]""", lambda m: f"%{ord(m[0]):02X}", str(key))
    return f"{by}={text}"


def write_folders(df: DataFrame, path: str, by: str, order: Sequence[str] = (), compression: str | None = None) -> None:
    """Column value of df (value, by) as lines, a folder by=... with one file for each value of by, its lines in order; what was at path goes.

    A task has some FOLDERS folders, however small they are: Spark would join small partitions by their bytes, though files
    cost by their number. Each file is written by its task under a hidden name and moved to its place, where the same task run again replaces it;
    lines pass in batches, no file is held. path is complete when this returns, not before.
    """
    spark, name = df.sparkSession, "part-00000.txt" + (".gz" if compression == "gzip" else "")
    whole = _whole(path)

    def run(batches):
        system, root, _ = _system(whole)
        out, now, n = None, None, 0

        def close():
            out.close()
            done = f"{root}/{_folder(by, now)}"
            if system.get_file_info(f"{done}/{name}").type == FileType.File:
                system.delete_file(f"{done}/{name}")
            system.move(f"{done}/{hidden}", f"{done}/{name}")

        hidden = f".{uuid.uuid4().hex}"
        for batch in batches:
            keys, values = batch.column(by), batch.column("value")
            runs = pc.run_end_encode(keys)
            at = 0
            for key, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist()):
                if out is None or key != now:
                    if out is not None:
                        close()
                    now, n = key, n + 1
                    system.create_dir(f"{root}/{_folder(by, key)}", recursive=True)
                    out = system.open_output_stream(f"{root}/{_folder(by, key)}/{hidden}", compression=compression)
                out.write("".join(f"{x}\n" for x in values.slice(at, end - at).to_pylist() if x is not None).encode())
                at = end
        if out is not None:
            close()
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    system, root, _ = _system(whole)
    if system.get_file_info(root).type == FileType.Directory:
        system.delete_dir_contents(root)
    system.create_dir(root, recursive=True)
    n = df.select(by).distinct().count()
    parts = max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n // FOLDERS))
    dealt = df.select("value", by).repartition(min(parts, max(1, n)), by).sortWithinPartitions(by, *order)
    dealt.mapInArrow(run, "n long").agg(F.sum("n")).collect()  # one row


def write_series(df: DataFrame, path: str) -> None:
    """A folder of blank-separated files for each site, and the site list."""
    rows = df.select("station", F.format_string("%.6f %.6f %.6f %.6f", "t", "east_m", "north_m", "up_m").alias("value"))
    write_folders(rows, f"{path}/series", "station", ("value",))
    df.select(F.col("station").alias("value")).distinct().orderBy("value").write.mode("overwrite").text(f"{path}/sites")


def write_outliers(df: DataFrame, path: str) -> None:
    """'SITE epoch' lines by site and epoch, four decimals."""
    df.orderBy("station", "t").select(F.format_string("%-4s %.4f", "station", "t").alias("value")).write.mode("overwrite").text(path)


def write_cleaned_series(original: DataFrame, selection: DataFrame, path: str) -> int:
    """Write the original less the selected epochs; returns how many rows went. Always from the original: running it again is the same."""
    cleaned = staged(strip_outliers(original, selection), "cleaned")
    write_series(cleaned, path)
    return original.count() - cleaned.count()


def write_velocity_report(df: DataFrame, path: str) -> None:
    """A line for each site and segment with velocities and their errors."""
    line = F.format_string("%-4s %2d  E %8.2f +- %6.2f  N %8.2f +- %6.2f  U %8.2f +- %6.2f", "station", "segment", *[c for a in "enu" for c in (f"v{a}_mm_yr", f"sig_v{a}_mm_yr")])
    df.orderBy("station", "segment").select(line.alias("value")).write.mode("overwrite").text(path)


def offset_lines(df: DataFrame) -> DataFrame:
    return df.orderBy("station_code", "event_date").select(F.format_string("%-4s %.4f %s", "station_code", calendar_decimal_year(F.col("event_date")), F.col("event_type")).alias("value"))


def export_offsets(df: DataFrame, path: str) -> None:
    """Offset events as 'SITE year TYPE' lines."""
    offset_lines(df).write.mode("overwrite").text(path)


def write_manifest(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, sep="\t", header=True)


def write_catalog(df: DataFrame, path: str, force: bool = False) -> None:
    """JSON lines; refuses to overwrite unless forced."""
    df.write.mode("overwrite" if force else "errorifexists").json(path)


def write_coverage(report: DataFrame, path: str) -> None:
    report.write.mode("overwrite").partitionBy("year").json(path)


def write_grid(scored: DataFrame, path: str) -> None:
    """Grid results by draw; a draw that is written again replaces itself."""
    scored.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("draw").parquet(path)


def append_best(best: DataFrame, path: str) -> None:
    write_grid(best, path)


def apply_retention(spark: SparkSession, path: str, as_of: str, days: int = 60) -> DataFrame:
    """The rows of the last days; older day partitions are pruned from the plan. drop_expired deletes them."""
    return spark.read.parquet(path).filter(F.col("obs_date") >= F.date_sub(F.lit(as_of).cast("date"), days))


def drop_expired(spark: SparkSession, path: str, as_of: str, days: int = 60) -> list[str]:
    """Delete the partitions obs_date of a table that are older than the last days, and return their dates; rows aren't read."""
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = root.getFileSystem(spark._jsc.hadoopConfiguration())
    first = (date.fromisoformat(as_of) - timedelta(days=days)).isoformat()
    gone = []
    for entry in system.listStatus(root):
        name, _, day = entry.getPath().getName().partition("=")
        if name == "obs_date" and day < first:
            system.delete(entry.getPath(), True)
            gone.append(day)
    return sorted(gone)


def write_segments(df: DataFrame, path: str, value: str, points: Sequence[tuple[str, str]]) -> None:
    """Map-ready segments: a header with the value and a line for each point (pairs of column names)."""
    lines = [F.format_string("> -Z%.4f", F.col(value))] + [F.format_string("%9.5f %9.5f", F.col(x), F.col(y)) for x, y in points]
    df.orderBy("row").select(F.concat_ws("\n", *lines).alias("value")).write.mode("overwrite").text(path)
