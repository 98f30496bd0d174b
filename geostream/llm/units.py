"""Buckets of rows that may belong together, cut into units of bounded size for blocked comparison inside tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def into_units(hits: DataFrame, chunk: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit, bucket, side, other, node, *keep) from rows (bucket, node, *keep) whose bucket has two rows at least.

    A bucket of up to chunk rows is one unit. A larger one is dealt into chunks and each pair of chunks is a unit, in
    which rows of one are compared with rows of the other (side and other: the row's chunk and the one it meets), so that
    every pair of a bucket meets exactly once and no task holds more than two chunks.
    """
    sizes = hits.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = hits.join(sizes, "bucket").withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    rows = rows.withColumn("side", F.pmod(F.xxhash64("node", F.lit(5)), F.col("chunks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    unit = F.xxhash64("bucket", F.least("side", "other"), F.greatest("side", "other"))
    return rows.select(unit.alias("unit"), "bucket", "side", "other", "node", *keep)


def home_units(hits: DataFrame, chunk: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit, bucket, chunks, deal, chunk, node, *keep): rows of buckets with two rows at least, in units of about chunk rows.

    A bucket of up to chunk rows is one unit. A larger one is dealt into chunks twice, each time anew: rows that belong
    together thus become one component although no unit sees all of them. A row is in two units at most.
    """
    sizes = hits.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1")
    rows = hits.join(sizes, "bucket").withColumn("chunks", F.ceil(F.col("size") / chunk).cast("int"))
    rows = rows.withColumn("deal", F.explode(F.sequence(F.lit(0), F.least(F.col("chunks") - 1, F.lit(1)))))
    rows = rows.withColumn("chunk", F.pmod(F.xxhash64("node", "bucket", "deal"), F.col("chunks")).cast("int"))
    return rows.select(F.xxhash64("bucket", "deal", "chunk").alias("unit"), "bucket", "chunks", "deal", "chunk", "node", *keep)


def strays_of(homes: DataFrame) -> DataFrame:
    """(bucket, largest, strays) of buckets with several groups: the largest one, and the number of rows that aren't in it."""
    groups = homes.groupBy("bucket", "group").agg(F.count("*").alias("n"))
    return groups.groupBy("bucket").agg(F.max_by("group", F.struct("n", "group")).alias("largest"), (F.sum("n") - F.max("n")).alias("strays")).filter("strays > 0")


def cross_units(homes: DataFrame, chunk: int, keep: tuple[str, ...] = ()) -> DataFrame:
    """(unit, side, chunk, node, group, *keep) in which the rows of a bucket meet those of its other chunks, for components.

    homes: rows of one deal with their group. Rows of the bucket's largest group needn't meet each other. The others, its
    strays, are dealt into chunks of their own, and each such chunk (side 2) meets each chunk of the bucket (side 0 the
    largest group, 1 strays). n rows with s strays make about 2 n s / chunk + n rows: in proportion to n where the bucket
    is one group but for some strays.
    """
    rows = homes.join(strays_of(homes), "bucket").withColumn("parts", F.ceil(F.col("strays") / chunk).cast("int")).withColumn("side", (F.col("group") != F.col("largest")).cast("int"))
    at_home = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).withColumn("host", F.col("chunk"))
    guests = rows.filter("side = 1").withColumn("side", F.lit(2)).withColumn("part", F.pmod(F.xxhash64("node", "bucket", F.lit(7)), F.col("parts")).cast("int"))
    guests = guests.withColumn("host", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).filter("host != chunk")
    return at_home.unionByName(guests).select(F.xxhash64("bucket", "host", "part").alias("unit"), "side", "chunk", "node", "group", *keep)


def dealt(rows: DataFrame, unit: str = "unit") -> DataFrame:
    """The rows of each unit together, in one task and in order.

    As many tasks as spark.sql.shuffle.partitions: the work behind them is CPU, which sizes in bytes don't tell.
    """
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return rows.repartition(tasks, unit).sortWithinPartitions(unit)


def by_unit(batches, names: tuple[str, ...], unit: str = "unit"):
    """Yield for each unit the columns names as lists, from batches sorted by unit."""
    last, held = None, []

    def close():
        return [sum((part[i] for part in held), []) for i in range(len(names))]

    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(unit).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]])
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
            if last is not None and key[a] != last:
                yield close()
                held = []
            last = key[a]
            held.append([batch.column(n)[a:b].to_pylist() for n in names])
    if held:
        yield close()


def longs(columns: list, names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(np.asarray(c, np.int64)) for c in columns], names)
