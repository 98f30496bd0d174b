"""Row numbers and running sums over a whole table, without a window over one partition."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostream.operators.series import dealt
from geostream.sources.shared import staged


def running_sum(df: DataFrame, order: Sequence[str], value: Column, name: str) -> DataFrame:
    """df with name, the sum of value over all rows up to each in order.

    Rows are dealt to tasks by ranges of the order columns, once and for all (a table in the shared folder), summed and the sums of the ranges before are added: one row for each task goes into the only unpartitioned window.
    """
    ranged = staged(df.withColumn("_value", value).repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ordered")
    totals = ranged.groupBy("_range").agg(F.sum("_value").alias("_total"))
    before = totals.select("_range", (F.sum("_total").over(Window.orderBy("_range")) - F.col("_total")).alias("_before"))
    inside = F.sum("_value").over(Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return ranged.join(F.broadcast(before), "_range").withColumn(name, F.col("_before") + inside).drop("_value", "_range", "_before")  # a row for each task


def number_rows(df: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """df with name, the place of each row in order, from 1."""
    return running_sum(df, order, F.lit(1).cast("long"), name)


def lead_by_ranges(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, offset: int, name: str, rows: int | None = None, each: int = 1 << 18) -> DataFrame:
    """df with name: value of the offset-th row after each in its group by, in order (without ties), null if there is none.

    No task holds a group: rows are dealt by ranges of about each rows, and a range is given the rows that follow it,
    of which heads holds offset for each range and group in it.
    """
    own, count = df.columns, df.count() if rows is None else rows
    tasks = max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), count // each)
    placed = staged(df.repartitionByRange(tasks, *by, *order).withColumn("_range", F.spark_partition_id()), "lead-ranges")
    here, group = Window.partitionBy("_range", *by).orderBy(*order), Window.partitionBy(*by).orderBy(*order)
    heads = dealt(placed, "_range", *by, rows=count, each=each).withColumn("_place", F.row_number().over(here)).filter(F.col("_place") <= offset)
    heads = heads.withColumn("_next", F.collect_list(F.struct(*own)).over(group.rowsBetween(0, offset - 1))).filter("_place = 1")
    heads = heads.withColumn("_to", F.lag("_range").over(group)).filter("_to is not null")
    after = heads.select(F.col("_to").alias("_range"), F.explode("_next").alias("_n")).select("_n.*", "_range", F.lit(True).alias("_after"))
    both = dealt(placed.withColumn("_after", F.lit(False)).unionByName(after), "_range", *by, rows=count, each=each)
    return both.withColumn(name, F.lead(value, offset).over(here)).filter("not _after").select(*own, name)
