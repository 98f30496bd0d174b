"""Rollups kept as mergeable states, by a log of what new rows touch.

New rows, late ones too, are aggregated to states by bucket and logged under the name of their batch. A refresh merges the
log into the states of those days alone that it touches, writes these days anew beside the old ones and publishes both the new days
and the batches that are in them by one file: a batch counts once, whenever a refresh fails, and no raw row is needed again.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.sources.ledger import Folder
from geostream.sources.shared import staged

COMPONENTS = ("horizontal", "east", "north", "up")


def states(rows: DataFrame, width: str) -> DataFrame:
    """station_code, bucket, v_horizontal_max, sums and counts of the components, sample_count, and bucket_date of rows (time, station_code, v_...)."""
    sums = [x for c in COMPONENTS for x in (F.sum(f"v_{c}").alias(f"sum_{c}"), F.count(f"v_{c}").alias(f"n_{c}"))]
    grouped = rows.groupBy("station_code", F.window("time", width).start.alias("bucket")).agg(F.max("v_horizontal").alias("v_horizontal_max"), *sums, F.count("*").alias("sample_count"))
    return grouped.withColumn("bucket_date", F.to_date("bucket"))


def merged(parts: DataFrame, width: str | None = None) -> DataFrame:
    """States of equal buckets as one; width: in coarser buckets."""
    bucket = F.col("bucket") if width is None else F.window("bucket", width).start
    sums = [F.sum(x).alias(x) for c in COMPONENTS for x in (f"sum_{c}", f"n_{c}")]
    grouped = parts.groupBy("station_code", bucket.alias("bucket")).agg(F.max("v_horizontal_max").alias("v_horizontal_max"), *sums, F.sum("sample_count").alias("sample_count"))
    return grouped.withColumn("bucket_date", F.to_date("bucket"))


def finished(state: DataFrame) -> DataFrame:
    """The columns of operators.telemetry.rollup."""
    means = [F.try_divide(f"sum_{c}", f"n_{c}").alias(f"v_{c}_avg") for c in COMPONENTS]
    return state.select("bucket", "station_code", "v_horizontal_max", *means, "sample_count")


class RollupStore:
    """States of one bucket width under a folder: log/batch=..., state/version=.../bucket_date=..., and the published versions."""

    def __init__(self, spark: SparkSession, root: str, width: str = "1 minute"):
        self.spark, self.width, self.folder = spark, width, Folder(spark, root)

    def log(self, batch: str, rows: DataFrame) -> None:
        """Note the rows of a batch; the same batch again replaces itself, and does nothing once it is in a refresh."""
        states(rows, self.width).write.mode("overwrite").parquet(self.folder.uri(f"log/batch={batch}"))

    def _published(self) -> tuple[int, dict[str, int], set[str]]:
        """(number of the last refresh, version of each day, batches that are in them)."""
        entries = self.folder.names("_published")
        if not entries:
            return 0, {}, set()
        lines = [line.split("\t") for line in self.folder.lines(f"_published/{entries[-1]}")]
        return int(entries[-1]), {day: int(version) for kind, day, version in lines if kind == "day"}, {batch for kind, batch, _ in lines if kind == "batch"}

    def _state(self, days: dict[str, int]) -> DataFrame | None:
        folders = [self.folder.uri(f"state/version={v}/bucket_date={d}") for d, v in sorted(days.items())]
        return self.spark.read.option("basePath", self.folder.uri("state")).parquet(*folders).drop("version") if folders else None

    def refresh(self) -> list[str]:
        """Merge the log into the states, and return the days that were written anew."""
        number, days, done = self._published()
        waiting = [x for x in self.folder.names("log") if x.removeprefix("batch=") not in done]
        if not waiting:
            return []
        news = self.spark.read.parquet(*[self.folder.uri(f"log/{x}") for x in waiting])
        touched = sorted(str(r[0]) for r in news.select("bucket_date").distinct().collect())  # a row for each day
        old = self._state({d: days[d] for d in touched if d in days})
        both = merged(news if old is None else news.unionByName(old.select(news.columns)))
        version = number + 1
        dealt = both.repartition("bucket_date").sortWithinPartitions("bucket_date", "station_code", "bucket")
        dealt.write.mode("overwrite").partitionBy("bucket_date").parquet(self.folder.uri(f"state/version={version}"))
        now = days | {d: version for d in touched}
        batches = {x.removeprefix("batch=") for x in waiting} | done
        self.folder.publish("_published", f"{version:012d}", [f"day\t{d}\t{v}" for d, v in sorted(now.items())] + [f"batch\t{b}\t-" for b in sorted(batches)])
        return touched

    def forget(self) -> None:
        """Delete what no reader of the published state needs: logged batches that are in it, and days that were written anew. Their names stay published."""
        _, days, done = self._published()
        for x in self.folder.names("log"):
            if x.removeprefix("batch=") in done:
                self.folder.delete(f"log/{x}")
        for version in self.folder.names("state"):
            for day in self.folder.names(f"state/{version}"):
                if day.startswith("bucket_date=") and days.get(day.removeprefix("bucket_date=")) != int(version.removeprefix("version=")):
                    self.folder.delete(f"state/{version}/{day}")

    def read(self, width: str | None = None) -> DataFrame | None:
        """The rollup as of the last refresh, in coarser buckets if width is given; None before the first."""
        state = self._state(self._published()[1])
        return None if state is None else finished(state if width is None else merged(state, width))


#: Days of a bitmap that one whole number holds while bitmaps are made: seven bytes; seven of them make up the 46 bytes and three more.
_WORD, _WORDS = 56, 7


def _bits(words: list[Column]) -> Column:
    """The 46 bytes of _WORDS whole numbers, the first byte of each being its highest."""
    return F.substring(F.concat(*[F.unhex(F.lpad(F.hex(F.coalesce(w, F.lit(0))), _WORD // 4, "0")) for w in words]), 1, 46)


def day_bits(days: DataFrame, by: tuple[str, ...] = ("station", "year")) -> DataFrame:
    """(by, bits): a bitmap of the days of year (doy, 1 to 366) of each station-year, 46 bytes; days may repeat. Null days don't count.

    Bits are gathered in whole numbers: Spark's bitmap aggregates have a buffer of 4 KB for each group.
    """
    day = F.col("doy").cast("long")
    place = (8 * (_WORD // 8 - 1 - F.floor(day % _WORD / 8)) + day % 8).cast("int")
    bit = F.call_function("shiftleft", F.lit(1).cast("long"), place)
    words = [F.bit_or(F.when(F.floor(day / _WORD) == k, bit)).alias(f"_w{k}") for k in range(_WORDS)]
    return days.filter(F.col("doy").between(1, 366)).groupBy(*by).agg(*words).select(*by, _bits([F.col(f"_w{k}") for k in range(_WORDS)]).alias("bits"))


def merged_bits(bits: DataFrame, by: tuple[str, ...] = ("station", "year")) -> DataFrame:
    word = lambda k: F.conv(F.rpad(F.hex(F.substring("bits", k * _WORD // 8 + 1, _WORD // 8)), _WORD // 4, "0"), 16, 10).cast("long")
    words = [F.bit_or(word(k)).alias(f"_w{k}") for k in range(_WORDS)]
    return bits.groupBy(*by).agg(*words).select(*by, _bits([F.col(f"_w{k}") for k in range(_WORDS)]).alias("bits"))


def days_of(bits) -> Column:
    """The days of a bitmap as a sorted array; bytes without a day cost one comparison."""
    at = lambda k: F.substring(bits, k + 1, F.lit(1))
    used = F.filter(F.sequence(F.lit(0), F.lit(45)), lambda k: at(k) != F.lit(b"\x00"))
    byte = F.transform(used, lambda k: F.struct(k.alias("k"), F.conv(F.hex(at(k)), 16, 10).cast("int").alias("b")))
    return F.flatten(F.transform(byte, lambda x: F.filter(F.sequence(x["k"] * 8, x["k"] * 8 + 7), lambda d: F.getbit(x["b"], d % 8) == 1)))


def append_days(spark: SparkSession, path: str, days: DataFrame) -> DataFrame:
    """Merge days (station, year, doy) into the bitmaps stored by year under path, and return those stored. Only years of new days are read and written; the same days again change nothing."""
    new = staged(day_bits(days), "day-bits")
    years = [r[0] for r in new.select("year").distinct().collect()]  # a row for each year
    folder = Folder(spark, path)
    old = [folder.uri(f"year={y}") for y in years if folder.exists(f"year={y}")]
    both = new if not old else new.unionByName(spark.read.option("basePath", folder.uri("")).parquet(*old).select("station", "year", "bits"))
    kept = staged(merged_bits(both), "day-bits-merged")
    if years:
        kept.repartition("year").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("year").parquet(folder.uri(""))
    return spark.read.schema("station string, bits binary, year int" if not years else kept.select("station", "bits", "year").schema).parquet(folder.uri("")) if folder.exists("") else kept
