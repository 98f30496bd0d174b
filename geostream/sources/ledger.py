"""Several tables that batches are published to together: a ledger names the batches that count, readers see all of a batch or nothing.

A batch is written to folders of its own, one in each table, and then named in the ledger by one new file. What a
crash leaves before that is named nowhere; the batch that is run again writes over it. Compaction rewrites what is published into one
folder a table and names that, by one file again.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.sources.sinks import first_of_keys


#: How entries of compactions begin; no batch may.
PACKED = "upto-"


class Table(NamedTuple):
    """Key columns, the time by whose day rows are partitioned, and what orders rows of equal keys within a batch."""

    keys: Sequence[str]
    time: str
    order: Sequence[str] = ()


class Folder:
    """What Hadoop's file systems do with a folder, and files that are there whole or not at all."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self.system = self.path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def uri(self, name: str) -> str:
        return f"{self.root}/{name}" if name else self.root

    def path(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(self.uri(name))

    def exists(self, name: str) -> bool:
        return self.system.exists(self.path(name))

    def delete(self, name: str) -> None:
        self.system.delete(self.path(name), True)

    def names(self, name: str) -> list[str]:
        """Sorted names in a folder, without hidden ones."""
        return sorted(x for x in (f.getPath().getName() for f in self.system.listStatus(self.path(name))) if x[0] not in "._") if self.exists(name) else []

    def lines(self, name: str) -> list[str]:
        return [r[0] for r in self.spark.read.text(self.uri(name)).collect()]

    def publish(self, folder: str, name: str, lines: Sequence[str] = ()) -> None:
        """One new file, by rename: the first to name it has named it."""
        draft, final = self.path(f"{folder}/.{name}"), self.path(f"{folder}/{name}")
        out = self.system.create(draft, True)
        out.write(bytearray("".join(f"{x}\n" for x in lines).encode()))
        out.close()
        if self.system.exists(final) or not self.system.rename(draft, final):
            raise FileExistsError(f"{self.uri(folder)}/{name} is there already")


class Ledger:
    def __init__(self, spark: SparkSession, root: str, tables: Mapping[str, Table]):
        self.spark, self.folder, self.tables = spark, Folder(spark, root), dict(tables)

    def _folder(self, table: str, entry: str) -> str:
        return f"{table}/batch={entry}"

    def _entries(self) -> list[str]:
        return self.folder.names("_ledger")

    def published(self) -> list[str]:
        """Entries that count: the last compaction and the batches after it."""
        entries = self._entries()
        packed = [x for x in entries if x.startswith(PACKED)]
        with_it = set(self.folder.lines(f"_ledger/{packed[-1]}")) if packed else set()
        return [*packed[-1:], *[x for x in entries if not x.startswith(PACKED) and x not in with_it]]

    def read(self, table: str) -> DataFrame | None:
        """The published rows of a table, None before the first batch with rows of it."""
        folders = [self.folder.uri(f) for f in (self._folder(table, x) for x in self.published()) if self.folder.exists(f)]
        return self.spark.read.option("basePath", self.folder.uri(table)).parquet(*folders).drop("batch") if folders else None

    def _write(self, rows: DataFrame, name: str, entry: str) -> None:
        """rows in their folder of a table, in place of what a lost attempt left there; no folder if there are none."""
        folder = self._folder(name, entry)
        self.folder.delete(folder)
        rows.sortWithinPartitions("obs_date", *self.tables[name].keys).write.partitionBy("obs_date").parquet(self.folder.uri(folder))
        if not self.folder.names(folder):
            self.folder.delete(folder)

    def append(self, batch: str, rows: Mapping[str, DataFrame]) -> bool:
        """Publish a batch: of each table its rows whose keys no published row has, of equal keys the first; False if it has been published before."""
        if batch.startswith(PACKED):
            raise ValueError(f"a batch can't be named {batch}")
        if batch in self._entries():
            return False
        for name, df in rows.items():
            table = self.tables[name]
            new, there = first_of_keys(df, table.keys, table.order).withColumn("obs_date", F.to_date(table.time)), self.read(name)
            if there is not None:
                days = new.select("obs_date").distinct()
                new = new.join(there.join(days, "obs_date", "left_semi").select(*table.keys), list(table.keys), "left_anti")
            self._write(new, name, batch)
        self.folder.publish("_ledger", batch)
        return True

    def compact(self, label: str) -> str:
        """Rewrite what is published into one folder a table and publish that in its place; label sorts behind earlier ones. Returns its entry."""
        folders, entry = self.published(), f"{PACKED}{label}"
        if entry in folders:
            raise ValueError(f"{entry} is published already")
        done = set(folders)
        for x in folders[:1]:
            done |= set(self.folder.lines(f"_ledger/{x}")) if x.startswith(PACKED) else set()
        for name in self.tables:
            rows = self.read(name)
            if rows is not None:
                self._write(rows.repartition("obs_date"), name, entry)
        self.folder.publish("_ledger", entry, sorted(done))
        return entry

    def clean(self) -> list[str]:
        """Delete folders of batches that are published no more, and return them; for a time without readers of an older state and without a batch on its way."""
        keep, gone = {f"batch={x}" for x in self.published()}, []
        for name in self.tables:
            for x in self.folder.names(name):
                if x not in keep and x.startswith("batch="):
                    self.folder.delete(f"{name}/{x}")
                    gone.append(f"{name}/{x}")
        return sorted(gone)


def replace_file(df: DataFrame, folder: str, name: str) -> None:
    """Put a table of a few rows into folder as one file, by a rename over the one before: a reader finds the old or the new."""
    spark, there = df.sparkSession, Folder(df.sparkSession, folder)
    df.coalesce(1).write.mode("overwrite").parquet(there.uri("_draft"))
    fs = spark._jvm.org.apache.hadoop.fs
    files = fs.FileContext.getFileContext(there.system.makeQualified(there.path("")).toUri(), spark._jsc.hadoopConfiguration())
    part = next(x for x in there.names("_draft") if x.startswith("part-"))
    how = spark.sparkContext._gateway.new_array(fs.Options.Rename, 1)
    how[0] = fs.Options.Rename.OVERWRITE
    files.rename(there.system.makeQualified(there.path(f"_draft/{part}")), there.system.makeQualified(there.path(name)), how)
    there.delete("_draft")
