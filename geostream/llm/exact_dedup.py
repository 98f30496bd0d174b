"""Exact dedup by an extendible-hash index on shared files.

A first scan counts the hash prefixes of all texts, from which the directory is made. Then each task folds its own copies: a row whose normalised bytes it has already seen points to that row, after a
comparison of the bytes. What is left (at most one row for each text and task) goes into the index: the directory of hash
prefixes is doubled until no bucket is overfull, an owner task takes each bucket, a contiguous range of hash keys, and
walks the chain of each key comparing bytes, so that a collision of hashes never merges different texts.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BinaryType, IntegerType, LongType, StringType, StructField, StructType

from geostream.llm.common import quoted, stage

_FOLD = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
_SIGN = 1 << 63

#: Rows that tasks write: a member (kind 0) for each row, an entry (kind 1) for each class of equal texts of a task.
_LONGS = ("kind", "doc_id", "row", "rep", "key", "n", "best", "best_row")
_NAMES = ("kind", "bucket", "doc_id", "row", "rep", "key", "sha", "n", "best", "best_row", "text")
ROWS = StructType([StructField(x, LongType() if x in _LONGS else IntegerType() if x == "bucket" else StringType() if x == "sha" else BinaryType()) for x in _NAMES])


def _better(a: tuple, b: tuple) -> tuple:
    """Of (doc_id or None, row, ...) the one that stays: the largest doc_id, then the first row."""
    return max(a, b, key=lambda x: (x[0] is not None, x[0] or 0, -x[1]))


def _batch(rows: list, schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def _folded(text: str | None) -> bytes:
    return (text or "").encode().translate(_FOLD)


def _count_task(depth: int, digest):
    """Number of texts by the first depth bits of their keys."""

    def run(batches):
        counts = np.zeros(1 << depth, np.int64)
        for batch in batches:
            keys = np.array([digest(_folded(text)) for text in batch.column(0).to_pylist()], np.uint64)
            np.add.at(counts, (keys >> np.uint64(64 - depth)).astype(np.int64), 1)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(counts[at], pa.int64())], ["prefix", "n"])

    return run


def _fold_task(keep_bytes: int, digest, schema: pa.Schema, shared):
    """Batches doc_id, text and the columns that the surviving row keeps, if any -> ROWS and those columns.

    shared: the directory, a bucket for each hash prefix.

    With such columns only entries are written, and the folded text is left to be made again from the kept one.
    """

    def run(batches):
        from pyspark import TaskContext

        base, count = TaskContext.get().partitionId() << 33, 0
        seen: dict[int, list] = {}
        held = 0

        buckets = shared.value
        shift = 64 - (len(buckets) - 1).bit_length()

        def flush():
            return _batch([(1, int(buckets[(key + _SIGN) >> shift]), None, None, rep, key, None, n, best[0], best[1], None if best[2:] else text, *best[2:]) for key, chain in seen.items() for text, rep, n, best, _ in chain], schema)

        for batch in batches:
            members = []
            for doc, text, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                text = _folded(text)
                key, row = digest(text) - _SIGN, base + count
                count += 1
                chain = seen.setdefault(key, [])
                own = next((x for x in chain if x[0] == text), None)
                if own is None:
                    own = [text, row, 0, (doc, row, *rest), hashlib.sha256(text).hexdigest()]
                    chain.append(own)
                    held += (1 + len(rest) // 2) * len(text) + 400
                own[2] += 1
                own[3] = _better(own[3], (doc, row, *rest))
                if not rest:
                    members.append((0, None, doc, row, own[1], None, own[4], None, None, None, None))
            yield _batch(members, schema)
            if held > keep_bytes:
                yield flush()
                seen.clear()
                held = 0
        yield flush()

    return run


def directory(counts: dict[int, int], depth: int, capacity: int) -> np.ndarray:
    """Bucket of each of the 2**depth hash prefixes, given the number of keys that each has.

    Begins with one bucket; an overfull bucket is split by its next bit, and the directory is doubled whenever the
    bucket that is split was as deep as the directory, up to depth.
    """
    own = np.zeros(1 << depth, np.int64)
    for prefix, n in counts.items():
        own[prefix] = n
    total = np.concatenate([[0], np.cumsum(own)])
    bucket, todo, ranges = np.zeros(1 << depth, np.int32), [(0, 1 << depth)], []
    while todo:
        lo, hi = todo.pop()
        if total[hi] - total[lo] > capacity and hi - lo > 1:
            todo += [((lo + hi) // 2, hi), (lo, (lo + hi) // 2)]
        else:
            ranges.append((lo, hi))
    for i, (lo, hi) in enumerate(sorted(ranges)):
        bucket[lo:hi] = i
    return bucket


def _chain_task(batches):
    """Entries sorted by key: the chain of the key at hand is held, one text for each class of equal texts."""
    names = ["rep", "keep_id", "keep_row", "group_size"]
    key, chain, members = None, [], []

    def close():
        return [(rep, own[1][0], own[1][1], own[2]) for rep, own in members]

    for batch in batches:
        out = []
        for k, rep, n, best, best_row, text in zip(*(batch.column(c).to_pylist() for c in ("key", "rep", "n", "best", "best_row", "text"))):
            if k != key:
                out += close()
                key, chain, members = k, [], []
            own = next((x for x in chain if x[0] == text), None)
            if own is None:
                chain.append(own := [text, (best, best_row), 0])
            own[1], own[2] = _better(own[1], (best, best_row)), own[2] + n
            members.append((rep, own))
        yield _batch(out, _CHAINED)
    yield _batch(close(), _CHAINED)


_CHAINED = pa.schema([(x, pa.int64()) for x in ("rep", "keep_id", "keep_row", "group_size")])


def _keep_task(schema: pa.Schema, text_at: int):
    """The same walk, yielding of each class the columns of the row that stays; the one at text_at is folded to compare."""

    def run(batches):
        key, chain = None, []
        for batch in batches:
            out = []
            for k, best, best_row, *rest in zip(*(c.to_pylist() for c in batch.columns)):
                text = _folded(rest[text_at])
                if k != key:
                    out += [own[1][2:] for own in chain]
                    key, chain = k, []
                own = next((x for x in chain if x[0] == text), None)
                if own is None:
                    chain.append([text, (best, best_row, *rest)])
                else:
                    own[1] = _better(own[1], (best, best_row, *rest))
            yield _batch(out, schema)
        yield _batch([own[1][2:] for own in chain], schema)

    return run


def _directory(rows: DataFrame, bucket_keys: int, max_depth: int, digest) -> np.ndarray:
    """The directory of rows (doc_id, text, ...), from one count for each of the 2**max_depth prefixes at most."""
    counted = rows.select("text").mapInArrow(_count_task(max_depth, digest), "prefix int, n long").groupBy("prefix").agg(F.sum("n").alias("n")).toPandas()
    return directory(dict(zip(counted["prefix"].tolist(), counted["n"].tolist())), max_depth, bucket_keys)


def _owned(entries: DataFrame, buckets: np.ndarray) -> DataFrame:
    """Entries dealt to the owners of their buckets and sorted by key; each owner has one bucket."""
    return entries.repartitionById(int(buckets.max()) + 1, "bucket").sortWithinPartitions("key").drop("bucket")


def exact_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 2000, max_depth: int = 18, keep_bytes: int = 64 << 20, digest=xxhash.xxh3_64_intdigest) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 of every row; texts are equal if identical after lower-casing A-Z.

    The row with the largest doc_id stays; of rows that repeat its doc_id too, one. A null text counts as empty, a null
    doc_id as smaller than any other. No rows: no rows. Other columns are ignored. bucket_keys: entries that a bucket
    holds before it is split. digest: text bytes -> unsigned 64-bit key, any; equal keys of different texts only chain.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    buckets = _directory(rows, bucket_keys, max_depth, digest)
    shared = docs.sparkSession.sparkContext.broadcast(buckets)
    rows = stage(rows.mapInArrow(_fold_task(keep_bytes, digest, to_arrow_schema(ROWS), shared), ROWS), "exact-index")
    entries = rows.filter("kind = 1").select("bucket", "key", "rep", "n", "best", "best_row", "text")
    chained = _owned(entries, buckets).mapInArrow(_chain_task, "rep long, keep_id long, keep_row long, group_size long")
    members = rows.filter("kind = 0").select("doc_id", "row", "rep", F.col("sha").alias("text_sha256"))
    return members.join(chained, "rep").select("doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "text_sha256")


def exact_survivors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", bucket_keys: int = 2000, max_depth: int = 18, keep_bytes: int = 64 << 20, digest=xxhash.xxh3_64_intdigest) -> DataFrame:
    """The rows that exact_groups keeps, with all their columns, straight from the owners of the index; nothing is staged.

    Nulls, empty and very long texts, repeated rows and ties are as in exact_groups; columns keep their names, whatever they
    are. No rows: no rows.
    """
    own = [(f"keep_{i}", f) for i, f in enumerate(docs.schema.fields)]
    schema = StructType([*ROWS.fields, *(StructField(name, f.dataType, True) for name, f in own)])
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *[c.alias(name) for c, (name, _) in zip(quoted(docs.columns), own)])
    buckets = _directory(rows, bucket_keys, max_depth, digest)
    shared = docs.sparkSession.sparkContext.broadcast(buckets)
    names = [name for name, _ in own]
    rows = rows.mapInArrow(_fold_task(keep_bytes, digest, to_arrow_schema(schema), shared), schema)
    entries = rows.select("bucket", "key", "best", "best_row", *names)
    kept = StructType(schema.fields[len(ROWS) :])
    out = _owned(entries, buckets).mapInArrow(_keep_task(to_arrow_schema(kept), docs.columns.index(text_col)), kept)
    return out.select(*[F.col(name).alias(f.name) for name, f in own])
