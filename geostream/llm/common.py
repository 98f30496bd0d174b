"""Shared folder, staged tables, word shingles and connected components used by the corpus operators."""

from __future__ import annotations

from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.sources.shared import scratch_path, shared_dir  # noqa: F401  the latter for the other modules

#: Words: runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return.
WORD = r"[^\x20\x09-\x0D]+"


_captured: list[list[str]] = []


@contextmanager
def captured(paths: list[str]):
    """Within it, the paths of staged tables are added to paths."""
    _captured.append(paths)
    try:
        yield
    finally:
        _captured.pop()


def _path(spark: SparkSession, path: str):
    """(file system, path) of a path in the JVM."""
    there = spark._jvm.org.apache.hadoop.fs.Path(path)
    return there.getFileSystem(spark._jsc.hadoopConfiguration()), there


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables that nothing reads any more, and forget them."""
    for path in paths:
        system, there = _path(spark, path)
        system.delete(there, True)
    paths.clear()


def scratch(spark: SparkSession, label: str) -> str:
    """A new folder in the shared one. It goes when the application ends, or earlier by release."""
    path = scratch_path(spark, label)
    for paths in _captured:
        paths.append(path)
    return path


def stage(df: DataFrame, label: str) -> DataFrame:
    """Write df to the shared folder and read it again: lineage ends here and a lost executor costs no recomputation."""
    spark = df.sparkSession
    path = f"{scratch(spark, label)}/table"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def quoted(names) -> list:
    """Columns by their names, whatever stands in them."""
    return [F.col("`" + n.replace("`", "``") + "`") for n in names]


def fold_ascii(col):
    """Lower-case A-Z and nothing else."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id, modulus: int, remainder: int):
    """True where crc32(doc_id as text) mod modulus is remainder; false for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(modulus)) == remainder, F.lit(False))


def label_sample(docs: DataFrame, labels: DataFrame, column: str, most: dict[int, int]) -> DataFrame:
    """doc_id, text and label of about most[label] documents of each label, those whose ids have the smallest hashes.

    The sample of ids is bounded by the parameter and so broadcast: the texts are scanned once and not shuffled.
    """
    known = labels.select("doc_id", F.col(column).cast("int").alias("label")).filter(F.col("label").isin(*most))
    sizes = {r[0]: r[1] for r in known.groupBy("label").count().collect()}
    shares = F.create_map(*[F.lit(float(x)) if i else F.lit(x) for label in sorted(most) for i, x in enumerate((label, min(1.0, most[label] / sizes.get(label, 1))))])
    ids = known.filter((F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) / float(1 << 20)) < F.element_at(shares, F.col("label")))
    return docs.select("doc_id", "text").join(F.broadcast(ids), "doc_id")


def binary_column(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets (int64) and bytes of a string column; null counts as empty."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    col = (col.fill_null("") if col.null_count else col).cast(pa.large_binary())
    if not len(col):
        return np.zeros(1, np.int64), np.zeros(0, np.uint8)
    offsets = np.frombuffer(col.buffers()[1], np.int64)[col.offset : col.offset + len(col) + 1]
    data = col.buffers()[2]
    return offsets, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def blocks(offsets: np.ndarray, size: int):
    """Ranges of rows of about size bytes each; a longer row has a range of its own."""
    first, rows = 0, len(offsets) - 1
    while first < rows:
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + size, "right")) - 1)
        yield first, last
        first = last


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finalizer (two xor-shift-multiply rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Shingler:
    """Distinct word-shingle hashes of many texts at once, by prefix sums of a polynomial hash over the bytes.

    A-Z are lower-cased. A text with fewer words than width has its whole sequence as its one shingle; a text
    without words has none.
    """

    def __init__(self, width: int = 5, block: int = 1 << 18):
        self.width, self.block = width, block
        rng = np.random.default_rng(20240229)
        self.byte = rng.integers(1, 1 << 63, size=256, dtype=np.uint64)
        self.byte[65:91] = self.byte[97:123]
        self.space = np.zeros(256, bool)
        self.space[[9, 10, 11, 12, 13, 32]] = True
        self.base = 0x9E3779B97F4A7C15
        self.inverse = pow(self.base, -1, 1 << 64)
        self.up = self.down = np.ones(0, np.uint64)

    def _powers(self, n: int) -> None:
        if len(self.up) < n:
            full = np.full(n, self.base, np.uint64)
            full[0] = 1
            self.up = np.cumprod(full)
            full[1:] = self.inverse
            self.down = np.cumprod(full)

    def words(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Hash of each word, and where each row's words begin. data holds the rows back to back, offsets start at 0."""
        n = len(data)
        if not n:
            return np.zeros(0, np.uint64), np.zeros(len(offsets), np.int64)
        self._powers(n + 1)
        inside = ~self.space[data]
        edge = np.zeros(n + 1, bool)
        edge[offsets] = True
        before = np.empty(n, bool)
        before[0] = False
        before[1:] = inside[:-1]
        start = np.flatnonzero(inside & (~before | edge[:n]))
        after = np.empty(n, bool)
        after[-1] = False
        after[:-1] = inside[1:]
        end = np.flatnonzero(inside & (~after | edge[1:])) + 1
        prefix = np.zeros(n + 1, np.uint64)
        np.cumsum(self.byte[data] * self.up[:n], out=prefix[1:])
        hashed = mix64((prefix[end] - prefix[start]) * self.down[start] + (end - start).astype(np.uint64))
        return hashed, np.searchsorted(start, offsets)

    def rows(self, column: pa.Array):
        """Yield the sorted distinct shingle hashes of each row."""
        offsets, data = binary_column(column)
        for first, last in blocks(offsets, self.block):
            own = offsets[first : last + 1] - offsets[first]
            word, at = self.words(data[offsets[first] : offsets[last]], own)
            hashed = np.zeros(0, np.uint64)
            if len(word) >= self.width:
                hashed = word[: len(word) - self.width + 1].copy()
                for j in range(1, self.width):
                    hashed *= np.uint64(0xC2B2AE3D27D4EB4F)
                    hashed += word[j : len(word) - self.width + 1 + j]
                hashed = mix64(hashed)
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                if b - a >= self.width:
                    yield np.unique(hashed[a : b - self.width + 1])
                elif b > a:
                    h = np.uint64(b - a)
                    with np.errstate(over="ignore"):
                        for w in word[a:b]:
                            h = h * np.uint64(0xC2B2AE3D27D4EB4F) + w
                    yield mix64(np.array([h], np.uint64))
                else:
                    yield np.zeros(0, np.uint64)


def least_of_component(component: DataFrame, values: DataFrame) -> DataFrame:
    """(node, least) of the nodes of component (node, component): the smallest value, of values (node, value), in its component.

    Least values are a table of one row for each component, whose size Spark knows: it is broadcast if small, and else
    a component that holds many nodes is split by the join, at any size.
    """
    own = component.join(values, "node")
    least = stage(own.groupBy("component").agg(F.min("value").alias("least")), "least-of-component")
    return own.join(least, "component").select("node", "least")


def _stars(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges between the nodes a and b, as an edge from each node to the smallest that it reaches by them."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = place[: len(a)], place[len(a) :]
    least = np.arange(len(nodes))
    while True:
        new = least.copy()
        low = np.minimum(least[x], least[y])
        for end in (x, y, least[x], least[y]):
            np.minimum.at(new, end, low)
        new = new[new]
        if (new == least).all():
            break
        least = new
    own = np.flatnonzero(least != np.arange(len(nodes)))
    return nodes[own], nodes[least[own]]


def _contract(block: int):
    """Edges (hi, lo) of a task as stars, block edges at a time."""

    def run(batches):
        held, size = [], 0

        def close():
            hi, lo = _stars(*np.concatenate(held, axis=1))
            return pa.RecordBatch.from_arrays([pa.array(hi, pa.int64()), pa.array(lo, pa.int64())], ["hi", "lo"])

        for batch in batches:
            pairs = np.array([c.to_numpy(zero_copy_only=False) for c in batch.columns], np.int64)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if pairs.size:
                held.append(pairs)
                size += pairs.shape[1]
            if size > block:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return run


def _lower(batches):
    """Edges sorted by (hi, lo): each hi keeps the one to its smallest lo (own), its other lo get one to that."""
    last = least = before = None
    for batch in batches:
        own, nodes, tops = [], [], []
        for hi, lo in zip(batch.column("hi").to_pylist(), batch.column("lo").to_pylist()):
            if hi != last:
                own.append(True)
                nodes.append(hi)
                tops.append(lo)
                last, least = hi, lo
            elif lo != before:
                own.append(False)
                nodes.append(lo)
                tops.append(least)
            before = lo
        yield pa.RecordBatch.from_arrays([pa.array(own, pa.bool_()), pa.array(nodes, pa.int64()), pa.array(tops, pa.int64())], ["own", "hi", "lo"])


def connected_components(edges: DataFrame, block: int = 1 << 20) -> DataFrame:
    """(node, component) of the nodes of edges (a, b), component being the smallest node reached.

    In each round a task replaces its edges by stars, so that a node has at most one edge downwards in each block of a
    task, however many neighbours it has; then the edges of a node meet, sorted, and it keeps the smallest, to which the
    others now lead; then edges that end at a node with an edge of its own are led on to that one's end. Rounds end when
    all edges are stars. Edges into a hub are never gathered: they stay with their other ends, and the join that leads
    them on has one row for each node at most, which Spark broadcasts if it is small and else splits by skew. Nothing
    that grows with the input has to fit a task or reaches the driver. A round with its result is a staged table.
    """
    todo = edges.select(F.col("a").cast("long").alias("hi"), F.col("b").cast("long").alias("lo"))
    while True:
        stars = todo.mapInArrow(_contract(block), "hi long, lo long").repartition("hi").sortWithinPartitions("hi", "lo")
        now = stage(stars.mapInArrow(_lower, "own boolean, hi long, lo long"), "components")
        ends = now.filter("own").select(F.col("hi").alias("end"), F.col("lo").alias("next"))
        led = now.join(ends, F.col("lo") == F.col("end"), "left")
        if led.filter("next is not null or not own").isEmpty():
            break
        todo = led.select("hi", F.coalesce("next", "lo").alias("lo"))
    found = now.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
    return found.unionByName(found.select(F.col("component").alias("node"), "component").distinct())
