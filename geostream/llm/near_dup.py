"""MinHash near-dedup by SetSketch registers.

A document is the set of its word shingles. Register j of its sketch is floor(1 - log_b(x)), x being the smallest of the
set's exponentially distributed hashes by function j, truncated to [0, q + 1]; sketches of parts merge by maximum. Bands
of registers propose pairs, the likelihood of the three counts (registers above, below, equal) estimates their
similarity, and pairs near the threshold are verified on the full sets. Sets are compared as sets of 64-bit hashes of
their shingles, and are taken for equal if their sizes and 128-bit fingerprints are.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import Shingler, connected_components, least_of_component, mix64, stage
from geostream.llm.units import by_unit, cross_units, dealt, home_units, longs, strays_of


class SetSketch:
    """Registers of sets of 64-bit hashes."""

    def __init__(self, size: int = 100, base: float = 1.001, rate: float = 20.0, top: int = (1 << 15) - 2, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.size, self.base, self.rate, self.top = size, base, rate, top
        self.multiply = rng.integers(1, 1 << 31, size=size, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
        self.add = rng.integers(0, 1 << 32, size=size, dtype=np.uint32)

    def registers(self, hashes: np.ndarray, part: int = 2048) -> np.ndarray:
        """Sketch of a set, built in parts and merged, so that a very long text needs no more memory than a part."""
        out = np.zeros(self.size, np.int16)
        high = (hashes >> np.uint64(32)).astype(np.uint32)
        for i in range(0, len(high), part):
            least = (high[i : i + part, None] * self.multiply + self.add).min(0)
            x = -np.log1p(-(least + 0.5) / 2.0**32) / self.rate
            out = self.merge(out, np.clip(np.floor(1 - np.log(x) / np.log(self.base)), 0, self.top + 1).astype(np.int16))
        return out

    @staticmethod
    def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return np.maximum(a, b)

    def likely(self, above: np.ndarray, below: np.ndarray, n_a, n_b, least: float) -> np.ndarray:
        """Whether the most likely similarity is at least least, given how many of a's registers are above and below b's,
        and both set sizes.

        The log-likelihood of the three counts is concave in the similarity, so its slope at least tells.
        """
        u = n_a / (n_a + n_b)
        v = 1 - u
        shrink, log_b = (self.base - 1) / self.base, np.log(self.base)
        x, y = u - v * least, v - u * least
        possible = (x >= 0) & (y >= 0)
        x, y = np.maximum(x, 0), np.maximum(y, 0)
        more, less = -np.log1p(-x * shrink) / log_b, -np.log1p(-y * shrink) / log_b
        d_more, d_less = -v * shrink / (1 - x * shrink) / log_b, -u * shrink / (1 - y * shrink) / log_b
        slope = (self.size - above - below) * -(d_more + d_less) / np.maximum(1 - more - less, 1e-12) + above * d_more / np.maximum(more, 1e-12) + below * d_less / np.maximum(less, 1e-12)
        return possible & (slope >= 0)


def _sketch(sketch: SetSketch, width: int):
    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            sizes, keys, registers = [], [], []
            for own in shingler.rows(batch.column(1)):
                sizes.append(len(own))
                keys.append(_fingerprint(own))
                registers.append(sketch.registers(own).tobytes() if len(own) > 1 else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64()), pa.array(keys, pa.binary()), pa.array(registers, pa.binary())], ["doc_id", "n_shingles", "set_key", "registers"])

    return run


def _fingerprint(own: np.ndarray) -> bytes:
    """128-bit fingerprint of a set, two sums over it, and its size."""
    return np.array([mix64(own).sum(dtype=np.uint64), mix64(own ^ np.uint64(0xA0761D6478BD642F)).sum(dtype=np.uint64), len(own)], np.uint64).tobytes()


class _Unit:
    """Rows of a unit of one band; finds the likely partners of one row at a time among those that it has to meet here.

    A pair meets in the first band that it shares only (in any, if band is negative). Rows of other chunks of the bucket (side 2) meet those at home;
    of two strays, the one with the smaller node is the guest.
    """

    def __init__(self, sketch: SetSketch, rows: int, least: float, band: int, registers: list, n: list, node: list, side: list):
        self.sketch, self.rows, self.least, self.band = sketch, rows, least, band
        self.registers = np.frombuffer(b"".join(registers), np.int16).reshape(len(registers), -1)
        self.n, self.node, self.side = np.array(n, np.float64), np.array(node), np.array(side)
        guests = np.flatnonzero(self.side == 2)
        self.turns = guests.tolist() if len(guests) else range(len(n) - 1)
        self.cross = bool(len(guests))

    def others(self, i: int) -> np.ndarray:
        """Rows that row i has to meet in its turn."""
        if not self.cross:
            return np.arange(i + 1, len(self.n))
        return np.flatnonzero((self.side == 0) | ((self.side == 1) & (self.node > self.node[i])))

    def partners(self, i: int, rows: np.ndarray) -> np.ndarray:
        """Those of rows that are likely similar to row i, the likeliest first."""
        if not len(rows):
            return rows
        there, own = self.registers[rows], self.registers[i]
        same = there == own
        equal = same.sum(1)
        keep = equal >= (self.least - 0.15) * self.sketch.size
        rows, there, same, equal = rows[keep], there[keep], same[keep], equal[keep]
        if not len(rows):
            return rows
        above = (own > there).sum(1)
        good = self.sketch.likely(above, self.sketch.size - equal - above, self.n[i], self.n[rows], self.least)
        bands = same[good].reshape(-1, self.sketch.size // self.rows, self.rows).all(2)
        first = bands[:, self.band] & ~bands[:, : self.band].any(1) if self.band >= 0 else bands.any(1)
        return rows[good][first][np.argsort(-equal[good][first], kind="stable")]


def _flag(sketch: SetSketch, rows: int, least: float):
    """Keep the rows of each unit that have a likely partner outside their group."""
    names = ("unit", "band", "side", "node", "n", "registers", "group")

    def run(batches):
        out: list[np.ndarray] = []
        for columns in by_unit(batches, names):
            _, band, side, node, n, registers, group = columns
            if len(n) < 2:
                continue
            unit, group, found = _Unit(sketch, rows, least, band[0], registers, n, node, side), np.array(group), np.zeros(len(n), bool)
            for i in unit.turns:
                # A pair of rows that both have a partner already tells nothing new.
                rest = unit.others(i)
                near = unit.partners(i, rest[(group[rest] != group[i]) & ~(found[rest] & found[i])])
                if len(near):
                    found[near] = found[i] = True
            if found.any():
                out.append(np.array([np.array(x, np.int64)[found] for x in (*columns[:4], group)]))
        if out:
            yield longs(list(np.concatenate(out, axis=1)), ["unit", "band", "side", "node", "group"])

    return run


def _verify(sketch: SetSketch, rows: int, least: float, width: int, numerator: int, denominator: int):
    """Links of a unit on full sets, as a forest: rows that other links join already need no test."""
    names = ("band", "side", "node", "n", "registers", "group", "text")

    def run(batches):
        shingler, edges = Shingler(width), []
        for band, side, node, n, registers, group, text in by_unit(batches, names):
            if len(n) < 2:
                continue
            unit, label, sets = _Unit(sketch, rows, least, band[0], registers, n, node, side), np.array(group), None
            for i in unit.turns:
                rest = unit.others(i)
                for j in unit.partners(i, rest[label[rest] != label[i]]).tolist():
                    if label[i] == label[j]:
                        continue
                    sets = list(shingler.rows(pa.array(text, pa.string()))) if sets is None else sets
                    common = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
                    if denominator * common >= numerator * (len(sets[i]) + len(sets[j]) - common):
                        edges.append((group[i], group[j]))
                        label[label == label[j]] = label[i]
        if edges:
            yield longs(list(zip(*edges)), ["a", "b"])

    return run


def _own_text(width: int):
    """Keep the rows whose text has the node's set (a doc_id may be repeated with other texts)."""

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            same = [key == _fingerprint(own) for key, own in zip(batch.column("set_key").to_pylist(), shingler.rows(batch.column("text")))]
            yield batch.filter(pa.array(same, pa.bool_())).select(["node", "text"])

    return run


#: Cells in which shingles are counted: the rarer ones are told from the frequent ones by so many counts at most.
CELLS = 18


def _count_cells(width: int):
    """Number of shingles in each cell, of a task's texts."""

    def run(batches):
        shingler, counts = Shingler(width), np.zeros(1 << CELLS, np.int64)
        for batch in batches:
            for own in shingler.rows(batch.column("text")):
                np.add.at(counts, (own >> np.uint64(64 - CELLS)).astype(np.int64), 1)
        cells = np.flatnonzero(counts)
        yield longs([cells, counts[cells]], ["cell", "n"])

    return run


def prefix_lengths(n: int, numerator: int, denominator: int) -> tuple[int, int]:
    """(probe, index): how many of the first of n shingles, in any order common to all sets, hold one that is common too.

    Of two sets with denominator * intersection >= numerator * union, their first common shingle is among the first probe
    of the larger one, as they share at least numerator / denominator of it, and among the first index of the smaller one,
    as they share at least 2 * numerator / (numerator + denominator) of that. Of equal sizes, either way round.
    """
    return n - -(-numerator * n // denominator) + 1, n - -(-2 * numerator * n // (numerator + denominator)) + 1


def _prefixes(width: int, counts: np.ndarray, numerator: int, denominator: int, most: int = 1 << 19):
    """The first shingles of each set, rarest cells first: (node, group, bucket, indexed)."""

    def run(batches):
        shingler = Shingler(width)
        for batch in batches:
            held, size = [], 0
            for node, group, own in zip(batch.column("node").to_pylist(), batch.column("group").to_pylist(), shingler.rows(batch.column("text"))):
                probe, index = prefix_lengths(len(own), numerator, denominator)
                first = own[np.lexsort((own, counts[(own >> np.uint64(64 - CELLS)).astype(np.int64)]))[:probe]]
                held.append([np.full(probe, node), np.full(probe, group), first.view(np.int64), np.arange(probe) < index])
                size += probe
                if size > most:
                    yield longs([np.concatenate(c) for c in zip(*held)], ["node", "group", "bucket", "indexed"])
                    held, size = [], 0
            if held:
                yield longs([np.concatenate(c) for c in zip(*held)], ["node", "group", "bucket", "indexed"])

    return run


def _by_rare_shingles(rows: DataFrame, width: int, numerator: int, denominator: int) -> DataFrame:
    """(bucket, node) of rows (node, group, text): buckets of a shingle in which rows of several groups may link.

    Whatever pair links has its first common shingle in the prefixes of both, so that none is lost; shingles that many sets
    share come last and are seldom there. The order goes by the counts of 2^CELLS cells of shingles, which reach the
    driver and the tasks; ties of cells only cost time.
    """
    counts = np.zeros(1 << CELLS, np.uint32)
    for cell, n in rows.select("text").mapInArrow(_count_cells(width), "cell long, n long").groupBy("cell").agg(F.sum("n").alias("n")).collect():
        counts[cell] = min(n, 0xFFFFFFFF)
    held = stage(rows.select("node", "group", "text").mapInArrow(_prefixes(width, counts, numerator, denominator), "node long, group long, bucket long, indexed long"), "sketch-prefixes")
    several = held.groupBy("bucket").agg(F.min("group").alias("least"), F.max("group").alias("most"), F.max("indexed").alias("indexed")).filter("least < most and indexed = 1")
    return held.join(several.select("bucket"), "bucket", "left_semi").select("bucket", "node")


def near_duplicates(docs: DataFrame, percent: int = 85, width: int = 5, rows: int = 5, bands: int = 20, first_bands: int = 4, slack: float = 0.15, chunk: int = 512) -> DataFrame:
    """doc_id, n_shingles, component_id and kept of every row.

    Texts are folded to lower case (A-Z), words are runs without ASCII white space, a document's set holds its distinct
    shingles of width words, or its whole sequence if it has fewer, or nothing if it has none or is null. Documents link
    if 100 * intersection >= percent * union; component_id is the smallest doc_id reachable by links. Equal sets are one
    node from the start, so that copies are neither compared nor paired. A row without doc_id takes part in no link: its
    component_id is null and it is kept. Rows that repeat a doc_id with equal texts agree. No rows: no rows; other columns
    are ignored. bands * rows registers: a pair at 85 % shares no band with a probability of 1e-5. slack: how far the
    estimate may lie below the threshold for a pair to be verified (4 standard deviations of it).

    Buckets have no cap. Their rows meet in units of about chunk rows; in a larger bucket, what its largest component does
    not hold then meets the other chunks (see units), so that a bucket of near copies costs in proportion to its rows. If
    that is more than a unit, as where texts share a template without linking, the bucket is split by the rarest shingles
    of its rows: only what shares one of them, as every pair that links does, and a band meets, and the cost is in
    proportion to the rows but for shingles that are in the prefixes of more than a unit of rows of several components.
    """
    sketch, threshold = SetSketch(rows * bands), percent / 100
    least = threshold - slack
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sets = stage(docs.mapInArrow(_sketch(sketch, width), "doc_id long, n_shingles long, set_key binary, registers binary"), "sketches")
    known = sets.filter("n_shingles > 0 and doc_id is not null")
    nodes = stage(known.groupBy("set_key").agg(F.min("doc_id").alias("first"), F.first("n_shingles").alias("n"), F.first("registers").alias("registers")).withColumn("node", F.monotonically_increasing_id()), "sketch-nodes")
    lean = nodes.select("node", "n", "registers")
    band = [F.struct(F.lit(k).alias("band"), F.xxhash64(F.substring("registers", 2 * rows * k + 1, 2 * rows), F.lit(k)).alias("bucket")) for k in range(bands)]
    hits = nodes.filter("registers is not null").select("node", F.explode(F.array(*band)).alias("x")).select("node", "x.band", "x.bucket")
    homes = stage(home_units(hits, chunk, ("band",)), "sketch-homes")

    def flagged(units: DataFrame) -> DataFrame:
        """Rows of units (unit, band, side, node, group) with a likely partner in another group."""
        return dealt(units.join(lean, "node")).mapInArrow(_flag(sketch, rows, least), "unit long, band long, side long, node long, group long")

    def texts_of(units: DataFrame) -> DataFrame:
        """The text of each node, that of its smallest doc_id."""
        some = units.select("node").distinct().join(nodes.select("node", "first", "set_key"), "node")
        texts = some.join(docs, F.col("first") == F.col("doc_id")).select("node", "text", "set_key")
        return stage(texts.mapInArrow(_own_text(width), "node long, text string").dropDuplicates(["node"]), "sketch-texts")

    def links(units: DataFrame, texts: DataFrame) -> DataFrame:
        return dealt(units.join(lean, "node").join(texts, "node")).mapInArrow(_verify(sketch, rows, least, width, percent, 100), "a long, b long")

    def grouped(units: DataFrame, component: DataFrame) -> DataFrame:
        """units with the component of each node as its group."""
        return units.drop("group").join(component, "node", "left").withColumn("group", F.coalesce("component", "node")).drop("component")

    def joined(component: DataFrame, more: DataFrame) -> DataFrame:
        return stage(connected_components(component.select(F.col("node").alias("a"), F.col("component").alias("b")).union(more)), "sketch-components")

    likely = stage(flagged(homes.select("unit", "band", F.lit(0).alias("side"), "node", F.col("node").alias("group"))), "sketch-likely")
    large = homes.filter("chunks > 1 and deal = 0")
    # Texts are fetched once: those of larger buckets may be wanted later on.
    texts = texts_of(likely.select("node").union(large.select("node")))
    component = stage(connected_components(links(likely.filter(F.col("band") < first_bands), texts)), "sketch-components")
    # The other bands matter only where they join what is still apart.
    rest = flagged(grouped(likely.filter(F.col("band") >= first_bands), component))
    component = joined(component, links(rest, texts))
    if not large.isEmpty():
        apart = stage(grouped(large, component), "sketch-apart")
        strays = strays_of(apart)
        few = apart.join(strays.filter(F.col("strays") <= chunk).select("bucket"), "bucket", "left_semi")
        across = stage(flagged(cross_units(few, chunk, ("band",))), "sketch-across")
        many = stage(apart.join(strays.filter(F.col("strays") > chunk).select("bucket"), "bucket", "left_semi").select("node", "group").distinct(), "sketch-many")
        more = links(across, texts)
        if many.isEmpty():
            component = joined(component, more)
        else:
            hits = _by_rare_shingles(many.join(texts, "node"), width, percent, 100).withColumn("band", F.lit(-1))
            homes = stage(home_units(hits, chunk, ("band",)), "sketch-rare-homes")
            likely = stage(flagged(grouped(homes.withColumn("side", F.lit(0)).select("unit", "band", "side", "node"), component)), "sketch-rare-likely")
            component = joined(component, more.union(links(likely, texts)))
            large = homes.filter("chunks > 1 and deal = 0")
            if not large.isEmpty():
                across = stage(flagged(cross_units(grouped(large, component), chunk, ("band",))), "sketch-rare-across")
                component = joined(component, links(across, texts))
    least_id = least_of_component(component, nodes.select("node", F.col("first").alias("value")))
    of_set = nodes.select("node", "set_key", "first").join(least_id, "node", "left").select("set_key", F.coalesce("least", "first").alias("component_id"))
    linked = known.select("doc_id", "n_shingles", "set_key").join(of_set, "set_key").select("doc_id", "n_shingles", "component_id")
    lone = sets.filter("n_shingles = 0 or doc_id is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return linked.unionByName(lone).withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
