"""Embedding near-dedup by spherical-cap filters of structured random product codes.

A filter direction is a pair of codewords, one for each half of the vector; a vector is listed under every direction whose
inner product with it exceeds the cap's height. Vectors listed under one filter are compared exactly, in blocks.
"""

from __future__ import annotations

from statistics import NormalDist

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import connected_components, least_of_component, stage
from geostream.llm.units import by_unit, dealt, into_units, longs


class ProductCode:
    """tables x words x words filter directions for vectors of dim components."""

    def __init__(self, dim: int, words: int, tables: int, listed: float, least: int, seed: int = 11):
        rng = np.random.default_rng([seed, dim])
        self.words, self.tables, self.least, self.half = words, tables, least, max(1, dim // 2)
        halves = [rng.standard_normal((tables, words, size), np.float32) for size in (self.half, max(1, dim - self.half))]
        self.left, self.right = (x / np.linalg.norm(x, axis=2, keepdims=True) for x in halves)
        # Each direction has length sqrt(2); its product with a random unit vector has variance 2 / dim.
        self.height = NormalDist().inv_cdf(1 - min(0.5, listed / words**2)) * (2 / dim) ** 0.5

    def decode(self, x: np.ndarray) -> list[np.ndarray]:
        """For each unit vector the sorted filters whose cap holds it; the best few if the cap holds it for fewer."""
        found: list[list] = [[] for _ in x]
        for t in range(self.tables):
            a = x[:, : self.half] @ self.left[t].T
            b = x[:, self.half :] @ self.right[t].T if x.shape[1] > self.half else np.zeros((len(x), self.words))
            order = np.argsort(-b, axis=1)
            for i, (p, q, at) in enumerate(zip(a, b, order)):
                # Of each left word, the right words in front are those that reach the height with it.
                n = np.searchsorted(-q[at], p - self.height, "right")
                left = np.flatnonzero(n)
                pairs = [l * self.words + at[: n[l]] for l in left]
                own = np.concatenate(pairs) if pairs else np.zeros(0, np.int64)
                if len(own) < self.least:
                    best = np.argsort(-p)[: self.least]
                    sums = (p[best][:, None] + q[at[: self.least]][None, :]).ravel()
                    top = np.argsort(-sums, kind="stable")[: self.least]
                    own = np.union1d(own, best[top // min(self.least, self.words)] * self.words + at[top % min(self.least, self.words)])
                found[i].append(own + t * self.words * self.words)
        return [np.sort(np.concatenate(f)) for f in found]


def _decode(words: int, tables: int, listed: float, least: int):
    def run(batches):
        codes: dict[int, ProductCode] = {}
        for batch in batches:
            nodes, vectors = batch.column("node").to_pylist(), [np.array(v, np.float64) for v in batch.column("vector").to_pylist()]
            filters: list = [None] * len(vectors)
            for dim in {len(v) for v in vectors}:
                rows = [i for i, v in enumerate(vectors) if len(v) == dim]
                x = np.stack([vectors[i] / np.abs(vectors[i]).max() for i in rows])
                x /= np.linalg.norm(x, axis=1, keepdims=True)
                code = codes.setdefault(dim, ProductCode(dim, words, tables, listed, least))
                for i, own in zip(rows, code.decode(x)):
                    filters[i] = (own << 28) + dim  # vectors of different length never meet
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), batch.column("n").cast(pa.int64()), pa.array([v.astype("<f8").tobytes() for v in vectors], pa.binary()), pa.array(filters, pa.list_(pa.int64()))], ["node", "n", "vector", "filters"])

    return run


def _components(linked: np.ndarray) -> np.ndarray:
    """Smallest row number that each row reaches by a symmetric boolean matrix."""
    n = len(linked)
    own = np.arange(n)
    while True:
        new = np.minimum(own, np.where(linked, own[None, :], n).min(1))
        new = new[new]
        if (new == own).all():
            return own
        own = new


def _compare(threshold: float):
    names = ("bucket", "side", "other", "node", "n", "vector", "filters")

    def run(batches):
        for bucket, side, other, node, n, vector, filters in by_unit(batches, names):
            if len(node) < 2:
                continue
            x = np.stack([np.frombuffer(v, "<f8") for v in vector])
            x = x / np.abs(x).max(1, keepdims=True)
            x /= np.linalg.norm(x, axis=1, keepdims=True)
            linked = x @ x.T >= threshold
            np.fill_diagonal(linked, False)
            if side[0] != other[0]:  # two chunks: pairs within either have a unit of their own
                side = np.array(side)
                linked &= side[:, None] != side[None, :]
            rows = np.flatnonzero(linked.any(1))
            if not len(rows):
                continue
            linked = linked[np.ix_(rows, rows)]
            # A pair counts under the smallest of the filters that list both.
            smaller = [[f for f in filters[r] if f < bucket[0]] for r in rows]
            place = {f: i for i, f in enumerate(sorted({f for s in smaller for f in s}))}
            owned = linked
            if place:
                listed = np.zeros((len(rows), len(place)), np.float32)
                for i, own in enumerate(smaller):
                    listed[i, [place[f] for f in own]] = 1
                owned = linked & (listed @ listed.T < 0.5)
            links = owned.astype(np.float64) @ np.array([n[r] for r in rows], np.float64)
            node = np.array(node)[rows]
            yield longs([node, np.rint(links), node[_components(linked)]], ["node", "links", "root"])

    return run


def code_size(classes: int, listed: float, tables: int) -> tuple[int, int]:
    """(words, tables) for a number of different vectors: filters list about 32 each, and tables make up for narrower caps.

    With twice as many words a pair at the threshold shares a filter of one table less often; a table more for each
    eightfold of words keeps the recall from falling.
    """
    words = 32
    while words * words * 32 < classes * listed:
        words *= 2
    return words, tables + max(0, int(np.log(words / 64) / np.log(8) + 1e-9))


def near_vectors(vectors: DataFrame, threshold: float = 0.95, id_col: str = "vec_id", vector_col: str = "embedding", tables: int = 2, listed: float = 10.0, least: int = 6, chunk: int = 1024) -> DataFrame:
    """vec_id, n_links, component_id, kept of every row.

    Links are pairs with cosine >= threshold in double precision; each found pair is verified, so none is below. Equal
    vectors are compared once and counted as often as they occur, repeated rows included. A vector that is null, empty,
    zero or holds null or non-finite components links with nothing; vectors of different length neither. component_id is
    the smallest vec_id reachable (of rows without id: the smallest there is, else null). No rows: no rows; other columns
    are ignored. listed: filters of a table that list a random vector on average; tables (for few vectors, see code_size)
    and listed set the recall, chunk the rows that meet in a task. A task holds the codes, 4 * tables * words * length bytes.

    Exact link counts need every pair within a cluster of near but different vectors: n of them are sent to n / chunk units
    in each filter that lists them, and n * n products are computed there. No counts are estimated to avoid that.
    """
    rows = vectors.select(F.col(id_col).alias("vec_id"), F.col(vector_col).alias("vector"))
    fine = F.forall("vector", lambda v: v.isNotNull() & (F.abs(v) < float("inf"))) & F.exists("vector", lambda v: v != 0)
    rows = rows.withColumn("fine", F.coalesce(fine, F.lit(False)))
    classes = stage(rows.filter("fine").groupBy("vector").agg(F.min("vec_id").alias("first"), F.count("*").alias("n")).withColumn("node", F.monotonically_increasing_id()), "vector-classes")
    words, tables = code_size(classes.count(), listed, tables)
    known = stage(dealt(classes.select("node", "n", "vector"), "node").mapInArrow(_decode(words, tables, listed, least), "node long, n long, vector binary, filters array<long>"), "vector-filters")
    hits = known.select(F.explode("filters").alias("bucket"), "node")
    meet = into_units(hits, chunk).join(known, "node")
    found = stage(dealt(meet).mapInArrow(_compare(threshold), "node long, links long, root long"), "vector-links")
    links = found.groupBy("node").agg(F.sum("links").alias("links"))
    component = stage(connected_components(found.filter("node != root").select(F.col("node").alias("a"), F.col("root").alias("b"))), "vector-components")
    of_node = least_of_component(component, classes.select("node", F.col("first").alias("value"))).withColumnRenamed("least", "component_id")
    of_class = classes.join(links, "node", "left").join(of_node, "node", "left").select("vector", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("n_links"), F.coalesce("component_id", "first").alias("component_id"))
    good = rows.filter("fine").join(of_class, "vector").select("vec_id", "n_links", "component_id")
    lone = rows.filter("not fine").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return good.unionByName(lone).withColumn("kept", F.col("vec_id").eqNullSafe(F.col("component_id")))
