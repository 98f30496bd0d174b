"""Audit of how document filters interact: what each removes at each place of every order.

A document's failures are a mask of bits, and a part of the corpus is at most 2**k cells (mask, count). A Gray-code walk over
the subsets of filters toggles one filter at a time; each cell counts the active filters that it fails, and the survivors
change by those cells alone whose counter leaves or reaches zero. The walk stores a state for each subset; a step of any order
is the difference of two states.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import stage

#: More filters than this have more orders (k!) than a report should hold.
MOST_FILTERS = 7


def words_of(text: Column) -> Column:
    """The runs of anything but blank, tab, line feed, vertical tab, form feed and carriage return."""
    return F.array_remove(F.split(F.translate(text, "\t\n\x0b\f\r", "     "), " "), "")


def failures(text: Column) -> dict[str, Column]:
    """The five filters by letter, E aside, as conditions on which a text fails; of an empty text only A holds."""
    return {
        "A": F.size(words_of(text)) < 50,
        "B": 100 * F.size(F.array_distinct(words_of(text))) < 65 * F.size(words_of(text)),
        "C": 100 * F.regexp_count(text, F.lit("[A-Z]")) > 5 * F.char_length(text),
        "D": F.regexp_like(text, F.lit(r"[#$%&*|]")),
    }


def mask_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic) of each document: bit i of mask is set if it fails the i-th filter of ABCDE.

    E fails if any document with a smaller id has the same text, in the whole table; a row without an id has no smaller one
    and is smaller than none, rows that share an id are not smaller than each other. A null text is empty, a null part an
    empty string. good and toxic: a row of labels for this id has quality 1, toxic 1; ids that labels repeat count once.
    Texts are read once and never shuffled: what moves is an id, a digest and a mask. Of the groups of equal texts only
    those of two or more are joined, from a table of known size; a group with a third of all rows is split by the join.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    own = [F.when(fails, F.lit(1 << i)).otherwise(F.lit(0)) for i, fails in enumerate(failures(F.col("text")).values())]
    slim = stage(rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("digest"), sum(own[1:], own[0]).alias("mask")), "audit-masks")
    groups = slim.groupBy("digest").agg(F.min("doc_id").alias("first"), F.count("*").alias("n"))
    copies = stage(groups.filter("n > 1 and first is not null").select("digest", "first"), "audit-copies")
    marked = slim.join(copies, "digest", "left").select("doc_id", "part", (F.col("mask") + F.when(F.col("doc_id") > F.col("first"), F.lit(16)).otherwise(F.lit(0))).alias("mask"))
    said = labels.groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic"))
    return marked.join(said, "doc_id", "left").select("part", "mask", F.coalesce("good", F.lit(False)).alias("good"), F.coalesce("toxic", F.lit(False)).alias("toxic"))


def walk(cells: np.ndarray, k: int) -> np.ndarray:
    """Survivors by subset: cells (parts, 2**k masks, values) -> (parts, 2**k subsets, values).

    The i-th step of the walk toggles the filter of i's lowest set bit. A cell survives while no active filter fails it.
    """
    masks = np.arange(1 << k)
    failing = np.zeros(1 << k, np.int64)
    alive = cells.sum(axis=1)
    out = np.empty_like(cells)
    out[:, 0] = alive
    subset = 0
    for i in range(1, 1 << k):
        bit = (i & -i).bit_length() - 1
        subset ^= 1 << bit
        touched = (masks >> bit & 1).astype(bool)
        if subset >> bit & 1:
            gone = touched & (failing == 0)
            failing[touched] += 1
            alive = alive - cells[:, gone].sum(axis=1)
        else:
            failing[touched] -= 1
            alive = alive + cells[:, touched & (failing == 0)].sum(axis=1)
        out[:, subset] = alive
    return out


def orders(names: Sequence[str]) -> list[tuple[str, list[int]]]:
    """(name, places of the filters) of every order of filters, by the order of names."""
    return [("".join(names[i] for i in order), list(order)) for order in permutations(range(len(names)))]


def _report(names: Sequence[str], values: Sequence[str]):
    k, every = len(names), orders(names)
    order = np.array([o for _, o in every])
    after = np.cumsum(1 << order, axis=1)
    before = after - (1 << order)

    def run(batches):
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            cells = np.stack([np.array(batch.column(v).to_pylist(), np.int64).reshape(m, 1 << k) for v in ("n", *values)], axis=2)
            state = walk(cells, k)
            lost = state[:, before] - state[:, after]  # parts, orders, steps, values
            single = cells[:, 1 << np.arange(k), 0]
            failing = state[:, [0], 0] - state[:, 1 << np.arange(k), 0]  # the filter alone removes all that fail it
            shares = np.stack([(lost[..., 0] * (order == f)).sum(axis=(1, 2)) for f in range(k)], axis=1)
            steps = len(every) * k
            columns = {
                "kept": state[:, after, 0], "removed": lost[..., 0], "redundant": failing[:, order] - lost[..., 0], "unique_fails": single[:, order],
                **{f"{v}_lost": lost[..., 1 + i] for i, v in enumerate(values)}, "shapley": shares[:, order],
            }
            parts = batch.column("part").to_pylist()
            yield pa.RecordBatch.from_arrays(
                [pa.array([p for p in parts for _ in range(steps)], pa.string()), pa.array([o for o, _ in every for _ in range(k)] * m, pa.string()), pa.array(list(range(1, k + 1)) * len(every) * m, pa.int32()), *[pa.array(c.ravel(), pa.int64()) for c in columns.values()]],
                ["part", "filter_order", "step", *columns])

    return run


def audit_orders(masks: DataFrame, names: Sequence[str], values: Mapping[str, Column]) -> DataFrame:
    """part, filter_order, step and counts of masks (part, mask, ...): a row for each part, order of the filters and step.

    kept: what is left after the step; removed: what it removes; redundant: what fails its filter but was removed before;
    unique_fails: what fails its filter and no other; {name}_lost of each condition in values: how many of removed it holds
    for; shapley: what its filter removes in all orders together. names: a letter for each bit of mask. Counts only; a part
    has one row of 2**k cells, whatever its size, pre-aggregated before any shuffle. No rows: no rows.
    """
    k = len(names)
    if not 1 <= k <= MOST_FILTERS:
        raise ValueError(f"from 1 to {MOST_FILTERS} filters can be audited")
    cells = masks.groupBy("part", "mask").agg(F.count("*").alias("n"), *[F.count_if(c).alias(v) for v, c in values.items()])
    wide = cells.groupBy("part").agg(*[F.array(*[F.coalesce(F.sum(F.when(F.col("mask") == i, F.col(v))), F.lit(0)) for i in range(1 << k)]).alias(v) for v in ("n", *values)])
    counts = ["kept", "removed", "redundant", "unique_fails", *[f"{v}_lost" for v in values], "shapley"]
    return wide.mapInArrow(_report(names, list(values)), "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in counts))


def audit(docs: DataFrame, labels: DataFrame, **columns: str) -> DataFrame:
    """The five filters over documents, by source, in all 120 orders; see mask_documents and audit_orders."""
    return audit_orders(mask_documents(docs, labels, **columns), "ABCDE", {"good": F.col("good"), "toxic": F.col("toxic")})
