"""Quality by nearest-neighbour voting over latent-semantic vectors."""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from geostream.llm.common import held_out, label_sample, quoted

BITS = 11
SHAPES = 9
BINS = 12
WIDTH = (1 << BITS) + SHAPES * BINS


def terms(text: str) -> np.ndarray:
    """Term frequencies of a whole text: hashed character 3-grams by shape-preserving code point, and binned text shapes.

    Shapes are the shares of upper case, digits, symbols, blanks, long lines, repeated lines, repeated words, the share
    of the most frequent word, and distinct 3-grams against what their number would give.
    """
    code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = np.zeros(WIDTH, np.float32)
    n = len(code)
    if n >= 3:
        three = (code[:-2] * np.uint32(0x9E3779B1) + code[1:-1]) * np.uint32(0x85EBCA6B) + code[2:]
        at = (three ^ (three >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> np.uint32(32 - BITS)
        out[: 1 << BITS] = np.sqrt(np.bincount(at, minlength=1 << BITS))
    low = np.bincount(np.minimum(code, 128), minlength=129)
    words, lines = text.split(), text.split("\n")
    times = Counter(words)
    shapes = (
        low[65:91].sum() / n,
        low[48:58].sum() / n,
        (low[33:48].sum() + low[58:65].sum() + low[91:97].sum() + low[123:127].sum()) / n,
        (low[32] + low[9:14].sum()) / n,
        min(1.0, n / len(lines) / 2000),
        1 - len(set(lines)) / len(lines),
        1 - len(times) / max(1, len(words)),
        max(times.values(), default=0) / max(1, len(words)),
        np.count_nonzero(out[: 1 << BITS]) / min(n, 1 << BITS),
    )
    out[(1 << BITS) + np.arange(SHAPES) * BINS + np.minimum((np.sqrt(np.array(shapes)) * BINS).astype(int), BINS - 1)] = 1
    return out


def _sample(batches):
    for batch in batches:
        kept = [(int(label), terms(text).astype(np.float16).tobytes()) for label, text in zip(batch.column("label").to_pylist(), batch.column("text").to_pylist()) if text]
        yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in kept], pa.int32()), pa.array([x[1] for x in kept], pa.binary())], ["label", "terms"])


class Model:
    """Projection into the latent space and the labelled vectors there; a few MB whatever the corpus."""

    def __init__(self, labels: np.ndarray, counts: np.ndarray, rank: int, neighbours: int, seed: int = 3):
        self.neighbours, self.prior = neighbours, float(labels.mean()) if len(labels) else 0.5
        self.labels = labels.astype(np.float32)
        df = (counts > 0).sum(0)
        self.idf = np.log((1 + len(counts)) / (1 + df)).astype(np.float32) + 0.05
        if not len(labels):
            self.axes, self.vectors = np.zeros((WIDTH, 1), np.float32), np.zeros((0, 1), np.float32)
            return
        x = self.weigh(counts)
        rng = np.random.default_rng(seed)
        rank = min(rank, *x.shape)
        basis = x.T @ (x @ rng.standard_normal((WIDTH, rank + 8)).astype(np.float32))
        for _ in range(3):
            basis = x.T @ (x @ np.linalg.qr(basis)[0])
        basis = np.linalg.qr(basis)[0]
        _, _, axes = np.linalg.svd(x @ basis, full_matrices=False)
        self.axes = np.ascontiguousarray((basis @ axes[:rank].T).astype(np.float32))
        self.vectors = self.latent(x)

    def weigh(self, counts: np.ndarray) -> np.ndarray:
        """Term weights: both halves, 3-grams and shapes, with length 1."""
        x = counts.astype(np.float32) * self.idf
        for part in (x[:, : 1 << BITS], x[:, 1 << BITS :]):
            part /= np.maximum(np.linalg.norm(part, axis=1, keepdims=True), 1e-6)
        return x

    def latent(self, x: np.ndarray) -> np.ndarray:
        y = x @ self.axes
        return y / np.maximum(np.linalg.norm(y, axis=1, keepdims=True), 1e-6)

    def score(self, counts: np.ndarray) -> np.ndarray:
        """Votes of the nearest labelled vectors by exact cosine, weighted by a steep function of similarity."""
        if not len(self.labels):
            return np.full(len(counts), self.prior)
        near = self.latent(self.weigh(counts)) @ self.vectors.T
        k = min(self.neighbours, near.shape[1])
        at = np.argpartition(-near, k - 1, axis=1)[:, :k]
        value = np.take_along_axis(near, at, 1).astype(np.float64)
        weight = np.exp(20 * (value - value.max(1, keepdims=True)))
        return (weight * self.labels[at]).sum(1) / weight.sum(1)


def fit(labelled: DataFrame, rank: int = 64, neighbours: int = 15) -> Model:
    """labelled: doc_id, text and label (0 or 1), a bounded sample whose vectors the driver can hold (see label_sample)."""
    rows = labelled.select("text", F.col("label").cast("int").alias("label")).filter("label in (0, 1)").mapInArrow(_sample, "label int, terms binary").toPandas().sort_values(["terms", "label"])
    counts = np.frombuffer(b"".join(rows["terms"]), np.float16).reshape(-1, WIDTH)
    return Model(rows["label"].to_numpy(), counts, rank, neighbours)


def _score(shared, name: str, with_text: bool, block: int = 256):
    def run(batches):
        model = shared.value
        for batch in batches:
            texts, score = batch.column("text"), np.zeros(batch.num_rows)
            for first in range(0, batch.num_rows, block):
                part = [x.as_py() for x in texts[first : first + block]]
                full = [i for i, x in enumerate(part) if x]
                if full:
                    score[first + np.array(full)] = model.score(np.stack([terms(part[i]) for i in full]))
            out = batch if with_text else batch.drop_columns(["text"])
            yield pa.RecordBatch.from_arrays([*out.columns, pa.array(score, pa.float64())], [*out.schema.names, name])

    return run


def score(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",), name: str = "score") -> DataFrame:
    """The kept columns and the score in [0, 1] of every row, by its whole text; a null or empty text has score 0.

    Repeated rows get the same score; no rows: no rows; without any label learned, every text has score 0.5.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    with_text = "text" in keep
    safe = ["text" if c == "text" else f"keep_{i}" for i, c in enumerate(keep)]  # mapInArrow takes no dots in names
    docs = docs.select(*[c.alias(s) for c, s in zip(quoted(keep), safe)], *([] if with_text else ["text"]))
    schema = StructType([*docs.select(*safe).schema.fields, StructField("score", DoubleType())])
    return docs.mapInArrow(_score(shared, "score", with_text), schema).toDF(*keep, name)


def classify(docs: DataFrame, labels: DataFrame, column: str = "quality", modulus: int = 3, remainder: int = 1, bad_docs: int = 1500, good_docs: int = 3500, **params) -> DataFrame:
    """doc_id, held_out, score, predicted. Labels are learned only from rows whose crc32(doc_id) mod modulus is not remainder,
    about bad_docs labelled 0 and good_docs labelled 1."""
    known = labels.filter(~held_out(F.col("doc_id"), modulus, remainder))
    model = fit(label_sample(docs, known, column, {0: bad_docs, 1: good_docs}), **params)
    marked = docs.select("doc_id", held_out(F.col("doc_id"), modulus, remainder).alias("held_out"), "text")
    return score(marked, model, ("doc_id", "held_out")).withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
