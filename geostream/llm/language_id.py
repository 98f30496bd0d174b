"""Language ID: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import held_out

_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """For each code point, whether it is a letter."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def ngram_buckets(text: str | None, bits: int) -> np.ndarray | None:
    """Buckets of the 1- to 3-grams over lower-cased letters, other characters counting as a blank; None without letters."""
    if not text:
        return None
    code = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    letter = letters()[code]
    if not letter.any():
        return None
    code = np.concatenate([[32], np.where(letter, code, 32), [32]]).astype(np.uint32)
    code = code[np.concatenate([[True], (code[1:] != 32) | (code[:-1] != 32)])]
    two = code[:-1] * np.uint32(0x9E3779B1) + code[1:]
    three = two[:-1] * np.uint32(0x85EBCA6B) + code[2:]
    one = code[code != 32]
    shift = np.uint32(32 - bits)
    return np.concatenate([(x ^ (x >> np.uint32(15))) * np.uint32(0xC2B2AE35) >> shift for x in (one, two, three)])


def _count(bits: int):
    def run(batches):
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(0), batch.column(1).to_pylist()):
                at = ngram_buckets(text.as_py(), bits)
                if at is not None:
                    own = total.setdefault(lang, np.zeros(1 << bits, np.int64))
                    own += np.bincount(at, minlength=1 << bits)
        for lang, own in total.items():
            at = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(own[at], pa.int64())], ["lang", "bucket", "n"])

    return run


def fit(labelled: DataFrame, bits: int = 14, docs_per_language: int = 2000, smoothing: float = 0.5, most_languages: int = 2000) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, a row of 2**bits for each.

    labelled: doc_id, text and lang, lang not null. Counts are taken from about docs_per_language whole documents of each
    language, those whose ids and texts have the smallest hashes (copies under other ids enter apart), and summed by Spark;
    the driver gets at most 2**bits numbers a language. Over most_languages different values of lang are an error: the
    table would not be a broadcast of bounded size.
    """
    labelled = labelled.select("doc_id", "text", "lang").filter("lang is not null")
    sizes = {r[0]: r[1] for r in labelled.groupBy("lang").count().limit(most_languages + 1).collect()}
    if len(sizes) > most_languages:
        raise ValueError(f"more than {most_languages} languages")
    if not sizes:
        return [], np.zeros((0, 1 << bits), np.float32)
    shares = F.create_map(*[F.lit(x) for lang, n in sorted(sizes.items()) for x in (lang, min(1.0, docs_per_language / n))])
    sample = labelled.filter((F.pmod(F.xxhash64("doc_id", "text"), F.lit(1 << 20)) / float(1 << 20)) < F.element_at(shares, F.col("lang")))
    counts = sample.select("text", "lang").mapInArrow(_count(bits), "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(sizes)
    table = np.full((len(langs), 1 << bits), smoothing)
    row = {lang: i for i, lang in enumerate(langs)}
    np.add.at(table, (counts["lang"].map(row).to_numpy(np.int64), counts["bucket"].to_numpy(np.int64)), counts["n"].to_numpy(np.float64))
    return langs, np.log(table / table.sum(1, keepdims=True)).astype(np.float32)


def _score(langs: list[str], shared, bits: int, block: int = 1 << 19):
    def run(batches):
        weights = np.ascontiguousarray(shared.value.T)
        for batch in batches:
            n = batch.num_rows
            best, score = np.full(n, "und", object), np.zeros(n)
            rows, parts, held = [], [], 0

            def close():
                nonlocal rows, parts, held
                if rows:
                    sizes = np.array([len(x) for x in parts])
                    sums = np.add.reduceat(weights[np.concatenate(parts)], np.concatenate([[0], np.cumsum(sizes)[:-1]]), axis=0, dtype=np.float64)
                    # n-grams overlap and depend on each other: the sum counts as the square root of their number.
                    sums = (sums - sums.max(1, keepdims=True)) / np.sqrt(sizes)[:, None]
                    odds = np.exp(sums)
                    score[rows] = odds.max(1) / odds.sum(1)
                    best[rows] = [langs[i] for i in sums.argmax(1)]
                rows, parts, held = [], [], 0

            if langs:
                for i, text in enumerate(batch.column("text")):
                    at = ngram_buckets(text.as_py(), bits)
                    if at is not None:
                        rows.append(i)
                        parts.append(at)
                        held += len(at)
                        if held > block:
                            close()
                close()
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(best, pa.string()), pa.array(score, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return run


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out (as given, else null), lang_pred and score of every row, by its whole text.

    und with score 0 if the text is null or has no letter, or if nothing was learned. Ties go to the first language by
    name. A very long text counts with all its n-grams. Repeated rows get the same answer; no rows: no rows; other columns are ignored.
    """
    if "held_out" not in docs.columns:
        docs = docs.withColumn("held_out", F.lit(None).cast("boolean"))
    shared = docs.sparkSession.sparkContext.broadcast(table)
    bits = int(np.log2(table.shape[1]))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(_score(langs, shared, bits), "doc_id long, held_out boolean, lang_pred string, score double")


def language_id(docs: DataFrame, modulus: int = 5, remainder: int = 0, **params) -> DataFrame:
    """Learn from rows whose crc32(doc_id) mod modulus is not remainder, predict all rows."""
    marked = docs.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder))
    langs, table = fit(marked.filter("not held_out"), **params)
    return predict(marked, langs, table)
