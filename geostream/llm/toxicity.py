"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text and normalised by length."""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import held_out, label_sample

#: Letters of other scripts that look like Latin ones, and digits that stand for letters. A 1 stands for i
#: or l, so that both fold to i.
HOMOGLYPHS = dict(zip("авеёкмнорстухіјѕԁһαβεηικνορτυχ", "abeekmhopctyxijsdhabenikvoptux"))
DIGITS = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "l": "i"}
#: Full-width letters, marks without width and soft hyphens.
_FOLD = {ord(a): b for a, b in (HOMOGLYPHS | DIGITS).items()} | {0xFF41 + i: chr(97 + i) for i in range(26)} | {0xFF4C: "i"} | dict.fromkeys((0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF))
_SYMBOL = re.compile(r"(?<=[^\W\d_])[@$](?=[^\W\d_])")
_RUN = re.compile(r"[^\W\d_]+")
#: Letters of scripts that put no blanks between words: Thai and Lao, kana, Han.
_DENSE = re.compile("[\u0e00-\u0eff\u3040-\u30ff\u3400-\u9fff]+")


def fold(text: str) -> str:
    """Lower case without homoglyphs, digit substitutions, marks without width and, inside words, @ and $; l is i."""
    text = text.lower().translate(_FOLD)
    if "@" in text or "$" in text:
        text = _SYMBOL.sub(lambda m: "a" if m[0] == "@" else "s", text)
    return text


def words_of(folded: str) -> list[str]:
    """Runs of letters; of scripts without blanks the pairs of neighbouring letters."""
    words = _RUN.findall(folded)
    if not _DENSE.search(folded):
        return words
    out: list[str] = []
    for word in words:
        at = 0
        for m in _DENSE.finditer(word):
            out += [word[at : m.start()]] * (m.start() > at) + ([m[0][i : i + 2] for i in range(len(m[0]) - 1)] or [m[0]])
            at = m.end()
        out += [word[at:]] * (at < len(word))
    return out


def _words(batches):
    """A row for each different pair of a word and the one before it in a text; new marks the first of each word."""
    for batch in batches:
        words, before, labels, new = [], [], [], []
        for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist()):
            own = words_of(fold(text or ""))
            seen = set()
            for word, last in dict.fromkeys(zip(own, ["", *own])):
                words.append(word)
                before.append(last)
                labels.append(label)
                new.append(word not in seen)
                seen.add(word)
        yield pa.RecordBatch.from_arrays([pa.array(words, pa.string()), pa.array(before, pa.string()), pa.array(labels, pa.int32()), pa.array(new, pa.bool_())], ["word", "before", "label", "new"])


class Lexicon:
    """Terms with weights, phrases that excuse a term, and the calibration of the sum of weights; bounded by the sample."""

    def __init__(self, weights: dict[str, float], exceptions: set[str] = frozenset(), curve: tuple = (-4.0, 2.0, 1.0)):
        self.weights, self.exceptions, self.curve = weights, {fold(x) for x in exceptions}, tuple(curve)
        self.terms = {fold(term): term for term in weights}
        self.excused = {w for phrase in self.exceptions for w in phrase.split()} & set(self.terms)
        self.trie = None

    def __getstate__(self):
        return {**self.__dict__, "trie": None}

    def matches(self, folded: str):
        """Yield (term, start) of each whole word of folded that is a term and stands in no exception phrase.

        Neighbours of a term in a script without blanks don't make it a part of a longer word.
        """
        if not self.weights:
            return
        if self.trie is None:
            import ahocorasick

            self.trie = ahocorasick.Automaton()
            for term in self.terms:
                self.trie.add_word(term, (term, len(term), bool(_DENSE.fullmatch(term))))
            self.trie.make_automaton()
        size = len(folded)

        def ends(at: int) -> bool:
            return not 0 <= at < size or not folded[at].isalpha() or bool(_DENSE.match(folded[at]))

        for end, (term, length, dense) in self.trie.iter(folded):
            start = end + 1 - length
            if not dense and not (ends(start - 1) and ends(end + 1)):
                continue
            if term in self.excused:
                near = words_of(folded[max(0, start - 60) : start])[-1:] + [term] + words_of(folded[end + 1 : end + 61])[:1]
                if any(" ".join(near[i : i + 2]) in self.exceptions for i in range(len(near) - 1)):
                    continue
            yield self.terms[term], start

    def features(self, text: str) -> tuple[float, float]:
        """ln(1 + sum of matched weights), and that sum for each 100 words, 1 at most."""
        folded = fold(text)
        total = sum(self.weights[term] for term, _ in self.matches(folded))
        return (np.log1p(total), min(1.0, total * 100 / (9 * max(100, len(words_of(folded)))))) if total else (0.0, 0.0)

    def score(self, features) -> np.ndarray:
        x = np.asarray(features, np.float64).reshape(-1, 2)
        return 1 / (1 + np.exp(-np.clip(self.curve[0] + x @ np.array(self.curve[1:]), -30, 30)))


def _calibrate(x: np.ndarray, y: np.ndarray, odds: float) -> tuple:
    """Logistic curve by Newton steps with a small ridge; odds: what the labels' odds are against those of the sample."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(3)
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        w -= np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + 0.05 * np.eye(3), a.T @ (p - y) + 0.05 * w)
    return (float(w[0] + np.log(odds)), float(w[1]), float(w[2]))


def _apply(shared, with_label: bool):
    def run(batches):
        lexicon = shared.value
        for batch in batches:
            found = np.array([lexicon.features(text) if text else (0.0, 0.0) for text in batch.column("text").to_pylist()]).reshape(-1, 2)
            first = [batch.column("label")] if with_label else [batch.column("doc_id"), batch.column("held_out")]
            rest = [pa.array(found[:, 0]), pa.array(found[:, 1])] if with_label else [pa.array(lexicon.score(found))]
            yield pa.RecordBatch.from_arrays(first + rest, ["label", "a", "b"] if with_label else ["doc_id", "held_out", "score"])

    return run


def fit(sample: DataFrame, odds: float = 1.0, least_contexts: int = 4, least_weight: float = 3.0, exceptions: set[str] = frozenset()) -> Lexicon:
    """Learn terms, exception phrases and the curve from text and label (0 or 1), a bounded sample.

    A term is a word that stands after at least least_contexts different words in texts labelled 1 and whose log-odds
    reach least_weight; its weight is the log-odds. Copies of one text thus make none of its words a term. A phrase of
    two words that ends with a term is an exception if texts labelled 0 hold it at least three times, and four times as
    often. What is learned has no other bound than the sample.
    """
    sample = sample.select("text", F.col("label").cast("int").alias("label")).persist()
    n = {r[0]: r[1] for r in sample.groupBy("label").count().collect()}
    pos, neg = n.get(1, 0), n.get(0, 0)
    words = sample.mapInArrow(_words, "word string, before string, label int, new boolean")
    a, b = F.col("a"), F.col("b")
    odds_of = F.log((a + 0.5) / (F.lit(pos) - a + 0.5)) - F.log((b + 0.5) / (F.lit(neg) - b + 0.5))
    counted = words.groupBy("word").agg(F.count_if(F.col("new") & (F.col("label") == 1)).alias("a"), F.count_if(F.col("new") & (F.col("label") == 0)).alias("b"), F.count_distinct(F.when(F.col("label") == 1, F.col("before"))).alias("contexts"))
    terms = counted.filter(F.col("contexts") >= least_contexts).withColumn("weight", odds_of).filter(F.col("weight") >= least_weight).select("word", "weight")
    weights = {r[0]: float(r[1]) for r in terms.collect()}
    learned = set(exceptions)
    if weights:
        pairs = words.filter(F.col("before") != "").groupBy("before", "word").agg(F.sum("label").alias("a"), F.sum(1 - F.col("label")).alias("b"))
        learned |= {f"{r[0]} {r[1]}" for r in pairs.filter("b >= 3 and b >= 4 * a").join(terms, "word", "left_semi").select("before", "word").collect()}
    lexicon = Lexicon(weights, learned)
    shared = sample.sparkSession.sparkContext.broadcast(lexicon)
    found = sample.mapInArrow(_apply(shared, True), "label int, a double, b double").toPandas().sort_values(["label", "a", "b"])
    sample.unpersist()
    if pos and neg:
        lexicon.curve = _calibrate(found[["a", "b"]].to_numpy(), found["label"].to_numpy(np.float64), odds * neg / pos)
    return lexicon


def score(docs: DataFrame, lexicon: Lexicon) -> DataFrame:
    """doc_id, held_out (as given, else null), score in [0, 1] and predicted of every row, by its whole text.

    A null or empty text scores as one without a match, a very long one by its sum of weights and its share of words as
    any other. Repeated rows get the same score, and texts with the same matches for the same number of words too; no rows:
    no rows; other columns are ignored.
    """
    if "held_out" not in docs.columns:
        docs = docs.withColumn("held_out", F.lit(None).cast("boolean"))
    shared = docs.sparkSession.sparkContext.broadcast(lexicon)
    found = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "held_out", "text").mapInArrow(_apply(shared, False), "doc_id long, held_out boolean, score double")
    return found.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def classify(docs: DataFrame, labels: DataFrame, column: str = "toxic", modulus: int = 5, remainder: int = 0, toxic_docs: int = 2000, clean_docs: int = 3000, **params) -> DataFrame:
    """Learn from about toxic_docs and clean_docs labelled rows whose crc32(doc_id) mod modulus is not remainder; score all rows."""
    known = labels.filter(~held_out(F.col("doc_id"), modulus, remainder))
    share = known.agg(F.avg(F.col(column).cast("double"))).first()[0]
    share = min(max(share or 0.0, 1e-3), 0.999)
    lexicon = fit(label_sample(docs, known, column, {1: toxic_docs, 0: clean_docs}), share / (1 - share), **params)
    return score(docs.withColumn("held_out", held_out(F.col("doc_id"), modulus, remainder)), lexicon)
