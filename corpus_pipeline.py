"""Documents to packed training sequences: quality, exact copies, near copies, mixing, packing.

Each stage takes (spark, docs, sf_dir), docs with the columns of documents, works on all rows that its predecessor kept,
and returns rows with those columns; the last returns pieces of sequences. Further columns pass through, whatever their
names. An empty table gives an empty one. Tables that a stage has staged last until the application ends, so that its result
may be used at any time; run() deletes them as soon as the stage's result is written.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geostream.llm import exact_dedup, mixing, near_dup, packing, quality
from geostream.llm.common import captured, held_out, label_sample, quoted, release, stage, table


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is 0.5 or more. Labels are those of rows whose crc32(doc_id) mod 3 is not 1.

    A null or empty text scores 0 and goes; a very long one is scored whole; repeated rows stay or go together.
    """
    labels = table(spark, sf_dir, "labels").filter(~held_out(F.col("doc_id"), 3, 1))
    model = quality.fit(label_sample(docs, labels, "quality", {0: 1500, 1: 3500}))
    name = "score_" + "_".join(docs.columns)  # no column of docs has it
    return quality.score(docs, model, tuple(docs.columns), name).filter(quoted([name])[0] >= 0.5).select(*quoted(docs.columns))


def exact_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of equal texts, the one with the largest doc_id; of its repetitions, one.

    A null text counts as empty, a null doc_id as smaller than any other; very long texts are compared whole.
    """
    return exact_dedup.exact_survivors(docs)


#: Documents of the corpus link from a similarity of 80 %. A pair there shares none of 25 bands of 4 registers with a
#: probability of 2e-6; the slack is 5 standard deviations of its estimate.
NEAR = {"percent": 80, "rows": 4, "bands": 25, "slack": 0.2}


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates, the one with the smallest doc_id.

    Rows that share a doc_id stay or go together. Rows without a doc_id, and those without words, take part in no link and
    stay; very long texts are compared by all their shingles.
    """
    kept = near_dup.near_duplicates(docs, **NEAR).filter("kept and doc_id is not null").select("doc_id").distinct()
    return docs.filter("doc_id is not null").join(kept, "doc_id", "left_semi").select(*quoted(docs.columns)).unionByName(docs.filter("doc_id is null"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it.

    A null or empty text has no words and is taken in complete epochs only; a null source is a source of its own; a very
    long text counts whole; repeated rows are taken each for itself.
    """
    rows = docs.select("doc_id", "text", "source", F.struct(*quoted(docs.columns)).alias("whole"))
    mixed = mixing.mix(rows).filter("mix_copies > 0")
    return mixed.select("whole", F.explode(F.sequence(F.lit(1), F.col("mix_copies")))).select("whole.*")


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids, with their ids. A null or empty text has the end id alone; a very long one crosses many sequences."""
    return packing.pack(docs)


STAGES = [("quality classifier", quality_stage), ("exact dedup", exact_stage), ("MinHash near-dedup", near_stage), ("mixing to target weights", mixing_stage), ("packing", packing_stage)]

#: The classifier and the tokenizer have no SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written to the shared folder and read again."""
    docs, before = table(spark, sf_dir, "documents"), []
    for i, (_, work) in enumerate(STAGES):
        scratch: list[str] = []
        with captured(scratch):
            docs = work(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            written: list[str] = []
            with captured(written):
                docs = stage(docs, f"stage-{i + 1}")
            release(spark, scratch + before)  # nothing but what is written reads them
            before = written
    return docs
