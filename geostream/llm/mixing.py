"""Mixing sources to target weights by Efraimidis-Spirakis sampling.

Each document has the key -ln(u) / w, u from its id and w its quality weight; within a source, documents with small keys
come first. A source's target is met by complete epochs and then by the documents in front, up to the rest of its budget.
The prefix sum that finds the border never sorts a source: keys fall in cells and cells in groups, the sums of the groups
tell which one holds the border, the sums of its cells which cell, and only that cell's documents are sorted.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from geostream.llm.common import WORD, quoted, stage


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def quality_weight(text: Column) -> Column:
    """1 for plain prose, down to 0.1 as every second character is a symbol or a digit; 1 for an empty text."""
    odd = F.regexp_count(text, F.lit(r"[0-9#$%&*|!=<>{}]")) / F.greatest(F.char_length(text), F.lit(1))
    return F.coalesce(F.greatest(1 - 1.8 * odd, F.lit(0.1)), F.lit(1.0))


def sampling_key(doc_id: Column, text: Column, weight: Column, seed: int) -> Column:
    """-ln(u) / weight with u in (0, 1) from 52 bits of md5(seed:doc_id), or of the text where there is no id."""
    own = F.coalesce(doc_id.cast("string"), F.concat(F.lit(":"), F.md5(text.cast("binary"))), F.lit(""))
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:"), own).cast("binary")), 1, 13), 16, 10).cast("long")
    return -F.log((bits + F.lit(0.5)) / F.lit(float(1 << 52))) / weight


def source_targets(sizes: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """source, source_size, rows and target of each source, from rows (source, size).

    Sources by code point, null last, take the weights in turn. Targets share `share` times all sizes by weight and stop
    at `most` times their source's size; the excess goes to the others by weight until none is above. One row for each
    source, so that one task can order them.
    """
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("rows"))
    place = Window.orderBy(F.col("source").isNull(), F.col("source"))
    turn = F.array(*[F.lit(float(w)) for w in weights])
    known = known.withColumn("weight", F.get(turn, (F.row_number().over(place) - 1) % len(weights))).withColumn("most", most * F.col("source_size"))
    # In the order in which sources fill up as the level rises: those before are full when this one fills.
    rising = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").isNull(), F.col("source"))
    everything = Window.partitionBy()
    before = rising.rowsBetween(Window.unboundedPreceding, -1)
    known = known.withColumn("level", (share * F.sum("source_size").over(everything) - F.coalesce(F.sum("most").over(before), F.lit(0.0))) / (F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    # The first source whose share at this level is not above its most sets the level of all that follow.
    first = F.when(F.col("level") * F.col("weight") <= F.col("most"), F.col("level"))
    known = known.withColumn("level", F.first(first, ignorenulls=True).over(rising.rowsBetween(Window.unboundedPreceding, 0)))
    return known.select("source", "source_size", "rows", F.coalesce(F.col("level") * F.col("weight"), F.col("most")).alias("target"))


def _first_over(rows: DataFrame, step: Column, name: str) -> DataFrame:
    """(with, {name}, past): of each source the first step at which the running sum of sizes exceeds rest, and the sum before it.

    rows: of, rest, past, mix_size; past is what lies before all of them.
    """
    sums = rows.groupBy("of", "rest", "past", step.alias(name)).agg(F.sum("mix_size").alias("size"))
    sums = sums.withColumn("sum", F.col("past") + F.sum("size").over(Window.partitionBy("of").orderBy(name)))
    return sums.filter("sum > rest").groupBy(F.col("of").alias("with")).agg(F.min_by(F.struct(name, (F.col("sum") - F.col("size")).alias("past")), name).alias("b")).select("with", f"b.{name}", "b.past")


def _border(narrow: DataFrame, targets: DataFrame, bucket_rows: int) -> DataFrame:
    """targets with epochs, cells, and the cell in which each source's fractional part ends with the sum of sizes before it.

    Running sums are over at most the square root of a source's cells, twice.
    """
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    targets = targets.withColumn("epochs", epochs).withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    targets = targets.withColumn("cells", F.greatest(F.ceil(F.col("rows") / bucket_rows), F.lit(1))).withColumn("width", F.ceil(F.sqrt("cells")))
    plan = targets.withColumnRenamed("source", "of")
    group = F.floor(_cell() / F.col("width"))
    rows = narrow.join(plan, F.col("source").eqNullSafe(F.col("of")))
    groups = stage(plan.join(_first_over(rows.withColumn("past", F.lit(0).cast("long")), group, "group"), F.col("of").eqNullSafe(F.col("with")), "left").drop("with"), "mixing-groups")
    rows = narrow.join(groups.filter("group is not null"), F.col("source").eqNullSafe(F.col("of"))).filter(group == F.col("group"))
    border = _first_over(rows, _cell(), "cell")
    return groups.drop("group", "past").join(border, F.col("of").eqNullSafe(F.col("with")), "left").drop("with")


def _cell(cells: str = "cells"):
    return F.floor(F.col(cells) * (1 - F.exp(-F.col("mix_key")))).cast("long")


def mix(docs: DataFrame, weights: Sequence[float] = (5, 2, 1), share: float = 1.5, seed: int = 17, quality=quality_weight, bucket_rows: int = 2000, texts: bool = True) -> DataFrame:
    """docs with mix_size, mix_source_size, mix_target and mix_copies, the number of times that the mix takes the row.

    docs has doc_id, text and source; other columns pass through, whatever their names (one with a name of those added is
    replaced).
    With texts=False only doc_id, source and the added columns return, from one scan of the texts instead of two.
    A null text has size 0; a null source is a source of its own; equal keys are ordered by doc_id (null first), then
    size; rows that agree in these are exchangeable. Rows without an id draw by their text. A very long text counts whole. A document without words is taken in complete epochs only. quality:
    text column -> weight column above 0. No documents: no rows. Reruns give the same result.
    """
    added = ["mix_size", "mix_source_size", "mix_target", "mix_copies"]
    whole = quoted([c for c in docs.columns if c not in added])
    frame = docs.select("doc_id", "text", "source", F.struct(*whole).alias("row"))  # no column of docs can clash with those made here
    frame = frame.withColumn("mix_size", word_count(F.col("text"))).withColumn("mix_key", sampling_key(F.col("doc_id"), F.col("text"), quality(F.col("text")), seed))
    narrow = stage(frame.select("doc_id", "source", "mix_size", "mix_key"), "mixing")
    targets = source_targets(narrow.select("source", F.col("mix_size").alias("size")), weights, share)
    # One row for each source; read from its file, so that it is broadcast only if that is small.
    plan = stage(_border(narrow, targets, bucket_rows), "mixing-plan")
    plan = plan.select(F.col("of").alias("mix_of"), F.struct("source_size", "target", "epochs", "rest", "cells", "cell", "past").alias("mix_plan"))
    columns = ["row.*"] if texts else ["doc_id", "source"]
    frame = (frame.drop("text") if texts else narrow).join(plan, F.col("source").eqNullSafe(F.col("mix_of")))
    own = _cell("mix_plan.cells")
    here = F.col("mix_plan.cell").isNotNull() & (own == F.col("mix_plan.cell"))
    sure = frame.filter(~here).withColumn("mix_again", F.col("mix_plan.cell").isNull() | (own < F.col("mix_plan.cell")))
    place = Window.partitionBy("source").orderBy("mix_key", "doc_id", "mix_size").rowsBetween(Window.unboundedPreceding, 0)
    reached = F.col("mix_plan.past") + F.sum("mix_size").over(place)
    edge = frame.filter(here).withColumn("mix_again", 2 * reached - F.col("mix_size") <= 2 * F.col("mix_plan.rest"))
    copies = F.col("mix_plan.epochs") + (F.col("mix_again") & (F.col("mix_size") > 0)).cast("int")
    return sure.unionByName(edge).select(*columns, "mix_size", F.col("mix_plan.source_size").alias("mix_source_size"), F.col("mix_plan.target").alias("mix_target"), copies.alias("mix_copies"))
