"""Licence scan by a trained paragraph classifier; DataFrame functions and spark.ml only, no Python on executors.

Blank lines part paragraphs, lines within one don't; a long paragraph is read in windows that overlap by a half, so that each
template is whole in some window. Sparse vectors hold the word 1- and 2-grams of the templates and of negations, and a
multinomial logistic regression tells the licence families and a class of its own for everything else. That class learns hard
cases too: sentences that deny a licence, pieces of templates, rights reserved without a notice, and what the corpus has
of that kind. Its threshold is calibrated on windows of either kind that it wasn't trained on. A prediction counts only if the window
holds enough of one of the family's templates; windows that hold enough of none are not classified.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping, Sequence

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geostream.llm.common import stage
from geostream.operators.series import group_quantiles

#: Sentences by which texts declare their licence, from the licences and the notices that they recommend.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "artistic-2.0": ("Licensed under the Artistic License 2.0", "under the terms of the Artistic License 2.0", "SPDX-License-Identifier: Artistic-2.0"),
    "agpl": (
        "This work is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0",
    ),
    "apache-2.0": (
        "Licensed under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        'software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied',
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "bsd": (
        "Released under the BSD License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer",
        "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials",
        "may be used to endorse or promote products derived from this software without specific prior written permission",
        "SPDX-License-Identifier: BSD-2-Clause",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "boost": (
        "Distributed under the Boost Software License, Version 1.0",
        "obtaining a copy of the software and accompanying documentation covered by this license to use, reproduce, display, distribute, execute, and transmit the Software",
        "SPDX-License-Identifier: BSL-1.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "Licensed under CC BY 4.0",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-nc": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "Licensed under CC BY-NC 4.0",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "cc-by-nd": (
        "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License",
        "Licensed under CC BY-ND 4.0",
        "SPDX-License-Identifier: CC-BY-ND-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "Licensed under CC BY-SA 4.0",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "cc-by-nc-nd": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License",
        "Licensed under CC BY-NC-ND 4.0",
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0",
    ),
    "cc-by-nc-sa": (
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License",
        "Licensed under CC BY-NC-SA 4.0",
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "Licensed under CC0 1.0 Universal",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "epl": (
        "made available under the terms of the Eclipse Public License",
        "Licensed under the Eclipse Public License 2.0",
        "SPDX-License-Identifier: EPL-1.0",
        "SPDX-License-Identifier: EPL-2.0",
    ),
    "eupl": ("Licensed under the European Union Public Licence", "Licensed under the EUPL", "SPDX-License-Identifier: EUPL-1.2"),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3",
        "you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "under the terms of the GNU General Public License",
        "You should have received a copy of the GNU General Public License along with this program",
        "SPDX-License-Identifier: GPL-2.0",
        "SPDX-License-Identifier: GPL-3.0",
    ),
    "isc": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear",
        "Released under the ISC License",
        "SPDX-License-Identifier: ISC",
    ),
    "lgpl": (
        "This work is licensed under the GNU Lesser General Public License, version 3",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "You should have received a copy of the GNU Lesser General Public License along with this library",
        "SPDX-License-Identifier: LGPL-3.0",
    ),
    "mit": (
        "Released under the MIT License",
        "Licensed under the MIT License",
        'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software")',
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software",
        "SPDX-License-Identifier: MIT",
        "SPDX-License-Identifier: Apache-2.0 OR MIT",
    ),
    "mpl-2.0": (
        "subject to the terms of the Mozilla Public License, v. 2.0",
        "If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "ofl": ("This Font Software is licensed under the SIL Open Font License, Version 1.1",),
    "proprietary": ("All rights reserved", "may not be reproduced or distributed without permission", "may not be copied, reproduced or distributed without the prior written permission"),
    "unlicense": ("This is free and unencumbered software released into the public domain", "SPDX-License-Identifier: Unlicense"),
    "zlib": (
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software",
        "This notice may not be removed or altered from any source distribution",
        "SPDX-License-Identifier: Zlib",
    ),
}

#: The share of a template's word pairs that confirms a prediction; a template of up to SHORT pairs has to be whole.
LEAST, SHORT = 0.6, 4
#: Words that are frequent in any English text.
COMMON = ("this", "that", "with", "without", "under", "from", "the", "and", "not", "for", "are", "all", "any", "you", "may", "was", "one")
#: Templates that declare something beside a notice alone, and notices for them.
BARE = ("All rights reserved",)
NOTICES = ("Copyright 2019 the authors.", "Copyright (c) 2021 the company.", "(c) Copyright the owners", "Copyright owner:", "Copyright 1999 by the publisher,", "Copyright (C) 2011, contributors.", "copyright of this work is with us;", "Copyright notice:")
#: Other sentences that hold them.
FRAMES = ("{}", "that {} to the others remain with them", "the {} of all are with the people", "with {} by law", "{} for members", "whose {} this is", "on {} and duties")
#: Words by which a sentence denies what its template says.
NEGATIONS = ("not", "never", "no longer", "neither", "isn't", "wasn't", "cannot be")
#: Words of a window, and from one window to the next.
WINDOW, STEP = 64, 32


def words_of(text: Column) -> Column:
    return F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "").alias("words")


def template_pairs(template: str) -> list[str]:
    """Different pairs of neighbouring words of a template, in order."""
    words = [w for w in re.split(r"[\W_]+", template.lower()) if w]
    if len(words) > WINDOW - STEP + 1:
        raise ValueError(f"a template of over {WINDOW - STEP + 1} words may lie in no window: {template}")
    return list(dict.fromkeys(" ".join(x) for x in zip(words, words[1:])))


def needed(pairs: Sequence[str]) -> int:
    """How many of a template's pairs confirm."""
    return len(pairs) if len(pairs) <= SHORT else -int(-LEAST * len(pairs) // 1)


def cue_words(templates: Mapping[str, Sequence[str]]) -> list[str]:
    """Words of which any text that holds enough of a template has one.

    Of each template the longest words, those of COMMON last, until so few pairs are without one of them that these don't
    confirm.
    """
    cues: set[str] = set()
    for own in (template_pairs(t) for group in templates.values() for t in group):
        rest = [p.split() for p in own]
        while len(rest) >= needed(own):
            best = max({w for p in rest for w in p}, key=lambda w: (w not in COMMON, w in cues, len(w), w))
            cues.add(best)
            rest = [p for p in rest if best not in p]
    return sorted(cues)


def pairs_of(words: Column) -> Column:
    """Pairs of neighbouring words."""
    return F.zip_with(F.slice(words, 1, F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, 2, F.greatest(F.size(words) - 1, F.lit(0))), lambda a, b: F.concat_ws(" ", a, b))


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), an array, with value made once however often use names it: an array of one binds it."""
    return F.flatten(F.transform(F.array(value), use))


def known_words(words: Column, vocabulary: Sequence[str]) -> Column:
    """The words, null where the vocabulary has no such word."""
    own = [w for w in vocabulary if " " not in w]
    return F.transform(words, lambda w: F.when(w.isin(own), w))


def known_pairs(kept: Column, vocabulary: Sequence[str]) -> Column:
    """For each place of known_words() the pair that begins there, null where the vocabulary has no such pair."""
    own = [w for w in vocabulary if " " in w]
    return F.transform(F.zip_with(kept, F.slice(kept, F.lit(2), F.size(kept)), lambda a, b: F.when(a.isNotNull() & b.isNotNull(), F.concat(a, F.lit(" "), b))), lambda p: F.when(p.isin(own), p))


def windows(text: Column, vocabulary: Sequence[str] | None = None) -> Column:
    """(paragraph, place, words) of each window of a text; place counts the windows of a paragraph.

    With a vocabulary also kept and pairs, those words and pairs of the window that it has.
    """

    def cut(words: Column, i: Column, kept: Column | None = None, pairs: Column | None = None) -> Column:
        last = F.greatest(F.ceil((F.size(words) - WINDOW) / STEP), F.lit(0)).cast("int")
        own = lambda k: [] if kept is None else [F.array_compact(F.slice(of, k * STEP + 1, F.lit(n))).alias(name) for of, n, name in ((kept, WINDOW, "kept"), (pairs, WINDOW - 1, "pairs"))]
        return F.transform(F.sequence(F.lit(0), last), lambda k: F.struct(i.cast("int").alias("paragraph"), k.alias("place"), F.slice(words, k * STEP + 1, F.lit(WINDOW)).alias("words"), *own(k)))

    # What overlapping windows share is looked up once.
    def cuts(words: Column, i: Column) -> Column:
        if vocabulary is None:
            return cut(words, i)
        return _once(known_words(words, vocabulary), lambda kept: _once(known_pairs(kept, vocabulary), lambda pairs: cut(words, i, kept, pairs)))

    return F.flatten(F.transform(F.split(text, r"\r?\n[ \t\r]*\n"), lambda p, i: _once(words_of(p), lambda w: cuts(w, i))))


def _known(templates: Mapping[str, Sequence[str]]) -> list[str]:
    return sorted({p for group in templates.values() for t in group for p in template_pairs(t)})


def similarities(words: Column, templates: Mapping[str, Sequence[str]]) -> Column:
    """(family, similarity) of each template of which the words hold enough; similarity is the share of its pairs."""
    table = F.array(*[F.struct(F.lit(family).alias("family"), F.array(*map(F.lit, p)).alias("pairs"), F.lit(needed(p)).alias("needed")) for family, group in sorted(templates.items()) for p in map(template_pairs, group)])

    def of(some: Column) -> Column:
        counted = F.transform(table, lambda t: F.struct(t["family"].alias("family"), F.size(F.array_intersect(some, t["pairs"])).alias("n"), t["needed"].alias("needed"), F.size(t["pairs"]).alias("size")))
        return F.transform(F.filter(counted, lambda x: x["n"] >= x["needed"]), lambda x: F.struct(x["family"].alias("family"), (x["n"] / x["size"]).alias("similarity")))

    known = _known(templates)
    return _once(F.array_distinct(F.filter(pairs_of(words), lambda p: p.isin(known))), of)


def denials(templates: Mapping[str, Sequence[str]]) -> list[str]:
    """Sentences that deny one of the templates that begin with a verb."""
    verbs = r"^(?:this work is |and )?((?:released|licensed|distributed|made available|available|redistributed|covered|subject) .*)"
    said = [m[1] for group in templates.values() for t in group if (m := re.match(verbs, t, re.IGNORECASE))]
    return [f"this {n} {x}" for x in said for n in NEGATIONS]


def vocabulary(templates: Mapping[str, Sequence[str]]) -> list[str]:
    """Words and pairs of words of all templates, and of the denials of templates those with a word of denial."""
    denied = {p for t in denials(templates) for p in template_pairs(t)[:3]}
    return sorted({w for p in (*_known(templates), *denied) for w in (p, *p.split())})


def examples(templates: Mapping[str, Sequence[str]]) -> tuple[list[tuple[str, str]], list[tuple[str, str]]]:
    """(class, sentence) to learn from: templates, alone and beside a notice; unknown: denials, thirds of long templates, BARE in other sentences. Then sentences with two families, once for each."""
    out = [("unknown", t) for t in denials(templates)] + [("unknown", say.format(t)) for t in BARE for say in FRAMES]
    tags, names = {}, {}
    for family, group in templates.items():
        for t in group:
            words = t.split()
            if " OR " in t:  # two families
                continue
            out += [(family, f"{n} {t}") for n in (NOTICES if t in BARE else NOTICES[:4])] + ([] if t in BARE else [(family, t), *[(family, f"{n} {b}. {t}") for n in NOTICES[:2] for b in BARE]])
            if len(words) > 2 * SHORT:
                third = len(words) // 3
                out += [("unknown", " ".join(words[:third])), ("unknown", " ".join(words[-third:]))]
            if t.startswith("SPDX"):
                tags.setdefault(family, t.split()[-1])
            if re.match("(Released|Licensed|Distributed) under the", t) and len(words) < 12:
                names.setdefault(family, t.split(" under ")[1])
    both = []
    for some, say in ((tags, "SPDX-License-Identifier: {} OR {}"), (names, "Licensed under {} or {}"), (names, "dual licensed under {} and {}")):
        both += [(family, say.format(some[a], some[b])) for a in some for b in some if a != b for family in (a, b)]
    return out, both


def _grams(df: DataFrame, templates: Mapping[str, Sequence[str]], words: str = "words") -> DataFrame:
    """df (with words and pairs) with features, a sparse vector of the 1- and 2-grams that occur in templates, each counted once.

    Words and pairs that the vocabulary doesn't have may be left out.
    """
    df = df.withColumn("grams", F.concat(words, "pairs"))
    counter = CountVectorizerModel.from_vocabulary(vocabulary(templates), inputCol="grams", outputCol="features")
    return counter.setBinary(True).transform(df).drop("grams")


def _merged(data: DataFrame) -> DataFrame:
    """data (label, weight, features) with one row for all of equal label and features, of their whole weight."""
    return data.groupBy("label", "features").agg(F.sum("weight").alias("weight")).select("label", "weight", "features")


class LicenseModel:
    """A fitted regression, its classes and the probability below which a window is unknown."""

    def __init__(self, model, classes: list[str], threshold: float, templates: Mapping[str, Sequence[str]]):
        self.model, self.classes, self.threshold, self.templates = model, classes, threshold, templates


def fit(docs: DataFrame, templates: Mapping[str, Sequence[str]] = TEMPLATES, plain_windows: int = 4000, contexts: int = 12, quantile: float = 0.999, hard_quantile: float = 0.95, merge_from: int = 1 << 17) -> LicenseModel:
    """Train on the templates in the context of the corpus, of which every window counts.

    Class 0 is "unknown": windows of the corpus that hold no pair of words of any template, windows that hold some but not
    enough of any, and what examples() has of it. Each family has its examples. All stand bare and within the words of
    plain windows, so that each plain window has some example in it and each example stands in contexts of them at least, if
    there are so many. Half of all windows, by their hashes, are learned from. The threshold for "licensed" is that which of the
    other half no more than 1 - quantile exceed that hold no pair, and no more than 1 - hard_quantile of those that hold some,
    and 0.5 at least; both are exact. plain_windows and contexts are weights, so that the examples count as much beside a
    large corpus: windows of either kind weigh half of plain_windows together, an example's contexts as much as contexts of
    them (2 for sentences with two families), no window more than 1. From merge_from windows on, windows and examples of
    equal label and features are learned from as one row of their whole weight, which leaves the loss as it is.
    """
    spark = docs.sparkSession
    classes = ["unknown", *sorted(templates)]
    terms, own_pairs, cues = vocabulary(templates), _known(templates), cue_words(templates)
    every = docs.select(F.explode(windows(F.col("text"), terms)).alias("x")).select("x.words", "x.kept", "x.pairs").filter(F.size("words") > 0)
    hard = F.exists("pairs", lambda p: p.isin(own_pairs))
    cue = F.exists("kept", lambda w: w.isin(cues))
    # Without a cue word a window can't hold enough of a template.
    marked = every.withColumn("hard", hard).filter(~F.col("hard") | ~cue | (F.size(similarities(F.col("words"), templates)) == 0))
    marked = _grams(marked.withColumn("held_out", F.pmod(F.xxhash64("words", F.lit(1)), F.lit(2)) == 0), templates, "kept")
    known = stage(marked.select("hard", "held_out", *[F.when(~F.col("hard") & ~F.col("held_out"), x).alias(name) for x, name in ((F.col("words"), "context"), (F.xxhash64("words", F.lit(2)), "deal"))], "features"), "licence-windows")
    own = known.filter("not held_out")
    sizes = {r["hard"]: r["count"] for r in own.groupBy("hard").count().collect()}
    plain = sizes.get(False, 0)
    single, both = examples(templates)
    seeds = [(float(classes.index(c)), t, n) for group, n in ((single, contexts), (both, min(contexts, 2))) for c, t in group]
    places = max(1, min(len(seeds), plain // max(1, contexts)))
    seeds = spark.createDataFrame([(*seed, i % places) for i, seed in enumerate(seeds)], "label double, line string, times int, place long").select("label", "times", "place", words_of(F.col("line")))
    room = WINDOW - F.size("words")
    at = F.pmod(F.xxhash64("context", "words"), F.lit(WINDOW - STEP)).cast("int")
    around = F.concat(F.slice("context", F.lit(1), F.least(at, room)), F.col("words"), F.slice("context", at + 1, F.greatest(room - at, F.lit(0))))
    dealt = own.filter("deal is not null").select("context", F.pmod("deal", F.lit(places)).alias("place"))
    dealt = dealt.join(F.broadcast(dealt.groupBy("place").agg(F.count("*").alias("n"))), "place")  # a row for each place
    within = dealt.join(F.broadcast(seeds), "place").select("label", F.least(F.lit(1.0), F.col("times") / F.col("n")).alias("weight"), around.alias("words"))
    made = seeds.select("label", F.lit(1.0).alias("weight"), "words").union(within)
    made = made.withColumn("kept", known_words(F.col("words"), terms))
    made = made.select("label", "weight", F.array_compact("kept").alias("kept"), F.array_compact(known_pairs(F.col("kept"), terms)).alias("pairs"))
    made = _grams(made, templates, "kept").select("label", "weight", "features")
    weight = F.when(F.col("hard"), F.lit(min(1.0, plain_windows / 2 / max(1, sizes.get(True, 0))))).otherwise(F.lit(min(1.0, plain_windows / 2 / max(1, plain))))
    data = own.select(F.lit(0.0).alias("label"), weight.alias("weight"), "features").union(made)
    data = stage(_merged(data) if sum(sizes.values()) + plain >= merge_from else data, "licence-examples")
    tasks = max(spark.sparkContext.defaultParallelism, data.count() >> 17)  # not more, as each iteration has them
    model = LogisticRegression(family="multinomial", maxIter=40, regParam=1e-4, weightCol="weight").fit(data.coalesce(tasks))
    p = 1 - F.get(vector_to_array("probability"), F.lit(0))
    held = stage(model.transform(known.filter("held_out").select("hard", "features")).select("hard", p.alias("p")), "licence-held-out")
    worst = group_quantiles(held, ("hard",), ("p",), (quantile, hard_quantile)).collect()
    return LicenseModel(model, classes, max([0.5, *[r["q_p"][1 if r["hard"] else 0] for r in worst]]), templates)


def candidates(docs: DataFrame, templates: Mapping[str, Sequence[str]]) -> DataFrame:
    """(row, doc_id, found) of every row: found, the windows that hold enough of some template, with their similarities; else null.

    Most texts have no cue word, or none together with another word of a template, and are done with then.
    """
    def hold(text: Column) -> Column:
        near = F.filter(windows(text), lambda x: F.arrays_overlap(x["words"], F.array(*map(F.lit, cue_words(templates)))))
        alike = F.transform(near, lambda x: F.struct(x["paragraph"].alias("paragraph"), x["words"].alias("words"), similarities(x["words"], templates).alias("alike")))
        return F.filter(alike, lambda x: F.size(x["alike"]) > 0)

    cue = F.arrays_overlap(words_of(F.col("text")), F.array(*map(F.lit, cue_words(templates))))
    found = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.when(cue, hold(F.col("text"))).alias("found"))
    return stage(found.withColumn("found", F.when(F.size("found") > 0, F.col("found"))), "licence-rows")


def classified(found: DataFrame, model: LicenseModel) -> DataFrame:
    """row, doc_id, paragraph, family, probability, licensed, template_similarity and counts of each confirmed family of each candidate window.

    Of the families that a template confirms those stay whose probability is at least half of the best of them: a window
    may name two. They count if the window is licensed by the threshold and their probabilities add up to 0.5 or more.
    """
    spans = found.select("row", "doc_id", F.explode("found").alias("x")).select("row", "doc_id", "x.*")
    scored = model.model.transform(_grams(spans.withColumn("pairs", pairs_of(F.col("words"))), model.templates)).withColumn("odds", vector_to_array("probability"))
    names = F.array(*map(F.lit, model.classes))

    def told(family: Column) -> Column:
        alike = F.transform(F.filter("alike", lambda x: x["family"] == family), lambda x: x["similarity"])
        return F.struct(family.alias("family"), F.get("odds", F.array_position(names, family).cast("int") - 1).alias("probability"), F.array_max(alike).alias("template_similarity"))

    every = F.transform(F.array_distinct(F.transform("alike", lambda x: x["family"])), told)
    scored = scored.withColumn("every", every).withColumn("best", F.array_max(F.transform("every", lambda x: x["probability"])))
    scored = scored.withColumn("named", F.filter("every", lambda x: x["probability"] >= 0.5 * F.col("best"))).withColumn("licensed", 1 - F.get("odds", F.lit(0)))
    whole = F.aggregate("named", F.lit(0.0), lambda t, x: t + x["probability"])
    # A probability that equals the threshold counts, which a threshold of 1 allows for.
    scored = scored.withColumn("counts", (F.col("licensed") >= model.threshold) & (whole >= 0.5))
    return scored.select("row", "doc_id", "paragraph", "licensed", "counts", F.explode("named").alias("x")).select("row", "doc_id", "paragraph", "x.family", "x.probability", "licensed", "x.template_similarity", "counts")


def scan(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, license, score, template_similarity, n_paragraphs, licenses of every row.

    license is the family of the confirmed window with the highest probability (ties: the higher similarity, the earlier
    paragraph, the family by name), else null with score 0; n_paragraphs counts paragraphs with a confirmed window, licenses
    holds all their families in order, two of a window that names two. Each row has findings of its own, also if it repeats a doc_id or has none. A null or
    empty text has none; a very long one is read whole. No rows: no rows; other columns are ignored.
    """
    model = model or fit(docs)
    rows = candidates(docs, model.templates)
    found = classified(rows.filter("found is not null"), model)
    order = F.struct("probability", "template_similarity", -F.col("paragraph"), "family")
    best = found.groupBy("row").agg(F.first("doc_id").alias("doc_id"), F.max(F.when(F.col("counts"), order)).alias("best"), F.count_distinct(F.when(F.col("counts"), F.col("paragraph"))).alias("n_paragraphs"), F.sort_array(F.collect_set(F.when(F.col("counts"), F.col("family")))).alias("licenses"))
    hits = best.select("doc_id", F.col("best.family").alias("license"), F.coalesce("best.probability", F.lit(0.0)).alias("score"), F.coalesce("best.template_similarity", F.lit(0.0)).alias("template_similarity"), "n_paragraphs", "licenses")
    none = rows.filter("found is null").select("doc_id", F.lit(None).cast("string").alias("license"), F.lit(0.0).alias("score"), F.lit(0.0).alias("template_similarity"), F.lit(0).cast("long").alias("n_paragraphs"), F.array().cast("array<string>").alias("licenses"))
    return hits.unionByName(none)
