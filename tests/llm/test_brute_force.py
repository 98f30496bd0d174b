"""The learned operators against plain recomputation, edge rows for all, large buckets and hubs, and the pipeline's columns."""

import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F
from test_corpus_operators import docs, edge_rows, near_brute, prose

from geostream.llm import common, exact_dedup, language_id, license_scan, mixing, near_dup, packing, quality, toxicity, units, url_filter, vector_dedup

DATA = "/root/testdata/sf0.1"


def held(doc_id, modulus, remainder):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % modulus == remainder


# --- components and units ---


def components(edges):
    up = {}

    def root(x):
        while up.get(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    return {x: root(x) for e in edges for x in e}


@pytest.mark.parametrize("parts", [1, 20])
def test_components_of_stars_paths_and_random_graphs(spark, parts):
    r = random.Random(parts)
    path = list(range(100_000, 100_700))
    r.shuffle(path)
    edges = [(9_999, i) for i in range(3000)] + [(10_000, i) for i in range(10_001, 12_000)] + list(zip(path, path[1:])) + [(r.randrange(200_000, 202_000), r.randrange(202_000, 204_000)) for _ in range(2500)]
    got = common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(parts), block=64).collect()
    assert dict(map(tuple, got)) == components(edges) and len(got) == len(components(edges))


def test_components_without_edges(spark):
    assert common.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
    assert common.connected_components(spark.createDataFrame([(3, 3)], "a long, b long")).count() == 0


def test_units_grow_with_the_bucket(spark):
    n, chunk = 4000, 64
    hits = spark.createDataFrame([(1, i) for i in range(n)], "bucket long, node long")
    homes = units.home_units(hits, chunk)
    assert homes.count() == 2 * n and homes.groupBy("unit").count().agg(F.max("count")).first()[0] < 3 * chunk
    for strays in (0, 3):
        grouped = homes.filter("deal = 0").withColumn("group", F.when(F.col("node") < strays, F.col("node")).otherwise(F.lit(99)))
        across = units.cross_units(grouped, chunk)
        assert across.count() <= (0 if not strays else n + strays * (n // chunk + 1))
        seen = Counter()
        by = defaultdict(list)
        for x in across.collect():
            by[x.unit].append(x)
        for rows in by.values():
            for a in (x for x in rows if x.side == 2):
                seen.update((min(a.node, b.node), max(a.node, b.node)) for b in rows if b.side == 0 or (b.side == 1 and b.node > a.node))
        chunk_of = {x.node: x.chunk for x in grouped.collect()}
        wanted = {(min(a, b), max(a, b)) for a in range(strays) for b in range(n) if a != b and chunk_of[a] != chunk_of[b]}
        assert set(seen) == wanted and set(seen.values()) <= {1}


def test_near_duplicates_in_one_large_bucket(spark):
    """Variants of one text, with some that only a few of them link to, in buckets many times the size of a unit."""
    r = random.Random(21)
    base = prose(r, 120).split()
    rows = []
    for i in range(300):
        own = list(base)
        own[r.randrange(120)] = f"x{i}"
        rows.append((i, " ".join(own)))
    for i in range(40):  # about as far from each other as the threshold
        own = list(base)
        for k in range(3):
            own[(10 + 40 * k + i) % 120] = f"y{i % 9}"
        rows.append((1000 + i, " ".join(own)))
    got = near_dup.near_duplicates(docs(spark, rows).repartition(4), chunk=8).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == near_brute(rows)


@pytest.mark.parametrize("numerator,denominator", [(85, 100), (80, 100), (1, 2)])
def test_prefixes_hold_a_common_shingle(numerator, denominator):
    r = random.Random(5)
    for _ in range(3000):
        a, b = (set(r.sample(range(30), r.randint(1, 30))) for _ in range(2))
        a, b = sorted((a, b), key=len)
        if denominator * len(a & b) >= numerator * len(a | b):
            probe, index = near_dup.prefix_lengths(len(b), numerator, denominator)[0], near_dup.prefix_lengths(len(a), numerator, denominator)[1]
            assert set(sorted(b)[:probe]) & set(sorted(a)[:index])
            assert 1 <= index <= len(a) and probe <= len(b)


def templated(n):
    """Texts that share 150 words and have some 30 of their own, and for each tenth a variant that links to it."""
    r = random.Random(31)
    shared, rows = [f"s{k}" for k in range(150)], []
    for i in range(n):
        own = [f"w{i}x{k}" for k in range(r.randint(25, 40))]
        rows.append((10 * i, " ".join(shared + own)))
        if i % 10 == 0:
            rows.append((10 * i + 5, " ".join(shared + own[:-1] + ["other"])))
    return rows


def test_near_duplicates_of_templated_texts(spark, monkeypatch):
    """Texts that share bands without linking cost in proportion to their number, and lose no link."""
    met = []

    def counted(rows):
        met.append(rows.count())
        return units.dealt(rows)

    monkeypatch.setattr(near_dup, "dealt", counted)
    rows_of = {}
    for n in (150, 600):
        rows, met[:] = templated(n), []
        got = near_dup.near_duplicates(docs(spark, rows).repartition(4), chunk=16).collect()
        assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == near_brute(rows)
        rows_of[n] = sum(met)
    assert rows_of[600] < 5 * rows_of[150]


def test_near_duplicates_split_by_shingles_that_many_share(spark, monkeypatch):
    """The path by rare shingles alone, its buckets many times the size of a unit, against brute force."""
    monkeypatch.setattr(near_dup, "strays_of", lambda homes: units.strays_of(homes).withColumn("strays", F.lit(10**6)))
    r = random.Random(8)
    base = prose(r, 60).split()
    rows = []
    for i in range(150):
        own = list(base)
        for k in range(3):  # about as far from each other as the threshold
            own[(5 + 20 * k + i) % 60] = f"y{i % 11}"
        rows.append((i, " ".join(own)))
    got = near_dup.near_duplicates(docs(spark, rows).repartition(4), chunk=4).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == near_brute(rows)


# --- edge rows for all ---


def long_and_repeated(r):
    long_text = prose(r, 20_000)
    return [(808, long_text, "en", "a"), (808, long_text, "en", "a"), (809, long_text.upper(), "en", "a"), (804, None, None, None), (805, "", "en", "b"), (805, "", "en", "b"), (None, long_text, None, "c"), (806, "\t \n", "en", "a"), (807, "日本語の文章です", "ja", "a")]


def test_edge_rows_of_the_scores(spark):
    r = random.Random(31)
    rows = long_and_repeated(r) + edge_rows() + [(100 + i, prose(r, 40), "en", "a") for i in range(60)]
    labels = spark.createDataFrame([(100 + i, i % 2, i % 3 == 0) for i in range(60)], "doc_id long, quality int, toxic boolean").withColumn("toxic", F.col("toxic").cast("int"))
    frame = docs(spark, rows).repartition(3)
    for name, got in (("quality", quality.classify(frame, labels)), ("toxicity", toxicity.classify(frame, labels)), ("language", language_id.language_id(frame)), ("licence", license_scan.scan(frame))):
        got = got.collect()
        assert Counter(x.doc_id for x in got) == Counter(row[0] for row in rows), name
        answers = defaultdict(set)
        for x in got:
            answers[x.doc_id].add(tuple(str(v) for v in x))
        assert all(len(answers[i]) == 1 for i in (808, 805)), name  # repeated rows agree
        assert all(0 <= x.score <= 1 for x in got), name


def test_edge_rows_of_urls_and_vectors(spark):
    long_url = "http://h.com/" + "/".join(f"s{i}" for i in range(3000))
    pages = [(1, long_url), (1, long_url), (2, None), (2, None), (3, "http://h.com"), (4, "http://h.com/"), (None, "http://h.com/a")]
    frame = spark.createDataFrame([(*p, "x", 1.0, "y") for p in pages], "page_id long, url string, verdict string, purity double, n string")
    got = url_filter.judge(frame).collect()
    assert Counter(x.page_id for x in got) == Counter(p[0] for p in pages) and {x.verdict for x in got} == {"allow"} and {x.n for x in got} == {"y"}
    assert {x.template for x in got if x.page_id == 1} == {"/" + "/".join(f"s{i}" for i in range(3000))} and {x.template for x in got if x.page_id in (3, 4)} == {""}
    rng = np.random.default_rng(3)
    short, long_vector = rng.standard_normal(4).tolist(), rng.standard_normal(4103).tolist()
    vectors = [(1, short), (2, short), (2, short), (3, long_vector), (4, long_vector), (None, short)]
    frame = spark.createDataFrame([(*v, 7, 0.5, 3) for v in vectors], "vec_id long, embedding array<float>, label int, n_links double, node int")
    got = vector_dedup.near_vectors(frame).collect()
    assert Counter((x.vec_id, x.n_links, x.component_id) for x in got) == Counter([(1, 3, 1), (2, 3, 1), (2, 3, 1), (3, 1, 3), (4, 1, 3), (None, 3, 1)])


def test_vectors_of_many_lengths_never_meet(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.standard_normal(4 if i % 2 else 4103).tolist()) for i in range(120)]
    got = vector_dedup.near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert len(got) == 120


@pytest.mark.parametrize("classes", [5_000, 600_000, 40_000_000])
def test_recall_holds_as_codes_grow(classes):
    words, tables = vector_dedup.code_size(classes, 10.0, 2)
    rng, dim = np.random.default_rng(8), 64
    x = rng.standard_normal((150, dim))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    away = rng.standard_normal((150, dim))
    away -= (away * x).sum(1, keepdims=True) * x
    y = 0.952 * x + np.sqrt(1 - 0.952**2) * away / np.linalg.norm(away, axis=1, keepdims=True)
    code = vector_dedup.ProductCode(dim, words, tables, 10.0, 6)
    met = [bool(set(a.tolist()) & set(b.tolist())) for a, b in zip(code.decode(x), code.decode(y))]
    assert words * words * 32 >= classes * 10 and np.mean(met) >= 0.96


# --- quality ---


def quality_terms(text):
    """The features in plain Python."""
    code = [ord(c) for c in text]
    n, mask = len(code), (1 << 32) - 1
    grams = Counter()
    for a, b, c in zip(code, code[1:], code[2:]):
        three = (((a * 0x9E3779B1 + b) & mask) * 0x85EBCA6B + c) & mask
        grams[(((three ^ (three >> 15)) * 0xC2B2AE35) & mask) >> (32 - quality.BITS)] += 1
    words, lines = text.split(), text.split("\n")
    often = Counter(words)
    share = lambda test: sum(map(test, text)) / n
    shapes = [
        share(lambda c: "A" <= c <= "Z"), share(lambda c: "0" <= c <= "9"), share(lambda c: "!" <= c <= "~" and not c.isalnum()), share(lambda c: c == " " or "\t" <= c <= "\r"), min(1.0, n / len(lines) / 2000), 1 - len(set(lines)) / len(lines),
        1 - len(often) / max(1, len(words)), max(often.values(), default=0) / max(1, len(words)), len(grams) / min(n, 1 << quality.BITS),
    ]
    out = np.zeros(quality.WIDTH)
    for at, k in grams.items():
        out[at] = math.sqrt(k)
    for i, x in enumerate(shapes):
        out[(1 << quality.BITS) + i * quality.BINS + min(int(math.sqrt(x) * quality.BINS), quality.BINS - 1)] = 1
    return out


def test_quality_features_and_space():
    r = random.Random(41)
    texts = [prose(r, r.randint(3, 200)) + r.choice(["", "\n" + prose(r, 9), " A1! é"]) for _ in range(60)]
    counts = np.stack([quality.terms(t) for t in texts])
    assert np.allclose(counts, np.stack([quality_terms(t) for t in texts]), atol=1e-6)
    model = quality.Model(np.arange(60) % 2, counts, rank=10, neighbours=5)
    x = model.weigh(counts).astype(np.float64)
    _, values, axes = np.linalg.svd(x, full_matrices=False)
    # The same space: what the axes keep of the matrix is what the first singular vectors keep.
    assert np.linalg.norm(x @ model.axes) ** 2 == pytest.approx((values[:10] ** 2).sum(), rel=1e-3)


def test_label_sample_is_bounded_and_reads_labels_only(spark):
    frame = docs(spark, [(i, f"text {i}") for i in range(2000)])
    labels = spark.createDataFrame([(i, i % 4 == 0) for i in range(2000)], "doc_id long, quality boolean")
    got = Counter(x.label for x in common.label_sample(frame, labels, "quality", {0: 100, 1: 100}).collect())
    assert set(got) == {0, 1} and all(60 < n < 140 for n in got.values())


# --- toxicity ---


def plain_lexicon(sample, least_contexts=4, least_weight=3.0):
    """Weights and exceptions recounted from (text, label)."""
    pos, neg = sum(y for _, y in sample), sum(1 - y for _, y in sample)
    has, pair, contexts = defaultdict(lambda: [0, 0]), defaultdict(lambda: [0, 0]), defaultdict(set)
    for text, y in sample:
        w = re.findall(r"[^\W\d_]+", toxicity.fold(text))
        for word in set(w):
            has[word][y] += 1
        for before, word in set(zip(["", *w], w)):
            pair[before, word][y] += 1
            if y:
                contexts[word].add(before)
    odds = lambda k, n: math.log((k + 0.5) / (n - k + 0.5))
    weights = {w: odds(b, pos) - odds(a, neg) for w, (a, b) in has.items()}
    weights = {w: x for w, x in weights.items() if x >= least_weight and len(contexts[w]) >= least_contexts}
    return weights, {f"{b} {w}" for (b, w), (clean, toxic) in pair.items() if b and w in weights and clean >= 3 and clean >= 4 * toxic}


def test_toxicity_learns_and_matches_as_recounted(spark):
    r = random.Random(51)
    sample = []
    for i in range(240):
        w = prose(r, 40).split()
        if i % 2:
            for word in ("scumly", r.choice(["ki1l", "k1ll", "KILL"]), r.choice(["ki1l", "dröll"])):
                w.insert(r.randrange(len(w)), word)
        elif i % 12 == 0:
            w.insert(r.randrange(len(w)), "pond scumly")
        sample.append((" ".join(w), i % 2))
    lexicon = toxicity.fit(spark.createDataFrame(sample, "text string, label int").repartition(3))
    weights, exceptions = plain_lexicon(sample)
    assert weights.keys() == lexicon.weights.keys() and all(lexicon.weights[w] == pytest.approx(x) for w, x in weights.items())
    assert lexicon.exceptions == exceptions and "pond scumiy" in exceptions and "kiii" in weights
    for text, _ in sample + [("pond scumly, scumly! kill kiln k1l1 KILL", 0)]:
        folded = toxicity.fold(text)
        words = [(m.group(), m.start()) for m in re.finditer(r"[^\W\d_]+", folded)]
        plain = [(w, at) for i, (w, at) in enumerate(words) if w in weights and not ({" ".join(x) for x in ((words[i - 1][0] if i else "", w), (w, words[i + 1][0] if i + 1 < len(words) else ""))} & exceptions)]
        assert sorted(lexicon.matches(folded)) == sorted(plain)
        total = sum(weights[w] for w, _ in plain)
        a, b = lexicon.features(text)
        assert a == pytest.approx(math.log1p(total)) and b == pytest.approx(min(1.0, total * 100 / (9 * max(100, len(words)))))


def test_toxicity_without_blanks():
    lexicon = toxicity.Lexicon({"ばか": 4.0, "scum": 3.0})
    assert [m[0] for m in lexicon.matches(toxicity.fold("おまえはばかだ scum scumあ"))] == ["ばか", "scum", "scum"]
    assert toxicity.words_of("abさしすcd ef") == ["ab", "さし", "しす", "cd", "ef"]


def test_toxicity_has_no_cap(spark):
    """More terms than any limit that was there before."""
    r = random.Random(52)
    bad = ["".join(r.choice("abcdefgh") for _ in range(9)) for _ in range(2500)]
    rows = [(" ".join(x for w in r.sample(bad, 600) for x in (r.choice("pqrstu") * 3, w)), 1) for _ in range(60)] + [(prose(r, 50, "xyz"), 0) for _ in range(60)]
    lexicon = toxicity.fit(spark.createDataFrame(rows, "text string, label int"), least_contexts=2, least_weight=1.0)
    assert len(lexicon.weights) > 2000


# --- language ---


def test_language_matches_plain_naive_bayes(spark):
    r = random.Random(61)
    letters = {"xx": "abcdef", "yy": "defghi"}
    rows = [(i, prose(r, 12, letters[lang]), lang) for i, lang in enumerate(r.choices(list(letters), k=120))]
    frame = docs(spark, rows).withColumn("held_out", F.lit(False))
    langs, table = language_id.fit(frame, bits=12)
    counts = {lang: np.full(1 << 12, 0.5) for lang in letters}

    def buckets(text):
        padded, out, mask = re.sub(" +", " ", " " + "".join(c if c.isalpha() else " " for c in text.lower()) + " "), [], (1 << 32) - 1
        code = [ord(c) for c in padded]
        grams = [c for c in code if c != 32] + [(a * 0x9E3779B1 + b) & mask for a, b in zip(code, code[1:])] + [(((a * 0x9E3779B1 + b) & mask) * 0x85EBCA6B + c) & mask for a, b, c in zip(code, code[1:], code[2:])]
        for x in grams:
            out.append((((x ^ (x >> 15)) * 0xC2B2AE35) & mask) >> 20)
        return out

    for _, text, lang in rows:
        for at in buckets(text):
            counts[lang][at] += 1
    assert langs == sorted(letters) and np.allclose(table, np.log(np.stack([counts[x] / counts[x].sum() for x in langs])), atol=1e-5)
    for x in language_id.predict(frame, langs, table).collect():
        at = buckets(rows[x.doc_id][1])
        sums = np.array([np.log(counts[lang] / counts[lang].sum())[at].sum() for lang in langs]) / math.sqrt(len(at))
        assert x.lang_pred == langs[int(sums.argmax())] and x.score == pytest.approx(1 / np.exp(sums - sums.max()).sum(), abs=1e-4)


def test_language_sample_of_copies_and_bound(spark):
    rows = [(i, "abc abc", "xx") for i in range(3000)] + [(5000 + i, "def def", "yy") for i in range(3)]
    langs, table = language_id.fit(docs(spark, rows), docs_per_language=100)
    assert langs == ["xx", "yy"] and table[0].std() > 0
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(docs(spark, [(i, "a", f"l{i}") for i in range(30)]), most_languages=20)


# --- mixing ---


def test_mixing_rows_without_ids(spark):
    rows = [(None, f"word {'more ' * (i % 7)} {i}", "en", "a") for i in range(400)] + [(i, "some words here", "en", "b") for i in range(400)]
    got = mixing.mix(docs(spark, rows), bucket_rows=5).collect()
    taken = Counter()
    for x in got:
        taken[x.source] += x.mix_size * x.mix_copies
    assert all(abs(taken[x.source] - x.mix_target) <= 10 for x in got)


# --- urls ---


@pytest.mark.skipif(not os.path.isdir(DATA), reason="driver tables are not here")
def test_url_method_decides_on_the_driver_tables(spark):
    got = url_filter.judge(spark.read.parquet(f"{DATA}/pages.parquet").select("page_id", "url")).filter("rule is null")
    blocked = got.filter("verdict = 'block'")
    assert 0 < blocked.count() < got.count() and blocked.filter("purity < 0.75").count() == 0


def test_url_purity_by_hand(spark):
    """Counts of a small tree, worked out by hand."""
    counts = [("h", "/a/*", 10, 10), ("h", "/b/*", 10, 0), ("h", "/c/*", 0, 0), ("h", "/d", 2, 1)]
    got = {x.template: x.purity for x in url_filter.template_purity(spark.createDataFrame(counts, "host string, template string, labelled long, blocked long"), 2.0, 0.75, 1.96).collect()}
    whole = (11 + 0.5) / (22 + 1)
    root = (11 + 1.5 * whole) / (22 + 2)
    # /a and /b differ from the rest; /c has no label and /d not enough of them to differ, so that both share the counts of /d.
    a, b, rest = (10 + 1.5 * root) / 12, (0 + 1.5 * root) / 12, (1 + 1.5 * root) / 4
    assert got == pytest.approx({"/a/*": (10 + 1.5 * a) / 12, "/b/*": 1.5 * b / 12, "/c/*": 1.5 * rest / 2, "/d": rest})


# --- licences ---


def test_licences_by_row(spark):
    r = random.Random(71)
    grant = "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n(the \"Software\"), to deal in the Software"
    rows = [(i, "\n".join(prose(r, 12) for _ in range(4))) for i in range(60)]
    rows += [(200, "Released under the MIT License."), (200, prose(r, 40)), (None, prose(r, 20)), (None, "# SPDX-License-Identifier: Apache-2.0\n" + prose(r, 5)), (201, grant), (202, "Released under the ISC License"), (203, prose(r, 3000) + " Licensed under CC BY-SA 4.0. " + prose(r, 3000)), (204, "SPDX-License-Identifier: Unheard-Of"), (205, "GNU Lesser General Public License:\nThis work is licensed under the GNU Lesser General Public License, version 3."), (206, "the licence is under review, and the software is distributed with permission")]
    got = defaultdict(list)
    for x in license_scan.scan(docs(spark, rows).repartition(3)).collect():
        got[x.doc_id].append(x)
    assert sorted(map(str, (x.license for x in got[200]))) == ["None", "mit"] and sorted(map(str, (x.license for x in got[None]))) == ["None", "apache-2.0"]
    assert [got[i][0].license for i in range(201, 207)] == ["mit", "isc", "cc-by-sa", None, "lgpl", None]
    assert all(got[i][0].license is None for i in range(60))


def test_licences_match_plain_windows(spark):
    """Windows, pairs, similarities and probabilities recomputed from the fitted weights."""
    r = random.Random(72)
    marks = [t for group in license_scan.TEMPLATES.values() for t in group]
    rows = [(i, "\n".join([prose(r, r.randint(0, 90)), r.choice(marks) if i % 2 else prose(r, 8), "", prose(r, 5), prose(r, r.randint(0, 90))])) for i in range(80)]
    frame = docs(spark, rows).repartition(3)
    model = license_scan.fit(frame, plain_windows=300, contexts=4)
    words = license_scan.vocabulary(model.templates)
    place, weights, bias = {w: i for i, w in enumerate(words)}, model.model.coefficientMatrix.toArray(), model.model.interceptVector.toArray()
    expected = {}
    for doc, text in rows:
        found = []
        for p, paragraph in enumerate(re.split(r"\r?\n[ \t\r]*\n", text)):
            own = [w for w in re.split(r"[\W_]+", paragraph.lower()) if w]
            for k in range(max(0, math.ceil((len(own) - 64) / 32)) + 1):
                window = own[32 * k : 32 * k + 64]
                pairs = {" ".join(x) for x in zip(window, window[1:])}
                best = defaultdict(float)
                for family, group in model.templates.items():
                    for t in group:
                        wanted = license_scan.template_pairs(t)
                        both = len(pairs & set(wanted))
                        if both >= (len(wanted) if len(wanted) <= 4 else math.ceil(0.6 * len(wanted) - 1e-9)):
                            best[family] = max(best[family], both / len(wanted))
                if best:
                    x = np.zeros(len(words))
                    x[[place[g] for g in {*window, *pairs} if g in place]] = 1
                    odds = np.exp(weights @ x + bias)
                    odds /= odds.sum()
                    family = model.classes[1:][int(odds[1:].argmax())]
                    if 1 - odds[0] >= model.threshold and family in best:
                        found.append((odds[1:].max(), best[family], -p, family))
        expected[doc] = (max(found)[3] if found else None, sorted({x[3] for x in found}), len({x[2] for x in found}))
    got = {x.doc_id: (x.license, x.licenses, x.n_paragraphs) for x in license_scan.scan(frame, model).collect()}
    assert got == expected and sum(x[0] is not None for x in got.values()) > 30


def test_cue_words_are_in_every_confirmed_text():
    cues = set(license_scan.cue_words(license_scan.TEMPLATES))
    r = random.Random(73)
    for t in (t for group in license_scan.TEMPLATES.values() for t in group):
        pairs = license_scan.template_pairs(t)
        for _ in range(50):
            some = r.sample(pairs, license_scan.needed(pairs))
            assert cues & {w for p in some for w in p.split()}


# --- pipeline and staged tables ---


NAMES = "doc_id long, text string, lang string, source string, n_chars long, mix_key double, mix_copy int, mix_size string, mix_copies int, kept_id long, row int, whole string, col string, kept string, node int, score_ double"


def test_stages_keep_columns_of_any_name(spark, tmp_path):
    r = random.Random(81)
    rows = [(i, prose(r, 40) + ".", "en", "ab"[i % 2], 1, 0.5, i, "s", 2, 3, 4, "w", "c", "k", 5, 0.1) for i in range(60)]
    rows += [(100 + i, rows[0][1] if i else prose(r, 20_000), "en", None, 1, 0.5, 7, "s", 2, 3, 4, "w", "c", "k", 5, 0.1) for i in range(2)]
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    before = spark.createDataFrame(rows, NAMES).repartition(3)
    for k, (_, work) in enumerate(corpus_pipeline.STAGES[:4]):
        after = work(spark, before, str(tmp_path))
        assert after.columns == before.columns
        after.write.parquet(f"{tmp_path}/{k}")
        before = spark.read.parquet(f"{tmp_path}/{k}")
        assert not {tuple(x) for x in before.collect()} - set(rows)
    assert corpus_pipeline.packing_stage(spark, before, str(tmp_path)).count() > 60


def test_stages_of_empty_tables(spark, tmp_path):
    none = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    none.write.parquet(f"{tmp_path}/documents.parquet")
    assert all(work(spark, none, str(tmp_path)).count() == 0 for _, work in corpus_pipeline.STAGES)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_results_of_stages_stay_usable(spark):
    """A result that isn't used before the next stage is called, nor before another pipeline runs."""
    r = random.Random(82)
    frames = [spark.createDataFrame([(i, prose(r, 30), "en", "a", 1) for i in range(20 * k)], "doc_id long, text string, lang string, source string, n_chars long") for k in (1, 2)]
    for work in (corpus_pipeline.exact_stage, corpus_pipeline.near_stage, corpus_pipeline.mixing_stage, corpus_pipeline.packing_stage):
        first, second = (work(spark, frame, "") for frame in frames)
        assert first.count() and second.count() and first.count() < second.count()


def test_run_leaves_no_stage_behind(spark, tmp_path):
    r = random.Random(83)
    spark.createDataFrame([(i, prose(r, 30), "en", "a", 1) for i in range(30)], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(30)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    folder = common.shared_dir(spark).removeprefix("file://")
    before = set(os.listdir(folder))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    left = {name.rsplit("-", 1)[0] for name in set(os.listdir(folder)) - before}
    assert left <= {"stage-4", "packing"}  # what the result reads


def test_a_cluster_has_to_name_its_shared_folder(spark):
    class Conf:
        def get(self, name, default=None):
            return default

    class Cluster:
        conf, sparkContext = Conf(), type("Context", (), {"master": "spark://host:7077"})()

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(Cluster())


def test_tokens_beyond_16_bits_are_refused():
    assert exact_dedup.directory({0: 10**6}, 4, 10).max() == 4
    with pytest.raises(OverflowError):
        packing.array("H", [1 << 16])
