"""The corpus operators against brute force, exact round trips and held-out accuracy, with their edge cases."""

import hashlib
import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from geostream.llm import exact_dedup, language_id, license_scan, mixing, near_dup, packing, quality, toxicity, units, url_filter, vector_dedup
from geostream.llm.common import Shingler, connected_components

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, held_out string, rejected int, target double"
LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def docs(spark, rows):
    """rows: (doc_id, text[, lang[, source]]); the extra columns clash with names that the operators use."""
    full = [(*r, *[None] * (4 - len(r)), 0, 0.5, "x", 1, 2.0) for r in rows]
    return spark.createDataFrame(full, SCHEMA)


def words(text):
    return (text or "").encode().translate(LOWER).split()


def prose(r, n, letters="abcdefgh"):
    return " ".join("".join(r.choice(letters) for _ in range(r.randint(1, 6))) for _ in range(n))


def edge_rows():
    r = random.Random(1)
    base = prose(r, 120)
    longer = prose(r, 20_000)
    return [(1, base, "en", "a"), (2, base.upper(), "en", "a"), (3, base + " tail", "en", "b"), (4, None, None, None), (5, "", "en", "b"), (6, "one two", "en", "a"), (7, "ONE two", "en", None),
            (8, longer, "en", "a"), (9, longer[:-1] + "z", "en", "c"), (None, base, "en", "a"), (6, "one two", "en", "a"), (10, "\t\n ", "en", "c"), (11, prose(r, 50), None, "b"), (12, "12 !!", "en", "b")]


# --- exact dedup ---


def exact_brute(rows):
    groups = defaultdict(list)
    for i, row in enumerate(rows):
        groups[(row[1] or "").encode().translate(LOWER)].append((row[0] is not None, row[0] or 0, -i, row[0]))
    return {key: (max(g)[3], len(g)) for key, g in groups.items()}


@pytest.mark.parametrize("keep_bytes", [1, 64 << 20])
def test_exact_groups(spark, keep_bytes):
    rows = edge_rows() + [(i, f"copy {i % 7}") for i in range(100, 400)]
    brute = exact_brute(rows)
    got = exact_dedup.exact_groups(docs(spark, rows).repartition(5), bucket_keys=3, keep_bytes=keep_bytes).collect()
    assert len(got) == len(rows)
    expected = Counter((r[0], *brute[(r[1] or "").encode().translate(LOWER)], hashlib.sha256((r[1] or "").encode().translate(LOWER)).hexdigest()) for r in rows)
    assert Counter((r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in got) == expected
    assert sum(r.kept for r in got) == len(brute)


def test_exact_groups_chain_collisions(spark):
    rows = [(i, f"text {i % 20}") for i in range(200)]
    got = exact_dedup.exact_groups(docs(spark, rows), digest=lambda text: 7 << 60).collect()
    assert {(r.doc_id, r.keep_id, r.group_size) for r in got} == {(i, 180 + i % 20, 10) for i in range(200)}


def test_directory_doubles():
    own = exact_dedup.directory({0: 5, 1: 5, 7: 1}, 3, 6)
    assert own.tolist() == [0, 1, 2, 2, 3, 3, 3, 3]
    assert exact_dedup.directory({}, 3, 6).max() == 0


def test_empty_tables(spark):
    none = docs(spark, []).limit(0)
    assert exact_dedup.exact_groups(none).count() == 0
    assert near_dup.near_duplicates(none).count() == 0
    assert mixing.mix(none).count() == 0
    assert packing.pack(none).count() == 0
    assert language_id.language_id(none).count() == 0
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.classify(none, labels).count() == 0
    assert toxicity.classify(none, labels).count() == 0
    assert url_filter.judge(spark.createDataFrame([], "page_id long, url string")).count() == 0
    assert vector_dedup.near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert license_scan.scan(none).count() == 0


# --- near dedup ---


def near_brute(rows, percent=85):
    sets = []
    for row in rows:
        w = words(row[1])
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and rows[i][0] is not None and rows[j][0] is not None:
                both = len(sets[i] & sets[j])
                if 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                    up[root(i)] = root(j)
    least = {}
    for i, row in enumerate(rows):
        if row[0] is not None:
            least[root(i)] = min(least.get(root(i), row[0]), row[0])
    return Counter((row[0], len(sets[i]), None if row[0] is None else least[root(i)]) for i, row in enumerate(rows))


def edited(r, text, share):
    return " ".join("".join(r.choice("abcdefgh") for _ in range(4)) if r.random() < share else w for w in text.split())


@pytest.mark.parametrize("chunk", [512, 6])
def test_near_duplicates(spark, chunk):
    r = random.Random(4)
    rows = edge_rows()
    passage = prose(r, 60)
    for g in range(12):
        base = prose(r, 150)
        rows += [(100 + 40 * g + i, edited(r, base, r.choice([0.0, 0.01, 0.02, 0.04]))) for i in range(12)]
    rows += [(2000 + i, prose(r, 80) + " " + passage + " " + prose(r, 80)) for i in range(40)]
    got = near_dup.near_duplicates(docs(spark, rows).repartition(3), chunk=chunk).collect()
    assert Counter((x.doc_id, x.n_shingles, x.component_id) for x in got) == near_brute(rows)
    assert all(x.kept == (x.doc_id == x.component_id) for x in got)


def test_shingler_matches_words():
    r = random.Random(2)
    texts = [prose(r, n) for n in (0, 1, 4, 5, 6, 300)] + ["a\u00a0b c", "  x\x0by\x0cz  ", "A b C d E", "a B c D e", None, "é ü"]
    got = list(Shingler(block=64).rows(pa.array(texts, pa.string())))
    sizes = [len({tuple(w[i : i + 5]) for i in range(len(w) - 4)}) if len(w) >= 5 else min(len(w), 1) for w in map(words, texts)]
    assert [len(x) for x in got] == sizes
    assert (got[8] == got[9]).all() and not set(got[5].tolist()) & set(got[3].tolist())


def test_sketches_merge_and_estimate():
    sketch, rng = near_dup.SetSketch(), np.random.default_rng(1)
    pool = rng.integers(0, 1 << 63, size=3000, dtype=np.uint64)
    a, b = pool[:2000], pool[1000:]
    assert (sketch.merge(sketch.registers(a), sketch.registers(b)) == sketch.registers(pool)).all()
    assert (sketch.registers(pool, part=7) == sketch.registers(pool)).all()
    near = sketch.registers(pool[:2000]), sketch.registers(pool[100:2000])
    above, below = (near[0] > near[1]).sum(), (near[0] < near[1]).sum()
    assert sketch.likely(np.array([above]), np.array([below]), 2000, np.array([1900.0]), 0.8)[0]
    far = sketch.registers(a), sketch.registers(b)
    assert not sketch.likely(np.array([(far[0] > far[1]).sum()]), np.array([(far[0] < far[1]).sum()]), 2000, np.array([2000.0]), 0.7)[0]


def test_components(spark):
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, 9), (9, 7), (7, 5), (200, 300)]
    got = dict(map(tuple, connected_components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {**{i: 100 for i in range(100, 161)}, 5: 5, 7: 5, 9: 5, 200: 200, 300: 200}


def test_units_meet_every_pair_once(spark):
    hits = spark.createDataFrame([(1, i) for i in range(25)] + [(2, 0), (2, 1), (3, 5)], "bucket long, node long")
    seen = Counter()
    by = defaultdict(list)
    for r in units.into_units(hits, 6).collect():
        by[(r.bucket, r.unit)].append(r)
    for (bucket, _), rows in by.items():
        two = rows[0].side != rows[0].other
        seen.update((bucket, min(a.node, b.node), max(a.node, b.node)) for i, a in enumerate(rows) for b in rows[:i] if not two or a.side != b.side)
    assert set(seen.values()) == {1} and len(seen) == 25 * 24 // 2 + 1


# --- mixing ---


def mix_brute(rows, seed=17):
    weight, key = {}, {}
    size = [len(words(r[1])) for r in rows]
    sources = sorted({r[3] for r in rows}, key=lambda s: (s is None, s or ""))
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sources)}
    total = {s: sum(n for n, r in zip(size, rows) if r[3] == s) for s in sources}
    target, free, left = {}, set(sources), 1.5 * sum(size)
    while True:
        share = {s: left * weights[s] / sum(weights[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 2 * total[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 2.0 * total[s]
            left -= target[s]
            free.discard(s)
        if not free:
            break
    return size, total, target


def test_mix(spark):
    r = random.Random(3)
    rows = edge_rows() + [(100 + i, prose(r, r.randint(1, 60)), "en", r.choice("aaabcdefg")) for i in range(600)]
    size, total, target = mix_brute(rows)
    got = mixing.mix(docs(spark, rows), bucket_rows=10).collect()
    again = mixing.mix(docs(spark, rows).repartition(7), bucket_rows=1000, texts=False).collect()
    assert Counter((x.doc_id, x.mix_size, x.mix_copies) for x in got) == Counter((x.doc_id, x.mix_size, x.mix_copies) for x in again)
    taken = defaultdict(int)
    for x in got:
        assert x.mix_source_size == total[x.source] and x.mix_target == pytest.approx(target[x.source]) and x.mix_copies <= 2
        taken[x.source] += x.mix_size * x.mix_copies
    largest = max(n for n, row in zip(size, rows) if row[3] != "a")
    assert all(abs(taken[s] - target[s]) <= (20_000 if s in "ac" and s else largest) for s in total if s is not None)
    assert set(got[0].asDict()) == {*[x.split()[0] for x in SCHEMA.split(", ")], "mix_size", "mix_source_size", "mix_target", "mix_copies"}


# --- packing ---


def test_pack_round_trip(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = edge_rows() + [(50, "special <|endoftext|> inside<|endoftext|>"), (51, "日本語 and ünïcödé 🙂"), (52, "x" * 500)]
    pieces = packing.pack(docs(spark, rows).repartition(3), length=64).collect()
    by = defaultdict(list)
    for p in pieces:
        by[p.doc_id].append(p)
    expected = Counter((r[0], tuple(tokenizer.encode(r[1] or "", add_special_tokens=False).ids) + (1,)) for r in rows)
    got = Counter()
    for doc, own in by.items():
        ids = []
        for p in sorted(own, key=lambda p: (p.sequence_id, p.offset)):
            ids += np.frombuffer(p.ids, "<u4").tolist()
            assert p.length == len(p.ids) // 4
            if p.start + p.length == p.doc_tokens:
                got[(doc, tuple(ids))] += 1
                ids = []
    assert got == expected
    at = sorted((p.sequence_id, p.offset, p.length) for p in pieces)
    place = 0
    for sequence, offset, length in at:
        assert sequence * 64 + offset == place and offset + length <= 64
        place += length


# --- classifiers ---

LANGS = {"xx": "abcdef", "yy": "defghi", "zz": "мнопрс"}


def test_language_id(spark):
    r = random.Random(5)
    rows = [(i, prose(r, 40, LANGS[lang]), lang) for i, lang in enumerate(r.choices(list(LANGS), k=300))]
    rows += [(1000, None), (1001, ""), (1002, "12 !?"), (None, rows[0][1], "xx"), rows[1]]
    got = language_id.language_id(docs(spark, rows)).collect()
    truth = {x[0]: x[2] for x in rows if len(x) > 2 and x[0] is not None}
    held = [x for x in got if x.held_out and x.doc_id in truth]
    assert len(got) == len(rows) and held and all(x.lang_pred == truth[x.doc_id] for x in held)
    assert {(x.lang_pred, x.score) for x in got if x.doc_id in (1000, 1001, 1002)} == {("und", 0.0)}
    assert all(x.held_out == (x.doc_id is not None and zlib.crc32(str(x.doc_id).encode()) % 5 == 0) and 0 <= x.score <= 1 for x in got)


def test_quality(spark):
    r = random.Random(6)
    rows, labels = [], []
    for i in range(400):
        good = i % 4 > 0
        text = prose(r, 80) + "." if good else r.choice([" ".join(["spam"] * 90), prose(r, 80).upper().replace(" ", "!! "), prose(r, 60).replace(" ", "### ")])
        rows.append((i, text))
        labels.append((i, int(good), 0))
    rows += [(900, None), (901, ""), (902, "a")]
    got = quality.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    held = [x for x in got if x.held_out and x.doc_id < 400]
    assert len(got) == len(rows) and np.mean([x.predicted == (x.doc_id % 4 > 0) for x in held]) > 0.97
    assert all(0 <= x.score <= 1 and x.predicted == (x.score >= 0.5) for x in got)
    assert {x.doc_id: x.score for x in got}[901] == 0


def test_most_frequent_word_counts_every_word():
    r = random.Random(9)
    for share in (0.1, 0.3, 0.6, 0.9):
        text = [f"w{i}" for i in range(300)]
        for i in r.sample([i for i in range(5, 295) if not 145 <= i < 158], int(270 * share)):
            text[i] = "stuffed"  # neither first, nor in the middle, nor last
        bins = quality.terms(" ".join(text))[(1 << quality.BITS) + 7 * quality.BINS :][: quality.BINS]
        assert bins.tolist().index(1) == int(math.sqrt(text.count("stuffed") / 300) * quality.BINS)


def test_neighbours_are_exact():
    rng = np.random.default_rng(2)
    counts = rng.poisson(0.05, (60, quality.WIDTH)).astype(np.float32)
    model = quality.Model(np.arange(60) % 2, counts, rank=16, neighbours=5)
    x = model.latent(model.weigh(counts[:7]))
    near = x @ model.vectors.T
    for i, row in enumerate(near):
        at = np.argsort(-row)[:5]
        w = np.exp(20 * (row[at].astype(float) - row.max()))
        assert model.score(counts[:7])[i] == pytest.approx((w * model.labels[at]).sum() / w.sum(), abs=1e-5)


def test_toxicity(spark):
    r = random.Random(7)
    rows, labels = [], []
    for i in range(300):
        toxic = i % 3 == 0
        w = prose(r, 60).split()
        if toxic:
            for _ in range(3):
                w.insert(r.randrange(len(w)), r.choice(["moronix", "1oathly", "m0r0nix!", "vilest", "mоrоnix"]))
        elif i % 5 == 0:
            w.insert(5, "so vilest")
        rows.append((i, " ".join(w)))
        labels.append((i, 1, int(toxic)))
    rows += [(900, None), (901, ""), (902, "a clean text")]
    got = {x.doc_id: x for x in toxicity.classify(docs(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    held = [x for x in got.values() if x.held_out and x.doc_id < 300]
    assert np.mean([x.predicted == (x.doc_id % 3 == 0) for x in held]) > 0.95
    assert got[900].predicted == got[901].predicted == got[902].predicted == 0


def test_folding_and_exceptions():
    lexicon = toxicity.Lexicon({"loser": 4.0, "scum": 3.0}, {"pond scum"})
    find = lambda text: [m[0] for m in lexicon.matches(toxicity.fold(text))]
    assert find("L0SER, 1oser ｌｏｓｅｒ los\u200ber lоser") == ["loser"] * 5
    assert find("closer losers pond scum") == [] and find("pond, old scum") == ["scum"]
    assert toxicity.fold("scum$$$ a$s") == "scum$$$ ass"


# --- urls and licences ---


def test_urls(spark):
    urls = ["http://A.Example.NET/en/1?x", "https://x.net/de/1", "http://net/", "http://notnet/x", "http://m.example.com/de/5.html", "http://EXAMPLE.com/DE/5", "http://a.org/fr/1", "no scheme", None, "", "x://h", "http://h?q://z/", "http://a.net#/b"]
    got = {r.page_id: r for r in url_filter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").withColumn("host", F.lit("clash"))).collect()}
    assert [got[i].rule for i in range(len(urls))] == ["example.net/en/", "net/", "net/", None, "example.com/de/", None, "org/fr/", None, None, None, None, None, None]
    assert [(got[i].host, got[i].path) for i in (0, 5, 7, 8, 10, 11, 12)] == [("a.example.net", "/en/1"), ("example.com", "/DE/5"), ("", ""), ("", ""), ("h", ""), ("h", ""), ("a.net", "")]
    assert [got[i].verdict for i in (0, 1, 4, 6)] == ["allow", "block", "block", "allow"]


def test_url_templates(spark):
    rows = [(i, f"http://h/bad/{i}") for i in range(50)] + [(100 + i, f"http://h/bad/{'abcdefgh'[i % 8]}{i}x") for i in range(50)] + [(200 + i, f"http://h/good/{i}") for i in range(90)]
    got = url_filter.judge(spark.createDataFrame(rows, "page_id long, url string"), rules=[(f"h/bad/{d}", "block") for d in range(1, 10)] + [(f"h/bad/{c}", "block") for c in "abcdefg"])
    by = {r.page_id: r for r in got.collect()}
    assert by[0].rule is None and by[0].template == "/bad/*" and by[0].verdict == "block" and by[250].verdict == "allow"
    assert all(r.rule is None and r.verdict == "block" for r in by.values() if 100 <= r.page_id < 200 and (r.page_id - 100) % 8 == 7)


def test_licences(spark):
    r = random.Random(8)
    marks = {"mit": "Released under the MIT License.", "gpl": "This work is licensed under the GNU General Public License, version 3.", "cc-by-nc": "Licensed under CC BY-NC 4.0.", "apache-2.0": "Licensed under the Apache License, Version 2.0."}
    rows = []
    for i in range(120):
        own = list(marks.values())[i // 10 % 4] if i % 10 == 0 else "the licence of the old inn was under the bar" if i % 10 == 1 else prose(r, 9)
        rows.append((i, "\n".join([prose(r, 30), own, prose(r, 20)])))
    rows += [(500, None), (501, "")]
    got = {x.doc_id: x for x in license_scan.scan(docs(spark, rows)).collect()}
    assert len(got) == len(rows)
    assert {i: got[i].license for i in range(0, 120, 10)} == {i: list(marks)[i // 10 % 4] for i in range(0, 120, 10)}
    assert all(got[i].license is None for i in got if i % 10 or i >= 500)


def test_licences_over_wrapped_lines(spark):
    r = random.Random(10)
    rows = [(i, "\n".join(prose(r, 12) for _ in range(4))) for i in range(60)]
    by = "This work is licensed under a Creative\nCommons Attribution 4.0 International License"
    rows += [(100, f"{prose(r, 9)}\n{by}\n{prose(r, 9)}"), (101, by.replace("Creative\n", "Creative\n\n")), (102, "\n".join(by.split())), (103, f"Released under the MIT License.\n{prose(r, 9)}\n\n{by}"), (104, by.replace("\n", " "))]
    got = {x.doc_id: x for x in license_scan.scan(docs(spark, rows).repartition(2)).collect()}
    assert {i: got[i].licenses for i in range(100, 105)} == {100: ["cc-by"], 101: [], 102: ["cc-by"], 103: ["cc-by", "mit"], 104: ["cc-by"]}
    assert [got[i].n_paragraphs for i in range(100, 105)] == [1, 0, 1, 2, 1]
    assert all(got[i].license is None and got[i].licenses == [] for i in range(60))


# --- vectors ---


def test_vectors(spark):
    rng = np.random.default_rng(9)
    centres = rng.standard_normal((40, 64))
    rows = [c + rng.standard_normal(64) * s for c in centres for s in (0.0, 0.0, 0.05, 0.15, 0.25, 0.3)] + list(rng.standard_normal((200, 64)))
    x = np.array(rows, np.float32)
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(900, None), (901, [0.0] * 64), (902, [float("nan")] * 64), (903, [float("inf")] * 64), (904, [1.0, None]), (905, [])]
    y = x.astype(float) / np.linalg.norm(x.astype(float), axis=1, keepdims=True)
    linked = y @ y.T >= 0.95
    np.fill_diagonal(linked, False)
    for chunk in (1024, 5):
        got = {r.vec_id: r for r in vector_dedup.near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>"), chunk=chunk).collect()}
        found = sum(got[i].n_links for i in range(len(x)))
        assert found >= 0.97 * linked.sum() and all(got[i].n_links <= linked[i].sum() for i in range(len(x)))
        assert all(got[i].component_id <= i and (got[i].component_id == i) == got[i].kept for i in range(len(x)))
        assert all(got[i].n_links == 0 and got[i].kept for i in range(900, 906))


def test_caps_list_every_exceeding_direction():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((20, 10))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    code = vector_dedup.ProductCode(10, 16, 2, 8.0, 1)
    for own, row in zip(code.decode(x), x):
        for t in range(2):
            sums = (code.left[t] @ row[:5])[:, None] + (code.right[t] @ row[5:])[None, :]
            expected = {int(i * 16 + j + t * 256) for i, j in zip(*np.nonzero(sums >= code.height))} or {int(sums.argmax()) + t * 256}
            assert {f for f in own.tolist() if f // 256 == t} == expected
    assert math.isfinite(code.height)
