"""WARC archives, vector codes and the filter audit against brute force, with their edge rows."""

import base64
import gzip
import hashlib
import math
import random
from collections import Counter
from itertools import permutations
from pathlib import Path

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from geostream.llm import filter_audit, license_scan, url_filter, vector_codes, warc
from geostream.llm.common import scratch

# --- WARC ---

PAGES = [
    (1, "http://a.de/x", "<html>eins</html>"), (2, "http://a.de/y", "<html>eins</html>"), (7, None, "<html>eins</html>"), (3, "http://b.de/\r\nWARC-Type: x y", "zwei"), (4, "http://c.de/", None), (5, "http://c.de/ä", ""),
    (None, "http://d.de/", "drei"), (None, "http://d.de/2", "drei"), (6, "http://d.de/3", "drei"), (8, "http://e.de/", "vier"), (8, "http://e.de/", "vier"), (9, "u", "ß" * 300_000), (None, None, "fünf"), (None, None, "fünf"),
]


def pages(spark, rows, schema="page_id long, url string, html string"):
    return spark.createDataFrame(rows, schema)


def archived(rows, least=0):
    """(page_id, bytes, digest, type, refers_to) by brute force; of repeated ids one is the response."""
    out, groups = [], {}
    for page, _, html in rows:
        groups.setdefault((html or "").encode(), []).append(page)
    for payload, ids in groups.items():
        ids.sort(key=lambda i: (i is not None, i or 0), reverse=True)
        digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
        for k, i in enumerate(ids):
            again = k > 0 and len(payload) >= least
            out.append((i, len(payload), digest, "revisit" if again else "response", ids[0] if again else None))
    return Counter(out)


@pytest.mark.parametrize("least", [0, 1, 5, 10**9])
def test_archives_round_trip(spark, least):
    got = warc.archive_pages(pages(spark, PAGES).repartition(3), least).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == archived(PAGES, least)
    texts = {(html or "").encode() for _, _, html in PAGES}
    assert {bytes(r.payload) for r in got if r.record_type == "response"} == texts and all(r.payload is None for r in got if r.record_type == "revisit")
    assert {r.target_uri for r in got} >= {"http://b.de/%0D%0AWARC-Type:%20x%20y", "http://c.de/%C3%A4", None}


def test_archives_of_nothing_and_of_other_columns(spark):
    assert warc.archive_pages(pages(spark, []).limit(0)).count() == 0
    odd = pages(spark, PAGES).withColumn("row", F.lit("x")).withColumn("sha", F.lit(1)).withColumn("a.b", F.lit(2)).withColumn("payload", F.lit(3))
    got = warc.archive_pages(odd).collect()
    assert Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got) == archived(PAGES)


def test_index_selects_records_and_archives_are_plain_warc(spark):
    folder = warc.shared_uri(spark, scratch(spark, "warc-test"))
    rows = [(i, f"http://h/{i}", f"text {i % 40} " * 50) for i in range(400)]
    index = warc.write_archives(pages(spark, rows).repartition(4), folder, file_bytes=4000)
    entries = index.collect()
    assert len(entries) == 400 and len({(e.file, e.offset) for e in entries}) == 400 and len({e.file for e in entries}) > 4
    for path in {e.file for e in entries}:
        data = Path(path.removeprefix("file://")).read_bytes()
        plain = gzip.decompress(data)  # members one after the other, as any reader takes them
        own = sorted((e.offset, e.length, e.url) for e in entries if e.file == path)
        assert plain.count(b"WARC/1.1\r\n") == len(own) + 1 and own[-1][0] + own[-1][1] == len(data)
        for offset, length, url in own:
            headers, block = warc.parse_record(gzip.decompress(data[offset : offset + length]))
            assert headers["warc-target-uri"] == url and len(block) == int(headers["content-length"])
    chosen = index.filter("page_id % 7 = 3")
    got = warc.read_archives(chosen, gap=100, most=2000).collect()
    assert {r.page_id for r in got} == {i for i in range(400) if i % 7 == 3} and len(got) == chosen.count()


def test_ranges_coalesce():
    rows = [(0, 10), (10, 10), (25, 5), (100, 10), (110, 500), (610, 10)]
    assert list(warc._ranges(rows, gap=5, most=40)) == [(0, 3), (3, 4), (4, 5), (5, 6)]
    assert list(warc._ranges(rows, gap=1000, most=10_000)) == [(0, 6)]


def test_damaged_archives_are_errors():
    record = warc.page_record(1, 0, "u", 3, "D", b"abc", None, "1970-01-01T00:00:00Z")
    assert warc.parse_record(record)[0]["warc-type"] == "response"
    for bad in (record[:-1], record + b"x", b"HTTP" + record):
        with pytest.raises(ValueError):
            warc.parse_record(bad)


# --- vector codes ---


def codes_brute(rows, parts=4, entries=256, rounds=4):
    kept = [(i, [int(math.floor(1024 * x)) for x in v], label) for i, v, label in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    width = -(-max((len(v) for _, v, _ in kept), default=0) // parts)
    kept = [(i, v + [0] * (parts * width - len(v)), label) for i, v, label in kept]
    cut = [[v[p * width : (p + 1) * width] for _, v, _ in kept] for p in range(parts)]
    order = sorted(range(len(kept)), key=lambda j: (kept[j][0] is None, kept[j][0] or 0, kept[j][1]))[:entries]
    books = [[list(cut[p][j]) for j in order] for p in range(parts)]
    codes, errors = ["" for _ in kept], [0 for _ in kept]
    for turn in range(rounds + 1):
        for p in range(parts):
            own = [min((sum((a - b) ** 2 for a, b in zip(x, e)), k) for k, e in enumerate(books[p])) for x in cut[p]]
            if turn == rounds:
                codes, errors = [c + f"{k:02x}" for c, (_, k) in zip(codes, own)], [e + d for e, (d, _) in zip(errors, own)]
            else:
                for k in range(len(books[p])):
                    if mine := [x for x, (_, own_k) in zip(cut[p], own) if own_k == k]:
                        books[p][k] = [sum(c) // len(mine) for c in zip(*mine)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    sums = Counter()
    for (_, _, label), e in zip(kept, errors):
        sums[label] += e
    most = 2**63 - 1
    return Counter((i, c, min(e, most), min(sums[label], most), digest) for (i, _, label), c, e in zip(kept, codes, errors))


def coded(spark, rows, kind="double", **params):
    df = spark.createDataFrame(rows, f"vec_id long, embedding array<{kind}>, label int").repartition(3)
    return Counter(map(tuple, vector_codes.compress(df, **params).select("vec_id", "code", "error", "label_error", "codebooks_sha256").collect()))


def clouds(n, dim, seed, spread=0.05, centres=12):
    r = random.Random(seed)
    mid = [[r.gauss(0, 0.3) for _ in range(dim)] for _ in range(centres)]
    return [(i, [x + r.gauss(0, spread) for x in mid[i % centres]], i % 5 if i % 7 else None) for i in range(n)]


@pytest.mark.parametrize(("n", "entries", "near"), [(300, 16, 4), (300, 16, 15), (400, 64, 8), (200, 256, 16), (50, 1, 16)])
def test_codes_are_those_of_a_full_search(spark, n, entries, near):
    rows = clouds(n, 10, n + entries)
    assert coded(spark, rows, entries=entries, near=near) == codes_brute(rows, entries=entries)


def test_codes_of_ties_repeats_and_odd_rows(spark):
    r = random.Random(4)
    grid = [(i, [float(r.randrange(-2, 3)) / 512 for _ in range(8)], i % 2) for i in range(250)]  # equal parts and equal distances abound
    nan, inf = float("nan"), float("inf")
    odd = [(None, [0.5] * 8, None), (None, [0.25] * 8, 1), (3, grid[3][1], 0), (3, [0.1] * 8, None), (900, None, 1), (901, [nan] * 8, 1), (902, [inf] + [0.0] * 7, 1), (903, [None] + [0.0] * 7, 1), (904, [0.3, -0.3, 0.1], 2), (905, [], 2), (906, [0.7] * 9, 2)]
    for entries in (4, 40):
        assert coded(spark, grid + odd, entries=entries, near=3) == codes_brute(grid + odd, entries=entries)


def test_codes_of_large_components_are_exact(spark):
    r = random.Random(9)
    rows = [(i, [r.uniform(-1, 1) * 10 ** r.randrange(0, 14) for _ in range(8)], i % 3) for i in range(120)]
    assert coded(spark, rows, entries=8, near=3) == codes_brute(rows, entries=8)
    assert sum(coded(spark, [*rows, (500, [1e300, -1e300] * 4, 7)], entries=8, near=3).values()) == 121


def test_codes_of_nothing(spark):
    assert coded(spark, []) == Counter() == coded(spark, [(1, None, 1)])
    assert coded(spark, [(1, [], 1)]) == codes_brute([(1, [], 1)])


def test_bounds_hold_while_entries_move():
    rng = np.random.default_rng(5)
    x, books = rng.integers(-500, 500, (2000, 6)), rng.integers(-500, 500, (64, 6))
    s, b, skipped = vector_codes.full_search(x, books, 12, True), 12, 0
    for turn in range(8):
        new = books + rng.integers(-40, 40, books.shape) // (turn + 1)
        moved = vector_codes._above(vector_codes.squared_pairs(new, books))
        s, used = vector_codes.adapt(x, new, moved, s, b, True)
        b, books = max(1, min(b, used)), new
        d2 = vector_codes.squared(x, books, True)
        assert (s.own == d2.argmin(1)).all() and (s.d2 == d2.min(1)).all()
        d = np.sqrt(d2)
        rest = np.ones_like(d, bool)
        rest[np.arange(len(x)), s.own] = False
        held = vector_codes._ascending(s.low, s.outer)
        for z in range(s.near.shape[1]):
            assert (held[:, z] <= np.where(rest, d, np.inf).min(1)).all()
            rest[np.arange(len(x)), s.near[:, z]] = False
        assert (s.outer <= np.where(rest, d, np.inf).min(1)).all()
        skipped += (s.outer < np.inf).sum()
    assert skipped


# --- filter audit ---


def audit_brute(docs, labels):
    least = {}
    for i, text, _ in docs:
        if i is not None:
            least[text or ""] = min(least.get(text or "", i), i)
    good = {i for i, q, _ in labels if q == 1 and i is not None}
    toxic = {i for i, _, t in labels if t == 1 and i is not None}
    rows = []
    for i, text, part in docs:
        text = text or ""
        words = [w for w in text.translate({c: " " for c in range(9, 14)}).split(" ") if w]
        fails = set()
        if len(words) < 50:
            fails.add("A")
        if 100 * len(set(words)) < 65 * len(words):
            fails.add("B")
        if 100 * sum("A" <= c <= "Z" for c in text) > 5 * len(text):
            fails.add("C")
        if any(c in "#$%&*|" for c in text):
            fails.add("D")
        if i is not None and text in least and least[text] < i:
            fails.add("E")
        rows.append((part or "", fails, i in good, i in toxic))
    out = {}
    for part in {r[0] for r in rows}:
        own = [r for r in rows if r[0] == part]
        shapley = Counter()
        for order in permutations("ABCDE"):
            left = own
            for step, f in enumerate(order, 1):
                gone = [r for r in left if f in r[1]]
                left = [r for r in left if f not in r[1]]
                failing = [r for r in own if f in r[1]]
                shapley[f] += len(gone)
                out[part, "".join(order), step] = [len(left), len(gone), len(failing) - len(gone), sum(r[1] == {f} for r in own), sum(r[2] for r in gone), sum(r[3] for r in gone)]
        for (p, order, step), values in out.items():
            if p == part:
                values.append(shapley[order[step - 1]])
    return {k: tuple(v) for k, v in out.items()}


def audited(spark, docs, labels):
    d = spark.createDataFrame(docs, "doc_id long, text string, source string").withColumn("mask", F.lit("x")).withColumn("a.b", F.lit(1)).withColumn("part", F.lit(2)).repartition(3)
    got = filter_audit.audit(d, spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    assert len({(r.part, r.filter_order, r.step) for r in got}) == len(got)
    return {(r.part, r.filter_order, r.step): tuple(r[c] for c in ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")) for r in got}


def test_audit_is_that_of_applying_the_filters(spark):
    r = random.Random(12)
    vocabulary = [f"wort{i}" for i in range(120)] + ["Ä", "ß x", "Zwölf"]
    docs = []
    for i in range(300):
        words = [r.choice(vocabulary[: r.choice([20, 123])]) for _ in range(r.choice([3, 49, 50, 51, 80, 200]))]
        if r.random() < 0.3:
            words.append(r.choice("#$%&*|"))
        if r.random() < 0.3:
            words = [w.upper() if r.random() < 0.2 else w for w in words]
        docs.append((i, r.choice([" ", "\t", "\n\n", "\x0b", " \r "]).join(words), r.choice(["web", "buch", None, ""])))
    docs += [(1000 + i, docs[r.randrange(300)][1], "kopie") for i in range(80)] + [(5, docs[9][1], "web"), (5, docs[9][1], "web"), (None, docs[9][1], "web"), (None, "ohne", None), (None, "ohne", None), (2000, None, "leer"), (2001, "", "leer"), (2002, "A " * 100_000, "lang")]
    labels = [(i, r.choice([0, 1, None]), r.choice([0, 1, None])) for i in range(0, 300, 2)] + [(4, 1, 0), (4, 0, 1), (None, 1, 1), (2000, 1, 0), (9999, 1, 1)]
    assert audited(spark, docs, labels) == audit_brute(docs, labels)


def test_audit_of_nothing(spark):
    assert audited(spark, [], []) == {}
    one = audited(spark, [(1, None, None)], [])
    assert len(one) == 600 and one == audit_brute([(1, None, None)], [])


@pytest.mark.parametrize("k", [1, 2, 4])
def test_walk_holds_every_subset(k):
    cells = np.random.default_rng(k).integers(0, 50, (3, 1 << k, 2))
    got = filter_audit.walk(cells, k)
    for subset in range(1 << k):
        assert (got[:, subset] == cells[:, [m for m in range(1 << k) if not m & subset]].sum(1)).all()


def test_audit_of_other_filters(spark):
    masks = spark.createDataFrame([("a", 0, True), ("a", 1, True), ("a", 3, False), ("b", 2, True)], "part string, mask int, seen boolean")
    got = filter_audit.audit_orders(masks, "XY", {"seen": F.col("seen")})
    assert {tuple(r) for r in got.collect()} >= {("a", "XY", 1, 1, 2, 0, 1, 1, 3), ("a", "XY", 2, 1, 0, 1, 0, 0, 1), ("b", "YX", 1, 0, 1, 0, 1, 1, 2), ("b", "YX", 2, 0, 0, 0, 0, 0, 0)}
    with pytest.raises(ValueError):
        filter_audit.audit_orders(masks, "ABCDEFGH", {})


# --- licences that need telling apart ---


def test_licences_that_need_telling_apart(spark):
    r = random.Random(21)
    vocabulary = [f"wort{i}" for i in range(60)] + "the of and to in a is that for it as with on by at this be are from or an under terms".split()
    prose = lambda n: " ".join(r.choice(vocabulary) for _ in range(n))
    bsd = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"
    said = {
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License": ["cc-by-nc-sa"],
        "Licensed under CC BY-NC-SA 4.0": ["cc-by-nc-sa"],
        "SPDX-License-Identifier: CC-BY-NC-SA-4.0": ["cc-by-nc-sa"],
        "SPDX-License-Identifier: CC-BY-NC-ND-4.0": ["cc-by-nc-nd"],
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License": ["cc-by-nc"],
        "Licensed under CC BY-SA 4.0": ["cc-by-sa"],
        f"Copyright (c) 2011, The Authors. All rights reserved. {bsd}": ["bsd"],
        "Copyright (c) 2014 Example Corporation. All rights reserved.": ["proprietary"],
        "that all rights reserved to the states remain with the people": [],
        "SPDX-License-Identifier: MIT OR Apache-2.0": ["apache-2.0", "mit"],
        "SPDX-License-Identifier: Apache-2.0 OR MIT": ["apache-2.0", "mit"],
        "Licensed under the MIT license or the Apache License, Version 2.0": ["apache-2.0", "mit"],
        "It is not released under the MIT License": [],
        "this library was never licensed under the Apache License, Version 2.0": [],
        "Licensed under the Eclipse Public License 2.0": ["epl"],
        "SPDX-License-Identifier: EUPL-1.2": ["eupl"],
        "SPDX-License-Identifier: Artistic-2.0": ["artistic-2.0"],
        "SPDX-License-Identifier: GPL-2.0": ["gpl"],
        "This work is licensed under the GNU Lesser General Public License, version 3": ["lgpl"],
        "Released under the MIT License": ["mit"],
    }
    rows = [(i, "\n\n".join(prose(r.randint(20, 60)) for _ in range(4))) for i in range(100)]
    rows += [(1000 + 10 * i + k, text if k == 0 else f"{prose(12)}\n{text}.\n{prose(25)}") for i, text in enumerate(said) for k in range(3)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    model = license_scan.fit(frame)
    got = {x.doc_id: x.licenses for x in license_scan.scan(frame, model).collect()}
    assert {(text, k): got[1000 + 10 * i + k] for i, text in enumerate(said) for k in range(3)} == {(text, k): own for text, own in said.items() for k in range(3)}
    assert all(got[i] == [] for i in range(100))
    found = license_scan.classified(license_scan.candidates(frame, model.templates).filter("found is not null"), model)
    assert found.filter(F.col("licensed") < model.threshold).select("doc_id").distinct().count() >= 9  # confirmed by a template, unknown to the classifier


# --- columns with dots ---


def test_columns_with_dots_pass_through(spark, tmp_path):
    r = random.Random(5)
    rows = [(i, " ".join(r.choice(["haus", "baum", "see", "weg", "tal", "berg"]) + str(r.randrange(40)) for _ in range(60)), "de", "s", 1, i, f"x{i}", i * 2) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, `a.b` long, `c d` string, `doc_id.x` long")
    spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", "a.b", "c d", "doc_id.x"]
    assert docs.count() >= 30 and all(x["a.b"] == x.doc_id and x["doc_id.x"] == 2 * x.doc_id for x in docs.collect())
    assert corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).count() > 0
    pages = spark.createDataFrame([(1, "http://a.net/x", 5), (2, "http://b.de/y", 6)], "page_id long, url string, `a.b` long")
    assert {(x.page_id, x["a.b"]) for x in url_filter.judge(pages).collect()} == {(1, 5), (2, 6)}
