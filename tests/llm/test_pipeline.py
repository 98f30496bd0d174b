"""The pipeline's stages, each held against brute force on what its predecessor kept."""

import random
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from test_corpus_operators import exact_brute, mix_brute, near_brute, prose, words

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long, score double"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    r = random.Random(11)
    rows, labels = [], []
    for i in range(300):
        bad = i % 6 == 0
        rows.append((i, prose(r, 40).upper().replace(" ", "!! ") if bad else prose(r, 60) + ".", "en", r.choice("aaab"), 1, 0.1))
        labels.append((i, int(not bad), 0))
    rows += [(1000 + i, rows[1 + i % 3][1].title(), "en", None, 1, 0.1) for i in range(20)]
    rows += [(2000 + i, f"{rows[7][1]} x{i}", "en", "c", 1, 0.1) for i in range(15)]
    rows += [rows[2], (3000, None, None, None, None, None), (3001, "", None, "a", None, None), (None, rows[3][1] + " more", "en", "b", 1, 0.1)]
    folder = tmp_path_factory.mktemp("data")
    spark.createDataFrame(rows, COLUMNS).repartition(4).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), [rows]
    for i, (_, work) in enumerate(corpus_pipeline.STAGES):
        out = work(spark, docs, str(folder))
        out.write.parquet(f"{folder}/{i}")
        docs = spark.read.parquet(f"{folder}/{i}")
        kept.append([tuple(x) for x in docs.collect()])
        if i < 4:
            assert docs.columns == [c.split()[0] for c in COLUMNS.split(", ")]
    return kept


def test_quality_stage(stages):
    before, after = Counter(stages[0]), Counter(stages[1])
    assert not after - before
    assert all(after[x] == n for x, n in before.items() if x[1] and not x[1].isupper())
    gone = [x for x in before if x[0] is not None and x[0] < 300 and x[0] % 6 == 0]
    assert np.mean([after[x] == 0 for x in gone]) > 0.95


def test_exact_stage(stages):
    assert Counter(x[0] for x in stages[2]) == Counter(doc for doc, _ in exact_brute(stages[1]).values())


def test_near_stage(stages):
    expected = {doc for doc, _, component in near_brute(stages[2]) if doc == component}
    assert Counter(x[0] for x in stages[3]) == Counter(expected) and len(stages[3]) < len(stages[2])


def test_near_stage_links_from_80_percent(spark):
    r, rows = random.Random(12), []
    for g in range(240):
        base = prose(r, 94, "abcdefghijklmnop").split()
        changed = 7 + g % 5  # (90 - k) / (90 + k): 0.86, 0.84, 0.82, 0.80 and 0.78
        rows += [(2 * g, " ".join(base)), (2 * g + 1, " ".join(base[:-changed] + prose(r, changed, "qrstuvwxyz").split()))]
    docs = spark.createDataFrame([(*x, None, "a", 1, 0.1) for x in rows], COLUMNS).repartition(3)
    got = Counter(x.doc_id for x in corpus_pipeline.near_stage(spark, docs, "").collect())
    expected = {doc for doc, _, component in near_brute(rows, percent=80) if doc == component}
    assert got == Counter(expected) and len(expected) < len({doc for doc, _, component in near_brute(rows) if doc == component})


def test_mixing_stage(stages):
    size, total, target = mix_brute(stages[3])
    taken = defaultdict(int)
    for x in stages[4]:
        taken[x[3]] += len(words(x[1]))
    assert not set(stages[4]) - set(stages[3]) and max(Counter(stages[4]).values()) <= 2
    assert all(abs(taken[s] - target[s]) <= max(size) for s in total)


def test_packing_stage(stages):
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    expected = sorted(token for x in stages[4] for token in (*tokenizer.encode(x[1] or "", add_special_tokens=False).ids, 1))
    assert sorted(np.concatenate([np.frombuffer(x[3], "<u4") for x in stages[5]]).tolist()) == expected
    place = 0
    for _, _, length, _, _, sequence, offset in sorted(stages[5], key=lambda x: (x[5], x[6])):
        assert sequence * 2048 + offset == place
        place += length
