"""Steps whose memory or time grew with the largest file or group (review r03)."""

import pytest
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Window
from pyspark.sql import functions as F

from geostream.functions import text
from geostream.llm import license_scan
from geostream.operators import ordered, series
from geostream.sources import coordinates, lines
from geostream.sources import telemetry as sentences


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_lines_of_splits_are_numbered_without_sorting_them(spark, tmp_path):
    (tmp_path / "a.txt").write_text("".join(f"{i}\n" for i in range(1000)))
    df = lines.read_lines(spark, str(tmp_path), whole=-1)
    assert "row_number" not in plan_of(df)
    assert [(x.line_no, x.line) for x in df.orderBy("line_no").collect()] == [(i + 1, str(i)) for i in range(1000)]


def test_polylines_are_numbered_across_blocks(spark, tmp_path):
    bodies = {"a": "9 9\n> one\n1 1\n\n2 2\n3 3\n4 4\n5 5\n> none\n >two\nx y\n6 6\n" + "7 7\n" * 20 + ">\n8 8\n", "b": "> only\n" + "1 2\n" * 9, "c": "1 1\n2 2\n", "d": "\n"}
    expected = set()
    for name, body in bodies.items():
        (tmp_path / name).write_text(body)
        segment = seq = 0
        for line in body.split("\n"):
            if line.lstrip().startswith(">"):
                segment, seq = segment + 1, 0
            elif line.strip():
                seq += 1
                if line != "x y":
                    expected.add((name, segment if ">" in body else 0, seq, *map(float, line.split())))
    for block in (1, 2, 3, 7, 1 << 16):
        rows = coordinates.read_polylines(spark, str(tmp_path), block=block)
        assert "partitionBy" not in plan_of(rows) and "windowspecdefinition(file_path" not in plan_of(rows)
        got = rows.collect()
        assert {(x.file_name, x.segment_id, x.seq, x.lon, x.lat) for x in got} == expected and len(got) == len(expected)


def test_parsing_is_not_moved_below_a_repartition(spark):
    body = F.concat(F.lit("GNLVM,113805.50,030215,0.0011,0.00012,0.0002,0,0,0,0,0,0,0.01,"), F.col("id").cast("string"))
    made = lines.bound(spark.range(20).repartition(3), body=body)
    made = made.select("id", F.concat(F.lit("$"), "body", F.lit("*"), text.xor_checksum(F.col("body"))).alias("sentence"))
    good, bad = sentences.parse_lvm(sentences.route_sentences(made))
    assert "Filter" not in plan_of(good).split("Repartition")[1]
    assert good.count() == 20 and bad.count() == 0 and sorted(x.n_sats for x in good.collect()) == list(range(20))


def test_series_are_dealt_to_tasks_by_their_rows(spark, monkeypatch):
    rows = spark.range(4000).selectExpr("cast(id % 40 as string) station", "id / 40.0 t", "double(id) east_m", "double(id) north_m", "double(id) up_m")
    cuts = spark.createDataFrame([("1", 30.5), ("1", 60.0), ("2", 500.0)], "station string, date double")
    few = series.assign_segments(rows, cuts)
    monkeypatch.setattr(series.dealt, "__kwdefaults__", {"rows": None, "each": 100})
    many = series.assign_segments(rows, cuts)
    assert "Repartition" not in plan_of(few) and many.rdd.getNumPartitions() == 40
    assert sorted(map(tuple, few.collect())) == sorted(map(tuple, many.collect()))


def test_lead_over_ranges_holds_no_group(spark):
    rows = spark.createDataFrame([(g, (7 * i) % 50, i) for g, n in (("a", 50), ("b", 1), ("c", 2), ("d", 13), (None, 4)) for i in range(n)], "g string, k int, v int")
    w = Window.partitionBy("g").orderBy("k")
    expected = sorted(map(str, rows.withColumn("x", F.lead("v", 2).over(w)).collect()))
    for each in (1, 2, 5, 100):
        assert sorted(map(str, ordered.lead_by_ranges(rows, ("g",), ("k",), "v", 2, "x", each=each).collect())) == expected


def test_licence_model_learns_from_every_window(spark):
    near = "Permission is hereby granted, free of charge, to any person obtaining a copy of nothing {}"
    rows = [(i, f"old house {i} garden sea river") for i in range(300)] + [(1000 + i, near.format(f"at all {i}")) for i in range(12)] + [(2000, ""), (2001, None)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    model = license_scan.fit(frame, plain_windows=20, contexts=3, quantile=1.0, hard_quantile=1.0)
    words = frame.filter("text > ''").select(license_scan.words_of(F.col("text")))
    every = words.withColumn("held_out", F.pmod(F.xxhash64("words", F.lit(1)), F.lit(2)) == 0).withColumn("pairs", license_scan.pairs_of(F.col("words")))
    every = every.filter(F.size(license_scan.similarities(F.col("words"), license_scan.TEMPLATES)) == 0)
    odds = model.model.transform(license_scan._grams(every, license_scan.TEMPLATES)).select("held_out", (1 - F.get(vector_to_array("probability"), F.lit(0))).alias("p")).collect()
    assert model.threshold == pytest.approx(max(0.5, *[x.p for x in odds if x.held_out]))
    used = model.model.summary.predictions
    learned = sum(not x.held_out for x in odds)
    denied = sum(c == "unknown" for c, _ in license_scan.examples(license_scan.TEMPLATES)[0])
    assert learned > 100 and used.filter("label = 0").count() >= learned + denied * 4  # alone and in three windows


def test_licence_model_learns_equal_rows_as_one(spark):
    """Windows and examples of equal features are one row of their whole weight, however many there are."""
    rows = [(i, f"old house {i} garden sea river the {'with' if i % 3 else 'under'} of {i}") for i in range(300)] + [(300 + i, f"this software is {i} granted") for i in range(20)]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    used = []
    for least in (10**9, 1):
        model = license_scan.fit(frame, plain_windows=20, contexts=3, merge_from=least).model
        used.append(model.summary.predictions.groupBy("label", F.col("features").cast("string").alias("x")).agg(F.count("*").alias("n"), F.sum("weight").alias("w")).collect())
    every, merged = ({(x.label, x.x): x.w for x in part} for part in used)
    assert every.keys() == merged.keys() and all(merged[k] == pytest.approx(w) for k, w in every.items())
    assert max(x.n for x in used[0]) > 20 and all(x.n == 1 for x in used[1])


def test_kept_words_and_pairs_of_windows_match_plain_ones(spark):
    terms = license_scan.vocabulary(license_scan.TEMPLATES)
    text = ("of the. old house " * 40 + "granted, free of charge\n\n" + "this is not licensed under " * 3 + "\n\n \n\n. of", "", None, "under", "sea " * 70 + "you may")
    frame = spark.createDataFrame([(t,) for t in text], "text string").select(F.explode(license_scan.windows(F.col("text"), terms)).alias("x")).select("x.*")
    plain = spark.createDataFrame([(t,) for t in text], "text string").select(F.explode(license_scan.windows(F.col("text"))).alias("x")).select("x.*")
    got, expected = frame.collect(), plain.collect()
    assert [(x.paragraph, x.place, x.words) for x in got] == [(x.paragraph, x.place, x.words) for x in expected] and len(got) > 8
    for x in got:
        assert x.kept == [w for w in x.words if w in terms]
        assert x.pairs == [p for p in map(" ".join, zip(x.words, x.words[1:])) if p in terms]
    assert sum(len(x.pairs) for x in got) > 30
