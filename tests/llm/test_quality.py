import math
import random
import re
import unicodedata
import zlib

from pyspark.sql import functions as F

from luminal.llm import quality

SF = "/root/testdata/sf0.01"


def test_held_out_accuracy(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = quality.classify(docs, labels)
    assert out.count() == docs.count()
    rows = out.join(labels, "doc_id").filter("held_out").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in out.collect())
    good, bad = [r for r in rows if r.quality == 1], [r for r in rows if r.quality == 0]
    assert sum(r.predicted == 1 for r in good) / len(good) > 0.95 and sum(r.predicted == 0 for r in bad) / max(1, len(bad)) > 0.7


def test_learns_nothing_from_held_out_rows(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    a = quality.fit(docs, labels)
    b = quality.fit(docs, labels.withColumn("quality", F.when(quality.held_out(F.col("doc_id")), 1 - F.col("quality")).otherwise(F.col("quality"))))
    assert [str(r) for r, _ in a.weights] == [str(r) for r, _ in b.weights]


def test_odd_rows(spark):
    docs = spark.createDataFrame([(1, None, 1.0), (2, "", 2.0), (3, "word " * 50_000, 3.0), (None, "x", 4.0), (1, None, 1.0)], "doc_id long, text string, st_digits double")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, none).collect()
    assert len(rows) == 5 and all(r.score == 0.5 and r.predicted == 1 for r in rows)
    one = spark.createDataFrame([(i, 1, 0) for i in (1, 2, 3)], "doc_id long, quality int, toxic int")
    assert all(0 <= r.score <= 1 for r in quality.classify(docs, one).collect())
    assert quality.classify(docs.limit(0), one).count() == 0
    kept = quality.score(docs, quality.Ensemble(0.0, ((quality.Rule(((4, 0.5, 9.0),)), 1.0),)), score_col="s")
    assert kept.columns == ["doc_id", "text", "st_digits", "s"] and {r.st_digits for r in kept.collect()} == {1.0, 2.0, 3.0, 4.0}


def test_statistics_against_python(spark):
    r = random.Random(2)
    texts = ["".join(r.choice("ab A1%|.!\n\té") for _ in range(r.randint(0, 80))) for _ in range(60)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    for row in quality.statistics(df, F.col("text")).collect():
        t = texts[row.i]
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
        assert abs(row.st_capitals - (t.count("A") / len(t) if t else 0)) < 1e-9 and abs(row.st_repeats - (sum(a == b for a, b in zip(w, w[1:], strict=False)) / len(w) if w else 0)) < 1e-9
        assert abs(row.st_distinct - (len(set(w)) / len(w) if w else 0)) < 1e-9


def test_rules_of_a_printed_tree():
    text = "Tree 0:\n  If (feature 1 <= 2.0)\n   If (feature 0 <= 1.0)\n    Predict: 0.0\n   Else (feature 0 > 1.0)\n    Predict: 1.0\n  Else (feature 1 > 2.0)\n   Predict: 1.0\n"
    inf = float("inf")
    assert [r.parts for r in quality.tree_rules(text)] == [((1, -inf, 2.0),), ((0, -inf, 1.0), (1, -inf, 2.0)), ((0, 1.0, inf), (1, -inf, 2.0)), ((1, 2.0, inf),)]


def plain_statistics(text):
    """All statistics of a text in plain Python, in order of NAMES."""
    t = text or ""
    ws, n = [w for w in re.split(r"[\x20\x09-\x0D]+", t) if w], len(t)
    m = len(ws)
    kinds = [lambda c: c in "#$%&*+/<=>@\\^_`{|}~[]", lambda c: unicodedata.category(c) == "Lu", lambda c: c in "0123456789", lambda c: c in "!?", lambda c: c in ".,;:", lambda c: c == "\n"]
    shares = [sum(map(k, t)) / n if n else 0.0 for k in kinds]
    return [*shares, math.log1p(n), math.log1p(m), (n - m) / m if m else 0.0, sum(a == b for a, b in zip(ws, ws[1:], strict=False)) / m if m else 0.0, len(set(ws)) / m if m else 0.0, float(max(map(len, ws), default=0))]


def test_statistics_rules_and_score_beside_a_plain_evaluation(spark):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    model = quality.fit(docs, labels)
    assert len(model.weights) > 3
    odd = spark.createDataFrame([(-1, None), (-2, ""), (-3, " \n\t"), (-4, "É É é #[]{}|~ 12!?.,;:"), (-5, "x" * 5000)], "doc_id long, text string")
    rows = quality.score(docs.select("doc_id", "text").unionByName(odd), model).collect()
    stats = {r.doc_id: [r[f"st_{k}"] for k in quality.NAMES] for r in quality.statistics(docs.select("doc_id", "text").unionByName(odd), F.col("text")).collect()}
    for r in rows:
        own = plain_statistics(r.text)
        assert all(abs(a - b) < 1e-9 for a, b in zip(own, stats[r.doc_id], strict=True)), (r.doc_id, own, stats[r.doc_id])
        # the split points are doubles, so that the rules are held against the statistics as Spark has them
        margin = model.intercept + sum(w for rule, w in model.weights if all(low < stats[r.doc_id][f] <= high for f, low, high in rule.parts))
        assert abs(r.score - 1 / (1 + math.exp(-margin))) < 1e-9


def test_an_id_with_both_labels(spark):
    docs = spark.createDataFrame([(i, "good words here" if i % 2 else "1 1 1 !") for i in range(60)], "doc_id long, text string")
    labels = [(i, i % 2, 0) for i in range(60)]
    twice = spark.createDataFrame(labels + [(i, 1 - i % 2, 0) for i in range(0, 60, 6)] + [(None, 1, 0), (3, None, 0), (5, 7, 0)], "doc_id long, quality int, toxic int")
    rows = quality.classify(docs, twice).collect()
    assert len(rows) == 60 and all(r.predicted == r.doc_id % 2 for r in rows)
