import hashlib

import corpus_pipeline
import numpy as np
from luminal.llm.quality import fit
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    first = docs
    for name, stage in corpus_pipeline.STAGES:
        before = docs.toPandas()
        docs = stage(spark, docs, SF).cache()
        after = docs.toPandas()
        if name != "tokens":
            assert docs.columns == columns
        if name == "quality classifier":
            assert 0.7 * len(before) < len(after) <= len(before)
        if name == "exact dedup":
            want = before.assign(text=before.text.fillna("")).groupby("text").doc_id.max()
            assert sorted(after.doc_id) == sorted(want)
        if name == "near dedup":
            sets = {r.doc_id: shingles(r.text) for r in before.itertuples()}
            near = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
            kept = set(after.doc_id)
            assert all(not (a in kept and b in kept) for a, b in near)
            gone = set(before.doc_id) - kept
            assert gone and all(max(len(sets[g] & sets[o]) / max(1, len(sets[g] | sets[o])) for o in sets if o != g) >= 0.8 for g in gone if sets[g])
        if name == "mixing":
            assert set(after.doc_id) <= set(before.doc_id) and after.doc_id.value_counts().max() <= 3
        if name == "tokens":
            texts = before.set_index("doc_id").text.fillna("").to_dict()
            assert len(after) == len(before)
            for r in after.itertuples():
                assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id].encode()).hexdigest() and len(np.frombuffer(r.ids, "<u4")) == r.n_tokens
    assert first.count() > docs.count() * 0.3


def shingles(text, k=5):
    w = (text or "").lower().split()
    return {" ".join(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set()


def test_run_and_odd_rows(spark, tmp_path):
    rows = [(1, "a b c d e f g h", "en", "s", 15), (2, "a b c d e f g h", "en", "s", 15), (3, None, "en", None, None), (4, "", None, "s", 0), (None, "x y", "en", "t", 3)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r.doc_id for r in out} <= {None, 2, 3, 4} and len(out) >= 2
    empty = spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long")
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, str(tmp_path)).count() == 0, name


def test_quality_stage_takes_effect(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    assert corpus_pipeline.quality_stage(spark, docs, SF).count() == corpus_pipeline.score(docs, fit(docs, labels)).filter(F.col("score") >= 0.5).count()


def test_clashing_names_repeats_and_long_texts(spark, tmp_path):
    """Columns called like the stages' own, a row that repeats with its id, and a text of a million words."""
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    long = " ".join(f"w{i % 9973}" for i in range(1_000_000))
    rows = [(1, "a b c d e f g h", "s"), (1, "a b c d e f g h", "s"), (2, long, "s"), (3, long + " end", "t"), (4, "one two three four five", None)]
    names = ["row", "key", "id", "_row", "_dropped", "score", "_score", "copies", "_copies", "node"]
    docs = spark.createDataFrame([(*r, *names) for r in rows], "doc_id long, text string, source string, " + ", ".join(f"{n} string" for n in names))
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns, name
        got = out.collect()
        assert all(r[n] == n for r in got for n in names), name
        ids = sorted(r.doc_id for r in got)
        if name in ("quality classifier", "exact dedup"):
            assert ids == [1, 1, 2, 3, 4]
        if name == "near dedup":
            assert ids == [1, 1, 2, 4]
    last = corpus_pipeline.tokens_stage(spark, docs, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in last) == [1, 1, 2, 3, 4] and all(r.n_tokens > 0 for r in last)
