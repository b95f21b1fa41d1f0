"""The stages on a small corpus against what each must do."""

import random

import corpus_pipeline
from pyspark.sql import functions as F


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    vocabulary = [f"{a}{b}{c}" for a in ("th", "st", "on", "er") for b in "aeiou" for c in ("nd", "re", "ng", "s")]
    make = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    item = make(30)
    rows = [(i, make(200), "en", "s", None) for i in range(40)]
    near = rows[0][1].split()
    near[77] = "else"
    rows += [(100, " ".join(near), "en", "s", None), (101, rows[1][1], "en", "s", None), (102, make(100) + " " + item + " " + make(100), "en", "s", None), (103, item, "en", "s", None)]
    rows += [(104, make(50) + " write to someone@mail.example.com " + make(50), "en", "s", None), (105, "123 456", "en", "s", None), (106, None, "en", "s", None), (None, make(80), None, None, None)]
    folder = str(tmp_path / "sf")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long")).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, docs, folder).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        seen[name] = {r["doc_id"]: r for r in docs.collect()}
    assert set(seen["language"]) == {r[0] for r in rows} - {105, 106}
    assert set(seen["language"]) - set(seen["near_copies"]) == {100, 101}
    assert set(seen["near_copies"]) - set(seen["benchmark"]) == {103}
    assert item not in seen["benchmark"][102]["text"] and seen["benchmark"][3]["text"] == rows[3][1]
    assert "<EMAIL>" in seen["personal_data"][104]["text"]
    assert all(r["round_trip"] and r["n_tokens"] == len(r["ids"]) for r in seen["tokens"].values())
    assert set(seen["tokens"]) == set(seen["benchmark"])


def test_stages_survive_odd_tables(spark, tmp_path):
    """No row at all, further columns with clashing names, nulls everywhere, equal rows, a long text, an empty benchmark."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, lang_pred string, score double, h string, ids string, `a b` int, spans int, row int"
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    words = "the house and the garden with that sun on a day like this one"
    full = [(1, words, "en", "s", 5, "lp", 0.5, "h", "i", 7, 8, 9), (2, "la maison et le jardin avec ce soleil", "fr", "s", 5, "lp", 0.5, "h", "i", 7, 8, 9)]
    rows = full + [(3, "x" * 200_000 + " " + words * 500, "en", None, None, None, None, None, None, None, None, None)] + [(4, None, *[None] * 10)] * 2 + [(None, None, *[None] * 10), (5, words + " again", *[None] * 10), (5, words + " again", *[None] * 10)]
    for data in ([], rows):
        docs = spark.createDataFrame(data, schema)
        for name, stage in corpus_pipeline.STAGES:
            path = f"{tmp_path}/{len(data)}-{name}"
            stage(spark, docs, str(tmp_path)).write.parquet(path)
            names, docs = docs.columns, spark.read.parquet(path)
            assert name == "tokens" or docs.columns == names
        out = {r["doc_id"]: r for r in docs.collect()}
        assert len(out) == docs.count() and all(r["round_trip"] for r in out.values())
        assert set(out) <= {1, 2, 3, 5} and (not data or {1, 2} <= set(out))
        if data:
            assert (out[1]["lang_pred"], out[1]["score"], out[1]["h"], out[1]["a b"], out[1]["spans"], out[1]["row"]) == ("lp", 0.5, "h", 7, 8, 9)
