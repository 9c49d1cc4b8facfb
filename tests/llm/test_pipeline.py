"""The corpus pipeline and the registration of its queries."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

pytest.importorskip("public_tokenizers")
import corpus_pipeline  # noqa: E402
from kartlane.llm import jaccard, queries, quality, toxicity  # noqa: E402

SF = "/root/testdata/sf0.01"


def test_stages_take_effect(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("score", F.lit("clash")).withColumn("row", F.lit(3))
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows, texts = docs.collect(), {}
    after = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, after = after, stage(spark, after, SF)
        assert after.columns == docs.columns
        left, had = {r.doc_id for r in after.collect()}, {r.doc_id for r in before.collect()}
        assert left <= had
        if name == "toxicity":
            gone = {r.doc_id for r in toxicity.classify(before, labels).where("predicted = 1").collect()}
        elif name == "quality":
            gone = {r.doc_id for r in quality.classify(before, labels).where("predicted = 0").collect()}
        else:
            gone = {r.doc_id for r in jaccard.near_duplicates(before).where("doc_id <> component_id").collect()}
        assert gone and had - left == gone
        after = spark.createDataFrame(after.collect(), docs.schema)
    texts = {r.doc_id: r for r in rows}
    assert all(texts[r.doc_id] == r for r in after.collect())
    packed = corpus_pipeline.STAGES[-1][1](spark, after, SF)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in after.collect()}


def test_odd_rows_pass_the_pipeline(spark, tmp_path):
    rows = [(1, None, "a"), (1, None, "a"), (2, "", "b"), (None, "x y", "c"), (3, "word " * 3000, None), (4, "a b c d e f g", "d"),
            (5, "a b c d e f g", "e"), (5, "a b c d e f g", "e")]
    for name, data in (("some", rows), ("none", [])):
        spark.createDataFrame(data, "doc_id bigint, text string, mean string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        spark.createDataFrame([], "doc_id bigint, quality int, toxic int").write.parquet(f"{tmp_path}/{name}/labels.parquet")
    got = {r.doc_id for r in corpus_pipeline.one_of_each(spark, spark.read.parquet(f"{tmp_path}/some/documents.parquet"), "").collect()}
    assert got == {1, 2, None, 3, 4}
    assert corpus_pipeline.run(spark, f"{tmp_path}/none").count() == 0
    corpus_pipeline.run(spark, f"{tmp_path}/some").count()


def test_rows_are_judged_by_their_text_alone(spark):
    """Repeated ids with different texts stay; near copies without an id go, among themselves and beside one with an id."""
    words = [f"w{i}" for i in range(80)]
    a, b, c = " ".join(words), " ".join(f"v{i}" for i in range(80)), " ".join(f"u{i}" for i in range(80))
    near = lambda t: " ".join([*t.split()[:-1], "other"])
    rows = [(1, a, "first"), (1, b, "own text"), (1, near(a), "copy"), (None, near(b), "copy"), (None, c, "group"),
            (None, near(c), "group"), (None, c, "group"), (None, "alone " + a[:20], "own text"), (None, None, "no text"), (2, " ", "no text")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, key string").repartition(3)
    got = sorted(r.key for r in corpus_pipeline.one_of_each(spark, docs, "").where("key <> 'first' and key <> 'copy'").collect())
    assert got == ["group", "no text", "no text", "own text", "own text"]
    left = corpus_pipeline.one_of_each(spark, docs, "").collect()
    assert len(left) == 6 and sum(r.text in (a, near(a)) for r in left) == 1


def test_every_operator_is_registered():
    import __spark_entry__ as entry
    names = entry.queries()
    assert "pipeline" in names and {n.split("_")[0] for n in queries.NAMES} == {f"op{i}" for i in range(1, 14)}
    assert set(queries.NAMES) <= set(names)
