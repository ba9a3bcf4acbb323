import corpus_pipeline as pipeline
from helpers import clashing, documents, rows

from deltaloom.llm import decontamination as dec


def test_stages_take_effect(spark):
    sf = "/root/testdata/sf0.01"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns = docs.columns
    for name, stage in pipeline.STAGES:
        before, was = docs, {r["doc_id"] for r in docs.select("doc_id").collect()}
        docs = pipeline.staged(stage(spark, before, sf), f"test-{name}")
        now = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert now <= was and len(now) > 0.7 * len(was)
        if name != "bpe":
            assert docs.columns == columns and docs.schema.simpleString() == before.schema.simpleString()
        if name == "decontamination":
            assert dec.contaminated(docs, spark.read.parquet(f"{sf}/benchmark.parquet")).count() == 0
            leaked = {r["doc_id"] for r in dec.contaminated(before, spark.read.parquet(f"{sf}/benchmark.parquet")).collect()}
            assert was - now == leaked
        if name in ("secret_scan", "bpe"):
            assert now == was


def test_one_of_each_group_on_awkward_rows(spark):
    df = clashing(documents(spark, ["a b c d", "A b c d", None, "", "", "x", "a b c d"], [2, 1, 3, 4, 5, None, 1]))
    out = pipeline.one_of_each_group(spark, df, "")
    assert [r[0] for r in rows(out.select("doc_id"))] == [1, 3, 4, 5, None] and out.columns == df.columns
