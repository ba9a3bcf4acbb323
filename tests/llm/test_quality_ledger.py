import shutil

import duckdb
from helpers import documents, rows

from deltaloom.llm import quality


def test_a_second_policy_reads_no_text(spark, tmp_path):
    texts = [None, "", "w " * 30, " ".join(f"word{i}" for i in range(40)), "WHY " + " ".join(f"word{i}" for i in range(60))]
    documents(spark, texts).write.parquet(f"{tmp_path}/documents.parquet")
    ledger = quality.stored(spark.read.parquet(f"{tmp_path}/documents.parquet"))
    shutil.rmtree(f"{tmp_path}/documents.parquet")
    one_rule = quality.Policy("few", 2, ("few_words",))
    assert rows(ledger.filter(quality.passes(one_rule)).select("doc_id")) == [(2,), (3,), (4,)]
    assert rows(ledger.filter(quality.passes(quality.POLICIES["strict"])).select("doc_id")) == [(3,), (4,)]
    assert [tuple(r) for r in quality.ablations(ledger, one_rule).collect()] == [("few", 2, "few_words", 2, 2, 5)]


def test_ablations_of_repeated_rows_and_none(spark, tmp_path):
    text = " ".join(f"word{i}" for i in range(40))
    for name, df in (("some", documents(spark, [text, text, "x"], [1, 1, None])), ("none", documents(spark, []))):
        df.write.parquet(f"{tmp_path}/{name}/documents.parquet")
        c = duckdb.connect()
        c.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/{name}/documents.parquet/*.parquet'")
        got = quality.quality_ablations(spark, f"{tmp_path}/{name}").select("policy", "version", "rule", "n_fail", "n_only", "n_kept_without")
        assert rows(got) == sorted(c.execute(quality.ABLATION_ORACLE).fetchall(), key=repr)
