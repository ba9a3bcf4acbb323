"""The corpus pipeline: from raw documents to token ids, a Parquet table between any two stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.llm import bpe, decontamination, jaccard, secrets, toxicity
from deltaloom.session import staged
from deltaloom.sources.tables import table

# Learned scores, near-duplicate groups and token ids are beyond SQL; tests hold each stage against brute force.
ORACLE_SQL = None

#: Words in a shingle, and the least similarity in hundredths, of near duplicates; op10_jaccard_join has its own.
NEAR_WORDS, NEAR_PERCENT = 5, 80


def without_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below one half."""
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    model = toxicity.fit(toxicity.training_rows(docs, labels))
    return toxicity.scored(docs, model, "_toxicity").filter("_toxicity < 0.5").select(*docs.columns)


def one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of near duplicates: that of least doc_id, those without a doc_id last.

    Rows are told apart by a staged key, not by doc_id: a row without a doc_id goes if it is a near copy of another
    row, and of two different texts under one doc_id both stay. Rows without words are copies of nothing, but
    repeated rows of one doc_id and text are one.
    """
    rows = staged(docs.withColumn("_row", F.monotonically_increasing_id()), "rows")
    groups = jaccard.jaccard_components(rows.select(F.col("_row").alias("doc_id"), "text"), NEAR_WORDS, NEAR_PERCENT)
    named = rows.select("_row", "doc_id", F.xxhash64("text").alias("_text")).join(groups.select(F.col("doc_id").alias("_row"), "n_shingles", "component_id"), "_row")
    repeated = (F.col("n_shingles") == 0) & F.col("doc_id").isNotNull()
    group = [F.when(~repeated, F.col("component_id")).alias("_group"), F.when(repeated, F.col("doc_id")).alias("_of"), F.when(repeated, F.col("_text")).alias("_as")]
    first = named.groupBy(*group).agg(F.min(F.struct(F.col("doc_id").isNull().alias("_none"), "doc_id", "_text", "_row")).alias("_first"))
    return rows.join(first.select("_first._row"), "_row", "left_semi").select(*docs.columns)


def without_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item. Each text is judged by itself, whatever the doc_id of its row."""
    return decontamination.without_contaminated(docs, table(spark, sf_dir, "benchmark"))


def without_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced."""
    return secrets.redact_documents(docs)


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and ids of every document."""
    return bpe.encoded_documents(docs, bpe.tokenizer_path(), keep_ids=True)


STAGES = [
    ("toxicity", without_toxic),
    ("jaccard_join", one_of_each_group),
    ("decontamination", without_benchmark),
    ("secret_scan", without_secrets),
    ("bpe", encoded),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = staged(docs, f"stage-{name}")
    return docs
