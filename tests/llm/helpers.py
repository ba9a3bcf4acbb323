"""Small tables with the awkward rows that every corpus operator has to bear."""

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def documents(spark: SparkSession, texts: list, ids: list | None = None) -> DataFrame:
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None if t is None else len(t)) for i, t in zip(ids, texts, strict=True)], SCHEMA)


def saved(df: DataFrame, tmp_path, name: str = "documents") -> str:
    df.write.mode("overwrite").parquet(f"{tmp_path}/{name}.parquet")
    return str(tmp_path)


def rows(df: DataFrame) -> list:
    return sorted((tuple(r) for r in df.collect()), key=repr)


def clashing(df: DataFrame) -> DataFrame:
    """The same rows with more columns, named like those that operators make."""
    from pyspark.sql import functions as F

    return df.select("*", *[F.lit(1).alias(c) for c in ("blob", "shard", "words", "hash", "batch", "score", "size", "kept", "item_id")])


def texts_of(sf_dir: str) -> dict:
    import pyarrow.parquet as pq

    t = pq.read_table(f"{sf_dir}/documents.parquet", columns=["doc_id", "text"]).to_pydict()
    return dict(zip(t["doc_id"], t["text"], strict=True))
