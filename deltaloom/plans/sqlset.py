"""Named SQL queries: one text that both engines run, or a text of its own for the oracle."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from deltaloom.sources.tables import NAMES, views

ANSI = "spark.sql.ansi.enabled"


def under_rules(spark: SparkSession, ansi: bool, text: str) -> DataFrame:
    """A query under ANSI rules or without them. Expressions take the rules up when the text is analysed and keep them."""
    was = spark.conf.get(ANSI)
    spark.conf.set(ANSI, str(ansi).lower())
    try:
        return spark.sql(text)
    finally:
        spark.conf.set(ANSI, was)


class SqlSet:
    def __init__(self) -> None:
        self.queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
        self.oracle: dict[str, str] = {}

    def sql(self, name: str, text: str, oracle: str | None = None, ansi: bool | None = None, rows: int | None = None) -> None:
        """ansi: the rules that the text was written for, where they matter; the session's stay as they are. rows: of its
        tables that a task takes at most, about, where a row costs more than its bytes tell."""
        mine = [t for t in NAMES if re.search(rf"\b{t}\b", text)]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            views(spark, sf_dir, *mine, rows=rows) if mine else None
            return spark.sql(text) if ansi is None else under_rules(spark, ansi, text)

        self.queries[name], self.oracle[name] = run, oracle or text

    def frame(self, name: str, oracle: str | None = None) -> Callable:
        def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
            self.queries[name] = fn
            if oracle:
                self.oracle[name] = oracle
            return fn

        return add
