"""SQL commands: tables, views, inserts, statistics, settings and plans."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.sources.formats import scratch
from deltaloom.sources.tables import table, views

SET = SqlSet()


def fresh(kind: str) -> str:
    return f"{kind}_{uuid.uuid4().hex}"


def created(spark: SparkSession, columns: str, more: str = "") -> str:
    """A new external table in the shared folder."""
    name = fresh("t")
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet {more} LOCATION '{scratch(spark, name)}'")
    return name


@SET.frame("cmd_ctas", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def cmd_ctas(spark, sf_dir):
    views(spark, sf_dir, "nation")
    name = fresh("ctas")
    spark.sql(f"CREATE TABLE {name} USING parquet LOCATION '{scratch(spark, name)}' AS SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
    return spark.table(name)


@SET.frame("cmd_insert_directory", "SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
def cmd_insert_directory(spark, sf_dir):
    views(spark, sf_dir, "supplier")
    path = scratch(spark, "directory")
    spark.sql(f"INSERT OVERWRITE DIRECTORY '{path}' USING orc SELECT s_suppkey, s_acctbal FROM supplier WHERE s_acctbal < 0")
    return spark.read.orc(path)


@SET.frame("cmd_multi_insert", "SELECT n_nationkey AS k, n_regionkey < 2 AS low FROM nation")
def cmd_multi_insert(spark, sf_dir):
    """One scan feeds two tables."""
    views(spark, sf_dir, "nation")
    a, b = created(spark, "k INT"), created(spark, "k INT")
    spark.sql(f"FROM nation INSERT INTO {a} SELECT n_nationkey WHERE n_regionkey < 2 INSERT INTO {b} SELECT n_nationkey WHERE n_regionkey >= 2")
    return spark.table(a).withColumn("low", F.lit(True)).union(spark.table(b).withColumn("low", F.lit(False)))


@SET.frame("cmd_partition_overwrite", "SELECT n_nationkey AS k, n_regionkey AS r FROM nation WHERE n_regionkey <> 1 OR n_nationkey > 10")
def cmd_partition_overwrite(spark, sf_dir):
    """Only the partitions that the new rows belong to are replaced."""
    path = scratch(spark, "dynamic")
    n = table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    n.write.partitionBy("r").parquet(path)
    n.filter("r = 1 AND k > 10").write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("r").parquet(path)
    return spark.read.schema(n.schema).parquet(path)


@SET.frame("cmd_global_view", "SELECT r_regionkey, r_name FROM region WHERE r_regionkey > 1")
def cmd_global_view(spark, sf_dir):
    table(spark, sf_dir, "region").createOrReplaceGlobalTempView("deltaloom_region")
    return spark.newSession().sql("SELECT r_regionkey, r_name FROM global_temp.deltaloom_region WHERE r_regionkey > 1")


@SET.frame("cmd_view", "SELECT s_nationkey, round(sum(s_acctbal), 2) AS total FROM supplier GROUP BY s_nationkey")
def cmd_view(spark, sf_dir):
    views(spark, sf_dir, "supplier")
    spark.sql("CREATE OR REPLACE TEMPORARY VIEW deltaloom_totals (s_nationkey, total) AS SELECT s_nationkey, round(sum(s_acctbal), 2) FROM supplier GROUP BY s_nationkey")
    return spark.table("deltaloom_totals")


@SET.frame("cmd_view_using", "SELECT r_name FROM region")
def cmd_view_using(spark, sf_dir):
    spark.sql(f"CREATE OR REPLACE TEMPORARY VIEW deltaloom_using USING parquet OPTIONS (path '{sf_dir}/region.parquet')")
    return spark.sql("SELECT r_name FROM deltaloom_using")


@SET.frame("cmd_analyze", "SELECT count(*) AS n, count(DISTINCT n_regionkey) AS d, CAST(max(n_regionkey) AS VARCHAR) AS hi FROM nation")
def cmd_analyze(spark, sf_dir):
    """Row count, distinct count and maximum as the optimizer's statistics hold them."""
    name = created(spark, "k INT, r INT")
    table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey").write.insertInto(name)
    spark.sql(f"ANALYZE TABLE {name} COMPUTE STATISTICS FOR ALL COLUMNS")
    rows = spark.sql(f"DESCRIBE EXTENDED {name}").filter("col_name = 'Statistics'").select(F.regexp_extract("data_type", "([0-9]+) rows", 1).cast("long").alias("n"))
    column = spark.sql(f"DESCRIBE EXTENDED {name} r")
    value = lambda what: F.max(F.when(F.col("info_name") == what, F.col("info_value")))
    return rows.crossJoin(column.agg(value("distinct_count").cast("long").alias("d"), value("max").alias("hi")))


@SET.frame("cmd_alter_table", "SELECT r_regionkey AS k, CAST(NULL AS VARCHAR) AS note FROM region UNION ALL SELECT 99, 'new'")
def cmd_alter_table(spark, sf_dir):
    name = created(spark, "k INT")
    table(spark, sf_dir, "region").select("r_regionkey").write.insertInto(name)
    spark.sql(f"ALTER TABLE {name} ADD COLUMNS (note STRING)")
    spark.sql(f"ALTER TABLE {name} ALTER COLUMN k COMMENT 'the key'")
    spark.sql(f"INSERT INTO {name} VALUES (99, 'new')")
    spark.sql(f"REFRESH TABLE {name}")
    return spark.table(name)


@SET.frame("cmd_describe", "SELECT * FROM (VALUES ('r_regionkey', 'int'), ('r_name', 'string')) t(col_name, data_type)")
def cmd_describe(spark, sf_dir):
    views(spark, sf_dir, "region")
    return spark.sql("DESCRIBE region").select("col_name", "data_type")


@SET.frame("cmd_show", "SELECT * FROM (VALUES ('columns', CAST(2 AS BIGINT)), ('tables', CAST(1 AS BIGINT)), ('functions', CAST(1 AS BIGINT)), ('databases', CAST(1 AS BIGINT))) t(what, n)")
def cmd_show(spark, sf_dir):
    name = created(spark, "a INT, b STRING")
    counts = {
        "columns": f"SHOW COLUMNS IN {name}",
        "tables": f"SHOW TABLES LIKE '{name}'",
        "functions": "SHOW SYSTEM FUNCTIONS LIKE 'approx_count_distinct'",
        "databases": "SHOW DATABASES LIKE 'default'",
    }
    return spark.createDataFrame([(what, spark.sql(text).count()) for what, text in counts.items()], "what string, n long")


@SET.frame("cmd_cache_table", "SELECT n_regionkey, count(*) AS n FROM nation GROUP BY n_regionkey")
def cmd_cache_table(spark, sf_dir):
    views(spark, sf_dir, "nation")
    name = fresh("cached")
    spark.sql(f"CACHE LAZY TABLE {name} AS SELECT n_regionkey FROM nation")
    held = spark.sql(f"SELECT n_regionkey, count(*) AS n FROM {name} GROUP BY n_regionkey").collect()
    spark.sql(f"UNCACHE TABLE {name}")
    return spark.createDataFrame(held, "n_regionkey int, n long")


@SET.frame("cmd_set_variables", "SELECT n_nationkey FROM nation WHERE n_regionkey = 3 AND n_nationkey < 20")
def cmd_set_variables(spark, sf_dir):
    """A setting put into a text by substitution, and a session variable."""
    views(spark, sf_dir, "nation")
    spark.sql("SET deltaloom.region = 3")
    spark.sql("DECLARE OR REPLACE VARIABLE deltaloom_top INT DEFAULT 20")
    return spark.sql("SELECT n_nationkey FROM nation WHERE n_regionkey = ${deltaloom.region} AND n_nationkey < deltaloom_top")


@SET.frame("cmd_parameters", "SELECT s_suppkey FROM supplier WHERE s_acctbal > 1000 AND s_nationkey IN (1, 2, 3)")
def cmd_parameters(spark, sf_dir):
    views(spark, sf_dir, "supplier")
    return spark.sql("SELECT s_suppkey FROM supplier WHERE s_acctbal > :least AND array_contains(:nations, s_nationkey)", args={"least": 1000, "nations": [1, 2, 3]})


@SET.frame("cmd_explain", "SELECT true AS pushed, true AS pruned")
def cmd_explain(spark, sf_dir):
    """The filter and the two columns reach the scan."""
    views(spark, sf_dir, "lineitem")
    plan = spark.sql("EXPLAIN FORMATTED SELECT l_orderkey FROM lineitem WHERE l_quantity > 40")
    pruned = F.regexp_like("plan", F.lit(r"ReadSchema: struct<l_orderkey:bigint,l_quantity:double>"))
    return plan.select(F.contains("plan", F.lit("GreaterThan(l_quantity,40.0)")).alias("pushed"), pruned.alias("pruned"))


@SET.frame("cmd_regex_columns", "SELECT n_nationkey, n_name FROM nation")
def cmd_regex_columns(spark, sf_dir):
    views(spark, sf_dir, "nation")
    key = "spark.sql.parser.quotedRegexColumnNames"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        return spark.sql("SELECT `(n_regionkey)?+.+` FROM nation")
    finally:
        spark.conf.set(key, before)


@SET.frame("cmd_sql_function", "SELECT s_suppkey, s_acctbal * 1.5 + 1 AS raised FROM supplier")
def cmd_sql_function(spark, sf_dir):
    views(spark, sf_dir, "supplier")
    spark.sql("CREATE OR REPLACE TEMPORARY FUNCTION deltaloom_raised(x DOUBLE) RETURNS DOUBLE RETURN x * 1.5D + 1")
    return spark.sql("SELECT s_suppkey, deltaloom_raised(s_acctbal) AS raised FROM supplier")


LOCAL_ORDER = "SELECT o_custkey, count(*) AS n FROM ({}) t GROUP BY o_custkey"
for name, clause in (("distribute_by", "DISTRIBUTE BY o_custkey SORT BY o_orderkey"), ("cluster_by", "CLUSTER BY o_custkey"), ("sort_by", "SORT BY o_totalprice DESC")):
    SET.sql(name, LOCAL_ORDER.format(f"SELECT * FROM orders {clause}"), LOCAL_ORDER.format("SELECT * FROM orders"))
SET.sql("tablesample_all", "SELECT o_orderkey FROM orders TABLESAMPLE (100 PERCENT)", "SELECT o_orderkey FROM orders")
SET.sql("tablesample_rows", "SELECT count(*) AS n FROM (SELECT * FROM orders TABLESAMPLE (7 ROWS)) t", "SELECT CAST(7 AS BIGINT) AS n")
SET.sql("tablesample_bucket", "SELECT n > 0.4 * total AND n < 0.6 * total AS half, total FROM (SELECT count(*) AS n FROM orders TABLESAMPLE (BUCKET 2 OUT OF 4)) a CROSS JOIN (SELECT count(*) AS total FROM orders) b",
        "SELECT true AS half, count(*) AS total FROM orders")
