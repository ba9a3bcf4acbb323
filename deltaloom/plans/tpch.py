"""TPC-H shapes over the test tables, adapted where columns are absent."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans.sqlset import SqlSet
from deltaloom.sources.tables import table

SET = SqlSet()
PARTSUPP = """(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, CAST(sum(l_quantity) AS INT) AS ps_availqty,
  min(l_extendedprice / l_quantity) AS ps_supplycost FROM lineitem GROUP BY l_partkey, l_suppkey)"""


@SET.frame(
    "q1",
    """SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price,
       round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price,
       round(sum(l_extendedprice * (1 - l_discount) * (1 + l_tax)), 2) AS sum_charge,
       round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price,
       round(avg(l_discount), 4) AS avg_disc, count(*) AS count_order
FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY 1, 2""",
)
def q1(spark: SparkSession, sf_dir: str) -> DataFrame:
    price = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return (
        table(spark, sf_dir, "lineitem")
        .filter(F.col("l_shipdate") <= F.lit("1998-09-02").cast("timestamp"))
        .groupBy("l_returnflag", "l_linestatus")
        .agg(
            F.round(F.sum("l_quantity"), 2).alias("sum_qty"),
            F.round(F.sum("l_extendedprice"), 2).alias("sum_base_price"),
            F.round(F.sum(price), 2).alias("sum_disc_price"),
            F.round(F.sum(price * (1 + F.col("l_tax"))), 2).alias("sum_charge"),
            F.round(F.avg("l_quantity"), 4).alias("avg_qty"),
            F.round(F.avg("l_extendedprice"), 4).alias("avg_price"),
            F.round(F.avg("l_discount"), 4).alias("avg_disc"),
            F.count("*").alias("count_order"),
        )
        .orderBy("l_returnflag", "l_linestatus")
    )


SET.sql("q2", f"""WITH ps AS {PARTSUPP}, eu AS (
  SELECT ps_partkey, ps_supplycost, s_suppkey, s_name, n_name FROM ps JOIN supplier ON s_suppkey = ps_suppkey
  JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_regionkey = 3)
SELECT s_name, n_name, p_partkey, p_brand, round(ps_supplycost, 2) AS cost FROM part JOIN eu ON p_partkey = ps_partkey
WHERE p_size = 15 AND p_type = 'LARGE' AND ps_supplycost = (SELECT min(e.ps_supplycost) FROM eu e WHERE e.ps_partkey = part.p_partkey)""")
SET.sql("q3", """SELECT l_orderkey, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, o_orderdate FROM customer
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1997-03-15' AND l_shipdate > TIMESTAMP '1997-03-15'
GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""")
SET.sql("q4", """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01'
AND o_orderdate < TIMESTAMP '1996-10-01' AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY o_orderpriority""")
SET.sql("q5", """SELECT n_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey
JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey
WHERE r_regionkey = 2 AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY n_name""")
SET.sql("q6", """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01'
AND l_shipdate < TIMESTAMP '1997-01-01' AND l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24""")
SET.sql("q7", """SELECT n1.n_name AS supp_nation, n2.n_name AS cust_nation, CAST(year(l_shipdate) AS INT) AS l_year,
round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM supplier JOIN lineitem ON s_suppkey = l_suppkey JOIN orders ON o_orderkey = l_orderkey
JOIN customer ON c_custkey = o_custkey JOIN nation n1 ON s_nationkey = n1.n_nationkey JOIN nation n2 ON c_nationkey = n2.n_nationkey
WHERE ((n1.n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND n2.n_name IN ('NATION_4', 'NATION_5', 'NATION_6'))
    OR (n2.n_name IN ('NATION_1', 'NATION_2', 'NATION_3') AND n1.n_name IN ('NATION_4', 'NATION_5', 'NATION_6'))) GROUP BY 1, 2, 3""")
SET.sql("q8", """SELECT o_year, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 6) AS mkt_share FROM (
SELECT CAST(year(o_orderdate) AS INT) AS o_year, l_extendedprice * (1 - l_discount) AS volume, n2.n_name AS nation FROM part JOIN lineitem ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey
JOIN nation n1 ON c_nationkey = n1.n_nationkey JOIN region ON n1.n_regionkey = r_regionkey JOIN nation n2 ON s_nationkey = n2.n_nationkey
WHERE o_orderdate BETWEEN TIMESTAMP '1996-01-01' AND TIMESTAMP '1997-12-31' AND p_type = 'ECONOMY') v GROUP BY o_year""")
SET.sql("q9", f"""WITH ps AS {PARTSUPP} SELECT n_name AS nation, CAST(year(o_orderdate) AS INT) AS o_year,
round(sum(l_extendedprice * (1 - l_discount) - ps_supplycost * l_quantity), 2) AS sum_profit FROM part JOIN lineitem ON p_partkey = l_partkey
JOIN supplier ON s_suppkey = l_suppkey JOIN ps ON ps_suppkey = l_suppkey AND ps_partkey = l_partkey JOIN orders ON o_orderkey = l_orderkey
JOIN nation ON s_nationkey = n_nationkey WHERE p_name LIKE '%1%' GROUP BY 1, 2""")
SET.sql("q10", """SELECT c_custkey, c_name, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue, c_acctbal, n_name FROM customer
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R'
GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey LIMIT 20""")
SET.sql("q11", f"""WITH ps AS {PARTSUPP}, mine AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS v FROM ps JOIN supplier ON ps_suppkey = s_suppkey
JOIN nation ON s_nationkey = n_nationkey WHERE n_name = 'NATION_2')
SELECT ps_partkey, round(sum(v), 2) AS total FROM mine GROUP BY ps_partkey HAVING sum(v) > (SELECT sum(v) * 0.0001 FROM mine)""")
SET.sql("q12", """SELECT l_returnflag, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS high_line_count,
CAST(sum(CASE WHEN o_orderpriority NOT IN ('1-URGENT', '2-HIGH') THEN 1 ELSE 0 END) AS BIGINT) AS low_line_count FROM orders JOIN lineitem ON o_orderkey = l_orderkey
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01' GROUP BY l_returnflag""")
SET.sql("q13", """SELECT c_count, count(*) AS custdist FROM (SELECT c_custkey, count(o_orderkey) AS c_count FROM customer LEFT JOIN orders
ON c_custkey = o_custkey AND o_orderpriority <> '1-URGENT' GROUP BY c_custkey) c GROUP BY c_count""")
SET.sql("q14", """SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN l_extendedprice * (1 - l_discount) ELSE 0 END)
/ sum(l_extendedprice * (1 - l_discount)), 4) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey
WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""")
SET.sql("q15", """WITH revenue AS (SELECT l_suppkey AS supplier_no, round(sum(l_extendedprice * (1 - l_discount)), 2) AS total FROM lineitem
WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
SELECT s_suppkey, s_name, total FROM supplier JOIN revenue ON s_suppkey = supplier_no WHERE total = (SELECT max(total) FROM revenue)""")
SET.sql("q16", f"""WITH ps AS {PARTSUPP} SELECT p_brand, p_type, p_size, count(DISTINCT ps_suppkey) AS supplier_cnt FROM ps JOIN part ON p_partkey = ps_partkey
WHERE p_brand <> 'Brand#5' AND p_type NOT LIKE 'MEDIUM%' AND p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
AND ps_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY p_brand, p_type, p_size""")
SET.sql("q17", """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE p_brand = 'Brand#2' AND l_quantity < (SELECT 0.2 * avg(l.l_quantity) FROM lineitem l WHERE l.l_partkey = part.p_partkey)""")
SET.sql("q18", """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, round(sum(l_quantity), 2) AS qty FROM customer
JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 300)
GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice ORDER BY o_totalprice DESC, o_orderkey LIMIT 100""")
SET.sql("q19", """SELECT round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN part ON p_partkey = l_partkey
WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20
AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""")
SET.sql("q20", f"""WITH ps AS {PARTSUPP} SELECT s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE s_suppkey IN (
SELECT ps_suppkey FROM ps WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE '%9%')
AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01'
AND l_shipdate < TIMESTAMP '1997-01-01')) AND n_name = 'NATION_2'""")
SET.sql("q21", """SELECT s_name, count(*) AS numwait FROM supplier JOIN lineitem l1 ON s_suppkey = l1.l_suppkey JOIN orders ON o_orderkey = l1.l_orderkey
JOIN nation ON s_nationkey = n_nationkey WHERE o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND n_name = 'NATION_2'
AND EXISTS (SELECT 1 FROM lineitem l2 WHERE l2.l_orderkey = l1.l_orderkey AND l2.l_suppkey <> l1.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lineitem l3 WHERE l3.l_orderkey = l1.l_orderkey AND l3.l_suppkey <> l1.l_suppkey AND l3.l_returnflag = 'R') GROUP BY s_name""")
SET.sql("q22", """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (3, 7, 11, 13, 17)
AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)
GROUP BY c_nationkey""")
SET.sql("q_theta", """SELECT p_partkey, p_retailprice FROM part CROSS JOIN (SELECT avg(p_retailprice) * 1.5 AS bar FROM part WHERE p_type = 'SMALL') s WHERE p_retailprice > bar""")
