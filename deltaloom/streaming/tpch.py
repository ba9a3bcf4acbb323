"""TPC-H shapes kept up to date under inserts, deletes and updates of their large tables.

customer, orders and lineitem come as changes (see incremental.changes); part, supplier, nation and region are static.
Every view must give what the batch query gives over the whole tables, so the oracle is that query's SQL. A limit is
taken over the maintained rows when they are read, as it is the report and not the view.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from deltaloom.plans import tpch
from deltaloom.plans.sqlset import SqlSet
from deltaloom.sources.tables import table
from deltaloom.streaming.incremental import Join, Recomputed, Sums, Theta, changes, maintained, minus, weighted
from deltaloom.streaming.state import At, W

SET = SqlSet()
KEY = {"customer": "c_custkey", "orders": "o_orderkey", "lineitem": "l_orderkey"}


def revenue() -> Column:
    return F.col("l_extendedprice") * (1 - F.col("l_discount"))


def two_digits() -> dict[str, Column]:
    return {"revenue": F.round("revenue", 2)}


def view(name: str, *streams: str) -> Callable:
    """Register step(spark, sf_dir), which makes a view's step function over the changes of streams, as inc_<name>."""

    def add(make: Callable) -> Callable:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            batches = zip(*[changes(table(spark, sf_dir, t), KEY[t]) for t in streams], strict=True)
            return maintained(spark, list(batches), make(spark, sf_dir))

        SET.queries[f"inc_{name}"], SET.oracle[f"inc_{name}"] = run, tpch.SET.oracle[name]
        return make

    return add


def read_as(name: str, final: Callable[[DataFrame], DataFrame]) -> None:
    """What a report takes from the maintained rows."""
    run = SET.queries[name]
    SET.queries[name] = lambda spark, sf_dir: final(run(spark, sf_dir))


def between(column: str, first: str, end: str) -> str:
    return f"{column} >= TIMESTAMP '{first}' AND {column} < TIMESTAMP '{end}'"


@view("q1", "lineitem")
def q1(spark, sf_dir):
    sums = {"qty": F.col("l_quantity"), "base": F.col("l_extendedprice"), "disc": revenue(), "charge": revenue() * (1 + F.col("l_tax")), "d": F.col("l_discount")}
    mean = lambda c: F.round(F.col(c) / F.col(f"{c}__n"), 4)
    final = {
        "sum_qty": F.round("qty", 2), "sum_base_price": F.round("base", 2), "sum_disc_price": F.round("disc", 2), "sum_charge": F.round("charge", 2),
        "avg_qty": mean("qty"), "avg_price": mean("base"), "avg_disc": mean("d"), "count_order": F.col("n"),
    }
    op = Sums("q1", ["l_returnflag", "l_linestatus"], sums, final)
    return lambda at, lines: op.step(at, lines.filter("l_shipdate <= TIMESTAMP '1998-09-02'"))


@view("q3", "customer", "orders", "lineitem")
def q3(spark, sf_dir):
    mine, priced = Join("mine", ["c_custkey"]), Join("priced", ["l_orderkey"])
    total = Sums("total", ["l_orderkey", "o_orderdate"], {"revenue": revenue()}, two_digits())

    def step(at: At, customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
        c = customers.filter("c_mktsegment = 'BUILDING'").select("c_custkey", W)
        o = orders.filter("o_orderdate < TIMESTAMP '1997-03-15'").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"), "o_orderdate", W)
        rows = lines.filter("l_shipdate > TIMESTAMP '1997-03-15'").select("l_orderkey", "l_extendedprice", "l_discount", W)
        return total.step(at, priced.step(at, mine.step(at, c, o).drop("c_custkey"), rows))

    return step


read_as("inc_q3", lambda df: df.orderBy(F.desc("revenue"), "o_orderdate", "l_orderkey").limit(10))


@view("q4", "orders", "lineitem")
def q4(spark, sf_dir):
    returned, count = Join("returned", ["o_orderkey"], "semi"), Sums("count", ["o_orderpriority"], {}, {"order_count": F.col("n")})

    def step(at: At, orders: DataFrame, lines: DataFrame) -> DataFrame:
        o = orders.filter(between("o_orderdate", "1996-07-01", "1996-10-01")).select("o_orderkey", "o_orderpriority", W)
        return count.step(at, returned.step(at, o, lines.filter("l_returnflag = 'R'").select(F.col("l_orderkey").alias("o_orderkey"), W)))

    return step


@view("q5", "customer", "orders", "lineitem")
def q5(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").filter("n_regionkey = 2").select("n_nationkey", "n_name")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_nationkey", "n_name")
    mine, priced, total = Join("mine", ["c_custkey"]), Join("priced", ["l_orderkey"]), Sums("total", ["n_name"], {"revenue": revenue()}, two_digits())

    def step(at: At, customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
        o = orders.filter(between("o_orderdate", "1996-01-01", "1997-01-01")).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"), W)
        owned = mine.step(at, customers.select("c_custkey", "c_nationkey", W), o).drop("c_custkey")
        sold = lines.select("l_orderkey", "l_suppkey", "l_extendedprice", "l_discount", W).join(suppliers, F.col("l_suppkey") == F.col("s_suppkey")).drop("l_suppkey", "s_suppkey")
        return total.step(at, priced.step(at, owned, sold).filter("c_nationkey = s_nationkey"))

    return step


@view("q6", "lineitem")
def q6(spark, sf_dir):
    op = Sums("q6", [], {"revenue": F.col("l_extendedprice") * F.col("l_discount")}, two_digits())
    return lambda at, lines: op.step(at, lines.filter(between("l_shipdate", "1996-01-01", "1997-01-01")).filter("l_discount BETWEEN 0.05 AND 0.07 AND l_quantity < 24"))


@view("q10", "customer", "orders", "lineitem")
def q10(spark, sf_dir):
    nations = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    returned, owned = Join("returned", ["l_orderkey"]), Join("owned", ["c_custkey"])
    total = Sums("total", ["c_custkey", "c_name", "c_acctbal", "n_name"], {"revenue": revenue()}, two_digits())

    def step(at: At, customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
        o = orders.filter(between("o_orderdate", "1996-10-01", "1997-01-01")).select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderkey").alias("l_orderkey"), W)
        rows = returned.step(at, o, lines.filter("l_returnflag = 'R'").select("l_orderkey", "l_extendedprice", "l_discount", W)).drop("l_orderkey")
        c = customers.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "c_name", "c_acctbal", "n_name", W)
        return total.step(at, owned.step(at, c, rows))

    return step


read_as("inc_q10", lambda df: df.orderBy(F.desc("revenue"), "c_custkey").limit(20))


@view("q12", "orders", "lineitem")
def q12(spark, sf_dir):
    priced, urgent = Join("priced", ["l_orderkey"]), F.col("o_orderpriority").isin("1-URGENT", "2-HIGH").cast("int")
    final = {"high_line_count": F.col("high").cast("long"), "low_line_count": F.col("low").cast("long")}
    count = Sums("count", ["l_returnflag"], {"high": urgent, "low": 1 - urgent}, final)

    def step(at: At, orders: DataFrame, lines: DataFrame) -> DataFrame:
        rows = lines.filter(between("l_shipdate", "1996-01-01", "1997-01-01")).select("l_orderkey", "l_returnflag", W)
        return count.step(at, priced.step(at, orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderpriority", W), rows))

    return step


@view("q13", "customer", "orders")
def q13(spark, sf_dir):
    """A left join whose unmatched customers come and go, then counts of counts."""
    owned = Join("owned", ["c_custkey"], "left")
    orders_of = Sums("orders", ["c_custkey"], {"o": F.col("o_orderkey")}, {"c_count": F.col("o__n")})
    customers_with = Sums("customers", ["c_count"], {}, {"custdist": F.col("n")})

    def step(at: At, customers: DataFrame, orders: DataFrame) -> DataFrame:
        o = orders.filter("o_orderpriority <> '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"), "o_orderkey", W)
        return customers_with.step(at, orders_of.step(at, owned.step(at, customers.select("c_custkey", W), o)))

    return step


@view("q14", "lineitem")
def q14(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_type")
    promo = F.when(F.col("p_type").like("PROMO%"), revenue()).otherwise(0.0)
    share = Sums("share", [], {"promo": promo, "all": revenue()}, {"promo_revenue": F.round(100.0 * F.col("promo") / F.col("all"), 4)})
    return lambda at, lines: share.step(at, lines.filter(between("l_shipdate", "1996-09-01", "1996-10-01")).join(parts, F.col("l_partkey") == F.col("p_partkey")))


@view("q15", "lineitem")
def q15(spark, sf_dir):
    """The suppliers of greatest revenue: a maximum whose holder may be taken back."""
    suppliers = table(spark, sf_dir, "supplier").select("s_suppkey", "s_name")
    sold = Sums("sold", ["s_suppkey"], {"total": revenue()}, {"total": F.round("total", 2)})
    top = Recomputed("top", [], lambda df: df.join(F.broadcast(df.agg(F.max("total").alias("total"))), "total").select("s_suppkey", "s_name", "total"))  # one row

    def step(at: At, lines: DataFrame) -> DataFrame:
        rows = lines.filter(between("l_shipdate", "1996-01-01", "1996-04-01")).withColumnRenamed("l_suppkey", "s_suppkey")
        return top.step(at, sold.step(at, rows).join(suppliers, "s_suppkey"))

    return step


@view("q18", "customer", "orders", "lineitem")
def q18(spark, sf_dir):
    """Orders enter and leave as their quantity crosses 300."""
    quantity, large, owned = Sums("quantity", ["o_orderkey"], {"qty": F.col("l_quantity")}, {"qty": F.round("qty", 2)}), Join("large", ["o_orderkey"]), Join("owned", ["c_custkey"])

    def step(at: At, customers: DataFrame, orders: DataFrame, lines: DataFrame) -> DataFrame:
        big = quantity.step(at, lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_quantity", W)).filter("qty > 300")
        o = orders.select("o_orderkey", F.col("o_custkey").alias("c_custkey"), "o_orderdate", "o_totalprice", W)
        return owned.step(at, customers.select("c_custkey", "c_name", W), large.step(at, o, big))

    return step


read_as("inc_q18", lambda df: df.orderBy(F.desc("o_totalprice"), "o_orderkey").limit(100))


@view("q19", "lineitem")
def q19(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size")
    wanted = """(p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5) OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20
        AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#3' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)"""
    op = Sums("q19", [], {"revenue": revenue()}, two_digits())
    return lambda at, lines: op.step(at, lines.join(parts, F.col("l_partkey") == F.col("p_partkey")).filter(wanted))


@view("q21", "orders", "lineitem")
def q21(spark, sf_dir):
    """Suppliers who alone of several returned a line of an order: what holds of an order is found anew when it changes."""
    nations = table(spark, sf_dir, "nation").filter("n_name = 'NATION_2'").select("n_nationkey")
    suppliers = table(spark, sf_dir, "supplier").join(nations, F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", "s_name")

    def alone(lines: DataFrame) -> DataFrame:
        returned = F.when(F.col("l_returnflag") == "R", F.col("l_suppkey"))
        orders = lines.groupBy("o_orderkey").agg(F.countDistinct("l_suppkey").alias("all"), F.countDistinct(returned).alias("late"), F.first(returned, True).alias("s_suppkey"), F.count(returned).alias("n"))
        one = orders.filter("late = 1 AND all > 1")
        return one.select("o_orderkey", "s_suppkey", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))).alias("i"))

    waiting, failed, count = Recomputed("waiting", ["o_orderkey"], alone), Join("failed", ["o_orderkey"]), Sums("count", ["s_name"], {}, {"numwait": F.col("n")})

    def step(at: At, orders: DataFrame, lines: DataFrame) -> DataFrame:
        kept = waiting.step(at, lines.select(F.col("l_orderkey").alias("o_orderkey"), "l_suppkey", "l_returnflag", W))
        o = orders.filter("o_orderstatus = 'F'").select("o_orderkey", W)
        return count.step(at, failed.step(at, o, kept).join(suppliers, "s_suppkey"))

    return step


@view("q22", "customer", "orders")
def q22(spark, sf_dir):
    """An anti join and a bar that moves with the customers."""
    bar = Sums("bar", [], {"x": F.col("c_acctbal")}, {"bar": F.col("x") / F.col("x__n")})
    above, without = Theta("above", "c_acctbal > bar"), Join("without", ["c_custkey"], "anti")
    total = Sums("total", ["c_nationkey"], {"x": F.col("c_acctbal")}, {"numcust": F.col("n"), "totacctbal": F.round("x", 2)})

    def step(at: At, customers: DataFrame, orders: DataFrame) -> DataFrame:
        moved = bar.step(at, customers.filter("c_acctbal > 0"))
        rich = above.step(at, customers.filter("c_nationkey IN (3, 7, 11, 13, 17)").select("c_custkey", "c_nationkey", "c_acctbal", W), moved)
        return total.step(at, without.step(at, rich, orders.filter("o_totalprice > 400000").select(F.col("o_custkey").alias("c_custkey"), W)))

    return step


@SET.frame("inc_rising_sums", "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey")
def inc_rising_sums(spark, sf_dir):
    """Updates: every order comes at half its price and is then put right."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    half = o.withColumn("o_totalprice", F.col("o_totalprice") / 2)
    op = Sums("s", ["o_custkey"], {"s": F.col("o_totalprice")}, {"s": F.round("s", 2)})
    return maintained(spark, [(weighted(half),), (minus(weighted(o), weighted(half)),)], op.step)
