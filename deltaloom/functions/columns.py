"""More of the function surface, every function over columns of a table."""

from __future__ import annotations

from functools import partial

from pyspark.sql import functions as F

from deltaloom.functions import scalar
from deltaloom.plans.sqlset import SqlSet
from deltaloom.sources.tables import dealt, table, views

SET = SqlSet()
pair = partial(scalar.pair, to=SET)

pair("fc_math", "part",
    ("k", "p_partkey", ""), ("a_bin", "bin(p_size)", ""), ("a_ceiling", "ceiling(p_retailprice / 7)", "CAST(ceil(p_retailprice / 7) AS BIGINT)"), ("a_conv", "conv(CAST(p_partkey AS STRING), 10, 16)", "upper(to_base(p_partkey, 16))"),
    ("a_cot", "round(cot(p_size), 6)", ""), ("a_e", "round(e() * p_size, 6)", "round(exp(1) * p_size, 6)"), ("a_hex", "hex(p_partkey)", "upper(to_base(p_partkey, 16))"), ("a_unhex", "CAST(unhex(hex(p_name)) AS STRING)", "p_name"),
    ("a_log", "round(log(p_retailprice), 6)", "round(ln(p_retailprice), 6)"), ("a_log_base", "round(log(2, p_retailprice), 6)", "round(ln(p_retailprice) / ln(2), 6)"), ("a_mod", "mod(p_partkey, 7)", "p_partkey % 7"), ("a_mod_word", "p_partkey % 5", ""),
    ("a_negative", "negative(p_size)", "-p_size"), ("a_positive", "positive(p_size)", "p_size"), ("a_unary", "+p_size - (-p_size)", "p_size + p_size"), ("a_pi", "round(pi() * p_size, 6)", ""), ("a_power", "power(p_size, 2)", "CAST(p_size AS DOUBLE) * p_size"),
    ("a_by_zero", "p_size / (p_size - p_size)", "CAST(NULL AS DOUBLE)"), ("a_div_zero", "p_size div (p_size - p_size)", "CAST(NULL AS BIGINT)"), ("a_mod_zero", "p_size % (p_size - p_size)", "CAST(NULL AS INT)"),
    ("a_float", "CAST(CAST(p_retailprice AS FLOAT) AS DOUBLE)", ""), ("a_smallint", "CAST(p_size AS SMALLINT)", ""), ("a_tinyint", "CAST(p_size AS TINYINT)", ""), ("a_wraps", "CAST(p_partkey + 300 AS TINYINT)", "CAST(((p_partkey + 300 + 128) % 256) - 128 AS TINYINT)"),
    ("a_implicit", "CAST(p_size AS STRING) + 1", "CAST(p_size + 1 AS DOUBLE)"), ("a_bround", "bround(p_size / 2.0D, 0)", "round_even(p_size / 2.0, 0)"), ansi=False)
pair("fc_hash", "(SELECT count(DISTINCT xxhash64(l_orderkey, l_linenumber)) AS x, count(DISTINCT md5(concat_ws('-', l_orderkey, l_linenumber))) AS m, count(DISTINCT crc32(CAST(l_returnflag AS BINARY))) AS c, count(DISTINCT hash(l_returnflag, l_linestatus)) AS h, count(DISTINCT u) AS u, count(*) AS n FROM (SELECT *, uuid() AS u FROM lineitem) l) t",
    ("x", "x", ""), ("m", "m", ""), ("c", "c", ""), ("h", "h", ""), ("u", "u", ""), ("n", "n", ""))
SET.oracle["fc_hash"] = """SELECT count(DISTINCT (l_orderkey, l_linenumber)) AS x, count(DISTINCT (l_orderkey, l_linenumber)) AS m, count(DISTINCT l_returnflag) AS c,
count(DISTINCT (l_returnflag, l_linestatus)) AS h, count(*) AS u, count(*) AS n FROM lineitem"""
SET.sql("fc_random", """SELECT count(*) AS n, count(DISTINCT r) > 0.99 * count(*) AS spread, bool_and(r >= 0 AND r < 1) AS bounds, abs(avg(r) - 0.5) < 0.02 AS middle, abs(avg(z)) < 0.05 AS zero, abs(stddev(z) - 1) < 0.05 AS one,
bool_and(r = r2) AS seeded FROM (SELECT rand(5) AS r, rand(5) AS r2, randn(9) AS z FROM lineitem) t""", "SELECT count(*) AS n, true AS spread, true AS bounds, true AS middle, true AS zero, true AS one, true AS seeded FROM lineitem")
pair("fc_string", "part",
    ("k", "p_partkey", ""), ("a_character_length", "character_length(p_name)", "CAST(length(p_name) AS INT)"), ("a_decode", "decode(encode(p_name, 'UTF-16'), 'UTF-16')", "p_name"), ("a_elt", "elt(1 + p_size % 2, p_name, p_brand)", "CASE WHEN p_size % 2 = 0 THEN p_name ELSE p_brand END"),
    ("a_find_in_set", "find_in_set(p_type, 'ECONOMY,PROMO,SMALL')", "CAST(coalesce(list_position(['ECONOMY', 'PROMO', 'SMALL'], p_type), 0) AS INT)"), ("a_format_number", "format_number(p_retailprice * 1000, 2)", "format('{:,.2f}', p_retailprice * 1000)"),
    ("a_format_string", "format_string('%05d-%s', p_size, p_brand)", "printf('%05d-%s', p_size, p_brand)"), ("a_printf", "printf('%s/%d', p_type, p_partkey)", "printf('%s/%d', p_type, p_partkey)"),
    ("a_ltrim", "ltrim(concat('  ', p_name, ' '))", "p_name || ' '"), ("a_rtrim", "rtrim(concat(' ', p_name, '  '))", "' ' || p_name"), ("a_trim", "trim(concat('  ', p_name, ' '))", "p_name"), ("a_trim_of", "trim(BOTH 'B' FROM p_brand)", "trim(p_brand, 'B')"),
    ("a_position", "position('a' IN p_name)", "CAST(position('a' IN p_name) AS INT)"), ("a_sentences", "array_join(flatten(sentences(concat(p_name, '. ', p_type, '!'))), '|')", "replace(p_name, ' ', '|') || '|' || p_type"),
    ("a_space", "space(p_size % 4)", "repeat(' ', p_size % 4)"), ("a_substr", "substr(p_name, 2, 3)", ""), ("a_substr_from", "substr(p_name, -3)", "right(p_name, 3)"), ("a_ucase", "ucase(p_name)", "upper(p_name)"), ("a_lcase", "lcase(p_type)", "lower(p_type)"),
    ("a_unbase64", "CAST(unbase64(base64(CAST(p_name AS BINARY))) AS STRING)", "p_name"), ("a_str_to_map", "str_to_map(concat('k:', p_size, ',b:', p_brand), ',', ':')['b']", "p_brand"), ("a_substring_index", "substring_index(p_name, ' ', 1)", "split_part(p_name, ' ', 1)"),
    ("a_escape", "concat(p_type, '_x') LIKE '%!_x' ESCAPE '!'", "true"), ("a_not_like", "concat(p_type, 'ax') LIKE '%!_x' ESCAPE '!'", "false"), ("a_soundex", "soundex(p_name) = soundex(upper(p_name))", "true"), ("a_initcap", "initcap(p_type)", "upper(left(p_type, 1)) || lower(substr(p_type, 2))"),
    ("a_overlay", "overlay(p_brand PLACING '--' FROM 2)", "left(p_brand, 1) || '--' || substr(p_brand, 4)"), ("a_crc32", "crc32(CAST(p_name AS BINARY)) = crc32(encode(p_name, 'UTF-8'))", "true"), ("a_left", "left(p_name, p_size % 5)", ""))
pair("fc_time", "events",
    ("k", "event_id", ""), ("a_today", "ts < current_timestamp() AND CAST(ts AS DATE) < current_date()", "ts < current_timestamp::TIMESTAMP AND CAST(ts AS DATE) < current_date"), ("a_date_sub", "CAST(date_sub(ts, 3) AS STRING)", "CAST(CAST(ts AS DATE) - 3 AS VARCHAR)"),
    ("a_dayofmonth", "dayofmonth(ts)", "CAST(day(ts) AS INT)"), ("a_from_unixtime", "from_unixtime(unix_timestamp(ts), 'yyyy-MM-dd HH:mm:ss')", "strftime(ts, '%Y-%m-%d %H:%M:%S')"),
    ("a_from_utc", "date_format(from_utc_timestamp(ts, 'America/New_York'), 'yyyy-MM-dd HH:mm:ss')", "strftime((ts AT TIME ZONE 'UTC') AT TIME ZONE 'America/New_York', '%Y-%m-%d %H:%M:%S')"),
    ("a_to_utc", "date_format(to_utc_timestamp(ts, 'Asia/Tokyo'), 'yyyy-MM-dd HH:mm:ss')", "strftime((ts AT TIME ZONE 'Asia/Tokyo') AT TIME ZONE 'UTC', '%Y-%m-%d %H:%M:%S')"),
    ("a_next_day", "CAST(next_day(ts, 'MON') AS STRING)", "CAST(CAST(date_trunc('week', ts) AS DATE) + 7 AS VARCHAR)"), ("a_timestamp", "timestamp(date_format(ts, 'yyyy-MM-dd HH:mm:ss')) = date_trunc('SECOND', ts)", "true"), ("a_to_date", "CAST(to_date(date_format(ts, 'dd/MM/yyyy'), 'dd/MM/yyyy') AS STRING)", "CAST(CAST(ts AS DATE) AS VARCHAR)"),
    ("a_to_timestamp", "unix_timestamp(to_timestamp(date_format(ts, 'yyyyMMdd HHmm'), 'yyyyMMdd HHmm'))", "CAST(epoch(date_trunc('minute', ts)) AS BIGINT)"), ("a_to_unix", "to_unix_timestamp(date_format(ts, 'yyyy-MM-dd'), 'yyyy-MM-dd')", "CAST(epoch(date_trunc('day', ts)) AS BIGINT)"),
    ("a_months", "round(months_between(date_trunc('MONTH', ts), DATE '2020-01-01'), 4)", "CAST(datediff('month', DATE '2020-01-01', CAST(ts AS DATE)) AS DOUBLE)"), ("a_interval", "date_format(ts + INTERVAL 90 MINUTES - INTERVAL 1 DAY, 'yyyy-MM-dd HH:mm')", "strftime(ts + INTERVAL 90 MINUTE - INTERVAL 1 DAY, '%Y-%m-%d %H:%M')"),
    ("a_fields", "extract(QUARTER FROM ts) * 1000000 + extract(WEEK FROM ts) * 10000 + extract(DOY FROM ts) * 10 + extract(DOW FROM ts)", "CAST(quarter(ts) * 1000000 + weekofyear(ts) * 10000 + dayofyear(ts) * 10 + dayofweek(ts) + 1 AS INT)"),
    ("a_clock", "extract(HOUR FROM ts) * 10000 + extract(MINUTE FROM ts) * 100 + floor(extract(SECOND FROM ts))", "CAST(hour(ts) * 10000 + minute(ts) * 100 + second(ts) AS BIGINT)"), ("a_make_date", "CAST(make_date(year(ts), month(ts), 1) AS STRING)", "CAST(CAST(date_trunc('month', ts) AS DATE) AS VARCHAR)"))
pair("fc_json", "events",
    ("k", "event_id", ""), ("a_from_json", "from_json(props, 'k INT').k", "CAST(json_extract_string(props, '$.k') AS INT)"), ("a_get_json_object", "get_json_object(props, '$.k')", "json_extract_string(props, '$.k')"), ("a_missing", "get_json_object(props, '$.none')", "CAST(NULL AS VARCHAR)"),
    ("a_to_json", "to_json(named_struct('u', user_id, 't', event_type))", "'{\"u\":' || user_id || ',\"t\":\"' || event_type || '\"}'"), ("a_keys", "array_join(json_object_keys(props), ',')", "array_to_string(json_keys(props), ',')"), ("a_length", "json_array_length(concat('[', user_id, ',2]'))", "CAST(json_array_length('[' || user_id || ',2]') AS INT)"),
    ("a_from_csv", "from_csv(concat(user_id, ',', event_type), 'a LONG, b STRING').b", "event_type"), ("a_to_csv", "to_csv(struct(user_id, event_type))", "user_id || ',' || event_type"), ("a_map", "from_json(props, 'map<string,int>')['k']", "CAST(json_extract_string(props, '$.k') AS INT)"))
SET.sql("fc_json_tuple", "SELECT event_id, a, b FROM events LATERAL VIEW json_tuple(props, 'k', 'none') j AS a, b", "SELECT event_id, json_extract_string(props, '$.k') AS a, CAST(NULL AS VARCHAR) AS b FROM events")
_XML = "concat('<a><b>', p_size, '</b><b>', p_size + 1, '</b><c>', p_type, '</c></a>')"
pair("fc_xpath", "part",
    ("k", "p_partkey", ""), ("a_boolean", f"xpath_boolean({_XML}, 'a/b[text()>25]')", "p_size + 1 > 25"), ("a_short", f"xpath_short({_XML}, 'sum(a/b)')", "CAST(2 * p_size + 1 AS SMALLINT)"), ("a_int", f"xpath_int({_XML}, 'a/b[1]')", "p_size"), ("a_long", f"xpath_long({_XML}, 'a/b[2]')", "CAST(p_size + 1 AS BIGINT)"),
    ("a_float", f"CAST(xpath_float({_XML}, 'a/b[1]') AS DOUBLE)", "CAST(p_size AS DOUBLE)"), ("a_double", f"xpath_double({_XML}, 'a/b[1]')", "CAST(p_size AS DOUBLE)"), ("a_number", f"xpath_number({_XML}, 'count(a/b)')", "CAST(2 AS DOUBLE)"), ("a_string", f"xpath_string({_XML}, 'a/c')", "p_type"),
    ("a_list", f"array_join(xpath({_XML}, 'a/b/text()'), ',')", "p_size || ',' || (p_size + 1)"), rows=20_000)
pair("fc_url", "pages",
    ("k", "page_id", ""), ("a_host", "parse_url(url, 'HOST')", "regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1)"), ("a_protocol", "parse_url(url, 'PROTOCOL')", "regexp_extract(url, '^([a-z]+)://', 1)"), ("a_round", "url_decode(url_encode(url))", "url"),
    ("a_query", "parse_url(concat('http://h/p?id=', page_id), 'QUERY', 'id')", "CAST(page_id AS VARCHAR)"))
pair("fc_nested", "part",
    ("k", "p_partkey", ""), ("a_ifnull", "ifnull(nullif(p_size, 11), -1)", "coalesce(nullif(p_size, 11), -1)"), ("a_nvl2", "nvl2(nullif(p_size, 11), p_size, 0)", "CASE WHEN p_size <> 11 THEN p_size ELSE 0 END"), ("a_zip_with", "array_join(zip_with(array(p_size, 1), array(2, p_size), (x, y) -> x + y), ',')", "(p_size + 2) || ',' || (p_size + 1)"),
    ("a_beyond", "array(p_size, 1)[5]", "CAST(NULL AS INT)"), ("a_two_deep", "array(array(p_size, 1), array(2, 3))[0][0]", "p_size"), ("a_two_beyond", "array(array(p_size))[1][0]", "CAST(NULL AS INT)"), ("a_no_key", "map('a', p_size)['b']", "CAST(NULL AS INT)"),
    ("a_map_types", "element_at(map_concat(map('a', p_size), map('b', CAST(p_partkey AS INT))), 'a')", "p_size"), ("a_arrays_of", "map_from_arrays(array(p_name, p_type), array(1, p_size))[p_type]", "p_size"), ("a_transform_keys", "transform_keys(map(p_name, 1), (k, v) -> upper(k))[upper(p_name)]", "1"),
    ("a_shuffle", "array_join(sort_array(shuffle(array(p_size, 60, 70))), ',')", "p_size || ',60,70'"), ("a_struct", "struct(p_size, p_name).p_name", "p_name"), ("a_reflect", "reflect('java.lang.Math', 'abs', -p_size)", "CAST(p_size AS VARCHAR)"), ("a_java_method", "java_method('java.lang.Integer', 'toHexString', p_size)", "lower(to_base(p_size, 16))"))
SET.sql("fc_struct_star", "SELECT s.* FROM (SELECT named_struct('k', p_partkey, 'n', p_name) AS s FROM part) t", "SELECT p_partkey AS k, p_name AS n FROM part")
SET.sql("fc_generators", """SELECT p_partkey AS k, a, b FROM part LATERAL VIEW stack(2, p_size, p_brand, p_size + 1, p_type) s AS a, b
UNION ALL SELECT p_partkey, a, b FROM part LATERAL VIEW inline(array(struct(p_size, p_name))) i AS a, b
UNION ALL SELECT p_partkey, a, NULL FROM part LATERAL VIEW OUTER explode(filter(array(p_size, p_size + 1), x -> x > 40)) e AS a""",
        """SELECT p_partkey AS k, p_size AS a, p_brand AS b FROM part UNION ALL SELECT p_partkey, p_size + 1, p_type FROM part UNION ALL SELECT p_partkey, p_size, p_name FROM part
UNION ALL SELECT p_partkey, p_size, NULL FROM part WHERE p_size > 40 UNION ALL SELECT p_partkey, p_size + 1, NULL FROM part WHERE p_size + 1 > 40 UNION ALL SELECT p_partkey, NULL, NULL FROM part WHERE p_size + 1 <= 40""")  # fmt: skip
SET.sql("fc_three_valued", """SELECT a, b, a AND b AS c_and, a OR b AS c_or, NOT a AS c_not, a = b AS c_eq, a <=> b AS c_same, a IN (b, true) AS c_in, count(*) AS n
FROM (SELECT CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 = 1 END AS b FROM part) t GROUP BY a, b""",
        """SELECT a, b, a AND b AS c_and, a OR b AS c_or, NOT a AS c_not, a = b AS c_eq, a IS NOT DISTINCT FROM b AS c_same, a IN (b, true) AS c_in, count(*) AS n
FROM (SELECT CASE WHEN p_size % 3 = 0 THEN NULL ELSE p_size % 3 = 1 END AS a, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey % 3 = 1 END AS b FROM part) t GROUP BY a, b""")  # fmt: skip
SET.sql("fc_assert_true", "SELECT p_partkey, assert_true(p_size > 0) IS NULL AS passed, current_database() = current_schema() AS here FROM part", "SELECT p_partkey, true AS passed, true AS here FROM part")
SET.sql("fc_agg_first_last", "SELECT p_brand, first(p_brand) AS a, last(p_brand, true) AS b, any_value(p_brand) AS c, first(nullif(p_brand, p_brand), false) AS d FROM part GROUP BY p_brand",
        "SELECT p_brand, p_brand AS a, p_brand AS b, p_brand AS c, CAST(NULL AS VARCHAR) AS d FROM part GROUP BY p_brand")
_MOMENT = "(SELECT p_brand, p_retailprice AS x, avg(p_retailprice) OVER (PARTITION BY p_brand) AS m, stddev_pop(p_retailprice) OVER (PARTITION BY p_brand) AS s FROM part)"
SET.sql("fc_agg_moments", """SELECT p_brand, round(skewness(p_retailprice), 6) AS skew, round(kurtosis(p_retailprice), 6) AS kurt, round(std(p_retailprice), 6) AS sd, some(p_size > 49) AS a, any(p_size > 49) AS b, every(p_size > 0) AS c, bool_or(p_size > 50) AS d,
sum(DISTINCT p_size) AS sd_size, count(DISTINCT p_size, p_type) AS pairs FROM part GROUP BY p_brand""",
        f"""SELECT p_brand, round(avg(power((x - m) / s, 3)), 6) AS skew, round(avg(power((x - m) / s, 4)) - 3, 6) AS kurt, round(stddev_samp(x), 6) AS sd, a, b, c, d, sd_size, pairs FROM {_MOMENT} JOIN (
SELECT p_brand, bool_or(p_size > 49) AS a, bool_or(p_size > 49) AS b, bool_and(p_size > 0) AS c, bool_or(p_size > 50) AS d, sum(DISTINCT p_size) AS sd_size, count(DISTINCT (p_size, p_type)) AS pairs FROM part GROUP BY p_brand) g USING (p_brand)
GROUP BY p_brand, a, b, c, d, sd_size, pairs""")  # fmt: skip
SET.sql("fc_agg_grouping", "SELECT p_brand, p_type, CAST(grouping(p_brand) AS INT) AS gb, CAST(grouping(p_type) AS INT) AS gt, CAST(grouping_id(p_brand, p_type) AS INT) AS id, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)",
        "SELECT p_brand, p_type, CAST(grouping(p_brand) AS INT) AS gb, CAST(grouping(p_type) AS INT) AS gt, CAST(grouping_id(p_brand, p_type) AS INT) AS id, count(*) AS n FROM part GROUP BY CUBE (p_brand, p_type)")
SET.sql("fc_agg_alias_keys", "SELECT p_size % 7 AS g, count(*) AS n FROM part GROUP BY g HAVING n > 1 ORDER BY 2 DESC, 1", "SELECT p_size % 7 AS g, count(*) AS n FROM part GROUP BY 1 HAVING count(*) > 1")
SET.sql("fc_agg_histogram", "SELECT CAST(b.x AS INT) AS r, CAST(b.y AS BIGINT) AS n FROM (SELECT explode(histogram_numeric(n_regionkey, 5)) AS b FROM nation) t", "SELECT n_regionkey AS r, count(*) AS n FROM nation GROUP BY n_regionkey")
SET.sql("fc_agg_bounds", """SELECT l_returnflag, abs(approx_count_distinct(l_orderkey) - count(DISTINCT l_orderkey)) <= 0.15 * count(DISTINCT l_orderkey) AS near, count(DISTINCT l_orderkey) AS n,
approx_count_distinct(l_linenumber) AS few, abs(percentile_approx(l_quantity, 0.5) - percentile(l_quantity, 0.5)) <= 1 AS middle, percentile(l_quantity, 0.5) AS p FROM lineitem GROUP BY l_returnflag""",
        """SELECT l_returnflag, true AS near, count(DISTINCT l_orderkey) AS n, count(DISTINCT l_linenumber) AS few, true AS middle, quantile_cont(l_quantity, 0.5) AS p FROM lineitem GROUP BY l_returnflag""")  # fmt: skip


def agg_bounds(spark, sf_dir):
    """Orders are counted apart, as the other aggregates' buffers would else be kept for each order."""
    lines = table(spark, sf_dir, "lineitem").select("l_returnflag", "l_orderkey", "l_linenumber", "l_quantity")
    rest = lines.groupBy("l_returnflag").agg(F.approx_count_distinct("l_orderkey").alias("guess"), F.approx_count_distinct("l_linenumber").alias("few"), F.percentile_approx("l_quantity", 0.5).alias("m"), F.percentile("l_quantity", 0.5).alias("p"))
    orders = dealt(lines.select(F.col("l_returnflag").alias("f"), "l_orderkey"), "f", "l_orderkey").distinct().groupBy("f").agg(F.count("l_orderkey").alias("n"))
    both = rest.join(orders, F.col("l_returnflag").eqNullSafe(F.col("f")))
    return both.select("l_returnflag", (F.abs(F.col("guess") - F.col("n")) <= 0.15 * F.col("n")).alias("near"), "n", "few", (F.abs(F.col("m") - F.col("p")) <= 1).alias("middle"), "p")


SET.queries["fc_agg_bounds"] = agg_bounds


@SET.frame("fc_count_min_sketch", "SELECT l_returnflag AS item, count(*) AS n, true AS never_less FROM lineitem GROUP BY l_returnflag")
def count_min_sketch(spark, sf_dir):
    """Counts read from a sketch: never too small, and right where few items share it."""
    lines = table(spark, sf_dir, "lineitem")
    sketch = lines._jdf.stat().countMinSketch("l_returnflag", 0.001, 0.99, 42)
    items = sorted(r[0] for r in lines.select("l_returnflag").distinct().collect())
    exact = {r[0]: r[1] for r in lines.groupBy("l_returnflag").count().collect()}
    rows = [(i, int(sketch.estimateCount(i)), int(sketch.estimateCount(i)) >= exact[i]) for i in items]
    return spark.createDataFrame(rows, "item string, n long, never_less boolean")


@SET.frame("fc_sketch_bytes", "SELECT p_brand, true AS same FROM part GROUP BY p_brand")
def sketch_bytes(spark, sf_dir):
    """The sketch aggregate merges partials: that of a group is the same however the rows are dealt."""
    parts = table(spark, sf_dir, "part")
    sketch = F.expr("count_min_sketch(p_partkey, 0.1D, 0.9D, 1)")
    a, b = parts.repartition(1).groupBy("p_brand").agg(sketch.alias("a")), parts.repartition(5).groupBy("p_brand").agg(sketch.alias("b"))
    return a.join(b, "p_brand").select("p_brand", (F.col("a") == F.col("b")).alias("same"))


@SET.frame("fc_freq_items", "SELECT 'l_returnflag' AS c, l_returnflag AS item FROM lineitem GROUP BY l_returnflag UNION ALL SELECT 'l_linenumber', CAST(l_linenumber AS VARCHAR) FROM lineitem GROUP BY l_linenumber")
def freq_items(spark, sf_dir):
    """All values of columns with fewer than 1 / support of them are frequent."""
    found = table(spark, sf_dir, "lineitem").stat.freqItems(["l_returnflag", "l_linenumber"], 0.05)
    each = [found.select(F.lit(c).alias("c"), F.explode(F.col(f"{c}_freqItems").cast("array<string>")).alias("item")) for c in ("l_returnflag", "l_linenumber")]
    return each[0].unionAll(each[1])


@SET.frame("fc_partition_ids", "SELECT count(*) AS n, 6 AS parts, true AS bounds FROM orders")
def partition_ids(spark, sf_dir):
    o = table(spark, sf_dir, "orders").repartition(6)
    return o.select(F.spark_partition_id().alias("p"), F.monotonically_increasing_id().alias("i")).agg(
        F.count("*").alias("n"), F.countDistinct("p").cast("int").alias("parts"), F.expr("bool_and(p BETWEEN 0 AND 5 AND shiftright(i, 33) = p)").alias("bounds"))


@SET.frame("fc_input_file", "SELECT 'nation.parquet' AS f, true AS whole, count(*) AS n FROM nation")
def input_file(spark, sf_dir):
    n = table(spark, sf_dir, "nation").selectExpr("regexp_extract(input_file_name(), '([^/]+[.]parquet)', 1) AS f", "input_file_block_start() = 0 AND input_file_block_length() > 0 AS whole")
    return n.groupBy("f", "whole").agg(F.count("*").alias("n"))


@SET.frame("fc_overflow", "SELECT 'decimal' AS kind, true AS nulled, true AS raised UNION ALL SELECT 'long', false, true")
def overflow(spark, sf_dir):
    """What is too large is null, or wraps, by the engine's settings, and an error under ANSI rules."""
    views(spark, sf_dir, "part")
    out = []
    for kind, text in (("decimal", "max(CAST(p_partkey + 1 AS DECIMAL(38, 0)) * CAST('9e37' AS DECIMAL(38, 0)))"), ("long", "max(p_partkey + 9223372036854775807)")):
        was = spark.conf.get("spark.sql.ansi.enabled")
        spark.conf.set("spark.sql.ansi.enabled", "false")
        nulled = spark.sql(f"SELECT {text} AS x FROM part WHERE p_partkey > 0").first()[0] is None
        try:
            spark.conf.set("spark.sql.ansi.enabled", "true")
            spark.sql(f"SELECT {text} AS x FROM part WHERE p_partkey > 0").collect()
            raised = False
        except Exception as e:  # noqa: BLE001  the engine's own class depends on the operation
            raised = "OVERFLOW" in str(e) or "OUT_OF_RANGE" in str(e)
        finally:
            spark.conf.set("spark.sql.ansi.enabled", was)
        out.append((kind, nulled, raised))
    return spark.createDataFrame(out, "kind string, nulled boolean, raised boolean")
