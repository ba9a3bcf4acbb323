"""The scalar-function surface, a query for each family. Each is a pair of texts, as function names differ."""

from __future__ import annotations

from deltaloom.plans.sqlset import SqlSet

SET = SqlSet()


def pair(name: str, source: str, *columns: tuple[str, str, str], to: SqlSet = SET, ansi: bool | None = None, rows: int | None = None) -> None:
    """columns: name, Spark's expression, the oracle's (empty: the same)."""
    mine = ", ".join(f"{s} AS {c}" for c, s, _ in columns)
    other = ", ".join(f"{o or s} AS {c}" for c, s, o in columns)
    to.sql(name, f"SELECT {mine} FROM {source}", f"SELECT {other} FROM {source}", ansi, rows)


pair("fn_math", "lineitem",
    ("k", "l_orderkey", ""), ("a", "round(sqrt(l_quantity) + cbrt(l_quantity) + exp(l_discount) + ln(l_quantity), 6)", ""),
    ("b", "round(log10(l_quantity) + log2(l_quantity) + pow(l_quantity, 1.5), 5)", ""), ("c", "ceil(l_tax * 100) + floor(l_discount * 100)", "CAST(ceil(l_tax * 100) + floor(l_discount * 100) AS BIGINT)"),
    ("d", "round(sin(l_tax) + cos(l_tax) + tan(l_tax) + asin(l_tax) + acos(l_tax) + atan(l_tax) + atan2(l_tax, 2) + sinh(l_tax) + cosh(l_tax) + tanh(l_tax), 6)", ""),
    ("e", "sign(l_quantity - 25)", "CAST(sign(l_quantity - 25) AS DOUBLE)"), ("f", "abs(l_quantity - 25) % 7", ""), ("g", "greatest(l_tax, l_discount, 0.03)", "greatest(l_tax, l_discount, CAST(0.03 AS DOUBLE))"),
    ("h", "least(l_quantity, 10.0)", "least(l_quantity, CAST(10.0 AS DOUBLE))"), ("i", "pmod(-l_orderkey, 7)", "((-l_orderkey % 7) + 7) % 7"), ("j", "round(degrees(l_tax) + radians(l_quantity), 6)", ""),
    ("m", "factorial(l_linenumber)", "CAST(factorial(l_linenumber) AS BIGINT)"), ("n", "round(hypot(l_tax, l_discount), 6)", "round(sqrt(l_tax * l_tax + l_discount * l_discount), 6)"),
    ("o", "l_orderkey div 3", "l_orderkey // 3"), ("p", "nullif(l_linenumber, 3) + 1", ""), ("q", "bround(2.5, 0)", "2.0"), ("r", "width_bucket(l_quantity, 0, 50, 5)", "CAST(floor(l_quantity / 10) + 1 AS BIGINT)"), ("s", "rint(l_quantity)", "round_even(l_quantity, 0)"),
    ("t", "try_divide(l_quantity, l_linenumber - 1)", "l_quantity / nullif(l_linenumber - 1, 0)"), ("u", "expm1(0.0) + log1p(0.0)", "CAST(0 AS DOUBLE)"), ("v", "conv('ff', 16, 10)", "'255'"), ("w", "hex(255)", "'FF'"), ("x", "bin(10)", "'1010'"))
pair("fn_bitwise", "orders",
    ("k", "o_orderkey", ""), ("a", "o_orderkey & 255", ""), ("b", "o_orderkey | 16", ""), ("c", "o_orderkey ^ 5", "xor(o_orderkey, 5)"), ("d", "~o_orderkey", ""), ("e", "shiftleft(o_orderkey, 2)", "o_orderkey << 2"),
    ("f", "shiftright(o_orderkey, 1)", "o_orderkey >> 1"), ("g", "bit_count(o_orderkey)", "CAST(bit_count(o_orderkey) AS INT)"), ("h", "getbit(o_orderkey, 1)", "CAST((o_orderkey >> 1) & 1 AS TINYINT)"))
pair("fn_string", "part",
    ("k", "p_partkey", ""), ("a", "upper(p_name) || lower(p_type)", ""), ("b", "length(p_name)", "CAST(length(p_name) AS INT)"), ("c", "substring(p_name, 2, 4)", ""), ("d", "trim('  x ') || ltrim('  y') || rtrim('z  ')", ""),
    ("e", "lpad(p_brand, 12, '*')", ""), ("f", "rpad(p_brand, 10, '-')", ""), ("g", "replace(p_brand, 'Brand', 'B')", ""), ("h", "instr(p_brand, '#')", "CAST(instr(p_brand, '#') AS INT)"), ("i", "reverse(p_brand)", ""),
    ("j", "repeat('ab', p_size % 3)", ""), ("l", "concat_ws('|', p_brand, p_type)", ""), ("m", "translate(p_brand, 'Bd', 'xy')", ""), ("n", "initcap('hello world')", "'Hello World'"), ("o", "ascii(p_brand)", ""), ("p", "chr(65 + p_size % 26)", "chr(CAST(65 + p_size % 26 AS INT))"),
    ("q", "split(p_brand, '#')[1]", "split_part(p_brand, '#', 2)"), ("r", "left(p_brand, 3) || right(p_brand, 2)", ""), ("s", "levenshtein(p_type, 'SMALL')", "CAST(levenshtein(p_type, 'SMALL') AS INT)"), ("t", "p_brand LIKE 'Brand#1%'", ""),
    ("u", "startswith(p_type, 'S')", "starts_with(p_type, 'S')"), ("v", "contains(p_type, 'A')", ""), ("w", "md5(p_brand)", ""), ("x", "sha2(p_brand, 256)", "sha256(p_brand)"), ("y", "base64(CAST(p_brand AS BINARY))", "base64(CAST(p_brand AS BLOB))"),
    ("z", "split_part(p_brand, '#', -1)", ""), ("aa", "soundex('Robert')", "'R163'"), ("ab", "substring_index('a.b.c', '.', 2)", "'a.b'"), ("ac", "overlay('abcdef' PLACING 'ZZ' FROM 2)", "'aZZdef'"), ("ad", "format_number(1234567.891, 2)", "'1,234,567.89'"),
    ("ae", "locate('#', p_brand, 2)", "CAST(instr(p_brand, '#') AS INT)"), ("af", "char_length(p_name) + octet_length(p_name) + bit_length('a')", "CAST(length(p_name) + strlen(p_name) + 8 AS INT)"), ("ag", "elt(2, 'a', 'b')", "'b'"), ("ah", "find_in_set('b', 'a,b')", "2"), ("ai", "space(3)", "'   '"), ("aj", "crc32('Spark')", "CAST(1557323817 AS BIGINT)"), ("ak", "decode(encode('é', 'utf-8'), 'utf-8')", "'é'"), ("al", "unhex('4D') = X'4D'", "true"))
pair("fn_regex", "part",
    ("k", "p_partkey", ""), ("a", "regexp_extract(p_brand, '([A-Za-z]+)#([0-9]+)', 2)", ""), ("b", "regexp_replace(p_name, '[aeiou]', '_')", "regexp_replace(p_name, '[aeiou]', '_', 'g')"), ("c", "p_brand RLIKE '#[12]$'", "regexp_matches(p_brand, '#[12]$')"),
    ("d", "size(regexp_extract_all(p_name, '[0-9]', 0))", "CAST(len(regexp_extract_all(p_name, '[0-9]', 0)) AS INT)"), ("e", "regexp_count(p_name, 'a')", "CAST(len(regexp_extract_all(p_name, 'a')) AS INT)"), ("f", "size(split(p_name, '[ _#]'))", "CAST(len(regexp_split_to_array(p_name, '[ _#]')) AS INT)"))
pair("fn_date", "orders",
    ("k", "o_orderkey", ""), ("a", "CAST(year(o_orderdate) * 10000 + month(o_orderdate) * 100 + day(o_orderdate) AS BIGINT)", ""), ("b", "CAST(quarter(o_orderdate) + weekofyear(o_orderdate) AS BIGINT)", ""), ("c", "dayofweek(o_orderdate)", "CAST(dayofweek(o_orderdate) + 1 AS INT)"),
    ("d", "dayofyear(o_orderdate)", "CAST(dayofyear(o_orderdate) AS INT)"), ("e", "CAST(date_add(o_orderdate, 30) AS STRING)", "CAST(CAST(o_orderdate AS DATE) + 30 AS VARCHAR)"), ("f", "datediff(o_orderdate, DATE '1995-01-01')", "CAST(datediff('day', DATE '1995-01-01', CAST(o_orderdate AS DATE)) AS INT)"),
    ("g", "CAST(last_day(o_orderdate) AS STRING)", "CAST(last_day(o_orderdate) AS VARCHAR)"), ("h", "CAST(trunc(o_orderdate, 'MM') AS STRING)", "CAST(CAST(date_trunc('month', o_orderdate) AS DATE) AS VARCHAR)"), ("i", "date_format(o_orderdate, 'yyyy/MM/dd')", "strftime(o_orderdate, '%Y/%m/%d')"),
    ("j", "unix_timestamp(o_orderdate)", "CAST(epoch(o_orderdate) AS BIGINT)"), ("l", "CAST(add_months(o_orderdate, 2) AS STRING)", "CAST(CAST(CAST(o_orderdate AS DATE) + INTERVAL 2 MONTH AS DATE) AS VARCHAR)"), ("m", "hour(o_orderdate) + minute(o_orderdate) + second(o_orderdate)", "CAST(hour(o_orderdate) + minute(o_orderdate) + second(o_orderdate) AS INT)"),
    ("n", "CAST(date_trunc('WEEK', o_orderdate) AS DATE) = trunc(o_orderdate, 'WEEK')", "true"), ("o", "CAST(to_date('2020-02-29', 'yyyy-MM-dd') AS STRING)", "'2020-02-29'"), ("p", "CAST(make_date(2020, 2, 3) AS STRING)", "'2020-02-03'"), ("q", "weekday(o_orderdate)", "CAST(isodow(o_orderdate) - 1 AS INT)"),
    ("r", "CAST(next_day(DATE '2024-01-03', 'MON') AS STRING)", "'2024-01-08'"), ("s", "round(months_between(TIMESTAMP '1997-02-28 10:30:00', TIMESTAMP '1996-10-30'), 8)", "3.94959677"), ("t", "CAST(from_unixtime(0) AS STRING)", "'1970-01-01 00:00:00'"), ("u", "extract(YEAR FROM o_orderdate)", "CAST(year(o_orderdate) AS INT)"))
pair("fn_array", "embeddings",
    ("k", "vec_id", ""), ("a", "size(embedding)", "CAST(len(embedding) AS INT)"), ("b", "round(element_at(embedding, 3), 5)", "round(embedding[3], 5)"), ("c", "round(array_max(embedding) - array_min(embedding), 5)", "round(list_max(embedding) - list_min(embedding), 5)"),
    ("d", "array_join(array_sort(array(label, 3, 1)), ',')", "array_to_string(list_sort([label, 3, 1]), ',')"), ("e", "array_contains(array(1, 2, label), 5)", "list_contains([1, 2, label], 5)"), ("f", "array_join(array_distinct(array(label, 1, label)), ',')", "CASE WHEN label = 1 THEN '1' ELSE label::VARCHAR || ',1' END"),
    ("g", "array_position(array(4, label, 9), 9)", "CAST(CASE WHEN label = 9 THEN 2 ELSE 3 END AS BIGINT)"), ("h", "array_join(slice(array(1, 2, 3, 4), 2, 2), '-')", "'2-3'"), ("i", "array_join(flatten(array(array(1), array(label))), ',')", "'1,' || label::VARCHAR"), ("j", "array_join(sequence(1, 5), '')", "'12345'"),
    ("l", "array_join(array_repeat(label, 2), ',')", "label::VARCHAR || ',' || label::VARCHAR"), ("m", "array_join(array_union(array(1, 2), array(2, 3)), ',')", "'1,2,3'"), ("n", "array_join(array_intersect(array(1, 2), array(2, 3)), ',')", "'2'"), ("o", "array_join(array_except(array(1, 2), array(2, 3)), ',')", "'1'"),
    ("p", "arrays_overlap(array(1, 2), array(label))", "label IN (1, 2)"), ("q", "array_join(reverse(array(1, 2, 3)), '')", "'321'"), ("r", "array_join(array_remove(array(1, 2, 1), 1), '')", "'2'"), ("s", "size(arrays_zip(array(1, 2), array(3)))", "2"), ("t", "cardinality(shuffle(array(1, 2, 3)))", "3"), ("u", "array_join(array_compact(array(1, NULL, 2)), '')", "'12'"))
pair("fn_lambda", "embeddings",
    ("k", "vec_id", ""), ("a", "round(aggregate(embedding, CAST(0 AS DOUBLE), (s, x) -> s + x * x), 3)", "round(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * x)), 3)"), ("b", "size(filter(embedding, x -> x > 0))", "CAST(len(list_filter(embedding, lambda x: x > 0)) AS INT)"),
    ("c", "round(transform(embedding, (x, i) -> CAST(x AS DOUBLE) * i)[3], 4)", "round(CAST(embedding[4] AS DOUBLE) * 3, 4)"), ("d", "exists(embedding, x -> x > 2)", "len(list_filter(embedding, lambda x: x > 2)) > 0"), ("e", "forall(embedding, x -> x < 9)", "len(list_filter(embedding, lambda x: x >= 9)) = 0"), ("f", "size(zip_with(array(1, 2), array(3, 4), (x, y) -> x + y))", "2"),
    ("g", "map_filter(map('a', 1, 'b', 2), (k, v) -> v > 1)['b']", "2"), ("h", "transform_values(map('a', 1), (k, v) -> v + 1)['a']", "2"), ("i", "transform_keys(map('a', 1), (k, v) -> upper(k))['A']", "1"), ("j", "map_zip_with(map('a', 1), map('a', 2), (k, x, y) -> x + y)['a']", "3"), ("l", "array_join(array_sort(array(3, 1, 2), (x, y) -> y - x), '')", "'321'"))
pair("fn_map_struct", "supplier",
    ("k", "s_suppkey", ""), ("a", "map('n', s_nationkey, 'x', 1)['n']", "s_nationkey"), ("b", "size(map_keys(map(s_name, 1, 'b', 2)))", "2"), ("c", "element_at(map_concat(map('a', 1), map('b', s_nationkey)), 'b')", "s_nationkey"), ("d", "named_struct('a', s_name, 'b', 2).a", "s_name"),
    ("e", "array_join(map_values(map('a', s_nationkey, 'b', 2)), ',')", "s_nationkey::VARCHAR || ',2'"), ("f", "map_from_arrays(array('x'), array(s_nationkey))['x']", "s_nationkey"), ("g", "str_to_map('a:1,b:2', ',', ':')['b']", "'2'"), ("h", "map_from_entries(array(struct('q', s_nationkey)))['q']", "s_nationkey"), ("i", "size(map_entries(map('a', 1)))", "1"), ("j", "map_contains_key(map('a', 1), 'a')", "true"), ("l", "struct(s_nationkey, s_name).s_nationkey", "s_nationkey"))
pair("fn_json", "events",
    ("k", "event_id", ""), ("c", "to_json(named_struct('a', user_id))", "'{\"a\":' || user_id::VARCHAR || '}'"), ("d", "from_json('{\"a\":1}', 'a INT').a", "1"), ("e", "schema_of_json('{\"a\":1}')", "'STRUCT<a: BIGINT>'"), ("f", "json_array_length('[1,2]')", "2"), ("g", "get_json_object('{\"a\":{\"b\":[5]}}', '$.a.b[0]')", "'5'"), ("h", "from_csv('1,x', 'a INT, b STRING').b", "'x'"), ("i", "to_csv(struct(1, 'x'))", "'1,x'"))
SET.sql("fn_json_tuple", "SELECT event_id, a, b FROM events LATERAL VIEW json_tuple('{\"a\":1,\"b\":\"z\"}', 'a', 'b') j AS a, b", "SELECT event_id, '1' AS a, 'z' AS b FROM events")
pair("fn_null", "orders",
    ("k", "o_orderkey", ""), ("a", "coalesce(nullif(o_orderstatus, 'F'), 'none')", ""), ("b", "nvl(nullif(o_orderstatus, 'O'), 'x')", "coalesce(nullif(o_orderstatus, 'O'), 'x')"), ("c", "nvl2(nullif(o_orderstatus, 'O'), 1, 2)", "CASE WHEN o_orderstatus <> 'O' THEN 1 ELSE 2 END"), ("d", "ifnull(nullif(1, 1), 5)", ""),
    ("e", "isnull(nullif(o_orderstatus, 'P'))", "nullif(o_orderstatus, 'P') IS NULL"), ("f", "isnotnull(o_orderstatus)", "o_orderstatus IS NOT NULL"), ("g", "if(o_totalprice > 1000, 1, 0)", "CASE WHEN o_totalprice > 1000 THEN 1 ELSE 0 END"), ("h", "nanvl(CAST('NaN' AS DOUBLE), 3.0)", "CAST(3.0 AS DOUBLE)"), ("i", "nullif(o_orderstatus, 'F') <=> NULL", "nullif(o_orderstatus, 'F') IS NOT DISTINCT FROM NULL"))
pair("fn_cast", "lineitem",
    ("k", "l_orderkey", ""), ("a", "CAST(l_quantity AS INT)", "CAST(trunc(l_quantity) AS INT)"), ("b", "CAST(l_linenumber AS STRING)", "CAST(l_linenumber AS VARCHAR)"), ("c", "CAST(l_quantity AS DECIMAL(10, 2))", ""), ("d", "TRY_CAST('x1' AS INT)", ""), ("e", "CAST('12' AS BIGINT) + 1", ""),
    ("f", "CAST(CAST(l_shipdate AS DATE) AS STRING)", "CAST(CAST(l_shipdate AS DATE) AS VARCHAR)"), ("g", "CAST('true' AS BOOLEAN)", ""), ("h", "CAST(l_linenumber AS DOUBLE) / 4", ""), ("i", "typeof(l_linenumber)", "'int'"))
pair("fn_decimal", "lineitem",
    ("k", "l_orderkey", ""), ("a", "CAST(CAST(l_quantity AS DECIMAL(10, 2)) * CAST(2.5 AS DECIMAL(3, 1)) AS DECIMAL(18, 3))", ""), ("b", "CAST(CAST(l_quantity AS DECIMAL(10, 2)) + CAST(1.25 AS DECIMAL(5, 2)) AS DECIMAL(12, 2))", ""))
pair("fn_hash_uuid", "region", ("k", "r_regionkey", ""), ("a", "length(uuid())", "36"), ("b", "sha1('a')", "'86f7e437faa5a7fce15d1ddcb9eaeaea377667b8'"), ("c", "hash(1) = hash(1)", "true"), ("d", "xxhash64('a') <> xxhash64('b')", "true"), ("e", "rand(1) < 1", "true"), ("f", "monotonically_increasing_id() >= 0", "true"))
pair("fn_xml_url", "region",
    ("k", "r_regionkey", ""), ("a", "xpath_string('<a><b>x</b></a>', 'a/b')", "'x'"), ("b", "xpath_int('<a><b>1</b><b>2</b></a>', 'sum(a/b)')", "3"), ("c", "size(xpath('<a><b>1</b><b>2</b></a>', 'a/b/text()'))", "2"), ("d", "parse_url('http://h.com/p?q=1', 'QUERY', 'q')", "'1'"), ("e", "xpath_boolean('<a><b>1</b></a>', 'a/b')", "true"), ("f", "xpath_double('<a>1.5</a>', 'a')", "CAST(1.5 AS DOUBLE)"), ("g", "url_encode('a b')", "'a+b'"))
SET.sql("fn_generators", "SELECT stack_k, stack_v FROM region LATERAL VIEW stack(2, 'a', 1, 'b', 2) t AS stack_k, stack_v UNION ALL SELECT c1, c2 FROM (SELECT inline(array(struct('i', 3))) AS (c1, c2))",
        "SELECT k AS stack_k, v AS stack_v FROM region, (VALUES ('a', 1), ('b', 2)) t(k, v) UNION ALL SELECT 'i', 3")
