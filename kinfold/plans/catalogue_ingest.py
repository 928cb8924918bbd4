"""Catalogue: loading, ids, enrichment, selectors and text analysis."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from kinfold.functions.dates import latest_date, legacy_date_iso, parse_flexible_date
from kinfold.functions.ids import document_id
from kinfold.functions.paths import read_path, read_values
from kinfold.functions.phonetic import encode_column
from kinfold.functions.text import ANALYZERS, NA_VALUES, na_to_null, normalize_join_key
from kinfold.operators.enrich import LookupPolicy, build_lookup, enrich, outcome_dates, without
from kinfold.operators.population import compile_selector, population, seeded_sample
from kinfold.plans._registry import query, table
from kinfold.sources.catalog import last_wins
from kinfold.sources.tables import snapshot_scan, window_since

_LINE_ORDER = ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
LINES = LookupPolicy("lines", "lineitem", "l_orderkey", ("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_shipdate"), _LINE_ORDER)
ORDERS = LookupPolicy("orders", "orders", "o_custkey", ("o_orderkey", "o_totalprice", "lines"), ("o_orderkey",))


def orders_with_lines(spark, sf, cap=5):
    lines = table(spark, sf, "lineitem").withColumn("l_shipdate", F.date_format("l_shipdate", "yyyy-MM-dd"))
    return enrich(table(spark, sf, "orders"), build_lookup(lines, LINES, cap), "o_orderkey", "lines")


_CAPPED = """
WITH ranked AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS n FROM lineitem),
     kept AS (SELECT * FROM ranked WHERE n <= {cap})
"""


@query(_CAPPED.format(cap=5) + """SELECT o_orderkey, count(l_orderkey) AS line_count, round(coalesce(sum(l_quantity), 0), 2) AS quantity, string_agg(l_partkey::VARCHAR, ',' ORDER BY n) AS parts
FROM orders LEFT JOIN kept ON o_orderkey = l_orderkey GROUP BY o_orderkey""")
def enrich_orders_with_lineitems(spark, sf):
    df = orders_with_lines(spark, sf)
    n = F.when(F.col("lines").isNull(), 0).otherwise(F.size("lines")).cast("long")
    qty = F.aggregate(F.coalesce(F.transform("lines", lambda x: x["l_quantity"]), F.array().cast("array<double>")), F.lit(0.0), lambda a, x: a + x)
    return df.select("o_orderkey", n.alias("line_count"), F.round(qty, 2).alias("quantity"), F.array_join(F.transform("lines", lambda x: x["l_partkey"].cast("string")), ",").alias("parts"))


@query(_CAPPED.format(cap=3) + """, o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS m FROM orders)
SELECT c_custkey, count(DISTINCT o_orderkey) AS order_count, count(l_partkey) AS part_count, coalesce(sum(l_partkey), 0)::BIGINT AS part_sum
FROM customer LEFT JOIN (SELECT * FROM o WHERE m <= 4) o ON o_custkey = c_custkey LEFT JOIN kept ON l_orderkey = o_orderkey GROUP BY c_custkey""")
def enrich_two_level(spark, sf):
    nested = enrich(table(spark, sf, "customer"), build_lookup(orders_with_lines(spark, sf, 3), ORDERS, 4), "c_custkey", "orders")
    parts = F.coalesce(read_path(nested, "orders.lines.l_partkey"), F.array().cast("array<bigint>"))
    count = F.when(F.col("orders").isNull(), 0).otherwise(F.size("orders"))
    return nested.select("c_custkey", count.cast("long").alias("order_count"), F.size(parts).cast("long").alias("part_count"), F.aggregate(parts, F.lit(0).cast("long"), lambda a, x: a + x).alias("part_sum"))


SELECTORS = {
    "returned": {"nested-exists": {"path": "lines", "require": "l_shipdate", "terms": {"l_returnflag": ["R"]}, "range": {"l_shipdate": {"gte": "1995-01-01"}}}},
    "finished": {"term": {"o_orderstatus": "F"}},
    "flagged": {"term": {"lines.l_returnflag": "A"}},
    "both": {"all": ["returned", "finished"]},
    "either": {"any": ["returned", "finished"]},
}
_RETURNED = "EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R' AND l_shipdate >= DATE '1995-01-01')"


def _all_lines(spark, sf):
    return orders_with_lines(spark, sf, 1 << 30)


@query(f"SELECT o_orderkey FROM orders WHERE {_RETURNED}")
def nested_exists_selector(spark, sf):
    df = _all_lines(spark, sf)
    return df.where(compile_selector(df, SELECTORS, "returned")).select("o_orderkey")


@query(f"SELECT o_orderkey, {_RETURNED} AND coalesce(o_orderstatus = 'F', false) AS in_both, {_RETURNED} OR coalesce(o_orderstatus = 'F', false) AS in_either FROM orders")
def selector_all_any(spark, sf):
    df = _all_lines(spark, sf)
    return df.select("o_orderkey", compile_selector(df, SELECTORS, "both").alias("in_both"), compile_selector(df, SELECTORS, "either").alias("in_either"))


@query("SELECT o_orderkey FROM orders WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'A')")
def object_term_selector(spark, sf):
    df = _all_lines(spark, sf)
    return df.where(compile_selector(df, SELECTORS, "flagged")).select("o_orderkey")


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F' ORDER BY o_orderkey LIMIT 500")
def population_snapshot(spark, sf):
    spec = {"mode": "lifecycle", "selector": "finished", "selectors": SELECTORS, "sort_field": "o_orderkey", "max_records": 500}
    return population(table(spark, sf, "orders"), spec).select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey, p_name FROM part ORDER BY p_partkey LIMIT 100")
def selector_snapshot_scan(spark, sf):
    return snapshot_scan(table(spark, sf, "part"), "p_partkey", 100).select("p_partkey", "p_name")


@query("SELECT o_orderkey FROM (SELECT * FROM orders WHERE o_orderpriority IS NOT NULL) ORDER BY md5('7' || o_orderkey), o_orderkey LIMIT 200")
def seeded_random_sample(spark, sf):
    return seeded_sample(table(spark, sf, "orders"), ["o_orderpriority"], "o_orderkey", 200, 7).select("o_orderkey")


@query("SELECT l_orderkey, strftime(max(l_shipdate), '%Y-%m-%d') AS latest FROM lineitem GROUP BY l_orderkey")
def latest_ship_date(spark, sf):
    df = _all_lines(spark, sf).where("lines is not null")
    return df.select(F.col("o_orderkey").alias("l_orderkey"), F.date_format(latest_date(read_path(df, "lines.l_shipdate"), True), "yyyy-MM-dd").alias("latest"))


_KEY = "CASE o_orderkey % 6 WHEN 0 THEN lpad(o_orderkey::VARCHAR, 9, '0') WHEN 1 THEN o_orderkey::VARCHAR || '.0' WHEN 2 THEN 'X' || o_orderkey WHEN 3 THEN ' ' || o_orderkey WHEN 4 THEN NULL ELSE '' END"


@query(f"SELECT o_orderkey, CASE WHEN regexp_full_match(string_split(raw, '.')[1], '[+-]?\\d+') THEN try_cast(string_split(raw, '.')[1] AS BIGINT)::VARCHAR ELSE raw END AS join_key FROM (SELECT o_orderkey, {_KEY} AS raw FROM orders)")
def normalize_join_keys(spark, sf):
    k = F.col("o_orderkey")
    t = k.cast("string")
    raw = F.when(k % 6 == 0, F.lpad(t, 9, "0")).when(k % 6 == 1, F.concat(t, F.lit(".0"))).when(k % 6 == 2, F.concat(F.lit("X"), t)).when(k % 6 == 3, F.concat(F.lit(" "), t)).when(k % 6 == 4, F.lit(None)).otherwise("")
    return table(spark, sf, "orders").select("o_orderkey", normalize_join_key(raw).alias("join_key"))


_RAW_DATE = "CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN upper(strftime(o_orderdate, '%d-%b-%y')) WHEN 2 THEN strftime(o_orderdate, ' %d-%b-%Y ') WHEN 3 THEN '31-FEB-21' WHEN 4 THEN '9999-99-99' WHEN 5 THEN ' ' ELSE '01-JUN-74' END"


def _raw_dates(spark, sf):
    k, d = F.col("o_orderkey") % 7, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.upper(F.date_format(d, "dd-MMM-yy"))).when(k == 2, F.date_format(d, "' 'dd-MMM-yyyy' '")).when(k == 3, "31-FEB-21").when(k == 4, "9999-99-99").when(k == 5, " ").otherwise("01-JUN-74")
    return table(spark, sf, "orders").select("o_orderkey", raw.alias("raw"))


_ISO = "CASE o_orderkey % 7 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 2 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 6 THEN '1974-06-01' ELSE NULL END"


@query(f"SELECT o_orderkey, {_ISO} AS iso FROM orders")
def legacy_dates(spark, sf):
    return _raw_dates(spark, sf).select("o_orderkey", legacy_date_iso(F.col("raw")).alias("iso"))


@query(f"SELECT o_orderkey, ({_ISO})::DATE AS parsed FROM orders")
def flexible_dates(spark, sf):
    return _raw_dates(spark, sf).select("o_orderkey", parse_flexible_date(F.col("raw")).alias("parsed"))


@query("SELECT l_orderkey || '|' || l_linenumber || '|' || CASE WHEN l_returnflag = 'N' THEN '' ELSE l_returnflag END AS _id, count(*) AS n FROM lineitem GROUP BY 1")
def composite_id(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("flag"))
    return df.select(document_id(df, ["l_orderkey", "l_linenumber", "flag"]).alias("_id")).groupBy("_id").agg(F.count("*").alias("n"))


@query("""SELECT CASE WHEN k IS NULL THEN 'blank-key:' || sha256('{"c_custkey":' || c_custkey || ',"k":null}') ELSE k END AS _id, c_custkey
FROM (SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN NULL ELSE lpad(c_custkey::VARCHAR, 8, '0') END AS k FROM customer)""")
def blank_key_id(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select(F.when(k % 3 != 0, F.lpad(k.cast("string"), 8, "0")).alias("k"), "c_custkey")
    return df.select(document_id(df, "k").alias("_id"), "c_custkey")


@query("""SELECT l_orderkey || '|' || l_linenumber AS _id, l_partkey, l_suppkey FROM
(SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber ORDER BY l_partkey DESC, l_suppkey DESC, l_quantity DESC) AS n FROM lineitem) WHERE n = 1""")
def upsert_last_wins(spark, sf):
    df = table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")
    loaded = df.select(document_id(df, ["l_orderkey", "l_linenumber"]).alias("_id"), "l_partkey", "l_suppkey", F.struct("l_partkey", "l_suppkey", "l_quantity").alias("_rowno"))
    return last_wins(loaded).select("_id", "l_partkey", "l_suppkey")


_NA_LIST = ", ".join(f"'{v}'" for v in NA_VALUES)


@query(f"SELECT c_custkey, CASE WHEN v IN ({_NA_LIST}) THEN NULL ELSE v END AS v FROM (SELECT c_custkey, [{_NA_LIST}, 'na', 'none', 'UNKNOWN', ' '][1 + c_custkey % {len(NA_VALUES) + 4}] AS v FROM customer)")
def na_values_to_null(spark, sf):
    words = F.array(*[F.lit(v) for v in [*NA_VALUES, "na", "none", "UNKNOWN", " "]])
    value = F.element_at(words, (1 + F.col("c_custkey") % (len(NA_VALUES) + 4)).cast("int"))
    return table(spark, sf, "customer").select("c_custkey", na_to_null(value).alias("v"))


@query("SELECT event_id, event_type FROM events WHERE strftime(ts, '%Y%m%d') > '20240115'")
def source_window(spark, sf):
    df = table(spark, sf, "events").withColumn("day", F.date_format("ts", "yyyyMMdd"))
    return window_since(df, "day", "20240115").select("event_id", "event_type")


@query("SELECT user_id, count(DISTINCT ts::DATE) FILTER (WHERE event_type = 'error') AS error_days FROM events GROUP BY user_id")
def outcome_join(spark, sf):
    ev = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    joined = outcome_dates(ev.select("user_id").distinct(), ev.where("event_type = 'error'"), "user_id", "day", "days")
    return joined.select("user_id", F.size("days").cast("long").alias("error_days"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderdate >= DATE '1995-03-01' AND o_orderdate < DATE '1995-04-01')")
def anti_join_population(spark, sf):
    month = table(spark, sf, "orders").where("o_orderdate >= timestamp_ntz'1995-03-01 00:00:00' and o_orderdate < timestamp_ntz'1995-04-01 00:00:00'")
    return without(table(spark, sf, "customer").select("c_custkey"), month.select(F.col("o_custkey").alias("c_custkey")), "c_custkey")


@query(f"""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(list_filter(string_split(lower(p_name || ' ' || CASE p_partkey % 3 WHEN 0 THEN 'ST' WHEN 1 THEN 'Ave' ELSE 'NW' END || ' UNIT 7'), ' '), lambda w: w <> 'unit'),
 lambda w: CASE w WHEN 'st' THEN 'street' WHEN 'ave' THEN 'avenue' WHEN 'nw' THEN 'northwest' ELSE w END))), ' ') AS tokens FROM part""")
def street_tokens(spark, sf):
    k = F.col("p_partkey") % 3
    street = F.concat("p_name", F.lit(" "), F.when(k == 0, "ST").when(k == 1, "Ave").otherwise("NW"), F.lit(" UNIT 7"))
    return table(spark, sf, "part").select("p_partkey", F.array_join(F.array_sort(ANALYZERS["street_tokens"].token_set(street)), " ").alias("tokens"))


# A mark joins what stands between two letters (or digits) inside a word; every second such place needs a second pass.
_BETWEEN = "regexp_replace({0}, '([\\p{{L}}])[.'':]([\\p{{L}}])', '\\1\x01\\2', 'g')"
_CURLED = "regexp_replace({0}, '([\\p{{L}}])’([\\p{{L}}])', '\\1\x02\\2', 'g')"
_DIGITS = "regexp_replace({0}, '([\\p{{N}}])[.,;'']([\\p{{N}}])', '\\1\x01\\2', 'g')"
_MARKED = "lower(strip_accents(replace(replace(replace(replace(replace(replace(text, 'ß', 'ss'), 'æ', 'ae'), 'Æ', 'ae'), 'œ', 'oe'), 'ø', 'o'), 'Ø', 'o')))"
for _step in (_BETWEEN, _CURLED, _DIGITS) * 2:
    _MARKED = _step.format(_MARKED)


@query(f"""SELECT doc_id, coalesce(array_to_string(list_sort(list_distinct(list_filter(list_transform(regexp_extract_all({_MARKED}, '[\\p{{L}}\\p{{M}}\\p{{N}}_\x01\x02]+'),
 lambda w: replace(replace(replace(w, '\x01', ' '), '_', ' '), '\x02', '’')), lambda w: trim(w) <> ''))), ' '), '') AS tokens FROM documents""")
def name_clean_tokens(spark, sf):
    return table(spark, sf, "documents").select("doc_id", F.array_join(F.array_sort(ANALYZERS["name_clean"].token_set(F.col("text"))), " ").alias("tokens"))


@query("SELECT c_mktsegment AS segment, count(DISTINCT l_partkey) AS parts FROM customer JOIN orders ON o_custkey = c_custkey JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1")
def nested_path_values(spark, sf):
    lines = build_lookup(table(spark, sf, "lineitem"), LookupPolicy("l", "lineitem", "l_orderkey", ("l_partkey",), _LINE_ORDER), 1 << 30)
    orders = enrich(table(spark, sf, "orders"), lines, "o_orderkey", "lines")
    nested = enrich(table(spark, sf, "customer"), build_lookup(orders, ORDERS, 1 << 30), "c_custkey", "orders")
    return nested.select("c_mktsegment", F.explode(read_values(nested, "orders.lines.l_partkey")).alias("p")).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count_distinct("p").alias("parts"))


@query()
def double_metaphone_tokens(spark, sf):
    words = table(spark, sf, "part").select(F.array_distinct(F.split("p_name", " ")).alias("tokens")).distinct()
    coded = encode_column(words.withColumn("token", F.explode("tokens")).select("token", F.array("token").alias("code")).distinct(), "code", "double_metaphone")
    return coded.select("token", F.explode("code").alias("code")).distinct()


@query("SELECT l_orderkey, l_partkey FROM (SELECT l_orderkey, l_partkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_extendedprice DESC, l_partkey) AS n FROM lineitem) WHERE n <= 2")
def top_per_key(spark, sf):
    w = Window.partitionBy("l_orderkey").orderBy(F.desc("l_extendedprice"), "l_partkey")
    return table(spark, sf, "lineitem").withColumn("n", F.row_number().over(w)).where("n <= 2").select("l_orderkey", "l_partkey")
