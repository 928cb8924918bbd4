"""Catalogue: metrics, comparisons, validation statistics, samples and profiles."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.setsim import blended_overlap
from kinfold.functions.ids import blank_key_count, document_id
from kinfold.functions.text import ANALYZERS, HOSPITAL_STOP
from kinfold.operators import metrics, profile, stats
from kinfold.operators.enrich import LookupPolicy, attributes_by_key, lookup_counts
from kinfold.plans._registry import query, table
from kinfold.plans.catalogue_matching import _BLEND, _FIRMS, _LIFECYCLE_SQL, _PAIRS_SQL, PARTS_CONFIG, _evidence_pairs, _firms, lifecycle_pairs, part_pairs, parts
from kinfold.plans.sweep import Provenance, sweep

METRICS = [
    {"name": "pairs"},
    {"name": "pairs_ge_080", "filter": {"score_gte": 0.8}},
    {"name": "weak", "filter": {"score_lt": 0.6}},
    {"name": "same_name", "filter": {"fields_equal": "p_name"}},
    {"name": "same_name_share", "ratio": {"numerator": "same_name", "denominator": "pairs"}},
    {"name": "typed", "filter": {"has_signal_type": ["rarity-weighted-value"]}},
    {"name": "code_only", "filter": {"matched_on_equals": ["exact-identifier"]}},
    {"name": "code_only_identity", "filter": {"matched_identity_equals": ["exact-identifier"]}},
    {"name": "three_signals", "filter": {"signal_count_gte": 3}},
    {"name": "gapless", "filter": {"not": {"gap_between": [-180, 365]}}},
    {"name": "strong_or_typed", "filter": {"any": [{"score_gte": 0.9}, {"all": [{"has_signal_type": ["rarity-weighted-value"]}, {"not": {"score_lt": 0.7}}]}]}},
    {"name": "early", "filter": {"gap_lte": 0}},
    {"name": "late", "filter": {"gap_gte": 1}},
    {"name": "left_with_pairs", "distinct": "left.entity_key"},
]
_METRIC_LIST = """count(*) AS pairs, count(*) FILTER (WHERE total_score >= 0.8) AS pairs_ge_080, count(*) FILTER (WHERE total_score < 0.6) AS weak, count(*) FILTER (WHERE ln = rn) AS same_name,
 CASE WHEN count(*) = 0 THEN 0.0 ELSE (count(*) FILTER (WHERE ln = rn))::DOUBLE / count(*) END AS same_name_share, count(*) FILTER (WHERE rarity > 0) AS typed,
 count(*) FILTER (WHERE matched_on = 'exact-identifier') AS code_only, count(*) FILTER (WHERE name = 0) AS code_only_identity, count(*) AS three_signals, count(*) AS gapless,
 count(*) FILTER (WHERE total_score >= 0.9 OR (rarity > 0 AND total_score >= 0.7)) AS strong_or_typed, 0::BIGINT AS early, 0::BIGINT AS late, count(DISTINCT l) AS left_with_pairs"""


@query(_PAIRS_SQL + f"SELECT {_METRIC_LIST} FROM pairs")
def metrics_record(spark, sf):
    return metrics.run_metrics(part_pairs(spark, sf), METRICS)


_COMPARED = ["pairs", "pairs_ge_080", "same_name", "left_with_pairs"]
EXPECTED = {"pairs": "within_10pct", "pairs_ge_080": "must_not_fall", "same_name": "must_not_rise", "left_with_pairs": "informational"}


@query(_PAIRS_SQL + """, m AS (SELECT k, count(*) FILTER (WHERE t) AS pairs, count(*) FILTER (WHERE t AND total_score >= 0.8) AS pairs_ge_080, count(*) FILTER (WHERE t AND ln = rn) AS same_name, count(DISTINCT l) FILTER (WHERE t) AS left_with_pairs
 FROM (SELECT *, k = 0 OR total_score >= 0.7 AS t FROM pairs CROSS JOIN (VALUES (0), (1)) v(k)) GROUP BY k),
 long AS (SELECT k, unnest(['pairs', 'pairs_ge_080', 'same_name', 'left_with_pairs']) AS metric, unnest([pairs, pairs_ge_080, same_name, left_with_pairs])::DOUBLE AS value FROM m)
SELECT a.metric, a.value AS baseline, b.value AS candidate, b.value - a.value AS delta, CASE a.metric WHEN 'pairs' THEN 'within_10pct' WHEN 'pairs_ge_080' THEN 'must_not_fall' WHEN 'same_name' THEN 'must_not_rise' ELSE 'informational' END AS expectation,
 CASE a.metric WHEN 'pairs' THEN a.value <> 0 AND b.value < a.value * 0.9 WHEN 'pairs_ge_080' THEN b.value < a.value WHEN 'same_name' THEN b.value > a.value ELSE false END AS regressed
FROM long a JOIN long b ON a.metric = b.metric AND a.k = 0 AND b.k = 1""")
def sweep_compare(spark, sf):
    runs = F.filter(F.array(F.lit("baseline"), F.when(F.col("total_score") >= 0.7, "candidate")), lambda x: x.isNotNull())
    pairs = part_pairs(spark, sf).withColumn("run", F.explode(runs))
    records = metrics.records_by(pairs, [m for m in METRICS if m["name"] in _COMPARED], "run")
    return metrics.compare_records(records["baseline"], records["candidate"], EXPECTED)


@query(_PAIRS_SQL + "SELECT l || '|' || r AS _id, 'baseline_only' AS side FROM pairs WHERE total_score < 0.7 UNION ALL SELECT l || '|' || r, 'candidate_only' FROM pairs WHERE total_score > 0.95")
def pair_id_diff(spark, sf):
    pairs = part_pairs(spark, sf)
    return metrics.id_difference(pairs.where("total_score <= 0.95"), pairs.where("total_score >= 0.7"), "_id")


_BAND = "CASE WHEN {c} >= 0.35 AND {c} < 0.5 THEN '0.35-0.50' WHEN {c} >= 0.5 AND {c} < 0.6 THEN '0.50-0.60' WHEN {c} >= 0.6 AND {c} < 0.7 THEN '0.60-0.70' WHEN {c} >= 0.7 AND {c} < 0.8 THEN '0.70-0.80' WHEN {c} >= 0.8 AND {c} < 0.9 THEN '0.80-0.90' WHEN {c} >= 0.9 AND {c} <= 1.0 THEN '0.90-1.00' END"


@query(_PAIRS_SQL + f", b AS (SELECT {_BAND.format(c='total_score')} AS band, ln = rn AS same FROM pairs) SELECT v.band, count(b.band) AS total, count(*) FILTER (WHERE same) AS hits, CASE WHEN count(b.band) = 0 THEN NULL ELSE (count(*) FILTER (WHERE same))::DOUBLE / count(b.band) END AS rate FROM (VALUES ('0.35-0.50'), ('0.50-0.60'), ('0.60-0.70'), ('0.70-0.80'), ('0.80-0.90'), ('0.90-1.00')) v(band) LEFT JOIN b ON b.band = v.band GROUP BY v.band")
def score_band_counts(spark, sf):
    rows = part_pairs(spark, sf).select(stats.score_band(F.col("total_score")).alias("band"), (F.col("left.p_name") == F.col("right.p_name")).alias("same"))
    return stats.band_stats(rows, "band", stats.score_band_names(), "same")


_GAPS = "CASE WHEN gap IS NULL THEN NULL WHEN gap < -180 THEN '180d+ before' WHEN gap < 0 THEN '0-180d before' WHEN gap < 366 THEN 'under 1y after' ELSE '1y+ after' END"


@query(_LIFECYCLE_SQL + f"SELECT {_BAND.format(c='total_score')} AS band, {_GAPS} AS gap_band, count(*) AS pairs FROM pairs GROUP BY 1, 2")
def score_gap_matrix(spark, sf):
    return lifecycle_pairs(spark, sf).groupBy(stats.score_band(F.col("total_score")).alias("band"), stats.gap_band(F.col("gap_days")).alias("gap_band")).agg(F.count("*").alias("pairs"))


@query(_LIFECYCLE_SQL + "SELECT gap >= 0 AS after, count(*) AS pairs, round(avg(total_score), 6) AS mean_score FROM pairs GROUP BY 1")
def score_separation(spark, sf):
    return lifecycle_pairs(spark, sf).groupBy((F.col("gap_days") >= 0).alias("after")).agg(F.count("*").alias("pairs"), F.round(F.avg("total_score"), 6).alias("mean_score"))


@query(_PAIRS_SQL + f", b AS (SELECT {_BAND.format(c='total_score')} AS band FROM pairs), v AS (SELECT unnest(['0.35-0.50', '0.50-0.60', '0.60-0.70', '0.70-0.80', '0.80-0.90', '0.90-1.00']) AS band) SELECT v.band, count(b.band) AS total, least(count(b.band), 25) AS sampled FROM v LEFT JOIN b ON b.band = v.band GROUP BY v.band")
def sample_band_counts(spark, sf):
    pairs = part_pairs(spark, sf).withColumn("band", stats.score_band(F.col("total_score")))
    return stats.band_counts(pairs, stats.review_sample(pairs, "band", "_id", 25, 7), "band", stats.score_band_names())


GAP_METRICS = [
    {"name": "pairs"},
    {"name": "early", "filter": {"gap_lte": 0}},
    {"name": "late", "filter": {"gap_gte": 100}},
    {"name": "near", "filter": {"gap_between": [-30, 90]}},
    {"name": "far_and_strong", "filter": {"all": [{"not": {"gap_between": [-30, 90]}}, {"score_gte": 0.7}]}},
    {"name": "late_share", "ratio": {"numerator": "late", "denominator": "pairs"}},
    {"name": "predecessors", "distinct": "predecessor.entity_key"},
]


@query(_LIFECYCLE_SQL + """SELECT count(*) AS pairs, count(*) FILTER (WHERE gap <= 0) AS early, count(*) FILTER (WHERE gap >= 100) AS late, count(*) FILTER (WHERE gap BETWEEN -30 AND 90) AS near,
 count(*) FILTER (WHERE gap NOT BETWEEN -30 AND 90 AND total_score >= 0.7) AS far_and_strong, count(*) FILTER (WHERE gap >= 100) / count(*) AS late_share, count(DISTINCT l) AS predecessors FROM pairs""")
def gap_metrics_record(spark, sf):
    return metrics.run_metrics(lifecycle_pairs(spark, sf), GAP_METRICS)


@query(_PAIRS_SQL + "SELECT r AS entity_key, max(total_score) AS best_score FROM pairs GROUP BY r")
def best_score_per_entity(spark, sf):
    return part_pairs(spark, sf).groupBy(F.col("right.entity_key").alias("entity_key")).agg(F.max("total_score").alias("best_score"))


@query(_PAIRS_SQL + "SELECT l || '|' || r AS _id, total_score FROM pairs WHERE total_score >= 0.7 AND list_has_any(string_split(matched_on, ','), ['rarity-weighted-value']) ORDER BY total_score DESC, l || '|' || r LIMIT 50")
def analyst_top_pairs(spark, sf):
    df = part_pairs(spark, sf)
    return df.where(metrics.compile_predicate(df, {"all": [{"score_gte": 0.7}, {"has_signal_type": ["rarity-weighted-value"]}]})).orderBy(F.desc("total_score"), "_id").limit(50).select("_id", "total_score")


# Customers as a population: cohort by the year of the first order, "fleet" by number of orders, outcome by a late order.
_POP = """
WITH pop AS (SELECT c_custkey, c_nationkey AS state, min(o_orderdate) AS add_ts, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE count(*) END AS units, c_custkey % 4 = 0 AS flagged,
                    max(o_orderdate) > min(o_orderdate) + INTERVAL 1500 DAY AS hit FROM customer JOIN orders ON o_custkey = c_custkey GROUP BY 1, 2),
     st AS (SELECT *, year(add_ts)::INT AS cohort, CASE WHEN units IS NULL THEN 'unknown' WHEN units = 1 THEN '1' WHEN units BETWEEN 2 AND 5 THEN '2-5' WHEN units BETWEEN 6 AND 20 THEN '6-20' WHEN units BETWEEN 21 AND 100 THEN '21-100' WHEN units > 100 THEN '100+' END AS fleet FROM pop),
     all_ AS (SELECT cohort, fleet, state, count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM st GROUP BY 1, 2, 3),
     fl AS (SELECT cohort, fleet, state, count(*) FILTER (WHERE hit) AS hits, count(*) AS total FROM st WHERE flagged GROUP BY 1, 2, 3)
"""
_STRATA = ["cohort", "fleet", "state"]


def _population(spark, sf):
    orders = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.min("o_orderdate").alias("first"), F.max("o_orderdate").alias("last"), F.count("*").alias("n"))
    df = table(spark, sf, "customer").join(orders, "c_custkey")
    return df.select(
        "c_custkey", F.col("c_nationkey").alias("state"), F.year("first").alias("cohort"), stats.fleet_band(F.when(F.col("c_custkey") % 9 != 0, F.col("n"))).alias("fleet"), (F.col("c_custkey") % 4 == 0).alias("flagged"),
        (F.date_diff("last", "first") >= 1500).alias("_d"), (F.col("last") > F.col("first") + F.expr("INTERVAL 1500 DAY")).alias("hit"), F.date_format("first", "yyyyMMdd").cast("int").alias("add"),
    ).drop("_d")


@query(_POP + "SELECT cohort, fleet, state, hits, total FROM all_")
def stratum_counts(spark, sf):
    return stats.stratum_counts(_population(spark, sf), _STRATA, F.col("hit"))


@query(_POP + "SELECT a.cohort, a.fleet, a.state, a.hits - coalesce(f.hits, 0) AS hits, a.total - coalesce(f.total, 0) AS total, a.hits < coalesce(f.hits, 0) OR a.total < coalesce(f.total, 0) AS negative FROM all_ a LEFT JOIN fl f ON a.cohort IS NOT DISTINCT FROM f.cohort AND a.fleet IS NOT DISTINCT FROM f.fleet AND a.state IS NOT DISTINCT FROM f.state")
def unflagged_by_subtraction(spark, sf):
    pop = _population(spark, sf)
    return stats.subtract_strata(stats.stratum_counts(pop, _STRATA, F.col("hit")), stats.stratum_counts(pop.where("flagged"), _STRATA, F.col("hit")), _STRATA)


@query(_POP + """, j AS (SELECT f.hits, f.total, a.hits - f.hits AS h, a.total - f.total AS t FROM fl f JOIN all_ a ON a.cohort IS NOT DISTINCT FROM f.cohort AND a.fleet IS NOT DISTINCT FROM f.fleet AND a.state IS NOT DISTINCT FROM f.state),
 r AS (SELECT sum(CASE WHEN t > 0 THEN total * (h / t) END) / sum(CASE WHEN t > 0 THEN total END) AS s, count(*) FILTER (WHERE t = 0) AS k, coalesce(sum(total) FILTER (WHERE t = 0), 0)::BIGINT AS n, sum(hits) / sum(total) AS f FROM j)
SELECT round(s, 6) AS standardised_rate, k AS skipped_strata, n AS skipped_rows, round(f, 6) AS flagged_rate, round(f / s, 6) AS lift FROM r""")
def direct_standardization(spark, sf):
    pop = _population(spark, sf)
    flagged = stats.stratum_counts(pop.where("flagged"), _STRATA, F.col("hit"))
    control = stats.subtract_strata(stats.stratum_counts(pop, _STRATA, F.col("hit")), flagged, _STRATA)
    out = stats.standardised_rate(flagged, control, _STRATA)
    return out.select(*[F.round(c, 6).alias(c) if c in ("standardised_rate", "flagged_rate", "lift") else F.col(c) for c in out.columns])


_CELLS = "VALUES ('under-1y'), ('1-3y'), ('3y-plus')"
_MONTHS = "date_diff('day', add_ts::DATE, DATE '1998-09-01') / 30.4375"
_RECENT = f"CASE WHEN {_MONTHS} < 12 THEN 'under-1y' WHEN {_MONTHS} < 36 THEN '1-3y' ELSE '3y-plus' END"


@query(_POP + f", x AS (SELECT {_RECENT} AS cohort, fleet, hit FROM st) SELECT c.cohort, f.fleet, count(x.fleet) AS total, count(*) FILTER (WHERE hit) AS hits, CASE WHEN count(x.fleet) = 0 THEN NULL ELSE round((count(*) FILTER (WHERE hit))::DOUBLE / count(x.fleet), 6) END AS rate FROM ({_CELLS}) c(cohort) CROSS JOIN (VALUES ('1'), ('2-5'), ('6-20'), ('21-100'), ('100+'), ('unknown')) f(fleet) LEFT JOIN x ON x.cohort = c.cohort AND x.fleet = f.fleet GROUP BY 1, 2")
def recency_table(spark, sf):
    months = stats.months_between(F.col("add"), F.lit(19980901))
    rows = _population(spark, sf).drop("cohort").withColumn("cohort", stats.recency_cohort(months))
    out = stats.cross_stats(rows, "cohort", [n for _, n in stats.RECENCY], "fleet", [*(n for *_, n in stats.FLEET_BANDS), "unknown"], "hit")
    return out.withColumn("rate", F.round("rate", 6))


@query(_POP + """, e AS (SELECT fleet, hit, greatest(date_diff('day', greatest(add_ts::DATE, DATE '1995-01-01'), DATE '1998-09-01') / 30.4375, 0.0) AS months FROM st WHERE add_ts < TIMESTAMP '1995-01-01')
SELECT fleet, count(*) AS total, count(*) FILTER (WHERE hit) AS hits, round((count(*) FILTER (WHERE hit))::DOUBLE / count(*), 6) AS rate, round(sum(months), 4) AS months, round((count(*) FILTER (WHERE hit)) * 1000.0 / sum(months), 6) AS per_1000_months FROM e WHERE fleet IN ('2-5', '6-20', '21-100', 'unknown') GROUP BY fleet
UNION ALL SELECT f, 0, 0, NULL, 0.0, NULL FROM (VALUES ('2-5'), ('6-20'), ('21-100'), ('unknown')) v(f) WHERE f NOT IN (SELECT fleet FROM e WHERE fleet IS NOT NULL)""")
def exposure_rate(spark, sf):
    rows = stats.exposed_rows(_population(spark, sf), "add", F.lit(19950101), F.lit(19980901)).where("restricted")
    out = stats.band_stats(rows, "fleet", ["2-5", "6-20", "21-100", "unknown"], "hit", "exposure")
    return out.select("fleet", "total", "hits", F.round("rate", 6).alias("rate"), F.round("months", 4).alias("months"), F.round("per_1000_months", 6).alias("per_1000_months"))


@query("SELECT user_id, max(ts::DATE) FILTER (WHERE event_type = 'error') > min(ts::DATE) FILTER (WHERE event_type = 'signup') IS TRUE AS happened FROM events GROUP BY user_id")
def outcome_after_start(spark, sf):
    ev = table(spark, sf, "events").withColumn("d", F.to_date("ts"))
    users = ev.groupBy("user_id").agg(F.collect_set(F.when(F.col("event_type") == "error", F.col("d"))).alias("dates"), F.min(F.when(F.col("event_type") == "signup", F.col("d"))).alias("start"))
    return users.select("user_id", stats.happened_after(F.col("dates"), F.col("start")).alias("happened"))


@query(_PAIRS_SQL + f", b AS (SELECT l || '|' || r AS _id, {_BAND.format(c='total_score')} AS band FROM pairs), n AS (SELECT *, row_number() OVER (PARTITION BY band ORDER BY md5('42:' || _id), _id) AS n FROM b WHERE band IS NOT NULL) SELECT _id, band, NULL::VARCHAR AS verdict FROM n WHERE n <= 20")
def stratified_sample(spark, sf):
    rows = part_pairs(spark, sf).select("_id", stats.score_band(F.col("total_score")).alias("band"))
    return stats.review_sample(rows, "band", "_id", 20, 42)


@query("WITH k AS (SELECT c_custkey, row_number() OVER (ORDER BY md5(c_custkey::VARCHAR), c_custkey) AS n FROM customer), v AS (SELECT c_acctbal, row_number() OVER (ORDER BY md5('42:' || c_custkey), c_custkey) AS n FROM customer) SELECT c_custkey, c_acctbal FROM k JOIN v USING (n)")
def placebo_permutation(spark, sf):
    return stats.placebo(table(spark, sf, "customer").select("c_custkey", "c_acctbal"), "c_custkey", "c_acctbal", 42)


def _raw_customers(spark, sf):
    k = F.col("c_custkey")
    return table(spark, sf, "customer").select(
        F.lpad(k.cast("string"), 6, "0").alias("padded"), k.cast("string").alias("plain"), F.when(k % 3 == 0, F.concat(F.lit("S"), k.cast("string"))).otherwise(k.cast("string")).alias("mixed"),
        F.when(k % 2 == 0, "01-JUN-74").otherwise("1/2/1999").alias("dated"), F.when(k % 4 == 0, F.lit("x")).when(k % 4 == 1, " ").alias("sparse"), F.when(k % 5 == 0, "true").otherwise("false").alias("flag"), (k / 4).cast("decimal(12,2)").cast("string").alias("amount"), "c_mktsegment",
    )


_CELLS_SQL = """
WITH raw AS (SELECT lpad(c_custkey::VARCHAR, 6, '0') AS padded, c_custkey::VARCHAR AS plain, CASE WHEN c_custkey % 3 = 0 THEN 'S' || c_custkey ELSE c_custkey::VARCHAR END AS mixed,
                    CASE WHEN c_custkey % 2 = 0 THEN '01-JUN-74' ELSE '1/2/1999' END AS dated, CASE c_custkey % 4 WHEN 0 THEN 'x' WHEN 1 THEN ' ' END AS sparse, CASE WHEN c_custkey % 5 = 0 THEN 'true' ELSE 'false' END AS flag,
                    (c_custkey / 4)::DECIMAL(12, 2)::VARCHAR AS amount, c_mktsegment FROM customer),
     cells AS (SELECT col AS "column", val AS value FROM (SELECT unnest(['padded', 'plain', 'mixed', 'dated', 'sparse', 'flag', 'amount', 'c_mktsegment']) AS col, unnest([padded, plain, mixed, dated, sparse, flag, amount, c_mktsegment]) AS val FROM raw)),
     v AS (SELECT "column", trim(value) AS value, value IS NULL OR trim(value) = '' AS blank, count(*) AS n FROM cells GROUP BY ALL),
     p AS (SELECT "column", sum(n)::BIGINT AS total, coalesce(sum(n) FILTER (WHERE blank), 0)::BIGINT AS blank, count(DISTINCT value) FILTER (WHERE NOT blank) AS distinct_values,
                  coalesce(sum(n) FILTER (WHERE NOT blank AND regexp_full_match(value, '-?\\d+')), 0)::BIGINT AS n_int, coalesce(sum(n) FILTER (WHERE NOT blank AND regexp_full_match(value, '-?\\d*\\.\\d+')), 0)::BIGINT AS n_float,
                  coalesce(sum(n) FILTER (WHERE NOT blank AND regexp_full_match(value, '0\\d+')), 0)::BIGINT AS n_leading_zero, coalesce(sum(n) FILTER (WHERE NOT blank AND regexp_full_match(value, '\\d{1,2}-[A-Za-z]{3}-\\d{2,4}')), 0)::BIGINT AS n_month_name_date,
                  coalesce(sum(n) FILTER (WHERE NOT blank AND regexp_full_match(value, '\\d{1,2}/\\d{1,2}/\\d{2,4}')), 0)::BIGINT AS n_slash_date, coalesce(sum(n) FILTER (WHERE lower(value) IN ('true', 'false')), 0)::BIGINT AS n_boolean,
                  coalesce(max(length(value)) FILTER (WHERE NOT blank), 0)::INT AS max_length, coalesce(max(n) FILTER (WHERE NOT blank), 0)::BIGINT AS top_count, round(sum(n * n) FILTER (WHERE NOT blank) / (sum(n) FILTER (WHERE NOT blank))::DOUBLE / (sum(n) FILTER (WHERE NOT blank)), 9) AS collision FROM v GROUP BY 1)
"""
_LOW = "(distinct_values BETWEEN 1 AND 200 AND distinct_values / (total - blank) < 0.5 AND top_count / (total - blank) > 0.01)"


@query(_CELLS_SQL + 'SELECT "column", total, blank, distinct_values, n_int, n_float, total - blank - n_int - n_float AS n_other, n_leading_zero, n_month_name_date, n_slash_date, max_length, top_count, collision FROM p')
def profile_columns(spark, sf):
    p = profile.profile_columns(_raw_customers(spark, sf))
    return p.select("column", "total", "blank", "distinct_values", "n_int", "n_float", "n_other", "n_leading_zero", "n_month_name_date", "n_slash_date", "max_length", "top_count", F.round("collision", 9).alias("collision"))


@query(_CELLS_SQL + f"""SELECT "column", array_to_string(list_filter([CASE WHEN n_leading_zero > 0 THEN 'LEADING ZEROS' WHEN n_int + n_float > 0 AND total - blank - n_int - n_float > 0 THEN 'MIXED TYPES' WHEN n_int + n_float > 0 THEN 'ALL-NUMERIC' END,
 CASE WHEN n_month_name_date + n_slash_date > 0 THEN 'NON-ISO DATES' END, CASE WHEN blank / total > 0.2 THEN 'SPARSE' END, CASE WHEN {_LOW} THEN 'LOW CARDINALITY' END], lambda x: x IS NOT NULL), ',') AS warnings,
 CASE WHEN distinct_values > 200 OR distinct_values / (total - blank) >= 0.5 THEN 'fingerprint' ELSE 'filter' END AS usage FROM p""")
def profile_warnings(spark, sf):
    p = profile.usage(profile.warnings(profile.profile_columns(_raw_customers(spark, sf))))
    return p.select("column", F.array_join("warnings", ",").alias("warnings"), "usage")


@query(_CELLS_SQL + """SELECT "column", CASE WHEN n_leading_zero > 0 AND n_int = total - blank THEN 'keyword' WHEN n_boolean = total - blank THEN 'boolean' WHEN n_int = total - blank THEN 'long' WHEN n_int + n_float = total - blank THEN 'double' END AS recommended_type,
 n_month_name_date + n_slash_date = total - blank AS looks_like_date FROM p""")
def recommend_types(spark, sf):
    return profile.recommend_types(profile.profile_columns(_raw_customers(spark, sf))).select("column", "recommended_type", "looks_like_date")


@query(_CELLS_SQL + f'SELECT "column", distinct_values FROM p WHERE {_LOW}')
def low_cardinality(spark, sf):
    return profile.profile_columns(_raw_customers(spark, sf)).where(profile.low_cardinality()).select("column", "distinct_values")


@query("""WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, count(*) AS n FROM lineitem GROUP BY ALL), k AS (SELECT l_orderkey, l_linenumber, sum(n) AS n, count(*) AS kinds, sum(n - 1) AS again FROM r GROUP BY 1, 2)
SELECT sum(n)::BIGINT AS total_rows, count(*) AS distinct_keys, count(*) FILTER (WHERE n > 1) AS duplicate_keys, sum(again)::BIGINT AS identical_rows, sum(kinds - 1)::BIGINT AS real_collisions FROM k""")
def key_uniqueness(spark, sf):
    return profile.key_uniqueness(table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"), ["l_orderkey", "l_linenumber"])


@query(_FIRMS + f""", sc AS (SELECT {_BLEND.format(a='x', b='y')} AS a, {_BLEND.format(a='tx', b='ty')} AS b
 FROM (SELECT list_distinct(string_split(lower(a.street), ' ')) AS x, list_distinct(string_split(lower(b.street), ' ')) AS y, a.tok AS tx, b.tok AS ty
       FROM pairs JOIN t a ON a.k = l JOIN t b ON b.k = r WHERE l < r AND a.street IS NOT NULL AND b.street IS NOT NULL))
SELECT count(*) AS pairs, count(*) FILTER (WHERE a <> b) AS changed, count(*) FILTER (WHERE b > a) AS up, count(*) FILTER (WHERE b < a) AS down, round(avg(a), 6) AS mean_before, round(avg(b), 6) AS mean_after,
 count(*) FILTER (WHERE a < 0.8 AND b >= 0.8) AS now_above, count(*) FILTER (WHERE a >= 0.8 AND b < 0.8) AS now_below FROM sc""")
def analyzer_effect(spark, sf):
    """What the street analyzer does to the overlap of customers' streets, against plain words."""
    rec = _firms(spark, sf).where("street is not null")
    rec = rec.select("c_custkey", F.array_distinct(F.split(F.lower("street"), " ")).alias("plain"), F.array_distinct("`tok:street.tokens`").alias("analyzed"))
    pairs = _evidence_pairs(spark, sf).where("l < r")
    both = pairs.join(rec.toDF("l", "p1", "a1"), "l").join(rec.toDF("r", "p2", "a2"), "r").select(blended_overlap(F.col("p1"), F.col("p2")).alias("before"), blended_overlap(F.col("a1"), F.col("a2")).alias("after"))
    found = profile.analyzer_effect(both, "before", "after", 0.8)
    return found.withColumns({c: F.round(c, 6) for c in ("mean_before", "mean_after")})


@query("SELECT event_type, count(*) AS n, min(event_id) AS lo, max(event_id) AS hi FROM events GROUP BY event_type")
def count_min_max(spark, sf):
    return table(spark, sf, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.min("event_id").alias("lo"), F.max("event_id").alias("hi"))


@query("SELECT DISTINCT o_custkey FROM orders WHERE o_orderstatus = 'F'")
def distinct_keys(spark, sf):
    return table(spark, sf, "orders").where("o_orderstatus = 'F'").select("o_custkey").distinct()


_BLANK = "SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN ' ' WHEN c_custkey % 11 = 0 THEN NULL ELSE c_name END AS name FROM customer"


@query(f"SELECT count(*) FILTER (WHERE name IS NULL OR trim(name) = '') AS blank_keys FROM ({_BLANK})")
def blank_key_counts(spark, sf):
    k = F.col("c_custkey")
    df = table(spark, sf, "customer").select("c_custkey", F.when(k % 7 == 0, " ").when(k % 11 == 0, F.lit(None)).otherwise(F.col("c_name")).alias("name"))
    return blank_key_count(df.withColumn("_id", document_id(df, "name")))


@query("SELECT c_custkey, regexp_replace('(' || (c_custkey % 900 + 100) || ') ' || CASE WHEN c_custkey % 5 = 0 THEN 'none' ELSE lpad(c_custkey::VARCHAR, 7, '0') END || ' ext. ' || (c_custkey % 3), '[^0-9]', '', 'g') AS digits FROM customer")
def phone_clean_tokens(spark, sf):
    k = F.col("c_custkey")
    raw = F.concat(F.lit("("), (k % 900 + 100).cast("string"), F.lit(") "), F.when(k % 5 == 0, "none").otherwise(F.lpad(k.cast("string"), 7, "0")), F.lit(" ext. "), (k % 3).cast("string"))
    return table(spark, sf, "customer").select("c_custkey", F.array_join(ANALYZERS["phone_clean"].token_set(raw), " ").alias("digits"))


_HOSPITAL = ", ".join(f"'{w}'" for w in HOSPITAL_STOP)


@query(f"""SELECT s_suppkey, array_to_string(list_sort(list_distinct(list_filter(string_split(lower(raw), ' '), lambda w: w NOT IN ({_HOSPITAL})))), ' ') AS tokens
 FROM (SELECT s_suppkey, 'Saint ' || s_suppkey || CASE s_suppkey % 3 WHEN 0 THEN ' General Hospital of' WHEN 1 THEN ' Memorial Medical Center' ELSE ' Clinic North' END || ' Nation' || s_nationkey AS raw FROM supplier)""")
def hospital_clean_tokens(spark, sf):
    k = F.col("s_suppkey")
    raw = F.concat(F.lit("Saint "), k.cast("string"), F.when(k % 3 == 0, " General Hospital of").when(k % 3 == 1, " Memorial Medical Center").otherwise(" Clinic North"), F.lit(" Nation"), F.col("s_nationkey").cast("string"))
    return table(spark, sf, "supplier").select("s_suppkey", F.array_join(F.array_sort(ANALYZERS["hospital_clean"].token_set(raw)), " ").alias("tokens"))


@query("SELECT o_orderkey, o_custkey, c_name, c_mktsegment FROM orders LEFT JOIN (SELECT c_custkey AS o_custkey, c_name, c_mktsegment FROM customer WHERE c_acctbal > 0) USING (o_custkey)")
def attributes_of_orders(spark, sf):
    known = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("o_custkey"), "c_name", "c_mktsegment")
    return attributes_by_key(table(spark, sf, "orders").select("o_orderkey", "o_custkey"), known, "o_custkey")


@query(_PAIRS_SQL + ", u AS (SELECT *, row_number() OVER (PARTITION BY least(l, r), greatest(l, r) ORDER BY total DESC, l) AS m FROM pairs) SELECT l AS left_key, r AS right_key, total_score FROM u WHERE m = 1")
def undirected_pairs(spark, sf):
    pairs = sweep(parts(spark, sf), PARTS_CONFIG | {"scoring": PARTS_CONFIG["scoring"] | {"undirected": True}})
    return pairs.select(F.col("left.entity_key").alias("left_key"), F.col("right.entity_key").alias("right_key"), "total_score")


@query(_PAIRS_SQL + "SELECT 'r1' AS run_id, 't' AS generated_at, 'part' AS source_index, 'parts' AS source_alias, 'f0' AS analysis_fingerprint, count(*) AS pairs FROM pairs")
def stamped_pairs(spark, sf):
    stamped = sweep(parts(spark, sf), PARTS_CONFIG, Provenance("part", "parts", "f0", "r1", "t"))
    return stamped.groupBy("run_id", "generated_at", "source_index", "source_alias", "analysis_fingerprint").agg(F.count("*").alias("pairs"))


@query("SELECT count(*) AS documents, count(k) AS with_key, count(DISTINCT k) AS keys FROM (SELECT CASE WHEN o_orderkey % 9 = 0 THEN NULL ELSE o_custkey END AS k FROM orders)")
def lookup_document_counts(spark, sf):
    rows = table(spark, sf, "orders").select(F.when(F.col("o_orderkey") % 9 != 0, F.col("o_custkey")).alias("k"))
    return lookup_counts(rows, LookupPolicy("customers", "orders", "k", ("k",)))


@query("SELECT 0.3 / (0.5 + 0.3 + 0.2) AS weight_share, round(0.3 * avg(hit), 6) AS mean_contribution, round(0.3 * (1 - avg(hit)), 6) AS headroom FROM (SELECT CASE WHEN p_size > 25 THEN 1.0 ELSE 0.25 END AS hit FROM part)")
def temporal_headroom(spark, sf):
    mean = table(spark, sf, "part").agg(F.avg(F.when(F.col("p_size") > 25, 1.0).otherwise(0.25))).first()[0]
    found = stats.signal_headroom({"name-token": 0.5, "temporal": 0.3, "address": 0.2}, "temporal", mean)
    return spark.createDataFrame([(found["weight_share"], round(found["mean_contribution"], 6), round(found["headroom"], 6))], "weight_share double, mean_contribution double, headroom double")
