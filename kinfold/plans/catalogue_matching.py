"""Catalogue: signals, blocking, scoring and the sweep."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinfold.functions.setsim import best_of, blended_overlap, containment, jaccard
from kinfold.functions.text import Binding, normalize_phone
from kinfold.operators import blocking, scoring
from kinfold.operators.context import normalised_idf, rarity_table, suppressed, value_rows
from kinfold.operators.enrich import LookupPolicy, build_lookup, enrich, within_gap
from kinfold.operators.signals import AddressSignal, Context, ExactIdentifierSignal, SharedTokenSignal, TemporalSignal, lifecycle_columns
from kinfold.plans._registry import query, table
from kinfold.plans.sweep import analyze, sweep

#: Parts of a lot: a code is a brand within a lot, so as many parts share one (about 40) at any size of the table.
PARTS_OF_LOT = 1000
PARTS_CONFIG = {
    "source_index": "part",
    "entity": {"key": "p_partkey", "summary_fields": ["p_name", "p_brand"]},
    "population": {"mode": "all-entities", "sort_field": "p_partkey"},
    "candidates": {"max_candidates": 20, "seed_signals": ["exact-identifier"]},
    "signals": [
        {"type": "name-token", "weight": 0.5, "fields": ["p_name"], "subfield": "clean"},
        {"type": "exact-identifier", "weight": 0.3, "text_fields": ["code"]},
        {"type": "rarity-weighted-value", "weight": 0.2, "name_field": "p_type"},
    ],
    "max_shared_records": {"*": 1000},
    "scoring": {"min_total_score": 0.5, "min_signals": 2, "require_identity_signal": True, "max_pairs_per_predecessor": 3},
}


def parts(spark, sf):
    df = table(spark, sf, "part").withColumn("code", F.concat_ws("/", "p_brand", F.floor(F.col("p_partkey") / PARTS_OF_LOT).cast("string")))
    return analyze(df, [Binding("p_name", {"clean": "name_clean"})])


def part_pairs(spark, sf):
    """Explained pairs of the flagship sweep."""
    return sweep(parts(spark, sf), PARTS_CONFIG)


_TOKENS = "list_distinct(string_split(lower(p_name), ' '))"
_PAIRS_SQL = f"""
WITH e AS (SELECT p_partkey AS k, p_name, p_brand, p_type, p_brand || '/' || (p_partkey // 1000) AS code, {_TOKENS} AS t FROM part),
     hot AS (SELECT code FROM e GROUP BY code HAVING count(*) > 1000),
     typ AS (SELECT p_type, count(*) AS c, sum(count(*)) OVER () AS n FROM e GROUP BY p_type),
     idf AS (SELECT p_type, CASE WHEN n < 2 THEN 0.0 ELSE ln(n / c) / ln(n) END AS idf FROM typ),
     cand AS (SELECT a.k AS l, b.k AS r, row_number() OVER (PARTITION BY a.k ORDER BY b.k) AS rank
              FROM e a JOIN e b ON a.code = b.code AND a.k <> b.k WHERE a.code NOT IN (SELECT code FROM hot)),
     top AS (SELECT * FROM cand WHERE rank <= 20),
     sim AS (SELECT l, r, rank, a.p_name AS ln, b.p_name AS rn, len(list_intersect(a.t, b.t))::DOUBLE AS i, len(a.t)::DOUBLE AS x, len(b.t)::DOUBLE AS y,
                    CASE WHEN a.p_type = b.p_type THEN idf.idf ELSE 0.0 END AS rarity
             FROM top JOIN e a ON a.k = l JOIN e b ON b.k = r JOIN idf ON idf.p_type = a.p_type),
     sc AS (SELECT *, (i / (x + y - i) + i / least(x, y)) / 2 AS name FROM sim),
     tot AS (SELECT *, (name * 0.5 + 1.0 * 0.3 + rarity * 0.2) / (0.5 + 0.3 + 0.2) AS total FROM sc),
     best AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY total DESC, rank, r) AS n FROM tot WHERE total >= 0.5),
     pairs AS (SELECT l, r, ln, rn, name, rarity, total, round(total, 6) AS total_score,
                      array_to_string(list_sort(list_filter(['exact-identifier', CASE WHEN name > 0 THEN 'name-token' END, CASE WHEN rarity > 0 THEN 'rarity-weighted-value' END], lambda v: v IS NOT NULL)), ',') AS matched_on
               FROM best WHERE n <= 3)
"""


@query(_PAIRS_SQL + "SELECT l || '|' || r AS _id, l AS left_key, r AS right_key, ln AS left_name, rn AS right_name, total_score, 3 AS signals_present, matched_on FROM pairs")
def entity_match_parts(spark, sf):
    return part_pairs(spark, sf).select(
        "_id", F.col("left.entity_key").alias("left_key"), F.col("right.entity_key").alias("right_key"), F.col("left.p_name").alias("left_name"), F.col("right.p_name").alias("right_name"),
        "total_score", "signals_present", F.array_join("matched_on", ",").alias("matched_on"),
    )


_BASKET = """
WITH post AS (SELECT DISTINCT l_orderkey AS id, l_partkey || ':' || CAST(l_quantity AS INT) AS token FROM lineitem),
     df AS (SELECT token, count(*) AS df FROM post GROUP BY token), n AS (SELECT count(DISTINCT id) AS n FROM post),
     rel AS (SELECT id, post.token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS rel FROM post JOIN df USING (token) CROSS JOIN n),
     pairs AS (SELECT a.id AS l, b.id AS r, sum(b.rel) AS relevance FROM post a JOIN rel b ON a.token = b.token AND a.id <> b.id GROUP BY 1, 2)
"""


def _baskets(spark, sf):
    token = F.concat_ws(":", F.col("l_partkey").cast("string"), F.col("l_quantity").cast("int").cast("string"))
    lines = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.collect_set(token).alias("tokens"))
    return blocking.postings(lines, "l_orderkey", {"basket": "tokens"})


@query(_BASKET + """, ranked AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY round(relevance, 9) DESC, r) AS rank, count(*) OVER (PARTITION BY l) AS found FROM pairs)
SELECT l, r, round(relevance, 6) AS relevance, rank::INT AS rank, found >= 5 AS truncated FROM ranked WHERE rank <= 5""")
def blocking_topk(spark, sf):
    posted = _baskets(spark, sf)
    found = blocking.candidates(posted, blocking.weighted(posted, "idf"), 5)
    return found.select("l", "r", F.round("relevance", 6).alias("relevance"), "rank", "truncated")


@query("""
WITH w AS (SELECT doc_id AS id, lower(unnest(regexp_extract_all(text, '[A-Za-z]+'))) AS token FROM documents),
     p AS (SELECT id, token, count(*) AS tf, sum(count(*)) OVER (PARTITION BY id) AS dl FROM w GROUP BY id, token),
     df AS (SELECT token, count(*) AS df FROM p GROUP BY token),
     n AS (SELECT count(*) AS n, avg(dl) AS avgdl FROM (SELECT DISTINCT id, dl FROM p))
SELECT token, count(*) AS postings, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 4) AS relevance
FROM p JOIN df USING (token) CROSS JOIN n GROUP BY token
""")
def bm25_postings(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.transform(F.regexp_extract_all("text", F.lit("[A-Za-z]+"), F.lit(0)), lambda w: F.lower(w)).alias("tokens"))
    hits = blocking.weighted(blocking.postings(docs, "doc_id", {"text": "tokens"}))
    return hits.groupBy("token").agg(F.count("*").alias("postings"), F.round(F.sum("relevance"), 4).alias("relevance"))


def _twin_parts(spark, sf):
    p = parts(spark, sf).select("p_partkey", "code", F.split(F.lower("p_name"), " ").alias("n"), F.split(F.lower("p_type"), " ").alias("t"))
    p = p.select("p_partkey", "code", F.array_distinct("n").alias("n"), F.array_distinct("t").alias("t"))
    a, b = (p.withColumnsRenamed({c: f"{c}{i}" for c in ("p_partkey", "n", "t")}) for i in (1, 2))
    return a.join(b, "code").where("p_partkey1 < p_partkey2")


_TWINS = """
WITH e AS (SELECT p_partkey AS k, p_brand || '/' || (p_partkey // 1000) AS code, list_distinct(string_split(lower(p_name), ' ')) AS n, list_distinct(string_split(lower(p_type), ' ')) AS t FROM part),
     p AS (SELECT a.k AS left_key, b.k AS right_key, a.n AS n1, b.n AS n2, a.t AS t1, b.t AS t2 FROM e a JOIN e b ON a.code = b.code AND a.k < b.k)
"""
_BLEND = "((len(list_intersect({a}, {b})) / (len({a}) + len({b}) - len(list_intersect({a}, {b}))) + len(list_intersect({a}, {b})) / least(len({a}), len({b}))) / 2)"


@query(_TWINS + f"""SELECT left_key, right_key, round(len(list_intersect(n1, n2)) / (len(n1) + len(n2) - len(list_intersect(n1, n2))), 6) AS jaccard,
 round(len(list_intersect(n1, n2)) / least(len(n1), len(n2)), 6) AS containment, round({_BLEND.format(a='n1', b='n2')}, 6) AS blended FROM p""")
def name_overlap_scores(spark, sf):
    a, b = F.col("n1"), F.col("n2")
    return _twin_parts(spark, sf).select(F.col("p_partkey1").alias("left_key"), F.col("p_partkey2").alias("right_key"), F.round(jaccard(a, b), 6).alias("jaccard"), F.round(containment(a, b), 6).alias("containment"), F.round(blended_overlap(a, b), 6).alias("blended"))


@query(_TWINS + "SELECT left_key, right_key, round(greatest(" + ", ".join(_BLEND.format(a=a, b=b) for a in ("n1", "t1") for b in ("n2", "t2")) + "), 6) AS score FROM p")
def cross_field_overlap(spark, sf):
    scores = [blended_overlap(F.col(a), F.col(b)) for a in ("n1", "t1") for b in ("n2", "t2")]
    return _twin_parts(spark, sf).select(F.col("p_partkey1").alias("left_key"), F.col("p_partkey2").alias("right_key"), F.round(best_of(scores), 6).alias("score"))


#: A house has 40 customers, a telephone three, a mailbox four, at any size of the table.
_FIRMS = """
WITH f AS (SELECT c_custkey AS k, c_nationkey AS state,
                  CASE c_custkey % 5 WHEN 0 THEN (c_custkey // 40)::VARCHAR || ' MAIN ST' WHEN 1 THEN (c_custkey // 40)::VARCHAR || ' Main Street' WHEN 2 THEN (c_custkey // 40)::VARCHAR || ' MAIN ST STE 4'
                                     WHEN 3 THEN 'P.O. BOX ' || (c_custkey // 40)::VARCHAR ELSE NULL END AS street,
                  '(555) ' || lpad((c_custkey // 3)::VARCHAR, 7, '0') AS phone,
                  CASE c_custkey % 3 WHEN 0 THEN '0000000000' WHEN 1 THEN '555' || lpad(((c_custkey + 3) // 3)::VARCHAR, 7, '0') ELSE NULL END AS fax,
                  CASE WHEN c_custkey % 4 = 0 THEN ' ' ELSE 'Mail' || (c_custkey // 4)::VARCHAR END AS mail FROM customer),
     c AS (SELECT *, trim(regexp_replace(regexp_replace(lower(regexp_replace(street, '(?i)\\bp[.\\s]*o[.\\s]*(box|b\\b)', 'pobox', 'g')), '[[:punct:]]', ' ', 'g'), '\\s+', ' ', 'g')) AS clean,
                  list_filter([regexp_replace(phone, '[^0-9]', '', 'g'), CASE WHEN fax <> '0000000000' THEN fax END, nullif(lower(trim(mail)), '')], lambda v: v IS NOT NULL) AS vs FROM f),
     t AS (SELECT *, list_distinct(list_transform(list_filter(string_split(clean, ' '), lambda w: w <> 'ste'), lambda w: CASE WHEN w = 'st' THEN 'street' ELSE w END)) AS tok FROM c),
     post AS (SELECT k, 'street' AS block, clean AS token FROM t WHERE clean IS NOT NULL UNION ALL SELECT k, 'phone', regexp_replace(phone, '[^0-9]', '', 'g') FROM t
              UNION ALL SELECT k, 'fax', fax FROM t WHERE fax <> '0000000000' UNION ALL SELECT k, 'mail', mail FROM t WHERE trim(mail) <> ''),
     pairs AS (SELECT DISTINCT a.k AS l, b.k AS r FROM post a JOIN post b ON a.block = b.block AND a.token = b.token AND a.k <> b.k)
"""


def _firms(spark, sf):
    k = F.col("c_custkey")
    n = F.floor(k / 40).cast("string")
    text = lambda by, more=0: F.floor((k + more) / by).cast("string")
    kind = k % 5
    df = table(spark, sf, "customer").withColumns({
        "street": F.when(kind == 0, F.concat(n, F.lit(" MAIN ST"))).when(kind == 1, F.concat(n, F.lit(" Main Street"))).when(kind == 2, F.concat(n, F.lit(" MAIN ST STE 4"))).when(kind == 3, F.concat(F.lit("P.O. BOX "), n)),
        "state": F.col("c_nationkey").cast("string"), "phone": F.concat(F.lit("(555) "), F.lpad(text(3), 7, "0")),
        "fax": F.when(k % 3 == 0, "0000000000").when(k % 3 == 1, F.concat(F.lit("555"), F.lpad(text(3, 3), 7, "0"))),
        "mail": F.when(k % 4 == 0, " ").otherwise(F.concat(F.lit("Mail"), text(4))),
    })
    return analyze(df, [Binding("street", {"clean": "street_clean", "tokens": "street_tokens"})])


def _evidence(spark, sf):
    """Customers prepared for both signals, and the signals."""
    signals = [
        AddressSignal({"type": "address", "weight": 1, "fields": ["street"], "exact_subfield": "clean", "fuzzy_subfield": "tokens", "fuzzy_scale": 0.7}, 0, Context({}, state_field="state")),
        ExactIdentifierSignal({"type": "exact-identifier", "weight": 1, "phone_fields": ["phone", "fax"], "text_fields": ["mail"]}, 1, Context({"fax": ["0000000000"]})),
    ]
    rec = _firms(spark, sf)
    for s in signals:
        rec = s.prepare(rec, "c_custkey")
    return signals[1].seed_columns(rec), signals


def _evidence_pairs(spark, sf):
    """(l, r): customers that share a street, a number or a mailbox."""
    rec, signals = _evidence(spark, sf)
    blocks = {f"{s.index}:{b}": f"`{c}`" for s in signals for b, c in s.seeds(rec)[1].items()}
    return blocking.pairs(blocking.postings(rec, "c_custkey", blocks), blocking.postings(rec, "c_custkey", blocks))


def _scored_by_evidence(spark, sf, scored):
    """These pairs with the score of the signal number ``scored``."""
    rec, signals = _evidence(spark, sf)
    ev = rec.select("c_custkey", F.struct(*[F.col(c) for c in rec.columns if c.startswith("ev")]).alias("rec"))
    both = _evidence_pairs(spark, sf).join(ev.withColumnsRenamed({"c_custkey": "l", "rec": "a"}), "l").join(ev.withColumnsRenamed({"c_custkey": "r", "rec": "b"}), "r")
    return both.select("l", "r", signals[scored].score("a", "b").alias("score"))


@query(_FIRMS + """SELECT l AS left_key, r AS right_key,
       CASE WHEN a.clean IS NULL OR b.clean IS NULL THEN NULL WHEN a.clean = b.clean THEN 1.0
            ELSE round(len(list_intersect(a.tok, b.tok)) / least(len(a.tok), len(b.tok)) * 0.7 * CASE WHEN a.state = b.state THEN 1.0 ELSE 0.5 END, 6) END::DOUBLE AS score
FROM pairs JOIN t a ON a.k = l JOIN t b ON b.k = r""")
def address_signal(spark, sf):
    return _scored_by_evidence(spark, sf, 0).select(F.col("l").alias("left_key"), F.col("r").alias("right_key"), F.round("score", 6).alias("score"))


@query(_FIRMS + "SELECT l AS left_key, r AS right_key, CASE WHEN len(a.vs) = 0 OR len(b.vs) = 0 THEN NULL WHEN list_has_any(a.vs, b.vs) THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM pairs JOIN t a ON a.k = l JOIN t b ON b.k = r WHERE l < r")
def exact_identifier(spark, sf):
    return _scored_by_evidence(spark, sf, 1).where("l < r").select(F.col("l").alias("left_key"), F.col("r").alias("right_key"), "score")


@query("""
WITH v AS (SELECT DISTINCT o_custkey AS c, l_partkey AS p, l_suppkey AS s FROM orders JOIN lineitem ON o_orderkey = l_orderkey),
     hot AS (SELECT p, s FROM v GROUP BY p, s HAVING count(*) > 5)
SELECT DISTINCT a.c AS left_key, b.c AS right_key, 1.0::DOUBLE AS score FROM v a JOIN v b ON a.p = b.p AND a.s = b.s AND a.c < b.c ANTI JOIN hot ON hot.p = a.p AND hot.s = a.s
""")
def shared_token_pairs(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.concat_ws("-", F.col("l_partkey").cast("string"), F.col("l_suppkey").cast("string")).alias("token"))
    buyers = table(spark, sf, "orders").select("o_orderkey", "o_custkey").join(lines, "o_orderkey").groupBy("o_custkey").agg(F.collect_set(F.struct("token")).alias("items"))
    hot = suppressed(value_rows(buyers, "o_custkey", ["items.token"]), {"items.token": 5}, most=None)
    signal = SharedTokenSignal({"type": "shared-token", "weight": 1, "fields": ["items.token"]}, 0, Context({}, hot))
    rec = signal.seed_columns(signal.prepare(buyers, "o_custkey"))
    left, right, _ = signal.seeds(rec)
    posted = blocking.postings(rec, "o_custkey", right)
    pairs = blocking.postings(rec, "o_custkey", left).alias("a").join(posted.alias("b"), ["block", "token"]).where("a.id < b.id").select(F.col("a.id").alias("l"), F.col("b.id").alias("r")).distinct()
    ev = rec.select("o_custkey", F.struct("ev0").alias("rec"))
    both = pairs.join(ev.withColumnsRenamed({"o_custkey": "l", "rec": "a"}), "l").join(ev.withColumnsRenamed({"o_custkey": "r", "rec": "b"}), "r")
    return both.select(F.col("l").alias("left_key"), F.col("r").alias("right_key"), signal.score("a", "b").alias("score"))


@query("""SELECT lower(trim(p_type)) AS value, count(*) AS records, (sum(count(*)) OVER ())::BIGINT AS total,
 round(ln((sum(count(*)) OVER ()) / count(*)) / ln(sum(count(*)) OVER ()), 6) AS idf FROM part GROUP BY 1""")
def rarity_weighted(spark, sf):
    rows = value_rows(table(spark, sf, "part"), "p_partkey", ["p_type"])
    return rarity_table(rows).select("value", "records", "total", F.round("idf", 6).alias("idf"))


_LIFE = """
WITH ends AS (SELECT user_id, max(ts)::DATE AS ended FROM events WHERE event_type = 'error' GROUP BY 1),
     begins AS (SELECT user_id, min(ts)::DATE AS began FROM events WHERE event_type = 'signup' GROUP BY 1),
     post AS (SELECT DISTINCT user_id, event_type, round(value * 100)::BIGINT AS cents FROM events),
     known AS (SELECT user_id FROM ends UNION SELECT user_id FROM begins),
     token AS (SELECT event_type, cents FROM post GROUP BY 1, 2 HAVING count(*) <= 20),
     shared AS (SELECT DISTINCT a.user_id AS l, b.user_id AS r FROM post a JOIN post b USING (event_type, cents) JOIN token USING (event_type, cents) WHERE a.user_id <> b.user_id),
     p AS (SELECT l AS left_key, r AS right_key, CASE WHEN r % 10 = 0 THEN NULL ELSE date_diff('day', ended, began) END AS gap
           FROM shared JOIN ends ON ends.user_id = l JOIN known ON known.user_id = r LEFT JOIN begins ON begins.user_id = r)
"""


def _lives(spark, sf):
    """Users as records with an array of error dates and a registration date, paired with others by events of one kind and value."""
    ev = table(spark, sf, "events").select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd").alias("d"), F.concat_ws(":", "event_type", F.round(F.col("value") * 100).cast("long").cast("string")).alias("token"))
    errors = ev.where("event_type = 'error'").groupBy("user_id").agg(F.collect_set(F.struct("d")).alias("errors"))
    signups = ev.where("event_type = 'signup'").groupBy("user_id").agg(F.min("d").alias("signup"))
    users = errors.join(signups.withColumn("signup", F.when(F.col("user_id") % 10 != 0, F.col("signup"))), "user_id", "full")
    rec = lifecycle_columns(users, {"shutdown_date": "errors.d", "registration_date": "signup"})
    rec = rec.select("user_id", F.col("errors").isNotNull().alias("ended"), F.struct("ev_shutdown", "ev_registered").alias("rec"))
    posted = blocking.postings(ev.groupBy("user_id").agg(F.collect_set("token").alias("tokens")), "user_id", {"event": "tokens"})
    pairs = blocking.pairs(posted, blocking.weighted(posted, "idf", 20))
    a, b = (rec.withColumnsRenamed({"user_id": f"k{i}", "rec": f"r{i}", "ended": f"e{i}"}) for i in (1, 2))
    return pairs.withColumnsRenamed({"l": "k1", "r": "k2"}).join(a.where("e1"), "k1").join(b, "k2")


@query(_LIFE + "SELECT left_key, right_key, round(CASE WHEN gap IS NULL THEN NULL WHEN gap >= 0 THEN greatest(0.0, 1 - gap / 20.0) ELSE greatest(0.0, (1 - least(1.0, abs(gap) / 180.0)) * 0.5) END, 6) AS score FROM p")
def temporal_signal(spark, sf):
    life = {"shutdown_date": "errors.d", "registration_date": "signup"}
    signal = TemporalSignal({"type": "temporal", "weight": 1, "max_gap_days": 20}, 0, Context({}, lifecycle=life))
    return _lives(spark, sf).select(F.col("k1").alias("left_key"), F.col("k2").alias("right_key"), F.round(signal.score("r1", "r2"), 6).alias("score"))


@query(_LIFE + "SELECT left_key, right_key, gap::INT AS gap_days FROM p WHERE gap IS NULL OR gap BETWEEN -25 AND -10")
def gap_window_gate(spark, sf):
    from kinfold.operators.signals import gap_days

    pairs = _lives(spark, sf).select(F.col("k1").alias("left_key"), F.col("k2").alias("right_key"), gap_days("r1", "r2").alias("gap_days"))
    return pairs.where(within_gap(F.col("gap_days"), -25, -10))


@query("SELECT 'p_name' AS path, p_name AS value, count(*) AS records FROM part GROUP BY p_name HAVING count(*) > 30 UNION ALL SELECT 'p_type', p_type, count(*) FROM part GROUP BY p_type HAVING count(*) > 20")
def frequency_suppression(spark, sf):
    return suppressed(value_rows(table(spark, sf, "part"), "p_partkey", ["p_name", "p_type"]), {"p_name": 30, "*": 20})


_SCORED = _TWINS.rstrip() + f""",
     s AS (SELECT left_key, right_key, CASE WHEN left_key % 3 = 0 THEN NULL ELSE {_BLEND.format(a='n1', b='n2')} END AS a,
                  CASE WHEN right_key % 4 = 0 THEN NULL ELSE {_BLEND.format(a='t1', b='t2')} END AS b, CASE WHEN left_key % 5 = 0 THEN 1.0 WHEN left_key % 5 = 1 THEN NULL ELSE 0.0 END AS c FROM p),
     t AS (SELECT *, CASE WHEN a IS NULL AND b IS NULL AND c IS NULL THEN NULL ELSE (coalesce(a * 0.5, 0) + coalesce(b * 0.3, 0) + coalesce(c * 0.2, 0)) /
                  ((CASE WHEN a IS NULL THEN 0.0 ELSE 0.5 END) + (CASE WHEN b IS NULL THEN 0.0 ELSE 0.3 END) + (CASE WHEN c IS NULL THEN 0.0 ELSE 0.2 END)) END AS total,
                  (a IS NOT NULL)::INT + (b IS NOT NULL)::INT + (c IS NOT NULL)::INT AS present FROM s)
"""


class _Given:
    """A signal whose score is a column that is there already."""

    def __init__(self, kind, weight, column, conclusive=False):
        self.type, self.weight, self.column, self.conclusive = kind, weight, column, conclusive
        self.name, self.config, self.fields, self.evidence_key, self.identity = None, {}, [column], column, kind in ("name-token", "shared-token")


_GIVEN = [_Given("name-token", 0.5, "a"), _Given("rarity-weighted-value", 0.3, "b"), _Given("shared-token", 0.2, "c", True)]


def _scored(spark, sf):
    df = _twin_parts(spark, sf)
    l, r = F.col("p_partkey1"), F.col("p_partkey2")
    df = df.select(l.alias("left_key"), r.alias("right_key"), F.when(l % 3 != 0, blended_overlap(F.col("n1"), F.col("n2"))).alias("a"), F.when(r % 4 != 0, blended_overlap(F.col("t1"), F.col("t2"))).alias("b"), F.when(l % 5 == 0, 1.0).when(l % 5 != 1, 0.0).alias("c"))
    cols = [F.col(c) for c in "abc"]
    return df.withColumns({"evidence": scoring.contributions(_GIVEN, cols), "total": scoring.total_score([s.weight for s in _GIVEN], cols), "gap_days": F.lit(None).cast("int")})


@query(_SCORED + "SELECT left_key, right_key, round(total, 6) AS total_score, present AS signals_present FROM t")
def renormalized_score(spark, sf):
    return _scored(spark, sf).select("left_key", "right_key", F.round("total", 6).alias("total_score"), F.size("evidence").alias("signals_present"))


@query(_SCORED + "SELECT left_key, right_key, round(total, 6) AS total_score FROM t WHERE present >= 2 AND (coalesce(a, 0) > 0 OR coalesce(c, 0) > 0) AND total >= 0.4")
def score_guards(spark, sf):
    return scoring.guarded(_scored(spark, sf), {"min_total_score": 0.4, "min_signals": 2}, set()).select("left_key", "right_key", F.round("total", 6).alias("total_score"))


@query(_SCORED + "SELECT left_key, right_key, round(total, 6) AS total_score FROM t WHERE present >= 1 AND (coalesce(a, 0) > 0 OR coalesce(c, 0) > 0) AND (total >= 0.6 OR c > 0)")
def conclusive_override(spark, sf):
    return scoring.guarded(_scored(spark, sf), {"min_total_score": 0.6, "min_signals": 1}, {"shared-token"}).select("left_key", "right_key", F.round("total", 6).alias("total_score"))


@query("SELECT records, total, round(CASE WHEN total < 2 THEN 0.0 WHEN records IS NULL THEN 1.0 ELSE ln(total / records) / ln(total) END, 6) AS idf FROM (SELECT CASE WHEN p_size % 7 = 0 THEN NULL ELSE p_size END::BIGINT AS records, (p_size * 3 - 2)::BIGINT AS total FROM (SELECT DISTINCT p_size FROM part))")
def normalised_idf_values(spark, sf):
    s = table(spark, sf, "part").select("p_size").distinct()
    s = s.select(F.when(F.col("p_size") % 7 != 0, F.col("p_size")).cast("long").alias("records"), (F.col("p_size") * 3 - 2).cast("long").alias("total"))
    return s.select("records", "total", F.round(normalised_idf(F.col("records"), F.col("total")), 6).alias("idf"))


@query("""SELECT c_custkey, CASE WHEN length(d) >= 7 AND replace(d, left(d, 1), '') <> '' THEN d END AS phone FROM
 (SELECT c_custkey, regexp_replace(CASE c_custkey % 4 WHEN 0 THEN '(555) ' || c_custkey || '-77' WHEN 1 THEN '999-9999' WHEN 2 THEN '12' ELSE '+1 ' || (c_custkey * 1000003)::VARCHAR END, '[^0-9]', '', 'g') AS d FROM customer)""")
def phone_clean(spark, sf):
    k = F.col("c_custkey")
    raw = F.when(k % 4 == 0, F.concat(F.lit("(555) "), k.cast("string"), F.lit("-77"))).when(k % 4 == 1, "999-9999").when(k % 4 == 2, "12").otherwise(F.concat(F.lit("+1 "), (k * 1000003).cast("string")))
    return table(spark, sf, "customer").select("c_custkey", normalize_phone(raw).alias("phone"))


LIFECYCLE_CONFIG = {
    "source_index": "firms",
    "entity": {"key": "k", "key_label": "number", "summary_fields": ["name"]},
    "lifecycle": {"shutdown_date": "orders.d", "registration_date": "added", "shutdown_reason": "orders.why"},
    "population": {"mode": "lifecycle", "sort_field": "k", "selector": "ended", "selectors": {"ended": {"nested-exists": {"path": "orders", "require": "d", "terms": {"status": ["F"]}, "range": {"d": {"gte": "1997-01-01"}}}}}},
    "candidates": {"max_candidates": 8, "seed_signals": ["name-token", "address"]},
    "signals": [
        {"type": "name-token", "weight": 0.4, "fields": ["name"], "subfield": "clean"},
        {"type": "address", "weight": 0.3, "fields": ["street"], "exact_subfield": "clean", "fuzzy_subfield": "tokens"},
        {"type": "temporal", "weight": 0.3, "max_gap_days": 365},
    ],
    "scoring": {"min_total_score": 0.35, "min_signals": 2, "require_identity_signal": True, "max_pairs_per_predecessor": 3, "min_gap_days": -200, "max_gap_days": 500},
}
FIRM_ORDERS = LookupPolicy("orders", "orders", "o_custkey", ("d", "status", "why"), ("o_orderkey",))


def lifecycle_firms(spark, sf):
    """Customers with a name (a word of four, one of about twenty), a street, a first day and up to five orders."""
    k = F.col("c_custkey")
    orders = table(spark, sf, "orders").select("o_custkey", "o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("d"), F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("why"))
    kind = k % 3
    n = F.floor(k / 6).cast("string")
    df = table(spark, sf, "customer").select(
        k.alias("k"), F.concat(F.lit("N"), F.floor(k / 4).cast("string"), F.lit(" "), F.initcap("c_mktsegment"), F.floor(k / 100).cast("string")).alias("name"),
        F.when(kind == 0, F.concat(n, F.lit(" Oak St"))).when(kind == 1, F.concat(n, F.lit(" OAK STREET"))).otherwise(F.concat(n, F.lit(" Oak St. Apt 2"))).alias("street"),
        F.date_format(F.date_add(F.lit("1995-06-01").cast("date"), ((k * 37) % 2200).cast("int")), "yyyy-MM-dd").alias("added"),
    )
    df = enrich(df, build_lookup(orders, FIRM_ORDERS, 5), "k", "orders")
    return analyze(df, [Binding("name", {"clean": "name_clean"}), Binding("street", {"clean": "street_clean", "tokens": "street_tokens"})])


_LIFECYCLE_SQL = """
WITH o AS (SELECT o_custkey AS k, strftime(o_orderdate, '%Y-%m-%d') AS d, o_orderstatus AS status, o_orderpriority AS why, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders),
     o5 AS (SELECT * FROM o WHERE n <= 5),
     ended AS (SELECT k, max(d) AS d, arg_max(why, d || why) AS why FROM o5 GROUP BY k),
     pop AS (SELECT DISTINCT k FROM o5 WHERE status = 'F' AND d >= '1997-01-01'),
     e AS (SELECT c_custkey AS k, 'N' || (c_custkey // 4) || ' ' || c_mktsegment[1] || lower(c_mktsegment[2:]) || (c_custkey // 100) AS name,
                  ['n' || (c_custkey // 4), lower(c_mktsegment) || (c_custkey // 100)] AS t,
                  (c_custkey // 6) || CASE c_custkey % 3 WHEN 0 THEN ' oak st' WHEN 1 THEN ' oak street' ELSE ' oak st apt 2' END AS clean,
                  CASE WHEN c_custkey % 3 = 2 THEN list_distinct(['' || (c_custkey // 6), 'oak', 'street', '2']) ELSE ['' || (c_custkey // 6), 'oak', 'street'] END AS s,
                  DATE '1995-06-01' + (c_custkey * 37 % 2200)::INT AS added FROM customer),
     post AS (SELECT k, 'name' AS block, unnest(t) AS token FROM e UNION ALL SELECT k, 'street', clean FROM e),
     df AS (SELECT block, token, count(*) AS df FROM post GROUP BY 1, 2), n AS (SELECT count(*) AS n FROM e),
     rel AS (SELECT k, post.block, post.token, ln(1 + (n - df + 0.5) / (df + 0.5)) AS rel FROM post JOIN df USING (block, token) CROSS JOIN n),
     cand AS (SELECT a.k AS l, b.k AS r, sum(b.rel) AS relevance FROM post a JOIN pop USING (k) JOIN rel b ON a.block = b.block AND a.token = b.token AND a.k <> b.k GROUP BY 1, 2),
     top AS (SELECT l, r, row_number() OVER (PARTITION BY l ORDER BY round(relevance, 9) DESC, r) AS rank, count(*) OVER (PARTITION BY l) AS found FROM cand),
     sim AS (SELECT l, r, rank, found >= 8 AS truncated, a.name AS ln, b.name AS rn, ended.d, ended.why, b.added, date_diff('day', ended.d::DATE, b.added) AS gap,
                    len(list_intersect(a.t, b.t))::DOUBLE AS i, CASE WHEN a.clean = b.clean THEN 1.0 ELSE len(list_intersect(a.s, b.s)) / least(len(a.s), len(b.s)) * 0.7 END AS addr
             FROM top JOIN e a ON a.k = l JOIN e b ON b.k = r JOIN ended ON ended.k = l WHERE rank <= 8),
     sc AS (SELECT *, (i / (4 - i) + i / 2) / 2 AS name, CASE WHEN gap >= 0 THEN greatest(0.0, 1 - gap / 365.0) ELSE greatest(0.0, (1 - least(1.0, abs(gap) / 180.0)) * 0.5) END AS temp FROM sim WHERE gap BETWEEN -200 AND 500),
     tot AS (SELECT *, name * 0.4 + addr * 0.3 + temp * 0.3 AS total FROM sc WHERE name > 0 OR addr > 0),
     best AS (SELECT *, row_number() OVER (PARTITION BY l ORDER BY total DESC, rank, r) AS n, round(total, 6) AS total_score FROM tot WHERE total >= 0.35),
     pairs AS (SELECT * FROM best WHERE n <= 3)
"""


def lifecycle_pairs(spark, sf):
    return sweep(lifecycle_firms(spark, sf), LIFECYCLE_CONFIG)


@query(_LIFECYCLE_SQL + """SELECT l || '|' || r AS _id, l AS predecessor, r AS successor, ln AS predecessor_name, rn AS successor_name, d AS shutdown_date, why AS shutdown_reason, strftime(added, '%Y-%m-%d') AS add_date, gap::INT AS gap_days,
       total_score, 3 AS signals_present, truncated,
       array_to_string(list_sort(list_filter([CASE WHEN addr > 0 THEN 'address' END, CASE WHEN name > 0 THEN 'name-token' END, CASE WHEN temp > 0 THEN 'temporal' END], lambda v: v IS NOT NULL)), ',') AS matched_on
FROM pairs
""")
def entity_match_lifecycle(spark, sf):
    return lifecycle_pairs(spark, sf).select(
        "_id", F.col("predecessor.number").alias("predecessor"), F.col("successor.number").alias("successor"), F.col("predecessor.name").alias("predecessor_name"), F.col("successor.name").alias("successor_name"),
        F.date_format("predecessor.shutdown_date", "yyyy-MM-dd").alias("shutdown_date"), F.col("predecessor.shutdown_reason").alias("shutdown_reason"), F.date_format("successor.add_date", "yyyy-MM-dd").alias("add_date"),
        "gap_days", "total_score", "signals_present", "truncated", F.array_join("matched_on", ",").alias("matched_on"),
    )
