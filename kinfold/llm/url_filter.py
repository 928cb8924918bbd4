"""URL filters: a blocked Bloom filter of listed canonical URLs before an exact hash join (DataFrame functions only).

A list entry is ``host/path-prefix``: it fits its host and all subdomains where the url's path starts with the
entry's path. Every url is turned into the few keys that could be listed (host suffixes times listed path
lengths), the Bloom filter drops nearly all of them, and the exact join drops its false positives.

Rules are held against host and path as they stand; listed URLs are held against canonical ones: host without user, port
and closing dots, path without empty and ``.`` segments (percent codes stay as they are).

Defined cases: a null url and one without ``://`` have empty host and path and fit nothing; repeated rows are kept
and judged alike; a very long url gives as many keys as its host has labels, up to those of the longest entry; an empty table
gives an empty result; an empty list gives the default verdict everywhere; columns of ``pages`` that clash with the added names
are replaced. Of entries of equal length the greater string wins, of equal entries of one kind the greater action.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._store import stored

#: Words of the Bloom filter, 64 bits each: with its index 16 bytes a word, so 1 MB at most is ever broadcast.
BLOOM_WORDS = 1 << 16

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_of(url: Column) -> Column:
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, _UPPER, _LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def canonical_host(host: Column) -> Column:
    return F.regexp_replace(host, r"(?s)^.*@|:[0-9]*$|\.+(?=:[0-9]*$|$)", "")


def canonical_path(path: Column) -> Column:
    return F.regexp_replace(path, r"/(?:\.?/)+", "/")


def _bloom_columns(key: Column, words: int) -> tuple[Column, Column]:
    """The word a key falls into, and its four bits there."""
    h, g = F.xxhash64(key), F.xxhash64(key, F.lit(0x9E37))
    bits = []
    one = F.lit(1).cast("long")
    for shift in (0, 6, 12, 18):
        bits.append(F.call_function("shiftleft", one, F.shiftrightunsigned(g, shift).bitwiseAND(F.lit(63)).cast("int")))
    mask = bits[0]
    for b in bits[1:]:
        mask = mask.bitwiseOR(b)
    return F.pmod(h, F.lit(words)).cast("int"), mask


def build_bloom(keys: DataFrame, column: str, words: int = BLOOM_WORDS) -> DataFrame:
    """(word, bits) of the listed keys, at most ``words`` rows."""
    word, mask = _bloom_columns(F.col(column), words)
    return keys.select(word.alias("bloom_word"), mask.alias("_mask")).groupBy("bloom_word").agg(F.bit_or("_mask").alias("bloom_bits"))


def filter_urls(pages: DataFrame, entries: DataFrame, default: str = "allow", url: str = "url", words: int = BLOOM_WORDS) -> DataFrame:
    """Add host, path, rule and verdict to every row of ``pages``.

    ``entries``: (entry, action, kind); kind ``rule`` gives the verdict and is named in ``rule`` (the longest wins),
    kind ``listed`` blocks or allows a url that no rule fits.
    """
    listed = entries.groupBy("entry", "kind").agg(F.max("action").alias("action"))
    shape = listed.select(
        F.length(F.regexp_extract("entry", r"(?s)^[^/]*(.*)$", 1)).alias("n"), F.size(F.split(F.regexp_extract("entry", r"^[^/]*", 0), r"\.")).alias("labels")
    ).agg(F.collect_set("n").alias("lengths"), F.max("labels").alias("labels")).first()  # one row: distinct path lengths
    lengths, labels = sorted(shape["lengths"] or []), shape["labels"] or 1
    judged = pages.drop("host", "path", "rule", "verdict").withColumns({"host": host_of(F.col(url)), "path": path_of(F.col(url))})
    longest = max(lengths, default=0)
    head = lambda path: F.substring(path, 1, longest) if longest else F.lit("")
    judged = judged.withColumn("_head", head("path")).withColumns({"_chost": canonical_host(F.col("host")), "_chead": head(canonical_path(F.col("path")))})

    place = ["host", "_head", "_chost", "_chead"]
    places = judged.select(*place).distinct()
    sides = F.array(F.struct(F.lit("rule").alias("kind"), F.col("host").alias("h"), F.col("_head").alias("p")), F.struct(F.lit("listed").alias("kind"), F.col("_chost").alias("h"), F.col("_chead").alias("p")))
    keys = places.select(*place, F.explode(sides).alias("x")).select(*place, "x.*").withColumn("_parts", F.split("h", r"\."))
    suffixes = F.transform(F.sequence(F.lit(1), F.least(F.size("_parts"), F.lit(labels))), lambda i: F.array_join(F.slice("_parts", -i, i), "."))
    heads = F.transform(F.filter(F.lit(lengths).cast("array<int>") if lengths else F.array().cast("array<int>"), lambda n: n <= F.length("p")), lambda n: F.substring(F.col("p"), F.lit(1), n))
    keys = keys.select(*place, "kind", F.explode(suffixes).alias("_s"), heads.alias("_ps")).select(*place, "kind", "_s", F.explode("_ps").alias("_p"))
    keys = keys.select(*place, "kind", F.concat("_s", "_p").alias("_key"))
    hits = possible(keys, listed, words).join(listed, (F.col("_key") == F.col("entry")) & (F.col("kind") == F.col("_kind"))).drop("_kind")
    rank = F.struct(F.length("entry"), F.col("entry"))
    best = lambda kind, c: F.max_by(F.when(F.col("kind") == kind, F.col(c)), F.when(F.col("kind") == kind, rank))
    found = hits.groupBy(*place).agg(best("rule", "entry").alias("rule"), best("rule", "action").alias("_by_rule"), best("listed", "action").alias("_by_list"))
    # Written first: so both sides of the join are dealt out anew, and the pages of one place can be split over tasks.
    out = judged.join(stored(found, "url-places"), place, "left")
    verdict = F.coalesce("_by_rule", "_by_list", F.lit(default))
    kept = [c for c in judged.columns if c not in ("path", *place)]
    return out.select(*kept, "host", "path", "rule", verdict.alias("verdict"))


def possible(keys: DataFrame, listed: DataFrame, words: int = BLOOM_WORDS) -> DataFrame:
    """The rows of ``keys`` (_key, kind) that the Bloom filter of ``listed`` lets pass, ``kind`` being ``_kind`` now."""
    word, mask = _bloom_columns(F.col("_key"), words)
    bloom = F.broadcast(build_bloom(listed, "entry", words))  # at most `words` rows of 16 bytes
    passed = keys.withColumns({"_w": word, "_m": mask}).join(bloom, F.col("_w") == F.col("bloom_word")).where(F.col("bloom_bits").bitwiseAND(F.col("_m")) == F.col("_m"))
    return passed.drop("_w", "_m", "bloom_word", "bloom_bits").withColumnRenamed("kind", "_kind")


#: Production lists: the given rules, hosts that are always listed, and names that get a crawl's hosts listed (fixed values).
RULES = [("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block")]
LISTED_HOSTS = ["ads-track.example.com", "free-bets.example.net", "cheap-pills.example.net", "spam-farm.example.org", "casino-win.example.net", "adult-x.example.com"]
UNWANTED = ["ads-track", "free-bets", "cheap-pills", "spam-farm", "casino-win", "adult-x"]
_UNWANTED = rf"(?:^|\.)((?:{'|'.join(UNWANTED)})\..*)$"


def production_entries(spark: SparkSession) -> DataFrame:
    rows = [(r, a, "rule") for r, a in RULES] + [(f"{h}/", "block", "listed") for h in LISTED_HOSTS]
    return spark.createDataFrame(rows, "entry string, action string, kind string")


def listed_hosts(pages: DataFrame, url: str = "url") -> DataFrame:
    """Entries for the domains of a crawl that have an unwanted name, from that name on."""
    host = pages.select(canonical_host(host_of(F.col(url))).alias("h")).distinct()
    found = host.select(F.regexp_extract("h", _UNWANTED, 1).alias("d")).where("d <> ''").distinct()
    return found.select(F.concat("d", F.lit("/")).alias("entry"), F.lit("block").alias("action"), F.lit("listed").alias("kind"))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    return filter_urls(pages, production_entries(spark).unionByName(listed_hosts(pages))).select("page_id", "host", "path", "rule", "verdict")


_VALUES = ", ".join(f"('{e}', '{a}', {k})" for e, a, k in [(r, a, 1) for r, a in RULES] + [(f"{h}/", "block", 0) for h in LISTED_HOSTS])

OP3_SQL = f"""
WITH judged AS (SELECT page_id, translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') AS host,
                       regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path FROM pages),
     places AS (SELECT host, path, rtrim(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), ':[0-9]*$', ''), '.') AS chost, regexp_replace(path, '/(\\.?/)+', '/', 'g') AS cpath FROM (SELECT DISTINCT host, path FROM judged)),
     entries(entry, action, is_rule) AS (VALUES {_VALUES} UNION SELECT DISTINCT regexp_extract(chost, '{_UNWANTED}', 1) || '/', 'block', 0 FROM places WHERE regexp_extract(chost, '{_UNWANTED}', 1) <> ''),
     cut AS (SELECT entry, action, is_rule, regexp_extract(entry, '^[^/]*') AS ehost, regexp_extract(entry, '^[^/]*(.*)$', 1) AS epath FROM entries),
     best AS (SELECT host, path,
                     arg_max(entry, length(entry)) FILTER (WHERE is_rule = 1) AS rule,
                     arg_max(action, length(entry)) FILTER (WHERE is_rule = 1) AS by_rule,
                     arg_max(action, length(entry)) FILTER (WHERE is_rule = 0) AS by_list
              FROM places JOIN cut ON CASE WHEN is_rule = 1 THEN (host = ehost OR ends_with(host, '.' || ehost)) AND starts_with(path, epath)
                                           ELSE (chost = ehost OR ends_with(chost, '.' || ehost)) AND starts_with(cpath, epath) END
              GROUP BY host, path)
SELECT page_id, host, path, rule, coalesce(by_rule, by_list, 'allow') AS verdict FROM judged LEFT JOIN best USING (host, path)
"""
