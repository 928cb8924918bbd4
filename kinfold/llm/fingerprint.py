"""Document fingerprints from closed syncmers (DataFrame functions only).

Units are the words of the text (in scripts without spaces, their letters): of all k-unit windows those are anchors whose
least s-unit inner window, by hash, lies at the window's start or end. Whether a window is an anchor depends on nothing
outside it, so an edit elsewhere leaves it in place. The fingerprint is all anchors, each with its position. Texts are
matched by position: a link is two neighbouring anchors and their distance, and the likeness of two texts is the Jaccard
similarity of their links; ``passages`` joins anchors of documents and lines them up by offset.

Defined cases: a null text counts as empty; a text without words has the empty fingerprint, and equal fingerprints have
likeness 1; a text without an anchor (always one of fewer than k units) has one, all of it; repeated rows get equal
fingerprints; for the next document rows are ordered by (doc_id, hash of the text), a null doc_id first; a very long text has
as many anchors as it needs; an empty table gives an empty result; clashing extra columns are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

K, S = 6, 2
#: White space between units, and every place beside a letter of a script without spaces.
_UNSPACED = r"[\p{IsHan}\p{IsHiragana}\p{IsKatakana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}]"
SPLIT = rf"[\x20\x09-\x0D]+|(?={_UNSPACED})|(?<={_UNSPACED})"
SPACED = r"[\x20\x09-\x0D]+"
ROWS_PER_STRETCH = 500
KNOTS = 256
BROADCAST_ROWS = 100_000


def units(text: Column) -> Column:
    spaced = F.split(text, SPACED)
    return F.array_remove(F.when(text.rlike(_UNSPACED), F.split(text, SPLIT)).otherwise(spaced), "")


def with_anchors(df: DataFrame, text: str, out: str, k: int = K, s: int = S) -> DataFrame:
    """Add ``out``: array of the anchors' 64-bit hashes in text order, with repeats, and ``out_pos``: their first units, from 1."""
    h, sm, span = f"_{out}_h", f"_{out}_s", k - s
    n = F.size(F.col(h))
    df = df.withColumn(h, F.transform(units(F.col(text)), lambda w: F.xxhash64(w)))
    shifted = [F.slice(F.col(h), j + 1, n - s + 1) for j in range(s)]
    inner = F.zip_with(*shifted, lambda a, b: F.xxhash64(a, b)) if s == 2 else F.transform(F.sequence(F.lit(1), n - s + 1), lambda i: F.xxhash64(*[F.get(F.col(h), i + j - 1) for j in range(s)]))
    df = df.withColumn(sm, F.when(n >= k, inner))
    at = lambda i: F.get(F.col(sm), i)
    between = lambda i: [at(i + j) for j in range(span)]  # noqa: E731  i counts from 1, so these are the inner ones but the first
    edge = lambda i: F.least(at(i - 1), at(i + (span - 1)))
    chosen = F.filter(F.sequence(F.lit(1), n - k + 1), lambda i: edge(i) <= F.least(*between(i)))
    df = df.withColumn(f"{out}_pos", F.when(n >= k, chosen))
    hashed = F.transform(F.col(f"{out}_pos"), lambda i: F.xxhash64(F.slice(F.col(h), i, k)))
    some, pos = F.size(f"{out}_pos") > 0, F.col(f"{out}_pos")
    whole = lambda value, kind: F.when(n > 0, F.array(value)).otherwise(F.array().cast(f"array<{kind}>"))
    df = df.withColumn(out, F.when(some, hashed).otherwise(whole(F.xxhash64(F.col(h)), "bigint")))
    return df.withColumn(f"{out}_pos", F.when(some, pos).otherwise(whole(F.lit(1), "int"))).drop(h, sm)


def links(anchors: str) -> Column:
    """The distinct links of anchors in ``anchors`` and ``<anchors>_pos``: two neighbours and how far apart they are; a lone anchor is its own."""
    a, p = F.col(anchors), F.col(f"{anchors}_pos")
    n = F.size(a)
    both = F.zip_with(F.slice(a, 1, n - 1), F.slice(a, 2, n - 1), lambda x, y: F.xxhash64(x, y))
    gaps = F.zip_with(F.slice(p, 1, n - 1), F.slice(p, 2, n - 1), lambda x, y: y - x)
    return F.when(n > 1, F.array_distinct(F.zip_with(both, gaps, lambda b, g: F.xxhash64(b, g)))).otherwise(a)


def as_text(anchors: str) -> Column:
    """``positions|hashes``; empty for none."""
    joined = lambda c: F.array_join(F.col(c).cast("array<string>"), " ")
    return F.when(F.size(anchors) > 0, F.concat(joined(f"{anchors}_pos"), F.lit("|"), joined(anchors))).otherwise("")


def likeness(a: Column, b: Column) -> Column:
    """Jaccard similarity of two arrays of distinct links."""
    both = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) == 0) & (F.size(b) == 0), F.lit(1.0)).otherwise(both / (F.size(a) + F.size(b) - both))


def passages(queries: DataFrame, docs: DataFrame, least: int = 2) -> DataFrame:
    """(query_id, doc_id, offset, anchors, first, last): passages of ``queries`` in other documents of ``docs`` (both doc_id, text).

    Anchors are joined by hash; those of one pair at one offset are a passage, given by its units' places in the query.
    Pairs of rows with ``least`` anchors or more come out; queries are meant to be a set much smaller than ``docs``.
    """
    each = lambda df, key, at: with_anchors(df.select(F.col("doc_id").alias(key), F.coalesce("text", F.lit("")).alias("text")), "text", "a").select(key, F.explode(F.arrays_zip("a", "a_pos")).alias("z")).select(key, F.col("z.a").alias("anchor"), F.col("z.a_pos").alias(at))
    met = each(queries, "query_id", "_q").join(each(docs, "doc_id", "_d"), "anchor").where("query_id <> doc_id")
    found = met.groupBy("query_id", "doc_id", (F.col("_d") - F.col("_q")).alias("offset")).agg(F.count_distinct("_q").alias("anchors"), F.min("_q").alias("first"), (F.max("_q") + K - 1).alias("last"))
    return found.where(F.col("anchors") >= least)


def _stretch(rows: DataFrame, key: str, tie: str) -> tuple[Column, int, int]:
    """A number of stretches of the order (key, tie), a null key first, of about as many rows each; least and greatest number.

    Quantiles of the key cut it into regions, regions are cut into equal widths; a key that fills a region or more by itself is
    cut by ``tie``, a 64-bit hash.
    """
    probabilities = [i / KNOTS for i in range(KNOTS + 1)]
    lo, hi, n, some, knots = rows.agg(F.min(key), F.max(key), F.count("*"), F.count(key), F.percentile_approx(key, probabilities)).first()
    parts = max(1, -(-some // (KNOTS * ROWS_PER_STRETCH)))
    values = sorted([lo, hi, *knots[1:-1]]) if some else []
    regions: list[tuple[int, int, int, bool]] = []  # first key, width, stretches, cut by the tie
    for i, v in enumerate(values):
        if i and values[i - 1] == v:
            continue
        times, after = values.count(v), next((x for x in values[i:] if x > v), v + 1)
        if times > 1:
            regions.append((v, 1, times * parts, True))
            if after > v + 1:
                regions.append((v + 1, after - v - 1, parts, False))
        else:
            regions.append((v, after - v, parts, False))
    spread = lambda count: F.least(F.floor((F.col(tie).cast("double") / 2.0**64 + 0.5) * count), count - 1).cast("long")
    nulls = -(-(n - some) // ROWS_PER_STRETCH)
    of_null = spread(F.lit(max(1, nulls))) - nulls
    if not regions:
        return of_null, -nulls, -1
    base = [0]
    for r in regions:
        base.append(base[-1] + r[2])
    which = F.size(F.filter(F.lit([r[0] for r in regions]).cast("array<bigint>"), lambda x: x <= F.col(key)))
    of = lambda values, kind: F.element_at(F.lit(values).cast(f"array<{kind}>"), which)
    count = of([r[2] for r in regions], "bigint")
    even = F.floor((F.col(key) - of([r[0] for r in regions], "bigint")).cast("double") / of([r[1] for r in regions], "double") * count)
    inside = F.when(of([r[3] for r in regions], "boolean"), spread(count)).otherwise(F.least(F.greatest(even, F.lit(0)), count - 1))
    return F.when(F.col(key).isNull(), of_null).otherwise(of(base[:-1], "bigint") + inside).cast("long"), -nulls, base[-1] - 1


def with_next(rows: DataFrame, key: str, order: list[str], carry: list[str], prepare=None, prepared: list[str] = ()) -> DataFrame:
    """Add next_<c> for each column c of ``carry``: its value in the next row by (key, hash of ``order``), the last's being the first's.

    Rows are dealt into stretches of that order; the first row of each stretch also goes, as a guest, to the stretch before,
    so one window over stretches is enough. Firsts of stretches are ordered in two levels. ``prepare`` adds the columns
    ``prepared``, carried too, after rows were dealt out, so that they needn't travel.
    """
    tie = F.xxhash64(*order)
    rows = rows.withColumn("_tie", tie)
    stretch, least, most = _stretch(rows, key, "_tie")
    dealt = rows.withColumn("_b", stretch)
    firsts = dealt.groupBy("_b").agg(F.min(F.struct(F.col(key).isNotNull(), F.col(key), "_tie")).alias("_f"))
    firsts = firsts.select("_b", F.col("_f").getField(key).alias("_first"), F.col("_f._tie").alias("_ft"), F.floor(F.col("_b") / 1000).alias("_c"))
    heads = firsts.groupBy("_c").agg(F.max("_b").alias("_last")).withColumn("_before", F.lag("_last").over(Window.orderBy("_c")))
    end = firsts.agg(F.max("_b")).first()[0]
    before = firsts.withColumn("_p", F.lag("_b").over(Window.partitionBy("_c").orderBy("_b"))).join(heads.drop("_last"), "_c")
    before = before.select(F.col("_b").alias("_fb"), "_first", "_ft", F.coalesce("_p", "_before", F.lit(end)).alias("_to"))
    before = F.broadcast(before) if most - least < BROADCAST_ROWS else before  # 32 bytes a stretch
    guests = dealt.join(before, (F.col("_b") == F.col("_fb")) & F.col(key).eqNullSafe(F.col("_first")) & (F.col("_tie") == F.col("_ft")))
    guests = guests.withColumn("_wrap", F.when(F.col("_to") >= F.col("_b"), 2).otherwise(1)).dropDuplicates(["_b"])  # rows equal in key and tie are equal in what is carried
    guests = guests.withColumn("_b", F.col("_to")).drop("_fb", "_first", "_ft", "_to")
    both = dealt.withColumn("_wrap", F.lit(0)).unionByName(guests).repartition("_b")
    both = prepare(both) if prepare else both
    w = Window.partitionBy("_b").orderBy("_wrap", F.col(key).asc_nulls_first(), "_tie")
    led = both.withColumns({f"next_{c}": F.lead(c).over(w) for c in [*carry, *prepared]})
    return led.where("_wrap = 0").drop("_b", "_wrap", "_tie")


def op5_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    own = lambda df: with_anchors(df, "text", "a").withColumn("links", links("a")).withColumn("fingerprint", as_text("a")).drop("a", "a_pos")
    docs = with_next(docs, "doc_id", ["text"], ["text"], own, ["links"])
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.length("text") - half), F.substring(F.col("next_text"), F.lit(1), half))
    docs = docs.select("doc_id", F.length("text").cast("long").alias("n_chars"), edited.alias("edited"), "fingerprint", "links", "next_links")
    docs = with_anchors(docs, "edited", "e").withColumn("edited_links", links("e"))
    return docs.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), "fingerprint", as_text("e").alias("edited_fingerprint"),
        likeness(F.col("links"), F.col("edited_links")).alias("near_edited"), likeness(F.col("links"), F.col("next_links")).alias("near_next"),
    )
