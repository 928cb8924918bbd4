"""Benchmark decontamination by template canonicalisation (DataFrame functions only).

Numbers, names (runs of capitalised words, at the beginning of a sentence too) and units become typed placeholders,
everything else is lower-cased and cut into words. Windows of ``WINDOW`` places of the benchmark items' templates are
hash-joined with those of the documents. Where a joined window has placeholders, the values behind them are compared: a
re-parameterised copy puts one value for each value of the item, everywhere (different values may become the same one, and a
name may become a longer or shorter one). Windows with the item's own values always count; windows with other values count where the
whole copy (document, item, offset) is free of contradiction. Windows with fewer than ``LITERALS`` plain words would fit too
much as templates and are left out of these. Beside the templates, windows of the words as they are (lower-cased) are joined
too, so verbatim copies are found whatever their capitals, names and figures.

A document holds an item if, of the item's windows of either kind, ``COVERAGE`` or ``RUN`` (whichever is fewer, one at least) are
found consistently. An item shorter than a window is one window of its own length. ``windows`` and ``item_windows`` are those of the
words where these suffice, else those of the templates.

Defined cases: null and empty texts hold nothing; repeated rows of a doc_id count once, and of different texts under one doc_id
each is judged alone; a null doc_id is never reported; a very long text is one row, with as many windows as words; empty tables
give an empty result; equal items are all reported; clashing extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._store import stored

WINDOW, LITERALS, COVERAGE, RUN = 8, 3, 0.5, 6
BROADCAST_ROWS = 500_000

#: Marks of the typed placeholders and of a number's end, from the private use area (fixed values).
NAME, NUMBER, UNIT, END = "\ue000", "\ue001", "\ue002", "\ue003"
MARKS = NAME + NUMBER + UNIT + END

# A look back that comes after the first letter is tried at letters of its kind only.
_NAME, _WHOLE = r"\p{Lu}\p{Ll}{1,60}+", r"(?![\p{L}\p{N}])"
_FIRST = r"\p{Lu}(?<![\p{L}\p{N}].)\p{Ll}{1,60}+" + _WHOLE
# Possessive, as a greedy group takes a stack frame for each round: a run of a thousand names ended the executor.
_NAMES, _JOINED = (f"{_FIRST}(?:{gap}{_NAME}{_WHOLE})*+" for gap in " _")
_NUMBERS = r"\p{N}(?<![\p{L}\p{N}" + NAME + r"].)\p{N}*+(?:[.,]\p{N}++)*+"
_UNITS = (
    "km/h", "kg", "mg", "lbs?", "km", "cm", "mm", "ml", "miles?", "met(?:er|re)s?", "feet", "foot", "inch(?:es)?", "yards?", "lit(?:er|re)s?", "gallons?", "grams?",
    "hours?", "minutes?", "seconds?", "days?", "weeks?", "months?", "years?", "dollars?", "euros?", "cents?", "percent", "degrees?", "[gmhsl]", "%", "€",
)
_NO_WORD = r"[^\p{L}\p{N}]+"


def plain_words(text: Column) -> Column:
    """The words as they are, lower-cased."""
    return F.array_remove(F.split(F.lower(F.coalesce(text, F.lit(""))), _NO_WORD), "")


def template(text: Column, values: bool = False) -> Column:
    """The places of the text's template; with ``values``, placeholders are followed by what they stand for (words of a name joined by ``_``)."""
    own, end = ("$0", END) if values else ("", "")
    clean = F.translate(F.coalesce(text, F.lit("")), MARKS + "_", " " * 5)
    if values:  # names of several words are joined first, as later steps cut at blanks
        clean = F.regexp_replace(clean, rf"(?<=(?<![\p{{L}}\p{{N}}])\p{{Lu}}\p{{Ll}}{{1,60}}) (?={_NAME}{_WHOLE})", "_")
    named = F.regexp_replace(clean, _JOINED if values else _NAMES, NAME + own)
    numbered = F.regexp_replace(F.lower(named), _NUMBERS, NUMBER + own + end + " ")
    after = "(" + (END if values else NUMBER) + " {0,2})(" + "|".join(_UNITS) + ")" + _WHOLE
    units = F.regexp_replace(numbered, after, "$1 " + UNIT + ("$2" if values else "") + " ")
    if values:
        units = F.regexp_replace(units, r"(?<=\p{N})[.,](?=\p{N})|(?<=" + UNIT + r"km)/(?=h)", "_")
    cut = r"[^\p{L}\p{N}" + NAME + NUMBER + UNIT + ("_" if values else "") + "]+"
    return F.array_remove(F.split(units, cut), "")


def with_hashes(df: DataFrame, words: str, seed: int, lengths: list[int], out: str) -> DataFrame:
    """Add arrays ``<out><n>`` of the hashes of all windows of n words, put together from windows of powers of two.

    Every step is a column of its own, as expressions that are used twice would be computed twice.
    """
    df, made = df.withColumn(f"_{out}p1", F.transform(words, lambda w: F.xxhash64(F.lit(seed), w))), [f"_{out}p1"]

    def pair(df: DataFrame, left: str, right: str, skip: int, name: str) -> DataFrame:
        """Hashes of ``left`` together with those of ``right`` that begin ``skip`` words later."""
        n = F.greatest(F.size(right) - skip, F.lit(0))
        made.append(name)
        return df.withColumn(name, F.zip_with(F.slice(left, 1, n), F.slice(right, skip + 1, n), lambda x, y: F.xxhash64(x, y)))

    p = 1
    while 2 * p <= max(lengths):
        df = pair(df, f"_{out}p{p}", f"_{out}p{p}", p, f"_{out}p{2 * p}")
        p *= 2
    for n in lengths:
        parts = [q for q in (1 << i for i in reversed(range(p.bit_length()))) if n & q]
        have, column = parts[0], f"_{out}p{parts[0]}"
        for q in parts[1:]:
            df = pair(df, column, f"_{out}p{q}", have, f"_{out}j{n}_{q}")
            have, column = have + q, f"_{out}j{n}_{q}"
        df = df.withColumn(f"{out}{n}", F.col(column))
    return df.drop(*made)


def with_windows(df: DataFrame, words: dict[int, str], kinds: list[tuple[int, int]], keep: list[str]) -> DataFrame:
    """One row per window: ``keep``, idx, window_hash, and as ``_b<j>`` where the windows of ``kinds[j]`` (kind, length) begin in idx.

    ``words`` names the array column of each kind. Windows of all kinds and lengths come from one pass over the texts.
    """
    for kind in sorted({k for k, _ in kinds}):
        df = with_hashes(df, words[kind], kind, [n for k, n in kinds if k == kind], f"_a{kind}_")
    begin, starts = F.lit(0), []
    for j, (kind, n) in enumerate(kinds):
        starts.append(begin.alias(f"_b{j}"))
        begin = begin + F.size(f"_a{kind}_{n}")
    return df.select(*keep, *starts, F.posexplode(F.concat(*[F.col(f"_a{k}_{n}") for k, n in kinds])).alias("idx", "window_hash"))


def _small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast what is known to have few rows; larger tables are joined by shuffle."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def _is_slot(word: Column) -> Column:
    return F.substring(word, 1, 1).isin(NAME, NUMBER, UNIT)


def put(item: Column, doc: Column) -> Column:
    """What a document puts for the item's value behind a placeholder: (item's, document's) pairs; of names word for word.

    Of names of different lengths the first words that only one of them has are a pair.
    """
    a, b = F.split(F.substring(item, 2, 1 << 30), "_"), F.split(F.substring(doc, 2, 1 << 30), "_")
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("i"), y.alias("d")))
    rest_a, rest_b = F.array_except(a, b), F.array_except(b, a)
    none = F.array().cast("array<struct<i:string,d:string>>")
    uneven = F.when((F.size(rest_a) > 0) & (F.size(rest_b) > 0), F.array(F.struct(F.get(rest_a, 0).alias("i"), F.get(rest_b, 0).alias("d")))).otherwise(none)
    whole = F.array(F.struct(item.alias("i"), doc.alias("d")))
    return F.when(F.substring(item, 1, 1) != NAME, whole).when(F.size(a) == F.size(b), pairs).otherwise(uneven)


def contaminated(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, coverage: float = COVERAGE, run: int = RUN) -> DataFrame:
    """(doc_id, item_id, windows, item_windows, reparameterised) for every item that a document holds."""
    text = F.col("text")
    words = {0: "_w", 1: "_t"}
    items = benchmark.select("item_id", text).where("item_id is not null").distinct()
    items = items.select("item_id", plain_words(text).alias("_w"), template(text).alias("_t"), template(text, True).alias("_v"))
    cut = []
    for kind, column in words.items():
        n, at = F.size(column), F.col("item_pos")
        own = items.where(n > 0).select("item_id", "_v", F.col(column).alias("_own"), F.least(n, F.lit(window)).alias("length"), F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), n - window + 1))).alias("item_pos"))
        own = own.select("item_id", F.lit(kind).alias("kind"), "item_pos", "length", F.slice("_own", at, F.col("length")).alias("_own"), (F.slice("_v", at, F.col("length")) if kind else F.lit(None).cast("array<string>")).alias("item_values"))
        if kind:
            plain = F.size(F.filter("_own", lambda w: ~_is_slot(w)))
            own = own.where(plain >= F.least(F.lit(LITERALS), F.col("length"))).withColumn("slots", plain < F.col("length"))
        cut.append(own if kind else own.withColumn("slots", F.lit(False)))
    cut = stored(cut[0].unionByName(cut[1]), "decon-cut")
    kinds = sorted((r[0], r[1]) for r in cut.select("kind", "length").distinct().collect())  # `window` and the few lengths below it, of two kinds
    if not kinds:
        return docs.sparkSession.createDataFrame([], "doc_id long, item_id long, windows long, item_windows long, reparameterised boolean")
    hashed = None
    for kind, n in kinds:
        one = with_hashes(cut.where((F.col("kind") == kind) & (F.col("length") == n)), "_own", kind, [n], "_h").withColumn("window_hash", F.get(f"_h{n}", 0)).drop(f"_h{n}")
        hashed = one if hashed is None else hashed.unionByName(one)
    cut = stored(hashed.drop("_own"), "decon-items")
    rows = cut.count()
    needed = cut.groupBy("item_id", "kind").agg(F.count_distinct("item_pos").alias("item_windows"))

    # One pass over the documents; a text is told apart from others of its doc_id by its hash.
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("_row"), "text")
    found = texts.select("doc_id", "_row", plain_words(text).alias("_w"), template(text).alias("_t"))
    found = with_windows(found, words, kinds, ["doc_id", "_row"])
    keys = cut.select("item_id", "kind", "length", "item_pos", "window_hash", "slots")
    begin = F.lit(0)
    for j, (kind, n) in enumerate(kinds):
        begin = F.when((F.col("kind") == kind) & (F.col("length") == n), F.col(f"_b{j}")).otherwise(begin)
    hits = found.join(_small(keys, rows), "window_hash").select("doc_id", "_row", "item_id", "kind", "length", "item_pos", (F.col("idx") - begin + 1).alias("pos"), "slots")
    hits = stored(hits.distinct(), "decon-hits")

    # Values behind the placeholders, for the few windows that have any.
    slotted = hits.where("slots")
    count = slotted.select("doc_id", "_row").distinct().count()
    sure = hits.where(~F.col("slots")).select("doc_id", "_row", "item_id", "kind", "item_pos", F.lit(False).alias("changed"))
    if count:
        owners = texts.join(_small(slotted.select("doc_id", "_row").distinct(), count), ["doc_id", "_row"], "left_semi").dropDuplicates(["doc_id", "_row"])
        owners = owners.select("doc_id", "_row", template(text, True).alias("_v"))
        pairs = slotted.join(owners, ["doc_id", "_row"]).join(_small(cut.where("slots").select("item_id", "item_pos", "item_values").distinct(), rows), ["item_id", "item_pos"])
        zipped = F.filter(F.arrays_zip(F.col("item_values").alias("i"), F.slice("_v", F.col("pos"), F.col("length")).alias("d")), lambda x: _is_slot(x["i"]))
        pairs = pairs.select("doc_id", "_row", "item_id", "kind", "item_pos", (F.col("pos") - F.col("item_pos")).alias("_off"), zipped.alias("_z"))
        pairs = stored(pairs.withColumn("changed", F.exists("_z", lambda x: x["i"] != x["d"])), "decon-slots")
        # A copy is where item and document run in step: its offset. One value for each value of the item.
        copy = ["doc_id", "_row", "item_id", "_off"]
        each = pairs.select(*copy, F.explode(F.flatten(F.transform("_z", lambda x: put(x["i"], x["d"])))).alias("z")).select(*copy, "z.i", "z.d").distinct()
        bad = each.groupBy(*copy, "i").agg(F.count("*").alias("_k")).where("_k > 1").select(*copy).distinct()
        kept = pairs.where("changed").join(bad, copy, "left_anti")
        sure = sure.unionByName(pairs.where("not changed").unionByName(kept).select("doc_id", "_row", "item_id", "kind", "item_pos", "changed"))
    held = sure.groupBy("doc_id", "_row", "item_id", "kind").agg(F.count_distinct("item_pos").alias("windows"), F.max("changed").alias("changed"))
    held = held.join(_small(needed, rows), ["item_id", "kind"])
    enough = F.greatest(F.lit(1), F.least(F.lit(run), F.ceil(F.col("item_windows") * coverage)))
    held = held.where(F.col("windows") >= enough).withColumn("_best", F.struct(-F.col("kind"), "windows", "item_windows", "changed"))
    best = held.groupBy("doc_id", "item_id").agg(F.max("_best").alias("_best"), F.min("kind").alias("_kind"), F.max("changed").alias("_changed"))
    return best.select("doc_id", "item_id", "_best.windows", "_best.item_windows", "_changed").withColumnRenamed("_changed", "reparameterised")


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
