"""Mixing sources to target weights by a low-discrepancy schedule of equal-token blocks (DataFrame functions only).

The schedule has a power of two of slots, each worth ``width`` words (``BLOCK_WORDS`` at most). Slot j takes the j-th van
der Corput point; the source whose interval of cumulative targets holds the point owns the slot. A source's slots are
ranked in the schedule's order, and rank r is joined to the r-th block of ``width`` words of the source's shuffled line: its
documents in hash order, one after the other, repeated ``passes`` times. What a document gives to the mix is what the
slots of its blocks take, and nothing else: a source comes within two blocks of its target, and blocks beyond the last
pass are not there to be taken. ``first_slot`` is the slot that takes a document's words first (its place in the mix).

Defined cases: size is the number of words; null and empty texts have size 0 and are never taken; a null source is a
source of its own, after all others; rows are laid in the order of a hash of (doc_id, size, text), so reruns and other
row orders give equal results; null and repeated doc_ids are rows like any other, and rows equal in all of that can't be
told apart, so it doesn't matter which comes first; an empty table gives an empty result; clashing extra columns are
replaced.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.llm._ranking import buckets_for, prefix_sum
from kinfold.llm._store import stored

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5.0, 2.0, 1.0)
SHARE = 1.5
PASSES = 2
#: Words of a slot at most; more than half of it, but for mixes of few words.
BLOCK_WORDS = 96
#: Points of the line that one owner lookup compares.
CELL_BITS = 4


def sizes(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add size and, for the order of rows, a hash of the text."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.drop("size", "text_hash").withColumns({"size": F.regexp_count(body, F.lit(WORD)).cast("long"), "text_hash": F.xxhash64(body)})


def targets(rows: DataFrame, source: str = "source", weights=WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """One row per source: source_size, weight, target, and where its targets begin and end on the common line.

    Weights go to the sources by code point, null last, repeating. A target stops at ``passes`` times the source's
    size and the excess goes to the others by weight until none is above: with sources sorted by size/weight, the
    level at which the line is full is found by running sums.
    """
    by_source = rows.groupBy(source).agg(F.sum("size").alias("source_size"))
    order = Window.orderBy(F.col(source).isNull(), source)  # one row per source
    numbered = by_source.withColumn("_i", F.row_number().over(order) - 1)
    weight = F.element_at(F.lit(list(map(float, weights))), (F.col("_i") % len(weights) + 1).cast("int"))
    everywhere = Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    line = numbered.withColumn("weight", weight).withColumn("_cap", (F.col("source_size") * passes).cast("double")).withColumn("_want", F.sum("source_size").over(everywhere) * share)
    fill = Window.orderBy(F.col("_cap") / F.col("weight"), "_i")
    line = line.withColumn("_full", F.coalesce(F.sum("_cap").over(fill.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)))
    line = line.withColumn("_open", F.sum("weight").over(fill.rowsBetween(0, Window.unboundedFollowing)))
    level = (F.col("_want") - F.col("_full")) / F.col("_open")  # if all earlier ones are full and no other is
    # The right level is the first that fills no source; later ones count sources as full that are not, and are lower.
    line = line.withColumn("_level", F.when(level * F.col("weight") < F.col("_cap"), level))
    line = line.withColumn("_level", F.max("_level").over(everywhere))
    line = line.withColumn("target", F.least(F.col("_cap"), F.coalesce(F.col("_level"), F.lit(float("inf"))) * F.col("weight")))
    line = line.withColumn("_end", F.sum("target").over(Window.orderBy("_i").rowsBetween(Window.unboundedPreceding, 0)))
    line = line.withColumn("_begin", F.coalesce(F.lag("_end").over(Window.orderBy("_i")), F.lit(0.0)))
    return line.select(source, "source_size", "weight", "target", "_i", "_begin", "_end")


def van_der_corput(slot: Column, digits: int) -> Column:
    """The slot's point in base 2, as a multiple of 1/2^digits: its bits in reverse."""
    table = F.lit([int(f"{b:08b}"[::-1], 2) for b in range(256)]).cast("array<bigint>")
    octets = -(-digits // 8)
    out = None
    for j in range(octets):
        turned = F.element_at(table, (F.shiftrightunsigned(slot, 8 * j).bitwiseAND(F.lit(255)) + 1).cast("int"))
        part = F.shiftleft(turned, 8 * (octets - 1 - j))
        out = part if out is None else out.bitwiseOR(part)
    return F.shiftrightunsigned(out, 8 * octets - digits)


def schedule(spark: SparkSession, plan: DataFrame, digits: int, width: float, points=van_der_corput) -> DataFrame:
    """(slot, _i, rank): the owner of each of 2^digits slots, and the slot's rank among its owner's.

    Points are multiples of 1/2^digits, so an owner's interval is a range of whole numbers; where one ends the next begins.
    Ranges and points meet in cells of 2^CELL_BITS points, so a lookup compares few ranges whatever the number of sources.
    """
    last = plan.agg(F.max("_i")).first()[0]
    edge = lambda c: F.least(F.lit(1 << digits), F.greatest(F.lit(0), F.ceil(F.col(c) / width - 0.5))).cast("long")  # noqa: E731  the first point at or above
    ranges = plan.select("_i", edge("_begin").alias("_lo"), F.when(F.col("_i") == last, F.lit(1 << digits)).otherwise(edge("_end")).alias("_hi")).where("_lo < _hi")
    wide = max(CELL_BITS, digits // 2)
    ranges = ranges.withColumn("_wide", F.explode(F.sequence(F.shiftright("_lo", wide), F.shiftright(F.col("_hi") - 1, wide))))
    first = F.greatest(F.shiftright("_lo", CELL_BITS), F.shiftleft("_wide", wide - CELL_BITS))
    final = F.least(F.shiftright(F.col("_hi") - 1, CELL_BITS), F.shiftleft(F.col("_wide") + 1, wide - CELL_BITS) - 1)
    ranges = ranges.select("_i", "_lo", "_hi", F.explode(F.sequence(first, final)).alias("_cell"))
    slots = spark.range(1 << digits).select(F.col("id").alias("slot"), points(F.col("id"), digits).alias("_point")).withColumn("_cell", F.shiftright("_point", CELL_BITS))
    owned = slots.join(ranges.hint("merge"), "_cell").where("_point >= _lo and _point < _hi").select("slot", "_i")
    # Ranks in the schedule's order: counts of (source, stretch of slots) first, so that no source is in one place.
    dealt = owned.withColumn("_stretch", F.shiftright("slot", -(-digits // 2)))
    counted = dealt.groupBy("_i", "_stretch").agg(F.count("*").alias("_n"))
    before = Window.partitionBy("_i").orderBy("_stretch").rowsBetween(Window.unboundedPreceding, -1)
    counted = counted.select("_i", "_stretch", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    inside = F.row_number().over(Window.partitionBy("_i", "_stretch").orderBy("slot"))
    return dealt.withColumn("_in", inside).join(counted, ["_i", "_stretch"]).select("slot", "_i", (F.col("_base") + F.col("_in") - 1).alias("rank"))


def mix(rows: DataFrame, source: str = "source", order: tuple[str, ...] = ("doc_id", "size", "text_hash"), points=van_der_corput, **how) -> DataFrame:
    """Add source_size, target, taken and first_slot to rows that carry ``size``; of ``order``, columns that are there."""
    spark = rows.sparkSession
    rows = rows.drop("source_size", "target", "taken", "first_slot")
    passes = how.get("passes", PASSES)
    plan = stored(targets(rows, source, **how), "mix-targets")
    count, want = rows.count(), plan.agg(F.sum("target")).first()[0] or 0.0
    nothing = {"taken": F.lit(0).cast("long"), "first_slot": F.lit(None).cast("long")}
    if not want:  # no words at all
        return rows.withColumns({"source_size": F.lit(0).cast("long"), "target": F.lit(0.0)} | nothing)
    digits = max(1, math.ceil(math.log2(max(2.0, want / BLOCK_WORDS))))
    width = want / (1 << digits)
    slots = schedule(spark, plan, digits, width, points)

    # Documents on their source's line, in hash order; per pass, the blocks that hold their words.
    known = rows.join(plan.select(F.col(source).alias("_src"), "_i", "source_size", "target"), F.col(source).eqNullSafe(F.col("_src"))).drop("_src")
    laid = prefix_sum(known, "_i", [F.col(c) for c in order if c in rows.columns], F.col("size"), "_from", buckets_for(count))
    laid = stored(laid, "mix-line")
    again = laid.where("size > 0").select("_i", "_from", "size", "source_size", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))).alias("_pass"))
    again = again.select("_i", "_from", (F.col("_from") + F.col("_pass") * F.col("source_size")).alias("_a"), "size").withColumn("_z", F.col("_a") + F.col("size"))
    begin = lambda r: F.floor(r * F.lit(width))  # noqa: E731  where block r begins
    # The block of a word: rounding can be off by one, so one more on each side; those that hold none of it give 0.
    near = F.sequence(F.greatest(F.lit(0).cast("long"), F.floor(F.col("_a") / width) - 1), F.floor(F.col("_z") / width) + 1)
    pieces = again.select("_i", "_from", "_a", "_z", F.explode(near).alias("rank"))
    pieces = pieces.withColumn("_words", F.least(F.col("_z"), begin(F.col("rank") + 1)) - F.greatest(F.col("_a"), begin(F.col("rank")))).where("_words > 0")
    taken = pieces.join(slots, ["_i", "rank"]).groupBy("_i", "_from").agg(F.sum("_words").alias("taken"), F.min("slot").alias("first_slot"))  # (_i, _from) names a row of size > 0
    out = laid.withColumn("_pos", F.when(F.col("size") > 0, F.col("_from"))).join(taken.withColumnRenamed("_from", "_pos"), ["_i", "_pos"], "left")
    return out.withColumn("taken", F.coalesce("taken", F.lit(0)).cast("long")).drop("_i", "_pos", "_from")


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sizes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "source", "text")).drop("text")
    return mix(stored(docs, "mix-sizes")).select("doc_id", "size", "source_size", "target", "taken", "first_slot")
