"""Exclusive prefix sums inside groups of any size, dealt over many tasks."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def buckets_for(rows: int) -> int:
    """As many buckets as a bucket has rows: the rows of one bucket and the sums of all are both few."""
    return max(1, math.isqrt(rows))


def prefix_sum(df: DataFrame, group: str, order: list[Column], value: Column, out: str, buckets: int) -> DataFrame:
    """Add ``out``: the sum of ``value`` over the rows before this one in its group.

    Rows are dealt into ``buckets`` by the hash of ``order``; a group's order is (bucket, hash, order). Only the
    sums of (group, bucket) meet in one place, so a group that holds a third of all rows is spread like any other.
    """
    dealt = df.withColumn("_h", F.xxhash64(*order)).withColumn("_b", F.pmod("_h", F.lit(buckets)))
    sums = dealt.groupBy(group, "_b").agg(F.sum(value).alias("_s"))
    before = Window.partitionBy(group).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select(F.col(group).alias("_g"), F.col("_b").alias("_bb"), F.coalesce(F.sum("_s").over(before), F.lit(0)).alias("_base"))
    inside = Window.partitionBy(group, "_b").orderBy("_h", *order).rowsBetween(Window.unboundedPreceding, -1)
    summed = dealt.withColumn("_in", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    joined = summed.join(base, F.col(group).eqNullSafe(F.col("_g")) & (F.col("_b") == F.col("_bb")), "left")
    return joined.withColumn(out, (F.col("_in") + F.col("_base")).cast("long")).drop("_h", "_b", "_bb", "_g", "_in", "_base")
