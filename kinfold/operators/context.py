"""Corpus statistics of a sweep: values too common to identify anyone, and how rare names are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.paths import read_values

DEFAULT_LIMIT = 5
MOST_SUPPRESSED = 2000


def value_rows(df: DataFrame, key: str, paths: list[str]) -> DataFrame:
    """(_rid, path, value): distinct raw values of each path of each record."""
    parts = [df.select(F.col(f"`{key}`").alias("_rid"), F.lit(p).alias("path"), F.explode(F.array_distinct(read_values(df, p))).alias("value")) for p in paths]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def limit_for(path: str, limits: dict[str, int], own: int | None = None) -> int:
    """The path's limit, else that of ``*``, else the signal's own, else 5."""
    return limits.get(path, limits.get("*", own if own is not None else DEFAULT_LIMIT))


def suppressed(rows: DataFrame, limits: dict[str, int], own: dict[str, int] | None = None, most: int | None = MOST_SUPPRESSED) -> DataFrame:
    """(path, value, records): values on more records than the path's limit; the ``most`` most common of each path."""
    own = own or {}
    counted = rows.groupBy("path", "value").agg(F.count("*").alias("records"))
    over = F.lit(False)
    for path in sorted({*limits, *own}):
        if path != "*":
            over = F.when(F.col("path") == path, F.col("records") > limit_for(path, limits, own.get(path))).otherwise(over)
    default = limit_for("", {k: v for k, v in limits.items() if k == "*"})
    named = [p for p in {*limits, *own} if p != "*"]
    hot = counted.where(F.when(F.col("path").isin(named), over).otherwise(F.col("records") > default) if named else F.col("records") > default)
    if most is None:
        return hot
    w = Window.partitionBy("path").orderBy(F.desc("records"), "value")
    return hot.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= most).drop("_n")


def rarity_table(rows: DataFrame, top: int | None = None) -> DataFrame:
    """(value, records, total, idf) of one path: idf = ln(total/records)/ln(total); 0 where total is under 2.

    Exact over all values; ``top`` keeps only so many of the most common (others then count as unseen: 1.0).
    """
    counted = rows.groupBy(F.lower(F.trim("value")).alias("value")).agg(F.count("*").alias("records"))
    if top is not None:
        counted = counted.orderBy(F.desc("records"), "value").limit(top)
    total = counted.agg(F.sum("records").alias("total"))
    return counted.join(F.broadcast(total)).withColumn("idf", normalised_idf(F.col("records"), F.col("total")))  # one row


def normalised_idf(records: Column, total: Column) -> Column:
    return F.when(total < 2, F.lit(0.0)).when(records.isNull() | (records <= 0), F.lit(1.0)).otherwise(F.log(total / records) / F.log(total))
