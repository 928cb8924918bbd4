"""From signal scores to explained pairs: renormalised total, guards, caps."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.operators.enrich import within_gap
from kinfold.operators.signals import Signal

DEFAULTS = {"min_total_score": 0.35, "min_signals": 2, "require_identity_signal": True, "max_pairs_per_predecessor": 10, "min_gap_days": None, "max_gap_days": None}


def contributions(signals: list[Signal], scores: list[Column]) -> Column:
    """Evaluable signals as structs: paths and numbers, never values."""
    one = [
        F.struct(
            F.lit(s.type).alias("signal_type"), F.lit(s.name).cast("string").alias("signal_name"), F.array(*[F.lit(f) for f in s.fields]).cast("array<string>").alias("fields"),
            F.lit(s.config.get("subfield")).cast("string").alias("subfield"), F.lit(s.weight).alias("weight"), c.alias("score"), (c * s.weight).alias("contribution"),
            F.lit(s.evidence_key).alias("evidence_key"), F.lit(s.identity).alias("identity"), F.lit(s.conclusive).alias("conclusive"),
        )
        for s, c in zip(signals, scores, strict=True)
    ]
    return F.filter(F.array(*one), lambda x: x["score"].isNotNull())


def total_score(weights: list[float], scores: list[Column]) -> Column:
    """Weighted mean over the evaluable scores; NULL if their weights add up to nothing."""
    add = lambda cols: reduce(lambda a, b: a + b, cols)
    weight = add([F.when(c.isNotNull(), F.lit(w)).otherwise(F.lit(0.0)) for w, c in zip(weights, scores, strict=True)])
    return F.when(weight > 0, add([F.coalesce(c * w, F.lit(0.0)) for w, c in zip(weights, scores, strict=True)]) / weight)


def guarded(pairs: DataFrame, rules: dict, conclusive: set[str], count_fired: bool = False) -> DataFrame:
    """Keep pairs that pass every guard. Needs ``evidence`` (contributions), ``total`` and ``gap_days``.

    ``min_signals`` counts distinct evidence among what could be evaluated (``count_fired``: among what fired).
    """
    rules = DEFAULTS | {k: v for k, v in rules.items() if v is not None}
    pairs = pairs.where(within_gap(F.col("gap_days"), rules["min_gap_days"], rules["max_gap_days"]))
    counted = F.filter("evidence", lambda x: x["score"] > 0) if count_fired else F.col("evidence")
    pairs = pairs.where(F.size(F.array_distinct(F.transform(counted, lambda x: x["evidence_key"]))) >= rules["min_signals"])
    if rules["require_identity_signal"]:
        pairs = pairs.where(F.exists("evidence", lambda x: x["identity"] & (x["score"] > 0)))
    fired = F.exists("evidence", lambda x: x["signal_type"].isin(sorted(conclusive)) & (x["score"] > 0)) if conclusive else F.lit(False)
    return pairs.where(F.col("total").isNotNull() & ((F.col("total") >= rules["min_total_score"]) | fired))


def described(pairs: DataFrame) -> DataFrame:
    """Add total_score, signals_present, matched_on and signals from ``evidence`` and ``total``."""
    fired = F.transform(F.filter("evidence", lambda x: x["score"] > 0), lambda x: x["signal_type"])
    plain = F.transform("evidence", lambda x: F.struct(*[x[c].alias(c) for c in ("signal_type", "signal_name", "fields", "subfield", "weight", "score", "contribution")]))
    return pairs.withColumns({"total_score": F.round("total", 6), "signals_present": F.size("evidence"), "matched_on": F.array_sort(F.array_distinct(fired)), "signals": plain})


def capped(pairs: DataFrame, left: str, right: str, most: int, rank: str | None = None) -> DataFrame:
    """The ``most`` best pairs of each left record (ties: candidate rank, then key), each ordered pair once."""
    order = [F.desc("total"), *([F.col(rank)] if rank else []), F.col(right)]
    best = pairs.withColumn("_n", F.row_number().over(Window.partitionBy(left).orderBy(*order))).where(F.col("_n") <= most).drop("_n")
    return best.dropDuplicates([left, right])


def undirected(pairs: DataFrame, left: str, right: str) -> DataFrame:
    """One of A->B and B->A, the better one, after the caps."""
    w = Window.partitionBy(F.least(left, right), F.greatest(left, right)).orderBy(F.desc("total"), left)
    return pairs.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")
