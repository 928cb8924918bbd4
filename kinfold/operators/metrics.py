"""Declarative metrics over pairs in one aggregation, comparison of two records, and id-set differences."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.operators.signals import IDENTITY

SIDES = (("predecessor", "successor"), ("left", "right"))


def _sides(df: DataFrame) -> tuple[str, str]:
    for pair in SIDES:
        if set(pair) <= set(df.columns):
            return pair
    raise ValueError("pairs have neither predecessor/successor nor left/right")


def _matched(c: list[str]) -> Column:
    return F.array(*[F.lit(x) for x in sorted(set(c))]).cast("array<string>")


def _set_of(c: Column) -> Column:
    return F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))


def compile_predicate(df: DataFrame, predicate: dict | None) -> Column:
    """A boolean Column that is never NULL: an unknown value matches nothing, and ``not`` turns that round."""
    if not predicate:
        return F.lit(True)
    if len(predicate) != 1:
        raise ValueError(f"a predicate has one key, found {sorted(predicate)}")
    (kind, arg), = predicate.items()
    score, gap = F.coalesce(F.col("total_score"), F.lit(0.0)), F.col("gap_days") if "gap_days" in df.columns else F.lit(None).cast("int")

    def fields_equal(name: str) -> Column:
        a, b = _sides(df)
        return F.col(a).getField(name) == F.col(b).getField(name)

    leaf = {
        "score_gte": lambda: score >= arg,
        "score_lt": lambda: score < arg,
        "gap_between": lambda: gap.between(arg[0], arg[1]),
        "gap_lte": lambda: gap <= arg,
        "gap_gte": lambda: gap >= arg,
        "has_signal_type": lambda: F.arrays_overlap(_set_of(F.col("matched_on")), _matched(arg)),
        "matched_on_equals": lambda: _set_of(F.col("matched_on")) == _matched(arg),
        "matched_identity_equals": lambda: F.array_sort(F.array_intersect(_set_of(F.col("matched_on")), _matched(list(IDENTITY)))) == _matched(arg),
        "fields_equal": lambda: fields_equal(arg),
        "signal_count_gte": lambda: F.size("signals") >= arg,
    }
    if kind in leaf:
        return F.coalesce(leaf[kind](), F.lit(False))
    if kind in ("all", "any"):
        parts = [compile_predicate(df, p) for p in arg]
        return reduce(lambda a, b: (a & b) if kind == "all" else (a | b), parts)
    if kind == "not":
        return ~compile_predicate(df, arg)
    raise ValueError(f"unknown predicate {kind!r}")


def run_metrics(pairs: DataFrame, metrics: list[dict], by: str | None = None) -> DataFrame:
    """One row with every metric: counts and distinct counts in one pass, ratios (of any other metric) after it.

    ``by`` names a column (a run, say): then there is one row for each of its values, all from the same pass.
    """
    names = [m["name"] for m in metrics]
    if len(set(names)) < len(names):
        raise ValueError("metric names must be unique")
    base, ratios = [], {}
    for m in metrics:
        if "ratio" in m:
            ratios[m["name"]] = m["ratio"]
            continue
        test = compile_predicate(pairs, m.get("filter"))
        if "distinct" in m:
            a, _, b = m["distinct"].partition(".")
            value = F.col(a).getField(b) if b else F.col(a)
            base.append(F.count_distinct(F.when(test, value)).alias(m["name"]))
        else:
            base.append(F.count_if(test).alias(m["name"]))
    row = pairs.groupBy(by).agg(*base) if by else pairs.agg(*base)
    for name, r in ratios.items():
        for part in (r["numerator"], r["denominator"]):
            if part not in names:
                raise ValueError(f"{name}: no metric {part!r}")
    done: set[str] = set(names) - set(ratios)
    while ratios.keys() - done:
        ready = [n for n in ratios if n not in done and {ratios[n]["numerator"], ratios[n]["denominator"]} <= done]
        if not ready:
            raise ValueError(f"ratios depend on each other: {sorted(ratios.keys() - done)}")
        row = row.withColumns({n: F.coalesce(F.try_divide(F.col(ratios[n]["numerator"]).cast("double"), F.col(ratios[n]["denominator"])), F.lit(0.0)) for n in ready})
        done |= set(ready)
    return row.select(*([by] if by else []), *names)


def records_by(pairs: DataFrame, metrics: list[dict], by: str) -> dict[str, DataFrame]:
    """The one-row record of each of the (few) values of ``by``."""
    found = run_metrics(pairs, metrics, by)
    names = [c for c in found.columns if c != by]
    rows = {r[by]: r for r in found.collect()}
    kinds = found.select(*names).schema
    return {k: pairs.sparkSession.createDataFrame([tuple(r[n] for n in names)], kinds) for k, r in rows.items()}


def long_form(record: DataFrame) -> DataFrame:
    """(metric, value) of a one-row record."""
    return record.select(*[F.col(c).cast("double").alias(c) for c in record.columns]).unpivot([], record.columns, "metric", "value")


RULES = ("must_not_fall", "must_not_rise", "within_10pct", "informational")


def compare_records(baseline: DataFrame, candidate: DataFrame, expectations: dict[str, str]) -> DataFrame:
    """(metric, baseline, candidate, delta, expectation, regressed); ``within_10pct`` bounds falls only."""
    unknown = set(expectations.values()) - set(RULES)
    if unknown:
        raise ValueError(f"unknown expectations {sorted(unknown)}")
    both = long_form(baseline).withColumnRenamed("value", "baseline").join(long_form(candidate).withColumnRenamed("value", "candidate"), "metric", "full")
    rule = F.lit(None).cast("string")
    for name, kind in expectations.items():
        rule = F.when(F.col("metric") == name, F.lit(kind)).otherwise(rule)
    a, b = F.col("baseline"), F.col("candidate")
    worse = F.when(F.col("expectation") == "must_not_fall", b < a).when(F.col("expectation") == "must_not_rise", b > a).when(F.col("expectation") == "within_10pct", (a != 0) & (b < a * 0.9)).otherwise(F.lit(False))
    return both.withColumn("delta", b - a).withColumn("expectation", rule).withColumn("regressed", F.coalesce(worse, F.lit(False)))


def exit_code(comparison: DataFrame) -> int:
    return int(not comparison.where("regressed").isEmpty())


def id_difference(baseline: DataFrame, candidate: DataFrame, key: str) -> DataFrame:
    """(key, side): ids in one set only."""
    a, b = baseline.select(key).distinct(), candidate.select(key).distinct()
    return a.join(b, key, "left_anti").withColumn("side", F.lit("baseline_only")).unionByName(b.join(a, key, "left_anti").withColumn("side", F.lit("candidate_only")))


def sweep_ceilings(stats: DataFrame, most: float = 0.10) -> None:
    """Raise where the share of failed lookups or scores (one row: lookups_failed, lookups, scores_failed, scores) reaches ``most``."""
    row = stats.first()
    for bad, all_ in (("lookups_failed", "lookups"), ("scores_failed", "scores")):
        if row[all_] and row[bad] / row[all_] >= most:
            raise RuntimeError(f"{row[bad]} of {row[all_]} {all_} failed")
