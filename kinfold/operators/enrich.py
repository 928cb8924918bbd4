"""Capped nested lookup joins, several levels deep."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class LookupPolicy:
    """Rows of ``source`` by ``match_field``, of which ``fields`` are nested; ``order`` decides which fit under a cap."""

    name: str
    source: str
    match_field: str
    fields: tuple[str, ...]
    order: tuple[str, ...] = field(default=())

    def drift(self, stored: dict) -> list[str]:
        """What differs from the policy a snapshot was built by."""
        own = {"source": self.source, "match_field": self.match_field, "fields": list(self.fields)}
        return [k for k, v in own.items() if stored.get(k) != v]


def build_lookup(source: DataFrame, policy: LookupPolicy, max_matches: int) -> DataFrame:
    """(key, matches): at most ``max_matches`` rows per key as an array of structs, in the policy's order.

    Keys compare as their rendered text. The cap is applied by a ranking window whose partial limit runs before the
    shuffle, so a hot key sends at most ``max_matches`` rows per task.
    """
    order = [F.col(f"`{c}`") for c in (policy.order or policy.fields)]
    key = F.col(f"`{policy.match_field}`").cast("string")
    rows = source.where(key.isNotNull()).select(key.alias("_key"), F.struct(*[F.col(f"`{c}`") for c in policy.fields]).alias("_row"), F.struct(*order).alias("_order"))
    ranked = rows.withColumn("_n", F.row_number().over(Window.partitionBy("_key").orderBy("_order"))).where(F.col("_n") <= max_matches)
    packed = ranked.groupBy("_key").agg(F.sort_array(F.collect_list(F.struct("_n", "_row"))).alias("_m"))
    return packed.select("_key", F.transform("_m", lambda x: x["_row"]).alias("matches"))


def lookup_counts(source: DataFrame, policy: LookupPolicy) -> DataFrame:
    """One row (documents, with_key, keys): the source's rows, those that have a key, and the distinct keys."""
    key = F.col(f"`{policy.match_field}`").cast("string")
    return source.agg(F.count("*").alias("documents"), F.count(key).alias("with_key"), F.count_distinct(key).alias("keys"))


def checked_lookup(source: DataFrame, policy: LookupPolicy, max_matches: int) -> DataFrame:
    """As ``build_lookup``; a lookup that would come out empty from a source with rows is an error."""
    key = F.col(f"`{policy.match_field}`").isNotNull()
    if source.where(key).isEmpty() and not source.isEmpty():
        raise ValueError(f"{policy.name}: no row of {policy.source} has a {policy.match_field}")
    return build_lookup(source, policy, max_matches)


def enrich(left: DataFrame, lookup: DataFrame, on: str, target: str) -> DataFrame:
    """Nest the lookup's matches under ``target``; a row without a match keeps NULL there and is never lost."""
    joined = left.join(lookup.withColumnRenamed("matches", target), F.col(f"`{on}`").cast("string") == F.col("_key"), "left")
    return joined.drop("_key")


def build_all(policies: list[tuple[DataFrame, LookupPolicy, int]]) -> dict[str, DataFrame]:
    """All lookups; failures are gathered and raised together."""
    built, wrong = {}, []
    for source, policy, cap in policies:
        try:
            built[policy.name] = checked_lookup(source, policy, cap)
        except ValueError as e:
            wrong.append(str(e))
    if wrong:
        raise ValueError("; ".join(wrong))
    return built


def attributes_by_key(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    return left.join(right, key, "left")


def outcome_dates(left: DataFrame, outcomes: DataFrame, key: str, date: str, out: str) -> DataFrame:
    """All distinct outcome dates of each key; none is an empty array."""
    dates = outcomes.groupBy(key).agg(F.collect_set(date).alias(out))
    return left.join(dates, key, "left").withColumn(out, F.coalesce(F.col(out), F.array().cast(dates.schema[out].dataType)))


def without(left: DataFrame, right: DataFrame, key: str | list[str]) -> DataFrame:
    return left.join(right, key, "left_anti")


def within_gap(gap: Column, low: float | None, high: float | None) -> Column:
    """NULL gaps pass; others lie between the bounds, both included."""
    inside = F.lit(True)
    if low is not None:
        inside = inside & (gap >= low)
    if high is not None:
        inside = inside & (gap <= high)
    return gap.isNull() | inside
