"""Set similarity of token arrays (each a set: no repeats)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def _both(a: Column, b: Column) -> Column:
    return (F.size(a) > 0) & (F.size(b) > 0)


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union; 0 if either is empty or missing."""
    return F.when(_both(a, b), F.size(F.array_intersect(a, b)) / F.size(F.array_union(a, b))).otherwise(F.lit(0.0))


def containment(a: Column, b: Column) -> Column:
    """Intersection over the smaller set; 0 if either is empty or missing."""
    return F.when(_both(a, b), F.size(F.array_intersect(a, b)) / F.least(F.size(a), F.size(b))).otherwise(F.lit(0.0))


def blended_overlap(a: Column, b: Column) -> Column:
    """Half Jaccard, half containment; NULL (not evaluable) if either is empty or missing."""
    both, one, two = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    return F.when(_both(a, b), (both / (one + two - both) + both / F.least(one, two)) / 2)


def best_of(scores: list[Column]) -> Column:
    """The greatest of the scores that are evaluable."""
    return F.greatest(*scores) if len(scores) > 1 else scores[0]
