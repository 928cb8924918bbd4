"""Connected components of a link table, by alternating large-star and small-star steps on DataFrames.

A table of ``ONE_TASK`` links at most is settled by one task instead, as each step is a query that the driver has to plan.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinfold.llm._store import stored

MOST_ROUNDS = 64
ONE_TASK = 200_000


def _least_by(edges: DataFrame, key: str, least) -> DataFrame:
    """(key, m) by a grouping that doesn't fit the join which follows: so that both its sides are dealt out anew, and AQE can
    split the edges of a hub over tasks. The second key is always 0.
    """
    other = "v" if key == "u" else "a"
    return edges.groupBy(key, F.pmod(other, F.lit(1)).alias("_zero")).agg(least.alias("m")).drop("_zero")


def _large(edges: DataFrame) -> DataFrame:
    both = edges.select(F.col("a").alias("u"), F.col("b").alias("v")).unionByName(edges.select(F.col("b").alias("u"), F.col("a").alias("v")))
    least = _least_by(both, "u", F.least(F.min("v"), F.col("u")))
    joined = both.where("v > u").join(least, "u")
    return joined.select(F.col("m").alias("a"), F.col("v").alias("b")).where("a <> b").distinct()


def _small(edges: DataFrame) -> DataFrame:
    # an edge (a, b) has a < b: b's smaller neighbours are its a's
    least = _least_by(edges, "b", F.min("a"))
    joined = edges.join(least, "b")
    down = joined.select(F.col("m").alias("a"), F.col("a").alias("c")).where("a <> c").select("a", F.col("c").alias("b"))
    return down.unionByName(least.select(F.col("m").alias("a"), "b")).distinct()


def forest(links: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Of links (2 x n arrays): each node other than the least of its component, and that least node.

    Every root goes to the least root that it has a link to, until none moves.
    """
    nodes, at = np.unique(np.concatenate(links, 1), return_inverse=True)
    a, b = at.reshape(2, -1)
    label, before = np.arange(len(nodes)), None
    while before is None or (label != before).any():
        before = label.copy()
        least = np.minimum(before[a], before[b])
        np.minimum.at(label, before[a], least)
        np.minimum.at(label, before[b], least)
        while (label[label] != label).any():
            label = label[label]
    other = label != np.arange(len(nodes))
    return nodes[other], nodes[label[other]]


def _settled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, label) of all links of the task."""
    links = [np.stack([x.column("a").to_numpy(), x.column("b").to_numpy()]) for x in batches if x.num_rows]
    if links:
        yield pa.RecordBatch.from_arrays([pa.array(x) for x in forest(links)], names=["node", "label"])


def components(edges: DataFrame) -> DataFrame:
    """(node, label): the least node of its component, for every node of ``edges`` (a, b) other than the least itself."""
    now = stored(edges.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct(), "edges")
    mark = None
    for _ in range(MOST_ROUNDS):
        found = now.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if tuple(found) == mark or not found[0]:
            break
        if mark is None and found[0] <= ONE_TASK:
            return stored(now.coalesce(1).mapInArrow(_settled, "node long, label long"), "labels")
        mark = tuple(found)
        now = stored(_small(_large(now)), "edges")
    else:
        raise RuntimeError("components did not settle")
    return now.select(F.col("b").alias("node"), F.col("a").alias("label"))
