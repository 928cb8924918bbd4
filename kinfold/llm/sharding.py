"""Sharding by Karmarkar-Karp differencing of indivisible groups (equal texts), law ``bytes``.

Partial partitions start with one group each; the two of largest spread are combined again and again, one ordered
oppositely to the other, until one k-way partition is left. This runs from large groups to small ones, down a tree of cells: the
root differences the groups of more than 1/``GIANT`` of a shard; its loads are shared out to ``FAN`` children by their bytes, as a
partial partition to begin with; each child differences the groups that are large for it, and so on, down to cells of a few
thousand groups that take all that is left. So no group outweighs its cell (a cell sees fewer than shards*GIANT*FAN
large ones), and what is uneven above is evened out below.

Defined cases: a null text counts as empty; size is its UTF-8 bytes plus 1; repeated rows are rows of one group; a null
doc_id is a row like any other; a very long text is one group; groups of equal size are told apart by their key, so ties
don't matter; an empty table gives an empty result; the other columns of ``docs`` are kept, clashing names are replaced.
"""

from __future__ import annotations

import heapq

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._ranking import buckets_for, prefix_sum
from kinfold.llm._store import stored

SHARDS = 16
CELL_GROUPS = 4000
FAN = 8
GIANT = 64


def differencing(partitions: list[list[int]], k: int) -> tuple[list[list[int]], list[int]]:
    """Combine partial partitions (bytes by slot, at most k) into one.

    Returns for each input partition the final slot of each of its slots, and the final sums. Slots are sorted by
    falling sums.
    """
    sums, order, children = [], [], []
    heap = []
    for i, p in enumerate(partitions):
        full = list(p) + [0] * (k - len(p))
        by = sorted(range(k), key=lambda s: (-full[s], s))
        sums.append([full[s] for s in by])
        order.append(by)
        children.append(None)
        heap.append((sums[i][-1] - sums[i][0], i))
    heapq.heapify(heap)
    while len(heap) > 1:
        _, a = heapq.heappop(heap)
        _, b = heapq.heappop(heap)
        sa, sb = sums[a], sums[b]
        both = sorted([(-(sa[j] + sb[k - 1 - j]), j) for j in range(k)])
        n = len(sums)
        sums.append([-x for x, _ in both])
        order.append(None)
        children.append((a, b, [j for _, j in both]))
        sums[a] = sums[b] = None
        heapq.heappush(heap, (both[-1][0] * -1 - both[0][0] * -1, n))
    slots: list[list[int]] = [[] for _ in partitions]
    if not heap:
        return slots, [0] * k
    top = heap[0][1]
    stack = [(top, list(range(k)))]
    while stack:
        node, to = stack.pop()  # to[j]: final slot of the node's j-th largest sum
        if children[node] is None:
            final = [0] * k
            for j, s in enumerate(order[node]):
                final[s] = to[j]
            slots[node] = final
            continue
        a, b, came = children[node]
        to_a, to_b = [0] * k, [0] * k
        for j, was in enumerate(came):
            to_a[was] = to[j]
            to_b[k - 1 - was] = to[j]
        stack += [(a, to_a), (b, to_b)]
    return slots, sums[top]


PLACED = "node long, group_key long, shard int, loads array<long>"


def _cell(k: int):
    """Shards of a cell's groups, given the loads it begins with; and on a row without group its loads at the end."""

    def run(own: pd.DataFrame, begin: pd.DataFrame) -> pd.DataFrame:
        own = own.sort_values(["group_bytes", "group_key"], ascending=[False, True], ignore_index=True)
        node = int((own if len(own) else begin)["node"].iloc[0])
        loads = [int(x) for x in begin["loads"].iloc[0]] if len(begin) else [0] * k
        slots, sums = differencing([loads] + [[int(x)] for x in own["group_bytes"]], k)
        back = [0] * k  # slot -> shard: the one whose load went there
        for shard, slot in enumerate(slots[0]):
            back[slot] = shard
        end = [sums[slots[0][shard]] for shard in range(k)]
        return pd.DataFrame({"node": node, "group_key": pd.array([*own["group_key"], None], "Int64"), "shard": pd.array([*(back[s[0]] for s in slots[1:]), None], "Int32"), "loads": [None] * len(own) + [end]})

    return run


def place(groups: DataFrame, shards: int = SHARDS) -> DataFrame:
    """(group_key, shard) of groups (group_key, group_bytes)."""
    n, total = groups.agg(F.count("*"), F.coalesce(F.sum("group_bytes"), F.lit(0))).first()
    depth = 0
    while CELL_GROUPS * FAN**depth < n:
        depth += 1
    level = F.lit(depth)
    for d in reversed(range(depth)):
        level = F.when(F.col("group_bytes") > total // (shards * GIANT * FAN**d), d).otherwise(level)
    dealt = groups.select("group_key", "group_bytes", level.alias("level"), F.pmod(F.xxhash64("group_key", F.lit(7)), F.lit(FAN**depth)).alias("leaf"))
    placed, loads = None, None
    for d in range(depth + 1):
        node = (F.col("leaf") % FAN**d).alias("node")
        begin = groups.sparkSession.createDataFrame([(0, [0] * shards)], "node long, loads array<long>")
        if d:  # the parent's loads, shared out by what is still to come
            rest = dealt.where(F.col("level") >= d).groupBy(node).agg(F.sum("group_bytes").alias("rest")).withColumn("parent", F.col("node") % FAN ** (d - 1))
            whole = rest.groupBy("parent").agg(F.sum("rest").alias("whole"))
            begin = rest.join(whole, "parent").join(loads.withColumnRenamed("node", "parent"), "parent")
            begin = begin.select("node", F.transform("loads", lambda x: (x.cast("double") * F.col("rest") / F.col("whole")).cast("long")).alias("loads"))
        own = dealt.where(F.col("level") == d).select(node, "group_key", "group_bytes")
        done = stored(own.groupBy("node").cogroup(begin.groupBy("node")).applyInPandas(_cell(shards), PLACED), "shard-cells")
        loads = done.where("loads is not null").select("node", "loads")
        found = done.where("loads is null").select("group_key", "shard")
        placed = found if placed is None else placed.unionByName(found)
    return placed


def with_groups(docs: DataFrame, text: str = "text") -> DataFrame:
    """Add size, text_crc32 and the key of the row's group of equal texts."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.drop("size", "text_crc32", "group_key").withColumns({"size": F.octet_length(body).cast("long") + 1, "text_crc32": F.crc32(body).cast("long"), "group_key": F.xxhash64(body, F.octet_length(body))})


def shard(rows: DataFrame, shards: int = SHARDS, order: tuple[str, ...] = ("doc_id", "text_crc32")) -> DataFrame:
    """Add shard and slot (gapless from 0 in each shard) to rows that carry ``size`` and ``group_key``."""
    groups = stored(rows.groupBy("group_key").agg(F.sum("size").alias("group_bytes"), F.count("*").alias("group_rows")), "shard-groups")
    count = groups.agg(F.coalesce(F.sum("group_rows"), F.lit(0))).first()[0]
    placed = stored(place(groups, shards), "shard-placed")
    joined = rows.drop("shard", "slot").join(placed, "group_key")
    keys = [F.col(c) for c in order if c in rows.columns]
    return prefix_sum(joined, "shard", keys or [F.col("group_key")], F.lit(1).cast("long"), "slot", buckets_for(count))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_groups(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")).drop("text")
    out = shard(stored(docs, "shard-rows"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
