"""Candidate retrieval as one set-at-a-time join: postings, relevance, top-K per record."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def postings(df: DataFrame, key: str, fields: dict[str, str], out_key: str = "id") -> DataFrame:
    """(id, block, token, tf, dl) from token arrays with repeats; ``fields`` is {block: column}."""
    parts = [df.select(F.col(key).alias(out_key), F.lit(block).alias("block"), F.size(column).alias("dl"), F.explode(column).alias("token")) for block, column in fields.items()]
    rows = parts[0]
    for p in parts[1:]:
        rows = rows.unionByName(p)
    return rows.groupBy(out_key, "block", "token").agg(F.count("*").alias("tf"), F.first("dl").alias("dl"))


def statistics(posted: DataFrame, id_column: str = "id") -> tuple[DataFrame, DataFrame]:
    """Document frequency of (block, token), and N with the mean length of each block (one row per block)."""
    df = posted.groupBy("block", "token").agg(F.count("*").alias("df"))
    lengths = posted.groupBy("block", id_column).agg(F.first("dl").alias("dl")).groupBy("block").agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"))
    return df, lengths


def weighted(posted: DataFrame, rank: str = "bm25", max_block_df: int | None = None, constant: tuple[str, ...] = ()) -> DataFrame:
    """Postings with the relevance of a hit: BM25, its idf alone, or 1 for blocks of exact terms.

    ``max_block_df`` leaves out tokens on more records than that (off: parity).
    """
    df, lengths = statistics(posted)
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    bm25 = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    if max_block_df is not None:
        df = df.where(F.col("df") <= max_block_df)
    hit = bm25 if rank == "bm25" else idf
    if constant:
        hit = F.when(F.col("block").isin(list(constant)), F.lit(1.0)).otherwise(hit)
    return posted.join(df, ["block", "token"]).join(F.broadcast(lengths), "block").withColumn("relevance", hit).drop("n", "avgdl")  # a row per configured block


def pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """(l, r): every ordered pair of different records that share a token of a block."""
    a = left.select(F.col("id").alias("l"), "block", "token").distinct()
    b = right.select(F.col("id").alias("r"), "block", "token").distinct()
    return a.join(b, ["block", "token"]).where("l <> r").select("l", "r").distinct()


def candidates(left: DataFrame, right: DataFrame, k: int) -> DataFrame:
    """(l, r, relevance, rank, truncated): the k best-matching records for each record of ``left``.

    ``left`` (id, block, token) holds the population's postings, ``right`` everyone's with their relevance. A join on
    (block, token) replaces one query per record; pairs are dealt by record once, for their sums, their ranks and their number.
    """
    a = left.select(F.col("id").alias("l"), "block", "token").distinct()
    b = right.select(F.col("id").alias("r"), "block", "token", "relevance")
    found = a.join(b, ["block", "token"]).where(F.col("l") != F.col("r")).repartition("l").groupBy("l", "r").agg(F.sum("relevance").alias("relevance"))
    own = Window.partitionBy("l")
    ranked = found.withColumns({"rank": F.row_number().over(own.orderBy(F.desc(F.round("relevance", 9)), "r")), "_found": F.count("*").over(own)})
    return ranked.where(F.col("rank") <= k).withColumn("truncated", F.col("_found") >= k).drop("_found")
