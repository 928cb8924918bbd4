"""Banding, rates, direct standardisation, exposure, recency, permutation and stratified samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinfold.functions.dates import months_between

#: Bands (fixed values): scores half-open with the last one closed, fleets closed, gaps half-open, recency in months.
SCORE_EDGES = (0.35, 0.50, 0.60, 0.70, 0.80, 0.90, 1.0)
FLEET_BANDS = ((1, 1, "1"), (2, 5, "2-5"), (6, 20, "6-20"), (21, 100, "21-100"), (101, None, "100+"))
GAP_EDGES = ((None, -180, "180d+ before"), (-180, 0, "0-180d before"), (0, 366, "under 1y after"), (366, None, "1y+ after"))
RECENCY = ((12, "under-1y"), (36, "1-3y"), (None, "3y-plus"))


def score_band_names(edges=SCORE_EDGES) -> list[str]:
    return [f"{a:.2f}-{b:.2f}" for a, b in zip(edges[:-1], edges[1:], strict=True)]


def score_band(score: Column, edges=SCORE_EDGES) -> Column:
    """The band's name; NULL outside all bands."""
    out = F.lit(None).cast("string")
    for (a, b), name in reversed(list(zip(zip(edges[:-1], edges[1:], strict=True), score_band_names(edges), strict=True))):
        top = score <= b if b == edges[-1] else score < b
        out = F.when((score >= a) & top, F.lit(name)).otherwise(out)
    return out


def fleet_band(size: Column) -> Column:
    """NULL is ``unknown``; what is no positive number is NULL."""
    n = size.try_cast("bigint")
    out = F.lit(None).cast("string")
    for low, high, name in FLEET_BANDS:
        out = F.when((n >= low) & (n <= high if high is not None else F.lit(True)), F.lit(name)).otherwise(out)
    return F.when(size.isNull(), F.lit("unknown")).otherwise(out)


def gap_band(gap: Column) -> Column:
    out = F.lit(None).cast("string")
    for low, high, name in GAP_EDGES:
        out = F.when((gap >= low if low is not None else F.lit(True)) & (gap < high if high is not None else F.lit(True)), F.lit(name)).otherwise(out)
    return F.when(gap.isNotNull(), out)


def recency_cohort(months: Column) -> Column:
    out = F.lit(RECENCY[-1][1])
    for most, name in reversed(RECENCY[:-1]):
        out = F.when(months < most, F.lit(name)).otherwise(out)
    return F.when(months.isNotNull(), out)


def happened_after(dates: Column, start: Column) -> Column:
    """Any date strictly after the start; without a start never."""
    return F.when(start.isNull(), F.lit(False)).otherwise(F.coalesce(F.exists(dates, lambda d: d > start), F.lit(False)))


def rate(hits: Column, total: Column) -> Column:
    """NULL (not 0) where nothing was counted."""
    return F.try_divide(hits.cast("double"), total)


def exposed_rows(rows: DataFrame, add: str, window_start: Column, window_end: Column) -> DataFrame:
    """Rows with a start date, with months of exposure in the window and whether they began before it (YYYYMMDD integers)."""
    a = F.col(add)
    months = F.greatest(months_between(F.greatest(a, window_start), window_end), F.lit(0.0))
    return rows.where(a.isNotNull()).withColumn("exposure", months).withColumn("restricted", a < window_start)


def band_stats(rows: DataFrame, band: str, bands: list[str], hit: str, exposure: str | None = None) -> DataFrame:
    """Per band (all of them, counted or not): total, hits, rate, hits per 1000 months."""
    spark = rows.sparkSession
    all_bands = spark.createDataFrame([(b,) for b in bands], f"{band} string")
    aggs = [F.count("*").alias("total"), F.count_if(F.col(hit)).alias("hits")]
    if exposure:
        aggs.append(F.sum(exposure).alias("months"))
    found = rows.groupBy(band).agg(*aggs)
    out = all_bands.join(found, band, "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "hits")})
    out = out.withColumn("rate", rate(F.col("hits"), F.col("total")))
    if exposure:
        out = out.withColumn("months", F.coalesce("months", F.lit(0.0))).withColumn("per_1000_months", F.try_divide(F.col("hits") * 1000.0, F.col("months")))
    return out


def cross_stats(rows: DataFrame, a: str, a_names: list[str], b: str, b_names: list[str], hit: str) -> DataFrame:
    """Every cell of a fixed table of two dimensions, those without rows at 0."""
    cells = rows.sparkSession.createDataFrame([(x, y) for x in a_names for y in b_names], f"{a} string, {b} string")
    found = rows.groupBy(a, b).agg(F.count("*").alias("total"), F.count_if(F.col(hit)).alias("hits"))
    out = cells.join(found, [a, b], "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("total", "hits")})
    return out.withColumn("rate", rate(F.col("hits"), F.col("total")))


def stratum_counts(rows: DataFrame, strata: list[str], hit: Column) -> DataFrame:
    """(strata, hits, total); NULL is a stratum of its own."""
    return rows.groupBy(*strata).agg(F.count_if(F.coalesce(hit, F.lit(False))).alias("hits"), F.count("*").alias("total"))


def _null_safe(a: DataFrame, b: DataFrame, keys: list[str]) -> Column:
    out = F.lit(True)
    for k in keys:
        out = out & a[k].eqNullSafe(b[k])
    return out


def subtract_strata(population: DataFrame, flagged: DataFrame, strata: list[str]) -> DataFrame:
    """Population minus flagged per stratum; ``negative`` marks strata where more was flagged than there is."""
    f = flagged.select(*strata, F.col("hits").alias("_h"), F.col("total").alias("_t"))
    joined = population.join(f, _null_safe(population, f, strata), "left").select(*[population[s] for s in strata], (population["hits"] - F.coalesce("_h", F.lit(0))).alias("hits"), (population["total"] - F.coalesce("_t", F.lit(0))).alias("total"))
    return joined.withColumn("negative", (F.col("hits") < 0) | (F.col("total") < 0))


def standardised_rate(flagged: DataFrame, control: DataFrame, strata: list[str]) -> DataFrame:
    """One row: the control's rate over the flagged's strata, and how much of the flagged had no control.

    sum(n_flagged * rate_control) / sum(n_flagged) over strata in which there are controls; NULL if there are none.
    """
    c = control.select(*strata, F.col("hits").alias("_h"), F.col("total").alias("_t"))
    joined = flagged.join(c, _null_safe(flagged, c, strata), "left")
    ok = F.coalesce(F.col("_t") > 0, F.lit(False))
    n = F.col("total").cast("double")
    return joined.agg(
        F.try_divide(F.sum(F.when(ok, n * F.col("_h") / F.col("_t"))), F.sum(F.when(ok, n))).alias("standardised_rate"),
        F.coalesce(F.sum(F.when(~ok, F.lit(1))), F.lit(0)).cast("long").alias("skipped_strata"),
        F.coalesce(F.sum(F.when(~ok, F.col("total"))), F.lit(0)).cast("long").alias("skipped_rows"),
        rate(F.sum("hits"), F.sum("total")).alias("flagged_rate"),
    ).withColumn("lift", F.try_divide(F.col("flagged_rate"), F.col("standardised_rate")))


def hash_order(seed: int, key: str) -> Column:
    """A seeded order that SQL engines agree on."""
    return F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))


def stratified_sample(rows: DataFrame, band: str, key: str, per_band: int, seed: int) -> DataFrame:
    w = Window.partitionBy(band).orderBy(hash_order(seed, key), key)
    return rows.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= per_band).drop("_n")


def review_sample(rows: DataFrame, band: str, key: str, per_band: int, seed: int) -> DataFrame:
    """A stratified sample with an empty verdict for the reviewer."""
    return stratified_sample(rows.where(F.col(band).isNotNull()), band, key, per_band, seed).withColumn("verdict", F.lit(None).cast("string"))


def band_counts(rows: DataFrame, sample: DataFrame, band: str, names: list[str]) -> DataFrame:
    """(band, total, sampled) of every named band, in their order: what there is and what the sample took of it."""
    all_, some = (df.groupBy(band).agg(F.count("*").alias(c)) for df, c in ((rows, "total"), (sample, "sampled")))
    order = rows.sparkSession.createDataFrame(list(enumerate(names)), f"_at int, {band} string")
    found = order.join(all_, band, "left").join(some, band, "left")
    return found.orderBy("_at").select(band, F.coalesce("total", F.lit(0)).alias("total"), F.coalesce("sampled", F.lit(0)).alias("sampled"))


def persist_results(catalog, name: str, views: dict[str, DataFrame], provenance: dict[str, str]) -> None:
    """Append all result tables of a validation to table ``name`` of a catalog, a row per reported cell, with the run's marks."""
    rows = result_rows(views).withColumns({k: F.lit(v) for k, v in provenance.items()})
    catalog.create(name)
    catalog.write(name, rows, "append")


def placebo(rows: DataFrame, key: str, value: str, seed: int, buckets: int = 64) -> DataFrame:
    """The values dealt anew over the keys: values in seeded hash order meet keys in key order, rank by rank.

    Ranks come from prefix counts over hash buckets, so neither order needs one task.
    """
    by_key = _ranked(rows.select(key), F.md5(F.col(key).cast("string")), [key], buckets)
    by_value = _ranked(rows.select(F.col(key).alias("_k"), value), hash_order(seed, "_k"), ["_k"], buckets).drop("_k")
    return by_key.join(by_value, "_rank").drop("_rank")


def _ranked(df: DataFrame, order: Column, ties: list[str], buckets: int) -> DataFrame:
    """Add ``_rank`` from 1 by an order of hex digests: buckets of their first digits, then inside each."""
    dealt = df.withColumn("_o", order).withColumn("_b", F.floor(F.conv(F.substring("_o", 1, 4), 16, 10).cast("long") * buckets / 65536))
    counts = dealt.groupBy("_b").agg(F.count("*").alias("_c"))
    start = counts.select("_b", F.coalesce(F.sum("_c").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))  # a row per bucket
    inside = F.row_number().over(Window.partitionBy("_b").orderBy("_o", *ties))
    return dealt.withColumn("_in", inside).join(F.broadcast(start), "_b").withColumn("_rank", F.col("_in") + F.col("_s")).drop("_o", "_b", "_in", "_s")


def result_rows(views: dict[str, DataFrame]) -> DataFrame:
    """All result tables of a validation as rows of one, told apart by ``view``; columns that a view lacks are NULL."""
    out = None
    for name, rows in views.items():
        named = rows.withColumn("view", F.lit(name))
        out = named if out is None else out.unionByName(named, allowMissingColumns=True)
    if out is None:
        raise ValueError("no results")
    return out


def signal_headroom(weights: dict[str, float], kind: str, observed_mean: float) -> dict[str, float]:
    """Share of the configured weight that a signal has, and how much of it a mean score leaves unused."""
    share = weights[kind] / sum(weights.values())
    return {"weight_share": share, "mean_contribution": share * observed_mean, "headroom": share * (1 - observed_mean)}
