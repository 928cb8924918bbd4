"""Column profiles, warnings, type recommendations, key uniqueness and mapping coverage of raw (all-text) tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.ids import row_hash
from kinfold.functions.text import is_blank

#: Value shapes and thresholds (fixed values).
ISO_DATE = r"^\d{4}-\d{2}-\d{2}$"
MONTH_NAME_DATE = r"^\d{1,2}-[A-Za-z]{3}-\d{2,4}$"
SLASH_DATE = r"^\d{1,2}/\d{1,2}/\d{2,4}$"
INTEGER = r"^-?\d+$"
DECIMAL = r"^-?\d*\.\d+$"
LEADING_ZERO = r"^0\d+$"
CATEGORY_MAX_DISTINCT, FINGERPRINT_RATIO, COMMON_SHARE, SPARSE_SHARE = 200, 0.5, 0.01, 0.2
NAME_SHARE, BOOLEANS = 0.9, ("true", "false")


def long_cells(df: DataFrame) -> DataFrame:
    """(column, value) of every cell as text; one pass over the table for all columns."""
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"`{c}`").cast("string").alias("value")) for c in df.columns])
    return df.select(F.inline(cells))


def profile_columns(df: DataFrame, approximate: bool = False) -> DataFrame:
    """One row per column: counts by shape, distinct values, the top value, longest value, collision probability.

    Cells are counted per (column, value) first, with partial sums before the shuffle, so all figures are exact whatever
    the number of distinct values; ``approximate`` estimates the distinct count from a sketch instead.
    """
    values = long_cells(df).groupBy("column", "value").agg(F.count("*").alias("n"))
    v, n = F.trim("value"), F.col("n")
    blank = is_blank(F.col("value"))
    shaped = lambda pattern: F.coalesce(F.sum(F.when(~blank & v.rlike(pattern), n)), F.lit(0)).cast("long")
    number = v.rlike(INTEGER) | v.rlike(DECIMAL)
    return values.groupBy("column").agg(
        F.sum(n).cast("long").alias("total"),
        F.coalesce(F.sum(F.when(blank, n)), F.lit(0)).cast("long").alias("blank"),
        (F.approx_count_distinct(F.when(~blank, v)) if approximate else F.count_distinct(F.when(~blank, v))).alias("distinct_values"),
        shaped(INTEGER).alias("n_int"), shaped(DECIMAL).alias("n_float"),
        F.coalesce(F.sum(F.when(~blank & ~number, n)), F.lit(0)).cast("long").alias("n_other"),
        shaped(LEADING_ZERO).alias("n_leading_zero"), shaped(ISO_DATE).alias("n_iso_date"), shaped(MONTH_NAME_DATE).alias("n_month_name_date"), shaped(SLASH_DATE).alias("n_slash_date"),
        F.coalesce(F.sum(F.when(~blank & F.lower(v).isin(*BOOLEANS), n)), F.lit(0)).cast("long").alias("n_boolean"),
        F.coalesce(F.max(F.when(~blank, F.length(v))), F.lit(0)).alias("max_length"),
        F.max(F.when(~blank, F.struct(n.alias("n"), v.alias("v")))).alias("_top"),
        F.sum(F.when(~blank, n.cast("double") * n)).alias("_squares"),
    ).select(
        "*", F.col("_top.v").alias("top_value"), F.coalesce("_top.n", F.lit(0)).alias("top_count"),
        F.try_divide(F.col("_squares"), (F.col("total") - F.col("blank")).cast("double") * (F.col("total") - F.col("blank"))).alias("collision"),
    ).drop("_top", "_squares").withColumn("populated", F.col("total") - F.col("blank"))


def near_unique() -> Column:
    return F.coalesce(F.try_divide(F.col("distinct_values"), F.col("populated")) >= FINGERPRINT_RATIO, F.lit(False))


def low_cardinality() -> Column:
    few = F.col("distinct_values").between(1, CATEGORY_MAX_DISTINCT)
    return few & ~near_unique() & F.coalesce(F.try_divide(F.col("top_count"), F.col("populated")) > COMMON_SHARE, F.lit(False))


def warnings(profile: DataFrame) -> DataFrame:
    """Add ``warnings``: what would corrupt a load if the column stayed unpinned."""
    numeric = F.col("n_int") + F.col("n_float")
    kinds = F.when(F.col("n_leading_zero") > 0, "LEADING ZEROS").when((numeric > 0) & (F.col("n_other") > 0), "MIXED TYPES").when((numeric > 0) & (F.col("n_other") == 0) & (F.col("populated") > 0), "ALL-NUMERIC")
    found = F.array(
        kinds,
        F.when(F.col("n_month_name_date") + F.col("n_slash_date") > 0, "NON-ISO DATES"),
        F.when((F.col("populated") > 0) & (F.col("blank") / F.col("total") > SPARSE_SHARE), "SPARSE"),
        F.when(low_cardinality(), "LOW CARDINALITY"),
    )
    return profile.withColumn("warnings", F.array_compact(found))


def usage(profile: DataFrame) -> DataFrame:
    """``fingerprint`` for columns that tell records apart, ``filter`` for the others."""
    apart = (F.col("distinct_values") > CATEGORY_MAX_DISTINCT) | near_unique()
    return profile.withColumn("usage", F.when(F.col("populated") == 0, F.lit(None).cast("string")).when(apart, "fingerprint").otherwise("filter"))


def recommend_types(profile: DataFrame) -> DataFrame:
    """keyword (zero-padded numbers), boolean, long, double, or NULL where text is right; blanks are ignored."""
    p = F.col("populated")
    kind = (
        F.when(p == 0, F.lit(None).cast("string"))
        .when((F.col("n_leading_zero") > 0) & (F.col("n_int") == p), "keyword")
        .when(F.col("n_boolean") == p, "boolean")
        .when(F.col("n_int") == p, "long")
        .when(F.col("n_int") + F.col("n_float") == p, "double")
    )
    return profile.withColumn("recommended_type", kind).withColumn("looks_like_date", (p > 0) & (F.col("n_month_name_date") + F.col("n_slash_date") == p))


def field_types(profile: DataFrame) -> DataFrame:
    """What a scaffolded project pins: identifiers and codes as keyword, dates as date, numbers by type, the rest as text."""
    p = F.col("populated")
    typed = recommend_types(profile)
    kind = F.when(F.col("n_iso_date") == p, "date").when(F.col("recommended_type").isNotNull(), F.col("recommended_type")).when(low_cardinality(), "keyword").otherwise("text")
    return typed.withColumn("field_type", F.when(p == 0, "keyword").otherwise(kind)).withColumn("identity_candidate", (F.try_divide(F.col("distinct_values"), p) >= NAME_SHARE) & (p >= F.col("total") * FINGERPRINT_RATIO))


def key_uniqueness(df: DataFrame, key: list[str]) -> DataFrame:
    """One row: rows, distinct keys, duplicate keys, rows identical to their key's first, and real collisions."""
    hashed = df.select(*[F.col(f"`{k}`").cast("string").alias(f"_k{i}") for i, k in enumerate(key)], row_hash(df).alias("_h"))
    keys = [f"_k{i}" for i in range(len(key))]
    per = hashed.groupBy(*keys, "_h").agg(F.count("*").alias("_n")).groupBy(*keys).agg(F.sum("_n").alias("_rows"), F.max("_n").alias("_same"), F.count("*").alias("_kinds"), F.sum(F.col("_n") - 1).alias("_again"))
    return per.agg(
        F.coalesce(F.sum("_rows"), F.lit(0)).cast("long").alias("total_rows"), F.count("*").alias("distinct_keys"), F.count_if(F.col("_rows") > 1).alias("duplicate_keys"),
        F.coalesce(F.sum("_again"), F.lit(0)).cast("long").alias("identical_rows"), F.coalesce(F.sum(F.col("_kinds") - 1), F.lit(0)).cast("long").alias("real_collisions"),
    )


def coverage(columns: list[str], pinned: list[str], enriched: list[str]) -> dict[str, list[str]]:
    """Columns without a pin, and pins without a column."""
    return {"unpinned": sorted(set(columns) - set(pinned)), "dead": sorted(set(pinned) - set(columns) - set(enriched))}


def analyzer_effect(scores: DataFrame, before: str, after: str, floor: float) -> DataFrame:
    """One row: pairs whose score an analyzer changed, up, down, means, and crossings of a floor either way."""
    a, b = F.col(before), F.col(after)
    return scores.agg(
        F.count("*").alias("pairs"), F.count_if(a != b).alias("changed"), F.count_if(b > a).alias("up"), F.count_if(b < a).alias("down"), F.avg(a).alias("mean_before"), F.avg(b).alias("mean_after"),
        F.count_if((a < floor) & (b >= floor)).alias("now_above"), F.count_if((a >= floor) & (b < floor)).alias("now_below"),
    )
