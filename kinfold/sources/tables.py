"""Reading raw tables: CSV as text with missing values made NULL, Parquet, bounded and skipped rows, ordered snapshots."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.text import na_to_null

ROW = "_rowno"


def header_of(spark: SparkSession, path: str, multi_line: bool = True) -> list[str]:
    row = spark.read.option("header", False).option("multiLine", multi_line).option("escape", '"').csv(path).limit(1).collect()
    return [str(x) for x in row[0]] if row else []


def read_csv(spark: SparkSession, path: str, num_rows: int | None = None, skip_rows: int = 0, columns: list[str] | None = None, multi_line: bool = True) -> DataFrame:
    """Every column STRING, nothing inferred, the usual missing-value words NULL; ``skip_rows`` data rows left out first.

    Quoted cells may hold line feeds; files without such cells are cut into many tasks with ``multi_line=False``.
    """
    names = columns or header_of(spark, path, multi_line)
    schema = T.StructType([T.StructField(n, T.StringType()) for n in names])
    df = spark.read.schema(schema).option("header", True).option("multiLine", multi_line).option("escape", '"').option("enforceSchema", True).csv(path)
    df = df.select(*[na_to_null(F.col(f"`{n}`")).alias(n) for n in names])
    if skip_rows or num_rows is not None:
        df = numbered(df).where(F.col(ROW) >= skip_rows)
        if num_rows is not None:
            df = df.where(F.col(ROW) < skip_rows + num_rows)
        df = df.drop(ROW)
    return df


def numbered(df: DataFrame) -> DataFrame:
    """Add ``_rowno``, gapless from 0 in reading order, from per-partition counts (no global sort)."""
    tagged = df.withColumn("_m", F.monotonically_increasing_id()).withColumn("_p", F.shiftright("_m", 33))
    counts = tagged.groupBy("_p").agg(F.count("*").alias("_c"))
    start = counts.select("_p", F.coalesce(F.sum("_c").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_s"))
    return tagged.join(F.broadcast(start), "_p").withColumn(ROW, F.col("_s") + F.col("_m").bitwiseAND(F.lit((1 << 33) - 1))).drop("_m", "_p", "_s")  # a row per partition


def pinned(df: DataFrame, pins: dict[str, str]) -> DataFrame:
    """Apply a pin map {column: type}; a value that doesn't fit becomes NULL and its row stays."""
    kinds = {"keyword": "string", "text": "string", "long": "bigint", "integer": "int", "double": "double", "float": "double", "boolean": "boolean", "date": "date"}
    for name, kind in pins.items():
        c = F.col(f"`{name}`")
        if kind == "date":
            to = F.when(c.rlike(r"^\d{4}-\d{2}-\d{2}$"), F.to_date(F.try_to_timestamp(c, F.lit("yyyy-MM-dd"))))
        else:
            to = c.try_cast(kinds[kind])
        df = df.withColumn(name, to)
    return df


def window_since(df: DataFrame, date_column: str, cutoff: str) -> DataFrame:
    """Rows after a YYYYMMDD cutoff; the filter reaches the scan."""
    return df.where(F.col(date_column) > F.lit(cutoff))


def snapshot_scan(df: DataFrame, sort_field: str, max_records: int | None = None) -> DataFrame:
    """Rows in the order of a total sort key, at most ``max_records`` (a top-n, not a full sort, where given)."""
    ordered = df.orderBy(sort_field)
    return ordered.limit(max_records) if max_records else ordered


def sampled_column(df: DataFrame, column: str, rows: int = 20_000) -> DataFrame:
    return df.select(column).limit(rows)


def read_json_config(path: str | Path) -> dict | list | None:
    """Parsed JSON, or None when the file is absent."""
    p = Path(path)
    return json.loads(p.read_text(encoding="utf-8")) if p.exists() else None
