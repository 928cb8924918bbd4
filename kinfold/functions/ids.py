"""Deterministic document ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinfold.functions.text import is_blank

BLANK_PREFIX = "blank-key:"


def row_hash(df: DataFrame) -> Column:
    """SHA-256 of the row as JSON, keys in order, NULLs written: the same for any order of columns."""
    row = F.struct(*[F.col(f"`{c}`") for c in sorted(df.columns)])
    return F.sha2(F.to_json(row, {"ignoreNullFields": "false"}), 256)


def document_id(df: DataFrame, key: str | list[str]) -> Column:
    """The key column verbatim, or components joined by ``|`` (blank ones empty); all blank: a hash of the row.

    A key column that the table lacks is an error: a random id would make reruns add rows.
    """
    keys = [key] if isinstance(key, str) else list(key)
    missing = [k for k in keys if k not in df.columns]
    if missing:
        raise ValueError(f"id columns not in the table: {missing}")
    cols = [F.col(f"`{k}`").cast("string") for k in keys]
    blank = is_blank(cols[0])
    for c in cols[1:]:
        blank = blank & is_blank(c)
    joined = cols[0] if len(cols) == 1 else F.concat_ws("|", *[F.when(is_blank(c), F.lit("")).otherwise(c) for c in cols])
    return F.when(blank, F.concat(F.lit(BLANK_PREFIX), row_hash(df))).otherwise(joined)


def blank_keys(id_column: str = "_id") -> Column:
    """Aggregate: rows whose key was blank."""
    return F.count_if(F.col(id_column).startswith(BLANK_PREFIX))


def blank_key_count(df: DataFrame, id_column: str = "_id") -> DataFrame:
    return df.agg(blank_keys(id_column).alias("blank_keys"))


def pair_id(left: Column, right: Column) -> Column:
    blank = lambda c: F.when(is_blank(c), F.lit("")).otherwise(c.cast("string"))
    return F.concat_ws("|", blank(left), blank(right))
