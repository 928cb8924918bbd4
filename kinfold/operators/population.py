"""Population selectors: a closed menu of named predicates compiled to Columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.paths import path_type, read_path
from kinfold.sources.tables import snapshot_scan

KINDS = ("nested-exists", "term", "all", "any")
MODES = ("lifecycle", "all-entities")
_BOUNDS = {"gte": "__ge__", "gt": "__gt__", "lte": "__le__", "lt": "__lt__"}


class SelectorError(ValueError):
    pass


def _nested_exists(df: DataFrame, spec: dict) -> Column:
    """One element of the array fulfils everything."""
    path = spec["path"]
    kind = path_type(df.schema, path)
    if kind is None:
        raise SelectorError(f"no such path: {path}")

    def holds(x: Column) -> Column:
        at = lambda f: x.getField(f.removeprefix(path + "."))
        test = at(spec["require"]).isNotNull()
        for f, values in spec.get("terms", {}).items():
            test = test & at(f).isin(list(values))
        for f, bounds in spec.get("range", {}).items():
            for op, value in bounds.items():
                test = test & getattr(at(f), _BOUNDS[op])(F.lit(value))
        return F.coalesce(test, F.lit(False))

    c = read_path(df, path)
    return F.coalesce(F.exists(c, holds), F.lit(False)) if isinstance(kind, T.ArrayType) else F.coalesce(holds(c), F.lit(False))


def _term(df: DataFrame, spec: dict) -> Column:
    (path, value), = spec.items()
    kind = path_type(df.schema, path)
    if kind is None:
        raise SelectorError(f"no such path: {path}")
    c = read_path(df, path)
    found = F.array_contains(c, value) if isinstance(kind, T.ArrayType) else c == F.lit(value)
    return F.coalesce(found, F.lit(False))


def compile_selector(df: DataFrame, selectors: dict[str, dict], name: str, path: tuple[str, ...] = ()) -> Column:
    """The named selector as a boolean Column; unknown names, odd clauses and cycles are reported with their path."""
    if name in path:
        raise SelectorError("cycle: " + " -> ".join((*path, name)))
    if name not in selectors:
        raise SelectorError(f"unknown selector {name!r}" + (f" (from {' -> '.join(path)})" if path else ""))
    clause = selectors[name]
    if len(clause) != 1:
        raise SelectorError(f"{name}: exactly one clause kind is needed, found {sorted(clause)}")
    (kind, spec), = clause.items()
    if kind == "nested-exists":
        return _nested_exists(df, spec)
    if kind == "term":
        return _term(df, spec)
    if kind in ("all", "any"):
        parts = [compile_selector(df, selectors, n, (*path, name)) for n in spec]
        out = parts[0]
        for p in parts[1:]:
            out = (out & p) if kind == "all" else (out | p)
        return out
    raise SelectorError(f"{name}: unknown clause kind {kind!r}; known are {', '.join(KINDS)}")


def population(df: DataFrame, spec: dict) -> DataFrame:
    """The swept records: all of them, or those of the mode's selector; in sort order and capped where the spec says so."""
    mode = spec.get("mode")
    if mode not in MODES:
        raise SelectorError(f"unknown population mode {mode!r}")
    chosen = df
    if mode == "lifecycle":
        if not spec.get("selector"):
            raise SelectorError("mode 'lifecycle' needs a selector")
        chosen = df.where(compile_selector(df, spec.get("selectors", {}), spec["selector"]))
    return snapshot_scan(chosen, spec["sort_field"], spec["max_records"]) if spec.get("max_records") and spec.get("sort_field") else chosen


def seeded_sample(df: DataFrame, required: list[str], id_column: str, n: int, seed: int) -> DataFrame:
    """``n`` rows that have all required fields, in a seeded hash order."""
    for c in required:
        df = df.where(F.col(c).isNotNull())
    return df.orderBy(F.md5(F.concat(F.lit(str(seed)), F.col(id_column).cast("string"))), id_column).limit(n)
