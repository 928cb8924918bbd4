"""Dotted paths over structs and arrays of structs, at any depth."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def resolve(schema: T.StructType, path: str) -> tuple[str, list[str]] | None:
    """The column that a path begins with (verbatim names, dots included, come first) and the steps below it."""
    names = set(schema.names)
    pieces = path.split(".")
    for n in range(len(pieces), 0, -1):
        if ".".join(pieces[:n]) in names:
            return ".".join(pieces[:n]), pieces[n:]
    return None


def path_type(schema: T.StructType, path: str) -> T.DataType | None:
    """Type of the value at the path, arrays on the way counted once; None if the path is not there."""
    found = resolve(schema, path)
    if found is None:
        return None
    kind: T.DataType = schema[found[0]].dataType
    many = False
    for step in found[1]:
        while isinstance(kind, T.ArrayType):
            kind, many = kind.elementType, True
        if not isinstance(kind, T.StructType) or step not in kind.names:
            return None
        kind = kind[step].dataType
    if many:
        while isinstance(kind, T.ArrayType):
            kind = kind.elementType
        return T.ArrayType(kind)
    return kind


def _descend(c: Column, kind: T.DataType, steps: list[str]) -> tuple[Column, T.DataType] | None:
    if isinstance(kind, T.ArrayType) and steps:
        inner: list = []

        def take(x: Column) -> Column:
            found = _descend(x, kind.elementType, steps)
            inner.append(found)
            return found[0] if found else F.lit(None)

        mapped = F.transform(c, take)
        if not inner[0]:
            return None
        below = inner[0][1]
        return (F.flatten(F.filter(mapped, lambda x: x.isNotNull())), below) if isinstance(below, T.ArrayType) else (mapped, T.ArrayType(below))
    if not steps:
        return c, kind
    if not isinstance(kind, T.StructType) or steps[0] not in kind.names:
        return None
    return _descend(c.getField(steps[0]), kind[steps[0]].dataType, steps[1:])


def read_path(df: DataFrame, path: str) -> Column:
    """Value (or array of the values) at a dotted path; NULL if the path is not there."""
    found = resolve(df.schema, path)
    if found is None:
        return F.lit(None).cast("string")
    base, steps = found
    out = _descend(F.col(f"`{base}`"), df.schema[base].dataType, steps)
    return out[0] if out else F.lit(None).cast("string")


def read_values(df: DataFrame, path: str) -> Column:
    """The path's values as an array of strings, without NULLs; empty if there are none."""
    kind = path_type(df.schema, path)
    if kind is None:
        return F.array().cast("array<string>")
    c = read_path(df, path)
    values = c.cast("array<string>") if isinstance(kind, T.ArrayType) else F.array(c.cast("string"))
    return F.coalesce(F.array_compact(values), F.array().cast("array<string>"))
