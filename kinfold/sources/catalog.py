"""Versioned tables behind aliases: dated names, upserts, atomic swaps, fingerprints and provenance."""

from __future__ import annotations

import datetime as dt
import json
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from kinfold.sources.files import Files
from kinfold.sources.tables import ROW


def dated_name(pattern: str, now: dt.datetime | None = None) -> str:
    """``{now/d}`` becomes the date, ``{now/s}`` the second."""
    now = now or dt.datetime.now(dt.UTC)
    return pattern.replace("{now/d}", now.strftime("%Y.%m.%d")).replace("{now/s}", now.strftime("%Y.%m.%d.%H.%M.%S"))


def last_wins(df: DataFrame, key: str = "_id", order: str = ROW) -> DataFrame:
    """Upsert by id: of rows with one id the last in reading order stays."""
    w = Window.partitionBy(key).orderBy(F.desc(order))
    return df.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


class Catalog:
    """Tables as Parquet folders under a root in any store that Hadoop's FileSystem reaches.

    Each table has ``_table.json`` with its settings and the name of its present data folder; a new version is written beside
    the present one and the name exchanged in one step, so readers and lost executors never see half of it. Aliases are small
    files, exchanged alike.
    """

    def __init__(self, spark: SparkSession, root: str | Path):
        self.spark, self.files = spark, Files(spark, str(root))
        self.files.make("aliases")

    def create(self, name: str, settings: dict | None = None, fingerprint: str | None = None) -> bool:
        """False if the table was there already."""
        if self.files.exists(name):
            return False
        self.files.make(name)
        self.stamp(name, {"settings": settings or {}, "analysis_fingerprint": fingerprint})
        return True

    def meta(self, name: str) -> dict:
        return json.loads(self.files.read(f"{name}/_table.json") or "{}")

    def stamp(self, name: str, more: dict) -> None:
        self.files.write(f"{name}/_table.json", json.dumps(self.meta(name) | more, sort_keys=True, default=str))

    def put_mapping(self, name: str, mapping: dict[str, str]) -> None:
        """Fixed once set: new columns may join, a changed type is refused."""
        old = self.meta(name).get("mapping", {})
        changed = {c for c in mapping if c in old and old[c] != mapping[c]}
        if changed:
            raise ValueError(f"{name}: types cannot change in place: {sorted(changed)}")
        self.stamp(name, {"mapping": old | mapping})

    def put_pipeline(self, name: str, processors: list[dict]) -> None:
        """Keep a named pipeline beside the tables; putting it again replaces it."""
        self.files.make("pipelines")
        self.files.write(f"pipelines/{name}", json.dumps(processors, sort_keys=True))

    def pipeline(self, name: str) -> list[dict]:
        found = self.files.read(f"pipelines/{name}")
        if found is None:
            raise ValueError(f"no pipeline {name!r}")
        return json.loads(found)

    def put_policy(self, name: str, stored: dict) -> None:
        """Keep what a lookup's snapshot was built by, and its counts."""
        self.files.make("policies")
        self.files.write(f"policies/{name}", json.dumps(stored, sort_keys=True))

    def policy(self, name: str) -> dict:
        return json.loads(self.files.read(f"policies/{name}") or "{}")

    def swap_alias(self, alias: str, name: str, retain: bool = False) -> None:
        """One atomic step: the alias points at ``name`` alone, or also at what it pointed at before."""
        names = [*([x for x in self.resolve(alias) if x != name] if retain else []), name]
        self.files.write(f"aliases/{alias}", json.dumps(names))

    def resolve(self, alias: str) -> list[str]:
        found = self.files.read(f"aliases/{alias}")
        if found is not None:
            return json.loads(found)
        return [alias] if self.files.is_folder(alias) else []

    def _data(self, name: str) -> str | None:
        found = self.meta(name).get("data")
        return self.files.uri(f"{name}/{found}") if found else None

    def write(self, name: str, df: DataFrame, mode: str = "overwrite") -> None:
        """Replace the table's rows by ``df`` (mode ``append``: add them)."""
        if mode == "append" and self._data(name):
            df.write.mode("append").parquet(self._data(name))
            return
        self.files.make(name)
        old, fresh = self.meta(name).get("data"), f"data-{uuid.uuid4().hex}"
        df.write.parquet(self.files.uri(f"{name}/{fresh}"))
        self.stamp(name, {"data": fresh})
        if old:
            self.files.delete(f"{name}/{old}")

    def upsert(self, name: str, df: DataFrame, key: str = "_id") -> None:
        """Rows of ``df`` replace those of equal id; the present data goes when the new version is in place."""
        if self._data(name):
            old = self.spark.read.parquet(self._data(name))
            df = old.join(df.select(key), key, "left_anti").unionByName(df, allowMissingColumns=True)
        self.write(name, df)

    def read(self, alias: str) -> DataFrame:
        names = self.resolve(alias)
        if not names:
            raise ValueError(f"no table or alias {alias!r}")
        frames = [self.spark.read.parquet(self._data(n)) for n in names if self._data(n)]
        if not frames:
            raise ValueError(f"{alias!r} has no rows yet")
        out = frames[0]
        for f in frames[1:]:
            out = out.unionByName(f, allowMissingColumns=True)
        return out


def write_jsonl(df: DataFrame, path: str) -> None:
    """JSON lines with NULLs written, as review samples need."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_record(df: DataFrame, path: str | Path) -> dict:
    """The one row of a metric table as JSON with sorted keys."""
    record = df.first().asDict()
    folder, _, name = str(path).rpartition("/")
    Files(df.sparkSession, folder or ".").write(name, json.dumps(record, sort_keys=True, indent=2, default=float))
    return record
