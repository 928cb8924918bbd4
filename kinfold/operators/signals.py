"""Evidence signals: each prepares columns per record once, and scores a pair of prepared records in [0, 1] or NULL.

NULL means that the signal cannot be evaluated for the pair; 0.0 means that it was, and speaks against it. A blank
never matches a blank.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kinfold.functions.dates import latest_date
from kinfold.functions.paths import path_type, read_path
from kinfold.functions.setsim import best_of, blended_overlap, containment
from kinfold.functions.text import normalize_phone, normalize_text
from kinfold.operators.context import rarity_table, value_rows

IDENTITY = ("name-phonetic", "name-token", "address", "exact-identifier", "shared-token")
MAX_SEED_VALUES = 512
EARLY_DAYS = 180


def token_column(field: str, subfield: str) -> str:
    return f"tok:{field}.{subfield}"


@dataclass
class Context:
    """What a sweep knows of its corpus: configured ignored values, suppressed (path, value) rows, the lifecycle block."""

    ignored: dict[str, list[str]]
    suppressed: DataFrame | None = None
    lifecycle: dict | None = None
    state_field: str | None = None
    cross_field_seed: bool = False


def _fold(values: list[str]) -> list[str]:
    return sorted({v.strip().lower() for v in values})


class Signal:
    def __init__(self, config: dict, index: int, context: Context):
        self.config, self.index, self.context = config, index, context
        self.type, self.weight = config["type"], float(config["weight"])
        self.name, self.conclusive = config.get("name"), bool(config.get("conclusive"))
        self.identity = self.type in IDENTITY

    @property
    def fields(self) -> list[str]:
        """Paths that the signal reads, in the order of its configuration."""
        return list(self.config.get("fields", []))

    @property
    def evidence_key(self) -> str:
        """Signals that read the same fields are one piece of evidence, whatever the analyzer."""
        return "|".join(sorted(set(self.fields))) or self.type

    def column(self, part: str = "") -> str:
        return f"ev{self.index}{part}"

    def prepare(self, df: DataFrame, key: str) -> DataFrame:
        return df

    def score(self, left: str, right: str) -> Column:
        raise NotImplementedError

    def seeds(self, df: DataFrame) -> tuple[dict[str, str], dict[str, str], bool]:
        """{block: token column} of the left and right side, and whether a hit counts 1 instead of its relevance."""
        return {}, {}, False

    def of(self, side: str, part: str = "") -> Column:
        return F.col(side).getField(self.column(part))


class NameSignal(Signal):
    """Best blended overlap of analyzed names over pairs of fields (all of them with ``cross_field``)."""

    def prepare(self, df, key):
        return df.withColumns({self.column(str(i)): F.array_distinct(F.col(f"`{token_column(f, self.config['subfield'])}`")) for i, f in enumerate(self.fields)})

    def score(self, left, right):
        n = range(len(self.fields))
        pairings = [(i, j) for i in n for j in (n if self.config.get("cross_field") else [i])]
        return best_of([blended_overlap(self.of(left, str(i)), self.of(right, str(j))) for i, j in pairings])

    def seeds(self, df):
        own = {f"{f}.{self.config['subfield']}": token_column(f, self.config["subfield"]) for f in self.fields}
        return own, own, False


class AddressSignal(Signal):
    """Equal exact tokens 1; else containment of fuzzy tokens, scaled, and halved where the states differ."""

    def prepare(self, df, key):
        c = self.config
        for i, f in enumerate(self.fields):
            df = df.withColumn(self.column(f"e{i}"), F.array_distinct(F.col(f"`{token_column(f, c['exact_subfield'])}`")))
            df = df.withColumn(self.column(f"f{i}"), F.array_distinct(F.col(f"`{token_column(f, c['fuzzy_subfield'])}`")))
        state = self.context.state_field
        return df.withColumn(self.column("s"), F.nullif(F.col(f"`{state}`").cast("string"), F.lit("")) if state else F.lit(None).cast("string"))

    def score(self, left, right):
        scale = float(self.config.get("fuzzy_scale", 0.7))
        same = F.coalesce(self.of(left, "s") == self.of(right, "s"), F.lit(False)) if self.context.state_field else F.lit(True)
        found = []
        for i in range(len(self.fields)):
            for j in range(len(self.fields)):
                el, er, fl, fr = self.of(left, f"e{i}"), self.of(right, f"e{j}"), self.of(left, f"f{i}"), self.of(right, f"f{j}")
                some = lambda e, f: (F.coalesce(F.size(e), F.lit(0)) > 0) | (F.coalesce(F.size(f), F.lit(0)) > 0)
                exact = (F.size(el) > 0) & (F.size(el) == F.size(er)) & (F.size(F.array_intersect(el, er)) == F.size(el))
                found.append(F.when(some(el, fl) & some(er, fr), F.when(exact, F.lit(1.0)).otherwise(containment(fl, fr) * scale * F.when(same, F.lit(1.0)).otherwise(F.lit(0.5)))))
        return best_of(found)

    def seeds(self, df):
        own = {f"{f}.{self.config['exact_subfield']}": token_column(f, self.config["exact_subfield"]) for f in self.fields}
        return own, own, False


class PooledSignal(Signal):
    """Values pooled over fields, without ignored and suppressed ones; 1 if any is shared."""

    def normal(self, path: str, value: Column) -> Column:
        return normalize_text(value)

    def _pooled(self, df: DataFrame, key: str) -> DataFrame:
        rows = value_rows(df, key, self.fields)
        normal = normalize_text(F.col("value"))
        for p in self.fields:
            normal = F.when(F.col("path") == p, self.normal(p, F.col("value"))).otherwise(normal)
        rows = rows.withColumn("_n", normal).withColumn("_raw", F.lower(F.trim("value"))).where(F.col("_n").isNotNull())
        for p in self.fields:
            bad = _fold([*self.context.ignored.get(p, []), *self.context.ignored.get("*", [])])
            if bad:
                rows = rows.where((F.col("path") != p) | ~(F.col("_raw").isin(bad) | F.col("_n").isin(bad)))
        if self.context.suppressed is not None:
            hot = self.context.suppressed.select(F.col("path").alias("_p"), F.lower(F.trim("value")).alias("_v")).distinct()
            rows = rows.join(hot, (F.col("path") == F.col("_p")) & (F.col("_raw") == F.col("_v")), "left_anti")
        return rows

    def seed_value(self) -> Column:
        """What a value seeds by: its raw form."""
        return F.col("value")

    def prepare(self, df, key):
        rows = self._pooled(df, key)
        pooled = rows.groupBy("_rid").agg(F.collect_set("_n").alias(self.column()), F.collect_set(F.struct("path", self.seed_value().alias("v"))).alias(self.column("v")))
        return df.join(pooled, df[key] == pooled["_rid"], "left").drop("_rid")

    def score(self, left, right):
        a, b = self.of(left), self.of(right)
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.arrays_overlap(a, b).cast("double"))

    def _of_path(self, path: str) -> Column:
        return F.transform(F.filter(self.column("v"), lambda x: x["path"] == path), lambda x: x["v"])

    def seed_columns(self, df: DataFrame) -> DataFrame:
        """Columns of the values that seed: per path on the right, pooled over all paths on the left where they cross."""
        for i, p in enumerate(self.fields):
            df = df.withColumn(self.column(f"r{i}"), F.coalesce(self._of_path(p), F.array().cast("array<string>")))
        pooled = F.slice(F.array_sort(F.array_distinct(F.transform(self.column("v"), lambda x: x["v"]))), 1, MAX_SEED_VALUES)
        return df.withColumn(self.column("l"), F.coalesce(pooled, F.array().cast("array<string>")))


class ExactIdentifierSignal(PooledSignal):
    @property
    def fields(self):
        return [*self.config.get("phone_fields", []), *self.config.get("text_fields", [])]

    def normal(self, path, value):
        return normalize_phone(value) if path in self.config.get("phone_fields", []) else normalize_text(value)

    def seed_value(self):
        phones = self.config.get("phone_fields", [])
        return F.when(F.col("path").isin(phones), F.col("_n")).otherwise(F.col("value")) if phones else F.col("value")

    def seeds(self, df):
        own = {f"{p}.exact": self.column(f"r{i}") for i, p in enumerate(self.fields)}
        return own, own, True


class SharedTokenSignal(PooledSignal):
    def seeds(self, df):
        left = {f"{p}.value": self.column("l") for p in self.fields}
        return left, {f"{p}.value": self.column(f"r{i}") for i, p in enumerate(self.fields)}, True


class RarityWeightedSignal(Signal):
    """The rarest value that both records have, by normalised inverse frequency."""

    @property
    def fields(self):
        return [self.config["name_field"]]

    def prepare(self, df, key):
        rows = value_rows(df, key, self.fields)
        table = rarity_table(rows).select(F.col("value").alias("_v"), "idf")
        own = rows.select("_rid", F.lower(F.trim("value")).alias("_v")).where("_v <> ''").distinct().join(table, "_v")
        packed = own.groupBy("_rid").agg(F.collect_list(F.struct(F.col("_v").alias("v"), "idf")).alias(self.column()))
        return df.join(packed, df[key] == packed["_rid"], "left").drop("_rid")

    def score(self, left, right):
        a, b = self.of(left), self.of(right)
        names = F.transform(b, lambda x: x["v"])
        shared = F.transform(F.filter(a, lambda x: F.array_contains(names, x["v"])), lambda x: x["idf"])
        return F.when((F.size(a) > 0) & (F.size(b) > 0), F.coalesce(F.array_max(shared), F.lit(0.0)))


class TemporalSignal(Signal):
    """How soon after one record's end the other began."""

    def __init__(self, config, index, context):
        super().__init__(config, index, context)
        if not context.lifecycle:
            raise ValueError("a temporal signal needs a lifecycle block")

    @property
    def fields(self):
        return [self.context.lifecycle["shutdown_date"], self.context.lifecycle["registration_date"]]

    def score(self, left, right):
        gap = gap_days(left, right)
        most = float(self.config.get("max_gap_days", 365))
        after = F.greatest(F.lit(0.0), 1 - gap / F.lit(most))
        before = F.greatest(F.lit(0.0), (1 - F.least(F.lit(1.0), F.abs(gap) / F.lit(float(EARLY_DAYS)))) * 0.5)
        return F.when(gap.isNotNull(), F.when(gap >= 0, after).otherwise(before))


def lifecycle_columns(df: DataFrame, lifecycle: dict | None) -> DataFrame:
    """Latest shutdown and registration date, and the reason that goes with the former."""
    if not lifecycle:
        none = F.lit(None)
        return df.withColumns({"ev_shutdown": none.cast("date"), "ev_registered": none.cast("date"), "ev_reason": none.cast("string")})
    out = {}
    for name, path in (("ev_shutdown", lifecycle["shutdown_date"]), ("ev_registered", lifecycle["registration_date"])):
        out[name] = latest_date(read_path(df, path), isinstance(path_type(df.schema, path), T.ArrayType))
    reason = lifecycle.get("shutdown_reason")
    if reason is None:
        out["ev_reason"] = F.lit(None).cast("string")
    elif isinstance(path_type(df.schema, reason), T.ArrayType):
        both = F.arrays_zip(F.transform(read_path(df, lifecycle["shutdown_date"]), lambda d: latest_date(d, False)).alias("d"), read_path(df, reason).alias("r"))
        out["ev_reason"] = F.array_max(F.filter(both, lambda x: x["d"].isNotNull()))["r"].cast("string")
    else:
        out["ev_reason"] = read_path(df, reason).cast("string")
    return df.withColumns(out)


def gap_days(left: str, right: str) -> Column:
    return F.date_diff(F.col(right).getField("ev_registered"), F.col(left).getField("ev_shutdown"))


REGISTRY: dict[str, type[Signal]] = {
    "name-phonetic": NameSignal,
    "name-token": NameSignal,
    "address": AddressSignal,
    "exact-identifier": ExactIdentifierSignal,
    "shared-token": SharedTokenSignal,
    "rarity-weighted-value": RarityWeightedSignal,
    "temporal": TemporalSignal,
}


def build_signals(configs: list[dict], context: Context) -> list[Signal]:
    unknown = [c["type"] for c in configs if c["type"] not in REGISTRY]
    if unknown:
        raise ValueError(f"unknown signal types {unknown}; known are {sorted(REGISTRY)}")
    return [REGISTRY[c["type"]](c, i, context) for i, c in enumerate(configs)]
