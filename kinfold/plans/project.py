"""Running a project: steps and phases of its configuration over versioned tables, from raw files to explained pairs."""

from __future__ import annotations

import logging
from collections.abc import Callable
from dataclasses import dataclass, field
from pathlib import Path

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from kinfold.functions.dates import legacy_date_iso
from kinfold.functions.ids import blank_keys, document_id
from kinfold.functions.text import Binding, normalize_join_key
from kinfold.operators.enrich import LookupPolicy, checked_lookup, enrich, lookup_counts
from kinfold.operators.metrics import sweep_ceilings
from kinfold.operators.population import population
from kinfold.operators.signals import Context, build_signals
from kinfold.plans.config import PHASES, check_project_shape, validate
from kinfold.plans.sweep import Provenance, analyze, preflight, spec_fingerprint, sweep
from kinfold.sources.catalog import Catalog, dated_name, last_wins
from kinfold.sources.tables import numbered, pinned, read_csv, read_json_config

Transform = Callable[[DataFrame, str], DataFrame]

#: Processors of ingest pipelines by name: each rewrites one field.
PROCESSORS: dict[str, Transform] = {
    "join-key": lambda df, f: df.withColumn(f, normalize_join_key(F.col(f"`{f}`"))),
    "legacy-date": lambda df, f: df.withColumn(f, legacy_date_iso(F.col(f"`{f}`"))),
    "remove": lambda df, f: df.drop(f),
}


@dataclass
class Project:
    """A folder with ``configuration.json``, a folder of settings per step, and data per step."""

    spark: SparkSession
    root: Path
    catalog: Catalog
    num_rows: int | None = None
    retain_aliases: bool = False
    lookups: dict[str, tuple[DataFrame, LookupPolicy]] = field(default_factory=dict)

    def settings(self, step: str, name: str):
        return read_json_config(self.root / self.config["configurationDir"] / step / f"{name}.json")

    @property
    def config(self) -> dict:
        found = read_json_config(self.root / "configuration.json")
        if found is None:
            raise ValueError(f"{self.root} has no configuration.json")
        wrong = check_project_shape(found)
        if wrong:
            raise ValueError("; ".join(wrong))
        return found

    def run(self, only_step: str | None = None, only_phase: str | None = None) -> None:
        """Every phase of every step in order; an unknown phase is an error."""
        for step in self.config["steps"]:
            if only_step not in (None, step["name"]):
                continue
            for phase in step["phases"]:
                if only_phase in (None, phase):
                    getattr(self, "_" + phase.replace("-", "_"))(step["name"])

    def _table(self, step: str) -> tuple[dict, str]:
        own = self.settings(step, "index-config")
        return own, dated_name(own["index"])

    def _bindings(self, step: str) -> list[Binding]:
        mapping = self.settings(step, "mappings") or {}
        return [Binding(f, dict(spec["fields"])) for f, spec in mapping.items() if spec.get("fields")]

    def _index_create(self, step: str) -> None:
        own, name = self._table(step)
        self.catalog.create(name, fingerprint=spec_fingerprint(self._bindings(step)))
        self.catalog.swap_alias(own["alias"], name, self.retain_aliases)

    def _index_map(self, step: str) -> None:
        _, name = self._table(step)
        self.catalog.put_mapping(name, {f: spec["type"] for f, spec in (self.settings(step, "mappings") or {}).items()})

    def _enrichment_policies(self, step: str) -> None:
        """Snapshots of all lookups; what fails is reported together. A policy that differs from its last snapshot's is said so."""
        wrong, log = [], logging.getLogger(__name__)
        for p in self.settings(step, "enrichment-policies") or []:
            m = p["match"]
            source = m["indices"] if isinstance(m["indices"], str) else m["indices"][0]
            policy = LookupPolicy(p["name"], source, m["match_field"], tuple(m["enrich_fields"]))
            try:
                rows = self.catalog.read(source)
                counts = lookup_counts(rows, policy).first().asDict()
                if counts["documents"] and not counts["keys"]:
                    raise ValueError(f"{policy.name}: no row of {source} has a {policy.match_field}")
            except ValueError as e:
                wrong.append(str(e))
                continue
            drifted = policy.drift(self.catalog.policy(p["name"])) if self.catalog.policy(p["name"]) else []
            if drifted:
                log.warning("%s: the snapshot was built with other %s and is built anew", p["name"], ", ".join(drifted))
            self.catalog.put_policy(p["name"], {"source": source, "match_field": policy.match_field, "fields": list(policy.fields), **counts})
            log.info("%s: %s documents, %s keys", p["name"], counts["documents"], counts["keys"])
            self.lookups[p["name"]] = (rows, policy)
        if wrong:
            raise ValueError("; ".join(wrong))

    def _pipelines(self, step: str) -> None:
        for p in self.settings(step, "pipelines") or []:
            for processor in p["processors"]:
                (kind, spec), = processor.items()
                if kind != "enrich" and kind not in PROCESSORS:
                    raise ValueError(f"{p['name']}: unknown processor {kind!r}")
                if kind == "enrich" and spec["policy_name"] not in self.lookups:
                    raise ValueError(f"{p['name']}: no lookup {spec['policy_name']!r}")
            self.catalog.put_pipeline(p["name"], p["processors"])

    def _index_populate(self, step: str) -> None:
        own, name = self._table(step)
        mapping = self.settings(step, "mappings") or {}
        path = str(self.root / self.config["dataDir"] / step / own["source"])
        df = read_csv(self.spark, path, self.num_rows if self.num_rows is not None else own.get("num_rows"), own.get("skip_rows") or 0, multi_line=own.get("multi_line", True))
        df, loaded = numbered(df), Observation("loaded")
        if own.get("id_field"):
            bare = df.drop("_rowno")
            df = df.withColumn("_id", document_id(bare, own["id_field"]))
            df = last_wins(df.observe(loaded, F.count("*").alias("rows_read"), blank_keys().alias("blank_keys")))
        for processor in self.catalog.pipeline(own["pipeline"]) if own.get("pipeline") else []:
            (kind, spec), = processor.items()
            if kind == "enrich":
                source, policy = self.lookups[spec["policy_name"]]
                df = enrich(df, checked_lookup(source, policy, spec.get("max_matches", 1)), spec["field"], spec["target_field"])
            else:
                df = PROCESSORS[kind](df, spec["field"])
        df = analyze(df.drop("_rowno"), self._bindings(step))
        df = pinned(df, {f: spec["type"] for f, spec in mapping.items() if f in df.columns and spec["type"] not in ("object", "nested")})
        self.catalog.write(name, df)
        if own.get("id_field"):
            self.catalog.stamp(name, loaded.get)

    def _validate(self, step: str) -> None:
        config = self.settings(step, "entity-match")
        source = self.catalog.read(config["source_index"])
        analyzed = {b.field: b.subfields for b in self._bindings(config.get("source_settings_step", step))}
        validate(config, source.schema, analyzed)

    def _entity_match(self, step: str) -> None:
        config, (own, name) = self.settings(step, "entity-match"), self._table(step)
        concrete = self.catalog.resolve(config["source_index"])
        if len(concrete) != 1:
            raise ValueError(f"{config['source_index']} is {len(concrete)} tables")
        expected = spec_fingerprint(self._bindings(config.get("source_settings_step", step)))
        entities = self.catalog.read(config["source_index"])
        signals = build_signals(config["signals"], Context(config.get("ignore_values", {}), lifecycle=config.get("lifecycle")))
        for note in preflight(entities, signals, expected, self.catalog.meta(concrete[0]).get("analysis_fingerprint")):
            logging.getLogger(__name__).warning("%s: %s", step, note)
        scored = Observation("scored")
        pairs = sweep(entities, config, Provenance(concrete[0], config["source_index"], expected), observation=scored)
        self.catalog.create(name)
        self.catalog.write(name, pairs)
        stats = {"lookups": population(entities, config["population"]).count(), "lookups_failed": 0, **scored.get}  # a lookup that fails ends the job
        self.catalog.stamp(name, {"source_index": concrete[0], "analysis_fingerprint": expected, "sweep": stats})
        sweep_ceilings(self.spark.createDataFrame([stats]))  # before the alias moves on
        self.catalog.swap_alias(own["alias"], name, self.retain_aliases)


assert {"_" + p.replace("-", "_") for p in PHASES} <= set(vars(Project))
