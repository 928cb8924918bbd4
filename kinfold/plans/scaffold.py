"""A starting configuration for a raw table: types from its profile, and keys to decide left as TODO that validation refuses."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame

from kinfold.operators.profile import field_types, profile_columns, usage


def scaffold(df: DataFrame, name: str, source: str, root: str | Path) -> Path:
    """Write configuration.json, index-config, mappings and an unfinished entity-match file; the profile has a row per column."""
    rows = {r["column"]: r for r in usage(field_types(profile_columns(df))).collect()}
    keys = [c for c in df.columns if rows[c]["distinct_values"] == rows[c]["total"]]
    step = Path(root) / "configuration" / name
    step.mkdir(parents=True, exist_ok=True)
    (Path(root) / "data" / name).mkdir(parents=True, exist_ok=True)

    def put(path: Path, value) -> None:
        path.write_text(json.dumps(value, indent=2))

    match = step.with_name(f"{name}-match")
    match.mkdir(parents=True, exist_ok=True)
    dates = [c for c in df.columns if rows[c]["looks_like_date"] or rows[c]["field_type"] == "date"]
    legacy = [c for c in dates if rows[c]["field_type"] != "date"]
    load = ["enrichment-policies", "pipelines", "index-create", "index-map", "index-populate"]
    put(Path(root) / "configuration.json", {"steps": [{"name": name, "phases": load}, {"name": match.name, "phases": ["validate", "entity-match"]}], "configurationDir": "configuration", "dataDir": "data"})
    pipeline = [*({"join-key": {"field": c}} for c in keys[:1]), *({"legacy-date": {"field": c}} for c in legacy)]
    put(step / "enrichment-policies.json", [])
    put(step / "pipelines.json", [{"name": f"{name}-in", "processors": pipeline}] if pipeline else [])
    put(step / "index-config.json", {"alias": name, "index": name + "-{now/d}", "source": source, **({"pipeline": f"{name}-in"} if pipeline else {}), **({"id_field": keys[0]} if keys else {"__TODO_id_field__": sorted(rows)})})
    put(step / "mappings.json", {c: {"type": rows[c]["field_type"]} | ({"fields": {"clean": "name_clean"}} if rows[c]["field_type"] == "text" and rows[c]["usage"] == "fingerprint" else {}) for c in df.columns})
    put(match / "index-config.json", {"alias": match.name, "index": match.name + "-{now/d}"})
    sweep = {"source_index": name, "source_settings_step": name, "entity": {"key": keys[0] if keys else "__TODO_key__"}, "population": {"mode": "all-entities"}, "candidates": {}}
    sweep |= {"__TODO_signals__": [c for c in df.columns if rows[c]["usage"] == "fingerprint"], "scoring": {}} | ({"__TODO_lifecycle__": dates} if dates else {})
    for folder in (step, match):  # the first to be seen beside the data, the second to be run
        put(folder / "entity-match.json", sweep)
    return step
