"""Validation of a project's configuration in three tiers: shape, coherence, and against the data's schema."""

from __future__ import annotations

from pyspark.sql import types as T

from kinfold.functions.paths import path_type
from kinfold.operators.metrics import RULES
from kinfold.operators.population import KINDS, MODES
from kinfold.operators.signals import REGISTRY

PHASES = ("index-create", "index-map", "enrichment-policies", "pipelines", "index-populate", "entity-match", "validate")

_TEXT, _NUMBER, _INT, _BOOL, _TEXTS = (str,), (int, float), (int,), (bool,), [str]

#: Allowed keys with the types of their values; ``!`` marks needed ones (fixed values).
SHAPES: dict[str, dict] = {
    "entity-match": {"source_index!": _TEXT, "source_settings_step": _TEXT, "entity!": {"key!": _TEXT, "key_label": _TEXT, "summary_fields": _TEXTS}, "lifecycle": {"shutdown_date!": _TEXT, "registration_date!": _TEXT, "shutdown_reason": _TEXT},
                     "population!": {"mode!": MODES, "sort_field": _TEXT, "max_records": (int, type(None)), "selector": _TEXT, "selectors": dict}, "candidates!": {"max_candidates": _INT, "seed_signals": _TEXTS, "rank": ("bm25", "idf"), "max_block_df": (int, type(None))}, "signals!": list,
                     "ignore_values": dict, "max_shared_records": dict, "scoring!": {"min_total_score": _NUMBER, "min_signals": _INT, "require_identity_signal": _BOOL, "max_pairs_per_predecessor": _INT, "min_gap_days": _NUMBER, "max_gap_days": _NUMBER, "count_fired": _BOOL, "undirected": _BOOL}},
    "signal": {"type!": tuple(REGISTRY), "weight!": _NUMBER, "name": _TEXT, "conclusive": _BOOL, "fields": _TEXTS, "subfield": _TEXT, "cross_field": _BOOL, "exact_subfield": _TEXT, "fuzzy_subfield": _TEXT, "fuzzy_scale": _NUMBER,
               "phone_fields": _TEXTS, "text_fields": _TEXTS, "name_field": _TEXT, "max_gap_days": _NUMBER, "max_shared_entities": _INT},
    "configuration": {"steps!": list, "all_phases": _TEXTS, "configurationDir!": _TEXT, "dataDir!": _TEXT, "logLevel": ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")},
    "index-config": {"alias!": _TEXT, "index!": _TEXT, "source": _TEXT, "id_field": (str, list), "num_rows": (int, type(None)), "skip_rows": _INT, "pipeline": _TEXT, "multi_line": _BOOL},
    "metrics": {"baseline": _TEXT, "metrics!": list},
    "metric": {"name!": _TEXT, "filter": dict, "distinct": _TEXT, "ratio": {"numerator!": _TEXT, "denominator!": _TEXT}},
    "policy": {"name!": _TEXT, "match": {"indices!": (str, list), "match_field!": _TEXT, "enrich_fields!": _TEXTS}, "geo_match": dict, "range": dict},
    "pipeline": {"name!": _TEXT, "processors!": list},
}

NEEDS = {"name-phonetic": ("fields", "subfield"), "name-token": ("fields", "subfield"), "address": ("fields", "exact_subfield", "fuzzy_subfield"), "rarity-weighted-value": ("name_field",), "shared-token": ("fields",), "temporal": (), "exact-identifier": ()}


def check_shape(value, shape, path: str = "$") -> list[str]:
    """All findings, sorted by path."""
    return sorted(_shape(value, shape, path))


def _shape(value, shape, path: str) -> list[str]:
    if isinstance(shape, dict):
        if not isinstance(value, dict):
            return [f"{path}: an object is needed"]
        keys = {k.rstrip("!"): s for k, s in shape.items()}
        out = [f"{path}.{k}: unknown key" for k in value if k not in keys]
        out += [f"{path}.{k[:-1]}: missing" for k in shape if k.endswith("!") and k[:-1] not in value]
        for k, s in keys.items():
            if k in value:
                out += _shape(value[k], s, f"{path}.{k}")
        return out
    if shape is dict or shape is list:
        return [] if isinstance(value, shape) else [f"{path}: {shape.__name__} needed"]
    if shape == _TEXTS and isinstance(shape, list):
        return [] if isinstance(value, list) and all(isinstance(x, str) for x in value) else [f"{path}: a list of texts is needed"]
    if all(isinstance(s, type) for s in shape):
        odd = isinstance(value, bool) and bool not in shape
        return [] if isinstance(value, shape) and not odd else [f"{path}: {' or '.join(s.__name__ for s in shape)} needed"]
    return [] if value in shape else [f"{path}: {value!r} is none of {', '.join(map(str, shape))}"]


def check_sweep_shape(config: dict) -> list[str]:
    out = _shape(config, SHAPES["entity-match"], "$")
    for i, s in enumerate(config.get("signals") or []):
        out += _shape(s, SHAPES["signal"], f"$.signals[{i}]")
        if isinstance(s, dict):
            out += [f"$.signals[{i}].{k}: missing" for k in NEEDS.get(s.get("type"), ()) if k not in s]
            if s.get("type") == "exact-identifier" and not (s.get("phone_fields") or s.get("text_fields")):
                out.append(f"$.signals[{i}]: phone_fields or text_fields are needed")
            if isinstance(s.get("weight"), int | float) and s["weight"] < 0:
                out.append(f"$.signals[{i}].weight: under 0")
    for name, clause in ((config.get("population") or {}).get("selectors") or {}).items():
        if not isinstance(clause, dict) or len(clause) != 1 or next(iter(clause)) not in KINDS:
            out.append(f"$.population.selectors.{name}: exactly one of {', '.join(KINDS)} is needed")
    low = (config.get("scoring") or {}).get("min_total_score")
    if isinstance(low, int | float) and not 0 <= low <= 1:
        out.append("$.scoring.min_total_score: outside 0 to 1")
    return sorted(out)


def check_project_shape(config: dict) -> list[str]:
    out = _shape(config, SHAPES["configuration"], "$")
    for i, step in enumerate(config.get("steps") or []):
        out += _shape(step, {"name!": _TEXT, "phases!": _TEXTS}, f"$.steps[{i}]")
        out += [f"$.steps[{i}].phases: unknown phase {p!r}" for p in (step.get("phases") or []) if p not in PHASES]
    return sorted(out)


def check_coherence(config: dict) -> list[str]:
    """Rules that hold between blocks."""
    out, signals = [], config.get("signals") or []
    types, scoring, population = {s.get("type") for s in signals}, config.get("scoring") or {}, config.get("population") or {}
    seeds = (config.get("candidates") or {}).get("seed_signals") or []
    if "temporal" in types and not config.get("lifecycle"):
        out.append("a temporal signal needs a lifecycle block")
    if (scoring.get("min_gap_days") is not None or scoring.get("max_gap_days") is not None) and not config.get("lifecycle"):
        out.append("a gap window needs a lifecycle block")
    if population.get("mode") == "all-entities" and config.get("lifecycle"):
        out.append("a lifecycle block has no effect in mode all-entities")
    out += [f"seed signal {s!r} is not configured" for s in seeds if s not in types]
    out += [f"conclusive signal {s.get('type')!r} does not seed, so it can never carry a pair alone" for s in signals if s.get("conclusive") and s.get("type") not in seeds]
    if signals and sum(float(s.get("weight") or 0) for s in signals) <= 0:
        out.append("all weights are 0")
    if population.get("mode") == "lifecycle":
        out += _resolves(population.get("selectors") or {}, population.get("selector"), ())
    return out


def _resolves(selectors: dict, name: str | None, path: tuple[str, ...]) -> list[str]:
    if not name:
        return ["mode lifecycle needs a selector"]
    if name in path:
        return ["selector cycle: " + " -> ".join((*path, name))]
    if name not in selectors:
        return [f"unknown selector {name!r}"]
    clause = selectors[name]
    return [x for kind in ("all", "any") for n in clause.get(kind, []) for x in _resolves(selectors, n, (*path, name))]


def check_metrics(config: dict, expectations: dict[str, str] | None = None, baseline: dict | None = None) -> tuple[list[str], list[str]]:
    """(findings, warnings) of a metrics file."""
    metrics = config.get("metrics") or []
    out = _shape(config, SHAPES["metrics"], "$")
    for i, m in enumerate(metrics):
        out += _shape(m, SHAPES["metric"], f"$.metrics[{i}]")
    names = [m.get("name") for m in metrics]
    out += [f"metric {n!r} is named twice" for n in sorted({n for n in names if names.count(n) > 1})]
    for m in metrics:
        out += [f"{m['name']}: no metric {p!r}" for p in (m.get("ratio") or {}).values() if p not in names]
    out += [f"{n}: unknown expectation {e!r}" for n, e in (expectations or {}).items() if e not in RULES]
    return out, [f"the baseline lacks {n!r}" for n in names if baseline is not None and n not in baseline]


def check_liveness(config: dict, schema: T.StructType, analyzed: dict[str, dict[str, str]]) -> list[str]:
    """Paths, subfields and terms against what the data has; ``analyzed`` is {field: {subfield: analyzer}}."""
    out = []
    paths = [config["entity"]["key"], *(config["entity"].get("summary_fields") or []), *(v for k, v in (config.get("lifecycle") or {}).items())]
    for s in config.get("signals") or []:
        paths += [*s.get("fields", []), *s.get("phone_fields", []), *s.get("text_fields", []), *([s["name_field"]] if "name_field" in s else [])]
        for f in s.get("fields", []):
            out += [f"{f}: no subfield {s[k]!r}" for k in ("subfield", "exact_subfield", "fuzzy_subfield") if k in s and s[k] not in analyzed.get(f, {})]
    for name, clause in ((config.get("population") or {}).get("selectors") or {}).items():
        if "term" in clause:
            (field, _), = clause["term"].items()
            paths.append(field)
            if analyzed.get(field, {}).get("") is not None:
                out.append(f"{name}: term on the analyzed field {field!r} matches nothing")
        if "nested-exists" in clause:
            spec = clause["nested-exists"]
            paths += [f"{spec['path']}.{f.removeprefix(spec['path'] + '.')}" for f in [spec["require"], *spec.get("terms", {}), *spec.get("range", {})]]
    out += [f"{p}: not in the data" for p in dict.fromkeys(paths) if path_type(schema, p) is None]
    return out


def validate(config: dict, schema: T.StructType | None = None, analyzed: dict[str, dict[str, str]] | None = None) -> None:
    """Run the tiers in order; one that finds anything raises with all of it, and later tiers are not run."""
    tiers = [("shape", lambda: check_sweep_shape(config)), ("coherence", lambda: check_coherence(config))]
    if schema is not None:
        tiers.append(("liveness", lambda: check_liveness(config, schema, analyzed or {})))
    for name, tier in tiers:
        found = tier()
        if found:
            raise ValueError(f"{name}: " + "; ".join(found))
