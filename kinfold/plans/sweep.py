"""The sweep: select, retrieve candidates, score, guard, cap, and explain, as one DataFrame program."""

from __future__ import annotations

import datetime as dt
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinfold.functions.ids import pair_id
from kinfold.functions.paths import read_path
from kinfold.functions.text import ANALYZERS, Binding, fingerprint
from kinfold.operators import blocking, scoring
from kinfold.operators.context import suppressed, value_rows
from kinfold.operators.population import population
from kinfold.operators.signals import Context, PooledSignal, Signal, build_signals, gap_days, lifecycle_columns, token_column

DEFAULT_CANDIDATES = 500


@dataclass(frozen=True)
class Provenance:
    source_index: str
    source_alias: str | None = None
    analysis_fingerprint: str | None = None
    run_id: str = ""
    generated_at: str = ""

    def columns(self) -> dict:
        run, at = self.run_id or uuid.uuid4().hex, self.generated_at or dt.datetime.now(dt.UTC).isoformat(timespec="seconds")
        texts = {"run_id": run, "generated_at": at, "source_index": self.source_index, "source_alias": self.source_alias, "analysis_fingerprint": self.analysis_fingerprint}
        return {k: F.lit(v).cast("string") for k, v in texts.items()}


def analyze(df: DataFrame, bindings: list[Binding], encode=None) -> DataFrame:
    """Add a token column (with repeats) per field and subfield; ``encode(df, column, kind)`` turns tokens into phonetic codes."""
    for b in bindings:
        for subfield, name in b.subfields.items():
            a = ANALYZERS[name]
            column = token_column(b.field, subfield)
            df = df.withColumn(column, a.tokens(F.col(f"`{b.field}`")))
            if a.phonetic:
                if encode is None:
                    from kinfold.functions.phonetic import encode_column as encode
                df = encode(df, column, a.phonetic)
    return df


def side_names(mode: str) -> tuple[str, str]:
    return ("predecessor", "successor") if mode == "lifecycle" else ("left", "right")


def preflight(df: DataFrame, signals: list[Signal], expected: str | None = None, actual: str | None = None) -> list[str]:
    """Notes worth logging; what would make every score NULL raises."""
    if df.isEmpty():
        raise ValueError("the source table is empty")
    wanted = {token_column(f, s.config[k]) for s in signals for f in s.config.get("fields", []) for k in ("subfield", "exact_subfield", "fuzzy_subfield") if k in s.config}
    missing = sorted(wanted - set(df.columns))
    if missing:
        raise ValueError(f"scored subfields that were not analyzed: {missing}")
    return ["the table was analyzed by other analyzers than configured"] if expected and actual and expected != actual else []


def corpus_context(df: DataFrame, config: dict, key: str) -> Context:
    """Ignored values from the configuration, and values on more records than their field's limit."""
    pooled = [s for s in config["signals"] if s["type"] in ("exact-identifier", "shared-token")]
    paths, own = [], {}
    for s in pooled:
        for p in [*s.get("fields", []), *s.get("phone_fields", []), *s.get("text_fields", [])]:
            paths.append(p)
            if "max_shared_entities" in s:
                own[p] = s["max_shared_entities"]
    hot = suppressed(value_rows(df, key, list(dict.fromkeys(paths))), config.get("max_shared_records", {}), own) if paths else None
    return Context(config.get("ignore_values", {}), hot, config.get("lifecycle"), config.get("state_field"))


def _once(df: DataFrame) -> DataFrame:
    """Columns computed up to here are computed once: no filter moves below a number that depends on the row's place.

    The optimiser would else copy the scores' array functions into every guard that reads them.
    """
    return df.withColumn("_at", F.monotonically_increasing_id()).where("_at >= 0").drop("_at")


def sweep(entities: DataFrame, config: dict, provenance: Provenance | None = None, rank: str | None = None, max_block_df: int | None = None, count_fired: bool | None = None, observation: Observation | None = None) -> DataFrame:
    """Scored, explained pairs of ``entities`` (analyzed: with token columns).

    ``rank``, ``max_block_df`` (candidates) and ``count_fired`` (scoring) are read from the configuration where not given.
    ``observation`` gets scores (candidate pairs) and scores_failed (those that no signal could evaluate) when the result is written.
    Evidence is prepared once per record; the candidate join carries ids only, and prepared records are joined to the
    pairs that are left after the top-K cut.
    """
    key, mode = config["entity"]["key"], config["population"]["mode"]
    rank, max_block_df = rank or config["candidates"].get("rank", "bm25"), max_block_df or config["candidates"].get("max_block_df")
    lifecycle = config.get("lifecycle") if mode == "lifecycle" else None
    context = corpus_context(entities, config, key)
    context.lifecycle = lifecycle or config.get("lifecycle")
    signals = build_signals(config["signals"], context)
    prepared = lifecycle_columns(entities, lifecycle)
    for s in signals:
        prepared = s.prepare(prepared, key)
    pooled = [s for s in signals if isinstance(s, PooledSignal)]
    for s in pooled:
        prepared = s.seed_columns(prepared)
    chosen = population(prepared, config["population"])

    seed_types = set(config["candidates"].get("seed_signals") or [])
    left_blocks, right_blocks, exact = {}, {}, set()
    for s in signals:
        if s.type in seed_types:
            left, right, constant = s.seeds(prepared)
            left_blocks |= {f"{s.index}:{b}": c for b, c in left.items()}
            right_blocks |= {f"{s.index}:{b}": c for b, c in right.items()}
            exact |= {f"{s.index}:{b}" for b in right} if constant else set()
    if not left_blocks:
        raise ValueError("no configured signal seeds candidates")
    quoted = lambda blocks: {b: f"`{c}`" for b, c in blocks.items()}
    posted = blocking.weighted(blocking.postings(prepared, f"`{key}`", quoted(right_blocks)), rank, max_block_df, tuple(sorted(exact)))
    asked = blocking.postings(chosen, f"`{key}`", quoted(left_blocks))
    k = config["candidates"].get("max_candidates", DEFAULT_CANDIDATES)
    found = blocking.candidates(asked, posted, k)

    summary = [F.col(f"`{key}`").alias("entity_key")]
    if config["entity"].get("key_label"):
        summary.append(F.col(f"`{key}`").alias(config["entity"]["key_label"]))
    summary += [read_path(entities, f).alias(f) for f in config["entity"].get("summary_fields", [])]
    evidence = [F.col(f"`{c}`") for c in prepared.columns if c.startswith("ev")]
    record = prepared.select(F.col(f"`{key}`").alias("_id"), F.struct(*evidence, F.struct(*summary).alias("_summary")).alias("_rec"))
    pairs = found.join(record.withColumnsRenamed({"_id": "l", "_rec": "a"}), "l").join(record.withColumnsRenamed({"_id": "r", "_rec": "b"}), "r")
    pairs = pairs.withColumn("gap_days", gap_days("a", "b") if lifecycle else F.lit(None).cast("int"))
    pairs = _once(pairs.withColumns({f"_s{s.index}": s.score("a", "b") for s in signals}))
    scores = [F.col(f"_s{s.index}") for s in signals]
    pairs = _once(pairs.withColumns({"evidence": scoring.contributions(signals, scores), "total": scoring.total_score([s.weight for s in signals], scores)}))
    if observation is not None:
        pairs = pairs.observe(observation, F.count("*").alias("scores"), F.count_if(F.col("total").isNull()).alias("scores_failed"))
    rules = dict(config["scoring"])
    if not lifecycle:
        rules["min_gap_days"] = rules["max_gap_days"] = None
    fired, undirected = bool(rules.pop("count_fired", False)) if count_fired is None else count_fired, rules.pop("undirected", False)
    kept = scoring.guarded(pairs, rules, {s.type for s in signals if s.conclusive}, fired)
    kept = scoring.capped(kept, "l", "r", rules.get("max_pairs_per_predecessor") or scoring.DEFAULTS["max_pairs_per_predecessor"], "rank")
    kept = scoring.described(scoring.undirected(kept, "l", "r") if undirected else kept)
    left, right = side_names(mode)
    first, second = F.col("a._summary"), F.col("b._summary")
    if lifecycle:
        first = first.withField("shutdown_date", F.col("a.ev_shutdown")).withField("shutdown_reason", F.col("a.ev_reason"))
        second = second.withField("add_date", F.col("b.ev_registered"))
    out = kept.select(pair_id(F.col("l"), F.col("r")).alias("_id"), first.alias(left), second.alias(right), "total_score", "gap_days", "signals_present", "matched_on", "signals", "truncated")
    return out.withColumns(provenance.columns()) if provenance else out


def spec_fingerprint(bindings: list[Binding]) -> str | None:
    used = {n for b in bindings for n in b.subfields.values()}
    return fingerprint({n: ANALYZERS[n] for n in used}, bindings)
