"""Command line: run projects, compute and compare metrics, compare pair sets, check mappings, sample and scaffold.

``python -m kinfold COMMAND --help`` tells the arguments. Exit codes: 0 well, 1 a regression or a difference, 2 wrong usage.
"""

from __future__ import annotations

import argparse
import json
import sys
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.operators import metrics, stats
from kinfold.plans.config import check_metrics
from kinfold.plans.project import Project
from kinfold.plans.scaffold import scaffold
from kinfold.plans.session import session
from kinfold.sources.catalog import Catalog, write_jsonl, write_record
from kinfold.sources.tables import read_csv, read_json_config


def _table(rows: list[tuple], header: tuple[str, ...]) -> str:
    text = [tuple("" if v is None else f"{v:g}" if isinstance(v, float) else str(v) for v in r) for r in [header, *rows]]
    widths = [max(len(r[i]) for r in text) for i in range(len(header))]
    return "\n".join("  ".join(c.ljust(w) for c, w in zip(r, widths, strict=True)).rstrip() for r in text)


def run(spark: SparkSession, a: argparse.Namespace) -> int:
    Project(spark, Path(a.project), Catalog(spark, a.tables), num_rows=a.rows, retain_aliases=a.retain_aliases).run(a.step, a.phase)
    return 0


def _compared(baseline: DataFrame, candidate: DataFrame, expectations: dict[str, str]) -> int:
    found = metrics.compare_records(baseline, candidate, expectations)
    rows = [tuple(r[c] for c in ("metric", "baseline", "candidate", "delta", "expectation", "regressed")) for r in found.orderBy("metric").collect()]
    print(_table(rows, ("metric", "baseline", "candidate", "delta", "expectation", "regressed")))
    return int(any(r[-1] for r in rows))


def metric(spark: SparkSession, a: argparse.Namespace) -> int:
    """Metrics of one table of pairs; with a baseline record, the comparison and its exit code."""
    config, expectations = read_json_config(a.config), read_json_config(a.expect) if a.expect else {}
    baseline = read_json_config(a.baseline) if a.baseline else None
    wrong, notes = check_metrics(config, expectations, baseline)
    for line in [*wrong, *notes]:
        print(line, file=sys.stderr)
    if wrong:
        return 2
    record = metrics.run_metrics(Catalog(spark, a.tables).read(a.table), config["metrics"])
    row = write_record(record, a.out) if a.out else record.first().asDict()
    if baseline is None:
        print(_table(sorted(row.items()), ("metric", "value")))
        return 0
    frame = lambda d: spark.createDataFrame([{k: float(v) for k, v in d.items() if v is not None}])
    return _compared(frame(baseline), frame(row), expectations or {})


def compare(spark: SparkSession, a: argparse.Namespace) -> int:
    """The metrics of two tables of pairs, one against the other."""
    catalog, config = Catalog(spark, a.tables), read_json_config(a.config)
    expectations = read_json_config(a.expect) if a.expect else {}
    records = [metrics.run_metrics(catalog.read(t), config["metrics"]) for t in (a.baseline_table, a.candidate_table)]
    return _compared(*records, expectations)


def ids(spark: SparkSession, a: argparse.Namespace) -> int:
    """Pairs that only one of two tables has."""
    catalog = Catalog(spark, a.tables)
    found = metrics.id_difference(catalog.read(a.baseline_table), catalog.read(a.candidate_table), "_id")
    count = {r["side"]: r["count"] for r in found.groupBy("side").count().collect()}
    print(_table([(s, count.get(s, 0)) for s in ("baseline_only", "candidate_only")], ("side", "pairs")))
    for r in found.orderBy("side", "_id").limit(a.show).collect():
        print(r["side"], r["_id"])
    return int(bool(count))


def coverage(spark: SparkSession, a: argparse.Namespace) -> int:
    """Columns of a raw file that its mapping lacks, and mapped fields that the file lacks."""
    columns, mapping = set(read_csv(spark, a.file, 0).columns), set(read_json_config(a.mapping) or {})
    rows = [(c, "not mapped") for c in sorted(columns - mapping)] + [(c, "not in the file") for c in sorted(mapping - columns)]
    print(_table(rows, ("field", "finding")) if rows else f"all {len(columns)} fields are mapped")
    return int(bool(rows))


def sample(spark: SparkSession, a: argparse.Namespace) -> int:
    """A stratified sample of pairs by score band as JSON lines, with an empty verdict, and its counts."""
    pairs = Catalog(spark, a.tables).read(a.table).withColumn("band", stats.score_band(F.col("total_score")))
    chosen = stats.review_sample(pairs, "band", "_id", a.per_band, a.seed)
    write_jsonl(chosen, a.out)
    print(_table([tuple(r) for r in stats.band_counts(pairs, chosen, "band", stats.score_band_names()).collect()], ("band", "total", "sampled")))
    return 0


def new(spark: SparkSession, a: argparse.Namespace) -> int:
    print(scaffold(read_csv(spark, a.file), a.name, Path(a.file).name, a.project))
    return 0


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="kinfold", description=__doc__.splitlines()[0])
    p.add_argument("--master", help="Spark master; a submitted job has its own")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name: str, f, *positional: str, **options) -> None:
        c = sub.add_parser(name, help=(f.__doc__ or "").split("\n")[0] or name)
        for x in positional:
            c.add_argument(x)
        for x, spec in options.items():
            c.add_argument(f"--{x.replace('_', '-')}", **spec)
        c.set_defaults(f=f)

    tables = {"tables": {"required": True, "help": "root folder of the tables, a path or URI"}}
    command("run", run, "project", **tables, step={}, phase={}, rows={"type": int}, retain_aliases={"action": "store_true"})
    command("metrics", metric, "table", "config", **tables, baseline={}, expect={}, out={})
    command("compare", compare, "baseline_table", "candidate_table", "config", **tables, expect={})
    command("ids", ids, "baseline_table", "candidate_table", **tables, show={"type": int, "default": 20})
    command("coverage", coverage, "file", "mapping")
    command("sample", sample, "table", "out", **tables, per_band={"type": int, "default": 25}, seed={"type": int, "default": 0})
    command("new", new, "file", "name", "project")
    return p


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(arguments)
    try:
        return a.f(spark or session("kinfold", master=a.master), a)
    except (ValueError, json.JSONDecodeError) as e:
        print(e, file=sys.stderr)
        return 2


if __name__ == "__main__":
    sys.exit(main())
