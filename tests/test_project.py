import json

import pytest
from pyspark.sql import types as T

from kinfold.plans.project import Project
from kinfold.plans.scaffold import scaffold
from kinfold.sources.catalog import Catalog
from kinfold.sources.tables import read_csv
from kinfold.streaming.incremental import upsert_stream


def write(path, value):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(value if isinstance(value, str) else json.dumps(value))


def test_project_from_files_to_pairs(spark, tmp_path):
    c = tmp_path / "configuration"
    write(tmp_path / "configuration.json", {"configurationDir": "configuration", "dataDir": "data", "steps": [
        {"name": "orders", "phases": ["index-create", "index-populate"]},
        {"name": "setup", "phases": ["enrichment-policies", "pipelines"]},
        {"name": "firms", "phases": ["index-create", "index-map", "index-populate"]},
        {"name": "pairs", "phases": ["validate", "entity-match"]}]})
    write(tmp_path / "data/orders/o.csv", "firm,d,status\n1,2021-03-01,ACTIVE\n1,NA,x\n9,2020-01-01,ACTIVE\n")
    write(tmp_path / "data/firms/f.csv", "id,name,added\n001,Blue Line,01-JAN-10\n2.0,Blue Line,2021-04-01\n3,Other,31-FEB-21\n3,Other Firm,2020-01-01\n")
    write(c / "orders/index-config.json", {"alias": "orders", "index": "orders-{now/d}", "source": "o.csv"})
    write(c / "setup/enrichment-policies.json", [{"name": "orders", "match": {"indices": "orders", "match_field": "firm", "enrich_fields": ["d", "status"]}}])
    write(c / "setup/pipelines.json", [{"name": "firm-in", "processors": [{"join-key": {"field": "id"}}, {"legacy-date": {"field": "added"}}, {"enrich": {"policy_name": "orders", "field": "id", "target_field": "orders", "max_matches": 5}}]}])
    write(c / "firms/index-config.json", {"alias": "firms", "index": "firms-{now/d}", "source": "f.csv", "id_field": "id", "pipeline": "firm-in"})
    write(c / "firms/mappings.json", {"name": {"type": "text", "fields": {"clean": "name_clean"}}, "id": {"type": "keyword"}})
    write(c / "pairs/index-config.json", {"alias": "pairs", "index": "pairs-{now/d}"})
    write(c / "pairs/entity-match.json", {"source_index": "firms", "source_settings_step": "firms", "entity": {"key": "id"}, "lifecycle": {"shutdown_date": "orders.d", "registration_date": "added"},
        "population": {"mode": "lifecycle", "selector": "s", "selectors": {"s": {"term": {"orders.status": "ACTIVE"}}}}, "candidates": {"max_candidates": 5, "seed_signals": ["name-token"]},
        "signals": [{"type": "name-token", "weight": 1.0, "fields": ["name"], "subfield": "clean"}, {"type": "temporal", "weight": 0.5}], "scoring": {"min_signals": 2}})
    catalog = Catalog(spark, tmp_path / "tables")
    project = Project(spark, tmp_path, catalog)
    project.run()
    firms = {r["id"]: r for r in catalog.read("firms").collect()}
    assert set(firms) == {"1", "2", "3"} and firms["3"]["name"] == "Other Firm" and firms["1"]["added"] == "2010-01-01" and len(firms["1"]["orders"]) == 2
    pair, = catalog.read("pairs").collect()
    assert (pair["predecessor"]["entity_key"], pair["successor"]["entity_key"], pair["gap_days"]) == ("1", "2", 31)
    assert pair["source_index"].startswith("firms-") and catalog.meta(catalog.resolve("pairs")[0])["analysis_fingerprint"]
    write(tmp_path / "configuration.json", {"configurationDir": "c", "dataDir": "d", "steps": [{"name": "x", "phases": ["nope"]}]})
    with pytest.raises(ValueError):
        project.run()


def test_scaffold_leaves_decisions_open(spark, tmp_path):
    write(tmp_path / "in.csv", "k,name,zip\n1,Alpha Works,01234\n2,Beta Works,01234\n3,Gamma Works,05678\n")
    step = scaffold(read_csv(spark, str(tmp_path / "in.csv")), "t", "in.csv", tmp_path / "p")
    mapping = json.loads((step / "mappings.json").read_text())
    assert mapping["zip"]["type"] == "keyword" and mapping["k"]["type"] == "long"
    from kinfold.plans.config import check_sweep_shape

    assert any("__TODO_signals__" in x for x in check_sweep_shape(json.loads((step / "entity-match.json").read_text())))


def test_stream_upserts(spark, tmp_path):
    catalog = Catalog(spark, tmp_path / "cat")
    catalog.create("t")
    schema = T.StructType([T.StructField("k", T.StringType()), T.StructField("v", T.StringType())])
    for rows in ([("1", "a"), ("2", "b")], [("2", "c"), ("3", "d"), ("3", "e")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        q = upsert_stream(spark, str(tmp_path / "in"), schema, catalog, "t", "k", str(tmp_path / "cp"))
        q.awaitTermination(120)
    assert {r["k"]: r["v"] for r in catalog.read("t").collect()} == {"1": "a", "2": "c", "3": "e"}


def test_catalog_by_uri_keeps_one_version(spark, tmp_path):
    catalog = Catalog(spark, f"file:{tmp_path}/cat")
    frame = lambda rows: spark.createDataFrame(rows, "_id string, v string")
    assert catalog.create("t") and not catalog.create("t")
    with pytest.raises(ValueError):
        catalog.read("t")
    catalog.write("t", frame([("1", "a"), ("2", "b")]))
    before = catalog.read("t")
    catalog.upsert("t", frame([("2", "c"), ("3", "d")]))
    catalog.write("t", frame([("4", "e")]), "append")
    assert {r["_id"]: r["v"] for r in catalog.read("t").collect()} == {"1": "a", "2": "c", "3": "d", "4": "e"}
    assert len([n for n in catalog.files.names("t") if n.startswith("data-")]) == 1 and before.columns == ["_id", "v"]
    catalog.write("u", frame([("9", "z")]))
    catalog.swap_alias("both", "t")
    catalog.swap_alias("both", "u", retain=True)
    assert catalog.resolve("both") == ["t", "u"] and catalog.read("both").count() == 5
    catalog.put_pipeline("p", [{"remove": {"field": "v"}}])
    assert Catalog(spark, str(tmp_path / "cat")).pipeline("p") == [{"remove": {"field": "v"}}]
    with pytest.raises(ValueError):
        catalog.pipeline("q")
    assert catalog.meta("none") == {} and catalog.resolve("none") == []


def test_command_line(spark, tmp_path, capsys):
    from kinfold.__main__ import main

    c, tables = tmp_path / "p/configuration", str(tmp_path / "tables")
    rows = "".join(f"{i},Firm{i // 2} Works{i // 4}\n" for i in range(12))
    write(tmp_path / "p/data/firms/f.csv", "id,name\n" + rows)
    write(tmp_path / "p/configuration.json", {"configurationDir": "configuration", "dataDir": "data", "steps": [{"name": "firms", "phases": ["index-create", "index-populate"]}, {"name": "pairs", "phases": ["validate", "entity-match"]}]})
    write(c / "firms/index-config.json", {"alias": "firms", "index": "firms-1", "source": "f.csv", "id_field": "id", "multi_line": False})
    write(c / "firms/mappings.json", {"name": {"type": "text", "fields": {"clean": "name_clean"}}, "id": {"type": "keyword"}})
    match = {"source_index": "firms", "source_settings_step": "firms", "entity": {"key": "id", "summary_fields": ["name"]}, "population": {"mode": "all-entities"}, "candidates": {"seed_signals": ["name-token"], "max_block_df": 4, "rank": "idf"},
             "signals": [{"type": "name-token", "weight": 1.0, "fields": ["name"], "subfield": "clean"}], "scoring": {"min_signals": 1, "min_total_score": 0.3}}
    for name, more in (("pairs", {}), ("fewer", {"undirected": True})):
        write(c / "pairs/index-config.json", {"alias": name, "index": f"{name}-1"})
        write(c / "pairs/entity-match.json", match | {"scoring": match["scoring"] | more})
        assert main(["run", str(tmp_path / "p"), "--tables", tables, *(["--step", "pairs"] if more else [])], spark) == 0
    catalog = Catalog(spark, tables)
    assert catalog.read("pairs").count() == 2 * catalog.read("fewer").count() == 36
    assert catalog.meta("pairs-1")["sweep"] == {"lookups": 12, "lookups_failed": 0, "scores": 36, "scores_failed": 0}
    write(tmp_path / "m.json", {"metrics": [{"name": "pairs"}, {"name": "strong", "filter": {"score_gte": 0.9}}]})
    write(tmp_path / "e.json", {"pairs": "must_not_fall"})
    assert main(["metrics", "pairs", str(tmp_path / "m.json"), "--tables", tables, "--out", str(tmp_path / "r.json")], spark) == 0
    assert json.loads((tmp_path / "r.json").read_text()) == {"pairs": 36, "strong": 12}
    same = ["metrics", "fewer", str(tmp_path / "m.json"), "--tables", tables, "--baseline", str(tmp_path / "r.json")]
    assert main(same, spark) == 0 and main([*same, "--expect", str(tmp_path / "e.json")], spark) == 1
    assert main(["compare", "pairs", "fewer", str(tmp_path / "m.json"), "--tables", tables, "--expect", str(tmp_path / "e.json")], spark) == 1
    assert main(["ids", "pairs", "pairs", "--tables", tables], spark) == 0 and main(["ids", "pairs", "fewer", "--tables", tables], spark) == 1
    assert main(["coverage", str(tmp_path / "p/data/firms/f.csv"), str(c / "firms/mappings.json")], spark) == 0
    write(tmp_path / "short.json", {"id": {"type": "keyword"}, "zip": {"type": "keyword"}})
    assert main(["coverage", str(tmp_path / "p/data/firms/f.csv"), str(tmp_path / "short.json")], spark) == 1
    assert main(["sample", "pairs", str(tmp_path / "s"), "--tables", tables, "--per-band", "5"], spark) == 0
    assert len([x for f in (tmp_path / "s").glob("part-*") for x in f.read_text().splitlines()]) == 10
    write(tmp_path / "bad.json", {"metrics": [{"name": "a"}, {"name": "a"}]})
    assert main(["metrics", "pairs", str(tmp_path / "bad.json"), "--tables", tables], spark) == 2 and main(["ids", "none", "pairs", "--tables", tables], spark) == 2
    assert main(["new", str(tmp_path / "p/data/firms/f.csv"), "firms", str(tmp_path / "new")], spark) == 0
    assert "candidate_only" in capsys.readouterr().out


def test_policies_that_drift_are_told(spark, tmp_path, caplog):
    catalog = Catalog(spark, tmp_path / "t")
    catalog.write("o-1", spark.createDataFrame([("1", "a"), ("1", "b"), (None, "c")], "firm string, d string"))
    catalog.swap_alias("orders", "o-1")
    write(tmp_path / "configuration.json", {"configurationDir": "c", "dataDir": "d", "steps": [{"name": "s", "phases": ["enrichment-policies"]}]})
    policy = {"name": "orders", "match": {"indices": "orders", "match_field": "firm", "enrich_fields": ["d"]}}
    write(tmp_path / "c/s/enrichment-policies.json", [policy])
    Project(spark, tmp_path, catalog).run()
    assert catalog.policy("orders") == {"source": "orders", "match_field": "firm", "fields": ["d"], "documents": 3, "with_key": 2, "keys": 1} and not caplog.records
    write(tmp_path / "c/s/enrichment-policies.json", [{**policy, "match": policy["match"] | {"match_field": "d", "enrich_fields": ["firm"]}}])
    Project(spark, tmp_path, catalog).run()
    assert "match_field, fields" in caplog.text


def test_sweep_ceilings_and_persisted_results(spark, tmp_path):
    from kinfold.operators import metrics, stats

    metrics.sweep_ceilings(spark.createDataFrame([(0, 0, 9, 100)], "lookups_failed int, lookups int, scores_failed int, scores int"))
    with pytest.raises(RuntimeError):
        metrics.sweep_ceilings(spark.createDataFrame([(0, 5, 10, 100)], "lookups_failed int, lookups int, scores_failed int, scores int"))
    catalog = Catalog(spark, tmp_path / "t")
    for run in "ab":
        stats.persist_results(catalog, "validation", {"bands": spark.createDataFrame([("x", 1.0)], "band string, rate double"), "lift": spark.createDataFrame([(2.0,)], "lift double")}, {"run_id": run})
    got = sorted((r["run_id"], r["view"], r["rate"], r["lift"]) for r in catalog.read("validation").collect())
    assert got == [("a", "bands", 1.0, None), ("a", "lift", None, 2.0), ("b", "bands", 1.0, None), ("b", "lift", None, 2.0)]
