import json

import pytest
from pyspark.sql import functions as F

from kinfold.functions.text import Binding
from kinfold.operators import blocking, context, metrics, population, profile, scoring, stats
from kinfold.operators.enrich import LookupPolicy, build_all, build_lookup, enrich, within_gap
from kinfold.operators.signals import AddressSignal, Context, RarityWeightedSignal, TemporalSignal, build_signals
from kinfold.plans import config as checks
from kinfold.plans.sweep import Provenance, analyze, spec_fingerprint, sweep
from kinfold.sources import catalog, tables

CONFIG = {
    "source_index": "firms",
    "entity": {"key": "id", "key_label": "number", "summary_fields": ["name", "absent"]},
    "lifecycle": {"shutdown_date": "orders.d", "registration_date": "added", "shutdown_reason": "orders.why"},
    "population": {"mode": "lifecycle", "sort_field": "id", "selector": "ended", "selectors": {"ended": {"nested-exists": {"path": "orders", "require": "d", "terms": {"status": ["ACTIVE"]}, "range": {"d": {"gte": "2020-01-01"}}}}}},
    "candidates": {"max_candidates": 50, "seed_signals": ["name-token", "exact-identifier", "shared-token"]},
    "signals": [
        {"type": "name-token", "weight": 0.4, "fields": ["name"], "subfield": "clean"},
        {"type": "address", "weight": 0.2, "fields": ["street"], "exact_subfield": "clean", "fuzzy_subfield": "tokens"},
        {"type": "exact-identifier", "weight": 0.2, "phone_fields": ["phone", "fax"], "text_fields": ["mail"]},
        {"type": "shared-token", "weight": 0.1, "fields": ["units.vin"], "conclusive": True, "name": "vehicle"},
        {"type": "temporal", "weight": 0.1, "max_gap_days": 365},
    ],
    "ignore_values": {"phone": ["(000) 000-0000"], "units.vin": ["UNKNOWN"]},
    "max_shared_records": {"*": 3},
    "scoring": {"min_total_score": 0.35, "min_signals": 2, "require_identity_signal": True, "max_pairs_per_predecessor": 2, "min_gap_days": -180, "max_gap_days": 365},
}
SCHEMA = "id string, name string, street string, phone string, fax string, mail string, added string, orders array<struct<d string, status string, why string>>, units array<struct<vin string>>"
BINDINGS = [Binding("name", {"clean": "name_clean"}), Binding("street", {"clean": "street_clean", "tokens": "street_tokens"})]


def firms(spark):
    rows = [
        ("1", "Blue Line Haulage", "100 Main St", "(555) 123-4567", None, None, "2010-01-01", [("2021-03-01", "ACTIVE", "fees"), ("2015-01-01", "INACTIVE", "old")], [("VIN1",), ("UNKNOWN",)]),
        ("2", "Blue Line Haulage", "100 Main Street", None, "555 123 4567", None, "2021-04-01", None, [("VIN1",)]),
        ("3", "Other Firm", "9 Oak Ave", "(000) 000-0000", None, None, "2021-04-01", None, [("UNKNOWN",)]),
        ("4", "Blue Line Haulage", None, None, None, None, "2030-01-01", None, None),
        ("5", "Renamed Entirely", "1 Far Rd", "999", None, None, "2021-05-01", None, [("VIN1",)]),
        ("6", "Quiet", None, "(000) 000-0000", None, None, "2019-01-01", [("2015-01-01", "ACTIVE", "x"), ("2022-01-01", "INACTIVE", "y")], None),
    ]
    return analyze(spark.createDataFrame(rows, SCHEMA), BINDINGS)


def test_lifecycle_sweep(spark):
    out = {(r["predecessor"]["entity_key"], r["successor"]["entity_key"]): r for r in sweep(firms(spark), CONFIG, Provenance("firms-1", run_id="r", generated_at="t")).collect()}
    assert set(out) == {("1", "2"), ("1", "5")}  # 4 is outside the window, 6's elements don't fulfil the selector together
    best = out["1", "2"]
    assert best["_id"] == "1|2" and best["gap_days"] == 31 and best["signals_present"] == 5
    assert best["matched_on"] == ["address", "exact-identifier", "name-token", "shared-token", "temporal"]
    assert best["predecessor"]["shutdown_reason"] == "fees" and best["predecessor"]["number"] == "1" and best["predecessor"]["absent"] is None
    assert best["run_id"] == "r"
    renamed = out["1", "5"]
    assert renamed["total_score"] < 0.35 and "shared-token" in renamed["matched_on"]  # carried by the conclusive signal
    assert {s["signal_type"] for s in renamed["signals"] if s["score"] == 0.0} == {"name-token", "address"}
    assert [s for s in best["signals"] if s["signal_type"] == "shared-token"][0]["signal_name"] == "vehicle"


def test_all_entities_sweep_is_directed_and_gapless(spark):
    config = CONFIG | {"population": {"mode": "all-entities", "sort_field": "id"}, "signals": CONFIG["signals"][:3], "candidates": {"max_candidates": 5, "seed_signals": ["name-token"]}}
    config.pop("lifecycle")
    rows = sweep(firms(spark), config).collect()
    keys = {(r["left"]["entity_key"], r["right"]["entity_key"]) for r in rows}
    assert ("1", "2") in keys and ("2", "1") in keys and all(r["gap_days"] is None for r in rows)
    assert ("1", "4") not in keys  # only the name can be evaluated
    wide = sweep(firms(spark), config | {"scoring": {"min_total_score": 0.0, "min_signals": 1, "max_pairs_per_predecessor": 1}}).collect()
    assert len({r["left"]["entity_key"] for r in wide}) == len(wide)


def test_address_cases(spark):
    df = spark.createDataFrame([(1, "100 Main St", "TX"), (2, "100 MAIN ST", "CA"), (3, "100 Main Ave", "TX"), (4, None, "TX"), (5, "100 Main Ave", "CA")], "id int, street string, st string")
    df = analyze(df, BINDINGS[1:])
    s = AddressSignal({"type": "address", "weight": 1, "fields": ["street"], "exact_subfield": "clean", "fuzzy_subfield": "tokens"}, 0, Context({}, state_field="st"))
    rec = s.prepare(df, "id")
    rec = rec.select("id", F.struct(*[c for c in rec.columns if c.startswith("ev")]).alias("r"))
    pairs = rec.withColumnsRenamed({"id": "a", "r": "x"}).where("a = 1").join(rec.withColumnsRenamed({"id": "b", "r": "y"}).where("b > 1"))
    got = {r["b"]: r["s"] for r in pairs.select("b", s.score("x", "y").alias("s")).collect()}
    assert got[2] == 1.0 and got[4] is None
    assert got[3] == pytest.approx(0.7 * 2 / 3) and got[5] == pytest.approx(0.35 * 2 / 3)


def test_rarity_and_temporal(spark):
    assert [r["idf"] for r in context.rarity_table(spark.createDataFrame([("a",)], "value string")).collect()] == [0.0]
    df = spark.createDataFrame([(1, "common"), (2, "common"), (3, "rare"), (4, " Rare "), (5, None)], "id int, n string")
    s = RarityWeightedSignal({"type": "rarity-weighted-value", "weight": 1, "name_field": "n"}, 0, Context({}))
    rec = s.prepare(df, "id").select("id", F.struct("ev0").alias("r"))
    both = rec.withColumnsRenamed({"id": "a", "r": "x"}).join(rec.withColumnsRenamed({"id": "b", "r": "y"})).select("a", "b", s.score("x", "y").alias("s"))
    got = {(r["a"], r["b"]): r["s"] for r in both.collect()}
    assert got[3, 4] == got[1, 2] == pytest.approx(0.5) and got[1, 3] == 0.0 and got[1, 5] is None
    with pytest.raises(ValueError):
        TemporalSignal({"type": "temporal", "weight": 1}, 0, Context({}))
    with pytest.raises(ValueError):
        build_signals([{"type": "nonsense", "weight": 1}], Context({}))


def test_suppression_and_limits(spark):
    rows = spark.createDataFrame([(i, "p", "v") for i in range(6)] + [(1, "q", "w")], "id int, path string, value string")
    assert [tuple(r) for r in context.suppressed(rows, {"p": 5}).collect()] == [("p", "v", 6)]
    assert context.suppressed(rows, {"p": 6}).count() == 0
    assert context.limit_for("x", {"*": 7}, 3) == 7 and context.limit_for("x", {}, 3) == 3 and context.limit_for("x", {}) == 5


def test_candidates_rank_and_truncate(spark):
    posted = spark.createDataFrame([(1, "b", "t"), (2, "b", "t"), (3, "b", "t"), (4, "b", "u")], "id int, block string, token string").withColumns({"tf": F.lit(1), "dl": F.lit(1)})
    got = blocking.candidates(posted, blocking.weighted(posted, "idf"), 1).collect()
    assert {(r["l"], r["r"], r["truncated"]) for r in got} == {(1, 2, True), (2, 1, True), (3, 1, True)}


def test_selectors(spark):
    df = firms(spark)
    pick = lambda s, n: {r["id"] for r in df.where(population.compile_selector(df, s, n)).select("id").collect()}
    s = {"active": {"term": {"orders.status": "ACTIVE"}}, "recent": {"nested-exists": {"path": "orders", "require": "d", "range": {"orders.d": {"gte": "2022-01-01"}}}}, "both": {"all": ["active", "recent"]}, "one": {"any": ["active", "recent"]}}
    assert pick(s, "active") == {"1", "6"} and pick(s, "both") == {"6"} and pick(s, "one") == {"1", "6"}
    for bad in ({"a": {"all": ["b"]}, "b": {"all": ["a"]}}, {"a": {"all": ["x"]}}, {"a": {"what": 1}}, {"a": {"term": {"id": "1"}, "all": ["a"]}}, {"a": {"term": {"nope": "1"}}}):
        with pytest.raises(population.SelectorError):
            population.compile_selector(df, bad, "a")
    for bad in ({"mode": "x"}, {"mode": "lifecycle"}):
        with pytest.raises(population.SelectorError):
            population.population(df, bad)


def test_enrich_caps_and_keeps_rows(spark):
    left = spark.createDataFrame([("1",), ("2",), (None,)], "k string")
    right = spark.createDataFrame([(1, "c"), (1, "a"), (1, "b"), (None, "z")], "m int, v string")
    policy = LookupPolicy("p", "r", "m", ("v",))
    got = {r["k"]: r["hits"] for r in enrich(left, build_lookup(right, policy, 2), "k", "hits").collect()}
    assert [x["v"] for x in got["1"]] == ["a", "b"] and got["2"] is None and got[None] is None
    with pytest.raises(ValueError):
        build_all([(right.where("m is null"), policy, 2)])
    assert policy.drift({"source": "r", "match_field": "m", "fields": ["w"]}) == ["fields"]


def test_gap_edges(spark):
    got = spark.createDataFrame([(-180,), (-181,), (365,), (366,), (None,)], "g int").where(within_gap(F.col("g"), -180, 365)).collect()
    assert [r[0] for r in got] == [-180, 365, None]


def pairs(spark):
    rows = [(0.7, 5, ["name-token"], 2, ("1", "A"), ("2", "A")), (1.0, None, ["shared-token", "temporal"], 3, ("1", "A"), ("3", None)), (None, -30, [], 1, ("4", None), ("5", None))]
    return spark.createDataFrame(rows, "total_score double, gap_days int, matched_on array<string>, signals_present int, predecessor struct<entity_key string, n string>, successor struct<entity_key string, n string>").withColumn("signals", F.transform("matched_on", lambda x: F.struct(x.alias("signal_type"))))


def test_metric_predicates(spark):
    df = pairs(spark)
    count = lambda p: df.where(metrics.compile_predicate(df, p)).count()
    assert count({}) == 3 and count({"score_gte": 0.7}) == 2 and count({"score_lt": 0.7}) == 1
    assert count({"gap_between": [-30, 5]}) == 2 and count({"not": {"gap_between": [-30, 5]}}) == 1
    assert count({"fields_equal": "n"}) == 1 and count({"matched_identity_equals": ["shared-token"]}) == 1 and count({"matched_on_equals": ["shared-token"]}) == 0
    for bad in ({"x": 1}, {"score_gte": 1, "score_lt": 2}):
        with pytest.raises(ValueError):
            metrics.compile_predicate(df, bad)


def test_metrics_ratio_forward_and_empty(spark):
    m = [{"name": "share", "ratio": {"numerator": "strong", "denominator": "all"}}, {"name": "all"}, {"name": "strong", "filter": {"score_gte": 0.7}}, {"name": "keys", "distinct": "predecessor.entity_key"}]
    assert metrics.run_metrics(pairs(spark), m).first().asDict() == {"share": pytest.approx(2 / 3), "all": 3, "strong": 2, "keys": 2}
    assert metrics.run_metrics(pairs(spark).limit(0), m).first()["share"] == 0.0
    a, b = spark.createDataFrame([(10, 5)], "x long, y long"), spark.createDataFrame([(8, 6)], "x long, y long")
    got = {r["metric"]: r["regressed"] for r in metrics.compare_records(a, b, {"x": "within_10pct", "y": "must_not_rise"}).collect()}
    assert got == {"x": True, "y": True}
    assert metrics.exit_code(metrics.compare_records(a, a, {"x": "must_not_fall"})) == 0
    with pytest.raises(ValueError):
        metrics.compare_records(a, b, {"x": "whatever"})


def test_bands(spark):
    got = spark.createDataFrame([(0.35,), (0.5,), (1.0,), (0.2,), (None,)], "s double").select(stats.score_band(F.col("s"))).collect()
    assert [r[0] for r in got] == ["0.35-0.50", "0.50-0.60", "0.90-1.00", None, None]
    got = spark.createDataFrame([(None,), (0,), (1,), (5,), (21,), (101,)], "n int").select(stats.fleet_band(F.col("n"))).collect()
    assert [r[0] for r in got] == ["unknown", None, "1", "2-5", "21-100", "100+"]
    got = spark.createDataFrame([(-181,), (-180,), (0,), (366,), (None,)], "g int").select(stats.gap_band(F.col("g"))).collect()
    assert [r[0] for r in got] == ["180d+ before", "0-180d before", "under 1y after", "1y+ after", None]


def test_standardisation(spark):
    schema = "s string, hits long, total long"
    flagged = spark.createDataFrame([("a", 1, 10), (None, 2, 10), ("gone", 1, 5)], schema)
    control = spark.createDataFrame([("a", 1, 100), (None, 10, 100)], schema)
    row = stats.standardised_rate(flagged, control, ["s"]).first()
    assert row["standardised_rate"] == pytest.approx(0.055) and row["skipped_strata"] == 1 and row["skipped_rows"] == 5
    assert stats.standardised_rate(flagged, control.limit(0), ["s"]).first()["standardised_rate"] is None
    assert stats.subtract_strata(control, flagged, ["s"]).where("negative").count() == 0


def test_placebo_is_a_permutation(spark):
    df = spark.range(200).select("id", (F.col("id") * 2).alias("v"))
    got = stats.placebo(df, "id", "v", 42).collect()
    assert sorted(r["id"] for r in got) == list(range(200)) and sorted(r["v"] for r in got) == list(range(0, 400, 2))
    assert sum(r["v"] == 2 * r["id"] for r in got) < 20


def test_profile_traps(spark):
    df = spark.createDataFrame([("001", "S1", None, "01-JUN-74"), ("002", "2", " ", "02-JUL-89"), ("003", "3", "x", "03-AUG-20")], "z string, m string, e string, d string")
    p = {r["column"]: r for r in profile.warnings(profile.profile_columns(df)).collect()}
    assert p["z"]["warnings"][0] == "LEADING ZEROS" and p["m"]["warnings"][0] == "MIXED TYPES" and "SPARSE" in p["e"]["warnings"] and "NON-ISO DATES" in p["d"]["warnings"]
    assert profile.coverage(["a", "b"], ["b", "c", "n"], ["n"]) == {"unpinned": ["a"], "dead": ["c"]}
    u = profile.key_uniqueness(spark.createDataFrame([(1, "a"), (1, "a"), (1, "b"), (2, "c")], "k int, v string"), ["k"]).first().asDict()
    assert u == {"total_rows": 4, "distinct_keys": 2, "duplicate_keys": 1, "identical_rows": 1, "real_collisions": 1}


def test_config_tiers(spark):
    assert checks.check_sweep_shape(CONFIG) == [] and checks.check_coherence(CONFIG) == []
    assert "$.oops: unknown key" in checks.check_sweep_shape(CONFIG | {"oops": 1})
    broken = json.loads(json.dumps(CONFIG))
    broken.pop("lifecycle")
    broken["candidates"]["seed_signals"] = ["name-phonetic"]
    found = " ".join(checks.check_coherence(broken))
    assert all(x in found for x in ("temporal", "gap window", "not configured", "conclusive"))
    df = firms(spark)
    analyzed = {"name": {"clean": "name_clean"}, "street": {"clean": "street_clean", "tokens": "street_tokens"}}
    assert checks.check_liveness(CONFIG, df.schema, analyzed) == ["absent: not in the data"]
    with pytest.raises(ValueError, match="^coherence"):
        checks.validate(broken)
    assert checks.check_project_shape({"steps": [{"name": "a", "phases": ["nope"]}], "configurationDir": "c", "dataDir": "d"}) == ["$.steps[0].phases: unknown phase 'nope'"]


def test_csv_and_catalog(spark, tmp_path):
    p = tmp_path / "in.csv"
    p.write_text('id,v w,x\n001,"a\nb",NA\n002,,na\n003,z,N/A\n001,last,null\n')
    df = tables.read_csv(spark, str(p))
    assert [r["id"] for r in df.collect()] == ["001", "002", "003", "001"] and df.first()["v w"] == "a\nb"
    assert [r["x"] for r in df.collect()] == [None, "na", None, None]
    assert [r["id"] for r in tables.read_csv(spark, str(p), num_rows=1, skip_rows=2).collect()] == ["003"]
    rows = tables.numbered(df).withColumn("_id", F.col("id"))
    assert {r["_id"]: r["v w"] for r in catalog.last_wins(rows).collect()}["001"] == "last"
    assert tables.pinned(spark.createDataFrame([("2020-13-01", "x", "5")], "d string, n string, m string"), {"d": "date", "n": "long", "m": "long"}).first().asDict() == {"d": None, "n": None, "m": 5}
    c = catalog.Catalog(spark, tmp_path / "cat")
    for n in ("t-1", "t-2"):
        assert c.create(n, fingerprint="f")
    assert not c.create("t-1")
    c.write("t-1", catalog.last_wins(rows).drop("_rowno"))
    c.upsert("t-1", spark.createDataFrame([("002", "002", "new", None)], "id string, _id string, `v w` string, x string"))
    c.swap_alias("t", "t-2")
    c.swap_alias("t", "t-1")
    assert c.resolve("t") == ["t-1"] and {r["_id"]: r["v w"] for r in c.read("t").collect()}["002"] == "new" and c.read("t").count() == 3
    c.swap_alias("t", "t-2", retain=True)
    assert c.resolve("t") == ["t-1", "t-2"]
    c.put_mapping("t-1", {"a": "long"})
    with pytest.raises(ValueError):
        c.put_mapping("t-1", {"a": "text"})
    assert catalog.dated_name("x-{now/d}") != catalog.dated_name("x-{now/s}")


def test_undirected_keeps_the_better(spark):
    df = spark.createDataFrame([("a", "b", 0.5), ("b", "a", 0.7), ("a", "c", 0.1)], "l string, r string, total double")
    assert {(r["l"], r["r"]) for r in scoring.undirected(df, "l", "r").collect()} == {("b", "a"), ("a", "c")}
    assert spec_fingerprint(BINDINGS) and len(spec_fingerprint(BINDINGS)) == 16


def test_result_rows_and_headroom(spark):
    rows = stats.result_rows({"bands": spark.createDataFrame([("a", 1)], "band string, hits long"), "summary": spark.createDataFrame([(1.5,)], "lift double")}).collect()
    assert {(r["view"], r["band"], r["lift"]) for r in rows} == {("bands", "a", None), ("summary", None, 1.5)}
    assert stats.signal_headroom({"temporal": 0.1, "x": 0.9}, "temporal", 0.25) == pytest.approx({"weight_share": 0.1, "mean_contribution": 0.025, "headroom": 0.075})


def test_ceilings_and_preflight(spark):
    row = "lookups_failed long, lookups long, scores_failed long, scores long"
    metrics.sweep_ceilings(spark.createDataFrame([(0, 10, 9, 100)], row))
    with pytest.raises(RuntimeError):
        metrics.sweep_ceilings(spark.createDataFrame([(1, 10, 0, 100)], row))
    from kinfold.plans.sweep import preflight

    signals = build_signals(CONFIG["signals"][:1], Context({}))
    assert preflight(firms(spark), signals, "a", "b") and not preflight(firms(spark), signals, "a", "a")
    for bad in (firms(spark).limit(0), firms(spark).drop("tok:name.clean")):
        with pytest.raises(ValueError):
            preflight(bad, signals)
