import hashlib
import itertools
import json
import math
import random
import re
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from brute import WORD, anchor_links, anchors, lm_scores as plain_lm, mixed as mixed_plainly, spark_hash, water_fill
from kinfold.llm import chat_format, decontaminate, fingerprint, lm_score, mixing, quality, queries, sharding, token_counts, url_filter
from kinfold.llm._graph import components
from kinfold.llm._kernel import slices, words
from kinfold.llm._ranking import buckets_for, prefix_sum
from oracle import compare

DOCS = "doc_id long, text string"
TEXTS = ["the cat sat on the mat", None, "", " \n", "the cat sat on the mat", "a", "the cat ran. The CAT sat", "ü ö ä straße", "x" * 5000 + " tail", "the cat sat"]


def docs(spark, texts=TEXTS):
    return spark.createDataFrame(list(enumerate(texts)), DOCS)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_matches_sql(spark, sf_dir, name):
    assert compare(queries.QUERIES[name](spark, sf_dir), queries.ORACLE_SQL[name], sf_dir) > 0


def test_every_operator_has_a_query():
    assert {int(n[2:].split("_")[0]) for n in queries.QUERIES if n.startswith("op")} == set(range(1, 11)) and "pipeline" in queries.QUERIES


# kernel, ranking, graph


def test_words_are_those_of_the_pattern():
    texts = ["a b", "", "  ", "ab\tc\x0b\x0cd", "é\u00a0x y", "a b", "A b"]
    batch = pa.record_batch({"text": pa.array([*texts, None])})
    (rows, flat, offs), = slices(iter([batch]), "text")
    h, doc, per = words(flat, offs)
    assert per.tolist() == [len(WORD.findall(t)) for t in texts] + [0]
    by = defaultdict(list)
    for x, d in zip(h.tolist(), doc.tolist(), strict=True):
        by[d].append(x)
    assert by[0] == by[5] != by[6] and words(flat, offs, lower=True)[0][-2:].tolist() == by[0]
    many = list(slices(iter([batch]), "text", 3))
    assert sum(r.num_rows for r, _, _ in many) == len(texts) + 1 and len(many) > 3


def test_prefix_sums_in_groups(spark):
    df = spark.createDataFrame([("a", i, i) for i in range(50)] + [(None, i, 1) for i in range(9)], "g string, k int, v int")
    rows = prefix_sum(df, "g", [F.col("k")], F.col("v"), "before", 4).collect()
    for g in ("a", None):
        own = sorted((r["before"], r["v"]) for r in rows if r["g"] == g)
        at = 0
        for before, v in sorted(own, key=lambda x: (x[0], x[1] != 0)):
            assert before == at
            at += v


def test_components(spark):
    edges = [(1, 2), (2, 3), (10, 11), (5, 3), (20, 21), (21, 22), (22, 23), (23, 20), (7, 7)] + [(100 + i, 101 + i) for i in range(30)]
    got = {r["node"]: r["label"] for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {2: 1, 3: 1, 5: 1, 11: 10, 21: 20, 22: 20, 23: 20} | {101 + i: 100 for i in range(30)}


@pytest.mark.parametrize("most", [0, 1000])
def test_components_in_one_task_and_by_steps(spark, monkeypatch, most):
    from kinfold.llm import _graph

    monkeypatch.setattr(_graph, "ONE_TASK", most)
    r = random.Random(3)
    edges = [(r.randrange(-300, 300), r.randrange(-300, 300)) for _ in range(250)]
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    plan = components(spark.createDataFrame(edges, "a long, b long"))
    assert {r["node"]: r["label"] for r in plan.collect()} == {x: y for x, y in root.items() if x != y}


# 1


def test_lm_scores(spark):
    for texts in (TEXTS, [], [None, ""]):
        got = [tuple(r) for r in lm_score.lm_scores(docs(spark, texts)).orderBy("doc_id").collect()]
        for (d, n, log, mean), (m, total) in zip(got, plain_lm(list(enumerate(texts))), strict=True):
            assert n == m and log == pytest.approx(total, abs=1e-9)
            assert mean == (pytest.approx(total / m, abs=1e-9) if m else None)


@pytest.mark.parametrize("order, least", [(1, 2), (2, 2), (3, 1), (4, 2), (5, 3)])
def test_lm_scores_of_other_orders(spark, monkeypatch, order, least):
    monkeypatch.setattr(lm_score, "CHUNK_BYTES", 200)
    r = random.Random(order)
    texts = [" ".join(r.choice("ab") * r.randint(1, 2) for _ in range(r.randrange(25))) for _ in range(60)] + [None, "", "x " * 300]
    df = docs(spark, texts).withColumns({"part": F.lit("clash"), "chunk": F.lit(1), "level": F.lit(2)}).unionByName(spark.createDataFrame([(None, texts[0])], DOCS), allowMissingColumns=True)
    got = sorted((tuple(x) for x in lm_score.lm_scores(df, order=order, min_count=least).collect()), key=lambda x: (x[0] is None, x[0]))
    plain = plain_lm([*enumerate(texts), (None, texts[0])], order=order, min_count=least)
    for (_, n, log, _), (m, total) in zip(got, plain, strict=True):
        assert n == m and log == pytest.approx(total, abs=1e-9)


def test_ngram_counts(spark):
    own = [WORD.findall(t or "") for t in TEXTS]
    plain = Counter(tuple(w[i : i + n]) for w in own for n in (1, 2) for i in range(len(w) - n + 1))
    got = {r["gram"]: r["count"] for r in lm_score.ngram_counts(docs(spark)).collect()}
    assert got.pop(1) == sum(map(len, own)) and sorted(got.values()) == sorted(plain.values())


def test_lm_packing():
    r = np.random.default_rng(1)
    for bits, n in ((62, 5), (40, 1000), (20, 1)):
        v = np.unique(r.integers(0, 1 << bits, n).astype(np.uint64))
        assert (lm_score.unpack(lm_score.pack(v), len(v)) == v).all()
    c = np.array([1, 254, 255, 256, 1 << 40, 0])
    assert (lm_score.unpack_counts(lm_score.pack_counts(c), len(c)) == c).all()


# 2


def test_token_counts(spark):
    texts = ["one line", "two\nlines here\n", None, "", "\n\n", "mid\ndle émoji 😀 x\n\nend"]
    rows = token_counts.count_tokens(docs(spark, texts)).orderBy("doc_id", "section").collect()
    encoding, _ = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    for d, own in itertools.groupby(rows, key=lambda r: r["doc_id"]):
        own, text = list(own), texts[d] or ""
        lines = text.split("\n")
        sections = [x + "\n" for x in lines[:-1]] + ([lines[-1]] if lines[-1] or not text else [])
        assert [(r["char_start"], r["char_end"]) for r in own] == list(itertools.pairwise([0, *itertools.accumulate(map(len, sections))]))
        expected, crossing, at = Counter(), Counter(), 0
        ends = list(itertools.accumulate(len(s.encode()) for s in sections))
        for t in encoding.encode_ordinary(text):
            n = len(encoding.decode_single_token_bytes(t))
            s = next(i for i, e in enumerate(ends) if at < e)
            expected[s] += 1
            crossing[s] += at + n > ends[s]
            at += n
        assert [r["tokens"] for r in own] == [expected[i] for i in range(len(own))]
        assert [r["crossing"] for r in own] == [crossing[i] for i in range(len(own))]


def test_token_counts_of_fields(spark):
    df = spark.createDataFrame([(1, "Title", "a\nb")], "doc_id long, title string, text string")
    rows = token_counts.count_tokens(df, ("title", "text")).orderBy("section").collect()
    assert [r["field"] for r in rows] == [0, 1, 1]
    assert token_counts.count_tokens(df.limit(0)).count() == 0


def test_long_runs_are_cut_where_the_pattern_cuts():
    encoding, _ = token_counts._encoder(open(token_counts.VOCABULARY, "rb").read(), token_counts.PATTERN)
    r = random.Random(9)
    for _ in range(300):
        runs = ["".join(r.choice(" \n\t\u00a0\u2003\x85\r") for _ in range(r.choice([1, 2, 999, 1000, 1001, 3000]))) for _ in range(3)]
        text = "".join(r.choice(["", "a", "word", "'s", "12", "...", "é", " x"]) + w for w in runs) + r.choice(["", "b", "\x1c", "!", "9"])
        assert token_counts.encode(encoding, text).tolist() == encoding.encode_ordinary(text)


def test_token_counts_of_odd_texts(spark):
    """A million blanks, a million line feeds, one word of 10 MB; repeated rows, a null doc_id, clashing names."""
    texts = ["a" + " " * 1_000_000 + "b", " " * 1_000_000, "x" * 10_000_000, "same", "same", "\n" * 100_000]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "same")], DOCS)).withColumns({"section": F.lit("s"), "field": F.lit(7), "first_fields": F.lit(1)})
    got = defaultdict(list)
    for x in token_counts.count_tokens(df).collect():
        got[x["doc_id"]].append(x)
    assert sum(x["tokens"] for x in got[0]) == 1_000_001 and sum(x["tokens"] for x in got[1]) == 1_000_000
    assert got[2][0]["char_end"] == 10_000_000 and len(got[5]) == 100_000
    assert len(got[3]) == len(got[4]) == len(got[None]) == 1 and got[3][0]["tokens"] == got[None][0]["tokens"] == 1


# 3


def test_url_rules(spark):
    urls = [
        (1, "http://example.com/en/x", "example.com/en/", "block"), (2, "https://www.Example.com/en/x?q=/a", "www.example.com/en/", "allow"), (3, "http://a.www.example.com/en/", "www.example.com/en/", "allow"),
        (4, "http://badexample.com/en/", "com/", "allow"), (5, "http://x.net/es/1", "net/es/", "block"), (6, "http://x.net/de/1", None, "allow"), (7, None, None, "allow"), (8, "no url", None, "allow"),
        (9, "http://example.com", None, "allow"), (10, "http://net/fr/#x", "net/fr/", "block"), (11, "http://a.spam-farm.example.org/x", None, "block"), (12, "http://ads-track.example.com/x", "com/", "allow"),
        (13, "a://b://c.com/", None, "allow"), (14, "http://EXAMPLE.com/EN/", "com/", "allow"), (1, "http://example.com/en/x", "example.com/en/", "block"),
    ]
    df = spark.createDataFrame([(i, u, "old") for i, u, _, _ in urls], "page_id long, url string, host string")
    for size in (1 << 16, 1):  # one word: the filter passes nearly everything, the join must hold
        got = url_filter.filter_urls(df, url_filter.production_entries(spark), words=size)
        assert sorted((r["page_id"], r["rule"] or "", r["verdict"]) for r in got.collect()) == sorted((i, r or "", v) for i, _, r, v in urls)
    none = url_filter.filter_urls(df, url_filter.production_entries(spark).limit(0), default="block").select("verdict").distinct().collect()
    assert [r[0] for r in none] == ["block"]
    assert url_filter.filter_urls(df.limit(0), url_filter.production_entries(spark)).count() == 0


def test_listed_urls_are_canonical(spark):
    urls = {1: "http://user:pw@Bad.org:8080//a/./b/x", 2: "http://bad.org./a/b/", 3: "http://bad.org/a/c", 4: "http://sub.bad.org/a/b/?q", 5: "http://notbad.org/a/b/", 6: "http://bad.org:80/a/.b/", 7: "x" * 100_000 + "://bad.org/a/b/" + "y" * 100_000, 8: "http://" + "s." * 5000 + "bad.org/a/b/"}
    entries = spark.createDataFrame([("bad.org/a/b/", "block", "listed")], "entry string, action string, kind string")
    got = {r["page_id"]: r["verdict"] for r in url_filter.filter_urls(spark.createDataFrame(list(urls.items()), "page_id long, url string"), entries).collect()}
    assert got == {1: "block", 2: "block", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "block", 8: "block"}


def test_the_crawl_s_unwanted_hosts_are_listed(spark, sf_dir):
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet")
    found = {r["entry"] for r in url_filter.listed_hosts(pages).collect()}
    assert found and all(e.split(".")[0] in url_filter.UNWANTED for e in found)
    judged = queries.QUERIES["op3_url_filters"](spark, "/root/testdata/sf0.1")
    assert judged.where("rule is null and verdict = 'block'").count() > 0


def test_false_positives_do_not_get_through(spark):
    """A long list in a small filter: many keys pass that aren't listed, and none of them is judged by the list."""
    entries = spark.range(20_000).select(F.concat(F.lit("h"), F.col("id") * 2, F.lit(".org/")).alias("entry"), F.lit("block").alias("action"), F.lit("listed").alias("kind"))
    keys = spark.range(40_000).select(F.col("id"), F.lit("listed").alias("kind"), F.concat(F.lit("h"), F.col("id"), F.lit(".org/")).alias("_key"))
    passed = {r[0] for r in url_filter.possible(keys, entries, 1 << 10).select("id").collect()}
    assert set(range(0, 40_000, 2)) <= passed and 500 < len(passed) - 20_000 < 20_000
    assert len({r[0] for r in url_filter.possible(keys, entries).select("id").collect()}) - 20_000 < 100
    pages = keys.select(F.col("id").alias("page_id"), F.concat(F.lit("http://"), "_key").alias("url"))
    got = url_filter.filter_urls(pages, entries, words=1 << 10).where("verdict = 'block'").select("page_id").collect()
    assert {r[0] for r in got} == set(range(0, 40_000, 2))


# 4


def test_quality_on_held_out_rows(spark, sf_dir):
    scored = queries.QUERIES["op4_quality_classifier"](spark, sf_dir)
    rows = scored.join(spark.read.parquet(f"{sf_dir}/labels.parquet"), "doc_id").where("held_out").collect()
    assert len(rows) > 50 and sum(r["predicted"] == r["quality"] for r in rows) / len(rows) > 0.9
    assert scored.where("score is null or score < 0 or score > 1 or predicted <> cast(score >= 0.7 as int)").count() == 0
    assert scored.count() == spark.read.parquet(f"{sf_dir}/documents.parquet").count()


def test_quality_edges(spark):
    d = docs(spark).withColumn("score", F.lit("old"))
    labels = spark.createDataFrame([(0, 1), (4, 1), (2, None), (None, 0)], "doc_id long, quality int")
    got = quality.score(d, *quality.train(d, labels)).collect()
    assert len(got) == len(TEXTS) and {r["score"] for r in got} == {1.0}
    assert quality.score(d.limit(0), *quality.train(d.limit(0), labels)).count() == 0


def test_quality_comes_through_the_vectors(spark):
    """Held-out accuracy on sf0.1, and the base rate with all vectors 0."""
    sf = "/root/testdata/sf0.1"
    d, labels = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("documents", "labels"))
    d = d.select("doc_id", "text").join(labels.select("doc_id"), "doc_id", "left_semi").cache()
    vectors, net = quality.train(d, labels)
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    own = [r for r in quality.score(d, vectors, net).where(quality.held_out(F.col("doc_id"))).select("doc_id", "score").collect()]
    right = sum((r["score"] >= quality.THRESHOLD) == truth[r["doc_id"]] for r in own) / len(own)
    assert len(own) > 900 and right >= 0.97
    x = np.zeros((len(truth), quality.WIDTH), np.float32)
    flat_ = quality.fit(x, np.array(list(truth.values())))
    assert np.ptp(flat_.score(x)) < 1e-9 and abs(flat_.score(x)[0] - np.mean(list(truth.values()))) < 0.1
    batch = pa.record_batch({"text": pa.array(["some words of a text", "&&& ### more", None])})
    (_, flat, offs), = slices(iter([batch]), "text")
    assert not quality.features(flat, offs, np.zeros_like(vectors)).any()


def test_context_vectors_equal_plain_sums(spark):
    r = random.Random(5)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 3) for _ in range(r.randrange(30))) for _ in range(40)] + [None, ""]
    place, sign = quality.index_vectors()
    expected = np.zeros((quality.VOCAB, quality.DIMS))
    for t in texts:
        (_, flat, offs), = slices(iter([pa.record_batch({"text": pa.array([t], pa.string())})]), "text")
        e = quality.entries(words(flat, offs)[0]).tolist()
        for i, j in itertools.permutations(range(len(e)), 2):
            if abs(i - j) <= quality.WINDOW:
                for p, s in zip(place[e[j]], sign[e[j]], strict=True):
                    expected[e[i], p] += s
    assert np.allclose(quality.word_vectors(docs(spark, texts)), quality.unit(expected), atol=1e-6)


def test_pooling_equals_plain_means(monkeypatch):
    vectors = np.random.default_rng(1).normal(size=(quality.VOCAB, quality.DIMS)).astype(np.float32)
    texts = ["a b c", None, "a b c", "x " * 50, "", "y z " * 9, "a b c"]
    (_, flat, offs), = slices(iter([pa.record_batch({"text": pa.array(texts)})]), "text")
    whole = quality.features(flat, offs, vectors)
    for most in (1, 7, 1 << 16):
        monkeypatch.setattr(quality, "POOL_WORDS", most)
        got = quality.features(flat, offs, vectors)
        assert (got[0] == got[2]).all() and (got[0] == got[6]).all() and np.allclose(got, whole, atol=1e-5)
    for i, t in enumerate(texts):
        (_, f, o), = slices(iter([pa.record_batch({"text": pa.array([t], pa.string())})]), "text")
        v = vectors[quality.entries(words(f, o)[0])]
        assert np.allclose(whole[i], np.concatenate([v.mean(0), v.std(0)]) if len(v) else 0, atol=1e-4)


def test_contradicting_labels_are_left_out(spark):
    d = docs(spark, ["good words here"] * 30 + ["### $$$"] * 30).union(docs(spark, ["another text"]))
    labels = spark.createDataFrame([(i, int(i < 30)) for i in range(60)] + [(0, 0), (31, 1)], "doc_id long, quality int")
    scored = {r["text"]: r["score"] for r in quality.score(d, *quality.train(d, labels)).collect()}
    assert scored["good words here"] > 0.7 > scored["### $$$"]


# 5


def test_fingerprints(spark, sf_dir):
    rows = {r["doc_id"]: r for r in queries.QUERIES["op5_fingerprints"](spark, sf_dir).collect()}
    source = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()]
    by_text = {}
    for (i, t), (_, nxt) in zip(source, source[1:] + source[:1], strict=True):
        half = len(t) // 2
        edited = t[: len(t) - half] + nxt[:half]
        assert rows[i]["n_chars"] == len(t) and rows[i]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert by_text.setdefault(t, rows[i]["fingerprint"]) == rows[i]["fingerprint"]
        assert 0 <= rows[i]["near_edited"] <= 1 and 0 <= rows[i]["near_next"] <= 1
    mean = lambda c: sum(r[c] for r in rows.values()) / len(rows)
    assert mean("near_edited") > 0.25 > 0.05 > mean("near_next")


def test_anchors_are_context_free(spark):
    r = random.Random(3)
    w = [str(r.randrange(10**6)) for _ in range(60)]
    texts = [" ".join(w), " ".join(["new", *w]), " ".join(w[:30]), "one two", None]
    got = [x["a"] for x in fingerprint.with_anchors(docs(spark, texts).fillna(""), "text", "a").orderBy("doc_id").collect()]
    assert set(got[0]) <= set(got[1]) and set(got[2]) <= set(got[0]) and len(got[3]) == 1 and got[4] == []
    assert 10 < len(got[0]) < 45


def test_next_rows(spark):
    ids = [5, 1, 900, 30_000, 30_001, None, 7]
    df = spark.createDataFrame([(i, str(i)) for i in ids], "doc_id long, text string")
    got = {r["text"]: r["next_text"] for r in fingerprint.with_next(df, "doc_id", ["text"], ["text"]).collect()}
    order = ["None", "1", "5", "7", "900", "30000", "30001"]
    assert got == dict(zip(order, order[1:] + order[:1], strict=True))
    single = fingerprint.with_next(df.where("doc_id = 5"), "doc_id", ["text"], ["text"]).collect()
    assert [r["next_text"] for r in single] == ["5"]
    assert fingerprint.with_next(df.limit(0), "doc_id", ["text"], ["text"]).count() == 0


def test_anchors_equal_plain_syncmers(spark):
    r = random.Random(6)
    texts = [" ".join(r.choice("abcdefgh") * r.randint(1, 4) for _ in range(n)) for n in (0, 1, 5, 6, 7, 8, 30, 200)] + [" lead\ttail \n", None, "w " * 40, "é ü " * 30]
    for k, s in ((6, 2), (5, 3), (7, 1)):
        rows = fingerprint.with_anchors(docs(spark, texts).fillna(""), "text", "a", k, s).orderBy("doc_id").collect()
        for x, t in zip(rows, texts, strict=True):
            assert list(zip(x["a_pos"], x["a"], strict=True)) == anchors(t, k, s)


def test_likeness_equals_plain_links(spark, sf_dir):
    rows = queries.QUERIES["op5_fingerprints"](spark, sf_dir).collect()
    source = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").orderBy("doc_id").limit(300).collect()]
    got, last = {r["doc_id"]: r for r in rows}, len(source) - 1
    share = lambda a, b: len(a & b) / len(a | b) if a | b else 1.0
    for i, (d, t) in enumerate(source[:last]):
        nxt, half = source[i + 1][1], len(t) // 2
        edited = anchors(t[: len(t) - half] + nxt[:half])
        own = anchors(t)
        text = lambda found: f"{' '.join(str(p) for p, _ in found)}|{' '.join(str(h) for _, h in found)}" if found else ""
        assert got[d]["fingerprint"] == text(own) and got[d]["edited_fingerprint"] == text(edited)
        assert got[d]["near_edited"] == pytest.approx(share(anchor_links(own), anchor_links(edited)))
        assert got[d]["near_next"] == pytest.approx(share(anchor_links(own), anchor_links(anchors(nxt))))


def test_likeness_sees_order(spark):
    r = random.Random(2)
    blocks = [" ".join(str(r.randrange(10**6)) for _ in range(8)) for _ in range(40)]
    texts = [" ".join(blocks), " ".join(reversed(blocks))]
    a, b = fingerprint.with_anchors(docs(spark, texts), "text", "a").withColumn("l", fingerprint.links("a")).orderBy("doc_id").collect()
    assert len(set(a["a"]) & set(b["a"])) > 20 and len(set(a["l"]) & set(b["l"])) < 0.5 * len(a["l"])


def test_passages(spark):
    r = random.Random(11)
    w = [[str(r.randrange(10**6)) for _ in range(400)] for _ in range(4)]
    texts = [" ".join(w[0]), " ".join(w[1][:100] + w[0][50:150] + w[1][100:]), " ".join(w[2]), "kurz", None, ""]
    got = fingerprint.passages(docs(spark, texts).where("doc_id = 0"), docs(spark, texts)).collect()
    (x,) = got
    assert (x["query_id"], x["doc_id"], x["offset"]) == (0, 1, 50) and 51 <= x["first"] < 70 and 130 < x["last"] <= 150


def test_unspaced_scripts_have_anchors(spark):
    text = "これは長い文章ですが空白はありませんので文字ごとに見ます"
    got = fingerprint.with_anchors(docs(spark, [text * 2, "x " + text]), "text", "a").orderBy("doc_id").collect()
    assert len(got[0]["a"]) > 5 and set(got[1]["a"]) & set(got[0]["a"])


def test_next_rows_of_odd_keys(spark, monkeypatch):
    """One far-out key, a key that a third of the rows share, no key for another third; repeated rows."""
    monkeypatch.setattr(fingerprint, "ROWS_PER_STRETCH", 10)
    monkeypatch.setattr(fingerprint, "KNOTS", 16)
    rows = [(i, f"t{i}") for i in range(300)] + [(10**15, "far")] + [(77, f"s{i}") for i in range(300)] + [(None, f"n{i}") for i in range(300)] + [(5, "t5")] * 4
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in fingerprint.with_next(df, "doc_id", ["text"], ["text"]).select("doc_id", "text", "next_text").collect())
    line = sorted(rows, key=lambda x: (x[0] is not None, x[0] or 0, spark_hash(x[1])))
    assert got == Counter((*a, b[1]) for a, b in zip(line, line[1:] + line[:1], strict=True))
    stretch, least, most = fingerprint._stretch(df.withColumn("_tie", F.xxhash64("text")), "doc_id", "_tie")
    sizes = [r["count"] for r in df.withColumn("_tie", F.xxhash64("text")).groupBy(stretch.alias("b")).count().collect()]
    assert max(sizes) <= 60 and least < 0 < most


def test_fingerprints_of_odd_tables(spark, monkeypatch, tmp_path):
    texts = [None, "", "long " + "word " * 30_000, "same same", "same same", "x"]
    df = docs(spark, texts).unionByName(spark.createDataFrame([(None, "no id")], DOCS)).withColumns({"links": F.lit(1), "a": F.lit("x"), "edited": F.lit(0)})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = fingerprint.op5_fingerprints(spark, str(tmp_path)).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == 7 and by[0]["fingerprint"] == by[1]["fingerprint"] == "" and by[0]["near_next"] == 1.0
    assert by[3]["fingerprint"] == by[4]["fingerprint"] != "" and by[3]["near_next"] == 1.0 and by[2]["n_chars"] == 150_005


# 6


def mixed(spark, rows, **how):
    df = spark.createDataFrame(rows, "doc_id long, source string, size long")
    return mixing.mix(df, **how).collect()


def test_mixing_targets_and_taken(spark):
    r = random.Random(1)
    rows = [(i, r.choice(["a", "b", "c", "d", "é", None]), r.choice([0, 1, 50, 300, 900])) for i in range(300)]
    got = mixed(spark, rows)
    sources = sorted({s for _, s, _ in rows if s is not None}) + [None]
    size = [sum(n for _, s, n in rows if s == x) for x in sources]
    target = water_fill(size, [(5, 2, 1)[i % 3] for i in range(len(sources))], 1.5, 2)
    by = {x: (n, t) for x, n, t in zip(sources, size, target, strict=True)}
    assert len(got) == len(rows)
    for x in got:
        assert x["source_size"] == by[x["source"]][0] and x["target"] == pytest.approx(by[x["source"]][1])
        assert 0 <= x["taken"] <= 2 * x["size"]
    for s, (_, t) in by.items():
        assert abs(sum(x["taken"] for x in got if x["source"] == s) - t) <= 3 * mixing.BLOCK_WORDS
    assert sorted(map(repr, got)) == sorted(map(repr, mixed(spark, rows)))


def test_mixing_edges(spark):
    assert mixed(spark, []) == []
    assert [(x["taken"], x["source_size"]) for x in mixed(spark, [(1, "a", 0), (2, None, 0)])] == [(0, 0), (0, 0)]
    assert [x["taken"] for x in mixed(spark, [(1, "a", 10)])] == [15]
    twice = mixed(spark, [(1, "a", 10), (1, "a", 10)])
    assert len(twice) == 2 and sum(x["taken"] for x in twice) == 30
    sized = mixing.sizes(docs(spark).withColumn("size", F.lit("x"))).orderBy("doc_id").collect()
    assert [x["size"] for x in sized] == [len(WORD.findall(t or "")) for t in TEXTS]


@pytest.mark.parametrize("points", ["van der Corput", "in order", "golden ratio"])
def test_mixing_follows_its_schedule(spark, points):
    """Against a plain schedule; another sequence of points gives another mix."""
    r = random.Random(7)
    rows = [(r.choice([None, 1, 2, i]), r.choice(["a", "b", "c", None]), r.choice([0, 3, 40, 500]), i % 90) for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, source string, size long, text_hash long")
    here, plain = {
        "van der Corput": (mixing.van_der_corput, None), "in order": (lambda slot, digits: slot, lambda j: j),
        "golden ratio": (lambda slot, digits: F.floor((slot * 0.6180339887498949) % 1.0 * (1 << digits)).cast("long"), "golden"),
    }[points]
    got = mixing.mix(df, points=here).withColumn("h", F.xxhash64("doc_id", "size", "text_hash")).collect()
    sources = ["a", "b", "c", None]
    size = [sum(n for _, s, n, _ in rows if s == x) for x in sources]
    target = dict(zip(sources, water_fill(size, [5, 2, 1, 5], 1.5, 2), strict=True))
    if plain == "golden":
        slots = 1 << max(1, math.ceil(math.log2(sum(target.values()) / 96)))
        plain = lambda j: math.floor((j * 0.6180339887498949) % 1.0 * slots)
    buckets = buckets_for(len(rows))
    own = {s: sorted((x for x in got if x["source"] == s), key=lambda x: (x["h"] % buckets, x["h"])) for s in sources}
    expected = mixed_plainly({s: [x["size"] for x in o] for s, o in own.items()}, target, points=plain)
    key = lambda x, t: (x["h"], t[0] if x["size"] else 0)  # noqa: E731  rows equal in all columns can't be told apart
    for s in sources:
        assert sorted(key(x, (x["taken"], x["first_slot"])) for x in own[s]) == sorted(key(x, t) for x, t in zip(own[s], expected[s], strict=True))
        assert Counter(x["first_slot"] for x in own[s] if x["size"]) == Counter(t[1] for x, t in zip(own[s], expected[s], strict=True) if x["size"])
    other = mixing.mix(df).collect() if points != "van der Corput" else mixing.mix(df, points=lambda slot, digits: slot * 0).collect()
    assert Counter(map(tuple, other)) != Counter(tuple(x[:-1]) for x in got)
    amounts = lambda rows: Counter((x["doc_id"], x["source"], x["size"], x["text_hash"], x["taken"]) for x in rows)
    assert amounts(mixing.mix(df, points=lambda slot, digits: F.shiftright(slot, 1)).collect()) != amounts(got)  # points in half of the line only


def test_mixing_does_not_depend_on_row_order(spark):
    r = random.Random(8)
    texts = ["w " * r.randrange(60) for _ in range(40)] + [None]
    rows = [(r.choice([None, 1, 2, i]), r.choice(texts), r.choice(["a", "b"])) for i in range(200)]
    found = []
    for _ in range(2):
        r.shuffle(rows)
        df = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
        found.append(Counter(map(tuple, mixing.mix(mixing.sizes(df)).collect())))
    assert found[0] == found[1]


def test_mixing_of_many_sources(spark):
    df = spark.range(6000).select(F.col("id").alias("doc_id"), F.concat(F.lit("s"), F.lpad(F.col("id").cast("string"), 5, "0")).alias("source"), (F.lit(150) + F.col("id") % 7 * 100).cast("long").alias("size"))
    got = mixing.mix(df).collect()
    assert len(got) == 6000 and all(0 <= x["taken"] <= 2 * x["size"] for x in got)
    assert all(abs(x["taken"] - x["target"]) <= 2 * mixing.BLOCK_WORDS for x in got)


# 7


def test_differencing_is_tight_and_whole():
    r = random.Random(2)
    for n in (0, 1, 5, 400):
        items = [[r.randint(1, 5000)] for _ in range(n)]
        slots, sums = sharding.differencing(items, 4)
        loads = [0] * 4
        for (x,), s in zip(items, slots, strict=True):
            loads[s[0]] += x
        assert loads == sums
        if n == 400:
            assert max(loads) - min(loads) <= 5
    assert sorted(sharding.differencing([[8], [7], [6], [5], [4]], 2)[1]) == [14, 16]


def test_shards(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELL_GROUPS", 40)
    r = random.Random(4)
    texts = ["w" * r.randint(1, 400) + str(i) for i in range(600)] + ["copy " * 300] * 9 + [None, "", None]
    rows = sharding.shard(sharding.with_groups(docs(spark, texts).withColumn("shard", F.lit("old")))).collect()
    assert len(rows) == len(texts)
    load, group = Counter(), defaultdict(set)
    for x in rows:
        load[x["shard"]] += x["size"]
        group[texts[x["doc_id"]] or ""].add(x["shard"])
        assert x["size"] == len((texts[x["doc_id"]] or "").encode()) + 1
    assert all(len(s) == 1 for s in group.values()) and set(load) <= set(range(16))
    assert max(load.values()) <= 1.05 * max(sum(load.values()) / 16, 9 * 1501)
    for s in range(16):
        assert sorted(x["slot"] for x in rows if x["shard"] == s) == list(range(sum(x["shard"] == s for x in rows)))
    assert sharding.shard(sharding.with_groups(docs(spark, []))).count() == 0


@pytest.mark.parametrize("cell, fan", [(150, 4), (400, 8), (4000, 8)])
def test_levels_of_differencing_stay_tight(spark, monkeypatch, cell, fan):
    """Heavy groups in many small cells, one with a third of all bytes, over up to three levels."""
    monkeypatch.setattr(sharding, "CELL_GROUPS", cell)
    monkeypatch.setattr(sharding, "FAN", fan)
    r = random.Random(cell)
    sizes = [r.randint(1, 900) for _ in range(1500)] + [r.randint(5_000, 9_000) for _ in range(60)] + [500_000]
    groups = spark.createDataFrame(list(enumerate(sizes)), "group_key long, group_bytes long")
    placed = {x["group_key"]: x["shard"] for x in sharding.place(groups).collect()}
    assert set(placed) == set(range(len(sizes)))
    load = Counter()
    for k, s in placed.items():
        load[s] += sizes[k]
    rest = sorted(load.values())[:-1]
    assert max(load.values()) == 500_000 and len(rest) == 15 and max(rest) - min(rest) <= (40 if cell == 4000 else 0.01 * sum(rest) / 15)


def test_shards_equal_plain_differencing(spark):
    """One cell: the whole differencing in plain Python, group by group."""
    r = random.Random(5)
    sizes = [r.randint(1, 4000) for _ in range(300)]
    parts = [[0] * 15 + [x] for x in sizes]  # rising sums
    owner = [[[] for _ in range(15)] + [[i]] for i in range(300)]
    while len(parts) > 1:
        order = sorted(range(len(parts)), key=lambda i: parts[i][0] - parts[i][-1])
        a, b = order[:2]
        both = sorted(zip([x + y for x, y in zip(parts[a], parts[b][::-1], strict=True)], [x + y for x, y in zip(owner[a], owner[b][::-1], strict=True)], strict=True), key=lambda t: t[0])
        parts, owner = ([x for i, x in enumerate(own) if i not in (a, b)] for own in (parts, owner))
        parts.append([x for x, _ in both])
        owner.append([x for _, x in both])
    spread = parts[0][-1] - parts[0][0]
    groups = spark.createDataFrame(list(enumerate(sizes)), "group_key long, group_bytes long")
    load = Counter()
    for x in sharding.place(groups).collect():
        load[x["shard"]] += sizes[x["group_key"]]
    assert sum(load.values()) == sum(sizes) and max(load.values()) - min(load.values()) <= max(spread, 3)


def test_shards_of_odd_rows(spark, tmp_path):
    """No doc_id, one doc_id for many rows, one very long text, equal sizes, clashing names."""
    rows = [(None, f"n{i}") for i in range(40)] + [(7, f"s{i:02d}") for i in range(40)] + [(1, "long " * 100_000), (2, None), (3, ""), (None, None)]
    df = spark.createDataFrame(rows, DOCS).withColumns({c: F.lit("old") for c in ("size", "shard", "slot", "group_key", "text_crc32", "level", "leaf", "node")})
    df.write.parquet(f"{tmp_path}/documents.parquet")
    got = sharding.op7_sharding(spark, str(tmp_path)).collect()
    assert len(got) == len(rows) and all(sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sum(x["shard"] == s for x in got))) for s in range(16))
    long = next(x for x in got if x["doc_id"] == 1)
    assert long["size"] == 500_001 and sum(x["shard"] == long["shard"] for x in got) == 1
    assert len({x["shard"] for x in got if x["size"] == 1}) == 1 and {x["law"] for x in got} == {"bytes"}


# 8

QUESTION = "If Anna Smith drives 120 km in 2 hours then how far does Anna go in 5 hours, and what would Bob say about it?"


def test_decontamination(spark):
    like = QUESTION.replace("Anna Smith", "Peter Jones").replace("Anna", "Peter").replace("120", "90").replace("in 2", "in 3").replace("in 5", "in 7")
    odd = like.replace("does Peter", "does Luke").replace("in 7 hours", "in 3 hours")
    rows = [(1, "Before. " + QUESTION + " After"), (2, "so: " + like), (3, "so: " + odd), (4, None), (5, ""), (6, "quite another text with some words in it"), (1, "again"), (None, QUESTION), (7, QUESTION.upper()[:40])]
    d = spark.createDataFrame([(*r, 1) for r in rows], DOCS + ", item_id int")
    b = spark.createDataFrame([(10, QUESTION), (11, "too short"), (12, None), (13, QUESTION)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]): r["reparameterised"] for r in decontaminate.contaminated(d, b).collect()}
    assert got == {(1, 10): False, (2, 10): True, (1, 13): False, (2, 13): True}
    assert decontaminate.contaminated(d, b.limit(0)).count() == 0 and decontaminate.contaminated(d.limit(0), b).count() == 0


def test_leaks_of_figures_and_of_copies_with_a_contradiction(spark):
    sum_, figures = "Compute 3 * 4 + 5 * 6 - 7", "11 12 13 14 15 16 17 18 19 20 21"
    twice = "a tank loses 3 litres every day while it rains and then gains another amount until all of the water in it is gone after 3 days of sun"
    rows = [(1, "so: " + sum_ + " now"), (2, "so: Compute 3 * 4 + 5 * 6 - 8 now"), (3, "see " + figures), (4, figures.replace("1", "2")), (5, twice.replace("after 3", "after 4")), (6, None)]
    items = spark.createDataFrame([(20, sum_), (21, figures), (22, twice)], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(spark.createDataFrame(rows, DOCS), items).collect()}
    assert got == {(1, 20), (3, 21), (5, 22)}


def test_decontamination_equals_window_search(spark, sf_dir):
    import re

    got = {(r["doc_id"], r["item_id"]) for r in queries.QUERIES["op8_decontamination"](spark, sf_dir).collect()}
    tokens = lambda t: re.findall(r"[^\W_]+", (t or "").lower())
    windows = defaultdict(set)
    for i, t in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect():
        w = tokens(t)
        for k in range(len(w) - 7):
            windows[tuple(w[k : k + 8])].add(i)
    plain = defaultdict(set)
    for d, t in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect():
        w = tokens(t)
        for k in range(len(w) - 7):
            for i in windows.get(tuple(w[k : k + 8]), ()):
                plain[d, i].add(tuple(w[k : k + 8]))
    assert got == {p for p, s in plain.items() if len(s) >= 6} and got


ITEM = "Anna has 12 apples and 5 pears in a basket. Anna gives some of them to a friend. How many of all the fruits are left after 3 days if nobody eats any?"


def test_changed_copies_are_found(spark):
    """One more word in a name, two numbers set to the same value, names at the beginning of sentences, other figures and units."""
    changed = {
        1: ITEM.replace("Anna", "Mary Jane"), 2: ITEM.replace("12", "7").replace(" 5 ", " 7 "), 3: ITEM.replace("Anna", "Zoe"), 4: ITEM.replace("12", "1,250.75").replace("3 days", "4 weeks"),
        5: ITEM.lower(), 6: ITEM.upper(), 7: "Some words. " + ITEM.replace("Anna has", "Otto has").replace("Anna gives", "Otto gives") + " And more.",
    }
    other = {20: "Anna has 12 ideas. The rest is quite different from what stands above in any of its words, and it goes on for a while.", 21: None, 22: ""}
    got = {r["doc_id"]: r["reparameterised"] for r in decontaminate.contaminated(spark.createDataFrame([*changed.items(), *other.items()], DOCS), spark.createDataFrame([(1, ITEM)], "item_id long, text string")).collect()}
    assert got == {1: True, 2: True, 3: True, 4: True, 5: False, 6: False, 7: True}


def test_templates_with_and_without_values_are_in_step(spark):
    r = random.Random(12)
    bits = ["Anna", "Anna Smith", "the", "12", "1,250.75", "3 km", "km", "5km/h", "McDonald", "USA", "O'Neil", "Ärger", "über", ".", ", ", "_", "\ue000", "x_Y", "A", "Zoe-Marie", "9.", "½", "7%", "\n", "Dr. Who", "9" * 60 + " days"]
    texts = ["".join(r.choice(bits) + r.choice(["", " ", " ", "  "]) for _ in range(r.randrange(30))) for _ in range(400)]
    rows = docs(spark, texts).select(decontaminate.template(F.col("text")).alias("t"), decontaminate.template(F.col("text"), True).alias("v")).collect()
    for x in rows:
        assert x["t"] == [w[0] if w[0] in decontaminate.MARKS else w for w in x["v"]]


def plain_holds(doc, item, templates, window=8, coverage=0.5, run=6):
    """Slot consistency by loops: the item's windows in a document, by words, else by templates."""
    words = lambda t: [w for w in re.split(r"[\W_]+", (t or "").lower()) if w]
    a, b = words(item), words(doc)
    n = min(window, len(a))
    enough = lambda k: max(1, min(run, math.ceil(k * coverage)))
    spots = range(len(a) - n + 1) if a else []
    verbatim = [i for i in spots if any(b[j : j + n] == a[i : i + n] for j in range(len(b) - n + 1))]
    if a and len(verbatim) >= enough(len(spots)):
        return True
    (ta, va), (tb, vb) = templates[item], templates[doc]
    n = min(window, len(ta))
    slot = lambda w: w[0] in decontaminate.MARKS
    spots = [i for i in range(len(ta) - n + 1) if ta and sum(not slot(w) for w in ta[i : i + n]) >= min(3, n)]
    seen, copies = set(), defaultdict(list)
    for i in spots:
        for j in range(len(tb) - n + 1):
            if tb[j : j + n] == ta[i : i + n]:
                pairs = [(x, y) for x, y in zip(va[i : i + n], vb[j : j + n], strict=True) if slot(x)]
                if all(x == y for x, y in pairs):
                    seen.add(i)
                copies[j - i].append((i, pairs))
    for own in copies.values():
        put = defaultdict(set)
        for _, pairs in own:
            for x, y in pairs:
                p, q = x[1:].split("_"), y[1:].split("_")
                if x[0] != decontaminate.NAME:
                    put[x].add(y)
                elif len(p) == len(q):
                    for c, d in zip(p, q, strict=True):
                        put[c].add(d)
                else:
                    c, d = [k for k in p if k not in q], [k for k in q if k not in p]
                    if c and d:
                        put[c[0]].add(d[0])
        if all(len(v) == 1 for v in put.values()):
            seen |= {i for i, _ in own}
    return bool(spots) and len(seen) >= enough(len(spots))


def test_decontamination_equals_loops(spark):
    r = random.Random(13)
    names, plain = ["Anna", "Bob Lee", "Zoe", "Peter Paul Pry"], ["goes", "to", "the", "market", "with", "many", "of", "his", "old", "friends", "and", "buys", "some", "bread"]
    def text():
        return " ".join(r.choice([r.choice(names), str(r.randrange(30)), r.choice(["3 km", "5 days"]), *[r.choice(plain)] * 6]) for _ in range(r.choice([5, 12, 30]))) + "."
    def changed(t):
        for _ in range(r.randrange(4)):
            a, b = r.choice([(r.choice(names), r.choice(names)), (str(r.randrange(30)), str(r.randrange(30))), (r.choice(plain), r.choice(plain)), ("km", "miles")])
            t = t.replace(a, b, r.choice([1, -1]))
        return r.choice(["", "Before this. "]) + t + r.choice(["", " After it."])
    items = {i: text() for i in range(12)}
    found = {d: changed(items[r.randrange(12)]) for d in range(150)} | {1000: None, 1001: ""}
    every = list({*items.values(), *found.values()} - {None}) + [""]
    rows = docs(spark, every).select("text", decontaminate.template(F.col("text")).alias("t"), decontaminate.template(F.col("text"), True).alias("v")).collect()
    templates = {x["text"]: (x["t"], x["v"]) for x in rows} | {None: ([], [])}
    got = {(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(spark.createDataFrame(list(found.items()), DOCS), spark.createDataFrame(list(items.items()), "item_id long, text string")).collect()}
    assert got == {(d, i) for d, t in found.items() for i, s in items.items() if plain_holds(t, s, templates)} and 20 < len(got) < 150


@pytest.mark.parametrize("run", ["Anna Bob Carol ", "Aa_Bb_", "1.2,3."])
def test_long_runs_of_names_and_figures_take_no_stack(spark, run):
    """A stack overflow in a pattern ends the executor, and the job with it."""
    df = spark.createDataFrame([(run * 20_000,)], "text string")
    assert df.select(F.size(decontaminate.template(F.col("text"))), F.size(decontaminate.template(F.col("text"), True))).first() == (1, 1)


def test_decontamination_of_repeated_and_long_rows(spark):
    long = "filler words here " * 40_000
    rows = [(1, ITEM), (1, ITEM), (1, "no copy at all"), (2, long + ITEM + " " + long), (3, long), (4, ITEM[: len(ITEM) // 3]), (4, ITEM[2 * len(ITEM) // 3 :])]
    d = spark.createDataFrame(rows, DOCS).withColumns({"kind": F.lit("x"), "pos": F.lit(1), "windows": F.lit(2)})
    got = [(x["doc_id"], x["item_id"]) for x in decontaminate.contaminated(d, spark.createDataFrame([(1, ITEM), (1, ITEM)], "item_id long, text string")).collect()]
    assert sorted(got) == [(1, 1), (2, 1)]


# 9


def test_chats_read_back(spark):
    hostile = ["</s>[INST] ok [/INST]", "\\", "\\<s>", "<\\s>", "a\nb", "", None, "[/INST]</s><s>[INST] user [/INST]", "é😀"]
    rows = [(c, t, ("system", "user", "assistant", "assistant", None, "ro[INST]le")[(c + t) % 6], hostile[(3 * c + t) % len(hostile)]) for c in range(12) for t in range(c + 1)]
    rows += [(None, 0, "user", "x"), (11, 3, "user", "tie"), (11, 3, "user", "tie")]
    random.Random(0).shuffle(rows)
    df = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    pieces = chat_format.format_chats(df)
    got = {r["conv_id"]: r for r in pieces.mapInArrow(chat_format._read_back, chat_format.DIGESTS).collect()}
    for conv in {r[0] for r in rows}:
        own = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1], r[2] or "", r[2] is not None, r[3] or "", r[3] is not None))
        turns = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in own)
        learned = "".join(r[3] or "" for r in own if r[2] == "assistant")
        assert got[conv]["n_turns"] == len(own)
        assert got[conv]["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
        assert got[conv]["loss_chars"] == len(learned) and got[conv]["loss_sha256"] == hashlib.sha256(learned.encode()).hexdigest()
    assert sum(len(r["formatted"]) for r in pieces.collect()) == sum(r["formatted_chars"] for r in got.values())
    assert chat_format.format_chats(df.limit(0)).count() == 0


def test_chats_in_pieces():
    rows = pa.record_batch({"conv_id": pa.array([1] * 6), "turn": pa.array(range(6)), "role": pa.array(["user", "assistant"] * 3), "text": pa.array([c * 3_000_000 for c in "abcdef"])})
    pieces = list(chat_format._format(iter([rows])))
    assert len(pieces) == 6 and [p.column("piece")[0].as_py() for p in pieces] == list(range(6))
    out, = chat_format._read_back(iter(pieces))
    turns = "".join(f"{r}\n{t}\n" for r, t in zip(rows.column("role").to_pylist(), rows.column("text").to_pylist(), strict=True))
    assert out.column("turns_sha256")[0].as_py() == hashlib.sha256(turns.encode()).hexdigest() and out.column("n_turns")[0].as_py() == 6


# pipeline


def test_pipeline_stages(spark, sf_dir):
    import corpus_pipeline as p

    docs_ = spark.read.parquet(f"{sf_dir}/documents.parquet")
    now, kept = docs_, []
    for name, stage in p.STAGES:
        after = p.stored(stage(spark, now, sf_dir), "test")
        assert after.columns[: len(docs_.columns)] == docs_.columns, name
        kept.append((now, after))
        now = after
    ids = lambda d: {r[0] for r in d.select("doc_id").collect()}
    (a, b), (_, c), (_, d), (_, e), (_, f) = kept
    good = ids(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))
    assert len(good & ids(b)) > 0.95 * len(good & ids(a)) and b.count() < a.count()
    from brute import components as plain

    rows = [tuple(r) for r in b.select("doc_id", "text").collect()]
    assert ids(c) == {i for i, (n, least) in plain(rows).items() if not n or least == i}
    held = ids(decontaminate.contaminated(c, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    assert ids(d) == ids(c) - held and held
    times = Counter(r[0] for r in e.select("doc_id").collect())
    assert set(times) <= ids(d) and max(times.values()) == 2
    assert f.count() == e.count() and f.select("shard", "slot").distinct().count() == f.count()
    json.dumps(p.ORACLE_SQL)


def test_stages_decide_per_row(spark, sf_dir):
    """Null and repeated doc_id: equal rows, a second text under one doc_id, rows without one."""
    import corpus_pipeline as p

    texts = [" ".join(f"t{i}w{j}" for j in range(30)) for i in range(6)]
    leak = spark.read.parquet(f"{sf_dir}/benchmark.parquet").orderBy(F.desc(F.length("text"))).first()["text"]
    schema = "doc_id long, text string, source string"
    frame = lambda rows: spark.createDataFrame([(*r, "s") for r in rows], schema)
    kept = lambda stage, rows: sorted(((r[0], r[1]) for r in stage(spark, frame(rows), sf_dir).collect()), key=repr)
    rows = [(1, texts[0])] * 3 + [(2, texts[0]), (2, texts[1]), (None, texts[0]), (None, texts[2]), (None, texts[2]), (3, "")]
    assert kept(p.stage_ngram_join, rows) == sorted([(1, texts[0]), (2, texts[1]), (None, texts[2]), (3, "")], key=repr)
    rows = [(1, leak), (1, texts[0]), (None, leak), (None, texts[1])]
    assert kept(p.stage_decontamination, rows) == sorted([(1, texts[0]), (None, texts[1])], key=repr)
    rows = [(None if i % 3 == 0 else 7, f"m{i} " + "word " * 20) for i in range(60)]
    sized = mixing.sizes(frame(rows)).withColumn("_nr", F.monotonically_increasing_id())
    taken = mixing.mix(sized, order=("doc_id", "_nr")).select("doc_id", "text", F.round(F.col("taken") / F.col("size")).cast("int").alias("n")).collect()
    assert kept(p.stage_mixing, rows) == sorted([(r[0], r[1]) for r in taken for _ in range(r[2])], key=repr) and any(r[0] is None and r[2] for r in taken)


def _pipeline_rows(spark, sf_dir):
    """Nulls, repeats and clashing names, on top of clean texts of the table."""
    clean = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").join(spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"), "doc_id").orderBy("doc_id").limit(40).collect()]
    names = ["score", "shard", "slot", "size", "group_key", "text_crc32", "taken", "target", "component_id", "windows", "n_shingles", "first_slot", "text_hash", "kind"]
    rows = [(i, t, "en", f"s{i % 3}") for i, t in enumerate(clean)] + [(None, t, None, None) for t in clean[:5]] + [(3, clean[3], "en", "s0")] * 3 + [(90, None, None, "s1"), (91, "", "en", None), (92, clean[0] + " word" * 200_000, "en", "s1")]
    return spark.createDataFrame([(*r, *(f"{c}{k}" for c in names)) for k, r in enumerate(rows)], "doc_id long, text string, lang string, source string, " + ", ".join(f"{c} string" for c in names))


def test_stages_handle_odd_rows_and_names(spark, sf_dir):
    import corpus_pipeline as p

    df = _pipeline_rows(spark, sf_dir)
    for name, stage in p.STAGES:
        out = stage(spark, df, sf_dir)
        rows = out.collect()
        known = {tuple(r[c] for c in df.columns if c not in ("shard", "slot")) for r in df.collect()}
        assert sorted(out.columns) == sorted({*df.columns, "shard", "slot"}) and len(set(out.columns)) == len(out.columns), name
        assert rows and {tuple(r[c] for c in df.columns if c not in ("shard", "slot")) for r in rows} <= known, name
        if name != "sharding":
            assert out.columns == df.columns
        else:
            assert len(rows) == df.count() and {r["shard"] for r in rows} <= set(range(16))
        empty = stage(spark, df.limit(0), sf_dir)
        assert empty.columns == out.columns and empty.count() == 0, name
    joined = Counter(r["text"] for r in p.stage_ngram_join(spark, df, sf_dir).collect())
    texts = {r["text"] for r in df.collect() if r["text"]}
    assert all(joined[t] <= 1 for t in texts) and joined[None] == joined[""] == 1


def test_stages_write_no_copy_of_rows_read_from_files(spark, sf_dir, tmp_path, monkeypatch):
    import corpus_pipeline as p

    names, stored = [], p.stored
    monkeypatch.setattr(p, "stored", lambda df, name: names.append((name, "text" in df.columns)) or stored(df, name))
    df = _pipeline_rows(spark, sf_dir).repartition(3, "text")
    df.write.parquet(f"{tmp_path}/documents.parquet")
    read = spark.read.parquet(f"{tmp_path}/documents.parquet")
    nr = [r[0] for r in p._numbered(read, "x").select("_nr").collect()]
    assert len(set(nr)) == len(nr) == df.count() and max(nr) >> 40 == 2 and not names
    for name, stage in p.STAGES[1:]:
        got = Counter(map(tuple, stage(spark, read, sf_dir).select(df.columns[:4]).collect()))
        assert not any(whole for _, whole in names), name
        if name != "mixing sources":  # whose order has the rows' keys in it
            assert got == Counter(map(tuple, stage(spark, df, sf_dir).select(df.columns[:4]).collect())), name
        names.clear()


def test_no_shared_folder_is_an_error_on_a_cluster(spark, monkeypatch):
    from kinfold.llm import _store

    class Context:
        master, applicationId = "spark://host:7077", "app-1"

        def getCheckpointDir(self):
            return None

    class Session:
        conf, sparkContext = {}, Context()

    with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
        _store.shared_dir(Session())
    Context.master = "local[4]"
    assert _store.shared_dir(Session()) == _store.shared_dir(Session()) != ""


def test_stored_tables_go_with_their_plans(spark):
    import gc
    import os

    from kinfold.llm import _store

    there = lambda: {e[2].toString().removeprefix("file:").replace("//", "/") for e in _store._tables}
    before = there()
    table = _store.stored(spark.range(100), "test-sweep")
    (path,) = there() - before
    derived = table.where("id > 3").groupBy((F.col("id") % 7).alias("k")).count().join(table.withColumnRenamed("id", "k"), "k")
    del table
    for _ in range(3):
        _store.free(spark)
    assert os.path.isdir(path) and derived.count() == 7
    del derived
    for _ in range(40):  # Spark itself remembers its last query, and its listeners are told of queries a little later
        spark.range(5).join(F.broadcast(spark.range(5)), "id").count()
        gc.collect()
        _store.free(spark)
        if path not in there():
            break
        time.sleep(0.25)
    assert not os.path.isdir(path) and path not in there()


def test_pipeline_row_keys_need_no_join(spark, tmp_path):
    """A row's key comes from its file and its place there by an expression, however often the rows are read."""
    import corpus_pipeline as p

    spark.range(100).selectExpr("id as doc_id", "'x' as text").repartition(5).write.parquet(str(tmp_path / "rows"))
    numbered = p._numbered(spark.read.parquet(str(tmp_path / "rows")), "test-rows")
    assert "Join" not in numbered._jdf.queryExecution().optimizedPlan().toString()
    files = {f: i for i, f in enumerate(sorted(r[0] for r in numbered.select("_metadata.file_path").distinct().collect()))}
    rows = numbered.select("_nr", "_metadata.file_path", "_metadata.row_index").collect()
    assert len({r[0] for r in rows}) == 100 and len(files) == 5
    assert [r[0] for r in sorted(rows, key=lambda r: (files[r[1]], r[2]))] == sorted(r[0] for r in rows)


def test_driver_gives_memory_back(spark):
    from kinfold.llm._store import trim

    assert trim(spark)
