import random

import numpy as np
import pyarrow as pa
import pytest

from brute import components, shingle_set
from kinfold.llm import ngram_join as g

SCHEMA = "doc_id long, text string"


def corpus(seed, docs=90):
    """Near copies with a few edits, a passage that many share, exact copies, short and odd texts."""
    r = random.Random(seed)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(r.randint(2, 6)))
    passage = [word() for _ in range(40)]
    rows, bases = [], [[word() for _ in range(r.choice([6, 8, 12, 30, 80, 200]))] for _ in range(12)]
    for i in range(docs):
        w = list(r.choice(bases))
        if r.random() < 0.3:
            w = [word() for _ in range(60)] + passage + [word() for _ in range(10)]
        for _ in range(r.choice([0, 0, 1, 1, 2, 3, 6])):
            at = r.randrange(len(w))
            w[at : at + 1] = r.choice([[word()], [], [word(), w[at]]])
        rows.append((i * 3, " ".join(w)))
    return rows + [(1000, None), (1001, ""), (1002, "  \n\t"), (1003, "One two"), (1004, "one  TWO\n"), (1005, "one two three four five"), (1006, "É é"), (1007, "é é"), (1008, "x" * 3000)]


@pytest.mark.parametrize("seed, hot", [(1, 48), (2, 1), (3, 2)])
def test_components_equal_brute_force(spark, monkeypatch, seed, hot):
    monkeypatch.setattr(g, "HOT", hot)
    rows = corpus(seed)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in g.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)
    assert len({c for _, c in got.values()}) < len(rows)


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert g.near_duplicates(empty).collect() == []
    alone = g.near_duplicates(spark.createDataFrame([(7, None), (8, "a b c d e f g")], SCHEMA)).collect()
    assert {tuple(r) for r in alone} == {(7, 0, 7), (8, 3, 8)}
    again = [(5, "a b c d e f"), (5, "a b c d e f"), (9, "A B C D E F"), (None, "a b c d e f")]
    extra = spark.createDataFrame([(*x, "clash", 1) for x in again], SCHEMA + ", n_shingles string, part int")
    assert sorted((tuple(r) for r in g.near_duplicates(extra).collect()), key=repr) == sorted([(5, 2, 5), (5, 2, 5), (9, 2, 5), (None, 2, 5)], key=repr)


def test_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(16)]
    full, most = " ".join(words), " ".join(words[:13])  # 12 and 9 shingles: 9/12 = 0.75
    less = " ".join(words[:12])  # 8/12
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(spark.createDataFrame([(1, full), (2, most), (3, full + " x"), (4, less + " y z")], SCHEMA)).collect()}
    assert got[2] == 1 and got[3] == 1 and got[4] == components([(1, full), (2, most), (3, full + " x"), (4, less + " y z")])[4][1]


def test_short_near_copies_are_found(spark):
    """A pair whose shared shingles all lie in the segment that differs, the other segments being empty in both."""
    r, rows = random.Random(4), []
    for i in range(400):
        w = [f"{i}x{r.random()}" for _ in range(8 + i % 12)]
        rows += [(2 * i, " ".join(w)), (2 * i + 1, " ".join(w[:-1]))]
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert [i for i in range(400) if got[2 * i + 1] != 2 * i] == []


@pytest.mark.parametrize("levels", [1, 2, 8])
def test_linked_pairs_share_a_signature(monkeypatch, levels):
    """All size pairs to 24 shingles at every overlap that links, a hundred random pairs each."""
    monkeypatch.setattr(g, "LEVELS", levels)
    r, sets, names = np.random.default_rng(levels), [], []
    for x in range(1, 25):
        for y in range(x, 25):
            for both in range(1, x + 1):
                if 100 * both >= 75 * (x + y - both):
                    for _ in range(100):
                        v = r.integers(0, 2**64, x + y - both, np.uint64)
                        sets += [v[:x], v[x - both :]]
                        names.append((x, y, both))
    n, value = np.array([len(s) for s in sets]), np.concatenate(sets)
    own, _ = g.bands_of(n, 75, 100)
    band = np.repeat(np.maximum(own[::2], own[1::2]), 2)
    sig, who, _ = g.signatures(value, n, band, 75, 100)
    seen = np.unique(np.stack([sig, (who // 2).astype(np.uint64), (who % 2).astype(np.uint64)], 1), axis=0)
    shared = (seen[1:, :2] == seen[:-1, :2]).all(1)
    found = set(seen[1:][shared][:, 1].tolist())
    assert {names[i] for i in range(len(names)) if i not in found} == set()


def test_packed_signatures_keep_48_bits():
    sig = np.random.default_rng(0).integers(0, 2**64, 1000, np.uint64)
    assert len(g.packed(sig)) == 6 * len(sig) and (g.unpacked(g.packed(sig)) == sig & np.uint64(2**48 - 1)).all()


def test_allocation_covers_the_bound():
    m, d = g.allocation(75, 100)
    for hi, a, b in zip(g.BAND_HI[:20], m, d, strict=False):
        assert a + b >= g.most_apart(2 * int(hi), 75, 100) + 1 and b <= a


def test_histogram_bounds_the_intersection():
    r = np.random.default_rng(0)
    for n, k in [(5, 9), (40, 50), (300, 390), (7, 200)]:
        pool = r.integers(0, 2**63, 600).astype(np.uint64)
        a, b = (np.unique(r.choice(pool, x, replace=False)) for x in (n, k))
        ha, hb = (np.frombuffer(g.histogram(x, np.array([len(x)]))[0], np.uint8) for x in (a, b))
        assert g.most_common(ha, hb) >= len(np.intersect1d(a, b))


def test_shingle_numbers(spark):
    rows = [(i, t) for i, t in enumerate(["a b c d e f", "a a a a a a a", "Ünïcode wörds hier und da noch", "a\u00a0b c d e f g", "tab\tnew\nline\x0bff\x0cx y"])]
    got = {r["doc_id"]: r["n_shingles"] for r in g.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == {i: len(shingle_set(t)) for i, t in rows}


@pytest.mark.parametrize("sets, most", [(3, 10**9), (7, 300), (512, 400_000)])
def test_blocks_of_any_size_give_the_same(spark, monkeypatch, sets, most):
    monkeypatch.setattr(g, "BLOCK_SETS", sets)
    monkeypatch.setattr(g, "BLOCK_SHINGLES", most)
    rows = corpus(17, 120)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in g.near_duplicates(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert got == components(rows)


def test_blocks_cover_all_pairs_of_components(spark, monkeypatch):
    monkeypatch.setattr(g, "BLOCK_SETS", 5)
    r = random.Random(1)
    members = [(k, i, r.choice([0, 0, 0, 1, 2, i]), r.randint(1, 50)) for k in range(3) for i in range(60)]
    df = spark.createDataFrame(members, "gid long, set long, label long, n long")
    pieces = {}
    for x in g.blocked(df, ["gid"]).collect():
        pieces.setdefault((x["gid"], x["block_a"], x["block_b"]), []).append((x["side"], x["set"], x["label"]))
    met = set()
    for (gid, a, b), own in pieces.items():
        assert len(own) <= 40 and len({s for _, s, _ in own}) == len(own)
        met |= {(gid, min(s, t), max(s, t)) for d, s, l in own for e, t, m in own if l != m and (a == b or d != e)}
    label = {(k, i): l for k, i, l, _ in members}
    assert met == {(k, i, j) for k in range(3) for i in range(60) for j in range(i + 1, 60) if label[k, i] != label[k, j]}


def test_repeated_rows_stay_linear(spark):
    """Rows of a doc_id that repeats, with equal and with different texts, don't multiply on the way."""
    words = [f"w{i}" for i in range(60)]
    rows = [(1, " ".join(words))] * 30 + [(2, " ".join(words[:-2]))] * 30 + [(2, "another text of this number " + " ".join(words[:20]))] * 30 + [(None, " ".join(words[:-1]))] * 30
    df = spark.createDataFrame(rows, SCHEMA).repartition(7)
    got = [tuple(r) for r in g.near_duplicates(df).collect()]
    assert len(got) == 120 and {(d, n): c for d, n, c in got} == {(1, 56): 1, (2, 54): 1, (None, 55): 1, (2, 21): 2}


def test_long_words_are_told_apart(spark):
    """Words of more than 65,536 bytes that differ by a swap of bytes that far apart."""
    a = "a" * 70_000 + "b" + "a" * 70_000
    b = a[4465:] + a[:4465]
    swapped = list(a)
    swapped[70_000], swapped[70_000 - 65_536] = swapped[70_000 - 65_536], swapped[70_000]
    got = {r["doc_id"]: r["component_id"] for r in g.near_duplicates(spark.createDataFrame([(1, a), (2, "".join(swapped)), (3, b), (4, a)], SCHEMA)).collect()}
    assert got == {1: 1, 2: 2, 3: 3, 4: 1}


def test_allocation_is_the_cheapest_in_every_band():
    m, d = g.allocation(75, 100)
    for hi, a, b in zip(g.BAND_HI[:9].tolist(), m.tolist(), d.tolist(), strict=False):
        apart = g.most_apart(2 * hi, 75, 100)
        need = apart + 1 + (-(-15 * apart // 100) if hi > 12 else 0)
        choices = [(x + (need - x) * hi / x, x) for x in range(max(1, (need + 1) // 2), max(2, min(need, max(1, hi // 3)) + 1)) if need - x <= x]
        assert (a + b * hi / a) <= min(choices)[0] + 1e-9 and a + b == need


@pytest.mark.parametrize("most", [1, 1 << 16])
def test_possible_links_of_a_task_are_a_forest(monkeypatch, most):
    """Sets that meet in many groups and blocks are connected once, however many of these one task has."""
    monkeypatch.setattr(g, "FOREST_LINKS", most)
    r, batches, met = random.Random(5), [], []
    for _ in range(6):
        rows = []
        for _ in range(5):
            sets = sorted(r.sample(range(60), 20))
            kinds = [s % 3 for s in sets]
            rows.append({"sets": sets, "labels": sets, "sizes": [8] * 20, "sides": [0] * 20, "histograms": [bytes([8 * (k == 0), 8 * (k == 1), 8 * (k == 2), 0]) for k in kinds]})
            met += [(s, t) for s in sets for t in sets if s < t and s % 3 == t % 3]
        batches.append(pa.RecordBatch.from_pylist(rows, pa.schema([(c, pa.list_(pa.int64())) for c in ("sets", "labels", "sizes", "sides")] + [("histograms", pa.list_(pa.binary()))])))
    links = [(x["a"], x["b"]) for b in g._possible_edges(75, 100)(iter(batches)) for x in b.to_pylist()]

    def parts(pairs):
        root = {s: s for p in pairs for s in p}
        for _ in root:
            for a, b in pairs:
                root[a] = root[b] = min(root[a], root[b])
        return root

    assert parts(links) == parts(met) and len(links) == len(parts(met)) - len(set(parts(met).values()))
