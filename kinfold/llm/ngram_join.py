"""N-gram Jaccard join by universe partition and the pigeonhole principle, verified exactly.

Sets of hashed k-word shingles are put into bands by size (each twice the one before). For two sets of x and y shingles
with intersection/union >= NUM/DEN, at most H = (x+y)(DEN-NUM)/(DEN+NUM) shingles are in one set only. A band cuts the
universe of shingles into m segments; a segment gets 1 (index its subset), or 2 (index its subset and the subset's
one-deletion neighbourhood). If these numbers add up to H+K, the hits of any linked pair add up to K at least.
How many segments get 2 is chosen by cost per band. A set is indexed in its own band, and in the next one if a larger
partner could be there.

A segment that is empty in both sets is a hit without a signature. A pair can be found by such hits alone only if the
empty weight of both sets reaches the least sum of their hits, so exactly the sets where it does are cut again by another
hash, up to ``LEVELS`` times; what is still left after the last cut gets signatures of its empty subsets too.

Segments travel as packed blocks of (48 bits of the signature, set), dealt by signature; equal sets are folded per task before. Buckets
with two sets or more become groups. Pairs are then verified exactly, in three rounds:
 0. every set with the set it shares most groups with;
 1. every set with the first of each of its groups, where these aren't connected yet;
 2. all sets of a group that aren't connected yet: small histograms tell which could be connected; over all groups these make
    clusters, and inside a cluster products of 0/1 matrices give all intersections exactly. Groups and clusters are cut into
    blocks of bounded size, components first, and every pair of blocks that holds two components is a piece of work of its own.
In a group of more than ``HOT`` components only sets whose hot and empty segments add up to K or more can depend on it
(all others meet their partners in another group too), so only these are compared there. That loses no link and caps
nothing. The work inside a cluster grows with the product of its texts in different components; only connecting edges leave it.
Shingles and sets are told apart by 64-bit hashes: "exact" holds for these.

Defined cases: A-Z are lower-cased; null texts and texts without words have no shingles and link with nothing, not even
each other; fewer than k words make one shingle; repeated rows have the same set; a null doc_id takes part, but a
component is named by its least doc_id that isn't null; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._graph import components, forest
from kinfold.llm._kernel import distinct_sets, mix, shingles, slices, words
from kinfold.llm._store import free, small_batches, stored

K_WORDS, NUM, DEN = 5, 75, 100
BAND_HI = 6 * 2 ** np.arange(40, dtype=np.int64)
HOT = 48
LEVELS = 8
PART_SIGNATURES = 1_600_000
#: A block of a group or cluster has about so many sets, and so many shingles, at most.
BLOCK_SETS, BLOCK_SHINGLES = 512, 400_000
BROADCAST_ROWS = 200_000
#: A task's possible links are cut down to a forest whenever it has so many more.
FOREST_LINKS = 1 << 16

_S = np.uint64(0xA5A5_5A5A_1234_5678)


def most_apart(x: int, num: int, den: int) -> int:
    """H for two sets of x shingles together."""
    return x * (den - num) // (den + num)


@lru_cache(maxsize=8)
def allocation(num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """(m, d) by band: m segments, of which the first d get 2; the cheapest that add up to H and some slack."""
    ms, ds = [], []
    for hi in BAND_HI.tolist():
        apart = most_apart(2 * hi, num, den)
        need = apart + 1 + (math.ceil(0.15 * apart) if hi > 12 else 0)
        best = None
        least, most = max(1, (need + 1) // 2), max(2, min(need, max(1, hi // 3)) + 1)
        for m in range(least, most, 1 + (most - least) // 4096):  # in the largest bands every so many-th, and the last
            m = most - 1 - (m - least)
            d = max(0, need - m)
            if d <= m:
                cost = m + d * hi / m
                best = min(best or (math.inf, 0, 0), (cost, m, d))
        _, m, d = best or (0, need, 0)
        ms.append(m)
        ds.append(d)
    return np.array(ms), np.array(ds)


def sets_of(flat: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, their number per text, and a 64-bit name of each set."""
    h, _, per = words(flat, offs, lower=True)
    with np.errstate(over="ignore"):
        value, n = distinct_sets(*shingles(h, per, k))
    name = np.zeros(len(n), np.uint64)
    some = n > 0
    if some.any():
        begin = (np.cumsum(n) - n)[some]
        name[some] = mix(np.add.reduceat(mix(value ^ _S), begin) + n[some].astype(np.uint64))
    return value, n, name


def cut(value: np.ndarray, n: np.ndarray, band: np.ndarray, num: int, den: int, level: int = 0, empty: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of sets (flat hashes, sizes) in the given bands: signatures, the set of each, and per set the weight of empty subsets.

    ``level`` chooses the hash that cuts; with ``empty``, empty subsets have signatures too.
    """
    ms, ds = allocation(num, den)
    m, d = ms[band], ds[band]
    base = np.cumsum(m) - m
    owner = np.repeat(np.arange(len(n)), n)
    by = value if level == 0 else mix(value ^ mix(np.array([level], np.uint64)))
    segment = (((by >> np.uint64(32)) * m[owner].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
    at = base[owner] + segment
    term = mix(value ^ _S)
    sums = np.zeros(int(m.sum()), np.uint64)
    np.add.at(sums, at, term)
    size = np.bincount(at, minlength=len(sums))
    of = np.repeat(np.arange(len(n)), m)
    seg = np.arange(len(sums)) - base[of]
    place = mix((band[of].astype(np.uint64) << np.uint64(40)) + np.uint64(level << 32) + seg.astype(np.uint64))
    doubled = seg < d[of]
    missing = np.bincount(of, (size == 0) * (1 + doubled) + ((size == 1) & doubled), minlength=len(n)).astype(np.int64)
    full = (size > 0) | empty
    out, who = [mix(sums[full] + place[full])], [of[full]]
    drop = doubled[at] & ((size[at] > 1) | empty)
    if drop.any():
        out.append(mix(sums[at[drop]] - term[drop] + place[at[drop]]))
        who.append(owner[drop])
    sig, who = np.concatenate(out), np.concatenate(who)
    return (sig & ~np.uint64(31)) | band[who].astype(np.uint64), who, missing


def unsure(n: np.ndarray, band: np.ndarray, missing: np.ndarray, num: int, den: int) -> np.ndarray:
    """Sets whose empty weight reaches the least sum of the hits with their furthest partner in the band."""
    ms, ds = allocation(num, den)
    furthest = (n + np.minimum(n * den // num, BAND_HI[band])) * (den - num) // (den + num)
    return missing >= ms[band] + ds[band] - furthest


def signatures(value: np.ndarray, n: np.ndarray, band: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Signatures of which any linked pair shares one, the set of each, and per set the weight of empty subsets in the first cut."""
    sig, who, missing = cut(value, n, band, num, den)
    sigs, whos, at, left = [sig], [who], np.arange(len(n)), missing
    for level in range(1, LEVELS + 1):
        again = unsure(n, band, left, num, den)
        if not again.any():
            break
        value, n, band, at = value[np.repeat(again, n)], n[again], band[again], at[again]
        sig, who, left = cut(value, n, band, num, den, level, level == LEVELS)
        sigs.append(sig)
        whos.append(at[who])
    return np.concatenate(sigs), np.concatenate(whos), missing


def bands_of(n: np.ndarray, num: int, den: int) -> tuple[np.ndarray, np.ndarray]:
    """Own band of each size, and whether a partner may be in the next one."""
    own = np.searchsorted(BAND_HI, n)
    return own, n * den // num > BAND_HI[own]


def _described(k: int, keep: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offs in slices(batches, "text"):
            _, n, name = sets_of(flat, offs, k)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(n.astype(np.int64)), pa.array(name.view(np.int64))], names=[*keep, "n_shingles", "set_id"])

    return run


def packed(sig: np.ndarray) -> bytes:
    """The lower 48 bits of signatures; the upper ones have chosen the part. What falls together is compared like any group."""
    return sig.astype(np.uint32).tobytes() + (sig >> np.uint64(32)).astype(np.uint16).tobytes()


def unpacked(sigs: bytes) -> np.ndarray:
    n = len(sigs) // 6
    return np.frombuffer(sigs, np.uint32, n).astype(np.uint64) | (np.frombuffer(sigs, np.uint16, n, 4 * n).astype(np.uint64) << np.uint64(32))


def _blocks(k: int, num: int, den: int, parts: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for _, flat, offs in slices(batches, "text"):
            value, n, name = sets_of(flat, offs, k)
            fresh = np.zeros(len(n), bool)
            for i, s in enumerate(name.tolist()):
                if n[i] and s not in seen:
                    fresh[i] = True
                    seen.add(s)
            if len(seen) > 1 << 20:
                seen.clear()
            value, name, n = value[np.repeat(fresh, n)], name[fresh], n[fresh]
            if not len(n):
                continue
            own, also = bands_of(n, num, den)
            first = signatures(value, n, own, num, den)
            sig, who = [first[0]], [first[1]]
            if also.any():
                more = signatures(value[np.repeat(also, n)], n[also], own[also] + 1, num, den)
                sig.append(more[0])
                who.append(np.flatnonzero(also)[more[1]])
            sig, who = np.concatenate(sig), np.concatenate(who)
            part = (((sig >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)).astype(np.uint16 if parts <= 1 << 16 else np.int64)
            order = np.argsort(part, kind="stable")
            part, sig, who = part[order], sig[order], who[order]
            start = np.flatnonzero(np.append(True, part[1:] != part[:-1]))
            sigs, whos, names = [], [], []
            for a, z in zip(start, np.append(start[1:], len(part)), strict=True):
                used, index = np.unique(who[a:z], return_inverse=True)
                sigs.append(packed(sig[a:z]))
                whos.append(index.astype(np.uint32 if len(used) > 65535 else np.uint16).tobytes())
                names.append(name[used].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(part[start].astype(np.int64)), pa.array(sigs, pa.binary()), pa.array(whos, pa.binary()), pa.array(names, pa.binary())], names=["part", "sigs", "owners", "sets"])

    return run


def _groups(num: int, den: int):
    def run(table: pa.Table) -> pa.Table:
        sig, sets = [], []
        for s, o, names in zip(*(table.column(c).to_pylist() for c in ("sigs", "owners", "sets")), strict=True):
            s, names = unpacked(s), np.frombuffer(names, np.uint64)
            sig.append(s)
            sets.append(names[np.frombuffer(o, np.uint16 if len(o) == 2 * len(s) else np.uint32)])
        sig, sets = np.concatenate(sig), np.concatenate(sets)
        order = np.argsort(sig)
        sig, sets = sig[order], sets[order]
        same = sig[1:] == sig[:-1]
        several = np.append(same, False) | np.append(False, same)
        sig, sets = sig[several], sets[several].view(np.int64)
        order = np.lexsort((sets, sig))
        sig, sets = sig[order], sets[order]
        keep = np.append(True, (sig[1:] != sig[:-1]) | (sets[1:] != sets[:-1]))[: len(sig)]
        sig, sets = sig[keep], sets[keep]
        begin = np.flatnonzero(np.append(True, sig[1:] != sig[:-1])[: len(sig)])
        length = np.diff(np.append(begin, len(sig)))
        begin, length = begin[length > 1], length[length > 1]
        if not len(begin):
            return pa.table({"band": pa.array([], pa.int32()), "gid": pa.array([], pa.int64()), "weight": pa.array([], pa.int64()), "members": pa.array([], pa.list_(pa.int64()))})
        place = np.repeat(begin - (np.cumsum(length) - length), length) + np.arange(length.sum())
        members = sets[place]
        gid = mix(np.add.reduceat(mix(members.view(np.uint64)), np.cumsum(length) - length) + length.astype(np.uint64))
        band = (sig[begin] & np.uint64(31)).astype(np.int64)
        weigh = 1 + (allocation(num, den)[1][band] > 0)
        names, first, which = np.unique(np.stack([band, gid.view(np.int64)], 1), axis=0, return_index=True, return_inverse=True)
        total = np.bincount(which.ravel(), weigh, minlength=len(names)).astype(np.int64)
        taken = length[first]
        starts = (np.cumsum(length) - length)[first]
        place = np.repeat(starts - (np.cumsum(taken) - taken), taken) + np.arange(taken.sum())
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(taken)]).astype(np.int32)), pa.array(members[place]))
        return pa.table({"band": pa.array(names[:, 0].astype(np.int32)), "gid": pa.array(names[:, 1]), "weight": pa.array(total), "members": lists})

    return run


GROUPS = "band int, gid long, weight long, members array<long>"


def histogram(value: np.ndarray, n: np.ndarray) -> list[bytes]:
    """Per set, how many hashes fall into each of 2^j bins, one byte each (255: that or more).

    A bin holds one to two on average, and two to four in sets of 128 and more, which have bins enough to tell unlike sets apart.
    """
    ends, out = np.cumsum(n), []
    for z, c in zip(ends.tolist(), n.tolist(), strict=True):
        bins = 1 << max(0, c.bit_length() - 1 - (c >= 128))
        count = np.bincount((value[z - c : z] & np.uint64(bins - 1)).astype(np.int64), minlength=bins)
        out.append(np.minimum(count, 255).astype(np.uint8).tobytes())
    return out


def most_common(a: np.ndarray, b: np.ndarray) -> int:
    """Upper bound of the intersection of two sets, from their histograms."""
    a, b = a.astype(np.int64), b.astype(np.int64)
    a[a == 255], b[b == 255] = 1 << 40, 1 << 40
    if len(a) > len(b):
        a = a.reshape(-1, len(b)).sum(0)
    elif len(b) > len(a):
        b = b.reshape(-1, len(a)).sum(0)
    return int(np.minimum(a, b).sum())


def _profiles(k: int, num: int, den: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, offs in slices(batches, "text"):
            value, n, name = sets_of(flat, offs, k)
            own, also = bands_of(n, num, den)
            missing = cut(value, n, own, num, den)[2]
            beyond = np.zeros(len(n), np.int64)
            if also.any():
                beyond[also] = cut(value[np.repeat(also, n)], n[also], own[also] + 1, num, den)[2]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(n.astype(np.int64)), pa.array(own.astype(np.int32)), pa.array(missing), pa.array(beyond), pa.array(histogram(value, n), pa.binary())], names=["set_id", "n", "band", "missing", "missing_next", "histogram"])

    return run


PROFILES = "set_id long, n long, band int, missing long, missing_next long, histogram binary"


def _bodies(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, flat, offs in slices(batches, "text"):
            value, n, name = sets_of(flat, offs, k)
            ends = np.cumsum(n)
            body = [value[z - c : z].tobytes() for z, c in zip(ends.tolist(), n.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(name.view(np.int64)), pa.array(body, pa.binary())], names=["set_id", "body"])

    return run


def _kept(test):
    """Keep the pairs (a, b) whose left and right binaries pass ``test``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column("left"), batch.column("right")
            mask = pa.array([test(x, y) for x, y in zip(left, right, strict=True)], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(mask), batch.column("b").filter(mask)], names=["a", "b"])

    return run


def _could_link(num: int, den: int):
    def test(x, y) -> bool:
        a, b = np.frombuffer(x.as_buffer(), np.uint8), np.frombuffer(y.as_buffer(), np.uint8)
        some, others = int(a.sum()), int(b.sum())
        if 255 in a or 255 in b:
            return True
        return (den + num) * min(most_common(a, b), some, others) >= num * (some + others)

    return test


def _links(num: int, den: int):
    def test(x, y) -> bool:
        a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
        short, long = (a, b) if len(a) < len(b) else (b, a)
        spot = np.searchsorted(long, short)
        both = int((long[np.minimum(spot, len(long) - 1)] == short).sum())
        return den * both >= num * (len(a) + len(b) - both)

    return test


def _paired(pairs: DataFrame, table: DataFrame, column: str) -> DataFrame:
    """The pairs (a, b) with ``column`` of both sets as left and right."""
    right = table.select(F.col("set_id").alias("b"), F.col(column).alias("right"))
    left = table.select(F.col("set_id").alias("a"), F.col(column).alias("left"))
    return pairs.select("a", "b").join(right, "b").join(left, "a").select("a", "b", "left", "right")


def unique_sets(table: DataFrame, name: str) -> DataFrame:
    """One row per set: several documents can have the text of a wanted doc_id. Told from narrow rows, as nearly always none has."""
    if table.select("set_id").distinct().count() == table.count():
        return table
    return stored(table.dropDuplicates(["set_id"]), name)


class Verifier:
    """Exact check of pairs: first an upper bound of the intersection from small histograms, then the shingles themselves."""

    def __init__(self, texts: DataFrame, owners: DataFrame, profiles: DataFrame, k: int, num: int, den: int):
        self.texts, self.owners, self.profiles, self.k, self.num, self.den = texts, owners, profiles, k, num, den

    def possible(self, pairs: DataFrame) -> DataFrame:
        size = self.profiles.select("set_id", "n")
        fit = pairs.select("a", "b").join(size.withColumnsRenamed({"set_id": "a", "n": "_na"}), "a").join(size.withColumnsRenamed({"set_id": "b", "n": "_nb"}), "b")
        fit = fit.where(F.least("_na", "_nb") * self.den >= F.greatest("_na", "_nb") * self.num)
        return stored(_paired(fit, self.profiles, "histogram").mapInArrow(_kept(_could_link(self.num, self.den)), "a long, b long"), "ngram-possible")

    def links(self, possible: DataFrame) -> DataFrame:
        need = possible.select(F.col("a").alias("set_id")).unionByName(possible.select(F.col("b").alias("set_id"))).distinct()
        bodies = bodies_of(self.texts, self.owners, need, self.k)
        return stored(_paired(possible, bodies, "body").mapInArrow(_kept(_links(self.num, self.den)), "a long, b long").distinct(), "ngram-links")


def texts_of(texts: DataFrame, owners: DataFrame, need: DataFrame) -> DataFrame:
    """The text of one document for each set of ``need``."""
    ids = stored(owners.join(need, "set_id").select("doc_id"), "ngram-owners")
    few = ids.count()
    chosen = F.broadcast(ids) if few <= BROADCAST_ROWS else ids  # 8 bytes a row; beyond, both sides are shuffled
    return texts.join(chosen, texts["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")


def bodies_of(texts: DataFrame, owners: DataFrame, need: DataFrame, k: int) -> DataFrame:
    return unique_sets(stored(texts_of(texts, owners, need).mapInArrow(_bodies(k), "set_id long, body binary"), "ngram-bodies"), "ngram-one-body")


def blocked(members: DataFrame, group: list[str]) -> DataFrame:
    """Members (``group``, set, label, n, more) once for each pair of blocks that needs them: with block_a, block_b and side.

    A component of many sets has blocks of its own, all others share blocks. Side 0 is of block_a, side 1 of block_b; of a block
    with itself there is side 0 only. Pairs of blocks of one component are left out.
    """
    per = members.groupBy(*group, "label").agg(F.count("*").alias("c"), F.sum("n").alias("w"))
    per = per.withColumn("own", F.when((F.col("c") > BLOCK_SETS) | (F.col("w") > BLOCK_SHINGLES), F.col("label")))
    parts = per.groupBy(*group, "own").agg(F.ceil(F.greatest(F.sum("c") / BLOCK_SETS, F.sum("w") / BLOCK_SHINGLES)).cast("int").alias("parts"))
    named = F.xxhash64("own", "part").alias("block")
    blocks = parts.select(*group, "own", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")).select(*group, "own", named)
    right = blocks.select(*[F.col(c).alias(f"_{c}") for c in group], F.col("own").alias("_own"), F.col("block").alias("block_b"))
    same = F.lit(True)
    for c in group:
        same &= F.col(c) == F.col(f"_{c}")
    pairs = blocks.withColumnRenamed("block", "block_a").join(right, same).where("block_a <= block_b and not coalesce(own = _own, false)").select(*group, "block_a", "block_b")
    dealt = members.join(per.select(*group, "label", "own"), [*group, "label"]).join(parts.withColumnRenamed("own", "_own"), group).where("own <=> _own")
    dealt = dealt.withColumn("part", F.pmod(F.xxhash64("set", F.lit(3)), F.col("parts")).cast("int")).withColumn("block", named).drop("own", "_own", "part", "parts")
    first = dealt.join(pairs.withColumn("block", F.col("block_a")), [*group, "block"]).withColumn("side", F.lit(0))
    second = dealt.join(pairs.where("block_a < block_b").withColumn("block", F.col("block_b")), [*group, "block"]).withColumn("side", F.lit(1))
    return first.unionByName(second).drop("block")


def _near_in_group(size: np.ndarray, label: np.ndarray, side: np.ndarray, table: list[np.ndarray], num: int, den: int) -> Iterator[tuple[int, np.ndarray]]:
    """For each set (by rising size), the later ones of other components that its histogram can't rule out, across sides where there are two."""
    crossed = bool(side.any())
    bins = np.array([len(h) for h in table])
    by_bins = {b: np.flatnonzero(bins == b) for b in np.unique(bins).tolist()}
    rows = {b: np.stack([table[i] for i in at]).astype(np.int16) for b, at in by_bins.items()}
    for b, m in rows.items():
        m[m == 255] = 1 << 13  # 255 or more: no bound from this bin
    folded = {(2 * b, b): rows[2 * b].reshape(len(rows[2 * b]), 2, b).sum(1, dtype=np.int16) for b in rows if 2 * b in rows}
    place = np.empty(len(size), np.int64)
    for at in by_bins.values():
        place[at] = np.arange(len(at))
    reach = np.searchsorted(size, size * den // num, "right")
    for i in range(len(size)):
        b, hits = int(bins[i]), []
        for other, m in ((b, rows[b]), (2 * b, folded.get((2 * b, b)))):
            if m is None:
                continue
            at = by_bins[other]
            a, z = np.searchsorted(at, i + 1), np.searchsorted(at, reach[i])
            if z > a:
                most = np.minimum(rows[b][place[i]], m[a:z]).sum(1, dtype=np.int64)
                j = at[a:z]
                hits.append(j[(label[j] != label[i]) & ((side[j] != side[i]) | (not crossed)) & ((den + num) * most >= num * (size[i] + size[j]))])
        if hits:
            yield i, np.concatenate(hits)


def _roots(n: int, pairs: list[tuple[int, np.ndarray]]) -> np.ndarray:
    """Component (by its least index) of each of n members, from (i, partners) pairs."""
    root = np.arange(n)
    for i, j in pairs:
        touched = np.unique(root[np.append(j, i)])
        if len(touched) > 1:
            root[np.isin(root, touched[1:])] = touched[0]
    return root


def _possible_edges(num: int, den: int):
    """What histograms allow to be connected in groups: an edge from each such set of the task to the first of its component.

    Sets that meet in many groups, or in many blocks of one, are connected once a task, not once in each of these.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        links, held, after = [], 0, FOREST_LINKS
        for batch in batches:
            for sets, label, size, side, table in zip(*(batch.column(c) for c in ("sets", "labels", "sizes", "sides", "histograms")), strict=True):
                sets, label, size, side = (np.asarray(x.values) for x in (sets, label, size, side))
                order = np.argsort(size, kind="stable")
                table = [np.frombuffer(table.values[int(i)].as_buffer(), np.uint8) for i in order]
                sets, label, size, side = sets[order], label[order], size[order], side[order]
                root = _roots(len(sets), [(i, j) for i, j in _near_in_group(size, label, side, table, num, den) if len(j)])
                other = root != np.arange(len(sets))
                links.append(np.stack([sets[root[other]], sets[other]]))
                held += links[-1].shape[1]
                if held > after:
                    node, least = forest(links)
                    links, held, after = [np.stack([least, node])], len(node), 2 * len(node) + FOREST_LINKS
        if held:
            node, least = forest(links)
            yield pa.RecordBatch.from_arrays([pa.array(least), pa.array(node)], names=["a", "b"])

    return run


COLUMNS = 4096


def _common(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """Intersection sizes of all pairs, by products of 0/1 matrices whose columns are the hashes that both sides have."""
    shared = np.intersect1d(np.concatenate(left), np.concatenate(right))
    total = np.zeros((len(left), len(right)), np.float32)

    def entries(bodies: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, column) of each hash that is shared, by rising column, and where every COLUMNS-th column begins."""
        flat, owner = np.concatenate(bodies), np.repeat(np.arange(len(bodies)), [len(b) for b in bodies])
        spot = np.minimum(np.searchsorted(shared, flat), len(shared) - 1)
        keep = shared[spot] == flat
        order = np.argsort(spot[keep], kind="stable")
        column = spot[keep][order]
        return owner[keep][order], column, np.searchsorted(column, np.arange(0, len(shared) + COLUMNS, COLUMNS))

    if not len(shared):
        return total
    sides = entries(left), entries(right)
    for k in range(-(-len(shared) // COLUMNS)):
        x, y = (np.zeros((len(b), COLUMNS), np.float32) for b in (left, right))
        for m, (row, column, cuts) in zip((x, y), sides, strict=True):
            m[row[cuts[k] : cuts[k + 1]], column[cuts[k] : cuts[k + 1]] - k * COLUMNS] = 1
        total += x @ y.T
    return total


def _linked_lists(num: int, den: int):
    """Exact links between the two blocks of a pair (or inside one), as edges from every set to the first of its component."""

    def run(table: pa.Table) -> pa.Table:
        sets, side, label = (np.asarray(table.column(c).combine_chunks()) for c in ("set", "side", "label"))
        bodies = [np.frombuffer(b.as_buffer(), np.uint64) for b in table.column("body").combine_chunks()]
        a = np.flatnonzero(side == 0)
        b = np.flatnonzero(side == 1) if side.any() else a
        if not len(a) or not len(b):
            return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
        both = _common([bodies[i] for i in a], [bodies[i] for i in b]).astype(np.int64)
        n = np.array([len(x) for x in bodies])
        good = ((den + num) * both >= num * (n[a][:, None] + n[b][None])) & (label[a][:, None] != label[b][None])
        root = _roots(len(sets), [(int(a[i]), b[good[i]]) for i in np.flatnonzero(good.any(1))])
        other = root != np.arange(len(sets))
        return pa.table({"a": pa.array(sets[root[other]]), "b": pa.array(sets[other])})

    return run


def set_components(docs: DataFrame, k: int = K_WORDS, num: int = NUM, den: int = DEN) -> tuple[DataFrame, DataFrame | None]:
    """(doc_id, n_shingles, set_id) of all rows, and (node, label) of the linked sets, or None without links."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select("doc_id", "text")
    rows = stored(texts.mapInArrow(_described(k, ["doc_id"]), "doc_id long, n_shingles long, set_id long"), "ngram-rows")
    total = rows.agg(F.coalesce(F.sum("n_shingles"), F.lit(0))).first()[0]
    parts = max(64, -(-3 * total // (4 * PART_SIGNATURES)))
    blocks = texts.mapInArrow(_blocks(k, num, den, parts), "part long, sigs binary, owners binary, sets binary")
    found = blocks.groupBy("part").applyInArrow(_groups(num, den), GROUPS)
    groups = stored(found.groupBy("band", "gid").agg(F.first("members").alias("members"), F.sum("weight").alias("weight")), "ngram-groups")
    del blocks, found
    free(spark)

    stars = groups.select(F.element_at("members", 1).alias("a"), F.explode(F.slice("members", 2, F.size("members"))).alias("b"))
    stars = stored(stars.groupBy("a", "b").agg(F.count("*").alias("shared")), "ngram-stars")
    if stars.isEmpty():
        return rows, None
    wanted = stars.select(F.col("a").alias("set_id")).unionByName(stars.select(F.col("b").alias("set_id"))).distinct()
    owners = rows.where("n_shingles > 0").groupBy("set_id").agg(F.min("doc_id").alias("doc_id"))
    owners = stored(owners.join(wanted, "set_id"), "ngram-wanted")
    profiles = stored(texts_of(texts, owners, owners.select("set_id")).mapInArrow(_profiles(k, num, den), PROFILES), "ngram-profiles")
    profiles = unique_sets(profiles, "ngram-one-profile")
    check = Verifier(texts, owners, profiles, k, num, den)

    stars = check.possible(stars).join(stars, ["a", "b"])
    best = stored(stars.groupBy("b").agg(F.max_by("a", F.struct("shared", -F.col("a"))).alias("a")), "ngram-best")
    links = check.links(best)
    labels = components(links)

    def labelled(df: DataFrame, column: str, out: str) -> DataFrame:
        return df.join(labels.withColumnsRenamed({"node": column, "label": "_l"}), column, "left").withColumn(out, F.coalesce("_l", column)).drop("_l")

    apart = labelled(labelled(stars.select("a", "b"), "a", "_a"), "b", "_b").where("_a <> _b").select("a", "b")
    apart = stored(apart.join(best, ["a", "b"], "left_anti"), "ngram-apart")
    links = stored(links.unionByName(check.links(apart)), "ngram-links")
    labels = components(links)
    del stars, wanted, best, apart
    free(spark)

    # Round 2: groups of more than two sets that still hold several components.
    own = profiles.select(F.col("set_id").alias("set"), "n", F.col("band").alias("_own"), "missing", "missing_next")
    wide = groups.where(F.size("members") > 2).select("band", "gid", "weight", F.element_at("members", 1).alias("first"), F.explode("members").alias("set"))
    members = labelled(wide, "set", "label")
    spread = members.groupBy("band", "gid").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi"), F.approx_count_distinct("label").alias("_labels")).where("_lo <> _hi")
    members = stored(members.join(spread.select("band", "gid", (F.col("_labels") > HOT).alias("is_hot")), ["band", "gid"]), "ngram-open")
    ms, ds = allocation(num, den)
    given = F.create_map(*[F.lit(int(x)) for b, (m, d) in enumerate(zip(ms[:32], ds[:32], strict=True)) for x in (b, m + d)])
    hi = F.create_map(*[F.lit(x) for b in range(32) for x in (b, int(BAND_HI[b]))])
    hot = members.where("is_hot").groupBy("set", "band").agg(F.sum("weight").alias("_hot")).join(own, "set")
    empty = F.when(F.col("band") == F.col("_own"), F.col("missing")).otherwise(F.col("missing_next"))
    furthest = F.floor((F.col("n") + F.least(F.floor(F.col("n") * den / num), hi[F.col("band")])) * (den - num) / (den + num))
    bound_to = hot.where(F.col("_hot") + empty >= given[F.col("band")] - furthest).select("set", "band", F.lit(True).alias("_bound"))
    members = members.join(bound_to, ["set", "band"], "left").where("not is_hot or _bound")
    sizes = profiles.select(F.col("set_id").alias("set"), "n")
    open_ = stored(members.select("band", "gid", "set", "label").join(sizes, "set"), "ngram-members")
    pieces = blocked(open_, ["band", "gid"]).join(profiles.select(F.col("set_id").alias("set"), "histogram"), "set")
    item = F.struct(F.col("set").alias("s"), F.col("label").alias("l"), F.col("n"), F.col("side").alias("d"), F.col("histogram").alias("h"))
    rest = pieces.groupBy("band", "gid", "block_a", "block_b").agg(F.collect_list(item).alias("_m")).where(F.size("_m") > 1)  # two blocks at most
    rest = rest.select(F.col("_m.s").alias("sets"), F.col("_m.l").alias("labels"), F.col("_m.n").alias("sizes"), F.col("_m.d").alias("sides"), F.col("_m.h").alias("histograms"))
    edges = stored(rest.mapInArrow(_possible_edges(num, den), "a long, b long").distinct(), "ngram-possible")
    if edges.isEmpty():
        return rows, labels
    del groups, own, wide, members, spread, hot, bound_to, open_, pieces, rest
    free(spark)
    joined = components(edges)
    listed = joined.select(F.col("label").alias("gid"), F.col("node").alias("set")).unionByName(joined.select(F.col("label").alias("gid"), F.col("label").alias("set")).distinct())
    listed = stored(labelled(listed, "set", "label").join(sizes, "set"), "ngram-clusters")
    bodies = bodies_of(texts, owners, listed.select(F.col("set").alias("set_id")).distinct(), k)
    inside = blocked(listed, ["gid"]).join(bodies.withColumnRenamed("set_id", "set"), "set").groupBy("gid", "block_a", "block_b").applyInArrow(_linked_lists(num, den), "a long, b long")
    links = stored(links.unionByName(inside.distinct()), "ngram-links")
    return rows, components(links)


def near_duplicates(docs: DataFrame, k: int = K_WORDS, num: int = NUM, den: int = DEN) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of ``docs`` (doc_id, text)."""
    rows, labels = set_components(docs, k, num, den)
    some = rows.where("n_shingles > 0")
    none = rows.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    least = some.groupBy("set_id").agg(F.min("doc_id").alias("_least"))
    if labels is not None:
        least = least.join(labels.withColumnRenamed("node", "set_id"), "set_id", "left").withColumn("label", F.coalesce("label", "set_id"))
        first = least.groupBy("label").agg(F.min("_least").alias("component_id"))
        least = least.join(first, "label").select("set_id", "component_id")
    else:
        least = least.withColumnRenamed("_least", "component_id")
    least = stored(least, "ngram-components")
    return some.join(least, "set_id").select("doc_id", "n_shingles", "component_id").unionByName(none)


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
