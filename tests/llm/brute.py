"""Plain-Python versions of the operators, for small inputs."""

from __future__ import annotations

import math
import re
import struct
from collections import Counter

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, k=5):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def components(docs):
    """{doc_id: (n_shingles, component_id)} of [(doc_id, text)]."""
    sets = [(i, shingle_set(t)) for i, t in docs]
    parent = {i: i for i, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(sets)):
        for b in range(a):
            (i, x), (j, y) = sets[a], sets[b]
            if x and y and 100 * len(x & y) >= 75 * len(x | y):
                p, q = sorted((root(i), root(j)))
                parent[q] = p
    return {i: (len(s), root(i)) for i, s in sets}


def lm_scores(docs, order=3, backoff=0.4, min_count=2):
    words = [WORD.findall(t or "") for _, t in docs]
    count = Counter()
    for w in words:
        for n in range(order + 1):
            for i in range(len(w) - n + 1 if n else len(w)):
                count[tuple(w[i : i + n])] += 1
    out = []
    for w in words:
        total = 0.0
        for i in range(len(w)):
            log = 0.0
            for n in range(min(order, i + 1), 0, -1):
                gram = tuple(w[i - n + 1 : i + 1])
                if n == 1 or count[gram] >= min_count:
                    total += log + math.log(count[gram] / count[gram[:-1]])
                    break
                log += math.log(backoff)
        out.append((len(w), total))
    return out


def water_fill(sizes, weights, share, passes):
    """Targets by repeated sharing of what is above the caps."""
    want, target, open_ = share * sum(sizes), [0.0] * len(sizes), set(range(len(sizes)))
    while open_:
        left = want - sum(passes * sizes[i] for i in range(len(sizes)) if i not in open_)
        scale = left / sum(weights[i] for i in open_)
        over = {i for i in open_ if scale * weights[i] > passes * sizes[i] + 1e-9}
        if not over:
            for i in open_:
                target[i] = scale * weights[i]
            break
        open_ -= over
    return [target[i] if i in open_ else float(passes * sizes[i]) for i in range(len(sizes))]


def spark_hash(*values):
    """xxhash64 of texts and 64-bit numbers, as Spark chains it."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else struct.pack("<q", v), seed)
    return seed - (1 << 64) if seed >> 63 else seed


def anchors(text, k=6, s=2):
    """[(first word from 1, hash)] of a text's closed syncmers."""
    words = [spark_hash(w) for w in WORD.findall(text or "")]
    at = syncmer_words(words, k, s, lambda w: spark_hash(*w)) if len(words) >= k else []
    if not at:
        return [(1, spark_hash(*words))] if words else []
    return [(i + 1, spark_hash(*words[i : i + k])) for i in at]


def anchor_links(found):
    if len(found) < 2:
        return {h for _, h in found}
    return {(a[1], b[1], b[0] - a[0]) for a, b in zip(found, found[1:])}


def syncmer_words(words, k, s, h):
    """Start positions of closed syncmers, given a hash of an s-word window."""
    out = []
    for i in range(len(words) - k + 1):
        inner = [h(words[i + j : i + j + s]) for j in range(k - s + 1)]
        if min(inner) in (inner[0], inner[-1]):
            out.append(i)
    return out


def mixed(line, targets, passes=2, block_words=96, points=None):
    """[taken, first slot] of each row of {source: [sizes in the line's order]}, {source: target} in the sources' order."""
    want = sum(targets.values())
    slots = 2
    while want / slots > block_words:
        slots *= 2
    digits, width = slots.bit_length() - 1, want / slots
    points = points or (lambda j: int(f"{j:0{digits}b}"[::-1], 2))
    used, out = Counter(), {s: [[0, None] for _ in own] for s, own in line.items()}
    for j in range(slots):
        at, end = (points(j) + 0.5) * width, 0.0
        for s, t in targets.items():
            end += t
            if at < end:
                break
        r = used[s]
        used[s] += 1
        a, z, size = math.floor(r * width), math.floor((r + 1) * width), sum(line[s])
        for p in range(passes):
            begin = p * size
            for row, n in zip(out[s], line[s], strict=True):
                both = min(z, begin + n) - max(a, begin)
                if both > 0:
                    row[0] += both
                    row[1] = j if row[1] is None else row[1]
                begin += n
    return out
