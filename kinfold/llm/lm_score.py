"""Stupid-backoff language-model scores, computed relationally.

Documents are dealt into chunks of a few megabytes. A chunk's n-grams are exploded and pre-aggregated to (n-gram hash,
count); these are dealt by hash to the parts of the count table, where counts of all chunks are added. Each part joins its
table to the n-grams that chunks asked for, and the totals go back to the chunks, are joined to their exploded n-grams, and
summed per document. An n-gram counted ``MIN_COUNT`` times or more consists of shorter ones that are counted as often, so
from three words on only n-grams whose two shorter ones are that frequent are sent at all; the others' counts are never read.

S(w | context) = c(context w) / c(context) where c(context w) >= ``MIN_COUNT``, else ``BACKOFF`` * S(w | shorter context);
for single words c(w) / N. Counts cover all documents, a document's own words included. N-grams are told apart by a 62-bit
hash at every size (of their words' 64-bit hashes; in a corpus of 10^12 n-grams one in four million shares its own, and the counts
add up). Log scores are natural and summed over a text's words.

Defined cases: null texts and texts without words have 0 tokens, log score 0 and no mean; a text's first words have
shorter contexts; repeated rows are scored and counted each; a null doc_id is scored; a very long text is a chunk with
few others, and takes memory in proportion; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._kernel import _stream, mix, text_buffer, words
from kinfold.llm._store import small_batches

ORDER, BACKOFF, MIN_COUNT = 3, 0.4, 2
BITS = 62
CHUNK_BYTES = 8 << 20
PART_GRAMS = 1_000_000

_PLACE = _stream(211, 16) | np.uint64(1)
_EMPTY = np.uint64(1)  # the n-gram of no words: counts all words


def grams(word: np.ndarray, doc: np.ndarray, n: int, bits: int = BITS) -> np.ndarray:
    """Hash (2 or more) of the n words that end at each word; 0 where the text has fewer before it."""
    total = np.full(len(word), n, np.uint64)
    inside = np.ones(len(word), bool)
    for j in range(n):
        total[j:] += word[: len(word) - j] * _PLACE[n - 1 - j]
        inside[:j] = False
    if n > 1:
        inside[n - 1 :] = doc[n - 1 :] == doc[: len(doc) - n + 1]
    out = np.maximum(mix(total) >> np.uint64(64 - bits), np.uint64(2))
    out[~inside] = 0
    return out


def _squeezed(data: bytes, strategy: int) -> bytes:
    press = zlib.compressobj(1, zlib.DEFLATED, -15, 9, strategy)
    return press.compress(data) + press.flush()


def pack(value: np.ndarray) -> bytes:
    """Rising numbers as differences of as many bytes as the greatest takes; their top bytes, mostly small, are Huffman coded."""
    step = np.diff(value, prepend=value[:1])
    width = max(1, (int(step.max()).bit_length() + 7) // 8)
    octets = step.astype("<u8").view(np.uint8).reshape(-1, 8)
    return bytes([width]) + value[:1].astype("<u8").tobytes() + octets[:, : width - 1].tobytes() + _squeezed(octets[:, width - 1].tobytes(), zlib.Z_HUFFMAN_ONLY)


def unpack(data: bytes, n: int) -> np.ndarray:
    width, first = data[0], np.frombuffer(data, "<u8", 1, 1)[0]
    wide = np.zeros((n, 8), np.uint8)
    low = n * (width - 1)
    wide[:, : width - 1] = np.frombuffer(data, np.uint8, low, 9).reshape(n, width - 1)
    wide[:, width - 1] = np.frombuffer(zlib.decompress(data[9 + low :], -15), np.uint8)
    return np.cumsum(wide.view("<u8").ravel(), dtype=np.uint64) + first


def pack_counts(count: np.ndarray) -> bytes:
    """A byte each, compressed; 255 points to the next of the large ones behind them."""
    return _squeezed(np.minimum(count, 255).astype("u1").tobytes() + count[count >= 255].astype("<u8").tobytes(), zlib.Z_DEFAULT_STRATEGY)


def unpack_counts(data: bytes, n: int) -> np.ndarray:
    data = zlib.decompress(data, -15)
    out = np.frombuffer(data, "u1", n).astype(np.int64)
    out[out == 255] = np.frombuffer(data, "<u8", offset=n)
    return out


ASKED = "part long, chunk long, n long, hashes binary, counts binary"
ANSWERS = "chunk long, level int, part long, n long, totals binary"


def _asked(chunk: int, value: np.ndarray, count: np.ndarray, parts: int) -> pa.Table:
    """One chunk's (n-gram, count) rows, rising, by ranges of hashes."""
    edges = np.array([(p << BITS) // parts for p in range(1, parts)], np.uint64)
    cut = np.concatenate([[0], np.searchsorted(value, edges), [len(value)]])
    some = np.flatnonzero(np.diff(cut))
    return pa.table({
        "part": pa.array(some, pa.int64()), "chunk": pa.array([chunk] * len(some), pa.int64()), "n": pa.array(np.diff(cut)[some], pa.int64()),
        "hashes": pa.array([pack(value[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
        "counts": pa.array([pack_counts(count[cut[p] : cut[p + 1]]) for p in some], pa.binary()),
    })


class Chunk:
    """A chunk's words, and what is known so far of the counts of the n-grams that end at each."""

    def __init__(self, texts: pa.Table, min_count: int):
        flat, offs = text_buffer(texts.column("text"))
        with np.errstate(over="ignore"):
            self.word, self.doc, self.per = words(flat, offs)
        self.min_count, self.total, self.counts = min_count, 0.0, []

    def grams(self, n: int) -> np.ndarray:
        """The n-grams to be counted, 0 where there is none or where shorter ones say that it is too rare to matter."""
        with np.errstate(over="ignore"):
            out = grams(self.word, self.doc, n)
        if n > 2:
            often = self.counts[n - 2] >= self.min_count
            out[~often] = 0
            out[1:][~often[:-1]] = 0
        return out

    def asks(self, level: int) -> tuple[np.ndarray, list[np.ndarray]]:
        """Of level 1 the n-grams of one and two words, of level k those of k + 1 words: the distinct ones, and those at each word."""
        own = [self.grams(1), self.grams(2)] if level == 1 else [self.grams(level + 1)]
        every = np.concatenate([g[g > 0] for g in own])
        return (np.append(_EMPTY, every) if level == 1 else every), own

    def learn(self, level: int, answers: pa.Table) -> None:
        """Join the totals of a level, which come in the order of its distinct n-grams, to the n-grams at each word."""
        own = answers.filter(pc.equal(answers.column("level"), level))
        told, n = own.column("totals").to_pylist(), own.column("n").to_pylist()
        rising = np.argsort(np.array(own.column("part").to_pylist(), np.int64)).tolist()
        total = np.concatenate([unpack_counts(told[i], n[i]) for i in rising]) if rising else np.zeros(0, np.int64)
        if level == 1:
            self.total, total = float(total[0]), total[1:]
        at = self.asks(level)[1]
        every = np.concatenate(at)
        order = np.argsort(every)
        ranked = every[order]
        fresh = np.append(True, ranked[1:] != ranked[:-1])[: len(ranked)]
        none = int(len(ranked) and ranked[0] == 0)
        which = np.cumsum(fresh) - 1 - none  # the n-th distinct n-gram; -1: no n-gram
        dealt = np.zeros(len(every))
        some = which >= 0
        dealt[order[some]] = total[which[some]]
        self.counts += np.split(dealt, len(at))


def _levels(order: int) -> range:
    return range(1, max(1, order - 1) + 1)


def _ask(parts: int, min_count: int):
    def run(table: pa.Table) -> pa.Table:
        chunk = Chunk(table, min_count)
        asked = chunk.asks(1)[0]
        value, count = np.unique(asked, return_counts=True)
        count[0] = len(chunk.word)
        return _asked(table.column("chunk")[0].as_py(), value, count, parts)

    return run


def _ask_longer(level: int, parts: int, min_count: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return _asked(0, np.zeros(0, np.uint64), np.zeros(0, np.int64), parts)
        chunk = Chunk(texts, min_count)
        for known in range(1, level):
            chunk.learn(known, answers)
        value, count = np.unique(chunk.asks(level)[0], return_counts=True)
        return _asked(texts.column("chunk")[0].as_py(), value, count, parts)

    return run


def summed(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The count table of one range of hashes: its n-grams, their totals, and the place of each asked n-gram in it."""
    sizes = np.array(table.column("n").to_pylist(), np.int64)
    value = np.concatenate([unpack(x, n) for x, n in zip(table.column("hashes").to_pylist(), sizes.tolist(), strict=True)])
    count = np.concatenate([unpack_counts(x, n) for x, n in zip(table.column("counts").to_pylist(), sizes.tolist(), strict=True)])
    order = np.argsort(value)
    ranked = value[order]
    begin = np.flatnonzero(np.append(True, ranked[1:] != ranked[:-1]))
    place = np.empty(len(value), np.int32)
    place[order] = np.repeat(np.arange(len(begin), dtype=np.int32), np.diff(np.append(begin, len(value))))
    return ranked[begin], np.add.reduceat(count[order], begin), place, sizes


def _answer(level: int):
    def run(table: pa.Table) -> pa.Table:
        _, total, place, sizes = summed(table)
        ends = np.cumsum(sizes)
        back = [pack_counts(total[place[z - n : z]]) for z, n in zip(ends.tolist(), sizes.tolist(), strict=True)]
        return pa.table({"chunk": table.column("chunk"), "level": pa.array([level] * len(sizes), pa.int32()), "part": table.column("part"), "n": table.column("n"), "totals": pa.array(back, pa.binary())})

    return run


def _counted(table: pa.Table) -> pa.Table:
    value, total, _, _ = summed(table)
    return pa.table({"gram": pa.array(value.astype(np.int64)), "count": pa.array(total)})


SCORES = "doc_id long, n_tokens long, log_score double, mean_log_score double"


def _score(order: int, backoff: float, min_count: int):
    def run(texts: pa.Table, answers: pa.Table) -> pa.Table:
        if not texts.num_rows:
            return pa.table({c.split()[0]: pa.array([], t) for c, t in zip(SCORES.split(", "), (pa.int64(), pa.int64(), pa.float64(), pa.float64()), strict=True)})
        chunk = Chunk(texts, min_count)
        for level in _levels(order):
            chunk.learn(level, answers)
        word, doc, per, count = chunk.word, chunk.doc, chunk.per, [np.full(len(chunk.word), chunk.total), *chunk.counts]
        log = np.log(count[1] / count[0]) if len(word) else np.zeros(0)
        place = np.arange(len(word)) - np.repeat(np.cumsum(per) - per, per)
        for n in range(2, order + 1):  # from short contexts to long ones
            inside = place >= n - 1
            context = np.append(0.0, count[n - 1][:-1])[: len(word)]
            shorter = log + np.where(inside, np.log(backoff), 0.0)
            log = np.where(inside & (count[n] >= min_count), np.log(np.maximum(count[n], 1)) - np.log(np.maximum(context, 1)), shorter)
        score = np.bincount(doc, log, minlength=len(per)) if len(word) else np.zeros(len(per))
        mean = np.where(per > 0, score / np.maximum(per, 1), np.nan)
        return pa.table({"doc_id": texts.column("doc_id"), "n_tokens": pa.array(per.astype(np.int64)), "log_score": pa.array(score), "mean_log_score": pa.array(mean, from_pandas=True)})

    return run


def _dealt(docs: DataFrame, order: int) -> tuple[DataFrame, int]:
    """Documents by chunk, and the number of parts of the count table."""
    small_batches(docs.sparkSession)
    size = docs.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    body = F.coalesce(F.col("text"), F.lit(""))
    chunk = F.pmod(F.xxhash64("doc_id", body), F.lit(max(1, -(-size // CHUNK_BYTES)))).cast("long")
    return docs.select("doc_id", body.alias("text"), chunk.alias("chunk")), max(8, -(-size * order // (6 * PART_GRAMS)))


def ngram_counts(docs: DataFrame) -> DataFrame:
    """(gram, count) of all n-grams of one and two words by their hashes; 1 is the n-gram of no words, counted at each word."""
    dealt, parts = _dealt(docs, 2)
    return dealt.groupBy("chunk").applyInArrow(_ask(parts, MIN_COUNT), ASKED).groupBy("part").applyInArrow(_counted, "gram long, count long")


def lm_scores(docs: DataFrame, order: int = ORDER, backoff: float = BACKOFF, min_count: int = MIN_COUNT) -> DataFrame:
    """(doc_id, n_tokens, log_score, mean_log_score) of every row."""
    dealt, parts = _dealt(docs, order)
    answers = None
    for level in _levels(order):
        if level == 1:
            asked = dealt.groupBy("chunk").applyInArrow(_ask(parts, min_count), ASKED)
        else:
            asked = dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_ask_longer(level, parts, min_count), ASKED)
        told = asked.groupBy("part").applyInArrow(_answer(level), ANSWERS)
        answers = told if answers is None else answers.unionByName(told)
    return dealt.groupBy("chunk").cogroup(answers.groupBy("chunk")).applyInArrow(_score(order, backoff, min_count), SCORES)


def op1_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    scored = lm_scores(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    return scored.select("doc_id", "n_tokens", F.round("mean_log_score", 6).alias("score"), F.round("log_score", 4).alias("log_sum"))


OP1_SQL = r"""
WITH w AS (SELECT doc_id, unnest(l) AS w, generate_subscripts(l, 1) AS i
           FROM (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS l FROM documents)),
     g AS (SELECT doc_id, i, w, lag(w) OVER d AS w1, lag(w, 2) OVER d AS w2 FROM w WINDOW d AS (PARTITION BY doc_id ORDER BY i)),
     c1 AS (SELECT w, count(*) AS c FROM w GROUP BY w),
     c2 AS (SELECT w1, w, count(*) AS c FROM g WHERE w1 IS NOT NULL GROUP BY w1, w),
     c3 AS (SELECT w2, w1, w, count(*) AS c FROM g WHERE w2 IS NOT NULL GROUP BY w2, w1, w),
     n AS (SELECT count(*) AS n FROM w),
     s AS (SELECT g.doc_id,
                  CASE WHEN c3.c >= 2 THEN ln(c3.c) - ln(x2.c)
                       WHEN c2.c >= 2 THEN CASE WHEN g.w2 IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(c2.c) - ln(x1.c)
                       ELSE CASE WHEN g.w2 IS NOT NULL THEN ln(0.4) ELSE 0 END + CASE WHEN g.w1 IS NOT NULL THEN ln(0.4) ELSE 0 END + ln(c1.c / n.n) END AS l
           FROM g CROSS JOIN n JOIN c1 ON c1.w = g.w
           LEFT JOIN c2 ON c2.w1 = g.w1 AND c2.w = g.w LEFT JOIN c1 x1 ON x1.w = g.w1
           LEFT JOIN c3 ON c3.w2 = g.w2 AND c3.w1 = g.w1 AND c3.w = g.w LEFT JOIN c2 x2 ON x2.w1 = g.w2 AND x2.w = g.w1)
SELECT d.doc_id, coalesce(t.n, 0)::BIGINT AS n_tokens, round(t.l / t.n, 6) AS score, round(coalesce(t.l, 0), 4) AS log_sum
FROM documents d LEFT JOIN (SELECT doc_id, count(*) AS n, sum(l) AS l FROM s GROUP BY doc_id) t USING (doc_id)
"""
