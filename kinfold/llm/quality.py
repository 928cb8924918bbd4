"""Quality classifier: random-indexing word vectors pooled per document, a two-layer numpy network, temperature.

Words are hashed into ``VOCAB`` entries (a fixed table of 16 MB: words beyond the frequent ones share entries, held-out
figures at several sizes are in the README), each with a sparse ternary index vector. One pass over all documents adds the
index vectors of the words up to ``WINDOW`` places before and after to each word's context vector; the sums of all tasks,
taken to unit length about their mean, are the word vectors. A document is the mean and the spread of its words' vectors,
and nothing else. The network is fitted on the driver on at most ``TRAIN_ROWS`` labelled rows, chosen by hash, and its
temperature on a fifth of them. Labels, lang, source and doc_id are never inputs.

Defined cases: null and empty texts have all features 0 and get the score the network gives these; equal texts get equal
scores; a null doc_id is scored and not held out; a doc_id with contradicting labels is not learned from, and one with
several texts only from one of them (the least by its features); an empty table gives an empty result; without usable labels of
both kinds every score is 1.0 (nothing is rejected); extra columns pass through, clashing names are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm._kernel import _stream, give_back, mix, slices, words
from kinfold.llm._store import free, small_batches, trim

VOCAB, DIMS, NONZERO, WINDOW = 1 << 16, 64, 6, 2
HIDDEN, EPOCHS, RATE, DECAY = 32, 400, 0.01, 1e-4
TRAIN_ROWS = 8000
THRESHOLD = 0.7
POOL_WORDS = 1 << 16
TASK_BYTES = 128 << 20


def index_vectors() -> tuple[np.ndarray, np.ndarray]:
    """The NONZERO places and signs of each of VOCAB sparse ternary vectors, from a hash of (word, j)."""
    h = mix(_stream(101, VOCAB * NONZERO)).reshape(VOCAB, NONZERO)
    return (h % np.uint64(DIMS)).astype(np.int64), np.where((h >> np.uint64(40)) & np.uint64(1), 1, -1).astype(np.int32)


def entries(word: np.ndarray) -> np.ndarray:
    return (word % np.uint64(VOCAB)).astype(np.int64)


def add_contexts(table: np.ndarray, entry: np.ndarray, doc: np.ndarray, index: tuple[np.ndarray, np.ndarray], window: int = WINDOW) -> None:
    """Add to each word's row of ``table`` (VOCAB x DIMS) the index vectors of its neighbours in the same text."""
    place, sign = index
    flat = table.reshape(-1)
    for w in range(1, window + 1):
        same = doc[w:] == doc[:-w]
        left, right = entry[:-w][same], entry[w:][same]
        for j in range(NONZERO):
            np.add.at(flat, left * DIMS + place[right, j], sign[right, j])
            np.add.at(flat, right * DIMS + place[left, j], sign[left, j])


def _contexts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    table, index = np.zeros((VOCAB, DIMS), np.int32), index_vectors()  # of one task: far under 2^31 each
    for _, flat, offs in slices(batches, "text"):
        h, doc, _ = words(flat, offs)
        add_contexts(table, entries(h), doc, index)
    seen = np.flatnonzero(table.any(1))
    for a in range(0, len(seen), VOCAB // 16):
        some = seen[a : a + VOCAB // 16]
        yield pa.RecordBatch.from_arrays([pa.array(some)] + [pa.array(table[some, j]) for j in range(DIMS)], names=["word"] + [f"d{j}" for j in range(DIMS)])


def word_vectors(docs: DataFrame) -> np.ndarray:
    """The context vectors of all words over all documents, unit length about their mean: VOCAB x DIMS on the driver."""
    schema = "word long, " + ", ".join(f"d{j} int" for j in range(DIMS))
    sums = _wide(docs.select("text")).mapInArrow(_contexts, schema).groupBy("word").agg(*[F.sum(f"d{j}").alias(f"d{j}") for j in range(DIMS)])
    return unit(_table(sums.select("word", F.array(*[F.col(f"d{j}").cast("float") for j in range(DIMS)]).alias("v")).toArrow()))


def _wide(docs: DataFrame) -> DataFrame:
    """The same rows in fewer, larger tasks (but two a core at least): each task sends a table of its own, whatever it has read."""
    guess = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return docs.coalesce(max(2 * docs.sparkSession.sparkContext.defaultParallelism, min(-(-guess // TASK_BYTES), 1 << 24)))  # a size that Spark does not know is huge


def _table(rows: pa.Table) -> np.ndarray:
    """VOCAB rows at most."""
    table = np.zeros((VOCAB, DIMS))
    if rows.num_rows:
        table[rows.column("word").to_numpy()] = rows.column("v").combine_chunks().flatten().to_numpy().reshape(-1, DIMS)
    return table


def unit(table: np.ndarray) -> np.ndarray:
    length = np.linalg.norm(table, axis=1, keepdims=True)
    table = table / np.maximum(length, 1e-9)
    used = np.flatnonzero(length[:, 0])
    if len(used):
        mean = table[used].mean(0)
        for a in range(0, len(used), 4096):  # by pieces: the driver has little memory
            some = table[used[a : a + 4096]] - mean
            table[used[a : a + 4096]] = some / np.maximum(np.linalg.norm(some, axis=1, keepdims=True), 1e-9)
    return table.astype(np.float32)


WIDTH = 2 * DIMS


def features(flat: np.ndarray, offs: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Mean and spread of each text's word vectors; pieces are cut at the same places in equal texts, so sums are equal too."""
    h, _, per = words(flat, offs)
    entry, ends = entries(h), np.cumsum(per)
    sums, squares = np.zeros((len(per), DIMS)), np.zeros((len(per), DIMS))
    a = 0
    while a < len(per):
        begin = ends[a] - per[a]
        z = max(a + 1, int(np.searchsorted(ends, begin + POOL_WORDS, "right")))
        some = a + np.flatnonzero(per[a:z])
        for at in range(begin, ends[z - 1], POOL_WORDS):  # one piece, or several of one long text
            v = vectors[entry[at : min(at + POOL_WORDS, ends[z - 1])]].astype(np.float64)
            cut = np.maximum(ends[some] - per[some] - at, 0)
            sums[some] += np.add.reduceat(v, cut, axis=0)
            squares[some] += np.add.reduceat(v * v, cut, axis=0)
        a = z
    n = np.maximum(per, 1)[:, None]
    mean = sums / n
    return np.concatenate([mean, np.sqrt(np.maximum(squares / n - mean**2, 0))], 1).astype(np.float32)


@dataclass
class Network:
    centre: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logit(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.centre) / self.scale, -8, 8)
        return np.tanh(z @ self.w1 + self.b1) @ self.w2 + self.b2

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x) / self.temperature, -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, seed: int = 5) -> Network | None:
    """Full-batch Adam on four fifths, temperature by the least log loss on the rest."""
    if len(set(y.tolist())) < 2:
        return None
    rng = np.random.default_rng(seed)
    held = rng.permutation(len(y)) % 5 == 0
    if len(set(y[~held].tolist())) < 2 or not held.any():
        held[:] = False
    t, s = x[~held].astype(float), y[~held].astype(float)
    centre, scale = t.mean(0), t.std(0)
    scale[scale < 1e-6] = 1.0
    p = [rng.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], HIDDEN)), np.zeros(HIDDEN), rng.normal(0, 1 / np.sqrt(HIDDEN), HIDDEN), np.zeros(1)]
    m, v = [np.zeros_like(a) for a in p], [np.zeros_like(a) for a in p]
    z = np.clip((t - centre) / scale, -8, 8)
    for step in range(1, EPOCHS + 1):
        a = np.tanh(z @ p[0] + p[1])
        e = (1 / (1 + np.exp(-(a @ p[2] + p[3]))) - s) / len(s)
        back = np.outer(e, p[2]) * (1 - a**2)
        grads = [z.T @ back + DECAY * p[0], back.sum(0), a.T @ e + DECAY * p[2], np.array([e.sum()])]
        for i, g in enumerate(grads):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g**2
            p[i] = p[i] - RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    net = Network(centre, scale, p[0], p[1], p[2], float(p[3][0]))
    if held.any():
        logit, truth = net.logit(x[held].astype(float)), y[held]
        loss = lambda k: np.logaddexp(0, np.where(truth == 1, -logit, logit) / k).mean()
        net.temperature = float(min(np.geomspace(0.25, 8, 61), key=loss))
    return net


def _features_of(vectors: np.ndarray):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offs in slices(batches, "text"):
            x = features(flat, offs, vectors)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("quality"), pa.array([r.tobytes() for r in x], pa.binary())], names=["doc_id", "quality", "x"])

    return run


def _scores_of(vectors: np.ndarray, net: Network | None, keep: list[str], out: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, flat, offs in slices(batches, "text"):
            s = net.score(features(flat, offs, vectors)) if net else np.ones(rows.num_rows)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in keep), pa.array(s, pa.float64())], names=[*keep, out])

    return run


def held_out(doc_id) -> F.Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string")), F.lit(4)) == 2, F.lit(False))


def train(docs: DataFrame, labels: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[np.ndarray, Network | None]:
    """Word vectors from all documents, and the network from at most ``train_rows`` labelled rows that aren't held out."""
    small_batches(docs.sparkSession)
    free(docs.sparkSession)  # what was planned before
    vectors = word_vectors(docs)
    trim(docs.sparkSession)
    usable = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    usable = usable.groupBy("doc_id").agg(F.min("quality").alias("quality"), F.max("quality").alias("_most")).where("quality = _most").drop("_most")
    chosen = usable.orderBy(F.xxhash64("doc_id"), "doc_id").limit(train_rows)
    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")  # at most train_rows rows of 12 bytes
    rows = sample.mapInArrow(_features_of(vectors), "doc_id long, quality int, x binary").groupBy("doc_id", "quality").agg(F.min("x").alias("x")).orderBy("doc_id").collect()  # train_rows at most
    give_back()  # the driver's own memory too
    trim(docs.sparkSession)
    if not rows:
        return vectors, None
    return vectors, fit(np.stack([np.frombuffer(r["x"], np.float32) for r in rows]), np.array([r["quality"] for r in rows]))


def score(docs: DataFrame, vectors: np.ndarray, net: Network | None, keep: list[str] | None = None, out: str = "score") -> DataFrame:
    """Add ``out`` to the columns ``keep`` (all but a clashing one)."""
    from pyspark.sql import types as T

    keep = keep or [c for c in docs.columns if c != out]
    schema = T.StructType([f for f in docs.schema.fields if f.name in keep and f.name != out] + [T.StructField(out, T.DoubleType())])
    keep = [f.name for f in schema.fields[:-1]]
    return docs.drop(out).mapInArrow(_scores_of(vectors, net, keep, out), schema)


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    scored = score(docs, *train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")), keep=["doc_id"])
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
