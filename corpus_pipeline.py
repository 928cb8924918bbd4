"""Corpus pipeline: quality classifier, n-gram Jaccard join, benchmark decontamination, mixing, sharding.

Each stage is written to the shared folder as Parquet and read again before the next one. All but the last return the
columns of ``documents``: the classifier drops what it rejects, the join keeps one document of each group (the one
with the least doc_id), decontamination drops documents that hold a benchmark item, mixing repeats or leaves out
documents so that sources come near their targets, and sharding adds each row's shard and slot.

Stages decide per row: the join, decontamination, mixing and sharding give every row a key of its own first, so rows that share
a doc_id or have none are judged one by one. The key is the row's place in its Parquet files; only of what is not read from such
files a copy is written. Stages work on keys and what they need of the rows, and whole rows are joined once, at the end.

Defined cases, for every stage: a null or repeated doc_id is no reason to lose or keep a row; repeated rows are copies of each
other (one stays in the join) and rows like any other elsewhere; null and empty texts get the classifier's score of an empty
text, have no copies and hold nothing, are never taken by the mix (they have no words), and are one group in sharding; very long
texts are read whole; an empty table gives an empty result; extra columns go through all stages as they are, also where an operator
has a column of that name (only ``shard`` and ``slot`` of the last stage replace columns of these names); names that begin with
``_`` and are not those of ``documents`` are reserved for the stages.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinfold.llm import decontaminate, mixing, ngram_join, quality, sharding
from kinfold.llm._store import free, stored


def _numbered(docs: DataFrame, name: str) -> DataFrame:
    """The rows with a key of their own, ``_nr``, that stays the same: (file, by name; row of the file)."""
    free(docs.sparkSession)  # what the stage before has left
    if docs._jdf.queryExecution().analyzed().getClass().getSimpleName() == "LogicalRelation":  # files as they are: no row left out or repeated
        try:
            placed = docs.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
            files = [r[1] for r in sorted(placed.select("_file", F.xxhash64("_file")).distinct().collect())]  # a row per file
            if len(set(files)) == len(files):
                at = F.array_position(F.lit(files).cast("array<long>"), F.xxhash64("_file"))  # 8 bytes a file in the plan, no join
                return placed.select(*docs.columns, (F.shiftleft(at, 40) + F.col("_row")).alias("_nr"))
        except AnalysisException:  # not Parquet
            pass
    return stored(docs.withColumn("_nr", F.monotonically_increasing_id()), name)


def _without(docs: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not in ``gone``, sent to all tasks where it has few rows."""
    few = gone.count() <= ngram_join.BROADCAST_ROWS
    return docs.join(F.broadcast(gone) if few else gone, "_nr", "left_anti").drop("_nr")


def stage_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 4: documents whose score is under the threshold go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    scored = quality.score(docs, *quality.train(docs, labels), out="_score")
    return scored.where(F.col("_score") >= quality.THRESHOLD).select(*docs.columns)


def stage_ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 10: of each component one row of the least doc_id stays (a null one last); so do all without shingles."""
    docs = _numbered(docs, "pipeline-join-rows")
    found = ngram_join.near_duplicates(docs.select(F.col("_nr").alias("doc_id"), "text")).where("n_shingles > 0")
    ranked = found.select(F.col("doc_id").alias("_nr"), "component_id").join(docs.select("_nr", "doc_id"), "_nr")
    ranked = stored(ranked.withColumn("_rank", F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("_nr"))), "pipeline-ranks")
    first = ranked.groupBy("component_id").agg(F.min("_rank").alias("_first"))
    gone = stored(ranked.join(first, "component_id").where(F.col("_nr") != F.col("_first._nr")).select("_nr"), "pipeline-copies")
    return _without(docs, gone)


def stage_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 8: rows that hold a benchmark item go."""
    docs = _numbered(docs, "pipeline-leak-rows")
    held = decontaminate.contaminated(docs.select(F.col("_nr").alias("doc_id"), "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    gone = stored(held.select(F.col("doc_id").alias("_nr")).distinct(), "pipeline-leaks")
    return _without(docs, gone)


def stage_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 6: every row as often as its words are taken, rounded; so a partly taken one counts from half."""
    docs = _numbered(docs, "pipeline-mix-rows")
    sized = stored(mixing.sizes(docs.select("_nr", "doc_id", "source", "text")).drop("text"), "pipeline-sizes")
    taken = mixing.mix(sized, order=("doc_id", "_nr")).where("taken > 0").select("_nr", F.round(F.col("taken") / F.col("size")).cast("int").alias("_copies"))
    taken = stored(taken.where("_copies > 0"), "pipeline-taken")
    return docs.join(taken, "_nr").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("_copies")))).drop("_nr", "_copies", "_copy")


def stage_sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Operator 7: the documents with their shard and slot."""
    kept = [c for c in docs.columns if c not in ("shard", "slot")]
    docs = _numbered(docs, "pipeline-shard-rows")
    rows = stored(sharding.with_groups(docs.select("_nr", "doc_id", "text")).drop("text"), "pipeline-shard-keys")
    placed = stored(sharding.shard(rows).select("_nr", "shard", "slot"), "pipeline-shards")
    return docs.select(*kept, "_nr").join(placed, "_nr").drop("_nr")


STAGES = [
    ("quality classifier", stage_quality),
    ("n-gram Jaccard join", stage_ngram_join),
    ("benchmark decontamination", stage_decontamination),
    ("mixing sources", stage_mixing),
    ("sharding", stage_sharding),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"stage-{name.replace(' ', '-')}")
    return STAGES[-1][1](spark, docs, sf_dir)


#: The classifier and the differencing of groups can't be put into SQL; tests hold every stage against brute force.
ORACLE_SQL = None
