"""Incremental loads: a file-source stream whose batches are upserted into a catalog table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from kinfold.functions.ids import document_id
from kinfold.sources.catalog import Catalog, last_wins
from kinfold.sources.tables import numbered


def upsert_stream(spark: SparkSession, folder: str, schema: T.StructType, catalog: Catalog, table: str, key: str | list[str], checkpoint: str) -> StreamingQuery:
    """Every new Parquet file's rows replace those of equal id; a batch that is run again changes nothing."""

    def upsert(batch: DataFrame, _epoch: int) -> None:
        rows = numbered(batch)
        rows = last_wins(rows.withColumn("_id", document_id(batch, key)))
        catalog.upsert(table, rows.drop("_rowno"))

    return spark.readStream.schema(schema).parquet(folder).writeStream.foreachBatch(upsert).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
