"""Retrieval over a stream of examples: one row holds a query's nodes, so no state is kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from mooring.config import Config
from mooring.plans.retrieval import retrieve


def retrieve_stream(spark: SparkSession, source: str, sink: str, checkpoint: str, config: Config) -> StreamingQuery:
    """Runs ``retrieve`` on each micro-batch of Parquet examples that arrives in ``source`` and
    appends its results to ``sink``.  Rows of one query must arrive in one file."""
    schema = spark.read.parquet(source).schema

    def write(batch: DataFrame, number: int) -> None:
        retrieve(batch, config).write.mode("overwrite").parquet(f"{sink}/batch={number}")  # a repeated batch replaces itself

    return spark.readStream.schema(schema).parquet(source).writeStream.option("checkpointLocation", checkpoint).foreachBatch(write).trigger(availableNow=True).start()
