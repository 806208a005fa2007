"""Matching of arriving sources against fixed targets."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from lumenfold.config import MatchConfig
from lumenfold.operators import vector


def match_stream(spark: SparkSession, sources: DataFrame, targets: DataFrame, out: str, checkpoint: str, cfg: MatchConfig = MatchConfig()):
    """Starts a query that matches each micro-batch of sources (source_id, vector, complete per source) and appends to Parquet at out.

    A source's maximum and ranks need its own pairs alone, so a batch is matched by itself. A batch
    that is repeated after a failure replaces what it wrote before.
    """

    def one(batch: DataFrame, number: int) -> None:
        vector.match(batch, targets, cfg).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return sources.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
