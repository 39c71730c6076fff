"""Micro-batch consumers. Offsets are committed after the handler returns, so a failed batch runs
again; every handler is written to be repeatable."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from paywarden.operators.snapshots import incremental_features
from paywarden.sources.events import alerts_of, event_to_fact, new_rows
from paywarden.sources.tables import _exists, append_fact
from paywarden.streaming import topics

WATERMARK = "7 days"


def run_stream(source: DataFrame, handler: Callable[[DataFrame, int], None], checkpoint: str, *,
               once: bool = False, every: str = "10 seconds") -> StreamingQuery:
    """Start a consumer. `once` handles what is there and stops."""
    writer = source.writeStream.foreachBatch(handler).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)
    return writer.start()


def _weeks(batch: DataFrame) -> list:
    """Weeks a batch touches; a handful, since a batch spans minutes."""
    return [r.w for r in batch.select(F.to_date(F.date_trunc("week", "tx_time")).alias("w")).distinct().collect()]


def persist_scored(path: str) -> Callable[[DataFrame, int], None]:
    """Append decision events to the fact table once, however often a batch is repeated. Only the
    table's partitions of the batch's weeks are read."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        rows = event_to_fact(batch).withColumn("__arrival", F.col("scored_at"))
        if _exists(spark, path):
            table = spark.read.parquet(path).filter(F.col("event_week").isin(_weeks(rows))).select("transaction_id", "tx_time")
        else:
            table = rows.select("transaction_id", "tx_time").limit(0)
        append_fact(new_rows(rows, table, "__arrival"), path)
    return handle


def publish(folder: str) -> Callable[[DataFrame, int], None]:
    """Every decision event to the scored topic, alerts also to the alert topic."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        batch.persist()
        try:
            alerts = batch.filter(F.col("decision.action") != "APPROVE")
            topics.write_topic(topics.as_messages(batch, "transaction.user_id"), topics.SCORED, folder=folder)
            topics.write_topic(topics.as_messages(alerts, "transaction.user_id"), topics.ALERTS, folder=folder)
        finally:
            batch.unpersist()
    return handle


def score_batches(history: Callable[[SparkSession], DataFrame], users: Callable[[SparkSession], DataFrame], period_start: str,
                  score: Callable[[DataFrame], DataFrame], sink: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
    """Score transactions as they come: features from the stored history and the batch, then `score`,
    then `sink`. Rows of one user in the same batch see each other as successful."""
    def handle(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        fresh = batch.dropDuplicates(["transaction_id"])
        sink(score(incremental_features(fresh, history(spark), users(spark), period_start)), batch_id)
    return handle


def unique_alerts(decisions: DataFrame, ts: str = "scored_at", watermark: str = WATERMARK) -> DataFrame:
    """Alert stream without replays."""
    return alerts_of(decisions).withWatermark(ts, watermark).dropDuplicatesWithinWatermark(["transaction_id"])
