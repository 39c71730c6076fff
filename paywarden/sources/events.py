"""Decision events: building, flattening and appending them."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.schema import TRANSACTION

REASON_LENGTH = 255      # fixed value


def to_events(decided: DataFrame, features: list[str]) -> DataFrame:
    """Nested decision events from decided rows that still carry their transaction columns."""
    tx = [F.col(f.name).cast(f.dataType).alias(f.name) if f.name in decided.columns
          else F.lit(None).cast(f.dataType).alias(f.name) for f in TRANSACTION.fields]
    pairs = F.map_from_arrays(F.array(*[F.lit(n) for n in features]),
                              F.array(*[F.round(F.col(n).cast("double"), 5) for n in features]))
    decision = F.struct("action", "risk_level", "reason", "rules_triggered", "fraud_probability",
                        "is_fraud_predicted", "threshold", "model_version", "latency_ms", "degraded")
    return decided.select(F.col("transaction_id").alias("event_id"), "scored_at", F.struct(*tx).alias("transaction"),
                          decision.alias("decision"), pairs.alias("features"))


def event_to_fact(events: DataFrame) -> DataFrame:
    """Flat fact rows of nested events; the reason is cut to its column length."""
    t, d = "transaction.", "decision."
    columns = {
        "transaction_id": t + "transaction_id", "tx_time": t + "timestamp", "scored_at": "scored_at",
        "user_id": t + "user_id", "channel": t + "channel", "operator": t + "operator", "tx_type": t + "tx_type",
        "access_channel": t + "access_channel", "amount": t + "amount", "currency": t + "currency",
        "amount_usd": t + "amount_usd", "province": t + "location_province", "device_id": t + "device_id",
        "counterparty_id": t + "counterparty_id", "agent_id": t + "agent_id", "merchant_id": t + "merchant_id",
        "fraud_probability": d + "fraud_probability", "risk_level": d + "risk_level", "action": d + "action",
        "reason": d + "reason", "rules_triggered": d + "rules_triggered", "model_version": d + "model_version",
        "latency_ms": d + "latency_ms", "degraded": d + "degraded"}
    rest = [c for c in ("explanation", "features") if c in events.columns]
    flat = events.select(*[F.col(path).alias(name) for name, path in columns.items()], *rest)
    return flat.withColumn("reason", F.substring("reason", 1, REASON_LENGTH))


def new_rows(batch: DataFrame, table: DataFrame, arrival: str) -> DataFrame:
    """Rows of a batch to append: per transaction the last arrival, without those already in the table."""
    columns = [c for c in batch.columns if c != arrival]
    last = batch.groupBy("transaction_id").agg(F.max_by(F.struct(*columns), F.col(arrival)).alias("r")).select("r.*")
    return last.join(table.select("transaction_id", "tx_time"), ["transaction_id", "tx_time"], "left_anti")


def alerts_of(decisions: DataFrame) -> DataFrame:
    """The decisions that also go to the alert topic."""
    return decisions.filter(F.col("action") != "APPROVE")
