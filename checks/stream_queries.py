"""Queries that run a stream over the given tables, file by file, and return what it wrote."""
from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks.feature_queries import _select, feats_sql, rounded
from checks.scored import fact, scored_sql
from checks.tables import profiles, transactions
from paywarden.operators import features as ft
from paywarden.session import materialise, stage_folder
from paywarden.streaming.alerts import evaluations, sustained_stream
from paywarden.streaming.online import online_features

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = "2024-01-01 00:00:00"
SPANS = 3


def _folder(spark: SparkSession, name: str) -> str:
    return f"{stage_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def streamed(df: DataFrame, order: str, name: str, transform: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """What a stream writes whose input comes in SPANS equal spans of `order`. Each span is one micro-batch,
    and each is handled by a query of its own that goes on from the stored state of the one before."""
    spark = df.sparkSession
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    rows = materialise(df.withColumn("__us", F.unix_micros(F.col(order).cast("timestamp"))), name)
    low, high = rows.agg(F.min("__us"), F.max("__us")).first()
    source, out = _folder(spark, f"{name}-in"), _folder(spark, f"{name}-out")
    for i in range(SPANS):
        span = F.floor((F.col("__us") - F.lit(low)) * SPANS / F.lit(max(1, (high or 0) - (low or 0) + 1)))
        rows.filter(span == i).drop("__us").write.mode("append").parquet(source)
        done = transform(spark.readStream.schema(df.schema).parquet(source))
        query = (done.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-progress")
                 .trigger(availableNow=True).start())
        query.awaitTermination()
    return spark.read.schema(done.schema).parquet(out)


def f6_online(spark, d):
    users = profiles(spark, d)
    done = streamed(transactions(spark, d).select(*ft.INPUT_COLUMNS), "timestamp", "online",
                    lambda tx: online_features(tx, users, START, precise=True))
    return done.select("transaction_id", "user_id", "known_user", *rounded(done, ft.FEATURE_NAMES))


F6_ONLINE_SQL = feats_sql(f"SELECT transaction_id, user_id, known_user, {_select(ft.FEATURE_NAMES)} FROM feats")


def w2_sustained(spark, d):
    """Alert rate per operator over six hours, every hour, above 85 % for two hours; one row in ten comes
    two hours late."""
    late = F.when(F.col("event_id") % 10 == 0, F.expr("scored_at + INTERVAL 2 HOURS")).otherwise(F.col("scored_at"))
    rows = fact(spark, d).select("event_id", F.col("scored_at").cast("timestamp").alias("scored_at"), "operator", "action")

    def rule(stream: DataFrame) -> DataFrame:
        series = evaluations(stream.withWatermark("scored_at", "3 hours"), "scored_at", "6 hours", "1 hour", ["operator"],
                             alerts=F.count_if(F.col("action") != "APPROVE"), n=F.count("*"))
        found = sustained_stream(series, F.col("alerts") > 0.85 * F.col("n"), 120, 60, ["operator"])
        return found.select("operator", "state", F.unix_micros("at").alias("at_us"))

    return streamed(rows.withColumn("arrival", late), "arrival", "decisions", rule)


W2_SUSTAINED_SQL = scored_sql("""
SELECT operator, 'pending' AS state, us AS at_us FROM runs WHERE begins
UNION ALL SELECT operator, 'firing', us FROM runs WHERE us - since = 2 * 3600000000
UNION ALL SELECT operator, 'resolved', us + 3600000000 FROM runs WHERE ends AND us - since >= 2 * 3600000000 AND us + 3600000000 <= (SELECT w FROM wm)
""", more="""
wm AS (SELECT max(epoch_us(scored_at)) - 3 * 3600000000 AS w FROM scored),
hits AS (SELECT operator, action, (epoch_us(scored_at) // 3600000000 + unnest(range(1, 7))) * 3600000000 AS us FROM scored),
evals AS (SELECT operator, us, count(*) FILTER (WHERE action <> 'APPROVE') AS alerts, count(*) AS n FROM hits
          WHERE us <= (SELECT w FROM wm) GROUP BY operator, us),
held AS (SELECT operator, us, coalesce(us - lag(us) OVER o <> 3600000000, true) AS begins,
                coalesce(lead(us) OVER o - us <> 3600000000, true) AS ends
         FROM evals WHERE alerts > 0.85e0 * n WINDOW o AS (PARTITION BY operator ORDER BY us)),
runs AS (SELECT *, max(CASE WHEN begins THEN us END) OVER (PARTITION BY operator ORDER BY us) AS since FROM held)
""".strip())


def build() -> dict:
    return {"f6_online_features": (f6_online, F6_ONLINE_SQL), "w2_sustained_stream": (w2_sustained, W2_SUSTAINED_SQL)}
