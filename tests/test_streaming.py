import json

import pytest
from pyspark.sql import functions as F

from checks.flow_queries import _events, _requests
from checks.scored import fact
from checks.tables import profiles, transactions
from paywarden.operators import monitor as mo
from paywarden.operators.cases import run_workflow
from paywarden.operators.features import build_features
from paywarden.schema import DECISION_EVENT, TRANSACTION
from paywarden.session import materialise
from paywarden.streaming import pipeline, state, topics
from tests.conftest import SF

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@pytest.fixture(scope="module")
def events(spark):
    return materialise(_events(spark, SF), "events")


def drain(query):
    query.awaitTermination(120)
    assert query.exception() is None and not query.isActive


def test_topic_to_fact_once_with_unreadable_messages(spark, events, tmp_path):
    folder, table = str(tmp_path / "topics"), str(tmp_path / "fact")
    pipeline.publish(folder)(events, 0)
    pipeline.publish(folder)(events.limit(50), 1)                        # replayed messages
    spark.createDataFrame([("{broken",), ("[1",)], "value string").write.mode("append").text(f"{folder}/{topics.SCORED}")
    counts = []

    def consume(name):
        source = topics.parse(topics.read_topic(spark, topics.SCORED, folder=folder), DECISION_EVENT, "scored")
        query = pipeline.run_stream(source, pipeline.persist_scored(table), str(tmp_path / name), once=True)
        drain(query)
        counts.extend(p.observedMetrics["scored"] for p in query.recentProgress if "scored" in p.observedMetrics)

    consume("first")
    assert sum(c.unreadable for c in counts) == 2
    n = events.count()
    assert spark.read.parquet(table).count() == n
    consume("second")                                                    # a new consumer reads everything again
    stored = spark.read.parquet(table)
    assert stored.count() == n and stored.select("transaction_id").distinct().count() == n
    alerts = spark.read.text(f"{folder}/{topics.ALERTS}")
    assert alerts.select(F.get_json_object("value", "$.event_id")).distinct().count() == stored.filter("action <> 'APPROVE'").count()
    assert json.loads(alerts.first().value)["decision"]["action"] != "APPROVE"


def test_scoring_stream_equals_batch(spark, tmp_path):
    tx, users, start = transactions(spark, SF), profiles(spark, SF), "2024-01-01 00:00:00"
    columns = TRANSACTION.fieldNames()
    rows = materialise(tx.select(*[F.col(c).cast(TRANSACTION[c].dataType).alias(c) for c in columns]), "tx")
    cut = "timestamp >= TIMESTAMP_NTZ '2024-01-25 00:00:00'"
    folder = str(tmp_path / "in")
    rows.filter(cut).write.parquet(folder)
    out = []
    handler = pipeline.score_batches(
        lambda s: rows.filter(f"NOT ({cut})"), lambda s: users, start, lambda f: f,
        lambda f, i: out.extend(f.select("transaction_id", F.round("tx_count_24h", 4), F.round("device_n_users", 4), F.round("agent_n_users_24h", 4)).collect()))
    drain(pipeline.run_stream(spark.readStream.schema(TRANSACTION).parquet(folder), handler, str(tmp_path / "c"), once=True))
    want = build_features(tx, users, start).filter(cut).select("transaction_id", F.round("tx_count_24h", 4), F.round("device_n_users", 4), F.round("agent_n_users_24h", 4)).collect()
    assert sorted(map(tuple, out)) == sorted(map(tuple, want)) and out


def test_blocked_decision_counts_as_failure(spark, tmp_path):
    folder = str(tmp_path / "in")
    rows = [(f"T{i}", "U1", i * 1_000_000, None, 100.0 if i == 0 else 1.0) for i in range(4)]
    rows += [("T9", "U1", 25 * 3600 * 1_000_000, None, 1.0)]
    schema = "transaction_id string, user_id string, ts_us long, status string, amount double"
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = state.decide_with_feedback(spark.readStream.schema(schema).parquet(folder), lambda row, n: "BLOCK" if row["amount"] > 50 else "APPROVE")
    q = out.writeStream.format("memory").queryName("feedback").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    got = {r.transaction_id: (r.failed_count_24h, r.action) for r in spark.table("feedback").collect()}
    assert got == {"T0": (0, "BLOCK"), "T1": (1, "APPROVE"), "T2": (1, "APPROVE"), "T3": (1, "APPROVE"), "T9": (0, "APPROVE")}


def test_case_workflow_stream_equals_batch(spark, tmp_path):
    requests = materialise(_requests(spark, SF), "requests")
    folder = str(tmp_path / "in")
    requests.write.parquet(folder)
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    out = state.case_workflow_stream(spark.readStream.schema(requests.schema).parquet(folder))
    q = out.writeStream.format("memory").queryName("workflow").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    drain(q)
    batch = run_workflow(requests).select("case_id", "seq", "accepted", "reject_reason", "status_after")
    stream = spark.table("workflow").select(*batch.columns)
    assert stream.count() == requests.count() and batch.exceptAll(stream).count() == 0


def test_alert_windows_and_unique_alerts_on_a_stream(spark, tmp_path):
    rows = materialise(fact(spark, SF).select("transaction_id", F.col("scored_at").cast("timestamp").alias("scored_at"), "action"), "fact")
    folder = str(tmp_path / "in")
    rows.unionByName(rows.limit(100)).write.parquet(folder)
    stream = spark.readStream.schema(rows.schema).parquet(folder)
    q = pipeline.unique_alerts(stream, watermark="60 days").writeStream.format("memory").queryName("alerts").option(
        "checkpointLocation", str(tmp_path / "a")).trigger(availableNow=True).start()
    drain(q)
    assert spark.table("alerts").count() == rows.filter("action <> 'APPROVE'").count()
    q = mo.alert_rate(stream.withWatermark("scored_at", "1 hour")).writeStream.outputMode("complete").format("memory").queryName("rate").option(
        "checkpointLocation", str(tmp_path / "b")).trigger(availableNow=True).start()
    drain(q)
    assert spark.table("rate").count() == mo.alert_rate(rows).count()
