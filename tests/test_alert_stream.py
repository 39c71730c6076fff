from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paywarden.operators.monitor import transitions
from paywarden.session import materialise
from paywarden.streaming.alerts import evaluations, sustained_stream

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
T0 = datetime(2024, 3, 1)


def at(minute, second=0):
    return T0 + timedelta(minutes=minute, seconds=second)


def rows():
    """Rule a: high from minute 3 to 12, with a late row that makes minute 7 high as well; then a gap while
    high; then high again at the end. Rule b: never for long. Rule c: high, then nothing more."""
    out = []
    for m in range(0, 16):
        out.append((m, "a", at(m, 5), "BLOCK" if 3 <= m <= 12 and m != 7 else "APPROVE"))
        out.append((m, "b", at(m, 9), "BLOCK" if m % 3 else "APPROVE"))
    out += [(10, "a", at(7, 30), "BLOCK"), (10, "a", at(7, 31), "BLOCK")]              # late by three minutes
    out += [(m, "a", at(m, 1), "BLOCK") for m in range(20, 26)]                         # from 16 to 20 nothing comes
    out += [(m, "a", at(m, 1), "BLOCK") for m in range(30, 33)]
    out += [(m, "c", at(m, 2), "BLOCK") for m in range(2, 9)]
    out += [(m, "b", at(m, 3), "APPROVE") for m in range(16, 60)]                       # goes on, so that time passes
    return sorted(out)


@pytest.mark.parametrize("spans", [1, 4, 12])
def test_transitions_equal_the_batch_with_late_rows_and_gaps(spark, tmp_path, spans):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    schema = "arrival int, rule string, ts timestamp, action string"
    table = materialise(spark.createDataFrame(rows(), schema), "alert-rows")
    source = str(tmp_path / "in")
    measures = {"alerts": F.count_if(F.col("action") != "APPROVE"), "n": F.count("*")}
    high = F.col("alerts") >= 0.5 * F.col("n")
    for i in range(spans):
        table.filter(F.floor(F.col("arrival") * spans / 60) == i).coalesce(1).write.mode("append").parquet(source)
        stream = spark.readStream.schema(schema).parquet(source).withWatermark("ts", "5 minutes")
        found = sustained_stream(evaluations(stream, "ts", "1 minute", "1 minute", ["rule"], **measures), high, 4, 1, ["rule"])
        q = (found.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "c"))
             .trigger(availableNow=True).start())
        q.awaitTermination(120)
        assert q.exception() is None
    got = sorted(map(tuple, spark.read.parquet(str(tmp_path / "out")).select("rule", "state", "at").collect()))
    # what the watermark has passed: the last row less five minutes
    series = (table.groupBy(F.window("ts", "1 minute").alias("w"), "rule").agg(*[c.alias(n) for n, c in measures.items()])
              .select(F.col("w.end").alias("at"), "rule", *measures).filter(F.col("at") <= F.lit(at(59, 3) - timedelta(minutes=5))))
    want = sorted(map(tuple, transitions(series, high, 4, 1, ["rule"]).select("rule", "state", "at").collect()))
    assert got == want
    assert [r for r in got if r[0] == "a" and r[1] != "pending"] == [
        ("a", "firing", at(8)), ("a", "firing", at(25)), ("a", "resolved", at(14)), ("a", "resolved", at(27))]
    assert ("c", "resolved", at(10)) in got and not any(r[0] == "b" and r[1] == "firing" for r in got)


def test_without_keys_and_with_unknown_values(spark):
    series = spark.createDataFrame([(at(m), v) for m, v in enumerate([True, True, None, True, True, True, False])], "at timestamp, high boolean")
    got = sorted((r.state, r.at) for r in transitions(series, F.col("high"), 2).collect())
    assert got == [("firing", at(5)), ("pending", at(0)), ("pending", at(3)), ("resolved", at(6))]
    assert transitions(series.limit(0), F.col("high"), 2).count() == 0
