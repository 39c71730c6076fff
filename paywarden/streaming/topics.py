"""Decision, alert and feedback topics as streams of JSON texts."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- fixed values: topic names ------------------------------------------------------------------
SCORED, ALERTS, FEEDBACK, AUDIT = "transactions.scored", "fraud.alerts", "analyst.feedback", "audit.logs"
# -------------------------------------------------------------------------------------------------
CORRUPT = "_unreadable"


def read_topic(spark: SparkSession, topic: str, *, folder: str | None = None,
               kafka: Mapping[str, str] | None = None) -> DataFrame:
    """(key, value) texts of a topic: a folder of JSON-line files per topic, or Kafka options."""
    if kafka:
        raw = spark.readStream.format("kafka").options(**kafka).option("subscribe", topic).load()
        return raw.select(F.col("key").cast("string").alias("key"), F.col("value").cast("string").alias("value"))
    return spark.readStream.format("text").load(f"{folder}/{topic}").select(F.lit(None).cast("string").alias("key"), "value")


def parse(raw: DataFrame, schema: T.StructType, name: str = "topic") -> DataFrame:
    """Readable messages as columns. Unreadable ones are dropped and counted: the metric `name` of the
    query's progress holds `read` and `unreadable`."""
    wide = T.StructType([*schema.fields, T.StructField(CORRUPT, T.StringType())])
    parsed = raw.select(F.from_json("value", wide, {"columnNameOfCorruptRecord": CORRUPT}).alias("m"))
    bad = F.col("m").isNull() | F.col(f"m.{CORRUPT}").isNotNull()
    counted = parsed.observe(name, F.count("*").alias("read"), F.count_if(bad).alias("unreadable"))
    return counted.filter(~bad).select(*[F.col(f"m.{f.name}").alias(f.name) for f in schema.fields])


def as_messages(events: DataFrame, key: str) -> DataFrame:
    """(key, value) rows of events; the key keeps a user's events in order."""
    return events.select(F.col(key).alias("key"), F.to_json(F.struct("*")).alias("value"))


def write_topic(batch: DataFrame, topic: str, *, folder: str | None = None, kafka: Mapping[str, str] | None = None) -> None:
    if kafka:
        batch.select("key", "value").write.format("kafka").options(**kafka).option("topic", topic).save()
    else:
        batch.select("value").write.mode("append").text(f"{folder}/{topic}")
