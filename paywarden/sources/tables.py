"""Reading and writing the batch tables."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.functions.ids import canonical_ids
from paywarden.operators.drift import SCORE
from paywarden.schema import HISTORY, USERS


def _read(spark: SparkSession, path: str, schema: T.StructType, fmt: str) -> DataFrame:
    """Fixed schema, never inferred. A missing path is an error when the plan is made."""
    reader = spark.read.schema(schema).format(fmt)
    if fmt == "csv":
        reader = reader.option("header", True).option("mode", "FAILFAST")
    return reader.load(path)


def read_transactions(spark: SparkSession, path: str, fmt: str = "parquet",
                      schema: T.StructType = HISTORY) -> DataFrame:
    """Transaction history with identifiers as canonical text."""
    return canonical_ids(_read(spark, path, schema, fmt))


def read_users(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    return canonical_ids(_read(spark, path, USERS, fmt))


def write_features(df: DataFrame, path: str) -> None:
    """Feature table partitioned by day, so time-range readers skip files."""
    (df.withColumn("event_date", F.to_date("timestamp"))
     .repartition("event_date", F.pmod(F.xxhash64("transaction_id"), F.lit(16)))
     .write.mode("overwrite").partitionBy("event_date").parquet(path))


def read_features(spark: SparkSession, path: str, build=None, rebuild: bool = False) -> DataFrame:
    """The cached feature table; `build()` makes it when absent or when `rebuild` is set."""
    if build is not None and (rebuild or not _exists(spark, path)):
        write_features(build(), path)
    return spark.read.parquet(path)


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def sample_rows(df: DataFrame, n: int, seed: int, key: str = "transaction_id") -> DataFrame:
    """n rows without replacement, the same ones on every run: smallest hashes of (key, seed)."""
    return df.orderBy(F.md5(F.concat(F.col(key), F.lit(f":{seed}"))), key).limit(n)


def reference_sample(df: DataFrame, names: Sequence[str], n: int = 10_000, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """Drift reference: features of training rows, scores of validation rows."""
    features = sample_rows(df.filter("split <= 1"), n, seed).select("transaction_id", *names)
    scores = sample_rows(df.filter("split = 2"), n, seed).select("transaction_id", SCORE)
    return features, scores


def write_reference_sample(df: DataFrame, names: Sequence[str], path: str, n: int = 10_000, seed: int = 42) -> None:
    features, scores = reference_sample(df, names, n, seed)
    features.write.mode("overwrite").parquet(f"{path}/features")
    scores.write.mode("overwrite").parquet(f"{path}/scores")


def export_features_by_split(df: DataFrame, path: str) -> None:
    """Feature matrices and meta columns, one folder per split."""
    df.write.mode("overwrite").partitionBy("split").parquet(path)


def predictions(meta: DataFrame, scores: dict[str, DataFrame], predicted: str, threshold: float,
                key: str = "transaction_id") -> DataFrame:
    """Meta columns, one `score_<model>` column per model and the predicted flag of one model."""
    out = meta
    for name, df in scores.items():
        out = out.join(df.select(key, F.col("score").alias(f"score_{name}")), key, "left")
    return out.withColumn(f"pred_{predicted}", (F.col(f"score_{predicted}") >= threshold).cast("int"))


def write_predictions(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def append_fact(df: DataFrame, path: str) -> None:
    """Append to the fact table, partitioned by the week of the transaction."""
    (df.withColumn("event_week", F.to_date(F.date_trunc("week", "tx_time")))
     .write.mode("append").partitionBy("event_week").parquet(path))
