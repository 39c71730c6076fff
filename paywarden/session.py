"""Session settings the operators rely on."""
from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


# the JVM never compiles methods of more bytecode than this; plans over all features have them, and run
# faster by operator than in one interpreted method
WIDE_PLANS = {"spark.sql.codegen.hugeMethodLimit": "8000"}


def build_session(app: str = "paywarden", master: str | None = None, **conf: str) -> SparkSession:
    """Session with UTC time, AQE and skew-join handling. `master` stays unset on a cluster."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        # call-site capture costs milliseconds per column expression; the plans here have hundreds
        "spark.python.sql.dataFrameDebugging.enabled": "false",
        **WIDE_PLANS,
        **conf,
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def stage_folder(spark: SparkSession) -> str:
    """The cluster's shared checkpoint folder; a temporary one only where none is configured (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
        folder = tempfile.mkdtemp(prefix="paywarden-stage-", dir=os.environ.get("TMPDIR", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write an intermediate table once and read it back.

    Used where a result feeds two branches: the second branch reads files instead of running the
    first again, and a lost executor costs a re-read, not a recomputation.
    """
    spark = df.sparkSession
    path = f"{stage_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
