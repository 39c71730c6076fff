"""Scores made honest: isotonic calibration, and what every threshold costs and saves.

Both first collapse to one row per distinct score. Rows without score or label are left out.
"""
from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.features import CENTS
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise

BLOCK = "lo double, hi double, n long, pos long"
LIMIT = 200_000                     # blocks the driver takes


def pool(blocks: Iterable[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Neighbours are pooled until the rate rises from block to block. Blocks come in order of score; pooling what
    is already pooled in parts gives the same as pooling everything at once. Rates are compared exactly."""
    stack: list[tuple[float, float, int, int]] = []
    for lo, hi, n, pos in blocks:
        while stack and stack[-1][3] * n >= pos * stack[-1][2]:
            low, _, m, p = stack.pop()
            lo, n, pos = low, n + m, pos + p
        stack.append((lo, hi, n, pos))
    return stack


def pooled(blocks: DataFrame, ranges: int | None = None) -> DataFrame:
    """One pass: every range of scores is pooled by a task, which holds the blocks that are left."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for b in batches for r in zip(*[c.to_pylist() for c in b.columns]))
        left = pool(rows)
        if left:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*left), (pa.float64(), pa.float64(), pa.int64(), pa.int64()))],
                                             names=["lo", "hi", "n", "pos"])

    dealt = blocks.repartitionByRange(ranges, "lo") if ranges else blocks.repartitionByRange("lo")
    return dealt.sortWithinPartitions("lo").mapInArrow(run, BLOCK)


def isotonic(df: DataFrame, score: str = "score", label: str = "label", *, ranges: int | None = None, limit: int = LIMIT) -> DataFrame:
    """(lo, hi, n, pos, rate): the non-decreasing step function nearest to the labels by least squares.

    Scores of a block run from `lo` to `hi`; its rate is pos / n. Counts are grouped by distinct score, pooled
    per range of scores, and pooled again over the ranges' borders on the driver, which only receives blocks.
    While there are more than `limit` of them they are pooled again over half as many ranges, in the end by one
    task that streams over them. An empty table has no blocks; -0.0 is 0.0.
    """
    s = F.col(score).cast("double")
    points = (df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull())
              .groupBy((s + 0.0).alias("lo")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
              .select("lo", F.col("lo").alias("hi"), "n", "pos"))
    blocks = materialise(pooled(points, ranges), "isotonic")
    parts = ranges or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    while parts > 1 and blocks.limit(limit + 1).count() > limit:
        parts = -(-parts // 2)
        blocks = materialise(pooled(blocks, parts), "isotonic")
    if parts > 1:
        rows = [tuple(r) for r in blocks.collect()]
        blocks = df.sparkSession.createDataFrame(pool(sorted(rows)), BLOCK)
    return blocks.withColumn("rate", F.col("pos") / F.col("n"))


def calibrated(df: DataFrame, blocks: DataFrame, score: str = "score", out: str = "probability") -> DataFrame:
    """Add the rate of the last block that begins at or below the score (below all: of the first). Unknown scores,
    and any score where there are no blocks, get null. The blocks (LIMIT at most) go to every worker."""
    rows = sorted(tuple(r) for r in blocks.select("lo", "rate").limit(LIMIT + 1).collect())
    if len(rows) > LIMIT:
        raise ValueError(f"more than {LIMIT} blocks")
    starts, rates = np.array([r[0] for r in rows]), np.array([r[1] for r in rows])
    shared = df.sparkSession.sparkContext.broadcast((starts, rates))

    @F.pandas_udf("double")
    def look_up(s: pd.Series) -> pd.Series:
        starts, rates = shared.value
        if not len(starts):
            return pd.Series(np.nan, index=s.index)
        at = np.clip(np.searchsorted(starts, s.to_numpy(float), "right") - 1, 0, None)
        return pd.Series(np.where(s.notna(), rates[at], np.nan), index=s.index)

    return df.withColumn(out, F.nanvl(look_up(F.col(score).cast("double")), F.lit(None).cast("double")))


def avoidance_curve(df: DataFrame, score: str = "score", label: str = "label", amount: str = "amount_usd", user: str = "user_id",
                    policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per distinct score taken as threshold (what scores that or more is stopped): the fraud amount it
    avoids, and the users disturbed although honest, per 10 000 users with honest rows.

    A user is disturbed from the largest score of their honest rows downwards, so each counts once: the curve
    is a running count over largest scores, without a set of users.
    """
    s = F.col(score).cast("double") + 0.0
    rows = df.filter(s.isNotNull() & ~F.isnan(s) & F.col(label).isNotNull()).select(
        s.alias("threshold"), (F.col(label) == 1).alias("fraud"), F.col(user).alias("who"),
        F.coalesce(F.round(F.col(amount) * CENTS).cast("long"), F.lit(0).cast("long")).alias("cents"))
    money = rows.groupBy("threshold").agg(F.sum(F.when(F.col("fraud"), F.col("cents")).otherwise(0)).alias("cents"),
                                          F.count_if("fraud").alias("frauds"), F.lit(0).cast("long").alias("users"))
    worst = (rows.filter(~F.col("fraud")).groupBy("who").agg(F.max("threshold").alias("threshold")).groupBy("threshold")
             .agg(F.lit(0).cast("long").alias("cents"), F.lit(0).cast("long").alias("frauds"), F.count("*").alias("users")))
    steps = materialise(money.unionByName(worst).groupBy("threshold").agg(*[F.sum(c).alias(c) for c in ("cents", "frauds", "users")])
                        .withColumn("down", -F.col("threshold")), "curve")
    total = steps.agg(F.sum("cents").alias("all_cents"), F.sum("users").alias("all_users"))
    upto = running(steps, [], ["down"], inclusive=True, policy=policy,
                   sums={"avoided": F.col("cents"), "caught": F.col("frauds"), "disturbed": F.col("users")})
    return upto.crossJoin(F.broadcast(total)).select(
        "threshold", (F.col("avoided") / CENTS).alias("avoided_usd"), F.try_divide("avoided", "all_cents").alias("avoided_share"),
        "caught", "disturbed", (10_000 * F.try_divide("disturbed", "all_users")).alias("disturbed_per_10000"))


def net_value(curve: DataFrame, per_user_usd: float) -> Column:
    """What a threshold is worth if disturbing a user costs so much."""
    return curve["avoided_usd"] - per_user_usd * curve["disturbed"]
