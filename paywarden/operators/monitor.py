"""Monitoring rules as windowed queries. Everything but `sustained` also runs on a stream."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.functions.columns import MICROS, epoch_us

# --- fixed values -------------------------------------------------------------------------------
LATENCY_BUCKETS = [0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.2, 0.5, 1.0]
PROVIDER_LATENCY_BUCKETS = [0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.2, 0.5, 1.0]
PROBABILITY_BUCKETS = [0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.5, 0.7, 0.9, 0.99]
P99_LIMIT_S = 0.1
ALERT_RATE_LIMIT = 0.05
# -------------------------------------------------------------------------------------------------


def _upto(value: Column, buckets: Sequence[float]) -> list[Column]:
    """Rows at or below each bucket bound, and all rows."""
    return [F.count_if(value <= b) for b in buckets] + [F.count(value)]


def histogram(df: DataFrame, value: Column, buckets: Sequence[float], by: Sequence[Column] = ()) -> DataFrame:
    """(le, n, share) rows per group: cumulative counts per bound, +Inf last."""
    bounds = [*buckets, float("inf")]
    counts = df.groupBy(*by).agg(F.array(*_upto(value, buckets)).alias("__upto"), F.count(value).alias("__n"))
    rows = F.arrays_zip(F.array(*[F.lit(b) for b in bounds]).alias("le"), F.col("__upto").alias("n"))
    names = [c for c in counts.columns if not c.startswith("__")]
    return counts.select(*names, "__n", F.inline(rows)).withColumn(
        "share", F.try_divide(F.col("n"), F.col("__n"))).drop("__n")


def histogram_quantile(upto: Column, buckets: Sequence[float], q: float) -> Column:
    """Quantile from cumulative bucket counts, linear inside a bucket; beyond the last bound, that bound."""
    total = F.get(upto, F.lit(len(buckets)))
    rank = total * q
    out = F.lit(float(buckets[-1]))
    for i in reversed(range(len(buckets))):
        low = float(buckets[i - 1]) if i else 0.0
        below = F.get(upto, F.lit(i - 1)) if i else F.lit(0)
        here = F.get(upto, F.lit(i))
        inside = low + (float(buckets[i]) - low) * F.coalesce(F.try_divide(rank - below, here - below), F.lit(1.0))
        out = F.when(here >= rank, inside).otherwise(out)
    return F.when(total > 0, out)


def latency_quantiles(df: DataFrame, ts: str, seconds: Column, buckets: Sequence[float] = LATENCY_BUCKETS,
                      size: str = "5 minutes", slide: str = "1 minute", by: Sequence[str] = ()) -> DataFrame:
    """p50, p95, p99 per sliding window from bucket counts, and whether p99 is above its limit."""
    counts = df.groupBy(F.window(ts, size, slide).alias("w"), *by).agg(
        F.array(*_upto(seconds, buckets)).alias("__upto"), F.count("*").alias("n"))
    q = {f"p{int(p * 100)}": histogram_quantile(F.col("__upto"), buckets, p) for p in (0.5, 0.95, 0.99)}
    return counts.select(F.col("w.end").alias("at"), *by, "n", *[c.alias(n) for n, c in q.items()]).withColumn(
        "high", F.col("p99") > P99_LIMIT_S)


def alert_rate(df: DataFrame, ts: str = "scored_at", size: str = "5 minutes", slide: str = "1 minute") -> DataFrame:
    """Share of verified or blocked decisions per sliding window."""
    alerts = F.count_if(F.col("action") != "APPROVE")
    return (df.groupBy(F.window(ts, size, slide).alias("w")).agg(alerts.alias("alerts"), F.count("*").alias("n"))
            .select(F.col("w.end").alias("at"), "alerts", "n", (F.col("alerts") / F.col("n")).alias("rate"))
            .withColumn("high", F.col("rate") > ALERT_RATE_LIMIT))


def windowed_counts(df: DataFrame, ts: str, size: str, conditions: Mapping[str, Column], by: Sequence[str] = (),
                    slide: str | None = None) -> DataFrame:
    """Rows fulfilling each condition per window and key."""
    window = F.window(ts, size, slide) if slide else F.window(ts, size)
    return df.groupBy(window.alias("w"), *by).agg(*[F.count_if(c).alias(n) for n, c in conditions.items()]).select(
        F.col("w.end").alias("at"), *by, *conditions)


def rates(df: DataFrame, ts: str, by: Sequence[str], seconds: int = 60) -> DataFrame:
    """Rows per second and key in tumbling windows."""
    return df.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *by).agg(
        (F.count("*") / seconds).alias("per_second")).select(F.col("w.start").alias("at"), *by, "per_second")


def sustained(series: DataFrame, condition: str, minutes: int, step_minutes: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Add `firing`: the condition held at every evaluation of the last `minutes`, the current one included.

    One row per evaluation time (and key), so the series grows with time, not with traffic.
    """
    rows = series.withColumn("__at", epoch_us("at"))
    span = minutes * 60 * MICROS
    window = Window.partitionBy(*by).orderBy("__at").rangeBetween(-span, 0)
    held = F.sum(F.col(condition).cast("int")).over(window)
    return rows.withColumn("firing", held == minutes // step_minutes + 1).drop("__at")


def transitions(series: DataFrame, condition: Column, minutes: int, step_minutes: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, state, at): when the condition became pending, firing (held for `minutes`) and resolved. An evaluation
    that is missing ends a run. A run that reaches the last evaluation of the series is still open.

    One row per evaluation time (and key), so the series grows with time, not with traffic.
    """
    step, span = step_minutes * 60 * MICROS, minutes * 60 * MICROS
    rows = series.select(*by, epoch_us("at").alias("us"), F.coalesce(condition, F.lit(False)).alias("holds"))
    end = rows.agg(F.max("us").alias("__end"))
    order = Window.partitionBy(*by).orderBy("us")
    runs = (rows.filter("holds").withColumn("begins", F.coalesce(F.col("us") - F.lag("us").over(order) != step, F.lit(True)))
            .withColumn("since", F.last(F.when(F.col("begins"), F.col("us")), ignorenulls=True).over(order))
            .withColumn("ends", F.coalesce(F.lead("us").over(order) - F.col("us") != step, F.lit(True))))
    held = F.col("us") - F.col("since")

    def state(name: str, when: Column, at: Column) -> Column:
        return F.when(when, F.struct(F.lit(name).alias("state"), F.timestamp_micros(at).alias("at")))

    found = F.array(state("pending", F.col("begins"), F.col("us")), state("firing", held == span, F.col("us")),
                    state("resolved", F.col("ends") & (held >= span) & (F.col("us") + step <= F.col("__end")), F.col("us") + step))
    return runs.crossJoin(F.broadcast(end)).select(*by, F.inline(F.array_compact(found)))
