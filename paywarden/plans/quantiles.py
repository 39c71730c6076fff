"""Exact quantiles (linear between neighbours) without holding a group's values in one task."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise


def value_counts(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    return df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("n"))


def pick(value: Column, upto: Column, total: Column, q: float) -> Column:
    """Aggregate over distinct values with cumulative counts: the q-quantile."""
    rank = (total - 1) * F.lit(q)
    low, high = F.floor(rank), F.ceil(rank)
    at = lambda r: F.min(F.when(upto > r, value))
    part = F.max(rank - low)
    return at(low) + (at(high) - at(low)) * part


def exact_quantiles(df: DataFrame, value: str, probs: dict[str, float], by: Sequence[str] = (),
                    policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """One row per group with a column per quantile in `probs` ({name: probability})."""
    by = list(by)
    counts = materialise(value_counts(df, value, by), "value-counts")      # read by the probe and twice more
    upto = running(counts, by, [value], sums={"upto": F.col("n")}, inclusive=True, policy=policy)
    totals = counts.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(F.sum("n").alias("total"))
    if by:
        ranked = upto.join(totals, [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by])
    else:
        ranked = upto.withColumn("total", totals.scalar())
    return ranked.groupBy(*by).agg(
        *[pick(F.col(value), F.col("upto"), F.col("total"), q).alias(name) for name, q in probs.items()])
