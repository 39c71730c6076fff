"""Drift between a reference and a current distribution: KS, PSI, families, alarm.

All features go through one plan: one row per (feature, distinct value) with its counts on both
sides, running counts per feature, then sums.
"""
from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.features import FEATURE_NAMES
from paywarden.plans.quantiles import pick
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise

# --- fixed values -------------------------------------------------------------------------------
KS_MAX, P_MIN, PSI_MAX = 0.10, 0.01, 0.20
BINS, FLOOR = 10, 1e-4
MIN_WINDOW = 500
EXACT_ROWS = 10_000
CALENDAR = ["hour_sin", "hour_cos", "is_night", "is_weekend", "is_month_end"]
CUMULATIVE = ["log_history_days", "log_user_tx_count", "tx_count_7d", "log_device_prior_uses",
              "n_devices_user", "counterparty_n_users", "log_account_age_days", "user_night_ratio",
              "log_mins_since_topup"]
# -------------------------------------------------------------------------------------------------


def feature_family(name: Column) -> Column:
    return (F.when(name.isin(CALENDAR), "calendaire").when(name.isin(CUMULATIVE), "cumulative")
            .otherwise("comportementale"))


def latest_window(fact: DataFrame, n: int = 2000) -> DataFrame:
    """The n most recently scored rows."""
    return fact.orderBy(F.desc("scored_at"), F.desc("transaction_id")).limit(n)


def unpivot_features(df: DataFrame, names: Sequence[str] | None = None, source: str | None = None) -> DataFrame:
    """(feature, value) rows from feature columns, or from a map column given by `source`."""
    if source:
        rows = df.select(F.explode(source).alias("feature", "value"))
        return rows.filter(F.col("feature").isin(list(names))) if names else rows
    names = list(names or FEATURE_NAMES)
    wide = df.select(*[F.col(n).cast("double").alias(n) for n in names])
    return wide.unpivot([], names, "feature", "value")


def value_table(reference: DataFrame, current: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per (feature, value): counts and cumulative counts on both sides, and the feature's totals.

    The counts are written for the running totals, and the table once more: KS, bin edges and bin shares scan it
    without sorting again.
    """
    both = (reference.select("feature", "value", F.lit(1).alias("r"), F.lit(0).alias("c"))
            .unionByName(current.select("feature", "value", F.lit(0).alias("r"), F.lit(1).alias("c"))))
    counts = materialise(both.filter(F.col("value").isNotNull()).groupBy("feature", "value").agg(
        F.sum("r").alias("ref"), F.sum("c").alias("cur")), "value-counts")
    ranked = running(counts, ["feature"], ["value"], sums={"ref_upto": F.col("ref"), "cur_upto": F.col("cur")},
                     inclusive=True, policy=policy)
    totals = counts.groupBy("feature").agg(
        F.sum("ref").alias("n_ref"), F.sum("cur").alias("n_cur"),
        F.count_if(F.col("ref") > 0).alias("ref_values"))
    return materialise(ranked.join(F.broadcast(totals), "feature"), "value-table")


def _ks(table: DataFrame) -> Column:
    return F.max(F.abs(F.try_divide("ref_upto", "n_ref") - F.try_divide("cur_upto", "n_cur")))


def ks_p_value(d: Column, n: Column, m: Column) -> Column:
    """Asymptotic two-sided p-value, 2 * sum of (-1)^(k-1) exp(-2 k^2 x^2)."""
    x2 = d * d * (n * m / (n + m))
    term = lambda acc, k: acc + F.when(k % 2 == 1, 2.0).otherwise(-2.0) * F.exp(-2 * k * k * x2)
    series = F.aggregate(F.sequence(F.lit(1), F.lit(100)), F.lit(0.0), term)
    return F.when(x2 < 0.04, 1.0).otherwise(F.least(F.greatest(series, F.lit(0.0)), F.lit(1.0)))


def ks_2samp(table: DataFrame) -> DataFrame:
    """KS distance and p-value per feature."""
    d = table.groupBy("feature").agg(_ks(table).alias("ks_d"), F.max("n_ref").alias("n_ref"),
                                     F.max("n_cur").alias("n_cur"))
    return d.select("feature", "ks_d", ks_p_value(F.col("ks_d"), F.col("n_ref"), F.col("n_cur")).alias("ks_p"),
                    "n_ref", "n_cur")


def ks_exact_p(d: float, n: int, m: int) -> float:
    """Chance that two samples of n and m rows of one continuous law differ by d or more: the share of lattice
    paths from (0, 0) to (n, m) that leave the band |i / n - j / m| < d.

    `left` is that share among the paths to a point; a point is reached over its two neighbours in proportion
    to their paths, so one diagonal follows from the one before and nothing large is ever formed.
    """
    whole = n * m // math.gcd(n, m)
    reach = round(d * whole)
    if reach <= 0:
        return 1.0
    wide, high = whole // n, whole // m
    left = np.zeros(n + 1)
    for s in range(1, n + m + 1):
        i = np.arange(max(0, s - m), min(n, s) + 1)
        over = np.where(i > 0, left[np.maximum(i - 1, 0)] * i, 0.0) + np.where(i < s, left[i] * (s - i), 0.0)
        left[i] = np.where(np.abs(i * wide - (s - i) * high) >= reach, 1.0, over / s)
    return float(left[n])


def ks_2samp_exact(table: DataFrame, by: str = "feature") -> DataFrame:
    """KS distance and p-value: the exact law up to EXACT_ROWS rows on either side, the asymptotic one beyond."""
    exact = F.udf(lambda d, n, m: None if d is None or n is None else ks_exact_p(d, n, m), "double")
    d = table.groupBy(by).agg(_ks(table).alias("ks_d"), F.max("n_ref").alias("n_ref"), F.max("n_cur").alias("n_cur"))
    small = (F.col("n_ref") > 0) & (F.col("n_cur") > 0) & (F.greatest("n_ref", "n_cur") <= EXACT_ROWS)
    return d.select(by, "ks_d", F.when(small, exact("ks_d", F.when(small, F.col("n_ref")), F.when(small, F.col("n_cur"))))
                    .otherwise(ks_p_value(F.col("ks_d"), F.col("n_ref"), F.col("n_cur"))).alias("ks_p"), "n_ref", "n_cur")


def quantile_edges(table: DataFrame, bins: int = BINS) -> DataFrame:
    """Inner bin edges per feature: distinct reference quantiles without the outermost two.

    Only values at which the running count passes a rank reach the aggregate: a rank's neighbours lie in
    ref_upto - ref to ref_upto - 1, so rank i has i * (n_ref - 1) / bins between ref_upto - ref - 1 and ref_upto.
    """
    rank = lambda upto: F.try_divide(upto * bins, F.col("n_ref") - 1)
    passed = F.floor(rank(F.col("ref_upto")) + 1e-6) >= F.ceil(rank(F.col("ref_upto") - F.col("ref") - 1) - 1e-6)
    seen = table.filter((F.col("ref") > 0) & F.coalesce(passed, F.lit(True)))
    cuts = [pick(F.col("value"), F.col("ref_upto"), F.col("n_ref"), i / bins) for i in range(bins + 1)]
    edges = seen.groupBy("feature").agg(F.array(*cuts).alias("all_edges"))
    unique = F.array_distinct("all_edges")
    return edges.select("feature", F.slice(unique, 2, F.greatest(F.size(unique) - 2, F.lit(0))).alias("edges"))


def psi(table: DataFrame, bins: int = BINS) -> DataFrame:
    """Population stability index per feature. Up to `bins` distinct reference values: one class per
    value of either side; otherwise reference-quantile bins, left-closed."""
    joined = table.join(F.broadcast(quantile_edges(table, bins)), "feature", "left")
    below = [F.coalesce((F.get("edges", F.lit(i)) <= F.col("value")).cast("int"), F.lit(0)) for i in range(bins)]
    within = F.when(F.col("edges").isNotNull(), sum(below, F.lit(0))).cast("double")
    label = F.when(F.col("ref_values") <= bins, F.col("value")).otherwise(within)
    classes = joined.groupBy("feature", label.alias("class")).agg(
        (F.sum("ref") / F.max("n_ref")).alias("r0"),
        F.coalesce(F.try_divide(F.sum("cur"), F.max("n_cur")), F.lit(0.0)).alias("c0"))
    r, c = F.greatest("r0", F.lit(FLOOR)), F.greatest("c0", F.lit(FLOOR))
    return classes.groupBy("feature").agg(F.sum((c - r) * F.log(c / r)).alias("psi"))


def compare(reference: DataFrame, current: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per feature: ks_d, ks_p, psi, family and the drift flag. Inputs are (feature, value) rows."""
    table = value_table(reference, current, policy)
    drift = ((F.col("ks_d") > KS_MAX) & (F.col("ks_p") < P_MIN)) | (F.col("psi") > PSI_MAX)
    return (ks_2samp(table).join(psi(table), "feature")
            .withColumns({"family": feature_family(F.col("feature")), "drift": drift}))


SCORE = "fraud_probability"


def drift_report(per_feature: DataFrame, window: Column, min_window: int = MIN_WINDOW) -> DataFrame:
    """One report row from `compare` output that also holds the score as a feature.

    The alarm needs a drifted behavioural feature or a score PSI above the limit; a window that is too
    small gives no row.
    """
    score = F.col("feature") == SCORE
    behavioural = F.col("family") == "comportementale"

    def names(condition: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(condition & F.col("drift") & ~score, F.col("feature"))))

    row = per_feature.agg(
        names(behavioural).alias("drifted_features"), names(~behavioural).alias("expected_drift"),
        F.max(F.when(score, F.round("ks_d", 4))).alias("score_ks_d"), F.max(F.when(score, F.col("ks_p"))).alias("score_ks_p"),
        F.max(F.when(score, F.round("psi", 4))).alias("score_psi"))
    alarm = (F.size("drifted_features") > 0) | (F.col("score_psi") > PSI_MAX)
    return (row.select(window.alias("window"), F.size("drifted_features").alias("n_drifted"), "*",
                       F.coalesce(alarm, F.lit(False)).alias("alarm"))
            .filter(F.col("window") >= min_window))


def top_features(per_feature: DataFrame, measure: str, n: int = 10) -> DataFrame:
    return (per_feature.filter(F.col("feature") != SCORE)
            .orderBy(F.desc(measure), "feature").limit(n).select("feature", measure))
