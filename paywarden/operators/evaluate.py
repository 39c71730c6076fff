"""Model quality on any number of rows: one row per distinct score, running totals, then sums."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise

SINGLE_CLASS = "une seule classe présente"      # fixed value


def pr_curve(df: DataFrame, y: str = "y", score: str = "score", by: Sequence[str] = (),
             policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per distinct score used as threshold: own positives/negatives, tp, fp, totals, precision, recall."""
    by = list(by)
    # written once: the probe for hot groups, the running totals and the totals all read it
    per_score = materialise(df.groupBy(*by, F.col(score).cast("double").alias("threshold")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) == 0).alias("neg")), "per-score")
    ranked = running(per_score.withColumn("__down", -F.col("threshold")), by, ["__down"],
                     sums={"tp": F.col("pos"), "fp": F.col("neg")}, inclusive=True, policy=policy)
    totals = per_score.groupBy(*[F.col(c).alias(f"__{c}") for c in by]).agg(
        F.sum("pos").alias("all_pos"), F.sum("neg").alias("all_neg"))
    if by:
        match = [F.col(c).eqNullSafe(F.col(f"__{c}")) for c in by]
        curve = ranked.join(totals, match).drop(*[f"__{c}" for c in by])
    else:
        curve = ranked.withColumns({n: totals.select(n).scalar() for n in ("all_pos", "all_neg")})
    return curve.drop("__down").withColumns({
        "precision": F.col("tp") / (F.col("tp") + F.col("fp")),
        "recall": F.try_divide(F.col("tp"), F.col("all_pos"))})


def _average_precision() -> Column:
    return F.sum(F.col("pos") / F.col("all_pos") * F.col("precision"))


def _roc_auc() -> Column:
    area = F.col("neg") * (F.col("tp") - F.col("pos") / 2)
    return F.sum(area / F.col("all_pos") / F.col("all_neg"))


def _recall_at(max_fpr: float) -> Column:
    within = F.col("fp") / F.col("all_neg") <= max_fpr
    return F.coalesce(F.max(F.when(within, F.col("recall"))), F.lit(0.0))


def _group(curve: DataFrame, by: Sequence[str]):
    usable = curve.filter((F.col("all_pos") > 0) & (F.col("all_neg") > 0))
    return usable.groupBy(*by)


def average_precision(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Step sum of precision over recall gains."""
    return _group(curve, by).agg(_average_precision().alias("average_precision"))


def roc_auc(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Area under the ROC curve, equal scores count half."""
    return _group(curve, by).agg(_roc_auc().alias("roc_auc"))


def recall_at_fpr(curve: DataFrame, max_fpr: float = 0.01, by: Sequence[str] = ()) -> DataFrame:
    return _group(curve, by).agg(_recall_at(max_fpr).alias("recall_at_fpr"))


def best_f1_threshold(curve: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Threshold with the highest F1, the lowest one among equals."""
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.col("precision") + F.col("recall"), F.lit(1e-12))
    best = F.max(F.struct(f1.alias("f1"), (-F.col("threshold")).alias("down")))
    return curve.groupBy(*by).agg(best.alias("b")).select(
        *by, (-F.col("b.down")).alias("threshold"), F.col("b.f1").alias("f1"))


def evaluate(df: DataFrame, threshold: float, y: str = "y", score: str = "score", by: Sequence[str] = (),
             policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """n, n_fraud, pr_auc, roc_auc, recall_at_1pct_fpr, precision, recall, f1, false_positive_rate.

    With a single class present only the counts and a note are given.
    """
    by = list(by)
    curve = pr_curve(df, y, score, by, policy)
    hit = F.col("threshold") >= threshold
    sums = curve.groupBy(*by).agg(
        F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("n_fraud"),
        F.max("all_neg").alias("all_neg"),
        F.sum(F.when(hit, F.col("pos")).otherwise(0)).alias("hits"),
        F.sum(F.when(hit, F.col("neg")).otherwise(0)).alias("false_hits"),
        F.sum(F.try_divide("pos", "all_pos") * F.col("precision")).alias("ap"),
        F.sum(F.try_divide(F.try_divide(F.col("neg") * (F.col("tp") - F.col("pos") / 2), F.col("all_pos")),
                           F.col("all_neg"))).alias("auc"),
        F.max(F.when(F.try_divide("fp", "all_neg") <= 0.01, F.col("recall"))).alias("at_fpr"))
    both = (F.col("n_fraud") > 0) & (F.col("all_neg") > 0)
    precision = F.coalesce(F.try_divide("hits", F.col("hits") + F.col("false_hits")), F.lit(0.0))
    recall = F.try_divide("hits", "n_fraud")
    f1 = F.coalesce(F.try_divide(2 * F.col("hits"), F.col("hits") + F.col("false_hits") + F.col("n_fraud")), F.lit(0.0))

    def measured(value: Column, places: int, name: str) -> Column:
        return F.when(both, F.round(value, places)).alias(name)

    return sums.select(
        *by, "n", "n_fraud", measured(F.col("ap"), 4, "pr_auc"), measured(F.col("auc"), 4, "roc_auc"),
        measured(F.coalesce("at_fpr", F.lit(0.0)), 4, "recall_at_1pct_fpr"), measured(precision, 4, "precision"),
        measured(recall, 4, "recall"), measured(f1, 4, "f1"),
        measured(F.try_divide("false_hits", "all_neg"), 5, "false_positive_rate"),
        F.when(~both, SINGLE_CLASS).alias("note"))


def recall_by_fraud_type(df: DataFrame, threshold: float, y: str = "y", score: str = "score",
                         kind: str = "fraud_type") -> DataFrame:
    return df.filter((F.col(y) == 1) & F.col(kind).isNotNull()).groupBy(kind).agg(
        F.count("*").alias("n"), F.round(F.avg((F.col(score) >= threshold).cast("double")), 4).alias("recall"))
