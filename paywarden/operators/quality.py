"""Data quality checks and money rules of the transaction table."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.operators.features import FEATURE_NAMES, build_features
from paywarden.schema import USD_CDF_RATE

# --- fixed values -------------------------------------------------------------------------------
TOLERANCE = 0.01
CDF_STEP, CDF_AIRTIME_STEP = 500, 100
MIN_AMOUNT, LIMIT_SHARE = 0.2, 0.95
# -------------------------------------------------------------------------------------------------


def duplicate_ids(df: DataFrame, key: str = "transaction_id") -> DataFrame:
    """Identifiers that occur more than once."""
    return df.groupBy(key).agg(F.count("*").alias("n")).filter("n > 1")


def inside_period(tx: DataFrame, start: str, end: str) -> DataFrame:
    """First and last time, and rows outside [start, end)."""
    ts = F.col("timestamp")
    outside = (ts < F.lit(start).cast("timestamp_ntz")) | (ts >= F.lit(end).cast("timestamp_ntz"))
    return tx.agg(F.count("*").alias("n"), F.count_if(outside).alias("outside"))


def balance_violations(tx: DataFrame) -> DataFrame:
    """Rows with a negative balance, a non-positive amount, or a failed operation that moved money."""
    before, after = F.col("balance_before_usd"), F.col("balance_after_usd")
    problems = {
        "negative_before": before < -TOLERANCE, "negative_after": after < -TOLERANCE,
        "failed_moved": (F.col("status") != "SUCCESS") & (F.abs(before - after) > 1e-5 * F.abs(after) + 1e-8),
        "amount_not_positive": F.col("amount_usd") <= 0}
    found = F.filter(F.array(*[F.when(c, F.lit(n)) for n, c in problems.items()]), lambda p: p.isNotNull())
    return tx.withColumn("problems", found).filter(F.size("problems") > 0)


def over_kyc_limit(tx: DataFrame, users: DataFrame) -> DataFrame:
    """Rows above the user's limit."""
    limits = users.select("user_id", "kyc_tx_limit_usd")
    return tx.join(limits, "user_id").filter(F.col("amount_usd") > F.col("kyc_tx_limit_usd") + TOLERANCE)


def identifier_lengths(tx: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per identifier column: lengths seen only on frauds. Any length there would give the label away."""
    wide = tx.select("is_fraud", *[F.length(c).alias(c) for c in columns])
    lengths = wide.unpivot(["is_fraud"], list(columns), "column", "length").filter(F.col("length").isNotNull())
    seen = lengths.groupBy("column", "length").agg(
        F.max((F.col("is_fraud") == 1).cast("int")).alias("fraud"), F.max((F.col("is_fraud") == 0).cast("int")).alias("legit"))
    return seen.groupBy("column").agg(
        F.count("*").alias("lengths"), F.count_if((F.col("fraud") == 1) & (F.col("legit") == 0)).alias("fraud_only"))


def not_finite(features: DataFrame, names: Sequence[str] = tuple(FEATURE_NAMES)) -> DataFrame:
    """Per feature: values that are null, NaN or infinite."""
    def bad(name: str) -> Column:
        x = F.col(name).cast("double")
        return F.count_if(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))).alias(name)

    return features.agg(*[bad(n) for n in names]).unpivot([], list(names), "feature", "not_finite")


def future_leaks(tx: DataFrame, users: DataFrame, until: str, period_start: str, places: int = 5,
                 **options) -> DataFrame:
    """Rows before `until` whose features change when the later rows are taken away."""
    early = F.col("timestamp") < F.lit(until).cast("timestamp_ntz")

    def table(rows: DataFrame) -> DataFrame:
        built = build_features(rows, users, period_start, **options)
        return built.filter(early).select("transaction_id", *[
            F.round(F.col(n).cast("double"), places).alias(n) for n in FEATURE_NAMES])

    whole, prefix = table(tx), table(tx.filter(early))
    return whole.join(prefix, whole.columns, "left_anti").select("transaction_id")


def display_amount(amount_usd: Column, currency: Column, rate: float = USD_CDF_RATE) -> Column:
    """Amount in the currency of the operation; CDF has no decimals."""
    return F.when(currency == "CDF", F.bround(amount_usd * rate, 0)).otherwise(amount_usd)


def clip_to_limit(amount_usd: Column, limit: Column) -> Column:
    return F.least(F.greatest(amount_usd, F.lit(MIN_AMOUNT)), limit * LIMIT_SHARE)


def round_amount(amount_usd: Column, currency: Column, tx_type: Column, rate: float = USD_CDF_RATE) -> Column:
    """Amounts typed by people: CDF in steps, USD in whole or half dollars. Card purchases keep the
    merchant's price."""
    step = F.when(tx_type == "AIRTIME", CDF_AIRTIME_STEP).otherwise(CDF_STEP)
    cdf = F.greatest(step.cast("double"), F.bround(amount_usd * rate / step, 0) * step) / rate
    usd = F.when(amount_usd >= 5, F.bround(amount_usd, 0)).otherwise(
        F.greatest(F.lit(0.5), F.bround(amount_usd * 2, 0) / 2))
    return (F.when(tx_type == "CARD_PURCHASE", amount_usd).when(currency == "CDF", cdf)
            .when(currency == "USD", usd).otherwise(amount_usd))
