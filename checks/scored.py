"""The scored fact the report, drift, label and case queries read: features, a fixed logistic of the
rule score as probability, and the decision policy."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.feature_queries import feats_sql, features
from paywarden.operators.decision import Policy, decide
from paywarden.operators.features import FEATURE_NAMES
from paywarden.operators.rules import rule_score
from paywarden.session import materialise

THRESHOLD = 0.3
EXTRA = ("event_id", "latency_ms", "operator", "access_channel", "location_province", "amount", "currency",
         "device_id", "wallet_id", "status", "counterparty_id", "merchant_id", "agent_id")


def with_probability(df: DataFrame) -> DataFrame:
    return df.withColumns({"rule_score": rule_score()}).withColumn(
        "fraud_probability", 1 / (1 + F.exp(-(-4 + 1.1 * F.col("rule_score")))))


# the features that rule score and decision rules read
DECIDING = ("amount_ratio_user_mean", "is_new_device", "is_night", "is_near_full_drain", "is_foreign_ip", "tx_count_1h",
            "amount_to_kyc_limit", "is_new_province")


def decided(spark, d, names=FEATURE_NAMES) -> DataFrame:
    df = with_probability(features(spark, d, extra=EXTRA + ("balance_before_usd",), names=names))
    return decide(df, Policy(THRESHOLD))


def fact(spark, d, names=FEATURE_NAMES) -> DataFrame:
    """One row per transaction with decision and, for every third event, the analyst's label; `names` for readers
    of fewer features."""
    label = F.when(F.col("event_id") % 3 == 0, F.col("is_fraud"))
    return decided(spark, d, names).withColumns({
        "tx_time": F.col("timestamp"), "scored_at": F.col("timestamp"), "province": F.col("location_province"),
        "model_version": F.lit("rules"), "degraded": F.col("event_id") % 41 == 0, "label": label,
        "labeled_at": F.when(label.isNotNull(), F.expr("timestamp + INTERVAL 2 DAYS"))})


def stored_fact(spark, d, *columns: str) -> DataFrame:
    """The fact as reports find it: written once, for queries that read it more than once."""
    return materialise(fact(spark, d).select(*columns), "fact")


SCORED = """
s0 AS (
  SELECT *, CAST((amount_ratio_user_mean > ln(6)) AS INT) + is_new_device + is_night + is_near_full_drain
            + is_foreign_ip + CAST((tx_count_1h >= 4) AS INT) AS rule_score FROM feats),
s1 AS (SELECT *, 1 / (1 + exp(-(-4 + 1.1e0 * rule_score))) AS p FROM s0),
s2 AS (
  SELECT *, p * amount_usd AS ca,
    CASE WHEN channel = 'VISA_VIRTUAL' THEN 0.15e0 + p * amount_usd * (1 - 0.9e0) ELSE 0.3e0 + p * amount_usd * (1 - 0.85e0) END AS cv,
    (1 - p) * (CASE WHEN channel = 'VISA_VIRTUAL' THEN 6 ELSE 4 END + 0.05e0 * amount_usd) AS cb,
    list_filter([CASE WHEN tx_type NOT IN ('P2P_RECEIVE','CASH_IN') AND is_new_device = 1 AND is_near_full_drain = 1 THEN 'NOUVEL_APPAREIL_VIDAGE_COMPTE' END,
      CASE WHEN tx_type NOT IN ('P2P_RECEIVE','CASH_IN') AND amount_to_kyc_limit > 1 THEN 'DEPASSEMENT_PLAFOND_KYC' END,
      CASE WHEN tx_type = 'CASH_OUT' AND is_new_device = 1 AND is_new_province = 1 THEN 'CASH_OUT_APPAREIL_ET_PROVINCE_INHABITUELS' END],
      lambda x: x IS NOT NULL) AS rules FROM s1),
s3 AS (
  SELECT *, CASE WHEN p >= 0.97 THEN 'BLOCK' WHEN p < 0.01 THEN 'APPROVE'
                 WHEN ca <= cv AND ca <= cb THEN 'APPROVE' WHEN cv <= cb THEN 'VERIFY' ELSE 'BLOCK' END AS act0,
    CASE WHEN p >= 0.97 THEN 'probabilité de fraude très élevée' WHEN p < 0.01 THEN 'risque négligeable'
         ELSE 'coût attendu minimal' END AS why FROM s2),
scored AS (
  SELECT *, p AS fraud_probability,
    CASE WHEN len(rules) > 0 AND act0 = 'APPROVE' THEN 'VERIFY' ELSE act0 END AS action,
    CASE WHEN p >= 0.9 THEN 'CRITIQUE' WHEN p >= 0.3 THEN 'ELEVE' WHEN p >= 0.06 THEN 'MOYEN' ELSE 'FAIBLE' END AS risk_level,
    CASE WHEN len(rules) > 0 AND act0 = 'APPROVE' THEN concat('règle : ', rules[1]) ELSE why END AS reason,
    timestamp AS tx_time, timestamp AS scored_at, location_province AS province,
    event_id % 41 = 0 AS degraded, CASE WHEN event_id % 3 = 0 THEN is_fraud END AS label,
    CASE WHEN event_id % 3 = 0 THEN timestamp + INTERVAL 2 DAYS END AS labeled_at FROM s3)
"""


def scored_sql(body: str, more: str = "") -> str:
    extra = f",\n{more}" if more else ""
    return feats_sql(body, SCORED.strip() + extra)
