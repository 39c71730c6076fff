"""The given tables seen as transactions and user profiles.

`TX` and `PROFILE` are one SQL text for both engines; only the JSON accessor differs.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from paywarden.session import WIDE_PLANS

_TX = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value AS v, CAST({K} AS INT) AS k FROM events),
t AS (
  SELECT e.*, CASE event_type
      WHEN 'purchase' THEN CASE WHEN k % 2 = 0 THEN 'CARD_PURCHASE' ELSE 'MERCHANT_PAYMENT' END
      WHEN 'click'  THEN 'P2P_SEND'
      WHEN 'view'   THEN 'P2P_RECEIVE'
      WHEN 'signup' THEN CASE WHEN k % 3 = 0 THEN 'CARD_TOPUP' ELSE 'CASH_IN' END
      ELSE 'CASH_OUT' END AS tx_type FROM e),
a AS (
  SELECT t.*, CASE WHEN tx_type IN ('CASH_IN','CASH_OUT') THEN 'AGENT'
                   WHEN k % 3 = 0 AND tx_type NOT IN ('CARD_PURCHASE','CARD_TOPUP') THEN 'USSD'
                   ELSE 'APP' END AS access_channel FROM t)
SELECT a.event_id,
       concat('TX', lpad(CAST(a.event_id AS varchar(20)), 12, '0')) AS transaction_id,
       a.ts AS timestamp, concat('U', CAST(a.user_id AS varchar(20))) AS user_id,
       CASE WHEN a.user_id % 50 <> 0 THEN concat('2438', CAST(a.user_id AS varchar(20))) END AS wallet_id,
       CASE WHEN tx_type IN ('CARD_PURCHASE','CARD_TOPUP') THEN concat('CARD', CAST(a.user_id AS varchar(20))) END AS card_id,
       CASE WHEN tx_type IN ('CARD_PURCHASE','CARD_TOPUP') THEN 'VISA_VIRTUAL' ELSE 'MOBILE_MONEY' END AS channel,
       CASE a.user_id % 3 WHEN 0 THEN 'VODACOM' WHEN 1 THEN 'AIRTEL' ELSE 'ORANGE' END AS operator,
       tx_type, access_channel, v AS amount_usd,
       CASE WHEN a.user_id % 2 = 0 THEN 'USD' ELSE 'CDF' END AS currency,
       CASE WHEN a.user_id % 2 = 0 THEN v ELSE v * 2850 END AS amount,
       coalesce(abs(c.c_acctbal), CAST(0 AS double)) / 20 AS balance_before_usd,
       CASE WHEN event_type = 'error' AND k % 4 = 0 THEN 'FAILED_INSUFFICIENT_FUNDS' ELSE 'SUCCESS' END AS status,
       CASE WHEN tx_type IN ('P2P_SEND','P2P_RECEIVE') THEN concat('W', CAST(k AS varchar(20))) END AS counterparty_id,
       CASE WHEN event_type = 'purchase' THEN concat('M', CAST(k % 30 AS varchar(20))) END AS merchant_id,
       CASE WHEN event_type = 'purchase' THEN CASE k % 5 WHEN 0 THEN 'ELECTRONICS' WHEN 1 THEN 'GIFT_CARDS'
            WHEN 2 THEN 'RESTAURANT' WHEN 3 THEN 'PHARMACIE' ELSE 'GAMING' END END AS merchant_category,
       CASE WHEN event_type = 'purchase' THEN CASE WHEN k % 4 = 0 THEN 'US' ELSE 'CD' END END AS merchant_country,
       CASE WHEN tx_type IN ('CASH_IN','CASH_OUT') THEN concat('A', CAST(k % 12 AS varchar(20))) END AS agent_id,
       concat('D', CAST((a.user_id * 7 + k % 4) % 211 AS varchar(20))) AS device_id,
       CASE WHEN k % 4 = 3 THEN 'feature_phone' ELSE 'smartphone' END AS device_type,
       CASE WHEN access_channel = 'APP' THEN CASE WHEN k % 11 = 0 THEN 'FR' ELSE 'CD' END END AS ip_country,
       concat('PROV', CAST(CASE WHEN k % 10 = 0 THEN k % 9 ELSE a.user_id % 9 END AS varchar(20))) AS location_province,
       CASE WHEN k % 17 = 0 AND v > 60 THEN 1 ELSE 0 END AS is_fraud,
       CASE WHEN k % 17 = 0 AND v > 60 THEN concat('TYPE', CAST(k % 4 AS varchar(20))) END AS fraud_type,
       5.0e0 + (a.event_id % 97) * 1.5e0 AS latency_ms
FROM a LEFT JOIN customer c ON c.c_custkey = a.user_id
"""

PROFILE = """
SELECT concat('U', CAST(c_custkey AS varchar(20))) AS user_id,
       concat('PROV', CAST(c_custkey % 9 AS varchar(20))) AS province,
       1 + c_nationkey % 3 AS kyc_level,
       CASE 1 + c_nationkey % 3 WHEN 1 THEN 150.0e0 WHEN 2 THEN 1500.0e0 ELSE 5000.0e0 END AS kyc_tx_limit_usd,
       CAST(30 + c_custkey % 2000 AS double) AS account_age_days,
       abs(c_acctbal) / 10.0e0 + 50.0e0 AS monthly_income_usd,
       CASE WHEN c_mktsegment IN ('BUILDING','MACHINERY') THEN 1 ELSE 0 END AS has_visa_virtual
FROM customer
"""

TX_SPARK = _TX.replace("{K}", "get_json_object(props, '$.k')")
TX_DUCK = _TX.replace("{K}", "json_extract_string(props, '$.k')")


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _sql(spark: SparkSession, sf_dir: str, text: str, names: tuple[str, ...]) -> DataFrame:
    for key, value in {"spark.sql.session.timeZone": "UTC", **WIDE_PLANS}.items():
        spark.conf.set(key, value)
    return spark.sql(text.replace("FROM events", "FROM {events}").replace(" customer", " {customer}"),
                     **{n: load(spark, sf_dir, n) for n in names})


def transactions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, TX_SPARK, ("events", "customer"))


def profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sql(spark, sf_dir, PROFILE, ("customer",))


def duck(body: str, *, profile: bool = False) -> str:
    """A DuckDB query over `tx` (and `profile`)."""
    views = [f"tx AS ({TX_DUCK})"] + ([f"profile AS ({PROFILE})"] if profile else [])
    body = body.strip()
    if body[:5].upper() == "WITH ":
        return "WITH " + ",\n".join(views) + ",\n" + body[5:]
    return "WITH " + ",\n".join(views) + "\n" + body
