"""Feature queries (F*) with their DuckDB counterparts."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from checks.tables import duck, profiles, transactions
from paywarden.operators import features as ft
from paywarden.operators import snapshots as sn

H24 = "INTERVAL 24 HOURS"


def features(spark, d, **kw) -> DataFrame:
    return ft.build_features(transactions(spark, d), profiles(spark, d), precise=True, **kw)


def rounded(df: DataFrame, names: list[str], places: int = 6) -> list:
    """Rounded columns; the nudge keeps exact halves from falling differently in the two engines."""
    return [F.round(F.col(n) + 1e-9, places).alias(n) for n in names]


# one window per rule, written from the definitions; timestamps of one user never tie in this data
FEATS = """
b AS (
  SELECT tx.*, epoch_us(timestamp) AS us, hour(timestamp) AS hr,
         tx_type NOT IN ('P2P_RECEIVE','CASH_IN') AS debit,
         CASE WHEN tx_type IN ('P2P_SEND','P2P_RECEIVE') THEN counterparty_id END AS cp,
         p.province, p.kyc_level, p.kyc_tx_limit_usd, p.account_age_days, p.monthly_income_usd,
         p.has_visa_virtual, p.user_id IS NOT NULL AS known_user,
         (SELECT date_trunc('day', min(timestamp)) FROM tx) AS start_at
  FROM tx LEFT JOIN profile p USING (user_id)),
w AS (
  SELECT *,
    count(*) OVER past AS n, coalesce(sum(ln(1+amount_usd)) OVER past, 0) AS la_sum,
    coalesce(sum(ln(1+amount_usd)*ln(1+amount_usd)) OVER past, 0) AS la_sq,
    coalesce(sum(amount_usd) OVER past, 0) AS amt_sum,
    count(*) OVER h1 - 1 AS c1h, count(*) OVER h24 - 1 AS c24h, count(*) OVER d7 AS c7_incl,
    count(*) FILTER (WHERE debit) OVER h1 - debit::INT AS d1h,
    coalesce(sum(CASE WHEN debit THEN amount_usd ELSE 0 END) OVER h24, 0) - CASE WHEN debit THEN amount_usd ELSE 0 END AS s24,
    count(*) FILTER (WHERE status <> 'SUCCESS') OVER h24 - (status <> 'SUCCESS')::INT AS f24,
    lag(us) OVER u AS last_us, min(us) OVER past AS first_us,
    row_number() OVER (PARTITION BY user_id, device_id ORDER BY timestamp) - 1 AS dev_prior,
    row_number() OVER (PARTITION BY user_id, location_province ORDER BY timestamp) - 1 AS prov_prior,
    row_number() OVER (PARTITION BY user_id, cp ORDER BY timestamp) - 1 AS cp_prior,
    row_number() OVER (PARTITION BY user_id, agent_id ORDER BY timestamp) - 1 AS ag_prior,
    row_number() OVER (PARTITION BY user_id, merchant_id ORDER BY timestamp) - 1 AS me_prior,
    coalesce(count(*) FILTER (WHERE hr <= 5) OVER past, 0) AS nights,
    coalesce(sum(sin(2*pi()*hr/24)) OVER past, 0) AS ssin, coalesce(sum(cos(2*pi()*hr/24)) OVER past, 0) AS scos,
    last_value(CASE WHEN tx_type = 'CARD_TOPUP' AND status = 'SUCCESS' THEN us END IGNORE NULLS) OVER past AS top_us,
    last_value(CASE WHEN tx_type = 'CARD_TOPUP' AND status = 'SUCCESS' THEN amount_usd END IGNORE NULLS) OVER past AS top_usd,
    count(DISTINCT device_id) OVER past AS n_dev,
    count(DISTINCT user_id) OVER (PARTITION BY device_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS dev_users,
    count(DISTINCT user_id) OVER (PARTITION BY cp ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS cp_users,
    count(DISTINCT user_id) OVER (PARTITION BY agent_id ORDER BY timestamp RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) AS ag_users
  FROM b
  WINDOW u AS (PARTITION BY user_id ORDER BY timestamp),
         past AS (PARTITION BY user_id ORDER BY timestamp ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         h1 AS (PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN INTERVAL 1 HOUR PRECEDING AND CURRENT ROW),
         h24 AS (PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW),
         d7 AS (PARTITION BY user_id ORDER BY timestamp RANGE BETWEEN INTERVAL 7 DAYS PRECEDING AND CURRENT ROW)),
w2 AS (SELECT *, coalesce(lag(c7_incl) OVER (PARTITION BY user_id ORDER BY timestamp), 0) AS c7,
              la_sum / nullif(n, 0) AS mean, scos / nullif(n, 0) AS mx, ssin / nullif(n, 0) AS my FROM w),
w3 AS (SELECT *, sqrt(mx*mx + my*my) AS strength, abs(atan2(my, mx) - 2*pi()*hr/24) AS apart0 FROM w2),
w4 AS (SELECT *, apart0 - floor(apart0 / (2*pi())) * 2*pi() AS apart,
              tx_type = 'CARD_PURCHASE' AND top_us IS NOT NULL AS topped FROM w3),
feats AS (
  SELECT transaction_id, user_id, channel, tx_type, amount_usd, is_fraud, fraud_type, known_user,
         timestamp, event_id, status, latency_ms, operator, access_channel, location_province, amount, currency,
         device_id, wallet_id,
    ln(1+amount_usd) AS log_amount_usd,
    CASE WHEN n >= 3 THEN greatest(-10, least(10, (ln(1+amount_usd) - mean) / (sqrt(greatest(la_sq/n - mean*mean, 0)) + 0.25))) ELSE 0 END AS amount_zscore_user,
    CASE WHEN n >= 3 THEN ln(1 + amount_usd / (amt_sum/n + 1e-6)) ELSE ln(2) END AS amount_ratio_user_mean,
    CASE WHEN debit THEN least(amount_usd / (balance_before_usd + 1), 5) ELSE 0 END AS amount_to_balance,
    CASE WHEN debit AND balance_before_usd > 1 AND amount_usd >= 0.85e0 * balance_before_usd THEN 1 ELSE 0 END AS is_near_full_drain,
    amount_usd / kyc_tx_limit_usd AS amount_to_kyc_limit,
    ln(1 + greatest(balance_before_usd, 0)) AS log_balance_before,
    c1h AS tx_count_1h, c24h AS tx_count_24h, c7 AS tx_count_7d, d1h AS debit_count_1h,
    ln(1 + greatest(round(s24, 4), 0)) AS log_debit_sum_24h,
    ln(1 + coalesce((us - last_us) / 1e6, 30*86400)) AS log_secs_since_last_tx,
    f24 AS failed_count_24h,
    CASE WHEN n > 0 AND dev_prior = 0 THEN 1 ELSE 0 END AS is_new_device,
    ln(1 + dev_prior) AS log_device_prior_uses, n_dev AS n_devices_user,
    least(dev_users - CASE WHEN dev_prior > 0 THEN 1 ELSE 0 END, 20) AS device_n_users,
    CASE WHEN device_type = 'smartphone' THEN 1 ELSE 0 END AS is_smartphone,
    CASE WHEN access_channel = 'APP' THEN 1 ELSE 0 END AS access_app,
    CASE WHEN access_channel = 'USSD' THEN 1 ELSE 0 END AS access_ussd,
    CASE WHEN access_channel = 'AGENT' THEN 1 ELSE 0 END AS access_agent,
    CASE WHEN ip_country <> 'CD' THEN 1 ELSE 0 END AS is_foreign_ip,
    CASE WHEN n > 0 AND prov_prior = 0 THEN 1 ELSE 0 END AS is_new_province,
    CASE WHEN location_province IS DISTINCT FROM province THEN 1 ELSE 0 END AS is_away_from_home,
    CASE WHEN cp IS NOT NULL AND cp_prior = 0 THEN 1 ELSE 0 END AS is_new_counterparty,
    CASE WHEN cp IS NULL THEN 0 ELSE ln(1 + cp_users - CASE WHEN cp_prior > 0 THEN 1 ELSE 0 END) END AS counterparty_n_users,
    CASE WHEN agent_id IS NOT NULL AND ag_prior = 0 THEN 1 ELSE 0 END AS is_new_agent,
    CASE WHEN agent_id IS NULL THEN 0 ELSE ln(1 + ag_users - 1) END AS agent_n_users_24h,
    CASE WHEN merchant_id IS NOT NULL AND me_prior = 0 THEN 1 ELSE 0 END AS is_new_merchant,
    CASE WHEN merchant_category IN ('ELECTRONICS','GIFT_CARDS','CRYPTO_EXCHANGE','GAMING') THEN 1 ELSE 0 END AS is_high_risk_merchant,
    CASE WHEN merchant_country <> 'CD' THEN 1 ELSE 0 END AS is_foreign_merchant,
    sin(2*pi()*hr/24) AS hour_sin, cos(2*pi()*hr/24) AS hour_cos,
    CASE WHEN hr <= 5 THEN 1 ELSE 0 END AS is_night,
    (nights + 0.05e0) / (n + 1) AS user_night_ratio,
    CASE WHEN hr <= 5 THEN 1 - (nights + 0.05e0) / (n + 1) ELSE 0 END AS night_unusual,
    CASE WHEN n >= 3 AND strength > 0.1 THEN least(apart, 2*pi() - apart) / pi() * strength ELSE 0 END AS hour_deviation_user,
    CASE WHEN isodow(timestamp) >= 6 THEN 1 ELSE 0 END AS is_weekend,
    CASE WHEN day(timestamp) >= 25 OR day(timestamp) <= 3 THEN 1 ELSE 0 END AS is_month_end,
    CASE WHEN first_us IS NULL THEN 0 ELSE ln(1 + (us - first_us) / 86400e6) END AS log_history_days,
    ln(1 + n) AS log_user_tx_count,
    CASE WHEN channel = 'VISA_VIRTUAL' THEN 1 ELSE 0 END AS is_card,
    CASE WHEN topped THEN ln(1 + (us - top_us) / 60e6) ELSE ln(1 + 43200) END AS log_mins_since_topup,
    CASE WHEN topped THEN least(amount_usd / (top_usd + 1), 5) ELSE 0 END AS purchase_to_topup_ratio,
    kyc_level, ln(1 + greatest(account_age_days + (us - epoch_us(start_at)) / 86400e6, 0)) AS log_account_age_days,
    ln(1 + monthly_income_usd) AS log_monthly_income, has_visa_virtual,
""" + ",\n".join(f"    CASE WHEN tx_type = '{t}' THEN 1 ELSE 0 END AS type_{t}" for t in ft.TX_TYPES) + """
  FROM w4)
"""


def feats_sql(body: str, more: str = "") -> str:
    """DuckDB text with `feats` (and `tx`, `profile`) in scope."""
    extra = f",\n{more}" if more else ""
    return duck(f"WITH {FEATS.strip()}{extra}\n{body}", profile=True)


def _select(names: list[str]) -> str:
    return ", ".join(f"round(CAST({n} AS DOUBLE) + 1e-9, 6) AS {n}" for n in names)


def _group(name: str):
    names = ft.feature_names(name)

    def run(spark, d):
        df = features(spark, d)
        return df.select("transaction_id", *rounded(df, names))

    return run, feats_sql(f"SELECT transaction_id, {_select(names)} FROM feats")


def f1(spark, d):
    df = features(spark, d)
    return df.select("transaction_id", "user_id", "channel", "tx_type", "amount_usd", "is_fraud", "fraud_type",
                     "known_user", *rounded(df, ft.FEATURE_NAMES))


NULLS = [*ft.feature_names("device"), *ft.feature_names("location")]


def f2_nulls(spark, d):
    """Absent devices and provinces are values like any other."""
    tx = transactions(spark, d).withColumns({
        "device_id": F.when(F.col("event_id") % 7 != 3, F.col("device_id")),
        "location_province": F.when(F.col("event_id") % 5 != 1, F.col("location_province"))})
    df = ft.build_features(tx, profiles(spark, d), precise=True)
    return df.select("transaction_id", *rounded(df, NULLS))


# the same with a name for what is absent
F2_NULLS_SQL = feats_sql(f"SELECT transaction_id, {_select(NULLS)} FROM feats").replace(
    "concat('D', CAST((a.user_id", "CASE WHEN a.event_id % 7 = 3 THEN 'NONE' ELSE concat('D', CAST((a.user_id").replace(
    "% 211 AS varchar(20))) AS device_id", "% 211 AS varchar(20))) END AS device_id").replace(
    "concat('PROV', CAST(CASE WHEN k % 10", "CASE WHEN a.event_id % 5 = 1 THEN 'NONE' ELSE concat('PROV', CAST(CASE WHEN k % 10").replace(
    "% 9 END AS varchar(20))) AS location_province", "% 9 END AS varchar(20))) END AS location_province")


def f3(spark, d):
    """Half of the users are taken out of the profile table."""
    users = profiles(spark, d).filter("CAST(substr(user_id, 2) AS INT) % 2 = 0")
    df = ft.build_features(transactions(spark, d), users, precise=True)
    return df.select("transaction_id", "known_user",
                     *rounded(df, ["kyc_level", "amount_to_kyc_limit", "log_monthly_income", "has_visa_virtual",
                                   "is_away_from_home"]))


F3_SQL = duck("""
SELECT transaction_id, p.user_id IS NOT NULL AS known_user,
  round(CAST(coalesce(p.kyc_level, 1) AS DOUBLE), 6) AS kyc_level,
  round(amount_usd / coalesce(p.kyc_tx_limit_usd, 100), 6) AS amount_to_kyc_limit,
  round(ln(1 + coalesce(p.monthly_income_usd, 100)), 6) AS log_monthly_income,
  round(CAST(coalesce(p.has_visa_virtual, 0) AS DOUBLE), 6) AS has_visa_virtual,
  CASE WHEN location_province <> coalesce(p.province, 'Kinshasa') THEN 1.0e0 ELSE 0.0e0 END AS is_away_from_home
FROM tx LEFT JOIN (SELECT * FROM profile WHERE CAST(substr(user_id, 2) AS INT) % 2 = 0) p USING (user_id)""",
              profile=True)

UNTIL = "2024-01-20 00:00:00"


def f4(spark, d):
    s = sn.profile_snapshot(transactions(spark, d), until=UNTIL)
    return s.select("user_id", "n", "first_us", "last_us", "night_count", "n_devices", "n_provinces",
                    "n_counterparties", "n_agents", "n_merchants", "last_topup_us", "last_topup_amt",
                    *rounded(s, ["log_amt_sum", "log_amt_sq", "amt_sum", "hour_sin_sum", "hour_cos_sum"], 4))


F4_SQL = duck(f"""
SELECT user_id, count(*) AS n, min(epoch_us(timestamp)) AS first_us, max(epoch_us(timestamp)) AS last_us,
  count(*) FILTER (WHERE hour(timestamp) <= 5) AS night_count,
  count(DISTINCT device_id) AS n_devices, count(DISTINCT location_province) AS n_provinces,
  count(DISTINCT CASE WHEN tx_type IN ('P2P_SEND','P2P_RECEIVE') THEN counterparty_id END) AS n_counterparties,
  count(DISTINCT agent_id) AS n_agents, count(DISTINCT merchant_id) AS n_merchants,
  max(CASE WHEN tx_type='CARD_TOPUP' AND status='SUCCESS' THEN epoch_us(timestamp) END) AS last_topup_us,
  max_by(amount_usd, timestamp) FILTER (WHERE tx_type='CARD_TOPUP' AND status='SUCCESS') AS last_topup_amt,
  round(sum(ln(1+amount_usd)), 4) AS log_amt_sum, round(sum(ln(1+amount_usd)*ln(1+amount_usd)), 4) AS log_amt_sq,
  round(sum(amount_usd), 4) AS amt_sum, round(sum(sin(2*pi()*hour(timestamp)/24)), 4) + 0 AS hour_sin_sum,
  round(sum(cos(2*pi()*hour(timestamp)/24)), 4) + 0 AS hour_cos_sum
FROM tx WHERE timestamp < TIMESTAMP '{UNTIL}' GROUP BY user_id""")


def f4_links(spark, d):
    return sn.profile_links(transactions(spark, d), until=UNTIL)


F4_LINKS_SQL = duck(f"""
SELECT user_id, kind, entity, count(*) AS uses, min(epoch_us(timestamp)) AS first_us, max(epoch_us(timestamp)) AS last_us
FROM (SELECT user_id, timestamp, 'D' AS kind, device_id AS entity FROM tx UNION ALL
      SELECT user_id, timestamp, 'P', location_province FROM tx UNION ALL
      SELECT user_id, timestamp, 'C', counterparty_id FROM tx WHERE tx_type IN ('P2P_SEND','P2P_RECEIVE') UNION ALL
      SELECT user_id, timestamp, 'A', agent_id FROM tx UNION ALL
      SELECT user_id, timestamp, 'M', merchant_id FROM tx)
WHERE entity IS NOT NULL AND timestamp < TIMESTAMP '{UNTIL}' GROUP BY user_id, kind, entity""")


def f5(spark, d):
    return sn.entity_snapshot(transactions(spark, d), until=UNTIL)


F5_SQL = duck(f"""
WITH l AS (SELECT user_id, timestamp, 'D' AS kind, device_id AS entity FROM tx UNION ALL
      SELECT user_id, timestamp, 'C', counterparty_id FROM tx WHERE tx_type IN ('P2P_SEND','P2P_RECEIVE') UNION ALL
      SELECT user_id, timestamp, 'A', agent_id FROM tx),
g AS (SELECT kind, entity, user_id, max(epoch_us(timestamp)) AS last_us FROM l
      WHERE entity IS NOT NULL AND timestamp < TIMESTAMP '{UNTIL}' GROUP BY ALL),
m AS (SELECT *, max(last_us) OVER (PARTITION BY kind, entity) AS top FROM g)
SELECT kind, entity, user_id, last_us FROM m WHERE kind <> 'A' OR last_us >= top - 86400000000""")


def f7(spark, d):
    df = features(spark, d)
    a = df.select("transaction_id", F.col("amount_zscore_user").alias("score"))
    b = df.select("transaction_id", F.round("amount_zscore_user", 2).alias("score"))
    r = sn.parity_check(a, b, tolerance=1e-4)
    return r.select("n", F.round("max_gap", 6).alias("max_gap"), F.round("mean_gap", 6).alias("mean_gap"), "ok")


F7_SQL = feats_sql("""SELECT count(*) AS n, round(max(abs(amount_zscore_user - round(amount_zscore_user, 2))), 6) AS max_gap,
 round(avg(abs(amount_zscore_user - round(amount_zscore_user, 2))), 6) AS mean_gap,
 max(abs(amount_zscore_user - round(amount_zscore_user, 2))) < 1e-4 AS ok FROM feats""")


def f8(spark, d):
    """Arrival order differs from event time: gaps against the arrival order never go below zero."""
    tx = transactions(spark, d).withColumn("arrival", F.expr("event_id + CASE WHEN event_id % 10 = 0 THEN 25 ELSE 0 END"))
    g = sn.arrival_gaps(tx, arrival="arrival")
    return g.select("transaction_id", *rounded(g, ["log_secs_since_last_tx", "log_history_days"]), "late")


F8_SQL = duck("""
WITH a AS (SELECT *, event_id + CASE WHEN event_id % 10 = 0 THEN 25 ELSE 0 END AS arrival, epoch_us(timestamp) AS us FROM tx),
w AS (SELECT *, lag(us) OVER o AS prev, first_value(us) OVER o AS first_us, row_number() OVER o AS rn,
             max(us) OVER (PARTITION BY user_id ORDER BY arrival, transaction_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top
      FROM a WINDOW o AS (PARTITION BY user_id ORDER BY arrival, transaction_id))
SELECT transaction_id, round(ln(1 + CASE WHEN prev IS NULL THEN 30*86400 ELSE greatest(us - prev, 0) / 1e6 END) + 1e-9, 6) AS log_secs_since_last_tx,
 round(CASE WHEN rn = 1 THEN 0 ELSE ln(1 + greatest(us - first_us, 0) / 86400e6) END + 1e-9, 6) AS log_history_days,
 coalesce(us < top, false) AS late FROM w""")


def f9(spark, d):
    """Replay with recorded decisions: half of the rows have no status, those above an amount were blocked."""
    tx = transactions(spark, d).withColumn("status", F.expr("CASE WHEN event_id % 2 = 0 THEN status END"))
    decisions = tx.select("transaction_id", F.when(F.col("amount_usd") > 150, "BLOCK").otherwise("APPROVE").alias("action"))
    df = ft.build_features(sn.apply_decisions(tx, decisions), profiles(spark, d), precise=True)
    return df.select("transaction_id", *rounded(df, ["failed_count_24h"]))


F9_SQL = duck("""
SELECT transaction_id, CAST(count(*) FILTER (WHERE f) OVER (PARTITION BY user_id ORDER BY timestamp
   RANGE BETWEEN INTERVAL 24 HOURS PRECEDING AND CURRENT ROW) - f::INT AS DOUBLE) AS failed_count_24h
FROM (SELECT *, CASE WHEN event_id % 2 = 0 THEN status <> 'SUCCESS' ELSE amount_usd > 150 END AS f FROM tx)""")


def build() -> dict:
    out = {"f1_build_features": (f1, feats_sql(
        "SELECT transaction_id, user_id, channel, tx_type, amount_usd, is_fraud, fraud_type, known_user, "
        + _select(ft.FEATURE_NAMES) + " FROM feats"))}
    for g in ft.FEATURE_GROUPS:
        out[f"f2_features_{g}"] = _group(g)
    out["f2_absent_values"] = (f2_nulls, F2_NULLS_SQL)
    out |= {"f3_unknown_user": (f3, F3_SQL), "f4_profile_snapshot": (f4, F4_SQL),
            "f4_profile_links": (f4_links, F4_LINKS_SQL), "f5_entity_snapshot": (f5, F5_SQL),
            "f7_parity_check": (f7, F7_SQL), "f8_late_rows": (f8, F8_SQL),
            "f9_blocked_counts_as_failed": (f9, F9_SQL)}
    return out
