"""Reports (Q*), data quality (V*) and labels (R*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_queries import _select, features, feats_sql, rounded
from checks.model_queries import SPLIT, split_sql
from checks.scored import DECIDING, THRESHOLD, fact, scored_sql, stored_fact
from checks.tables import duck, profiles, transactions
from paywarden.operators import labels as lb
from paywarden.operators import quality as qa
from paywarden.operators import reports as rp
from paywarden.operators import split as sp
from paywarden.operators.features import FEATURE_NAMES, build_features
from paywarden.session import materialise

NOW = "2024-01-31 00:00:00"
WEEK = 7 * 1440
SINCE = f"scored_at >= TIMESTAMP '{NOW}' - INTERVAL {WEEK} MINUTES"
CASES = """
cases AS (SELECT transaction_id, tx_time, user_id, channel, tx_type, amount_usd, fraud_probability, risk_level, action,
   CASE event_id % 4 WHEN 0 THEN 'OUVERT' WHEN 1 THEN 'EN_COURS' WHEN 2 THEN 'FRAUDE_CONFIRMEE' ELSE 'FAUX_POSITIF' END AS status,
   event_id AS case_id FROM scored WHERE action <> 'APPROVE')
"""


def cases_sql(body: str) -> str:
    return scored_sql(body, CASES.strip())


def case_table(df):
    status = (F.when(F.col("event_id") % 4 == 0, "OUVERT").when(F.col("event_id") % 4 == 1, "EN_COURS")
              .when(F.col("event_id") % 4 == 2, "FRAUDE_CONFIRMEE").otherwise("FAUX_POSITIF"))
    return df.filter("action <> 'APPROVE'").select(
        "transaction_id", "tx_time", "user_id", "channel", "tx_type", "amount_usd", "fraud_probability", "risk_level",
        "action", status.alias("status"), F.col("event_id").alias("case_id"))


def _as_text(name: str):
    """A map as text: key=value pairs in key order."""
    pairs = F.transform(F.array_sort(F.map_entries(name)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string")))
    return F.concat_ws("|", pairs).alias(name)


COUNTS = "(SELECT string_agg(concat(status, '=', n), '|' ORDER BY status) FROM (SELECT status, count(*) AS n FROM cases GROUP BY status))"


def q1(spark, d):
    f = stored_fact(spark, d, "scored_at", "action", "amount_usd", "latency_ms", "degraded", "event_id", "transaction_id", "tx_time", "user_id",
                    "channel", "tx_type", "fraud_probability", "risk_level")
    k = rp.kpis(f, NOW, WEEK, cases=case_table(f))
    return k.select("volume", _as_text("cases"), "approved", "verified", "blocked", "degraded", "window_minutes",
                    *rounded(k, ["amount_usd", "amount_blocked_usd", "amount_verified_usd"], 2),
                    *rounded(k, ["latency_avg_ms", "latency_p95_ms", "alert_rate"], 4))


Q1_SQL = cases_sql(f"""
SELECT count(*) AS volume, {COUNTS} AS cases, count(*) FILTER (WHERE action = 'APPROVE') AS approved, count(*) FILTER (WHERE action = 'VERIFY') AS verified,
 count(*) FILTER (WHERE action = 'BLOCK') AS blocked, count(*) FILTER (WHERE degraded) AS degraded, {WEEK} AS window_minutes,
 round(coalesce(sum(amount_usd), 0) + 1e-9, 2) AS amount_usd, round(coalesce(sum(amount_usd) FILTER (WHERE action = 'BLOCK'), 0) + 1e-9, 2) AS amount_blocked_usd,
 round(coalesce(sum(amount_usd) FILTER (WHERE action = 'VERIFY'), 0) + 1e-9, 2) AS amount_verified_usd, round(avg(latency_ms) + 1e-9, 4) AS latency_avg_ms,
 round(quantile_cont(latency_ms, 0.95) + 1e-9, 4) AS latency_p95_ms, round(count(*) FILTER (WHERE action <> 'APPROVE') / count(*) + 1e-9, 4) AS alert_rate
FROM scored WHERE {SINCE}""")


def q2(spark, d):
    return rp.cases_by_status(case_table(fact(spark, d)))


def q3(spark, d):
    r = rp.timeseries(fact(spark, d), NOW, WEEK, 3600)
    return r.select(F.date_format("bucket", "yyyy-MM-dd HH:mm").alias("bucket"), "volume", "verified", "blocked",
                    *rounded(r, ["avg_probability", "latency_avg_ms"], 5))


Q3_SQL = scored_sql(f"""
SELECT strftime(time_bucket(INTERVAL 3600 SECONDS, scored_at), '%Y-%m-%d %H:%M') AS bucket, count(*) AS volume,
 count(*) FILTER (WHERE action = 'VERIFY') AS verified, count(*) FILTER (WHERE action = 'BLOCK') AS blocked,
 round(avg(p) + 1e-9, 5) AS avg_probability, round(avg(latency_ms) + 1e-9, 5) AS latency_avg_ms
FROM scored WHERE {SINCE} GROUP BY 1""")


def _breakdown(dimension):
    def run(spark, d):
        r = rp.breakdown(fact(spark, d), dimension, NOW, WEEK)
        return r.select("key", "volume", "alerts", "blocked", *rounded(r, ["avg_probability"], 5),
                        *rounded(r, ["amount_blocked_usd"], 2))
    return run, scored_sql(f"""
SELECT coalesce({dimension}, 'N/A') AS key, count(*) AS volume, count(*) FILTER (WHERE action <> 'APPROVE') AS alerts,
 count(*) FILTER (WHERE action = 'BLOCK') AS blocked, round(avg(p) + 1e-9, 5) AS avg_probability,
 round(coalesce(sum(amount_usd) FILTER (WHERE action = 'BLOCK'), 0) + 1e-9, 2) AS amount_blocked_usd
FROM scored WHERE {SINCE} GROUP BY 1""")


def q5(spark, d):
    r = rp.model_performance(fact(spark, d))
    return r.select("action", "risk_level", "confirmed_fraud", "false_positive", "labeled",
                    F.round(F.col("observed_precision") + 1e-9, 6).alias("observed_precision"))


Q5_SQL = scored_sql("""
SELECT action, risk_level, count(*) FILTER (WHERE label = 1) AS confirmed_fraud, count(*) FILTER (WHERE label = 0) AS false_positive,
 count(*) AS labeled, CASE WHEN action IS NULL THEN round(count(*) FILTER (WHERE label = 1) / count(*) + 1e-9, 6) END AS observed_precision
FROM scored WHERE label IS NOT NULL GROUP BY GROUPING SETS ((action, risk_level), ())""")


def q6(spark, d):
    r = rp.top_risky_users(fact(spark, d), NOW, WEEK, 10)
    return r.select("user_id", "alerts", *rounded(r, ["max_probability"], 6), *rounded(r, ["amount_usd"], 2))


Q6_SQL = scored_sql(f"""
SELECT user_id, count(*) AS alerts, round(max(p) + 1e-9, 6) AS max_probability, round(sum(amount_usd) + 1e-9, 2) AS amount_usd
FROM scored WHERE action <> 'APPROVE' AND {SINCE} GROUP BY user_id ORDER BY alerts DESC, max(p) DESC, user_id LIMIT 10""")


def q7(spark, d):
    r = rp.list_transactions(stored_fact(spark, d, *rp.SUMMARY), page=2, size=50, channel="MOBILE_MONEY", alerts_only=True,
                             min_probability=0.05, labeled=True)
    return r.select("transaction_id", "user_id", "action", "risk_level", "reason", "label", "total")


Q7_SQL = scored_sql("""
SELECT transaction_id, user_id, action, risk_level, reason, label, count(*) OVER () AS total FROM scored
WHERE channel = 'MOBILE_MONEY' AND action <> 'APPROVE' AND p >= 0.05 AND label IS NOT NULL
ORDER BY scored_at DESC, transaction_id LIMIT 50 OFFSET 50""")


def q8(spark, d):
    r = rp.get_transaction(fact(spark, d), "TX000000000123")
    return r.select("transaction_id", "user_id", "amount_usd", "action", "reason",
                    F.concat_ws("|", "rules_triggered").alias("rules_triggered"), *rounded(r, ["fraud_probability", "log_amount_usd"]))


Q8_SQL = scored_sql("""SELECT transaction_id, user_id, amount_usd, action, reason, array_to_string(rules, '|') AS rules_triggered,
 round(p + 1e-9, 6) AS fraud_probability, round(log_amount_usd + 1e-9, 6) AS log_amount_usd FROM scored WHERE transaction_id = 'TX000000000123'""")


def q9(spark, d):
    return rp.user_history(fact(spark, d), "U8", 30).select("transaction_id", "tx_type", "amount_usd", "action")


def q10(spark, d):
    r = rp.case_queue(case_table(stored_fact(spark, d, "event_id", "transaction_id", "tx_time", "user_id", "channel", "tx_type", "amount_usd", "fraud_probability", "risk_level", "action")), page=1, size=50)
    return r.select("transaction_id", "status", "risk_level", "amount_usd", "total", _as_text("counts"))


Q10_SQL = cases_sql(f"""SELECT transaction_id, status, risk_level, amount_usd, count(*) OVER () AS total, {COUNTS} AS counts FROM cases
 ORDER BY status <> 'OUVERT', list_position(['CRITIQUE','ELEVE','MOYEN','FAIBLE'], risk_level), amount_usd DESC, transaction_id LIMIT 50""")


def q11(spark, d):
    r = rp.alert_rate_by_type(fact(spark, d), NOW, WEEK)
    return r.select("tx_type", "volume", "verified", "blocked", "approved", *rounded(r, ["alert_rate"]))


Q11_SQL = scored_sql(f"""SELECT tx_type, count(*) AS volume, count(*) FILTER (WHERE action = 'VERIFY') AS verified,
 count(*) FILTER (WHERE action = 'BLOCK') AS blocked, count(*) FILTER (WHERE action = 'APPROVE') AS approved,
 round(count(*) FILTER (WHERE action <> 'APPROVE') / count(*) + 1e-9, 6) AS alert_rate FROM scored WHERE {SINCE} GROUP BY tx_type""")


def q13(spark, d):
    tx = transactions(spark, d).withColumn(
        "fraud_episode_id", F.when(F.col("is_fraud") == 1, F.concat(F.lit("EP"), F.expr("event_id DIV 500"))))
    r = rp.dataset_profile(tx)
    return r.select("measure", "key", F.round(F.col("value") + 1e-9, 5).alias("value"))


def _unpivot_sql(source: str, key: str, **measures: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{n}' AS measure, {key} AS key, round(CAST({e} AS DOUBLE) + 1e-9, 5) AS value FROM {source} GROUP BY ALL"
        for n, e in measures.items())


Q13_SQL = duck(" UNION ALL ".join([
    _unpivot_sql("tx", "'all'", n_transactions="count(*)", fraud_rate="round(avg(is_fraud), 5)",
                 failure_rate_legit="round(avg((status <> 'SUCCESS')::INT) FILTER (WHERE is_fraud = 0), 5)",
                 failure_rate_fraud="round(avg((status <> 'SUCCESS')::INT) FILTER (WHERE is_fraud = 1), 5)",
                 first_us="min(epoch_us(timestamp))", last_us="max(epoch_us(timestamp))"),
    _unpivot_sql("tx", "channel", channel_n="count(*)", channel_fraud_rate="round(avg(is_fraud), 5)"),
    _unpivot_sql("(SELECT * FROM tx WHERE is_fraud = 1)", "fraud_type", frauds="count(*)", episodes="count(DISTINCT event_id // 500)"),
    _unpivot_sql("tx", "tx_type", operations="count(*)")]))


# --- data quality -----------------------------------------------------------------------------------
def _dirty(spark, d):
    """Transactions with planted faults: repeated ids, negative balances, failed rows that moved money."""
    tx = transactions(spark, d).withColumns({
        "transaction_id": F.expr("CASE WHEN event_id % 97 = 1 THEN 'TXDUP' || CAST(event_id DIV 970 AS string) ELSE transaction_id END"),
        "balance_before_usd": F.expr("CASE WHEN event_id % 89 = 0 THEN -1.0D ELSE balance_before_usd END"),
        "amount_usd": F.expr("CASE WHEN event_id % 83 = 0 THEN 0.0D ELSE amount_usd END")})
    return tx.withColumn("balance_after_usd", F.expr(
        "CASE WHEN status <> 'SUCCESS' AND event_id % 2 = 0 THEN balance_before_usd ELSE balance_before_usd - amount_usd END"))


DIRTY = """
dirty0 AS (SELECT * REPLACE (CASE WHEN event_id % 97 = 1 THEN 'TXDUP' || CAST(event_id // 970 AS VARCHAR) ELSE transaction_id END AS transaction_id,
    CASE WHEN event_id % 89 = 0 THEN -1.0e0 ELSE balance_before_usd END AS balance_before_usd, CASE WHEN event_id % 83 = 0 THEN 0.0e0 ELSE amount_usd END AS amount_usd) FROM tx),
dirty AS (SELECT *, CASE WHEN status <> 'SUCCESS' AND event_id % 2 = 0 THEN balance_before_usd ELSE balance_before_usd - amount_usd END AS balance_after_usd FROM dirty0)
"""


def dirty_sql(body: str) -> str:
    return duck(f"WITH {DIRTY.strip()}\n{body}", profile=True)


def v1(spark, d):
    return qa.duplicate_ids(_dirty(spark, d))


def v2(spark, d):
    return qa.inside_period(transactions(spark, d), "2024-01-02 00:00:00", "2024-01-30 00:00:00")


def v3(spark, d):
    r = qa.balance_violations(_dirty(spark, d))
    return r.select("event_id", F.concat_ws("|", "problems").alias("problems"))


V3_SQL = dirty_sql("""SELECT * FROM (SELECT event_id, array_to_string(list_filter([CASE WHEN balance_before_usd < -0.01 THEN 'negative_before' END,
  CASE WHEN balance_after_usd < -0.01 THEN 'negative_after' END,
  CASE WHEN status <> 'SUCCESS' AND abs(balance_before_usd - balance_after_usd) > 1e-5 * abs(balance_after_usd) + 1e-8 THEN 'failed_moved' END,
  CASE WHEN amount_usd <= 0 THEN 'amount_not_positive' END], lambda x: x IS NOT NULL), '|') AS problems FROM dirty) WHERE problems <> ''""")


def v4(spark, d):
    return qa.over_kyc_limit(transactions(spark, d), profiles(spark, d)).select("transaction_id", "amount_usd", "kyc_tx_limit_usd")


def v5(spark, d):
    return qa.identifier_lengths(transactions(spark, d), ["transaction_id", "device_id", "counterparty_id", "merchant_id"])


V5_SQL = duck(" UNION ALL ".join(
    f"""SELECT '{c}' AS "column", count(*) AS lengths, count(*) FILTER (WHERE f AND NOT l) AS fraud_only FROM
    (SELECT length({c}), bool_or(is_fraud = 1) AS f, bool_or(is_fraud = 0) AS l FROM tx WHERE {c} IS NOT NULL GROUP BY 1)"""
    for c in ["transaction_id", "device_id", "counterparty_id", "merchant_id"]))


def v6(spark, d):
    return qa.not_finite(features(spark, d))


V6_SQL = feats_sql(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, count(*) FILTER (WHERE {n} IS NULL OR NOT isfinite(CAST({n} AS DOUBLE))) AS not_finite FROM feats" for n in FEATURE_NAMES))


def v7(spark, d):
    tx, users = transactions(spark, d), profiles(spark, d)
    leaks = qa.future_leaks(tx, users, "2024-01-20 00:00:00", "2024-01-01 00:00:00", precise=True)
    checked = tx.filter("timestamp < TIMESTAMP_NTZ '2024-01-20 00:00:00'").agg(F.count("*")).scalar()
    return leaks.agg(F.count("*").alias("leaks")).withColumn("checked", F.lit(0) + checked)


# the features of the rows before the cutoff, from all rows and from these alone
_V7 = feats_sql("SELECT transaction_id, " + _select(FEATURE_NAMES) + " FROM feats WHERE timestamp < TIMESTAMP '2024-01-20'")
_V7_ALONE = _V7.replace("FROM tx LEFT JOIN profile p", "FROM (SELECT * FROM tx WHERE timestamp < TIMESTAMP '2024-01-20') tx LEFT JOIN profile p")
V7_SQL = f"""SELECT count(*) AS checked, count(*) FILTER (WHERE {' OR '.join(f'a.{n} IS DISTINCT FROM b.{n}' for n in FEATURE_NAMES)}) AS leaks
FROM ({_V7}) a FULL JOIN ({_V7_ALONE}) b USING (transaction_id)"""


def v7_prefix(spark, d):
    """Features of the rows before a cutoff, computed from those rows alone."""
    tx = transactions(spark, d).filter("timestamp < TIMESTAMP_NTZ '2024-01-20 00:00:00'")
    df = build_features(tx, profiles(spark, d), precise=True)
    return df.select("transaction_id", *rounded(df, FEATURE_NAMES))


def v9(spark, d):
    tx = transactions(spark, d)
    return tx.select("transaction_id", F.round(qa.round_amount(F.col("amount_usd"), F.col("currency"), F.col("tx_type")), 6).alias("amount_usd"))


V9_SQL = duck("""SELECT transaction_id, round(CASE WHEN tx_type = 'CARD_PURCHASE' THEN amount_usd
  WHEN currency = 'CDF' THEN greatest(step, round_even(amount_usd * 2850.0e0 / step, 0) * step) / 2850.0e0
  WHEN amount_usd >= 5 THEN round_even(amount_usd, 0) ELSE greatest(0.5, round_even(amount_usd * 2, 0) / 2) END, 6) AS amount_usd
FROM (SELECT *, CASE WHEN tx_type = 'AIRTIME' THEN 100 ELSE 500 END AS step FROM tx)""")


def v10(spark, d):
    return transactions(spark, d).select("transaction_id", qa.display_amount(F.col("amount_usd"), F.col("currency")).alias("amount"))


V10_SQL = duck("SELECT transaction_id, CASE WHEN currency = 'CDF' THEN round_even(amount_usd * 2850.0e0, 0) ELSE amount_usd END AS amount FROM tx")


def v11(spark, d):
    tx = transactions(spark, d).join(profiles(spark, d), "user_id")
    return tx.select("transaction_id", F.round(qa.clip_to_limit(F.col("amount_usd"), F.col("kyc_tx_limit_usd")), 6).alias("amount_usd"))


V11_SQL = duck("SELECT transaction_id, round(least(greatest(amount_usd, 0.2e0), kyc_tx_limit_usd * 0.95e0), 6) AS amount_usd FROM tx JOIN profile USING (user_id)", profile=True)


# --- labels -----------------------------------------------------------------------------------------
R1 = """
rl AS (SELECT *, coalesce(label, CASE WHEN epoch_us(tx_time) <= (SELECT max(epoch_us(tx_time)) FROM scored) - 7*86400000000 THEN 0 END) AS y FROM scored),
r1 AS (SELECT * FROM rl WHERE y IS NOT NULL),
r2 AS (SELECT *, row_number() OVER (ORDER BY tx_time, transaction_id) / count(*) OVER () AS q FROM r1),
prod AS (SELECT *, CASE WHEN q <= 0.5 THEN 'fit' WHEN q <= 0.7 THEN 'val' ELSE 'eval' END AS part FROM r2)
"""


def labels_sql(body: str) -> str:
    return scored_sql(body, R1.strip())


def r1(spark, d):
    return lb.resolve_labels(stored_fact(spark, d, "transaction_id", "tx_time", "label")).select("transaction_id", "y")


def r2(spark, d):
    return lb.production_split(lb.resolve_labels(stored_fact(spark, d, "transaction_id", "tx_time", "label"))).select("transaction_id", "part")


def r3(spark, d):
    tx = transactions(spark, d)
    return lb.history_split(tx, sp.split_bounds(tx)).select("transaction_id", "part")


R3_SQL = split_sql("SELECT transaction_id, CASE split WHEN 0 THEN 'fit' WHEN 1 THEN 'early_stop' ELSE 'val' END AS part FROM sp WHERE split < 3")


def r4(spark, d):
    """History = the first slices; production = the rest, its features read back from the stored map."""
    names = ["log_amount_usd", "tx_count_24h", "is_night", "absent_feature"]
    f = materialise(fact(spark, d), "fact").withColumn("features", F.map_from_arrays(
        F.array(*[F.lit(n) for n in names[:3]]), F.array(*[F.col(n) for n in names[:3]])))
    bounds = sp.split_bounds(f)
    hist = lb.history_split(f, bounds).withColumns({"y": F.col("is_fraud"), "absent_feature": F.lit(0.0)})
    later = f.join(hist.select("transaction_id"), "transaction_id", "left_anti").drop(*names[:3])
    prod = lb.production_split(lb.resolve_labels(later)).withColumn("champion_proba", F.col("fraud_probability"))
    table = lb.training_table(hist, lb.features_from_map(prod, names), names)
    return table.groupBy("part").agg(F.count("*").alias("n"), F.sum("y").alias("frauds"),
                                     F.count("champion_proba").alias("with_champion"),
                                     F.round(F.sum("log_amount_usd"), 3).alias("log_amount_usd"),
                                     F.sum("absent_feature").alias("absent_feature"))


R4_SQL = scored_sql("""
SELECT part, count(*) AS n, CAST(sum(y) AS BIGINT) AS frauds, count(cp) AS with_champion, round(sum(log_amount_usd), 3) AS log_amount_usd, 0.0e0 AS absent_feature FROM (
  SELECT CASE split WHEN 0 THEN 'fit' WHEN 1 THEN 'early_stop' ELSE 'val' END AS part, is_fraud AS y, NULL AS cp, log_amount_usd FROM sj WHERE split < 3
  UNION ALL
  SELECT CASE WHEN q <= 0.5 THEN 'fit' WHEN q <= 0.7 THEN 'val' ELSE 'eval' END, y, p, log_amount_usd FROM (
    SELECT *, row_number() OVER (ORDER BY tx_time, transaction_id) / count(*) OVER () AS q FROM (
      SELECT *, coalesce(label, CASE WHEN epoch_us(tx_time) <= (SELECT max(epoch_us(tx_time)) FROM sj) - 7*86400000000 THEN 0 END) AS y
      FROM sj WHERE split = 3) WHERE y IS NOT NULL)) GROUP BY part""", SPLIT.strip() + ",\nsj AS (SELECT scored.*, sp.split FROM scored JOIN sp USING (transaction_id))")


def r5(spark, d):
    return lb.enough_labels(lb.resolve_labels(stored_fact(spark, d, "transaction_id", "tx_time", "label")))


R5_SQL = labels_sql("SELECT count(*) AS n_labeled, CAST(sum(y) AS BIGINT) AS n_frauds, count(*) >= 2000 AND sum(y) >= 30 AS go FROM r1")


def _evaluation(spark, d):
    stored = stored_fact(spark, d, "transaction_id", "tx_time", "label", "fraud_probability", "amount_zscore_user")
    prod = materialise(lb.production_split(lb.resolve_labels(stored)).select(
        "transaction_id", "part", "y", F.round("fraud_probability", 6).alias("champion_proba"),
        F.round(F.col("amount_zscore_user") + 1e-9, 6).alias("challenger_proba")), "evaluation")
    return prod.filter("part = 'eval'")


def r6(spark, d):
    return lb.champion_vs_challenger(_evaluation(spark, d), THRESHOLD, 1.5).select(
        "model", "n", "n_fraud", "pr_auc", "roc_auc", "recall", "precision", "f1")


def _metrics(column: str, threshold: float, model: str) -> str:
    return f"""SELECT '{model}' AS model, CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_fraud, round(sum(pos / ap_ * tp / (tp + fp)), 4) AS pr_auc,
  round(sum(neg * (tp - pos / 2) / ap_ / an_), 4) AS roc_auc, round(coalesce(sum(pos) FILTER (WHERE s >= {threshold}), 0) / sum(pos), 4) AS recall,
  round(coalesce(sum(pos) FILTER (WHERE s >= {threshold}) / sum(pos + neg) FILTER (WHERE s >= {threshold}), 0), 4) AS precision,
  round(coalesce(2 * sum(pos) FILTER (WHERE s >= {threshold}) / (sum(pos + neg) FILTER (WHERE s >= {threshold}) + sum(pos)), 0), 4) AS f1
 FROM (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS ap_, sum(neg) OVER () AS an_ FROM
   (SELECT {column} AS s, sum(y) AS pos, sum(1 - y) AS neg FROM prod WHERE part = 'eval' GROUP BY 1) WINDOW w AS (ORDER BY s DESC))"""


R6_BODY = _metrics("round(p, 6)", 0.3, "champion") + " UNION ALL " + _metrics("round(amount_zscore_user + 1e-9, 6)", 1.5, "challenger")
R6_SQL = labels_sql(R6_BODY)


def r7(spark, d):
    return lb.promotion(lb.champion_vs_challenger(_evaluation(spark, d), THRESHOLD, 1.5))


R7_SQL = labels_sql(f"""SELECT better, CASE WHEN better THEN 'CHAMPION' ELSE 'REJETE' END AS status FROM (SELECT
  max(pr_auc) FILTER (WHERE model = 'challenger') >= max(pr_auc) FILTER (WHERE model = 'champion') + 0.002e0
  AND max(recall) FILTER (WHERE model = 'challenger') >= max(recall) FILTER (WHERE model = 'champion') - 0.01e0 AS better FROM ({R6_BODY}))""")


def _registry(spark, d):
    """One model per calendar week of the data; the newest is the champion."""
    weeks = transactions(spark, d).groupBy(F.date_trunc("week", "timestamp").alias("w")).agg(F.count("*").alias("n"))
    newest = weeks.agg(F.max("w")).scalar()
    return weeks.select(F.date_format("w", "yyyy-MM-dd").alias("version"),
                        F.when(F.col("w") == newest, "CHAMPION").otherwise("ARCHIVE").alias("status"),
                        F.col("w").cast("timestamp_ntz").alias("created_at"))


REGISTRY = """
wk AS (SELECT date_trunc('week', timestamp) AS w, count(*) AS n FROM tx GROUP BY 1),
registry AS (SELECT strftime(w, '%Y-%m-%d') AS version, CASE WHEN w = (SELECT max(w) FROM wk) THEN 'CHAMPION' ELSE 'ARCHIVE' END AS status, CAST(w AS TIMESTAMP) AS created_at FROM wk)
"""


def r8(spark, d):
    reg = _registry(spark, d)
    entry = transactions(spark, d).agg(F.lit("next").alias("version"), F.lit("CHAMPION").alias("status"),
                                       F.max("timestamp").alias("created_at"))
    return lb.register(reg, entry).select("version", "status")


R8_SQL = duck(f"WITH {REGISTRY.strip()} SELECT version, CASE WHEN status = 'CHAMPION' THEN 'ARCHIVE' ELSE status END AS status FROM registry UNION ALL SELECT 'next', 'CHAMPION'")


def r9(spark, d):
    t = lb.retrain_trigger(fact(spark, d), _registry(spark, d), "2024-02-20 00:00:00", drift_alarm=True)
    return t.select("new_labels", F.round("age_h", 3).alias("age_h"), F.concat_ws("|", "reasons").alias("reasons"), "retrain")


R9_SQL = scored_sql("""
SELECT n AS new_labels, round(age_h, 3) AS age_h, concat_ws('|', CASE WHEN n >= 500 THEN concat(n, ' nouvelles étiquettes') END, 'dérive détectée',
  CASE WHEN age_h > 168 THEN concat('modèle vieux de ', CAST(round_even(age_h, 0) AS BIGINT), ' h') END) AS reasons, true AS retrain
FROM (SELECT count(*) FILTER (WHERE label IS NOT NULL AND labeled_at > (SELECT max(created_at) FROM registry)) AS n,
  (epoch_us(TIMESTAMP '2024-02-20 00:00:00') - (SELECT max(epoch_us(created_at)) FROM registry)) / 3600e6 AS age_h FROM scored)""", REGISTRY.strip())


def _feedback(df):
    """Two verdicts on every alert with event_id % 5 = 0, the later one counts."""
    hits = df.filter("action <> 'APPROVE' AND event_id % 5 = 0")
    twice = hits.select("transaction_id", "event_id", "tx_time", F.explode(F.array(F.lit(0), F.lit(1))).alias("turn"))
    return twice.select(
        F.concat_ws("-", "transaction_id", "turn").alias("event_id"),
        F.expr("tx_time + make_dt_interval(turn + 1)").alias("ts"), "transaction_id",
        ((F.col("event_id") + F.col("turn")) % 2).cast("int").alias("label"), F.lit("ana@x").alias("analyst"),
        F.col("event_id").alias("case_id"))


def r10(spark, d):
    f = materialise(fact(spark, d, DECIDING).select("transaction_id", "event_id", "tx_time", "action", "label", "labeled_at"), "fact")
    r = lb.apply_verdicts(f, _feedback(f))
    return r.select("transaction_id", "label", F.unix_micros(F.col("labeled_at").cast("timestamp")).alias("labeled_us"))


R10_SQL = scored_sql("""SELECT transaction_id, CASE WHEN hit THEN (event_id + 1) % 2 ELSE label END AS label,
  epoch_us(CASE WHEN hit THEN tx_time + INTERVAL 2 DAYS ELSE labeled_at END) AS labeled_us
FROM (SELECT *, action <> 'APPROVE' AND event_id % 5 = 0 AS hit FROM scored)""")


def _complaints(df):
    rows = df.filter("event_id % 6 = 0").select("transaction_id", "event_id", "tx_time",
                                               F.explode(F.sequence(F.lit(0), F.lit(1))).alias("turn"))
    return rows.select(
        F.concat_ws("-", "transaction_id", "turn").alias("complaint_id"),
        F.expr("CASE WHEN event_id % 11 = 0 THEN 'UNKNOWN' || transaction_id ELSE transaction_id END").alias("transaction_id"),
        F.expr("tx_time + make_dt_interval(turn + 3)").alias("ts"),
        F.expr("CASE WHEN event_id % 4 = 0 AND turn = 0 THEN 'x' ELSE 'operation non reconnue' END").alias("note"))


COMPLAINTS = CASES.strip() + """,
cm AS (SELECT concat(transaction_id, '-', turn) AS complaint_id, CASE WHEN event_id % 11 = 0 THEN concat('UNKNOWN', transaction_id) ELSE transaction_id END AS transaction_id,
   tx_time + to_days(CAST(turn + 3 AS INT)) AS ts, CASE WHEN event_id % 4 = 0 AND turn = 0 THEN 'x' ELSE 'operation non reconnue' END AS note
   FROM scored, range(0, 2) t(turn) WHERE event_id % 6 = 0),
jd AS (SELECT *, CASE WHEN length(note) < 5 THEN 'note invalide' WHEN NOT EXISTS (SELECT 1 FROM scored s WHERE s.transaction_id = cm.transaction_id) THEN 'transaction introuvable'
   WHEN EXISTS (SELECT 1 FROM cases c WHERE c.transaction_id = cm.transaction_id AND c.status IN ('FRAUDE_CONFIRMEE','FAUX_POSITIF'))
     OR row_number() OVER (PARTITION BY transaction_id, length(note) >= 5 ORDER BY ts, complaint_id) > 1 THEN 'dossier déjà clos' END AS outcome FROM cm)"""


def _judged(spark, d):
    f = materialise(fact(spark, d, DECIDING).select("transaction_id", "event_id", "tx_time", "user_id", "channel", "tx_type", "amount_usd",
                                          "fraud_probability", "risk_level", "action", "label", "labeled_at"), "fact")
    return f, lb.judge_complaints(_complaints(f), f, case_table(f))


def r11(spark, d):
    return _judged(spark, d)[1].select("complaint_id", "outcome")


def r11_labels(spark, d):
    f, judged = _judged(spark, d)
    return lb.apply_complaints(judged, f).select("transaction_id", "label")


R11_LABELS_SQL = scored_sql("SELECT transaction_id, CASE WHEN transaction_id IN (SELECT transaction_id FROM jd WHERE outcome IS NULL) THEN 1 ELSE label END AS label FROM scored", COMPLAINTS)


def r11_cases(spark, d):
    """Complaints close open cases and open closed ones for transactions without a case."""
    f, judged = _judged(spark, d)
    after = lb.complaint_cases(judged.withColumn("analyst", F.lit("ana@x")), f, case_table(f))
    return after.select("transaction_id", "status", "resolution_note", "resolved_by", "assigned_to", F.col("resolved_at").isNotNull().alias("resolved"), "opened")


R11_CASES_SQL = scored_sql("""SELECT transaction_id, CASE WHEN a.note IS NOT NULL THEN 'FRAUDE_CONFIRMEE' ELSE status END AS status, 'Plainte client : ' || a.note AS resolution_note,
  CASE WHEN a.note IS NOT NULL THEN 'ana@x' END AS resolved_by, CASE WHEN a.note IS NOT NULL THEN 'ana@x' END AS assigned_to, a.note IS NOT NULL AS resolved, c.status IS NULL AS opened
 FROM cases c FULL JOIN (SELECT transaction_id, note FROM jd WHERE outcome IS NULL) a USING (transaction_id)""", COMPLAINTS)


def r11_events(spark, d):
    f, judged = _judged(spark, d)
    feedback, audit = lb.complaint_events(judged.withColumn("analyst", F.lit("ana@x")), f)
    return feedback.select(F.lit("feedback").alias("kind"), "transaction_id", F.col("label").cast("string").alias("value")).union(
        audit.select("action", "entity_id", F.element_at("details", F.lit("decision_modele"))))


R11_EVENTS_SQL = scored_sql("""SELECT 'feedback' AS kind, transaction_id, '1' AS value FROM jd WHERE outcome IS NULL
 UNION ALL SELECT 'PLAINTE_CLIENT', transaction_id, concat('"', action, '"') FROM jd JOIN scored USING (transaction_id) WHERE outcome IS NULL""", COMPLAINTS)


def build() -> dict:
    out = {
        "r11_cases": (r11_cases, R11_CASES_SQL), "r11_events": (r11_events, R11_EVENTS_SQL),
        "q1_kpis": (q1, Q1_SQL), "q2_cases_by_status": (q2, cases_sql("SELECT status, count(*) AS n FROM cases GROUP BY status")),
        "q3_timeseries": (q3, Q3_SQL), "q5_model_performance": (q5, Q5_SQL), "q6_top_risky_users": (q6, Q6_SQL),
        "q7_list_transactions": (q7, Q7_SQL), "q8_get_transaction": (q8, Q8_SQL),
        "q9_user_history": (q9, scored_sql("SELECT transaction_id, tx_type, amount_usd, action FROM scored WHERE user_id = 'U8' ORDER BY tx_time DESC, transaction_id LIMIT 30")),
        "q10_case_queue": (q10, Q10_SQL), "q11_alert_rate_by_type": (q11, Q11_SQL), "q13_dataset_profile": (q13, Q13_SQL),
        "v1_unique_ids": (v1, dirty_sql("SELECT transaction_id, count(*) AS n FROM dirty GROUP BY 1 HAVING count(*) > 1")),
        "v2_inside_period": (v2, duck("SELECT count(*) AS n, count(*) FILTER (WHERE timestamp < TIMESTAMP '2024-01-02' OR timestamp >= TIMESTAMP '2024-01-30') AS outside FROM tx")),
        "v3_balances": (v3, V3_SQL),
        "v4_kyc_limit": (v4, duck("SELECT transaction_id, amount_usd, kyc_tx_limit_usd FROM tx JOIN profile USING (user_id) WHERE amount_usd > kyc_tx_limit_usd + 0.01", profile=True)),
        "v5_identifier_lengths": (v5, V5_SQL), "v6_finite_features": (v6, V6_SQL),
        "v7_no_future_leak": (v7, V7_SQL),
        "v7_prefix_features": (v7_prefix, feats_sql("SELECT transaction_id, " + _select(FEATURE_NAMES) + " FROM feats WHERE timestamp < TIMESTAMP '2024-01-20'")),
        "v9_round_amounts": (v9, V9_SQL), "v10_display_amount": (v10, V10_SQL), "v11_clip_amount": (v11, V11_SQL),
        "r1_resolve_labels": (r1, labels_sql("SELECT transaction_id, y FROM r1")),
        "r2_production_split": (r2, labels_sql("SELECT transaction_id, part FROM prod")), "r3_history_split": (r3, R3_SQL),
        "r4_training_table": (r4, R4_SQL), "r5_label_gate": (r5, R5_SQL), "r6_champion_vs_challenger": (r6, R6_SQL),
        "r7_promotion": (r7, R7_SQL), "r8_registry": (r8, R8_SQL), "r9_retrain_trigger": (r9, R9_SQL),
        "r10_apply_verdicts": (r10, R10_SQL),
        "r11_complaints": (r11, scored_sql("SELECT complaint_id, outcome FROM jd", COMPLAINTS)),
        "r11_complaint_labels": (r11_labels, R11_LABELS_SQL),
    }
    for dimension in rp.DIMENSIONS:
        out[f"q4_breakdown_{dimension}"] = _breakdown(dimension)
    return out
