"""Split, scaling, sequences (P*), rule score (M1), decisions (D*), evaluation (E*), drift (G*)."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_queries import features, feats_sql, rounded
from checks.scored import THRESHOLD, decided, fact, scored_sql, with_probability
from checks.tables import duck, transactions
from paywarden.operators import decision as dc
from paywarden.operators import drift as dr
from paywarden.operators import evaluate as ev
from paywarden.operators import features as ft
from paywarden.operators import split as sp
from paywarden.session import materialise
from paywarden.sources import tables as st

SPLIT = """
bounds AS (SELECT epoch_us(min(timestamp)) AS t0, epoch_us(max(timestamp)) AS t1 FROM tx),
cuts AS (SELECT t0, t1, t0 + CAST(floor((t1 - t0) * 0.595e0) AS BIGINT) AS c1, t0 + CAST(floor((t1 - t0) * 0.7e0) AS BIGINT) AS c2,
                t0 + CAST(floor((t1 - t0) * 0.85e0) AS BIGINT) AS c3 FROM bounds),
sp AS (SELECT tx.*, epoch_us(timestamp) AS us, CASE WHEN us < c1 THEN 0 WHEN us < c2 THEN 1 WHEN us < c3 THEN 2 ELSE 3 END AS split
       FROM tx, cuts)
"""
SCALED = list(ft.FEATURE_NAMES)


def split_sql(body: str) -> str:
    return duck(f"WITH {SPLIT.strip()}\n{body}")


def feats_split_sql(body: str, more: str = "") -> str:
    return feats_sql(body, SPLIT.strip() + ",\nfs AS (SELECT feats.*, sp.split, sp.us FROM feats JOIN sp USING (transaction_id))"
                     + (f",\n{more}" if more else ""))


def p1(spark, d):
    return sp.temporal_split(transactions(spark, d)).select("transaction_id", "split")


def p1_bounds(spark, d):
    return sp.split_bounds(transactions(spark, d))


def p2(spark, d):
    return sp.split_stats(sp.temporal_split(transactions(spark, d)))


def p3(spark, d):
    return sp.class_weights(sp.temporal_split(transactions(spark, d)))


def _scaler(spark, d):
    df = sp.temporal_split(features(spark, d)).select("transaction_id", "user_id", "timestamp", "split", *SCALED)
    df = materialise(df, "features")            # the fit and the scaling read it
    return df, sp.fit_scaler(df.filter("split <= 1"), SCALED)


def p4(spark, d):
    _, scaler = _scaler(spark, d)
    return scaler.select("feature", *rounded(scaler, ["mean", "std"], 5))


P4_SQL = feats_split_sql(" UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(avg({n}) + 1e-9, 5) AS mean, round(CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END + 1e-9, 5) AS std "
    "FROM fs WHERE split <= 1" for n in SCALED))


def p5(spark, d):
    df, scaler = _scaler(spark, d)
    scaled = sp.scale(df, sp.scaler_params(scaler))
    return scaled.select("transaction_id", *[F.round(F.col(n).cast("double") + 1e-5, 3).alias(n) for n in SCALED])


P5_SQL = feats_split_sql(
    "SELECT transaction_id, " + ", ".join(
        f"round(CAST(CAST(greatest(-10, least(10, ({n} - m_{n}) / s_{n})) AS FLOAT) AS DOUBLE) + 1e-5, 3) AS {n}" for n in SCALED)
    + " FROM fs, (SELECT " + ", ".join(
        f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS s_{n}" for n in SCALED) + " FROM fs WHERE split <= 1)")


def p6(spark, d):
    """Scaled, then back: the raw value, where the clip range holds it."""
    df, scaler = _scaler(spark, d)
    params = sp.scaler_params(scaler)
    back = sp.unscale(sp.scale(df, params), params)
    return back.select("transaction_id", *[F.round(F.col(n).cast("double") + 1e-5, 3).alias(n) for n in SCALED])


P6_SQL = feats_split_sql(
    "SELECT transaction_id, " + ", ".join(
        f"round(CAST(CAST(greatest(-10, least(10, ({n} - m_{n}) / s_{n})) AS FLOAT) AS DOUBLE) * s_{n} + m_{n} + 1e-5, 3) AS {n}" for n in SCALED)
    + " FROM fs, (SELECT " + ", ".join(
        f"avg({n}) AS m_{n}, CASE WHEN stddev_pop({n}) > 0 THEN stddev_pop({n}) ELSE 1 END AS s_{n}" for n in SCALED) + " FROM fs WHERE split <= 1)")


def p7(spark, d):
    tx = transactions(spark, d)
    seq = sp.build_sequences(tx, F.col("event_id"), 10)
    return seq.select("transaction_id",
                      F.concat_ws(",", F.transform("sequence", lambda v: F.coalesce(v.cast("string"), F.lit("-")))).alias("sequence"),
                      F.size(F.filter("mask", lambda m: m)).alias("filled"))


P7_SQL = duck("""
SELECT transaction_id, concat(repeat('-,', 10 - CAST(len(ids) AS INT)), array_to_string(ids, ',')) AS sequence, len(ids) AS filled
FROM (SELECT transaction_id, list(event_id) OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id
        ROWS BETWEEN 9 PRECEDING AND CURRENT ROW) AS ids FROM tx)""")


def p8(spark, d):
    """Read by amount of props first, the events are not in time order; the count is exact."""
    tx = transactions(spark, d).withColumn("pos", F.expr("event_id + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END"))
    return sp.time_order_check(tx, ["pos", "event_id"])


P8_SQL = duck("""
WITH p AS (SELECT event_id + CASE WHEN event_id % 7 = 0 THEN 3 ELSE 0 END AS pos, event_id, epoch_us(timestamp) AS us FROM tx),
w AS (SELECT *, max(us) OVER (ORDER BY pos, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM p)
SELECT count(*) AS n, count(*) FILTER (WHERE us < top) AS out_of_order, min(pos) FILTER (WHERE us < top) AS first_offender,
       count(*) FILTER (WHERE us < top) = 0 AS chronological FROM w""")


def m1(spark, d):
    df = with_probability(features(spark, d))
    return df.select("transaction_id", F.col("rule_score").cast("int").alias("rule_score"),
                     F.round("fraud_probability", 6).alias("p"))


M1_SQL = scored_sql("SELECT transaction_id, rule_score, round(p, 6) AS p FROM s1")


def _decided(*cols):
    def run(spark, d):
        df = decided(spark, d)
        return df.select("transaction_id", *[F.expr(c) for c in cols])
    return run


def d6(spark, d):
    df = decided(spark, d)
    return df.select("transaction_id", F.round("fraud_probability", 6).alias("fraud_probability"),
                     (F.col("fraud_probability") >= THRESHOLD).alias("is_fraud_predicted"), "action", "risk_level",
                     "reason", F.concat_ws("|", "rules_triggered").alias("rules_triggered"), "known_user",
                     *rounded(df, ["cost_approve", "cost_verify", "cost_block"], 3))


D6_SQL = scored_sql("""SELECT transaction_id, round(p, 6) AS fraud_probability, p >= 0.3 AS is_fraud_predicted, action,
 risk_level, reason, array_to_string(rules, '|') AS rules_triggered, known_user, round(round(ca, 4) + 1e-9, 3) AS cost_approve,
 round(round(cv, 4) + 1e-9, 3) AS cost_verify, round(round(cb, 4) + 1e-9, 3) AS cost_block FROM scored""")


def d7(spark, d):
    return dc.business_metric(decided(spark, d))


D7_SQL = scored_sql("""SELECT count(*) FILTER (WHERE is_fraud = 1 AND action <> 'APPROVE') AS frauds_stopped,
 count(*) FILTER (WHERE is_fraud = 1) AS frauds, count(*) FILTER (WHERE is_fraud = 0 AND action = 'BLOCK') AS honest_blocked FROM scored""")


# --- evaluation: the amount z-score has many distinct values, the rule score has ties ---------------
def _scores(spark, d):
    df = features(spark, d)
    return df.select("transaction_id", "channel", "fraud_type", F.col("is_fraud").alias("y"),
                     F.round(F.col("amount_zscore_user") + 1e-9, 6).alias("score"))


EVAL = """
ys AS (SELECT transaction_id, channel, fraud_type, is_fraud AS y, round(amount_zscore_user + 1e-9, 6) AS score FROM feats),
g AS (SELECT score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM ys GROUP BY score),
cv AS (SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER () AS all_pos, sum(neg) OVER () AS all_neg
       FROM g WINDOW w AS (ORDER BY threshold DESC)),
curve AS (SELECT *, tp / (tp + fp) AS precision, tp / all_pos AS recall FROM cv)
"""


def eval_sql(body: str) -> str:
    return feats_sql(body, EVAL.strip())


def e1(spark, d):
    c = ev.pr_curve(_scores(spark, d))
    return c.select("threshold", "tp", "fp", *rounded(c, ["precision", "recall"]))


E1_SQL = eval_sql("SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision + 1e-9, 6) AS precision, "
                  "round(recall + 1e-9, 6) AS recall FROM curve")


def e2(spark, d):
    r = ev.average_precision(ev.pr_curve(_scores(spark, d)))
    return r.select(*rounded(r, ["average_precision"]))


E2_SQL = eval_sql("""SELECT round(sum((recall - prev) * precision) + 1e-9, 6) AS average_precision FROM
 (SELECT *, coalesce(lag(recall) OVER (ORDER BY threshold DESC), 0) AS prev FROM curve)""")


def e3(spark, d):
    r = ev.roc_auc(ev.pr_curve(_scores(spark, d)))
    return r.select(*rounded(r, ["roc_auc"]))


E3_SQL = eval_sql("""SELECT round((sum(avg_rank) FILTER (WHERE y = 1) - count(*) FILTER (WHERE y = 1) * (count(*) FILTER (WHERE y = 1) + 1) / 2)
  / (count(*) FILTER (WHERE y = 1) * count(*) FILTER (WHERE y = 0)) + 1e-9, 6) AS roc_auc FROM
 (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS avg_rank FROM ys)""")


def e4(spark, d):
    r = ev.recall_at_fpr(ev.pr_curve(_scores(spark, d)), 0.01)
    return r.select(*rounded(r, ["recall_at_fpr"]))


E4_SQL = eval_sql("SELECT round(coalesce(max(recall) FILTER (WHERE fp / all_neg <= 0.01), 0) + 1e-9, 6) AS recall_at_fpr FROM curve")


def e5(spark, d):
    r = ev.best_f1_threshold(ev.pr_curve(_scores(spark, d)))
    return r.select("threshold", *rounded(r, ["f1"]))


E5_SQL = eval_sql("""SELECT threshold, round(f1 + 1e-9, 6) AS f1 FROM
 (SELECT threshold, 2 * precision * recall / greatest(precision + recall, 1e-12) AS f1 FROM curve)
 ORDER BY f1 DESC, threshold LIMIT 1""")
EVAL_COLS = ["pr_auc", "roc_auc", "recall_at_1pct_fpr", "precision", "recall", "f1", "false_positive_rate"]


def e6(spark, d):
    return ev.evaluate(_scores(spark, d), 1.5)


def e7(spark, d):
    return ev.evaluate(_scores(spark, d), 1.5, by=["channel"])


def e6_sql(by: str = "") -> str:
    part, lead, on = (f"PARTITION BY {by}", f"{by}, ", f"USING ({by})") if by else ("", "", "ON true")
    gcol = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return feats_sql(f"""
SELECT {lead}n, n_fraud, round(ap, 4) AS pr_auc, round(auc, 4) AS roc_auc, round(coalesce(at_fpr, 0), 4) AS recall_at_1pct_fpr,
  round(coalesce(hits / nullif(hits + fh, 0), 0), 4) AS precision, round(hits / n_fraud, 4) AS recall,
  round(coalesce(2 * hits / nullif(hits + fh + n_fraud, 0), 0), 4) AS f1, round(fh / (n - n_fraud), 5) AS false_positive_rate,
  CAST(NULL AS VARCHAR) AS note
FROM (SELECT {gcol}CAST(sum(pos + neg) AS BIGINT) AS n, CAST(sum(pos) AS BIGINT) AS n_fraud, sum(pos) FILTER (WHERE threshold >= 1.5) AS hits,
        sum(neg) FILTER (WHERE threshold >= 1.5) AS fh, sum(pos / all_pos * precision) AS ap,
        sum(neg * (tp - pos / 2) / all_pos / all_neg) AS auc, max(recall) FILTER (WHERE fp / all_neg <= 0.01) AS at_fpr
      FROM curve2 {group})""", f"""
ys AS (SELECT channel, is_fraud AS y, round(amount_zscore_user + 1e-9, 6) AS score FROM feats),
g2 AS (SELECT {gcol}score AS threshold, sum(y) AS pos, sum(1 - y) AS neg FROM ys GROUP BY ALL),
curve2 AS (SELECT *, tp / (tp + fp) AS precision, tp / all_pos AS recall FROM (
  SELECT *, sum(pos) OVER w AS tp, sum(neg) OVER w AS fp, sum(pos) OVER ({part}) AS all_pos, sum(neg) OVER ({part}) AS all_neg
  FROM g2 WINDOW w AS ({part} ORDER BY threshold DESC)))""".strip())


def e8(spark, d):
    return ev.recall_by_fraud_type(_scores(spark, d), 1.5)


E8_SQL = eval_sql("SELECT fraud_type, count(*) AS n, round(avg((score >= 1.5)::INT), 4) AS recall FROM ys "
                  "WHERE y = 1 AND fraud_type IS NOT NULL GROUP BY fraud_type")

# --- drift: first 70 % of the time span against the last 15 % ----------------------------------------
DRIFT = list(ft.FEATURE_NAMES)


def _drift_inputs(spark, d):
    df = sp.temporal_split(with_probability(features(spark, d)))
    names = [*DRIFT, dr.SCORE]
    df = materialise(df.select("split", *[F.round(F.col(n) + 1e-9, 5).alias(n) for n in names]), "features")
    return (dr.unpivot_features(df.filter("split <= 1"), names), dr.unpivot_features(df.filter("split = 3"), names))


_UNPIVOT = " UNION ALL ".join(
    f"SELECT '{n}' AS feature, round(CAST({n} AS DOUBLE) + 1e-9, 5) AS value, split FROM dfs" for n in [*DRIFT, dr.SCORE])
DRIFT_CTE = f"""
s0 AS (SELECT *, CAST((amount_ratio_user_mean > ln(6)) AS INT) + is_new_device + is_night + is_near_full_drain
            + is_foreign_ip + CAST((tx_count_1h >= 4) AS INT) AS rule_score FROM fs),
dfs AS (SELECT *, 1 / (1 + exp(-(-4 + 1.1e0 * rule_score))) AS fraud_probability FROM s0),
lv AS ({_UNPIVOT}),
h AS (SELECT feature, value, count(*) FILTER (WHERE split <= 1) AS ref, count(*) FILTER (WHERE split = 3) AS cur
      FROM lv WHERE split <> 2 GROUP BY ALL),
t AS (SELECT *, sum(ref) OVER w AS rup, sum(cur) OVER w AS cup, sum(ref) OVER (PARTITION BY feature) AS nr,
        sum(cur) OVER (PARTITION BY feature) AS nc, count(*) FILTER (WHERE ref > 0) OVER (PARTITION BY feature) AS rv
      FROM h WINDOW w AS (PARTITION BY feature ORDER BY value)),
ks AS (SELECT feature, max(abs(rup / nr - cup / nc)) AS ks_d, max(nr) AS n_ref, max(nc) AS n_cur FROM t GROUP BY feature),
ksp AS (SELECT ks.*, CASE WHEN x2 < 0.04 THEN 1 ELSE greatest(0, least(1, (SELECT sum(CASE WHEN k % 2 = 1 THEN 2 ELSE -2 END * exp(-2 * k * k * x2)) FROM range(1, 101) r(k)))) END AS ks_p
        FROM (SELECT *, ks_d * ks_d * (n_ref * n_cur / (n_ref + n_cur)) AS x2 FROM ks) ks),
qe AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]))) AS e
       FROM lv WHERE split <= 1 GROUP BY feature),
cl AS (SELECT t.feature, CASE WHEN rv <= 10 THEN value ELSE len(list_filter(e[2:len(e) - 1], lambda x: x <= value)) END AS class,
         greatest(sum(ref) / max(nr), 1e-4) AS r, greatest(sum(cur) / max(nc), 1e-4) AS c FROM t JOIN qe USING (feature) GROUP BY ALL),
ps AS (SELECT feature, sum((c - r) * ln(c / r)) AS psi FROM cl GROUP BY feature),
fam AS (SELECT *, CASE WHEN feature IN ('hour_sin','hour_cos','is_night','is_weekend','is_month_end') THEN 'calendaire'
   WHEN feature IN ('log_history_days','log_user_tx_count','tx_count_7d','log_device_prior_uses','n_devices_user','counterparty_n_users','log_account_age_days','user_night_ratio','log_mins_since_topup') THEN 'cumulative'
   ELSE 'comportementale' END AS family, (ks_d > 0.1 AND ks_p < 0.01) OR psi > 0.2 AS drift FROM ksp JOIN ps USING (feature))
"""


def drift_sql(body: str) -> str:
    return feats_split_sql(body, DRIFT_CTE.strip())


def g1(spark, d):
    return dr.latest_window(fact(spark, d), 2000).select("transaction_id", "action")


G1_SQL = scored_sql("SELECT transaction_id, action FROM scored ORDER BY scored_at DESC, transaction_id DESC LIMIT 2000")


def g2(spark, d):
    df = features(spark, d)
    u = dr.unpivot_features(df.withColumn("f", F.map_from_arrays(
        F.array(F.lit("log_amount_usd"), F.lit("tx_count_24h")), F.array("log_amount_usd", "tx_count_24h"))),
        ["log_amount_usd", "tx_count_24h"], source="f")
    return u.groupBy("feature").agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"))


G2_SQL = feats_sql("SELECT 'log_amount_usd' AS feature, count(*) AS n, round(sum(log_amount_usd), 3) AS total FROM feats UNION ALL "
                   "SELECT 'tx_count_24h', count(*), round(sum(CAST(tx_count_24h AS DOUBLE)), 3) FROM feats")


def g3(spark, d):
    r = dr.ks_2samp(dr.value_table(*_drift_inputs(spark, d)))
    return r.select("feature", *rounded(r, ["ks_d", "ks_p"]), "n_ref", "n_cur")


G3_SQL = drift_sql("SELECT feature, round(ks_d + 1e-9, 6) AS ks_d, round(ks_p + 1e-9, 6) AS ks_p, CAST(n_ref AS BIGINT) AS n_ref, "
                   "CAST(n_cur AS BIGINT) AS n_cur FROM ksp")


def g5(spark, d):
    r = dr.psi(dr.value_table(*_drift_inputs(spark, d)))
    return r.select("feature", F.round(F.col("psi") + 1e-7, 5).alias("psi"))


G5_SQL = drift_sql("SELECT feature, round(psi + 1e-7, 5) AS psi FROM ps")


def g8(spark, d):
    r = dr.compare(*_drift_inputs(spark, d))
    return r.select("feature", "family", "drift")


G8_SQL = drift_sql("SELECT feature, family, drift FROM fam")


def g9(spark, d):
    ref, cur = _drift_inputs(spark, d)
    window = F.lit(0) + cur.filter(F.col("feature") == dr.SCORE).agg(F.count("*")).scalar()
    r = dr.drift_report(dr.compare(ref, cur), window)
    return r.select("window", "n_drifted", F.concat_ws("|", "drifted_features").alias("drifted_features"),
                    F.concat_ws("|", "expected_drift").alias("expected_drift"), "score_ks_d", "score_psi", "alarm")


G9_SQL = drift_sql("""SELECT (SELECT count(*) FROM lv WHERE split = 3 AND feature = 'fraud_probability') AS window,
 count(*) FILTER (WHERE drift AND family = 'comportementale' AND feature <> 'fraud_probability') AS n_drifted,
 coalesce(string_agg(feature, '|' ORDER BY feature) FILTER (WHERE drift AND family = 'comportementale' AND feature <> 'fraud_probability'), '') AS drifted_features,
 coalesce(string_agg(feature, '|' ORDER BY feature) FILTER (WHERE drift AND family <> 'comportementale'), '') AS expected_drift,
 max(round(ks_d, 4)) FILTER (WHERE feature = 'fraud_probability') AS score_ks_d,
 max(round(psi, 4)) FILTER (WHERE feature = 'fraud_probability') AS score_psi,
 bool_or(drift AND family = 'comportementale' AND feature <> 'fraud_probability') OR max(psi) FILTER (WHERE feature = 'fraud_probability') > 0.2 AS alarm
 FROM fam HAVING (SELECT count(*) FROM lv WHERE split = 3 AND feature = 'fraud_probability') >= 500""")


def g10(spark, d):
    return dr.top_features(dr.compare(*_drift_inputs(spark, d)), "psi").select("feature")


G10_SQL = drift_sql("SELECT feature FROM ps WHERE feature <> 'fraud_probability' ORDER BY psi DESC, feature LIMIT 10")


def g11(spark, d):
    df = sp.temporal_split(with_probability(features(spark, d)))
    feats, scores = st.reference_sample(df, ["log_amount_usd"], n=1000, seed=42)
    a = feats.select("transaction_id", F.lit("features").alias("part"), F.round("log_amount_usd", 6).alias("value"))
    b = scores.select("transaction_id", F.lit("scores").alias("part"), F.round(dr.SCORE, 6).alias("value"))
    return a.unionByName(b)


G11_SQL = drift_sql("""(SELECT transaction_id, 'features' AS part, round(log_amount_usd, 6) AS value FROM dfs WHERE split <= 1
   ORDER BY md5(concat(transaction_id, ':42')), transaction_id LIMIT 1000)
 UNION ALL (SELECT transaction_id, 'scores', round(fraud_probability, 6) FROM dfs WHERE split = 2
   ORDER BY md5(concat(transaction_id, ':42')), transaction_id LIMIT 1000)""")


def build() -> dict:
    return {
        "p1_temporal_split": (p1, split_sql("SELECT transaction_id, split FROM sp")),
        "p1_split_bounds": (p1_bounds, split_sql("SELECT t0 AS start_us, c1 AS early_stop_from_us, c2 AS val_from_us, c3 AS test_from_us, t1 AS end_us FROM cuts")),
        "p2_split_stats": (p2, split_sql("""SELECT split, channel, count(*) AS n, CAST(sum(is_fraud) AS BIGINT) AS n_fraud, round(avg(is_fraud), 5) AS fraud_rate
            FROM sp GROUP BY GROUPING SETS ((split), (split, channel))""")),
        "p3_class_weights": (p3, split_sql("""SELECT count(*) FILTER (WHERE is_fraud = 0) AS negative, count(*) FILTER (WHERE is_fraud = 1) AS positive,
            round(count(*) FILTER (WHERE is_fraud = 0) / greatest(count(*) FILTER (WHERE is_fraud = 1), 1), 3) AS scale_pos_weight FROM sp WHERE split <= 1""")),
        "p4_fit_scaler": (p4, P4_SQL), "p5_scale": (p5, P5_SQL), "p6_unscale": (p6, P6_SQL),
        "p7_build_sequences": (p7, P7_SQL), "p8_time_order_check": (p8, P8_SQL),
        "m1_rule_score": (m1, M1_SQL),
        "d1_expected_costs": (_decided("round(cost_approve + 1e-9, 3) AS cost_approve", "round(cost_verify + 1e-9, 3) AS cost_verify", "round(cost_block + 1e-9, 3) AS cost_block"),
                              scored_sql("SELECT transaction_id, round(round(ca, 4) + 1e-9, 3) AS cost_approve, round(round(cv, 4) + 1e-9, 3) AS cost_verify, round(round(cb, 4) + 1e-9, 3) AS cost_block FROM s2")),
        "d2_choose_action": (_decided("action"), scored_sql("SELECT transaction_id, action FROM scored")),
        "d3_risk_level": (_decided("risk_level"), scored_sql("SELECT transaction_id, risk_level FROM scored")),
        "d4_override_rules": (_decided("concat_ws('|', rules_triggered) AS rules_triggered"), scored_sql("SELECT transaction_id, array_to_string(rules, '|') AS rules_triggered FROM scored")),
        "d5_rules_strengthen": (_decided("action", "reason"), scored_sql("SELECT transaction_id, action, reason FROM scored")),
        "d6_score_and_decide": (d6, D6_SQL), "d7_business_metric": (d7, D7_SQL),
        "e1_pr_curve": (e1, E1_SQL), "e2_average_precision": (e2, E2_SQL), "e3_roc_auc": (e3, E3_SQL),
        "e4_recall_at_fpr": (e4, E4_SQL), "e5_best_f1_threshold": (e5, E5_SQL), "e6_evaluate": (e6, e6_sql()),
        "e7_evaluate_by_channel": (e7, e6_sql("channel")), "e8_recall_by_fraud_type": (e8, E8_SQL),
        "g1_latest_window": (g1, G1_SQL), "g2_unpivot_features": (g2, G2_SQL), "g3_ks_2samp": (g3, G3_SQL),
        "g5_psi": (g5, G5_SQL), "g8_drift_flags": (g8, G8_SQL), "g9_drift_report": (g9, G9_SQL),
        "g10_top_drifted": (g10, G10_SQL), "g11_build_reference": (g11, G11_SQL),
    }
