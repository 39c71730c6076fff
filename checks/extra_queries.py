"""Models (M*), drift parts (G4, G6, G7), feature cache and incremental features (F6, S2, S9, S10)."""
from __future__ import annotations

from pyspark.sql import functions as F

from checks.feature_queries import _select, features, feats_sql, rounded
from checks.model_queries import _drift_inputs, drift_sql, feats_split_sql
from checks.tables import profiles, transactions
from paywarden.operators import drift as dr
from paywarden.operators import features as ft
from paywarden.operators import models as md
from paywarden.operators import snapshots as sn
from paywarden.operators import split as sp
from paywarden.operators.decision import Policy
from paywarden.session import materialise, stage_folder
from paywarden.sources import tables as st

START = "2024-01-01 00:00:00"
CUT = "2024-01-25 00:00:00"
NAMES = list(ft.FEATURE_NAMES)


def f6(spark, d):
    """The last days as a batch against the stored rest."""
    tx, users = transactions(spark, d), profiles(spark, d)
    late = f"timestamp >= TIMESTAMP_NTZ '{CUT}'"
    df = sn.incremental_features(tx.filter(late), tx.filter(f"NOT ({late})"), users, START, precise=True)
    return df.select("transaction_id", *rounded(df, ft.FEATURE_NAMES))


F6_SQL = feats_sql(f"SELECT transaction_id, {_select(ft.FEATURE_NAMES)} FROM feats WHERE timestamp >= TIMESTAMP '{CUT}'")


def s2(spark, d):
    path = f"{stage_folder(spark)}/feature-cache-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    df = st.read_features(spark, path, build=lambda: features(spark, d), rebuild=True)
    return df.select("transaction_id", *rounded(df, ft.FEATURE_NAMES))


S2_SQL = feats_sql(f"SELECT transaction_id, {_select(ft.FEATURE_NAMES)} FROM feats")


def s9(spark, d):
    path = f"{stage_folder(spark)}/reference-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    df = sp.temporal_split(features(spark, d)).withColumn(dr.SCORE, F.col("night_unusual"))
    st.write_reference_sample(df, ft.FEATURE_NAMES, path, n=500, seed=7)
    kept = spark.read.parquet(f"{path}/features")
    return kept.select("transaction_id", *rounded(kept, ft.FEATURE_NAMES))


S9_SQL = feats_split_sql(f"""SELECT transaction_id, {_select(ft.FEATURE_NAMES)} FROM fs WHERE split <= 1
  ORDER BY md5(concat(transaction_id, ':7')), transaction_id LIMIT 500""")


def s10(spark, d):
    path = f"{stage_folder(spark)}/by-split-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    st.export_features_by_split(sp.temporal_split(features(spark, d)).select("transaction_id", "split", *ft.FEATURE_NAMES), path)
    return spark.read.parquet(path).groupBy("split").agg(F.count("*").alias("n"), *[F.round(F.sum(n) + 1e-6, 3).alias(n) for n in ft.FEATURE_NAMES])


S10_SQL = feats_split_sql("SELECT split, count(*) AS n, " + ", ".join(f"round(CAST(sum({n}) AS DOUBLE) + 1e-6, 3) AS {n}" for n in ft.FEATURE_NAMES) + " FROM fs GROUP BY split")


def g4(spark, d):
    r = dr.ks_2samp(dr.value_table(*_drift_inputs(spark, d)))
    return r.select("feature", *rounded(r, ["ks_p"]), (F.col("ks_p") < dr.P_MIN).alias("significant"))


G4_SQL = drift_sql("SELECT feature, round(ks_p + 1e-9, 6) AS ks_p, ks_p < 0.01 AS significant FROM ksp")


def g6(spark, d):
    """Features with few reference values: one class per value."""
    table = dr.value_table(*_drift_inputs(spark, d))
    few = table.filter(F.col("ref_values") <= dr.BINS)
    return dr.psi(few).select("feature", F.round(F.col("psi") + 1e-7, 5).alias("psi"))


G6_SQL = drift_sql("SELECT feature, round(psi + 1e-7, 5) AS psi FROM ps WHERE feature IN (SELECT feature FROM t WHERE rv <= 10)")
for cte in ("lv", "t"):         # both are read twice
    G6_SQL = G6_SQL.replace(f"\n{cte} AS (", f"\n{cte} AS MATERIALIZED (")


def g7(spark, d):
    df = features(spark, d)
    long = dr.unpivot_features(df, ft.FEATURE_NAMES)
    return long.groupBy(dr.feature_family(F.col("feature")).alias("family")).agg(F.count_distinct("feature").alias("features"), F.count("*").alias("n"))


G7_SQL = feats_sql(f"""SELECT family, count(*) AS features, count(*) * (SELECT count(*) FROM feats) AS n FROM (SELECT CASE
  WHEN f IN ({', '.join(repr(x) for x in dr.CALENDAR)}) THEN 'calendaire' WHEN f IN ({', '.join(repr(x) for x in dr.CUMULATIVE)}) THEN 'cumulative' ELSE 'comportementale' END AS family
  FROM (SELECT unnest([{', '.join(repr(x) for x in ft.FEATURE_NAMES)}]) AS f)) GROUP BY family""")

# --- meta-learner with given numbers over three columns standing in for the branches ------------------
META = md.MetaLearner(md.BRANCHES, [0.5, 0.2, 2.0], [1.5, 0.4, 1.2], [1.1, 0.7, -0.3], -2.0, 0.3)


def _branches(df):
    n = F.expr("CAST(substr(transaction_id, 3) AS bigint)")
    return df.select("transaction_id", "is_fraud", F.col("amount_zscore_user").alias("xgboost"),
                     F.when(n % 7 != 0, F.col("night_unusual")).alias("lstm_attention"),
                     F.when(n % 11 != 0, F.col("log_amount_usd")).alias("autoencoder"))


BR = """
br AS (SELECT transaction_id, is_fraud, amount_zscore_user AS b1, CASE WHEN event_id % 7 <> 0 THEN night_unusual END AS b2, CASE WHEN event_id % 11 <> 0 THEN log_amount_usd END AS b3 FROM feats),
zs AS (SELECT *, 1.1e0 * (b1 - 0.5e0) / 1.5e0 AS c1, 0.7e0 * (coalesce(b2, 0.2e0) - 0.2e0) / 0.4e0 AS c2, -0.3e0 * (coalesce(b3, 2) - 2) / 1.2e0 AS c3 FROM br),
mp AS (SELECT *, 1 / (1 + exp(-(-2 + c1 + c2 + c3))) AS p FROM zs)
"""


def _meta(spark, d):
    return META.apply(_branches(features(spark, d)))


def m9(spark, d):
    df = _branches(features(spark, d))
    return df.select("transaction_id", *rounded(df, md.BRANCHES))


def m10(spark, d):
    df = _meta(spark, d)
    return df.select("transaction_id", *rounded(df, ["fraud_probability"]), "degraded", F.concat_ws("|", "degraded_branches").alias("degraded_branches"))


def m11(spark, d):
    return _meta(spark, d).select("transaction_id", *[
        F.round(F.element_at("branch_contributions", F.lit(b)) + 1e-9, 4).alias(b) for b in md.BRANCHES])


def m17(spark, d):
    return _meta(spark, d).select("transaction_id", "is_fraud_predicted")


def m7(spark, d):
    return md.downsample_negatives(features(spark, d), y="is_fraud").select("transaction_id", "is_fraud")


M7_SQL = feats_sql("SELECT transaction_id, is_fraud FROM feats WHERE is_fraud = 1 OR CAST(concat('0x', substr(md5(concat(transaction_id, ':42')), 1, 8)) AS BIGINT) < 1288490188")


def m12(spark, d):
    """Contributions of a linear score with given coefficients, explained from one fifth of the threshold."""
    coefficients = {"log_amount_usd": 0.5, "tx_count_24h": -0.2, "is_night": 1.3, "hour_sin": 0.9}
    feats = materialise(features(spark, d).select("transaction_id", "is_fraud", "amount_zscore_user", "night_unusual", *coefficients), "features")
    df = META.apply(_branches(feats)).select("transaction_id", "fraud_probability").join(feats, "transaction_id")
    top = md.top_contributions(coefficients, {n: F.col(n) for n in coefficients}, 1.0, 2)
    return df.withColumn("top", top).select(
        "transaction_id", F.concat_ws("|", F.transform("top", lambda t: t["feature"])).alias("features"))


M12_SQL = feats_sql("""
SELECT transaction_id, CASE WHEN p >= 0.2 THEN array_to_string(list_transform(list_reverse_sort([
   {'a': abs(log_amount_usd * 0.5e0), 'f': 'log_amount_usd'}, {'a': abs(tx_count_24h * 0.2e0), 'f': 'tx_count_24h'},
   {'a': abs(is_night * 1.3e0), 'f': 'is_night'}, {'a': abs(hour_sin * 0.9e0), 'f': 'hour_sin'}])[1:2], lambda x: x.f), '|') ELSE '' END AS features
FROM mp JOIN feats USING (transaction_id)""", BR.strip())


# --- trained models: scored on the whole table --------------------------------------------------------
def _train_rows(spark, d, names=NAMES, sequences=False):
    df = sp.temporal_split(features(spark, d))
    df = materialise(df.select("transaction_id", "timestamp", "user_id", "channel", "fraud_type", "split", F.col("is_fraud").alias("y"), *names), "features")
    df = sp.scale(df, sp.scaler_params(sp.fit_scaler(df.filter("split <= 1"), names)))
    return materialise(md.sequence_features(df, names), "rows") if sequences else df


def m2(spark, d):
    rows = _train_rows(spark, d)
    model = md.train_logreg(rows.filter("split <= 1"), NAMES)
    return md.model_score(model, rows, "logit").select("transaction_id", "y", "logit")


def m3(spark, d):
    rows = _train_rows(spark, d)
    model = md.train_random_forest(rows.filter("split <= 1"), NAMES)
    return md.model_score(model, rows, "score").select("transaction_id", "y", "score")


def m4(spark, d):
    rows = _train_rows(spark, d)
    model = md.train_trees(rows.filter("split = 0"), rows.filter("split = 1"), NAMES)
    return md.model_score(model, rows, "xgboost").select("transaction_id", "y", "xgboost")


def m5(spark, d):
    rows = _train_rows(spark, d)
    model = md.train_novelty(rows.filter("split = 0 AND y = 0"), NAMES)
    return md.novelty_score(model, rows, NAMES).select("transaction_id", "y", "autoencoder")


def m6(spark, d):
    rows = _train_rows(spark, d, sequences=True)
    wide = [*NAMES, *[f"seq_{n}" for n in NAMES]]
    model = md.train_logreg(rows.filter("split = 0"), wide)
    return md.model_score(model, rows, "lstm_attention").select("transaction_id", "y", "lstm_attention")


def m13(spark, d):
    rows = _train_rows(spark, d, sequences=True)
    return rows.select("transaction_id", F.size(md.attention_on_history()).alias("length"),
                       F.round(F.aggregate("attention", F.lit(0.0), lambda a, x: a + x) + 1e-9, 6).alias("total"))


M13_SQL = feats_sql("""SELECT transaction_id, least(10, row_number() OVER (PARTITION BY user_id ORDER BY timestamp, transaction_id)) AS length, 1.0e0 AS total FROM feats""")


def _ensemble(spark, d):
    rows = _train_rows(spark, d, sequences=True)
    return rows, md.train_ensemble(rows, NAMES)


def m8(spark, d):
    rows, ensemble = _ensemble(spark, d)
    return ensemble.score(rows).select("transaction_id", "y", *md.BRANCHES, "fraud_probability", "is_fraud_predicted")


def m14(spark, d):
    rows, ensemble = _ensemble(spark, d)
    scores = materialise(ensemble.branch_scores(rows.filter("split = 2")), "scores")
    out = None
    for name, meta in md.ablations(scores).items():
        part = scores.select("transaction_id", F.lit(name).alias("model"), meta.probability().alias("probability"))
        out = part if out is None else out.unionByName(part)
    return out


def m15(spark, d):
    rows, ensemble = _ensemble(spark, d)
    scored = materialise(ensemble.score(rows).select("split", "channel", "y", "fraud_probability", *md.BRANCHES), "scored")
    return md.comparison(scored.filter("split = 2"), scored.filter("split = 3"), ["fraud_probability", *md.BRANCHES])


def m16(spark, d):
    """Features to decision with a trained model, and again with the same model read back: equal scores and actions."""
    feats = materialise(sp.temporal_split(features(spark, d)).withColumn("y", F.col("is_fraud")), "features")
    params = sp.scaler_params(sp.fit_scaler(feats.filter("split <= 1"), NAMES))
    rows = materialise(md.sequence_features(sp.scale(feats, params), NAMES), "rows")
    ensemble = md.train_ensemble(rows, NAMES)
    ensemble.scaler = params
    path = f"{stage_folder(spark)}/model-{spark.sparkContext.applicationId}-{abs(hash(d))}"
    ensemble.save(path)
    policy = Policy(ensemble.meta.threshold)
    score = lambda model: md.score_and_decide(feats, model, policy).select(
        "transaction_id", (F.col("fraud_probability") + F.when(F.col("action") == "BLOCK", 2).when(F.col("action") == "VERIFY", 1).otherwise(0)).alias("score"))
    return sn.parity_check(score(ensemble), score(md.Ensemble.load(path)), tolerance=1e-9).select("n", "ok")


def build() -> dict:
    return {
        "f6_incremental_features": (f6, F6_SQL), "s2_feature_cache": (s2, S2_SQL), "s9_reference_sample": (s9, S9_SQL),
        "s10_export_by_split": (s10, S10_SQL), "g4_ks_p_value": (g4, G4_SQL), "g6_psi_discrete": (g6, G6_SQL), "g7_feature_family": (g7, G7_SQL),
        "m7_downsample": (m7, M7_SQL),
        "m9_branch_scores": (m9, feats_sql("SELECT transaction_id, round(b1 + 1e-9, 6) AS xgboost, round(b2 + 1e-9, 6) AS lstm_attention, round(b3 + 1e-9, 6) AS autoencoder FROM br", BR.strip())),
        "m10_degraded_mode": (m10, feats_sql("""SELECT transaction_id, round(p + 1e-9, 6) AS fraud_probability, b2 IS NULL OR b3 IS NULL AS degraded,
            concat_ws('|', CASE WHEN b2 IS NULL THEN 'lstm_attention' END, CASE WHEN b3 IS NULL THEN 'autoencoder' END) AS degraded_branches FROM mp""", BR.strip())),
        "m11_branch_contributions": (m11, feats_sql("SELECT transaction_id, round(c1 + 1e-9, 4) AS xgboost, round(c2 + 1e-9, 4) AS lstm_attention, round(c3 + 1e-9, 4) AS autoencoder FROM zs", BR.strip())),
        "m12_top_contributions": (m12, M12_SQL), "m17_predicted_flag": (m17, feats_sql("SELECT transaction_id, p >= 0.3 AS is_fraud_predicted FROM mp", BR.strip())),
        "m2_logistic_regression": (m2, None), "m3_random_forest": (m3, None), "m4_boosted_trees": (m4, None), "m5_novelty": (m5, None),
        "m6_sequence_branch": (m6, None), "m13_attention": (m13, M13_SQL), "m8_stacking": (m8, None), "m14_ablations": (m14, None),
        "m15_comparison": (m15, None), "m16_save_load": (m16, feats_sql("SELECT count(*) AS n, true AS ok FROM feats")),
    }
