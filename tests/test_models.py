import pytest
from pyspark.sql import functions as F

from checks.feature_queries import features
from paywarden.operators import evaluate as ev
from paywarden.operators import models as md
from paywarden.operators import split as sp
from paywarden.session import materialise
from tests.conftest import SF

NAMES = ["log_amount_usd", "amount_zscore_user", "amount_to_balance", "tx_count_24h", "is_new_device", "hour_sin", "kyc_level",
         "type_CASH_OUT", "log_secs_since_last_tx", "is_night"]


@pytest.fixture(scope="module")
def rows(spark):
    df = sp.temporal_split(features(spark, SF))
    params = sp.scaler_params(sp.fit_scaler(df.filter("split <= 1"), NAMES))
    df = sp.scale(df.select("transaction_id", "timestamp", "user_id", "channel", "fraud_type", "split",
                            ((F.col("amount_usd") > 60) & (F.col("log_amount_usd") > 4)).cast("int").alias("y"), *NAMES), params)
    return materialise(md.sequence_features(df, NAMES), "rows"), params


@pytest.fixture(scope="module")
def ensemble(rows):
    return md.train_ensemble(rows[0], NAMES, rounds=10)


def test_sequence_weights(rows):
    r = rows[0].withColumn("h", md.attention_on_history()).select("h", "mask", "attention").limit(200).collect()
    for row in r:
        assert sum(row.attention) == pytest.approx(1.0)
        assert all(w == 0 for w, m in zip(row.attention, row.mask) if not m)
        assert len(row.h) == sum(row.mask)


def test_stack_scores_and_degraded_mode(rows, ensemble):
    scored = materialise(ensemble.score(rows[0]), "scored")
    test = scored.filter("split = 3")
    assert ev.roc_auc(ev.pr_curve(test, "y", "fraud_probability")).first().roc_auc > 0.9
    # a missing branch counts as its mean: contribution 0, probability from the others
    cut = ensemble.meta.apply(scored.select("transaction_id", "y", md.BRANCHES[0], F.lit(None).cast("double").alias(md.BRANCHES[1]), md.BRANCHES[2]))
    r = cut.first()
    assert r.degraded and r.degraded_branches == [md.BRANCHES[1]] and r.branch_contributions[md.BRANCHES[1]] == 0.0


def test_reload_gives_equal_scores(rows, ensemble, tmp_path):
    ensemble.save(str(tmp_path / "model"), {"trained_at": "t"})
    again = md.Ensemble.load(str(tmp_path / "model"))
    a = ensemble.score(rows[0]).select("transaction_id", F.round("fraud_probability", 12).alias("p"))
    b = again.score(rows[0]).select("transaction_id", F.round("fraud_probability", 12).alias("p"))
    assert a.exceptAll(b).count() == 0


def test_novelty_is_log_reconstruction_error(rows):
    import numpy as np
    df = rows[0].filter("split = 0 AND y = 0")
    model = md.train_novelty(df, NAMES, k=3)
    got = md.novelty_score(model, df, NAMES).select("autoencoder", *NAMES).toPandas()
    pc = model.stages[-1].pc.toArray()
    x = got[NAMES].to_numpy(float)
    want = np.log(((x - x @ pc @ pc.T) ** 2).mean(axis=1) + 1e-6)
    assert np.allclose(got["autoencoder"], want, atol=1e-6)


def test_explanation_gate_and_order(rows):
    df, params = rows
    model = md.train_logreg(df.filter("split <= 1"), NAMES)
    coefficients = md.linear_coefficients(model, NAMES)
    raw = {n: F.col(n) * params[n][1] + params[n][0] for n in NAMES}
    scored = md.model_score(model, df, "logit").withColumn("fraud_probability", 1 / (1 + F.exp(-F.col("logit"))))
    for r in scored.withColumn("top", md.top_contributions(coefficients, raw, 0.5, 6)).collect():
        if r.fraud_probability < 0.1:
            assert r.top == []
        else:
            sizes = [abs(t.shap) for t in r.top]
            assert len(r.top) == 6 and sizes == sorted(sizes, reverse=True)


def test_comparison_and_ablations(rows, ensemble):
    scored = materialise(ensemble.score(rows[0]), "scored")
    val, test = scored.filter("split = 2"), scored.filter("split = 3")
    metas = md.ablations(val)
    assert set(metas) == {f"ablation_without_{b}" for b in md.BRANCHES}
    table = md.comparison(val, test, ["fraud_probability", "xgboost"]).collect()
    assert [r.model for r in table] and table[0].pr_auc >= table[-1].pr_auc


def test_hand_metrics(spark):
    df = spark.createDataFrame(list(zip([0, 0, 0, 1, 1], [.1, .2, .3, .8, .9])), "y int, score double")
    curve = ev.pr_curve(df)
    assert ev.recall_at_fpr(curve).first().recall_at_fpr == 1.0
    best = ev.best_f1_threshold(curve).first()
    assert best.f1 == 1.0 and best.threshold == 0.8
    one = ev.evaluate(df.filter("y = 0"), 0.5).first()
    assert one.note == ev.SINGLE_CLASS and one.pr_auc is None


def test_random_forest_and_downsampling(rows):
    df = rows[0].filter("split <= 1")
    forest = md.train_random_forest(df, NAMES, trees=10)
    assert md.model_score(forest, df, "rf").count() == df.count()
    kept = md.downsample_negatives(df)
    n0, n1 = (df.filter(f"y = {c}").count() for c in (0, 1))
    assert kept.filter("y = 1").count() == n1 and 0.15 * n0 < kept.filter("y = 0").count() < 0.45 * n0


def test_random_forest_keeps_the_node_of_a_row_and_grows_the_same_trees(spark):
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import RandomForestClassifier
    df = spark.createDataFrame([(f"t{i}", (i * 37 % 101) / 10, (i * 53 % 97) / 10, int(i * 31 % 7 == 0)) for i in range(600)], "transaction_id string, a double, b double, y int")
    forest = md.train_random_forest(df, ["a", "b"], trees=6)
    assert forest.stages[-1].getCacheNodeIds()          # or every round sends all trees to all tasks, which walk them from the root
    plain = RandomForestClassifier(featuresCol="vector", labelCol="y", weightCol="weight", numTrees=6, minInstancesPerNode=md.MIN_LEAF,
                                   featureSubsetStrategy="sqrt", maxDepth=30, seed=42)
    other = Pipeline(stages=[md.assemble(["a", "b"]), plain]).fit(md.balanced_weights(df))
    assert forest.stages[-1].toDebugString.split("\n")[1:] == other.stages[-1].toDebugString.split("\n")[1:]


def test_sequences_equal_a_plain_replay_with_nulls_and_runs(spark):
    """Batches of three rows; a user over several runs; a null feature takes the weights of all rows that see it."""
    import math
    from paywarden.plans.scan import SkewPolicy
    rows = [("a" if i % 7 else ("b" if i % 2 else None), i, f"t{i:05d}", math.sin(i), None if i in (40, 400, 1500) else float(i % 5)) for i in range(2600)]
    df = spark.createDataFrame(rows, "user_id string, timestamp long, transaction_id string, x double, y double").repartition(3)
    want, past = {}, {}
    for user, _, key, x, y in rows:
        seen = past.setdefault(user, [])
        seen.append((x, y))
        last = seen[-10:]
        if any(v[1] is None for v in last):
            want[key] = ([None] * 10, 0.0, 0.0)
            continue
        raw = [math.exp(-0.5 * (len(last) - 1 - i) - ((x - p) ** 2 + (y - q) ** 2) / 2) for i, (p, q) in enumerate(last)]
        w = [r / sum(raw) for r in raw]
        want[key] = ([0.0] * (10 - len(w)) + w, sum(a * v[0] for a, v in zip(w, last)), sum(a * v[1] for a, v in zip(w, last)))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 3)
    try:
        for policy in (SkewPolicy(), SkewPolicy(min_rows=60, max_slices=64, sample_per_slice=4, small_bytes=0)):
            got = md.sequence_features(df, ["x", "y"], policy=policy).collect()
            assert len(got) == len(rows)
            for r in got:
                weights, x, y = want[r.transaction_id]
                assert r.attention == (weights if weights[0] is None else pytest.approx(weights)) and (r.seq_x, r.seq_y) == pytest.approx((x, y))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
