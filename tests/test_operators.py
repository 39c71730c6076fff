import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from paywarden.functions.ids import canonical_id, to_local_naive
from paywarden.operators import audit as au
from paywarden.operators import cases as cs
from paywarden.operators import drift as dr
from paywarden.operators import evaluate as ev
from paywarden.operators import labels as lb
from paywarden.operators import reports as rp
from paywarden.operators.decision import Policy, decide
from paywarden.session import materialise
from paywarden.sources import ingest as ig
from paywarden.sources import tables as st
from tests.conftest import SF

FEATURES = "tx_type string, channel string, fraud_probability double, amount_usd double, is_new_device double, is_near_full_drain double, amount_to_kyc_limit double, is_new_province double"


@pytest.mark.parametrize("p, amount, drain, action, risk, rules", [
    (0.001, 500.0, 0.0, "APPROVE", "FAIBLE", 0), (0.99, 0.5, 0.0, "BLOCK", "CRITIQUE", 0), (0.3, 1.0, 0.0, "APPROVE", "MOYEN", 0),
    (0.3, 900.0, 0.0, "BLOCK", "MOYEN", 0), (0.001, 50.0, 1.0, "VERIFY", "FAIBLE", 1)])
def test_decisions(spark, p, amount, drain, action, risk, rules):
    df = spark.createDataFrame([("P2P_SEND", "MOBILE_MONEY", p, amount, drain, drain, 0.1, 0.0)], FEATURES)
    r = decide(df, Policy(0.5)).first()
    assert (r.action, r.risk_level, len(r.rules_triggered)) == (action, risk, rules)
    assert r.reason.startswith("règle : ") == bool(rules)


def test_unknown_channel_uses_mobile_money_costs(spark):
    rows = [("CASH_OUT", c, 0.3, 100.0, 0.0, 0.0, 0.1, 0.0) for c in ("MOBILE_MONEY", "OTHER")]
    a, b = decide(spark.createDataFrame(rows, FEATURES), Policy(0.5)).collect()
    assert a.cost_verify == b.cost_verify == pytest.approx(0.3 + 30 * 0.15)


def test_identifiers_and_time(spark):
    df = spark.createDataFrame([(243917538864.0, "A12", "243917538864.0", float("nan"))], "a double, b string, c string, d double")
    assert tuple(df.select(*[canonical_id(F.col(c)) for c in df.columns]).first()) == ("243917538864", "A12", "243917538864", None)
    t = spark.sql("SELECT TIMESTAMP '2025-11-01 09:30:00+00:00' AS t").select(to_local_naive(F.col("t"))).first()[0]
    assert t == datetime(2025, 11, 1, 10, 30)


BASE = dict(transaction_id="TX1", timestamp=datetime(2025, 11, 2, 21, 15, 7), user_id="U000781", wallet_id="243891234567", card_id=None,
            channel="MOBILE_MONEY", operator="VODACOM", tx_type="CASH_OUT", access_channel="AGENT", amount=285000.0, currency="CDF", amount_usd=100.0,
            balance_before_usd=120.5, status=None, counterparty_id=None, merchant_id=None, merchant_category=None, merchant_country=None,
            agent_id="A000123", device_id="DEVabc", device_type="feature_phone", ip_country=None, location_province="Haut-Katanga")


def unified(spark, **kw):
    row = {**BASE, **kw}
    return spark.createDataFrame([[row[f] for f in ig.TRANSACTION.fieldNames()]], ig.TRANSACTION)


@pytest.mark.parametrize("name", ["vodacom", "airtel", "orange"])
def test_mobile_money_round_trip(spark, name):
    tx = unified(spark, operator=name.upper())
    back = ig.from_messages(ig.to_messages(tx, ig.PROVIDERS[name]), ig.PROVIDERS[name]).first()
    assert back.reject_reasons == []
    want = tx.first().asDict()
    assert {k: back[k] for k in want} == want


def test_card_round_trip_and_minor_units(spark):
    tx = unified(spark, channel="VISA_VIRTUAL", operator="AIRTEL", tx_type="CARD_PURCHASE", access_channel="APP", amount=49.99, currency="USD",
                 amount_usd=49.99, card_id="CARD9", agent_id=None, merchant_id="M77", merchant_category="ELECTRONICS", merchant_country="AE",
                 device_type="smartphone", ip_country="AE")
    raw = ig.to_messages(tx, ig.VISA)
    message = json.loads(raw.first().raw)
    assert message["amount_minor"] == 4999 and message["currency_code"] == "840"
    back = ig.from_messages(raw, ig.VISA).first()
    assert {k: back[k] for k in tx.columns} == tx.first().asDict() and back.reject_reasons == []


def test_rejects_keep_their_reasons(spark):
    texts = ["{broken", '{"subscriber":{"msisdn":"1"}}', json.dumps({
        "transaction": {"id": "T", "type": "P2P_OUT", "amount": -5, "currency": "EUR", "timestamp": "2025-11-01T09:30:00+00:00"},
        "subscriber": {"msisdn": "1", "customer_id": 7, "balance_usd": 3, "province": "K"}, "device": {"imei": "d", "channel": "APP"}})]
    rows = ig.from_messages(spark.createDataFrame([(t,) for t in texts], "raw string"), ig.AIRTEL).collect()
    assert all(r.reject_reasons for r in rows)
    assert "transaction.id" in rows[1].reject_reasons[0] and "device.imei" in rows[1].reject_reasons[0]
    assert rows[2].reject_reasons == ["devise non prise en charge : EUR"] and rows[2].timestamp == datetime(2025, 11, 1, 10, 30)
    valid, rejected = ig.split_valid(ig.from_messages(spark.createDataFrame([(t,) for t in texts], "raw string"), ig.AIRTEL))
    assert valid.count() == 0 and rejected.count() == 3


def log_rows(spark, n=12):
    return spark.range(1, n + 1).select(
        "id", F.expr("timestamp_micros(1758794400000000 + id * 60000000)").alias("ts"), F.lit("a").alias("actor"), F.lit("LOGIN").alias("action"),
        F.lit("bo_user").alias("entity"), F.col("id").cast("string").alias("entity_id"), F.create_map(F.lit("k"), F.col("id").cast("string")).alias("details"))


def test_single_chain_equals_a_plain_fold(spark):
    import hashlib
    got = au.hash_chain(log_rows(spark), order=["id"]).orderBy("id").collect()
    prev = au.GENESIS
    for r in got:
        text = json.dumps({"prev": prev, "ts": r.ts.strftime("%Y-%m-%dT%H:%M:%S+00:00"), "actor": r.actor, "action": r.action, "entity": r.entity,
                           "entity_id": r.entity_id, "details": {"k": r.id}}, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        assert r.prev_hash == prev and r.hash == hashlib.sha256(text.encode()).hexdigest()
        prev = r.hash


def test_tampering_and_deletion_show(spark):
    from paywarden.session import materialise
    chain = materialise(au.hash_chain(log_rows(spark), order=["id"]), "chain")
    assert au.verify_chain(chain).first().asDict() == {"valid": True, "checked": 12, "broken_at_id": None}
    edited = chain.withColumn("details", F.when(F.col("id") == 3, F.create_map(F.lit("k"), F.lit("999"))).otherwise(F.col("details")))
    assert au.verify_chain(edited).first().asDict() == {"valid": False, "checked": 2, "broken_at_id": 3}
    assert au.verify_chain(chain.filter("id <> 2")).first().broken_at_id == 3


def test_an_untouched_chain_of_any_length_is_valid(spark, cut_everything):
    from paywarden.session import materialise
    rows = log_rows(spark, 3000)
    chain = materialise(au.hash_chain(rows, order=["id"]), "chain")
    for policy in (cut_everything, au.DEFAULT_POLICY):
        assert au.verify_chain(chain, policy=policy).first().asDict() == {"valid": True, "checked": 3000, "broken_at_id": None}


def test_a_stored_chain_continues_from_its_tip(spark):
    from paywarden.session import materialise
    rows = log_rows(spark, 40)
    whole = {r.id: r.hash for r in au.hash_chain(rows, order=["id"]).collect()}
    first = materialise(au.hash_chain(rows.filter("id <= 15"), order=["id"]), "chain")
    second = au.hash_chain(rows.filter("id > 15"), order=["id"], tips=au.seal_chains(first, order=["id"]))
    assert {r.id: r.hash for r in first.union(second).collect()} == whole
    keyed = rows.withColumn("day", F.when(F.col("id") % 2 == 0, F.lit("d")))
    by = {r.id: r.hash for r in au.hash_chain(keyed, key=["day"], order=["id"]).collect()}
    one = materialise(au.hash_chain(keyed.filter("id <= 20"), key=["day"], order=["id"]), "chain")
    two = au.hash_chain(keyed.filter("id > 20"), key=["day"], order=["id"], tips=au.seal_chains(one, key=["day"], order=["id"]))
    assert {r.id: r.hash for r in one.union(two).collect()} == by


def test_a_lost_day_shows(spark):
    tips = spark.createDataFrame([("d1", "aa", 3), ("d2", "bb", 4), ("d3", "cc", 5)], "day string, tip string, n long")
    links = {r.day: r.link for r in au.chain_tips(tips, ["day"]).collect()}
    cut = {r.day: r.link for r in au.chain_tips(tips.filter("day <> 'd2'"), ["day"]).collect()}
    assert links["d1"] == cut["d1"] and links["d3"] != cut["d3"]


def test_sms(spark):
    df = spark.createDataFrame([("VERIFY", 285000.0, "CDF"), ("BLOCK", 285000.0, "CDF"), ("APPROVE", 1.0, "USD")], "action string, amount double, currency string")
    verify, block, none = [r[0] for r in df.select(cs.sms_text()).collect()]
    assert "285 000 CDF" in verify and "confirmez" in verify and "communiquez" in block and len(verify) <= 200 and len(block) <= 200 and none is None


def test_case_workflow_hand(spark):
    rows = [(1, 1, "EN_COURS", None), (1, 2, "FAUX_POSITIF", None), (1, 3, "FAUX_POSITIF", "client en voyage"), (1, 4, "OUVERT", None)]
    got = cs.run_workflow(spark.createDataFrame(rows, "case_id long, seq long, status string, resolution_note string")).orderBy("seq")
    assert [(r.accepted, r.status_after) for r in got.collect()] == [(True, "EN_COURS"), (False, "EN_COURS"), (True, "FAUX_POSITIF"), (False, "FAUX_POSITIF")]
    assert cs.case_labels(got).first().asDict() == {"case_id": 1, "label": 0}


def test_drift_alarm_only_for_behaviour(spark):
    import numpy as np
    rng = np.random.default_rng(0)
    names = ["hour_sin", "amount_to_balance", "is_foreign_ip", dr.SCORE]

    def table(n, shift=None):
        x = rng.normal(size=(n, 4))
        x[:, 2] = rng.random(n) < 0.05
        x[:, 3] = rng.beta(0.3, 20, n)
        if shift is not None:
            x[:, shift[0]] += shift[1]
        return dr.unpivot_features(spark.createDataFrame(x.tolist(), names), names)

    reference = table(5000)
    report = lambda cur: dr.drift_report(dr.compare(reference, cur), F.lit(2000)).first()
    same, calendar, real = report(table(2000)), report(table(2000, (0, 2.0))), report(table(2000, (1, 1.5)))
    assert not same.alarm and same.n_drifted == 0
    assert not calendar.alarm and calendar.expected_drift == ["hour_sin"]
    assert real.alarm and real.drifted_features == ["amount_to_balance"]
    assert dr.drift_report(dr.compare(reference, table(600)), F.lit(100)).count() == 0


def test_whitelist_and_gate(spark):
    with pytest.raises(ValueError):
        rp.breakdown(spark.range(1), "drop table", "2024-01-01 00:00:00")
    few = spark.createDataFrame([(1,), (0,)], "y int")
    assert lb.enough_labels(few).first().go is False and lb.enough_labels(few, force=True).first().go is True


def test_promotion_needs_a_clear_gain(spark):
    def status(ap, recall, dry=False):
        rows = [("champion", 0.900, 0.80), ("challenger", ap, recall)]
        return lb.promotion(spark.createDataFrame(rows, "model string, pr_auc double, recall double"), dry).first().status
    assert [status(0.901, 0.9), status(0.91, 0.78), status(0.91, 0.8), status(0.91, 0.8, True)] == ["REJETE", "REJETE", "CHAMPION", "CHALLENGER"]


def test_metrics_survive_a_cut_score_axis(spark, cut_everything):
    df = spark.range(3000).select((F.col("id") % 7 == 0).cast("int").alias("y"), F.round(F.rand(1) + F.when(F.col("id") % 7 == 0, 0.4).otherwise(0), 3).alias("score"))
    from paywarden.session import materialise
    df = materialise(df, "scores")
    assert ev.evaluate(df, 0.8).first() == ev.evaluate(df, 0.8, policy=cut_everything).first()


def test_fixed_schema_and_missing_file(spark, tmp_path):
    path = str(tmp_path / "users.csv")
    with open(path, "w") as f:
        f.write("user_id,province,kyc_level,kyc_tx_limit_usd,account_age_days,monthly_income_usd,has_visa_virtual\n243917538864.0,K,2,500.0,400,300.0,1\n")
    assert st.read_users(spark, path, "csv").first().user_id == "243917538864"
    with pytest.raises(Exception):
        st.read_users(spark, str(tmp_path / "absent")).count()


def test_emails_and_case_events_compute_the_features_once(spark, monkeypatch):
    from checks import flow_queries as fq
    stored = []

    def keep(df, name):
        stored.append((name, df.columns))
        return materialise(df, name)
    monkeypatch.setattr(fq, "materialise", keep)
    for query in (fq.k2_email, fq.k4):
        stored.clear()
        df = query(spark, SF)
        assert [name for name, _ in stored] == ["alerts"] and "hour_sin" not in stored[0][1]
        assert "Window" not in df._jdf.queryExecution().optimizedPlan().toString()      # reads what was written


def test_drift_table_is_sorted_once_and_edges_equal_numpy(spark, cut_everything):
    import numpy as np
    rng = np.random.default_rng(5)
    sets = {"ties": np.round(rng.normal(size=900), 1), "wide": rng.normal(size=700), "one": np.array([2.5]), "flag": (rng.random(300) < 0.1) * 1.0}
    rows = [(k, float(v)) for k, x in sets.items() for v in x]
    ref = spark.createDataFrame(rows, "feature string, value double")
    cur = spark.createDataFrame([(k, v + 0.3) for k, v in rows[::2]], "feature string, value double")
    for policy in (dr.DEFAULT_POLICY, cut_everything):
        table = dr.value_table(ref, cur, policy)
        got = {r.feature: r.edges for r in dr.quantile_edges(table).collect()}
        assert got.keys() == sets.keys()
        for name, x in sets.items():
            want = [float(v) for v in np.unique(np.quantile(x, np.arange(11) / 10))][1:-1]
            assert got[name] == pytest.approx(want, abs=1e-12)
        values = {r.feature: r.psi for r in dr.psi(table).collect()}
        edges = np.array(got["wide"])
        share = lambda x: np.maximum(np.bincount(np.searchsorted(edges, x, "right"), minlength=10) / len(x), dr.FLOOR)
        r, c = share(sets["wide"]), share(np.array([v for k, v in cur.collect() if k == "wide"]))
        assert values["wide"] == pytest.approx(((c - r) * np.log(c / r)).sum())
        for result in (dr.psi(table), dr.ks_2samp(table)):
            assert "Window" not in result._jdf.queryExecution().optimizedPlan().toString()
