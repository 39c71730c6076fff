import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paywarden.operators import features as ft
from paywarden.operators import snapshots as sn
from paywarden.operators.ledger import ledger_replay
from paywarden.operators.split import build_sequences
from paywarden.schema import TRANSACTION, TX_TYPES, USERS
from tests.replay import ledger, replay


def make_rows(n=700, seed=3):
    rng = random.Random(seed)
    start, rows = datetime(2025, 3, 1), []
    for i in range(n):
        kind = rng.choice(TX_TYPES)
        card = kind in ("CARD_TOPUP", "CARD_PURCHASE")
        rows.append(dict(
            transaction_id=f"T{rng.randrange(10**9):09d}-{i}", timestamp=start + timedelta(hours=2 * rng.randrange(12 * 20)),
            user_id="U0" if i % 3 == 0 else f"U{rng.randrange(12)}", channel="VISA_VIRTUAL" if card else "MOBILE_MONEY",
            tx_type=kind, access_channel="APP", amount=1.0, currency="USD", amount_usd=round(rng.uniform(0.5, 90), 2),
            balance_before_usd=round(rng.uniform(0, 100), 2), status=rng.choice(["SUCCESS"] * 4 + ["FAILED"]),
            counterparty_id=f"W{rng.randrange(6)}" if kind.startswith("P2P") or kind == "AIRTIME" else None,
            merchant_id=f"M{rng.randrange(5)}" if kind in ("MERCHANT_PAYMENT", "CARD_PURCHASE") else None,
            agent_id=rng.choice(["A0", "A0", "A1"]) if kind.startswith("CASH") else None,
            device_id="D0" if rng.random() < 0.4 else f"D{rng.randrange(30)}", device_type="smartphone", ip_country="CD",
            location_province=f"P{rng.randrange(3)}"))
    return rows


USERS_ROWS = [(f"U{i}", "P0", 2, 500.0, 100.0, 300.0, 1) for i in range(10)]


@pytest.fixture(scope="module")
def fixture(spark, tmp_path_factory):
    rows = make_rows()
    path = str(tmp_path_factory.mktemp("tx"))
    columns = TRANSACTION.fieldNames()
    spark.createDataFrame([[r.get(c) for c in columns] for r in rows], TRANSACTION).repartition(3).write.mode("overwrite").parquet(path)
    return rows, spark.read.parquet(path), spark.createDataFrame(USERS_ROWS, USERS)


def check(df, expected):
    names = list(next(iter(expected.values())))
    got = {r.transaction_id: r for r in df.select("transaction_id", *names).collect()}
    assert got.keys() == expected.keys()
    for key, want in expected.items():
        assert {n: got[key][n] for n in names} == pytest.approx(want, abs=1e-6), key


def test_features_equal_replay_with_ties(fixture):
    rows, tx, users = fixture
    check(ft.build_features(tx, users, precise=True), replay(rows, USERS_ROWS))


@pytest.mark.parametrize("names", [["is_new_device", "tx_count_1h", "is_new_province"], ["agent_n_users_24h", "is_new_merchant"], ["tx_count_24h"]])
def test_fewer_features_are_the_same_and_skip_other_links(fixture, cut_everything, names):
    rows, tx, users = fixture
    want = {key: {n: row[n] for n in names} for key, row in replay(rows, USERS_ROWS).items()}
    df = ft.build_features(tx, users, precise=True, names=names)
    assert [c for c in df.columns if c in ft.FEATURE_NAMES] == [n for n in ft.FEATURE_NAMES if n in names]
    check(df, want)
    check(ft.build_features(tx, users, precise=True, names=names, policy=cut_everything), want)
    plan = lambda d: d._jdf.queryExecution().optimizedPlan().toString()
    crowds = ("seen" in plan(df), "seen" in plan(ft.build_features(tx, users, names=ft.FEATURE_NAMES)))
    assert crowds == ("agent_n_users_24h" in names, True)


def test_features_equal_replay_when_every_large_key_is_cut(fixture, cut_everything):
    rows, tx, users = fixture
    check(ft.build_features(tx, users, precise=True, policy=cut_everything), replay(rows, USERS_ROWS))


def test_unknown_user_has_the_cautious_profile(fixture):
    _, tx, users = fixture
    row = ft.build_features(tx.filter("user_id = 'U11'"), users).first()
    assert row.known_user is False and row.kyc_level == 1.0


def test_shape_and_guard(fixture):
    _, tx, users = fixture
    built = ft.build_features(tx, users)
    assert len(ft.FEATURE_NAMES) == 58 and built.schema["tx_count_7d"].dataType.simpleString() == "float"
    ft.leakage_guard(ft.FEATURE_NAMES)
    with pytest.raises(ValueError):
        ft.leakage_guard([*ft.FEATURE_NAMES, "is_fraud"])
    with pytest.raises(ValueError):
        ft.feature_names("nope")


def test_incremental_equals_full_replay(fixture):
    _, tx, users = fixture
    cut = "timestamp >= TIMESTAMP_NTZ '2025-03-18 00:00:00'"
    start = "2025-03-01 00:00:00"
    names = [n for n in ft.FEATURE_NAMES]
    full = ft.build_features(tx, users, start, precise=True).filter(cut).select("transaction_id", *[F.round(n, 6).alias(n) for n in names])
    inc = sn.incremental_features(tx.filter(cut), tx.filter(f"NOT ({cut})"), users, start, precise=True).select(
        "transaction_id", *[F.round(n, 6).alias(n) for n in names])
    assert full.count() == inc.count() > 0
    assert full.exceptAll(inc).count() == 0


@pytest.mark.parametrize("cut", [False, True])
def test_ledger(fixture, cut_everything, cut):
    rows, tx, _ = fixture
    got = ledger_replay(tx, 20.0, 5.0, **({"policy": cut_everything} if cut else {}))
    assert {r.transaction_id: (round(r.balance_before_usd, 6), round(r.balance_after_usd, 6), r.status)
            for r in got.collect()} == ledger(rows, 20.0, 5.0)


@pytest.mark.parametrize("cut", [False, True])
def test_sequences(fixture, cut_everything, cut):
    rows, tx, _ = fixture
    kw = {"policy": cut_everything} if cut else {}
    got = {r.transaction_id: r for r in build_sequences(tx, F.col("transaction_id"), 4, **kw).collect()}
    past = {}
    for r in sorted(rows, key=lambda r: (r["timestamp"], r["transaction_id"])):
        seen = past.setdefault(r["user_id"], [])
        seen.append(r["transaction_id"])
        want = [None] * (4 - len(seen[-4:])) + seen[-4:]
        assert got[r["transaction_id"]].sequence == want
        assert got[r["transaction_id"]].mask == [w is not None for w in want]


def test_the_transactions_are_computed_once(fixture, spark):
    rows, tx, users = fixture
    seen = spark.sparkContext.accumulator(0)

    def count(batches):
        for b in batches:
            seen.add(b.num_rows)
            yield b

    counted = tx.mapInArrow(count, tx.schema)
    assert ft.build_features(counted, users).count() == len(rows) and seen.value == len(rows)
    seen.value = 0
    late = counted.filter("timestamp >= TIMESTAMP_NTZ '2025-03-15'")
    sn.incremental_features(late, tx.filter("timestamp < TIMESTAMP_NTZ '2025-03-15'"), users, "2025-03-01 00:00:00").count()
    assert seen.value == len(rows)
