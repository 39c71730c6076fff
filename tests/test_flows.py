import random
from collections import deque
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from paywarden.operators.flows import agent_fraud_exposure, cash_out_speed

T0 = datetime(2024, 1, 1)
TX = "transaction_id string, agent_id string, user_id string, timestamp timestamp_ntz, tx_type string, amount_usd double, status string"


def moves(seed, n=300, users=2):
    """Many ties, amounts that repeat so that lots end exactly where cash-outs do, shortfalls, failures, nulls."""
    rng = random.Random(seed)
    rows, at = [], T0
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 0, 1, 3600, 86400]))
        rows.append((f"T{rng.randrange(10**6):06}-{i}", rng.choice(["A1", "A1", "A2", None]), f"U{rng.randrange(users)}", at,
                     rng.choice(["CASH_OUT", "CASH_OUT", "P2P_RECEIVE", "CASH_IN", "P2P_SEND"]), rng.choice([10.0, 20.0, 35.5, 0.0, None]),
                     rng.choice(["SUCCESS", "SUCCESS", "SUCCESS", "FAILED", None])))
    return rows


def queue_replay(rows):
    queues, out = {}, {}
    for tid, _, user, at, kind, amount, status in sorted(rows, key=lambda r: (r[3], r[0])):
        if status == "FAILED":
            continue
        amount = round((amount or 0.0) * 10**6)
        lots = queues.setdefault(user, deque())
        if kind in ("P2P_RECEIVE", "CASH_IN"):
            if amount:
                lots.append([amount, at])
        elif kind == "CASH_OUT":
            left, stayed = amount, 0.0
            while left and lots:
                used = min(left, lots[0][0])
                stayed += used * (at - lots[0][1]).total_seconds()
                left -= used
                lots[0][0] -= used
                if not lots[0][0]:
                    lots.popleft()
            matched = amount - left
            out[tid] = (amount / 10**6, matched / 10**6, round(stayed / matched, 4) if matched else None)
    return out


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("seed", [1, 2, 3])
def test_cash_out_speed_equals_a_queue(spark, cut_everything, seed, cut):
    rows = moves(seed)
    df = spark.createDataFrame(rows, TX).repartition(3)
    done = cash_out_speed(df, cut_everything) if cut else cash_out_speed(df)
    got = {r.transaction_id: (r.cash_out_usd, r.matched_usd, None if r.stayed_s is None else round(r.stayed_s, 4)) for r in done.collect()}
    want = queue_replay(rows)
    assert got.keys() == want.keys()
    for k, (amount, matched, stayed) in want.items():
        assert got[k][:2] == (amount, matched)
        assert (got[k][2] is None) == (stayed is None)
        assert stayed is None or abs(got[k][2] - stayed) < 1e-3


def test_partial_lots_by_hand(spark):
    hour = timedelta(hours=1)
    rows = [("a", None, "U", T0, "CASH_IN", 100.0, "SUCCESS"), ("b", None, "U", T0 + hour, "P2P_RECEIVE", 50.0, "SUCCESS"),
            ("c", None, "U", T0 + 2 * hour, "CASH_OUT", 120.0, "SUCCESS"), ("d", None, "U", T0 + 3 * hour, "CASH_OUT", 100.0, "SUCCESS"),
            ("e", None, "U", T0 + 4 * hour, "CASH_IN", 10.0, "SUCCESS"), ("f", None, "U", T0 + 4 * hour, "CASH_OUT", 10.0, "SUCCESS")]
    got = {r.transaction_id: (r.matched_usd, r.stayed_s) for r in cash_out_speed(spark.createDataFrame(rows, TX)).collect()}
    assert got == {"c": (120.0, (100 * 7200 + 20 * 3600) / 120), "d": (30.0, 7200.0), "f": (10.0, 0.0)}


def exposure_plain(rows, verdicts, days=7):
    known = {}
    for tid, label, at in sorted((v for v in verdicts if v[1] is not None and v[2] is not None), key=lambda v: (v[2], v[1])):
        known.setdefault(tid, (label, at))
    out = {}
    for tid, agent, _, at, *_ in rows:
        if agent is None:
            continue
        past = [r for r in rows if r[1] == agent and r[4] == "CASH_OUT" and (r[3], r[0]) < (at, tid) and r[3] >= at - timedelta(days=days)]
        frauds = [r for r in past if known.get(r[0], (0, None))[0] == 1 and known[r[0]][1] <= at]
        out[tid] = (len(past), len(frauds), round(sum(r[5] or 0 for r in past), 6), round(sum(r[5] or 0 for r in frauds), 6))
    return out


@pytest.mark.parametrize("cut", [False, True])
@pytest.mark.parametrize("seed", [1, 2])
def test_agent_exposure_knows_only_what_was_known(spark, cut_everything, seed, cut):
    rng = random.Random(seed)
    rows = moves(seed + 10)
    verdicts = [(r[0], rng.choice([0, 1, 1, None]), r[3] + timedelta(days=rng.choice([-1, 0, 1, 6, 7, 9]), seconds=rng.choice([0, 1]))) for r in rows if rng.random() < 0.7]
    verdicts += [(v[0], 1 - (v[1] or 0), v[2] + timedelta(days=1)) for v in verdicts[:40]] + [("unknown", 1, T0), (rows[0][0], 1, None)]
    df = spark.createDataFrame(rows, TX).repartition(3)
    table = spark.createDataFrame(verdicts, "transaction_id string, label int, labeled_at timestamp_ntz")

    def found(v):
        done = agent_fraud_exposure(df, v, policy=cut_everything) if cut else agent_fraud_exposure(df, v)
        return {r.transaction_id: (r.cashouts, r.frauds, r.cashout_usd, r.fraud_usd) for r in done.collect()}

    got = found(table)
    assert got == exposure_plain(rows, verdicts) and any(x[1] for x in got.values())
    # later verdicts never change earlier rows
    middle = rows[len(rows) // 2][3]
    early = found(table.filter(F.col("labeled_at") <= F.lit(middle).cast("timestamp_ntz")))
    assert all(early[r[0]] == got[r[0]] for r in rows if r[1] is not None and r[3] <= middle)


def test_empty_tables(spark):
    df = spark.createDataFrame([], TX)
    assert cash_out_speed(df).count() == 0
    assert agent_fraud_exposure(df, spark.createDataFrame([], "transaction_id string, label int, labeled_at timestamp_ntz")).count() == 0
