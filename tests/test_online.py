import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from checks.tables import profiles, transactions
from paywarden.operators.features import FEATURE_NAMES, INPUT_COLUMNS, build_features
from paywarden.operators.snapshots import apply_decisions
from paywarden.session import materialise
from paywarden.streaming import online
from tests.conftest import SF

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
START = "2024-01-01 00:00:00"


def in_batches(spark, rows, folder, edges):
    """One file per span of time, read one per micro-batch in that order."""
    for i, (low, high) in enumerate(zip([None, *edges], [*edges, None])):
        part = rows
        if low is not None:
            part = part.filter(F.col("timestamp") >= F.lit(low).cast("timestamp_ntz"))
        if high is not None:
            part = part.filter(F.col("timestamp") < F.lit(high).cast("timestamp_ntz"))
        part.coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(folder)


def run(spark, stream, name, tmp_path):
    q = (stream.writeStream.format("memory").queryName(name).option("checkpointLocation", str(tmp_path / name))
         .trigger(availableNow=True).start())
    q.awaitTermination(300)
    assert q.exception() is None
    return spark.table(name), q.recentProgress


def comparable(df):
    return sorted((r.transaction_id, *[round(r[n] + 1e-9, 6) for n in FEATURE_NAMES]) for r in df.collect())


@pytest.fixture(autouse=True)
def rocks(spark):
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


def test_five_batches_give_every_feature_of_the_whole_table(spark, tmp_path):
    rows = materialise(transactions(spark, SF).select(*INPUT_COLUMNS), "online-tx")
    stream = in_batches(spark, rows, str(tmp_path / "in"), ["2024-01-05", "2024-01-12", "2024-01-12 12:00:00", "2024-01-24"])
    got, progress = run(spark, online.online_features(stream, profiles(spark, SF), START, precise=True), "five", tmp_path)
    assert sum(p.numInputRows > 0 for p in progress) == 5
    want = build_features(rows, profiles(spark, SF), START, precise=True)
    assert comparable(got) == comparable(want)


def busy(seed, n, users=3):
    """Few entities and close times, so that rows of a batch share all keys; ties and absent values."""
    rng = random.Random(seed)
    at, rows = datetime(2024, 1, 1), []
    for i in range(n):
        at += timedelta(seconds=rng.choice([0, 1, 60, 3600, 7200, 86400]))
        kind = rng.choice(["P2P_SEND", "CASH_IN", "CARD_TOPUP", "CARD_PURCHASE", "MERCHANT_PAYMENT"])
        rows.append((f"T{i:04}", at, f"U{rng.randrange(users)}", "MOBILE_MONEY", kind, "APP", rng.choice([5.0, 80.0, 300.0]), 500.0,
                     rng.choice(["SUCCESS", "FAILED", None, None]), f"W{rng.randrange(2)}", rng.choice([None, "M1", "M2"]), "GAMING", "CD",
                     rng.choice([None, "A1"]), rng.choice([None, "D1", "D2"]), "smartphone", "CD", rng.choice([None, "P1", "P2"])))
    return rows


def busy_table(spark, rows):
    from paywarden.schema import HISTORY
    schema = ", ".join(f"{n} {HISTORY[n].dataType.simpleString()}" for n in INPUT_COLUMNS)
    return spark.createDataFrame(rows, schema)


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_of_a_batch_see_each_other_with_decided_status(spark, tmp_path, seed):
    rows = materialise(busy_table(spark, busy(seed, 120)), "busy")
    users = profiles(spark, SF)

    def block_large(row, past):
        return "BLOCK" if row["amount"] > 200 or past["past_f24h"] > 3 else "APPROVE"

    stream = in_batches(spark, rows, str(tmp_path / "in"), ["2024-01-08", "2024-01-20"])
    got, _ = run(spark, online.online_features(stream, users, START, block_large, precise=True), f"busy{seed}", tmp_path)
    actions = got.filter("action is not null").select("transaction_id", "action")
    assert actions.filter("action = 'BLOCK'").count() > 3 and actions.count() == rows.filter("status is null").count()
    # the table as its rows were decided gives the same features in one go
    want = build_features(apply_decisions(rows, actions), users, START, precise=True)
    assert comparable(got) == comparable(want)


def test_state_stays_the_same_size_under_a_steady_load(spark, tmp_path):
    rows = []
    for day in range(0, 60, 2):
        at = datetime(2024, 1, 1) + timedelta(days=day)
        rows += [(f"T{day:03}{i}", at + timedelta(hours=i), f"U{i % 2}", "MOBILE_MONEY", "CASH_IN", "APP", 5.0, 10.0, "SUCCESS", None, None, None,
                  None, f"A{i % 2}", f"D{i % 2}", "smartphone", "CD", "P1") for i in range(6)]
    table = materialise(busy_table(spark, rows), "steady")
    edges = [f"2024-01-{d:02}" for d in (9, 17, 25)] + [f"2024-02-{d:02}" for d in (2, 10, 18, 26)]
    stream = in_batches(spark, table, str(tmp_path / "in"), edges)
    _, progress = run(spark, online.online_features(stream, profiles(spark, SF), START), "steady", tmp_path)
    sizes = [[s.numRowsTotal for s in p.stateOperators] for p in progress if p.numInputRows > 0]
    assert len(sizes) == 8
    assert sizes[-1] == sizes[-2] == sizes[4]


def test_idle_keys_lose_their_windows(spark, tmp_path):
    """An agent's users and a user's recent rows leave by timers once the watermark has passed them."""
    early = busy(5, 40)
    late = [(f"Z{i}", datetime(2024, 9, 1) + timedelta(days=20 * i), "U9", *early[0][3:13], None, "D9", *early[0][15:]) for i in range(4)]
    table = materialise(busy_table(spark, early + late), "idle")
    stream = in_batches(spark, table, str(tmp_path / "in"), ["2024-08-01", "2024-09-10", "2024-10-01", "2024-10-20"])
    got, _ = run(spark, online.online_features(stream, profiles(spark, SF), START, precise=True), "idle", tmp_path)
    assert comparable(got) == comparable(build_features(
        apply_decisions(table, got.filter("action is not null").select("transaction_id", "action")), profiles(spark, SF), START, precise=True))
    state = spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "recent").load(str(tmp_path / "idle"))
    users = {r.key.who for r in state.select("key").collect()}
    assert users <= {"U9"}


class Calls:
    """A key's state variables in plain dicts, counting the round trips."""

    def __init__(self):
        self.made, self.vars = 0, {}

    def getMapState(self, name, *schema):
        return Variable(self, self.vars.setdefault(name, {}))

    getValueState = getMapState

    def registerTimer(self, at):
        self.made += 1


class Variable:
    def __init__(self, calls, held):
        self.calls, self.held = calls, held

    def getValue(self, key):
        self.calls.made += 1
        return self.held.get(key)

    def get(self):
        return self.getValue(None)

    def updateValue(self, key, value):
        self.calls.made += 1
        self.held[key] = value

    def update(self, value):
        self.updateValue(None, value)

    def removeKey(self, key):
        self.calls.made += 1
        self.held.pop(key, None)

    def iterator(self):
        self.calls.made += 1
        return iter(list(self.held.items()))


def test_entries_in_buckets_equal_a_dict_and_are_dealt_anew(monkeypatch):
    monkeypatch.setattr(online, "BUCKET", 4)
    rng, state, want = random.Random(3), Calls(), {}
    packed = online.Packed(state.getMapState("m"))
    for step in range(60):
        packed.open(len(want))
        if rng.random() < 0.2:
            assert packed.all() == want
        for _ in range(rng.randrange(30)):
            name = rng.choice(["é", "", "a b", "\ud800"]) + str(rng.randrange(40 if step < 40 else 4))
            assert packed.get(name) == want.get(name)
            if rng.random() < (0.6 if step < 30 else 0.2):
                packed.put(name, step)
                want[name] = step
            elif name in want:
                packed.drop(name)
                del want[name]
        packed.save()
        assert packed.n == len(want) and set(state.vars["m"]) <= {(i,) for i in range(packed.buckets_for(len(want)))}
    packed.open(len(want))
    assert packed.all() == want and 0 < len(want) < 80


def test_a_batch_of_a_key_makes_few_calls_to_the_state():
    def device_row(i, user):
        carried = '{"amount":5.0,"la":1.5,"cents":500,"debit":1,"night":0,"sin":0.1,"cos":0.9,"topup":0,"status":"SUCCESS","province":"P%d"}' % (i % 7)
        return online.Linked("D", f"D{i % 40}", user, datetime(2024, 1, 1), 10 ** 9 * i, f"T{i}", carried, "{}", 3)

    calls = Calls()
    past = online.UserPast(None)
    past.init(calls)
    for batch in range(3):
        out = list(past.handleInputRows(("U1",), iter([device_row(i, "U1") for i in range(200 * batch, 200 * batch + 200)]), None))
        assert len(out) == 200
    assert calls.made <= 3 * 8
    calls = Calls()
    crowd = online.Crowd()
    crowd.init(calls)
    for batch in range(3):
        rows = [online.Linked("C", "W1", f"U{i % 90}", datetime(2024, 1, 1), 10 ** 9 * i, f"T{i}", None, None) for i in range(200 * batch, 200 * batch + 200)]
        out = list(crowd.handleInputRows(("C", "W1"), iter(rows), None))
    assert [r.others for r in out] == [89] * 200 and calls.made <= 3 * 4
