import random

import pytest
from pyspark.sql import functions as F

from paywarden.plans import scan
from paywarden.plans.quantiles import exact_quantiles


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(7)
    # key "hot" holds most rows; many share a time
    return [("hot" if i % 3 else f"k{rng.randrange(20)}", rng.randrange(300), i, rng.choice([None, rng.randrange(100)]), rng.randrange(-5, 6))
            for i in range(1500)]


@pytest.fixture(scope="module")
def table(spark, rows):
    return spark.createDataFrame(rows, "key string, at int, id int, seen int, delta int").repartition(5)


def brute(rows, keyed=True):
    out, state = {}, {}
    for key, at, i, seen, delta in sorted(rows, key=lambda r: (r[1], r[2])):
        k = key if keyed else None
        total, last, low = state.get(k, (0, None, None))
        out[i] = (total, last, low)
        state[k] = (total + delta, seen if seen is not None else last, delta if low is None else min(low, delta))
    return out


@pytest.mark.parametrize("keys", [["key"], []])
def test_cut_and_whole_keys_agree_with_brute_force(spark, table, rows, cut_everything, keys):
    plan = scan.slice_plan(table, keys, ["at", "id"], cut_everything)
    assert plan is not None and plan.selectExpr("sum(size(__cuts))").first()[0] >= 3
    args = dict(sums={"total": F.col("delta")}, lasts={"last": F.col("seen")}, mins={"low": F.col("delta")})
    expected = brute(rows, bool(keys))
    for got in (scan.running(table, keys, ["at", "id"], plan=None, **args),
                scan.running(table, keys, ["at", "id"], policy=cut_everything, **args)):
        assert {r.id: (r.total, r["last"], r.low) for r in got.collect()} == expected


def test_small_input_is_not_inspected(spark):
    small = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    assert scan.slice_plan(small, ["user_id"], ["ts", "event_id"]) is None


def test_slices_are_balanced(spark, table, cut_everything):
    plan = scan.slice_plan(table, ["key"], ["at", "id"], cut_everything)
    sizes = [r["count"] for r in scan.with_slices(table, ["key"], ["at", "id"], plan)
             .filter("key = 'hot'").groupBy(scan.SLICE).count().collect()]
    assert len(sizes) >= 4 and max(sizes) < 500


def test_exact_quantiles(spark, table, rows, cut_everything):
    import numpy as np
    values = [r[1] for r in rows]
    got = exact_quantiles(table, "at", {"a": 0.05, "m": 0.5, "z": 0.95}, policy=cut_everything).first()
    assert [got.a, got.m, got.z] == pytest.approx(list(np.quantile(values, [0.05, 0.5, 0.95])))
