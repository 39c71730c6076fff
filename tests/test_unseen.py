import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from paywarden.operators import hash_tree as ht
from paywarden.operators import unseen as un
from paywarden.operators.models import train_logreg


def labelled(seed, n=4000):
    rng = np.random.default_rng(seed)
    rows = []
    for _ in range(n):
        a, b, c = rng.normal(size=3)
        kind = rng.choice(["S", "T", "V"]) if rng.random() < 0.15 else None
        if kind == "S":
            a += 1.5
        elif kind == "T":
            b += 2.0
        elif kind == "V":
            a, c = a + 1.0, c - 1.5
        rows.append((float(a), float(b), float(c), int(kind is not None), kind))
    return rows


def alone(rows, c=0.5):
    """One fit by Newton steps on all its rows."""
    x = np.array([[*r[:3], 1.0] for r in rows])
    y = np.array([r[3] for r in rows], float)
    weight = np.where(y == 1, len(y) / (2 * y.sum()), len(y) / (2 * (1 - y).sum()))
    ridge, w = np.array([1 / c] * 3 + [0.0]), np.zeros(4)
    for _ in range(50):
        p = 1 / (1 + np.exp(-x @ w))
        g = x.T @ (weight * (p - y)) + ridge * w
        w -= np.linalg.solve((x * (weight * p * (1 - p))[:, None]).T @ x + np.diag(ridge), g)
    return w


@pytest.fixture(scope="module")
def table(spark):
    rows = labelled(1)
    return rows, spark.createDataFrame(rows, "a double, b double, c double, y int, fraud_type string").repartition(5)


def test_each_fit_equals_a_fit_of_its_own(table):
    rows, df = table
    fits = un.leave_one_kind_out(df, ["a", "b", "c"])
    assert fits.kinds == ["", "S", "T", "V"] and fits.scans < 15 and fits.slope < 1e-9
    for k, w in zip(fits.kinds, fits.weights):
        assert w == pytest.approx(alone([r for r in rows if not k or r[4] != k]), abs=1e-6)


def test_the_whole_fit_is_that_of_the_library(table):
    _, df = table
    fits = un.leave_one_kind_out(df, ["a", "b", "c"])
    model = train_logreg(df, ["a", "b", "c"]).stages[-1]
    assert fits.weights[0] == pytest.approx([*model.coefficients, model.intercept], abs=1e-4)


def test_recall_of_the_unseen_kind(table):
    rows, df = table
    fits = un.leave_one_kind_out(df, ["a", "b", "c"])
    got = {r.fraud_type: r for r in un.unseen_recall(df, fits).collect()}
    for i, k in enumerate(fits.kinds[1:], 1):
        w, own = fits.weights[i], [r for r in rows if r[4] == k]
        found = sum(np.dot(w, [*r[:3], 1.0]) >= 0 for r in own)
        assert got[k].n == len(own) and got[k].recall_unseen == pytest.approx(found / len(own))
    # T alone moves b, so it can't be learned from the others
    assert got["T"].recall_unseen < got["T"].recall_seen - 0.2


def test_missing_values_and_classes(spark):
    schema = "a double, b double, c double, y int, fraud_type string"
    rows = [(0.1, 0.2, 0.3, 0, None), (None, 0.2, 0.3, 0, None), (0.9, 0.1, 0.3, 1, "S"), (0.5, 0.1, 0.0, 0, None)]
    fits = un.leave_one_kind_out(spark.createDataFrame(rows, schema), ["a", "b", "c"])
    assert fits.kinds == ["", "S"] and not fits.weights[1].any() and fits.weights[0].any()
    empty = spark.createDataFrame([], schema)
    none = un.leave_one_kind_out(empty, ["a", "b", "c"])
    assert not none.weights.any() and un.unseen_recall(empty, none).count() == 0


# --- hash tree -------------------------------------------------------------------------------------
def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def plain_root(rows):
    level = [sha("L" + "".join(f"{len(str(x))}:{x}" for x in r)) for r in sorted(rows)]
    while len(level) > 1:
        level = [sha("N" + level[i] + level[i + 1]) if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


def chains(n):
    rng = random.Random(n)
    return [(f"day{i:04}", f"{rng.getrandbits(64):016x}", rng.randrange(1, 99)) for i in range(n)]


def tree(spark, rows, policy=None):
    df = spark.createDataFrame(rows, "day string, tip string, n long").repartition(3)
    leaf = ht.leaves(df, ["day"], policy) if policy else ht.leaves(df, ["day"])
    return leaf, ht.hash_tree(leaf)


@pytest.mark.parametrize("n", [1, 2, 3, 7, 64, 101])
def test_root_and_proofs(spark, cut_everything, n):
    rows = chains(n)
    leaf, nodes = tree(spark, rows, cut_everything)
    top = ht.root(nodes)
    assert top == plain_root(rows)
    proved = ht.proofs(leaf, nodes).withColumn("to", ht.proved_root()).collect()
    assert len(proved) == n and all(r.to == top and len(r.proof) <= max(1, n - 1).bit_length() for r in proved)


def test_lost_added_and_swapped_chains_show(spark):
    rows = chains(33)
    _, nodes = tree(spark, rows)
    top = ht.root(nodes)
    swapped = [(rows[0][0], *rows[1][1:]), (rows[1][0], *rows[0][1:]), *rows[2:]]
    longer = [(*rows[0][:2], rows[0][2] + 1), *rows[1:]]
    for other in (rows[1:], [*rows, ("day9999", "ff", 1)], swapped, longer):
        assert ht.root(tree(spark, other)[1]) != top
    leaf, nodes = tree(spark, rows)
    wrong = ht.proofs(leaf, nodes).withColumn("to", ht.proved_root(F.sha2(F.lit("other"), 256)))
    assert wrong.filter(F.col("to") == top).count() == 0


def test_no_chains_no_tree(spark):
    leaf, nodes = tree(spark, chains(2))
    assert ht.root(ht.hash_tree(leaf.limit(0))) is None
