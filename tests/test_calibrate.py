import random
from itertools import combinations
from math import comb, gcd

import pytest
from pyspark.sql import functions as F

from paywarden.operators import calibrate as ca
from paywarden.operators import drift as dr


def plain_pav(pairs):
    """Pool-adjacent-violators over sorted distinct scores, one at a time."""
    counts = {}
    for s, y in pairs:
        n, p = counts.get(s, (0, 0))
        counts[s] = (n + 1, p + y)
    blocks = []
    for s in sorted(counts):
        blocks.append([s, s, *counts[s]])
        while len(blocks) > 1 and blocks[-2][3] / blocks[-2][2] >= blocks[-1][3] / blocks[-1][2]:
            _, hi, n, p = blocks.pop()
            blocks[-1][1:] = [hi, blocks[-1][2] + n, blocks[-1][3] + p]
    return [tuple(b) for b in blocks]


def sample(seed, n, ties):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        s = rng.random()
        out.append((round(s, ties), int(rng.random() < s * s)))
    return out


@pytest.mark.parametrize("ranges,limit", [(None, ca.LIMIT), (13, ca.LIMIT), (13, 3), (1, ca.LIMIT)])
def test_blocks_equal_plain_pooling(spark, ranges, limit):
    pairs = sample(1, 100_000, 4)
    df = spark.createDataFrame(pairs, "score double, label int").repartition(5)
    blocks = ca.isotonic(df, ranges=ranges, limit=limit)
    assert [tuple(r)[:4] for r in blocks.orderBy("lo").collect()] == plain_pav(pairs)


def test_pooling_parts_is_pooling_all():
    for seed in range(30):
        points = [(s, s, n, p) for s, _, n, p in plain_pav(sample(seed, 300, 2))]
        raw = sorted({(i / 50, i / 50, random.Random(seed * 100 + i).randint(1, 9), 0) for i in range(50)})
        raw = [(a, b, n, random.Random(i).randint(0, n)) for i, (a, b, n, _) in enumerate(raw)]
        cut = random.Random(seed).randrange(50)
        assert ca.pool(ca.pool(raw[:cut]) + ca.pool(raw[cut:])) == ca.pool(raw)
        assert ca.pool(points) == points


def test_probabilities_and_unknown_scores(spark):
    df = spark.createDataFrame([(0.1, 0), (0.2, 1), (0.3, 0), (0.9, 1), (None, 1), (float("nan"), 1), (0.5, None)], "score double, label int")
    blocks = ca.isotonic(df, ranges=3)
    assert [tuple(r) for r in blocks.orderBy("lo").collect()] == [(0.1, 0.1, 1, 0, 0.0), (0.2, 0.3, 2, 1, 0.5), (0.9, 0.9, 1, 1, 1.0)]
    asked = spark.createDataFrame([(-1.0,), (0.1,), (0.25,), (0.8,), (2.0,), (None,), (float("nan"),)], "score double")
    got = [r.probability for r in ca.calibrated(asked, blocks).collect()]
    assert got == [0.0, 0.0, 0.5, 0.5, 1.0, None, None]
    nothing = ca.isotonic(df.limit(0))
    assert nothing.count() == 0
    assert {r.probability for r in ca.calibrated(asked, nothing).collect()} == {None}


def test_curve_by_counting_each_threshold(spark, cut_everything):
    rng = random.Random(4)
    rows = [(round(rng.random(), 2), rng.choice([0, 0, 0, 1, None]), rng.choice([10.0, 20.5, None]), f"U{rng.randrange(40)}") for _ in range(800)]
    df = spark.createDataFrame(rows, "score double, label int, amount_usd double, user_id string").repartition(3)
    known = [r for r in rows if r[1] is not None]
    honest = len({r[3] for r in known if r[1] == 0})
    want = []
    for t in sorted({r[0] for r in known}):
        hit = [r for r in known if r[0] >= t]
        disturbed = len({r[3] for r in hit if r[1] == 0})
        want.append((t, round(sum(r[2] or 0 for r in hit if r[1] == 1), 6), sum(r[1] for r in hit), disturbed, round(10_000 * disturbed / honest, 6)))
    for policy in (cut_everything, None):
        curve = ca.avoidance_curve(df, policy=policy) if policy else ca.avoidance_curve(df)
        got = sorted((r.threshold, round(r.avoided_usd, 6), r.caught, r.disturbed, round(r.disturbed_per_10000, 6)) for r in curve.collect())
        assert got == want
    best = curve.withColumn("net", ca.net_value(curve, 2.0)).orderBy(F.desc("net")).first()
    assert best.net == max(w[1] - 2 * w[3] for w in want)
    assert ca.avoidance_curve(df.limit(0)).count() == 0


def enumerated(n, m, reach):
    """Share of all orders of n and m values in which the distance is at least reach / (n m)."""
    hits = 0
    for firsts in combinations(range(n + m), n):
        chosen, i, most = set(firsts), 0, 0
        for k in range(n + m):
            i += k in chosen
            most = max(most, abs(i * m - (k + 1 - i) * n))
        hits += most >= reach
    return hits / comb(n + m, n)


@pytest.mark.parametrize("n,m", [(1, 1), (2, 3), (4, 4), (3, 8), (6, 4), (8, 7), (8, 8)])
def test_exact_ks_law_equals_enumeration(n, m):
    for reach in range(0, n * m + 1, gcd(n, m)):
        assert dr.ks_exact_p(reach / (n * m), n, m) == pytest.approx(enumerated(n, m, reach), abs=1e-12)


def test_exact_law_meets_the_asymptotic_one(spark):
    rows = [("small", float(i), i < 4, i >= 4) for i in range(9)] + [("large", float(i % 997), True, False) for i in range(12_000)]
    rows += [("large", float((i * 7) % 1009), False, True) for i in range(11_000)] + [("alone", 1.0, True, False)]
    df = spark.createDataFrame(rows, "feature string, value double, r boolean, c boolean")
    table = dr.value_table(df.filter("r"), df.filter("c"))
    exact = {r.feature: r for r in dr.ks_2samp_exact(table).collect()}
    asymptotic = {r.feature: r for r in dr.ks_2samp(table).collect()}
    assert exact["large"] == asymptotic["large"]
    assert exact["small"].ks_p == pytest.approx(2 / comb(9, 4)) and exact["small"].ks_p != asymptotic["small"].ks_p
    d = 0.035
    assert dr.ks_exact_p(round(d * 4_000_000) / 4_000_000, 2000, 2000) == pytest.approx(
        spark.range(1).select(dr.ks_p_value(F.lit(d), F.lit(2000), F.lit(2000))).first()[0], rel=0.02)
