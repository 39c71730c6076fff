import hashlib
import math
import random

import numpy as np
import pytest

from paywarden.llm import vector_codes as vc
from paywarden.llm.queries import op12_sql, op12_vector_codes
from tests.conftest import SF


def plain(rows, parts=16, entries=64, rounds=2):
    """The definition, by comparing every part with every entry. Rows are (id, vector, label)."""
    good = [r for r in rows if r[1] and all(x is not None and math.isfinite(x) for x in r[1])]
    if not good:
        return {}, None
    good.sort(key=lambda r: (r[0], r[1]))
    good = [r for r in good if len(r[1]) == len(good[0][1])]
    width = len(good[0][1]) // parts
    whole = [[math.floor(256 * x) if abs(x) < 1e15 else 256 * int(x) for x in r[1]] for r in good]
    cut = [[w[p * width:(p + 1) * width] for p in range(parts)] for w in whole]
    books = [[c[p] for c in cut[:entries]] for p in range(parts)]

    def near(p, x):
        return min((sum((a - b) ** 2 for a, b in zip(x, e)), i) for i, e in enumerate(books[p]))

    for _ in range(rounds):
        new = []
        for p in range(parts):
            members = {}
            for c in cut:
                members.setdefault(near(p, c[p])[1], []).append(c[p])
            new.append([[sum(col) // len(members[i]) for col in zip(*members[i])] if i in members else e for i, e in enumerate(books[p])])
        books = new
    out, by_label = [], {}
    for r, c in zip(good, cut):
        found = [near(p, c[p]) for p in range(parts)]
        out.append((r[0], "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), r[2]))
        by_label[r[2]] = by_label.get(r[2], 0) + out[-1][2]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    return sorted((i, c, e, by_label[k]) for i, c, e, k in out), digest


def both(spark, rows, **options):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int").repartition(3)
    done = vc.encode(df, **options).collect()
    got = [(r.vec_id, r.code, r.error, r.label_error) for r in done]
    want, digest = plain(rows, **options)
    fits = [tuple(None if k > 1 and x > vc.LONG_MAX else x for k, x in enumerate(r)) for r in want]
    assert sorted(got, key=str) == sorted(fits, key=str)
    assert {r.codebooks_sha256 for r in done} == {digest}


def test_orchard_finds_the_nearest_entry_and_the_lower_index():
    rng = np.random.default_rng(5)
    for span in (3, 40, 100_000):
        entries = rng.integers(-span, span, (64, 4))
        parts = np.concatenate([rng.integers(-2 * span, 2 * span, (500, 4)), entries])
        codes, best = vc.Orchard(entries).nearest(parts)
        distance = ((parts[:, None, :] - entries[None]) ** 2).sum(2)
        assert codes.tolist() == distance.argmin(1).tolist()
        assert best.tolist() == distance.min(1).tolist()


def test_orchard_leaves_most_distances_out():
    rng = np.random.default_rng(7)
    entries = rng.integers(-10_000, 10_000, (64, 2))
    search = vc.Orchard(entries)
    search.nearest(np.repeat(entries, 20, 0) + rng.integers(-300, 300, (1280, 2)))
    assert search.measured < 0.4 * 1280 * 64


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rows_equal_the_definition(spark, seed):
    rng = random.Random(seed)
    rows = [(i, [rng.gauss(0, 1) for _ in range(32)], rng.choice([0, 1, 1, 1, None])) for i in range(300)]
    rows += [(300 + i, rows[i % 3][1], 1) for i in range(150)]             # copies, and a hot label
    both(spark, rows)


def test_edge_rows(spark):
    vector = [0.25 * i for i in range(16)]
    rows = [(5, vector, 1), (5, vector, 1), (5, [-x for x in vector], None), (6, None, 1), (7, [], 1), (8, [float("nan"), *vector[1:]], 1),
            (9, [None, *vector[1:]], 1), (10, [float("inf"), *vector[1:]], 2), (11, vector[:8], 2), (12, [1e6, *vector[1:]], 2),
            (None, vector, 3)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    done = vc.encode(df).collect()
    want, _ = plain([r for r in rows if r[0] is not None] + [(1 << 40, vector, 3)])
    got = [(r.vec_id if r.vec_id is not None else 1 << 40, r.code, r.error, r.label_error) for r in done]
    assert sorted(got) == want


def test_components_of_any_finite_size_are_exact(spark):
    rng = random.Random(3)
    rows = [(i, [rng.choice([-1, 1]) * 10.0 ** rng.randint(-3, 9) for _ in range(16)], i % 2) for i in range(90)]
    both(spark, [(i, v, k) for i, v, k in rows], entries=4)
    huge = [(0, [0.0] * 16, 1), (1, [1e300] * 16, 1), (2, [-1e300] * 16, 1), (3, [1e300] * 15 + [0.0], 1)]
    df = spark.createDataFrame(huge, "vec_id long, embedding array<double>, label int")
    codes = {r.vec_id: r for r in vc.encode(df, entries=2, rounds=1).collect()}
    assert codes[0].error is None and codes[0].code == "00" * 16 and codes[3].code == "01" * 15 + "00"


def test_empty_tables_and_clashing_names(spark):
    df = spark.createDataFrame([], "vec_id long, embedding array<double>, label int, CODE int, extra int")
    assert vc.encode(df).columns == ["vec_id", "embedding", "label", "extra", "code", "error", "label_error", "codebooks_sha256"]
    assert vc.encode(df).count() == 0
    one = spark.createDataFrame([(1, [0.5] * 16, 1, 7, 8)], df.schema)
    row = vc.encode(one).first()
    assert (row.code, row.error, row.label_error, row.extra) == ("00" * 16, 0, 0, 8)
    odd = spark.createDataFrame([(1, [0.5] * 15, 1, 7, 8)], df.schema)
    assert vc.encode(odd).count() == 0


def test_query_equals_sql_and_the_definition(spark):
    import duckdb
    got = sorted(tuple(r) for r in op12_vector_codes(spark, SF).collect())
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{SF}/embeddings.parquet'")
    assert got == sorted(con.execute(op12_sql()).fetchall())
    rows = [(r.vec_id, r.embedding, r.label) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    want, digest = plain(rows)
    assert [r[:4] for r in got] == want and {r[4] for r in got} == {digest}
