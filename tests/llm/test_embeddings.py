import math
from collections import defaultdict

import numpy as np
import pytest

from paywarden.llm import flat_graph
from paywarden.llm.queries import op3_embedding_copies
from tests.conftest import SF

SCHEMA = "vec_id long, embedding array<float>, label int, n string"


def plain(rows, threshold=0.98):
    by, out = defaultdict(list), {}
    for i, (vec_id, v, label, *_) in enumerate(rows):
        fine = v and None not in v and label is not None and all(map(math.isfinite, v)) and any(v)
        if fine:
            by[label, len(v)].append((i, vec_id, np.array(v, np.float32).astype(float)))
        else:
            out[i] = (vec_id, 0, vec_id)
    for group in by.values():
        x = np.array([v / np.linalg.norm(v) for _, _, v in group])
        near = x @ x.T >= threshold
        np.fill_diagonal(near, False)
        comp = list(range(len(group)))
        changed = True
        while changed:
            changed = False
            for a, b in zip(*np.nonzero(near)):
                low = min(comp[a], comp[b])
                changed |= comp[a] != low or comp[b] != low
                comp[a] = comp[b] = low
        for k, (i, vec_id, _) in enumerate(group):
            out[i] = (vec_id, int(near[k].sum()), min(g[1] for j, g in enumerate(group) if comp[j] == comp[k]))
    return sorted(out.values(), key=repr)


def clusters(rng, n, centres, size, noise):
    out = []
    for _ in range(centres):
        c = rng.normal(size=32)
        c /= np.linalg.norm(c)
        out += [c + rng.normal(size=32) * noise for _ in range(size)]
    return [*out, *rng.normal(size=(n, 32))]


@pytest.mark.parametrize("block", [8192, 50])
def test_links_equal_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(flat_graph, "BLOCK", block)
    monkeypatch.setattr(flat_graph, "CELL_NODES", 150)
    rng = np.random.default_rng(4)
    v = clusters(rng, 200, 6, 15, 0.015) + clusters(rng, 0, 1, 150, 0.012)
    rows = [(i, x.astype(np.float32).tolist(), int(i % 2) if i < 290 else 7) for i, x in enumerate(v)]
    rows += [(1000 + i, rows[0][1], 0) for i in range(30)]
    found = flat_graph.links(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=repr)
    want = plain(rows)
    links = sum(w[1] for w in want)
    assert [g[2] for g in got] == [w[2] for w in want] and all(g[1] <= w[1] for g, w in zip(got, want))
    assert sum(g[1] for g in got) >= (1.0 if block == 8192 else 0.9) * links > 0


def chained_rows(rng):
    """Chains whose next neighbours alone are linked, and tight groups that a single pair or a short chain joins."""
    def basis():
        return np.linalg.qr(rng.normal(size=(32, 2)))[0].T

    def arc(plane, angles):
        return [np.cos(t) * plane[0] + np.sin(t) * plane[1] for t in angles]

    v = []
    for n in (4, 9, 16):
        v += arc(basis(), np.arange(n) * 0.19)
    for steps in (1, 4):
        plane, ends = basis(), (0.0, 0.19 * steps)
        v += arc(plane, np.arange(steps + 1) * 0.19)
        for t, away in zip(ends, (-0.06, 0.06)):
            v += [w + rng.normal(size=32) * 0.004 for w in arc(plane, [t + away] * 25)]
    order = rng.permutation(len(v))
    return [(int(i), v[j].astype(np.float32).tolist(), 1) for i, j in enumerate(order)]


@pytest.mark.parametrize("block", [8192, 30])
def test_classes_of_chains_and_bridges(spark, monkeypatch, block):
    monkeypatch.setattr(flat_graph, "BLOCK", block)
    rows = chained_rows(np.random.default_rng(8))
    found = flat_graph.links(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3))
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=repr)
    want = plain(rows)
    assert len({w[2] for w in want}) == 5
    assert got == want


def test_forest_of_a_path_keeps_every_link():
    group, edges = np.arange(4), []
    for q, hit in enumerate(([2], [3], [0, 3], [1, 2])):          # 0-2, 2-3, 3-1: each keeps its smallest: 2-3 is lost
        edges += [(q, int(j)) for j in flat_graph.join_groups(group, np.array(hit), q)]
    assert len(set(group)) == 1 and len(edges) == 3
    assert flat_graph.join_groups(group, np.array([1, 2]), -1).tolist() == [1] and flat_graph.join_groups(group, np.array([], int), -1).tolist() == []


@pytest.mark.parametrize("threshold", [0.9, 0.98, 0.995])
def test_linked_pairs_share_a_cell(threshold):
    rng = np.random.default_rng(3)
    c = flat_graph.unit(rng.normal(size=(12, 8)))
    x = flat_graph.unit(rng.normal(size=(20_000, 8)))
    side = rng.normal(size=x.shape)
    side = flat_graph.unit(side - (side * x).sum(1, keepdims=True) * x)
    angle = np.arccos(threshold) * rng.uniform(0.97, 1, (len(x), 1))
    y = np.cos(angle) * x + np.sin(angle) * side
    margin = flat_graph.border(threshold)
    both = list(zip(flat_graph.cells(x, c, margin), flat_graph.cells(y, c, margin)))
    assert all(np.intersect1d(a, b).size for a, b in both)
    narrow = list(zip(flat_graph.cells(x, c, 0.8 * margin), flat_graph.cells(y, c, 0.8 * margin)))
    assert not all(np.intersect1d(a, b).size for a, b in narrow)


def test_pruning_equals_a_plain_loop_in_little_memory():
    import tracemalloc
    rng = np.random.default_rng(6)
    x = flat_graph.unit(rng.normal(size=(3000, 64)) + 2 * rng.normal(size=(60, 64))[rng.integers(0, 60, 3000)])
    pool = rng.integers(-1, 3000, (3000, 88))
    of = np.arange(3000)
    tracemalloc.start()
    got = flat_graph.prune(x, of, pool)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 60e6              # all at once: over 300 MB
    for i in range(0, 3000, 97):
        left, want = {int(j): 2 - 2 * x[i] @ x[j] for j in pool[i] if j >= 0 and j != i}, []
        while left and len(want) < flat_graph.DEGREE:
            want.append(min(left, key=left.get))
            left = {j: d for j, d in left.items() if j != want[-1] and flat_graph.ALPHA ** 2 * (2 - 2 * x[want[-1]] @ x[j]) > d}
        assert [j for j in got[i] if j >= 0] == want


def test_edge_vectors(spark):
    a = [1.0, 0.0, 0.0]
    rows = [(1, a, 1), (2, a, 1), (2, a, 1), (3, a, 2), (4, None, 1), (5, [], 1), (6, [0.0, 0.0, 0.0], 1), (7, [1.0, None, 0.0], 1), (8, [1.0, float("nan"), 0.0], 1),
            (9, a, None), (None, a, 1), (10, [2.0, 0.0, 0.0], 1), (11, [1.0, 0.0], 1), (12, [float("inf"), 0.0, 1.0], 1), (13, [1e-30, 0.0, 0.0], 1), (14, [-0.0, 1.0, 0.0], 3), (15, [0.0, 1.0, 0.0], 3)]
    got = {(r.vec_id, r.n_links, r.component_id, r.kept) for r in flat_graph.links(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA)).collect()}
    assert got == {(1, 5, 1, True), (2, 5, 1, False), (3, 0, 3, True), (4, 0, 4, True), (5, 0, 5, True), (6, 0, 6, True), (7, 0, 7, True), (8, 0, 8, True), (9, 0, 9, True),
                   (None, 5, 1, False), (10, 5, 1, False), (11, 0, 11, True), (12, 0, 12, True), (13, 5, 1, False), (14, 1, 14, True), (15, 1, 14, False)}
    assert flat_graph.links(spark.createDataFrame([], SCHEMA)).count() == 0


def test_op3_and_audit(spark):
    vectors = spark.read.parquet(f"{SF}/embeddings.parquet")
    found = op3_embedding_copies(spark, SF)
    got = sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=repr)
    assert got == plain([(r.vec_id, r.embedding, r.label) for r in vectors.collect()])
    hit, true = flat_graph.audit(vectors, found)
    assert hit >= 0.9 * true


@pytest.mark.parametrize("tile", [1 << 22, 40 * 32])
def test_graphs_hold_only_nodes_that_another_is_near_to(spark, monkeypatch, tile):
    monkeypatch.setattr(flat_graph, "TILE", tile)
    monkeypatch.setattr(flat_graph, "COMPARED", 64 * 7)
    monkeypatch.setattr(flat_graph, "CELL_NODES", 100)
    rng = np.random.default_rng(12)
    v = [*clusters(rng, 300, 8, 5, 0.012), *rng.normal(size=(2, 4))]
    order = rng.permutation(len(v))
    rows = [(int(i), v[j].astype(np.float32).tolist(), int(j % 2) if j >= 40 else 1) for i, j in enumerate(order)]
    written = {}

    def kept(df, name, put=flat_graph.materialise):
        written[name] = put(df, name)
        return written[name]

    monkeypatch.setattr(flat_graph, "materialise", kept)
    found = flat_graph.links(spark.createDataFrame([(*r, "x") for r in rows], SCHEMA).repartition(3))
    assert sorted(((r.vec_id, r.n_links, r.component_id) for r in found.collect()), key=repr) == plain(rows)
    near = {w[0] for w in plain(rows, 0.98 - 0.03) if w[1]}
    vectors = {tuple(r[1]): r[0] for r in rows}
    assert {vectors[tuple(r.embedding)] for r in written["vector-blocks"].collect()} == near and 0 < len(near) < 60


@pytest.mark.parametrize("compared", [1, 300, 1 << 20])
def test_near_pairs_by_products_equal_all_pairs(monkeypatch, compared):
    monkeypatch.setattr(flat_graph, "COMPARED", compared)
    x = flat_graph.unit(clusters(np.random.default_rng(2), 60, 5, 4, 0.02)).astype(np.float32)
    near = x.astype(float) @ x.T.astype(float) >= 0.95
    np.fill_diagonal(near, False)
    assert flat_graph.near_itself(x, 0.95).tolist() == near.any(1).tolist()
    a, b = x[::2], x[1::2]
    got = flat_graph.near_each_other(a, b, 0.95)
    assert [g.tolist() for g in got] == [near[::2, 1::2].any(1).tolist(), near[::2, 1::2].any(0).tolist()]
    assert flat_graph.near_itself(x[:1], 0.95).tolist() == [False]
