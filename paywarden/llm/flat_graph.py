"""Near-duplicate embeddings through a robust-pruned flat graph on overlapping shards.

    vectors ── equal ones of a label become one node with a count
            ── cells: the nearest of K centres and every cell whose border lies within the margin
            ── screen: nodes that some other node of their shard comes near to, in single precision
            ── shard = (label, cell), cut into blocks of `BLOCK` of these nodes where it is larger
    build   ── per block: batches are inserted by greedy search from the medoid, robust pruning
               (degree `DEGREE`, slack `ALPHA`), reverse edges pruned again
    union   ── a node's adjacency lists of all its shards become one list
    search  ── every node of a shard in every block of it: greedy search from the medoid (and from the node
               itself in its own block), then expansion of all nodes in range until none is left
    verify  ── cosine in double precision, >= `threshold`; a pair that two shards hold counts in the first
    classes ── connected nodes

The margin is half the largest distance of two linked vectors, sqrt((1 - threshold) / 2): of a linked pair on
two sides of a border one vector lies within it, so every linked pair shares a cell.

The screen compares the nodes of a shard by matrix products, a small part of what a graph over them costs. A node
with none at `threshold` less `RANGE`, how far the search expands, has no links, and no other node's expansion
comes to it; the graphs hold the rest. Shards of more than `TILE` values are compared tile by tile.

Centres come from a hashed sample of about `SAMPLE` nodes; every vector is indexed and every vector is a
query. Memory of a task is bounded by the sizes of block and tile, whatever a label or a cell holds; a task returns a count
per node and a spanning forest of its links (fewer edges than nodes), never pairs. `audit` measures recall
against brute force.

Vectors that are null, zero, hold null or non-finite values or have a null label link with nothing. A vector
of another length than the others of its label forms a group of its own. Rows that repeat a vec_id are
vectors of their own. An empty table gives no rows; extra columns are ignored.
"""
from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import connected
from paywarden.session import materialise

SAMPLE, CELL_NODES, MAX_CELLS = 20_000, 40_000, 5_000
BLOCK, DEGREE, BEAM, ALPHA, POOL = 8_192, 24, 32, 1.2, 64
RANGE, TILE, COMPARED = 0.03, 1 << 22, 1 << 23          # TILE: vector components; COMPARED: pairs at once
NODE = "node binary, label int, embedding array<float>, n long"


def unit(rows: list | np.ndarray) -> np.ndarray:
    v = np.array(rows, np.float64)
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def nodes_of(df: DataFrame, ident: str, vector: str, label: str) -> DataFrame:
    """vec_id, label, embedding, node (null for vectors that link with nothing)."""
    rows = df.select(F.col(ident).cast("long").alias("vec_id"), F.col(label).cast("int").alias("label"), F.col(vector).cast("array<float>").alias("embedding"))

    def run(batches):
        for batch in batches:
            node = []
            for lab, v in zip(batch.column("label").to_pylist(), batch.column("embedding").to_pylist()):
                fine = lab is not None and v and None not in v
                a = np.array(v, np.float32) + np.float32(0) if fine else None       # -0.0 becomes 0.0
                fine = fine and np.isfinite(a).all() and (a != 0).any()
                node.append(xxhash.xxh3_128_digest(a.tobytes() + lab.to_bytes(4, "little", signed=True)) if fine else None)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(node, pa.binary())], names=[*batch.schema.names, "node"])

    return rows.mapInArrow(run, "vec_id long, label int, embedding array<float>, node binary")


def centres(nodes: DataFrame, total: int, seed: int = 11) -> dict[int, np.ndarray]:
    """By vector length: unit centres fitted with a few rounds of spherical k-means on a hashed sample."""
    grain = 1 << 30
    rows = nodes.filter(F.pmod(F.xxhash64("node"), F.lit(grain)) < int(grain * min(1.0, SAMPLE / max(1, total)))).select("embedding").collect()
    by: dict[int, list] = {}
    for r in rows:
        by.setdefault(len(r["embedding"]), []).append(r["embedding"])
    out, rng = {}, np.random.default_rng(seed)
    for size, own in by.items():
        x = unit(own)
        k = min(max(1, round(total * len(own) / len(rows) / CELL_NODES)), MAX_CELLS, len(x))
        c = x[rng.choice(len(x), k, replace=False)]
        for _ in range(8):
            of = (x @ c.T).argmax(1)
            total_of = np.zeros_like(c)
            np.add.at(total_of, of, x)
            norm = np.linalg.norm(total_of, axis=1, keepdims=True)
            c = np.where(norm > 0, total_of / np.maximum(norm, 1e-12), c)
        out[size] = c
    return out


def border(threshold: float) -> float:
    """The margin that lets every pair of unit vectors with cosine >= threshold share a cell."""
    return max(0.0, (1 - threshold) / 2) ** 0.5 + 1e-6


def cells(x: np.ndarray, c: np.ndarray, margin: float) -> list[np.ndarray]:
    """For each unit vector: the cells whose border is within the margin, its nearest cell among them."""
    sim = x @ c.T
    nearest = sim.argmax(1)
    apart = np.linalg.norm(c[nearest][:, None, :] - c[None, :, :], axis=2) if len(c) <= 64 else None
    out = []
    for i, j in enumerate(nearest):
        gap = sim[i, j] - sim[i]                       # (|x-c|^2 - |x-c_j|^2) / 2 for unit centres
        width = apart[i] if apart is not None else np.linalg.norm(c - c[j], axis=1)
        out.append(np.flatnonzero(gap <= margin * np.maximum(width, 1e-9)))
    return out


def shards(nodes: DataFrame, found: dict[int, np.ndarray], threshold: float) -> DataFrame:
    """One row per node and cell; `cells` holds all cells of the node."""
    spec, margin = nodes.sparkSession.sparkContext.broadcast(found), border(threshold)

    def run(batches):
        for batch in batches:
            vectors = batch.column("embedding").to_pylist()
            of: list = [None] * len(vectors)
            by: dict[int, list[int]] = {}
            for i, v in enumerate(vectors):
                by.setdefault(len(v), []).append(i)
            for size, own in by.items():
                c = spec.value.get(size)
                got = cells(unit([vectors[i] for i in own]), c, margin) if c is not None else [np.array([0])] * len(own)
                for i, g in zip(own, got):
                    of[i] = [size << 32 | int(j) for j in g]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(of, pa.list_(pa.int64()))], names=[*batch.schema.names, "cells"])

    return nodes.mapInArrow(run, f"{NODE}, cells array<long>").withColumn("cell", F.explode("cells"))


def screened(member: DataFrame, threshold: float) -> DataFrame:
    """The rows of nodes that another node of one of their shards is near to."""
    shard = ["label", "cell"]
    sizes = member.groupBy(*shard).agg(F.ceil(F.count(F.lit(1)) * F.shiftright("cell", 32) / TILE).cast("int").alias("tiles"))
    tiled = (member.select("node", "embedding", *shard).join(sizes, shard)
             .withColumn("tile", F.pmod(F.xxhash64("node", F.lit(1)), F.col("tiles")).cast("int"))
             .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("tiles") - 1))))
    pairs = tiled.withColumns({"low": F.least("tile", "other"), "high": F.greatest("tile", "other")})
    found = pairs.groupBy(*shard, "low", "high").applyInArrow(near_tiles(threshold - RANGE), "node binary")
    return member.join(materialise(found.distinct(), "vector-near"), "node", "left_semi")


def near_tiles(least: float):
    def run(table: pa.Table) -> pa.Table:
        """Nodes of a tile, or of two, that one of the tile, or of the other one, is near to."""
        x = unit(matrix(table.column("embedding"))).astype(np.float32)
        tile, low = table.column("tile").to_numpy(), table.column("low")[0].as_py()
        near = np.zeros(len(x), bool)
        if low == table.column("high")[0].as_py():
            near |= near_itself(x, least)
        else:
            a, b = np.flatnonzero(tile == low), np.flatnonzero(tile != low)
            near[a], near[b] = near_each_other(x[a], x[b], least)
        return pa.table({"node": table.column("node").filter(pa.array(near))})

    return run


def matrix(column: pa.ChunkedArray) -> np.ndarray:
    """Vectors of one length as rows."""
    flat = np.concatenate([c.flatten().to_numpy() for c in column.chunks])
    return flat.reshape(len(column), -1)


def near_itself(x: np.ndarray, least: float) -> np.ndarray:
    near = np.zeros(len(x), bool)
    step = max(1, min(1024, COMPARED // len(x)))
    for i in range(0, len(x), step):        # each pair once
        own, rest = x[i:i + step], x[i + step:]
        hit = own @ own.T >= least
        np.fill_diagonal(hit, False)
        near[i:i + step] |= hit.any(1)
        if len(rest):
            a, b = near_each_other(own, rest, least)
            near[i:i + step] |= a
            near[i + step:] |= b
    return near


def near_each_other(a: np.ndarray, b: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    of_a, of_b = np.zeros(len(a), bool), np.zeros(len(b), bool)
    step = max(1, min(1024, COMPARED // max(1, len(b))))
    for i in range(0, len(a), step):
        hit = a[i:i + step] @ b.T >= least
        rows = np.flatnonzero(hit.any(1))
        of_a[i + rows] = True
        of_b |= hit[rows].any(0)
    return of_a, of_b


def prune(x: np.ndarray, of: np.ndarray, pool: np.ndarray) -> np.ndarray:
    """Robust pruning of each node's pool (-1 pads): the nearest stays, and removes those it is nearer to
    by ALPHA than the node is. Returns (nodes, DEGREE), -1 padded."""
    if len(of) > 128:           # what is compared at once stays in the processor's cache
        return np.concatenate([prune(x, of[i:i + 128], pool[i:i + 128]) for i in range(0, len(of), 128)])
    v = x[np.maximum(pool, 0)]
    own = 2 - 2 * (v @ x[of][:, :, None])[:, :, 0]
    between = ALPHA ** 2 * (2 - 2 * (v @ v.transpose(0, 2, 1)))
    left = np.where((pool >= 0) & (pool != of[:, None]), own, np.inf)
    out = np.full((len(of), DEGREE), -1, np.int64)
    rows = np.arange(len(of))
    for r in range(DEGREE):
        at = left.argmin(1)
        ok = left[rows, at] < np.inf
        if not ok.any():
            break
        out[ok, r] = pool[rows, at][ok]
        left[between[rows, at] <= own] = np.inf
        left[rows, at] = np.inf
    return out


def greedy(x: np.ndarray, graph: np.ndarray, q: np.ndarray, entry: int, beam: int = BEAM,
           own: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Best-first search of all queries together from `entry`, and from a query's own node where it has one
    (`own`, -1 without): (ids, similarities) of the beam, and the visited matrix."""
    n = len(q)
    ids = np.full((n, beam), -1, np.int64)
    sim = np.full((n, beam), -np.inf, x.dtype)
    done = np.ones((n, beam), bool)
    visited = np.zeros((n, len(x)), bool)
    ids[:, 0], sim[:, 0], done[:, 0] = entry, q @ x[entry], False
    visited[:, entry] = True
    if own is not None:
        has = np.flatnonzero((own >= 0) & (own != entry))
        ids[has, 1], sim[has, 1], done[has, 1] = ids[has, 0], sim[has, 0], False
        ids[has, 0], sim[has, 0], visited[has, own[has]] = own[has], 1.0, True
    active = np.arange(n)
    while len(active):
        at = done[active].argmin(1)                   # the beam is sorted: the best open one
        here = ids[active, at]
        done[active, at] = True
        near = graph[here]
        fresh = (near >= 0) & ~visited[active[:, None], np.maximum(near, 0)]
        asker, found = np.repeat(active, fresh.sum(1)), near[fresh]
        visited[asker, found] = True
        value = np.full(near.shape, -np.inf, sim.dtype)
        value[fresh] = np.einsum("nd,nd->n", x[found], q[asker])
        all_sim = np.hstack([sim[active], value])
        order = np.argsort(-all_sim, axis=1, kind="stable")[:, :beam]
        rows = np.arange(len(active))[:, None]
        sim[active] = all_sim[rows, order]
        ids[active] = np.hstack([ids[active], np.where(fresh, near, -1)])[rows, order]
        done[active] = np.hstack([done[active], ~fresh])[rows, order]
        active = active[~done[active].all(1)]
    return ids, sim, visited


def build(x: np.ndarray, seed: int = 5) -> np.ndarray:
    """Adjacency (nodes, DEGREE) of one block, -1 padded: a pass that inserts in doubling batches, and one that
    searches the whole graph again for every node, with its list as a start."""
    n = len(x)
    graph = np.full((n, DEGREE), -1, np.int64)
    x = x.astype(np.float32)                # a graph needs no more; links are verified in double precision
    entry = medoid(x)
    order = np.random.default_rng(seed).permutation(n)
    order = np.concatenate([[entry], order[order != entry]])
    start = 1
    while start < n:
        batch = order[start:start + min(start, 256)]
        start += len(batch)
        ids, _, _ = greedy(x, graph, x[batch], entry, POOL)
        # members of one batch don't see each other in the graph yet, so they join each other's pools
        mates = np.argsort(-(x[batch] @ x[batch].T), axis=1)[:, :8] if len(batch) > 1 else np.zeros((1, 0), int)
        graph[batch] = prune(x, batch, np.hstack([ids, batch[mates]]))
        back(x, graph, batch)
    for start in range(0, n, 256):
        batch = order[start:start + 256]
        ids, _, _ = greedy(x, graph, x[batch], entry, POOL, batch)
        pool = np.hstack([graph[batch], np.where((ids[:, :, None] == graph[batch][:, None, :]).any(2), -1, ids)])
        graph[batch] = prune(x, batch, pool)
        back(x, graph, batch)
    return graph


def back(x: np.ndarray, graph: np.ndarray, batch: np.ndarray) -> None:
    """Reverse edges of a batch; lists that overflow are pruned."""
    source, target = np.repeat(batch, DEGREE), graph[batch].ravel()
    source, target = source[target >= 0], target[target >= 0]
    order = np.argsort(target, kind="stable")
    source, target = source[order], target[order]
    node, first, count = np.unique(target, return_index=True, return_counts=True)
    width = DEGREE + int(count.max(initial=0))
    for start in range(0, len(node), 512):
        own, f, c = node[start:start + 512], first[start:start + 512], count[start:start + 512]
        pool = np.full((len(own), width), -1, np.int64)
        pool[:, :DEGREE] = graph[own]
        row = np.repeat(np.arange(len(own)), c)
        col = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
        pool[row, DEGREE + col] = source[np.repeat(f, c) + col]
        pool = pool[:, np.argsort(-(pool >= 0).sum(0), kind="stable")]
        # the nearest POOL + DEGREE of a long list are pruned; the others' own lists still lead there
        own_sim = np.full(pool.shape, -np.inf, x.dtype)
        own_sim[pool >= 0] = np.einsum("nd,nd->n", x[pool[pool >= 0]], x[np.repeat(own, (pool >= 0).sum(1))])
        best = np.argsort(-own_sim, axis=1, kind="stable")[:, :POOL + DEGREE]
        pool = np.take_along_axis(pool, best, 1)
        graph[own] = prune(x, own, pool)


def medoid(x: np.ndarray) -> int:
    return int((x @ x.mean(0)).argmax())


def in_range(x: np.ndarray, graph: np.ndarray, q: np.ndarray, least: float, own: np.ndarray) -> np.ndarray:
    """Visited matrix after greedy search and expansion of every node with similarity >= least."""
    _, _, visited = greedy(x, graph, q, medoid(x), BEAM, own)
    # expansion walks edges both ways, so that a node no list leads to is still found
    source, target = np.nonzero(graph >= 0)[0], graph[graph >= 0]
    edge = np.unique(np.concatenate([source * len(x) + target, target * len(x) + source]))
    source, target = edge // len(x), edge % len(x)
    first = np.searchsorted(source, np.arange(len(x) + 1))

    def near_enough(r: np.ndarray, c: np.ndarray) -> np.ndarray:
        parts = [np.einsum("nd,nd->n", x[c[i:i + 200_000]], q[r[i:i + 200_000]]) >= least for i in range(0, len(r), 200_000)]
        return np.concatenate(parts) if parts else np.empty(0, bool)

    r, c = np.nonzero(visited)          # also those that the beam has dropped
    while len(r):
        keep = near_enough(r, c)
        node = c[keep]
        degree = first[node + 1] - first[node]
        inside = np.arange(degree.sum()) - np.repeat(np.cumsum(degree) - degree, degree)
        r, c = np.repeat(r[keep], degree), target[np.repeat(first[node], degree) + inside]
        fresh = ~visited[r, c]
        pair = np.unique(r[fresh] * len(x) + c[fresh])
        r, c = pair // len(x), pair % len(x)
        visited[r, c] = True
    return visited


def links(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", threshold: float = 0.98) -> DataFrame:
    """vec_id, n_links, component_id, kept: one row per vector."""
    rows = materialise(nodes_of(df, ident, vector, label), "vectors")
    nodes = materialise(rows.filter("node is not null").groupBy("node").agg(
        F.first("label").alias("label"), F.first("embedding").alias("embedding"), F.count(F.lit(1)).alias("n")), "vector-nodes")
    total = nodes.count()
    member = materialise(shards(nodes, centres(nodes, total), threshold), "vector-shards")
    member = materialise(screened(member, threshold), "vector-screened")
    sizes = member.groupBy("label", "cell").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("parts"))
    member = materialise(member.join(sizes, ["label", "cell"]).withColumn("part", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")), "vector-blocks")
    lists = materialise(member.groupBy("label", "cell", "part").applyInArrow(build_block, "node binary, near array<binary>"), "vector-lists")
    merged = lists.groupBy("node").agg(F.array_distinct(F.flatten(F.collect_list("near"))).alias("near"))
    known = materialise(member.join(merged, "node"), "vector-graph")
    each = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    alone = known.filter("parts = 1").withColumn("asks", F.lit(0)).withColumn("role", F.lit("both"))
    held = known.filter("parts > 1").withColumn("asks", each).withColumn("role", F.lit("graph"))
    asking = (known.filter("parts > 1").withColumn("asks", F.col("part")).withColumn("part", each)
              .withColumn("near", F.array().cast("array<binary>")).withColumn("role", F.lit("query")))
    work = alone.unionByName(held).unionByName(asking)
    found = materialise(work.groupBy("label", "cell", "part", "asks").applyInArrow(search_block(threshold), "node binary, links long, root binary"), "vector-links")
    counts = found.groupBy("node").agg(F.sum("links").alias("links"))
    roots = connected(found.filter("root is not null").select(F.col("node").alias("a"), F.col("root").alias("b")), "vector")
    placed = (rows.join(nodes.select("node", "n").join(counts, "node", "left"), "node", "left").join(roots, "node", "left")
              .withColumn("root", F.coalesce("root", "node")))
    firsts = placed.filter("root is not null").groupBy("root").agg(F.min("vec_id").alias("first"))
    out = placed.join(firsts, "root", "left").withColumn("component_id", F.coalesce("first", "vec_id"))
    return out.select("vec_id", F.coalesce(F.col("n") - 1 + F.coalesce("links", F.lit(0)), F.lit(0)).alias("n_links"), "component_id",
                      F.col("vec_id").eqNullSafe(F.col("component_id")).alias("kept"))


def build_block(table: pa.Table) -> pa.Table:
    """Adjacency lists of the nodes of one block, by node."""
    node = table.column("node").to_pylist()
    near = []
    for own, at in same_length(table.column("embedding").to_pylist()):
        graph = build(own)
        near += [(at[i], [node[at[j]] for j in row if j >= 0]) for i, row in enumerate(graph)]
    near.sort()
    return pa.table({"node": pa.array(node, pa.binary()), "near": pa.array([v for _, v in near], pa.list_(pa.binary()))})


def same_length(vectors: list) -> list[tuple[np.ndarray, list[int]]]:
    by: dict[int, list[int]] = {}
    for i, v in enumerate(vectors):
        by.setdefault(len(v), []).append(i)
    return [(unit([vectors[i] for i in at]), at) for at in by.values()]


def search_block(threshold: float):
    def run(table: pa.Table) -> pa.Table:
        """Links of the querying nodes with the nodes of one block: a count per querying node, and the edges
        (node, root) of a spanning forest over all links, fewer than the nodes of the block and the queries."""
        role = table.column("role").to_pylist()
        node, cells_of, n = table.column("node").to_pylist(), table.column("cells").to_pylist(), table.column("n").to_pylist()
        cell = table.column("cell")[0].as_py() if len(node) else 0
        g = [i for i, r in enumerate(role) if r != "query"]
        ask = [i for i, r in enumerate(role) if r != "graph"]
        if not g or not ask:
            return pa.table({"node": pa.array([], pa.binary()), "links": pa.array([], pa.int64()), "root": pa.array([], pa.binary())})
        vectors = table.column("embedding").to_pylist()
        x, q = unit([vectors[i] for i in g]), unit([vectors[i] for i in ask])
        near = table.column("near")
        place = {node[i]: k for k, i in enumerate(g)}
        rows = [[place[v] for v in near[i].as_py() if v in place] for i in g]
        graph = np.full((len(g), max(1, max(map(len, rows)))), -1, np.int64)
        for k, r in enumerate(rows):
            graph[k, :len(r)] = r
        weight = np.array([n[i] for i in g])
        first = np.array([min(cells_of[i]) == cell for i in g])
        count, asked, edge_a, edge_b = [], [node[i] for i in ask], [], []
        walked, asking = x.astype(np.float32), q.astype(np.float32)          # as the graphs were built; links are verified in double precision
        group = np.arange(len(g))                  # of graph nodes that this block's links connect so far
        for start in range(0, len(ask), 512):
            part = q[start:start + 512]
            seen = in_range(walked, graph, asking[start:start + 512], threshold - RANGE, np.array([place.get(node[i], -1) for i in ask[start:start + 512]]))
            for k in range(len(part)):
                i = ask[start + k]
                at = np.flatnonzero(seen[k])
                hit = at[(x[at] @ part[k]) >= threshold]
                hit = hit[[node[g[j]] != node[i] for j in hit]] if len(hit) else hit
                own = set(cells_of[i])
                counted = [j for j in hit if (first[j] and cell == min(own)) or min(own.intersection(cells_of[g[j]])) == cell]
                count.append(int(weight[counted].sum()))
                for j in join_groups(group, hit, place.get(node[i], -1)):
                    edge_a.append(node[i])
                    edge_b.append(node[g[j]])
        return pa.table({"node": pa.array(asked + edge_a, pa.binary()), "links": pa.array(count + [0] * len(edge_a), pa.int64()),
                         "root": pa.array([None] * len(asked) + edge_b, pa.binary())})

    return run


def join_groups(group: np.ndarray, hit: np.ndarray, own: int) -> np.ndarray:
    """Joins the groups of the graph nodes `hit`, and that of the querying node where it is one (`own`, -1
    otherwise); returns one hit of each group the querying node wasn't in."""
    number, at = np.unique(group[hit], return_index=True)
    fresh = hit[at[number != group[own]]] if own >= 0 else hit[at]
    whole = np.union1d(number, group[own]) if own >= 0 else number
    if len(whole) > 1:
        group[np.isin(group, whole)] = whole[0]
    return fresh


def audit(df: DataFrame, found: DataFrame, queries: int = 200, threshold: float = 0.98) -> tuple[int, int]:
    """(links found, links that exist) of about `queries` vectors picked by hash, against all rows: the
    queries are broadcast, every task compares its rows with them in blocks."""
    rows = materialise(nodes_of(df, "vec_id", "embedding", "label").filter("node is not null"), "audit")
    grain = 1 << 30
    picked = rows.filter(F.pmod(F.xxhash64("vec_id"), F.lit(grain)) < int(grain * min(1.0, queries / max(1, rows.count())))).collect()
    if not picked:
        return 0, 0
    spec = df.sparkSession.sparkContext.broadcast((unit([r["embedding"] for r in picked]), np.array([r["label"] for r in picked])))

    def run(batches):
        total = np.zeros(len(spec.value[1]), np.int64)
        for batch in batches:
            x, lab = unit(batch.column("embedding").to_pylist()), batch.column("label").to_numpy()
            total += ((spec.value[0] @ x.T >= threshold) & (spec.value[1][:, None] == lab[None, :])).sum(1)
        yield pa.RecordBatch.from_pydict({"q": list(range(len(total))), "k": total.tolist()})

    true = sum(r["k"] for r in rows.select("embedding", "label").mapInArrow(run, "q long, k long").groupBy("q").agg(F.sum("k").alias("k")).collect()) - len(picked)
    ids = df.sparkSession.createDataFrame([(r["vec_id"],) for r in picked], "vec_id long")
    got = found.join(F.broadcast(ids), "vec_id").agg(F.sum("n_links")).first()[0] or 0
    return int(got), int(true)
