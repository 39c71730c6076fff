"""A hash tree over the tips of many chains: one root stands for all of them, and a proof of a few digests
shows that a chain belongs to it.

Leaves stand in order of their key. A node is the digest of its two children; a node without a right
neighbour moves up as it is. Each level is one grouping by index, so all of a level is hashed in parallel
and no task needs more than the pairs it was dealt; the number of levels is the logarithm of the leaves.
Leaves and inner nodes are hashed with different first letters, so that a node can't pose as a leaf.
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise


def leaf_digest(key: Sequence[str]) -> Column:
    """Digest of a chain's key, tip and length; each part carries its own length."""
    parts = [F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in (*key, "tip", "n")]
    return F.sha2(F.concat(F.lit("L"), *[F.concat(F.length(p).cast("string"), F.lit(":"), p) for p in parts]), 256)


def node_digest(left: Column, right: Column) -> Column:
    return F.sha2(F.concat(F.lit("N"), left, right), 256)


def leaves(tips: DataFrame, key: Sequence[str], policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """(key, tip, n, idx, digest): the chains in order of their key, which must be unique."""
    placed = running(tips.select(*key, "tip", "n"), [], list(key), sums={"idx": F.lit(1)}, policy=policy)
    return placed.withColumn("digest", leaf_digest(key))


def hash_tree(leaf: DataFrame) -> DataFrame:
    """(level, idx, digest) of every node; the root is the node of the highest level. No leaves give no nodes."""
    level = materialise(leaf.select(F.lit(0).alias("level"), "idx", "digest"), "tree")
    nodes, n, depth = level, level.count(), 0
    while n > 1:
        depth, n = depth + 1, -(-n // 2)
        child = lambda side: F.max(F.when(F.col("idx") % 2 == side, F.col("digest")))
        pairs = level.groupBy(F.floor(F.col("idx") / 2).alias("idx")).agg(child(0).alias("l"), child(1).alias("r"))
        up = pairs.select(F.lit(depth).alias("level"), "idx", F.coalesce(node_digest(F.col("l"), F.col("r")), F.col("l")).alias("digest"))
        level = materialise(up, "tree")
        nodes = nodes.unionByName(level)
    return nodes


def root(nodes: DataFrame) -> str | None:
    """The one digest to keep elsewhere."""
    top = nodes.orderBy(F.desc("level")).select("digest").first()
    return top["digest"] if top else None


def proofs(wanted: DataFrame, nodes: DataFrame) -> DataFrame:
    """Add to leaves (`idx`) their `proof`: the neighbours on the way up, at most one per level."""
    depth = nodes.agg(F.max("level")).first()[0] or 0
    steps = wanted.select("idx", F.explode(F.sequence(F.lit(0), F.lit(max(depth - 1, 0)))).alias("level")).distinct()
    own = F.expr("shiftright(idx, level)")
    asked = steps.select(F.col("idx").alias("__leaf"), "level", own.bitwiseXOR(F.lit(1).cast("long")).alias("idx"), (own % 2 == 1).alias("left"))
    found = asked.join(nodes, ["level", "idx"]).groupBy("__leaf").agg(
        F.array_sort(F.collect_list(F.struct("level", "left", "digest"))).alias("proof"))
    empty = F.array().cast("array<struct<level:int,left:boolean,digest:string>>")
    return wanted.join(found, F.col("idx") == F.col("__leaf"), "left").drop("__leaf").withColumn("proof", F.coalesce("proof", empty))


def proved_root(digest: str | Column = "digest", proof: str | Column = "proof") -> Column:
    """The root that a leaf's digest and its proof lead to."""
    start = F.col(digest) if isinstance(digest, str) else digest
    return F.aggregate(proof, start, lambda at, p: F.when(p.left, node_digest(p.digest, at)).otherwise(node_digest(at, p.digest)))
