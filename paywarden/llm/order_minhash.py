"""Near-duplicate documents by order MinHash.

A text is its sequence of five-word shingles (lower case, white-space words; a shorter text is one shingle).
The similarity of two texts is the longest common subsequence of their shingle sequences over the sequences'
union, so it falls with every edit and with reordering; texts at `threshold` or more are linked, classes are
the connected groups of links and exact copies.

    sketch: each of `slots` hash orders picks the `pick` smallest occurrence-labelled shingles of a text and
            keeps them in text order; texts with an equal pick share a bucket
    short texts: what is left when as many shingles are removed as a link allows; equal rests share a bucket
    exact copies collapse to one node before anything meets
    small buckets: their pairs, two shared buckets make a candidate; large buckets: members against a hub,
            then those that share a difference to it
    verify: multiset bound, then banded alignment

At similarity 0.8 one slot agrees with probability near 0.8 ** 6 = 0.26, and at most one of 32 agrees in 7
cases of 10 000 (at 0.85 in 2 of 100 000; in 2 of 1 000 at 0.8 with some 36 shingles); a pair must share two
buckets, or one of over `SMALL` members, or one if a text has fewer than 32 shingles. Texts of up to `SHORT` shingles, whose
picks would be nearly the whole text, always share a bucket with those of them they're linked with. Large buckets never meet as all pairs: each
member is compared with one hub, a bucket whose members ended in one class is done, and of the others only
those can be linked that differ from the hub alike (`keys_of`): they meet by shared differences, of which those
around one word or place are one key (`key_groups`), in small groups pair by pair, in large ones with a hub again. So no link between two classes is lost, a class of
thousands costs one comparison per member, and texts that each differ from the hub in their own way cost
one too. Links only join what earlier rounds left apart. Buckets of unlike texts that share a passage shrink
with the sixth power of its share of the text.

Null texts and texts without a word are in no class but their own. The class id is the smallest doc_id (null
ids last); ties between equal texts go to the smaller id. Rows that repeat both id and text are one document.
Extra columns are ignored here and kept by `drop_copies`. An empty table gives no rows.
"""
from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import connected, row_key, slices, take_over, without
from paywarden.session import materialise

WORDS = 5
SLOTS, PICK = 32, 6
SINGLE = 32                      # below so many shingles one shared bucket is enough
SHORT = 12                       # texts of up to so many shingles share buckets by what removals leave of them
SMALL = 16                       # buckets up to this size are compared pair by pair
SMALL_KEY = 64                   # and groups of a hub and a key, whose pairs mostly fail a condition on numbers
BLOCK = 16                       # neighbouring shingles of a hub that are one key where a text lacks them
BITS = 256                       # of the map of a text's differences to a hub
ROUNDS = 2                       # of hubs and keys
BROADCAST_ROWS = 500_000         # keys of about 40 bytes
_A = np.uint64(0x9E3779B97F4A7C15)
_hashes: dict[str, int] = {}


def mix(z: np.ndarray) -> np.ndarray:
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def words(text: str | None) -> list[str]:
    return (text or "").lower().split()


def word_hashes(found: list[str]) -> np.ndarray:
    """Hash of every word."""
    take_over("order_minhash", _hashes)
    if len(_hashes) > 150_000:
        _hashes.clear()
    known = _hashes
    for w in set(found).difference(known):
        known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, found), np.uint64, len(found))


def shingles(found: list[str]) -> np.ndarray:
    """Hash of every run of five words, in text order."""
    return runs(word_hashes(found))


def runs(h: np.ndarray) -> np.ndarray:
    """Hash of every run of five word hashes."""
    if len(h) <= WORDS:
        total = np.array([len(h)], np.uint64)
        for i in range(len(h)):
            total = total * _A + h[i:i + 1]
        return mix(total) if len(h) else h
    total = np.zeros(len(h) - WORDS + 1, np.uint64)
    for i in range(WORDS):
        total = total * _A + h[i:i + len(total)]
    return mix(total)


def labelled(h: np.ndarray) -> np.ndarray:
    """Shingle hashes that differ between the first, second, ... occurrence of a shingle."""
    ordered = np.sort(h)
    if not (ordered[1:] == ordered[:-1]).any():
        return h
    at = np.argsort(h, kind="stable")
    ordered = h[at]
    first = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    number = np.arange(len(h)) - np.repeat(first, np.diff(np.append(first, len(h))))
    out = np.empty_like(h)
    out[at] = np.where(number > 0, mix(ordered + number.astype(np.uint64) * _A), ordered)
    return out


SEEDS = mix(np.arange(1, SLOTS + 1, dtype=np.uint64) * _A)


def sketch(h: np.ndarray) -> np.ndarray:
    """One hash per slot: the slot's smallest shingles, in text order."""
    own = labelled(h)
    n, pick = len(own), min(PICK, len(own))
    out = SEEDS.copy()
    for start in range(0, SLOTS, max(1, (1 << 18) // n)):          # long texts a few slots at a time
        seeds = SEEDS[start:start + max(1, (1 << 18) // n)]
        order = (own[None, :] ^ seeds[:, None]) * np.uint64(0xBF58476D1CE4E5B9)
        if n > 64:
            # the smallest few lie below a bound that all but never leaves fewer than wanted
            row, col = np.nonzero(order < np.uint64(int((pick + 16) / n * (1 << 63)) * 2) if n > 2 * (pick + 16) else order >= 0)
            if np.bincount(row, minlength=len(seeds)).min() < pick:
                row, col = np.nonzero(order >= 0)
        else:
            row, col = np.nonzero(order >= 0)
        at = np.lexsort((order[row, col], row))
        row, col = row[at], col[at]
        first = np.searchsorted(row, np.arange(len(seeds)))
        best = np.sort(col[first[:, None] + np.arange(pick)], axis=1)
        total = seeds.copy()
        for i in range(pick):
            total = total * _A + own[best[:, i]]
        out[start:start + len(seeds)] = mix(total)
    return out


def shortened(h: np.ndarray, threshold: float) -> np.ndarray:
    """One hash for every sequence that is left of a short text when as many shingles are removed as a link
    allows. Two linked texts both leave their common subsequence, so they share one of these."""
    rest = []
    for left in range(len(h), 0, -1):
        if len(h) - left > (1 / threshold - 1) * left + 1e-9:
            break
        at = np.array(list(combinations(range(len(h)), left)))
        total = np.full(len(at), left, np.uint64)
        for i in range(left):
            total = total * _A + h[at[:, i]]
        rest.append(np.unique(mix(total)))
    return np.concatenate(rest)


def buckets(h: np.ndarray, threshold: float) -> np.ndarray:
    """The picks of all slots, and what removals leave of a short text, which has no other use for the slots
    if all texts it may be linked with are short."""
    if len(h) > SHORT:
        return sketch(h)
    own = shortened(h, threshold)
    return own if len(h) + 1e-9 < threshold * (SHORT + 1) else np.concatenate([sketch(h), own])


def alignment(a: np.ndarray, b: np.ndarray, threshold: float) -> bool:
    """Whether LCS(a, b) / (|a| + |b| - LCS) >= threshold, within the band the threshold leaves."""
    total = len(a) + len(b)
    need = threshold * total / (1 + threshold)          # of the common subsequence
    # no order can match more than the multisets share
    both = np.sort(np.concatenate([np.unique(labelled(a)), np.unique(labelled(b))]))
    if (both[1:] == both[:-1]).sum() < need - 1e-9:
        return False
    n = min(len(a), len(b))
    same = a[:n] == b[:n]
    head = n if same.all() else int(same.argmin())
    a, b = a[head:], b[head:]
    n = min(len(a), len(b))
    same = a[len(a) - n:][::-1] == b[len(b) - n:][::-1]
    tail = n if same.all() else int(same.argmin())
    x, y = a[:len(a) - tail].tolist(), b[:len(b) - tail].tolist()
    need -= head + tail
    if need <= 1e-9:
        return True
    band = int(len(x) + len(y) - 2 * need + 1e-9)       # most insertions and deletions together
    if band < abs(len(x) - len(y)):
        return False
    n, m, reach = len(x), len(y), {1: 0}
    for d in range(band + 1):
        for k in range(-d, d + 1, 2):
            i = reach[k + 1] if k == -d or (k != d and reach[k - 1] < reach[k + 1]) else reach[k - 1] + 1
            j = i - k
            while i < n and j < m and x[i] == y[j]:
                i += 1
                j += 1
            reach[k] = i
            if i >= n and j >= m:
                return True
    return False


def sketches(docs: DataFrame, ident: str, text: str, threshold: float) -> DataFrame:
    """key (id and text hash), node (equal for equal word sequences), n shingles, picks: one row per document."""
    rows = docs.select(F.col(ident).alias("doc_id"), row_key(ident, text).alias("key"), F.col(text).alias("t"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t"):
                node, sizes, picks = [], [], []
                for t in part.column("t").to_pylist():
                    found = words(t)
                    if not found:
                        node.append(None)
                        sizes.append(0)
                        picks.append([])
                        continue
                    h = shingles(found)
                    node.append(xxhash.xxh3_128_digest(" ".join(found)))
                    sizes.append(len(h))
                    picks.append(buckets(h, threshold).view(np.int64).tolist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("key"), pa.array(node, pa.binary()), pa.array(sizes, pa.int32()),
                                                  pa.array(picks, pa.list_(pa.int64()))], names=["doc_id", "key", "node", "n", "picks"])

    kinds = dict(rows.dtypes)
    return rows.mapInArrow(run, f"doc_id {kinds['doc_id']}, key {kinds['key']}, node binary, n int, picks array<long>")


def side_by_side(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """The pairs (a, b) with their texts ta and tb; a hub's pairs stay together unless they're too many."""
    wide = (pairs.join(texts.select(F.col("node").alias("b"), F.col("t").alias("tb")), "b")
            .join(texts.select(F.col("node").alias("a"), F.col("t").alias("ta")), "a"))
    return wide.select("a", "b", "ta", "tb")


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) whose texts (node, t) are linked."""
    def run(batches):
        for batch in batches:
            last, own = None, None
            a, b = batch.column("a").to_pylist(), batch.column("b").to_pylist()
            keep = []
            for i, (node, ta, tb) in enumerate(zip(a, batch.column("ta"), batch.column("tb"))):
                if node != last:
                    last, own = node, shingles(words(ta.as_py()))
                if alignment(own, shingles(words(tb.as_py())), threshold):
                    keep.append(i)
            yield pa.RecordBatch.from_arrays([pa.array([a[i] for i in keep], pa.binary()), pa.array([b[i] for i in keep], pa.binary())], names=["a", "b"])

    return side_by_side(pairs, texts).mapInArrow(run, "a binary, b binary")


def near(a: str, b: str, threshold: float):
    """Sizes that allow the similarity."""
    return F.least(a, b) >= threshold * F.greatest(a, b)


def classes(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, key, node, class_id, kept for every document."""
    rows = materialise(sketches(docs, ident, text, threshold), "omh-sketches")
    nodes = rows.filter("node is not null").groupBy("node").agg(
        F.min("key").alias("key"), F.first("n").alias("n"), F.first("picks").alias("picks"))
    member = materialise(nodes.select(F.explode("picks").alias("bucket"), "node", "n", "key"), "omh-members")
    sizes = member.groupBy("bucket").agg(F.count(F.lit(1)).alias("m"))
    shared = materialise(member.join(sizes.filter("m > 1"), "bucket"), "omh-buckets")
    fewer = shared.filter(F.col("m") <= SMALL)
    left, right = fewer.select("bucket", F.col("node").alias("a"), F.col("n").alias("na")), fewer.select("bucket", F.col("node").alias("b"), F.col("n").alias("nb"))
    met = (left.join(right, "bucket").filter((F.col("a") < F.col("b")) & near("na", "nb", threshold))
           .groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"), F.min(F.least("na", "nb")).alias("n")))
    # a longer pair that shares one bucket of all sizes is below the threshold but for 2 cases of 1 000; one
    # that shares a large bucket too meets there
    small = met.filter(enough("k", "n")).select("a", "b")
    many = shared.filter(F.col("m") > SMALL).select("bucket", "node", "n", spread("node").alias("u"))
    texts = node_texts(docs, shared.groupBy("node").agg(F.first("key").alias("key")), ident, text)
    roots = connected(materialise(verified(small, texts, threshold), "omh-links"), "omh")
    if not many.isEmpty():
        roots = hub_rounds(many, roots, texts, threshold)
    placed = rows.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    named = F.struct(F.col("doc_id").isNull().alias("no"), F.col("doc_id"), F.col("key"))
    firsts = placed.filter("root is not null").groupBy("root").agg(F.min(named).alias("first"), F.count(F.lit(1)).alias("class_size"))
    out = placed.join(firsts, "root", "left")
    return out.select("doc_id", "key", "node", F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("first.doc_id")).alias("class_id"),
                      (F.col("root").isNull() | (F.col("key") == F.col("first.key"))).alias("kept"), F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"))


def enough(k: str, n: str):
    """Whether `k` shared buckets make a candidate of a pair whose shorter text has `n` shingles."""
    return (F.col(k) >= 2) | (F.col(n) < SINGLE)


def node_texts(docs: DataFrame, needed: DataFrame, ident: str, text: str) -> DataFrame:
    """The text of every node that meets another, written once."""
    needed = materialise(needed, "omh-needed")
    side = F.broadcast(needed) if needed.count() <= BROADCAST_ROWS else needed
    found = docs.select(row_key(ident, text).alias("key"), F.col(text).alias("t")).join(side, "key").select("node", "t")
    return materialise(found.dropDuplicates(["node"]), "omh-texts")


def keys_of(hub: np.ndarray, own: np.ndarray, threshold: float) -> tuple[int, bool, bool, np.ndarray]:
    """How a text differs from a hub: the number of shingles only one of them has, whether no link between
    them is possible, whether the text has so many of its own that these alone decide, and its keys.

    Texts x and y are linked only if |x ^ y| <= share * (|x| + |y|), with share = (1 - threshold) / (1 + threshold).
    x ^ y = (x ^ hub) ^ (y ^ hub), so a linked pair has o = (|x ^ hub| + |y ^ hub| - share * (|x| + |y|)) / 2 or more
    differences in common, and o > 0 if one of them can't be linked with the hub. With all differences in one
    order (what the hub lacks first), each text's first |x ^ hub| - o + 1 hold a common one. A text that lacks
    nothing of its plain prefix (|x| - threshold * |x| + 1 shingles) outside the hub meets any text it's linked
    with there. What is returned covers both for every possible partner."""
    return key_groups(hub, own, threshold, hub, own)[:4]


def key_groups(hub: np.ndarray, own: np.ndarray, threshold: float, hub_lead: np.ndarray, own_lead: np.ndarray) -> tuple[int, bool, bool, np.ndarray, np.ndarray, np.ndarray]:
    """As `keys_of` with the differences ordered by their leads, and these leads with the place of the first
    difference of each. A lead is a number that follows from the shingle and the hub alone, so texts with a
    common difference have its lead in common."""
    share, n, m = (1 - threshold) / (1 + threshold), len(own), len(hub)
    new, gone = ~np.isin(own, hub), ~np.isin(hub, own)
    added, removed = own[new], hub[gone]
    d = len(added) + len(removed)
    prefix = n - int(np.ceil(threshold * n - 1e-9)) + 1
    outside = d > share * (n + m) + 1e-9
    far = len(added) >= prefix
    reach = prefix if far else max(len(added), int((d + share * (n + m if outside else n - m)) / 2 + 1 + 1e-9))
    first, then = np.lexsort((added, own_lead[new])), np.lexsort((removed, hub_lead[gone]))
    keys = np.concatenate([added[first], removed[then]])[:reach]
    leads = np.concatenate([own_lead[new][first], hub_lead[gone][then]])[:reach]
    places = np.flatnonzero(np.concatenate([[True], leads[1:] != leads[:-1]])[:len(leads)])
    return d, outside, far, keys, leads[places], places


def word_leads(h: np.ndarray, of_hub: np.ndarray) -> np.ndarray:
    """For every run of five word hashes the smallest of them, words that the hub lacks first. Neighbouring runs
    mostly have it in common: a new word leads all runs that hold it."""
    rank = h >> np.uint64(1) | np.isin(h, of_hub).astype(np.uint64) << np.uint64(63)
    return np.lib.stride_tricks.sliding_window_view(rank, min(WORDS, len(rank))).min(axis=1)


def bitmap(hub: np.ndarray, own: np.ndarray) -> np.ndarray:
    """One bit for each shingle that only one of two texts has, of `BITS` by its hash."""
    at = np.setxor1d(hub, own) % np.uint64(BITS)
    out = np.zeros(BITS // 64, np.uint64)
    np.bitwise_or.at(out, (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63)))
    return out


def not_in(p: str, q: str):
    """At least so many differences of one text the other lacks: bits that only its map has."""
    return sum(F.bit_count(F.get(F.col(p), F.lit(i)).bitwiseAND(F.bitwise_not(F.get(F.col(q), F.lit(i))))) for i in range(BITS // 64))


def differences(met: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """For every hub `a` and node `b`: linked, and how and by which keys the node differs from the hub."""
    def run(batches):
        for batch in batches:
            last, hub, marks, of_hub, places_of_hub = None, None, None, None, None
            out = []
            for a, b, ta, tb in zip(*(batch.column(c) for c in ("a", "b", "ta", "tb"))):
                if a != last:
                    last, of_hub = a, word_hashes(words(ta.as_py()))
                    hub = runs(of_hub)
                    marks, places_of_hub = labelled(hub), np.arange(len(hub), dtype=np.uint64) // np.uint64(BLOCK)
                found = word_hashes(words(tb.as_py()))
                h = runs(found)
                own = labelled(h)
                d, outside, far, keys, leads, places = key_groups(marks, own, threshold, places_of_hub, word_leads(found, of_hub))
                linked = not outside and alignment(hub, h, threshold)
                out.append((a.as_py(), b.as_py(), linked, outside, far, len(h), d, keys.view(np.int64), leads.view(np.int64), places, bitmap(marks, own).view(np.int64)))
            columns = list(zip(*out)) or [[]] * len(schema)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, schema.types)], schema=schema)

    schema = pa.schema([("a", pa.binary()), ("b", pa.binary()), ("linked", pa.bool_()), ("outside", pa.bool_()), ("far", pa.bool_()),
                        ("n", pa.int32()), ("d", pa.int32()), ("keys", pa.list_(pa.int64())), ("leads", pa.list_(pa.int64())), ("places", pa.list_(pa.int32())), ("bits", pa.list_(pa.int64()))])
    return side_by_side(met, texts).mapInArrow(
        run, "a binary, b binary, linked boolean, outside boolean, far boolean, n int, d int, keys array<long>, leads array<long>, places array<int>, bits array<long>")


def merged(roots: DataFrame, links: DataFrame) -> DataFrame:
    """`roots` (node, root) after more links: only the links between different roots are followed."""
    of = {x: roots.select(F.col("node").alias(x), F.col("root").alias("r" + x)) for x in "ab"}
    lifted = (links.join(of["a"], "a", "left").join(of["b"], "b", "left")
              .select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b")).filter("a != b").distinct())
    lifted = materialise(lifted, "omh-lifted")
    if lifted.isEmpty():
        return roots
    up = connected(lifted, "omh")
    moved = roots.join(up.select(F.col("node").alias("root"), F.col("root").alias("up")), "root", "left").select("node", F.coalesce("up", "root").alias("root"))
    return materialise(moved.union(up.join(roots, "node", "left_anti").select("node", "root")), "omh-roots")


def still_open(member: DataFrame, roots: DataFrame) -> DataFrame:
    """The members of buckets that hold more than one class, with their roots."""
    tagged = member.drop("root").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = tagged.groupBy("bucket").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo != hi").select("bucket")
    return materialise(tagged.join(mixed, "bucket", "left_semi"), "omh-open")


def several(keyed: DataFrame, name: str) -> DataFrame:
    """The members of a hub and a key (a, key, node, root, outside) among which a link may be found, with their number."""
    groups = (keyed.groupBy("a", "key").agg(F.count(F.lit(1)).alias("m"), F.min("root").alias("lo"), F.max("root").alias("hi"), F.max("outside").alias("any"))
              .filter("m > 1 and lo != hi and any").select("a", "key", "m"))
    return materialise(keyed.join(groups, ["a", "key"]), name)


def hub_rounds(member: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """`roots` after the links of large buckets (bucket, node, n, u).

    A round compares all members of a bucket with its hub, the one that is in most buckets: a text most others
    derive from, so that what they have beside it is their own. Of the others, pairs with no key in common (see
    `keys_of`) aren't linked; those with one meet in a group of the hub and the key's lead (see `key_groups`), so
    that a changed word is one row, or in one of the hub and the key itself if the lead has more than `SMALL_KEY`
    members: pair by pair up to that number, and whatever their number in the last round, else in the next round
    with a hub of their own. A pair goes on only if the two share a difference of the lead, if its places in both lists allow a link, and if bit maps of all their
    differences do: bits that only one map has are differences the two don't share. Members that hold what the
    hub holds and yet aren't linked (their order differs) meet all that are as near in the next round, and
    after the last in every pair across classes (`every_hub`)."""
    for left in reversed(range(ROUNDS)):
        tagged = still_open(member, roots)
        if tagged.isEmpty():
            return roots
        central = tagged.groupBy("node").agg((-F.count(F.lit(1))).alias("order"))
        hubs = (tagged.join(central, "node").groupBy("bucket").agg(F.min(F.struct(F.floor("u").alias("last"), "order", "u", "node")).alias("h"))
                .select("bucket", F.col("h.node").alias("a")))
        met = tagged.join(hubs, "bucket").filter("node != a").select("a", F.col("node").alias("b")).distinct()
        met = materialise(differences(met, texts, threshold), "omh-differences")
        roots = merged(roots, met.filter("linked").select("a", "b"))
        root_of = roots.select(F.col("node").alias("b"), "root")
        met = met.join(root_of, "b", "left").withColumn("root", F.coalesce("root", "b"))
        kept = [F.col("b").alias("node"), "root", "n", "d", "outside", "far", "bits"]
        listed = (met.select("a", F.posexplode("leads").alias("i", "key"), "keys", "places", *kept).withColumn("at", F.get("places", "i"))
                  .withColumn("part", F.slice("keys", F.col("at") + 1, F.coalesce(F.get("places", F.col("i") + 1), F.size("keys")) - F.col("at"))))
        few = several(listed.drop("i", "keys", "places"), "omh-leads")
        if left:
            # leads of many members are taken apart: their differences are keys of their own
            apart = few.filter(F.col("m") > SMALL_KEY).drop("key", "m").select("*", F.posexplode("part").alias("i", "key"))
            keyed = several(apart.withColumn("at", F.col("at") + F.col("i")).withColumn("part", F.array("key")).drop("i"), "omh-keys")
            few = few.unionByName(keyed).filter(F.col("m") <= SMALL_KEY)
        x, y = (few.select("a", "key", *[F.col(c).alias(c + side) for c in ("node", "root", "n", "d", "at", "part", "outside", "far", "bits")]) for side in "xy")
        need = F.ceil((F.col("dx") + F.col("dy") - (1 - threshold) / (1 + threshold) * (F.col("nx") + F.col("ny"))) / 2 - 1e-9)
        common = F.greatest(F.lit(1), need)
        alike = (F.col("dx") - not_in("bitsx", "bitsy") >= need) & (F.col("dy") - not_in("bitsy", "bitsx") >= need)
        meet = (F.col("farx") | F.col("fary")
                | ((F.col("outsidex") | F.col("outsidey")) & (F.col("atx") <= F.col("dx") - common) & (F.col("aty") <= F.col("dy") - common)))
        pairs = (x.join(y, ["a", "key"]).filter((F.col("nodex") < F.col("nodey")) & (F.col("rootx") != F.col("rooty")) & near("nx", "ny", threshold) & meet & alike & F.arrays_overlap("partx", "party"))
                 .select(F.col("nodex").alias("a"), F.col("nodey").alias("b")).distinct())
        roots = merged(roots, materialise(verified(pairs, texts, threshold), "omh-links"))
        reordered = met.filter("not linked and not outside").select("a").distinct()
        within = (met.filter("not outside").join(reordered, "a", "left_semi")
                  .select(F.xxhash64("a", F.lit("order")).alias("bucket"), F.col("b").alias("node"), "n", (spread("b") + F.col("linked").cast("int")).alias("u")))
        member = within
        if left:
            member = member.union(keyed.filter(F.col("m") > SMALL_KEY).select(F.xxhash64("a", "key").alias("bucket"), "node", "n", spread("node").alias("u")))
    return every_hub(member, roots, texts, threshold)


def spread(node: str):
    """A hash of the node between 0 and 1."""
    return F.pmod(F.xxhash64(node), F.lit(1 << 40)) / float(1 << 40)


def every_hub(member: DataFrame, roots: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """`roots` after every member has been compared with the members of other classes: a member is a hub when
    its hash falls in the round's range, and ranges grow fourfold."""
    largest = member.groupBy("bucket").count().agg(F.max("count")).first()[0] or 1
    low, high = 0.0, min(1.0, 4.0 / largest)
    while True:
        tagged = still_open(member, roots)
        if tagged.isEmpty():
            return roots
        hub = tagged.select("bucket", F.col("node").alias("a"), F.col("n").alias("na"), F.col("root").alias("ra"), spread("node").alias("ua"))
        hub = hub.filter((F.col("ua") >= low) & (F.col("ua") < high))
        pairs = (tagged.join(hub, "bucket").filter((F.col("root") != F.col("ra")) & near("n", "na", threshold))
                 .select(F.least("a", "node").alias("a"), F.greatest("a", "node").alias("b")).distinct())
        roots = merged(roots, materialise(verified(pairs, texts, threshold), "omh-links"))
        if high >= 1.0:
            return roots
        low, high = high, min(1.0, 4 * high)


def drop_copies(docs: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """`docs` without the documents whose class keeps another one; columns as they are."""
    gone = classes(docs, ident, text, threshold).filter("not kept").select(F.col("key").alias("__key")).distinct()
    return without(docs, ["__key"]).withColumn("__own", row_key(ident, text)).join(gone, F.col("__own") == F.col("__key"), "left_anti").drop("__own")
