"""Benchmark decontamination by SimHash of item-sized windows, in DataFrame expressions only.

    benchmark items ── five-word shingles ── `PRINTS` SimHash fingerprints of 64 bits ── 13 blocks of each
    documents ── shingles that some item has (broadcast up to a checked size, else an ordinary join)
              ── windows of an item's length that hold enough of them ── distinct ones ── fingerprints, blocks
              ── join on (length, fingerprint, block): all pairs within Hamming distance 12 meet
              ── distance filter ── exact weighted similarity, shingles weighted by occurrence ── matches

A window of similarity `threshold` to an item shares at least threshold * (its shingles) with the benchmark,
so windows with fewer are skipped without loss: clean documents end at the first step. With 13 blocks, two
fingerprints within distance 12 agree in a block (pigeonhole), so the index loses none of them. A pair of
similarity 0.8 has an expected distance of 9.7 and is within 12 with probability 0.83 to 0.9 for one fingerprint,
so the four together miss fewer than 1 in 1 000; at 0.85 none in a million, and no exact copy. What moves is
keys: a window or an item is one row per block without its shingles, which only pairs within the radius meet.

Words are runs of letters and digits in lower case. Items of fewer than five words are too short to tell and
match nothing. A document shorter than an item is compared whole. Null and empty texts match nothing; rows
that repeat id and text are one document. Of windows that are equally similar to an item the first counts; items
that repeat an id count as that item if any of their texts does. An empty table on either side gives no match,
and `drop_contaminated` then keeps every row; other columns pass through, those named `__key` or `__own` go.
Only shingle hashes, positions and hit documents are shuffled.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.llm.common import row_key, without
from paywarden.session import materialise

WORDS = 5
RADIUS, PRINTS = 12, 4
BLOCKS = RADIUS + 1
#: First bit and width of each block of a fingerprint.
CUTS = [(b * 64 // BLOCKS, (b + 1) * 64 // BLOCKS - b * 64 // BLOCKS) for b in range(BLOCKS)]
BROADCAST_ROWS = 1_000_000       # shingles of the benchmark, or keys of hit documents


def bound(value: Column, body) -> Column:
    """`body` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def shingles(text: Column) -> Column:
    """Hash of every run of five words, in order; empty for fewer words."""
    found = F.array_remove(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), "")
    return bound(found, lambda w: F.when(F.size(w) >= WORDS, F.transform(
        F.sequence(F.lit(1), F.size(w) - WORDS + 1), lambda i: F.xxhash64(F.slice(w, i, WORDS)))).otherwise(F.array().cast("array<bigint>")))


def sized(df: DataFrame) -> DataFrame:
    """Broadcast up to BROADCAST_ROWS rows, an ordinary join beyond."""
    return F.broadcast(df) if df.count() <= BROADCAST_ROWS else df


def simhash(items: Column, seed: int) -> Column:
    """Bit b is set where more hashes of the array have it set than not."""
    mixed = F.transform(items, lambda h: F.xxhash64(h, F.lit(seed)))
    bit = lambda m, b: F.aggregate(m, F.lit(0), lambda n, h: n + F.getbit(h, b).cast("int")) * 2 > F.size(m)
    return bound(mixed, lambda m: F.aggregate(
        F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"),
        lambda out, b: F.when(bit(m, b), out.bitwiseOR(F.call_function("shiftleft", F.lit(1).cast("long"), b))).otherwise(out)))


def blocks(items: Column) -> Column:
    """(seed, block, bits, print) of every fingerprint of the array."""
    return F.flatten(F.transform(F.array(*[F.struct(F.lit(s).alias("seed"), simhash(items, s).alias("print")) for s in range(PRINTS)]),
                     lambda p: F.array(*[F.struct(p["seed"].alias("seed"), F.lit(n).alias("block"),
                                                  F.shiftrightunsigned(p["print"], at).bitwiseAND((1 << width) - 1).alias("bits"),
                                                  p["print"].alias("print")) for n, (at, width) in enumerate(CUTS)])))


def weighted_similarity(a: Column, b: Column) -> Column:
    """Sum of the smaller over the sum of the larger occurrence counts."""
    common = F.aggregate(F.array_intersect(a, b), F.lit(0), lambda n, x: n + F.least(
        F.size(F.filter(a, lambda y: y == x)), F.size(F.filter(b, lambda y: y == x))))
    return common / (F.size(a) + F.size(b) - common).cast("double")


def starts(hits: Column, m: Column, least: Column) -> Column:
    """Where windows of m shingles start that hold at least `least` of the sorted positions `hits`."""
    spans = F.transform(hits, lambda first, j: F.struct(first.alias("first"), F.get(hits, (j + least - 1).cast("int")).alias("last")))
    fit = F.filter(spans, lambda s: s["last"].isNotNull() & (s["last"] - s["first"] < m))
    return F.array_distinct(F.flatten(F.transform(fit, lambda s: F.sequence(F.greatest(F.lit(0), s["last"] - m + 1), s["first"]))))


def content(items: str) -> Column:
    """128 bits that stand for an array."""
    return F.struct(F.xxhash64(items, F.lit(1)).alias("a"), F.xxhash64(items, F.lit(2)).alias("b"))


def items_of(benchmark: DataFrame, item: str = "item_id", text: str = "text") -> DataFrame:
    """item_id, own (its shingles), m (how many), o (their content)."""
    own = benchmark.select(F.col(item).alias("item_id"), shingles(F.col(text)).alias("own"))
    return own.withColumn("m", F.size("own")).filter("m > 0").withColumn("o", content("own"))


def matches(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """doc_id, key, item_id, start (first word), similarity: the best window of each document and item."""
    items = materialise(items_of(benchmark), "items")
    rows = docs.filter(F.col(text).isNotNull()).select(row_key(ident, text).alias("key"), F.col(text).alias("t"))
    known = sized(materialise(items.select(F.explode("own").alias("h"), "m").distinct(), "item-shingles"))
    hits = (rows.select("key", F.posexplode(shingles(F.col("t"))).alias("at", "h")).join(known, "h")
            .groupBy("key", "m").agg(F.array_sort(F.collect_set("at")).alias("hits")))
    least = F.ceil(F.lit(threshold) * F.col("m") - 1e-9).cast("int")
    windows = materialise(hits.filter(F.size("hits") >= least).withColumn("starts", starts(F.col("hits"), F.col("m"), least))
                          .filter("size(starts) > 0").select("key", "m", "starts"), "windows")
    near = sized(materialise(windows.select("key").distinct(), "hit-documents"))
    texts = materialise(rows.join(near, "key").select("key", shingles(F.col("t")).alias("all")).distinct(), "hit-shingles")
    cut = materialise(windows.join(texts, "key").select("key", "m", "all", F.explode("starts").alias("start"))
                      .select("key", "m", "start", F.slice("all", F.col("start") + 1, F.col("m")).alias("window"))
                      .withColumn("w", content("window")), "windows-cut")
    # windows and items of equal content are looked up once, whatever number of pages mirrors them
    probes = materialise(cut.groupBy("w", "m").agg(F.first("window").alias("window")).withColumn("b", blocks(F.col("window"))), "probes")
    index = materialise(items.groupBy("o", "m").agg(F.first("own").alias("own")).withColumn("b", blocks(F.col("own"))), "index")
    pairs = (probes.select("w", "m", F.explode("b").alias("b")).select("w", "m", "b.*")
             .join(index.select("o", "m", F.explode("b").alias("b")).select("o", "m", "b.*").withColumnRenamed("print", "item_print"),
                   ["m", "seed", "block", "bits"])
             .filter(F.bit_count(F.col("print").bitwiseXOR(F.col("item_print"))) <= RADIUS).select("w", "o").distinct())
    good = (pairs.join(probes.select("w", "window"), "w").join(index.select("o", "own"), "o")
            .select("w", "o", weighted_similarity(F.col("window"), F.col("own")).alias("similarity"))
            .filter(F.col("similarity") >= threshold - 1e-9))
    named = sized(materialise(good.join(items.select("o", "item_id").distinct(), "o").select("w", "item_id", "similarity"), "similar"))
    best = (cut.select("key", "start", "w").join(named, "w").groupBy("key", "item_id")
            .agg(F.max(F.struct("similarity", (-F.col("start")).alias("back"))).alias("best")))
    return best.select(F.col("key.id").alias("doc_id"), "key", "item_id", (-F.col("best.back")).alias("start"), F.col("best.similarity").alias("similarity"))


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, ident: str = "doc_id", text: str = "text", threshold: float = 0.8) -> DataFrame:
    """`docs` without the documents that hold a benchmark item; columns as they are."""
    gone = matches(docs, benchmark, ident, text, threshold).select(F.col("key").alias("__key")).distinct()
    return without(docs, ["__key", "__own"]).withColumn("__own", row_key(ident, text)).join(gone, F.col("__own") == F.col("__key"), "left_anti").drop("__own")
