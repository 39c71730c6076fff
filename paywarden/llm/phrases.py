"""Phrases whose words stand together more often than apart, counted through a prefix-free parse.

A text is lower-cased (A-Z), cut into pieces at punctuation and line ends, and these into words. A piece is
parsed into chunks: a chunk ends behind every pair of words whose checksum hits the trigger, and the next
one begins with that same pair. Cuts depend on the words alone, so copies of a passage give the same
chunks; the dictionary holds each distinct chunk once, with its parse frequency. N-grams (of up to three
words) are then counted inside the distinct chunks, weighted by these frequencies. Neighbouring chunks share
two words: an n-gram that lies wholly inside them counts with the earlier chunk only, so every occurrence
counts once, and every n-gram lies in some chunk.

Counts are exact and cover all texts. Phrases are counted length by length: a
phrase can't occur `least` times if a part of it doesn't, so those with a rarer part are left out before
anything is shuffled. Which parts are frequent is told by a bitmap of fixed size (8 MB) that finds all of
them and some others. Tasks count what they hold first, and emit their counters whenever these reach a
fixed size. A language's phrases are ranked in slices, so that its last window reads a bounded number of
rows.

Null text is empty, a null language counts as `und`. Empty texts and texts without words add nothing; very
long texts are chunked whole. Repeated rows count each. Ties in score go by count, then by the phrase's
bytes; ties between cuts go to the shorter first part. An empty table gives no phrases. Other columns of the
table, whatever their names, aren't used.
"""
from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.llm.common import BATCH_BYTES, gather, slices
from paywarden.session import materialise

TRIGGER = 64                    # one pair of words in so many ends a chunk
MIX = (0x9E3779B1, 0x85EBCA77)  # odd factors that spread the checksums of a pair
ENTRIES = 100_000               # distinct pieces of a task that are counted before they are parsed
GRAM_WORDS = 400_000            # words of distinct chunks whose grams are counted at once
#: Capital letters to small ones, tabs to blanks, what ends a piece to line ends.
TABLE = bytes(10 if chr(b) in ".,;:!?\n\x0b\x0c\r" else 32 if b == 9 else b + 32 if 65 <= b <= 90 else b for b in range(256))


def words_of(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, pa.Array, np.ndarray]:
    """For pieces of words with blanks between: their words' offsets and codes, the distinct words, and
    the checksums of these."""
    lists = pc.split_pattern(pa.array([p.decode() for p in pieces], pa.string()), " ")
    coded = lists.flatten().dictionary_encode()
    sums = np.fromiter((zlib.crc32(w.encode()) for w in coded.dictionary.to_pylist()), np.int64, len(coded.dictionary))
    return lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64), coded.dictionary, sums


def parse(pieces: list[bytes], weights: np.ndarray, trigger: int) -> tuple[np.ndarray, pa.Array, np.ndarray]:
    """Chunks of the pieces: whether another chunk of the piece stands before, the text, the weight."""
    offsets, codes, words, sums = words_of(pieces)
    starts, ends = offsets[:-1], offsets[1:]
    owner = np.repeat(np.arange(len(pieces)), ends - starts)
    at = np.arange(len(codes))
    # a pair (i, i + 1) ends a chunk if more words follow in its piece
    inside = at + 2 < ends[owner]
    i = at[inside]
    mixed = (sums[codes[i]] * MIX[0] + sums[codes[i + 1]] * MIX[1]) & 0x7FFFFFFFFFFFFFFF
    cut = i[(mixed >> 24) % trigger == 0]
    begin = np.concatenate([starts, cut])
    inner = np.concatenate([np.zeros(len(starts), bool), np.ones(len(cut), bool)])
    order = np.lexsort((inner, begin))
    begin, inner = begin[order], inner[order]
    mine = np.concatenate([np.arange(len(starts)), owner[cut]])[order]
    # a chunk reaches to the second word of the next one of its piece, or to the piece's end
    follows = np.append(mine[1:] == mine[:-1], False)
    stop = np.where(follows, np.append(begin[1:], 0) + 2, ends[mine])
    sizes = stop - begin
    picked = words.take(pa.array(codes[gather(at, begin, sizes)]))
    texts = pc.binary_join(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), picked), " ")
    return inner, texts, weights[mine]


def chunks(df: DataFrame, text: str = "text", lang: str = "lang", trigger: int = TRIGGER) -> DataFrame:
    """The dictionary (lang, inner, chunk, weight): distinct chunks and how often the parse has them."""
    rows = df.select(F.coalesce(F.col(text), F.lit("")).alias("text"), F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang"))
    names = ["lang", "inner", "chunk", "weight"]

    def emit(counts: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for own, counter in counts.items():
            total: dict[bytes, int] = {}
            for piece, n in counter.items():
                piece = b" ".join(piece.split())
                if piece:
                    total[piece] = total.get(piece, 0) + n
            pieces = list(total)
            # long pieces are few; a slice of pieces bounds what is parsed at once
            for part in bounded(pieces):
                inner, texts, weights = parse(part, np.fromiter((total[p] for p in part), np.int64, len(part)), trigger)
                yield pa.RecordBatch.from_arrays([pa.array([own] * len(inner), pa.string()), pa.array(inner), texts, pa.array(weights)], names=names)

    def run(batches):
        counts: dict[str, Counter] = {}
        for batch in batches:
            for part in slices(batch, "text"):
                texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
                for own in set(langs):
                    joined = "\n".join(t for t, x in zip(texts, langs) if x == own).encode().translate(TABLE)
                    counts.setdefault(own, Counter()).update(joined.split(b"\n"))
                if sum(map(len, counts.values())) > ENTRIES:
                    yield from emit(counts)
                    counts = {}
        yield from emit(counts)

    return (rows.mapInArrow(run, "lang string, inner boolean, chunk string, weight long")
            .groupBy("lang", "inner", "chunk").agg(F.sum("weight").alias("weight")))


def bounded(pieces: list[bytes], size: int = BATCH_BYTES) -> Iterator[list[bytes]]:
    part, total = [], 0
    for p in pieces:
        if part and total + len(p) > size:
            yield part
            part, total = [], 0
        part.append(p)
        total += len(p)
    if part:
        yield part


class Marks:
    """A bitmap of phrases, of a fixed size: a phrase that was marked is always found; of others, more are
    found the fuller the bitmap is, which costs work and changes no result."""

    def __init__(self, bits: int = 26):
        self.bits = bits
        self.words = np.zeros(1 << bits - 6, np.uint64)

    @staticmethod
    def hashes(lang: str, *sums: np.ndarray) -> np.ndarray:
        """64-bit hashes of phrases, from the checksums of their words."""
        with np.errstate(over="ignore"):
            h = np.full(len(sums[0]), zlib.crc32(lang.encode()) + 1, np.uint64)
            for s in sums:
                h = (h ^ s.astype(np.uint64)) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            return h

    def places(self, h: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for factor in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
            place = (h * np.uint64(factor)) >> np.uint64(64 - self.bits)
            yield place >> np.uint64(6), np.uint64(1) << (place & np.uint64(63))

    def add(self, h: np.ndarray) -> None:
        for at, bit in self.places(h):
            np.bitwise_or.at(self.words, at, bit)

    def holds(self, h: np.ndarray) -> np.ndarray:
        found = np.ones(len(h), bool)
        for at, bit in self.places(h):
            found &= self.words[at] & bit != 0
        return found


def marked(often: DataFrame, bits: int = 26) -> Marks:
    """The bitmap of (lang, phrase) rows; the driver receives its words that aren't zero, 16 MB at most."""
    def run(batches):
        own = Marks(bits)
        for batch in batches:
            by_lang: dict[str, list[list[int]]] = {}
            for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
                by_lang.setdefault(lang, []).append([zlib.crc32(w.encode()) for w in phrase.split(" ")])
            for lang, sums in by_lang.items():
                own.add(Marks.hashes(lang, *np.array(sums, np.uint64).T))
        at = np.flatnonzero(own.words)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(own.words[at].view(np.int64))], names=["at", "bits"])

    found = often.select("lang", "phrase").mapInArrow(run, "at long, bits long").groupBy("at").agg(F.bit_or("bits").alias("bits")).toArrow()
    out = Marks(bits)
    out.words[found.column("at").to_numpy()] = found.column("bits").to_numpy().view(np.uint64)
    return out


def grams(dictionary: DataFrame, n: int, least: int, parts: Marks | None = None) -> DataFrame:
    """(lang, size, phrase, f): phrases of n words that occur `least` times or more. `parts` marks the phrases
    of n - 1 words that do; a phrase with a part that doesn't is left out before it's counted."""
    names = ["lang", "phrase", "f"]
    shared = dictionary.sparkSession.sparkContext.broadcast(parts)

    def count(own: str, inner: np.ndarray, texts: pa.Array, weights: np.ndarray) -> Iterator[pa.RecordBatch]:
        lists = pc.split_pattern(texts, " ")
        coded = lists.flatten().dictionary_encode()
        words = coded.dictionary
        bits = int(len(words)).bit_length()
        if n * bits > 63 and len(texts) > 1:        # more distinct words than a key can hold
            half = len(texts) // 2
            for cut in (slice(None, half), slice(half, None)):
                yield from count(own, inner[cut], texts[cut], weights[cut])
            return
        offsets, codes = lists.offsets.to_numpy().astype(np.int64), coded.indices.to_numpy().astype(np.int64)
        sizes = np.diff(offsets)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        place = np.arange(len(codes)) - offsets[owner]
        # what ends within the two words shared with the chunk before counts there
        good = (place + n <= sizes[owner]) & (~inner[owner] | (place + n > 2))
        if shared.value is not None:
            sums = np.fromiter((zlib.crc32(w.encode()) for w in words.to_pylist()), np.uint64, len(words))
            if n == 2:
                found = shared.value.holds(Marks.hashes(own, sums))[codes]
            else:
                found = np.append(shared.value.holds(Marks.hashes(own, sums[codes[:-1]], sums[codes[1:]])), False)
            good &= found & np.append(found[1:], False)
        i = np.flatnonzero(good)
        if not len(i):
            return
        key = codes[i]
        for j in range(1, n):
            key = key << bits | codes[i + j]
        order = np.argsort(key, kind="stable")
        key, first = np.unique(key[order], return_index=True)
        f = np.add.reduceat(weights[owner[i]][order], first)
        picked = [words.take(pa.array(key >> bits * (n - 1 - j) & (1 << bits) - 1)) for j in range(n)]
        phrase = picked[0] if n == 1 else pc.binary_join_element_wise(*picked, " ")
        yield pa.RecordBatch.from_arrays([pa.array([own] * len(f), pa.string()), phrase, pa.array(f)], names=names)

    def run(batches):
        held: dict[str, list[pa.RecordBatch]] = {}
        total = 0

        def emit():
            for own, parts in held.items():
                table = pa.Table.from_batches(parts)
                column = {c: table.column(c).combine_chunks() for c in ("inner", "chunk", "weight")}
                yield from count(own, column["inner"].to_numpy(zero_copy_only=False).astype(bool), column["chunk"], column["weight"].to_numpy())

        for batch in batches:
            langs = batch.column("lang").to_numpy(zero_copy_only=False)
            for own in set(langs.tolist()):
                held.setdefault(own, []).append(batch.filter(pa.array(langs == own)))
            total += pc.sum(pc.add(pc.count_substring(batch.column("chunk"), " "), 1)).as_py() or 0
            if total > GRAM_WORDS:
                yield from emit()
                held, total = {}, 0
        yield from emit()

    return (dictionary.mapInArrow(run, "lang string, phrase string, f long").groupBy("lang", "phrase").agg(F.sum("f").alias("f"))
            .filter(F.col("f") >= least).select("lang", F.lit(n).alias("size"), "phrase", "f"))


def score(a: Column, left: Column, right: Column) -> Column:
    """floor(1 000 000 a a / (l r)), exact; at most a million, as neither part is rarer than the whole."""
    wide = "decimal(19,0)"
    top = (F.lit(1_000_000).cast("decimal(7,0)") * (a.cast("decimal(15,0)") * a.cast("decimal(15,0)")).cast("decimal(30,0)")).cast("decimal(38,0)")
    return F.call_function("div", top, (left.cast(wide) * right.cast(wide)).cast("decimal(38,0)"))


def phrases(df: DataFrame, text: str = "text", lang: str = "lang", least: int = 10, share: int = 50, top: int = 2000,
            trigger: int = TRIGGER) -> DataFrame:
    """Each language's `top` phrases: those of 2 and 3 words that occur `least` times or more, without
    those of which a longer candidate holds `share` percent, by the score of their worst cut."""
    dictionary = materialise(chunks(df, text, lang, trigger), "phrase-chunks")
    # a part is never rarer than the phrase it's cut from, so each length needs the frequent ones of the last only
    often, parts = None, None
    for n in (1, 2, 3):
        found = materialise(grams(dictionary, n, least, parts), "phrase-grams")
        parts = marked(found) if n < 3 else None
        often = found if often is None else often.unionByName(found)
    totals = words_per_language(df, text, lang)
    found = often.filter("size >= 2").withColumnRenamed("f", "a")
    cuts = [(1, "l", "1"), (1, "r", "1 - size"), (2, "l", "2"), (2, "r", "2 - size")]
    asked = (found.select("lang", "phrase", "size", "a", F.inline(F.array(*[
        F.struct(F.lit(cut).alias("cut"), F.lit(side).alias("side"), F.expr(f"substring_index(phrase, ' ', {words})").alias("part"))
        for cut, side, words in cuts])))
        .filter(F.col("cut") < F.col("size")))
    counted = (asked.join(often.select("lang", F.col("phrase").alias("part"), "f"), ["lang", "part"])
               .groupBy("lang", "phrase")
               .agg(F.first("a").alias("a"), *[F.max(F.when((F.col("cut") == cut) & (F.col("side") == side), F.col("f"))).alias(f"{side}{cut}")
                                               for cut, side, _ in cuts]))
    longer = (found.filter("size = 3")
              .select("lang", F.explode(F.array(F.substring_index("phrase", " ", 2), F.substring_index("phrase", " ", -2))).alias("phrase"), "a")
              .groupBy("lang", "phrase").agg(F.max("a").alias("within")))
    second = F.col("l2").isNotNull() & (score(F.col("a"), F.col("l2"), F.col("r2")) < score(F.col("a"), F.col("l1"), F.col("r1")))
    scored = (counted.join(longer, ["lang", "phrase"], "left")
              .filter(F.col("within").isNull() | (100 * F.col("within") < share * F.col("a")))
              .select("lang", "phrase", "a", F.when(second, F.col("l2")).otherwise(F.col("l1")).alias("l"),
                      F.when(second, F.col("r2")).otherwise(F.col("r1")).alias("r"))
              .withColumn("score", score(F.col("a"), F.col("l"), F.col("r"))))
    best = ranked(scored, top)
    return (best.join(F.broadcast(totals) if small(totals) else totals, "lang")
            .select("lang", "rank", "phrase", "a", "l", "r", "n", "score"))


def words_per_language(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, n): all word occurrences."""
    marks = ".,;:!?\n\x0b\x0c\r\t"
    own = F.coalesce(F.col(lang).cast("string"), F.lit("und")).alias("lang")
    words = F.size(F.filter(F.split(F.translate(F.coalesce(F.col(text), F.lit("")), marks, " " * len(marks)), " "), lambda w: w != ""))
    return df.select(own, words.cast("long").alias("n")).groupBy("lang").agg(F.sum("n").alias("n")).filter("n > 0")


def small(totals: DataFrame, rows: int = 10_000) -> bool:
    return totals.limit(rows + 1).count() <= rows


def ranked(scored: DataFrame, top: int) -> DataFrame:
    """The first `top` rows of each language. Slices of a language are ranked first, so that its last
    window reads 16 slices of `top` rows at most."""
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    left = scored.withColumn("__slice", F.pmod(F.xxhash64("phrase"), F.lit(256)))
    for slices_ in (256, 16):
        window = Window.partitionBy("lang", F.col("__slice") % slices_).orderBy(*order)
        left = left.withColumn("__rank", F.row_number().over(window)).filter(F.col("__rank") <= top).drop("__rank")
    final = Window.partitionBy("lang").orderBy(*order)
    return left.withColumn("rank", F.row_number().over(final).cast("long")).filter(F.col("rank") <= top).drop("__slice")
