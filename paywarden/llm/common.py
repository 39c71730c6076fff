"""Helpers shared by the operators: column handling, row keys, Arrow passes, shared files."""
from __future__ import annotations

import ctypes
import gc
import re
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.session import stage_folder

BATCH_BYTES = 4 << 20            # text handled at once in a Python worker


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def without(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """`df` less the columns whose names clash (in any case) with columns an operator adds."""
    taken = {n.lower() for n in names}
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in taken])


def row_key(*names: str) -> Column:
    """A key that tells rows apart by id and text, and is equal for nulls: rows that agree in both
    are one document wherever an operator counts documents."""
    ident, text = names
    return F.struct(F.col(ident).alias("id"), F.xxhash64(F.coalesce(F.col(text), F.lit("")), F.col(text).isNull()).alias("h"))


def slices(batch: pa.RecordBatch, text: str, size: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """The batch in pieces of about `size` bytes of text (a single longer text is a piece of its own)."""
    lengths = pc.binary_length(batch.column(text)).to_pylist()
    start = total = 0
    for i, n in enumerate(lengths):
        if total and total + (n or 0) > size:
            yield batch.slice(start, i - start)
            start, total = i, 0
        total += n or 0
    if start < batch.num_rows:
        yield batch.slice(start)


def add_columns(df: DataFrame, text: str, fields: Sequence[T.StructField],
                make: Callable[[list], Sequence[pa.Array]], size: int = BATCH_BYTES) -> DataFrame:
    """Pass every row through Arrow batches; `make` turns a list of texts into the new columns.

    Columns of `df` that clash with the new names are replaced; all others stay.
    """
    kept = without(df, [f.name for f in fields]) if text.lower() not in {f.name.lower() for f in fields} else df
    schema = T.StructType([*kept.schema.fields, *fields])

    def run(batches):
        for batch in batches:
            for part in slices(batch, text, size):
                new = make(part.column(text).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, *new], names=[*part.schema.names, *[f.name for f in fields]])

    return kept.mapInArrow(run, schema)


_working: dict[str, tuple[dict, ...]] = {}


def take_over(operator: str, *caches: dict) -> None:
    """Worker processes are used again by later stages: the first call by another operator empties the caches
    of the one before and gives its memory back."""
    if operator in _working:
        return
    for held in _working.values():
        for cache in held:
            cache.clear()
    _working.clear()
    _working[operator] = caches
    gc.enable()
    gc.collect()
    pa.default_memory_pool().release_unused()
    try:
        ctypes.CDLL(None).malloc_trim(0)
    except (AttributeError, OSError, TypeError):        # no such call in this C library
        pass


def word_chunks(text: str) -> list[str] | None:
    """The text cut before every single space. A byte-level pattern joins one space to what follows, so no
    piece straddles a cut; None where spaces follow each other, as a run of white space is one piece."""
    if not text or "  " in text:
        return None
    first, *rest = text.split(" ")
    chunks = [" " + w for w in rest]
    return [first, *chunks] if first else chunks


class ChunkCache:
    """Encoded chunks of a worker process. What a list of texts lacks is encoded together; two generations
    of `entries` keep what recurs and bound the memory; long chunks aren't kept."""

    def __init__(self, cut: Callable[[str], list[str]], fill: Callable[[list[str]], dict[str, bytes]], entries: int = 400_000):
        gc.disable()        # no cycles arise in these workers; tracking a million entries costs more than the work
        self.cut, self.fill, self.entries = cut, fill, entries
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.cut(t) for t in texts]
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        need = set().union(*parts).difference(young)
        kept = {c: old[c] for c in need if c in old}
        young.update(kept)
        need.difference_update(kept)
        if need:
            young.update(self.fill(list(need)))
        out = [b"".join(map(young.__getitem__, p)) for p in parts]
        for c in [c for c in need if len(c) > 48]:
            del young[c]
        return out


def new_folder(spark: SparkSession, name: str) -> str:
    """A folder of its own for one call, below the cluster's shared checkpoint folder."""
    folder = stage_folder(spark)
    if "://" not in folder and folder.startswith("file:"):
        folder = "file://" + folder.removeprefix("file:")
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def file_system(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(uri)


def write_file(uri: str) -> tuple[pa.NativeFile, Callable[[], str]]:
    """A stream to a file that only this task attempt writes; the call ends it and gives its address.
    Attempts that fail leave files that no manifest names."""
    fs, path = file_system(uri)
    fs.create_dir(path.rpartition("/")[0], recursive=True)
    stream = fs.open_output_stream(path, compression=None)

    def close() -> str:
        stream.close()
        return uri

    return stream, close


def connected(edges: DataFrame, name: str) -> DataFrame:
    """(node, root): the smallest node reachable over `edges` (a, b), for every node of an edge.

    Each round hooks every node's root to the smallest root among its neighbours and then halves the
    paths; rounds grow with the logarithm of the longest chain. Nothing is collected, each round is a
    written table, and a hot node is pre-aggregated by min() before its rows meet.
    """
    from paywarden.session import materialise

    both = materialise(edges.select(F.col("a"), F.col("b")).union(edges.select(F.col("b"), F.col("a"))).distinct(), f"{name}-edges")
    label = materialise(both.groupBy("a").agg(F.least(F.first("a"), F.min("b")).alias("root")).withColumnRenamed("a", "node"), f"{name}-root")
    while True:
        near = (both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy("a").agg(F.min("root").alias("near"))
                .withColumnRenamed("a", "node"))
        joined = label.join(near, "node").select("node", "root", F.least("root", "near").alias("low"))
        # the old root takes the smallest root any of its members saw
        hooks = joined.groupBy(F.col("root").alias("node")).agg(F.min("low").alias("hook"))
        hooked = (joined.join(hooks, "node", "left")
                  .select("node", F.col("root").alias("old"), F.least("low", F.coalesce("hook", "low")).alias("mid")))
        step = hooked.join(hooked.select(F.col("node").alias("mid"), F.col("mid").alias("up")), "mid", "left")
        after = materialise(step.select("node", "old", F.least("mid", F.coalesce("up", "mid")).alias("root")), f"{name}-root")
        if after.filter("old != root").isEmpty():
            return after.select("node", "root")
        label = after.select("node", "root")


def spaced_words(texts: list[str], more: re.Pattern | None = None) -> pa.ListArray:
    """Each text cut before every single space. A byte-level pattern joins one space to what follows, so no piece
    straddles a cut; a text with spaces that follow each other stays whole, as a run of white space is one
    piece. `more` matches the empty places of further cuts. Cuts are marked by a character that no text of the
    batch holds; were there none, all stay whole."""
    mark = next((c for c in ("\x1e", "\x1f", *map(chr, range(0xE000, 0xE100))) if not any(c in t for t in texts)), None)
    if mark is None:
        return pa.array([[t] for t in texts], pa.list_(pa.string()))
    cut = [t if "  " in t else t.replace(" ", mark + " ") for t in texts]
    if more is not None:
        cut = [more.sub(mark, t) for t in cut]
    return pc.split_pattern(pa.array(cut, pa.string()), mark)


def gather(values: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The runs values[start:start + size], one after the other."""
    ends = np.cumsum(sizes)
    if not len(ends) or not ends[-1]:
        return values[:0]
    return values[np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1])]


class WordTable:
    """Encoded words of a worker process, in flat arrays. A batch's words are dictionary-encoded, only words
    that are new are encoded, and all occurrences are gathered from the arrays; the table starts anew when
    it holds `entries` words or eight times as many values, which bounds the memory and changes no result.
    `encode` turns a list of words into the number of values of each, and all values in a row for each track."""

    def __init__(self, encode: Callable[[list[str]], tuple[np.ndarray, Sequence[np.ndarray]]], tracks: int, entries: int = 400_000):
        self.encode, self.tracks, self.entries = encode, tracks, entries
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)
        self.values = [np.zeros(0, np.int32) for _ in range(self.tracks)]

    def add(self, words: list[str]) -> None:
        sizes, values = self.encode(words)
        first = len(self.values[0]) + np.cumsum(sizes) - sizes
        self.row.update(zip(words, range(len(self.starts), len(self.starts) + len(words))))
        self.starts, self.sizes = np.concatenate([self.starts, first]), np.concatenate([self.sizes, sizes])
        self.values = [np.concatenate([old, new]) for old, new in zip(self.values, values)]

    def look_up(self, words: pa.Array) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many values each word has, and the values of all words in order, for each track."""
        coded = words.dictionary_encode()
        own = coded.dictionary.to_pylist()
        if len(self.row) > self.entries or len(self.values[0]) > 8 * self.entries:
            self.clear()
        known = self.row
        found = np.fromiter([known.get(w, -1) for w in own], np.int64, len(own))
        new = np.flatnonzero(found < 0)
        if len(new):
            found[new] = len(self.starts) + np.arange(len(new))
            self.add([own[i] for i in new.tolist()])
        rows = found[coded.indices.to_numpy()]
        sizes = self.sizes[rows]
        return sizes, [gather(v, self.starts[rows], sizes) for v in self.values]
