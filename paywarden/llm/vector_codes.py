"""Product codes of vectors on integer codebooks; the nearest entry is found by Orchard's search.

Each component x becomes floor(256 * x); a vector is cut into equal consecutive parts, and each part is
coded by the nearest entry of its position's codebook (squared Euclidean distance, the lower index at a
tie). Codebooks start as the parts of the vectors with the smallest ids; a round assigns all parts and
replaces each entry by floor(sum / count) of its parts. All arithmetic is on integers, so results don't
depend on partitions.

Orchard's search keeps, for every entry, the list of all entries sorted by their distance from it. It walks
the list of the best entry so far, skips entries already seen, jumps to the list of an entry that is
better, and ends once the list's entries are more than twice the current distance away: by the triangle
inequality nothing nearer is left. The parts of a batch walk in step.

Only codebooks pass through the driver (parts x entries x width numbers, whatever the table's size); sums
are added up in tasks and by Spark. Vectors that are null, empty or hold null or non-finite components are
dropped, and so are those whose length differs from that of the kept vector with the smallest id or can't
be cut into equal parts. Fewer kept vectors than entries give smaller codebooks; an empty table gives an
empty one. Equal ids are rows of their own (for the codebooks' start they are ordered by vector). A null
label is a label. Columns named like an output are replaced, all others stay. Components of any finite size
are exact; an error, or a sum of errors, that a long can't hold is null.
"""
from __future__ import annotations

import hashlib
import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.llm.common import without
from paywarden.session import materialise

SCALE = 256
SAFE = 1 << 27                  # components below this keep distances of up to 512 of them within 63 bits
LIMB = 32                       # bits of the digits that sums are split into
LONG_MAX = (1 << 63) - 1


def usable(vector: str) -> Column:
    v = F.col(vector)
    return v.isNotNull() & (F.size(v) > 0) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))


def scaled(x: float) -> int:
    return int(x) * SCALE if abs(x) >= 1 << 60 else math.floor(x * SCALE)


def integers(values: np.ndarray) -> np.ndarray:
    """floor(256 * x): as int64 where that is safe, else as Python integers."""
    with np.errstate(over="ignore"):
        big = values.astype(np.float64) * SCALE
    if not big.size or np.abs(big).max() < SAFE:
        return np.floor(big).astype(np.int64)
    return np.array([scaled(x) for x in values.ravel().tolist()], object).reshape(values.shape)


def matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return integers(flat.reshape(len(column), -1))


def fitting(*arrays: np.ndarray) -> list[np.ndarray]:
    """All of one kind: Python integers where any of them needs these."""
    big = any(a.dtype == object for a in arrays)
    return [a.astype(object) if big else a for a in arrays]


class Orchard:
    """Nearest entries of one codebook (entries x width)."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries
        self.between = ((entries[:, None, :] - entries[None, :, :]) ** 2).sum(2)
        k = len(entries)
        rows = [sorted(range(k), key=lambda j, row=row: (row[j], j)) for row in self.between.tolist()]
        self.near = np.array(rows, np.int64).reshape(k, k)
        self.measured = 0               # distances computed so far

    def nearest(self, parts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each part, the lower index at a tie."""
        n, k = len(parts), len(self.entries)
        entries, parts = fitting(self.entries, parts)
        between = self.between.astype(entries.dtype)
        current = np.zeros(n, np.int64)
        best = ((parts - entries[0]) ** 2).sum(1)
        seen = np.zeros((n, k), bool)
        seen[:, 0] = True
        place = np.zeros(n, np.int64)
        active = np.arange(n)
        while len(active):
            candidate = self.near[current[active], place[active]]
            # nothing beyond twice the current distance can be nearer or as near
            open_ = (between[current[active], candidate] <= 4 * best[active]).astype(bool)
            active, candidate = active[open_], candidate[open_]
            place[active] += 1
            new = ~seen[active, candidate]
            at, found = active[new], candidate[new]
            seen[at, found] = True
            self.measured += len(at)
            distance = ((parts[at] - entries[found]) ** 2).sum(1)
            better = ((distance < best[at]) | ((distance == best[at]) & (found < current[at]))).astype(bool)
            at, found = at[better], found[better]
            best[at], current[at], place[at] = distance[better], found, 0
            active = active[place[active] < k]
        return current, best


class Books:
    """Codebooks of all part positions, as they are sent to the workers."""

    def __init__(self, books: list[np.ndarray]):
        self.books = books
        self.search: list[Orchard] | None = None

    def __getstate__(self):
        return {"books": self.books, "search": None}

    def assign(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if self.search is None:
            self.search = [Orchard(b) for b in self.books]
        width = vectors.shape[1] // len(self.books)
        found = [s.nearest(vectors[:, i * width:(i + 1) * width]) for i, s in enumerate(self.search)]
        return np.stack([c for c, _ in found], 1), reduce(lambda a, b: a + b, [d for _, d in found])

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for b in self.books for x in b.ravel().tolist()).encode()).hexdigest()


def limbs(value: int) -> list[int]:
    """Digits of LIMB bits whose weighted sum is the value; one digit for all that fits into 48 bits."""
    if abs(value) < 1 << 48:
        return [value]
    sign, value, out = (-1 if value < 0 else 1), abs(value), []
    while value:
        out.append(sign * (value & ((1 << LIMB) - 1)))
        value >>= LIMB
    return out


def updated(df: DataFrame, vector: str, books: Books) -> Books:
    """One round: each entry becomes floor(sum / count) of the parts assigned to it; unused ones stay."""
    parts, shared = len(books.books), df.sparkSession.sparkContext.broadcast(books)

    def add(batches):
        sums: dict[tuple[int, int, int], int] = {}
        for batch in batches:
            vectors = matrix(batch.column(0))
            if not len(vectors):
                continue
            codes, _ = shared.value.assign(vectors)
            width = vectors.shape[1] // parts
            for p in range(parts):
                order = np.argsort(codes[:, p], kind="stable")
                entries, first, members = np.unique(codes[order, p], return_index=True, return_counts=True)
                total = np.add.reduceat(vectors[order, p * width:(p + 1) * width], first)
                for e, m, row in zip(entries.tolist(), members.tolist(), total.tolist()):
                    for j, x in enumerate([m, *row]):
                        sums[p, e, j] = sums.get((p, e, j), 0) + x
        rows = [(*key, i, x) for key, value in sums.items() for i, x in enumerate(limbs(value))]
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows)], names=["p", "e", "j", "limb", "x"])

    found = (df.select(vector).mapInArrow(add, "p long, e long, j long, limb long, x long")
             .groupBy("p", "e", "j", "limb").agg(F.sum("x").alias("x")).collect())      # bounded by the codebooks
    totals: dict[tuple[int, int, int], int] = {}
    for r in found:
        totals[r.p, r.e, r.j] = totals.get((r.p, r.e, r.j), 0) + (r.x << LIMB * r.limb)
    new = []
    for p, book in enumerate(books.books):
        rows = [[totals.get((p, e, j + 1), 0) // totals[p, e, 0] for j in range(book.shape[1])] if (p, e, 0) in totals else row
                for e, row in enumerate(book.tolist())]
        new.append(compact(rows))
    return Books(new)


def compact(rows: list[list[int]]) -> np.ndarray:
    small = all(abs(x) < SAFE for row in rows for x in row)
    return np.array(rows, np.int64 if small else object)


def train(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", parts: int = 16, entries: int = 64,
          rounds: int = 2) -> tuple[Books | None, int]:
    """Codebooks from all rows of `df` (usable vectors), and the length of the vectors they code."""
    first = df.select(ident, vector).orderBy(F.col(ident).asc_nulls_last(), vector).limit(1).collect()
    if not first or len(first[0][1]) % parts:
        return None, 0
    size = len(first[0][1])
    rows = df.filter(F.size(vector) == size)
    start = rows.select(ident, vector).orderBy(F.col(ident).asc_nulls_last(), vector).limit(entries).collect()
    vectors = [[scaled(x) for x in r[1]] for r in start]
    width = size // parts
    books = Books([compact([v[p * width:(p + 1) * width] for v in vectors]) for p in range(parts)])
    for _ in range(rounds):
        books = updated(rows, vector, books)
    return books, size


def encode(df: DataFrame, ident: str = "vec_id", vector: str = "embedding", label: str = "label", parts: int = 16,
           entries: int = 64, rounds: int = 2) -> DataFrame:
    """Every usable row with its `code` (two hex digits per part), `error`, `label_error` (the errors of its
    label added up) and the digest of the final codebooks."""
    kept = without(df, ["code", "error", "label_error", "codebooks_sha256"]).filter(usable(vector))
    books, size = train(kept, ident, vector, parts, entries, rounds)
    schema = T.StructType([*kept.schema.fields, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    spark = df.sparkSession
    if books is None:
        return (spark.createDataFrame([], schema)
                .select("*", F.lit(None).cast("long").alias("label_error"), F.lit(None).cast("string").alias("codebooks_sha256")))
    shared = spark.sparkContext.broadcast(books)

    def code(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            codes, errors = shared.value.assign(matrix(batch.column(vector)))
            texts = [row.tobytes().hex() for row in codes.astype(np.uint8)]
            fits = [x if x <= LONG_MAX else None for x in errors.tolist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string()), pa.array(fits, pa.int64())], schema=arrow_schema(batch))

    def arrow_schema(batch):
        return pa.schema([*batch.schema, pa.field("code", pa.string()), pa.field("error", pa.int64())])

    done = materialise(kept.filter(F.size(vector) == size).mapInArrow(code, schema), "vector-codes")
    # the sums are a table of their own: a hot label's rows can then be split when they meet them
    total = F.when(F.count("error") == F.count("*"), F.expr("try_sum(error)"))
    sums = materialise(done.groupBy(F.col(label).alias("__label")).agg(total.alias("label_error")), "vector-labels")
    return (done.join(sums, F.col(label).eqNullSafe(F.col("__label")), "left").drop("__label")
            .withColumn("codebooks_sha256", F.lit(books.digest())))
