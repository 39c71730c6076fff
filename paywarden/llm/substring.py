"""Repeated passages: sliding spans of consecutive sentences, hashed and joined over all documents.

    texts ── sentences ── every run of 3 sentences with 12 words or more, and of 2 with 24 or more
          ── hash of the run's words ── first place and count per hash ── hashes met more than once
          ── runs at any place but the first ── sentences they cover ── removed from the text

The first place is the smallest (doc_id, text hash, sentence); null ids come first. A sentence ends after . ! ?
and white space, or at a line break; one of more than 32 words also ends after each word whose checksum is
divisible by eight, so that a passage without punctuation still has sentences that don't depend on what
surrounds it. Words compare in lower case, white-space separated; sentences without words belong to the one before.

Counting combines per task before its shuffle, so a run that a third of all documents share is one row per
task. The runs then meet the repeated hashes in an ordinary join whose hot keys adaptive execution splits.
Only counts, places and hashes move for that; a text moves once, to meet its covered sentences.
Hashes have 64 bits.

Null text stays null, an empty text has no sentence. Rows that repeat both id and text are one document and
are treated alike. Other columns pass through; columns named like an output are replaced.
"""
from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.llm.common import slices, without
from paywarden.session import materialise

RUNS = ((3, 12), (2, 24))        # sentences of a run, words it has at least
LONG = 32
OUTPUTS = ["n_sentences", "n_removed"]
BREAK = re.compile(r"(?<=[.!?])\s+|\n\s*")
WORD = re.compile(r"\S+\s*")


def sentences(text: str) -> list[tuple[str, list[str]]]:
    """(piece of the text, its words); the pieces joined are the text."""
    out: list[tuple[str, list[str]]] = []
    start = 0
    for end in [*[m.end() for m in BREAK.finditer(text)], len(text)]:
        piece = text[start:end]
        start = end
        found = piece.lower().split()
        if not found:
            if piece and out:
                out[-1] = (out[-1][0] + piece, out[-1][1])
            elif piece:
                out.append((piece, found))
        elif len(found) <= LONG:
            out.append((piece, found))
        else:
            out += cut(piece)
    return out


def cut(piece: str) -> list[tuple[str, list[str]]]:
    """A long sentence, ended after every word whose checksum is divisible by eight."""
    head = len(piece) - len(piece.lstrip())
    out, text, found = [], piece[:head], []
    for m in WORD.finditer(piece, head):
        text += m[0]
        low = m[0].lower().strip()
        found.append(low)
        if zlib.crc32(low.encode()) % 8 == 0:
            out.append((text, found))
            text, found = "", []
    return [*out, (text, found)] if text else out


def runs(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first sentence and length of every run that counts."""
    parts = sentences(text)
    words = np.array([len(w) for _, w in parts], np.int64)
    h = np.array([xxhash.xxh3_64_intdigest(" ".join(w)) for _, w in parts], np.uint64)
    total = np.concatenate([[0], np.cumsum(words)])
    found = []
    for k, least in RUNS:
        n = len(parts) - k + 1
        if n <= 0:
            continue
        own = np.full(n, k, np.uint64)
        for i in range(k):
            own = (own ^ h[i:i + n]) * np.uint64(0x9E3779B97F4A7C15)
            own ^= own >> np.uint64(29)
        at = np.flatnonzero(total[k:k + n] - total[:n] >= least)
        found.append((own[at], at, np.full(len(at), k)))
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*found))


def spans(docs: DataFrame, ident: str, text: str) -> DataFrame:
    """h, doc_id, t (hash of the text), i, k of every run."""
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(ident).alias("doc_id"), F.hash(text).alias("t"), F.col(text).alias("text"))

    def run(batches):
        for batch in batches:
            for part in slices(batch, "text"):
                found = [runs(t) for t in part.column("text").to_pylist()]
                size = [len(x[0]) for x in found]
                at = pa.array(np.repeat(np.arange(part.num_rows), size))
                h, i, k = (np.concatenate(c) for c in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), part.column("doc_id").take(at), part.column("t").take(at),
                                                  pa.array(i.astype(np.int32)), pa.array(k.astype(np.int32))], names=["h", "doc_id", "t", "i", "k"])

    kind = dict(rows.dtypes)["doc_id"]
    return rows.mapInArrow(run, f"h long, doc_id {kind}, t int, i int, k int")


def covered(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t and `runs` (array of first sentence and length) of the documents with repeated runs to remove."""
    found = materialise(spans(docs, ident, text), "spans")
    place = F.struct("doc_id", "t", "i")
    repeated = found.groupBy("h").agg(F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1").select("h", "first")
    later = found.join(repeated, "h").filter(place != F.col("first"))
    return later.groupBy("doc_id", "t").agg(F.collect_set(F.struct("i", "k")).alias("runs"))


def remove_repeats(docs: DataFrame, ident: str = "doc_id", text: str = "text") -> DataFrame:
    """`docs` without the sentences that a repeated run covers, and n_sentences (before), n_removed."""
    gone = covered(docs, ident, text).select(F.struct("doc_id", "t").alias("__key"), F.col("runs").alias("__runs"))
    kept = without(docs, [*OUTPUTS, "__key", "__runs", "__own"])
    wide = (kept.withColumn("__own", F.struct(F.col(ident).alias("doc_id"), F.hash(text).alias("t")))
            .join(gone, F.col("__own") == F.col("__key"), "left").drop("__own", "__key"))
    fields = [T.StructField(n, T.IntegerType()) for n in OUTPUTS]
    schema = T.StructType([*kept.schema.fields, *fields])
    names = kept.columns

    def run(batches):
        for batch in batches:
            for part in slices(batch, text):
                texts, before, removed = [], [], []
                for t, marks in zip(part.column(text).to_pylist(), part.column("__runs").to_pylist()):
                    pieces = sentences(t or "")
                    hit = {s for m in marks or [] for s in range(m["i"], m["i"] + m["k"])}
                    texts.append("".join([p for s, (p, _) in enumerate(pieces) if s not in hit]) if hit else t)
                    before.append(len(pieces))
                    removed.append(len(hit))
                columns = [pa.array(texts, pa.string()) if n == text else part.column(n) for n in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(before, pa.int32()), pa.array(removed, pa.int32())], names=schema.fieldNames())

    return wide.mapInArrow(run, schema)
