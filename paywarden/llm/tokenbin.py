"""Token ids as binary files: byte or bit planes of fixed-size id blocks, each plane compressed alone.

A file holds the ids of many documents one after the other, cut into blocks of `BLOCK` ids without regard
to documents. A block is transposed: plane k holds byte (or bit) k of every id, so high planes are nearly
constant. Layout, little-endian:

    magic "PWTP" | mode (1 byte: 0 byte planes, 1 bit planes) | block size (uint32)
    planes, one zstandard frame each, block after block
    index, a zstandard frame: per block the ids and the bytes of each plane; doc ids, null marks, lengths
    index bytes (uint64) | magic "PWTP"

Documents are dealt to files by ranges of (doc_id, hash of the text), so files follow each other in
doc_id order and no file grows with the table. A task writes its own file and one manifest row; the
manifest is a written table, so files of failed attempts count for nothing. Reading holds one block.

Null text counts as empty, every document ends with `end_id`; null doc_ids come first. Repeated rows are
written as often as they occur. An empty table gives no files and no rows. Extra columns aren't written.
"""
from __future__ import annotations

import hashlib
import string
import struct
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from paywarden.llm.common import WordTable, file_system, new_folder, slices, take_over, write_file

MAGIC = b"PWTP"
BLOCK = 1 << 16
ENTRIES = 800_000               # words a worker keeps
#: Between a letter and one of these marks, or a line end and a letter, byte-level patterns always cut (if the
#: line end is all of its white space: of a longer run they cut off what comes before the last character).
LETTER, MARK = (np.isin(np.arange(256), np.frombuffer(c, np.uint8)) for c in (string.ascii_letters.encode(), b".,;:!?"))
_encoders: dict[str, WordTable] = {}


def to_planes(ids: np.ndarray, bits: bool) -> list[bytes]:
    """Planes of a block of uint32 ids, the lowest byte or bit first."""
    raw = np.ascontiguousarray(ids.astype("<u4")).view(np.uint8).reshape(-1, 4)
    if not bits:
        return [p.tobytes() for p in raw.T]
    return [np.packbits(p).tobytes() for p in np.unpackbits(raw, axis=1, bitorder="little").T]


def from_planes(planes: list[bytes], n: int, bits: bool) -> np.ndarray:
    rows = np.array([np.frombuffer(p, np.uint8) for p in planes])
    if bits:
        rows = np.packbits(np.unpackbits(rows, axis=1, count=n), axis=0, bitorder="little")
    return np.ascontiguousarray(rows.T).view("<u4").reshape(-1)


class Writer:
    def __init__(self, stream, bits: bool, block: int):
        self.stream, self.bits, self.block = stream, bits, block
        self.zip = zstandard.ZstdCompressor(level=1)
        self.pending, self.held, self.blocks = [], 0, []
        self.doc_ids, self.nulls, self.lengths = [], [], []
        stream.write(MAGIC + struct.pack("<BI", int(bits), block))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.doc_ids.append(doc_id or 0)
        self.nulls.append(doc_id is None)
        self.lengths.append(len(ids))
        self.pending.append(ids)
        self.held += len(ids)
        if self.held >= self.block:
            flat = np.concatenate(self.pending)
            whole = len(flat) // self.block * self.block
            for i in range(0, whole, self.block):
                self.flush(flat[i:i + self.block])
            self.pending, self.held = [flat[whole:]], len(flat) - whole

    def flush(self, ids: np.ndarray) -> None:
        frames = [self.zip.compress(p) for p in to_planes(ids, self.bits)]
        self.blocks.append([len(ids), *map(len, frames)])
        self.stream.write(b"".join(frames))

    def finish(self) -> None:
        if self.held:
            self.flush(np.concatenate(self.pending))
        planes = 32 if self.bits else 4
        blocks = np.array(self.blocks, "<u4").reshape(-1, planes + 1)
        index = self.zip.compress(struct.pack("<QQ", len(blocks), len(self.doc_ids)) + blocks.tobytes()
                                  + np.array(self.doc_ids, "<i8").tobytes() + np.array(self.nulls, "u1").tobytes()
                                  + np.array(self.lengths, "<u8").tobytes())
        self.stream.write(index + struct.pack("<Q", len(index)) + MAGIC)


def read_documents(uri: str) -> Iterator[tuple[int | None, int, np.ndarray]]:
    """(doc_id, ids of the file's documents before it, ids) in file order, holding one block and one document."""
    fs, path = file_system(uri)
    unzip = zstandard.ZstdDecompressor()
    with fs.open_input_file(path) as f:
        size = f.size()
        tail = f.read_at(12, size - 12)
        (length,), end = struct.unpack("<Q", tail[:8]), tail[8:]
        head = f.read_at(9, 0)
        if head[:4] != MAGIC or end != MAGIC:
            raise ValueError(f"{uri} isn't a token file")
        bits, _ = struct.unpack("<BI", head[4:])
        index = unzip.decompress(f.read_at(length, size - 12 - length))
        n_blocks, n_docs = struct.unpack_from("<QQ", index)
        at, width = 16, 33 if bits else 5
        blocks = np.frombuffer(index, "<u4", n_blocks * width, at).reshape(-1, width)
        at += blocks.nbytes
        doc_ids = np.frombuffer(index, "<i8", n_docs, at)
        nulls = np.frombuffer(index, "u1", n_docs, at + 8 * n_docs)
        lengths = np.frombuffer(index, "<u8", n_docs, at + 9 * n_docs).astype(np.int64)
        offset, next_block, start = 9, 0, 0
        held = np.empty(0, "<u4")
        for doc_id, null, n in zip(doc_ids.tolist(), nulls.tolist(), lengths.tolist()):
            got = [held]
            have = len(held)
            while have < n:
                row = blocks[next_block]
                frames = f.read_at(int(row[1:].sum()), offset)
                cuts = np.cumsum(row[1:], dtype=np.int64).tolist()
                planes = [unzip.decompress(frames[a:b]) for a, b in zip([0, *cuts[:-1]], cuts)]
                got.append(from_planes(planes, int(row[0]), bool(bits)))
                have += int(row[0])
                offset += cuts[-1]
                next_block += 1
            flat = np.concatenate(got) if len(got) > 1 else held
            yield (None if null else doc_id), start, flat[:n]
            held, start = flat[n:], start + n


def encoder(spec: str) -> WordTable:
    """The tokenizers library behind a table of words between single spaces, which byte-level tokenizers
    encode independently of each other."""
    take_over("tokenbin", _encoders)
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _encoders:
        from tokenizers import Tokenizer
        tokenizer = Tokenizer.from_str(spec)
        tokenizer.no_truncation()
        tokenizer.no_padding()
        _encoders.clear()

        def fill(words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
            ids = [e.ids for e in tokenizer.encode_batch_fast(words, add_special_tokens=False)]
            sizes = np.fromiter(map(len, ids), np.int64, len(ids))
            return sizes, [np.fromiter(chain.from_iterable(ids), np.int32, int(sizes.sum()))]

        _encoders[key] = WordTable(fill, 1, ENTRIES)
    return _encoders[key]


def cut_words(texts: list[str]) -> tuple[np.ndarray, pa.Array]:
    """All texts' words in a row, and where each text's words begin and end. A text is cut where byte-level
    patterns always cut, and before every single space unless it has spaces that follow each other, as a run
    of white space is one piece. All these places are beside ASCII characters, so bytes show them."""
    joined = pa.array(texts, pa.string())
    ends, data = joined.buffers()[1:]
    ends = np.frombuffer(ends, np.int32, len(texts) + 1)
    raw = np.frombuffer(data, np.uint8, ends[-1]) if ends[-1] else np.zeros(0, np.uint8)
    cut, space, letter = np.zeros(len(raw) + 1, bool), raw == ord(" "), LETTER[raw]
    cut[:-1] = space
    twice = np.flatnonzero(space[1:] & space[:-1])
    text = np.searchsorted(ends, twice, "right") - 1
    for i in np.unique(text[twice + 1 < ends[text + 1]]):
        cut[ends[i]:ends[i + 1]] = False
    cut[1:-1] |= letter[:-1] & MARK[raw[1:]]
    cut[2:-1] |= ((raw > 32) & (raw < 127))[:-2] & (raw == ord("\n"))[1:-1] & letter[2:]
    cut[ends] = True
    starts = np.flatnonzero(cut[:-1])
    words = pa.StringArray.from_buffers(len(starts), pa.py_buffer(np.append(starts, len(raw)).astype(np.int32)), pa.py_buffer(raw))
    return np.searchsorted(starts, ends), words


def encode_texts(spec: str, texts: list[str]) -> list[np.ndarray]:
    """Ids of each text (uint32)."""
    places, words = cut_words(texts)
    sizes, (ids,) = encoder(spec).look_up(words)
    bounds = np.concatenate([[0], np.cumsum(sizes)])[places].tolist()
    ids = ids.view(np.uint32)
    return [ids[a:b] for a, b in zip(bounds, bounds[1:])]


def write_tokens(df: DataFrame, tokenizer_path: str, folder: str, ident: str = "doc_id", text: str = "text",
                 end_id: int = 0, bits: bool = False, block: int = BLOCK) -> DataFrame:
    """Encode, write the files below `folder` and return the manifest: file, n_docs, n_tokens, lowest key."""
    spark = df.sparkSession
    with open(tokenizer_path, encoding="utf-8") as f:      # a vocabulary file of the driver, a few MB
        spec = spark.sparkContext.broadcast(f.read())
    end = np.uint32(end_id)

    def run(batches):
        import os
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        writer = close = low = None
        tokens = docs = 0
        for batch in batches:
            for part in slices(batch, "t"):
                found = encode_texts(spec.value, [t or "" for t in part.column("t").to_pylist()])
                for doc_id, h, ids in zip(part.column("id").to_pylist(), part.column("h").to_pylist(), found):
                    if writer is None:
                        stream, close = write_file(f"{folder}/ids-{uuid.uuid4().hex}.pwtp")
                        writer, low = Writer(stream, bits, block), (doc_id, h)
                    writer.add(doc_id, np.append(ids, end))
                    docs += 1
                    tokens += len(ids) + 1
        if writer is not None:
            writer.finish()
            yield pa.RecordBatch.from_pylist([{"file": close(), "n_docs": docs, "n_tokens": tokens, "low_id": low[0], "low_hash": low[1]}])

    dealt = (df.select(F.col(ident).cast("long").alias("id"), F.xxhash64(F.col(text)).alias("h"), F.col(text).alias("t"))
             .repartitionByRange("id", "h").sortWithinPartitions("id", "h"))
    schema = "file string, n_docs long, n_tokens long, low_id long, low_hash long"
    dealt.mapInArrow(run, schema).write.parquet(f"{folder}/manifest")
    return spark.read.schema(schema).parquet(f"{folder}/manifest")


def read_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Every document of the files a manifest names: doc_id, start (over all files), n_tokens, ids (uint32)."""
    manifest = spark.read.parquet(f"{folder}/manifest")
    # one row per file: the running total over all files is small
    before = Window.orderBy(F.col("low_id").asc_nulls_first(), "low_hash", "file").rowsBetween(Window.unboundedPreceding, -1)
    files = manifest.select("file", F.coalesce(F.sum("n_tokens").over(before), F.lit(0)).alias("before"))

    def run(batches):
        for batch in batches:
            for uri, before in zip(batch.column("file").to_pylist(), batch.column("before").to_pylist()):
                rows, held = [], 0
                for doc_id, start, ids in read_documents(uri):
                    rows.append((doc_id, before + start, len(ids), ids.tobytes()))
                    held += ids.nbytes
                    if held >= 8 << 20:
                        yield rows_batch(rows)
                        rows, held = [], 0
                if rows:
                    yield rows_batch(rows)

    schema = "doc_id long, start long, n_tokens long, ids binary"
    return files.repartition(max(1, manifest.count()), "file").mapInArrow(run, schema)


def rows_batch(rows: list[tuple]) -> pa.RecordBatch:
    doc_id, start, n, ids = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(doc_id, pa.int64()), pa.array(start, pa.int64()), pa.array(n, pa.int64()),
                                       pa.array(ids, pa.binary())], names=["doc_id", "start", "n_tokens", "ids"])


def token_files(df: DataFrame, tokenizer_path: str, **options) -> DataFrame:
    """Write the files to a new folder of the shared checkpoint folder, then read them back."""
    folder = new_folder(df.sparkSession, "token-files")
    write_tokens(df, tokenizer_path, folder, **options)
    return read_tokens(df.sparkSession, folder)


def ids_crc32(ids: str = "ids"):
    """Unsigned CRC-32 of the ids' bytes, as a column."""
    return F.crc32(F.col(ids))
