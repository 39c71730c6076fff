"""Byte-level BPE encoding and decoding with a segment tree over adjacent pair ranks.

Leaf i of the tree holds the rank of the pair that starts at symbol i; the root is the leftmost pair of
lowest rank. A merge changes three leaves, so a piece of n bytes costs O(n log n), whatever its length.
Texts are cut into pieces by the tokenizer's own pattern; pieces repeat, so each worker keeps a bounded
cache of encoded pieces. Nothing is shuffled.

Null text counts as empty. An empty text has no ids and decodes to the empty text. Every other column
passes through; columns named like an output are replaced. Repeated rows are encoded alike.
"""
from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from paywarden.llm.common import ChunkCache, add_columns, take_over, word_chunks

#: Fixed value: how byte-level tokenizers cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Letters and numbers newer than Unicode 16, which byte-level tokenizers still treat as symbols.
LATE = (r"\u0558\u058b-\u058c\u088f\u0c5c\u0cdc\u208f\u209d-\u209f\ua7ce-\ua7cf\ua7d2\ua7d4\ua7dd\ua7e2\ua7f1\uab6c-\uab6d"
        r"\U000107bb-\U000107bf\U00010940-\U00010959\U00010ec5-\U00010ec7\U00010ed9-\U00010eee\U00011b0a\U00011db0-\U00011ddb"
        r"\U00011de0-\U00011de9\U00011df1\U0001246f\U00012475-\U0001247f\U00012550-\U00012686\U00016ea0-\U00016eb8"
        r"\U00016ebb-\U00016ed3\U00016ff2-\U00016ff6\U000187f8-\U000187ff\U00018cd6-\U00018cda\U00018d09-\U00018d20"
        r"\U00018d80-\U00018df2\U00018e00-\U00019191\U000191a0-\U000191d2\U0001b123-\U0001b128\U0001b168\U0001d6a6"
        r"\U0001df1f-\U0001df24\U0001df2b-\U0001df81\U0001df90-\U0001df96\U0001dfcd-\U0001dfff\U0001e6c0-\U0001e6de"
        r"\U0001e6e0-\U0001e6e2\U0001e6e4-\U0001e6e5\U0001e6e7-\U0001e6ed\U0001e6f0-\U0001e6f4\U0001e6fe-\U0001e6ff"
        r"\U0002b73a-\U0002b73f\U0002b81e\U0002cea2-\U0002cead\U000323b0-\U00033479\U0003d000-\U0003fc3f")
NONE = 1 << 62


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary file."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one vocabulary file (JSON text)."""

    def __init__(self, spec: str):
        d = json.loads(spec)
        alphabet, vocab = byte_alphabet(), d["model"]["vocab"]
        self.special = {t["content"]: t["id"] for t in d["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.byte_id = [0] * 256
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.bytes_of = [b""] * size
        for token, i in vocab.items():
            self.bytes_of[i] = bytes(alphabet[c] for c in token)
            if len(token) == 1:
                self.byte_id[alphabet[token]] = i
        for token, i in self.special.items():
            self.bytes_of[i] = token.encode()
        self.pairs = {}
        for rank, pair in enumerate(d["model"]["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.pairs.setdefault(vocab[a] << 32 | vocab[b], (rank, vocab[a + b]))
        keys = np.array(list(self.pairs), np.int64)
        order = np.argsort(keys)
        self.keys = keys[order]
        self.ranks, self.merged = np.array(list(self.pairs.values()), np.int64)[order].T
        self.pattern = regex.compile(PATTERN)
        self.late = regex.compile(f"[{LATE}]")
        self.strict = regex.compile(PATTERN.replace(r"[^\s\p{L}\p{N}]", rf"[[^\s\p{{L}}\p{{N}}]||[{LATE}]]")
                                    .replace(r" ?\p{L}+", rf" ?[\p{{L}}--[{LATE}]]+").replace(r" ?\p{N}+", rf" ?[\p{{N}}--[{LATE}]]+"), regex.V1)
        self.id_of_byte = np.array(self.byte_id, np.int64)
        self.cache = ChunkCache(self.chunks, self.encode_chunks, 150_000)

    def pieces(self, text: str) -> list[str]:
        return (self.pattern if text.isascii() or not self.late.search(text) else self.strict).findall(text)

    def merge(self, ids: list[int]) -> list[int]:
        """All merges of one piece, lowest rank first, leftmost among equals."""
        n = len(ids)
        if n < 2:
            return ids
        pairs, width = self.pairs, 1 << (n - 2).bit_length() if n > 2 else 1
        tree = [NONE] * (2 * width)
        for i in range(n - 1):
            found = pairs.get(ids[i] << 32 | ids[i + 1])
            if found:
                tree[width + i] = found[0] << 32 | i
        for i in range(width - 1, 0, -1):
            a, b = tree[2 * i], tree[2 * i + 1]
            tree[i] = a if a < b else b
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))

        def put(i: int, value: int) -> None:
            i += width
            tree[i] = value
            while i > 1:
                i >>= 1
                a, b = tree[2 * i], tree[2 * i + 1]
                value = a if a < b else b
                if tree[i] == value:
                    return
                tree[i] = value

        while (best := tree[1]) < NONE:
            i = best & 0xFFFFFFFF
            j = after[i]
            k, h = after[j] if j < n else n, before[i]
            ids[i] = pairs[ids[i] << 32 | ids[j]][1]
            ids[j] = -1
            after[i] = k
            if j < n - 1 or j < width:
                put(j, NONE)
            if k < n:
                before[k] = i
                found = pairs.get(ids[i] << 32 | ids[k])
                put(i, found[0] << 32 | i if found else NONE)
            else:
                put(i, NONE)
            if h >= 0:
                found = pairs.get(ids[h] << 32 | ids[i])
                put(h, found[0] << 32 | h if found else NONE)
        return [x for x in ids if x >= 0]

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rank (NONE where no merge exists) and merged id of pairs."""
        key = a << 32 | b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        hit = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(hit, self.ranks[at], NONE), self.merged[at]

    def merge_many(self, pieces: list[bytes], width: int) -> list[bytes]:
        """`merge` of many pieces of at most `width` bytes at once: one tree per column."""
        n = len(pieces)
        ids = np.full((width + 1, n), -1, np.int64)
        size = np.fromiter(map(len, pieces), np.int64, n)
        flat = self.id_of_byte[np.frombuffer(b"".join(pieces), np.uint8)]
        col = np.repeat(np.arange(n), size)
        row = np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size)
        ids[row, col] = flat
        tree = np.full((2 * width, n), NONE, np.int64)
        rank, _ = self.rank_of(ids[:-1], ids[1:])
        place = np.arange(width)[:, None]
        tree[width:] = np.where(rank < NONE, rank << 32 | place, NONE)
        for i in range(width - 1, 0, -1):
            np.minimum(tree[2 * i], tree[2 * i + 1], out=tree[i])
        after = np.repeat(np.arange(1, width + 2)[:, None], n, 1)
        before = np.repeat(np.arange(-1, width)[:, None], n, 1)
        t, x, nx, pv = tree.ravel(), ids.ravel(), after.ravel(), before.ravel()

        def put(at: np.ndarray, value: np.ndarray, c: np.ndarray) -> None:
            node = at + width
            t[node * n + c] = value
            while width > 1 and node[0] > 1:
                node = node >> 1
                left = 2 * node * n + c
                t[node * n + c] = np.minimum(t[left], t[left + n])

        c = np.flatnonzero(tree[1] < NONE)
        while len(c):
            i = t[n + c] & 0xFFFFFFFF
            j = nx[i * n + c]
            k, h = nx[j * n + c], pv[i * n + c]
            _, new = self.rank_of(x[i * n + c], x[j * n + c])
            x[i * n + c], x[j * n + c], nx[i * n + c] = new, -1, k
            inside = j < width
            put(j[inside], np.full(inside.sum(), NONE), c[inside])
            pv[np.minimum(k, width) * n + c] = i
            rank, _ = self.rank_of(new, x[np.minimum(k, width) * n + c])
            put(i, np.where((rank < NONE) & (k <= width), rank << 32 | i, NONE), c)
            has = h >= 0
            hc, hh = c[has], h[has]
            rank, _ = self.rank_of(x[hh * n + hc], new[has])
            if len(hc):
                put(hh, np.where(rank < NONE, rank << 32 | hh, NONE), hc)
            c = c[t[n + c] < NONE]
        alive = ids.T >= 0
        ends = np.cumsum(alive.sum(1)) * 4
        packed = ids.T[alive].astype("<u4").tobytes()
        return [packed[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_pieces(self, pieces: list[str]) -> dict[str, bytes]:
        """Pieces of similar length are merged together; a long piece is merged alone."""
        raw = [p.encode() for p in pieces]
        groups: dict[int, list[int]] = {}
        for i, r in enumerate(raw):
            groups.setdefault(1 << max(1, (len(r) - 1).bit_length()), []).append(i)
        out = {}
        for width, members in groups.items():
            if width > 64:
                done = [np.array(self.merge([self.byte_id[b] for b in raw[i]]), "<u4").tobytes() for i in members]
            else:
                done = self.merge_many([raw[i] for i in members], width)
            out.update(zip([pieces[i] for i in members], done))
        return out

    def chunks(self, text: str) -> list[str]:
        if self.cut is None or not self.cut.search(text):
            return word_chunks(text) or self.pieces(text)
        return [c for p in self.cut.split(text) if p
                for c in ([p] if p in self.special else word_chunks(p) or self.pieces(p))]

    def encode_chunks(self, chunks: list[str]) -> dict[str, bytes]:
        """Special tokens have their id; a chunk of several pieces is the ids of its pieces joined."""
        out, whole, cut = {}, [], {}
        for c in chunks:
            if c in self.special:
                out[c] = np.array([self.special[c]], "<u4").tobytes()
                continue
            pieces = self.pieces(c)
            if len(pieces) == 1:
                whole.append(c)
            else:
                cut[c] = pieces
        out.update(self.encode_pieces(whole))
        cache = self.cache.young
        found = self.encode_pieces(list(set().union(*cut.values()).difference(cache)))
        for c, pieces in cut.items():
            out[c] = b"".join([found[p] if p in found else cache[p] for p in pieces])
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian uint32; a special token's own text becomes its id."""
        return self.cache.encode(texts)

    def decode(self, ids: bytes) -> str:
        """The bytes of all ids joined; what isn't UTF-8 becomes U+FFFD."""
        return b"".join(map(self.bytes_of.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


_codecs: dict[str, Codec] = {}


def codec(spec: str) -> Codec:
    """The codec of a worker process, built once."""
    take_over("bpe", _codecs)
    key = hashlib.md5(spec.encode()).hexdigest()
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(spec)
    return _codecs[key]


def encode_decode(df: DataFrame, tokenizer_path: str, text: str = "text", ids: str = "token_ids",
                  decoded: str = "decoded") -> DataFrame:
    """Add `ids` (binary, little-endian uint32) and `decoded` (the text the ids give back)."""
    with open(tokenizer_path, encoding="utf-8") as f:      # a vocabulary file of the driver, a few MB
        spec = df.sparkSession.sparkContext.broadcast(f.read())

    def make(texts: list) -> list[pa.Array]:
        own = codec(spec.value)
        encoded = own.encode([t or "" for t in texts])
        return [pa.array(encoded, pa.binary()), pa.array([own.decode(x) for x in encoded], pa.string())]

    return add_columns(df, text, [T.StructField(ids, T.BinaryType()), T.StructField(decoded, T.StringType())], make)
