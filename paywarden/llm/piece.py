"""SentencePiece BPE encoding with byte offsets into the original text, and decoding.

A text is first normalised: at each place the longest prefix that the model's compiled character map knows
is replaced, any other character stays, and spaces become the visible mark U+2581. The normaliser records,
for every byte it writes, the byte of the original it comes from; the end of the text closes the record.
Each piece covers a run of normalised bytes, so the record projects it to a span of the original. Merging
joins the adjacent symbols whose joint piece scores highest, the leftmost first. Where no piece of the
vocabulary holds the mark behind another character, a text falls into words before its runs of marks, and
each distinct word of a batch is merged once.

Null text counts as empty; an empty text has no pieces and decodes to the empty text. Text of any length is
encoded whole. Repeated rows are encoded alike, ties in score go to the left. An empty table gives an empty
table. Every other column passes through; columns named like an output are replaced. Nothing is shuffled.
"""
from __future__ import annotations

import hashlib
import heapq
import re
import struct

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.llm.common import WordTable, add_columns, gather, take_over

#: Fixed values of the model format: the mark that stands for a space, and what an unknown piece decodes to.
MARK = "▁"
UNKNOWN_SURFACE = " ⁇ "
#: Fixed values of the model format: kinds of pieces.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
SLICE_BYTES = 4 << 20
ENTRIES = 800_000               # words a worker keeps
NO_PIECE, RARE = float("-inf"), 1 << 40
SHORT = 24                      # symbols up to which scanning for the best pair beats a heap


def message(data: bytes) -> dict[int, list]:
    """Fields of a protocol-buffer message: numbers, or raw bytes, by field number."""
    found: dict[int, list] = {}
    at = 0

    def number() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    while at < len(data):
        key = number()
        kind = key & 7
        if kind == 0:
            value = number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            value, at = data[at:at + size], at + size
        found.setdefault(key >> 3, []).append(value)
    return found


class CharMap:
    """The compiled character map: a double-array trie of prefixes, and the texts that replace them."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size:]
        #: bytes that some prefix begins with; at all others a character stays as it is
        self.first = frozenset(b for b in range(256) if self.units and self.child(self.child_base(0, self.units[0]), b) is not None)

    def child_base(self, node: int, unit: int) -> int:
        return node ^ ((unit >> 10) << ((unit & 512) >> 6))

    def child(self, base: int, byte: int) -> int | None:
        node = base ^ byte
        return node if node < len(self.units) and self.units[node] & 0x800000FF == byte else None

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """Length and replacement of the longest prefix known at a place."""
        found = None
        base = self.child_base(0, self.units[0])
        for i in range(at, len(data)):
            node = self.child(base, data[i])
            if node is None:
                break
            unit = self.units[node]
            base = self.child_base(node, unit)
            if unit >> 8 & 1:
                found = (i + 1 - at, self.units[base] & 0x7FFFFFFF)
        if found is None:
            return None
        start = found[1]
        return found[0], self.texts[start:self.texts.index(b"\0", start)]


class Pieces:
    """A model: normalising, merging, decoding."""

    def __init__(self, model: bytes):
        fields = message(model)
        trainer, normal = message(fields[2][0]), message(fields[3][0])
        if trainer.get(3, [1])[-1] != 2:
            raise ValueError("the model isn't a BPE model")
        if trainer.get(24, [0])[-1]:
            raise ValueError("models with marks behind words aren't supported")
        rows = [message(p) for p in fields[1]]
        self.piece = [r[1][0].decode() for r in rows]
        self.kind = [r.get(3, [NORMAL])[-1] for r in rows]
        score = [struct.unpack("<f", r.get(2, [b"\0\0\0\0"])[-1])[0] for r in rows]
        self.unknown = self.kind.index(UNKNOWN)
        self.byte_fallback = bool(trainer.get(35, [0])[-1])
        self.dummy = bool(normal.get(3, [1])[-1])
        self.squeeze = bool(normal.get(4, [1])[-1])
        self.mark = MARK if normal.get(5, [1])[-1] else " "
        self.map = CharMap(normal.get(2, [b""])[-1])
        self.unknown_surface = trainer[44][-1].decode() if 44 in trainer else UNKNOWN_SURFACE
        self.id = {p: i for i, p in enumerate(self.piece) if self.kind[i] in (NORMAL, USER_DEFINED, UNUSED)}
        self.score = {p: score[i] for p, i in self.id.items()}
        self.unused = {p for p, i in self.id.items() if self.kind[i] == UNUSED}
        self.byte_id = {int(p[3:5], 16): i for i, p in enumerate(self.piece) if self.kind[i] == BYTE}
        own = sorted((p for p in self.id if self.kind[self.id[p]] == USER_DEFINED), key=len, reverse=True)
        self.own = frozenset(own)
        self.own_pattern = re.compile("|".join(map(re.escape, own))) if own else None
        self.by_word = (self.mark == MARK and not own and not any(MARK in p.lstrip(MARK) for p in self.id))
        plain = not self.map.units and not own and not self.squeeze and self.mark == MARK
        self.normalise = self.plain if plain else self.general
        #: what an id decodes to: text as bytes, with spaces for marks; None for a byte piece
        self.surface = [b"" if k == CONTROL else self.unknown_surface.encode() if k == UNKNOWN
                        else p.replace(MARK, " ").encode() for p, k in zip(self.piece, self.kind)]
        self.width = [len(p.encode()) for p in self.piece]
        self.widths = np.array(self.width)
        self.raw = {i: bytes([b]) for b, i in self.byte_id.items()}
        self.decoded = [self.raw.get(i, s) for i, s in enumerate(self.surface)]
        self.words = WordTable(self.merge_all, 2, ENTRIES)
        self.pairs()

    def plain(self, text: str) -> tuple[str, np.ndarray]:
        """The usual case: spaces become marks, all else stays."""
        if not text:
            return "", np.zeros(1, np.int32)
        data = np.frombuffer(text.encode(), np.uint8)
        sizes = np.where(data == 32, 3, 1)
        source = np.repeat(np.arange(len(data), dtype=np.int32), sizes)
        out = text.replace(" ", MARK)
        lead = np.zeros(3 if self.dummy else 0, np.int32)
        return (MARK + out if self.dummy else out), np.concatenate([lead, source, np.array([len(data)], np.int32)])

    def parts(self, data: bytes):
        """(start, end, replacement) along the text, each the longest prefix known at its place."""
        at, first = 0, self.map.first
        while at < len(data):
            own = self.own_pattern.match(data[at:at + 1024].decode("utf-8", "ignore")) if self.own_pattern else None
            if own:
                size, new = len(own[0].encode()), own[0].encode()
                yield at, at + size, new
                at += size
                continue
            found = self.map.longest(data, at) if data[at] in first else None
            if found is None:
                lead = data[at]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                found = (size, data[at:at + size])
            yield at, at + found[0], found[1]
            at += found[0]

    def general(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text, and for each of its bytes the byte of the original it comes from."""
        data = text.encode()
        mark = self.mark.encode()
        out: list[bytes] = []
        source: list[int] = []
        # where white space is squeezed, a text counts as if a space stood before it
        after_space, begun = self.squeeze, False
        for start, end, new in self.parts(data):
            if not begun:
                if self.squeeze and new == b" ":
                    continue
                begun = True
                if self.dummy:
                    out.append(mark)
                    source += [start] * len(mark)
            if after_space:
                new = new.lstrip(b" ")
            if not new:
                continue
            after_space = self.squeeze and new.endswith(b" ")
            new = new.replace(b" ", mark)
            out.append(new)
            source += [start] * len(new)
        done = b"".join(out)
        stop = len(data)
        if self.squeeze:
            while done.endswith(mark):
                done = done[:-len(mark)]
                stop = source[len(done)]
                del source[len(done):]
        return done.decode(), np.array([*source, stop], np.int32)

    def symbols(self, word: str) -> list[str]:
        if not self.own_pattern:
            return list(word)
        out, at = [], 0
        for m in self.own_pattern.finditer(word):
            out += [*word[at:m.start()], m[0]]
            at = m.end()
        return out + list(word[at:])

    def merged(self, symbols: list[str]) -> tuple[list[str], dict[str, tuple[str, str]]]:
        """The symbols left when no neighbours form a piece; and which two made each unused piece."""
        score, own, unused, made = self.score.get, self.own, self.unused, {}
        if own:
            def rank(a: str, b: str) -> float:
                return NO_PIECE if a in own or b in own else score(a + b, NO_PIECE)
        else:
            def rank(a: str, b: str) -> float:
                return score(a + b, NO_PIECE)

        if len(symbols) <= SHORT:
            ranks = list(map(rank, symbols, symbols[1:]))
            while ranks and (best := max(ranks)) > NO_PIECE:
                at = ranks.index(best)          # the leftmost
                joint = symbols[at] + symbols[at + 1]
                if joint in unused:
                    made[joint] = (symbols[at], symbols[at + 1])
                symbols[at:at + 2] = [joint]
                del ranks[at]
                if at < len(ranks):
                    ranks[at] = rank(joint, symbols[at + 1])
                if at:
                    ranks[at - 1] = rank(symbols[at - 1], joint)
            return symbols, made
        n = len(symbols)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        heap = [(-r, i, symbols[i] + symbols[i + 1]) for i in range(n - 1) if (r := rank(symbols[i], symbols[i + 1])) > NO_PIECE]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, joint = heapq.heappop(heap)
            j = right[i]
            if not alive[i] or j < 0 or len(symbols[i]) + len(symbols[j]) != len(joint):
                continue                # one of the two has merged elsewhere since
            if joint in unused:
                made[joint] = (symbols[i], symbols[j])
            symbols[i], alive[j], right[i] = joint, False, right[j]
            if right[i] >= 0:
                left[right[i]] = i
                if (r := rank(joint, symbols[right[i]])) > NO_PIECE:
                    heapq.heappush(heap, (-r, i, joint + symbols[right[i]]))
            if left[i] >= 0 and (r := rank(symbols[left[i]], joint)) > NO_PIECE:
                heapq.heappush(heap, (-r, left[i], symbols[left[i]] + joint))
        return [s for s, here in zip(symbols, alive) if here], made

    def merge(self, word: str) -> tuple[list[int], list[int]]:
        """Ids of a normalised word, and how many of its bytes each covers."""
        symbols, made = self.merged(self.symbols(word))
        ids = list(map(self.id.get, symbols))
        if not made and None not in ids:
            return ids, list(map(self.width.__getitem__, ids))
        ids, sizes, stack = [], [], symbols[::-1]
        while stack:
            s = stack.pop()
            if s in made:
                a, b = made[s]
                stack += [b, a]
                continue
            data = s.encode()
            own = self.id.get(s)
            if own is not None:
                ids.append(own)
                sizes.append(len(data))
            elif self.byte_fallback:
                # the last byte's piece covers the character
                ids += [self.byte_id[b] for b in data]
                sizes += [0] * (len(data) - 1) + [len(data)]
            elif ids and ids[-1] == self.unknown:
                sizes[-1] += len(data)
            else:
                ids.append(self.unknown)
                sizes.append(len(data))
        return ids, sizes

    def pairs(self) -> None:
        """Tables for merging many words at once: which pairs of pieces form a piece, and its rank by score
        (equal scores share a rank)."""
        levels = {x: i for i, x in enumerate(sorted(set(self.score.values()), reverse=True))}
        found = sorted((self.id[p[:i]] << 32 | self.id[p[i:]], levels[self.score[p]], self.id[p])
                       for p in self.id for i in range(1, len(p)) if p[:i] in self.id and p[i:] in self.id)
        self.keys, self.ranks, self.joint = np.array([(-1, RARE, 0), *found], np.int64).T.copy()
        self.char_id = np.full(0x110000, -1, np.int32)
        for p, i in self.id.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i

    def rank_of(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = a.astype(np.int64) << 32 | b
        at = np.searchsorted(self.keys, key, "right") - 1
        known = (self.keys[at] == key) & (a >= 0) & (b >= 0)
        return np.where(known, self.ranks[at], RARE), self.joint[at]

    def merge_many(self, codes: np.ndarray) -> np.ndarray:
        """Words as rows of pieces, -1 behind their end; all rows take a merge a round until none has one left."""
        n, width = codes.shape
        out = np.full((n, width), -1, np.int64)
        rows = np.arange(n)
        s = np.hstack([codes, np.full((n, 2), -1)])
        r, j = (np.hstack([x, np.full((n, 2), fill)]) for x, fill in zip(self.rank_of(codes[:, :-1], codes[:, 1:]), (RARE, 0)))
        columns = np.arange(width)
        while len(rows):
            at = r[:, :width].argmin(1)
            here = np.arange(len(rows))
            going = r[here, at] < RARE
            if not going.all():
                out[rows[~going]] = s[~going, :width]
                rows, s, r, j, at = rows[going], s[going], r[going], j[going], at[going]
                here = np.arange(len(rows))
            if not len(rows):
                break
            new = j[here, at]
            later = columns[None, :] + (columns[None, :] > at[:, None])
            s[:, :width], sooner = np.take_along_axis(s, later, 1), columns[None, :] + (columns[None, :] >= at[:, None])
            r[:, :width], j[:, :width] = np.take_along_axis(r, sooner, 1), np.take_along_axis(j, sooner, 1)
            s[here, at] = new
            r[here, at], j[here, at] = self.rank_of(new, s[here, at + 1])
            before = at > 0
            h, b = here[before], at[before] - 1
            r[h, b], j[h, b] = self.rank_of(s[h, b], new[before])
        return out

    def merge_all(self, words: list[str]) -> tuple[np.ndarray, list[np.ndarray]]:
        """How many pieces each word has, and all their ids and widths in a row. Words of similar length are merged
        together; long ones, those with characters that aren't pieces, and all words of models with unused or
        user-defined pieces, one by one."""
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        chars = self.char_id[np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)]
        starts = np.cumsum(lengths) - lengths
        plain = (lengths > 0) & (lengths <= SHORT) & (not self.unused and not self.own)
        if len(chars):
            unknown = np.concatenate([[0], np.cumsum(chars < 0)])
            plain &= unknown[starts + lengths] == unknown[starts]
        ids: list[np.ndarray] = []
        widths: list[np.ndarray] = []
        sizes, order = [], []
        for low, high in ((0, 6), (6, 12), (12, SHORT)):
            chosen = np.flatnonzero(plain & (lengths > low) & (lengths <= high))
            for i in range(0, len(chosen), 8192):
                some = chosen[i:i + 8192]
                place = np.arange(high)[None, :]
                there = place < lengths[some][:, None]
                codes = np.where(there, chars[np.minimum(starts[some][:, None] + place, len(chars) - 1)], -1).astype(np.int64)
                done = self.merge_many(codes)
                left = done >= 0
                order.append(some)
                sizes.append(left.sum(1))
                ids.append(done[left])
                widths.append(self.widths[done[left]])
        for i in np.flatnonzero(~plain).tolist():
            own, wide = self.merge(words[i])
            order.append(np.array([i]))
            sizes.append(np.array([len(own)]))
            ids.append(np.array(own, np.int64))
            widths.append(np.array(wide, np.int64))
        if not words:
            return lengths, [np.zeros(0, np.int32)] * 2
        order, sizes = np.concatenate(order), np.concatenate(sizes)
        first, back = np.cumsum(sizes) - sizes, np.argsort(order)
        return sizes[back], [gather(np.concatenate(x), first[back], sizes[back]).astype(np.int32) for x in (ids, widths)]

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Offsets of the texts' pieces, and each piece's id, begin and end byte in the original."""
        normal = [self.normalise(t) for t in texts]
        if self.by_word:
            words = pc.split_pattern(pa.array([self.spaced(t) for t, _ in normal], pa.string()), " ")
            flat, bounds = words.flatten(), words.offsets.to_numpy()
            sizes, (ids, covers) = self.words.look_up(flat)
        else:
            done = [self.merge(t) for t, _ in normal]
            sizes, bounds = np.array([len(d[0]) for d in done], np.int64), np.arange(len(done) + 1)
            ids, covers = (np.array([x for d in done for x in d[i]], np.int32) for i in (0, 1))
        offsets = np.concatenate([[0], np.cumsum(sizes)])[bounds]
        # all records of alignment one after the other; a piece's end is the next one's begin
        lengths = np.array([len(a) for _, a in normal], np.int64)
        source = np.concatenate([a for _, a in normal]) if normal else np.zeros(0, np.int32)
        ends = np.cumsum(covers, dtype=np.int64)
        shift = np.repeat(np.cumsum(lengths) - lengths - np.concatenate([[0], ends])[offsets[:-1]], np.diff(offsets))
        return offsets.astype(np.int32), ids, source[ends - covers + shift], source[ends + shift]

    def spaced(self, normal: str) -> str:
        """A space before each run of marks, but not at the begin; normalised text has no spaces of its own."""
        out = normal.replace(MARK, " " + MARK)
        if MARK + " " in out:
            twice = MARK + " " + MARK
            while twice in out:
                out = out.replace(twice, MARK + MARK)
        return out[1:] if out.startswith(" ") else out

    def decode(self, ids: list[int]) -> str:
        """The text of ids; a space that normalising put first goes, broken bytes become U+FFFD."""
        drop = self.dummy or self.squeeze
        parts = [self.decoded[i] for i in ids]
        for k, i in enumerate(ids) if drop else ():
            if i in self.raw:
                break
            if parts[k]:
                if parts[k].startswith(b" ") and self.kind[i] != UNKNOWN:
                    parts[k] = parts[k][1:]
                    if self.squeeze and not parts[k]:
                        continue
                break
        try:
            return b"".join(parts).decode()
        except UnicodeDecodeError:
            return self.mended(ids, parts)

    def mended(self, ids: list[int], parts: list[bytes]) -> str:
        out, run = [], b""
        for i, p in zip([*ids, None], [*parts, b""]):
            if i in self.raw:
                run += p
                continue
            while run:
                size = next((n for n in range(1, 5) if valid(run[:n])), 0)
                out.append(run[:size].decode() if size else "�")
                run = run[max(1, size):]
            out.append(p.decode())
        return "".join(out)


def valid(data: bytes) -> bool:
    try:
        return len(data.decode()) == 1
    except UnicodeDecodeError:
        return False


_models: dict[str, Pieces] = {}


def pieces(model: bytes) -> Pieces:
    """The model of a worker process, built once."""
    take_over("piece", _models)
    key = hashlib.md5(model).hexdigest()
    if key not in _models:
        _models.clear()
        _models[key] = Pieces(model)
    return _models[key]


def encode(df: DataFrame, model_path: str, text: str = "text", ids: str = "piece_ids", begins: str = "piece_begins",
           ends: str = "piece_ends", decoded: str | None = None) -> DataFrame:
    """Add the ids of each text's pieces, the span of original UTF-8 bytes each comes from, and, where a
    name is given, the text that the ids decode to."""
    with open(model_path, "rb") as f:               # a vocabulary file of the driver, half a MB
        model = df.sparkSession.sparkContext.broadcast(f.read())

    def make(texts: list) -> list[pa.Array]:
        own = pieces(model.value)
        offsets, *columns = own.encode([t or "" for t in texts])
        lists = [pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(c, pa.int32())) for c in columns]
        if decoded is None:
            return lists
        flat = columns[0].tolist()
        bounds = offsets.tolist()
        return [*lists, pa.array([own.decode(flat[a:b]) for a, b in zip(bounds, bounds[1:])], pa.string())]

    fields = [T.StructField(n, T.ArrayType(T.IntegerType())) for n in (ids, begins, ends)]
    return add_columns(df, text, fields + ([T.StructField(decoded, T.StringType())] if decoded else []), make, SLICE_BYTES)


def decode(df: DataFrame, model_path: str, ids: str = "piece_ids", decoded: str = "decoded") -> DataFrame:
    """Add the text of a column of id lists; a null list is empty."""
    with open(model_path, "rb") as f:
        model = df.sparkSession.sparkContext.broadcast(f.read())
    kept = df.drop(decoded) if decoded != ids else df
    schema = T.StructType([*kept.schema.fields, T.StructField(decoded, T.StringType())])

    def run(batches):
        for batch in batches:
            texts = [pieces(model.value).decode(x or []) for x in batch.column(ids).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, decoded])

    return kept.mapInArrow(run, schema)


def ids_sha256(ids: str = "piece_ids"):
    """Digest of an id list as decimal numbers joined by commas."""
    return F.sha2(F.concat_ws(",", F.col(ids).cast("array<string>")), 256)
