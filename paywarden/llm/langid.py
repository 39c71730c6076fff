"""Language identification with interpolated Kneser-Ney character models.

Training counts character 4-grams of all labelled documents: each task counts its own texts, Spark sums the
counts per (language, gram). The lower orders of a Kneser-Ney model are continuation counts, that is numbers
of distinct left neighbours, so they follow from the 4-gram table. No gram is left out, so the model grows with
the distinct 4-grams of letters of the languages.

    texts ── 4-gram counts per task ── sum per (lang, gram) ── continuation counts of the lower orders
          ── per language and order: hash and discounted probability of each gram, hash and back-off of each context
          ── sorted by (language, order, hash), written to the shared folder
    text  ── bits per character under each model ── lowest wins ── calibrated rejection

Only a row per language and order (its discount) and the calibration pass through the driver. A worker reads
the sorted arrays from the shared folder when it first scores a text: 16 bytes per gram and per context.

A text is lower-cased; letters stay, every run of other characters is one blank, both ends have a blank.
Rejection: on a hashed sample of about `calibration_docs` distinct labelled texts per language (all, if it has
fewer) each language learns the mean and spread of its own texts' cross-entropy; a text is rejected when it lies more than `reject_z` spreads above.
`score` is the winner's posterior (softmax of -cross-entropy * min(length, 40)) times how far the text is
from rejection.

Null text and texts without a letter are `und` with score 0 and rejected. Ties go to the first language by
name. Rows with null language don't train. Without any training row every text is `und`. Repeated rows count
as often as they occur. A text of any length is scored whole. Other columns pass through; columns named like an output are replaced.
"""
from __future__ import annotations

import hashlib
import pickle
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.fs
import pyarrow.parquet as pq
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.llm.common import add_columns, file_system, new_folder, slices, take_over
from paywarden.session import materialise

ORDER = 4
OUTPUTS = ["lang_pred", "score", "cross_entropy", "rejected"]
MEMO = 20                        # bits of a worker's table of scored grams
SLICE_BYTES = 1 << 20            # text handled at once; its arrays take some eighty times as much
TOP = np.uint64(1 << 63)         # flips the sign, so that signed order is the order of the hashes
_letters: list[np.ndarray] = []


def letters() -> np.ndarray:
    """The 16-bit code of each code point: 0 for what isn't a letter; beyond the basic plane folded."""
    if not _letters:
        table = np.array([chr(i).isalpha() for i in range(0x110000)])
        codes = np.arange(0x110000)
        _letters.append(np.where(table, np.where(codes < 0x10000, codes, 0xE000 | codes & 0xFFF), 0).astype(np.uint64))
    return _letters[0]


def grams(texts: list) -> tuple[np.ndarray, np.ndarray]:
    """4-gram keys of all texts one after the other (oldest character highest) and how many each text has."""
    parts, sizes = [], []
    for t in texts:
        codes = letters()[np.frombuffer((t or "").lower().encode("utf-32-le", "surrogatepass"), "<u4")]
        if len(codes):
            keep = codes != 0
            keep[1:] |= codes[:-1] != 0
            codes = codes[keep]
        if not codes.any():
            sizes.append(0)
            continue
        codes = codes[1:] if codes[0] == 0 else codes
        end = [] if codes[-1] == 0 else [0]
        parts.append(np.concatenate([np.zeros(ORDER - 1, np.uint64), codes, np.array(end, np.uint64)]))
        sizes.append(len(parts[-1]) - (ORDER - 1))
    if not parts:
        return np.empty(0, np.uint64), np.array(sizes, np.int64)
    flat = np.concatenate(parts)
    key = np.zeros(len(flat) - ORDER + 1, np.uint64)
    for i in range(ORDER):
        key = key << np.uint64(16) | flat[i:len(flat) - ORDER + 1 + i]
    whole = np.cumsum([0, *[s + ORDER - 1 for s in sizes if s]])
    inside = np.ones(len(flat), bool)
    for i in range(1, ORDER):
        inside[whole[1:] - i] = False         # windows that reach into the next text
    return key[inside[:len(key)]], np.array(sizes, np.int64)


def mix(key: np.ndarray, order: int) -> np.ndarray:
    """64-bit hash of a gram key of the given order."""
    z = key + np.uint64((0x9E3779B97F4A7C15 * order) & 0xFFFFFFFFFFFFFFFF)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def low(key: np.ndarray, order: int) -> np.ndarray:
    """The last `order` characters of a gram."""
    return key & np.uint64((1 << 16 * order) - 1)


@dataclass
class Model:
    """One language: per order the sorted hashes with discounted probabilities, and contexts with back-off."""
    uniform: float
    probs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)
    backs: list[tuple[np.ndarray, np.ndarray]] = field(default_factory=list)

    def probability(self, key: np.ndarray) -> np.ndarray:
        p = np.full(len(key), self.uniform)
        for order, (gram, back) in enumerate(zip(self.probs, self.backs), 1):
            own = find(gram, mix(low(key, order), order), 0.0)
            rest = find(back, mix(low(key, order) >> np.uint64(16), order - 1), 1.0)
            p = own + rest * p
        return p


def find(table: tuple[np.ndarray, np.ndarray], wanted: np.ndarray, other: float) -> np.ndarray:
    keys, values = table
    if not len(keys):
        return np.full(len(wanted), other)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], other)


class Identifier:
    """Models of all languages, calibration, and a worker's memo of scored grams."""

    def __init__(self, models: dict[str, Model], calibration: dict[str, tuple[float, float, float]] | None = None, reject_z: float = 8.0):
        self.names = sorted(models)
        self.models = [models[n] for n in self.names]
        self.calibration, self.reject_z = calibration or {}, reject_z
        self.memo_key = None

    def bits(self, key: np.ndarray) -> np.ndarray:
        return np.stack([-np.log2(m.probability(key)) for m in self.models], 1).astype(np.float32)

    def gram_bits(self, key: np.ndarray) -> np.ndarray:
        """Bits of every gram under every language, through a table of grams met before."""
        if self.memo_key is None:
            self.memo_key = np.full(1 << MEMO, np.uint64(0xFFFFFFFFFFFFFFFF))
            self.memo_bits = np.zeros((1 << MEMO, len(self.names)), np.float32)
        slot = (mix(key, 9) >> np.uint64(64 - MEMO)).astype(np.int64)
        out = self.memo_bits[slot]
        miss = np.flatnonzero(self.memo_key[slot] != key)
        if len(miss):
            fresh, back = np.unique(key[miss], return_inverse=True)
            bits = self.bits(fresh)
            out[miss] = bits[back]
            slot = (mix(fresh, 9) >> np.uint64(64 - MEMO)).astype(np.int64)
            self.memo_bits[slot] = bits
            self.memo_key[slot] = fresh
        return out

    def cross_entropies(self, texts: list) -> tuple[np.ndarray, np.ndarray]:
        """Bits per character under each language (texts x languages) and lengths; 0 without letters."""
        key, sizes = grams(texts)
        out = np.zeros((len(texts), len(self.names)))
        full = np.flatnonzero(sizes)
        if len(full):
            starts = np.cumsum(sizes[full]) - sizes[full]
            out[full] = np.add.reduceat(self.gram_bits(key), starts, axis=0, dtype=np.float64) / sizes[full][:, None]
        return out, sizes

    def predict(self, texts: list) -> list[tuple[str, float, float | None, bool]]:
        """(language, score, cross-entropy, rejected) per text."""
        if not self.names:
            return [("und", 0.0, None, True)] * len(texts)
        h, sizes = self.cross_entropies(texts)
        out = []
        for row, n in zip(h, sizes.tolist()):
            if not n:
                out.append(("und", 0.0, None, True))
                continue
            best = int(row.argmin())
            posterior = 1.0 / np.exp(-(row - row[best]) * min(n, 40)).sum()
            mean, spread, per_char = self.calibration.get(self.names[best], (float(row[best]), 1.0, 1.0))
            z = (row[best] - mean) / (spread + per_char / n ** 0.5)
            fits = 1.0 / (1.0 + np.exp(min(50.0, z - self.reject_z)))
            out.append((self.names[best], float(posterior * fits), float(row[best]), bool(z > self.reject_z)))
        return out


def gram_counts(df: DataFrame, text: str, lang: str) -> DataFrame:
    """(lang, gram, n): 4-gram counts over all rows, combined per task before the shuffle."""
    schema = "lang string, gram long, n long"

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                texts, langs = part.column("t").to_pylist(), part.column("l").to_pylist()
                for name in sorted(set(langs)):
                    key, _ = grams([t for t, own in zip(texts, langs) if own == name])
                    key.sort()
                    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.empty(0, np.int64)
                    n = np.diff(np.append(first, len(key)))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(first), pa.string()), pa.array(key[first].view(np.int64)),
                                                      pa.array(n, pa.int64())], names=["lang", "gram", "n"])

    rows = df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull()).select(F.col(text).alias("t"), F.col(lang).alias("l"))
    return rows.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def levels_of(counts: DataFrame) -> DataFrame:
    """(lang, level, gram, n): the 4-gram counts, and for each shorter gram how many distinct characters stand
    before it."""
    level = counts.select("lang", "gram", "n")
    out = level.withColumn("level", F.lit(ORDER))
    for order in range(ORDER - 1, 0, -1):
        shorter = F.col("gram").bitwiseAND((1 << 16 * order) - 1)
        level = materialise(level.groupBy("lang", shorter.alias("gram")).agg(F.count(F.lit(1)).alias("n")), f"lang-grams-{order}")
        out = out.unionByName(level.withColumn("level", F.lit(order)))
    return out


def write_model(counts: DataFrame) -> Fitted:
    """The interpolated Kneser-Ney model of (lang, gram, n), one discount per order (n1 / (n1 + 2 n2))."""
    spark = counts.sparkSession
    levels = levels_of(counts).withColumn("context", F.shiftrightunsigned("gram", 16))
    kinds = levels.groupBy("lang", "level").agg(F.count_if(F.col("n") == 1).alias("ones"), F.count_if(F.col("n") == 2).alias("twos"),
                                                F.count(F.lit(1)).alias("size")).collect()      # a row per language and order
    names = sorted({r["lang"] for r in kinds})
    if not names:
        return Fitted()
    rows = []
    for r in kinds:
        ones, twos = r["ones"], r["twos"]
        rows.append((r["lang"], r["level"], (names.index(r["lang"]) * 2) * ORDER + r["level"] - 1,
                     min(0.9, max(0.1, ones / (ones + 2 * twos) if ones + twos else 0.5))))
    known = spark.createDataFrame(rows, "lang string, level int, slot int, discount double")
    contexts = levels.groupBy("lang", "level", "context").agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("kinds"))
    own = (levels.join(contexts.drop("kinds"), ["lang", "level", "context"]).join(F.broadcast(known), ["lang", "level"])
           .select("slot", F.col("level").alias("order"), F.col("gram").alias("key"),
                   (F.greatest(F.col("n") - F.col("discount"), F.lit(0.0)) / F.col("total")).alias("value")))
    back = contexts.join(F.broadcast(known), ["lang", "level"]).select(
        (F.col("slot") + ORDER).alias("slot"), (F.col("level") - 1).alias("order"), F.col("context").alias("key"),
        (F.col("discount") * F.col("kinds") / F.col("total")).alias("value"))

    def hashed(batches):
        for batch in batches:
            key = batch.column("key").to_numpy().view(np.uint64)
            order = batch.column("order").to_numpy()
            h = np.empty(len(key), np.uint64)
            for n in np.unique(order):
                h[order == n] = mix(key[order == n], int(n))
            yield pa.RecordBatch.from_arrays([batch.column("slot"), pa.array((h ^ TOP).view(np.int64)), batch.column("value")], names=["slot", "h", "value"])

    folder = new_folder(spark, "lang-model")
    own.unionByName(back).mapInArrow(hashed, "slot int, h long, value double").orderBy("slot", "h").write.parquet(folder)
    sizes = {r["lang"]: r["size"] for r in kinds if r["level"] == 1}
    return Fitted(names, folder, [1.0 / (sizes[n] + 1) for n in names])


@dataclass
class Fitted:
    """Where the written model of `names` lies, and what the driver knows of it."""
    names: list[str] = field(default_factory=list)
    folder: str = ""
    uniform: list[float] = field(default_factory=list)
    calibration: dict[str, tuple[float, float, float]] = field(default_factory=dict)
    reject_z: float = 8.0

    def load(self) -> Identifier:
        """The sorted arrays, read file by file in their order."""
        if not self.names:
            return Identifier({})
        fs, path = file_system(self.folder)
        files = sorted(f.path for f in fs.get_file_info(pa.fs.FileSelector(path)) if f.path.endswith(".parquet"))
        parts = [pq.read_table(f, filesystem=fs, partitioning=None) for f in files]
        slot, h, value = (np.concatenate([p.column(c).to_numpy() for p in parts]) for c in ("slot", "h", "value"))
        at = np.searchsorted(slot, np.arange(2 * ORDER * len(self.names) + 1))
        h = h.view(np.uint64) ^ TOP
        table = [(h[i:j], value[i:j]) for i, j in zip(at, at[1:])]
        own = [table[i * 2 * ORDER:(i + 1) * 2 * ORDER] for i in range(len(self.names))]
        models = {n: Model(u, t[:ORDER], t[ORDER:]) for n, u, t in zip(self.names, self.uniform, own)}
        return Identifier(models, self.calibration, self.reject_z)


def fit(df: DataFrame, text: str = "text", lang: str = "lang", calibration_docs: int = 2_000, reject_z: float = 8.0) -> Fitted:
    """Count all rows of `df`, write the model, calibrate on about `calibration_docs` distinct texts per
    language, picked by their hash."""
    found = write_model(materialise(gram_counts(df, text, lang), "lang-grams"))
    found.reject_z = reject_z
    if found.names:
        found.calibration = calibrate(df, found, text, lang, calibration_docs)
    return found


def calibrate(df: DataFrame, found: Fitted, text: str, lang: str, docs: int) -> dict[str, tuple[float, float, float]]:
    """Per language: mean and spread of the cross-entropy of its longer texts, and spread per root character."""
    spark, grain = df.sparkSession, 1 << 30
    spec = spark.sparkContext.broadcast(pickle.dumps(found))
    rows = (df.filter(F.col(text).isNotNull() & F.col(lang).isNotNull())
            .select(F.col(lang).alias("l"), F.col(text).alias("t"), F.xxhash64(text).alias("h")))
    kinds = rows.groupBy("l").agg(F.approx_count_distinct("h").alias("k")).collect()        # a row per language
    shares = spark.createDataFrame([(r["l"], int(grain * min(1.0, docs / max(1, r["k"])))) for r in kinds], "l string, below int")
    picked = rows.join(F.broadcast(shares), "l").filter(F.pmod("h", F.lit(grain)) < F.col("below")).dropDuplicates(["l", "h"]).select("t", "l")

    def run(batches):
        for batch in batches:
            for part in slices(batch, "t", SLICE_BYTES):
                own = identifier(spec.value)
                h, n = own.cross_entropies(part.column("t").to_pylist())
                at = {name: i for i, name in enumerate(own.names)}
                full = [(name, float(h[i, at[name]]), int(n[i])) for i, name in enumerate(part.column("l").to_pylist()) if n[i] and name in at]
                columns = list(zip(*full)) or [[], [], []]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.float64(), pa.int64()))], names=["lang", "h", "n"])

    found_rows = picked.mapInArrow(run, "lang string, h double, n long").collect()         # about `docs` per language
    per: dict[str, list] = {}
    for r in found_rows:
        per.setdefault(r["lang"], []).append((r["h"], r["n"]))
    out = {}
    for name, values in per.items():
        own = np.array(sorted(values))
        long = own[:, 1] >= np.median(own[:, 1])
        mean = own[long, 0].mean()
        out[name] = (float(mean), max(0.05, float(own[long, 0].std())), max(0.5, float(((own[:, 0] - mean) * own[:, 1] ** 0.5)[~long].std()) if (~long).any() else 0.5))
    return out


_identifiers: dict[str, Identifier] = {}


def identifier(spec: bytes) -> Identifier:
    take_over("langid", _identifiers)
    key = hashlib.md5(spec).hexdigest()
    if key not in _identifiers:
        _identifiers.clear()
        _identifiers[key] = pickle.loads(spec).load()
    return _identifiers[key]


def identify(df: DataFrame, found: Fitted, text: str = "text") -> DataFrame:
    """Add lang_pred, score, cross_entropy and rejected to every row."""
    spec = df.sparkSession.sparkContext.broadcast(pickle.dumps(found))
    fields = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()),
              T.StructField("cross_entropy", T.DoubleType()), T.StructField("rejected", T.BooleanType())]

    def make(texts: list) -> list[pa.Array]:
        rows = list(zip(*identifier(spec.value).predict(texts))) or [[], [], [], []]
        return [pa.array(c, t) for c, t in zip(rows, (pa.string(), pa.float64(), pa.float64(), pa.bool_()))]

    return add_columns(df, text, fields, make, SLICE_BYTES)


def held_out(ident: Column | str, parts: int, rest: int) -> Column:
    """Whether crc32 of the id's text leaves `rest` modulo `parts` (a null id counts as empty text)."""
    value = F.coalesce((F.col(ident) if isinstance(ident, str) else ident).cast("string"), F.lit(""))
    return F.crc32(value.cast("binary")) % parts == rest
