"""Toxicity: a subsequence string-kernel support vector machine with Nystrom landmarks.

The kernel compares two strings by the character subsequences of length `P` they share; a subsequence that
spans s characters weighs DECAY ** s, and spans stop at `SPAN`. So a gap or an inserted character weakens a
match instead of breaking it. Landmarks l_1..l_m give the Nystrom map K(s, l_j) K_mm^(-1/2); a linear SVM on
it is f(s) = sum_j b_j K(s, l_j) + c. As the kernel is a dot product over subsequences, the sum over landmarks
is taken once per subsequence: scoring looks up each subsequence of a word in one sorted table.

The unit of a sentence is its word (a run of single characters counts as one word), its score that of its
strongest word, a text's score that of its strongest sentence. Labels are given per text, so training
alternates, as in multiple-instance learning: fit on witness words of toxic texts against words of clean
ones, score again, choose witnesses again. A logistic curve over text scores gives the probability.

Fitting takes at most about `docs_per_class` labelled texts of each class and `max_chars` characters of
them, picked by hash; a document with several labels has the highest; scoring takes every text whole. Each worker keeps a bounded cache of scored words.

Null and empty texts score as texts without any word. Rows without a label don't train; with a class
missing every text scores 0. Repeated rows score alike. Other columns pass through; columns named like an
output are replaced.
"""
from __future__ import annotations

import hashlib
import pickle
import re
import sys
from collections import Counter
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.llm.common import add_columns, take_over
from paywarden.session import materialise

P, SPAN, DECAY = 4, 6, 0.7
WIDTH = 26                       # characters of a word's window, marks included; longer words have several
#: Offsets of the characters of a subsequence, and its weight.
SHAPES = [((0, *rest), DECAY ** (rest[-1] + 1)) for rest in combinations(range(1, SPAN), P - 1)]
SPACED = re.compile(r"(?<!\S)\w(?:\s+\w){2,}(?!\S)")
LETTERS = re.compile(r"[^\W\d_]+")
CACHE = 400_000


def words(text: str) -> list[str]:
    """White-space separated tokens, lower case, and each run of single characters joined to one token."""
    low = text.lower()
    found = low.split()
    if any(len(a) == 1 for a in found):
        found += ["".join(run.split()) for run in SPACED.findall(low)]
    return found


def units(token: str) -> list[str]:
    """The token's letters between marks, in overlapping windows if they are many."""
    plain = "".join(LETTERS.findall(token))
    if not plain:
        return []
    whole, step = f"^{plain}$", WIDTH // 2
    return [whole[i:i + WIDTH] for i in range(0, max(1, len(whole) - step), step)] if len(whole) > WIDTH else [whole]


def matrix(strings: list[str]) -> np.ndarray:
    """Character codes (folded to 16 bits), one row per string, 0 where it has ended."""
    width = max(map(len, strings), default=1)
    raw = np.frombuffer("".join(s.ljust(width, "\0") for s in strings).encode("utf-32-le", "surrogatepass"), "<u4").reshape(-1, width)
    return np.where(raw < 0x10000, raw, 0xE000 | raw & 0xFFF).astype(np.uint64)


def subsequences(codes: np.ndarray):
    """For every shape: (row numbers, keys, weight) of the subsequences of each string."""
    width = codes.shape[1]
    for offsets, weight in SHAPES:
        n = width - offsets[-1]
        if n <= 0:
            continue
        key = np.zeros((len(codes), n), np.uint64)
        for o in offsets:
            key = key << np.uint64(16) | codes[:, o:o + n]
        row, col = np.nonzero(codes[:, offsets[-1]:offsets[-1] + n])
        yield row, key[row, col], weight


def norms(codes: np.ndarray) -> np.ndarray:
    """Root of the summed squared weights of a string's subsequences."""
    total = np.zeros(len(codes))
    for row, key, weight in subsequences(codes):
        total += np.bincount(row, minlength=len(codes)) * weight ** 2
    return np.sqrt(np.maximum(total, 1e-12))


def features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All (row, key, weight) with equal keys of a row summed, divided by the row's norm."""
    parts = list(subsequences(codes))
    if not parts:
        return np.empty(0, int), np.empty(0, np.uint64), np.empty(0)
    row, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
    value = np.concatenate([np.full(len(p[0]), p[2]) for p in parts]) / norms(codes)[row]
    order = np.lexsort((key, row))
    row, key, value = row[order], key[order], value[order]
    first = np.flatnonzero(np.concatenate([[True], (row[1:] != row[:-1]) | (key[1:] != key[:-1])]))
    return row[first], key[first], np.add.reduceat(value, first)


def kernel(strings: list[str], landmarks: list[str]) -> np.ndarray:
    """Normalised subsequence kernel of every string with every landmark."""
    lr, lk, lv = features(matrix(landmarks))
    vocabulary, at = np.unique(lk, return_inverse=True)
    dense = np.zeros((len(vocabulary), len(landmarks)))
    dense[at, lr] = lv
    out = np.zeros((len(strings), len(landmarks)))
    for start in range(0, len(strings), 250):
        part = strings[start:start + 250]
        r, k, v = features(matrix(part))
        where = np.minimum(np.searchsorted(vocabulary, k), len(vocabulary) - 1)
        hit = vocabulary[where] == k
        r, where, v = r[hit], where[hit], v[hit]
        starts = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]])) if len(r) else []
        if len(r):
            out[start + r[starts]] = np.add.reduceat(dense[where] * v[:, None], starts, axis=0)
    return out


def linear_svm(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 1e-5, steps: int = 30) -> tuple[np.ndarray, float]:
    """Squared-hinge SVM by Newton steps over the rows inside the margin; `weight` balances the classes."""
    x1 = np.hstack([x, np.ones((len(x), 1))])
    ridge = penalty * np.eye(x1.shape[1])
    ridge[-1, -1] = 1e-12
    loss = lambda w: (weight * np.maximum(0, 1 - y * (x1 @ w)) ** 2).sum() + w @ ridge @ w
    w = np.zeros(x1.shape[1])
    for _ in range(steps):
        inside = y * (x1 @ w) < 1
        own = x1[inside] * weight[inside, None]
        step = np.linalg.solve(own.T @ x1[inside] + ridge, own.T @ y[inside]) - w
        size, before = 1.0, loss(w)
        while loss(w + size * step) > before and size > 1e-3:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-8:
            break
    return w[:-1], float(w[-1])


class Scorer:
    """The trained machine: weights per subsequence, a constant, and the probability curve."""

    def __init__(self, keys: np.ndarray, values: np.ndarray, constant: float, slope: float = 1.0, shift: float = 0.0):
        self.keys, self.values, self.constant, self.slope, self.shift = keys, values, constant, slope, shift
        self.young: dict[str, float] = {}
        self.old: dict[str, float] = {}

    def score_units(self, strings: list[str]) -> np.ndarray:
        if not strings:
            return np.empty(0)
        out = np.zeros(len(strings))
        lengths = np.fromiter(map(len, strings), int, len(strings))
        for low in range(0, WIDTH + 1, 5):          # similar lengths together
            members = np.flatnonzero((lengths > low) & (lengths <= low + 5))
            for start in range(0, len(members), 50_000):
                own = members[start:start + 50_000]
                codes = matrix([strings[i] for i in own])
                total, norm = np.zeros(len(own)), norms(codes)
                for row, key, weight in subsequences(codes):
                    where = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
                    total += np.bincount(row, np.where(self.keys[where] == key, self.values[where], 0.0) * weight, len(own))
                out[own] = total / norm
        return out + self.constant

    def fill(self, tokens: list[str]) -> dict[str, float]:
        """Score of each token: that of its strongest unit; of one without letters, minus infinity."""
        flat, of = [], []
        for i, token in enumerate(tokens):
            for u in units(token):
                flat.append(u)
                of.append(i)
        best = np.full(len(tokens), -np.inf)
        np.maximum.at(best, np.array(of, int), self.score_units(flat))
        return dict(zip(tokens, best.tolist()))

    def raw(self, texts: list) -> list[float]:
        parts = [words(t or "") for t in texts]
        if len(self.young) > CACHE:
            self.old, self.young = self.young, {}
        young, old = self.young, self.old
        need = set().union(*parts).difference(young)
        kept = {c: old[c] for c in need if c in old}
        young.update(kept)
        need.difference_update(kept)
        young.update(self.fill(list(need)))
        out = [max(map(young.__getitem__, p), default=-np.inf) for p in parts]
        for c in [c for c in need if len(c) > 48]:
            del young[c]
        return out

    def predict(self, texts: list) -> list[float]:
        floor = self.constant - 1.0           # a text without words is as clean as can be
        return [float(1.0 / (1.0 + np.exp(min(700.0, -(self.slope * max(r, floor) + self.shift))))) for r in self.raw(texts)]


def train(toxic: list[set[str]], clean: list[set[str]], landmarks: int = 256, rounds: int = 2, seed: int = 7) -> Scorer | None:
    """Fit on the distinct units of each toxic and each clean text."""
    if not toxic or not clean:
        return None
    rng = np.random.default_rng(seed)
    grams = lambda u: {u[i:i + 4] for i in range(len(u) - 3)} or {u}
    bad, good = Counter(), Counter()
    for texts, count in ((toxic, bad), (clean, good)):
        for t in texts:
            count.update({g for u in t for g in grams(u)})
    # a gram speaks for toxicity if it is in enough toxic texts, and in as many times more of them than of clean ones
    # (by six standard deviations more often than chance would have it)
    least = max(3.0, 0.005 * len(toxic))

    def beyond_chance(count: Counter, other: Counter) -> set[str]:
        chance = {x: len(toxic) * (other[x] + 1) / len(clean) for x in count}
        return {x for x, n in count.items() if n > chance[x] + 6 * chance[x] ** 0.5}

    clear = beyond_chance(bad, good)
    ratio = {g: np.log(n / len(toxic)) - np.log((good[g] + 1) / len(clean)) for g, n in bad.items() if n >= least and g in clear}
    base = np.log(len(clean) / len(toxic))
    df_bad, df_good = Counter(u for t in toxic for u in t), Counter(u for t in clean for u in t)
    # words of clean texts may be witnesses too if toxic texts hold them four times as often and beyond chance;
    # what single labels get wrong is left to the margin
    clear = beyond_chance(df_bad, df_good)
    free = {u for u, n in df_bad.items() if u not in df_good or u in clear and n / len(toxic) > 4 * (df_good[u] + 1) / len(clean)}
    first = {u: max((ratio.get(g, -9.0) for g in grams(u)), default=-9.0) for u in free}
    negatives = [u for u, _ in df_good.most_common(4000)]
    clean_units = sorted(df_good)
    rest = sorted(set(df_good) - set(negatives))
    negatives += [rest[i] for i in rng.choice(len(rest), min(len(rest), 12_000), replace=False)] if rest else []
    score = lambda us: np.array([first.get(u, -9.0) for u in us])
    cut, scorer = base + np.log(least) - 1e-9, None
    spread = np.inf
    for _ in range(rounds):
        witness = Counter()
        for t in toxic:
            own = sorted(u for u in t if u in free)
            if own:
                s = score(own)
                witness.update([own[i] for i in np.flatnonzero((s > cut) & (s > s.max() - spread))])
        positives = [u for u, _ in witness.most_common(6000)]
        if not positives:
            break
        # landmarks: the most frequent witnesses, then words of clean texts, frequent and rare ones
        half = landmarks // 2
        marks = positives[:half] + negatives[:half // 2] + negatives[-(half - half // 2):]
        marks = list(dict.fromkeys(marks))
        k_mm = kernel(marks, marks)
        value, vector = np.linalg.eigh((k_mm + k_mm.T) / 2)
        keep = value > 1e-6 * value.max()
        root = vector[:, keep] / np.sqrt(value[keep])
        # frequent witnesses also train with a character inserted, as people write them to evade word lists
        disguised = [(u[:i] + chr(97 + rng.integers(26)) + u[i:], witness[u] / 2) for u in positives[:300] if len(u) > 5
                     for i in rng.integers(2, len(u) - 1, 3)]
        hard = [] if scorer is None else [clean_units[i] for i in np.argsort(-scorer.score_units(clean_units))[:4000]]
        sample = [*positives, *[u for u, _ in disguised], *negatives, *hard]
        y = np.array([1.0] * (len(positives) + len(disguised)) + [-1.0] * (len(negatives) + len(hard)))
        seen = np.sqrt([witness[u] for u in positives] + [n for _, n in disguised])
        weight = np.concatenate([0.5 * seen / seen.sum(), np.full(len(negatives) + len(hard), 0.5 / (len(negatives) + len(hard)))])
        w, constant = linear_svm(kernel(sample, marks) @ root, y, weight)
        beta = root @ w
        r, k, v = features(matrix(marks))
        keys, at = np.unique(k, return_inverse=True)
        scorer = Scorer(keys, np.bincount(at, v * beta[r]), constant)
        score = lambda us, s=scorer: s.score_units(us)
        cut, spread = 0.0, 1.0
    if scorer is None:
        return None
    top = [[max(scorer.score_units(sorted(t)), default=constant - 1.0) for t in texts] for texts in (toxic, clean)]
    x = np.maximum(np.array(top[0] + top[1]), constant - 1.0)
    y = np.array([1.0] * len(top[0]) + [0.0] * len(top[1]))
    # logistic curve over text scores, classes as frequent as in the sample, by Newton steps
    design, theta = np.stack([x, np.ones(len(x))], 1), np.zeros(2)
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ theta, -30, 30)))
        h = (design * (p * (1 - p) + 1e-9)[:, None]).T @ design + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, design.T @ (target - p) - 1e-6 * theta)
        theta += step * min(1.0, 5 / (np.abs(step).max() + 1e-12))
    scorer.slope, scorer.shift = map(float, theta)
    return scorer


def fit(docs: DataFrame, labels: DataFrame, ident: str = "doc_id", text: str = "text", label: str = "toxic",
        docs_per_class: int = 2_000, max_chars: int = 8_000_000, landmarks: int = 256) -> Scorer | None:
    """Train on a hashed sample of `labels`; the bounds hold per class, in expectation. The picked labels are
    what is broadcast, so no text is shuffled."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(ident).isNotNull()).groupBy(F.col(ident).alias("__id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    sizes = {r["y"]: r["count"] for r in known.groupBy("y").count().collect()}
    if set(sizes) != {0, 1}:
        return None
    grain = 1 << 30
    pick = lambda column, share: F.pmod(F.xxhash64(column), F.lit(grain)) < F.when(F.col("y") == 1, share[1]).otherwise(share[0])
    some = known.filter(pick("__id", {y: int(grain * min(1.0, docs_per_class / n)) for y, n in sizes.items()}))
    rows = docs.filter(F.col(text).isNotNull()).select(F.col(ident).alias("__id"), F.col(text).alias("t"))
    texts = materialise(rows.join(F.broadcast(some), "__id").select("y", "t"), "labelled-texts")
    chars = {r["y"]: r["c"] for r in texts.groupBy("y").agg(F.sum(F.length("t")).alias("c")).collect()}
    picked = texts.filter(pick("t", {y: int(grain * min(1.0, max_chars / max(1, chars.get(y, 0)))) for y in (0, 1)}))

    def run(batches):                     # the distinct units of each text
        for batch in batches:
            found = [sorted({u for w in set(words(t)) for u in units(w)}) for t in batch.column("t").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("y"), pa.array(found, pa.list_(pa.string()))], names=["y", "units"])

    found = picked.mapInArrow(run, "y int, units array<string>").toArrow()
    both: list[list[set[str]]] = [[], []]
    for y, u in zip(found.column("y").to_pylist(), found.column("units").to_pylist()):
        both[y].append({sys.intern(w) for w in u})
    return train(both[1], both[0], landmarks)


_scorers: dict[str, Scorer] = {}


def scorer_of(spec: bytes) -> Scorer:
    take_over("toxicity", _scorers)
    key = hashlib.md5(spec).hexdigest()
    if key not in _scorers:
        import gc
        gc.disable()        # no cycles arise in these workers; tracking the cache costs more than the work
        _scorers.clear()
        _scorers[key] = pickle.loads(spec)
    return _scorers[key]


def score(df: DataFrame, scorer: Scorer | None, text: str = "text", threshold: float = 0.7) -> DataFrame:
    """Add `score` (0 to 1) and `predicted` (1 from `threshold` up) to every row."""
    spec = df.sparkSession.sparkContext.broadcast(pickle.dumps(scorer))
    fields = [T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]

    def make(texts: list) -> list[pa.Array]:
        own = scorer_of(spec.value)
        found = own.predict(texts) if own else [0.0] * len(texts)
        return [pa.array(found, pa.float64()), pa.array([int(s >= threshold) for s in found], pa.int32())]

    return add_columns(df, text, fields, make)
