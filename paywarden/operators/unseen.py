"""How a model does on a kind of fraud it has never seen: one logistic fit per kind, with that kind left out.

All fits share every scan. A scan gives each task's sums of loss, gradient and curvature for all fits, a tree
of additions brings one array of fixed size to the driver (fits x features squared), and each fit takes a
Newton step there. What is minimised is that of `models.train_logreg`: balanced classes, L2 on the
coefficients with strength 1 / C, a free intercept.
"""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.operators.models import LOGREG_C

NONE_LEFT_OUT = ""


@dataclass
class Fits:
    """Weights (features and intercept last) of every fit, by the kind it left out."""
    kinds: list[str]
    names: list[str]
    weights: np.ndarray
    scans: int
    slope: float                    # largest component of a gradient that is left


def class_counts(df: DataFrame, kind: str, y: str) -> tuple[list[str], np.ndarray]:
    """Kinds of fraud, and (legitimate, fraud) rows of each fit: with nothing left out first."""
    rows = df.groupBy(F.when(F.col(y) == 1, F.coalesce(F.col(kind), F.lit(NONE_LEFT_OUT))).alias("k"), F.col(y).alias("y")).count().collect()
    per = {r.k: r["count"] for r in rows if r.y == 1}
    honest = sum(r["count"] for r in rows if r.y == 0)
    kinds = [NONE_LEFT_OUT, *sorted(k for k in per if k != NONE_LEFT_OUT)]
    total = sum(per.values())
    return kinds, np.array([[honest, total - (per[k] if k else 0)] for k in kinds], float)


def leave_one_kind_out(df: DataFrame, names: Sequence[str], kind: str = "fraud_type", y: str = "y", c: float = LOGREG_C,
                       max_scans: int = 60, tolerance: float = 1e-9) -> Fits:
    """Fit on all rows, and once per kind of fraud without its rows. Rows with a null feature or label are left
    out; a fraud without kind belongs to every fit. A fit without both classes keeps weights of 0."""
    names = list(names)
    whole = df.select(*[F.col(n).cast("double").alias(n) for n in names], F.col(y).cast("double").alias("__y"),
                      F.coalesce(F.col(kind), F.lit(NONE_LEFT_OUT)).alias("__kind")).dropna()
    kinds, counts = class_counts(whole.select(F.col("__kind").alias(kind), F.col("__y").alias(y)), kind, y)
    usable = (counts > 0).all(1)
    n = counts.sum(1)
    class_weight = np.where(usable[:, None], n[:, None] / (2 * np.maximum(counts, 1)), 0.0)
    size, fits = len(names) + 1, len(kinds)
    w = np.zeros((fits, size))
    place = {k: i for i, k in enumerate(kinds)}
    spark = df.sparkSession

    def sums(w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast(w)

        def run(batches):
            loss, slope, bend = np.zeros(fits), np.zeros((fits, size)), np.zeros((fits, size, size))
            for b in batches:
                x = np.column_stack([*[b.column(i).to_numpy(zero_copy_only=False) for i in range(size - 1)], np.ones(b.num_rows)])
                label = b.column("__y").to_numpy(zero_copy_only=False)
                own = np.fromiter((place[k] for k in b.column("__kind").to_pylist()), np.int64, b.num_rows)
                for i in range(fits):
                    m = class_weight[i][label.astype(int)]
                    if i:
                        m = np.where((label == 1) & (own == i), 0.0, m)
                    z = x @ shared.value[i]
                    p = 1 / (1 + np.exp(-np.clip(z, -500, 500)))
                    loss[i] += m @ (np.logaddexp(0, z) - label * z)
                    slope[i] += x.T @ (m * (p - label))
                    bend[i] += (x * (m * p * (1 - p))[:, None]).T @ x
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([loss, slope.ravel(), bend.ravel()]).tobytes()], pa.binary())], names=["s"])

        parts = whole.mapInArrow(run, "s binary").rdd.map(lambda r: np.frombuffer(r.s))
        flat = parts.treeReduce(lambda a, b: a + b, 3)
        return flat[:fits], flat[fits:fits + fits * size].reshape(fits, size), flat[fits + fits * size:].reshape(fits, size, size)

    ridge = np.append(np.full(size - 1, 1 / c), 0.0)
    at, step, before, scans, left = w.copy(), np.zeros_like(w), np.full(fits, np.inf), 0, np.inf
    while scans < max_scans and usable.any():
        loss, slope, bend = sums(at)
        scans += 1
        loss = loss + (ridge * at * at).sum(1) / 2
        slope = slope + ridge * at
        better = (loss <= before + 1e-12 * np.abs(before)) & usable
        for i in range(fits):
            if better[i]:
                w[i], before[i] = at[i], loss[i]
                step[i] = -np.linalg.solve(bend[i] + np.diag(ridge + 1e-12), slope[i])
            else:
                step[i] /= 2
            at[i] = w[i] + step[i]
        left = float(np.abs(slope[usable] / n[usable, None]).max())
        if left < tolerance or np.abs(step[usable]).max() < 1e-12:
            break
    return Fits(kinds, names, w, scans, left)


def score_fits(df: DataFrame, fits: Fits) -> DataFrame:
    """Add `fit_0`, `fit_1`, ...: the probability of each fit, in the order of `fits.kinds`."""
    def margin(w: np.ndarray):
        return sum((F.col(n).cast("double") * float(x) for n, x in zip(fits.names, w)), F.lit(float(w[-1])))
    return df.withColumns({f"fit_{i}": 1 / (1 + F.exp(-margin(w))) for i, w in enumerate(fits.weights)})


def unseen_recall(df: DataFrame, fits: Fits, kind: str = "fraud_type", y: str = "y", threshold: float = 0.5) -> DataFrame:
    """Per kind: its rows, the share found by the fit that never saw it and by the fit that saw all, and the share
    of legitimate rows that the former marks."""
    scored = score_fits(df, fits)
    rows = []
    for i, k in enumerate(fits.kinds):
        if k == NONE_LEFT_OUT:
            continue
        of, honest = (F.col(y) == 1) & (F.col(kind) == k), F.col(y) == 0
        hit = lambda j, who: F.count_if(who & (F.col(f"fit_{j}") >= threshold))
        rows.append(F.struct(F.lit(k).alias(kind), F.count_if(of).alias("n"), F.try_divide(hit(i, of), F.count_if(of)).alias("recall_unseen"),
                             F.try_divide(hit(0, of), F.count_if(of)).alias("recall_seen"),
                             F.try_divide(hit(i, honest), F.count_if(honest)).alias("marked_legitimate")))
    if not rows:
        return scored.limit(0).select(F.col(kind), *[F.lit(0).cast(t).alias(c) for c, t in (
            ("n", "long"), ("recall_unseen", "double"), ("recall_seen", "double"), ("marked_legitimate", "double"))])
    return scored.agg(F.array(*rows).alias("r")).select(F.inline("r"))
