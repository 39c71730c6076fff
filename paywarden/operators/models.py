"""Branches, stacked meta-learner, baselines and explanations on Spark ML.

Inputs are scaled feature rows (operators.split) with `y` and a `part` column. Branch names keep their
order everywhere: trees, sequence, novelty.
"""
from __future__ import annotations

import json
import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import asdict, dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import (GBTClassifier, LogisticRegression, RandomForestClassifier)
from pyspark.ml.feature import PCA, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.operators.decision import Policy, decide
from paywarden.operators.evaluate import best_f1_threshold, evaluate, pr_curve
from paywarden.operators.split import RUN, SEQUENCE_LENGTH, fit_scaler, scale, scaler_params, sequence_runs
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, slice_plan
from paywarden.session import materialise

# --- fixed values -------------------------------------------------------------------------------
BRANCHES = ["xgboost", "lstm_attention", "autoencoder"]
LOGREG_C, META_C = 0.5, 1.0
TREES, MIN_LEAF = 200, 5
GBT_DEPTH, GBT_STEP, GBT_SUBSAMPLE, GBT_COLUMNS, GBT_ROUNDS = 6, 0.05, 0.8, "0.8", 600
NOVELTY_K = 8
KEEP_NEGATIVES = 0.3
EXPLAIN_TOP_K = 6
# -------------------------------------------------------------------------------------------------
KEY = "transaction_id"


def assemble(names: Sequence[str], output: str = "vector") -> VectorAssembler:
    return VectorAssembler(inputCols=list(names), outputCol=output)


def balanced_weights(df: DataFrame, y: str = "y") -> DataFrame:
    """Add `weight` = rows / (2 * rows of the class)."""
    n, n1 = F.count("*"), F.sum(y)
    share = {c: df.agg(e.alias(c)).select(c).scalar() for c, e in (("w1", n / (2 * n1)), ("w0", n / (2 * (n - n1))))}
    return df.withColumn("weight", F.when(F.col(y) == 1, share["w1"]).otherwise(share["w0"]))


def margin() -> Column:
    """Log-odds of the positive class."""
    return vector_to_array("rawPrediction")[1]


def train_logreg(df: DataFrame, names: Sequence[str], y: str = "y", c: float = LOGREG_C, weighted: bool = True) -> PipelineModel:
    """L2 logistic regression with penalty 1/(C * total weight), features as they are."""
    if weighted:
        df = balanced_weights(df, y)
    n = df.count()
    lr = LogisticRegression(featuresCol="vector", labelCol=y, regParam=1 / (c * n), standardization=False, maxIter=200, tol=1e-8,
                            **({"weightCol": "weight"} if weighted else {}))
    return Pipeline(stages=[assemble(names), lr]).fit(df)


def train_random_forest(df: DataFrame, names: Sequence[str], y: str = "y", trees: int = TREES, seed: int = 42, max_depth: int = 30) -> PipelineModel:
    """Random forest; `max_depth` is the deepest Spark ML allows, as the model has no limit of its own. Rows keep
    the node they have reached, so no round sends the trees to the tasks or walks them from the root."""
    rf = RandomForestClassifier(featuresCol="vector", labelCol=y, weightCol="weight", numTrees=trees, minInstancesPerNode=MIN_LEAF,
                                featureSubsetStrategy="sqrt", maxDepth=max_depth, seed=seed, cacheNodeIds=True)
    return Pipeline(stages=[assemble(names), rf]).fit(balanced_weights(df, y))


def train_trees(fit: DataFrame, early_stop: DataFrame, names: Sequence[str], y: str = "y", rounds: int = GBT_ROUNDS, seed: int = 42) -> PipelineModel:
    """Boosted trees, positives weighted by the class ratio, stopped on the later slice."""
    ratio = fit.agg((F.count_if(F.col(y) == 0) / F.greatest(F.count_if(F.col(y) == 1), F.lit(1))).alias("r")).first().r
    both = fit.withColumn("late", F.lit(False)).unionByName(early_stop.withColumn("late", F.lit(True)))
    both = both.withColumn("weight", F.when(F.col(y) == 1, F.lit(float(ratio))).otherwise(1.0))
    gbt = GBTClassifier(featuresCol="vector", labelCol=y, weightCol="weight", validationIndicatorCol="late", maxIter=rounds,
                        maxDepth=GBT_DEPTH, stepSize=GBT_STEP, subsamplingRate=GBT_SUBSAMPLE, featureSubsetStrategy=GBT_COLUMNS, seed=seed)
    return Pipeline(stages=[assemble(names), gbt]).fit(both)


def model_score(model: PipelineModel, df: DataFrame, name: str) -> DataFrame:
    """Add the log-odds of a classifier as column `name`."""
    scored = model.transform(df).withColumn(name, margin())
    return scored.drop("vector", "rawPrediction", "probability", "prediction")


def train_novelty(legit: DataFrame, names: Sequence[str], k: int = NOVELTY_K) -> PipelineModel:
    """Principal components of legitimate rows; what they do not explain is new."""
    return Pipeline(stages=[assemble(names), PCA(k=k, inputCol="vector", outputCol="components")]).fit(legit)


def novelty_score(model: PipelineModel, df: DataFrame, names: Sequence[str], name: str = "autoencoder") -> DataFrame:
    """Add ln(mean squared reconstruction error + 1e-6). Components are orthonormal and taken without
    centring, so the error is the squared length minus that of the projection."""
    scored = model.transform(df)
    total = F.aggregate(vector_to_array("vector"), F.lit(0.0), lambda a, x: a + x * x)
    kept = F.aggregate(vector_to_array("components"), F.lit(0.0), lambda a, x: a + x * x)
    error = F.greatest(total - kept, F.lit(0.0)) / len(names)
    return scored.withColumn(name, F.log(error + 1e-6)).drop("vector", "components")


def attention_weights(current: np.ndarray, history: np.ndarray, mask: np.ndarray, decay: float = 0.5) -> np.ndarray:
    """Softmax over the unpadded history: closer in time and nearer to the current vector weighs more.

    `current` is (features, rows), `history` and `mask` are (length, ...), oldest first."""
    length = len(history)
    scores = np.zeros(mask.shape)
    for i in range(length):
        distance = np.zeros(mask.shape[1])
        for now, other in zip(current, history[i]):
            distance += (now - other) * (now - other)
        scores[i] = np.where(mask[i], np.exp(-decay * (length - 1 - i) - distance / len(current)), 0.0)
    total = np.zeros(mask.shape[1])
    for row in scores:
        total += row
    return scores / total


def _positions(users: pa.Array, last: tuple[object, int] | None) -> np.ndarray:
    """Number of each row in its user, going on from the user and number of the row before."""
    codes = users.dictionary_encode(null_encoding="encode").indices.to_numpy()
    starts = np.flatnonzero(np.concatenate([[True], codes[1:] != codes[:-1]]))
    pos = np.arange(len(users)) - np.repeat(starts, np.diff([*starts, len(users)]))
    if last is not None and users[0].as_py() == last[0]:
        pos[:starts[1] if len(starts) > 1 else None] += last[1] + 1
    return pos


def _with_sequences(names: Sequence[str], length: int, user: str, output: Sequence[str]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Batches in the order of users or of their runs, with the last `length - 1` vectors of the batch before at hand."""
    back = length - 1

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, kept_null, last = np.zeros((len(names), back)), np.zeros(back, bool), None
        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(n).cast(pa.float64()) for n in names]
            null = np.concatenate([kept_null, np.any([np.asarray(c.is_null()) for c in columns], axis=0)])
            vectors = np.concatenate([kept, np.stack([c.to_numpy(zero_copy_only=False) for c in columns])], axis=1)
            kept, kept_null = vectors[:, vectors.shape[1] - back:], null[len(null) - back:]
            if "__run" in batch.schema.names:
                pos = batch.column("__pos").to_numpy()
                at = np.flatnonzero(pos // RUN == batch.column("__run").to_numpy())      # not the copies in front of a run
            else:
                pos, at = _positions(batch.column(user), last), np.arange(batch.num_rows)
                last = (batch.column(user)[-1].as_py(), pos[-1])
            if not len(at):
                continue
            before = at + np.arange(length)[:, None]             # places of the last vectors, oldest first
            mask = np.arange(length)[:, None] >= back - pos[at]
            history = [vectors[:, b] for b in before]
            with np.errstate(invalid="ignore", over="ignore"):
                weights = attention_weights(history[-1], history, mask)
                used = (weights > 0) | np.isnan(weights)
                pooled = np.zeros((len(names), len(at)))
                for w, u, values in zip(weights, used, history):
                    pooled += np.where(u, w * values, 0.0)
            unknown = (null[before] & mask).any(axis=0)           # a null anywhere: no weights
            weights[:, unknown], pooled[:, unknown] = 0.0, 0.0
            absent = np.isnan(weights).any(axis=0) & ~mask.all(axis=0)
            own = batch.take(pa.array(at))
            kept_columns = [own.column(n) for n in output if n in own.schema.names]
            lists = np.arange(0, len(at) * length + 1, length, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([
                *kept_columns, pa.ListArray.from_arrays(lists, pa.array(mask.T.ravel())),
                pa.ListArray.from_arrays(lists, pa.array(weights.T.ravel(), mask=np.repeat(unknown, length))),
                *[pa.array(p, mask=absent) for p in pooled]], names=list(output))

    return add


def sequence_features(df: DataFrame, names: Sequence[str], length: int = SEQUENCE_LENGTH, *, user: str = "user_id",
                      order: Sequence[str] = ("timestamp", "transaction_id"), policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add `mask`, `attention` (weights over the last vectors) and one pooled column `seq_<name>` per feature.

    A task reads its users' rows in order, a batch at a time; users too large for a task are read by runs."""
    plan = slice_plan(df.select(user, *order), [user], list(order), policy)
    schema = T.StructType([*df.schema.fields, T.StructField("mask", T.ArrayType(T.BooleanType())),
                           T.StructField("attention", T.ArrayType(T.DoubleType())),
                           *[T.StructField(f"seq_{n}", T.DoubleType()) for n in names]])
    if plan is None:
        rows = df.repartition(user).sortWithinPartitions(user, *order)
    else:
        rows = (sequence_runs(df, length, user=user, order=order, policy=policy).repartition(user, "__run")
                .sortWithinPartitions(user, "__run", "__pos"))
    return rows.mapInArrow(_with_sequences(list(names), length, user, schema.names), schema)


def attention_on_history() -> Column:
    """Weights of the unpadded history, oldest first, rounded."""
    kept = F.filter(F.arrays_zip(F.col("attention").alias("w"), F.col("mask").alias("m")), lambda p: p["m"])
    return F.transform(kept, lambda p: F.round(p["w"], 4))


def downsample_negatives(df: DataFrame, rate: float = KEEP_NEGATIVES, seed: int = 42, y: str = "y", key: str = KEY) -> DataFrame:
    """All frauds and a repeatable share of the rest."""
    bucket = F.conv(F.substring(F.md5(F.concat(F.col(key), F.lit(f":{seed}"))), 1, 8), 16, 10).cast("long")
    return df.filter((F.col(y) == 1) | (bucket < int(rate * 2 ** 32)))


@dataclass
class MetaLearner:
    """Logistic regression on standardised branch scores, kept as plain numbers."""
    names: list[str]
    means: list[float]
    stds: list[float]
    coefficients: list[float]
    intercept: float
    threshold: float = 0.5
    extra: dict = field(default_factory=dict)

    def z(self, name: str) -> Column:
        """Standardised score; a missing branch counts as its mean."""
        i = self.names.index(name)
        return (F.coalesce(F.col(name), F.lit(self.means[i])) - self.means[i]) / self.stds[i]

    def contributions(self) -> Column:
        return F.create_map(*[x for n, c in zip(self.names, self.coefficients) for x in (F.lit(n), F.lit(c) * self.z(n))])

    def probability(self) -> Column:
        logit = F.lit(self.intercept)
        for n, c in zip(self.names, self.coefficients):
            logit = logit + c * self.z(n)
        return 1 / (1 + F.exp(-logit))

    def apply(self, df: DataFrame) -> DataFrame:
        """Add fraud_probability, is_fraud_predicted, branch contributions, and the degraded mode's flags."""
        missing = F.array_compact(F.array(*[F.when(F.col(n).isNull(), F.lit(n)) for n in self.names]))
        return (df.withColumns({"fraud_probability": self.probability(), "branch_contributions": self.contributions(),
                                "degraded_branches": missing})
                .withColumns({"is_fraud_predicted": F.col("fraud_probability") >= self.threshold,
                              "degraded": F.size("degraded_branches") > 0}))


def train_meta(df: DataFrame, names: Sequence[str] = tuple(BRANCHES), y: str = "y") -> MetaLearner:
    """Stacking on validation scores; the threshold maximises F1 there."""
    params = scaler_params(fit_scaler(df, names))
    z = df.select(y, *[((F.col(n) - params[n][0]) / params[n][1]).alias(n) for n in names])
    model = train_logreg(z, names, y, META_C, weighted=False).stages[-1]
    meta = MetaLearner(list(names), [params[n][0] for n in names], [params[n][1] for n in names],
                       [float(x) for x in model.coefficients], float(model.intercept))
    curve = pr_curve(df.withColumn("score", meta.probability()), y, "score")
    meta.threshold = best_f1_threshold(curve).first().threshold
    return meta


def ablations(df: DataFrame, y: str = "y") -> dict[str, MetaLearner]:
    """The meta-learner without each branch in turn."""
    out = {}
    for kept in combinations(BRANCHES, len(BRANCHES) - 1):
        dropped = next(b for b in BRANCHES if b not in kept)
        out[f"ablation_without_{dropped}"] = train_meta(df, kept, y)
    return out


def top_contributions(coefficients: Mapping[str, float], raw: Mapping[str, Column], threshold: float,
                      k: int = EXPLAIN_TOP_K, probability: str = "fraud_probability") -> Column:
    """The k features that move a linear score most, with their raw values; empty for low-risk rows."""
    parts = F.array(*[F.struct(F.abs(F.col(n) * c).alias("size"), F.lit(n).alias("feature"),
                               F.round(F.col(n) * c, 4).alias("shap"), F.round(raw[n], 4).alias("value"))
                      for n, c in coefficients.items()])
    ranked = F.slice(F.reverse(F.array_sort(parts)), 1, k)
    named = F.transform(ranked, lambda p: F.struct(p["feature"].alias("feature"), p["shap"].alias("shap"), p["value"].alias("value")))
    return F.when(F.col(probability) >= threshold / 5, named).otherwise(F.slice(named, 1, 0))


def linear_coefficients(model: PipelineModel, names: Sequence[str]) -> dict[str, float]:
    return dict(zip(names, (float(x) for x in model.stages[-1].coefficients)))


def comparison(validation: DataFrame, test: DataFrame, scores: Sequence[str], y: str = "y") -> DataFrame:
    """One row per score column: threshold from validation, metrics on test, pr_auc per channel; best first."""
    out = None
    for name in scores:
        t = best_f1_threshold(pr_curve(validation, y, name)).first().threshold
        row = evaluate(test, t, y, name).select(F.lit(name).alias("model"), F.lit(t).alias("threshold"), "*")
        channel = evaluate(test, t, y, name, by=["channel"]).groupBy(F.lit(name).alias("model")).agg(
            F.max(F.when(F.col("channel") == "MOBILE_MONEY", F.col("pr_auc"))).alias("pr_auc_mobile_money"),
            F.max(F.when(F.col("channel") == "VISA_VIRTUAL", F.col("pr_auc"))).alias("pr_auc_visa_virtual"))
        row = row.join(channel, "model")
        out = row if out is None else out.unionByName(row)
    return out.orderBy(F.desc("pr_auc"))


@dataclass
class Ensemble:
    """The three branches and the meta-learner."""
    trees: PipelineModel
    sequence: PipelineModel
    novelty: PipelineModel
    meta: MetaLearner | None
    names: list[str]
    scaler: dict[str, tuple[float, float]] | None = None        # (mean, std) of each feature, to score raw rows

    def branch_scores(self, df: DataFrame) -> DataFrame:
        """Add one column per branch, in order. Rows need their sequence features."""
        df = model_score(self.trees, df, BRANCHES[0])
        df = model_score(self.sequence, df, BRANCHES[1])
        return novelty_score(self.novelty, df, self.names, BRANCHES[2])

    def score(self, df: DataFrame) -> DataFrame:
        return self.meta.apply(self.branch_scores(df))

    def save(self, path: str, metadata: dict | None = None) -> None:
        for name in ("trees", "sequence", "novelty"):
            getattr(self, name).write().overwrite().save(f"{path}/{name}")
        spark = SparkSession.active()
        record = {"names": self.names, "branch_order": BRANCHES, "meta": asdict(self.meta), "scaler": self.scaler, **(metadata or {})}
        spark.createDataFrame([(json.dumps(record),)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @classmethod
    def load(cls, path: str) -> Ensemble:
        record = json.loads(SparkSession.active().read.text(f"{path}/metadata").first().value)
        parts = [PipelineModel.load(f"{path}/{n}") for n in ("trees", "sequence", "novelty")]
        scaler = {n: tuple(v) for n, v in record["scaler"].items()} if record.get("scaler") else None
        return cls(*parts, MetaLearner(**record["meta"]), record["names"], scaler)

    def score_raw(self, features: DataFrame) -> DataFrame:
        """Score feature rows as `build_features` gives them: scaled by the stored scaler, with the sequences
        of the rows at hand; the feature columns come back raw."""
        if self.scaler is None:
            raise ValueError("the ensemble has no scaler")
        kept = features.withColumn("__raw", F.struct(*self.names))
        wide = sequence_features(scale(kept, {n: self.scaler[n] for n in self.names}), self.names)
        scored = self.score(wide)
        added = [c for c in scored.columns if c not in wide.columns or c in features.columns]
        return scored.select(*[F.col(f"__raw.{c}").alias(c) if c in self.names else F.col(c) for c in added])


def score_and_decide(features: DataFrame, ensemble: Ensemble, policy: Policy, version: str = "1") -> DataFrame:
    """Features to decision in one plan: scaler, branches, meta-learner, costs and rules, with the model's
    version and an explanation (branch contributions, rules, missing branches)."""
    decided = decide(ensemble.score_raw(features), policy)
    return decided.withColumns({
        "model_version": F.lit(version),
        "explanation": F.struct("branch_contributions", "degraded_branches", "rules_triggered", "reason")})


def train_ensemble(df: DataFrame, names: Sequence[str], y: str = "y", rounds: int = GBT_ROUNDS, seed: int = 42) -> Ensemble:
    """Branches on the training slices (split 0, stopped on 1), the meta-learner on validation (split 2)."""
    fit, stop, val = (df.filter(F.col("split") == i) for i in range(3))
    trees = train_trees(fit, stop, names, y, rounds, seed)
    novelty = train_novelty(fit.filter(F.col(y) == 0), names)
    wide = [*names, *[f"seq_{n}" for n in names]]
    sampled = downsample_negatives(fit, KEEP_NEGATIVES, seed, y)
    counts = sampled.agg(F.count_if(F.col(y) == 0).alias("n0"), F.greatest(F.count_if(F.col(y) == 1), F.lit(1)).alias("n1")).first()
    weighted = sampled.withColumn("weight", F.when(F.col(y) == 1, math.sqrt(counts.n0 / counts.n1)).otherwise(1.0))
    lr = LogisticRegression(featuresCol="vector", labelCol=y, weightCol="weight", regParam=1 / (LOGREG_C * (counts.n0 + counts.n1)),
                            standardization=False, maxIter=200)
    sequence = Pipeline(stages=[assemble(wide), lr]).fit(weighted)
    ensemble = Ensemble(trees, sequence, novelty, None, list(names))
    # the fit of the meta-learner reads the scores several times
    ensemble.meta = train_meta(materialise(ensemble.branch_scores(val).select(y, *BRANCHES), "branch-scores"), BRANCHES, y)
    return ensemble
