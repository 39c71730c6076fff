"""Temporal split, scaling frozen on the training slice, and per-user sequences."""
from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paywarden.functions.columns import clip, epoch_us
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise

# --- fixed values -------------------------------------------------------------------------------
SPLIT_NAMES = ["train", "early_stop", "val", "test"]
EARLY_STOP_FROM, VAL_FROM, TEST_FROM = 0.595, 0.70, 0.85     # fractions of the time span
SEQUENCE_LENGTH = 10
RUN = 1000
FEATURES_AT_ONCE = 6
CLIP = 10.0
# -------------------------------------------------------------------------------------------------


def split_bounds(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """One row: start, early_stop_from, val_from, test_from, end (microseconds)."""
    span = df.agg(F.min(epoch_us(ts)).alias("t0"), F.max(epoch_us(ts)).alias("t1"))

    def cut(fraction: float) -> Column:
        return (F.col("t0") + F.floor((F.col("t1") - F.col("t0")) * fraction)).cast("long")

    return span.select(F.col("t0").alias("start_us"), cut(EARLY_STOP_FROM).alias("early_stop_from_us"),
                       cut(VAL_FROM).alias("val_from_us"), cut(TEST_FROM).alias("test_from_us"),
                       F.col("t1").alias("end_us"))


def temporal_split(df: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add `split`: 0 train, 1 early stop, 2 validation, 3 test, by fraction of the time span."""
    bounds = split_bounds(df, ts)
    at, code = epoch_us(ts), F.lit(3)
    for value, name in reversed(list(enumerate(["early_stop_from_us", "val_from_us", "test_from_us"]))):
        code = F.when(at < bounds.select(name).scalar(), value).otherwise(code)
    return df.withColumn("split", code)


def split_stats(df: DataFrame) -> DataFrame:
    """Rows, frauds and rate per split and per split and channel (channel null = all)."""
    return (df.groupingSets([["split"], ["split", "channel"]], "split", "channel")
            .agg(F.count("*").alias("n"), F.sum("is_fraud").alias("n_fraud"),
                 F.round(F.avg("is_fraud"), 5).alias("fraud_rate")))


def class_weights(df: DataFrame) -> DataFrame:
    """Negatives, positives and their ratio on the training slices."""
    counts = df.filter(F.col("split") <= 1).agg(F.count_if(F.col("is_fraud") == 0).alias("negative"),
                                               F.count_if(F.col("is_fraud") == 1).alias("positive"))
    return counts.withColumn("scale_pos_weight",
                             F.round(F.col("negative") / F.greatest(F.col("positive"), F.lit(1)), 3))


def fit_scaler(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Mean and population deviation per feature over the given rows, zero deviation replaced by 1.

    A few features an aggregate: the JVM never compiles the code of one over all of them."""
    out = None
    for group in (names[i:i + FEATURES_AT_ONCE] for i in range(0, len(names), FEATURES_AT_ONCE)):
        stats = df.agg(*[F.struct(F.avg(n).alias("mean"), F.stddev_pop(n).alias("std")).alias(n) for n in group])
        rows = F.array(*[F.struct(F.lit(n).alias("feature"), F.col(f"{n}.mean").alias("mean"),
                                  F.when(F.col(f"{n}.std") > 0, F.col(f"{n}.std")).otherwise(1.0).alias("std"))
                         for n in group])
        part = stats.select(F.inline(rows))
        out = part if out is None else out.unionByName(part)
    return out


def scaler_params(scaler: DataFrame) -> dict[str, tuple[float, float]]:
    """The fitted scaler on the driver: one pair per feature."""
    return {r.feature: (r.mean, r.std) for r in scaler.collect()}


def scaled(name: str, params: Mapping[str, tuple[float, float]]) -> Column:
    mean, std = params[name]
    return clip((F.col(name).cast("double") - mean) / std, -CLIP, CLIP).cast("float")


def scale(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    """(x - mean) / std, clipped to +-10, as FLOAT."""
    return df.withColumns({n: scaled(n, params) for n in params})


def unscale(df: DataFrame, params: Mapping[str, tuple[float, float]]) -> DataFrame:
    return df.withColumns({n: F.col(n).cast("double") * std + mean for n, (mean, std) in params.items()})


def sequence_runs(df: DataFrame, length: int = SEQUENCE_LENGTH, *, user: str = "user_id",
                  order: Sequence[str] = ("timestamp", "transaction_id"),
                  policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add `__pos`, the row's number in its user, and `__run`. Rows are grouped in runs of fixed size; a run
    also receives the last `length - 1` rows of the run before it, so no window is larger than a run."""
    back = length - 1
    numbered = running(df, [user], list(order), sums={"__pos": F.lit(1)}, policy=policy)
    own = F.floor(F.col("__pos") / RUN)
    runs = F.when(F.col("__pos") % RUN >= RUN - back, F.array(own, own + 1)).otherwise(F.array(own))
    return numbered.withColumn("__run", F.explode(runs))


def build_sequences(df: DataFrame, value: Column, length: int = SEQUENCE_LENGTH, *, user: str = "user_id",
                    order: Sequence[str] = ("timestamp", "transaction_id"),
                    policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add `sequence`, the user's last `length` values with the current one last, left-padded with
    null, and `mask`."""
    copies = sequence_runs(df.withColumn("__v", value), length, user=user, order=order, policy=policy)
    window = Window.partitionBy(user, "__run").orderBy("__pos").rowsBetween(1 - length, 0)
    seen = (copies.withColumn("__seen", F.collect_list(F.struct("__v")).over(window))
            .filter(F.floor(F.col("__pos") / RUN) == F.col("__run")))
    missing = F.lit(length) - F.size("__seen")
    values = F.transform("__seen", lambda s: s["__v"])
    # a null row, padded in front
    pad = F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: F.when(i < 0, F.col("__v")))
    return (seen.withColumn("sequence", F.concat(F.slice(pad, 1, missing), values))
            .withColumn("mask", F.transform(F.sequence(F.lit(1), F.lit(length)), lambda i: i > missing))
            .drop("__v", "__pos", "__run", "__seen"))


def time_order_check(df: DataFrame, sequence: Sequence[str], ts: str = "timestamp",
                     policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Rows out of chronological order when the table is read in `sequence`: count and first offender."""
    rows = materialise(df.select(*sequence, epoch_us(ts).alias("us")), "sequence")      # the probe reads it too
    seen = running(rows, [], list(sequence), maxes={"newest": F.col("us")}, policy=policy)
    late = F.col("us") < F.col("newest")
    return seen.agg(F.count("*").alias("n"), F.count_if(late).alias("out_of_order"),
                    F.min(F.when(late, F.col(sequence[0]))).alias("first_offender"),
                    (F.count_if(late) == 0).alias("chronological"))
