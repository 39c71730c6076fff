"""Running totals per key that stay parallel when one key holds most of the rows.

A Spark window puts all rows of a key in one task. Here a key that is too large is cut into slices
along its order; each slice is a window of its own and receives the total of the earlier slices.

    rows ──► slice number per row (0 = key is not cut)
         ──► window inside (key, slice)
         ──► one total per (key, slice), prefix over slices, added back

The result does not depend on where the cuts fall, so they come from a bounded row sample.
"""
from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.session import materialise

SLICE = "__slice"


@dataclass(frozen=True)
class SkewPolicy:
    """When to cut a key. At most `max_slices` keys can each hold 1/`max_slices` of the rows, so the
    cut table and the slice totals have a few times `max_slices` rows at most and may be broadcast."""
    min_rows: int = 2_000_000        # a smaller key always fits one task
    max_slices: int = 32_768
    sample_per_slice: int = 32
    small_bytes: int = 64 << 20      # input files below this are not inspected at all


DEFAULT_POLICY = SkewPolicy()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files and local tables a plan reads, each counted as often as it is read."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return sum(int(leaves.apply(i).stats().sizeInBytes()) for i in range(leaves.size()))


def _key_hash(keys: Sequence[str]) -> Column:
    return F.xxhash64(*keys) if keys else F.lit(0).cast("long")


def slice_plan(df: DataFrame, keys: Sequence[str], order: Sequence[str],
               policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame | None:
    """Cut points (`__h`, `__cuts`) of the keys that are too large for one task, or None.

    A count, and a sample of about `sample_per_slice` rows per slice: a key with more sampled rows than
    that is too large, and its sampled rows give the cuts. The sample has at most `sample_per_slice *
    max_slices` rows, whatever the table holds.
    """
    if input_bytes(df) < policy.small_bytes:
        return None
    spark = df.sparkSession
    narrow = df.select(_key_hash(keys).alias("__h"), F.struct(*order).alias("__o"))
    total = narrow.count()
    target = max(policy.min_rows, -(-total // policy.max_slices))
    if total <= target:
        return None
    step, grain = policy.sample_per_slice, 1 << 30
    sampled = narrow.filter(F.pmod(F.xxhash64("__h", "__o"), F.lit(grain)) < max(1, step * grain // target))
    hot = [r["__h"] for r in sampled.groupBy("__h").count().filter(F.col("count") > step).select("__h").collect()]
    if not hot:
        return None
    hot_keys = spark.createDataFrame([(h,) for h in hot], "__h long")
    ordered = (sampled.join(F.broadcast(hot_keys), "__h", "left_semi")
               .groupBy("__h").agg(F.array_sort(F.collect_list("__o")).alias("__s")))
    # every step-th sampled row is a cut, so a slice holds about `target` rows
    cuts = ordered.select("__h", F.filter("__s", lambda _, i: i % step == step - 1).alias("__cuts"))
    rows = cuts.collect()            # about max_slices cut points in all
    return spark.createDataFrame(rows, cuts.schema)


def _slice_number(cuts: Column, value: Column) -> Column:
    """1 + number of cut points <= value, by binary search."""
    def halve(state: Column, _: Column) -> Column:
        middle = F.floor((state.lo + state.hi) / 2).cast("int")
        below = F.get(cuts, middle) <= value
        return (F.when(state.lo >= state.hi, state)
                .when(below, F.struct((middle + 1).alias("lo"), state.hi.alias("hi")))
                .otherwise(F.struct(state.lo.alias("lo"), middle.alias("hi"))))

    start = F.struct(F.lit(0).alias("lo"), F.size(cuts).alias("hi"))
    steps = F.sequence(F.lit(1), F.ceil(F.log2(F.size(cuts) + 1.0)).cast("int") + 1)
    return F.aggregate(steps, start, halve, lambda state: state.lo + 1)


def with_slices(df: DataFrame, keys: Sequence[str], order: Sequence[str],
                plan: DataFrame | None) -> DataFrame:
    """Add `__slice`: 0 for keys that are not cut."""
    if plan is None:
        return df.withColumn(SLICE, F.lit(0))
    joined = df.withColumn("__h", _key_hash(keys)).join(F.broadcast(plan), "__h", "left")
    number = F.when(F.col("__cuts").isNull(), F.lit(0)).otherwise(
        _slice_number(F.col("__cuts"), F.struct(*order)))
    return joined.withColumn(SLICE, number).drop("__h", "__cuts")


def _zero(kind: T.DataType) -> Column:
    return F.lit(0).cast(kind)


def running(df: DataFrame, keys: Sequence[str], order: Sequence[str], *,
            sums: Mapping[str, Column] | None = None, lasts: Mapping[str, Column] | None = None,
            mins: Mapping[str, Column] | None = None, maxes: Mapping[str, Column] | None = None,
            inclusive: bool = False, cut_order: Sequence[str] | None = None,
            plan: DataFrame | None | str = "auto", policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per key, over the rows before the current one in `order` (or up to it with `inclusive`):
    running sums, last non-null values, minima and maxima.

    `order` must be total inside a key wherever the outcome depends on it. `plan` takes a prepared
    slice plan; a `__slice` column already present is reused.
    """
    sums, lasts, mins, maxes = sums or {}, lasts or {}, mins or {}, maxes or {}
    cut_order = cut_order or order
    sliced = SLICE in df.columns
    keep = list(df.columns)
    work = df.select("*", *[c.alias(f"__m_{name}") for name, c in
                            [*sums.items(), *lasts.items(), *mins.items(), *maxes.items()]])
    if not sliced:
        if isinstance(plan, str):
            plan = slice_plan(df, keys, cut_order, policy)
        work = with_slices(work, keys, cut_order, plan)
    cut = plan is not None and not isinstance(plan, str)
    if cut:
        work = materialise(work, "slices")

    by = [*keys, SLICE] if cut else list(keys)
    last_row = 0 if inclusive else -1
    window = Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, last_row)
    m = {name: f"__m_{name}" for name in [*sums, *lasts, *mins, *maxes]}
    local = {n: F.sum(m[n]).over(window) for n in sums}
    local |= {n: F.last(m[n], ignorenulls=True).over(window) for n in lasts}
    local |= {n: F.min(m[n]).over(window) for n in mins}
    local |= {n: F.max(m[n]).over(window) for n in maxes}
    kinds = {f.name: f.dataType for f in work.schema.fields}
    out_kind = {n: (T.LongType() if isinstance(kinds[m[n]], T.IntegralType) else kinds[m[n]]) for n in sums}

    if not cut:
        done = {n: F.coalesce(c, _zero(out_kind[n])) if n in sums else c for n, c in local.items()}
        return work.select(*[c for c in keep], *[c.alias(n) for n, c in done.items()])

    # totals of the slices of cut keys: a few times max_slices rows at most
    at = F.struct(*order)
    totals = work.filter(F.col(SLICE) > 0).groupBy(*keys, SLICE).agg(
        *[F.sum(m[n]).alias(n) for n in sums],
        *[F.max_by(m[n], F.when(F.col(m[n]).isNotNull(), at)).alias(n) for n in lasts],
        *[F.min(m[n]).alias(n) for n in mins], *[F.max(m[n]).alias(n) for n in maxes])
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carry = totals.select(
        *[F.col(k).alias(f"__k_{k}") for k in keys], F.col(SLICE).alias("__k_slice"),
        *[F.sum(n).over(earlier).alias(f"__c_{n}") for n in sums],
        *[F.last(n, ignorenulls=True).over(earlier).alias(f"__c_{n}") for n in lasts],
        *[F.min(n).over(earlier).alias(f"__c_{n}") for n in mins],
        *[F.max(n).over(earlier).alias(f"__c_{n}") for n in maxes])
    inner = work.select("*", *[c.alias(f"__l_{n}") for n, c in local.items()])
    match = F.col(SLICE) == F.col("__k_slice")
    for k in keys:
        match = match & F.col(k).eqNullSafe(F.col(f"__k_{k}"))
    joined = inner.join(F.broadcast(carry), match, "left")

    def merged(n: str) -> Column:
        before, inside = F.col(f"__c_{n}"), F.col(f"__l_{n}")
        if n in sums:
            zero = _zero(out_kind[n])
            return F.coalesce(before, zero) + F.coalesce(inside, zero)
        if n in lasts:
            return F.coalesce(inside, before)
        return F.least(before, inside) if n in mins else F.greatest(before, inside)

    return joined.select(*keep, *[merged(n).alias(n) for n in m])
