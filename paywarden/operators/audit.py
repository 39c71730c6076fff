"""The tamper-evident audit log: one schema, no repeats, hash chains and their verification."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from functools import reduce
from operator import and_

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running

GENESIS = "0" * 64                       # fixed value


def normalise(audit: DataFrame, feedback: DataFrame) -> DataFrame:
    """Audit events and analyst verdicts in one schema. A missing event id is derived from the content;
    details hold JSON values."""
    columns = ["event_id", "ts", "actor", "action", "entity", "entity_id"]
    derived = F.sha2(F.to_json(F.struct(*columns[1:], "details")), 256)
    details = F.coalesce(F.col("details"), F.create_map().cast("map<string,string>"))
    logged = audit.select(F.coalesce("event_id", derived).alias("event_id"), *columns[1:], details.alias("details"))
    label, case = F.col("label").cast("string"), F.col("case_id").cast("string")
    verdicts = feedback.select(
        F.coalesce("event_id", F.concat_ws("-", F.lit("fb"), case, label)).alias("event_id"), "ts",
        F.col("analyst").alias("actor"), F.lit("VERDICT_ANALYSTE").alias("action"),
        F.lit("transaction").alias("entity"), F.col("transaction_id").alias("entity_id"),
        F.create_map(F.lit("label"), label, F.lit("case_id"), case).alias("details"))
    return logged.unionByName(verdicts)


def drop_repeats(events: DataFrame, log: DataFrame | None = None, order: str = "ts") -> DataFrame:
    """One row per event id, the earliest (of several at that time the one with the smallest content), without
    those already in `log`."""
    columns = events.columns
    content = F.to_json(F.struct(*columns))
    first = events.groupBy("event_id").agg(F.min_by(F.struct(*columns), F.struct(F.col(order), content)).alias("e")).select("e.*")
    if log is None:
        return first
    return first.join(log.select("event_id").distinct(), "event_id", "left_anti")


def _json(value: Column) -> Column:
    """JSON text of a string column."""
    listed = F.to_json(F.array(value))
    return listed.substr(F.lit(2), F.length(listed) - 2)


def _iso(ts: Column) -> Column:
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(F.lit("")),
                    F.lit("+00:00"))


def _around_prev() -> tuple[Column, Column]:
    """The canonical text of an entry before and after the previous hash (keys sorted, no spaces)."""
    pairs = F.transform(F.array_sort(F.map_keys("details")),
                        lambda k: F.concat(_json(k), F.lit(":"), F.element_at("details", k)))
    head = F.concat(F.lit('{"action":'), _json(F.col("action")), F.lit(',"actor":'), _json(F.col("actor")),
                    F.lit(',"details":{'), F.concat_ws(",", pairs), F.lit('},"entity":'), _json(F.col("entity")),
                    F.lit(',"entity_id":'), _json(F.col("entity_id")), F.lit(',"prev":"'))
    return head, F.concat(F.lit('","ts":"'), _iso(F.col("ts")), F.lit('"}'))


def entry_hash(prev: Column) -> Column:
    head, tail = _around_prev()
    return F.sha2(F.concat(head, prev, tail), 256)


def _fold(key: Sequence[str]):
    """Chain the rows of a sorted partition from `__start`; only the last digest is kept between batches."""
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        chain = prev = None
        for batch in batches:
            previous, hashes = [], []
            keys = batch[list(key)].itertuples(index=False, name=None) if key else [()] * len(batch)
            for row, start, head, tail in zip(keys, batch["__start"], batch["__head"], batch["__tail"]):
                if row != chain:
                    chain, prev = row, start
                previous.append(prev)
                prev = hashlib.sha256(f"{head}{prev}{tail}".encode()).hexdigest()
                hashes.append(prev)
            yield batch.drop(columns=["__head", "__tail", "__start"]).assign(prev_hash=previous, hash=hashes)
    return run


def hash_chain(events: DataFrame, key: Sequence[str] = (), order: Sequence[str] = ("ts", "event_id"),
               tips: DataFrame | None = None) -> DataFrame:
    """Add `prev_hash` and `hash`: one chain per key, of any length.

    Every digest depends on the one before, so one task walks a chain, row by row and in constant memory;
    the key decides how much runs in parallel. Choose one that bounds a chain (a day, an actor's day), and link
    the chains with `chain_tips`. `tips` (key columns, `tip`) continues stored chains from their last hash."""
    key = list(key)
    head, tail = _around_prev()
    ready = events.withColumns({"__head": head, "__tail": tail})
    if tips is None:
        ready = ready.withColumn("__start", F.lit(GENESIS))
    elif key:
        stored = tips.select(*[F.col(k).alias(f"__k_{k}") for k in key], F.col("tip").alias("__tip"))
        same = reduce(and_, [F.col(k).eqNullSafe(F.col(f"__k_{k}")) for k in key])
        ready = ready.join(stored, same, "left").withColumn("__start", F.coalesce("__tip", F.lit(GENESIS))).drop("__tip", *[f"__k_{k}" for k in key])
    else:
        last = tips.select("tip").first()
        ready = ready.withColumn("__start", F.lit(last["tip"] if last else GENESIS))
    ordered = (ready.repartition(*key) if key else ready.repartition(1)).sortWithinPartitions(*key, *order)
    plain = [f for f in ready.schema.fields if f.name not in ("__head", "__tail", "__start", "details")]
    # the map travels as text through the fold
    schema = T.StructType([*plain, *[T.StructField(n, T.StringType()) for n in ("prev_hash", "hash", "details")]])
    folded = ordered.withColumn("details", F.to_json("details")).mapInPandas(lambda it: (b[schema.names] for b in _fold(key)(it)), schema)
    return folded.withColumn("details", F.from_json("details", "map<string,string>"))


def seal_chains(chain: DataFrame, key: Sequence[str] = (), order: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Last hash (`tip`) and length of every chain: where the next batch goes on, and what to keep elsewhere so
    that cutting off the end of a chain shows."""
    return chain.groupBy(*key).agg(F.max_by("hash", F.struct(*order)).alias("tip"), F.count("*").alias("n"))


def chain_tips(tips: DataFrame, key: Sequence[str], start: str = GENESIS) -> DataFrame:
    """The tips chained in key order (`prev_link`, `link`), so that a lost chain shows. One row per chain is
    walked in one task, say one per day."""
    key = list(key)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        prev = start
        for batch in batches:
            before, links = [], []
            for tip, n in zip(batch["tip"], batch["n"]):
                before.append(prev)
                prev = hashlib.sha256(f"{prev}{tip}{n}".encode()).hexdigest()
                links.append(prev)
            yield batch.assign(prev_link=before, link=links)

    rows = tips.select(*key, "tip", "n").repartition(1).sortWithinPartitions(*key)
    return rows.mapInPandas(run, T.StructType([*rows.schema.fields, T.StructField("prev_link", T.StringType()), T.StructField("link", T.StringType())]))


def verify_chain(log: DataFrame, key: Sequence[str] = (), order: str = "id",
                 policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per chain: valid, entries before the first break, and where it breaks. All rows are checked in
    parallel: each digest from its own row, each link from the row before."""
    key = list(key)
    linked = running(log, key, [order], lasts={"__before": F.col("hash")}, policy=policy)
    broken = (F.col("prev_hash") != F.coalesce("__before", F.lit(GENESIS))) | (F.col("hash") != entry_hash(F.col("prev_hash")))
    checked = running(linked.select(*key, order, F.coalesce(broken, F.lit(True)).alias("__bad")), key, [order],
                      sums={"__bad_upto": F.col("__bad").cast("int")}, inclusive=True, policy=policy)
    return checked.groupBy(*key).agg(
        (F.max("__bad_upto") == 0).alias("valid"), F.count_if(F.col("__bad_upto") == 0).alias("checked"),
        F.min(F.when(F.col("__bad"), F.col(order))).alias("broken_at_id"))


def changed_entries(before: DataFrame, after: DataFrame, key: str = "id") -> DataFrame:
    """Entries updated or deleted between two snapshots of an append-only table."""
    columns = [c for c in before.columns if c != key]
    digest = F.xxhash64(*[F.to_json(F.struct(F.col(c))) for c in columns])
    a = before.select(key, digest.alias("__a"))
    b = after.select(key, digest.alias("__b"))
    both = a.join(b, key, "left")
    change = F.when(F.col("__b").isNull(), "DELETE").when(F.col("__a") != F.col("__b"), "UPDATE")
    return both.select(key, change.alias("change")).filter(F.col("change").isNotNull())
