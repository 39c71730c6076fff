"""Profiles as of a cutoff, entity relations, and checks between two feature or score tables."""
from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import DAY_US, MICROS, at_least_zero, epoch_us
from paywarden.operators.features import (AGENT, DEVICE, INPUT_COLUMNS, MERCHANT, NO_HISTORY_S, PROVINCE,
                                          WALLET, _links, build_features)
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.session import materialise


def _before(tx: DataFrame, until: str | None) -> DataFrame:
    return tx if until is None else tx.filter(F.col("timestamp") < F.lit(until).cast("timestamp_ntz"))


def profile_links(tx: DataFrame, until: str | None = None) -> DataFrame:
    """Every (user, entity) relation with uses and first / last time. These are the user's sets of
    devices, provinces, wallets, agents and merchants as rows, so no set has to fit a record."""
    links = _links(_before(tx, until), DEVICE + PROVINCE + WALLET + AGENT + MERCHANT)
    return links.groupBy("user_id", "kind", "entity").agg(
        F.count("*").alias("uses"), F.min("ts_us").alias("first_us"), F.max("ts_us").alias("last_us"))


def profile_snapshot(tx: DataFrame, until: str | None = None) -> DataFrame:
    """Per-user counters and sums as of `until`, with the sizes of the user's entity sets."""
    past = _before(tx, until).withColumns({"us": epoch_us("timestamp"), "hour": F.hour("timestamp")})
    la = F.log1p("amount_usd")
    angle = 2 * F.pi() * F.col("hour") / 24
    topup = (F.col("tx_type") == "CARD_TOPUP") & (F.col("status") == "SUCCESS")
    at = F.when(topup, F.struct("us", "transaction_id"))
    state = past.groupBy("user_id").agg(
        F.count("*").alias("n"), F.sum(la).alias("log_amt_sum"), F.sum(la * la).alias("log_amt_sq"),
        F.sum("amount_usd").alias("amt_sum"), F.min("us").alias("first_us"), F.max("us").alias("last_us"),
        F.count_if(F.col("hour") <= 5).alias("night_count"),
        F.sum(F.sin(angle)).alias("hour_sin_sum"), F.sum(F.cos(angle)).alias("hour_cos_sum"),
        F.max(F.when(topup, F.col("us"))).alias("last_topup_us"),
        F.max_by("amount_usd", at).alias("last_topup_amt"))
    sizes = profile_links(tx, until).groupBy("user_id").agg(
        *[F.count_if(F.col("kind") == k).alias(name) for k, name in
          [(DEVICE, "n_devices"), (PROVINCE, "n_provinces"), (WALLET, "n_counterparties"),
           (AGENT, "n_agents"), (MERCHANT, "n_merchants")]])
    return state.join(sizes, "user_id")


def recent_rows(tx: DataFrame, until: str | None = None) -> DataFrame:
    """The rows a user's 7-day buffer holds: those within 7 days of the user's last transaction."""
    past = _before(tx, until).withColumn("us", epoch_us("timestamp"))
    last = past.groupBy("user_id").agg(F.max("us").alias("last_us"))
    return past.join(last, "user_id").filter(F.col("us") >= F.col("last_us") - 7 * DAY_US).drop("last_us")


def entity_snapshot(tx: DataFrame, until: str | None = None) -> DataFrame:
    """Users per device and wallet; per agent the users of the last 24 h of its activity."""
    links = _links(_before(tx, until), DEVICE + WALLET + AGENT)
    pairs = links.groupBy("kind", "entity", "user_id").agg(F.max("ts_us").alias("last_us"))
    agent = F.col("kind") == AGENT
    newest = (links.filter(agent).groupBy("entity").agg(F.max("ts_us").alias("newest_us"))
              .withColumn("kind", F.lit(AGENT)))
    return (pairs.join(newest, ["kind", "entity"], "left")
            .filter(~agent | (F.col("last_us") >= F.col("newest_us") - DAY_US))
            .select("kind", "entity", "user_id", "last_us"))


def parity_check(a: DataFrame, b: DataFrame, *, key: str = "transaction_id", value: str = "score",
                 tolerance: float = 1e-4) -> DataFrame:
    """Largest and mean absolute gap between two score tables, and the ids that only one of them has; ok when the
    largest gap is below tolerance and there are none of those."""
    gap = F.abs(F.col("a") - F.col("b"))
    both = a.select(key, F.col(value).alias("a"), F.lit(1).alias("in_a")).join(b.select(key, F.col(value).alias("b"), F.lit(1).alias("in_b")), key, "full")
    one_side = F.col("in_a").isNull() | F.col("in_b").isNull()
    return both.agg(F.count_if(~one_side).alias("n"), F.count_if(one_side).alias("n_one_side"), F.max(gap).alias("max_gap"), F.avg(gap).alias("mean_gap")).withColumn(
        "ok", F.coalesce(F.col("max_gap") < tolerance, F.lit(True)) & (F.col("n_one_side") == 0))


def arrival_gaps(tx: DataFrame, arrival: str, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Gaps in arrival order. A late row (older than one already seen) has gap 0, never a negative one."""
    rows = tx.select("transaction_id", "user_id", arrival, epoch_us("timestamp").alias("us"))
    seen = running(rows, ["user_id"], [arrival, "transaction_id"], policy=policy,
                   lasts={"prev": F.col("us")}, maxes={"newest": F.col("us")},
                   mins={"first": F.struct(arrival, "transaction_id", "us")})
    since = at_least_zero(F.col("us") - F.col("prev")) / MICROS
    age = at_least_zero(F.col("us") - F.col("first.us")) / DAY_US
    return seen.select(
        "transaction_id", "user_id",
        F.log1p(F.coalesce(since, F.lit(NO_HISTORY_S))).alias("log_secs_since_last_tx"),
        F.coalesce(F.log1p(age), F.lit(0.0)).alias("log_history_days"),
        F.coalesce(F.col("us") < F.col("newest"), F.lit(False)).alias("late"))


def apply_decisions(tx: DataFrame, decisions: DataFrame) -> DataFrame:
    """Status as the profile records it: a known status stays; where none is known a blocked transaction failed
    and any other succeeded."""
    blocked = F.col("action") == "BLOCK"
    return (tx.join(decisions.select("transaction_id", "action"), "transaction_id", "left")
            .withColumn("status", F.coalesce("status", F.when(blocked, "FAILED").otherwise("SUCCESS"))).drop("action"))


def incremental_features(batch: DataFrame, history: DataFrame, users: DataFrame, period_start: str,
                         **options) -> DataFrame:
    """Features of `batch` given the stored `history`: the rows of history that share a user, device,
    wallet or agent with the batch are replayed with it, so the values equal a full replay."""
    columns = [c for c in INPUT_COLUMNS]
    batch = materialise(batch.select(*columns), "batch")        # its keys and rows are read several times
    shared, touched = F.lit(False), history.select(*columns)
    for key in ("user_id", "device_id", "counterparty_id", "agent_id"):
        keys = batch.select(key).filter(F.col(key).isNotNull()).distinct().withColumn(f"__{key}", F.lit(True))
        touched, shared = touched.join(keys, key, "left"), shared | F.col(f"__{key}").isNotNull()
    touched = touched.filter(shared)
    ids = batch.select("transaction_id")
    needed = touched.dropDuplicates(["transaction_id"]).join(ids, "transaction_id", "left_anti")
    rows = needed.select(*columns).unionByName(batch.select(*columns))
    return build_features(rows, users, period_start, **options).join(ids, "transaction_id", "left_semi")
