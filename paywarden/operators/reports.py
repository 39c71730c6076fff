"""Operational reports on the scored fact. `now` is always a parameter, so a report repeats."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import position
from paywarden.plans.quantiles import exact_quantiles
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy
from paywarden.schema import RISK_LEVELS

# --- fixed values -------------------------------------------------------------------------------
DIMENSIONS = ["channel", "operator", "tx_type", "province", "access_channel"]
BUCKET_ORIGIN_S = 946_857_600        # buckets are aligned to Monday 2000-01-03
SUMMARY = ["transaction_id", "tx_time", "scored_at", "user_id", "channel", "operator", "tx_type",
           "access_channel", "amount_usd", "province", "fraud_probability", "risk_level", "action", "reason",
           "latency_ms", "label"]
# -------------------------------------------------------------------------------------------------


def since(now: str, minutes: int) -> Column:
    return F.lit(now).cast("timestamp_ntz") - F.expr(f"INTERVAL '{minutes}' MINUTE")


def recent(fact: DataFrame, now: str, minutes: int, ts: str = "scored_at") -> DataFrame:
    return fact.filter(F.col(ts) >= since(now, minutes))


def _sum_if(condition: Column, value: str = "amount_usd") -> Column:
    return F.coalesce(F.sum(F.when(condition, F.col(value))), F.lit(0.0))


def status_counts(cases: DataFrame) -> Column:
    """Map from status to number of cases, as a value for one-row results."""
    pairs = F.array_sort(F.collect_list(F.struct("status", "n")))
    return F.lit(None).cast("map<string,bigint>") if cases is None else cases_by_status(cases).agg(F.map_from_entries(pairs)).scalar()


def kpis(fact: DataFrame, now: str, minutes: int = 60, policy: SkewPolicy = DEFAULT_POLICY, cases: DataFrame | None = None) -> DataFrame:
    """One row: volume, counts and amounts per action, latency, degraded scores, alert rate, and the number of
    cases by status where `cases` is given."""
    rows = recent(fact, now, minutes)
    action = F.col("action")
    p95 = exact_quantiles(rows.select("latency_ms"), "latency_ms", {"p95": 0.95}, policy=policy).scalar()
    totals = rows.agg(
        F.count("*").alias("volume"), F.count_if(action == "APPROVE").alias("approved"),
        F.count_if(action == "VERIFY").alias("verified"), F.count_if(action == "BLOCK").alias("blocked"),
        F.coalesce(F.sum("amount_usd"), F.lit(0.0)).alias("amount_usd"),
        _sum_if(action == "BLOCK").alias("amount_blocked_usd"),
        _sum_if(action == "VERIFY").alias("amount_verified_usd"),
        F.coalesce(F.avg("latency_ms"), F.lit(0.0)).alias("latency_avg_ms"),
        F.count_if(F.col("degraded")).alias("degraded"))
    alerts = F.col("verified") + F.col("blocked")
    return totals.withColumns({
        "latency_p95_ms": F.coalesce(p95, F.lit(0.0)),
        "alert_rate": F.coalesce(F.try_divide(alerts, F.col("volume")), F.lit(0.0)),
        "window_minutes": F.lit(minutes), "cases": status_counts(cases)})


def cases_by_status(cases: DataFrame) -> DataFrame:
    return cases.groupBy("status").agg(F.count("*").alias("n"))


def timeseries(fact: DataFrame, now: str, minutes: int = 60, bucket_seconds: int = 60) -> DataFrame:
    """Volume, alerts and averages per time bucket."""
    offset = BUCKET_ORIGIN_S % bucket_seconds
    bucket = F.window("scored_at", f"{bucket_seconds} seconds", startTime=f"{offset} seconds").start
    return recent(fact, now, minutes).groupBy(bucket.alias("bucket")).agg(
        F.count("*").alias("volume"), F.count_if(F.col("action") == "VERIFY").alias("verified"),
        F.count_if(F.col("action") == "BLOCK").alias("blocked"),
        F.avg("fraud_probability").alias("avg_probability"), F.avg("latency_ms").alias("latency_avg_ms"))


def breakdown(fact: DataFrame, dimension: str, now: str, minutes: int = 1440) -> DataFrame:
    """Volume, alerts and blocked amount per value of one of five dimensions."""
    if dimension not in DIMENSIONS:
        raise ValueError(f"dimension must be one of {DIMENSIONS}")
    blocked = F.col("action") == "BLOCK"
    return (recent(fact, now, minutes).groupBy(F.coalesce(F.col(dimension), F.lit("N/A")).alias("key")).agg(
        F.count("*").alias("volume"), F.count_if(F.col("action") != "APPROVE").alias("alerts"),
        F.count_if(blocked).alias("blocked"), F.avg("fraud_probability").alias("avg_probability"),
        _sum_if(blocked).alias("amount_blocked_usd")).orderBy(F.desc("volume"), "key"))


def model_performance(fact: DataFrame) -> DataFrame:
    """Confirmed frauds and false positives per action and risk level; the total row (action null)
    carries the observed precision."""
    counts = (fact.filter(F.col("label").isNotNull())
              .groupingSets([["action", "risk_level"], []], "action", "risk_level")
              .agg(F.count_if(F.col("label") == 1).alias("confirmed_fraud"),
                   F.count_if(F.col("label") == 0).alias("false_positive")))
    labeled = F.col("confirmed_fraud") + F.col("false_positive")
    return counts.withColumns({
        "labeled": labeled,
        "observed_precision": F.when(F.col("action").isNull(), F.try_divide(F.col("confirmed_fraud"), labeled))})


def top_risky_users(fact: DataFrame, now: str, minutes: int = 1440, limit: int = 10) -> DataFrame:
    return (recent(fact, now, minutes).filter(F.col("action") != "APPROVE").groupBy("user_id").agg(
        F.count("*").alias("alerts"), F.max("fraud_probability").alias("max_probability"),
        F.sum("amount_usd").alias("amount_usd"))
        .orderBy(F.desc("alerts"), F.desc("max_probability"), "user_id").limit(limit))


def filter_transactions(fact: DataFrame, *, channel: str | None = None, action: str | None = None,
                        risk_level: str | None = None, operator: str | None = None, user_id: str | None = None,
                        min_probability: float | None = None, labeled: bool | None = None,
                        alerts_only: bool = False, search: str | None = None) -> DataFrame:
    equal = {"channel": channel, "action": action, "risk_level": risk_level, "operator": operator,
             "user_id": user_id}
    for name, value in equal.items():
        if value:
            fact = fact.filter(F.col(name) == value)
    if alerts_only:
        fact = fact.filter(F.col("action") != "APPROVE")
    if search:
        fact = fact.filter((F.col("transaction_id") == search) | (F.col("user_id") == search))
    if min_probability is not None:
        fact = fact.filter(F.col("fraud_probability") >= min_probability)
    if labeled is not None:
        fact = fact.filter(F.col("label").isNotNull() if labeled else F.col("label").isNull())
    return fact


def page_of(df: DataFrame, order: Sequence[Column], page: int, size: int) -> DataFrame:
    return df.orderBy(*order).offset((page - 1) * size).limit(size)


def list_transactions(fact: DataFrame, page: int = 1, size: int = 50, **filters) -> DataFrame:
    """One page, newest first, with the number of all matching rows in `total`."""
    matching = filter_transactions(fact, **filters)
    rows = page_of(matching.select(*SUMMARY), [F.desc("scored_at"), F.col("transaction_id")], page, size)
    return rows.withColumn("total", F.lit(0) + matching.agg(F.count("*")).scalar())


def get_transaction(fact: DataFrame, transaction_id: str) -> DataFrame:
    return fact.filter(F.col("transaction_id") == transaction_id)


def user_history(fact: DataFrame, user_id: str, limit: int = 30) -> DataFrame:
    return (fact.filter(F.col("user_id") == user_id).select(*SUMMARY)
            .orderBy(F.desc("tx_time"), "transaction_id").limit(limit))


def case_queue(cases: DataFrame, page: int = 1, size: int = 50, status: str | None = None,
               risk_level: str | None = None, assigned_to: int | None = None) -> DataFrame:
    """One page of the queue: open first, then by risk, then by amount; `total` counts the filtered cases,
    `counts` all of them by status."""
    counts = status_counts(cases)
    for name, value in {"status": status, "risk_level": risk_level, "assigned_to": assigned_to}.items():
        if value is not None:
            cases = cases.filter(F.col(name) == value)
    order = [F.col("status") != "OUVERT", position(RISK_LEVELS, F.col("risk_level")), F.desc("amount_usd"),
             F.col("transaction_id")]
    return page_of(cases, order, page, size).withColumns({
        "total": F.lit(0) + cases.agg(F.count("*")).scalar(), "counts": counts})


def alert_rate_by_type(fact: DataFrame, now: str, minutes: int = 1440) -> DataFrame:
    """Approved, alerts and alert rate per operation type."""
    return (recent(fact, now, minutes).groupBy("tx_type").agg(
        F.count("*").alias("volume"), F.count_if(F.col("action") == "VERIFY").alias("verified"),
        F.count_if(F.col("action") == "BLOCK").alias("blocked"))
        .withColumns({"approved": F.col("volume") - F.col("verified") - F.col("blocked"),
                      "alert_rate": (F.col("verified") + F.col("blocked")) / F.col("volume")}))


def list_audit(log: DataFrame, actor: str | None = None, action: str | None = None, page: int = 1,
               size: int = 50) -> DataFrame:
    for name, value in {"actor": actor, "action": action}.items():
        if value:
            log = log.filter(F.col(name) == value)
    return page_of(log, [F.desc("id")], page, size).withColumn(
        "total", F.lit(0) + log.agg(F.count("*")).scalar())


def dataset_profile(tx: DataFrame) -> DataFrame:
    """(measure, key, value) rows: totals, fraud rates, counts and distinct episodes per type, failure
    rates, operation mix."""
    fraud = F.col("is_fraud") == 1
    failed = (F.col("status") != "SUCCESS").cast("double")

    def rows(df: DataFrame, key: str | None, **measures: Column) -> DataFrame:
        grouped = df.groupBy(F.col(key).alias("key")) if key else df.groupBy(F.lit("all").alias("key"))
        wide = grouped.agg(*[c.cast("double").alias(n) for n, c in measures.items()])
        return wide.unpivot(["key"], list(measures), "measure", "value")

    frauds = tx.filter(fraud)
    parts = [
        rows(tx, None, n_transactions=F.count("*"), fraud_rate=F.round(F.avg("is_fraud"), 5),
             failure_rate_legit=F.round(F.avg(F.when(~fraud, failed)), 5),
             failure_rate_fraud=F.round(F.avg(F.when(fraud, failed)), 5),
             first_us=F.min(F.unix_micros(F.col("timestamp").cast("timestamp"))),
             last_us=F.max(F.unix_micros(F.col("timestamp").cast("timestamp")))),
        rows(tx, "channel", channel_n=F.count("*"), channel_fraud_rate=F.round(F.avg("is_fraud"), 5)),
        rows(frauds, "fraud_type", frauds=F.count("*"), episodes=F.count_distinct("fraud_episode_id")),
        rows(tx, "tx_type", operations=F.count("*"))]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out
