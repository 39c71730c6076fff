"""Behavioural features: every transaction against the strict past of its user, device,
counterparty and agent.

The past of a row is everything before it in (time, transaction id). Counts inside a moving window
are a running sum over all earlier rows less one over the rows that have left the window, so a row
costs the same whatever the window holds, and no key, however large, has to fit one task (see
plans.scan; only for users that are cut do departures become rows of their own).

The columns read are written once. Three scans, no join between transactions:

    links    one row per (transaction, entity it touches)       key: user + entity
    crowd    users seen at a device / wallet / agent             key: entity
    history  the user's own past, with the crowds merged         key: user
"""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from paywarden.functions.columns import DAY_US, HOUR_US, MICROS, at_least_zero, clip, epoch_us, flag
from paywarden.plans.scan import DEFAULT_POLICY, SLICE, SkewPolicy, running, slice_plan, with_slices
from paywarden.schema import (DEBIT_TYPES, DEFAULT_PROFILE, HIGH_RISK_CATEGORIES, HIDDEN_LABELS,
                              HOME_COUNTRY, P2P_TYPES, TX_TYPES)
from paywarden.session import materialise

# --- fixed values: names and order of the features ------------------------------------------------
FEATURE_GROUPS = {
    "amount": ["log_amount_usd", "amount_zscore_user", "amount_ratio_user_mean", "amount_to_balance",
               "is_near_full_drain", "amount_to_kyc_limit", "log_balance_before"],
    "velocity": ["tx_count_1h", "tx_count_24h", "tx_count_7d", "debit_count_1h", "log_debit_sum_24h",
                 "log_secs_since_last_tx", "failed_count_24h"],
    "device": ["is_new_device", "log_device_prior_uses", "n_devices_user", "device_n_users",
               "is_smartphone", "access_app", "access_ussd", "access_agent"],
    "location": ["is_foreign_ip", "is_new_province", "is_away_from_home"],
    "counterparty": ["is_new_counterparty", "counterparty_n_users", "is_new_agent", "agent_n_users_24h",
                     "is_new_merchant", "is_high_risk_merchant", "is_foreign_merchant"],
    "temporal": ["hour_sin", "hour_cos", "is_night", "user_night_ratio", "night_unusual",
                 "hour_deviation_user", "is_weekend", "is_month_end", "log_history_days",
                 "log_user_tx_count"],
    "cross_channel": ["is_card", "log_mins_since_topup", "purchase_to_topup_ratio"],
    "kyc_profile": ["kyc_level", "log_account_age_days", "log_monthly_income", "has_visa_virtual"],
    "tx_type": [f"type_{t}" for t in TX_TYPES],
}
META_COLUMNS = ["transaction_id", "timestamp", "user_id", "channel", "tx_type", "amount_usd",
                "is_fraud", "fraud_type"]
NO_HISTORY_S = 30 * 86_400.0
# --------------------------------------------------------------------------------------------------
FEATURE_NAMES = [name for group in FEATURE_GROUPS.values() for name in group]

INPUT_COLUMNS = ["transaction_id", "timestamp", "user_id", "channel", "tx_type", "access_channel",
                 "amount_usd", "balance_before_usd", "status", "counterparty_id", "merchant_id",
                 "merchant_category", "merchant_country", "agent_id", "device_id", "device_type",
                 "ip_country", "location_province"]

DEVICE, PROVINCE, WALLET, AGENT, MERCHANT = "D", "P", "C", "A", "M"
# the features that read earlier uses of an entity by the user, and those that read its crowd
USES = {DEVICE: {"is_new_device", "log_device_prior_uses", "n_devices_user"}, WALLET: {"is_new_counterparty"}, AGENT: {"is_new_agent"}}
CROWDS = {DEVICE: "device_n_users", WALLET: "counterparty_n_users", AGENT: "agent_n_users_24h"}
CENTS = 1_000_000                    # window sums of money run on integers: what enters leaves exactly


def feature_names(*groups: str) -> list[str]:
    """Feature names of the given families, all without arguments."""
    unknown = set(groups) - set(FEATURE_GROUPS)
    if unknown:
        raise ValueError(f"unknown feature families: {sorted(unknown)}")
    return [n for g in (groups or FEATURE_GROUPS) for n in FEATURE_GROUPS[g]]


def leakage_guard(columns: list[str]) -> None:
    """Refuse hidden labels among model inputs."""
    leaked = sorted(set(columns) & set(HIDDEN_LABELS))
    if leaked:
        raise ValueError(f"labels among the features: {leaked}")


def feature_input(tx: DataFrame) -> DataFrame:
    """Add the time parts the features read: ts_us, hour, weekday (Monday 0), day of month."""
    return tx.withColumns({"ts_us": epoch_us("timestamp"), "hour": F.hour("timestamp"),
                           "weekday": F.weekday("timestamp"), "day": F.dayofmonth("timestamp")})


def _links(tx: DataFrame, kinds: str) -> DataFrame:
    """(kind, entity, user_id, ts_us, transaction_id), one row per entity a transaction touches. An absent device
    or province is an entity like any other; other absent entities aren't touched."""
    entity = {
        DEVICE: F.col("device_id"), PROVINCE: F.col("location_province"),
        WALLET: F.when(F.col("tx_type").isin(P2P_TYPES), F.col("counterparty_id")),
        AGENT: F.col("agent_id"), MERCHANT: F.col("merchant_id")}
    pairs = F.array(*[F.struct(F.lit(k).alias("kind"), entity[k].alias("entity")) for k in kinds])
    return (tx.select("user_id", epoch_us("timestamp").alias("ts_us"), "transaction_id",
                      F.inline(F.filter(pairs, lambda p: p.entity.isNotNull() | p.kind.isin(DEVICE, PROVINCE)))))


def _prior_uses(links: DataFrame, policy: SkewPolicy, plan: DataFrame | None | str = "auto") -> DataFrame:
    """Earlier uses of the entity by the same user, and the time of the latest."""
    return running(links, ["kind", "entity", "user_id"], ["ts_us", "transaction_id"],
                   sums={"prior": F.lit(1)}, lasts={"prev_us": F.col("ts_us")}, plan=plan, policy=policy)


def _crowd(links: DataFrame, source: DataFrame, policy: SkewPolicy) -> DataFrame:
    """Add `others`: distinct other users seen earlier at the device or wallet, or at the agent within
    the last 24 hours.

    A user arrives with the first link (at an agent: the first after more than 24 h of absence). At an
    agent every link also departs 24 h later unless the user came back before that.
    """
    recent = F.coalesce(F.col("ts_us") - F.col("prev_us") <= DAY_US, F.lit(False))
    known = F.when(F.col("kind") == AGENT, recent).otherwise(F.col("prior") > 0)
    base = links.select("kind", "entity", "user_id", "ts_us", "transaction_id", "prior",
                        known.alias("known"), "prev_us")

    def event(at: Column, tie: Column, delta: Column, row: bool) -> Column:
        return F.struct(at.alias("at"), tie.alias("tie"), delta.cast("long").alias("delta"),
                        F.lit(row).alias("is_row"))

    none = F.lit("")
    arrive = event(F.col("ts_us"), F.col("transaction_id"), F.when(F.col("known"), 0).otherwise(1), True)
    leave = event(F.col("ts_us") + DAY_US + 1, none, F.lit(-1), False)
    stay = event(F.col("prev_us") + DAY_US + 1, none, F.lit(1), False)
    events = (F.when(F.col("kind") != AGENT, F.array(arrive))
              .when(F.col("known"), F.array(arrive, leave, stay)).otherwise(F.array(arrive, leave)))
    plan = slice_plan(source.select("kind", "entity", F.col("ts_us").alias("at"),
                                    F.col("transaction_id").alias("tie")),
                      ["kind", "entity"], ["at", "tie"], policy)
    moved = base.select("kind", "entity", "user_id", "ts_us", "transaction_id", "prior", "known",
                        F.inline(events))
    seen = running(moved, ["kind", "entity"], ["at", "tie"], sums={"seen": F.col("delta")}, plan=plan,
                   policy=policy).filter("is_row")
    return seen.select("kind", "user_id", "ts_us", "transaction_id", "prior",
                       (F.col("seen") - F.col("known").cast("long")).alias("others"))


def _departed(past: DataFrame, plan: DataFrame | None) -> DataFrame:
    """Less what has left the moving windows, by sums up to the row at which each window begins; a cut user's
    departures are rows already."""
    by = ["user_id"] if plan is None else ["user_id", SLICE]

    def before(back: int) -> WindowSpec:
        return Window.partitionBy(*by).orderBy("at").rangeBetween(Window.unboundedPreceding, -back - 1)

    whole = F.col(SLICE) == 0
    return past.withColumns({
        f"past_{c}": F.col(f"past_{c}") - F.when(whole, F.coalesce(F.sum(c).over(before(back)), F.lit(0))).otherwise(0)
        for c, back in [("c1h", HOUR_US), ("d1h", HOUR_US), ("c24h", DAY_US), ("s24h", DAY_US), ("f24h", DAY_US), ("c7d", 7 * DAY_US)]})


def _history(tx: DataFrame, links: DataFrame, extra: list[str], policy: SkewPolicy, plan: DataFrame | None) -> DataFrame:
    """One row per transaction: its own columns, the user's running past and the link results."""
    payload_cols = [*INPUT_COLUMNS, *extra]
    debit = F.col("tx_type").isin(DEBIT_TYPES)
    cents = F.round(F.col("amount_usd") * CENTS).cast("long")
    debit_1, debit_sum = debit.cast("long"), F.when(debit, cents).otherwise(F.lit(0).cast("long"))
    failed = F.coalesce(F.col("status") != "SUCCESS", F.lit(True)).cast("long")
    zero = F.lit(0).cast("long")
    payload = F.struct(*payload_cols)

    def event(at: Column, tie: Column, rank: int, body: Column, **delta: Column) -> Column:
        names = ["c1h", "d1h", "c24h", "s24h", "f24h", "c7d"]
        return F.struct(at.alias("at"), tie.alias("tie"), F.lit(rank).alias("rank"),
                        *[delta.get(n, zero).alias(n) for n in names], body.alias("tx"))

    one, ts = F.lit(1).cast("long"), F.col("ts_us")
    nothing = F.lit(None).cast(tx.select(payload.alias("p")).schema["p"].dataType)
    arrive = event(ts, F.col("transaction_id"), 2, payload, c1h=one, d1h=debit_1, c24h=one,
                   s24h=debit_sum, f24h=failed, c7d=one)
    gone_1h = event(ts + HOUR_US + 1, F.lit(""), 0, nothing, c1h=-one, d1h=-debit_1)
    gone_24h = event(ts + DAY_US + 1, F.lit(""), 0, nothing, c24h=-one, s24h=-debit_sum, f24h=-failed)
    gone_7d = event(ts + 7 * DAY_US + 1, F.lit(""), 0, nothing, c7d=-one)
    known = with_slices(tx.withColumn("ts_us", epoch_us("timestamp")).withColumns({"at": F.col("ts_us"), "tie": F.col("transaction_id")}),
                        ["user_id"], ["at", "tie"], plan)
    arrived = arrive if plan is None else F.explode(
        F.when(F.col(SLICE) == 0, F.array(arrive)).otherwise(F.array(arrive, gone_1h, gone_24h, gone_7d)))
    moved = known.select("user_id", arrived.alias("e")).select("user_id", "e.*")
    linked = links.select("user_id", F.col("ts_us").alias("at"), F.col("transaction_id").alias("tie"),
                          F.lit(1).alias("rank"), "kind", "prior", "others")
    events = moved.unionByName(linked, allowMissingColumns=True)
    events = with_slices(events, ["user_id"], ["at", "tie"], plan)
    order = ["at", "tie", "rank"]

    is_tx = F.col("rank") == 2
    amount, la = F.col("tx.amount_usd"), F.log1p("tx.amount_usd")
    hour = F.hour("tx.timestamp")
    angle = 2 * F.pi() * hour / 24
    topup = is_tx & (F.col("tx.tx_type") == "CARD_TOPUP") & (F.col("tx.status") == "SUCCESS")
    # the link rows of a transaction come right before it
    merged = [DEVICE, WALLET, AGENT] if plan is None else [DEVICE, PROVINCE, WALLET, AGENT, MERCHANT]
    link = {f"link_{k}": F.when(F.col("kind") == k, F.struct("tie", "prior", "others")) for k in merged}
    new_device = (F.col("kind") == DEVICE) & (F.col("prior") == 0)
    past = running(
        events, ["user_id"], order, cut_order=["at", "tie"], plan=plan, policy=policy,
        sums={"n": is_tx.cast("long"), "la_sum": F.when(is_tx, la), "la_sq": F.when(is_tx, la * la),
              "amt_sum": F.when(is_tx, amount), "nights": F.when(is_tx & (hour <= 5), 1).otherwise(0),
              "sin_sum": F.when(is_tx, F.sin(angle)), "cos_sum": F.when(is_tx, F.cos(angle)),
              "devices": F.when(new_device, 1).otherwise(0),
              **{f"past_{c}": F.col(c) for c in ("c1h", "d1h", "c24h", "s24h", "f24h", "c7d")}},
        lasts={"topup": F.when(topup, F.struct(F.col("at").alias("us"), amount.alias("usd"))), **link},
        maxes={"last_us": F.when(is_tx, F.col("at"))}, mins={"first_us": F.when(is_tx, F.col("at"))})
    past = _departed(past.filter(is_tx), plan)
    # the 7-day buffer was last trimmed at the previous transaction
    past = running(past, ["user_id"], order, plan=plan, policy=policy,
                   lasts={"buffer_7d": F.col("past_c7d") + 1})
    own = {f"{part}_{k}": F.when(F.col(f"link_{k}.tie") == F.col("tie"), F.col(f"link_{k}.{part}"))
           for k in merged for part in ("prior", "others")}
    past = past.withColumns(own)
    if plan is None:            # the user's rows are in one task: earlier rows of the same place or shop
        for k, entity in ((PROVINCE, "tx.location_province"), (MERCHANT, "tx.merchant_id")):
            same = Window.partitionBy("user_id", entity).orderBy("at", "tie").rangeBetween(Window.unboundedPreceding, Window.currentRow)
            touched = F.col("tie").isNotNull() & (F.lit(k == PROVINCE) | F.col(entity).isNotNull())
            past = past.withColumn(f"prior_{k}", F.when(touched, F.count("*").over(same) - 1))
    return past


def _feature_columns(start_us: Column) -> dict[str, Column]:
    """The 58 formulas on a history row joined with its profile."""
    c = F.col
    tx = lambda name: F.col(f"tx.{name}")
    n, amt, bal = c("n"), tx("amount_usd"), tx("balance_before_usd")
    la, known = F.log1p(amt), c("n") >= 3
    debit = tx("tx_type").isin(DEBIT_TYPES)
    ts, hour = c("at"), F.hour("tx.timestamp")
    angle = 2 * F.pi() * hour / 24

    mean = c("la_sum") / n
    spread = F.sqrt(F.greatest(c("la_sq") / n - mean * mean, F.lit(0.0))) + 0.25
    gap_s = F.coalesce(at_least_zero(ts - c("last_us")) / MICROS, F.lit(NO_HISTORY_S))
    first_d = c("prior_D") == 0
    night = hour <= 5
    night_ratio = (c("nights") + 0.05) / (n + 1)
    mx, my = c("cos_sum") / n, c("sin_sum") / n
    strength = F.hypot(mx, my)
    apart = F.pmod(F.abs(F.atan2(my, mx) - angle), 2 * F.pi())
    after_topup = (tx("tx_type") == "CARD_PURCHASE") & c("topup").isNotNull()
    crowd = lambda k: F.coalesce(c(f"others_{k}"), F.lit(0))

    out = {
        "log_amount_usd": la,
        "amount_zscore_user": F.when(known, clip((la - mean) / spread, -10, 10)).otherwise(0.0),
        "amount_ratio_user_mean": F.when(known, F.log1p(amt / (c("amt_sum") / n + 1e-6)))
        .otherwise(F.log(F.lit(2.0))),
        "amount_to_balance": F.when(debit, F.least(amt / (bal + 1.0), F.lit(5.0))).otherwise(0.0),
        "is_near_full_drain": flag(debit & (bal > 1.0) & (amt >= 0.85 * bal)),
        "amount_to_kyc_limit": amt / c("kyc_tx_limit_usd"),
        "log_balance_before": F.log1p(F.greatest(bal, F.lit(0.0))),
        "tx_count_1h": c("past_c1h"), "tx_count_24h": c("past_c24h"),
        "tx_count_7d": F.coalesce(c("buffer_7d"), F.lit(0)),
        "debit_count_1h": c("past_d1h"), "log_debit_sum_24h": F.log1p(c("past_s24h") / CENTS),
        "log_secs_since_last_tx": F.log1p(gap_s), "failed_count_24h": c("past_f24h"),
        "is_new_device": flag((n > 0) & first_d), "log_device_prior_uses": F.log1p(c("prior_D")),
        "n_devices_user": c("devices") - first_d.cast("long"),
        "device_n_users": F.least(crowd(DEVICE), F.lit(20)),
        "is_smartphone": flag(tx("device_type") == "smartphone"),
        "access_app": flag(tx("access_channel") == "APP"),
        "access_ussd": flag(tx("access_channel") == "USSD"),
        "access_agent": flag(tx("access_channel") == "AGENT"),
        "is_foreign_ip": flag(tx("ip_country") != HOME_COUNTRY),
        "is_new_province": flag((n > 0) & (c("prior_P") == 0)),
        "is_away_from_home": flag(~tx("location_province").eqNullSafe(c("province"))),
        "is_new_counterparty": flag(c("prior_C") == 0), "counterparty_n_users": F.log1p(crowd(WALLET)),
        "is_new_agent": flag(c("prior_A") == 0), "agent_n_users_24h": F.log1p(crowd(AGENT)),
        "is_new_merchant": flag(c("prior_M") == 0),
        "is_high_risk_merchant": flag(tx("merchant_category").isin(HIGH_RISK_CATEGORIES)),
        "is_foreign_merchant": flag(tx("merchant_country") != HOME_COUNTRY),
        "hour_sin": F.sin(angle), "hour_cos": F.cos(angle), "is_night": flag(night),
        "user_night_ratio": night_ratio,
        "night_unusual": F.when(night, 1 - night_ratio).otherwise(0.0),
        "hour_deviation_user": F.when(known & (strength > 0.1),
                                      F.least(apart, 2 * F.pi() - apart) / F.pi() * strength).otherwise(0.0),
        "is_weekend": flag(F.weekday("tx.timestamp") >= 5),
        "is_month_end": flag((F.dayofmonth("tx.timestamp") >= 25) | (F.dayofmonth("tx.timestamp") <= 3)),
        "log_history_days": F.coalesce(F.log1p(at_least_zero(ts - c("first_us")) / DAY_US), F.lit(0.0)),
        "log_user_tx_count": F.log1p(n),
        "is_card": flag(tx("channel") == "VISA_VIRTUAL"),
        "log_mins_since_topup": F.when(
            after_topup, F.log1p(at_least_zero(ts - c("topup.us")) / (60 * MICROS)))
        .otherwise(F.log1p(F.lit(NO_HISTORY_S / 60))),
        "purchase_to_topup_ratio": F.when(after_topup, F.least(amt / (c("topup.usd") + 1.0), F.lit(5.0)))
        .otherwise(0.0),
        "kyc_level": c("kyc_level"),
        "log_account_age_days": F.log1p(F.greatest(c("account_age_days") + (ts - start_us) / DAY_US,
                                                   F.lit(0.0))),
        "log_monthly_income": F.log1p(c("monthly_income_usd")),
        "has_visa_virtual": c("has_visa_virtual"),
    }
    out |= {f"type_{t}": flag(tx("tx_type") == t) for t in TX_TYPES}
    return {name: out[name].cast("double") for name in FEATURE_NAMES}


def with_profile(df: DataFrame, users: DataFrame) -> DataFrame:
    """Join the profile; an unknown user gets the cautious default and known_user = false."""
    profile = users.select("user_id", *DEFAULT_PROFILE, F.lit(True).alias("known_user"))
    joined = df.join(profile, "user_id", "left")
    filled = {name: F.when(F.col("known_user"), F.col(name)).otherwise(F.lit(value))
              for name, value in DEFAULT_PROFILE.items()}
    filled["known_user"] = F.coalesce(F.col("known_user"), F.lit(False))
    return joined.withColumns(filled)


def build_features(tx: DataFrame, users: DataFrame, period_start: str | None = None, *,
                   precise: bool = False, extra: tuple[str, ...] = (), names: Sequence[str] = FEATURE_NAMES,
                   policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Meta columns, `known_user` and the 58 features of every transaction.

    `period_start` anchors the account age; by default the day of the first transaction. Features are
    FLOAT; `precise` keeps DOUBLE. `extra` transaction columns are carried along. With fewer `names` the other
    features are left out, and links and crowds that none of the wanted ones reads aren't shuffled.
    """
    kinds = "".join(k for k in USES if CROWDS[k] in names or USES[k].intersection(names)) or DEVICE
    wanted = [n for n in ("is_fraud", "fraud_type") if n in tx.columns and n not in extra] + list(extra)
    carried = [n for n in wanted if n not in INPUT_COLUMNS]
    tx = materialise(tx.select(*INPUT_COLUMNS, *carried), "transactions")
    plan = slice_plan(tx.select("user_id", epoch_us("timestamp").alias("at"), F.col("transaction_id").alias("tie")),
                      ["user_id"], ["at", "tie"], policy)
    # a user touches an entity at most once a transaction, so these keys are cut only where users are
    finer = None if plan is None else "auto"
    shared = _links(tx, kinds)
    links = _prior_uses(shared, policy, finer)
    if set(CROWDS.values()).intersection(names):
        links = _crowd(links, shared, policy)
    else:
        links = links.select("kind", "user_id", "ts_us", "transaction_id", "prior", F.lit(None).cast("long").alias("others"))
    if plan is not None:
        own = _prior_uses(_links(tx, PROVINCE + MERCHANT), policy, finer)
        links = links.unionByName(own.drop("entity", "prev_us"), allowMissingColumns=True)
    history = with_profile(_history(tx, links, carried, policy, plan), users)
    if period_start is None:
        start = tx.select(epoch_us(F.date_trunc("day", F.min("timestamp")))).scalar()
    else:
        start = epoch_us(F.lit(period_start).cast("timestamp_ntz"))
    features = _feature_columns(F.lit(0) + start)
    kind = "double" if precise else "float"
    meta = [n for n in META_COLUMNS if n in INPUT_COLUMNS or n in carried]
    return history.select(
        *[(F.col(n) if n == "user_id" else F.col(f"tx.{n}")).alias(n) for n in meta],
        *[F.col(f"tx.{n}").alias(n) for n in wanted if n not in meta], "known_user",
        *[features[n].cast(kind).alias(n) for n in FEATURE_NAMES if n in names])
