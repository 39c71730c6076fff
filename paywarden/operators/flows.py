"""Signals about agents and recipients: fraud found at an agent, and how fast received money is cashed out.

Both are running totals over one merged sequence of events per key (see plans.scan), so no row meets the
rows it depends on, a hot agent or recipient is sliced, and amounts are integers that add up exactly.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import DAY_US, MICROS, epoch_us
from paywarden.operators.features import CENTS
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running

CREDIT_TYPES = ["P2P_RECEIVE", "CASH_IN"]
WIDE = "decimal(38,0)"


def agent_fraud_exposure(tx: DataFrame, verdicts: DataFrame, days: int = 7, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per transaction at an agent, over the agent's cash-outs of the last `days` before it: `cashouts`,
    their amount, and `frauds` with their amount, of those confirmed as fraud by then.

    Two clocks run: a cash-out counts from its own time, its verdict from the time it became known
    (`verdicts`: transaction_id, label, labeled_at; the first known verdict of a transaction holds). A verdict
    that comes later never changes an earlier row, and one that comes after the window has closed never
    counts. Rows at the same time count in the order of their ids; a verdict known at the very time of a row
    counts for it. Rows without an agent are left out; a null amount is 0.
    """
    first = verdicts.filter(F.col("labeled_at").isNotNull() & F.col("label").isNotNull()).groupBy("transaction_id").agg(
        F.min_by("label", F.struct("labeled_at", "label")).alias("label"), F.min(epoch_us("labeled_at")).alias("known_us"))
    cents = F.coalesce(F.round(F.col("amount_usd") * CENTS).cast("long"), F.lit(0).cast("long"))
    rows = (tx.filter(F.col("agent_id").isNotNull())
            .select("transaction_id", "agent_id", epoch_us("timestamp").alias("us"), F.when(F.col("tx_type") == "CASH_OUT", cents).alias("cents"))
            .join(first.filter("label = 1"), "transaction_id", "left"))
    gone = F.col("us") + days * DAY_US + 1
    out, fraud = F.col("cents").isNotNull(), F.col("cents").isNotNull() & F.col("known_us").isNotNull()
    at_once = fraud & (F.col("known_us") <= F.col("us"))
    zero = F.lit(0).cast("long")

    def event(at: Column, tie: Column, sign: int, counts: Column, confirmed: Column, is_row: bool) -> Column:
        def part(when: Column, value: Column) -> Column:
            return F.when(when, sign * value).otherwise(zero).cast("long")
        one = F.lit(1)
        return F.struct(at.alias("at"), tie.alias("tie"), part(counts, one).alias("n"), part(counts, F.col("cents")).alias("c"),
                        part(confirmed, one).alias("fn"), part(confirmed, F.col("cents")).alias("fc"), F.lit(is_row).alias("is_row"))

    none, never = F.lit(""), F.lit(False)
    own = event(F.col("us"), F.col("transaction_id"), 1, out, at_once, True)
    known = F.when(fraud & ~at_once & (F.col("known_us") < gone), event(F.col("known_us"), none, 1, never, F.lit(True), False))
    leave = F.when(out, event(gone, none, -1, F.lit(True), fraud & (F.col("known_us") < gone), False))
    events = rows.select("transaction_id", "agent_id", F.inline(F.array_compact(F.array(own, known, leave))))
    past = running(events, ["agent_id"], ["at", "tie"], policy=policy,
                   sums={"cashouts": F.col("n"), "cashout_cents": F.col("c"), "frauds": F.col("fn"), "fraud_cents": F.col("fc")})
    return past.filter("is_row").select(
        "transaction_id", "agent_id", F.col("at").alias("us"), "cashouts", "frauds",
        (F.col("cashout_cents") / CENTS).alias("cashout_usd"), (F.col("fraud_cents") / CENTS).alias("fraud_usd"),
        F.coalesce(F.try_divide(F.col("fraud_cents"), F.col("cashout_cents")), F.lit(0.0)).alias("exposure"))


def cash_out_speed(tx: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Per cash-out of a user: how much of it came from money received before (first in, first out), and the
    amount-weighted seconds that money had stayed.

    Lots (money received) and cash-outs are intervals on one axis of cumulated amounts. What finds no money
    is the running maximum of cash-outs less lots, so a cash-out covers the axis up to `spent` = cash-outs so
    far less that maximum. With G(x), the sum of amount times arrival over the axis up to x, the time its
    money arrived is G(spent) less G(spent before). G is linear inside a lot; one scan over lots and ends of
    cash-outs, in order of their place on the axis, gives every end the lot it falls into.

    Amounts are whole millionths; null and negative amounts count as 0. Failed transactions move no money
    (a null status counts as success). Rows at the same time go by id.
    """
    moved = (tx.filter((F.col("tx_type") == "CASH_OUT") | F.col("tx_type").isin(CREDIT_TYPES))
             .filter(F.coalesce(F.col("status") == "SUCCESS", F.lit(True)))
             .select("transaction_id", "user_id", epoch_us("timestamp").alias("us"), (F.col("tx_type") == "CASH_OUT").alias("out"),
                     F.greatest(F.coalesce(F.round(F.col("amount_usd") * CENTS).cast("long"), F.lit(0).cast("long")), F.lit(0).cast("long")).alias("cents")))
    paid, received = F.when(F.col("out"), F.col("cents")).otherwise(0), F.when(F.col("out"), 0).otherwise(F.col("cents"))
    order = ["us", "transaction_id"]
    lot_time = (received.cast("decimal(19,0)") * F.col("us").cast("decimal(19,0)")).cast(WIDE)
    flow = running(moved, ["user_id"], order, inclusive=True, policy=policy, sums={"paid": paid, "received": received, "g": lot_time})
    short = running(flow.withColumn("lack", F.col("paid") - F.col("received")), ["user_id"], order, inclusive=True, policy=policy,
                    maxes={"most": F.col("lack")})
    placed = short.select("transaction_id", "user_id", "us", "out", "cents", "g",
                          (F.col("received") - F.when(F.col("out"), 0).otherwise(F.col("cents"))).alias("lot_from"),
                          (F.col("paid") - F.greatest(F.col("most"), F.lit(0))).alias("spent"))
    # a lot stands at its start, the end of a cash-out behind the lots that start before it
    place = F.when(F.col("out"), F.col("spent")).otherwise(F.col("lot_from"))
    lot = F.when(~F.col("out") & (F.col("cents") > 0), F.struct(
        "lot_from", F.col("us").alias("lot_us"),
        (F.col("g") - (F.col("cents").cast("decimal(19,0)") * F.col("us").cast("decimal(19,0)")).cast(WIDE)).cast(WIDE).alias("before")))
    found = running(placed.withColumns({"place": place, "end": F.col("out").cast("int")}), ["user_id"],
                    ["place", "end", "us", "transaction_id"], policy=policy, lasts={"lot": lot})
    inside = ((F.col("spent") - F.col("lot.lot_from")).cast("decimal(19,0)") * F.col("lot.lot_us").cast("decimal(19,0)")).cast(WIDE)
    ends = found.filter("out").select("transaction_id", "user_id", "us", "cents", "spent",
                                      F.coalesce((F.col("lot.before") + inside).cast(WIDE), F.lit(0).cast(WIDE)).alias("upto"))
    before = running(ends, ["user_id"], order, policy=policy, lasts={"spent_before": F.col("spent"), "upto_before": F.col("upto")})
    matched = F.col("spent") - F.coalesce("spent_before", F.lit(0))
    arrived = F.col("upto") - F.coalesce("upto_before", F.lit(0).cast(WIDE))
    stayed = ((matched.cast("decimal(19,0)") * F.col("us").cast("decimal(19,0)")).cast(WIDE) - arrived).cast("double")
    return before.select(
        "transaction_id", "user_id", (F.col("cents") / CENTS).alias("cash_out_usd"), (matched / CENTS).alias("matched_usd"),
        F.when(matched > 0, stayed / matched / MICROS).alias("stayed_s"))
