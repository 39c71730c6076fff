"""Replay of wallet and card balances.

A debit above the balance fails and leaves the balance unchanged, so a balance depends on every
decision before it: no window function expresses that. Users are independent and are replayed in
parallel. A user with too many rows for one task is cut along time; each slice is replayed from an
assumed opening balance, and slices whose opening turns out different are replayed again until none
is; only the slices' balances (a bounded table) pass through the driver. The first slice is right from the start and every round makes at least one more right, so the
result is exact.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import epoch_us
from paywarden.plans.scan import DEFAULT_POLICY, SLICE, SkewPolicy, slice_plan, with_slices
from paywarden.session import materialise

# --- fixed values -------------------------------------------------------------------------------
CREDITS = ["P2P_RECEIVE", "CASH_IN"]
FAILED, OK = "FAILED_INSUFFICIENT_FUNDS", "SUCCESS"
EPSILON = 1e-9
# -------------------------------------------------------------------------------------------------
_ROWS = f"user_id string, {SLICE} int, us long, transaction_id string, kind string, amount_usd double, wallet0 double, card0 double"
_OUT = f"{_ROWS}, balance_before_usd double, balance_after_usd double, status string, wallet double, card double"


def _replay(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Walk a sorted partition; only the current user's two balances are kept between batches."""
    owner, wallet, card = None, 0.0, 0.0
    for batch in batches:
        before, after, status, wallets, cards = [], [], [], [], []
        for user, part, kind, amount, w0, c0 in zip(batch["user_id"], batch[SLICE], batch["kind"], batch["amount_usd"],
                                                    batch["wallet0"], batch["card0"]):
            if (user, part) != owner:
                owner, wallet, card = (user, part), w0, c0
            balance = card if kind == "purchase" else wallet
            if kind == "credit":
                wallet, done = wallet + amount, True
            else:
                done = amount <= balance + EPSILON
                if done and kind == "purchase":
                    card -= amount
                elif done:
                    wallet -= amount
                    card += amount if kind == "topup" else 0.0
            before.append(balance)
            after.append(card if kind == "purchase" else wallet)
            status.append(OK if done else FAILED)
            wallets.append(wallet)
            cards.append(card)
        yield batch.assign(balance_before_usd=before, balance_after_usd=after, status=status, wallet=wallets, card=cards)


def _run(rows: DataFrame) -> DataFrame:
    ordered = rows.repartition("user_id", SLICE).sortWithinPartitions("user_id", SLICE, "us", "transaction_id")
    return ordered.mapInPandas(_replay, _OUT)


def ledger_replay(tx: DataFrame, wallet_opening: float, card_opening: float,
                  policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """(user_id, transaction_id, balance_before_usd, balance_after_usd, status) of every transaction."""
    kind = (F.when(F.col("tx_type").isin(CREDITS), "credit").when(F.col("tx_type") == "CARD_PURCHASE", "purchase")
            .when(F.col("tx_type") == "CARD_TOPUP", "topup").otherwise("debit"))
    base = tx.select("user_id", epoch_us("timestamp").alias("us"), "transaction_id", kind.alias("kind"), "amount_usd")
    plan = slice_plan(base, ["user_id"], ["us", "transaction_id"], policy)
    rows = with_slices(base, ["user_id"], ["us", "transaction_id"], plan).withColumn(SLICE, F.col(SLICE).cast("int"))
    opening = {"wallet0": F.lit(float(wallet_opening)), "card0": F.lit(float(card_opening))}
    result = ["user_id", "transaction_id", "balance_before_usd", "balance_after_usd", "status"]
    shape = [c.split()[0] for c in _ROWS.split(", ")]
    if plan is None:
        return _run(rows.withColumns(opening).select(*shape)).select(*result)

    whole = _run(rows.filter(F.col(SLICE) == 0).withColumns(opening).select(*shape)).select(*result)
    cut = materialise(rows.filter(F.col(SLICE) > 0), "ledger-rows")

    def started(openings: dict) -> DataFrame:
        """Rows of the given slices with their opening balances; the table of slices is bounded by the plan."""
        table = tx.sparkSession.createDataFrame([(*k, *v) for k, v in openings.items()],
                                                f"user_id string, {SLICE} int, wallet0 double, card0 double")
        return cut.join(F.broadcast(table), ["user_id", SLICE]).select(*shape)

    slices = [tuple(r) for r in cut.select("user_id", SLICE).distinct().orderBy("user_id", SLICE).collect()]
    openings = {k: (float(wallet_opening), float(card_opening)) for k in slices}
    todo, ends = dict(openings), {}
    while todo:
        last = _run(started(todo)).groupBy("user_id", SLICE).agg(
            F.max_by(F.struct("wallet", "card"), F.struct("us", "transaction_id")).alias("end")).collect()
        ends |= {(r.user_id, r[SLICE]): (r.end.wallet, r.end.card) for r in last}
        todo = {b: ends[a] for a, b in zip(slices, slices[1:]) if a[0] == b[0] and ends[a] != openings[b]}
        openings |= todo
    return whole.unionByName(_run(started(openings)).select(*result))
