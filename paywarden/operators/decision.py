"""Cost-based approve / verify / block decisions with rules that only strengthen them."""
from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import lookup, position
from paywarden.schema import ACTIONS

# --- fixed values -------------------------------------------------------------------------------
# channel: friction, share of fraud a check stops, cost of blocking an honest client (fixed, share)
CHANNEL_COSTS = {"MOBILE_MONEY": (0.30, 0.85, 4.0, 0.05), "VISA_VIRTUAL": (0.15, 0.90, 6.0, 0.05)}
BLOCK_FLOOR, APPROVE_CEILING = 0.97, 0.01
REASON_BLOCK = "probabilité de fraude très élevée"
REASON_APPROVE = "risque négligeable"
REASON_COST = "coût attendu minimal"
REASON_RULE = "règle : "
RULE_DRAIN = "NOUVEL_APPAREIL_VIDAGE_COMPTE"
RULE_KYC = "DEPASSEMENT_PLAFOND_KYC"
RULE_CASH_OUT = "CASH_OUT_APPAREIL_ET_PROVINCE_INHABITUELS"
RULE_ACTION = "VERIFY"
# -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Policy:
    threshold: float
    costs: Mapping[str, tuple[float, float, float, float]] = field(default_factory=lambda: dict(CHANNEL_COSTS))
    block_floor: float = BLOCK_FLOOR
    approve_ceiling: float = APPROVE_CEILING


def expected_costs(p: Column, amount: Column, channel: Column, policy: Policy) -> dict[str, Column]:
    """Expected loss of each action; an unknown channel uses the mobile-money costs."""
    def cost(i: int) -> Column:
        table = {name: values[i] for name, values in policy.costs.items()}
        return F.coalesce(lookup(table, channel), F.lit(policy.costs["MOBILE_MONEY"][i]))

    friction, caught, blocked, share = (cost(i) for i in range(4))
    return {"APPROVE": p * amount, "VERIFY": friction + p * amount * (1 - caught),
            "BLOCK": (1 - p) * (blocked + share * amount)}


def risk_level(p: Column, threshold: float) -> Column:
    return (F.when(p >= max(0.9, threshold), "CRITIQUE").when(p >= threshold, "ELEVE")
            .when(p >= threshold / 5, "MOYEN").otherwise("FAIBLE"))


def triggered_rules() -> Column:
    """Names of the rules a feature row triggers."""
    debit = ~F.col("tx_type").isin("P2P_RECEIVE", "CASH_IN")
    new_device = F.col("is_new_device") > 0
    rules = [
        F.when(debit & new_device & (F.col("is_near_full_drain") > 0), RULE_DRAIN),
        F.when(debit & (F.col("amount_to_kyc_limit") > 1.0), RULE_KYC),
        F.when((F.col("tx_type") == "CASH_OUT") & new_device & (F.col("is_new_province") > 0), RULE_CASH_OUT)]
    return F.filter(F.array(*rules), lambda r: r.isNotNull())


def decide(df: DataFrame, policy: Policy, probability: str = "fraud_probability") -> DataFrame:
    """Add cost_*, action, risk_level, reason and rules_triggered to feature rows with a probability."""
    p = F.col(probability)
    costs = expected_costs(p, F.col("amount_usd"), F.col("channel"), policy)
    cheapest = (F.when((costs["APPROVE"] <= costs["VERIFY"]) & (costs["APPROVE"] <= costs["BLOCK"]), "APPROVE")
                .when(costs["VERIFY"] <= costs["BLOCK"], "VERIFY").otherwise("BLOCK"))
    floor, ceiling = p >= policy.block_floor, p < policy.approve_ceiling
    by_cost = F.when(floor, "BLOCK").when(ceiling, "APPROVE").otherwise(cheapest)
    why = F.when(floor, REASON_BLOCK).when(ceiling, REASON_APPROVE).otherwise(REASON_COST)
    df = df.withColumns({f"cost_{a.lower()}": F.round(c, 4) for a, c in costs.items()})
    df = df.withColumns({"rules_triggered": triggered_rules(), "__action": by_cost, "__why": why})
    # every rule asks for at least a verification
    stronger = ((F.size("rules_triggered") > 0)
                & (position(ACTIONS, F.lit(RULE_ACTION)) > position(ACTIONS, F.col("__action"))))
    return df.withColumns({
        "action": F.when(stronger, RULE_ACTION).otherwise(F.col("__action")),
        "risk_level": risk_level(p, policy.threshold),
        "reason": F.when(stronger, F.concat(F.lit(REASON_RULE), F.col("rules_triggered")[0]))
        .otherwise(F.col("__why")),
    }).drop("__action", "__why")


def business_metric(decided: DataFrame) -> DataFrame:
    """Frauds stopped (verified or blocked) of all frauds, and honest clients blocked."""
    fraud = F.col("is_fraud") == 1
    return decided.agg(
        F.count_if(fraud & (F.col("action") != "APPROVE")).alias("frauds_stopped"),
        F.count_if(fraud).alias("frauds"),
        F.count_if(~fraud & (F.col("action") == "BLOCK")).alias("honest_blocked"))
