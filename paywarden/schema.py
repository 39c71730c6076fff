"""Table layouts and fixed values. Identifiers are always text; nothing is inferred on read."""
from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values of the data model -------------------------------------------------------------
CHANNELS = ["MOBILE_MONEY", "VISA_VIRTUAL"]
TX_TYPES = ["P2P_SEND", "P2P_RECEIVE", "CASH_IN", "CASH_OUT", "MERCHANT_PAYMENT", "AIRTIME",
            "BILL_PAYMENT", "CARD_TOPUP", "CARD_PURCHASE"]
DEBIT_TYPES = ["P2P_SEND", "CASH_OUT", "MERCHANT_PAYMENT", "AIRTIME", "BILL_PAYMENT", "CARD_TOPUP",
               "CARD_PURCHASE"]
P2P_TYPES = ["P2P_SEND", "P2P_RECEIVE"]
ACCESS_CHANNELS = ["USSD", "APP", "AGENT"]
CURRENCIES = ["CDF", "USD"]
DEVICE_TYPES = ["smartphone", "feature_phone"]
HIGH_RISK_CATEGORIES = ["ELECTRONICS", "GIFT_CARDS", "CRYPTO_EXCHANGE", "GAMING"]
HOME_COUNTRY = "CD"
USD_CDF_RATE = 2850.0
ACTIONS = ["APPROVE", "VERIFY", "BLOCK"]
RISK_LEVELS = ["CRITIQUE", "ELEVE", "MOYEN", "FAIBLE"]
FINAL_LABEL = {"FRAUDE_CONFIRMEE": 1, "FAUX_POSITIF": 0}
ID_FIELDS = ["user_id", "wallet_id", "card_id", "counterparty_id", "merchant_id", "agent_id", "device_id"]
HIDDEN_LABELS = ["is_fraud", "fraud_type", "fraud_episode_id", "is_mule_account", "is_compromised"]
DEFAULT_PROFILE = {"province": "Kinshasa", "kyc_level": 1, "kyc_tx_limit_usd": 100.0,
                   "account_age_days": 0.0, "monthly_income_usd": 100.0, "has_visa_virtual": 0}
# -------------------------------------------------------------------------------------------------

S, D, I, L, B = T.StringType(), T.DoubleType(), T.IntegerType(), T.LongType(), T.BooleanType()
NTZ, TS = T.TimestampNTZType(), T.TimestampType()


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind) for name, kind in fields.items()])


TRANSACTION = _struct(
    transaction_id=S, timestamp=NTZ, user_id=S, wallet_id=S, card_id=S, channel=S, operator=S, tx_type=S,
    access_channel=S, amount=D, currency=S, amount_usd=D, balance_before_usd=D, status=S,
    counterparty_id=S, merchant_id=S, merchant_category=S, merchant_country=S, agent_id=S, device_id=S,
    device_type=S, ip_country=S, location_province=S)

HISTORY = _struct(
    transaction_id=S, timestamp=NTZ, user_id=S, wallet_id=S, card_id=S, channel=S, operator=S, tx_type=S,
    access_channel=S, amount=D, currency=S, amount_usd=D, balance_before_usd=D, balance_after_usd=D,
    status=S, counterparty_id=S, merchant_id=S, merchant_category=S, merchant_country=S, agent_id=S,
    device_id=S, device_type=S, ip_country=S, location_province=S, is_fraud=I, fraud_type=S,
    fraud_episode_id=S)

USERS = _struct(user_id=S, province=S, kyc_level=I, kyc_tx_limit_usd=D, account_age_days=D,
                monthly_income_usd=D, has_visa_virtual=I)

DECISION = _struct(
    action=S, risk_level=S, reason=S, rules_triggered=T.ArrayType(S), fraud_probability=D,
    is_fraud_predicted=B, threshold=D, model_version=S, latency_ms=D, degraded=B)
EXPLANATION = _struct(
    top_features=T.ArrayType(_struct(feature=S, shap=D, value=D)), branch_scores=T.MapType(S, D),
    branch_contributions=T.MapType(S, D), attention_on_history=T.ArrayType(D))
DECISION_EVENT = _struct(
    event_id=S, scored_at=TS, transaction=TRANSACTION, decision=DECISION, explanation=EXPLANATION,
    features=T.MapType(S, D))

SCORED = T.StructType([
    T.StructField("transaction_id", S), T.StructField("tx_time", NTZ), T.StructField("scored_at", TS),
    *[T.StructField(n, S) for n in ("user_id", "channel", "operator", "tx_type", "access_channel")],
    T.StructField("amount", D), T.StructField("currency", S), T.StructField("amount_usd", D),
    *[T.StructField(n, S) for n in ("province", "device_id", "counterparty_id", "agent_id", "merchant_id")],
    T.StructField("fraud_probability", D), T.StructField("risk_level", S), T.StructField("action", S),
    T.StructField("reason", S), T.StructField("rules_triggered", T.ArrayType(S)),
    T.StructField("model_version", S), T.StructField("latency_ms", D), T.StructField("degraded", B),
    T.StructField("explanation", EXPLANATION), T.StructField("features", T.MapType(S, D)),
    T.StructField("label", I), T.StructField("labeled_at", TS)])

AUDIT_EVENT = _struct(event_id=S, ts=TS, actor=S, action=S, entity=S, entity_id=S,
                      details=T.MapType(S, S))
FEEDBACK = _struct(event_id=S, ts=TS, transaction_id=S, label=I, analyst=S, case_id=L)
CASE_REQUEST = _struct(case_id=L, seq=L, ts=TS, status=S, assigned_to=L, resolution_note=S, analyst=L)
REGISTRY = _struct(version=S, status=S, created_at=TS)
