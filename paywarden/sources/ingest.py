"""Operator messages to unified transactions and back. Nothing is dropped: a message that cannot be
used keeps its row with `reject_reasons`."""
from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from paywarden.functions.columns import lookup
from paywarden.functions.ids import canonical_ids, to_local_naive
from paywarden.schema import (ACCESS_CHANNELS, CHANNELS, CURRENCIES, DEVICE_TYPES, TRANSACTION, TX_TYPES,
                              USD_CDF_RATE)

# --- fixed values: field names, codes and time formats of the four message kinds -------------------
VODACOM_TYPES = {"SendMoney": "P2P_SEND", "ReceiveMoney": "P2P_RECEIVE", "Deposit": "CASH_IN",
                 "Withdraw": "CASH_OUT", "BuyGoods": "MERCHANT_PAYMENT", "Airtime": "AIRTIME",
                 "PayBill": "BILL_PAYMENT", "CardTopUp": "CARD_TOPUP"}
AIRTEL_TYPES = {"P2P_OUT": "P2P_SEND", "P2P_IN": "P2P_RECEIVE", "CASHIN": "CASH_IN", "CASHOUT": "CASH_OUT",
                "MERCHPAY": "MERCHANT_PAYMENT", "AIRTIME": "AIRTIME", "BILLPAY": "BILL_PAYMENT",
                "CARD_LOAD": "CARD_TOPUP"}
ORANGE_TYPES = {"TRANSFERT_ENVOI": "P2P_SEND", "TRANSFERT_RECU": "P2P_RECEIVE", "DEPOT": "CASH_IN",
                "RETRAIT": "CASH_OUT", "PAIEMENT_MARCHAND": "MERCHANT_PAYMENT", "CREDIT": "AIRTIME",
                "FACTURE": "BILL_PAYMENT", "RECHARGE_CARTE": "CARD_TOPUP"}
VISA_TYPES = {"00": "CARD_PURCHASE", "28": "CARD_TOPUP"}
VISA_CURRENCIES = {"840": "USD", "976": "CDF"}
VODACOM_TIME, ORANGE_TIME, ISO_TIME = "yyyyMMddHHmmss", "dd/MM/yyyy HH:mm:ss", "iso"
MISSING, UNKNOWN_TYPE, BAD_TIME, BAD_CURRENCY, INVALID = (
    "champs obligatoires manquants : ", "type inconnu : ", "horodatage invalide : ",
    "devise non prise en charge : ", "valeur invalide : ")
SCORING_DOWN = "scoring indisponible (politique de repli)"

# unified field -> path in the message; "!" marks a required field
VODACOM_FIELDS = {
    "transaction_id": "TransID!", "timestamp": "TransTime!", "wallet_id": "MSISDN!", "user_id": "CustomerID!",
    "tx_type": "TransactionType!", "amount": "TransAmount!", "currency": "Currency!",
    "balance_before_usd": "AccountBalanceUSD!", "device_id": "DeviceIMEI!", "access_channel": "Channel!",
    "location_province": "Location!", "status": "ResultStatus", "counterparty_id": "CounterpartyMSISDN",
    "agent_id": "AgentTill", "merchant_id": "ShortCode", "merchant_category": "MerchantCategory",
    "merchant_country": "MerchantCountry", "device_type": "DeviceType", "ip_country": "IPCountry"}
AIRTEL_FIELDS = {
    "transaction_id": "transaction.id!", "tx_type": "transaction.type!", "amount": "transaction.amount!",
    "currency": "transaction.currency!", "timestamp": "transaction.timestamp!", "status": "transaction.status",
    "wallet_id": "subscriber.msisdn!", "user_id": "subscriber.customer_id!",
    "balance_before_usd": "subscriber.balance_usd!", "location_province": "subscriber.province!",
    "device_id": "device.imei!", "access_channel": "device.channel!", "device_type": "device.type",
    "ip_country": "device.ip_country", "counterparty_id": "counterparty.msisdn",
    "agent_id": "counterparty.agent_code", "merchant_id": "counterparty.merchant_code",
    "merchant_category": "counterparty.merchant_category", "merchant_country": "counterparty.merchant_country"}
ORANGE_FIELDS = {
    "transaction_id": "id_transaction!", "timestamp": "date_heure!", "wallet_id": "numero_client!",
    "user_id": "id_client!", "tx_type": "type_operation!", "amount": "montant!", "currency": "devise!",
    "balance_before_usd": "solde_avant_usd!", "device_id": "imei!", "access_channel": "canal!",
    "location_province": "province!", "status": "statut", "counterparty_id": "beneficiaire",
    "agent_id": "code_agent", "merchant_id": "code_marchand", "merchant_category": "categorie_marchand",
    "merchant_country": "pays_marchand", "device_type": "type_terminal", "ip_country": "pays_ip"}
VISA_FIELDS = {
    "transaction_id": "stan!", "timestamp": "transmission_datetime!", "card_id": "card_id!",
    "user_id": "cardholder_id!", "tx_type": "processing_code!", "amount": "amount_minor!",
    "currency": "currency_code!", "balance_before_usd": "available_balance_usd!", "device_id": "device_id!",
    "location_province": "province!", "wallet_id": "funding_wallet", "operator": "funding_operator",
    "access_channel": "access_channel", "status": "response_status", "merchant_id": "merchant.mid",
    "merchant_category": "merchant.category", "merchant_country": "merchant.country",
    "device_type": "device_type", "ip_country": "ip_country"}
# ---------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Provider:
    name: str
    fields: dict[str, str]
    types: dict[str, str]
    time_format: str
    channel: str
    operator: str | None = None
    currencies: dict[str, str] | None = None
    minor_units: bool = False


VODACOM = Provider("vodacom", VODACOM_FIELDS, VODACOM_TYPES, VODACOM_TIME, "MOBILE_MONEY", "VODACOM")
AIRTEL = Provider("airtel", AIRTEL_FIELDS, AIRTEL_TYPES, ISO_TIME, "MOBILE_MONEY", "AIRTEL")
ORANGE = Provider("orange", ORANGE_FIELDS, ORANGE_TYPES, ORANGE_TIME, "MOBILE_MONEY", "ORANGE")
VISA = Provider("visa", VISA_FIELDS, VISA_TYPES, ISO_TIME, "VISA_VIRTUAL", None, VISA_CURRENCIES, True)
PROVIDERS = {p.name: p for p in (VODACOM, AIRTEL, ORANGE, VISA)}


def to_usd(amount: Column, currency: Column, rate: float = USD_CDF_RATE) -> Column:
    """USD as is, CDF at the rate, both to the cent; null for any other currency."""
    code = F.upper(currency)
    return F.when(code == "USD", F.bround(amount, 2)).when(code == "CDF", F.bround(amount / rate, 2))


def parse_time(text: Column, fmt: str) -> Column:
    """Local wall-clock time, null if the text does not fit. ISO text with a zone is converted."""
    if fmt != ISO_TIME:
        return F.try_to_timestamp(text, F.lit(fmt)).cast("timestamp_ntz")
    zoned = text.rlike(r"T?\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})$")
    return F.when(zoned, to_local_naive(text.try_cast("timestamp"))).otherwise(text.try_cast("timestamp_ntz"))


def missing_fields(fields: dict[str, Column]) -> Column:
    """Names whose value is null or empty."""
    names = F.array(*[F.when(F.coalesce(v, F.lit("")) == "", F.lit(n)) for n, v in fields.items()])
    return F.filter(names, lambda n: n.isNotNull())


def _path(spec: str) -> str:
    return spec.rstrip("!")


def _message_schema(provider: Provider) -> T.StructType:
    """All leaves as text: numbers arrive quoted or not."""
    flat, blocks = [], {}
    for spec in provider.fields.values():
        head, _, leaf = _path(spec).partition(".")
        if leaf:
            blocks.setdefault(head, []).append(leaf)
        else:
            flat.append(head)
    fields = [T.StructField(n, T.StringType()) for n in flat]
    for head, leaves in blocks.items():
        fields.append(T.StructField(head, T.StructType([T.StructField(x, T.StringType()) for x in leaves])))
    return T.StructType(fields)


def check_unified() -> Column:
    """Names of the constraints a unified row breaks."""
    def text(name: str, low: int, high: int | None) -> Column:
        size = F.length(name)
        bad = size < low if high is None else (size < low) | (size > high)
        return F.col(name).isNull() | bad

    def one_of(name: str, values: Sequence[str]) -> Column:
        return F.col(name).isNull() | ~F.col(name).isin(list(values))

    def number(name: str, bad: Column) -> Column:
        return F.col(name).isNull() | F.isnan(name) | bad

    broken = {
        "transaction_id": text("transaction_id", 1, 64), "user_id": text("user_id", 1, 64),
        "device_id": text("device_id", 1, None), "location_province": F.col("location_province").isNull(),
        "timestamp": F.col("timestamp").isNull(), "channel": one_of("channel", CHANNELS),
        "tx_type": one_of("tx_type", TX_TYPES), "access_channel": one_of("access_channel", ACCESS_CHANNELS),
        "currency": one_of("currency", CURRENCIES), "device_type": one_of("device_type", DEVICE_TYPES),
        "amount": number("amount", F.col("amount") <= 0), "amount_usd": number("amount_usd", F.col("amount_usd") <= 0),
        "balance_before_usd": number("balance_before_usd", F.col("balance_before_usd") < 0)}
    return F.filter(F.array(*[F.when(c, F.lit(INVALID + n)) for n, c in broken.items()]), lambda n: n.isNotNull())


def from_messages(raw: DataFrame, provider: Provider, column: str = "raw", rate: float = USD_CDF_RATE) -> DataFrame:
    """Parse raw JSON messages of one provider: unified columns, `provider` and `reject_reasons`
    (empty for a usable row). The raw text stays."""
    parsed = raw.withColumn("__m", F.from_json(column, _message_schema(provider)))
    value = {name: F.col(f"__m.{_path(spec)}") for name, spec in provider.fields.items()}
    required = {_path(spec): value[name] for name, spec in provider.fields.items() if spec.endswith("!")}
    missing = missing_fields(required)
    when = parse_time(value["timestamp"], provider.time_format)
    tx_type = lookup(provider.types, value["tx_type"])
    currency = lookup(provider.currencies, value["currency"]) if provider.currencies else value["currency"]
    amount = value["amount"].try_cast("double")
    if provider.minor_units:
        amount = value["amount"].try_cast("bigint") / 100
    columns = {
        **value, "timestamp": when, "tx_type": tx_type, "currency": currency, "amount": amount,
        "amount_usd": to_usd(amount, currency, rate), "balance_before_usd": value["balance_before_usd"].try_cast("double"),
        "channel": F.lit(provider.channel), "operator": F.lit(provider.operator) if provider.operator else value["operator"],
        "device_type": F.coalesce(value["device_type"], F.lit("smartphone")),
        "access_channel": F.coalesce(value["access_channel"], F.lit("APP")) if provider is VISA else value["access_channel"]}
    unified = parsed.select(
        F.col(column), F.lit(provider.name).alias("provider"), missing.alias("__missing"),
        value["tx_type"].alias("__type"), value["timestamp"].alias("__time"), value["currency"].alias("__currency"),
        *[columns.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRANSACTION.fields])
    unified = canonical_ids(unified)
    unreadable = F.array_compact(F.array(
        F.when(F.size("__missing") > 0, F.concat(F.lit(MISSING), F.array_join("__missing", ", "))),
        F.when(F.col("__type").isNotNull() & F.col("tx_type").isNull(), F.concat(F.lit(UNKNOWN_TYPE), F.col("__type"))),
        F.when(F.col("__time").isNotNull() & F.col("timestamp").isNull(), F.concat(F.lit(BAD_TIME), F.col("__time"))),
        F.when(F.col("__currency").isNotNull() & F.col("amount").isNotNull() & F.col("amount_usd").isNull(),
               F.concat(F.lit(BAD_CURRENCY), F.col("__currency")))))
    reasons = F.when(F.size(unreadable) > 0, unreadable).otherwise(check_unified())
    return unified.withColumn("reject_reasons", reasons).drop("__missing", "__type", "__time", "__currency")


def split_valid(parsed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Usable transactions, and rejected messages with their reasons."""
    ok = F.size("reject_reasons") == 0
    valid = parsed.filter(ok).select("provider", *TRANSACTION.fieldNames())
    return valid, parsed.filter(~ok).select("provider", "raw", "reject_reasons")


def union_sources(messages: dict[str, DataFrame], rate: float = USD_CDF_RATE) -> DataFrame:
    """All providers' messages parsed into one table."""
    parts = [from_messages(df, PROVIDERS[name], rate=rate) for name, df in messages.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def _iso_text(ts: Column) -> Column:
    fraction = F.date_format(ts, "SSSSSS")
    return F.concat(F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss"),
                    F.when(fraction != "000000", F.concat(F.lit("."), fraction)).otherwise(F.lit("")))


def to_messages(tx: DataFrame, provider: Provider) -> DataFrame:
    """The inverse: unified rows as the provider's JSON, in `raw`."""
    def back(table: dict[str, str], name: str) -> Column:
        return lookup({v: k for k, v in table.items()}, F.col(name))

    leaf = {name: F.col(name) for name in provider.fields}
    leaf["tx_type"] = back(provider.types, "tx_type")
    ts = F.col("timestamp")
    leaf["timestamp"] = _iso_text(ts) if provider.time_format == ISO_TIME else F.date_format(ts, provider.time_format)
    if provider.currencies:
        leaf["currency"] = back(provider.currencies, "currency")
    if provider.minor_units:
        leaf["amount"] = F.bround(F.col("amount") * 100, 0).cast("bigint")
    flat, blocks = [], {}
    for name, spec in provider.fields.items():
        head, _, inner = _path(spec).partition(".")
        if inner:
            blocks.setdefault(head, []).append(leaf[name].alias(inner))
        else:
            flat.append(leaf[name].alias(head))
    message = F.to_json(F.struct(*flat, *[F.struct(*leaves).alias(head) for head, leaves in blocks.items()]))
    return tx.select("transaction_id", message.alias("raw"))


def provider_of() -> Column:
    """Card operations go to visa, others to their operator."""
    return F.when(F.col("channel") == "VISA_VIRTUAL", "visa").otherwise(F.lower("operator"))


def with_fallback(parsed: DataFrame, decisions: DataFrame, fail_open: bool = False) -> DataFrame:
    """Valid transactions with their decision, or the fallback where scoring gave none."""
    decided = decisions.select("transaction_id", "action", "risk_level", "reason", "fraud_probability",
                               F.lit(True).alias("__scored"))
    joined = parsed.join(decided, "transaction_id", "left")
    scored = F.coalesce(F.col("__scored"), F.lit(False))
    return joined.withColumns({
        "action": F.when(scored, F.col("action")).otherwise("APPROVE" if fail_open else "VERIFY"),
        "risk_level": F.when(scored, F.col("risk_level")).otherwise("INCONNU"),
        "reason": F.when(scored, F.col("reason")).otherwise(SCORING_DOWN),
        "scoring_available": scored}).drop("__scored")


def outcome_counts(parsed: DataFrame, decided: DataFrame) -> DataFrame:
    """(provider, outcome, n): invalid, an action, or scoring_unavailable."""
    invalid = parsed.filter(F.size("reject_reasons") > 0).select("provider", F.lit("invalid").alias("outcome"))
    rest = decided.select("provider", F.when(F.col("scoring_available"), F.col("action"))
                          .otherwise("scoring_unavailable").alias("outcome"))
    return invalid.unionByName(rest).groupBy("provider", "outcome").agg(F.count("*").alias("n"))
