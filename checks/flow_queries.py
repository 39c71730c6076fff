"""Ingest (I*), sources and sinks (S*), cases and audit (K*), monitoring (W*), audit list (Q12)."""
from __future__ import annotations

import re
import uuid

from pyspark.sql import Window
from pyspark.sql import functions as F

from checks.feature_queries import rounded
from checks.report_queries import CASES, case_table
from checks.scored import DECIDING, fact, scored_sql, stored_fact
from checks.tables import duck, transactions
from paywarden.functions.ids import canonical_id, to_local_naive
from paywarden.operators import audit as au
from paywarden.operators import cases as cs
from paywarden.operators import features as ft
from paywarden.operators import monitor as mo
from paywarden.operators import reports as rp
from paywarden.session import materialise, stage_folder
from paywarden.sources import events as ev
from paywarden.sources import ingest as ig
from paywarden.sources import tables as st

# --- ingest: messages made from the transactions, some of them broken ---------------------------------
BREAK = {   # provider -> (required field to drop, type field, time field)
    "vodacom": ("DeviceIMEI", "TransactionType", "TransTime"), "airtel": ("imei", "type", "timestamp"),
    "orange": ("imei", "type_operation", "date_heure"), "visa": ("device_id", "processing_code", "transmission_datetime")}
LABEL = {"vodacom": "DeviceIMEI", "airtel": "device.imei", "orange": "imei", "visa": "device_id"}
WALLET = {"vodacom": "MSISDN", "airtel": "subscriber.msisdn", "orange": "numero_client"}


def _messages(spark, d, name: str):
    tx = transactions(spark, d).withColumn("device_type", F.expr("CASE WHEN event_id % 13 <> 0 THEN device_type END"))
    tx = tx.filter(ig.provider_of() == name)
    raw = ig.to_messages(tx, ig.PROVIDERS[name]).withColumn("event_id", F.expr("CAST(substr(transaction_id, 3) AS bigint)"))
    drop, kind, time = BREAK[name]

    def broken(n: int, pattern: str, by: str):
        return F.when(F.col("event_id") % n == 0, F.regexp_replace("raw", pattern, by)).otherwise(F.col("raw"))

    raw = raw.withColumn("raw", broken(50, f'"{drop}":"[^"]*",?', ""))
    raw = raw.withColumn("raw", broken(53, f'"{kind}":"(?!smart|feature)[^"]*"', f'"{kind}":"INCONNU"'))
    return raw.withColumn("raw", broken(59, f'"{time}":"[^"]*"', f'"{time}":"hier"')).select("raw")


def _parsed(name):
    def run(spark, d):
        p = ig.from_messages(_messages(spark, d, name), ig.PROVIDERS[name])
        ok = F.size("reject_reasons") == 0
        return p.select("transaction_id", F.concat_ws("|", "reject_reasons").alias("reject_reasons"), *[
            F.when(ok, F.col(c)).alias(c) for c in
            ("user_id", "wallet_id", "card_id", "channel", "operator", "tx_type", "access_channel", "currency", "amount_usd",
             "status", "counterparty_id", "merchant_id", "merchant_country", "agent_id", "device_id", "device_type",
             "ip_country", "location_province")],
            F.when(ok, F.round("amount", 2)).alias("amount"), F.when(ok, F.round("balance_before_usd", 4)).alias("balance_before_usd"),
            F.when(ok, F.unix_micros(F.col("timestamp").cast("timestamp"))).alias("ts_us"))
    return run


def _expected(name: str) -> str:
    visa = name == "visa"
    where = "channel = 'VISA_VIRTUAL'" if visa else f"channel <> 'VISA_VIRTUAL' AND operator = '{name.upper()}'"
    missing = [f"CASE WHEN event_id % 50 = 0 THEN '{LABEL[name]}' END"]
    if not visa:
        missing.insert(0, f"CASE WHEN wallet_id IS NULL THEN '{WALLET[name]}' END")
    if name == "airtel":
        order = missing
    else:
        order = missing
    us = "epoch_us(timestamp)" if name in ("airtel", "visa") else "epoch_us(date_trunc('second', timestamp))"
    amount = "round(amount, 2)"
    cols = ["user_id", "wallet_id", "card_id", "channel", "operator", "tx_type", "access_channel", "currency", "status", "counterparty_id",
            "merchant_id", "merchant_country", "agent_id", "device_id", "ip_country", "location_province"]
    absent = {"card_id"} if not visa else {"counterparty_id", "agent_id"}
    return duck(f"""
WITH x AS (SELECT *, concat_ws(', ', {', '.join(order)}) AS miss FROM tx WHERE {where}),
y AS (SELECT *, concat_ws('|', CASE WHEN miss <> '' THEN concat('champs obligatoires manquants : ', miss) END,
   CASE WHEN event_id % 53 = 0 THEN 'type inconnu : INCONNU' END, CASE WHEN event_id % 59 = 0 THEN 'horodatage invalide : hier' END) AS reject_reasons FROM x)
SELECT transaction_id, reject_reasons, {', '.join(f"CASE WHEN reject_reasons = '' THEN {'NULL' if c in absent else c} END AS {c}" for c in cols)},
  CASE WHEN reject_reasons = '' THEN CASE WHEN event_id % 13 = 0 THEN 'smartphone' ELSE device_type END END AS device_type,
  CASE WHEN reject_reasons = '' THEN round(amount_usd, 2) END AS amount_usd, CASE WHEN reject_reasons = '' THEN {amount} END AS amount,
  CASE WHEN reject_reasons = '' THEN round(balance_before_usd, 4) END AS balance_before_usd, CASE WHEN reject_reasons = '' THEN {us} END AS ts_us FROM y""")


def i5(spark, d):
    """One field of each inverse mapping, read from the message text."""
    out = None
    paths = {"vodacom": ("$.TransID", "$.TransactionType", "$.TransTime"), "airtel": ("$.transaction.id", "$.transaction.type", "$.transaction.timestamp"),
             "orange": ("$.id_transaction", "$.type_operation", "$.date_heure"), "visa": ("$.stan", "$.processing_code", "$.amount_minor")}
    for name, (a, b, c) in paths.items():
        raw = ig.to_messages(transactions(spark, d).filter(ig.provider_of() == name), ig.PROVIDERS[name])
        part = raw.select(F.lit(name).alias("provider"), F.get_json_object("raw", a).alias("id"),
                          F.get_json_object("raw", b).alias("code"), F.get_json_object("raw", c).alias("third"))
        out = part if out is None else out.unionByName(part)
    return out


def _case(table: dict) -> str:
    return "CASE tx_type " + " ".join(f"WHEN '{v}' THEN '{k}'" for k, v in table.items()) + " END"


I5_SQL = duck(f"""
SELECT 'vodacom' AS provider, transaction_id AS id, {_case(ig.VODACOM_TYPES)} AS code, strftime(timestamp, '%Y%m%d%H%M%S') AS third FROM tx WHERE channel = 'MOBILE_MONEY' AND operator = 'VODACOM'
UNION ALL SELECT 'airtel', transaction_id, {_case(ig.AIRTEL_TYPES)}, strftime(timestamp, '%Y-%m-%dT%H:%M:%S.%f') FROM tx WHERE channel = 'MOBILE_MONEY' AND operator = 'AIRTEL'
UNION ALL SELECT 'orange', transaction_id, {_case(ig.ORANGE_TYPES)}, strftime(timestamp, '%d/%m/%Y %H:%M:%S') FROM tx WHERE channel = 'MOBILE_MONEY' AND operator = 'ORANGE'
UNION ALL SELECT 'visa', transaction_id, {_case(ig.VISA_TYPES)}, CAST(CAST(round_even(amount * 100, 0) AS BIGINT) AS VARCHAR) FROM tx WHERE channel = 'VISA_VIRTUAL'""")


def i6(spark, d):
    tx = transactions(spark, d).withColumn("code", F.expr("CASE event_id % 4 WHEN 0 THEN 'usd' WHEN 1 THEN 'CDF' WHEN 2 THEN 'cdf' ELSE 'EUR' END"))
    usd = ig.to_usd(F.col("amount") * 3 + 0.00001, F.col("code"))
    return tx.select("transaction_id", F.round(usd + 1e-9, 2).alias("amount_usd"), usd.isNull().alias("rejected"))


I6_SQL = duck("""SELECT transaction_id, round(CASE event_id % 4 WHEN 0 THEN amount * 3 + 0.00001e0 WHEN 3 THEN NULL ELSE (amount * 3 + 0.00001e0) / 2850.0e0 END + 1e-9, 2) AS amount_usd,
  event_id % 4 = 3 AS rejected FROM tx""")


def i7(spark, d):
    tx = transactions(spark, d)
    return tx.select("transaction_id", *[
        F.unix_micros(ig.parse_time(text, fmt).cast("timestamp")).alias(name) for name, fmt, text in [
            ("compact", ig.VODACOM_TIME, F.expr("CASE WHEN event_id % 5 = 0 THEN '2024' ELSE date_format(timestamp, 'yyyyMMddHHmmss') END")),
            ("slashed", ig.ORANGE_TIME, F.expr("CASE WHEN event_id % 5 = 1 THEN '32/01/2024 00:00:00' ELSE date_format(timestamp, 'dd/MM/yyyy HH:mm:ss') END")),
            ("iso_utc", ig.ISO_TIME, F.expr("concat(date_format(timestamp, \"yyyy-MM-dd'T'HH:mm:ss\"), CASE WHEN event_id % 2 = 0 THEN '+00:00' ELSE '' END)"))]])


I7_SQL = duck("""SELECT transaction_id, CASE WHEN event_id % 5 <> 0 THEN epoch_us(date_trunc('second', timestamp)) END AS compact,
 CASE WHEN event_id % 5 <> 1 THEN epoch_us(date_trunc('second', timestamp)) END AS slashed,
 epoch_us(date_trunc('second', timestamp)) + CASE WHEN event_id % 2 = 0 THEN 3600000000 ELSE 0 END AS iso_utc FROM tx""")


def i8(spark, d):
    tx = transactions(spark, d)
    fields = {n: F.col(n) for n in ("wallet_id", "card_id", "agent_id", "merchant_id")}
    return tx.select("transaction_id", F.concat_ws(",", ig.missing_fields(fields)).alias("missing"))


I8_SQL = duck("SELECT transaction_id, concat_ws(',', CASE WHEN wallet_id IS NULL THEN 'wallet_id' END, CASE WHEN card_id IS NULL THEN 'card_id' END, "
              "CASE WHEN agent_id IS NULL THEN 'agent_id' END, CASE WHEN merchant_id IS NULL THEN 'merchant_id' END) AS missing FROM tx")


def i9(spark, d):
    """Codes mapped per provider; unknown ones are rejected."""
    p = ig.union_sources({n: _messages(spark, d, n) for n in ig.PROVIDERS})
    return p.groupBy("provider", "tx_type").agg(F.count("*").alias("n"))


I9_SQL = duck("""SELECT CASE WHEN channel = 'VISA_VIRTUAL' THEN 'visa' ELSE lower(operator) END AS provider, CASE WHEN event_id % 53 <> 0 THEN tx_type END AS tx_type, count(*) AS n
 FROM tx GROUP BY ALL""")


def i10(spark, d):
    tx = transactions(spark, d).withColumns({
        "amount": F.expr("CASE WHEN event_id % 31 = 0 THEN 0D ELSE amount END"), "currency": F.expr("CASE WHEN event_id % 37 = 0 THEN 'EUR' ELSE currency END"),
        "device_type": F.expr("CASE WHEN event_id % 41 = 0 THEN 'tablet' ELSE device_type END"),
        "transaction_id": F.expr("CASE WHEN event_id % 43 = 0 THEN repeat('x', 65) ELSE transaction_id END"),
        "balance_before_usd": F.expr("CASE WHEN event_id % 47 = 0 THEN -5D ELSE balance_before_usd END")})
    return tx.select("event_id", F.concat_ws("|", ig.check_unified()).alias("broken"))


I10_SQL = duck("SELECT event_id, concat_ws('|', CASE WHEN event_id % 43 = 0 THEN 'valeur invalide : transaction_id' END, "
               "CASE WHEN event_id % 37 = 0 THEN 'valeur invalide : currency' END, CASE WHEN event_id % 41 = 0 THEN 'valeur invalide : device_type' END, "
               "CASE WHEN event_id % 31 = 0 THEN 'valeur invalide : amount' END, CASE WHEN event_id % 47 = 0 THEN 'valeur invalide : balance_before_usd' END) AS broken FROM tx")


def i11(spark, d):
    tx = transactions(spark, d)
    return tx.select("transaction_id", canonical_id(F.expr("CAST(243000000000 + event_id AS double)")).alias("msisdn"),
                     canonical_id(F.expr("CASE WHEN event_id % 3 = 0 THEN CAST('NaN' AS double) END")).alias("nothing"),
                     canonical_id(F.col("device_id")).alias("text"), canonical_id(F.expr("CAST(event_id AS double)")).alias("small"))


I11_SQL = duck("SELECT transaction_id, CAST(243000000000 + event_id AS VARCHAR) AS msisdn, CAST(NULL AS VARCHAR) AS nothing, device_id AS text, CAST(event_id AS VARCHAR) AS small FROM tx")


def i12(spark, d):
    tx = transactions(spark, d)
    return tx.select("transaction_id", F.unix_micros(to_local_naive(F.col("timestamp").cast("timestamp")).cast("timestamp")).alias("local_us"))


def i13(spark, d):
    return ft.feature_input(transactions(spark, d)).select("transaction_id", "ts_us", "hour", "weekday", "day")


def i14(spark, d):
    return transactions(spark, d).select("transaction_id", ig.provider_of().alias("provider"))


def _ingested(spark, d):
    parsed = materialise(ig.union_sources({n: _messages(spark, d, n) for n in ig.PROVIDERS}), "parsed")
    valid, _ = ig.split_valid(parsed)
    scored = materialise(fact(spark, d).filter("event_id % 20 <> 3").select(
        "transaction_id", "action", "risk_level", "reason", "fraud_probability"), "scored")
    return parsed, ig.with_fallback(valid, scored)


BAD = "(event_id % 50 = 0 OR event_id % 53 = 0 OR event_id % 59 = 0 OR (channel <> 'VISA_VIRTUAL' AND wallet_id IS NULL))"


def i15(spark, d):
    return ig.outcome_counts(*_ingested(spark, d))


I15_SQL = scored_sql(f"""SELECT CASE WHEN channel = 'VISA_VIRTUAL' THEN 'visa' ELSE lower(operator) END AS provider,
 CASE WHEN {BAD} THEN 'invalid' WHEN event_id % 20 = 3 THEN 'scoring_unavailable' ELSE action END AS outcome, count(*) AS n FROM scored GROUP BY ALL""")


def i16(spark, d):
    return _ingested(spark, d)[1].select("transaction_id", "action", "risk_level", "reason", F.round("fraud_probability", 6).alias("fraud_probability"))


I16_SQL = scored_sql(f"""SELECT transaction_id, CASE WHEN down THEN 'VERIFY' ELSE action END AS action, CASE WHEN down THEN 'INCONNU' ELSE risk_level END AS risk_level,
 CASE WHEN down THEN 'scoring indisponible (politique de repli)' ELSE reason END AS reason, CASE WHEN NOT down THEN round(p, 6) END AS fraud_probability
 FROM (SELECT *, event_id % 20 = 3 AS down FROM scored WHERE NOT {BAD})""")


def i17(spark, d):
    p = ig.union_sources({n: _messages(spark, d, n) for n in ig.PROVIDERS})
    return p.select("provider", "transaction_id", (F.size("reject_reasons") == 0).alias("usable"))


I17_SQL = duck(f"SELECT CASE WHEN channel = 'VISA_VIRTUAL' THEN 'visa' ELSE lower(operator) END AS provider, transaction_id, NOT {BAD} AS usable FROM tx")


def i18(spark, d):
    p = ig.union_sources({n: _messages(spark, d, n) for n in ig.PROVIDERS})
    return p.groupBy("device_type", "access_channel").agg(F.count("*").alias("n"))


I18_SQL = duck("SELECT CASE WHEN event_id % 13 = 0 THEN 'smartphone' ELSE device_type END AS device_type, access_channel, count(*) AS n FROM tx GROUP BY ALL")


# --- sources and sinks ----------------------------------------------------------------------------
def _events(spark, d):
    f = fact(spark, d).withColumns({"is_fraud_predicted": F.lit(True), "threshold": F.lit(0.3)})
    return ev.to_events(f, ["is_new_device", "amount_to_kyc_limit"])


def s4(spark, d):
    e = ev.event_to_fact(_events(spark, d))
    both = e.withColumn("topic", F.lit("scored")).unionByName(ev.alerts_of(e).withColumn("topic", F.lit("alerts")))
    return both.groupBy("topic", "action").agg(F.count("*").alias("n"))


S4_SQL = scored_sql("SELECT 'scored' AS topic, action, count(*) AS n FROM scored GROUP BY ALL UNION ALL SELECT 'alerts', action, count(*) FROM scored WHERE action <> 'APPROVE' GROUP BY ALL")


def s5(spark, d):
    e = ev.event_to_fact(_events(spark, d))
    return e.select("transaction_id", F.unix_micros(F.col("tx_time").cast("timestamp")).alias("tx_us"), "user_id", "channel", "operator",
                    "tx_type", "access_channel", "currency", "amount_usd", "province", "device_id", "counterparty_id", "agent_id",
                    "merchant_id", "risk_level", "action", "reason", F.concat_ws("|", "rules_triggered").alias("rules_triggered"),
                    "model_version", "latency_ms", "degraded", F.element_at("features", F.lit("is_new_device")).alias("new_device"))


S5_SQL = scored_sql("""SELECT s.transaction_id, epoch_us(s.timestamp) AS tx_us, s.user_id, s.channel, s.operator, s.tx_type, s.access_channel, s.currency, s.amount_usd, s.province,
 s.device_id, tx.counterparty_id, tx.agent_id, tx.merchant_id, risk_level, action, reason, array_to_string(rules, '|') AS rules_triggered, 'rules' AS model_version,
 s.latency_ms, degraded, CAST(is_new_device AS DOUBLE) AS new_device FROM scored s JOIN tx USING (transaction_id)""")


def s6(spark, d):
    """A batch with repeats against a table that already holds a part."""
    f = stored_fact(spark, d, "transaction_id", "event_id", "tx_time", "action", "risk_level")
    twice = f.withColumn("arrival", F.explode(F.array(F.lit(1), F.lit(2)))).withColumn(
        "risk_level", F.when(F.col("arrival") == 2, F.lower("risk_level")).otherwise(F.col("risk_level")))
    return ev.new_rows(twice, f.filter("event_id % 4 = 0"), "arrival").select("transaction_id", "action", "risk_level")


S6_SQL = scored_sql("SELECT transaction_id, action, lower(risk_level) AS risk_level FROM scored WHERE event_id % 4 <> 0")


def s8(spark, d):
    """Written by week, read back with a filter that touches one week."""
    f = fact(spark, d).select("transaction_id", "tx_time", "action", "amount_usd")
    path = f"{stage_folder(spark).rstrip('/')}/fact-week-{uuid.uuid4().hex}"
    st.append_fact(f, path)
    week = spark.read.parquet(path).filter("event_week = DATE '2024-01-08'")
    return week.groupBy("action").agg(F.count("*").alias("n"), F.round(F.sum("amount_usd"), 2).alias("amount_usd"))


S8_SQL = scored_sql("""SELECT action, count(*) AS n, round(sum(amount_usd), 2) AS amount_usd FROM scored WHERE date_trunc('week', tx_time) = DATE '2024-01-08' GROUP BY action""")


def s11(spark, d):
    f = materialise(fact(spark, d).select("transaction_id", "user_id", "is_fraud", "fraud_probability", "amount_zscore_user"), "fact")
    r = st.predictions(f.select("transaction_id", "user_id", "is_fraud"), {
        "rules": f.select("transaction_id", F.col("fraud_probability").alias("score")),
        "zscore": f.select("transaction_id", F.col("amount_zscore_user").alias("score"))}, "rules", 0.3)
    return r.select("transaction_id", "user_id", "is_fraud", "pred_rules", *rounded(r, ["score_rules", "score_zscore"]))


S11_SQL = scored_sql("""SELECT transaction_id, user_id, is_fraud, CAST(p >= 0.3 AS INT) AS pred_rules, round(p + 1e-9, 6) AS score_rules,
 round(amount_zscore_user + 1e-9, 6) AS score_zscore FROM scored""")


# --- cases and audit --------------------------------------------------------------------------------
def k1(spark, d):
    f = materialise(fact(spark, d).select("transaction_id", "event_id", "tx_time", "scored_at", "user_id", "channel", "tx_type",
                                          "amount_usd", "fraud_probability", "risk_level", "action"), "fact")
    alerts = f.withColumn("turn", F.explode(F.array(F.lit(1), F.lit(2))))
    existing = case_table(f).filter("case_id % 3 = 0")
    return cs.open_cases(alerts, existing).select("transaction_id", "user_id", "risk_level", "action", "status")


K1_SQL = scored_sql("SELECT transaction_id, user_id, risk_level, action, 'OUVERT' AS status FROM scored WHERE action <> 'APPROVE' AND event_id % 3 <> 0")
HOOKS = {"VODACOM": "https://vodacom.example/hook", "ORANGE": "https://orange.example/hook"}


CASE = ["transaction_id", "event_id", "tx_time", "scored_at", "user_id", "channel", "tx_type", "amount_usd", "fraud_probability", "risk_level", "action"]


def _alert_rows(spark, d):
    """Alerts with the critical level given to some, which the rule score alone never reaches."""
    return fact(spark, d, DECIDING).filter("action <> 'APPROVE'").withColumn(
        "risk_level", F.when(F.col("event_id") % 5 == 0, "CRITIQUE").otherwise(F.col("risk_level")))


def k2(spark, d):
    return cs.notification_plan(_alert_rows(spark, d), HOOKS)


K2_SQL = scored_sql("""SELECT transaction_id, 'SMS' AS notify_channel, coalesce(wallet_id, '?') AS recipient, CASE WHEN wallet_id IS NULL THEN 'ECHEC' ELSE 'ENVOYE' END AS notify_status,
  CASE WHEN wallet_id IS NULL THEN 'pas de numéro de portefeuille' ELSE 'simulé (aucune passerelle configurée)' END AS detail FROM scored WHERE action <> 'APPROVE'
 UNION ALL SELECT transaction_id, 'EMAIL', 'fraud-team@example.org', 'ENVOYE', 'fraud-team@example.org' FROM scored WHERE action <> 'APPROVE' AND (event_id % 5 = 0 OR risk_level = 'CRITIQUE')
 UNION ALL SELECT transaction_id, 'WEBHOOK', concat('https://', lower(operator), '.example/hook'), 'ENVOYE', NULL FROM scored WHERE action <> 'APPROVE' AND operator IN ('VODACOM','ORANGE')""")


def k2_email(spark, d):
    """Subject and text for the critical alerts whose case is new."""
    rows = _alert_rows(spark, d).select(*CASE, "operator", "amount", "currency", "location_province", "reason", "rules_triggered")
    rows = materialise(rows, "alerts").withColumn("case_id", F.col("event_id"))
    opened = cs.open_cases(rows, case_table(rows).filter("case_id % 3 = 0"))
    mails = cs.opened_only(rows.filter("risk_level = 'CRITIQUE'"), opened)
    return mails.select("transaction_id", cs.email_subject().alias("subject"), cs.email_text(F.array(F.lit("a"), F.lit("b"))).alias("body"))


K2_EMAIL_SQL = scored_sql("""SELECT transaction_id, concat('[CRITIQUE] Dossier #', event_id, ' — ', tx_type, ' ', printf('%.2f', amount_usd), ' USD (', action, ')') AS subject,
  concat('Transaction ', transaction_id, ' du client ', user_id, ' (', channel, ', ', operator, ')', chr(10), 'Montant : ', amount, ' ', currency, ' (', printf('%.2f', amount_usd), ' USD) — ', location_province, chr(10),
   'Probabilité de fraude : ', printf('%.3f', p), ' — décision : ', action, ' (', reason, ')', chr(10), 'Règles déclenchées : ', CASE WHEN len(rules) = 0 THEN 'aucune' ELSE array_to_string(rules, ', ') END, chr(10),
   'Principaux facteurs : a, b', chr(10), chr(10), 'Traiter le dossier dans le tableau de bord.') AS body
 FROM scored WHERE action <> 'APPROVE' AND event_id % 3 <> 0 AND (event_id % 5 = 0 OR risk_level = 'CRITIQUE')""")


def k3(spark, d):
    return fact(spark, d, DECIDING).select("transaction_id", cs.sms_text().alias("sms"))


K3_SQL = scored_sql("""SELECT transaction_id, CASE action WHEN 'VERIFY' THEN concat('Operation de ', a, ' en attente. Si c''est bien vous, confirmez avec votre PIN sur le menu *1#. Sinon, ne faites rien et appelez le service client.')
 WHEN 'BLOCK' THEN concat('Operation de ', a, ' bloquee par securite. Si vous en etes l''auteur, contactez le service client. Ne communiquez jamais votre PIN.') END AS sms
 FROM (SELECT *, concat(replace(format('{:,}', CAST(round_even(amount, 0) AS BIGINT)), ',', ' '), ' ', currency) AS a FROM scored)""")


def k4(spark, d):
    f = materialise(_alert_rows(spark, d).select(*CASE, "wallet_id", "operator"), "alerts")
    events = cs.opened_audit_events(case_table(f), cs.notification_plan(f, HOOKS))
    return events.select("event_id", "actor", "action", "entity", "entity_id",
                         F.element_at("details", F.lit("risk_level")).alias("risk"), F.element_at("details", F.lit("notifications")).alias("notifications"))


K4_SQL = scored_sql("""SELECT concat('case-', event_id) AS event_id, 'system:alerter' AS actor, 'DOSSIER_OUVERT' AS action, 'case' AS entity, CAST(event_id AS VARCHAR) AS entity_id,
  concat('"', CASE WHEN event_id % 5 = 0 THEN 'CRITIQUE' ELSE risk_level END, '"') AS risk,
  concat('[', concat_ws(',', CASE WHEN event_id % 5 = 0 OR risk_level = 'CRITIQUE' THEN '"EMAIL"' END, '"SMS"', CASE WHEN operator IN ('VODACOM','ORANGE') THEN '"WEBHOOK"' END), ']') AS notifications
 FROM scored WHERE action <> 'APPROVE'""")


def _requests(spark, d):
    """Every event is a request on the case of its user, so cases see hundreds of requests."""
    return transactions(spark, d).select(
        F.expr("CAST(substr(user_id, 2) AS bigint) * 7 + event_id % 7").alias("case_id"), F.col("event_id").alias("seq"),
        F.expr("CASE event_id % 11 WHEN 0 THEN 'EN_COURS' WHEN 1 THEN 'OUVERT' WHEN 2 THEN 'FRAUDE_CONFIRMEE' WHEN 3 THEN 'FAUX_POSITIF' END").alias("status"),
        F.expr("CASE event_id % 13 WHEN 5 THEN 'note' WHEN 6 THEN '' END").alias("resolution_note"))


def k5(spark, d):
    return cs.run_workflow(_requests(spark, d)).select("case_id", "seq", "accepted", "reject_reason", "status_after")


# the state machine as a fold, one request of every case per step
K5_SQL = duck("""
WITH RECURSIVE rq AS (SELECT CAST(substr(user_id, 2) AS BIGINT) * 7 + event_id % 7 AS case_id, event_id AS seq,
   CASE event_id % 11 WHEN 0 THEN 'EN_COURS' WHEN 1 THEN 'OUVERT' WHEN 2 THEN 'FRAUDE_CONFIRMEE' WHEN 3 THEN 'FAUX_POSITIF' END AS status,
   CASE event_id % 13 WHEN 5 THEN 'note' WHEN 6 THEN '' END AS note FROM tx),
n AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY seq) AS pos FROM rq),
f AS (
  SELECT case_id, CAST(0 AS BIGINT) AS pos, CAST(NULL AS BIGINT) AS seq, 'OUVERT' AS st, CAST('' AS VARCHAR) AS nt, true AS accepted, CAST(NULL AS VARCHAR) AS reject_reason FROM n WHERE pos = 1
  UNION ALL
  SELECT case_id, pos, seq, CASE WHEN rr IS NULL AND asks THEN status ELSE st END, CASE WHEN rr IS NULL AND note IS NOT NULL THEN note ELSE nt END, rr IS NULL, rr FROM (
    SELECT *, CASE WHEN asks AND st IN ('FRAUDE_CONFIRMEE','FAUX_POSITIF') THEN concat('transition ', st, ' -> ', status, ' interdite')
                   WHEN asks AND status IN ('FRAUDE_CONFIRMEE','FAUX_POSITIF') AND coalesce(note, '') = '' AND nt = '' THEN 'une note de résolution est obligatoire' END AS rr
    FROM (SELECT n.case_id, n.pos, n.seq, n.status, n.note, f.st, f.nt, n.status IS NOT NULL AND n.status <> f.st AS asks
          FROM f JOIN n ON n.case_id = f.case_id AND n.pos = f.pos + 1)))
SELECT case_id, seq, accepted, reject_reason, st AS status_after FROM f WHERE pos > 0""").replace("WITH tx AS", "WITH RECURSIVE tx AS MATERIALIZED", 1).replace(",\nRECURSIVE rq AS", ",\nrq AS").replace("n AS (SELECT *, row_number()", "n AS MATERIALIZED (SELECT *, row_number()")


def _audit(spark, d):
    """Audit events of two kinds from the transactions, some without an event id, some repeated."""
    tx = transactions(spark, d)
    logged = tx.filter("event_id % 3 <> 0").select(
        F.expr("CASE WHEN event_id % 5 <> 0 THEN 'e' || CAST(event_id DIV 2 AS string) END").alias("event_id"),
        F.col("timestamp").alias("ts"), F.col("user_id").alias("actor"), F.col("tx_type").alias("action"),
        F.lit("tx").alias("entity"), F.col("transaction_id").alias("entity_id"),
        F.create_map(F.lit("k"), F.col("event_id").cast("string")).alias("details"))
    feedback = tx.filter("event_id % 3 = 0").select(
        F.expr("CASE WHEN event_id % 2 = 0 THEN 'f' || CAST(event_id AS string) END").alias("event_id"), F.col("timestamp").alias("ts"),
        "transaction_id", F.col("is_fraud").alias("label"), F.lit("ana@x").alias("analyst"), F.expr("event_id DIV 6").alias("case_id"))
    return au.normalise(logged, feedback)


AUDIT = """
au AS (SELECT CASE WHEN event_id % 5 <> 0 THEN concat('e', event_id // 2) END AS event_id, timestamp AS ts, user_id AS actor, tx_type AS action, 'tx' AS entity, transaction_id AS entity_id
       FROM tx WHERE event_id % 3 <> 0
  UNION ALL SELECT CASE WHEN event_id % 2 = 0 THEN concat('f', event_id) ELSE concat('fb-', event_id // 6, '-', is_fraud) END, timestamp, 'ana@x', 'VERDICT_ANALYSTE', 'transaction', transaction_id
       FROM tx WHERE event_id % 3 = 0)
"""


def k6(spark, d):
    a = _audit(spark, d)
    return a.select(F.when(F.length("event_id") < 64, F.col("event_id")).alias("event_id"), "actor", "action", "entity", "entity_id")


K6_SQL = duck(f"WITH {AUDIT.strip()} SELECT event_id, actor, action, entity, entity_id FROM au")


def k7(spark, d):
    a = _audit(spark, d)
    seen = a.filter("event_id LIKE 'f%' AND length(event_id) < 64").select("event_id")
    return au.drop_repeats(a, seen).select(F.when(F.length("event_id") < 64, F.col("event_id")).alias("event_id"), "entity_id")


K7_SQL = duck(f"""WITH {AUDIT.strip()} SELECT event_id, min_by(entity_id, ts) AS entity_id FROM au WHERE event_id IS NOT NULL AND NOT starts_with(event_id, 'f') GROUP BY event_id
 UNION ALL SELECT NULL, entity_id FROM au WHERE event_id IS NULL""")


def _log_events(spark, d):
    return transactions(spark, d).select(
        F.col("event_id").alias("id"), F.col("timestamp").cast("timestamp").alias("ts"), F.col("user_id").alias("actor"), F.col("tx_type").alias("action"),
        F.lit("tx").alias("entity"), F.when(F.col("event_id") % 9 != 0, F.col("transaction_id")).alias("entity_id"),
        F.create_map(F.lit("n"), F.col("event_id").cast("string"), F.lit("device"), F.concat(F.lit('"'), F.col("device_id"), F.lit('"'))).alias("details"),
        F.date_format("timestamp", "yyyy-MM-dd").alias("day"))


def _log(spark, d):
    return au.hash_chain(_log_events(spark, d), key=["actor", "day"], order=["ts", "id"])


CHAIN = """
lg AS (SELECT event_id AS id, user_id AS actor, strftime(timestamp, '%Y-%m-%d') AS day, row_number() OVER (PARTITION BY user_id, strftime(timestamp, '%Y-%m-%d') ORDER BY timestamp, event_id) AS pos,
   concat('{"action":"', tx_type, '","actor":"', user_id, '","details":{"device":"', device_id, '","n":') AS h0, event_id AS n,
   concat('},"entity":"tx","entity_id":', CASE WHEN event_id % 9 <> 0 THEN concat('"', transaction_id, '"') ELSE 'null' END, ',"prev":"') AS h1,
   concat('","ts":"', strftime(timestamp, '%Y-%m-%dT%H:%M:%S'), CASE WHEN epoch_us(timestamp) % 1000000 <> 0 THEN strftime(timestamp, '.%f') ELSE '' END, '+00:00"}') AS t FROM tx),
ch AS (
  SELECT id, actor, day, pos, repeat('0', 64) AS prev_hash, sha256(concat(h0, n, h1, repeat('0', 64), t)) AS hash FROM lg WHERE pos = 1
  UNION ALL SELECT lg.id, lg.actor, lg.day, lg.pos, ch.hash, sha256(concat(h0, n, h1, ch.hash, t)) FROM ch JOIN lg ON lg.actor = ch.actor AND lg.day = ch.day AND lg.pos = ch.pos + 1)
"""


def chain_sql(body: str) -> str:
    return duck(f"WITH {CHAIN.strip()}\n{body}").replace("WITH tx AS", "WITH RECURSIVE tx AS MATERIALIZED", 1).replace("lg AS (", "lg AS MATERIALIZED (", 1)


def k8(spark, d):
    return _log(spark, d).select("id", "prev_hash", "hash")


def k8_append(spark, d):
    """The log in two batches, the second continued from the tips of the first."""
    events = _log_events(spark, d)
    ranked = materialise(events.withColumn("half", F.ntile(2).over(Window.partitionBy("actor", "day").orderBy("ts", "id"))), "log-halves")
    first = materialise(au.hash_chain(ranked.filter("half = 1"), key=["actor", "day"], order=["ts", "id"]), "log-first")
    tips = au.seal_chains(first, key=["actor", "day"], order=["ts", "id"])
    second = au.hash_chain(ranked.filter("half = 2"), key=["actor", "day"], order=["ts", "id"], tips=tips)
    return first.select("id", "prev_hash", "hash").union(second.select("id", "prev_hash", "hash"))


def k9(spark, d):
    """Some entries edited, some deleted after the chain was built."""
    log = materialise(_log(spark, d), "log").filter("id % 100 <> 33").withColumn(
        "details", F.when(F.col("id") % 100 == 7, F.map_concat(F.map_filter("details", lambda k, _: k != "n"),
                                                               F.create_map(F.lit("n"), F.lit("0")))).otherwise(F.col("details")))
    return au.verify_chain(log, key=["actor", "day"])


K9_SQL = chain_sql("""
SELECT actor, day, bool_and(NOT bad) AS valid, count(*) FILTER (WHERE bu = 0) AS checked, min(id) FILTER (WHERE bad) AS broken_at_id FROM (
 SELECT *, sum(bad::INT) OVER (PARTITION BY actor, day ORDER BY id) AS bu FROM (
  SELECT ch.id, ch.actor, ch.day, prev_hash <> coalesce(lag(hash) OVER (PARTITION BY ch.actor, ch.day ORDER BY ch.id), repeat('0', 64))
     OR sha256(concat(h0, CASE WHEN ch.id % 100 = 7 THEN 0 ELSE n END, h1, prev_hash, t)) <> hash AS bad FROM ch JOIN lg USING (id) WHERE ch.id % 100 <> 33)) GROUP BY actor, day""")


def k10(spark, d):
    before = transactions(spark, d).select(F.col("event_id").alias("id"), "user_id", "tx_type", "amount_usd")
    after = before.filter("id % 101 <> 5").withColumn("amount_usd", F.expr("CASE WHEN id % 103 = 4 THEN amount_usd + 1 ELSE amount_usd END"))
    return au.changed_entries(before, after)


K10_SQL = duck("SELECT event_id AS id, CASE WHEN event_id % 101 = 5 THEN 'DELETE' ELSE 'UPDATE' END AS change FROM tx WHERE event_id % 101 = 5 OR event_id % 103 = 4")


def q12(spark, d):
    log = transactions(spark, d).select(F.col("event_id").alias("id"), F.col("user_id").alias("actor"), F.col("tx_type").alias("action"))
    return rp.list_audit(log, action="CASH_IN", page=2, size=50)


Q12_SQL = duck("SELECT event_id AS id, user_id AS actor, tx_type AS action, count(*) OVER () AS total FROM tx WHERE tx_type = 'CASH_IN' ORDER BY event_id DESC LIMIT 50 OFFSET 50")

# --- monitoring --------------------------------------------------------------------------------------
SLIDING = """
sl AS (SELECT scored.*, date_trunc('minute', scored_at) - to_minutes(CAST(k AS INT)) + INTERVAL 5 MINUTES AS at FROM scored, range(0, 5) r(k))
"""


def _upto_sql(value: str, buckets: list[float]) -> str:
    return "[" + ", ".join(f"count(*) FILTER (WHERE {value} <= {b!r}e0)" for b in buckets) + ", count(*)]"


def _quantile_sql(q: float, buckets: list[float]) -> str:
    arms = []
    for i, hi in enumerate(buckets):
        lo, below = (buckets[i - 1], f"u[{i}]") if i else (0.0, "0")
        arms.append(f"WHEN u[{i + 1}] >= n * {q}e0 THEN {lo!r}e0 + ({hi!r}e0 - {lo!r}e0) * (n * {q}e0 - {below}) / (u[{i + 1}] - {below})")
    return "CASE " + " ".join(arms) + f" ELSE {buckets[-1]!r}e0 END"


def _at(df):
    return df.withColumn("at", F.unix_micros(F.col("at").cast("timestamp")))


def w1(spark, d):
    r = _at(mo.latency_quantiles(fact(spark, d), "scored_at", F.col("latency_ms") / 1000))
    r = r.select("at", "n", "high", *rounded(r, ["p50", "p95", "p99"]))
    return r


W1_SQL = scored_sql(f"""SELECT epoch_us(at) AS at, n, p99 > 0.1 AS high, round(p50 + 1e-9, 6) AS p50, round(p95 + 1e-9, 6) AS p95, round(p99 + 1e-9, 6) AS p99 FROM (
 SELECT at, n, {_quantile_sql(0.5, mo.LATENCY_BUCKETS)} AS p50, {_quantile_sql(0.95, mo.LATENCY_BUCKETS)} AS p95, {_quantile_sql(0.99, mo.LATENCY_BUCKETS)} AS p99
 FROM (SELECT at, count(*) AS n, {_upto_sql('latency_ms / 1000', mo.LATENCY_BUCKETS)} AS u FROM sl GROUP BY at))""", SLIDING.strip())


def w1_firing(spark, d):
    r = mo.sustained(mo.latency_quantiles(fact(spark, d), "scored_at", F.col("latency_ms") / 1000), "high", 5)
    return _at(r.filter("firing")).select("at")


W1_FIRING_SQL = scored_sql(f"""SELECT epoch_us(at) AS at FROM (SELECT at, sum((p99 > 0.1)::INT) OVER (ORDER BY at RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) AS held FROM (
 SELECT at, {_quantile_sql(0.99, mo.LATENCY_BUCKETS)} AS p99 FROM (SELECT at, count(*) AS n, {_upto_sql('latency_ms / 1000', mo.LATENCY_BUCKETS)} AS u FROM sl GROUP BY at))) WHERE held = 6""", SLIDING.strip())


def w2(spark, d):
    r = _at(mo.sustained(mo.alert_rate(fact(spark, d)), "high", 5))
    return r.select("at", "alerts", "n", "high", "firing")


W2_SQL = scored_sql("""SELECT epoch_us(at) AS at, alerts, n, alerts / n > 0.05e0 AS high,
 sum((alerts / n > 0.05e0)::INT) OVER (ORDER BY at RANGE BETWEEN INTERVAL 5 MINUTES PRECEDING AND CURRENT ROW) = 6 AS firing
 FROM (SELECT at, count(*) FILTER (WHERE action <> 'APPROVE') AS alerts, count(*) AS n FROM sl GROUP BY at)""", SLIDING.strip())


def w3(spark, d):
    r = mo.windowed_counts(fact(spark, d), "scored_at", "5 minutes", {
        "degraded": F.col("degraded"), "failed": F.col("status") != "SUCCESS"}, by=["operator"], slide="1 minute")
    return _at(r)


W3_SQL = scored_sql("SELECT epoch_us(at) AS at, operator, count(*) FILTER (WHERE degraded) AS degraded, count(*) FILTER (WHERE status <> 'SUCCESS') AS failed FROM sl GROUP BY at, operator", SLIDING.strip())


def w4(spark, d):
    r = mo.rates(fact(spark, d), "scored_at", ["action", "risk_level", "channel"], 60)
    return _at(r.withColumn("per_second", F.round("per_second", 6)))


W4_SQL = scored_sql("SELECT epoch_us(date_trunc('minute', scored_at)) AS at, action, risk_level, channel, round(count(*) / 60, 6) AS per_second FROM scored GROUP BY ALL")


def w5(spark, d):
    r = mo.histogram(fact(spark, d), F.col("fraud_probability"), mo.PROBABILITY_BUCKETS)
    return r.select(F.when(F.col("le") < 10, F.col("le")).alias("le"), "n", F.round("share", 6).alias("share"))


def _histogram_sql(value: str, buckets: list[float]) -> str:
    rows = [f"SELECT {b!r}e0 AS le, count(*) FILTER (WHERE {value} <= {b!r}e0) AS n, round(count(*) FILTER (WHERE {value} <= {b!r}e0) / count(*), 6) AS share FROM scored" for b in buckets]
    return " UNION ALL ".join([*rows, "SELECT NULL, count(*), 1.0e0 FROM scored"])


def w6(spark, d):
    f = fact(spark, d).withColumn("provider", F.expr("CASE WHEN channel = 'VISA_VIRTUAL' THEN 'visa' ELSE lower(operator) END"))
    r = mo.latency_quantiles(f, "scored_at", F.col("latency_ms") / 1000, mo.PROVIDER_LATENCY_BUCKETS, "1 hour", "1 hour", by=["provider"])
    return _at(r).select("at", "provider", "n", F.round(F.col("p95") + 1e-9, 6).alias("p95"))


W6_SQL = scored_sql(f"""SELECT epoch_us(at) AS at, provider, n, round({_quantile_sql(0.95, mo.PROVIDER_LATENCY_BUCKETS)} + 1e-9, 6) AS p95 FROM (
 SELECT date_trunc('hour', scored_at) + INTERVAL 1 HOUR AS at, CASE WHEN channel = 'VISA_VIRTUAL' THEN 'visa' ELSE lower(operator) END AS provider, count(*) AS n,
   {_upto_sql('latency_ms / 1000', mo.PROVIDER_LATENCY_BUCKETS)} AS u FROM scored GROUP BY ALL)""")


def w7(spark, d):
    """Hourly alarm series (mean probability above its limit) that holds for three hours."""
    f = fact(spark, d)
    series = f.groupBy(F.window("scored_at", "1 hour").end.alias("at")).agg((F.avg("fraud_probability") > 0.04).alias("alarm"))
    return _at(mo.sustained(series, "alarm", 180, 60)).select("at", "alarm", "firing")


W7_SQL = scored_sql("""SELECT epoch_us(at) AS at, alarm, sum(alarm::INT) OVER (ORDER BY at RANGE BETWEEN INTERVAL 3 HOURS PRECEDING AND CURRENT ROW) = 4 AS firing
 FROM (SELECT date_trunc('hour', scored_at) + INTERVAL 1 HOUR AS at, avg(p) > 0.04 AS alarm FROM scored GROUP BY 1)""")


def w8(spark, d):
    r = mo.histogram(fact(spark, d), F.col("latency_ms") / 1000, mo.LATENCY_BUCKETS)
    return r.select(F.when(F.col("le") < 10, F.col("le")).alias("le"), "n", F.round("share", 6).alias("share"))


def build() -> dict:
    out = {f"i{i}_from_{n}": (_parsed(n), _expected(n)) for i, n in enumerate(ig.PROVIDERS, 1)}
    out |= {
        "i5_to_messages": (i5, I5_SQL), "i6_to_usd": (i6, I6_SQL), "i7_parse_time": (i7, I7_SQL), "i8_required_fields": (i8, I8_SQL),
        "i9_code_mapping": (i9, I9_SQL), "i10_unified_checks": (i10, I10_SQL), "i11_canonical_id": (i11, I11_SQL),
        "i12_to_local_naive": (i12, duck("SELECT transaction_id, epoch_us(timestamp) + 3600000000 AS local_us FROM tx")),
        "i13_feature_input": (i13, duck("SELECT transaction_id, epoch_us(timestamp) AS ts_us, hour(timestamp) AS hour, isodow(timestamp) - 1 AS weekday, day(timestamp) AS day FROM tx")),
        "i14_provider_of": (i14, duck("SELECT transaction_id, CASE WHEN channel = 'VISA_VIRTUAL' THEN 'visa' ELSE lower(operator) END AS provider FROM tx")),
        "i15_outcome_counts": (i15, I15_SQL), "i16_fallback": (i16, I16_SQL), "i17_union_sources": (i17, I17_SQL), "i18_defaults": (i18, I18_SQL),
        "s4_alert_split": (s4, S4_SQL), "s5_event_to_fact": (s5, S5_SQL), "s6_append_once": (s6, S6_SQL), "s8_weekly_partitions": (s8, S8_SQL),
        "s11_predictions": (s11, S11_SQL),
        "k1_open_cases": (k1, K1_SQL), "k2_notification_plan": (k2, K2_SQL), "k3_sms_text": (k3, K3_SQL), "k4_opened_events": (k4, K4_SQL),
        "k5_case_workflow": (k5, K5_SQL), "k6_normalise": (k6, K6_SQL), "k7_drop_repeats": (k7, K7_SQL),
        "k8_hash_chain": (k8, chain_sql("SELECT id, prev_hash, hash FROM ch")), "k2_email": (k2_email, K2_EMAIL_SQL), "k8_append": (k8_append, chain_sql("SELECT id, prev_hash, hash FROM ch")), "k9_verify_chain": (k9, K9_SQL), "k10_changed_entries": (k10, K10_SQL),
        "q12_list_audit": (q12, Q12_SQL),
        "w1_latency_quantiles": (w1, W1_SQL), "w1_latency_alert": (w1_firing, W1_FIRING_SQL), "w2_alert_rate": (w2, W2_SQL), "w3_windowed_counts": (w3, W3_SQL),
        "w4_rates": (w4, W4_SQL), "w5_probability_histogram": (w5, scored_sql(_histogram_sql("p", mo.PROBABILITY_BUCKETS))), "w6_provider_latency": (w6, W6_SQL),
        "w7_drift_alarm": (w7, W7_SQL), "w8_latency_histogram": (w8, scored_sql(_histogram_sql("latency_ms / 1000", mo.LATENCY_BUCKETS))),
    }
    # AT is a keyword in DuckDB
    return {n: (run, re.sub(r'(?<!")\bat\b(?!")', '"at"', sql) if n.startswith("w") else sql) for n, (run, sql) in out.items()}
