"""Cases opened by alerts, the notifications they cause, and the case workflow."""
from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import lookup
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.schema import FINAL_LABEL

# --- fixed values: recipients, statuses and message texts -----------------------------------------
FRAUD_TEAM = "fraud-team@example.org"
SENT, FAILED = "ENVOYE", "ECHEC"
NO_WALLET = "pas de numéro de portefeuille"
SIMULATED = "simulé (aucune passerelle configurée)"
SMS_VERIFY = ("Operation de ", " en attente. Si c'est bien vous, confirmez avec votre PIN sur le menu *1#. "
              "Sinon, ne faites rien et appelez le service client.")
SMS_BLOCK = ("Operation de ", " bloquee par securite. Si vous en etes l'auteur, contactez le service client. "
             "Ne communiquez jamais votre PIN.")
STATUSES = ["OUVERT", "EN_COURS", "FRAUDE_CONFIRMEE", "FAUX_POSITIF"]
NOTE_REQUIRED = "une note de résolution est obligatoire"
# --------------------------------------------------------------------------------------------------
CASE_COLUMNS = ["transaction_id", "tx_time", "user_id", "channel", "tx_type", "amount_usd",
                "fraud_probability", "risk_level", "action"]


def open_cases(alerts: DataFrame, cases: DataFrame, arrival: str = "scored_at") -> DataFrame:
    """New cases: one per alerted transaction not yet in `cases`, the first arrival wins."""
    columns = list(dict.fromkeys([*CASE_COLUMNS, "transaction_id"]))
    first = (alerts.filter(F.col("action") != "APPROVE").groupBy("transaction_id")
             .agg(F.min_by(F.struct(*columns), F.col(arrival)).alias("c")).select("c.*"))
    return first.join(cases.select("transaction_id"), "transaction_id", "left_anti").withColumn("status", F.lit("OUVERT"))


def sms_text() -> Column:
    """Text for a verification or a block, null otherwise. The amount has no decimals and is grouped by
    spaces."""
    amount = F.concat(F.translate(F.format_number("amount", 0), ",", " "), F.lit(" "), F.col("currency"))

    def text(parts: tuple[str, str]) -> Column:
        return F.concat(F.lit(parts[0]), amount, F.lit(parts[1]))

    return F.when(F.col("action") == "VERIFY", text(SMS_VERIFY)).when(F.col("action") == "BLOCK", text(SMS_BLOCK))


def notification_plan(alerts: DataFrame, webhooks: Mapping[str, str] | None = None,
                      team: str = FRAUD_TEAM) -> DataFrame:
    """(transaction_id, channel, recipient, status, detail): SMS to the client, e-mail to the team for
    critical alerts, webhook where the operator has an address."""
    wallet = F.when(F.length("wallet_id") > 0, F.col("wallet_id"))

    def note(channel: str, recipient: Column, status: Column, detail: Column) -> Column:
        return F.struct(F.lit(channel).alias("notify_channel"), recipient.alias("recipient"),
                        status.alias("notify_status"), detail.alias("detail"))

    sms = note("SMS", F.coalesce(wallet, F.lit("?")), F.when(wallet.isNull(), FAILED).otherwise(SENT),
               F.when(wallet.isNull(), NO_WALLET).otherwise(SIMULATED))
    email = note("EMAIL", F.lit(team), F.lit(SENT), F.lit(team))
    parts = [F.when(F.col("action").isin("VERIFY", "BLOCK"), sms), F.when(F.col("risk_level") == "CRITIQUE", email)]
    if webhooks:
        address = lookup(dict(webhooks), F.col("operator"))
        parts.append(F.when(address.isNotNull(), note("WEBHOOK", address, F.lit(SENT), F.lit(None).cast("string"))))
    plan = F.filter(F.array(*parts), lambda n: n.isNotNull())
    return alerts.select("transaction_id", F.inline(plan))


def opened_only(alerts: DataFrame, opened: DataFrame) -> DataFrame:
    """The alerts whose case was newly opened; a repeated message notifies nobody again."""
    return alerts.join(opened.select("transaction_id"), "transaction_id", "left_semi")


def email_subject() -> Column:
    return F.concat(F.lit("["), F.col("risk_level"), F.lit("] Dossier #"), F.col("case_id").cast("string"), F.lit(" — "), F.col("tx_type"), F.lit(" "),
                    F.format_string("%.2f", F.col("amount_usd").cast("double")), F.lit(" USD ("), F.col("action"), F.lit(")"))


def email_text(factors: Column | None = None) -> Column:
    """Body of the team's e-mail; `factors` is an array of feature names, the first four are listed."""
    top = F.lit("") if factors is None else F.concat_ws(", ", F.slice(factors, 1, 4))
    rules = F.concat_ws(", ", "rules_triggered")
    part = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat(
        F.lit("Transaction "), F.col("transaction_id"), F.lit(" du client "), F.col("user_id"), F.lit(" ("), F.col("channel"), F.lit(", "), part("operator"), F.lit(")\n"),
        F.lit("Montant : "), part("amount"), F.lit(" "), F.col("currency"), F.lit(" ("), F.format_string("%.2f", F.col("amount_usd").cast("double")),
        F.lit(" USD) — "), part("location_province"), F.lit("\n"),
        F.lit("Probabilité de fraude : "), F.format_string("%.3f", F.col("fraud_probability").cast("double")), F.lit(" — décision : "), F.col("action"),
        F.lit(" ("), F.col("reason"), F.lit(")\n"),
        F.lit("Règles déclenchées : "), F.when(rules == "", "aucune").otherwise(rules), F.lit("\n"),
        F.lit("Principaux facteurs : "), F.when(top == "", "n/d").otherwise(top), F.lit("\n\nTraiter le dossier dans le tableau de bord."))


def opened_audit_events(cases: DataFrame, notifications: DataFrame, case_id: str = "case_id") -> DataFrame:
    """Audit event per opened case; details hold JSON values."""
    channels = notifications.groupBy("transaction_id").agg(F.array_sort(F.collect_list("notify_channel")).alias("__n"))
    joined = cases.join(channels, "transaction_id", "left")

    def text(c: str) -> Column:
        listed = F.to_json(F.array(F.col(c)))              # escaped as JSON asks
        return listed.substr(F.lit(2), F.length(listed) - 2)

    empty = F.array().cast("array<string>")
    return joined.select(
        F.concat(F.lit("case-"), F.col(case_id).cast("string")).alias("event_id"), F.col("tx_time").alias("ts"),
        F.lit("system:alerter").alias("actor"), F.lit("DOSSIER_OUVERT").alias("action"),
        F.lit("case").alias("entity"), F.col(case_id).cast("string").alias("entity_id"),
        F.create_map(F.lit("transaction_id"), text("transaction_id"), F.lit("risk_level"), text("risk_level"),
                     F.lit("action"), text("action"),
                     F.lit("notifications"), F.to_json(F.coalesce("__n", empty))).alias("details"))


def run_workflow(requests: DataFrame, policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Case requests (case_id, seq, status?, resolution_note?) in order, from OUVERT: add `accepted`,
    `reject_reason` and `status_after`.

    Open and in-progress follow each other freely; closing needs a note, given now or before; a closed
    case takes no other status. So the case closes at its first closing request that has a note, which
    two running scans find for a case of any length.
    """
    final = F.coalesce(F.col("status").isin(list(FINAL_LABEL)), F.lit(False))
    own_note = F.coalesce(F.length("resolution_note") > 0, F.lit(False))
    # a closing request without a note of its own either is refused or leaves the note as it was
    recorded = F.when(~(final & ~own_note), F.col("resolution_note"))
    noted = running(requests, ["case_id"], ["seq"], lasts={"__note": recorded}, policy=policy)
    closes = final & (own_note | F.coalesce(F.length("__note") > 0, F.lit(False)))
    moved = noted.withColumn("__closes", closes)
    open_status = F.when(~final & F.col("status").isNotNull(), F.col("status"))
    state = running(moved, ["case_id"], ["seq"], policy=policy,
                    mins={"__end": F.when(F.col("__closes"), F.struct("seq", "status"))},
                    lasts={"__open": open_status})
    current = F.coalesce(F.col("__end.status"), F.col("__open"), F.lit("OUVERT"))
    closed = F.col("__end").isNotNull()
    asks = F.col("status").isNotNull() & (F.col("status") != current)
    reason = (F.when(asks & closed, F.concat(F.lit("transition "), current, F.lit(" -> "), F.col("status"), F.lit(" interdite")))
              .when(asks & final & ~F.col("__closes"), F.lit(NOTE_REQUIRED)))
    after = F.when(asks & reason.isNull(), F.col("status")).otherwise(current)
    return state.select(*requests.columns, reason.isNull().alias("accepted"), reason.alias("reject_reason"),
                        after.alias("status_after"))


def case_labels(workflow: DataFrame) -> DataFrame:
    """(case_id, label) of the cases a workflow closed."""
    final = workflow.filter(F.col("accepted") & F.col("status").isin(list(FINAL_LABEL)))
    return final.groupBy("case_id").agg(F.min_by("status", "seq").alias("status")).select(
        "case_id", lookup(FINAL_LABEL, F.col("status")).alias("label"))
