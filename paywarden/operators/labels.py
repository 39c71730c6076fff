"""Analyst labels, the retraining data set, and the champion / challenger decision."""
from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.functions.columns import MICROS, epoch_us
from paywarden.operators.evaluate import evaluate
from paywarden.plans.scan import DEFAULT_POLICY, SkewPolicy, running
from paywarden.schema import FINAL_LABEL

# --- fixed values -------------------------------------------------------------------------------
MATURITY_DAYS = 7
MIN_LABELED, MIN_FRAUDS = 2000, 30
AP_GAIN, RECALL_LOSS = 0.002, 0.01
NEW_LABELS, MAX_AGE_HOURS = 500, 168
COMPLAINT_PREFIX = "Plainte client : "
NOT_FOUND, ALREADY_CLOSED, BAD_NOTE = "transaction introuvable", "dossier déjà clos", "note invalide"
NOTE_MIN, NOTE_MAX = 5, 2000
# -------------------------------------------------------------------------------------------------


def resolve_labels(fact: DataFrame, maturity_days: int = MATURITY_DAYS) -> DataFrame:
    """Add `y`: the label if there is one, 0 for unlabelled rows old enough; other rows are dropped."""
    newest = fact.agg(F.max(epoch_us("tx_time"))).scalar()
    mature = epoch_us("tx_time") <= newest - maturity_days * 86_400 * MICROS
    y = F.coalesce(F.col("label"), F.when(mature, F.lit(0)))
    return fact.withColumn("y", y.cast("int")).filter(F.col("y").isNotNull())


def production_split(df: DataFrame, order: Sequence[str] = ("tx_time", "transaction_id"),
                     policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Add `part` by rank in time: first half fit, next fifth val, the rest eval."""
    ranked = running(df, [], list(order), sums={"__rank": F.lit(1)}, inclusive=True, policy=policy)
    share = F.col("__rank") / df.agg(F.count("*")).scalar()
    return ranked.withColumn("part", F.when(share <= 0.5, "fit").when(share <= 0.7, "val").otherwise("eval")).drop("__rank")


def history_split(df: DataFrame, bounds: DataFrame, ts: str = "timestamp") -> DataFrame:
    """Add `part` (fit, early_stop, val) by the champion's split bounds; its test period is dropped."""
    at = epoch_us(ts)
    cut = {n: bounds.select(n).scalar() for n in ("early_stop_from_us", "val_from_us", "test_from_us")}
    return df.filter(at < cut["test_from_us"]).withColumn(
        "part", F.when(at < cut["early_stop_from_us"], "fit").when(at < cut["val_from_us"], "early_stop").otherwise("val"))


def features_from_map(df: DataFrame, names: Sequence[str], column: str = "features") -> DataFrame:
    """Feature columns of a stored map, absent ones 0."""
    return df.withColumns({n: F.coalesce(F.try_element_at(F.col(column), F.lit(n)), F.lit(0.0)) for n in names})


def training_table(history: DataFrame, production: DataFrame, names: Sequence[str]) -> DataFrame:
    """History and production in one table; the champion's probability exists for production only."""
    keys = ["transaction_id", "timestamp", "user_id", "channel", "y", "part"]
    old = history.select(*keys, *names).withColumn("champion_proba", F.lit(None).cast("double"))
    new = production.select(*keys, *[F.coalesce(F.col(n), F.lit(0.0)).alias(n) for n in names], "champion_proba")
    return old.unionByName(new)


def enough_labels(labeled: DataFrame, force: bool = False, min_labeled: int = MIN_LABELED,
                  min_frauds: int = MIN_FRAUDS) -> DataFrame:
    """One row: labelled rows, frauds among them, and whether retraining may go ahead."""
    counts = labeled.agg(F.count("*").alias("n_labeled"), F.coalesce(F.sum("y"), F.lit(0)).alias("n_frauds"))
    enough = (F.col("n_labeled") >= min_labeled) & (F.col("n_frauds") >= min_frauds)
    return counts.withColumn("go", enough | F.lit(force))


def champion_vs_challenger(evaluation: DataFrame, champion_threshold: float, challenger_threshold: float,
                           policy: SkewPolicy = DEFAULT_POLICY) -> DataFrame:
    """Metrics of the champion's recorded probabilities and of the challenger's on the last slice."""
    rows = [evaluate(evaluation, t, "y", column, policy=policy).withColumn("model", F.lit(name))
            for name, column, t in [("champion", "champion_proba", champion_threshold),
                                    ("challenger", "challenger_proba", challenger_threshold)]]
    return rows[0].unionByName(rows[1])


def promotion(metrics: DataFrame, dry_run: bool = False) -> DataFrame:
    """Status of the challenger: CHAMPION (CHALLENGER on a dry run) if better, else REJETE."""
    def of(model: str, name: str) -> Column:
        return F.max(F.when(F.col("model") == model, F.col(name)))

    better = ((of("challenger", "pr_auc") >= of("champion", "pr_auc") + AP_GAIN)
              & (of("challenger", "recall") >= of("champion", "recall") - RECALL_LOSS))
    return metrics.agg(F.coalesce(better, F.lit(False)).alias("better")).withColumn(
        "status", F.when(~F.col("better"), "REJETE").otherwise("CHALLENGER" if dry_run else "CHAMPION"))


def register(registry: DataFrame, entry: DataFrame) -> DataFrame:
    """Registry with the new entry; a new champion archives the old one."""
    crowned = entry.agg(F.max((F.col("status") == "CHAMPION").cast("int"))).scalar() == 1
    archived = F.when((F.col("status") == "CHAMPION") & crowned, "ARCHIVE").otherwise(F.col("status"))
    return registry.withColumn("status", archived).unionByName(entry.select(*registry.columns))


def retrain_trigger(fact: DataFrame, registry: DataFrame, now: str, drift_alarm: bool) -> DataFrame:
    """One row: new labels since the last model, its age, and the reasons to retrain."""
    last = registry.agg(F.max("created_at")).scalar()
    counts = fact.filter(F.col("label").isNotNull()).agg(
        F.count_if(F.coalesce(F.col("labeled_at") > last, last.isNull())).alias("new_labels"))
    age = (epoch_us(F.lit(now).cast("timestamp_ntz")) - epoch_us(last)) / (3600 * MICROS)
    reasons = F.array(
        F.when(F.col("new_labels") >= NEW_LABELS, F.concat(F.col("new_labels").cast("string"), F.lit(" nouvelles étiquettes"))),
        F.when(F.lit(drift_alarm), F.lit("dérive détectée")),
        F.when(F.col("age_h") > MAX_AGE_HOURS, F.concat(F.lit("modèle vieux de "), F.bround("age_h", 0).cast("bigint").cast("string"), F.lit(" h"))))
    out = counts.withColumn("age_h", age).withColumn("reasons", F.filter(reasons, lambda r: r.isNotNull()))
    return out.withColumn("retrain", F.size("reasons") > 0)


def apply_verdicts(fact: DataFrame, feedback: DataFrame) -> DataFrame:
    """Fact with the latest verdict of each transaction as label."""
    latest = feedback.groupBy("transaction_id").agg(
        F.max_by(F.struct("label", "ts"), F.struct("ts", "event_id")).alias("__v"))
    return (fact.join(latest, "transaction_id", "left")
            .withColumns({"label": F.coalesce(F.col("__v.label"), F.col("label")),
                          "labeled_at": F.coalesce(F.col("__v.ts"), F.col("labeled_at"))}).drop("__v"))


def judge_complaints(complaints: DataFrame, fact: DataFrame, cases: DataFrame) -> DataFrame:
    """Complaints (complaint_id, transaction_id, ts, note) with `outcome`: null if accepted, else the
    reason for refusal. The first valid complaint on a transaction closes its case."""
    length = F.length("note")
    bad_note = F.coalesce((length < NOTE_MIN) | (length > NOTE_MAX), F.lit(True))
    first = complaints.filter(~bad_note).groupBy("transaction_id").agg(
        F.min(F.struct("ts", "complaint_id")).alias("__first"))
    known = fact.select("transaction_id", F.lit(True).alias("__known"))
    closed = cases.filter(F.col("status").isin(list(FINAL_LABEL))).select("transaction_id", F.lit(True).alias("__closed"))
    joined = (complaints.join(first, "transaction_id", "left").join(known, "transaction_id", "left")
              .join(closed, "transaction_id", "left"))
    late = F.struct("ts", "complaint_id") > F.col("__first")
    return joined.withColumn("outcome", F.when(bad_note, BAD_NOTE).when(F.col("__known").isNull(), NOT_FOUND)
                             .when(F.col("__closed").isNotNull() | late, ALREADY_CLOSED)).drop(
        "__first", "__known", "__closed")


def apply_complaints(judged: DataFrame, fact: DataFrame) -> DataFrame:
    """Fact with label 1 for every transaction with an accepted complaint, approved ones too."""
    accepted = judged.filter(F.col("outcome").isNull()).select("transaction_id", F.col("ts").alias("__at"))
    hit = F.col("__at").isNotNull()
    return (fact.join(accepted, "transaction_id", "left")
            .withColumns({"label": F.when(hit, F.lit(1)).otherwise(F.col("label")),
                          "labeled_at": F.when(hit, F.col("__at")).otherwise(F.col("labeled_at"))}).drop("__at"))


def complaint_cases(judged: DataFrame, fact: DataFrame, cases: DataFrame, analyst: str = "analyst") -> DataFrame:
    """Cases after the accepted complaints (`analyst` names the column with who took them): an open case closes
    as confirmed fraud, a transaction without a case gets one that is closed at once. `opened` marks the new ones."""
    accepted = judged.filter(F.col("outcome").isNull()).select(
        "transaction_id", F.col("ts").alias("__at"), F.concat(F.lit(COMPLAINT_PREFIX), F.col("note")).alias("__note"), F.col(analyst).alias("__by"))
    shared = ["transaction_id", "tx_time", "user_id", "channel", "tx_type", "amount_usd", "fraud_probability", "risk_level", "action"]
    stored = cases.withColumns({c: F.lit(None).cast(k) for c, k in (("resolution_note", "string"), ("resolved_by", "string"), ("resolved_at", "timestamp_ntz"),
                                                                     ("assigned_to", "string")) if c not in cases.columns})
    known = stored.withColumn("opened", F.lit(False))
    new = (fact.join(accepted.select("transaction_id"), "transaction_id", "left_semi").join(cases.select("transaction_id"), "transaction_id", "left_anti")
           .select(*shared).withColumn("opened", F.lit(True)))
    hit = F.col("__at").isNotNull()
    both = known.unionByName(new, allowMissingColumns=True).join(accepted, "transaction_id", "left")
    return both.withColumns({
        "status": F.when(hit, "FRAUDE_CONFIRMEE").otherwise(F.col("status")), "resolution_note": F.when(hit, F.col("__note")).otherwise(F.col("resolution_note")),
        "resolved_by": F.when(hit, F.col("__by")).otherwise(F.col("resolved_by")), "resolved_at": F.when(hit, F.col("__at")).otherwise(F.col("resolved_at")),
        "assigned_to": F.when(hit, F.coalesce("assigned_to", "__by")).otherwise(F.col("assigned_to"))}).drop("__at", "__note", "__by")


def complaint_events(judged: DataFrame, fact: DataFrame, analyst: str = "analyst") -> tuple[DataFrame, DataFrame]:
    """Feedback (transaction_id, label, analyst, ts) and audit events of the accepted complaints."""
    accepted = judged.filter(F.col("outcome").isNull()).join(fact.select("transaction_id", F.col("action").alias("__action")), "transaction_id")
    feedback = accepted.select("transaction_id", F.lit(1).alias("label"), F.col(analyst).alias("analyst"), "ts")
    audit = accepted.select(
        "ts", F.col(analyst).alias("actor"), F.lit("PLAINTE_CLIENT").alias("action"), F.lit("transaction").alias("entity"), F.col("transaction_id").alias("entity_id"),
        F.create_map(F.lit("decision_modele"), F.concat(F.lit('"'), F.col("__action"), F.lit('"'))).alias("details"))
    return feedback, audit
