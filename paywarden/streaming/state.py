"""Stateful operators where one row's outcome changes the next row's input."""
from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paywarden.functions.columns import DAY_US
from paywarden.operators.cases import NOTE_REQUIRED
from paywarden.schema import FINAL_LABEL

FEEDBACK_OUT = "transaction_id string, user_id string, ts_us long, failed_count_24h long, action string"
CASE_OUT = "case_id long, seq long, accepted boolean, reject_reason string, status_after string"


class FailureFeedback(StatefulProcessor):
    """Per user: failures of the last 24 hours, where a block of a transaction without status is one."""

    def __init__(self, decide: Callable[[dict, int], str]):
        self.decide = decide

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.failures = handle.getListState("failures", "us long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        known = [r[0] for r in self.failures.get()] if self.failures.exists() else []
        batch = pd.concat(list(rows)).sort_values(["ts_us", "transaction_id"])
        out = []
        for row in batch.to_dict("records"):
            known = [t for t in known if row["ts_us"] - t <= DAY_US]
            count = len(known)
            action = self.decide(row, count)
            # a known status counts as it is; where none is known a block is a failure
            failed = row["status"] != "SUCCESS" if isinstance(row["status"], str) else action == "BLOCK"
            if failed:
                known.append(row["ts_us"])
            out.append((row["transaction_id"], key[0], row["ts_us"], count, action))
        if known:
            self.failures.put([(t,) for t in known])
        else:
            self.failures.clear()
        yield pd.DataFrame(out, columns=[c.split()[0] for c in FEEDBACK_OUT.split(", ")])

    def close(self) -> None:
        pass


def decide_with_feedback(tx: DataFrame, decide: Callable[[dict, int], str]) -> DataFrame:
    """Decide a stream of (transaction_id, user_id, ts_us, status, ...) rows; `decide(row, failures)`
    gives the action, and a block counts for the user's later rows, also in the same batch."""
    return tx.groupBy("user_id").transformWithStateInPandas(
        FailureFeedback(decide), outputStructType=FEEDBACK_OUT, outputMode="append", timeMode="none")


class CaseWorkflow(StatefulProcessor):
    """Per case: status and last note."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.case = handle.getValueState("case", "status string, note string")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        status, note = self.case.get() if self.case.exists() else ("OUVERT", "")
        batch = pd.concat(list(rows)).sort_values("seq")
        out = []
        for seq, asked, text in zip(batch["seq"], batch["status"], batch["resolution_note"]):
            reason = None
            if asked is not None and asked != status:
                if status in FINAL_LABEL:
                    reason = f"transition {status} -> {asked} interdite"
                elif asked in FINAL_LABEL and not (text or note):
                    reason = NOTE_REQUIRED
                else:
                    status = asked
            if reason is None and text is not None:
                note = text
            out.append((key[0], seq, reason is None, reason, status))
        self.case.update((status, note))
        yield pd.DataFrame(out, columns=[c.split()[0] for c in CASE_OUT.split(", ")])

    def close(self) -> None:
        pass


def case_workflow_stream(requests: DataFrame) -> DataFrame:
    """Streaming twin of operators.cases.run_workflow."""
    return requests.groupBy("case_id").transformWithStateInPandas(
        CaseWorkflow(), outputStructType=CASE_OUT, outputMode="append", timeMode="none")
