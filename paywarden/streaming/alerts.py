"""Alert rules with a "for" on live data: a windowed aggregate feeds a machine per key.

    inactive ──condition holds──► pending ──held for the whole span──► firing ──fails or is missing──► resolved

The aggregate runs in append mode: a window's value comes once, when the watermark has passed its end, late
rows included. The machine takes the evaluations of a key in order of time. An evaluation that doesn't come
(no row fell into its window) ends a run like one that fails; a timer one step behind the last evaluation
sees to it. State is one row per key whose condition holds now, and none for the others.

`operators.monitor.transitions` is the same over a finished table.
"""
from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from paywarden.functions.columns import MICROS, epoch_us

KEY = "__rule"


def evaluations(df: DataFrame, ts: str, size: str, slide: str, by: Sequence[str], **measures: Column) -> DataFrame:
    """One row per window and key, for a stream with a watermark on `ts`: `at` is the window's end."""
    counted = df.groupBy(F.window(ts, size, slide).alias("w"), *by).agg(*[c.alias(n) for n, c in measures.items()])
    return counted.select(F.window_time("w").alias("event_time"), F.col("w.end").alias("at"), *by, *measures)


class Sustained(StatefulProcessor):
    def __init__(self, by: list[str], step_us: int, span_us: int):
        self.by, self.step, self.span = by, step_us, span_us

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.run = handle.getValueState("run", "since_us long, last_us long")

    def out(self, key, state: str, us: int) -> Row:
        return Row(**dict(zip(self.by or [KEY], key)), state=state, at_us=us)

    def ended(self, key, since: int, last: int) -> Iterator[Row]:
        if last - since >= self.span:
            yield self.out(key, "resolved", last + self.step)

    def handleInputRows(self, key, rows, timerValues):
        before = self.run.get() if self.run.exists() else None
        run = tuple(before) if before else None
        for r in sorted(rows, key=lambda r: r.at_us):
            if run and (not r.holds or r.at_us - run[1] != self.step):
                yield from self.ended(key, *run)
                run = None
            if r.holds:
                run = (run[0] if run else r.at_us, r.at_us)
                if run[0] == r.at_us:
                    yield self.out(key, "pending", r.at_us)
                if r.at_us - run[0] == self.span:
                    yield self.out(key, "firing", r.at_us)
        if before:
            self.handle.deleteTimer((before[1] + self.step) // 1000)
        if run:
            self.run.update(run)
            self.handle.registerTimer((run[1] + self.step) // 1000)
        elif before:
            self.run.clear()

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        run = self.run.get() if self.run.exists() else None
        if run and (run[1] + self.step) // 1000 <= expiredTimerInfo.getExpiryTimeInMs():
            self.run.clear()
            yield from self.ended(key, *run)

    def close(self) -> None:
        pass


def sustained_stream(series: DataFrame, condition: Column, minutes: int, step_minutes: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """(by, state, at) rows of a stream of `evaluations`: pending, firing and resolved at the evaluation where
    each begins. `minutes` is how long the condition has to hold, a multiple of the step."""
    by = list(by)
    schema = series.select(*[F.col(c) for c in by] or [F.lit("").alias(KEY)]).schema
    rows = series.select("event_time", epoch_us("at").alias("at_us"), F.coalesce(condition, F.lit(False)).alias("holds"),
                         *[F.col(c) for c in by] or [F.lit("").alias(KEY)])
    unit = 60 * MICROS
    found = rows.groupBy(*by or [KEY]).transformWithState(
        Sustained(by, step_minutes * unit, minutes * unit), outputStructType=schema.add("state", "string").add("at_us", "long"),
        outputMode="append", timeMode="EventTime")
    return found.select(*by, "state", F.timestamp_micros("at_us").alias("at"))
