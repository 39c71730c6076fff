"""Small column helpers shared by the operators."""
from __future__ import annotations

from itertools import chain

from pyspark.sql import Column
from pyspark.sql import functions as F

HOUR_US = 3_600_000_000
DAY_US = 24 * HOUR_US
MICROS = 1_000_000


def epoch_us(ts: str | Column) -> Column:
    """Microseconds of a wall-clock timestamp (the session runs in UTC)."""
    return F.unix_micros(F.col(ts).cast("timestamp") if isinstance(ts, str) else ts.cast("timestamp"))


def flag(condition: Column) -> Column:
    """1.0 / 0.0, null counts as 0.0."""
    return F.when(condition, F.lit(1.0)).otherwise(F.lit(0.0))


def clip(value: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(float(low)), F.least(F.lit(float(high)), value))


def at_least_zero(value: Column) -> Column:
    """Negative becomes 0, null stays null (greatest would skip it)."""
    return F.when(value < 0, F.lit(0)).otherwise(value)


def literal_map(entries: dict) -> Column:
    return F.create_map(*[F.lit(x) for x in chain.from_iterable(entries.items())])


def lookup(entries: dict, key: Column) -> Column:
    """Value of a small fixed table, null when the key is unknown."""
    return F.try_element_at(literal_map(entries), key)


def position(values: list[str], key: Column) -> Column:
    """Index of `key` in a fixed list, from 0."""
    return F.array_position(F.array(*[F.lit(v) for v in values]), key) - 1
