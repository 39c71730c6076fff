"""Identifiers and wall-clock time in their canonical form."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from paywarden.schema import ID_FIELDS

UTC_OFFSET = "+01:00"       # fixed value: local time of the transactions


def canonical_id(value: Column) -> Column:
    """Text of an identifier: a whole float such as 243917538864.0 loses its fraction, a NaN number is null.
    Texts stay as they are, also an empty one or "nan"."""
    text = value.cast("string")
    scientific = text.rlike(r"^-?[0-9](\.[0-9]+)?E[0-9]+$")
    number = F.typeof(value).isin("double", "float")
    return (F.when(number & (text == "NaN"), F.lit(None))
            .when(scientific, F.coalesce(text.try_cast("decimal(38,0)").cast("string"), text))
            .otherwise(F.regexp_replace(text, r"^(-?[0-9]+)\.0+$", "$1")))


def canonical_ids(df: DataFrame) -> DataFrame:
    return df.withColumns({n: canonical_id(F.col(n)) for n in ID_FIELDS if n in df.columns})


def to_local_naive(ts: Column) -> Column:
    """An instant as local wall-clock time without a zone."""
    return F.convert_timezone(F.lit("UTC"), F.lit(UTC_OFFSET), ts.cast("timestamp_ntz"))
