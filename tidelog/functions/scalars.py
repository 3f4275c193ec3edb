"""Scalar helpers: times, dates, approximate equality, renaming with types."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def time_of_day(text: Column) -> Column:
    """'HH:mm:ss' or 'HH:mm:ss.SSS' as milliseconds since midnight; null for anything else."""
    part = lambda k: F.regexp_extract(text, r"^(\d{2}):(\d{2}):(\d{2})(?:\.(\d{1,3}))?$", k)
    ms = F.rpad(part(4), 3, "0").cast("int")
    whole = (part(1).cast("int") * 3600 + part(2).cast("int") * 60 + part(3).cast("int")) * 1000 + ms
    return F.when(text.rlike(r"^([01]\d|2[0-3]):[0-5]\d:[0-5]\d(\.\d{1,3})?$"), whole)


def slash_date(text: Column) -> Column:
    """'yyyy/MM/dd' as a date; null if it is none."""
    return F.try_to_timestamp(text, F.lit("yyyy/MM/dd")).cast("date")


def epoch_time(text: Column) -> Column:
    """Epoch seconds with up to six decimals, in text, as a timestamp, without floating point."""
    return F.timestamp_micros((text.cast("decimal(20,6)") * 1_000_000).cast("bigint"))


def about_equal(a: Column, b: Column, tolerance: float) -> Column:
    return F.abs(a - b) <= tolerance


def translated(df: DataFrame, names: Mapping[str, str], types: Mapping[str, str] | None = None) -> DataFrame:
    """Columns by new names, cast to the given types (by new name) where there are any."""
    out = df.withColumnsRenamed({a: b for a, b in names.items() if a in df.columns})
    return out.withColumns({c: F.col(c).try_cast(t) for c, t in (types or {}).items() if c in out.columns})
