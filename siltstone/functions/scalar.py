"""Scalar helpers that configurations use, as Column expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def proper_case(text: Column) -> Column:
    """Lower-case, a leading blank, and a capital after each blank (the leading blank stays)."""
    return F.concat(F.lit(" "), F.initcap(F.lower(text)))


def split_strings(df: DataFrame, text: str, delimiter: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``keep`` columns and (item_number, item): empty items are kept, numbers start at 1."""
    parts = F.split(F.col(text), re.escape(delimiter), -1)
    return df.select(*keep, F.posexplode(parts).alias("n", "item")).select(*keep, (F.col("n") + 1).alias("item_number"), "item")


def int_to_date(value: Column) -> Column:
    """A yyyymmdd integer as a date; null where there is no such day."""
    return F.try_to_date(F.lpad(value.cast("string"), 8, "0"), "yyyyMMdd")


def int_to_datetime(day: Column, time: Column) -> Column:
    """yyyymmdd and hhmmsscc (hundredths) integers as a timestamp; null where there is no such time."""
    text = F.concat(F.lpad(day.cast("string"), 8, "0"), F.lit(" "), F.lpad(time.cast("string"), 8, "0"))
    return F.try_to_timestamp(text, F.lit("yyyyMMdd HHmmssSS"))


def int_to_string(value: Column) -> Column:
    return value.cast("string")


def elapsed_text(milliseconds: int) -> str:
    """A duration in words: ``1 hr, 2 mins and 3 secs``, below a second in milliseconds."""
    if milliseconds < 1000:
        return f"{milliseconds} milliseconds"
    seconds = milliseconds // 1000
    hours, minutes, seconds = seconds // 3600, seconds // 60 % 60, seconds % 60
    word = lambda n, unit: f"{n} {unit}{'s' if n != 1 else ''}"
    parts = [word(n, unit) for n, unit in ((hours, "hr"), (minutes, "min")) if n]
    last = word(seconds, "sec")
    return f"{', '.join(parts)} and {last}" if parts else last


def elapsed(milliseconds: Column) -> Column:
    """``elapsed_text`` of a column."""
    seconds = F.floor(milliseconds / 1000)
    hours, minutes, rest = F.floor(seconds / 3600), F.floor(seconds / 60) % 60, seconds % 60
    word = lambda n, unit: F.concat(n.cast("string"), F.lit(f" {unit}"), F.when(n != 1, "s").otherwise(""))
    parts = F.concat_ws(", ", F.when(hours > 0, word(hours, "hr")), F.when(minutes > 0, word(minutes, "min")))
    whole = F.when(parts != "", F.concat(parts, F.lit(" and "), word(rest, "sec"))).otherwise(word(rest, "sec"))
    return F.when(milliseconds < 1000, F.concat(milliseconds.cast("string"), F.lit(" milliseconds"))).otherwise(whole)
