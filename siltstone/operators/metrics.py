"""Counts and profiles of vault objects."""

from __future__ import annotations

from datetime import date, datetime
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from siltstone.functions.naming import IS_CURRENT, IS_TOMBSTONE, LOAD_TIME, RECORD_SOURCE
from siltstone.operators.temporal import point_in_time


def by_record_source(table: DataFrame, sources: DataFrame | None = None, until: Column | None = None) -> DataFrame:
    """(record source, n): rows of a hub or link loaded not after ``until``; sources adds names by record source."""
    rows = table if until is None else table.where(F.col(LOAD_TIME) <= until)
    out = rows.groupBy(RECORD_SOURCE).agg(F.count("*").alias("n_rows"))
    return out if sources is None else out.join(sources, RECORD_SOURCE, "left")


def satellite_counts(table: DataFrame) -> DataFrame:
    """One row: all rows, current ones, ended versions and tombstones."""
    return table.agg(
        F.count("*").alias("n_total"),
        F.count_if(F.col(IS_CURRENT)).alias("n_current"),
        F.count_if(~F.col(IS_CURRENT) & ~F.col(IS_TOMBSTONE)).alias("n_versioned"),
        F.count_if(F.col(IS_TOMBSTONE)).alias("n_tombstones"),
    )


def column_profile(table: DataFrame, columns: list[str]) -> DataFrame:
    """A row for each column: least and greatest as text, distinct values, nulls, blanks, text lengths.

    Statistics that don't apply to a type are 0 (least and greatest: null). The columns are unpivoted, one
    field for each of their types, and (column, value) is counted, combined map-side; everything else
    comes from the distinct values.
    """
    kinds = {c: table.schema[c].dataType for c in columns}
    types = list(dict.fromkeys(kinds.values()))
    fields = [f"v{k}" for k in range(len(types))]
    cell = lambda c: F.struct(F.lit(c).alias("column_name"), *(F.col(c).alias(f) if kinds[c] == t else F.lit(None).cast(t).alias(f) for f, t in zip(fields, types, strict=True)))
    counted = table.select(F.inline(F.array(*(cell(c) for c in columns)))).groupBy("column_name", *fields).agg(F.count("*").alias("n"))
    present = reduce(lambda a, b: a | b, (F.col(f).isNotNull() for f in fields))
    aggregates = [F.count_if(present).alias("domain"), F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("nulls")]
    no_text = F.lit(None).cast("string")
    least, greatest, blanks, shortest, longest = [no_text], [no_text], [F.lit(0).cast("long")], [F.lit(0)], [F.lit(0)]
    for f, t in zip(fields, types, strict=True):
        if not isinstance(t, T.BinaryType | T.ArrayType | T.StructType):
            aggregates += [F.min(f).alias(f"{f}_least"), F.max(f).alias(f"{f}_greatest")]
            least.insert(0, F.col(f"{f}_least").cast("string"))
            greatest.insert(0, F.col(f"{f}_greatest").cast("string"))
        if isinstance(t, T.StringType):
            length = F.length(F.rtrim(F.col(f)))
            aggregates += [F.sum(F.when(F.trim(F.col(f)) == "", F.col("n"))).alias(f"{f}_blanks"), F.min(length).alias(f"{f}_shortest"), F.max(length).alias(f"{f}_longest")]
            blanks.insert(0, F.col(f"{f}_blanks"))
            shortest.insert(0, F.col(f"{f}_shortest"))
            longest.insert(0, F.col(f"{f}_longest"))
    found = counted.groupBy("column_name").agg(*aggregates)
    return found.select(
        "column_name",
        F.coalesce(*least).alias("least"),
        F.coalesce(*greatest).alias("greatest"),
        "domain",
        "nulls",
        F.coalesce(*blanks).alias("blanks"),
        F.coalesce(*shortest).cast("long").alias("least_length"),
        F.coalesce(*longest).cast("long").alias("greatest_length"),
    )


def satellite_profile(table: DataFrame, columns: list[str], at: datetime | None = None) -> DataFrame:
    """``column_profile`` of the versions of a satellite that are valid at a time (now: the current ones), without tombstones."""
    return column_profile(point_in_time(table, at), columns)


#: Registers of a sketch as a power of two: distinct counts are within 3 * 1.04 / sqrt(2^12), 4.9 %, nearly always.
SKETCH_BITS = 12


def profile_part(table: DataFrame, columns: list[str]) -> DataFrame:
    """One row: what ``merged_profile`` needs to know of these rows, whatever their number.

    For each column the least and the greatest value, nulls, blanks, text lengths and a sketch of its distinct values.
    """
    out = [F.count("*").alias("n")]
    for c in columns:
        kind, value = table.schema[c].dataType, F.col(c)
        text, length = isinstance(kind, T.StringType), F.length(F.rtrim(value)).cast("long") if isinstance(kind, T.StringType) else F.lit(0).cast("long")
        sketched = value if isinstance(kind, T.IntegerType | T.LongType) else F.concat(F.lit("."), F.hex(value) if isinstance(kind, T.BinaryType) else value.cast("string"))  # a sketch leaves out empty text
        plain = not isinstance(kind, T.BinaryType | T.ArrayType | T.StructType)
        out += [
            (F.min(value) if plain else F.min(F.lit(None).cast("string"))).alias(f"{c}__least"), (F.max(value) if plain else F.max(F.lit(None).cast("string"))).alias(f"{c}__greatest"),
            F.count_if(value.isNull()).alias(f"{c}__nulls"), (F.count_if(F.trim(value) == "") if text else F.count_if(F.lit(False))).alias(f"{c}__blanks"),
            F.min(length).alias(f"{c}__shortest"), F.max(length).alias(f"{c}__longest"), F.hll_sketch_agg(sketched, F.lit(SKETCH_BITS)).alias(f"{c}__sketch"),
        ]
    return table.agg(*out)


def merged_profile(parts: DataFrame, columns: list[str]) -> DataFrame:
    """``column_profile`` of all rows that the parts were made of; ``domain`` is estimated, everything else exact.

    So the profile of a table that is added to reads the rows that are new, and a row for each load before.
    """
    merged = parts.agg(*(
        f.alias(f"{c}__{n}") for c in columns for n, f in (
            ("least", F.min(f"{c}__least")), ("greatest", F.max(f"{c}__greatest")), ("nulls", F.sum(f"{c}__nulls")), ("blanks", F.sum(f"{c}__blanks")),
            ("shortest", F.min(f"{c}__shortest")), ("longest", F.max(f"{c}__longest")), ("domain", F.hll_sketch_estimate(F.hll_union_agg(f"{c}__sketch"))),
        )
    ))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long")
    rows = [
        F.struct(
            F.lit(c).alias("column_name"), F.col(f"{c}__least").cast("string").alias("least"), F.col(f"{c}__greatest").cast("string").alias("greatest"), zero(f"{c}__domain").alias("domain"),
            zero(f"{c}__nulls").alias("nulls"), zero(f"{c}__blanks").alias("blanks"), zero(f"{c}__shortest").alias("least_length"), zero(f"{c}__longest").alias("greatest_length"),
        ) for c in columns
    ]
    return merged.select(F.inline(F.array(*rows)))


def profiled_today(key: int, day: date, run_type: str = "Weekly", only: int = 0) -> bool:
    """Whether a satellite's columns are profiled: each on one day of the week, all on a full run, one alone if it is named."""
    return key == only if only else run_type == "Full" or key % 7 == day.isoweekday() % 7


def profiled_on(key: Column, day: Column) -> Column:
    """``profiled_today`` of a weekly run, for columns: Monday is 1, Sunday 0."""
    return key % 7 == (F.weekday(day) + 1) % 7
