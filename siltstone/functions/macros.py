"""Expression templates: numbered arguments, and macros that are Spark SQL functions of the session."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Signature and body of each macro. Spark parses and nests them; ``dv_concat`` is Spark's ``concat``, as it takes any number of arguments.
MACROS = {
    "dv_int_to_date": ("(x BIGINT) RETURNS DATE", "to_date(try_to_timestamp(lpad(cast(x as string), 8, '0'), 'yyyyMMdd'))"),
    "dv_int_to_datetime": ("(d BIGINT, t BIGINT) RETURNS TIMESTAMP", "try_to_timestamp(concat(lpad(cast(d as string), 8, '0'), ' ', lpad(cast(t as string), 8, '0')), 'yyyyMMdd HHmmssSS')"),
    "dv_int_to_string": ("(x BIGINT) RETURNS STRING", "cast(x as string)"),
}


def register(spark: SparkSession) -> None:
    """Make the macros temporary functions of the session."""
    for name, (signature, body) in MACROS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}{signature} RETURN {body}")


def expand(template: str, args: list[str]) -> str:
    """``##n`` becomes the n-th argument and ``#`` a quote; what is left is a Spark SQL expression."""

    def argument(m: re.Match) -> str:
        n = int(m[1])
        if not 1 <= n <= len(args):
            raise ValueError(f"argument {n} of {len(args)}")
        return args[n - 1]

    text = re.sub(r"##(\d+)", argument, template).replace("#", "'")
    if unknown := set(re.findall(r"\b(dv_\w+)\(", text)) - set(MACROS) - {"dv_concat"}:
        raise ValueError(f"unknown macros {sorted(unknown)}")
    return re.sub(r"\bdv_concat\(", "concat(", text)


def computed(df: DataFrame, columns: list[tuple[str, str]]) -> DataFrame:
    """Add expressions in order; a later one may use those before it."""
    if columns:
        register(df.sparkSession)
    for name, expression in columns:
        df = df.withColumn(name, F.expr(expression))
    return df
