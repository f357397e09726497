"""Names and technical columns of vault objects."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column
from pyspark.sql import functions as F

# Defaults that results depend on.
LOW_DATE = datetime(1900, 1, 1)
HIGH_DATE = datetime(9999, 12, 31)
FAILED_LOOKUP_KEY = -999
UNKNOWN, NOT_APPLICABLE, MISSING, NOT_REQUIRED = "<Unknown>", "<N/A>", "<Missing>", "<Not Required>"
PREFIXES = {"hub": "h_", "link": "l_", "sat": "s_", "stage": ""}
KEY_SUFFIX = "_key"

LOAD_TIME, RECORD_SOURCE = "dv_load_date_time", "dv_record_source"
SOURCE_TIME, IS_CURRENT, IS_TOMBSTONE = "dv_source_date_time", "dv_row_is_current", "dv_is_tombstone"
START, END = "dv_rowstartdate", "dv_rowenddate"
STAGE_TIME, VERSION_KEY = "dv_stage_date_time", "dv_source_version_key"
CDC_ACTION, CDC_START, CDC_HIGH_WATER, CDC_SEQUENCE = "dv_cdc_action", "dv_cdc_start_date", "dv_cdc_high_water_date", "dv_cdc_sequence"


def object_name(kind: str, name: str) -> str:
    return PREFIXES[kind] + name


def key_name(kind: str, name: str) -> str:
    """The surrogate key column: ``h_customer_key``."""
    return f"{PREFIXES[kind]}{name}{KEY_SUFFIX}"


def access_name(kind: str, table: str) -> str:
    """The name of a read: ``pit`` (point in time) or ``all`` (changes)."""
    if kind not in ("pit", "all"):
        raise ValueError(f"unknown access kind {kind}")
    return f"get_{table}_{kind}"


def next_abbreviation(last: str | None) -> str:
    """The code after ``last`` in four letters; the first one is ``aaaa``."""
    if last is None:
        return "aaaa"
    value = 0
    for c in last:
        value = value * 26 + ord(c) - ord("a")
    value += 1
    if value >= 26**4:
        raise ValueError("no abbreviation is left")
    return "".join(chr(ord("a") + value // 26**k % 26) for k in (3, 2, 1, 0))


def abbreviation(number: Column) -> Column:
    """The code of a number from 0 on, in four letters; null where none is left."""
    letters = [F.chr(97 + F.floor(number / 26**k) % 26) for k in (3, 2, 1, 0)]
    return F.when((number >= 0) & (number < 26**4), F.concat(*letters))
