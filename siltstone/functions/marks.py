"""High-water marks as text, and log sequence numbers as ordered byte strings.

A byte string sorts by its unsigned bytes. As text it is hexadecimal digits after ``0x``, so that no byte is lost.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of a log sequence number.
LSN_BYTES = 10


def as_text(value: Column, kind: T.DataType) -> Column:
    """A mark of this type as text that ``from_text`` gives back."""
    return F.concat(F.lit("0x"), F.hex(value)) if isinstance(kind, T.BinaryType) else value.cast("string")


def from_text(mark: str | None, kind: T.DataType) -> Column:
    if mark is None:
        return F.lit(None).cast(kind)
    return F.unhex(F.lit(mark.removeprefix("0x"))) if isinstance(kind, T.BinaryType) else F.lit(mark).cast(kind)


def zero_lsn(size: int = LSN_BYTES) -> Column:
    """Where a source without a mark begins."""
    return F.lit(bytes(size))


def next_lsn(lsn: Column) -> Column:
    """The byte string of the same length that comes next: plus one with carry; null after the last one.

    The last byte that isn't FF goes up by one, the FF bytes behind it become 00.
    """
    digits = F.hex(lsn)
    tail = F.length(F.regexp_extract(digits, "((?:FF)*)$", 1))
    head = F.substr(digits, F.lit(1), F.length(digits) - tail - 2)
    byte = F.substr(digits, F.length(digits) - tail - 1, F.lit(2))
    up = F.lpad(F.hex(F.conv(byte, 16, 10).cast("int") + 1), 2, "0")
    even = F.when(F.length(digits) > tail, F.concat(head, up, F.repeat(F.lit("00"), (tail / 2).cast("int"))))
    return F.unhex(even)
