"""Column types: from declared type names to Spark types, and casts that happen only where types differ."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Declared type names without parameters.
PLAIN = {
    "int": T.IntegerType(), "bigint": T.LongType(), "smallint": T.ShortType(), "tinyint": T.ShortType(), "bit": T.BooleanType(),
    "date": T.DateType(), "datetime": T.TimestampNTZType(), "datetime2": T.TimestampNTZType(), "datetimeoffset": T.TimestampType(),
    "real": T.FloatType(), "float": T.DoubleType(), "money": T.DecimalType(19, 4), "smallmoney": T.DecimalType(10, 4),
    "text": T.StringType(), "ntext": T.StringType(), "image": T.BinaryType(), "uniqueidentifier": T.StringType(),
}
TEXT = ("char", "varchar", "nchar", "nvarchar")


@dataclass(frozen=True)
class ColumnDef:
    """A declared column. length: of text (-1: unbounded; bytes for n-types); default: an SQL expression."""

    name: str
    type: str
    length: int | None = None
    precision: int | None = None
    scale: int | None = None
    nullable: bool = True
    default: str | None = None
    collation: str | None = None
    retired: bool = False

    @property
    def characters(self) -> int | None:
        if self.type not in TEXT or self.length in (None, -1):
            return None
        return self.length // 2 if self.type.startswith("n") else self.length


def spark_type(column: ColumnDef) -> T.DataType:
    """The Spark type of a declared column; an unknown type name is an error."""
    if column.type in ("decimal", "numeric"):
        return T.DecimalType(column.precision or 18, column.scale or 0)
    if column.type in TEXT:
        return T.StringType(column.collation) if column.collation else T.StringType()
    if column.type in ("binary", "varbinary"):
        return T.BinaryType()
    if column.type not in PLAIN:
        raise ValueError(f"column {column.name}: unknown type {column.type}")
    return PLAIN[column.type]


def cast_to(value: Column, have: T.DataType | None, column: ColumnDef) -> Column:
    """Cast only where the type differs; text with a declared length is cut to it."""
    want = spark_type(column)
    out = value if have == want else value.cast(want)
    return F.substring(out, 1, column.characters) if column.characters else out


def schema_of(columns: list[ColumnDef]) -> T.StructType:
    return T.StructType([T.StructField(c.name, spark_type(c), c.nullable) for c in columns])


def declared(schema: T.StructType) -> list[ColumnDef]:
    """The reverse: column definitions of a table that exists."""
    names = {v: k for k, v in reversed(PLAIN.items())}
    out = []
    for f in schema.fields:
        if isinstance(f.dataType, T.DecimalType):
            out.append(ColumnDef(f.name, "decimal", precision=f.dataType.precision, scale=f.dataType.scale, nullable=f.nullable))
        elif isinstance(f.dataType, T.StringType):
            out.append(ColumnDef(f.name, "varchar", length=-1, nullable=f.nullable))
        else:
            out.append(ColumnDef(f.name, names.get(f.dataType, f.dataType.simpleString()), nullable=f.nullable))
    return out
