"""Numbers in binary columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def double_of_bytes(blob: Column) -> Column:
    """The IEEE 754 double whose eight bytes, least first, a binary column holds; null is null, another length is an error.

    Sign, exponent and fraction are taken from the bits: subnormal numbers, both zeros,
    infinities and NaN come out as they are.
    """
    digits = F.hex(blob)
    number = lambda *places: F.conv(F.concat(*(F.substring(digits, 2 * p + 1, 2) for p in places)), 16, 10).cast("bigint")
    high, low = number(7, 6, 5, 4), number(3, 2, 1, 0)
    exponent = F.shiftright(high, 20).bitwiseAND(F.lit(0x7FF))
    fraction = high.bitwiseAND(F.lit(0xFFFFF)).cast("double") * 2.0**32 + low.cast("double")
    size = (
        F.when((exponent == 0x7FF) & (fraction == 0), F.lit(float("inf"))).when(exponent == 0x7FF, F.lit(float("nan")))
        .when(exponent == 0, fraction * F.lit(2.0**-1074)).otherwise((fraction + 2.0**52) * F.pow(F.lit(2.0), (exponent - 1075).cast("double")))
    )
    signed = F.when(F.shiftright(high, 31) == 1, -size).otherwise(size)
    return F.when(blob.isNull(), F.lit(None).cast("double")).when(F.octet_length(blob) == 8, signed).otherwise(F.raise_error(F.lit("a double has eight bytes")).cast("double"))


def as_doubles(df: DataFrame, *columns: str) -> DataFrame:
    """``df`` with columns of numbers, or of eight bytes each, as doubles; other types raise TypeError."""
    made = {}
    for c in columns:
        kind = df.schema[c].dataType
        if isinstance(kind, T.BinaryType):
            made[c] = double_of_bytes(F.col(c))
        elif isinstance(kind, T.NumericType):
            made[c] = F.col(c).cast("double")
        else:
            raise TypeError(f"column {c} is {kind.simpleString()}, not a number or its bytes")
    return df.withColumns(made)
