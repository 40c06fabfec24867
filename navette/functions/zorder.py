"""Space-filling key over two small numbers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Bits of each of the two numbers.
BITS = 16


def _spread(x: Column) -> Column:
    """The low bits of x moved to the even places."""
    for shift, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
        x = x.bitwiseOR(F.shiftleft(x, shift)).bitwiseAND(F.lit(mask).cast("bigint"))
    return x


def z_value(a: Column, b: Column) -> Column:
    """Interleaved bits of two numbers below 2^16: numbers close in both are mostly close in the key."""
    low, high = (_spread(x.cast("bigint")) for x in (a, b))
    return low.bitwiseOR(F.shiftleft(high, 1))
