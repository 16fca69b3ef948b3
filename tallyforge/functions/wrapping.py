"""Sums in 64-bit two's complement, whatever the order of rows."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def wrapping_sum(name: str) -> Column:
    """The exact decimal sum, folded into 64 bits."""
    total = F.sum(F.col(name).cast("decimal(20,0)")).cast("decimal(38,0)")
    half, whole = F.lit(str(1 << 63)).cast("decimal(38,0)"), F.lit(str(1 << 64)).cast("decimal(38,0)")
    return (F.pmod(total + half, whole) - half).cast("decimal(38,0)").cast("long")
