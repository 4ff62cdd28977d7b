"""Money and date column expressions (all Catalyst built-ins)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

AMOUNT = "decimal(10,2)"
TOTAL = "decimal(18,2)"


def cents_to_amount(c: Column | str) -> Column:
    """Integer cents to NUMERIC(10,2); division by 100 is exact in decimal."""
    c = F.col(c) if isinstance(c, str) else c
    return (c.cast("decimal(20,0)") / F.lit(100)).cast(AMOUNT)


def to_cents(c: Column | str) -> Column:
    """A money value held as double to whole cents (half away from zero)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c * F.lit(100)).cast("bigint")


def day(c: Column | str) -> Column:
    """Truncate a timestamp to the day and keep it as DATE."""
    c = F.col(c) if isinstance(c, str) else c
    return F.to_date(F.date_trunc("day", c))
