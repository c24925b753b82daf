"""Numeric column helpers: missing-value normalisation and text coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Text accepted as a number: plain decimal / scientific notation, or a signed
# infinity. Spark's own cast also takes '1d' (double suffix) and hex floats
# such as '0x1p3'; those are not numbers in a sensor export and become NULL.
NUMBER_PATTERN = r"^[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?$|^[+-]?(?i:inf|infinity)$"


def nan_to_null(c: Column | str) -> Column:
    """NaN -> NULL so that missing is one thing everywhere (Spark's avg/max propagate NaN)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.nanvl(c.cast("double"), F.lit(None).cast("double"))


def coerce_numeric(c: Column | str) -> Column:
    """Text -> double; anything that is not a number becomes NULL (never an error)."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.trim(c.cast("string"))
    ok = t.rlike(NUMBER_PATTERN)
    return F.when(ok, nan_to_null(t.try_cast("double")))


def safe_ratio(num: Column, den: Column) -> Column:
    """num/den, NULL when den is 0 or NULL (ANSI-safe)."""
    return F.try_divide(num, den)
