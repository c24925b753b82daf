"""Projections: channel pick, wide -> long, day axis, unit scaling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.timefns import ntz_lit

from sensorlake.functions.numeric import nan_to_null
from sensorlake.functions.timefns import US_PER_DAY, micros_between


def project_channels(wide: DataFrame, channels: Sequence[str], *, index: Sequence[str] = ("ts", "rid")) -> DataFrame:
    """Keep the index columns and the chosen channels (pruned at the scan)."""
    return wide.select(*index, *channels)


def pick_channels(readings: DataFrame, channels: Sequence[str], *, channel: str = "channel") -> DataFrame:
    """Long form: keep rows of the chosen channels (pushed to the scan as IN)."""
    return readings.where(F.col(channel).isin(list(channels)))


def unpivot(wide: DataFrame, channels: Sequence[str] | None = None, *, index: Sequence[str] = ("ts", "rid"),
            channel: str = "channel", value: str = "value") -> DataFrame:
    """Wide -> long readings; NULL (missing) cells are kept — coverage needs them.

    NaN becomes NULL on the way. No shuffle: one input row -> one row per channel.
    Written as ``inline(array(struct(name, value) …))`` (a generator) rather than
    ``DataFrame.unpivot``: Spark 4.1's whole-stage codegen fails to compile the
    Expand node next to large CASE expressions and falls back to slow
    interpretation; the generator path compiles.
    """
    index = list(index)
    channels = list(channels) if channels is not None else [c for c in wide.columns if c not in index]
    cells = F.array(*[F.struct(F.lit(c).alias(channel), nan_to_null(c).alias(value)) for c in channels])
    return wide.select(*index, F.inline(cells))


def pairwise_complete(wide: DataFrame, x: str, y: str) -> DataFrame:
    """Rows where both x and y are present."""
    return wide.where(F.col(x).isNotNull() & F.col(y).isNotNull())


def days_axis(df: DataFrame, *, ts: str = "ts", origin=None, out: str = "days") -> DataFrame:
    """(ts - first ts) in days. ``origin`` defaults to the frame's first ts (one scalar)."""
    if origin is None:
        origin = df.agg(F.min(ts)).first()[0]
    o = ntz_lit(origin)
    return df.withColumn(out, micros_between(o, F.col(ts)) / F.lit(float(US_PER_DAY)))


def scale_unit(readings: DataFrame, factor: float | str, *, value: str = "value") -> DataFrame:
    """value * factor; ``factor`` a number or the name of a per-row factor column."""
    f = F.col(factor) if isinstance(factor, str) else F.lit(float(factor))
    return readings.withColumn(value, F.col(value) * f)
