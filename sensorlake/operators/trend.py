"""Trend line per channel over daily means."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions.timefns import ntz_lit

from sensorlake.functions.timefns import US_PER_DAY, micros_between
from sensorlake.operators import resample as rs
from sensorlake.operators.stats import trend_slope
from sensorlake.plans.ranking import small_side


def trend_line(readings: DataFrame, *, keys: Sequence[str] = ("channel",), ts: str = "ts",
               order: Sequence[str] = ("ts", "rid"), value: str = "value", ordinal: str | None = None) -> DataFrame:
    """Per channel and daily bin: x (days from the first bin), daily mean,
    trend = slope·x + intercept with the slope from the raw samples and
    intercept = mean(daily means present) − slope·mean(x over all bins).
    ``slope_rank`` orders channels by |slope| (largest first; ties by ``ordinal``, the
    channel's column number in ``readings``, or else by name)."""
    keys = list(keys)
    origin, last = rs.frame_origin(readings, ts=ts)
    daily = rs.resample(readings, "daily", "mean", keys=keys, ts=ts, order=order, value=value,
                        origin=origin, last=last)
    o = ntz_lit(origin)
    daily = daily.withColumn("x", micros_between(o, F.col(ts)) / F.lit(float(US_PER_DAY)))
    per = daily.groupBy(*keys).agg(F.avg(value).alias("_ym"), F.avg("x").alias("_xm"))
    sl = trend_slope(readings, keys=keys, ts=ts, order=order, value=value).drop("n_valid")
    place = keys
    if ordinal is not None:
        sl = sl.join(readings.groupBy(*keys).agg(F.min(ordinal).alias("_place")), keys)
        place = ["_place", *keys]
    per = (per.join(sl, keys).withColumn("intercept", F.col("_ym") - F.col("slope") * F.col("_xm")))
    per = per.withColumn("slope_rank", F.row_number().over(
        Window.orderBy(F.abs(F.col("slope")).desc(), *place)).cast("long"))
    out = daily.join(small_side(per), keys)
    return out.select(*keys, ts, "x", F.col(value).alias("mean"),
                      (F.col("slope") * F.col("x") + F.col("intercept")).alias("trend"),
                      "slope", "intercept", "slope_rank")
