"""Distributions: equal-width histogram and five-number summary."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.plans.ranking import exact_percentiles, small_side

HIST_BINS = 40  # fixed value: bins of the original histogram


def histogram(readings: DataFrame, bins: int = HIST_BINS, *, keys: Sequence[str] = ("channel",),
              value: str = "value") -> DataFrame:
    """Per series: bin, center, count for ``bins`` equal-width bins over
    [min, max] (last bin closed, empty bins kept; min == max widens by ±0.5;
    fewer than 2 valid values -> no rows).

    Bin of x: trunc((x − lo)/(hi − lo)·bins), then moved down if x is below its
    left edge and up if at/above its right edge, edges = lo + k·((hi − lo)/bins),
    the last edge = hi exactly. This reproduces the usual histogram exactly
    (the plain formula misplaces values lying on edges)."""
    keys = list(keys)
    v = readings.where(F.col(value).isNotNull())
    rng = v.groupBy(*keys).agg(F.min(value).alias("_lo0"), F.max(value).alias("_hi0"), F.count(value).alias("_n"))
    rng = rng.where(F.col("_n") >= 2)
    same = F.col("_lo0") == F.col("_hi0")
    rng = (rng.withColumn("_lo", F.when(same, F.col("_lo0") - 0.5).otherwise(F.col("_lo0")))
           .withColumn("_hi", F.when(same, F.col("_hi0") + 0.5).otherwise(F.col("_hi0")))
           .withColumn("_step", (F.col("_hi") - F.col("_lo")) / F.lit(float(bins))))
    rng = rng.select(*keys, "_lo", "_hi", "_step")
    side = small_side(rng)
    x = F.col(value)

    def edge(k):
        return F.when(k >= bins, F.col("_hi")).otherwise(k.cast("double") * F.col("_step") + F.col("_lo"))

    b = v.join(side, keys)
    i0 = ((x - F.col("_lo")) / (F.col("_hi") - F.col("_lo")) * F.lit(float(bins))).cast("long")
    b = b.withColumn("_i0", F.least(i0, F.lit(bins - 1)))
    # numpy's two fix-ups in one step: after a decrement the increment test is
    # x >= edge(i0), already false, so the two cases never combine.
    i = (F.when(x < edge(F.col("_i0")), F.col("_i0") - 1)
         .when((x >= edge(F.col("_i0") + 1)) & (F.col("_i0") != bins - 1), F.col("_i0") + 1)
         .otherwise(F.col("_i0")))
    # non-null: keeps the optimizer from inferring (and inlining) an IS NOT NULL filter
    b = b.withColumn("_i", F.coalesce(i, F.lit(-1).cast("long")))
    counts = b.groupBy(*keys, F.col("_i").alias("bin")).agg(F.count(F.lit(1)).alias("count"))
    spine = rng.withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))))
    out = spine.join(counts, keys + ["bin"], "left")
    center = (edge(F.col("bin")) + edge(F.col("bin") + 1)) / 2.0
    return out.select(*keys, "bin", center.alias("center"), F.coalesce(F.col("count"), F.lit(0)).cast("long").alias("count"))


def box_summary(readings: DataFrame, *, keys: Sequence[str] = ("channel",), value: str = "value") -> DataFrame:
    """Per series: min, q1, median, q3, max (linear interpolation, exact).
    Series without any valid value are kept with NULLs."""
    keys = list(keys)
    # min and max are the ranks 0 and n-1: one pass for all five numbers
    q = exact_percentiles(readings, keys, value, [0.0, 0.25, 0.5, 0.75, 1.0],
                          names=["min", "q1", "median", "q3", "max"])
    return q.select(*keys, "min", "q1", "median", "q3", "max")
