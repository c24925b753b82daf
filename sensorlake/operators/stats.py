"""Per-channel statistics, trend slope, coverage and the summaries built on them
(A1–A8, A19–A23).

All per-series numbers come from ONE ``groupBy(keys)`` with partial
aggregation: counts, min/max/avg/stddev, first/last valid value via
``min_by``/``max_by`` on (ts, rid), and the least-squares slope from
covariance / variance. A hot channel is combined map-side, never gathered.
The summaries work on that per-channel table (one row per channel).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.timefns import US_PER_DAY, ts_micros
from sensorlake.plans.ranking import small_side

# Signal thresholds.
COVERAGE_POS, COVERAGE_WARN = 95.0, 85.0          # percent
SLOPE_NEG, SLOPE_WARN = 0.05, 0.005               # units per day
ANOMALY_NEG, ANOMALY_WARN = 0.05, 0.01            # flagged share


def signal_high_good(x: Column, pos: float, warn: float) -> Column:
    """'pos' when x >= pos, 'warn' when x >= warn, else 'neg'."""
    return F.when(x >= pos, "pos").when(x >= warn, "warn").otherwise("neg")


def signal_high_bad(x: Column, neg: float, warn: float) -> Column:
    """'neg' when x >= neg, 'warn' when x >= warn, else 'pos'."""
    return F.when(x >= neg, "neg").when(x >= warn, "warn").otherwise("pos")


def _with_x(readings: DataFrame, keys: Sequence[str], order: Sequence[str], ts: str, value: str) -> DataFrame:
    """``readings`` with the axis of slopes: days, or for a numeric time index the valid sample's number."""
    if not isinstance(readings.schema[ts].dataType, T.NumericType):
        return readings.withColumn("_x", ts_micros(F.col(ts)) / F.lit(float(US_PER_DAY)))
    from sensorlake.plans.ranking import with_position
    valid = with_position(readings.where(F.col(value).isNotNull()), list(keys), list(order), pos="_x")
    missing = readings.where(F.col(value).isNull()).withColumn("_x", F.lit(None).cast("long"))
    return valid.unionByName(missing).withColumn("_x", F.col("_x").cast("double"))


def stat_aggs(value: str = "value", order: Sequence[str] = ("ts", "rid"), x: str = "_x") -> list[Column]:
    """Aggregate expressions of channel statistics + slope (one pass)."""
    v = F.col(value)
    valid = v.isNotNull()
    key = F.when(valid, F.struct(*order))
    xv = F.when(valid, F.col(x))
    return [
        F.count(F.lit(1)).alias("n"),
        F.count(v).alias("n_valid"),
        F.min(v).alias("min"),
        F.max(v).alias("max"),
        F.avg(v).alias("mean"),
        F.stddev_samp(v).alias("std"),
        F.min_by(v, key).alias("first"),
        F.max_by(v, key).alias("last"),
        F.covar_pop(v, xv).alias("_cxy"),
        F.var_pop(xv).alias("_vx"),
    ]


def _finish_stats(g: DataFrame) -> DataFrame:
    g = (g.withColumn("nan_frac", F.when(F.col("n") > 0, 1.0 - F.col("n_valid") / F.col("n")))
         .withColumn("drift", F.col("last") - F.col("first"))
         .withColumn("range", F.col("max") - F.col("min"))
         .withColumn("peak_dev", F.greatest(F.col("max") - F.col("mean"), F.col("mean") - F.col("min")))
         .withColumn("slope", F.coalesce(F.try_divide(F.col("_cxy"), F.col("_vx")), F.lit(0.0)))
         .withColumn("coverage", F.col("n_valid") / F.col("n")))
    return g.drop("_cxy", "_vx")


def channel_stats(readings: DataFrame, *, keys: Sequence[str] = ("channel",), order: Sequence[str] = ("ts", "rid"),
                  ts: str = "ts", value: str = "value") -> DataFrame:
    """Per series: n, n_valid, nan_frac, min, max, mean, std, first, last, drift,
    range, peak_dev, slope (units/day), coverage."""
    g = _with_x(readings, keys, order, ts, value).groupBy(*keys).agg(*stat_aggs(value, order))
    return _finish_stats(g)


def trend_slope(readings: DataFrame, *, keys: Sequence[str] = ("channel",), ts: str = "ts",
                order: Sequence[str] = ("ts", "rid"), value: str = "value") -> DataFrame:
    """Least-squares slope of value over days (over the sample number for a numeric time index); < 2 valid points or no time spread -> 0."""
    v = F.col(value)
    xv = F.when(v.isNotNull(), F.col("_x"))
    return _with_x(readings, keys, order, ts, value).groupBy(*keys).agg(
        F.coalesce(F.try_divide(F.covar_pop(v, xv), F.var_pop(xv)), F.lit(0.0)).alias("slope"),
        F.count(v).alias("n_valid"))


def coverage(readings: DataFrame, *, keys: Sequence[str] = ("channel",), value: str = "value") -> DataFrame:
    """Per series: n, n_valid, coverage = share of present samples."""
    return (readings.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count(value).alias("n_valid"))
            .withColumn("coverage", F.col("n_valid") / F.col("n")))


def channel_card(stats: DataFrame, *, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """The 7 numbers of a channel panel."""
    return stats.select(*keys, "min", "max", "mean", "std", "drift", "slope", "coverage")


def health_summary(stats: DataFrame, channels: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Dataset health: avg coverage, most drifted / volatile, lowest coverage (ties -> first column)."""
    keys = list(keys)
    s = stats.join(small_side(channels.select(*keys, "channel", "ordinal", "family")), keys + ["channel"])
    absd = F.coalesce(F.abs(F.col("drift")), F.lit(0.0))
    sd = F.coalesce(F.col("std"), F.lit(0.0))
    cov = 1.0 - F.coalesce(F.col("nan_frac"), F.lit(1.0))
    g = s.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_channels"),
        F.count_distinct("family").alias("n_families"),
        (F.avg(cov) * 100.0).alias("avg_coverage_pct"),
        F.max_by(F.col("channel"), F.struct(absd, -F.col("ordinal"))).alias("most_drifted"),
        F.max(absd).alias("most_drifted_abs"),
        F.max_by(F.col("channel"), F.struct(sd, -F.col("ordinal"))).alias("most_volatile"),
        F.max(sd).alias("most_volatile_std"),
        F.min_by(F.col("channel"), F.struct(cov, F.col("ordinal"))).alias("lowest_coverage"),
        F.min(cov).alias("lowest_coverage_frac"),
    )
    return g.withColumn("coverage_signal", signal_high_good(F.col("avg_coverage_pct"), COVERAGE_POS, COVERAGE_WARN))


def family_diagnostics(stats: DataFrame, channels: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Channels of each family ranked by |drift| (missing drift last, then column order); hero = rank 1."""
    keys = list(keys)
    s = stats.join(small_side(channels.select(*keys, "channel", "ordinal", "family", "unit")), keys + ["channel"])
    w = Window.partitionBy(*keys, "family").orderBy(F.abs(F.col("drift")).desc_nulls_last(), F.col("ordinal"))
    s = s.withColumn("rank", F.row_number().over(w).cast("long"))
    return s.select(*keys, "family", "channel", "unit", "min", "max", "drift", "slope", "nan_frac", "rank",
                    (F.col("rank") == 1).alias("is_hero"))


def drift_kpis(stats: DataFrame, channels: DataFrame, n_daily_bins: int | Column, *, keys: Sequence[str] = ()) -> DataFrame:
    """Period (days, first->last daily bin), #daily rows, steepest |slope|, biggest |drift|."""
    keys = list(keys)
    s = stats.join(small_side(channels.select(*keys, "channel", "ordinal")), keys + ["channel"])
    d2 = F.when(F.col("n_valid") >= 2, F.col("drift")).otherwise(F.lit(0.0))
    nb = n_daily_bins if isinstance(n_daily_bins, Column) else F.lit(int(n_daily_bins))
    g = s.groupBy(*keys).agg(
        F.max_by(F.struct(F.col("channel"), F.col("slope")), F.struct(F.abs(F.col("slope")), -F.col("ordinal"))).alias("st"),
        F.max_by(F.struct(F.col("channel"), d2.alias("drift")), F.struct(F.abs(d2), -F.col("ordinal"))).alias("bd"),
    )
    return g.select(
        *keys,
        F.when(nb >= 2, (nb - 1).cast("double")).otherwise(F.lit(0.0)).alias("period_days"),
        nb.cast("long").alias("n_daily_rows"),
        F.col("st.channel").alias("steepest_channel"), F.col("st.slope").alias("steepest_slope"),
        signal_high_bad(F.abs(F.col("st.slope")), SLOPE_NEG, SLOPE_WARN).alias("slope_signal"),
        F.col("bd.channel").alias("biggest_drift_channel"), F.col("bd.drift").alias("biggest_drift"))


def median_step(frame: DataFrame, *, order: Sequence[str] = ("ts", "rid"), ts: str = "ts",
                keys: Sequence[str] = ()) -> DataFrame:
    """Median gap between consecutive samples of the frame, in minutes (exact).

    The step from the sample before is a ``lag`` inside a piece of the series; between pieces it comes from the small
    table of their first and last times. No positions, no copies of rows. ``order`` begins with ``ts``.
    """
    from sensorlake.plans.ranking import exact_percentiles, materialize, pieces
    from sensorlake.functions.timefns import micros_between
    keys, order = list(keys), list(order)
    rows, path, _ = pieces(frame.select(*keys, *order), keys, order)
    inside = Window.partitionBy(*keys, *path).orderBy(*order)
    near = rows.withColumn("_prev", F.lag(ts).over(inside)).where(F.col("_prev").isNotNull())
    ends = rows.groupBy(*keys, *path).agg(F.min(ts).alias("_first"), F.max(ts).alias("_last"))
    far = ends.withColumn("_prev", F.lag("_last").over(Window.partitionBy(*keys).orderBy(*path))).where(F.col("_prev").isNotNull())
    step = [near.select(*keys, micros_between(F.col("_prev"), F.col(ts)).cast("double").alias("step_us")),
            far.select(*keys, micros_between(F.col("_prev"), F.col("_first")).cast("double").alias("step_us"))]
    d = materialize(step[0].unionByName(step[1]))     # the percentile passes read it several times
    m = exact_percentiles(d, keys, "step_us", [0.5], names=["median_us"])
    return m.select(*keys, (F.col("median_us") / 60e6).alias("median_step_min"))


def dataset_kpis(readings: DataFrame, channels: DataFrame, frame: DataFrame, *, ts: str = "ts",
                 order: Sequence[str] = ("ts", "rid"), value: str = "value") -> DataFrame:
    """Dataset context: span days, median step (min), #channels, #families,
    cell-level missing share, coverage % and its signal. One recording.

    One aggregate over the readings; the frame's row count, the channel /
    family counts and the median step are single values added as literals
    (no join between the one-row results)."""
    from sensorlake.functions.timefns import micros_between
    n_rows = frame.agg(F.count(F.lit(1)).alias("n")).first()["n"]
    fam = channels.agg(F.count(F.lit(1)).alias("c"), F.count_distinct("family").alias("f")).first()
    med = median_step(frame, order=order, ts=ts).first()
    med_v = med["median_step_min"] if med is not None else None
    g = readings.agg(F.min(ts).alias("t0"), F.max(ts).alias("t1"),
                     F.count(F.lit(1)).alias("cells"), F.count(value).alias("present"))
    if isinstance(frame.schema[ts].dataType, T.NumericType):            # a numeric index counts as seconds
        days = (F.col("t1") - F.col("t0")) / F.lit(86_400.0)
    else:
        days = micros_between(F.col("t0"), F.col("t1")) / F.lit(float(US_PER_DAY))
    span = F.when(F.lit(n_rows) >= 2, days).otherwise(F.lit(0.0))
    nan = F.when(F.col("cells") > 0, 1.0 - F.col("present") / F.col("cells")).otherwise(F.lit(0.0))
    return g.select(
        span.alias("span_days"),
        F.lit(med_v).cast("double").alias("median_step_min"), F.lit(n_rows).cast("long").alias("n_rows"),
        F.lit(fam["c"]).cast("long").alias("n_channels"), F.lit(fam["f"]).cast("long").alias("n_families"),
        nan.alias("nan_frac"), ((1.0 - nan) * 100.0).alias("coverage_pct"),
        signal_high_good((1.0 - nan) * 100.0, COVERAGE_POS, COVERAGE_WARN).alias("coverage_signal"))
