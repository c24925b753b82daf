"""Resampling to fixed bins with explicit empty bins.

Bins are anchored at midnight of the frame's first day (so 7-day bins start on
that day, not on a Monday). Every bin between the first and the last sample is
emitted for every channel; a bin without valid samples carries NULL.

Plan: valid rows -> bin index (arithmetic, no shuffle) -> groupBy(channel, bin)
with partial aggregation; the spine repeats each channel by a generator. Medians use
the exact percentile (no group is gathered into one task).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.timefns import micros_between, micros_to_ts, ntz_lit, ts_micros
from sensorlake.plans.ranking import dealt, exact_percentiles, small_side

# Resample rule id -> bin width in micro-seconds ("raw" = no resample).
RULES = {
    "raw": None,
    "5min": 5 * 60 * 1_000_000,
    "hourly": 60 * 60 * 1_000_000,
    "daily": 24 * 60 * 60 * 1_000_000,
    "weekly": 7 * 24 * 60 * 60 * 1_000_000,
}
AGGS = ["mean", "min", "max", "std", "median", "first", "last"]


def frame_origin(df: DataFrame, *, ts: str = "ts"):
    """(midnight of the first day, last ts) of the frame — one aggregate row."""
    r = df.agg(F.date_trunc("day", F.min(ts)).cast("timestamp_ntz").alias("o"), F.max(ts).alias("hi")).first()
    return r["o"], r["hi"]


def with_bin(df: DataFrame, width_us: int, origin, *, ts: str = "ts", out: str = "bin") -> DataFrame:
    o = ntz_lit(origin)
    return df.withColumn(out, F.floor(micros_between(o, F.col(ts)) / F.lit(float(width_us))).cast("long"))


def _agg_expr(agg: str, value: str, order: Sequence[str]):
    key = F.struct(*order)
    return {
        "mean": F.avg(value),
        "min": F.min(value),
        "max": F.max(value),
        "std": F.stddev_samp(value),
        "first": F.min_by(value, key),
        "last": F.max_by(value, key),
    }[agg]


def spine(readings: DataFrame, n_bins: int, *, keys: Sequence[str] = ("channel",)) -> DataFrame:
    """Every (series, bin) pair for bin in [0, n_bins): each series (one row) repeated by a generator."""
    return readings.select(*keys).distinct().withColumn(
        "bin", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(int(n_bins) - 1).cast("long"))))


def resample_aggs(readings: DataFrame, rule: str = "daily", aggs: Sequence[str] = ("mean",), *,
                  keys: Sequence[str] = ("channel",), ts: str = "ts", order: Sequence[str] = ("ts", "rid"),
                  value: str = "value", origin=None, last=None, fill: bool = True,
                  frame_keys: Sequence[str] = ()) -> DataFrame:
    """Several aggregates per (series, bin): columns keys + [ts] + aggs.

    Unknown rule or "raw", or a numeric time index -> the readings themselves (column ``value`` per agg);
    unknown aggregate names fall back to mean. ``frame_keys`` (e.g. dataset_id,
    also listed in ``keys``): each recording gets its own origin and spine.
    """
    keys, order = list(keys), list(order)
    aggs = [a if a in AGGS else "mean" for a in aggs]
    width = RULES.get(rule.lower()) if isinstance(rule, str) else None
    if width is None or isinstance(readings.schema[ts].dataType, T.NumericType):
        return readings.select(*keys, ts, *[F.col(value).alias(a) for a in aggs])
    if frame_keys:
        return _resample_frames(readings, width, aggs, keys=keys, ts=ts, order=order, value=value,
                                fill=fill, frame_keys=list(frame_keys))
    if origin is None or last is None:
        o, hi = frame_origin(readings, ts=ts)
        origin = origin if origin is not None else o
        last = last if last is not None else hi
    if origin is None:
        return readings.sparkSession.createDataFrame([], readings.select(*keys, ts).schema).select(
            *keys, ts, *[F.lit(None).cast("double").alias(a) for a in aggs])
    valid = with_bin(readings.where(F.col(value).isNotNull()), width, origin, ts=ts)
    plain = [a for a in dict.fromkeys(aggs) if a != "median"]
    res = None
    if plain:
        res = valid.groupBy(*keys, "bin").agg(*[_agg_expr(a, value, order).alias(a) for a in plain])
    if "median" in aggs:
        med = exact_percentiles(valid, keys + ["bin"], value, [0.5], names=["median"])
        res = med if res is None else res.join(med, keys + ["bin"], "left")
    if fill:
        n_bins = int(micros_between_py(origin, last) // width) + 1
        res = spine(readings, n_bins, keys=keys).join(res, keys + ["bin"], "left")
    out = res.withColumn(ts, micros_to_ts(ts_micros(ntz_lit(origin)) + F.col("bin") * F.lit(width)))
    return out.select(*keys, ts, *[F.col(a) for a in aggs])


def _resample_frames(readings: DataFrame, width: int, aggs: list[str], *, keys: list[str], ts: str,
                     order: list[str], value: str, fill: bool, frame_keys: list[str]) -> DataFrame:
    """Many recordings at once: per-recording origin (one row per recording,
    broadcast), bins relative to it, spine per series by ``sequence``."""
    fr = readings.groupBy(*frame_keys).agg(
        F.date_trunc("day", F.min(ts)).cast("timestamp_ntz").alias("_o"), F.max(ts).alias("_hi"), F.count(F.lit(1)).alias("_n"))
    fr = small_side(fr.withColumn("_nb", F.floor(micros_between(F.col("_o"), F.col("_hi")) / F.lit(float(width)))
                                  .cast("long") + 1))
    size = fr.agg(F.sum("_n").alias("n"), F.sum("_nb").alias("bins")).first()
    n_rows, n_bins = size["n"] or 0, size["bins"] or 0
    fr = fr.drop("_n")
    valid = readings.where(F.col(value).isNotNull()).join(fr, frame_keys)
    valid = valid.withColumn("bin", F.floor(micros_between(F.col("_o"), F.col(ts)) / F.lit(float(width))).cast("long"))
    plain = [a for a in dict.fromkeys(aggs) if a != "median"]
    res = None
    if plain:
        res = valid.groupBy(*keys, "bin").agg(*[_agg_expr(a, value, order).alias(a) for a in plain])
        res = dealt(res, max(n_rows, n_bins), keys + ["bin"])
    if "median" in aggs:
        med = exact_percentiles(valid, keys + ["bin"], value, [0.5], names=["median"], n_rows=n_rows)
        res = med if res is None else res.join(med, keys + ["bin"], "left")
    if fill:
        sp = (readings.select(*keys).distinct().join(fr, frame_keys)
              .withColumn("bin", F.explode(F.sequence(F.lit(0).cast("long"), F.col("_nb") - 1))))
        res = dealt(sp.select(*keys, "bin"), max(n_rows, n_bins), keys + ["bin"]).join(res, keys + ["bin"], "left")
    res = res.join(fr.select(*frame_keys, "_o"), frame_keys)
    out = res.withColumn(ts, micros_to_ts(ts_micros(F.col("_o")) + F.col("bin") * F.lit(width)))
    return out.select(*keys, ts, *[F.col(a) for a in aggs])


def micros_between_py(a, b) -> int:
    d = b - a
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds


def resample(readings: DataFrame, rule: str = "daily", agg: str = "mean", **kw) -> DataFrame:
    """One aggregate per (series, bin) in column ``value``."""
    a = agg if agg in AGGS else "mean"
    r = resample_aggs(readings, rule, [a], **kw)
    return r.withColumnRenamed(a, kw.get("value", "value"))


def daily_band(readings: DataFrame, **kw) -> DataFrame:
    """Daily mean, min and max in one aggregation."""
    return resample_aggs(readings, "daily", ["mean", "min", "max"], **kw)


def selection_kpis(wide: DataFrame, picked: Sequence[str], rule: str = "raw", *, ts: str = "ts") -> DataFrame:
    """#channels, rows after resampling, first and last row time of the frame."""
    width = RULES.get(rule)
    g = wide.agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("lo"), F.max(ts).alias("hi"))
    if width is None:
        return g.select(F.lit(len(picked)).cast("long").alias("n_channels"), F.lit(rule).alias("rule"),
                        F.col("n").cast("long").alias("n_rows"), F.col("lo").alias("period_start"),
                        F.col("hi").alias("period_end"))
    o = F.date_trunc("day", F.col("lo")).cast("timestamp_ntz")
    nb = F.floor(micros_between(o, F.col("hi")) / F.lit(float(width))).cast("long")
    return g.select(F.lit(len(picked)).cast("long").alias("n_channels"), F.lit(rule).alias("rule"),
                    (nb + 1).alias("n_rows"), o.alias("period_start"),
                    micros_to_ts(ts_micros(o) + nb * F.lit(width)).alias("period_end"))
