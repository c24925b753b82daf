"""Time windows anchored on the recording's own last sample."""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.timefns import ntz_lit
from sensorlake.plans.ranking import small_side

# Preset id -> look-back (None = whole recording).
PRESETS = {
    "24h": dt.timedelta(hours=24),
    "7d": dt.timedelta(days=7),
    "30d": dt.timedelta(days=30),
    "all": None,
}
# accepted texts of a custom range besides ISO; month first where both would do
TEXT_DAYS = ["%m/%d/%Y", "%d/%m/%Y", "%Y/%m/%d", "%d.%m.%Y", "%m-%d-%Y", "%d-%m-%Y", "%b %d %Y", "%B %d %Y", "%d %b %Y", "%d %B %Y",
             "%Y%m%d"]
LABELS = {"24h": "Last 24h", "7d": "Last 7d", "30d": "Last 30d", "all": "All data"}


def _to_ts(v):
    if v is None or isinstance(v, dt.datetime):
        return v
    if isinstance(v, dt.date):
        return dt.datetime(v.year, v.month, v.day)
    text = " ".join(str(v).replace(",", " ").split())
    try:
        return dt.datetime.fromisoformat(text)
    except ValueError:
        pass
    for day in TEXT_DAYS:
        for clock in ("", " %H:%M", " %H:%M:%S"):
            try:
                return dt.datetime.strptime(text, day + clock)
            except ValueError:
                continue
    raise TypeError(f"not a time: {v!r}")


def custom_range(from_date, to_date) -> tuple[dt.datetime, dt.datetime]:
    """Date pickers -> (from midnight, to date + 1 day - 1 second)."""
    f = _to_ts(from_date)
    t = _to_ts(to_date)
    f = dt.datetime(f.year, f.month, f.day)
    t = dt.datetime(t.year, t.month, t.day) + dt.timedelta(days=1) - dt.timedelta(seconds=1)
    return f, t


def numeric_time(df: DataFrame, ts: str = "ts") -> bool:
    """Whether the time index is a number, not a time."""
    return isinstance(df.schema[ts].dataType, T.NumericType)


def _bound(v):
    return F.lit(float(v)) if isinstance(v, (int, float)) else ntz_lit(v)


def bounds_frame(df: DataFrame, preset: str = "all", frm=None, to=None, *, ts: str = "ts",
                 keys: Sequence[str] = ()) -> DataFrame:
    """(lo, hi) per recording (one row if ``keys`` is empty), as a DataFrame.

    24h/7d/30d: [max(first, last - Δ), last]; all / unknown: [first, last];
    custom: the given ends, a missing end defaults to first / last; bad input -> all.
    """
    keys = list(keys)
    g = df.where(F.col(ts).isNotNull()).groupBy(*keys).agg(F.min(ts).alias("first"), F.max(ts).alias("last"))
    lo, hi = F.col("first"), F.col("last")
    if numeric_time(df, ts):
        preset = "all"
    if preset == "custom":
        try:
            f, t = _to_ts(frm), _to_ts(to)
            lo = ntz_lit(f) if f is not None else lo
            hi = ntz_lit(t) if t is not None else hi
        except TypeError:
            pass
    elif PRESETS.get(preset) is not None:
        d = PRESETS[preset]
        lo = F.greatest(F.col("first"), F.col("last") - F.make_dt_interval(
            F.lit(d.days), F.lit(d.seconds // 3600), F.lit((d.seconds // 60) % 60), F.lit(d.seconds % 60)))
    return g.select(*keys, lo.alias("lo"), hi.alias("hi"))


def window_bounds(df: DataFrame, preset: str = "all", frm=None, to=None, *, ts: str = "ts"):
    """Resolved (lo, hi) as Python values: one aggregate row to the driver."""
    r = bounds_frame(df, preset, frm, to, ts=ts).first()
    return (None, None) if r is None else (r["lo"], r["hi"])


def apply_window(df: DataFrame, preset: str = "all", frm=None, to=None, *, ts: str = "ts",
                 anchor: DataFrame | None = None, keys: Sequence[str] = ()) -> DataFrame:
    """Rows with lo <= ts <= hi. ``all`` is the identity, and so is every window of a numeric time index.

    One recording: the bounds are collected as two literals, so the range
    reaches the Parquet scan as a pushed filter. Many recordings (``keys``):
    the per-recording bounds table (one row per recording) is joined.
    """
    if preset == "all" or (preset not in PRESETS and preset != "custom") or numeric_time(df, ts):
        return df
    src = anchor if anchor is not None else df
    if not keys:
        lo, hi = window_bounds(src, preset, frm, to, ts=ts)
        if lo is None:
            return df
        return df.where((F.col(ts) >= ntz_lit(lo)) & (F.col(ts) <= ntz_lit(hi)))
    b = bounds_frame(src, preset, frm, to, ts=ts, keys=keys)
    return (df.join(small_side(b), list(keys))
            .where((F.col(ts) >= F.col("lo")) & (F.col(ts) <= F.col("hi"))).drop("lo", "hi"))


def window_share(df: DataFrame, preset: str = "all", frm=None, to=None, *, ts: str = "ts") -> DataFrame:
    """One row: n_in_window, n_total, share_pct, label, lo, hi (single pass count)."""
    if numeric_time(df, ts):
        preset = "all"
    lo, hi = window_bounds(df, preset, frm, to, ts=ts)
    if preset == "all" or (preset not in PRESETS and preset != "custom") or lo is None:
        inw = F.count(F.lit(1))
    else:
        inw = F.count_if((F.col(ts) >= ntz_lit(lo)) & (F.col(ts) <= ntz_lit(hi)))
    label = LABELS.get(preset)
    if label is None:
        label = (f"{lo:%Y-%m-%d %H:%M} → {hi:%Y-%m-%d %H:%M}" if preset == "custom" and lo is not None
                 else "All data")
    agg = df.agg(inw.cast("long").alias("n_in_window"), F.count(F.lit(1)).cast("long").alias("n_total"))
    return (agg.withColumn("share_pct", F.col("n_in_window") * 100.0 / F.greatest(F.col("n_total"), F.lit(1)))
            .withColumn("label", F.lit(label))
            .withColumn("lo", _bound(lo)).withColumn("hi", _bound(hi)))
