"""Rolling mean ± Nσ anomaly flags and their summaries.

The centred frame of ``window`` samples is evaluated over positions in chunks
(``sensorlake.plans.ranking``), so one long channel is processed by many tasks.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.operators.stats import ANOMALY_NEG, ANOMALY_WARN, signal_high_bad
from sensorlake.plans.ranking import materialize, placed_pieces, positions_in, rolling_stats, small_side, with_position

#: Positions that the search for the first flags starts with, and how many times as many each further stretch ends at.
PREFIX = 8192
GROWTH = 16


def rolling_anomalies(readings: DataFrame, *, window: int = 60, sigma: float = 3.0,
                      keys: Sequence[str] = ("channel",), order: Sequence[str] = ("ts", "rid"),
                      value: str = "value", chunk: int | None = None) -> DataFrame:
    """Adds ``pos`` and ``is_anomaly``: |x − μ| > σ·sd over the centred frame
    [pos − window//2, pos + (window−1)//2] (missing samples take up places),
    needing at least max(5, window//4) present values. A frame whose values
    are all equal never flags (guards float noise in avg/stddev). Missing
    samples, window < 5, sigma <= 0 -> False. Infinite values are in no frame, but are
    themselves tested."""
    keys, order = list(keys), list(order)
    p = with_position(readings, keys, order)
    if window < 5 or sigma <= 0:
        return p.withColumn("is_anomaly", F.lit(False))
    return _flagged(p, window, sigma, keys, value, chunk)


def _flagged(p: DataFrame, window: int, sigma: float, keys: list[str], value: str, chunk: int | None = None) -> DataFrame:
    """Rows with positions ``pos`` and the flag of each; a frame holds the given rows only."""
    lo, hi = window // 2, (window - 1) // 2
    minp = max(5, window // 4)
    v = F.col(value)
    h = rolling_stats(p, keys, "pos", value, lo, hi, chunk=chunk, prefix="_r")
    flag = (v.isNotNull() & (F.col("_r_cnt") >= minp) & F.col("_r_sd").isNotNull()
            & ((F.col("_r_max") - F.col("_r_min")) > 0)
            & (F.abs(v - F.col("_r_mean")) > F.lit(float(sigma)) * F.col("_r_sd")))
    return h.withColumn("is_anomaly", F.coalesce(flag, F.lit(False))).drop(
        "_r_cnt", "_r_mean", "_r_sd", "_r_max", "_r_min")


def anomaly_summary(flags: DataFrame, *, keys: Sequence[str] = ("channel",), value: str = "value") -> DataFrame:
    """Per series: n_valid, n_flagged, rate = flagged / max(1, valid), signal."""
    g = flags.groupBy(*keys).agg(F.count(value).alias("n_valid"), F.count_if("is_anomaly").alias("n_flagged"))
    g = g.withColumn("rate", F.col("n_flagged") / F.greatest(F.col("n_valid"), F.lit(1)))
    return g.withColumn("signal", signal_high_bad(F.col("rate"), ANOMALY_NEG, ANOMALY_WARN))


def _with_series_mean(flags: DataFrame, keys: list[str], value: str, readings: DataFrame | None = None) -> DataFrame:
    """Join the series mean. Taken from ``readings`` when given (a cheap scan)
    instead of re-running the rolling computation behind ``flags``."""
    src = readings if readings is not None else flags
    mu = src.groupBy(*keys).agg(F.avg(value).alias("mu"))
    return flags.join(small_side(mu), keys)


def worst_excursion(flags: DataFrame, *, keys: Sequence[str] = ("channel",), ts: str = "ts", rid: str = "rid",
                    value: str = "value") -> DataFrame:
    """Per series: the flagged sample farthest from the series mean (first on ties)
    and its signed deviation; no flags -> NULL time and deviation 0.

    One aggregation: the farthest flagged value from the mean is the largest or
    the smallest flagged value, so the mean and both candidates (first on ties)
    come from the same pass."""
    keys = list(keys)
    fl = F.col("is_anomaly")
    row = F.struct(F.col(ts).alias("ts"), F.col(rid).alias("rid"), F.col(value).alias("value"), F.col("pos").alias("pos"))
    g = flags.groupBy(*keys).agg(
        F.avg(value).alias("mu"),
        F.max_by(row, F.when(fl, F.struct(F.col(value), -F.col("pos")))).alias("hi"),
        F.min_by(row, F.when(fl, F.struct(F.col(value), F.col("pos")))).alias("lo"))
    dh = F.col("hi.value") - F.col("mu")
    dl = F.col("lo.value") - F.col("mu")
    pick_hi = (F.abs(dh) > F.abs(dl)) | ((F.abs(dh) == F.abs(dl)) & (F.col("hi.pos") <= F.col("lo.pos")))
    w = F.when(F.col("hi").isNull(), F.lit(None)).when(pick_hi, F.col("hi")).otherwise(F.col("lo"))
    g = g.withColumn("w", w)
    return g.select(*keys, F.col("w.ts").alias("worst_ts"), F.col("w.rid").alias("worst_rid"),
                    F.col("w.value").alias("worst_value"),
                    F.coalesce(F.col("w.value") - F.col("mu"), F.lit(0.0)).alias("deviation"))


def _only_flagged(flags: DataFrame) -> DataFrame:
    """Flagged rows. The filter also tests a row mark: it would else go below the projections that make up a flag, and each
    use of a frame's values would be written out in full."""
    return flags.withColumn("_mark", F.monotonically_increasing_id()).where(
        F.col("is_anomaly") & (F.col("_mark") >= 0)).drop("_mark")


def flagged_first(flags: DataFrame, n: int = 12, *, keys: Sequence[str] = ("channel",), ts: str = "ts",
                  rid: str = "rid", value: str = "value", readings: DataFrame | None = None) -> DataFrame:
    """First ``n`` flagged samples per series with value and deviation from the
    series mean (ranked window -> per-partition top-n before the shuffle)."""
    keys = list(keys)
    f = _only_flagged(flags)
    w = Window.partitionBy(*keys).orderBy("pos")
    f = f.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= n)
    f = _with_series_mean(f, keys, value, readings if readings is not None else flags)
    return f.select(*keys, F.col("rank").cast("long").alias("rank"), ts, rid, value,
                    (F.col(value) - F.col("mu")).alias("deviation"))


def first_anomalies(readings: DataFrame, n: int = 12, *, window: int = 60, sigma: float = 3.0,
                    keys: Sequence[str] = ("channel",), order: Sequence[str] = ("ts", "rid"),
                    value: str = "value", prefix: int = PREFIX) -> DataFrame:
    """The rows of ``flagged_first(rolling_anomalies(readings))`` from a prefix of each series.

    Flags are computed for positions [0, prefix), then for ``GROWTH`` times as many of the series that have
    fewer than ``n`` so far and go on, and so forth. A stretch takes along the rows its frames reach into; pieces of
    the order outside it are neither sorted nor framed."""
    keys, order = list(keys), list(order)
    if window < 5 or sigma <= 0:
        return flagged_first(rolling_anomalies(readings, window=window, sigma=sigma, keys=keys, order=order, value=value),
                             n, keys=keys, ts=order[0], rid=order[-1], value=value, readings=readings)
    lo, hi = window // 2, (window - 1) // 2
    rows, path, table = placed_pieces(readings, keys, order)
    still = table.select(*keys, "_total").distinct()
    along = Window.partitionBy(*keys).orderBy("pos")
    found, start, stop = None, 0, max(prefix, window)
    while True:
        wanted = table.where((F.col("_before") < stop + hi) & (F.col("_before") + F.col("_n") > start - lo)).join(
            still.select(*keys), keys, "left_semi")
        p = positions_in(rows, path, wanted, keys, order, readings.columns).where(
            (F.col("pos") >= start - lo) & (F.col("pos") < stop + hi))
        more = _only_flagged(_flagged(p, window, sigma, keys, value)).where(
            (F.col("pos") >= start) & (F.col("pos") < stop)).drop("is_anomaly")
        more = more if found is None else found.unionByName(more)
        found = materialize(more.withColumn("rank", F.row_number().over(along)).where(F.col("rank") <= n).drop("rank"))
        enough = found.groupBy(*keys).count().where(F.col("count") >= n)
        still = still.where(F.col("_total") > stop).join(enough, keys, "left_anti")
        if still.isEmpty():
            break
        still = materialize(still)
        start, stop = stop, stop * GROWTH
    return flagged_first(found.withColumn("is_anomaly", F.lit(True)), n, keys=keys, ts=order[0], rid=order[-1], value=value,
                         readings=readings)


def anomaly_overlay(flags: DataFrame, n: int = 2000, *, keys: Sequence[str] = ("channel",),
                    ts: str = "ts", rid: str = "rid", value: str = "value",
                    readings: DataFrame | None = None) -> DataFrame:
    """Chart rows: the uniform stride of ``n`` samples plus every flagged sample
    (a row in both sets appears once per role). One pass over ``flags``; the
    series lengths come from ``readings`` when given."""
    from sensorlake.operators.downsample import stride_targets
    keys = list(keys)
    src = readings if readings is not None else flags
    counts = src.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))
    t = small_side(stride_targets(counts, n, keys=keys).withColumn("_tgt", F.lit(True)))
    j = flags.join(t.drop("k"), keys + ["pos"], "left")
    roles = F.array_compact(F.array(F.when(F.col("_tgt"), F.lit("series")),
                                    F.when(F.col("is_anomaly"), F.lit("anomaly"))))
    return (j.where(F.col("_tgt").isNotNull() | F.col("is_anomaly"))
            .select(*keys, "pos", ts, rid, value, F.explode(roles).alias("role")))
