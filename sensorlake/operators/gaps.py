"""Missing-data gaps: runs of ≥ 3 missing samples and their diagnostics.

Gaps-and-islands without a per-channel window: every sample gets its position by the
distributed ranking; runs of missing ones are found inside chunks of positions and put together
over the small table of runs at the chunks' borders (``position_runs``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions.timefns import ntz_lit

from sensorlake.functions.timefns import micros_between, micros_to_ts, ts_micros
from sensorlake.operators.stats import COVERAGE_POS, COVERAGE_WARN, signal_high_good
from sensorlake.plans.ranking import materialize, position_runs, small_side, with_position

MIN_GAP_SAMPLES = 3  # fixed value: shorter missing runs are not outages


def gap_segments(readings: DataFrame, *, min_len: int = MIN_GAP_SAMPLES, keys: Sequence[str] = ("channel",),
                 order: Sequence[str] = ("ts", "rid"), ts: str = "ts", value: str = "value") -> DataFrame:
    """One row per run of ≥ min_len consecutive missing samples:
    keys, start_pos, end_pos, start_ts, end_ts, n, dur_us (= end_ts − start_ts)."""
    keys, order = list(keys), list(order)
    p = with_position(readings.select(*keys, *order, value), keys, order)
    runs = position_runs(p.where(F.col(value).isNull()).select(*keys, ts, "pos"), keys, "pos",
                         first={"start_ts": ts}, last={"end_ts": ts})
    runs = runs.where(F.col("n") >= min_len)
    return runs.withColumn("dur_us", micros_between(F.col("start_ts"), F.col("end_ts")))


def gap_diagnostics(readings: DataFrame, gaps: DataFrame, channels: DataFrame, *,
                    keys: Sequence[str] = ("channel",), value: str = "value") -> DataFrame:
    """Per channel: coverage, longest gap (first wins), where and how long, episodes.
    Channels without gaps are kept with 0."""
    keys = list(keys)
    cov = readings.groupBy(*keys).agg((F.count(value) / F.count(F.lit(1))).alias("coverage"))
    g = gaps.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_episodes"),
        F.max_by(F.struct("n", "start_ts", "dur_us"), F.struct(F.col("n"), -F.col("start_pos"))).alias("L"))
    dims = channels.select(*keys, "ordinal", "unit")
    out = cov.join(small_side(dims), keys).join(g, keys, "left")
    return out.select(*keys, "ordinal", "unit", "coverage",
                      F.coalesce(F.col("L.n"), F.lit(0)).cast("long").alias("longest_n"),
                      F.col("L.start_ts").alias("longest_at"),
                      F.coalesce(F.col("L.dur_us"), F.lit(0)).cast("long").alias("longest_dur_us"),
                      F.coalesce(F.col("n_episodes"), F.lit(0)).cast("long").alias("n_episodes"))


def quality_kpis(diag: DataFrame, frame: DataFrame | None = None, *, ts: str = "ts") -> DataFrame:
    """Dataset quality: avg / lowest coverage, longest gap, total and most episodes
    (ties -> first column)."""
    g = diag.agg(
        (F.avg("coverage") * 100.0).alias("avg_coverage_pct"),
        F.min_by("channel", F.struct(F.col("coverage"), F.col("ordinal"))).alias("lowest_coverage_channel"),
        F.min("coverage").alias("lowest_coverage"),
        F.max_by(F.struct("channel", "longest_n", "longest_dur_us"),
                 F.struct(F.col("longest_n"), -F.col("ordinal"))).alias("L"),
        F.sum("n_episodes").cast("long").alias("total_episodes"),
        F.max_by(F.struct("channel", "n_episodes"), F.struct(F.col("n_episodes"), -F.col("ordinal"))).alias("E"),
    )
    g = g.select("avg_coverage_pct",
                 signal_high_good(F.col("avg_coverage_pct"), COVERAGE_POS, COVERAGE_WARN).alias("coverage_signal"),
                 "lowest_coverage_channel", "lowest_coverage",
                 F.when(F.col("lowest_coverage") < 0.85, "neg").when(F.col("lowest_coverage") < 0.95, "warn")
                 .alias("lowest_signal"),
                 F.col("L.channel").alias("longest_gap_channel"), F.col("L.longest_n").alias("longest_gap_n"),
                 F.col("L.longest_dur_us").alias("longest_gap_dur_us"), "total_episodes",
                 F.col("E.channel").alias("most_episodes_channel"), F.col("E.n_episodes").alias("most_episodes"))
    return g


def gap_offenders(diag: DataFrame, top: int = 5) -> DataFrame:
    """Top channels by longest gap (stable by column order) + #channels with gaps."""
    d = materialize(diag)                       # a row a channel, read twice
    n_with = d.agg(F.count_if(F.col("n_episodes") > 0)).first()[0]
    w = Window.orderBy(F.col("longest_n").desc(), F.col("ordinal"))
    best = d.orderBy(F.col("longest_n").desc(), F.col("ordinal")).limit(top)
    return best.withColumn("rank", F.row_number().over(w).cast("long")).select(
        "rank", "channel", "longest_n", "longest_dur_us", "n_episodes", "coverage", F.lit(n_with).cast("long").alias("n_with_gaps"))


def gap_timeline(gaps: DataFrame, frame: DataFrame, *, ts: str = "ts", n_ticks: int = 5,
                 min_width: float = 0.2) -> tuple[DataFrame, DataFrame]:
    """Gantt geometry: per gap start % and width % (≥ min_width) of the frame span,
    and ``n_ticks`` evenly spaced tick times. Span ≤ 0 -> no rows.
    The frame's first/last time is one aggregate row used as literals."""
    r = frame.agg(F.min(ts).alias("t0"), F.max(ts).alias("t1")).first()
    spark = gaps.sparkSession
    if r is None or r["t0"] is None or r["t1"] <= r["t0"]:
        return (gaps.limit(0).select("channel", "start_pos", F.lit(0.0).alias("left_pct"), F.lit(0.0).alias("width_pct")),
                spark.range(0).select(F.col("id").alias("tick"), ntz_lit(None).alias("ts")))
    t0 = ntz_lit(r["t0"])
    span = F.lit(micros_between_py(r["t0"], r["t1"]))
    x0 = micros_between(t0, F.col("start_ts")) / span * 100.0
    x1 = micros_between(t0, F.col("end_ts")) / span * 100.0
    bars = gaps.select("channel", "start_pos", x0.alias("left_pct"),
                       F.greatest(F.lit(min_width), x1 - x0).alias("width_pct"))
    ticks = spark.range(n_ticks).select(
        F.col("id").alias("tick"),
        micros_to_ts(ts_micros(t0) + F.floor(span * F.col("id") / F.lit(n_ticks - 1)).cast("long")).alias("ts"))
    return bars, ticks


def micros_between_py(a, b) -> int:
    d = b - a
    return (d.days * 86_400 + d.seconds) * 1_000_000 + d.microseconds
