"""Load-event landmarks per record: event window and zero crossing.

A record is one series (``record`` key) of samples in ``order``. The
original walks indices in Python; here every step is a grouped aggregate or an
island (gaps-and-islands) over positions, so records of any length and any
number of records run in parallel.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.plans.ranking import halo_window, materialize, position_runs, small_side, with_position


def positions(records: DataFrame, *, record: str = "record_id", order: Sequence[str] = ("ts", "rid")) -> DataFrame:
    """Records with ``pos``, checkpointed: the landmark operators read it several times."""
    return materialize(with_position(records, [record], list(order)))


def with_velocity(p: DataFrame, *, record: str = "record_id", load: str = "load", out: str = "velocity") -> DataFrame:
    """velocity = load − previous load in the record (0 at the first sample); 1-row halo."""
    h = halo_window(p, [record], "pos", 1, 0, {"_prev": F.min_by(F.col(load), F.col("pos"))})
    return h.withColumn(out, F.when(F.col("pos") == 0, F.lit(0.0)).otherwise(F.col(load) - F.col("_prev"))).drop("_prev")


def _peak(p: DataFrame, record: str, load: str) -> DataFrame:
    a = F.abs(F.col(load))
    return p.groupBy(record).agg(
        F.count(F.lit(1)).alias("n"), F.max(a).alias("peak"),
        F.max_by(F.col("pos"), F.struct(a, -F.col("pos"))).alias("peak_pos"))


def event_window(p: DataFrame, *, record: str = "record_id", load: str = "load", threshold_pct: float = 0.05,
                 buffer_pct: float = 0.15, min_buffer: int = 10, contiguous_run: int = 0) -> DataFrame:
    """(start, end) sample indices of the load event per record (``p`` carries ``pos``).

    Above = |load| > threshold_pct·max|load|. Fewer than 5 above, or no load -> (0, n).
    Plain: first … last above. contiguous_run = k > 0: from the peak outwards up to
    the nearest run of ≥ k consecutive samples below threshold on each side
    (end = that run's first index, else n−1; start = the left run's last index,
    else 0). Then a buffer max(min_buffer, int((end−start)·buffer_pct)) is added,
    clipped to [0, n]."""
    pk = _peak(p, record, load)
    q = p.join(small_side(pk), record).withColumn("_above", F.abs(F.col(load)) > F.col("peak") * F.lit(float(threshold_pct)))
    g = q.groupBy(record).agg(
        F.first("n").alias("n"), F.first("peak").alias("peak"), F.first("peak_pos").alias("peak_pos"),
        F.count_if("_above").alias("n_above"),
        F.min(F.when(F.col("_above"), F.col("pos"))).alias("first_above"),
        F.max(F.when(F.col("_above"), F.col("pos"))).alias("last_above"))
    if contiguous_run > 0:
        below = q.where(~F.col("_above")).select(record, "pos", "peak_pos")
        isl = position_runs(below, [record], "pos", first={"peak_pos": "peak_pos"}).withColumnsRenamed(
            {"start_pos": "i_start", "end_pos": "i_end", "n": "i_len"})
        isl = isl.where(F.col("i_len") >= contiguous_run)
        ends = isl.groupBy(record).agg(
            F.min(F.when(F.col("i_start") > F.col("peak_pos"), F.col("i_start"))).alias("_end"),
            F.max(F.when(F.col("i_end") < F.col("peak_pos"), F.col("i_end"))).alias("_start"))
        g = g.join(ends, record, "left")
        lo = F.coalesce(F.col("_start"), F.lit(0))
        hi = F.coalesce(F.col("_end"), F.col("n") - 1)
    else:
        lo, hi = F.col("first_above"), F.col("last_above")
    buf = F.greatest(F.lit(min_buffer), F.floor((hi - lo).cast("double") * F.lit(float(buffer_pct))).cast("long"))
    whole = (F.col("peak") <= 0) | (F.col("n_above") < 5)
    return g.select(record, F.col("n").cast("long").alias("n"), F.col("peak_pos").cast("long").alias("peak_pos"),
                    F.when(whole, F.lit(0)).otherwise(F.greatest(F.lit(0), lo - buf)).cast("long").alias("start"),
                    F.when(whole, F.col("n")).otherwise(F.least(F.col("n"), hi + buf)).cast("long").alias("end"))


def zero_crossing(p: DataFrame, *, record: str = "record_id", load: str = "load", velocity: str = "velocity") -> DataFrame:
    """Index where velocity changes sign (−, 0, + are three signs) at or after the
    load peak: first i ≥ peak with sign(v[i]) ≠ sign(v[i+1]); none -> first index of
    min |v| from the peak on; fewer than 3 samples or peak at the end -> NULL."""
    pk = _peak(p, record, load)
    h = halo_window(p, [record], "pos", 0, 1, {"_next": F.max_by(F.col(velocity), F.col("pos"))})
    q = h.join(small_side(pk), record).where(F.col("pos") >= F.col("peak_pos"))
    nxt_ok = F.col("pos") + 1 < F.col("n")
    cross = nxt_ok & (F.signum(F.col(velocity)) != F.signum(F.col("_next")))
    g = q.groupBy(record).agg(
        F.first("n").alias("n"), F.first("peak_pos").alias("peak_pos"),
        F.min(F.when(cross, F.col("pos"))).alias("_cross"),
        F.min_by(F.col("pos"), F.struct(F.abs(F.col(velocity)), F.col("pos"))).alias("_argmin"))
    undefined = (F.col("n") < 3) | (F.col("peak_pos") >= F.col("n") - 1)
    return g.select(record, F.col("n").cast("long").alias("n"), F.col("peak_pos").cast("long").alias("peak_pos"),
                    F.when(undefined, F.lit(None)).otherwise(F.coalesce(F.col("_cross"), F.col("_argmin")))
                    .cast("long").alias("unload_pos"))
