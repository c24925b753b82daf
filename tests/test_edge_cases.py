"""Edge cases E1–E16 (FIXTURES.md §C) with expected values stated in the test."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from sensorlake.operators import anomaly as an
from sensorlake.operators import browse as br
from sensorlake.operators import corr as cr
from sensorlake.operators import dist as di
from sensorlake.operators import downsample as ds
from sensorlake.operators import gaps as gp
from sensorlake.operators import resample as rs
from sensorlake.operators import stats as st

T0 = dt.datetime(2024, 1, 1)


def readings(spark, values, channel="c", step_min=1, ts=None):
    rows = []
    for i, v in enumerate(values):
        t = ts[i] if ts is not None else T0 + dt.timedelta(minutes=step_min * i)
        rows.append((channel, t, i, None if v is None else float(v)))
    df = spark.createDataFrame(rows, "channel string, ts timestamp_ntz, rid long, value double")
    return df


def test_e1_constant(spark):
    r = readings(spark, [0.1] * 20)
    s = st.channel_stats(r).first()
    assert s["std"] == 0.0 and s["slope"] == 0.0
    assert an.rolling_anomalies(r, window=5, sigma=1.0).where("is_anomaly").count() == 0
    wide = r.select("ts", "rid", F.col("value").alias("a"), (F.col("value") * 2).alias("b"))
    m = {(x["x"], x["y"]): x["r"] for x in cr.corr_matrix(wide, ["a", "b"]).collect()}
    assert m[("a", "a")] == 0.0 and m[("a", "b")] == 0.0


def test_e2_one_valid(spark):
    s = st.channel_stats(readings(spark, [None, 3.0, None])).first()
    assert s["std"] is None and s["slope"] == 0.0 and s["drift"] == 0.0 and s["n_valid"] == 1


def test_e3_all_missing(spark):
    r = readings(spark, [None] * 4)
    s = st.channel_stats(r).first()
    assert s["nan_frac"] == 1.0 and s["mean"] is None and s["min"] is None and s["coverage"] == 0.0
    g = gp.gap_segments(r).collect()
    assert len(g) == 1 and g[0]["n"] == 4


def test_e4_nan_is_missing(spark):
    from sensorlake.functions.numeric import nan_to_null
    df = spark.createDataFrame([(float("nan"),), (1.0,)], "v double").select(nan_to_null("v").alias("v"))
    assert df.where("v IS NULL").count() == 1


@pytest.mark.parametrize("method", ["plain", "distributed"])
def test_e5_e6_gap_runs(spark, method):
    # runs: 2 at start (not a gap), 3 in the middle, 4 at the end; plus equal-length check below
    vals = [None, None, 1, 2, None, None, None, 3, None, None, None, None]
    r = readings(spark, vals)
    g = sorted((x["start_pos"], x["end_pos"], x["n"], x["dur_us"]) for x in gp.gap_segments(r).collect())
    assert g == [(4, 6, 3, 2 * 60_000_000), (8, 11, 4, 3 * 60_000_000)]
    # Two gaps of equal length -> the earlier is the longest
    r2 = readings(spark, [1, None, None, None, 2, None, None, None, 3])
    gaps = gp.gap_segments(r2)
    chans = spark.createDataFrame([("c", 0, "")], "channel string, ordinal int, unit string")
    d = gp.gap_diagnostics(r2, gaps, chans).first()
    assert d["longest_n"] == 3 and d["longest_at"] == T0 + dt.timedelta(minutes=1) and d["n_episodes"] == 2


def test_e7_duplicate_timestamps_stable(spark):
    ts = [T0, T0, T0, T0 + dt.timedelta(minutes=1)]
    r = readings(spark, [5, 6, 7, 8], ts=ts)
    s = st.channel_stats(r).first()
    assert s["first"] == 5.0 and s["last"] == 8.0
    from sensorlake.plans.ranking import with_position
    for m in ("window", "range"):
        p = {x["rid"]: x["pos"] for x in with_position(r, ["channel"], ["ts", "rid"]).collect()}
        assert p == {0: 0, 1: 1, 2: 2, 3: 3}


def test_e8_weekly_bins(spark):
    ts = [dt.datetime(2024, 1, 3, 5), dt.datetime(2024, 1, 4), dt.datetime(2024, 1, 25, 1)]
    r = readings(spark, [1, 2, 3], ts=ts)
    out = sorted((x["ts"], x["value"]) for x in rs.resample(r, "weekly", "mean").collect())
    assert [t for t, _ in out] == [dt.datetime(2024, 1, 3), dt.datetime(2024, 1, 10), dt.datetime(2024, 1, 17),
                                  dt.datetime(2024, 1, 24)]
    assert [v for _, v in out] == [1.5, None, None, 3.0]


def test_e9_identical_timestamps_slope_zero(spark):
    r = readings(spark, [1, 2, 3], ts=[T0] * 3)
    assert st.trend_slope(r).first()["slope"] == 0.0


def test_e10_quartiles_n5(spark):
    rows = [(T0 + dt.timedelta(days=i), i, float(i), float(2 * i)) for i in range(5)]
    w = spark.createDataFrame(rows, "ts timestamp_ntz, rid long, x double, y double")
    q = cr.time_quartiles(w, "x", "y")
    got = {x["q"]: x["n"] for x in q.collect()}
    assert got == {0: 1, 1: 1, 2: 1, 3: 2}   # ids 0,1,2,3,3


def test_e11_csv_cells(spark):
    from sensorlake.functions.numeric import coerce_numeric
    cells = [" ", "—", "1,000", "1d", "0x1p3", "nan", " 5 ", "inf", "1e3"]
    df = spark.createDataFrame([(c,) for c in cells], "c string").select(coerce_numeric("c").alias("v"))
    got = [r["v"] for r in df.collect()]
    assert got[:6] == [None] * 6 and got[6] == 5.0 and math.isinf(got[7]) and got[8] == 1000.0


def test_e12_headers_and_families(spark):
    from sensorlake.functions.families import family_of
    from sensorlake.sources.files import normalise_header_col
    heads = spark.createDataFrame([("", 0), ("LVDT1 ", 1), ("  ", 2), ("Unnamed: 3", 3)], "c string, i int")
    assert [r[0] for r in heads.select(normalise_header_col("c", "i")).collect()] == ["timestamp", "LVDT1", "col_2", "col_3"]
    names = ["my_lvdt", "PT_3", "VWP1", "Barometer", "gauge_temp"]
    df = spark.createDataFrame([(n,) for n in names], "n string").select(family_of("n").alias("f"))
    assert [r["f"] for r in df.collect()] == ["other", "other", "vw", "press", "strain"]


def test_e13_histogram_constant(spark):
    r = readings(spark, [2, 2, 2])
    h = sorted((x["bin"], x["center"], x["count"]) for x in di.histogram(r, 4).collect())
    assert [c for _b, c, _n in h] == [1.625, 1.875, 2.125, 2.375]     # edges 1.5 … 2.5 by 0.25
    counts, _ = np.histogram([2.0, 2.0, 2.0], bins=4)
    assert [n for _b, _c, n in h] == list(counts)


@pytest.mark.parametrize("N,n,expect", [(3, 5, 3), (5, 5, 5), (6, 5, 5)])
def test_e14_stride(spark, N, n, expect):
    r = readings(spark, list(range(N)))
    out = ds.stride_downsample(r, n, keys=["channel"]).collect()
    pos = sorted(x["pos"] for x in out)
    assert len(pos) == expect and pos[0] == 0 and pos[-1] == N - 1
    assert pos == sorted(set(np.linspace(0, N - 1, n).astype(int))) if N > n else pos == list(range(N))


def test_e15_no_flags(spark):
    r = readings(spark, [1, 9, 1, 9, 100, 1, 9])
    assert an.rolling_anomalies(r, window=4).where("is_anomaly").count() == 0
    assert an.rolling_anomalies(r, window=5, sigma=0).where("is_anomaly").count() == 0
    assert an.rolling_anomalies(r.limit(0), window=5).count() == 0


def test_e16_paging(spark):
    r = readings(spark, list(range(45)))
    assert br.page_bounds(45, 0) == (1, 3, 0, 20)
    assert br.page_bounds(45, 99) == (3, 3, 40, 45)
    assert br.page_bounds(0, 1) == (1, 1, 0, 0)
    last = br.page_rows(r, 99).collect()
    assert [x["row_num"] for x in last] == [41, 42, 43, 44, 45] and last[0]["total_pages"] == 3
    assert br.page_rows(r.limit(0), 1).count() == 0


def test_synthetic_recording(spark):
    from sensorlake.sources.files import synthetic_recording
    df = synthetic_recording(spark, 7 * 24 * 60, seed=3)
    assert df.columns == ["timestamp", "LVDT1", "Tilt1", "Thermocouple1"]
    r = df.agg(F.count("*").alias("n"), F.avg("Thermocouple1").alias("t"), F.avg("LVDT1").alias("l"),
               F.min("timestamp").alias("t0"), F.max("timestamp").alias("t1"), F.avg("Tilt1").alias("g")).first()
    assert r["n"] == 10080 and abs(r["t"] - 22.0) < 0.05 and abs(r["l"] - 5.0) < 0.01
    assert abs(r["g"] - (-0.475)) < 0.002
    assert r["t0"] == T0 and r["t1"] == T0 + dt.timedelta(minutes=10079)
