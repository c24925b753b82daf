
import pytest
from pyspark.sql import functions as F

from sensorlake import fixtures as fx
from sensorlake.operators import anomaly as an
from sensorlake.operators import corr as cr
from sensorlake.operators import gaps as gp
from sensorlake.operators import resample as rs
from sensorlake.operators import stats as st
from sensorlake.queries import wide_readings


@pytest.mark.parametrize("a,b", [(2.5, -7.0), (-0.01, 3.0)])
def test_flags_invariant_under_affine_map(spark, sf001, a, b):
    r = fx.events_long(spark, sf001)
    base = an.rolling_anomalies(r, window=11, sigma=2.0).select("rid", F.col("is_anomaly").alias("f0"))
    moved = an.rolling_anomalies(r.withColumn("value", F.col("value") * a + b), window=11, sigma=2.0)
    j = moved.join(base, "rid")
    assert j.count() == r.count() and j.where(F.col("is_anomaly") != F.col("f0")).count() == 0


def test_no_flag_when_too_few_samples_for_sigma(spark, sf001):
    # with m valid samples in a frame, |x - mean| <= (m-1)/sqrt(m) * sd: sigma = 3 needs m > 10
    r = fx.events_long(spark, sf001)
    assert an.rolling_anomalies(r, window=10, sigma=3.0).where("is_anomaly").count() == 0


def test_coverage_times_n_is_n_valid(spark, sf001):
    s = st.channel_stats(wide_readings(spark, sf001)).collect()
    for row in s:
        assert round(row["coverage"] * row["n"]) == row["n_valid"]


def test_gap_lengths_bounded_by_missing(spark, sf001):
    r = wide_readings(spark, sf001)
    missing = {x["channel"]: x["m"] for x in r.groupBy("channel").agg(F.count_if(F.col("value").isNull()).alias("m")).collect()}
    per = gp.gap_segments(r).groupBy("channel").agg(F.sum("n").alias("s"), F.max("n").alias("mx")).collect()
    for x in per:
        assert x["mx"] <= x["s"] <= missing[x["channel"]]


def test_correlation_bounded_and_symmetric(spark, sf001):
    m = {(x["x"], x["y"]): x["r"] for x in cr.corr_matrix(fx.lineitem_masked(spark, sf001), fx.LINEITEM_CHANNELS).collect()}
    for (x, y), r in m.items():
        assert -1.0 <= r <= 1.0 and m[(y, x)] == r


def test_resample_spine_has_no_holes(spark, sf001):
    out = rs.resample(fx.orders_series(spark, sf001), "weekly", "mean")
    g = out.groupBy("channel").agg(F.count("*").alias("n"), F.min("ts").alias("a"), F.max("ts").alias("b")).first()
    weeks = (g["b"] - g["a"]).days // 7 + 1
    assert g["n"] == weeks and out.select("ts").distinct().count() == weeks
