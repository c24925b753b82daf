"""Positions, frames and percentiles in many small pieces against one window over each series."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from sensorlake import fixtures as fx
from sensorlake.plans import ranking
from sensorlake.plans.ranking import exact_percentiles, halo_window, pieces, rolling_stats, with_position
from sensorlake.queries import wide_readings


@pytest.fixture(scope="module")
def ev(spark, sf001):
    return fx.events_long(spark, sf001)


@pytest.fixture
def tiny_buckets(monkeypatch):
    """Many pieces per series, so every border case is exercised."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 37)


def plain_position(df, keys, order):
    return df.withColumn("pos2", (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def same_positions(df, keys, order, **how):
    got = with_position(df, keys, order, **how)
    want = plain_position(df, keys, order)
    cols = [*keys, *order]
    assert got.count() == df.count()
    a = sorted((tuple(map(str, r)) for r in got.select(*cols, "pos").collect()))
    b = sorted((tuple(map(str, r)) for r in want.select(*cols, "pos2").collect()))
    assert a == b


@pytest.mark.parametrize("rows", [37, 1000, 10 ** 6])
def test_positions_equal(spark, ev, rows):
    same_positions(ev, ["channel"], ["ts", "rid"], bucket_rows=rows)


def test_positions_ties_and_text(spark, sf001):
    """lineitem ship dates: ~24 rows per timestamp; ties broken by the tie order; a text column as the order."""
    li = fx.lineitem_wide(spark, sf001)
    same_positions(li, [], fx.LINEITEM_ORDER, bucket_rows=500)
    s = li.select(F.col("l_orderkey").cast("string").alias("k"), "l_linenumber", "l_partkey", "l_suppkey")
    same_positions(s, [], ["k", "l_linenumber", "l_partkey", "l_suppkey"], bucket_rows=300)


def test_positions_single_series(spark, ev):
    a = with_position(ev, [], ["ts", "rid"], bucket_rows=100)
    assert sorted(r["pos"] for r in a.select("pos").collect()) == list(range(ev.count()))


def biggest(df, keys, order, size):
    _, _, table = pieces(df, keys, order, size)
    return table.agg(F.max("_n")).first()[0]


def test_bursty_series(spark):
    """90 % of the rows in 1 % of the time, and a pile on one timestamp (cut by the next column)."""
    t0 = dt.datetime(2024, 1, 1)
    rows = [("c", t0 + dt.timedelta(hours=i), i) for i in range(300)]
    rows += [("c", t0 + dt.timedelta(hours=100, milliseconds=100 * i), 10_000 + i) for i in range(3000)]
    rows += [("c", t0 + dt.timedelta(hours=200), 50_000 + 7 * i) for i in range(2000)] + [("c", None, 90_000 + i) for i in range(900)]
    df = spark.createDataFrame(rows, "channel string, ts timestamp_ntz, rid long")
    assert biggest(df, ["channel"], ["ts", "rid"], 50) <= 4 * 50
    same_positions(df, ["channel"], ["ts", "rid"], bucket_rows=50)


@pytest.mark.parametrize("shape", ["sentinel", "narrow", "log", "special"])
def test_odd_values(spark, shape):
    """One value of 1e30, a span of 1e-9, magnitudes over 600 decades, infinities and NaN."""
    rng = np.random.default_rng(1)
    y = {"sentinel": np.append(rng.normal(0, 1, 4999), 1e30), "narrow": 1.0 + rng.random(5000) * 1e-9,
         "log": 10.0 ** rng.uniform(-300, 300, 5000), "special": np.concatenate([rng.normal(0, 1, 4000), [np.inf] * 500, [-np.inf] * 500])}[shape]
    rows = [("c", float(v), k) for k, v in enumerate(y)]
    if shape == "special":
        rows += [("c", None, 10_000 + k) for k in range(300)] + [("c", float("nan"), 20_000 + k) for k in range(300)]
    df = spark.createDataFrame(rows, "channel string, v double, rid long")
    assert biggest(df, ["channel"], ["v", "rid"], 100) <= 400
    same_positions(df, ["channel"], ["v", "rid"], bucket_rows=100)
    got = exact_percentiles(df, ["channel"], "v", [0.1, 0.5, 0.77], bucket_rows=100).first()
    for p, g in zip((0.1, 0.5, 0.77), got[1:]):
        s = np.sort(y)
        h = (len(s) - 1) * p
        a, b = s[int(h)], s[min(int(h) + 1, len(s) - 1)]
        assert g == pytest.approx(a if a == b else a + (h - int(h)) * (b - a), rel=1e-12, nan_ok=True)


@pytest.mark.parametrize("chunk", [7, 100, 5000])
def test_halo_equals_plain(spark, ev, chunk):
    p = plain_position(ev, ["channel"], ["ts", "rid"]).withColumnRenamed("pos2", "pos")
    x = halo_window(p, ["channel"], "pos", 30, 29, {"m": F.avg("value"), "n": F.count("value")}, chunk=chunk)
    w = Window.partitionBy("channel").orderBy("pos").rowsBetween(-30, 29)
    y = p.select("rid", F.avg("value").over(w).alias("m2"), F.count("value").over(w).alias("n2"))
    assert x.join(y, "rid").where("abs(m - m2) > 1e-9 OR n <> n2").count() == 0 and x.count() == ev.count()


@pytest.mark.parametrize("lo,hi", [(0, 0), (0, 3), (4, 0), (2, 2), (30, 29), (150, 150), (3000, 2999)])
@pytest.mark.parametrize("chunk", [41, 100_000])
def test_rolling_equals_frame(spark, ev, lo, hi, chunk):
    p = plain_position(ev, ["channel"], ["ts", "rid"]).withColumnRenamed("pos2", "pos")
    a = rolling_stats(p, ["channel"], "pos", "value", lo, hi, chunk=chunk)
    w = Window.partitionBy("channel").orderBy("pos").rowsBetween(-lo, hi)
    v = F.col("value")
    b = p.select("channel", "rid", F.count(v).over(w).alias("n"), F.avg(v).over(w).alias("mean"), F.stddev_samp(v).over(w).alias("sd"),
                 F.max(v).over(w).alias("mx"), F.min(v).over(w).alias("mn"))
    bad = a.join(b, ["channel", "rid"]).where(
        "_r_cnt <> n OR abs(coalesce(_r_mean, 0) - coalesce(mean, 0)) > 1e-9 "
        "OR abs(coalesce(_r_sd, -1) - coalesce(sd, -1)) > 1e-9 OR NOT _r_max <=> mx OR NOT _r_min <=> mn")
    assert a.count() == ev.count() and bad.count() == 0


@pytest.mark.parametrize("size", [37, 10 ** 6])
def test_percentiles_equal(spark, ev, size):
    skewed = ev.withColumn("value", F.when(F.col("rid") % 10 != 0, F.col("value") / 1e6).otherwise(F.col("value")))
    steps = ev.withColumn("value", F.round("value"))
    for df in (ev, skewed, steps):
        got = {r["channel"]: tuple(r)[1:] for r in exact_percentiles(
            df, ["channel"], "value", [0.0, 0.1, 0.5, 0.9, 1.0], bucket_rows=size).collect()}
        want = df.where("value IS NOT NULL").groupBy("channel").agg(F.percentile("value", F.array(*map(F.lit, [0.0, 0.1, 0.5, 0.9, 1.0]))))
        for r in want.collect():
            assert got[r[0]] == pytest.approx(tuple(r[1]))
    alone = exact_percentiles(ev, [], "value", [0.5], bucket_rows=size).first()[0]
    assert alone == pytest.approx(ev.agg(F.percentile("value", F.lit(0.5))).first()[0])


def test_gaps_in_small_pieces(spark, sf001, monkeypatch):
    from sensorlake.operators import gaps as gp
    r = wide_readings(spark, sf001)
    b = gp.gap_segments(r).collect()
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 37)
    a = gp.gap_segments(r).collect()
    assert sorted(map(tuple, a)) == sorted(map(tuple, b)) and len(a) > 0


def test_many_recordings_at_once(spark, sf001, tiny_buckets):
    """keys=[dataset_id, channel]: one call equals separate calls per recording."""
    from sensorlake.operators import anomaly as an
    from sensorlake.operators import resample as rs
    from sensorlake.operators import stats as st
    a = fx.events_long(spark, sf001)
    b = fx.orders_series(spark, sf001)
    both = a.withColumn("dataset_id", F.lit("ev")).unionByName(b.withColumn("dataset_id", F.lit("or")))
    k = ["dataset_id", "channel"]

    def rows(df, cols):
        return sorted(tuple(round(x, 9) if isinstance(x, float) else x for x in r) for r in df.select(*cols).collect())

    for ds_id, single in (("ev", a), ("or", b)):
        one = both.where(F.col("dataset_id") == ds_id)
        got = rs.resample(both, "weekly", "mean", keys=k, frame_keys=["dataset_id"]).where(F.col("dataset_id") == ds_id)
        assert rows(got, ["channel", "ts", "value"]) == rows(rs.resample(single, "weekly", "mean"), ["channel", "ts", "value"])
        s1 = st.channel_stats(both, keys=k).where(F.col("dataset_id") == ds_id)
        assert rows(s1, ["channel", "n", "mean", "slope"]) == rows(st.channel_stats(single), ["channel", "n", "mean", "slope"])
        from sensorlake.operators import timewindow as tw
        w1 = tw.apply_window(both, "7d", keys=["dataset_id"]).where(F.col("dataset_id") == ds_id)
        assert rows(w1, ["channel", "rid"]) == rows(tw.apply_window(single, "7d"), ["channel", "rid"])
        f1 = an.rolling_anomalies(both, keys=k).where(F.col("dataset_id") == ds_id)
        f2 = an.rolling_anomalies(one, keys=k)
        assert rows(f1, ["channel", "rid", "pos", "is_anomaly"]) == rows(f2, ["channel", "rid", "pos", "is_anomaly"])


# --------------------------------------------------------------------------- runs, rank selection, brackets
@pytest.mark.parametrize("chunk", [1, 3, 8, 1000])
def test_runs_over_chunks(spark, chunk):
    """Runs that end, begin or go on at borders of chunks, over several chunks, and single positions."""
    rng = np.random.default_rng(chunk)
    places = {"a": np.flatnonzero(rng.random(200) < 0.8), "b": np.arange(64), "c": np.array([0, 2, 3, 7, 8, 9, 24]), "d": np.array([5])}
    rows = [(k, int(p), f"t{p}") for k, ps in places.items() for p in ps]
    got = ranking.position_runs(spark.createDataFrame(rows, "k string, pos long, t string"), ["k"], "pos", first={"s": "t"}, last={"e": "t"},
                                chunk=chunk).select("k", "start_pos", "end_pos", "n", "s", "e").collect()
    want = [(k, int(r[0]), int(r[-1]), len(r), f"t{r[0]}", f"t{r[-1]}") for k, ps in places.items()
            for r in np.split(ps, np.flatnonzero(np.diff(ps) != 1) + 1)]
    assert sorted(map(tuple, got)) == sorted(want)


def test_brackets_that_miss(spark, monkeypatch):
    """Whatever the summary says, the result is exact: brackets that miss their rank are opened, and what is left
    is cut into pieces where it is much."""
    monkeypatch.setattr(ranking, "SUMMARY_ACCURACY", 20)
    rng = np.random.default_rng(2)
    v = {"a": rng.normal(0, 1, 6000), "b": np.repeat([1.0, 2.0, 3.0], 2000), "c": rng.integers(0, 40, 5000).astype(float), "d": np.array([4.0])}
    df = spark.createDataFrame([(k, float(x)) for k, xs in v.items() for x in xs], "channel string, v double")
    probs = [0.0, 0.25, 0.5, 0.9, 1.0]
    for points, size in ((2, 100), (50, 100), (1000, 1500)):
        monkeypatch.setattr(ranking, "SUMMARY_POINTS", points)
        for r in exact_percentiles(df, ["channel"], "v", probs, bucket_rows=size).collect():
            assert tuple(r)[1:] == pytest.approx(tuple(np.quantile(v[r[0]], probs)), rel=1e-12)
    monkeypatch.setattr(ranking, "SUMMARY_ACCURACY", 1000)
    total = F.when(F.col("channel") == "c", 5000).otherwise(6000).cast("long")
    many = df.where("channel <> 'd'").select("channel", F.col("v").alias("_v"), total.alias("_total"))
    kept = ranking._bracketed(many, ["channel"], [0.5], 3)
    assert kept.agg(F.sum("_w")).first()[0] == 17_000 and kept.count() < 2000


def test_stride_sorts_few_rows(spark, sf001, monkeypatch):
    """Rows of pieces that hold no target meet no sort."""
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 50)
    w = fx.lineitem_wide(spark, sf001)
    seen = []
    real = ranking.small_side
    monkeypatch.setattr(ranking, "small_side", lambda df: seen.append(df.count()) or real(df))
    from sensorlake.operators import downsample as ds
    picked = ds.stride_downsample(w, 20, order=fx.LINEITEM_ORDER)
    assert picked.count() == 20 and seen and seen[0] <= 20
    monkeypatch.setattr(ranking, "small_side", real)
    whole = with_position(w, [], fx.LINEITEM_ORDER)
    n = w.count()
    at = [int(k * ((n - 1) / 19)) if k < 19 else n - 1 for k in range(20)]
    key = list(fx.LINEITEM_ORDER)
    assert sorted(map(tuple, picked.select("pos", *key).collect())) == sorted(
        map(tuple, whole.where(F.col("pos").isin(at)).select("pos", *key).collect()))


@pytest.mark.parametrize("n", [1, 2, 3, 5, 4001])
def test_quartiles_of_pieces(spark, monkeypatch, n):
    from sensorlake.operators import corr
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 20)
    df = spark.createDataFrame([(k // 3, k, float(k), float(k * k % 17)) for k in range(n)], "ts long, rid long, x double, y double")
    got = {r.q: (r.n, r.pos_lo, r.pos_hi, r.x_mean, r.ts_first, r.ts_last) for r in corr.time_quartiles(df, "x", "y").collect()}
    ids = [(4 * k + 3) // n for k in range(n)]
    want = {q: [k for k in range(n) if ids[k] == q] for q in set(ids)}
    assert got == {q: (len(k), k[0], k[-1], pytest.approx(np.mean(k)), k[0] // 3, k[-1] // 3) for q, k in want.items()}


@pytest.mark.parametrize("size", [7, 10 ** 6])
def test_median_step_pieces(spark, sf001, size, monkeypatch):
    from sensorlake.operators import stats as st
    monkeypatch.setattr(ranking, "BUCKET_ROWS", size)
    frame = fx.events_long(spark, sf001).select("channel", "ts", "rid")
    times = sorted(r.ts for r in frame.collect())
    want = np.median([(b - a).total_seconds() / 60 for a, b in zip(times, times[1:])])
    assert st.median_step(frame).first()[0] == pytest.approx(want)
    each = {r.channel: r.median_step_min for r in st.median_step(frame, keys=["channel"]).collect()}
    own = sorted(r.ts for r in frame.where("channel = 'view'").collect()) or sorted(
        r.ts for r in frame.where(F.col("channel") == sorted(each)[0]).collect())
    name = "view" if "view" in each else sorted(each)[0]
    assert each[name] == pytest.approx(np.median([(b - a).total_seconds() / 60 for a, b in zip(own, own[1:])]))


def test_lttb_convex(spark):
    """A curve all of whose rows are hull vertices, with blocks of few buckets: walks from every entry."""
    import sys
    sys.path.insert(0, "tests")
    from test_kernels import lttb_ref

    from sensorlake.operators import downsample as ds
    n = 20_000
    y = np.arange(n, dtype=float) ** 2 / 1e4
    df = spark.range(n).select(F.col("id").alias("pos"), (F.col("id").cast("double") * F.col("id") / 1e4).alias("y"))
    for n_out, vertices in ((3, 200_000), (9, 200_000), (60, 1000)):
        ds.BLOCK_VERTICES, before = vertices, ds.BLOCK_VERTICES
        got = [r.pos for r in ds.lttb_positions(df, n_out).orderBy("k").collect()]
        ds.BLOCK_VERTICES = before
        assert got == lttb_ref(y, n_out)


def test_catalog_views(spark):
    """Views are listed, described and dropped by name; the listing is ranked without one task."""
    from sensorlake.sources import catalog as cg
    df = spark.createDataFrame([(1, "a")], "n long, s string")
    cg.register_view(df, "paths_view")
    assert "paths_view" in [r.name for r in cg.list_views(spark).collect()]
    assert [(r.name, r.dtype, r.is_numeric) for r in cg.describe_schema(df).collect()] == [("n", "bigint", True), ("s", "string", False)]
    assert cg.drop_view(spark, "paths_view")
    assert "paths_view" not in [r.name for r in cg.list_views(spark, "paths").collect()]
    cat = spark.createDataFrame([(f"t{k % 40}", f"p{k}", dt.datetime(2024, 1, 1 + k % 9)) for k in range(200)],
                                "table_name string, parquet_path string, ingested_at timestamp_ntz")
    latest = cg.catalog_latest(cat)
    order = [r.table_name for r in latest.orderBy("rank").collect()]
    newest = {}
    for r in cat.collect():
        newest[r.table_name] = max(newest.get(r.table_name, r.ingested_at), r.ingested_at)
    assert order == sorted(newest, key=lambda t: (newest[t], t), reverse=True)


@pytest.mark.parametrize("window,sigma,prefix,growth", [(11, 2.0, 8192, 16), (11, 2.0, 16, 3), (60, 3.0, 100, 2), (7, 1e9, 50, 4),
                                                       (4, 2.0, 64, 4)])
def test_first_anomalies_by_prefix(ev, monkeypatch, tiny_buckets, window, sigma, prefix, growth):
    from sensorlake.operators import anomaly as an
    monkeypatch.setattr(an, "GROWTH", growth)
    want = an.flagged_first(an.rolling_anomalies(ev, window=window, sigma=sigma), 12, readings=ev)
    got = an.first_anomalies(ev, 12, window=window, sigma=sigma, prefix=prefix)
    assert got.columns == want.columns
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


def test_first_anomalies_leave_the_rest_unsorted(spark, monkeypatch):
    """A series that has its flags in the prefix ends there; one with none, or few rows, is read to its end."""
    from sensorlake.operators import anomaly as an
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 100)
    seen = []
    plain = an._flagged
    monkeypatch.setattr(an, "_flagged", lambda p, *a: seen.append({r["channel"]: r["count"] for r in p.groupBy(
        "channel").count().collect()}) or plain(p, *a))
    rows = [(c, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=i), i,
             float(i % 7) if c != "spikes" or i % 20 else 500.0) for c, n in (("spikes", 4000), ("calm", 4000), ("short", 30))
            for i in range(n)]
    df = spark.createDataFrame(rows, "channel string, ts timestamp_ntz, rid long, value double")
    got = an.first_anomalies(df, 12, window=21, sigma=3.0, prefix=300).collect()
    assert sorted((r["channel"], r["rank"], r["rid"]) for r in got) == [("spikes", k + 1, 20 * k) for k in range(12)]
    assert seen[0] == {"spikes": 310, "calm": 310, "short": 30}
    assert seen[1:] == [{"calm": 4000 - 290}]
    assert an.first_anomalies(df.limit(0), 12, window=21, sigma=3.0).collect() == []
