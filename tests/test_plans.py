"""Plan checks: pushdown, pruning, no single-partition exchange on the distributed path."""

import re

from sensorlake import fixtures as fx
from sensorlake.operators import anomaly as an
from sensorlake.operators import project as pj
from sensorlake.operators import timewindow as tw
from sensorlake.plans.ranking import with_position


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_window_filter_pushed(spark, sf001):
    w = tw.apply_window(fx.events_wide(spark, sf001), "7d")
    p = plan(w)
    assert "PushedFilters: [IsNotNull(ts), GreaterThanOrEqual(ts" in p


def test_projection_pruned(spark, sf001):
    w = pj.project_channels(fx.events_wide(spark, sf001), ["LVDT1"])
    p = plan(w)
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,event_type:string,value:double>" in p


def exchanges(df) -> list[str]:
    return [x for x in plan(df).splitlines() if "Exchange" in x]


def test_positions_never_shuffle_by_the_series_alone(spark, sf001):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        p = with_position(fx.events_long(spark, sf001), ["channel"], ["ts", "rid"])
        assert plan(p).count("events.parquet") <= 2
        for x in exchanges(p):
            assert "SinglePartition" not in x
        # only the table of pieces is brought together by series, for its running sum
        by_series = [x for x in exchanges(p) if re.search(r"hashpartitioning\(channel#\d+, \d+\)", x)]
        assert len(by_series) <= 1
        f = an.rolling_anomalies(fx.events_long(spark, sf001))
        assert all("SinglePartition" not in x for x in exchanges(f)) and "_chunk" in plan(f)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_page_reads_few_pieces(spark, sf001, monkeypatch):
    from sensorlake.operators import browse as br
    from sensorlake.plans import ranking
    monkeypatch.setattr(ranking, "BUCKET_ROWS", 100)
    made = []
    monkeypatch.setattr(ranking, "small_side", lambda df: made.append(df.count()) or df)
    rows = br.page_rows(fx.events_wide(spark, sf001), 3).collect()
    assert [r["row_num"] for r in sorted(rows, key=lambda r: r["row_num"])] == list(range(41, 61)) and made[-1] <= 2
