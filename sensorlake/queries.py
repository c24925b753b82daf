"""Registered queries: each takes (spark, sf_dir) and returns a DataFrame over the
test tables (FIXTURES.md). Doubles are rounded to 6 decimals, counts are BIGINT,
so results compare with the DuckDB oracles in ``sensorlake.oracle_queries``."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake import fixtures as fx
from sensorlake.operators import resample as rs
from sensorlake.operators import timewindow as tw

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def register(name: str):
    def deco(fn):
        QUERIES[name] = fn
        return fn
    return deco


def finish(df: DataFrame, digits: int = 6) -> DataFrame:
    """Round doubles; integral counts stay BIGINT."""
    cols = []
    for f in df.schema.fields:
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            cols.append(F.round(F.col(f.name), digits).alias(f.name))
        else:
            cols.append(F.col(f.name))
    return df.select(*cols)


# --------------------------------------------------------------------------- resample
def _resample_query(rule: str, agg: str):
    def q(spark, d):
        r = fx.events_long(spark, d)
        return finish(rs.resample(r, rule, agg))
    return q


for _rule in ("5min", "hourly", "daily", "weekly"):
    for _agg in rs.AGGS:
        register(f"resample_{_rule}_{_agg}")(_resample_query(_rule, _agg))


@register("resample_orders_weekly_mean")
def q_orders_weekly(spark, d):
    return finish(rs.resample(fx.orders_series(spark, d), "weekly", "mean"))


@register("resample_suppliers_weekly")
def q_suppliers_weekly(spark, d):
    """Many recordings at once: every supplier has an origin and a spine of its own."""
    r = fx.supplier_series(spark, d)
    return finish(rs.resample_aggs(r, "weekly", ["mean", "max", "median"], keys=["dataset_id", "channel"], frame_keys=["dataset_id"]))


@register("resample_orders_daily_last")
def q_orders_daily_last(spark, d):
    return finish(rs.resample(fx.orders_series(spark, d), "daily", "last"))


@register("window7d_daily_mean_units")
def q_flagship(spark, d):
    """Flagship: last 7 days of the recording, daily means with empty days, channel units."""
    from sensorlake.functions.families import classify
    r = fx.events_long(spark, d, with_ordinal=True)
    win = tw.apply_window(r, "7d")
    daily = rs.resample(win, "daily", "mean")
    names = r.groupBy("channel").agg(F.min("ordinal").alias("ordinal"))
    chans = classify(names).select("channel", "family", "unit")
    return finish(daily.join(chans, "channel", "left"))          # both sides: one row per channel (×day)


# --------------------------------------------------------------------------- statistics
from sensorlake.operators import channels as ch  # noqa: E402
from sensorlake.operators import project as pj  # noqa: E402
from sensorlake.operators import stats as st  # noqa: E402
from sensorlake.operators import trend as tr  # noqa: E402


def event_channels(spark, d) -> DataFrame:
    return ch.channels_of(fx.events_long(spark, d, with_ordinal=True), ordinal="ordinal")


def wide_readings(spark, d) -> DataFrame:
    """B2 as long readings, missing cells kept."""
    return pj.unpivot(fx.events_wide(spark, d), fx.EVENT_CHANNEL_NAMES)


@register("channel_stats")
def q_channel_stats(spark, d):
    return finish(st.channel_stats(wide_readings(spark, d)))


@register("trend_slope")
def q_trend_slope(spark, d):
    return finish(st.trend_slope(fx.events_long(spark, d)))


@register("coverage")
def q_coverage(spark, d):
    return finish(st.coverage(wide_readings(spark, d)).withColumn("n", F.col("n").cast("long"))
                  .withColumn("n_valid", F.col("n_valid").cast("long")))


@register("channel_card")
def q_channel_card(spark, d):
    return finish(st.channel_card(st.channel_stats(wide_readings(spark, d))))


@register("health_summary")
def q_health(spark, d):
    s = st.channel_stats(wide_readings(spark, d))
    return finish(st.health_summary(s, event_channels(spark, d)).withColumn(
        "n_channels", F.col("n_channels").cast("long")).withColumn("n_families", F.col("n_families").cast("long")))


@register("family_diagnostics")
def q_family_diag(spark, d):
    s = st.channel_stats(wide_readings(spark, d))
    return finish(st.family_diagnostics(s, event_channels(spark, d)))


@register("dataset_kpis")
def q_dataset_kpis(spark, d):
    return finish(st.dataset_kpis(wide_readings(spark, d), event_channels(spark, d), fx.events_wide(spark, d)))


@register("median_step")
def q_median_step(spark, d):
    return finish(st.median_step(fx.events_wide(spark, d)))


@register("family_counts")
def q_family_counts(spark, d):
    return finish(ch.family_counts(event_channels(spark, d)).withColumn("family_rank", F.col("family_rank").cast("long")))


@register("classify")
def q_classify(spark, d):
    c = event_channels(spark, d)
    return c.select("channel", F.col("ordinal").cast("long").alias("ordinal"), "family", "label", "unit",
                    F.col("family_rank").cast("long").alias("family_rank"),
                    F.col("idx_in_family").cast("long").alias("idx_in_family"))


@register("drift_kpis")
def q_drift_kpis(spark, d):
    r = fx.events_long(spark, d)
    o, hi = rs.frame_origin(r)
    nb = rs.micros_between_py(o, hi) // rs.RULES["daily"] + 1
    return finish(st.drift_kpis(st.channel_stats(r), event_channels(spark, d), nb))


@register("trend_line")
def q_trend_line(spark, d):
    return finish(tr.trend_line(fx.events_long(spark, d)))


@register("daily_band")
def q_daily_band(spark, d):
    return finish(rs.daily_band(fx.events_long(spark, d)))


@register("default_channels")
def q_default_channels(spark, d):
    return ch.default_channels(event_channels(spark, d)).select(
        F.col("pick").cast("long").alias("pick"), "channel", "family", F.col("ordinal").cast("long").alias("ordinal"))


@register("selection_kpis")
def q_selection_kpis(spark, d):
    picked = [r["channel"] for r in ch.default_channels(event_channels(spark, d)).orderBy("pick").collect()]
    return finish(rs.selection_kpis(pj.project_channels(fx.events_wide(spark, d), picked), picked, "daily"))


# --------------------------------------------------------------------------- anomalies
from sensorlake.operators import anomaly as an  # noqa: E402
from sensorlake.operators import downsample as ds  # noqa: E402
from sensorlake.operators import gaps as gp  # noqa: E402

def _flags(spark, d, window=60, sigma=3.0, wide=False):
    r = wide_readings(spark, d) if wide else fx.events_long(spark, d)
    return an.rolling_anomalies(r, window=window, sigma=sigma)


def _flag_cols(df):
    return df.select("channel", "ts", "rid", "value", "pos", "is_anomaly")


register("anomaly_flags")(lambda spark, d: finish(_flag_cols(_flags(spark, d))))
register("anomaly_flags_w11_s2")(lambda spark, d: finish(_flag_cols(_flags(spark, d, 11, 2.0))))
register("anomaly_flags_w97")(lambda spark, d: finish(_flag_cols(_flags(spark, d, 97, 2.0))))
register("anomaly_flags_w1441")(lambda spark, d: finish(_flag_cols(_flags(spark, d, 1441, 2.0))))
register("anomaly_flags_w6_s1_5")(lambda spark, d: finish(_flag_cols(_flags(spark, d, 6, 1.5))))
register("anomaly_flags_wide_w61_s2_5")(lambda spark, d: finish(_flag_cols(_flags(spark, d, 61, 2.5, wide=True))))


@register("anomaly_summary")
def q_anomaly_summary(spark, d):
    return finish(an.anomaly_summary(_flags(spark, d)).withColumn("n_flagged", F.col("n_flagged").cast("long")))


@register("worst_excursion")
def q_worst(spark, d):
    return finish(an.worst_excursion(_flags(spark, d)))


@register("flagged_first12")
def q_first12(spark, d):
    return finish(an.first_anomalies(fx.events_long(spark, d), 12, window=11, sigma=2.0))


@register("anomaly_overlay")
def q_overlay(spark, d):
    return finish(an.anomaly_overlay(_flags(spark, d), ds.BUDGET_ANOMALY, readings=fx.events_long(spark, d)))


# --------------------------------------------------------------------------- gaps
def _gaps(spark, d):
    return gp.gap_segments(wide_readings(spark, d))


def _gap_diag(spark, d):
    return gp.gap_diagnostics(wide_readings(spark, d), _gaps(spark, d), event_channels(spark, d))


register("gap_segments")(lambda spark, d: finish(_gaps(spark, d)))
register("gap_diagnostics")(lambda spark, d: finish(_gap_diag(spark, d).withColumn("ordinal", F.col("ordinal").cast("long"))))
register("quality_kpis")(lambda spark, d: finish(gp.quality_kpis(_gap_diag(spark, d))))
register("gap_offenders")(lambda spark, d: finish(gp.gap_offenders(_gap_diag(spark, d))))
register("gap_timeline")(lambda spark, d: finish(gp.gap_timeline(_gaps(spark, d), fx.events_wide(spark, d))[0]))
register("gap_ticks")(lambda spark, d: finish(gp.gap_timeline(_gaps(spark, d), fx.events_wide(spark, d))[1]))


# --------------------------------------------------------------------------- down-sampling
@register("stride_downsample")
def q_stride(spark, d):
    s = ds.stride_downsample(fx.lineitem_wide(spark, d), ds.BUDGET_OVERVIEW, order=fx.LINEITEM_ORDER)
    return finish(s.select("k", "pos", *fx.LINEITEM_ORDER, *fx.LINEITEM_CHANNELS))


@register("stride_scatter_pairs")
def q_stride_scatter(spark, d):
    """Scatter budget over the pairwise-complete rows of the masked pair."""
    w = pj.pairwise_complete(fx.lineitem_masked(spark, d), "l_quantity", "l_extendedprice")
    s = ds.stride_downsample(w, ds.BUDGET_SCATTER, order=fx.LINEITEM_ORDER)
    return finish(s.select("k", "pos", *fx.LINEITEM_ORDER, "l_quantity", "l_extendedprice"))


@register("envelope")
def q_envelope(spark, d):
    return finish(ds.envelope(fx.events_wide(spark, d), fx.EVENT_CHANNEL_NAMES).select("ts", "rid", "envelope"))


# --------------------------------------------------------------------------- correlation (A12–A16), distributions
from sensorlake.operators import corr as cr  # noqa: E402
from sensorlake.operators import dist as di  # noqa: E402

PAIR = ("l_quantity", "l_extendedprice")


@register("corr_matrix")
def q_corr(spark, d):
    return finish(cr.corr_matrix(fx.lineitem_wide(spark, d), fx.LINEITEM_CHANNELS)
                  .withColumn("x_ord", F.col("x_ord").cast("long")).withColumn("y_ord", F.col("y_ord").cast("long")))


@register("corr_matrix_masked")
def q_corr_masked(spark, d):
    return finish(cr.corr_matrix(fx.lineitem_masked(spark, d), fx.LINEITEM_CHANNELS)
                  .withColumn("x_ord", F.col("x_ord").cast("long")).withColumn("y_ord", F.col("y_ord").cast("long")))


@register("corr_matrix_events")
def q_corr_events(spark, d):
    """Channels that never share a row: every off-diagonal pair is undefined -> 0."""
    return finish(cr.corr_matrix(fx.events_wide(spark, d), fx.EVENT_CHANNEL_NAMES)
                  .withColumn("x_ord", F.col("x_ord").cast("long")).withColumn("y_ord", F.col("y_ord").cast("long")))


@register("corr_matrix_wide")
def q_corr_wide(spark, d):
    """The many-channel form (per-partition cross-products) on the masked table."""
    return finish(cr.corr_matrix_wide(fx.lineitem_masked(spark, d), fx.LINEITEM_CHANNELS)
                  .withColumn("x_ord", F.col("x_ord").cast("long")).withColumn("y_ord", F.col("y_ord").cast("long")))


@register("corr_kpis")
def q_corr_kpis(spark, d):
    return finish(cr.corr_kpis(cr.corr_matrix(fx.lineitem_masked(spark, d), fx.LINEITEM_CHANNELS)))


@register("pair_fit")
def q_pair_fit(spark, d):
    return finish(cr.pair_fit(fx.lineitem_masked(spark, d), *PAIR))


@register("pair_fit_strided")
def q_pair_fit_strided(spark, d):
    w = fx.lineitem_masked(spark, d)
    sample = ds.stride_downsample(pj.pairwise_complete(w, *PAIR), ds.BUDGET_SCATTER, order=fx.LINEITEM_ORDER)
    return finish(cr.pair_fit(w, *PAIR, sample=sample))


@register("time_quartiles")
def q_time_quartiles(spark, d):
    return finish(cr.time_quartiles(fx.lineitem_masked(spark, d), *PAIR, order=fx.LINEITEM_ORDER))


def lineitem_readings(spark, d):
    return pj.unpivot(fx.lineitem_wide(spark, d), fx.LINEITEM_CHANNELS, index=fx.LINEITEM_ORDER)


@register("histogram_40")
def q_hist(spark, d):
    return finish(di.histogram(lineitem_readings(spark, d)))


@register("histogram_40_events")
def q_hist_events(spark, d):
    return finish(di.histogram(wide_readings(spark, d)))


@register("box_summary")
def q_box(spark, d):
    return finish(di.box_summary(lineitem_readings(spark, d)))


@register("box_summary_events")
def q_box_events(spark, d):
    return finish(di.box_summary(wide_readings(spark, d)))


# --------------------------------------------------------------------------- load events
from sensorlake.operators import events as evo  # noqa: E402


def _records(spark, d):
    return evo.positions(fx.load_records(spark, d))


register("event_window")(lambda spark, d: finish(evo.event_window(_records(spark, d))))
register("event_window_run")(lambda spark, d: finish(
    evo.event_window(_records(spark, d), threshold_pct=0.3, contiguous_run=2)))
register("zero_crossing")(lambda spark, d: finish(evo.zero_crossing(evo.with_velocity(_records(spark, d)))))


# --------------------------------------------------------------------------- windows, projections, browsing
from sensorlake.operators import browse as br  # noqa: E402

CUSTOM_FROM, CUSTOM_TO = "2024-01-10", "2024-01-12"


def _wide_out(df):
    return finish(df)


for _p in ("24h", "7d", "30d"):
    register(f"window_{_p}")((lambda p: lambda spark, d: _wide_out(tw.apply_window(fx.events_wide(spark, d), p)))(_p))


@register("window_custom")
def q_window_custom(spark, d):
    f, t = tw.custom_range(CUSTOM_FROM, CUSTOM_TO)
    return _wide_out(tw.apply_window(fx.events_wide(spark, d), "custom", f, t))


@register("window_bounds_7d")
def q_window_bounds(spark, d):
    return tw.bounds_frame(fx.events_long(spark, d), "7d")


@register("window_share_7d")
def q_window_share(spark, d):
    return finish(tw.window_share(fx.events_wide(spark, d), "7d"))


@register("window_share_custom")
def q_window_share_custom(spark, d):
    f, t = tw.custom_range(CUSTOM_FROM, CUSTOM_TO)
    return finish(tw.window_share(fx.events_wide(spark, d), "custom", f, t))


@register("project_channels")
def q_project(spark, d):
    return finish(pj.project_channels(fx.events_wide(spark, d), ["LVDT1", "VWP1"]))


@register("unpivot")
def q_unpivot(spark, d):
    return finish(wide_readings(spark, d))


@register("days_axis")
def q_days_axis(spark, d):
    return finish(pj.days_axis(fx.events_wide(spark, d)).select("ts", "rid", "days"))


@register("scale_unit")
def q_scale_unit(spark, d):
    """Displacement channels shown in µm: factor 1000 where the unit is mm."""
    r = fx.events_long(spark, d)
    c = event_channels(spark, d).select("channel", F.when(F.col("unit") == "mm", 1000.0).otherwise(1.0).alias("factor"))
    return finish(pj.scale_unit(r.join(c, "channel"), "factor").drop("factor"))


@register("axis_route")
def q_axis_route(spark, d):
    c = event_channels(spark, d)
    picked = [r["channel"] for r in ch.default_channels(c).orderBy("pick").collect()]
    return ch.axis_route(c, picked).withColumn("pick", F.col("pick").cast("long"))


@register("row_search")
def q_row_search(spark, d):
    ev = fx.table(spark, d, "events")
    return finish(br.row_search(ev, "CLICK 7"))


@register("row_search_literal")
def q_row_search_literal(spark, d):
    ev = fx.table(spark, d, "events")
    return finish(br.row_search(ev, '"k": 1', regex=False))


@register("sort_ts")
def q_sort_ts(spark, d):
    return finish(br.sort_ts(fx.events_wide(spark, d)))


@register("head_n")
def q_head(spark, d):
    return finish(br.head_n(fx.events_wide(spark, d), 100))


@register("page_rows")
def q_page(spark, d):
    return finish(br.page_rows(fx.events_wide(spark, d), 3))


@register("page_rows_last")
def q_page_last(spark, d):
    """A page past the end is clamped to the last page."""
    return finish(br.page_rows(fx.events_wide(spark, d), 10 ** 9))


@register("page_rows_search")
def q_page_search(spark, d):
    ev = fx.table(spark, d, "events")
    hits = br.row_search(ev, "view").withColumnRenamed("event_id", "rid")
    return finish(br.page_rows(hits, 2))


# --------------------------------------------------------------------------- sources, sinks, catalog
import uuid  # noqa: E402

from sensorlake.functions.numeric import coerce_numeric  # noqa: E402
from sensorlake.functions.timefns import parse_ts  # noqa: E402
from sensorlake.session import ensure_checkpoint_dir  # noqa: E402
from sensorlake.sources import catalog as cg  # noqa: E402
from sensorlake.sources import files as fl  # noqa: E402

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages "
          "benchmark labels conversations").split()


def scratch(spark, tag: str) -> str:
    """A fresh folder under the session's shared checkpoint folder."""
    return f"{ensure_checkpoint_dir(spark).rstrip('/')}/sensorlake-scratch/{tag}-{uuid.uuid4().hex}"


def _wide_typed(df):
    return finish(df.select("ts", F.col("rid").cast("long").alias("rid"),
                            *[F.col(c).cast("double").alias(c) for c in fx.EVENT_CHANNEL_NAMES]))


@register("scan_parquet")
def q_scan(spark, d):
    return finish(fl.scan_parquet(spark, f"{d}/events.parquet"))


@register("coerce_numeric")
def q_coerce(spark, d):
    ev = fx.table(spark, d, "events")
    return finish(ev.select("event_id", coerce_numeric("props").alias("props_num"),
                            coerce_numeric(F.regexp_extract("props", r"[0-9]+", 0)).alias("digits_num"),
                            coerce_numeric(F.col("value").cast("string")).alias("value_num")))


@register("parse_ts")
def q_parse_ts(spark, d):
    ev = fx.table(spark, d, "events")
    return ev.select("event_id", parse_ts(F.col("ts").cast("string")).alias("ts_parsed"),
                     parse_ts("props").alias("junk_parsed"))


@register("load_readings")
def q_load(spark, d):
    w = fx.events_wide(spark, d)
    text = w.select(*[F.col(c).cast("string").alias(c) for c in w.columns])
    frame, _kind = fl.load_readings(text, "ts")
    return _wide_typed(frame)


@register("roundtrip_parquet")
def q_roundtrip(spark, d):
    dest = fl.write_parquet(fx.events_wide(spark, d), scratch(spark, "parquet"))
    return finish(fl.scan_parquet(spark, dest))


@register("ingest_csv")
def q_ingest_csv(spark, d):
    """Files whose header has a blank and a repeated name and the time in the second place."""
    frame, _kind = fl.load_readings(fl.read_delimited(spark, _csv_source(spark, d) + "/*.csv"))
    return finish(frame.select("ts", "rid", *[c for c in frame.columns if c not in ("ts", "rid")]))


def _csv_source(spark, d, folder: str = "csv") -> str:
    """The wide events in time order, no row numbers: times as dd/MM/yyyy text."""
    w = fx.events_wide(spark, d).orderBy("ts", "rid")
    rows = w.select("LVDT1", F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS").alias("timestamp"), (F.col("rid") * 2).alias(" "),
                    "Tilt4", "Thermocouple1", "Strain_A", F.col("VWP1").alias("LVDT1 "))
    return fl.export_csv(rows, scratch(spark, "src") + f"/{folder}")


@register("ingest_file")
def q_ingest_file_query(spark, d):
    data, row = cg.ingest_file(spark, _csv_source(spark, d, "events wide 2024.csv"), scratch(spark, "ingest"))
    return row.select("table_name", "source_filename", "row_count", F.col("column_count").cast("long").alias("column_count"),
                      F.array_join(F.transform("columns", lambda c: c["name"]), ",").alias("column_names"))


@register("ingest_rolling")
def q_ingest_rolling(spark, d):
    """Ingest -> readings -> rolling flags, ordered by the typed time and the source order."""
    data, _row = cg.ingest_file(spark, _csv_source(spark, d, "wide.csv"), scratch(spark, "ingest"))
    r = pj.unpivot(data, ["LVDT1", "Tilt4", "Thermocouple1", "Strain_A", "LVDT1_1"])
    return finish(_flag_cols(an.rolling_anomalies(r, window=61, sigma=2.5)))


@register("load_readings_day_first")
def q_load_day_first(spark, d):
    w = fx.events_wide(spark, d)
    text = w.select(F.date_format("ts", "dd/MM/yyyy HH:mm:ss.SSSSSS").alias("time"),
                    *[F.col(c).cast("string").alias(c) for c in w.columns if c != "ts"])
    frame, _kind = fl.load_readings(text, "time")
    return _wide_typed(frame)


@register("trend_slope_numeric")
def q_trend_numeric(spark, d):
    """A numeric time index: lineitem over its order key."""
    return finish(st.trend_slope(_numeric_readings(spark, d), order=["ts", *fx.LINEITEM_ORDER[2:]]))


@register("window_resample_numeric")
def q_window_numeric(spark, d):
    """Windows and resampling leave a numeric time index as it is."""
    r = tw.apply_window(_numeric_readings(spark, d), "7d")
    return finish(rs.resample(r, "daily", "mean").groupBy("channel").agg(
        F.count(F.lit(1)).alias("n"), F.min("ts").alias("lo"), F.max("ts").alias("hi"), F.avg("value").alias("mean")))


def _numeric_readings(spark, d):
    w = fx.lineitem_wide(spark, d).withColumn("ts", F.col("l_orderkey").cast("double"))
    return pj.unpivot(w, fx.LINEITEM_CHANNELS, index=["ts", *fx.LINEITEM_ORDER[2:]])


@register("catalog_changes")
def q_catalog_changes(spark, d):
    """Entries of missing files skipped, one entry added, the names of purchases removed."""
    cat = _catalog_from_events(spark, d)
    there = cat.where("source_filename <> 'error.csv'").select("parquet_path")
    new = cat.orderBy("parquet_path").limit(1).withColumn("table_name", F.lit("added"))
    gone = cat.where("source_filename = 'purchase.csv'").select("table_name").distinct()
    return cg.catalog_latest(cg.remove_entry(cg.add_entry(cat, new), gone), there)


@register("row_count")
def q_row_count(spark, d):
    parts = [cg.row_count(fx.table(spark, d, t)).select(F.lit(t).alias("table_name"), "row_count") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@register("custom_sql")
def q_custom_sql(spark, d):
    cg.register_view(fx.events_long(spark, d), "sensorlake_readings")
    return cg.custom_sql(spark, "SELECT channel, count(*) AS n, round(avg(value), 6) AS mean "
                                "FROM sensorlake_readings GROUP BY channel")


@register("dataset_name")
def q_dataset_name(spark, d):
    return fx.table(spark, d, "pages").select("page_id", cg.dataset_name("url").alias("table_name"))


def _catalog_from_events(spark, d):
    ev = fx.table(spark, d, "events")
    return ev.select(cg.dataset_name("props").alias("table_name"),
                     F.concat(F.col("event_type"), F.lit(".csv")).alias("source_filename"),
                     F.concat(F.lit("/data/"), F.col("event_id").cast("string"), F.lit(".parquet")).alias("parquet_path"),
                     F.col("ts").alias("ingested_at"))


@register("catalog_latest")
def q_catalog_latest(spark, d):
    return cg.catalog_latest(_catalog_from_events(spark, d))


# --------------------------------------------------------------------------- LTTB (D3, D4) — rows-only check + numpy test
from sensorlake.plans.ranking import materialize, with_position  # noqa: E402


@register("lttb_downsample")
def q_lttb(spark, d):
    """Joint LTTB of the four lineitem channels: envelope max|y| over channels,
    1,500 points (the per-series budget), same rows for every channel."""
    w = ds.envelope(fx.lineitem_wide(spark, d), fx.LINEITEM_CHANNELS)
    p = materialize(with_position(w, [], fx.LINEITEM_ORDER))   # read by two stages
    picked = ds.lttb_positions(p, ds.BUDGET_BROWSER, y="envelope")
    return finish(p.join(picked, "pos").select("k", "pos", *fx.LINEITEM_ORDER, *fx.LINEITEM_CHANNELS, "envelope"))
