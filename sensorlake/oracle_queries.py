"""DuckDB oracle SQL for every registered query with a SQL form."""

from __future__ import annotations

from sensorlake import oracle as o
from sensorlake.operators.resample import AGGS, RULES

SQL: dict[str, str] = {}

DUCK_AGG = {
    "mean": "avg(value)",
    "min": "min(value)",
    "max": "max(value)",
    "std": "stddev_samp(value)",
    "median": "quantile_cont(value, 0.5)",
    "first": "arg_min(value, (ts, rid))",
    "last": "arg_max(value, (ts, rid))",
}


def resample_sql(src: str, width: int, aggs: dict[str, str], extra_cols: str = "", rnd: bool = True) -> str:
    """Spine of every channel × bin from the first day's midnight, left-joined to aggregates."""
    sel = ", ".join((f"round(a.{k}, 6) AS {k}" if rnd else f"a.{k} AS {k}") for k in aggs)
    agg = ", ".join(f"{v} AS {k}" for k, v in aggs.items())
    return o.with_ctes(
        f"""SELECT s.channel, o.origin + to_microseconds(s.bin * {width}) AS ts, {sel}{extra_cols}
            FROM s CROSS JOIN o LEFT JOIN a ON a.channel = s.channel AND a.bin = s.bin""",
        r=src,
        o="SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS origin, max(ts) AS hi FROM r",
        v=f"SELECT r.*, date_diff('microsecond', o.origin, r.ts) // {width} AS bin FROM r CROSS JOIN o "
          f"WHERE r.value IS NOT NULL",
        a=f"SELECT channel, bin, {agg} FROM v GROUP BY channel, bin",
        s=f"SELECT c.channel, b.bin FROM (SELECT DISTINCT channel FROM r) c CROSS JOIN "
          f"(SELECT unnest(range(0, date_diff('microsecond', origin, hi) // {width} + 1)) AS bin FROM o) b",
    )


for _rule in ("5min", "hourly", "daily", "weekly"):
    for _agg in AGGS:
        SQL[f"resample_{_rule}_{_agg}"] = resample_sql(o.EVENTS_LONG, RULES[_rule], {"value": DUCK_AGG[_agg]})

SQL["resample_orders_weekly_mean"] = resample_sql(o.ORDERS_SERIES, RULES["weekly"], {"value": DUCK_AGG["mean"]})
SQL["resample_orders_daily_last"] = resample_sql(o.ORDERS_SERIES, RULES["daily"], {"value": DUCK_AGG["last"]})

SQL["resample_suppliers_weekly"] = o.with_ctes(
    """SELECT s.dataset_id, 'l_quantity' AS channel, s.origin + to_microseconds(s.bin * 604800000000) AS ts,
              round(a.mean, 6) AS mean, round(a.max, 6) AS max, round(a.median, 6) AS median
       FROM s LEFT JOIN a ON a.dataset_id = s.dataset_id AND a.bin = s.bin""",
    r="SELECT l_suppkey AS dataset_id, CAST(l_shipdate AS TIMESTAMP) AS ts, CAST(l_quantity AS DOUBLE) AS value FROM lineitem",
    o="SELECT dataset_id, CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS origin, max(ts) AS hi FROM r GROUP BY dataset_id",
    a="SELECT r.dataset_id, date_diff('microsecond', origin, ts) // 604800000000 AS bin, avg(value) AS mean, max(value) AS max, "
      "median(value) AS median FROM r JOIN o USING (dataset_id) WHERE value IS NOT NULL GROUP BY 1, 2",
    s="SELECT dataset_id, origin, unnest(range(0, date_diff('microsecond', origin, hi) // 604800000000 + 1)) AS bin FROM o",
)

SQL["window7d_daily_mean_units"] = o.with_ctes(
    """SELECT d.channel, d.ts, d.value, c.family, c.unit FROM d LEFT JOIN c USING (channel)""",
    src=o.EVENTS_LONG,
    b="SELECT greatest(min(ts), max(ts) - INTERVAL 7 DAY) AS lo, max(ts) AS hi FROM src",
    win="SELECT src.* FROM src CROSS JOIN b WHERE src.ts >= b.lo AND src.ts <= b.hi",
    d="SELECT * FROM (" + resample_sql("SELECT * FROM win", RULES["daily"], {"value": DUCK_AGG["mean"]}) + ")",
    c=o.EVENT_CHANNELS_DIM,
)


# --------------------------------------------------------------------------- statistics
X_DAYS = "date_diff('microsecond', TIMESTAMP '1970-01-01 00:00:00', ts) / 86400000000.0"
STATS_RAW = f"""SELECT channel, count(*) AS n, count(value) AS n_valid, min(value) AS min, max(value) AS max,
    avg(value) AS mean, stddev_samp(value) AS std,
    arg_min(value, (ts, rid)) FILTER (WHERE value IS NOT NULL) AS first,
    arg_max(value, (ts, rid)) FILTER (WHERE value IS NOT NULL) AS last,
    covar_pop(value, x) AS cxy, var_pop(x) FILTER (WHERE value IS NOT NULL) AS vx
  FROM (SELECT *, {X_DAYS} AS x FROM r) GROUP BY channel"""
STATS = f"""SELECT channel, n, n_valid, min, max, mean, std, first, last,
    CASE WHEN n > 0 THEN 1.0 - n_valid / n END AS nan_frac, last - first AS drift, max - min AS range,
    greatest(max - mean, mean - min) AS peak_dev,
    coalesce(CASE WHEN vx <> 0 THEN cxy / vx END, 0.0) AS slope, n_valid / n AS coverage
  FROM ({STATS_RAW})"""
WIDE_LONG_CTES = dict(ew=o.EVENTS_WIDE, r=o.EVENTS_WIDE_LONG)


def r6(cols: str) -> str:
    return ", ".join(f"round({c.strip()}, 6) AS {c.strip()}" for c in cols.split(","))


SQL["channel_stats"] = o.with_ctes(
    f"SELECT channel, n, n_valid, {r6('min, max, mean, std, first, last, nan_frac, drift, range, peak_dev, slope, coverage')} FROM s",
    **WIDE_LONG_CTES, s=STATS)
SQL["trend_slope"] = o.with_ctes(
    f"""SELECT channel, round(coalesce(CASE WHEN vx <> 0 THEN cxy / vx END, 0.0), 6) AS slope, n_valid
        FROM ({STATS_RAW})""", r=o.EVENTS_LONG)
SQL["coverage"] = o.with_ctes(
    "SELECT channel, count(*) AS n, count(value) AS n_valid, round(count(value) / count(*), 6) AS coverage "
    "FROM r GROUP BY channel", **WIDE_LONG_CTES)
SQL["channel_card"] = o.with_ctes(
    f"SELECT channel, {r6('min, max, mean, std, drift, slope, coverage')} FROM s", **WIDE_LONG_CTES, s=STATS)
SQL["health_summary"] = o.with_ctes(
    f"""SELECT count(*) AS n_channels, count(DISTINCT family) AS n_families,
        round(avg(cov) * 100.0, 6) AS avg_coverage_pct,
        arg_max(channel, (absd, -ordinal)) AS most_drifted, round(max(absd), 6) AS most_drifted_abs,
        arg_max(channel, (sd, -ordinal)) AS most_volatile, round(max(sd), 6) AS most_volatile_std,
        arg_min(channel, (cov, ordinal)) AS lowest_coverage, round(min(cov), 6) AS lowest_coverage_frac,
        CASE WHEN avg(cov) * 100.0 >= 95 THEN 'pos' WHEN avg(cov) * 100.0 >= 85 THEN 'warn' ELSE 'neg' END
          AS coverage_signal
      FROM (SELECT s.channel, c.ordinal, c.family, coalesce(abs(s.drift), 0.0) AS absd, coalesce(s.std, 0.0) AS sd,
                   1.0 - coalesce(s.nan_frac, 1.0) AS cov FROM s JOIN c USING (channel))""",
    **WIDE_LONG_CTES, s=STATS, c=o.EVENT_CHANNELS_DIM)
SQL["family_diagnostics"] = o.with_ctes(
    f"""SELECT family, channel, unit, {r6('min, max, drift, slope, nan_frac')}, rank, rank = 1 AS is_hero
      FROM (SELECT c.family, s.channel, c.unit, s.min, s.max, s.drift, s.slope, s.nan_frac,
              row_number() OVER (PARTITION BY c.family ORDER BY abs(s.drift) DESC NULLS LAST, c.ordinal) AS rank
            FROM s JOIN c USING (channel))""",
    **WIDE_LONG_CTES, s=STATS, c=o.EVENT_CHANNELS_DIM)
MEDIAN_STEP = """SELECT quantile_cont(step_us, 0.5) / 60000000.0 AS median_step_min FROM (
    SELECT date_diff('microsecond', lag(ts) OVER (ORDER BY ts, rid), ts) AS step_us FROM ew) WHERE step_us IS NOT NULL"""
SQL["median_step"] = o.with_ctes("SELECT round(median_step_min, 6) AS median_step_min FROM m",
                                 ew=o.EVENTS_WIDE, m=MEDIAN_STEP)
SQL["dataset_kpis"] = o.with_ctes(
    """SELECT round(CASE WHEN n_rows >= 2 THEN date_diff('microsecond', t0, t1) / 86400000000.0 ELSE 0.0 END, 6)
          AS span_days, round(median_step_min, 6) AS median_step_min, n_rows, n_channels, n_families,
        round(nan, 6) AS nan_frac, round((1.0 - nan) * 100.0, 6) AS coverage_pct,
        CASE WHEN (1.0 - nan) * 100.0 >= 95 THEN 'pos' WHEN (1.0 - nan) * 100.0 >= 85 THEN 'warn' ELSE 'neg' END
          AS coverage_signal
      FROM (SELECT min(ts) AS t0, max(ts) AS t1, count(*) AS n_rows FROM ew)
      CROSS JOIN (SELECT CASE WHEN count(*) > 0 THEN 1.0 - count(value) / count(*) ELSE 0.0 END AS nan FROM r)
      CROSS JOIN (SELECT count(*) AS n_channels, count(DISTINCT family) AS n_families FROM c)
      CROSS JOIN m""",
    **WIDE_LONG_CTES, c=o.EVENT_CHANNELS_DIM, m=MEDIAN_STEP)
SQL["family_counts"] = o.with_ctes(
    "SELECT family, label, family_rank, count(*) AS n_channels FROM c GROUP BY family, label, family_rank",
    c=o.EVENT_CHANNELS_DIM)
SQL["classify"] = o.with_ctes(
    "SELECT channel, ordinal, family, label, unit, family_rank, idx_in_family FROM c", c=o.EVENT_CHANNELS_DIM)
SQL["drift_kpis"] = o.with_ctes(
    """SELECT CASE WHEN nb >= 2 THEN CAST(nb - 1 AS DOUBLE) ELSE 0.0 END AS period_days, nb AS n_daily_rows,
        st.channel AS steepest_channel, round(st.slope, 6) AS steepest_slope,
        CASE WHEN abs(st.slope) >= 0.05 THEN 'neg' WHEN abs(st.slope) >= 0.005 THEN 'warn' ELSE 'pos' END
          AS slope_signal,
        bd.channel AS biggest_drift_channel, round(bd.drift, 6) AS biggest_drift
      FROM (SELECT arg_max({'channel': channel, 'slope': slope}, (abs(slope), -ordinal)) AS st,
                   arg_max({'channel': channel, 'drift': d2}, (abs(d2), -ordinal)) AS bd
            FROM (SELECT s.*, c.ordinal, CASE WHEN n_valid >= 2 THEN drift ELSE 0.0 END AS d2
                  FROM s JOIN c USING (channel)))
      CROSS JOIN (SELECT date_diff('microsecond', CAST(date_trunc('day', min(ts)) AS TIMESTAMP), max(ts))
                         // 86400000000 + 1 AS nb FROM r)""",
    r=o.EVENTS_LONG, s=STATS, c=o.EVENT_CHANNELS_DIM)
SQL["daily_band"] = resample_sql(o.EVENTS_LONG, RULES["daily"],
                                 {"mean": DUCK_AGG["mean"], "min": DUCK_AGG["min"], "max": DUCK_AGG["max"]})
SQL["trend_line"] = o.with_ctes(
    """SELECT d.channel, d.ts, round(d.x, 6) AS x, round(d.value, 6) AS mean, round(p.slope * d.x + p.intercept, 6) AS trend,
        round(p.slope, 6) AS slope, round(p.intercept, 6) AS intercept, p.slope_rank
      FROM d JOIN p USING (channel)""",
    r=o.EVENTS_LONG,
    d0="SELECT * FROM (" + resample_sql("SELECT * FROM r", RULES["daily"], {"value": DUCK_AGG["mean"]}, rnd=False) + ")",
    d="SELECT d0.*, date_diff('microsecond', (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) FROM r), ts)"
      " / 86400000000.0 AS x FROM d0",
    sl=f"SELECT channel, coalesce(CASE WHEN vx <> 0 THEN cxy / vx END, 0.0) AS slope FROM ({STATS_RAW})",
    p0="SELECT d.channel, sl.slope, avg(d.value) - sl.slope * avg(d.x) AS intercept FROM d JOIN sl USING (channel) "
       "GROUP BY d.channel, sl.slope",
    p="SELECT *, row_number() OVER (ORDER BY abs(slope) DESC, channel) AS slope_rank FROM p0",
)
DEFAULT_CH = """SELECT row_number() OVER (ORDER BY ordinal) AS pick, channel, family, ordinal FROM (
    SELECT family, arg_min(channel, ordinal) AS channel, min(ordinal) AS ordinal FROM c GROUP BY family)
  QUALIFY pick <= 4"""
SQL["default_channels"] = o.with_ctes("SELECT pick, channel, family, CAST(ordinal AS BIGINT) AS ordinal FROM dc",
                                      c=o.EVENT_CHANNELS_DIM, dc=DEFAULT_CH)
SQL["selection_kpis"] = o.with_ctes(
    """SELECT (SELECT count(*) FROM dc) AS n_channels, 'daily' AS rule,
        date_diff('microsecond', p0, hi) // 86400000000 + 1 AS n_rows, p0 AS period_start,
        p0 + to_microseconds((date_diff('microsecond', p0, hi) // 86400000000) * 86400000000) AS period_end
      FROM (SELECT CAST(date_trunc('day', min(ts)) AS TIMESTAMP) AS p0, max(ts) AS hi FROM ew)""",
    ew=o.EVENTS_WIDE, c=o.EVENT_CHANNELS_DIM, dc=DEFAULT_CH)


# --------------------------------------------------------------------------- anomalies
def flags_sql(src: str, window: int, sigma: float, **ctes) -> dict:
    lo, hi = window // 2, (window - 1) // 2
    minp = max(5, window // 4)
    return dict(
        **ctes,
        r=src,
        p="SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts, rid) - 1 AS pos FROM r",
        f=f"""SELECT *, count(value) OVER w AS cnt, avg(value) OVER w AS mu, stddev_samp(value) OVER w AS sd,
                 max(value) OVER w AS mx, min(value) OVER w AS mn FROM p
              WINDOW w AS (PARTITION BY channel ORDER BY pos ROWS BETWEEN {lo} PRECEDING AND {hi} FOLLOWING)""",
        fl=f"""SELECT channel, ts, rid, value, pos, coalesce(value IS NOT NULL AND cnt >= {minp} AND sd IS NOT NULL
                 AND mx - mn > 0 AND abs(value - mu) > {float(sigma)} * sd, false) AS is_anomaly FROM f""",
    )


FLAG_OUT = "SELECT channel, ts, rid, round(value, 6) AS value, pos, is_anomaly FROM fl"
SQL["anomaly_flags"] = o.with_ctes(FLAG_OUT, **flags_sql(o.EVENTS_LONG, 60, 3.0))
SQL["anomaly_flags_w11_s2"] = o.with_ctes(FLAG_OUT, **flags_sql(o.EVENTS_LONG, 11, 2.0))
SQL["anomaly_flags_w97"] = o.with_ctes(FLAG_OUT, **flags_sql(o.EVENTS_LONG, 97, 2.0))
SQL["anomaly_flags_w1441"] = o.with_ctes(FLAG_OUT, **flags_sql(o.EVENTS_LONG, 1441, 2.0))
SQL["anomaly_flags_w6_s1_5"] = o.with_ctes(FLAG_OUT, **flags_sql(o.EVENTS_LONG, 6, 1.5))
SQL["anomaly_flags_wide_w61_s2_5"] = o.with_ctes(FLAG_OUT, **flags_sql("SELECT * FROM wl", 61, 2.5, ew=o.EVENTS_WIDE,
                                                                       wl=o.EVENTS_WIDE_LONG.replace("FROM ew", "FROM ew")))
SQL["anomaly_summary"] = o.with_ctes(
    """SELECT channel, n_valid, n_flagged, round(rate, 6) AS rate,
        CASE WHEN rate >= 0.05 THEN 'neg' WHEN rate >= 0.01 THEN 'warn' ELSE 'pos' END AS signal
      FROM (SELECT channel, count(value) AS n_valid, count(*) FILTER (WHERE is_anomaly) AS n_flagged,
                   count(*) FILTER (WHERE is_anomaly) / greatest(count(value), 1) AS rate FROM fl GROUP BY channel)""",
    **flags_sql(o.EVENTS_LONG, 60, 3.0))
SQL["worst_excursion"] = o.with_ctes(
    """SELECT channel, w.ts AS worst_ts, w.rid AS worst_rid, round(w.value, 6) AS worst_value,
        round(coalesce(w.deviation, 0.0), 6) AS deviation
      FROM (SELECT fl.channel, arg_max({'ts': ts, 'rid': rid, 'value': value, 'deviation': value - mu.mu},
                                       (abs(value - mu.mu), -pos)) FILTER (WHERE is_anomaly) AS w
            FROM fl JOIN mu USING (channel) GROUP BY fl.channel)""",
    **flags_sql(o.EVENTS_LONG, 60, 3.0), mu="SELECT channel, avg(value) AS mu FROM fl GROUP BY channel")
SQL["flagged_first12"] = o.with_ctes(
    """SELECT channel, rank, ts, rid, round(value, 6) AS value, round(value - mu, 6) AS deviation FROM (
        SELECT fl.*, mu.mu, row_number() OVER (PARTITION BY fl.channel ORDER BY pos) AS rank
        FROM fl JOIN mu USING (channel) WHERE is_anomaly) WHERE rank <= 12""",
    **flags_sql(o.EVENTS_LONG, 11, 2.0), mu="SELECT channel, avg(value) AS mu FROM fl GROUP BY channel")


def stride_targets_sql(count_rel: str, n: int, keys: str = "") -> str:
    """k and target pos per series; count_rel has columns keys..., N."""
    kc = f"{keys}, " if keys else ""
    return f"""SELECT {kc}k, CAST(CASE WHEN N <= {n} THEN k WHEN k = {n - 1} THEN N - 1
                 ELSE floor(CAST(k AS DOUBLE) * (CAST(N - 1 AS DOUBLE) / {float(max(n - 1, 1))})) END AS BIGINT) AS pos
               FROM (SELECT {kc}N, unnest(range(0, least(N, {n}))) AS k FROM ({count_rel}))"""


SQL["anomaly_overlay"] = o.with_ctes(
    """SELECT channel, pos, ts, rid, round(value, 6) AS value, 'series' AS role FROM fl JOIN t USING (channel, pos)
       UNION ALL SELECT channel, pos, ts, rid, round(value, 6) AS value, 'anomaly' AS role FROM fl WHERE is_anomaly""",
    **flags_sql(o.EVENTS_LONG, 60, 3.0),
    t=stride_targets_sql("SELECT channel, count(*) AS N FROM fl GROUP BY channel", 2000, "channel"))

# --------------------------------------------------------------------------- gaps
GAP_CTES = dict(
    **WIDE_LONG_CTES,
    p="SELECT *, row_number() OVER (PARTITION BY channel ORDER BY ts, rid) - 1 AS pos FROM r",
    m="SELECT *, pos - (row_number() OVER (PARTITION BY channel ORDER BY pos) - 1) AS isl FROM p WHERE value IS NULL",
    g0="""SELECT channel, min(pos) AS start_pos, max(pos) AS end_pos, count(*) AS n, arg_min(ts, pos) AS start_ts,
             arg_max(ts, pos) AS end_ts FROM m GROUP BY channel, isl HAVING count(*) >= 3""",
    g="SELECT *, date_diff('microsecond', start_ts, end_ts) AS dur_us FROM g0",
    c=o.EVENT_CHANNELS_DIM,
    dg="""SELECT cv.channel, CAST(c.ordinal AS BIGINT) AS ordinal, c.unit, cv.coverage,
             coalesce(gl.L.n, 0) AS longest_n, gl.L.start_ts AS longest_at, coalesce(gl.L.dur_us, 0) AS longest_dur_us,
             coalesce(gl.n_episodes, 0) AS n_episodes
          FROM (SELECT channel, count(value) / count(*) AS coverage FROM r GROUP BY channel) cv
          JOIN c USING (channel)
          LEFT JOIN (SELECT channel, count(*) AS n_episodes,
                            arg_max({'n': n, 'start_ts': start_ts, 'dur_us': dur_us}, (n, -start_pos)) AS L
                     FROM g GROUP BY channel) gl USING (channel)""",
)
SQL["gap_segments"] = o.with_ctes("SELECT * FROM g", **GAP_CTES)
SQL["gap_diagnostics"] = o.with_ctes(
    "SELECT channel, ordinal, unit, round(coverage, 6) AS coverage, longest_n, longest_at, longest_dur_us, n_episodes "
    "FROM dg", **GAP_CTES)
SQL["quality_kpis"] = o.with_ctes(
    """SELECT round(avg(coverage) * 100.0, 6) AS avg_coverage_pct,
        CASE WHEN avg(coverage) * 100.0 >= 95 THEN 'pos' WHEN avg(coverage) * 100.0 >= 85 THEN 'warn' ELSE 'neg' END
          AS coverage_signal,
        arg_min(channel, (coverage, ordinal)) AS lowest_coverage_channel, round(min(coverage), 6) AS lowest_coverage,
        CASE WHEN min(coverage) < 0.85 THEN 'neg' WHEN min(coverage) < 0.95 THEN 'warn' END AS lowest_signal,
        arg_max(channel, (longest_n, -ordinal)) AS longest_gap_channel, max(longest_n) AS longest_gap_n,
        arg_max(longest_dur_us, (longest_n, -ordinal)) AS longest_gap_dur_us,
        CAST(sum(n_episodes) AS BIGINT) AS total_episodes,
        arg_max(channel, (n_episodes, -ordinal)) AS most_episodes_channel, max(n_episodes) AS most_episodes
      FROM dg""", **GAP_CTES)
SQL["gap_offenders"] = o.with_ctes(
    """SELECT rank, channel, longest_n, longest_dur_us, n_episodes, round(coverage, 6) AS coverage, n_with_gaps FROM (
        SELECT *, row_number() OVER (ORDER BY longest_n DESC, ordinal) AS rank,
               count(*) FILTER (WHERE n_episodes > 0) OVER () AS n_with_gaps FROM dg) WHERE rank <= 5""", **GAP_CTES)
SQL["gap_timeline"] = o.with_ctes(
    """SELECT channel, start_pos, round(x0, 6) AS left_pct, round(greatest(0.2, x1 - x0), 6) AS width_pct FROM (
        SELECT g.channel, g.start_pos, date_diff('microsecond', b.t0, g.start_ts) / b.span * 100.0 AS x0,
               date_diff('microsecond', b.t0, g.end_ts) / b.span * 100.0 AS x1
        FROM g CROSS JOIN (SELECT min(ts) AS t0, date_diff('microsecond', min(ts), max(ts)) AS span FROM ew) b
        WHERE b.span > 0)""", **GAP_CTES)
SQL["gap_ticks"] = o.with_ctes(
    """SELECT i AS tick, t0 + to_microseconds(CAST(floor(span * i / 4) AS BIGINT)) AS ts
       FROM (SELECT min(ts) AS t0, date_diff('microsecond', min(ts), max(ts)) AS span FROM ew) b,
            (SELECT unnest(range(0, 5)) AS i) WHERE span > 0""", ew=o.EVENTS_WIDE)

# --------------------------------------------------------------------------- down-sampling
LI_ORDER = "ts, l_orderkey, l_linenumber, l_partkey, l_suppkey"
SQL["stride_downsample"] = o.with_ctes(
    f"""SELECT t.k, p.pos, {LI_ORDER}, {r6('l_quantity, l_extendedprice, l_discount, l_tax')}
        FROM p JOIN t USING (pos)""",
    lw=o.LINEITEM_WIDE, p=f"SELECT *, row_number() OVER (ORDER BY {LI_ORDER}) - 1 AS pos FROM lw",
    t=stride_targets_sql("SELECT count(*) AS N FROM lw", 2000))
SQL["stride_scatter_pairs"] = o.with_ctes(
    f"""SELECT t.k, p.pos, {LI_ORDER}, {r6('l_quantity, l_extendedprice')} FROM p JOIN t USING (pos)""",
    lw=o.LINEITEM_WIDE, lm=o.LINEITEM_MASKED,
    pc="SELECT * FROM lm WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL",
    p=f"SELECT *, row_number() OVER (ORDER BY {LI_ORDER}) - 1 AS pos FROM pc",
    t=stride_targets_sql("SELECT count(*) AS N FROM pc", 5000))
SQL["envelope"] = o.with_ctes(
    "SELECT ts, rid, round(greatest(" + ", ".join(f"abs(coalesce({b}, 0.0))" for _a, b in o.EVENT_CHANNELS)
    + "), 6) AS envelope FROM ew", ew=o.EVENTS_WIDE)


# --------------------------------------------------------------------------- correlation
def corr_sql(rel: str, chans: list[str]) -> str:
    aggs, cells = [], []
    for i, a in enumerate(chans):
        for j in range(i, len(chans)):
            b = chans[j]
            xa = a if i == j else f"CASE WHEN {b} IS NOT NULL THEN {a} END"
            xb = b if i == j else f"CASE WHEN {a} IS NOT NULL THEN {b} END"
            t = f"p{i}_{j}"
            aggs.append(f"covar_samp({xa}, {xb}) AS {t}_c, stddev_samp({xa}) AS {t}_sa, "
                        f"stddev_samp({xb}) AS {t}_sb, count({xa}) AS {t}_n")
            r = (f"least(1.0, greatest(-1.0, coalesce(CASE WHEN {t}_sa * {t}_sb <> 0 THEN {t}_c / ({t}_sa * {t}_sb) END,"
                 f" 0.0)))")
            cells.append(f"SELECT '{a}' AS x, '{b}' AS y, {i} AS x_ord, {j} AS y_ord, {r} AS r, {t}_n AS n FROM g")
            if i != j:
                cells.append(f"SELECT '{b}' AS x, '{a}' AS y, {j} AS x_ord, {i} AS y_ord, {r} AS r, {t}_n AS n FROM g")
    return f"WITH g AS (SELECT {', '.join(aggs)} FROM ({rel}))\n" + " UNION ALL ".join(cells)


LI = list(o.LINEITEM_CHANNELS)
EV = [b for _a, b in o.EVENT_CHANNELS]
CORR_OUT = "SELECT x, y, CAST(x_ord AS BIGINT) AS x_ord, CAST(y_ord AS BIGINT) AS y_ord, round(r, 6) AS r, n FROM cm"
SQL["corr_matrix"] = o.with_ctes(CORR_OUT, lw=o.LINEITEM_WIDE, cm=corr_sql("SELECT * FROM lw", LI))
SQL["corr_matrix_masked"] = o.with_ctes(CORR_OUT, lw=o.LINEITEM_WIDE, lm=o.LINEITEM_MASKED,
                                        cm=corr_sql("SELECT * FROM lm", LI))
SQL["corr_matrix_wide"] = SQL["corr_matrix_masked"]
SQL["corr_matrix_events"] = o.with_ctes(CORR_OUT, ew=o.EVENTS_WIDE, cm=corr_sql("SELECT * FROM ew", EV))
SQL["corr_kpis"] = o.with_ctes(
    """SELECT count(*) AS n_pairs, count(*) FILTER (WHERE abs(r) >= 0.7) AS n_strong,
        arg_max(x, (r, -x_ord, -y_ord)) FILTER (WHERE r > 0) AS top_pos_x,
        arg_max(y, (r, -x_ord, -y_ord)) FILTER (WHERE r > 0) AS top_pos_y,
        round(coalesce(max(r) FILTER (WHERE r > 0), 0.0), 6) AS top_pos_r,
        arg_min(x, (r, x_ord, y_ord)) FILTER (WHERE r < 0) AS top_neg_x,
        arg_min(y, (r, x_ord, y_ord)) FILTER (WHERE r < 0) AS top_neg_y,
        round(coalesce(min(r) FILTER (WHERE r < 0), 0.0), 6) AS top_neg_r,
        round(avg(abs(r)), 6) AS mean_abs_r
      FROM cm WHERE x_ord < y_ord""",
    lw=o.LINEITEM_WIDE, lm=o.LINEITEM_MASKED, cm=corr_sql("SELECT * FROM lm", LI))
FIT_COLS = ("slope, intercept, r, r2, x_mean, y_mean, x_min, x_max, y_min, y_max, fit_y_at_x_min, fit_y_at_x_max")


def fit_sql(full: str, fit_rel: str) -> str:
    return f"""SELECT 'l_quantity' AS x, 'l_extendedprice' AS y, {r6(FIT_COLS)}, n, n_fit FROM (
        SELECT *, r * r AS r2, slope * x_min + intercept AS fit_y_at_x_min, slope * x_max + intercept AS fit_y_at_x_max
        FROM (SELECT *, y_mean - slope * x_mean AS intercept FROM (
            SELECT CASE WHEN var_pop(l_quantity) <> 0 THEN covar_pop(l_extendedprice, l_quantity) / var_pop(l_quantity)
                   END AS slope,
                   avg(l_quantity) AS x_mean, avg(l_extendedprice) AS y_mean, min(l_quantity) AS x_min,
                   max(l_quantity) AS x_max, min(l_extendedprice) AS y_min, max(l_extendedprice) AS y_max,
                   count(*) AS n_fit FROM ({fit_rel}))
          CROSS JOIN (SELECT least(1.0, greatest(-1.0, coalesce(CASE WHEN stddev_samp(l_quantity) * stddev_samp(l_extendedprice)
                         <> 0 THEN covar_samp(l_quantity, l_extendedprice) / (stddev_samp(l_quantity)
                         * stddev_samp(l_extendedprice)) END, 0.0))) AS r, count(*) AS n FROM ({full}))))"""


PC = "SELECT * FROM lm WHERE l_quantity IS NOT NULL AND l_extendedprice IS NOT NULL"
SQL["pair_fit"] = o.with_ctes(fit_sql(PC, PC), lw=o.LINEITEM_WIDE, lm=o.LINEITEM_MASKED)
SQL["pair_fit_strided"] = o.with_ctes(
    fit_sql(PC, "SELECT p.* FROM p JOIN t USING (pos)"), lw=o.LINEITEM_WIDE, lm=o.LINEITEM_MASKED,
    pc=PC, p=f"SELECT *, row_number() OVER (ORDER BY {LI_ORDER}) - 1 AS pos FROM pc",
    t=stride_targets_sql("SELECT count(*) AS N FROM pc", 5000))
SQL["time_quartiles"] = o.with_ctes(
    """SELECT q, count(*) AS n, min(pos) AS pos_lo, max(pos) AS pos_hi, round(avg(l_quantity), 6) AS x_mean,
         round(avg(l_extendedprice), 6) AS y_mean, min(ts) AS ts_first, max(ts) AS ts_last
       FROM (SELECT *, (4 * pos + 3) // (SELECT count(*) FROM pc) AS q FROM p) GROUP BY q""",
    lw=o.LINEITEM_WIDE, lm=o.LINEITEM_MASKED, pc=PC,
    p=f"SELECT *, row_number() OVER (ORDER BY {LI_ORDER}) - 1 AS pos FROM pc")

# --------------------------------------------------------------------------- distributions
LI_LONG = " UNION ALL ".join(f"SELECT ts, '{c}' AS channel, {c} AS value FROM lw" for c in LI)


def hist_sql(long_rel: str, bins: int = 40) -> str:
    edge = lambda k: f"CASE WHEN {k} >= {bins} THEN hi ELSE CAST({k} AS DOUBLE) * step + lo END"
    return f"""WITH v AS (SELECT channel, value FROM ({long_rel}) WHERE value IS NOT NULL),
      rg0 AS (SELECT channel, min(value) AS lo0, max(value) AS hi0 FROM v GROUP BY channel HAVING count(value) >= 2),
      rg AS (SELECT channel, CASE WHEN lo0 = hi0 THEN lo0 - 0.5 ELSE lo0 END AS lo,
                    CASE WHEN lo0 = hi0 THEN hi0 + 0.5 ELSE hi0 END AS hi FROM rg0),
      rs AS (SELECT *, (hi - lo) / {float(bins)} AS step FROM rg),
      b0 AS (SELECT v.value AS x, rs.*, CAST(floor((v.value - lo) / (hi - lo) * {float(bins)}) AS BIGINT) AS i0
             FROM v JOIN rs USING (channel)),
      b1 AS (SELECT *, CASE WHEN i0 = {bins} THEN {bins - 1} ELSE i0 END AS i1 FROM b0),
      b2 AS (SELECT *, CASE WHEN x < {edge('i1')} THEN i1 - 1 ELSE i1 END AS i2 FROM b1),
      b3 AS (SELECT *, CASE WHEN x >= {edge('i2 + 1')} AND i2 <> {bins - 1} THEN i2 + 1 ELSE i2 END AS bin FROM b2),
      cnt AS (SELECT channel, bin, count(*) AS count FROM b3 GROUP BY channel, bin),
      sp AS (SELECT rs.*, unnest(range(0, {bins})) AS bin FROM rs)
    SELECT sp.channel, sp.bin, round(({edge('sp.bin')} + {edge('sp.bin + 1')}) / 2.0, 6) AS center,
           coalesce(cnt.count, 0) AS count
    FROM sp LEFT JOIN cnt ON sp.channel = cnt.channel AND sp.bin = cnt.bin"""


SQL["histogram_40"] = o.with_ctes("SELECT * FROM h", lw=o.LINEITEM_WIDE, h=hist_sql(LI_LONG))
SQL["histogram_40_events"] = o.with_ctes("SELECT * FROM h", **WIDE_LONG_CTES, h=hist_sql("SELECT * FROM r"))
BOX = """SELECT channel, round(min(value), 6) AS min, round(quantile_cont(value, 0.25), 6) AS q1,
    round(quantile_cont(value, 0.5), 6) AS median, round(quantile_cont(value, 0.75), 6) AS q3,
    round(max(value), 6) AS max FROM lr GROUP BY channel"""
SQL["box_summary"] = o.with_ctes(BOX, lw=o.LINEITEM_WIDE, lr=LI_LONG)
SQL["box_summary_events"] = o.with_ctes(BOX, **WIDE_LONG_CTES, lr="SELECT * FROM r")


# --------------------------------------------------------------------------- load events
REC_CTES = dict(
    lr=o.LOAD_RECORDS,
    p="SELECT *, row_number() OVER (PARTITION BY record_id ORDER BY ts, rid) - 1 AS pos FROM lr",
    pk="""SELECT record_id, count(*) AS n, max(abs(load)) AS peak, arg_max(pos, (abs(load), -pos)) AS peak_pos
          FROM p GROUP BY record_id""",
)


def event_window_sql(pct: float, bpct: float, minbuf: int, run: int) -> str:
    ctes = dict(REC_CTES)
    ctes["q"] = f"SELECT p.*, pk.n, pk.peak, pk.peak_pos, abs(load) > pk.peak * {float(pct)} AS above FROM p JOIN pk USING (record_id)"
    ctes["g"] = """SELECT record_id, any_value(n) AS n, any_value(peak) AS peak, any_value(peak_pos) AS peak_pos,
        count(*) FILTER (WHERE above) AS n_above, min(pos) FILTER (WHERE above) AS first_above,
        max(pos) FILTER (WHERE above) AS last_above FROM q GROUP BY record_id"""
    if run > 0:
        ctes["b"] = ("SELECT *, pos - (row_number() OVER (PARTITION BY record_id ORDER BY pos) - 1) AS k "
                     "FROM q WHERE NOT above")
        ctes["isl"] = (f"SELECT record_id, min(pos) AS i_start, max(pos) AS i_end, any_value(peak_pos) AS peak_pos "
                       f"FROM b GROUP BY record_id, k HAVING count(*) >= {run}")
        ctes["e"] = """SELECT record_id, min(i_start) FILTER (WHERE i_start > peak_pos) AS e_end,
                         max(i_end) FILTER (WHERE i_end < peak_pos) AS e_start FROM isl GROUP BY record_id"""
        ctes["w"] = ("SELECT g.*, coalesce(e.e_start, 0) AS lo, coalesce(e.e_end, n - 1) AS hi "
                     "FROM g LEFT JOIN e USING (record_id)")
    else:
        ctes["w"] = "SELECT g.*, first_above AS lo, last_above AS hi FROM g"
    return o.with_ctes(
        f"""SELECT record_id, n, peak_pos,
              CASE WHEN peak <= 0 OR n_above < 5 THEN 0 ELSE greatest(0, lo - buf) END AS start,
              CASE WHEN peak <= 0 OR n_above < 5 THEN n ELSE least(n, hi + buf) END AS "end"
            FROM (SELECT *, greatest({minbuf}, CAST(floor(CAST(hi - lo AS DOUBLE) * {float(bpct)}) AS BIGINT)) AS buf
                  FROM w)""", **ctes)


SQL["event_window"] = event_window_sql(0.05, 0.15, 10, 0)
SQL["event_window_run"] = event_window_sql(0.3, 0.15, 10, 2)
SQL["zero_crossing"] = o.with_ctes(
    """SELECT record_id, n, peak_pos, CASE WHEN n < 3 OR peak_pos >= n - 1 THEN NULL
         ELSE coalesce(cr, am) END AS unload_pos
       FROM (SELECT record_id, any_value(n) AS n, any_value(peak_pos) AS peak_pos,
                    min(pos) FILTER (WHERE pos + 1 < n AND sign(velocity) <> sign(nxt)) AS cr,
                    arg_min(pos, (abs(velocity), pos)) AS am
             FROM (SELECT v.*, pk.n, pk.peak_pos FROM v JOIN pk USING (record_id)) WHERE pos >= peak_pos
             GROUP BY record_id)""",
    **REC_CTES,
    v0="""SELECT *, CASE WHEN pos = 0 THEN 0.0 ELSE load - lag(load) OVER (PARTITION BY record_id ORDER BY pos) END
             AS velocity FROM p""",
    v="SELECT *, lead(velocity) OVER (PARTITION BY record_id ORDER BY pos) AS nxt FROM v0")


# --------------------------------------------------------------------------- windows, projections, browsing
EW_COLS = "ts, rid, " + ", ".join(f"round({b}, 6) AS {b}" for _a, b in o.EVENT_CHANNELS)


def window_sql(interval: str) -> str:
    return o.with_ctes(f"SELECT {EW_COLS} FROM ew CROSS JOIN b WHERE ew.ts >= b.lo AND ew.ts <= b.hi",
                       ew=o.EVENTS_WIDE,
                       b=f"SELECT greatest(min(ts), max(ts) - INTERVAL {interval}) AS lo, max(ts) AS hi FROM ew")


SQL["window_24h"] = window_sql("24 HOUR")
SQL["window_7d"] = window_sql("7 DAY")
SQL["window_30d"] = window_sql("30 DAY")
SQL["window_custom"] = o.with_ctes(
    f"SELECT {EW_COLS} FROM ew WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' AND ts <= TIMESTAMP '2024-01-12 23:59:59'",
    ew=o.EVENTS_WIDE)
SQL["window_bounds_7d"] = o.with_ctes(
    "SELECT greatest(min(ts), max(ts) - INTERVAL 7 DAY) AS lo, max(ts) AS hi FROM r", r=o.EVENTS_LONG)
SQL["window_share_7d"] = o.with_ctes(
    """SELECT count(*) FILTER (WHERE ts >= b.lo AND ts <= b.hi) AS n_in_window, count(*) AS n_total,
        round(count(*) FILTER (WHERE ts >= b.lo AND ts <= b.hi) * 100.0 / greatest(count(*), 1), 6) AS share_pct,
        'Last 7d' AS label, any_value(b.lo) AS lo, any_value(b.hi) AS hi
      FROM ew CROSS JOIN b""",
    ew=o.EVENTS_WIDE, b="SELECT greatest(min(ts), max(ts) - INTERVAL 7 DAY) AS lo, max(ts) AS hi FROM ew")
SQL["window_share_custom"] = o.with_ctes(
    """SELECT count(*) FILTER (WHERE ts >= lo AND ts <= hi) AS n_in_window, count(*) AS n_total,
        round(count(*) FILTER (WHERE ts >= lo AND ts <= hi) * 100.0 / greatest(count(*), 1), 6) AS share_pct,
        '2024-01-10 00:00 → 2024-01-12 23:59' AS label, any_value(lo) AS lo, any_value(hi) AS hi
      FROM ew CROSS JOIN (SELECT TIMESTAMP '2024-01-10 00:00:00' AS lo, TIMESTAMP '2024-01-12 23:59:59' AS hi)""",
    ew=o.EVENTS_WIDE)
SQL["project_channels"] = o.with_ctes("SELECT ts, rid, round(LVDT1, 6) AS LVDT1, round(VWP1, 6) AS VWP1 FROM ew",
                                      ew=o.EVENTS_WIDE)
SQL["unpivot"] = o.with_ctes("SELECT ts, rid, channel, round(value, 6) AS value FROM r", **WIDE_LONG_CTES)
SQL["days_axis"] = o.with_ctes(
    "SELECT ts, rid, round(date_diff('microsecond', (SELECT min(ts) FROM ew), ts) / 86400000000.0, 6) AS days FROM ew",
    ew=o.EVENTS_WIDE)
SQL["scale_unit"] = o.with_ctes(
    "SELECT r.channel, r.ts, r.rid, round(r.value * CASE WHEN c.unit = 'mm' THEN 1000.0 ELSE 1.0 END, 6) AS value "
    "FROM r JOIN c USING (channel)", r=o.EVENTS_LONG, c=o.EVENT_CHANNELS_DIM)
SQL["axis_route"] = o.with_ctes(
    """SELECT pick, channel, unit, axis, y_left, coalesce(y_right, '') AS y_right, n_left, n_right FROM (
        SELECT *, arg_min(CASE WHEN axis = 'right' THEN unit END, CASE WHEN axis = 'right' THEN pick END) OVER () AS y_right,
               count(*) FILTER (WHERE axis = 'left') OVER () AS n_left,
               count(*) FILTER (WHERE axis = 'right') OVER () AS n_right
        FROM (SELECT *, CASE WHEN unit = y_left THEN 'left' ELSE 'right' END AS axis FROM (
              SELECT dc.pick - 1 AS pick, c.channel, c.unit, arg_min(c.unit, dc.pick) OVER () AS y_left
              FROM dc JOIN c USING (channel))))""",
    c=o.EVENT_CHANNELS_DIM, dc=DEFAULT_CH)
EV_OUT = "event_id, ts, user_id, event_type, round(value, 6) AS value, props"
EVENT_COLUMNS = ("event_id", "ts", "user_id", "event_type", "value", "props")
SQL["row_search"] = (f"SELECT {EV_OUT} FROM events WHERE "
                     + " AND ".join("(" + " OR ".join(
                         f"regexp_matches(coalesce(CAST({c} AS VARCHAR), 'nan'), '{n}', 'i')"
                         for c in EVENT_COLUMNS) + ")" for n in ("CLICK", "7")))
SQL["row_search_literal"] = (f"SELECT {EV_OUT} FROM events WHERE "
                             + " AND ".join("(" + " OR ".join(
                                 f"contains(lower(coalesce(CAST({c} AS VARCHAR), 'nan')), '{n}')" for c in EVENT_COLUMNS)
                                 + ")" for n in ('"k":', "1")))
SQL["sort_ts"] = o.with_ctes(f"SELECT {EW_COLS} FROM ew ORDER BY ts, rid", ew=o.EVENTS_WIDE)
SQL["head_n"] = o.with_ctes(f"SELECT {EW_COLS} FROM ew ORDER BY ts, rid LIMIT 100", ew=o.EVENTS_WIDE)


def page_sql(rel: str, page: int, cols: str, size: int = 20) -> str:
    return o.with_ctes(
        f"""SELECT pos + 1 AS row_num, pg AS page, pages AS total_pages, total AS total_rows, {cols}
            FROM (SELECT *, row_number() OVER (ORDER BY ts, rid) - 1 AS pos FROM src) CROSS JOIN m
            WHERE pos >= (pg - 1) * {size} AND pos < least(pg * {size}, total)""",
        src=rel,
        m0=f"SELECT count(*) AS total, greatest(1, CAST(ceil(count(*) / {float(size)}) AS BIGINT)) AS pages FROM src",
        m=f"SELECT total, pages, greatest(1, least({page}, pages)) AS pg FROM m0")


SQL["page_rows"] = page_sql(o.EVENTS_WIDE, 3, EW_COLS)
SQL["page_rows_last"] = page_sql(o.EVENTS_WIDE, 10 ** 9, EW_COLS)
SQL["page_rows_search"] = page_sql(
    "SELECT event_id AS rid, ts, user_id, event_type, value, props FROM events "
    "WHERE " + " OR ".join(f"regexp_matches(coalesce(CAST({c} AS VARCHAR), 'nan'), 'view', 'i')" for c in EVENT_COLUMNS), 2,
    "rid, ts, user_id, event_type, round(value, 6) AS value, props")


# --------------------------------------------------------------------------- sources, sinks, catalog
from sensorlake.functions.numeric import NUMBER_PATTERN  # noqa: E402


def coerce_sql(x: str) -> str:
    return f"CASE WHEN regexp_matches(trim({x}), '{NUMBER_PATTERN}') THEN TRY_CAST(trim({x}) AS DOUBLE) END"


SQL["scan_parquet"] = "SELECT event_id, ts, user_id, event_type, round(value, 6) AS value, props FROM events"
SQL["coerce_numeric"] = (f"SELECT event_id, round({coerce_sql('props')}, 6) AS props_num, "
                         f"round({coerce_sql(chr(39) + chr(39) + ' || regexp_extract(props, ' + chr(39) + '[0-9]+' + chr(39) + ')')}, 6) AS digits_num, "
                         f"round({coerce_sql('CAST(value AS VARCHAR)')}, 6) AS value_num FROM events")
SQL["parse_ts"] = ("SELECT event_id, TRY_CAST(CAST(ts AS VARCHAR) AS TIMESTAMP) AS ts_parsed, "
                   "TRY_CAST(props AS TIMESTAMP) AS junk_parsed FROM events")
SQL["load_readings"] = o.with_ctes(f"SELECT {EW_COLS} FROM ew", ew=o.EVENTS_WIDE)
SQL["roundtrip_parquet"] = SQL["load_readings"]
SQL["load_readings_day_first"] = SQL["load_readings"]
CSV_ROWS = """SELECT ts, row_number() OVER (ORDER BY ts, rid) - 1 AS rid, LVDT1, rid * 2.0 AS col_2, Tilt4, Thermocouple1,
    Strain_A, VWP1 AS LVDT1_1 FROM ew"""
SQL["ingest_csv"] = o.with_ctes(
    "SELECT ts, rid, round(LVDT1, 6) AS LVDT1, CAST(col_2 AS DOUBLE) AS col_2, round(Tilt4, 6) AS Tilt4, "
    "round(Thermocouple1, 6) AS Thermocouple1, round(Strain_A, 6) AS Strain_A, round(LVDT1_1, 6) AS LVDT1_1 FROM cr",
    ew=o.EVENTS_WIDE, cr=CSV_ROWS)
SQL["ingest_rolling"] = o.with_ctes(FLAG_OUT, **flags_sql(
    "SELECT * FROM il", 61, 2.5, ew=o.EVENTS_WIDE, cr=CSV_ROWS, il=" UNION ALL ".join(
        f"SELECT '{c}' AS channel, ts, rid, {c} AS value FROM cr" for c in ("LVDT1", "Tilt4", "Thermocouple1", "Strain_A", "LVDT1_1"))))
NUMERIC_LONG = " UNION ALL ".join(
    f"SELECT '{c}' AS channel, CAST(l_orderkey AS DOUBLE) AS ts, l_linenumber, l_partkey, l_suppkey, {c} AS value FROM lw" for c in ("l_quantity", "l_extendedprice", "l_discount", "l_tax"))
SQL["trend_slope_numeric"] = o.with_ctes(
    "SELECT channel, round(coalesce(regr_slope(value, x), 0.0), 6) AS slope, count(value) AS n_valid FROM (SELECT *, "
    "row_number() OVER (PARTITION BY channel ORDER BY ts, l_linenumber, l_partkey, l_suppkey) - 1 AS x FROM nl "
    "WHERE value IS NOT NULL) GROUP BY channel",
    lw=o.LINEITEM_WIDE, nl=NUMERIC_LONG)
SQL["window_resample_numeric"] = o.with_ctes(
    "SELECT channel, count(*) AS n, min(ts) AS lo, max(ts) AS hi, round(avg(value), 6) AS mean FROM nl GROUP BY channel",
    lw=o.LINEITEM_WIDE, nl=NUMERIC_LONG)
SQL["ingest_file"] = ("SELECT 'events_wide_2024' AS table_name, 'events wide 2024.csv' AS source_filename, "
                      "count(*) AS row_count, CAST(9 AS BIGINT) AS column_count, "
                      "'ts,LVDT1,col_2,Tilt4,Thermocouple1,Strain_A,LVDT1_1,rid,day' AS column_names FROM events")
SQL["row_count"] = " UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split())
SQL["custom_sql"] = o.with_ctes("SELECT channel, count(*) AS n, round(avg(value), 6) AS mean FROM r GROUP BY channel",
                                r=o.EVENTS_LONG)


def dataset_name_sql(x: str) -> str:
    s = f"regexp_replace({x}, '[^A-Za-z0-9_]+', '_', 'g')"
    s = f"regexp_replace({s}, '_+', '_', 'g')"
    s = f"regexp_replace({s}, '^_+|_+$', '', 'g')"
    s = f"(CASE WHEN length({s}) = 0 THEN 'table' ELSE {s} END)"
    s = f"(CASE WHEN regexp_matches({s}, '^[0-9]') THEN '_' || {s} ELSE {s} END)"
    return f"lower({s})"


SQL["dataset_name"] = f"SELECT page_id, {dataset_name_sql('url')} AS table_name FROM pages"
SQL["catalog_latest"] = o.with_ctes(
    """SELECT table_name, source_filename, parquet_path, ingested_at, rank, rank = 1 AS is_active FROM (
        SELECT *, row_number() OVER (ORDER BY ingested_at DESC, table_name DESC) AS rank FROM (
          SELECT table_name, arg_max(source_filename, (ingested_at, parquet_path)) AS source_filename,
                 arg_max(parquet_path, (ingested_at, parquet_path)) AS parquet_path, max(ingested_at) AS ingested_at
          FROM cat GROUP BY table_name))""",
    cat=f"""SELECT {dataset_name_sql('props')} AS table_name, event_type || '.csv' AS source_filename,
              '/data/' || CAST(event_id AS VARCHAR) || '.parquet' AS parquet_path, ts AS ingested_at FROM events""")
CATALOG = f"""SELECT {dataset_name_sql('props')} AS table_name, event_type || '.csv' AS source_filename,
  '/data/' || CAST(event_id AS VARCHAR) || '.parquet' AS parquet_path, ts AS ingested_at FROM events"""
SQL["catalog_changes"] = o.with_ctes(
    """SELECT table_name, source_filename, parquet_path, ingested_at, rank, rank = 1 AS is_active FROM (
        SELECT *, row_number() OVER (ORDER BY ingested_at DESC, table_name DESC) AS rank FROM (
          SELECT table_name, arg_max(source_filename, (ingested_at, parquet_path)) AS source_filename,
                 arg_max(parquet_path, (ingested_at, parquet_path)) AS parquet_path, max(ingested_at) AS ingested_at
          FROM a WHERE source_filename <> 'error.csv'
            AND table_name NOT IN (SELECT table_name FROM cat WHERE source_filename = 'purchase.csv') GROUP BY table_name))""",
    cat=CATALOG, a="""SELECT * FROM cat UNION ALL
      (SELECT 'added', source_filename, parquet_path, ingested_at FROM cat ORDER BY parquet_path LIMIT 1)""")

# LTTB: a walk over the buckets, one step each (buckets as array_split makes them)
SQL["lttb_downsample"] = o.with_ctes(
    """SELECT k, p.pos, ts, l_orderkey, l_linenumber, l_partkey, l_suppkey, round(l_quantity, 6) AS l_quantity,
        round(l_extendedprice, 6) AS l_extendedprice, round(l_discount, 6) AS l_discount, round(l_tax, 6) AS l_tax,
        round(y, 6) AS envelope
      FROM (SELECT CAST(b + 1 AS BIGINT) AS k, x AS pos FROM walk UNION ALL SELECT 1499, n - 1 FROM len) q JOIN p USING (pos)""",
    lw=o.LINEITEM_WIDE,
    p="""SELECT *, row_number() OVER (ORDER BY ts, l_orderkey, l_linenumber, l_partkey, l_suppkey) - 1 AS pos,
        greatest(abs(coalesce(l_quantity, 0.0)), abs(coalesce(l_extendedprice, 0.0)), abs(coalesce(l_discount, 0.0)),
                 abs(coalesce(l_tax, 0.0))) AS y FROM lw""",
    len="SELECT count(*) AS n, (count(*) - 2) // 1498 AS q, (count(*) - 2) % 1498 AS r FROM p",
    pts="""SELECT pos AS x, y, CASE WHEN pos = 0 THEN -1 WHEN pos = n - 1 THEN 1498 WHEN pos - 1 < r * (q + 1) THEN (pos - 1) // (q + 1)
        ELSE r + (pos - 1 - r * (q + 1)) // q END AS b FROM p, len""",
    mid="SELECT b, avg(x) AS mx, avg(y) AS my FROM pts GROUP BY b",
    lists="SELECT b, list({'x': x, 'y': y} ORDER BY x) AS c FROM pts GROUP BY b",
    walk="""SELECT CAST(-1 AS BIGINT) AS b, CAST(0 AS BIGINT) AS x, (SELECT y FROM pts WHERE b = -1) AS y
      UNION ALL SELECT b, best.x, best.y FROM (
        SELECT l.b, list_reduce(list_transform(l.c, lambda e: {'x': e.x, 'y': e.y,
            'area': 0.5 * abs((w.x - m.mx) * (e.y - w.y) - (w.x - e.x) * (m.my - w.y))}),
            lambda f, g: CASE WHEN g.area > f.area THEN g ELSE f END) AS best
        FROM walk w JOIN lists l ON l.b = w.b + 1 JOIN mid m ON m.b = w.b + 2 WHERE w.b < 1497)""",
).replace("WITH ", "WITH RECURSIVE ", 1)
