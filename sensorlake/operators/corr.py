"""Pairwise-complete Pearson correlation, its KPIs, pair fit and time quartiles.

The matrix is ONE global aggregation with partial aggregation: for each pair
(a, b) the covariance and both standard deviations over rows where both are
present. Undefined r (constant channel, < 2 pairs) is 0, also on the diagonal.
``covar_samp / (sd·sd)`` is wrapped in ``try_divide`` because a bare ``corr``
over a constant input raises under ANSI mode.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions.numeric import nan_to_null
from sensorlake.plans.ranking import materialize, placed_pieces, small_side
from sensorlake.functions.shipping import by_value

by_value(__name__)      # pandas-UDF helpers travel with the task


def _pair_cols(a: str, b: str):
    if a == b:
        x = F.col(a)
        return x, x
    return F.when(F.col(b).isNotNull(), F.col(a)), F.when(F.col(a).isNotNull(), F.col(b))


def corr_matrix(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Long matrix (x, y, x_ord, y_ord, r, n) over all ordered pairs incl. the diagonal."""
    ch = list(channels)
    wide = wide.select(*[nan_to_null(F.col(c)).alias(c) for c in ch])
    aggs, pairs = [], []
    for i, a in enumerate(ch):
        for j in range(i, len(ch)):
            b = ch[j]
            xa, xb = _pair_cols(a, b)
            tag = f"p{i}_{j}"
            aggs += [F.covar_samp(xa, xb).alias(f"{tag}_c"), F.stddev_samp(xa).alias(f"{tag}_sa"),
                     F.stddev_samp(xb).alias(f"{tag}_sb"), F.count(xa).alias(f"{tag}_n")]
            pairs.append((i, j, tag))
    g = wide.agg(*aggs)
    cells = []
    for i, j, tag in pairs:
        r = F.coalesce(F.try_divide(F.col(f"{tag}_c"), F.col(f"{tag}_sa") * F.col(f"{tag}_sb")), F.lit(0.0))
        r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), r))
        n = F.col(f"{tag}_n").cast("long")
        cells.append(F.struct(F.lit(ch[i]).alias("x"), F.lit(ch[j]).alias("y"), F.lit(i).alias("x_ord"),
                              F.lit(j).alias("y_ord"), r.alias("r"), n.alias("n")))
        if i != j:
            cells.append(F.struct(F.lit(ch[j]).alias("x"), F.lit(ch[i]).alias("y"), F.lit(j).alias("x_ord"),
                                  F.lit(i).alias("y_ord"), r.alias("r"), n.alias("n")))
    return g.select(F.inline(F.array(*cells)))


def corr_matrix_wide(wide: DataFrame, channels: Sequence[str]) -> DataFrame:
    """Same result as ``corr_matrix`` for many channels.

    Pass 1: global mean per channel (one aggregate). Pass 2: every partition
    centres its rows on those means and emits, per channel pair, the
    pairwise-complete sums n, Σx, Σy, Σx², Σy², Σxy as masked matrix products
    (MᵀM, XᵀM, X²ᵀM, XᵀX with numpy); one ``groupBy(pair).sum`` combines them.
    Rows per partition out: k²; no row ever leaves its partition."""
    import numpy as np
    import pandas as pd
    ch = list(channels)
    wide = wide.select(*[nan_to_null(F.col(c)).alias(c) for c in ch])
    k = len(ch)
    means_row = wide.agg(*[F.avg(c).alias(c) for c in ch]).first()
    mu = np.array([0.0 if means_row[c] is None else float(means_row[c]) for c in ch])

    def sums(it):
        acc = None
        for pdf in it:
            x = pdf[ch].to_numpy(dtype=float) - mu
            m = (~np.isnan(x)).astype(float)
            x = np.nan_to_num(x, nan=0.0)
            part = (m.T @ m, x.T @ m, (x * x).T @ m, x.T @ x)
            acc = part if acc is None else tuple(a + b for a, b in zip(acc, part))
        if acc is None:
            return
        n, sx, sxx, sxy = acc
        ii, jj = np.meshgrid(np.arange(k), np.arange(k), indexing="ij")
        yield pd.DataFrame({"i": ii.ravel(), "j": jj.ravel(), "n": n.ravel(),
                            "sx": sx.ravel(), "sy": sx.T.ravel(), "sxx": sxx.ravel(), "syy": sxx.T.ravel(),
                            "sxy": sxy.ravel()})

    schema = "i long, j long, n double, sx double, sy double, sxx double, syy double, sxy double"
    part = wide.select(*[F.col(c).cast("double").alias(c) for c in ch]).mapInPandas(sums, schema)
    g = part.groupBy("i", "j").agg(*[F.sum(c).alias(c) for c in ("n", "sx", "sy", "sxx", "syy", "sxy")])
    n = F.col("n")
    cov = (F.col("sxy") - F.col("sx") * F.col("sy") / n) / (n - 1)
    vx = (F.col("sxx") - F.col("sx") * F.col("sx") / n) / (n - 1)
    vy = (F.col("syy") - F.col("sy") * F.col("sy") / n) / (n - 1)
    den = F.sqrt(F.greatest(vx, F.lit(0.0))) * F.sqrt(F.greatest(vy, F.lit(0.0)))
    r = F.when(n >= 2, F.try_divide(cov, den))
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.coalesce(r, F.lit(0.0))))
    names = F.array(*[F.lit(c) for c in ch])
    return g.select(F.element_at(names, (F.col("i") + 1).cast("int")).alias("x"),
                    F.element_at(names, (F.col("j") + 1).cast("int")).alias("y"),
                    F.col("i").cast("int").alias("x_ord"), F.col("j").cast("int").alias("y_ord"),
                    r.alias("r"), n.cast("long").alias("n"))


def corr_kpis(matrix: DataFrame) -> DataFrame:
    """Upper triangle: #pairs, #|r| ≥ 0.7, strongest positive / negative pair
    (ties -> first in row-major order), mean |r|."""
    u = matrix.where(F.col("x_ord") < F.col("y_ord"))
    pos = F.when(F.col("r") > 0, F.struct(F.col("r"), -F.col("x_ord"), -F.col("y_ord")))
    neg = F.when(F.col("r") < 0, F.struct(F.col("r"), F.col("x_ord"), F.col("y_ord")))
    g = u.agg(F.count(F.lit(1)).cast("long").alias("n_pairs"),
              F.count_if(F.abs(F.col("r")) >= 0.7).cast("long").alias("n_strong"),
              F.max_by(F.struct("x", "y", "r"), pos).alias("P"),
              F.min_by(F.struct("x", "y", "r"), neg).alias("N"),
              F.avg(F.abs(F.col("r"))).alias("mean_abs_r"))
    return g.select("n_pairs", "n_strong", F.col("P.x").alias("top_pos_x"), F.col("P.y").alias("top_pos_y"),
                    F.coalesce(F.col("P.r"), F.lit(0.0)).alias("top_pos_r"),
                    F.col("N.x").alias("top_neg_x"), F.col("N.y").alias("top_neg_y"),
                    F.coalesce(F.col("N.r"), F.lit(0.0)).alias("top_neg_r"), "mean_abs_r")


def pair_fit(wide: DataFrame, x: str, y: str, *, sample: DataFrame | None = None) -> DataFrame:
    """Least-squares line y = slope·x + intercept on the pairwise-complete rows,
    r and r² (all rows), means, extents and the fitted line's end points.

    One aggregation. ``sample``: rows to fit on instead of all (e.g. the
    5,000-row stride of the original chart); r and n still come from all rows
    (one extra single-row aggregate whose two numbers enter as literals)."""
    wide = wide.withColumns({c: nan_to_null(F.col(c)) for c in {x, y}})
    sample = None if sample is None else sample.withColumns({c: nan_to_null(F.col(c)) for c in {x, y}})
    if x == y:
        full = wide.where(F.col(x).isNotNull())
    else:
        full = wide.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    xa, ya = F.col(x), F.col(y)
    r_expr = F.coalesce(F.try_divide(F.covar_samp(xa, ya), F.stddev_samp(xa) * F.stddev_samp(ya)), F.lit(0.0))
    fit = [F.try_divide(F.covar_pop(ya, xa), F.var_pop(xa)).alias("slope"),
           F.avg(xa).alias("x_mean"), F.avg(ya).alias("y_mean"),
           F.min(xa).alias("x_min"), F.max(xa).alias("x_max"), F.min(ya).alias("y_min"), F.max(ya).alias("y_max"),
           F.count(F.lit(1)).cast("long").alias("n_fit")]
    if sample is None:
        out = full.agg(*fit, r_expr.alias("r"), F.count(F.lit(1)).cast("long").alias("n"))
    else:
        rn = full.agg(r_expr.alias("r"), F.count(F.lit(1)).alias("n")).first()
        out = sample.agg(*fit).withColumn("r", F.lit(rn["r"]).cast("double")).withColumn("n", F.lit(rn["n"]).cast("long"))
    out = out.withColumn("intercept", F.col("y_mean") - F.col("slope") * F.col("x_mean"))
    r = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), F.col("r")))
    return out.select(F.lit(x).alias("x"), F.lit(y).alias("y"), "slope", "intercept", r.alias("r"),
                      (r * r).alias("r2"), "x_mean", "y_mean", "n", "n_fit", "x_min", "x_max", "y_min", "y_max",
                      (F.col("slope") * F.col("x_min") + F.col("intercept")).alias("fit_y_at_x_min"),
                      (F.col("slope") * F.col("x_max") + F.col("intercept")).alias("fit_y_at_x_max"))


def time_quartiles(wide: DataFrame, x: str, y: str, *, order: Sequence[str] = ("ts", "rid"),
                   ts: str = "ts") -> DataFrame:
    """Split the pair cloud into 4 slices in time order: rows [(q·n)//4, ((q+1)·n)//4).
    q = (4·pos + 3) div n (not ntile, which puts the remainder first).
    One row per non-empty quartile with count, means and time span.

    Pieces of the order that lie in one quartile are aggregated as they are; only the pieces that hold a border
    between two, three at most, are sorted."""
    full = wide.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(*dict.fromkeys([*order, x, y, ts]))
    rows, path, table = placed_pieces(full, [], list(order))

    def quartile(pos: Column) -> Column:
        return F.floor((pos * 4 + 3) / F.col("_total")).cast("long")

    table = materialize(table.withColumn("q", quartile(F.col("_before"))).withColumn(
        "_cut", quartile(F.col("_before") + F.col("_n") - 1) != F.col("q")))
    whole = rows.join(small_side(table.where(~F.col("_cut")).select(*path, "q", "_total")), path)
    parts = rows.join(small_side(table.where("_cut").select(*path, "_before", "_total")), path)
    inside = F.row_number().over(Window.partitionBy(*path).orderBy(*order)) - 1
    parts = parts.withColumn("q", quartile(F.col("_before") + inside))
    cols = ["q", "_total", x, y, *([ts] if ts not in (x, y) else [])]
    g = whole.select(*cols).unionByName(parts.select(*cols)).groupBy("q").agg(
        F.count(F.lit(1)).cast("long").alias("n"), F.max("_total").alias("_total"), F.avg(x).alias("x_mean"), F.avg(y).alias("y_mean"),
        F.min(ts).alias("ts_first"), F.max(ts).alias("ts_last"))
    begin = F.ceil((F.col("q") * F.col("_total") - 3) / 4).cast("long")
    return g.select("q", "n", begin.alias("pos_lo"), (begin + F.col("n") - 1).alias("pos_hi"), "x_mean", "y_mean", "ts_first", "ts_last")
