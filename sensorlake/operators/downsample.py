"""Down-sampling for charts: uniform stride, envelope, LTTB.

Row picking happens on Spark; only the picked rows (a fixed budget) leave it.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.plans.ranking import materialize, small_side, with_position
from sensorlake.functions.shipping import by_value

by_value(__name__)      # pandas-UDF helpers travel with the task

# Point budgets of the original charts.
BUDGET_OVERVIEW = 2000
BUDGET_BROWSER = 1500
BUDGET_ANOMALY = 2000
BUDGET_SCATTER = 5000


def stride_targets(counts: DataFrame, n: int, *, keys: Sequence[str] = (), count: str = "N") -> DataFrame:
    """Target positions per series: trunc(linspace(0, N-1, n)); N <= n -> every row.

    k·((N−1)/(n−1)) is evaluated in DOUBLE like numpy, and the last target is N−1.
    """
    keys = list(keys)
    N = F.col(count)
    k = F.col("k")
    step = (N - 1).cast("double") / F.lit(float(max(n - 1, 1)))
    t = counts.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.least(N, F.lit(n)).cast("long") - 1)))
    idx = (F.when(N <= n, k)
           .when(k == n - 1, N - 1)
           .otherwise(F.floor(k.cast("double") * step).cast("long")))
    return t.select(*keys, k.alias("k"), idx.cast("long").alias("pos"))


def stride_pick(df: DataFrame, n: int, *, keys: Sequence[str] = (), pos: str = "pos",
                counts: DataFrame | None = None) -> DataFrame:
    """Rows of ``df`` (which carries positions) at the stride targets, with ``k``.
    ``counts`` (keys, N): series lengths, e.g. from the un-positioned input (cheaper)."""
    keys = list(keys)
    if counts is None:
        counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))
    t = small_side(stride_targets(counts, n, keys=keys))     # at most n rows per series
    if pos != "pos":
        t = t.withColumnRenamed("pos", pos)
    return df.join(t, keys + [pos])


def stride_downsample(df: DataFrame, n: int, *, keys: Sequence[str] = (), order: Sequence[str] = ("ts", "rid")) -> DataFrame:
    """Uniform-stride pick of n of N rows per series in ``order`` (adds pos, k). Only pieces of the order that hold a
    target are sorted."""
    def holds(first: Column, stop: Column, total: Column) -> Column:
        step = (total - 1).cast("double") / F.lit(float(max(n - 1, 1)))
        near = F.floor(first / step).cast("long")
        hit = (total <= n) | (stop >= total)                     # the last target is the last row
        for d in (-1, 0, 1, 2):
            at = F.floor((near + d).cast("double") * step).cast("long")
            hit = hit | ((near + d >= 0) & (at >= first) & (at < stop))
        return hit

    p = with_position(df, list(keys), list(order), only=holds)
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("N"))      # from the input: no second ranking
    return stride_pick(p, n, keys=keys, counts=counts)


def envelope(wide: DataFrame, channels: Sequence[str], *, out: str = "envelope") -> DataFrame:
    """Per row: max over channels of |y|, missing -> 0."""
    parts: list[Column] = [F.abs(F.coalesce(F.col(c), F.lit(0.0))) for c in channels]
    e = parts[0] if len(parts) == 1 else F.greatest(*parts)
    return wide.withColumn(out, e)


# ---------------------------------------------------------------------------- LTTB (D3)
# Largest-Triangle-Three-Buckets (Steinarsson, 2013) on (row position, y):
# keep rows 0 and N−1; split rows 1..N−2 into n_out−2 buckets like
# numpy.array_split (the first (N−2) mod (n_out−2) buckets one row longer);
# walk the buckets in order, picking in each the point with the largest
# triangle against the previous pick and the next bucket's mean (first on ties).
#
# At scale: the area is |linear| in the candidate point, so its maximum over a bucket lies on the bucket's
# convex hull. Stage 1 reduces every bucket to its hull vertices + sums (sub-buckets of ≤ SUB_BUCKET rows, then
# per bucket: all groups bounded). Stage 2 walks blocks of buckets side by side: all that a block depends on is the pick
# before it, a hull vertex of the bucket before, so the block is walked from each of them, a map from entry to exit
# (walks soon run into one another). Stage 3 chains the maps: a row a block and entry that the block before can
# leave from.
SUB_BUCKET = 100_000
MERGE = 64
#: Buckets of a block at most, and hull vertices of it, about.
BLOCK_BUCKETS = 32
BLOCK_VERTICES = 200_000


def _hull_keep(x, y):
    """Mask of convex-hull vertices (both chains, collinear points dropped); x ascending."""
    import numpy as np
    n = len(x)
    keep = np.zeros(n, dtype=bool)
    if n <= 2:
        keep[:] = True
        return keep
    for sign in (1.0, -1.0):
        st: list[int] = []
        for i in range(n):
            while len(st) >= 2:
                o, a = st[-2], st[-1]
                cross = (x[a] - x[o]) * (y[i] - y[o]) - (y[a] - y[o]) * (x[i] - x[o])
                if sign * cross >= 0:
                    st.pop()
                else:
                    break
            st.append(i)
        keep[st] = True
    return keep


def _hulls_pdf(pdf):
    """Hull vertices of every bucket present in one sub-chunk (stage 1).

    Vectorised prefilter first: a point strictly inside the quadrilateral of
    its bucket's leftmost, lowest, rightmost and highest points is not a hull
    vertex; the exact monotone chain then runs on the few survivors."""
    import numpy as np
    pdf = pdf.sort_values(["b", "x"], kind="mergesort").reset_index(drop=True)
    b = pdf["b"].to_numpy()
    x = pdf["x"].to_numpy(dtype=float)
    y = pdf["y"].to_numpy(dtype=float)
    n = len(pdf)
    if n == 0:
        return pdf
    starts = np.r_[0, np.flatnonzero(np.diff(b)) + 1]
    ends = np.r_[starts[1:], n]
    gid = np.repeat(np.arange(len(starts)), ends - starts)
    grp = pdf.assign(_g=gid).groupby("_g")["y"]
    lo_i = grp.idxmin().to_numpy()[gid]
    hi_i = grp.idxmax().to_numpy()[gid]
    first_i = starts[gid]
    last_i = ends[gid] - 1
    inside = np.ones(n, dtype=bool)
    for a, c in ((first_i, lo_i), (lo_i, last_i), (last_i, hi_i), (hi_i, first_i)):
        cross = (x[c] - x[a]) * (y - y[a]) - (y[c] - y[a]) * (x - x[a])
        inside &= cross > 0
    cand = np.flatnonzero(~inside)
    keep = np.zeros(n, dtype=bool)
    cb = b[cand]
    cuts = np.flatnonzero(np.diff(cb)) + 1
    for lo, hi in zip(np.r_[0, cuts], np.r_[cuts, len(cand)]):
        idx = cand[lo:hi]
        keep[idx[_hull_keep(x[idx], y[idx])]] = True
    return pdf[keep]


def _areas(ax, ay, bx, by, cx, cy):
    """Triangle areas of previous picks a, candidates b and the next bucket's mean c."""
    import numpy as np
    return 0.5 * np.abs((ax - cx) * (by - ay) - (ax - bx) * (cy - ay))


def _largest(ax, ay, bx, by, cx: float, cy: float):
    """For every a the index of the b with the largest triangle (first on ties); b are hull vertices by x.

    Many pairs are not all tried: the area is the distance from the line a–c along y, so the best vertex of either
    chain is where the chain's slope passes the line's; it and its neighbours are compared."""
    import numpy as np
    if len(ax) * len(bx) <= 1_000_000:
        return _areas(ax[:, None], ay[:, None], bx[None, :], by[None, :], cx, cy).argmax(axis=1)
    line = by[0] + (by[-1] - by[0]) * (bx - bx[0]) / (bx[-1] - bx[0])
    slope = (cy - ay) / (cx - ax)
    found = []
    for sign in (1.0, -1.0):
        chain = np.flatnonzero((sign * (by - line) > 0) | (np.arange(len(bx)) % (len(bx) - 1) == 0))
        falling = -sign * np.diff(by[chain]) / np.diff(bx[chain])
        at = np.searchsorted(falling, -sign * slope, "left")
        found += [chain[np.clip(at + d, 0, len(chain) - 1)] for d in (-1, 0, 1)]
    near = np.sort(np.stack(found, axis=1), axis=1)
    best = _areas(ax[:, None], ay[:, None], bx[near], by[near], cx, cy).argmax(axis=1)
    return near[np.arange(len(ax)), best]


def _block_walk(keys, pdf):
    """Walks of one block from every vertex of the bucket before: entry -> picks (stage 2). Rows by ``role``: 0 entries,
    1 the block's own vertices, 2 the mean of the bucket behind it."""
    import numpy as np
    import pandas as pd
    pdf = pdf.sort_values(["role", "b", "x"], kind="mergesort")
    role, b = pdf["role"].to_numpy(), pdf["b"].to_numpy()
    x, y, mx, my = (pdf[c].to_numpy(dtype=float) for c in ("x", "y", "mx", "my"))
    start = np.flatnonzero(role == 0)
    own = np.flatnonzero(role == 1)
    cuts = np.flatnonzero(np.diff(b[own])) + 1
    buckets = np.split(own, cuts)
    means = [(mx[k[0]], my[k[0]]) for k in buckets[1:]] + [(mx[-1], my[-1])]
    at, back, picks = start, np.arange(len(start)), []      # the points that walks are at, and each entry's among them
    for vertices, (cx, cy) in zip(buckets, means):
        to = vertices[_largest(x[at], y[at], x[vertices], y[vertices], cx, cy)]
        at, merged = np.unique(to, return_inverse=True)
        back = merged[back]
        picks.append(x[at[back]].astype("int64"))
    table = np.stack(picks, axis=1)
    out = pd.DataFrame({"entry": x[start].astype("int64"), "exit": table[:, -1], "picks": list(table)})
    out.insert(0, "g", int(pdf["g"].iloc[0]))
    for c in reversed(keys):
        out.insert(0, c, pdf[c].iloc[0])
    return out


def _chain(keys, pdf):
    """The one walk through all blocks of a series (stage 3): a few rows a block."""
    import numpy as np
    import pandas as pd
    step = {(g, e): k for k, (g, e) in enumerate(zip(pdf["g"], pdf["entry"]))}
    exits, picks = pdf["exit"].to_numpy(), pdf["picks"].to_numpy()
    pos, parts = 0, [[0]]
    for g in range(int(pdf["g"].max()) + 1):
        k = step[g, pos]
        parts.append(picks[k])
        pos = int(exits[k])
    parts.append([int(pdf["n"].iloc[0]) - 1])
    pos = np.concatenate(parts).astype("int64")
    out = pd.DataFrame({"k": np.arange(len(pos), dtype="int64"), "pos": pos})
    for c in reversed(keys):
        out.insert(0, c, pdf[c].iloc[0])
    return out


def lttb_positions(df: DataFrame, n_out: int, *, keys: Sequence[str] = (), pos: str = "pos", y: str = "y") -> DataFrame:
    """Positions picked by LTTB per series: (keys, k, pos). N ≤ n_out -> every row.

    ``df`` carries 0-based contiguous positions ``pos`` per series and the value ``y``
    (missing -> 0, as the envelope does)."""
    keys = list(keys)
    if n_out < 3:
        raise ValueError("n_out must be >= 3")
    B = n_out - 2
    counts = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_N"))
    base = df.select(*keys, F.col(pos).cast("long").alias("x"),
                     F.coalesce(F.col(y), F.lit(0.0)).cast("double").alias("y"))
    if keys:
        t = base.join(small_side(counts), keys)
    else:
        row = counts.first()                 # one series: its length is one scalar
        t = base.withColumn("_N", F.lit(row["_N"] if row is not None else 0).cast("long"))
    small = t.where(F.col("_N") <= n_out).select(*keys, F.col("x").alias("k"), F.col("x").alias("pos"))
    big = t.where(F.col("_N") > n_out)
    m = F.col("_N") - 2
    q = F.floor(m / F.lit(B)).cast("long")
    r = (m - q * F.lit(B)).cast("long")
    i = F.col("x") - 1
    b = (F.when(F.col("x") == 0, F.lit(-1))
         .when(F.col("x") == F.col("_N") - 1, F.lit(B))
         .when(i < r * (q + 1), F.floor(i / (q + 1)))
         .otherwise(r + F.floor((i - r * (q + 1)) / q))).cast("long")
    big = big.withColumn("b", b).withColumn("_sb", F.floor(F.col("x") / F.lit(SUB_BUCKET)).cast("long"))
    sums = big.groupBy(*keys, "b").agg(F.avg("x").alias("mx"), F.avg("y").alias("my"))
    hschema = big.select(*keys, "b", "_sb", "x", "y").schema
    # one pandas call per (series, sub-chunk of ≤ SUB_BUCKET rows), then the hulls of a bucket's sub-chunks are
    # merged in levels of MERGE at a time: what is left of a bucket is its own hull, however many rows it had
    hull = big.select(*keys, "b", "_sb", "x", "y").groupBy(*keys, "_sb").applyInPandas(_hulls_pdf, hschema)
    longest = big.agg(F.max(F.ceil(F.col("_N") / F.lit(B)))).first()[0] or 0
    chunks = longest // SUB_BUCKET + 2
    while chunks > 1:
        chunks = -(-chunks // MERGE) + (1 if chunks > MERGE else 0)
        fold = F.lit(0).cast("long") if chunks == 1 else F.floor(F.col("_sb") / MERGE).cast("long")
        hull = hull.withColumn("_sb", fold).groupBy(*keys, "b", "_sb").applyInPandas(_hulls_pdf, hschema)
    own = keys or ["_g"]
    if not keys:
        hull, sums = hull.withColumn("_g", F.lit(0)), sums.withColumn("_g", F.lit(0))
    sums = materialize(sums)
    cand = materialize(hull.drop("_sb").join(sums, own + ["b"]))
    most = cand.groupBy(*own, "b").count().agg(F.max("count")).first()[0]
    if most is None:
        return small
    K = max(1, min(BLOCK_BUCKETS, BLOCK_VERTICES // most))
    none = F.lit(None).cast("double")
    cols = ["b", F.col("x").cast("double").alias("x"), "y", "mx", "my"]
    inside = cand.where((F.col("b") >= 0) & (F.col("b") < B)).select(
        *own, F.floor(F.col("b") / K).cast("long").alias("g"), F.lit(1).alias("role"), *cols)
    entries = cand.where(((F.col("b") + 1) % K == 0) & (F.col("b") + 1 < B)).select(
        *own, F.floor((F.col("b") + 1) / K).cast("long").alias("g"), F.lit(0).alias("role"), *cols)
    behind = sums.where((F.col("b") > 0) & ((F.col("b") % K == 0) | (F.col("b") == B))).select(
        *own, F.floor((F.col("b") - 1) / K).cast("long").alias("g"), F.lit(2).alias("role"), "b", none.alias("x"), none.alias("y"), "mx", "my")
    blocks = inside.unionByName(entries).unionByName(behind)
    key_types = [f"{f.name} {f.dataType.simpleString()}" for f in blocks.select(*own).schema.fields]
    maps = materialize(blocks.groupBy(*own, "g").applyInPandas(
        lambda pdf: _block_walk(own, pdf), ", ".join([*key_types, "g long, entry long, exit long, picks array<long>"])))
    # only entries that the block before can leave from
    left = maps.select(*own, (F.col("g") + 1).alias("g"), F.col("exit").alias("entry")).distinct()
    reached = maps.where("g = 0").unionByName(maps.join(left, [*own, "g", "entry"], "left_semi").select(*maps.columns))
    lengths = sums.where(F.col("b") == B).select(*own, (F.col("mx") + 1).cast("long").alias("n"))
    walked = reached.join(lengths, own).groupBy(*own).applyInPandas(
        lambda pdf: _chain(own, pdf), ", ".join([*key_types, "k long, pos long"]))
    return walked.select(*keys, "k", "pos").unionByName(small)
