"""Order-dependent building blocks that never put one series into one task.

A window ``partitionBy(channel).orderBy(ts)`` sends a whole channel to one task; one
channel may hold a third of a 100 TB table. Here every series is cut into pieces first:

``pieces``  cells of the first order column on one even grid over the frame, counted per
    (series, cell). A piece with too many rows is cut again on its own extent, as often as
    needed; where all its rows share one value, the next order column takes over. The rule is
    arithmetic on the row's own columns, so every consumer and every retry agrees, and the
    (series, piece) counts are a small table.

``with_position``  0-based position of each row in its series: rank inside the piece + rows
    of the series in earlier pieces (a running sum over the count table). ``only`` restricts the
    work to pieces that hold wanted positions.

``position_runs``  runs of consecutive positions: found inside chunks, put together over the small table of runs at
    the chunks' borders.

``halo_window``  a rows frame [-lo, +hi] over positions, per chunk of C positions; rows near a
    chunk's edge are copied to the neighbour chunk. Each task holds at most C + lo + hi rows.

``rolling_stats``  count, mean, standard deviation, max and min of a rows frame of any length, O(1)
    a row: running aggregates forward and backward inside blocks as long as the frame, of which
    every frame needs exactly one of each.

``exact_percentiles``  a mergeable quantile summary per group brackets the wanted ranks; what lies
    between the brackets is only counted. Exact for any distribution.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.session import ensure_checkpoint_dir

#: Rows of a piece, about; a piece of more than four times as many is cut again.
BUCKET_ROWS = 250_000
#: Rows, about, of a partition where whole groups are ranked; so the partitions grow in number, not in size.
PARTITION_ROWS = 500_000
#: A table of at most so many narrow rows (some MB) is broadcast, a longer one joined by shuffle.
BROADCAST_ROWS = 50_000
#: Values over more binary magnitudes than this are cut by magnitude first.
MAGNITUDES = 8
#: Quantiles that a large group's summary is asked for, and the summary's accuracy (it errs by 1 / accuracy of the rows).
SUMMARY_POINTS = 1000
SUMMARY_ACCURACY = 5000

_INF = float("inf")


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage of a result that is read several times: a reliable ``checkpoint`` in the
    folder of ``spark.checkpoint.dir``, shared by all executors."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def bounded(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of ``rows`` rows, marked for broadcast if that is few enough."""
    return F.broadcast(df) if rows <= BROADCAST_ROWS else df


def small_side(df: DataFrame) -> DataFrame:
    """A table of about one narrow row a series, made once and marked for broadcast if it proves to have few
    rows; otherwise a shuffled join follows, in which Spark may split hot keys of the other side."""
    made = materialize(df)
    return bounded(made, made.count())


def dealt(df: DataFrame, rows: int, keys: Sequence[str]) -> DataFrame:
    """``df`` dealt out by ``keys``, in as many partitions as ``rows`` rows need; as it is if the session's partitions are enough."""
    n = -(-rows // PARTITION_ROWS)
    return df.repartition(n, *keys) if n > int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")) else df


# --------------------------------------------------------------------------- pieces
def _numbers(df: DataFrame, c: str) -> list[Column]:
    """Column ``c`` as numbers in the same order: micro-seconds, days, the number itself, or for text
    its first 18 bytes, six at a time."""
    t = df.schema[c].dataType
    if isinstance(t, (T.TimestampType, T.TimestampNTZType)):
        return [F.timestamp_diff("MICROSECOND", F.lit("1970-01-01 00:00:00").cast("timestamp_ntz"),
                                 F.col(c).cast("timestamp_ntz"))]
    if isinstance(t, T.DateType):
        return [F.datediff(F.col(c), F.lit("1970-01-01").cast("date")).cast("long")]
    if isinstance(t, T.StringType):
        body = F.rpad(F.hex(F.encode(F.col(c), "UTF-8")), 36, "0")
        return [F.conv(F.substring(body, 1 + 12 * k, 12), 16, 10).cast("long") for k in range(3)]
    return [F.col(c)]


def _kind(x: Column) -> Column:
    """Place of what an even grid cannot hold: null -2, -inf -1, a number 0, +inf 1, NaN 2."""
    d = x.cast("double")
    return (F.when(x.isNull(), -2).when(F.isnan(d), 2).when(d == _INF, 1).when(d == -_INF, -1).otherwise(0)).cast("int")


def _scale(x: Column) -> Column:
    """Sign and binary magnitude of a number as one integer in the same order."""
    size = F.floor(F.log2(F.abs(x.cast("double")))).cast("long") + 1100
    return F.when(x > 0, size).when(x < 0, -size).otherwise(F.lit(0).cast("long"))


def _cell(x: Column, lo: Column, hi: Column, cells: Column, most: int = 4096) -> Column:
    """Cell of a number: by magnitude where [lo, hi] spans over ``most``, else on an even grid; what is no
    number before and behind. In the order of the numbers, so that equal ones share a cell."""
    span = hi.cast("double") - lo.cast("double")
    at = F.floor((x.cast("double") - lo.cast("double")) / span * cells.cast("double"))
    even = F.when(span > 0, F.least(F.greatest(at, F.lit(0)), cells - 1)).otherwise(F.lit(0))
    magnitudes = _scale(hi) - _scale(lo)
    wide = (magnitudes > most) | (span == _INF)
    kind = _kind(x)
    return (F.when(kind == 0, F.when(wide, _scale(x) - _scale(lo)).otherwise(even)).when(kind < 0, kind)
            .otherwise(F.when(wide, magnitudes + 1).otherwise(cells) + kind).cast("long"))


def _extent(x: Column, name: str) -> list[Column]:
    number = F.when(_kind(x) == 0, x)
    return [F.min(number).alias(f"{name}_lo"), F.max(number).alias(f"{name}_hi"),
            F.min(_kind(x)).alias(f"{name}_k0"), F.max(_kind(x)).alias(f"{name}_k1")]


def pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_rows: int | None = None
           ) -> tuple[DataFrame, list[str], DataFrame]:
    """(rows with piece columns, the piece columns in order, the table of pieces with their counts ``_n``).

    A piece of over four times ``bucket_rows`` rows is left whole only if its rows are equal in every
    order column (text: in the first 18 bytes).
    """
    keys, size = list(keys), bucket_rows or BUCKET_ROWS
    numbers = [x for c in order for x in _numbers(df, c)]
    first = numbers[0]
    frame = df.agg(F.count(F.lit(1)).alias("n"), *_extent(first, "x")).first()
    cells = F.lit(max(1, -(-frame["n"] // size))).cast("long")
    lo, hi = F.lit(frame["x_lo"]), F.lit(frame["x_hi"])
    path = ["_b0"]
    even = _cell(first, lo, hi, cells) if frame["x_lo"] is not None else _kind(first).cast("long")
    rows = df.withColumn("_b0", even)

    def count(r: DataFrame) -> DataFrame:
        return r.groupBy(*keys, *path).agg(F.count(F.lit(1)).alias("_n"),
                                           *[c for j, x in enumerate(numbers) for c in _extent(x, f"_x{j}")])

    table = materialize(count(rows))
    while True:
        splits = [(F.col(f"_x{j}_lo") < F.col(f"_x{j}_hi")) | (F.col(f"_x{j}_k0") < F.col(f"_x{j}_k1"))
                  for j in range(len(numbers))]
        by = reduce(lambda a, j: a.when(splits[j], j), range(len(numbers)), F)
        over = table.where(F.col("_n") > 4 * size).withColumn("_j", by).where(F.col("_j").isNotNull())
        n_over = over.count()
        if not n_over:
            break
        over = over.select(*keys, *path, "_j", F.ceil(F.col("_n") / size).cast("long").alias("_cells"),
                           *[f"_x{j}_{e}" for j in range(len(numbers)) for e in ("lo", "hi")])
        level = f"_b{len(path)}"
        cell = reduce(lambda a, j: a.when(F.col("_j") == j, _cell(
            numbers[j], F.col(f"_x{j}_lo"), F.col(f"_x{j}_hi"), F.col("_cells"), MAGNITUDES)), range(len(numbers)), F)
        rows = (rows.join(bounded(over, n_over), [*keys, *path], "left")
                .withColumn(level, F.coalesce(cell.otherwise(None), F.lit(0)).cast("long"))
                .drop("_j", "_cells", *[f"_x{j}_{e}" for j in range(len(numbers)) for e in ("lo", "hi")]))
        before, path = path, [*path, level]
        kept = table.join(over.select(*keys, *before), [*keys, *before], "left_anti").withColumn(level, F.lit(0).cast("long"))
        again = count(rows.join(bounded(over.select(*keys, *before), n_over), [*keys, *before], "left_semi"))
        table = materialize(kept.select(again.columns).unionByName(again))
    return rows, path, table.select(*keys, *path, "_n")


def placed_pieces(df: DataFrame, keys: Sequence[str], order: Sequence[str], bucket_rows: int | None = None
                  ) -> tuple[DataFrame, list[str], DataFrame]:
    """``pieces`` with the rows of the series before each piece (``_before``) and in all (``_total``)."""
    rows, path, table = pieces(df, keys, order, bucket_rows)
    earlier = Window.partitionBy(*keys).orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    return rows, path, table.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).cast("long")).withColumn(
        "_total", F.sum("_n").over(Window.partitionBy(*keys)))


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], *, pos: str = "pos", bucket_rows: int | None = None,
                  only: Callable[[Column, Column, Column], Column] | None = None) -> DataFrame:
    """Add ``pos``: the 0-based rank of the row in its series by ``order``.

    ``order`` must be a total order within a series (e.g. ts, rid), and the keys not null. ``only``: a condition on a piece's
    first position, its end and the series' length; rows of other pieces are left out before any sort.
    """
    keys, order = list(keys), list(order)
    rows, path, table = placed_pieces(df, keys, order, bucket_rows)
    if only is not None:
        wanted = table.where(only(F.col("_before"), F.col("_before") + F.col("_n"), F.col("_total")))
        return positions_in(rows, path, wanted, keys, order, df.columns, pos=pos)
    ranked = rows.withColumn("_inside", _inside(keys, path, order)).join(table.drop("_n", "_total"), [*keys, *path])
    return ranked.withColumn(pos, _placed()).select(*df.columns, pos)


def _inside(keys: Sequence[str], path: Sequence[str], order: Sequence[str]) -> Column:
    return F.row_number().over(Window.partitionBy(*keys, *path).orderBy(*order)) - 1


def _placed() -> Column:
    return (F.col("_before") + F.col("_inside")).cast("long")


def positions_in(rows: DataFrame, path: Sequence[str], wanted: DataFrame, keys: Sequence[str], order: Sequence[str],
                 columns: Sequence[str], *, pos: str = "pos") -> DataFrame:
    """``columns`` and ``pos`` of the rows in ``wanted`` pieces (of ``placed_pieces``); rows of other pieces are left out
    before any sort."""
    ranked = rows.join(small_side(wanted.select(*keys, *path, "_before")), [*keys, *path])
    return ranked.withColumn("_inside", _inside(keys, path, order)).withColumn(pos, _placed()).select(*columns, pos)


def position_runs(flagged: DataFrame, keys: Sequence[str], pos: str, *, first: dict[str, str] | None = None,
                  last: dict[str, str] | None = None, chunk: int = 100_000) -> DataFrame:
    """Runs of consecutive positions among the given rows: keys, start_pos, end_pos, n and columns of a run's first and
    last row (new name -> column).

    Runs are found in chunks of positions; those that touch a chunk's border, two a chunk at most, are put together over
    the small table of them. A run of any length is a chain of such pieces, never one group of rows."""
    keys, first, last = list(keys), first or {}, last or {}
    at = F.floor(F.col(pos) / F.lit(chunk)).cast("long")
    rows = flagged.withColumn("_chunk", at)
    inside = Window.partitionBy(*keys, "_chunk").orderBy(pos)
    rows = rows.withColumn("_isl", F.col(pos) - F.row_number().over(inside))
    ends = [F.min(pos).alias("start_pos"), F.max(pos).alias("end_pos"), F.count(F.lit(1)).alias("n"),
            *[F.min_by(c, pos).alias(n) for n, c in first.items()], *[F.max_by(c, pos).alias(n) for n, c in last.items()]]
    local = rows.groupBy(*keys, "_chunk", "_isl").agg(*ends).drop("_chunk", "_isl")
    border = (F.col("start_pos") % chunk == 0) | ((F.col("end_pos") + 1) % chunk == 0)
    along = Window.partitionBy(*keys).orderBy("start_pos")
    new = F.coalesce(F.col("start_pos") != F.lag("end_pos").over(along) + 1, F.lit(True)).cast("int")
    chains = local.where(border).withColumn("_new", new).withColumn("_run", F.sum("_new").over(along))
    merged = chains.groupBy(*keys, "_run").agg(
        F.min("start_pos").alias("_s"), F.max("end_pos").alias("_e"), F.sum("n").alias("n"),
        *[F.min_by(n, "start_pos").alias(n) for n in first], *[F.max_by(n, "start_pos").alias(n) for n in last])
    merged = merged.withColumnsRenamed({"_s": "start_pos", "_e": "end_pos"}).select(*local.columns)
    return local.where(~border).unionByName(merged)


# --------------------------------------------------------------------------- frames over positions
def chunk_size(lo: int, hi: int, base: int = 100_000) -> int:
    return max(base, 10 * (lo + hi + 1))


def _copied(df: DataFrame, pos: str, lo: int, hi: int, chunk: int) -> DataFrame:
    """Rows with ``_chunk``: their own, and neighbours whose frames reach them; ``_own`` marks the first."""
    first = F.greatest(F.lit(0), F.floor((F.col(pos) - hi) / chunk)).cast("long")
    last = F.floor((F.col(pos) + lo) / chunk).cast("long")
    own = F.floor(F.col(pos) / chunk).cast("long")
    return df.withColumn("_chunk", F.explode(F.sequence(first, last))).withColumn("_own", own == F.col("_chunk"))


def halo_window(df: DataFrame, keys: Sequence[str], pos: str, lo: int, hi: int, aggs: dict[str, Column], *,
                chunk: int | None = None) -> DataFrame:
    """Add one column per ``aggs`` entry, each evaluated over the rows whose position lies in
    [pos - lo, pos + hi] of the same series. For short frames: the work is O(frame) a row."""
    out = _copied(df, pos, lo, hi, chunk or chunk_size(lo, hi))
    w = Window.partitionBy(*keys, "_chunk").orderBy(pos).rangeBetween(-lo, hi)
    for name, agg in aggs.items():
        out = out.withColumn(name, agg.over(w))
    return out.where("_own").drop("_own", "_chunk")


def rolling_stats(df: DataFrame, keys: Sequence[str], pos: str, value: str, lo: int, hi: int, *,
                  chunk: int | None = None, prefix: str = "_r") -> DataFrame:
    """Adds count / mean / stddev_samp / max / min ({prefix}_cnt, _mean, _sd, _max, _min) of ``value`` over the
    rows with position in [pos - lo, pos + hi] of the same series.

    The series is cut into blocks of w = lo + hi + 1 positions. A frame is the rest of one block from
    pos - lo on and the start of the next up to pos + hi: the running aggregates backward at the one and
    forward at the other, merged pairwise (means and squared deviations, no differences of sums).
    Missing and infinite values are not in any frame."""
    keys, w = list(keys), lo + hi + 1
    size = max(1, -(-(chunk or chunk_size(lo, hi)) // w)) * w          # whole blocks
    x = F.when(F.abs(F.col(value)) < _INF, F.col(value))
    # a neighbour's whole block comes along, so that its running aggregates are complete
    t = _copied(df, pos, w, w, size).withColumn("_x", x).withColumn("_block", F.floor(F.col(pos) / w))
    part = [*keys, "_chunk"]
    up = Window.partitionBy(*part, "_block").orderBy(pos).rowsBetween(Window.unboundedPreceding, 0)
    down = Window.partitionBy(*part, "_block").orderBy(F.col(pos).desc()).rowsBetween(Window.unboundedPreceding, 0)

    def running(over) -> Column:
        v = F.col("_x")
        return F.struct(F.col("_block").alias("block"), F.count(v).over(over).alias("n"), F.avg(v).over(over).alias("mean"),
                        (F.var_pop(v).over(over) * F.count(v).over(over)).alias("dev"),
                        F.max(v).over(over).alias("max"), F.min(v).over(over).alias("min"))

    t = t.withColumn("_down", running(down)).withColumn("_up", running(up))
    along = Window.partitionBy(*part).orderBy(pos)
    whole = along.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    head = F.lag("_down", lo).over(along) if lo else F.col("_down")
    tail = F.lead("_up", hi).over(along) if hi else F.col("_up")
    t = (t.withColumn("_head", head).withColumn("_tail", tail).withColumn("_end", F.last("_up").over(whole)))
    # the frame may run over the series' end
    t = t.withColumn("_cut", F.col("_tail").isNull()).withColumn("_tail", F.coalesce("_tail", "_end"))
    one = F.col("_head.block") == F.col("_tail.block")
    # the frame in one block: from the series' start, to its end, or a whole block
    alone = (F.when(F.col("_head").isNull(), F.col("_tail")).when(one & F.col("_cut"), F.col("_head")).when(one, F.col("_tail")))
    t = t.withColumn("_alone", alone)
    a, b = F.col("_head"), F.col("_tail")
    n = a["n"] + b["n"]
    gap = b["mean"] - a["mean"]
    both = F.struct(F.lit(0).cast("long").alias("block"), n.alias("n"),
                    F.coalesce(a["mean"] + gap * b["n"] / n, a["mean"], b["mean"]).alias("mean"),
                    (F.coalesce(a["dev"], F.lit(0.0)) + F.coalesce(b["dev"], F.lit(0.0))
                     + F.coalesce(gap * gap * a["n"] * b["n"] / n, F.lit(0.0))).alias("dev"),
                    F.greatest(a["max"], b["max"]).alias("max"), F.least(a["min"], b["min"]).alias("min"))
    t = t.withColumn("_f", F.when(F.col("_alone").isNotNull(), F.col("_alone")).otherwise(both)).where("_own")
    f = F.col("_f")
    return (t.withColumn(f"{prefix}_cnt", f["n"]).withColumn(f"{prefix}_mean", F.when(f["n"] > 0, f["mean"]))
            .withColumn(f"{prefix}_sd", F.when(f["n"] >= 2, F.sqrt(f["dev"] / (f["n"] - 1))))
            .withColumn(f"{prefix}_max", f["max"]).withColumn(f"{prefix}_min", f["min"])
            .drop("_chunk", "_own", "_x", "_block", "_down", "_up", "_head", "_tail", "_end", "_cut", "_alone", "_f"))


# --------------------------------------------------------------------------- percentiles
def exact_percentiles(df: DataFrame, keys: Sequence[str], value: str, probs: Sequence[float], *,
                      names: Sequence[str] | None = None, bucket_rows: int | None = None, n_rows: int | None = None) -> DataFrame:
    """Exact percentiles (linear interpolation, as numpy / SQL quantile_cont), one row per group: ``keys + names``
    (NULL where a group has no valid value). NaN counts as missing.

    A group of few rows is collapsed to (value, count) and ranked. For groups of many rows, one mergeable quantile summary a group
    brackets all wanted ranks at once; one more pass keeps the values inside the brackets and collapses what lies between them
    to a count each, so that few places are left to rank. The counts are exact, and so is the result whatever the
    summary said: a group of which a bracket missed its rank is ranked without brackets.

    ``n_rows``: the number of rows, if known; else they are counted. Groups of few rows are dealt out whole, in
    more partitions the more rows there are."""
    names = list(names or [f"p{int(round(p * 100))}" for p in probs])
    size, v = bucket_rows or BUCKET_ROWS, F.col(value).cast("double")
    if not keys:
        one = exact_percentiles(df.select(v.alias("_x"), F.lit(0).alias("_all")), ["_all"], "_x", probs, names=names, bucket_rows=size, n_rows=n_rows)
        return one.agg(*[F.max(n).alias(n) for n in names])
    keys = list(keys)
    rows = df.select(*keys, F.when(~F.isnan(v), v).alias("_v"))
    large = materialize(rows.groupBy(*keys).agg(F.count("_v").alias("_total")).where(F.col("_total") > size))
    n_large = large.count()
    plain = [F.col("_v").alias("_o"), F.col("_v").isNotNull().alias("_kept")]
    n_rows = df.count() if n_rows is None else n_rows
    if not n_large:
        return _picked(_running(_collapsed(dealt(rows.select(*keys, *plain), n_rows, keys), keys), keys), keys, probs, names)
    few = rows.join(bounded(large, n_large), keys, "left_anti")
    many = rows.where("_v IS NOT NULL").join(bounded(large, n_large), keys)
    found = _picked(_running(_collapsed(dealt(few.select(*keys, *plain), n_rows, keys), keys), keys), keys, probs, names)
    return found.unionByName(_picked(_ranked_places(_bracketed(many, keys, probs, n_large), keys, probs, size), keys, probs, names))


def _ranks(p: float) -> tuple[Column, Column, Column]:
    """The two ranks that a percentile lies between, and how far."""
    h = (F.col("_total") - 1).cast("double") * F.lit(float(p))
    k0 = F.floor(h).cast("long")
    return k0, F.least(k0 + 1, F.col("_total") - 1), h - F.floor(h)


def _holds(probs: Sequence[float], lo: Column, hi: Column) -> Column:
    """Whether ranks lo .. hi hold one that is wanted."""
    wanted = [k for p in probs for k in _ranks(p)[:2]]
    return reduce(lambda a, b: a | b, [(lo <= k) & (k <= hi) for k in wanted])


def _collapsed(rows: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(keys, _o, _kept, _w): equal places in the order once, with their count; a missing value counts nothing."""
    return rows.groupBy(*keys, "_o", "_kept").agg(F.count("_o").alias("_w"))


def _running(counted: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Collapsed groups with their total and the ranks _lo .. _hi of every place."""
    before = Window.partitionBy(*keys).orderBy("_o", "_kept").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.coalesce(F.sum("_w").over(before), F.lit(0))
    return (counted.withColumn("_total", F.sum("_w").over(Window.partitionBy(*keys))).withColumn("_lo", lo)
            .withColumn("_hi", F.col("_lo") + F.col("_w") - 1))


def _ranked_places(counted: DataFrame, keys: list[str], probs: Sequence[float], size: int) -> DataFrame:
    """``_running`` for groups of any number of places: beyond four times ``size`` only pieces of them that hold a wanted
    rank are ranked, each for itself."""
    most = counted.groupBy(*keys).count().agg(F.max("count")).first()[0] or 0
    if most <= 4 * size:
        return _running(counted, keys)
    # what is not kept comes just before the kept place of the same value
    rows, path, _ = pieces(counted.withColumn("_k", F.col("_kept").cast("int")), keys, ["_o", "_k"], size)
    table = rows.groupBy(*keys, *path).agg(F.sum("_w").alias("_w"))
    earlier = Window.partitionBy(*keys).orderBy(*path).rowsBetween(Window.unboundedPreceding, -1)
    table = table.withColumn("_before", F.coalesce(F.sum("_w").over(earlier), F.lit(0))).withColumn(
        "_total", F.sum("_w").over(Window.partitionBy(*keys)))
    table = small_side(table.where(_holds(probs, F.col("_before"), F.col("_before") + F.col("_w") - 1)).drop("_w"))
    inside = Window.partitionBy(*keys, *path).orderBy("_o", "_kept").rowsBetween(Window.unboundedPreceding, -1)
    lo = F.col("_before") + F.coalesce(F.sum("_w").over(inside), F.lit(0))
    return (rows.join(table, [*keys, *path]).withColumn("_lo", lo).withColumn("_hi", F.col("_lo") + F.col("_w") - 1)
            .select(*keys, "_o", "_kept", "_w", "_total", "_lo", "_hi"))


def _picked(ranked: DataFrame, keys: Sequence[str], probs: Sequence[float], names: Sequence[str]) -> DataFrame:
    """The percentiles of ranked groups."""
    aggs = []
    for p, n in zip(probs, names):
        k0, k1, share = _ranks(p)
        for tag, k in (("0", k0), ("1", k1)):
            aggs.append(F.max(F.when((F.col("_lo") <= k) & (k <= F.col("_hi")), F.col("_o"))).alias(f"{n}_{tag}"))
        aggs.append(F.max(share).alias(f"{n}_s"))
    return ranked.groupBy(*keys).agg(*aggs).select(*keys, *[
        F.when(F.col(f"{n}_0") == F.col(f"{n}_1"), F.col(f"{n}_0")).otherwise(
            F.col(f"{n}_0") + F.col(f"{n}_s") * (F.col(f"{n}_1") - F.col(f"{n}_0"))).alias(n) for n in names])


def _bracketed(many: DataFrame, keys: list[str], probs: Sequence[float], groups: int) -> DataFrame:
    """Groups of many rows (keys, _v, _total) collapsed but for the values around their wanted ranks."""
    def bracket(p: float) -> Column:
        """Values around the ranks: a point further on either side than the summary errs."""
        first, last, _ = _ranks(p)
        a = F.floor((first / F.col("_total") - 3.0 / SUMMARY_ACCURACY) * SUMMARY_POINTS).cast("int")
        b = F.ceil(((last + 1) / F.col("_total") + 3.0 / SUMMARY_ACCURACY) * SUMMARY_POINTS).cast("int")
        return F.struct(F.when(a > 0, F.col("_grid")[a]).otherwise(F.lit(-_INF)).alias("a"),
                        F.when(b < SUMMARY_POINTS, F.col("_grid")[b]).otherwise(F.lit(_INF)).alias("b"))

    probs = sorted(probs)
    points = ", ".join(f"{k / SUMMARY_POINTS!r}D" for k in range(SUMMARY_POINTS + 1))
    at = many.groupBy(*keys).agg(F.max("_total").alias("_total"), F.expr(
        f"percentile_approx(_v, array({points}), {SUMMARY_ACCURACY})").alias("_grid"))
    at = materialize(at.select(*keys, "_total", F.array(*map(bracket, probs)).alias("_at")))
    ends = [(F.col("_at")[j]["a"], F.col("_at")[j]["b"]) for j in range(len(probs))]
    x = F.col("_v")
    kept = reduce(lambda p, q: p | q, [(x >= a) & (x <= b) for a, b in ends])
    # what lies below a bracket comes just before it
    below = reduce(lambda w, a: w.when(x < a, a), [a for a, _ in ends], F).otherwise(F.lit(_INF))
    for _ in range(2):
        placed = many.select(*keys, "_v").join(bounded(at, groups), keys).withColumn("_kept", F.coalesce(kept, F.lit(False)))
        order = F.coalesce(F.when(F.col("_kept"), x).otherwise(below), F.lit(_INF))
        counted = materialize(_collapsed(placed.select(*keys, order.alias("_o"), "_kept"), keys))
        o, k, w, sums, missed = F.col("_o"), F.col("_kept"), F.col("_w"), [], []
        for j, (p, (a, b)) in enumerate(zip(probs, ends)):
            sums += [F.sum(F.when((o < a) | ((o == a) & ~k), w).otherwise(0)).alias(f"_u{j}"),
                     F.sum(F.when(k & (o >= a) & (o <= b), w).otherwise(0)).alias(f"_i{j}")]
            first, last, _ = _ranks(p)
            missed.append((first < F.col(f"_u{j}")) | (last >= F.col(f"_u{j}") + F.col(f"_i{j}")))
        checked = counted.join(bounded(at, groups), keys).groupBy(*keys).agg(F.max("_total").alias("_total"), *sums)
        open_ = materialize(checked.where(reduce(lambda p, q: p | q, missed)).select(*keys, F.lit(True).alias("_open")))
        if not open_.count():
            break
        every = F.array(*[F.struct(F.lit(-_INF).alias("a"), F.lit(_INF).alias("b"))] * len(probs))
        at = materialize(at.join(open_, keys, "left").select(*keys, "_total", F.when(F.col("_open"), every).otherwise(F.col("_at")).alias("_at")))
    return counted
