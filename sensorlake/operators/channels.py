"""Channel dimension: listing, default picks, axis routing, family counts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sensorlake.functions.families import classify

# Time-column header candidates, in order of preference.
TIME_COLUMN_CANDIDATES = ["timestamp", "time", "date", "datetime", "ts", "column0"]


def channels_of(readings: DataFrame, *, channel: str = "channel", ordinal: str | None = None,
                keys: Sequence[str] = ()) -> DataFrame:
    """Channels dimension of long readings: one row per channel, classified.

    ``ordinal``: a column of the readings giving the channel's position; when
    absent, channels are numbered by name.
    """
    keys = list(keys)
    if ordinal:
        names = readings.groupBy(*keys, channel).agg(F.min(ordinal).cast("int").alias("ordinal"))
    else:
        names = readings.select(*keys, channel).distinct()
        names = names.withColumn("ordinal", (F.row_number().over(
            Window.partitionBy(*keys).orderBy(channel)) - 1).cast("int"))
    if channel != "channel":
        names = names.withColumnRenamed(channel, "channel")
    return classify(names, keys=keys)


def default_channels(channels: DataFrame, *, limit: int = 4, keys: Sequence[str] = ()) -> DataFrame:
    """First channel of each family, families in order of first appearance, at most ``limit``."""
    keys = list(keys)
    first = channels.groupBy(*keys, "family").agg(
        F.min_by("channel", "ordinal").alias("channel"), F.min("ordinal").alias("ordinal"))
    w = Window.partitionBy(*keys).orderBy("ordinal")
    return (first.withColumn("pick", F.row_number().over(w).cast("int"))
            .where(F.col("pick") <= limit).select(*keys, "pick", "channel", "family", "ordinal"))


def axis_route(channels: DataFrame, picked: Sequence[str]) -> DataFrame:
    """Left axis: unit of the first picked channel; everything else right.

    One row per picked channel: pick order, unit, axis, y_left, y_right
    (first other unit in pick order), n_left, n_right.
    """
    order = F.create_map(*[x for i, c in enumerate(picked) for x in (F.lit(c), F.lit(i))])
    p = channels.where(F.col("channel").isin(list(picked))).withColumn("pick", order[F.col("channel")].cast("int"))
    whole = Window.partitionBy()
    p = p.withColumn("y_left", F.min_by("unit", "pick").over(whole))
    p = p.withColumn("axis", F.when(F.col("unit") == F.col("y_left"), "left").otherwise("right"))
    p = p.withColumn("y_right", F.coalesce(F.min_by(F.when(F.col("axis") == "right", F.col("unit")),
                                                    F.when(F.col("axis") == "right", F.col("pick"))).over(whole),
                                           F.lit("")))
    p = p.withColumn("n_left", F.count_if(F.col("axis") == "left").over(whole).cast("long"))
    p = p.withColumn("n_right", F.count_if(F.col("axis") == "right").over(whole).cast("long"))
    return p.select("pick", "channel", "unit", "axis", "y_left", "y_right", "n_left", "n_right")


def family_counts(channels: DataFrame, *, keys: Sequence[str] = ()) -> DataFrame:
    """Channels per family present, in fixed family order."""
    keys = list(keys)
    return (channels.groupBy(*keys, "family", "label", "family_rank")
            .agg(F.count(F.lit(1)).cast("long").alias("n_channels")))


def pick_time_column(columns: DataFrame, *, table: str = "table_name", column: str = "column_name",
                     ordinal: str = "ordinal") -> DataFrame:
    """Per table, the time column chosen by header: exact name match in candidate
    order, then substring match in candidate order, else the first column."""
    low = F.lower(F.col(column))
    exact = None
    sub = None
    for i, cand in enumerate(TIME_COLUMN_CANDIDATES):
        exact = (F.when(low == cand, F.lit(i)) if exact is None else exact.when(low == cand, F.lit(i)))
        sub = (F.when(F.instr(low, cand) > 0, F.lit(100 + i)) if sub is None
               else sub.when(F.instr(low, cand) > 0, F.lit(100 + i)))
    score = F.coalesce(exact, sub, F.lit(1000))
    return (columns.withColumn("_score", score)
            .groupBy(table).agg(F.min_by(F.col(column), F.struct(F.col("_score"), F.col(ordinal))).alias("time_column"),
                                F.min("_score").alias("_s"))
            .select(table, "time_column",
                    F.when(F.col("_s") < 100, "exact").when(F.col("_s") < 1000, "substring")
                    .otherwise("first").alias("rule")))
