"""The shared test tables seen as sensor recordings (FIXTURES.md §B).

Each builder has a DuckDB twin in ``sensorlake.oracle`` written from the same
definition, so a query and its oracle read identical inputs.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.functions.numeric import nan_to_null

# Event type -> channel alias (so that families are exercised),
# listed in channel (column) order.
EVENT_CHANNELS = [
    ("click", "LVDT1"),
    ("view", "Tilt4"),
    ("error", "Thermocouple1"),
    ("purchase", "Strain_A"),
    ("signup", "VWP1"),
]
EVENT_CHANNEL_NAMES = [a for _e, a in EVENT_CHANNELS]
LINEITEM_CHANNELS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
LINEITEM_ORDER = ["ts", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _alias(col: str):
    e = None
    for src, dst in EVENT_CHANNELS:
        e = F.when(F.col(col) == src, F.lit(dst)) if e is None else e.when(F.col(col) == src, F.lit(dst))
    return e.otherwise(F.col(col))


def _ordinal(col: str):
    e = None
    for i, (src, _dst) in enumerate(EVENT_CHANNELS):
        e = F.when(F.col(col) == src, F.lit(i)) if e is None else e.when(F.col(col) == src, F.lit(i))
    return e.otherwise(F.lit(len(EVENT_CHANNELS)))


def events_long(spark: SparkSession, sf_dir: str, *, with_ordinal: bool = False) -> DataFrame:
    """B1 readings: channel = aliased event_type, ts, rid = event_id, value."""
    ev = table(spark, sf_dir, "events")
    cols = [_alias("event_type").alias("channel"), F.col("ts"), F.col("event_id").alias("rid"),
            nan_to_null("value").alias("value")]
    if with_ordinal:
        cols.append(_ordinal("event_type").cast("int").alias("ordinal"))
    return ev.select(*cols)


def events_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B2 wide recording: one column per channel, NULL where another type fired."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("ts"), F.col("event_id").alias("rid"), *[
        F.when(F.col("event_type") == src, nan_to_null("value")).alias(dst) for src, dst in EVENT_CHANNELS])


def lineitem_wide(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ts = l_shipdate, tie order l_orderkey, l_linenumber, l_partkey, l_suppkey."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(F.col("l_shipdate").alias("ts"), "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey",
                     *[nan_to_null(c).alias(c) for c in LINEITEM_CHANNELS])


def lineitem_masked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """l_quantity missing where l_partkey%3=0, l_extendedprice where l_suppkey%4=0."""
    w = lineitem_wide(spark, sf_dir)
    return (w.withColumn("l_quantity", F.when(F.col("l_partkey") % 3 != 0, F.col("l_quantity")))
            .withColumn("l_extendedprice", F.when(F.col("l_suppkey") % 4 != 0, F.col("l_extendedprice"))))


def orders_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """B5 readings: one channel o_totalprice over several years."""
    o = table(spark, sf_dir, "orders")
    return o.select(F.lit("o_totalprice").alias("channel"), F.col("o_orderdate").alias("ts"),
                    F.col("o_orderkey").alias("rid"), nan_to_null("o_totalprice").alias("value"))


def load_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A4 load records: one record per user, samples in (ts, event_id) order, load = value."""
    ev = table(spark, sf_dir, "events")
    return ev.select(F.col("user_id").alias("record_id"), "ts", F.col("event_id").alias("rid"),
                     nan_to_null("value").alias("load"))


def supplier_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Many recordings: the quantities of every supplier (``dataset_id``)."""
    # a melted column, so that the channel is a value of the row (a constant would be taken out of groupings, not of partitionings)
    reading = F.struct(F.lit("l_quantity").alias("channel"), nan_to_null("l_quantity").cast("double").alias("value"))
    melted = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_shipdate", "l_orderkey", F.explode(F.array(reading)).alias("r"))
    return melted.select(F.col("l_suppkey").alias("dataset_id"), "r.channel", F.col("l_shipdate").alias("ts"),
                         F.col("l_orderkey").alias("rid"), "r.value")
