"""Partitions of groupings that hold whole groups: their number follows the rows."""

from __future__ import annotations

import re

from pyspark.sql import functions as F

from sensorlake.operators import resample as rs
from sensorlake.plans import ranking


def test_many_recordings_more_partitions(spark, monkeypatch):
    def weekly():
        start = F.expr("timestamp_ntz'2024-01-01 00:00:00'")
        x = F.explode(F.array(F.struct(F.lit("a").alias("channel"), (F.col("id") % 7).cast("double").alias("value"))))
        r = spark.range(2000).select((F.col("id") % 40).alias("dataset_id"), F.timestamp_add("HOUR", F.col("id").cast("int"), start).alias("ts"),
                                     F.col("id").alias("rid"), x.alias("x"))
        r = r.select("dataset_id", "x.channel", "ts", "rid", "x.value")
        return rs.resample_aggs(r, "weekly", ["mean", "median"], keys=["dataset_id", "channel"], frame_keys=["dataset_id"])

    plain = sorted(weekly().collect())
    session = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = 2000 // (3 * session)
    monkeypatch.setattr(ranking, "PARTITION_ROWS", rows)
    many = weekly()
    numbers = [int(n) for n in re.findall(r"hashpartitioning\([^)]*, (\d+)\), REPARTITION_BY_NUM",
                                          many._jdf.queryExecution().executedPlan().toString())]
    assert numbers and set(numbers) == {-(-2000 // rows)}
    assert sorted(many.collect()) == plain and len(plain) > 400
