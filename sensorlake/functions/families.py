"""Sensor families: classify a channel by its name, label, unit, rank.

The family table is a small dimension; classification is a column expression so
it runs over any listing of channel names (a whole catalog of recordings).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

# ---------------------------------------------------------------------------
# Fixed values (must equal the original application's family definitions):
# family id, label, unit, name patterns (searched in the lower-cased name,
# first family in this order wins; no pattern -> "other").
FAMILIES = [
    ("lvdt", "LVDT (Displacement)", "mm", [r"\blvdt", r"\bdispl"]),
    ("tilt", "Tiltmeter", "°", [r"\btilt", r"\binclin"]),
    ("thermo", "Thermocouple", "°C", [r"\btherm", r"\btemp"]),
    ("strain", "Strain Gauge", "µε", [r"\bstrain", r"\bgauge"]),
    ("vw", "Vibrating Wire", "Hz", [r"\bvw", r"\bvib"]),
    ("press", "Pressure", "kPa", [r"\bpress", r"\bbar"]),
    ("other", "Other", "", []),
]
# ---------------------------------------------------------------------------

FAMILY_IDS = [f[0] for f in FAMILIES]


def family_of(name: Column | str, families: Sequence[tuple] = FAMILIES) -> Column:
    """Family id of a channel-name column; a name that fits none is `other`."""
    low = F.lower(F.col(name) if isinstance(name, str) else name)
    expr = None
    for fid, _label, _unit, pats in families:
        if not pats:
            continue
        cond = low.rlike("|".join(pats))
        expr = F.when(cond, F.lit(fid)) if expr is None else expr.when(cond, F.lit(fid))
    return F.lit("other") if expr is None else expr.otherwise(F.lit("other"))


def family_table(spark: SparkSession) -> DataFrame:
    """families(family, label, unit, family_rank) — 7 rows."""
    rows = [(fid, label, unit, i) for i, (fid, label, unit, _p) in enumerate(FAMILIES)]
    return spark.createDataFrame(rows, "family string, label string, unit string, family_rank int")


def _lookup(fam: Column, pos: int, families: Sequence[tuple] = FAMILIES) -> Column:
    m = F.create_map(*[x for f in families for x in (F.lit(f[0]), F.lit(f[pos]))])
    return F.try_element_at(m, fam)


def classify(names: DataFrame, *, name: str = "channel", ordinal: str = "ordinal",
             keys: list[str] | None = None, families: Sequence[tuple] = FAMILIES) -> DataFrame:
    """Add family, label, unit, family_rank, idx_in_family to a channel listing.

    ``names`` holds one row per channel with its column ``ordinal`` (position in
    the recording). ``keys`` are extra grouping columns (e.g. dataset_id).
    ``families``: (id, label, unit, name patterns) rows in order of precedence, for other
    kinds of sensors. Lookups are map literals (one entry a family): no join.
    """
    keys = keys or []
    fam = family_of(name, families)
    rank = F.create_map(*[x for i, f in enumerate(families) for x in (F.lit(f[0]), F.lit(i))])
    out = (names.withColumn("family", fam)
           .withColumn("label", _lookup(F.col("family"), 1, families))
           .withColumn("unit", _lookup(F.col("family"), 2, families))
           .withColumn("family_rank", F.coalesce(F.try_element_at(rank, F.col("family")), F.lit(len(families)))))
    w = Window.partitionBy(*keys, "family").orderBy(ordinal)
    return out.withColumn("idx_in_family", (F.row_number().over(w) - 1).cast("int"))


def channels_from_names(spark: SparkSession, names: list[str], dataset_id: str | None = None) -> DataFrame:
    """Channels dimension for a wide table's sensor columns (schema metadata, bounded by #columns)."""
    rows = [(n, i) for i, n in enumerate(names)]
    df = spark.createDataFrame(rows, "channel string, ordinal int")
    if dataset_id is not None:
        df = df.withColumn("dataset_id", F.lit(dataset_id))
    return classify(df, keys=["dataset_id"] if dataset_id is not None else None)
