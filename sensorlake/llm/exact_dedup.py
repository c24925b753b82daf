"""Exact duplicates by two-pass Bloom filtering, DataFrame functions only.

Pass one counts the filter cells of every text's 64-bit hash and keeps the cells met
at least twice. Pass two tests every row: a row is possibly repeated only if all its
cells were met twice; such rows alone are shuffled and grouped by SHA-256. All other
rows are certainly unique and pass straight through.

The filter has at most ``MAX_CELLS`` cells, whatever the input (see ``bloom``). A fuller
filter lets more unique rows into the grouping; the result stays the same.

Defined results: null text counts as empty; of equal texts the largest doc_id stays
(a null id is smaller than any other); of repeated rows with equal id and text one
is kept; empty input gives an empty result; other columns are not read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.bloom import MAX_CELLS, cells_for, packed, probe, two_cells
from sensorlake.llm.common import apart, hidden, same, written


def _met_twice(hashes: DataFrame, cells: int) -> DataFrame:
    """The filter of cells that two rows or more met."""
    return packed(hashes.select(F.explode(F.array(*two_cells("h", cells))).alias("cell"))
                  .groupBy("cell").count().where("count > 1"))


def flag_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               max_cells: int = MAX_CELLS) -> DataFrame:
    """One row per document: doc_id, keep_id, group_size, kept, text_sha256."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    own = docs.select(F.col(id_col).alias("doc_id"), text.alias("t"))
    hashes = own.select(F.xxhash64("t").alias("h"))
    cells = cells_for(hashes.count(), max_cells)
    words = written(_met_twice(hashes, cells), "repeated-cells")

    rows = own.select("doc_id", F.unhex(F.sha2("t", 256)).alias("sha"), F.xxhash64("t").alias("h"))
    # ids and digests only, written once: the texts are hashed once and read again by nobody
    rows = written(probe(rows, "h", words, cells, "maybe").select("doc_id", "sha", "maybe"), "digests")

    alone = rows.where("NOT maybe").select(
        "doc_id", F.col("doc_id").alias("keep_id"), F.lit(1).cast("long").alias("group_size"),
        F.lit(True).alias("kept"), "sha")

    each = rows.where("maybe").groupBy("sha", "doc_id").agg(F.count("*").alias("n"))
    group = (rows.where("maybe").groupBy(F.col("sha").alias("s"))
             .agg(F.max("doc_id").alias("keep_id"), F.count("*").alias("group_size")))
    again = (each.join(apart(group), F.col("sha") == F.col("s"))
             .select("doc_id", "keep_id", "group_size", F.explode(F.sequence(F.lit(1), F.col("n"))).alias("i"), "sha")
             .select("doc_id", "keep_id", "group_size",
                     (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("i") == 1)).alias("kept"), "sha"))
    return alone.unionByName(again).select("doc_id", "keep_id", "group_size", "kept",
                                           F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **how) -> DataFrame:
    """``docs`` with one row of each group of equal texts, all columns as they were.

    Rows that are equal in id and text keep one of them.
    """
    key, sha = hidden(docs, "own_key"), hidden(docs, "own_sha")
    df = docs.withColumn(key, F.col(id_col)).withColumn(sha, F.sha2(F.coalesce(F.col(text_col), F.lit("")), 256))
    kept = flag_exact(docs, id_col, text_col, **how).where("kept").select(
        F.col("doc_id").alias("stay_id"), F.col("text_sha256").alias("stay_sha"))
    return (df.join(kept, same(key, "stay_id") & (F.col(sha) == F.col("stay_sha")), "left_semi")
            .dropDuplicates([key, sha]).drop(key, sha))
