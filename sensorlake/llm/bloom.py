"""Bloom filters as small tables: built by grouping, probed by a join with a bounded broadcast.

A filter of ``cells`` bits is a table of words (word, bits) of 64 cells each, so its
broadcast has ``cells / 64`` rows at most, whatever went into it. A fuller filter
lets more through; what it lets through is always checked exactly afterwards.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import hidden

#: Cells at most: 2^24 cells are 2^18 words, about 4 MB.
MAX_CELLS = 1 << 24
CELLS_PER_ENTRY = 16


def cells_for(entries: int, max_cells: int = MAX_CELLS) -> int:
    cells = 1 << 10
    while cells < min(entries * CELLS_PER_ENTRY, max_cells):
        cells *= 2
    return cells


def two_cells(h: str, cells: int) -> list[Column]:
    """Two cells of a 64-bit hash, from disjoint bits."""
    return [F.pmod(F.col(h), F.lit(cells)), F.pmod(F.shiftrightunsigned(h, 32), F.lit(cells))]


def packed(cell_rows: DataFrame) -> DataFrame:
    """(cell) rows as words: (word, bits)."""
    return (cell_rows.select(F.shiftright("cell", 6).alias("word"),
                             F.expr("shiftleft(1L, cast(cell & 63 as int))").alias("bit"))
            .groupBy("word").agg(F.bit_or("bit").alias("bits")))


def filter_of(hashes: DataFrame, h: str, cells: int) -> DataFrame:
    """The filter of the hashes in column ``h``."""
    return packed(hashes.select(F.explode(F.array(*two_cells(h, cells))).alias("cell")))


def probe(df: DataFrame, h: str, words: DataFrame, cells: int, out: str) -> DataFrame:
    """``df`` with a boolean column: both cells of column ``h`` are set."""
    names = {x: hidden(df, f"{out}_{x}") for x in ("c0", "w0", "b0", "c1", "w1", "b1")}
    hit = F.lit(True)
    for k, cell in enumerate(two_cells(h, cells)):
        c, w, b = (names[f"{x}{k}"] for x in "cwb")
        part = F.broadcast(words.select(F.col("word").alias(w), F.col("bits").alias(b)))
        df = df.withColumn(c, cell).join(part, F.shiftright(c, 6) == F.col(w), "left")
        hit = hit & (F.coalesce(F.expr(f"shiftright(`{b}`, cast(`{c}` & 63 as int)) & 1L"), F.lit(0)) == 1)
    return df.withColumn(out, hit).drop(*names.values())
