"""Helpers shared by the operators: tables in the shared folder, batch bounds, vectorised words.

Text is handled as UTF-8 bytes in numpy arrays taken from Arrow buffers, several
documents at a time, so no Python object is made per word.
"""

from __future__ import annotations

import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sensorlake.functions.shipping import by_value
from sensorlake.session import ensure_checkpoint_dir

by_value(__name__)

BLOCK_BYTES = 1 << 20
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


# --------------------------------------------------------------------------- Spark side
def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the folder named by ``spark.checkpoint.dir``.

    Cuts the lineage: later jobs read the files, also after executors are lost. So the shuffle files of the write go
    with its end, not when the driver happens to collect its garbage.
    """
    spark = df.sparkSession
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/sensorlake/{name}-{uuid.uuid4().hex}"
    was = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if was is None else spark.conf.set(CLEANUP, was)
    return spark.read.schema(df.schema).parquet(path)


def apart(df: DataFrame) -> DataFrame:
    """The rows of a grouping behind an exchange of their own.

    A join on the grouping's key then shuffles both sides, and Spark can split a hot key of the
    other side (it cannot where the grouping's own exchange serves the join).
    """
    return df.hint("rebalance")


def bound_batches(spark: SparkSession, rows: int = 256, size: str = "4m") -> None:
    """Bound an Arrow batch by rows and, where Spark has the setting, by bytes.

    Smaller settings of the session are left as they are.
    """
    conf = spark.conf
    if int(conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")) > rows:
        conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    conf.set("spark.sql.execution.arrow.maxBytesPerBatch", size)


def same(a: str, b: str):
    """Null-safe equality of two columns, as a join condition."""
    return F.col(a).eqNullSafe(F.col(b))


def hidden(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


# --------------------------------------------------------------------------- hashing
def mix(h: np.ndarray) -> np.ndarray:
    """Scramble 64-bit integers (a bijection), element by element."""
    h = h.astype(np.uint64, copy=True)
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def constants(n: int, seed: int) -> np.ndarray:
    """``n`` fixed odd 64-bit integers."""
    base = (np.arange(1, n + 1, dtype=np.uint64) + np.uint64(seed * 1_000_003)) * np.uint64(0x9E3779B97F4A7C15)
    return mix(base) | np.uint64(1)


_BASE = 0xD1342543DE82EF95                    # odd, so that it has an inverse modulo 2^64
_UNBASE = pow(_BASE, -1, 1 << 64)
_BYTE = constants(256, 7)


def _powers(base: int, n: int) -> np.ndarray:
    p = np.full(n, base, dtype=np.uint64)
    if n:
        p[0] = 1
    return np.cumprod(p, dtype=np.uint64)


_pow_cache: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if n <= BLOCK_BYTES:
        if 0 not in _pow_cache:
            _pow_cache[0] = _powers(_BASE, BLOCK_BYTES + 1), _powers(_UNBASE, BLOCK_BYTES + 1)
        return _pow_cache[0]
    return _powers(_BASE, n + 1), _powers(_UNBASE, n + 1)


# --------------------------------------------------------------------------- text as bytes
def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and document offsets of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    n = len(column)
    if n == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset:column.offset + n + 1]
    first, last = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[first:last] if last > first else np.zeros(0, np.uint8)
    return raw, offsets - first


def runs_of_documents(offsets: np.ndarray, limit: int = BLOCK_BYTES):
    """Ranges [i, j) of documents with at most ``limit`` bytes together, or one longer document."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + limit, "right")) - 1)
        yield i, j
        i = j


class Words:
    """Words of several documents: byte ranges, 64-bit hashes, first word of each document."""

    def __init__(self, raw: np.ndarray, offsets: np.ndarray, is_word: np.ndarray):
        low = raw.copy()
        upper = (low >= 65) & (low <= 90)
        low[upper] += 32
        inside = is_word[low]
        before = np.empty(len(inside), bool)
        before[1:] = inside[:-1]
        lengths = np.diff(offsets)
        full = lengths > 0
        before[offsets[:-1][full]] = False
        begins = np.flatnonzero(inside & ~before)
        before[:-1] = inside[1:]
        before[offsets[1:][full] - 1] = False
        ends = np.flatnonzero(inside & ~before) + 1
        self.low, self.start, self.end = low, begins, ends
        self.first = np.searchsorted(begins, offsets)
        self.hash = self._hashes()

    def _hashes(self) -> np.ndarray:
        out = np.empty(len(self.start), np.uint64)
        i = 0
        while i < len(out):
            j = max(i + 1, int(np.searchsorted(self.end, self.start[i] + BLOCK_BYTES, "right")))
            lo, hi = int(self.start[i]), int(self.end[j - 1])
            up, down = _power_tables(hi - lo)
            total = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum(_BYTE[self.low[lo:hi]] * up[:hi - lo], dtype=np.uint64, out=total[1:])
            s, e = self.start[i:j] - lo, self.end[i:j] - lo
            out[i:j] = (total[e] - total[s]) * down[s] + (e - s).astype(np.uint64)
            i = j
        return mix(out)


def byte_class(excluded: list[tuple[int, int]]) -> np.ndarray:
    """True for every byte value outside the given closed ranges."""
    keep = np.ones(256, bool)
    for a, b in excluded:
        keep[a:b + 1] = False
    return keep


# words of decontamination: digits, letters (A-Z folded first) and everything beyond ASCII
ALNUM_WORD = byte_class([(0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F)])
# words of near-duplicate shingles: everything but ASCII white space
SPACED_WORD = byte_class([(0x20, 0x20), (0x09, 0x0D)])
