"""Packing of tokenised documents into windows by non-negative least squares.

1. Documents are tokenised (byte-level BPE, end id 1) and cut into full windows and one rest.
2. The histogram of piece lengths, in bins of 8 tokens, goes to the driver (257 rows at most).
   Every combination of up to three bins that fills a window is a strategy; non-negative
   least squares (active sets) finds how often each is used so that the uses meet the histogram.
3. Repeat counts are rounded, never beyond the pieces there are. Every piece gets its rank in its
   bin (counts by bucket, running sums, numbering within small buckets), and ranks are dealt to the
   strategies' places, so sequences are formed without gathering anything.
4. Pieces left over are packed greedily, longest first, in groups of bounded size; a piece may be
   cut there at a multiple of 64 tokens, so that any length histogram packs tightly. Checksums of
   cut pieces follow from running checksums, the ids themselves are never shuffled.

Defined results: null and empty texts are one token (the end id); repeated rows are packed
once each; an empty table gives no pieces; a null id stays null; other columns are not read.
"""

from __future__ import annotations

import base64
import itertools
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import bound_batches, written

by_value(__name__)

WINDOW = 2048
END_ID = 1
BIN = 8
DEPTH = 3
#: Cuts of left-over pieces are at multiples of this many tokens.
GRID = 64
#: Pieces numbered together, and left-over pieces packed together.
BUCKET_ROWS = 20_000
GROUP_ROWS = 1024


# --------------------------------------------------------------------------- tokens and pieces
def _encoder(vocabulary: str):
    """text -> ids. The fast library reads the same vocabulary; texts it gives up on
    (over-long runs of white space) go to the other one, with the same ids."""
    import public_tokenizers
    import tiktoken

    with open(public_tokenizers.path(f"{vocabulary}.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    end = "<|endoftext|>"
    fast = tiktoken.Encoding(vocabulary, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks,
                             special_tokens={end: len(ranks)})
    slow = []

    def encode(text: str) -> np.ndarray:
        try:
            return fast.encode_to_numpy(text, allowed_special="all")
        except ValueError:
            if not slow:
                from tokenizers import Tokenizer
                slow.append(Tokenizer.from_file(public_tokenizers.path(f"{vocabulary}.json")))
            return np.array(slow[0].encode(text, add_special_tokens=False).ids, np.uint32)
    return encode


def _pieces(vocabulary: str, window: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    encode = _encoder(vocabulary)
    for batch in batches:
        start, length, total, row, marks, sums = [], [], [], [], [], []
        for k, text in enumerate(batch.column("t")):
            ids = np.append(encode(text.as_py() or ""), END_ID).astype("<u4")
            for a in range(0, len(ids), window):
                body = ids[a:a + window].tobytes()
                crc, marked = 0, []
                for x in range(0, len(body), 4 * GRID):
                    crc = zlib.crc32(body[x:x + 4 * GRID], crc)
                    marked.append(crc)
                row.append(k), start.append(a), length.append(len(body) // 4), total.append(len(ids)), sums.append(crc)
                marks.append(np.array(marked, "<u4").tobytes())
        yield pa.RecordBatch.from_arrays(
            [batch.column("d").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()),
             pa.array(length, pa.int64()), pa.array(sums, pa.int64()), pa.array(total, pa.int64()),
             pa.array(marks, pa.binary())],
            ["d", "start", "length", "ids_crc32", "doc_tokens", "marks"])


# --------------------------------------------------------------------------- strategies
def combinations(bins: int, depth: int = DEPTH) -> list[tuple[int, ...]]:
    """Multisets of up to ``depth`` bins (1 .. bins) that sum to ``bins``, longest first inside."""
    found = [(bins,)]
    for size in range(2, depth + 1):
        for head in itertools.combinations_with_replacement(range(1, bins), size - 1):
            last = bins - sum(head)
            if last >= head[-1]:
                found.append((last, *reversed(head)))
    return found


def least_squares(matrix: np.ndarray, target: np.ndarray) -> np.ndarray:
    """min |matrix x - target| with x >= 0, by active sets: a basic solution."""
    n = matrix.shape[1]
    x, basis = np.zeros(n), np.zeros(n, bool)
    small = 1e-9 * max(1.0, float(np.abs(target).max(initial=0)))
    for _ in range(3 * matrix.shape[0]):
        slope = matrix.T @ (target - matrix @ x)
        slope[basis] = -np.inf
        best = int(slope.argmax())
        if slope[best] <= small:
            break
        basis[best] = True
        while True:
            trial = np.zeros(n)
            trial[basis] = np.linalg.lstsq(matrix[:, basis], target, rcond=None)[0]
            bad = basis & (trial <= 0)
            if not bad.any():
                x = trial
                break
            move = x[bad] / np.maximum(x[bad] - trial[bad], 1e-300)
            x = x + float(move.min()) * (trial - x)
            basis &= x > small
            x[~basis] = 0
            if not basis.any():
                break
    return x


def plan(histogram: dict[int, int], bins: int) -> list[tuple[tuple[int, ...], int]]:
    """(strategy, repeats) for a histogram of pieces by bin, within what is there."""
    strategies = [s for s in combinations(bins) if all(histogram.get(b) for b in s)]
    if not strategies:
        return []
    rows = sorted({b for s in strategies for b in s})
    at = {b: k for k, b in enumerate(rows)}
    matrix = np.zeros((len(rows), len(strategies)))
    for k, s in enumerate(strategies):
        for b in s:
            matrix[at[b], k] += 1
    weight = np.sqrt(np.array(rows, float))[:, None]      # long pieces are hard to place elsewhere
    target = np.array([histogram[b] for b in rows], float)
    x = least_squares(matrix * weight, target * weight.ravel())
    rest, chosen = dict(histogram), []
    for k in np.argsort(-x, kind="stable"):
        s = strategies[k]
        times = min(round(x[k]), *(rest[b] // s.count(b) for b in s))
        if times > 0:
            chosen.append((s, times))
            for b in s:
                rest[b] -= times
    return chosen


# --------------------------------------------------------------------------- checksums of cut pieces
_POLY = 0xEDB88320


def _times(a: int, b: int) -> int:
    """Product of two polynomials modulo the checksum's, bits reflected."""
    out, bit = 0, 1 << 31
    while bit:
        if a & bit:
            out ^= b
        b = (b >> 1) ^ _POLY if b & 1 else b >> 1
        bit >>= 1
    return out


def crc_of_tail(whole: int, head: int, tail_bytes: int) -> int:
    """Checksum of the tail from those of the whole and of its head."""
    power, square, n = 1 << 31, 1 << 23, tail_bytes           # 1, and x^8: one byte
    while n:
        if n & 1:
            power = _times(square, power)
        square = _times(square, square)
        n >>= 1
    return whole ^ _times(power, head)


# --------------------------------------------------------------------------- left-over pieces
def _greedy(window: int, base: int, pieces: pd.DataFrame) -> pd.DataFrame:
    """Packs a group: longest first into a sequence, then the longest that fits, then a cut one."""
    pieces = pieces.sort_values(["length", "d", "start"], kind="stable").reset_index(drop=True)
    marks = [np.frombuffer(m, "<u4") for m in pieces["marks"]]
    start, length = pieces["start"].to_numpy(), pieces["length"].to_numpy()
    waiting = [(int(n), k, 0) for k, n in enumerate(length)]              # (length, piece, tokens cut off before)
    sequence = base + int(pieces["group"].iloc[0]) * (1 << 32)
    rows, offset = [], 0

    def crc(k: int, a: int, b: int) -> int:
        whole = int(marks[k][-(-b // GRID) - 1])
        return whole if a == 0 else crc_of_tail(whole, int(marks[k][a // GRID - 1]), 4 * (b - a))

    def place(k: int, a: int, n: int) -> None:
        nonlocal offset
        rows.append((k, start[k] + a, n, crc(k, a, a + n), sequence, offset))
        offset += n

    while waiting:
        free = window - offset
        at = bisect_right(waiting, (free, len(length), window)) - 1
        if at >= 0:
            n, k, a = waiting.pop(at)
            place(k, a, n)
        else:
            part = free // GRID * GRID
            if part:
                n, k, a = waiting.pop(0)                                  # the shortest, still longer than the gap
                place(k, a, part)
                rest = (n - part, k, a + part)
                waiting.insert(bisect_right(waiting, rest), rest)
            sequence, offset = sequence + 1, 0
        if offset == window:
            sequence, offset = sequence + 1, 0
    k, at, n, sums, seq, off = zip(*rows)
    return pd.DataFrame({"d": pieces["d"].to_numpy()[list(k)], "start": at, "length": n, "ids_crc32": sums,
                         "doc_tokens": pieces["doc_tokens"].to_numpy()[list(k)], "sequence_id": seq, "offset": off})


# --------------------------------------------------------------------------- the operator
def _ranked(pieces: DataFrame, rows: int) -> DataFrame:
    """``pieces`` with their rank (0-based) in their bin."""
    buckets = max(1, -(-rows // BUCKET_ROWS)) * 64
    dealt = pieces.withColumn("bucket", F.pmod(F.xxhash64("d", "start", "doc_tokens", "ids_crc32", "row"), F.lit(buckets)))
    before = (dealt.groupBy("bin", "bucket").count()
              .select(F.col("bin").alias("of_bin"), F.col("bucket").alias("of_bucket"),
                      (F.sum("count").over(Window.partitionBy("bin").orderBy("bucket")) - F.col("count")).alias("before")))
    inside = Window.partitionBy("bin", "bucket").orderBy("d", "start", "doc_tokens", "ids_crc32", "row")
    return (dealt.withColumn("inside", F.row_number().over(inside) - 1)
            .join(before, (F.col("bin") == F.col("of_bin")) & (F.col("bucket") == F.col("of_bucket")))
            .withColumn("rank", F.col("before") + F.col("inside"))
            .select("d", "start", "length", "ids_crc32", "doc_tokens", "marks", "bin", "rank"))


def _small(spark: SparkSession, rows: list[tuple], **columns: pa.DataType) -> DataFrame:
    """A few rows as a local relation, by Arrow: rows of Python objects would start Python workers on every executor."""
    return spark.createDataFrame(pa.Table.from_pylist([dict(zip(columns, r)) for r in rows], pa.schema(columns.items())))


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         vocabulary: str = "byte_bpe_50k") -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    ``window`` is a multiple of ``GRID``.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    own = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))
    id_type = own.schema["d"].dataType.simpleString()
    pieces = own.mapInArrow(partial(_pieces, vocabulary, window),
                            f"d {id_type}, start long, length long, ids_crc32 long, doc_tokens long, marks binary")
    # a number of the row, stored, deals pieces equal in all else over the buckets
    pieces = written(pieces.withColumn("bin", F.ceil(F.col("length") / BIN).cast("int"))
                     .withColumn("row", F.monotonically_increasing_id()), "pieces")

    bins = window // BIN
    histogram = {r["bin"]: r["count"] for r in pieces.groupBy("bin").count().collect()}    # one row a bin
    used: dict[int, int] = {}
    places, next_id = [], 0
    for strategy, times in plan(histogram, bins):
        for slot, b in enumerate(strategy):
            lo = used.get(b, 0)
            places.append((b, lo, lo + times, next_id - lo, slot, len(strategy)))
            used[b] = lo + times
        next_id += times
    rest = {b: n - used.get(b, 0) for b, n in histogram.items()}
    before = dict(zip(sorted(rest), itertools.accumulate([0, *(rest[b] for b in sorted(rest))])))
    groups = max(1, -(-sum(rest.values()) // GROUP_ROWS))

    ranked = written(_ranked(pieces, sum(histogram.values())), "ranked")
    # a few rows for each strategy in use: at most three times the number of bins
    where = F.broadcast(_small(spark, places, of_bin=pa.int32(), lo=pa.int64(), hi=pa.int64(), shift=pa.int64(),
                               slot=pa.int32(), slots=pa.int32()))
    placed = (ranked.drop("marks")
              .join(where, (F.col("bin") == F.col("of_bin")) & (F.col("rank") >= F.col("lo"))
                    & (F.col("rank") < F.col("hi")))
              .withColumn("sequence_id", F.col("rank") + F.col("shift")))
    cols = ["d", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
    single = placed.where("slots = 1").withColumn("offset", F.lit(0).cast("long")).select(cols)
    order = Window.partitionBy("sequence_id").orderBy("slot")
    several = placed.where("slots > 1").withColumn(
        "offset", F.sum("length").over(order) - F.col("length")).select(cols)

    counts = F.broadcast(_small(spark, [(b, used.get(b, 0), before[b] - used.get(b, 0)) for b in sorted(rest)],
                                of_bin=pa.int32(), used=pa.int64(), shift=pa.int64()))
    left = (ranked.join(counts, F.col("bin") == F.col("of_bin")).where("rank >= used")
            .withColumn("group", F.pmod(F.col("rank") + F.col("shift"), F.lit(groups))))
    schema = T.StructType([T.StructField("d", own.schema["d"].dataType)]
                          + [T.StructField(c, T.LongType()) for c in cols[1:]])

    def greedy_group(group: pd.DataFrame) -> pd.DataFrame:
        return _greedy(window, 1 << 62, group)

    greedy = left.select("group", "d", "start", "length", "doc_tokens", "marks").groupBy("group").applyInPandas(
        greedy_group, schema)
    return single.unionByName(several).unionByName(greedy).withColumnRenamed("d", "doc_id")

