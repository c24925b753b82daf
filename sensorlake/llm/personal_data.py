"""Personal data: base patterns, and a character-level BiLSTM-CRF trained on their spans.

The base patterns give the labelled spans. Windows of 64 characters from a bounded sample of documents
train the tagger in numpy; then every document is decoded in overlapping windows, half a window apart.
Windows are reconciled on characters: each takes its tag from the window in which it lies farthest from an
edge, and spans are read off the joined tags, so a span may be longer than a window. Decoded spans that
overlap no base span and have the least content of their kind are added.

All kinds hold a digit or `@`, so only windows that touch a run of characters without blanks that holds one
are decoded; a text without any is passed over. Equal windows of a batch are decoded once.

Defined results: null and empty texts have no spans; without any training window nothing is added; repeated
rows get equal results; other columns are not read; places are code points, ends exclusive.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import bound_batches, utf8
from sensorlake.llm.tagger import decode, fit

by_value(__name__)

KINDS = ("email", "ip", "card", "phone")
WIDTH, STRIDE = 64, 32
TRAIN_DOCS = 2000
MAX_TRAIN_CHARS = 20_000
TRAIN_WINDOWS = 4000
TRAIN_STEPS = 300

# classes of characters; every other character is class 0
_SINGLE = " \n@.-+()_%:,/=\"'"
N_CLASSES = len(_SINGLE) + 5
N_TAGS = 1 + 2 * len(KINDS)                       # 0 outside, then begin and inside of each kind


# --------------------------------------------------------------------------- base patterns
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")      # runs of digits are taken whole either way
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_NUMBER = re.compile(r"[+(]{0,2}[0-9][\x20()./0-9-]*")     # where it starts is the tagger's to say


def emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches, found from each `@` back to the start of its run."""
    free, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > free and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            yield start, m.end()
            free = m.end()
            at = text.find("@", free)
        else:
            free = at + 1
            at = text.find("@", free)


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(reversed(digits)):
        n = int(d) * (1 + k % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in text.split("."))


def _digits(text: str) -> str:
    return re.sub("[^0-9]", "", text)


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of all base matches, sorted."""
    out = [(a, 0, b) for a, b in emails(text)]
    for m in _IP.finditer(text):
        if _octets(m[0]):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 14 and 14 <= len(d := _digits(m[0])) <= 19 and luhn(d):
            out.append((m.start(), 2, m.end()))
    for m in _PHONE.finditer(text):
        if 10 <= len(_digits(m[0])) <= 15:
            out.append((m.start(), 3, m.end()))
    return sorted(out)


def _has_content(kind: int, text: str) -> bool:
    """The least that a decoded span of a kind must hold."""
    digits = len(_digits(text))
    if kind == 0:
        return re.fullmatch(r"[^\s@]+@[^\s@]+\.[^\s@]+", text) is not None
    if kind == 1:
        return re.fullmatch(r"[0-9]{1,3}(\.[0-9]{1,3}){3}", text) is not None and _octets(text)
    if kind == 2:
        return 14 <= digits <= 19 and luhn(_digits(text))
    return 10 <= digits <= 15 and _NUMBER.fullmatch(text) is not None


# --------------------------------------------------------------------------- windows
def _class_table() -> np.ndarray:
    table = np.zeros(128, np.int8)
    for k, c in enumerate(_SINGLE):
        table[ord(c)] = k + 1
    table[ord("0"):ord("9") + 1] = len(_SINGLE) + 1
    table[ord("a"):ord("z") + 1] = len(_SINGLE) + 2
    table[ord("A"):ord("Z") + 1] = len(_SINGLE) + 3
    return table


_TABLE = _class_table()


def classes_of(text: str) -> np.ndarray:
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(points < 128, _TABLE[np.minimum(points, 127)], len(_SINGLE) + 4).astype(np.int8)


def windows_of(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and classes of the windows that hold a digit or `@`; the last ones are padded."""
    marks = np.flatnonzero((classes == len(_SINGLE) + 1) | (classes == _TABLE[ord("@")])) // STRIDE
    starts = np.unique(np.concatenate([np.maximum(marks - 1, 0), marks])) * STRIDE
    padded = np.concatenate([classes, np.zeros(WIDTH, np.int8)])
    return starts, padded[starts[:, None] + np.arange(WIDTH)]


def _touching(classes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and classes of the windows that touch a run without blanks that holds a digit or `@`."""
    marks = np.flatnonzero((classes == len(_SINGLE) + 1) | (classes == _TABLE[ord("@")]))
    blank = np.flatnonzero((classes == _TABLE[ord(" ")]) | (classes == _TABLE[ord("\n")]))
    after = np.searchsorted(blank, marks)
    edges = np.concatenate([[-1], blank, [len(classes)]])
    steps = np.zeros(len(classes) // STRIDE + 2, np.int64)
    np.add.at(steps, np.maximum((edges[after] + 1) // STRIDE - 1, 0), 1)
    np.add.at(steps, (edges[after + 1] - 1) // STRIDE + 1, -1)
    starts = np.flatnonzero(np.cumsum(steps) > 0) * STRIDE
    padded = np.concatenate([classes, np.zeros(WIDTH, np.int8)])
    return starts, padded[starts[:, None] + np.arange(WIDTH)]


def _joined(starts: np.ndarray, tags: np.ndarray, n: int) -> np.ndarray:
    """A tag for each of ``n`` characters, from the window in which it lies farthest from an edge."""
    half = STRIDE // 2
    block = starts // STRIDE
    out = np.zeros((n // STRIDE + 2, STRIDE), np.int8)
    out[block + 1] = tags[:, STRIDE:]
    out[block, half:] = tags[:, half:STRIDE]
    alone = ~np.isin(block - 1, block)
    out[block[alone], :half] = tags[alone, :half]
    return out.ravel()[:n]


def _tags_of(n: int, spans: list[tuple[int, int, int]]) -> np.ndarray:
    tags = np.zeros(n + WIDTH, np.int8)
    for a, kind, b in sorted(spans, key=lambda s: s[2] - s[0]):
        tags[a:b] = 2 + 2 * kind
        tags[a] = 1 + 2 * kind
    return tags


def _training_windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        xs, ys = [], []
        for text in batch.column("t").to_pylist():
            classes = classes_of(text)
            starts, x = windows_of(classes)
            y = _tags_of(len(classes), base_spans(text))[starts[:, None] + np.arange(WIDTH)]
            xs += [row.tobytes() for row in x]
            ys += [row.tobytes() for row in y]
        yield pa.RecordBatch.from_arrays([pa.array(xs, pa.binary()), pa.array(ys, pa.binary())], ["x", "y"])


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", train_docs: int = TRAIN_DOCS,
          train_windows: int = TRAIN_WINDOWS, steps: int = TRAIN_STEPS) -> dict | None:
    """Tagger weights from about ``train_docs`` documents (by a hash of id and text, so that null and repeated ids do not
    stand or fall together) of at most ``MAX_TRAIN_CHARS`` characters, and at most ``train_windows`` different windows of
    them. None only where no such document holds a digit or ``@``."""
    rows = docs.where(F.col(text_col).rlike("[0-9@]") & (F.length(text_col) <= MAX_TRAIN_CHARS))
    n = rows.count()
    limit = 1 << 20
    draw = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("pii"))

    def windows_in(some: DataFrame) -> pa.Table:
        return (some.select(F.col(text_col).alias("t")).distinct().mapInArrow(_training_windows, "x binary, y binary").distinct()
                .orderBy(F.xxhash64("x", "y"), "x", "y").limit(train_windows).toArrow())

    windows = windows_in(rows.where(F.pmod(draw, F.lit(limit)) / limit < min(1.0, train_docs / max(n, 1))))
    if n and not windows.num_rows:                  # rows alike, none of which was drawn
        windows = windows_in(rows.orderBy(draw, text_col).limit(1))
    if not windows.num_rows:
        return None
    x, y = (np.frombuffer(b"".join(windows.column(c).to_pylist()), np.int8).reshape(-1, WIDTH).astype(np.int64)
            for c in "xy")
    return fit(x, y, N_CLASSES, N_TAGS, steps)


def _forbidden() -> np.ndarray:
    """An inside tag follows only a begin or inside of its kind."""
    out = np.zeros((N_TAGS, N_TAGS), bool)
    for kind in range(len(KINDS)):
        inside = 2 + 2 * kind
        out[:, inside] = True
        out[[inside - 1, inside], inside] = False
    return out


def _runs(tags: np.ndarray) -> Iterator[tuple[int, int, int]]:
    """(start, kind, end) of the spans in a sequence of tags."""
    kind = (tags.astype(np.int64) - 1) // 2                  # -1 outside
    before = np.concatenate([[-1], kind[:-1]])
    begins = (kind >= 0) & ((tags % 2 == 1) | (before != kind))
    edges = np.flatnonzero(begins | ((kind < 0) & (before >= 0)))
    for a, b in zip(edges, [*edges[1:], len(tags)]):
        if kind[a] >= 0:
            yield int(a), int(kind[a]), int(b)


def _clear_of(found: list[tuple[int, int, int]], taken: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """Found spans that overlap none of the taken ones (sorted)."""
    starts = np.array([a for a, _, _ in taken], np.int64)
    reach = np.concatenate([[0], np.maximum.accumulate(np.array([b for _, _, b in taken], np.int64))]) if taken else [0]
    return [(a, kind, b) for a, kind, b in found if reach[int(np.searchsorted(starts, b))] <= a]


def decoded_spans(weights: dict, texts: list[str], bases: list[list[tuple[int, int, int]]]) -> list[list[tuple[int, int, int]]]:
    """Spans that the tagger adds to each text."""
    starts, rows, owner = [], [], []
    for k, text in enumerate(texts):
        s, x = _touching(classes_of(text))
        starts.append(s), rows.append(x), owner.append(np.full(len(s), k))
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    every = np.concatenate(rows) if rows else np.zeros((0, WIDTH), np.int8)
    if not len(every):
        return out
    own = np.concatenate(owner)
    _, first, back = np.unique(every, axis=0, return_index=True, return_inverse=True)
    tags = np.concatenate([decode(weights, every[first[a:a + 2048]].astype(np.int64), _forbidden())
                           for a in range(0, len(first), 2048)])[back.ravel()]
    first_row = np.concatenate([[0], np.cumsum([len(x) for x in starts])])
    for k in np.unique(own[tags.any(axis=1)]):
        joined = _joined(starts[k], tags[first_row[k]:first_row[k + 1]], len(texts[k]))
        out[k] = _clear_of([x for x in _runs(joined) if _has_content(x[1], texts[k][x[0]:x[2]])], bases[k])
    return out


SPANS = T.StructType([T.StructField("base", T.ArrayType(T.StringType())), T.StructField("spans", T.ArrayType(T.StringType()))]
                     + [T.StructField(f"n_{k}", T.LongType()) for k in KINDS])
_ARROW = pa.struct([("base", pa.list_(pa.string())), ("spans", pa.list_(pa.string()))]
                   + [(f"n_{k}", pa.int64()) for k in KINDS])


def _written(spans: list[tuple[int, int, int]]) -> list[str]:
    return [f"{KINDS[kind]}:{a}:{b}" for a, kind, b in sorted(spans)]


def find_personal(docs: DataFrame, weights: dict | None, text_col: str = "text", out: str = "personal") -> DataFrame:
    """``docs`` with a struct column: base and spans (all), as `kind:start:end` in order, and n_email,
    n_ip, n_card, n_phone (of the base spans)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(SPANS)
    def scan(column: pa.Array) -> pa.Array:
        raw, offsets = utf8(column)
        marked = np.flatnonzero(((raw >= 48) & (raw <= 57)) | (raw == 64))
        has = np.searchsorted(marked, offsets)
        which = np.flatnonzero(has[1:] > has[:-1])
        texts = [column[int(k)].as_py() for k in which]
        bases = [base_spans(t) for t in texts]
        added = decoded_spans(shared.value, texts, bases) if shared.value else [[] for _ in texts]
        rows = [{"base": [], "spans": [], **{f"n_{k}": 0 for k in KINDS}} for _ in range(len(column))]
        for k, base, more in zip(which, bases, added):
            rows[k] = {"base": _written(base), "spans": _written(base + more),
                       **{f"n_{kind}": sum(s[1] == x for s in base) for x, kind in enumerate(KINDS)}}
        return pa.array(rows, _ARROW)

    return docs.withColumn(out, scan(F.col(text_col)))
