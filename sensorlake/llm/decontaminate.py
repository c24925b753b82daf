"""Benchmark decontamination with a generalised suffix automaton.

The words of all test items go into one suffix automaton. Documents are streamed
through it: at every word the automaton knows the longest suffix read so far that
occurs in some item. Where that length reaches a window (10 words, or a whole
shorter item) the words of the window are hit. Hit spans are cut from the text;
documents covered beyond a limit are dropped.

Before streaming, a bit table of the items' neighbouring word pairs passes over
stretches that cannot hold a window: every window's pairs are in the table, so
only runs long enough to hold one go through the automaton, and nothing is missed.

Defined results: null or empty text has no words and no hits; null items and items
without words match nothing; equal items all count; items with a null id hit words but
are not listed; repeated rows get equal results; extra columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import ALNUM_WORD, Words, bound_batches, hidden, mix, runs_of_documents, utf8, written

by_value(__name__)

WINDOW = 10
#: Items of one automaton: so many characters at most (an item longer than that is alone).
ITEM_CHARS = 1_000_000
PAIR_BITS = 22

RESULT = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_hit", T.LongType()),
    T.StructField("items", T.ArrayType(T.StringType())),
    T.StructField("spans", T.ArrayType(T.LongType())), T.StructField("clean", T.StringType())])
ARROW = pa.struct([("n_words", pa.int64()), ("n_hit", pa.int64()), ("items", pa.list_(pa.string())),
                   ("spans", pa.list_(pa.int64())), ("clean", pa.string())])


class SuffixAutomaton:
    """Generalised suffix automaton over word sequences.

    ``step`` reads one word: it returns the new state and the length of the longest
    suffix of what was read that occurs in an item.
    """

    def __init__(self):
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]

    def _state(self, length: int, moves: dict[int, int], link: int) -> int:
        self.next.append(moves)
        self.length.append(length)
        self.link.append(link)
        return len(self.length) - 1

    def _split(self, p: int, word: int) -> int:
        """The state after ``p`` on ``word`` whose longest string is one word longer than p's."""
        q = self.next[p][word]
        if self.length[q] == self.length[p] + 1:
            return q
        twin = self._state(self.length[p] + 1, dict(self.next[q]), self.link[q])
        self.link[q] = twin
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = twin
            p = self.link[p]
        return twin

    def add(self, words: list[int]) -> None:
        at = 0
        for w in words:
            if w in self.next[at]:
                at = self._split(at, w)
                continue
            new, p = self._state(self.length[at] + 1, {}, 0), at
            while p >= 0 and w not in self.next[p]:
                self.next[p][w] = new
                p = self.link[p]
            if p >= 0:
                self.link[new] = self._split(p, w)
            at = new

    def step(self, state: int, length: int, word: int) -> tuple[int, int]:
        while state and word not in self.next[state]:
            state = self.link[state]
            length = self.length[state]
        if word in self.next[state]:
            return self.next[state][word], length + 1
        return 0, 0

    def of_length(self, state: int, length: int) -> int:
        """The state of the suffix of ``length`` words of a match at ``state``."""
        while self.length[self.link[state]] >= length:
            state = self.link[state]
        return state


class Matcher:
    """The automaton of the items, with the items of every window."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int = WINDOW):
        column = pa.array([t.decode("utf-8") for _, t in items], pa.string())
        raw, offsets = utf8(column)
        words = Words(raw, offsets, ALNUM_WORD)
        low = words.low.tobytes()
        self.ids: dict[bytes, int] = {}
        self.sam = SuffixAutomaton()
        rows = []
        for k in range(len(items)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            row = [self.ids.setdefault(low[s:e], len(self.ids)) for s, e in zip(words.start[a:b], words.end[a:b])]
            rows.append(row)
            self.sam.add(row)
        self.windows: dict[tuple[int, int], set[int]] = {}
        for k, row in enumerate(rows):
            size = min(window, len(row))
            state = length = 0
            for at, w in enumerate(row):
                state, length = self.sam.step(state, length, w)
                if size and at + 1 >= size:
                    self.windows.setdefault((self.sam.of_length(state, size), size), set()).add(k)
        self.names = [name for name, _ in items]
        self.sizes = sorted({size for _, size in self.windows}, reverse=True)
        self.least = min(self.sizes, default=0)
        self.table = np.zeros(1 << PAIR_BITS, bool)
        for k in range(len(items)):
            a, b = int(words.first[k]), int(words.first[k + 1])
            self.table[self._cells(words.hash[a:b])] = True

    def plain(self) -> dict:
        """The content in built-in types and arrays, for a broadcast that needs no package to read."""
        return vars(self) | {"sam": vars(self.sam)}

    @classmethod
    def of_plain(cls, content: dict) -> "Matcher":
        matcher, sam = cls.__new__(cls), SuffixAutomaton.__new__(SuffixAutomaton)
        vars(sam).update(content["sam"])
        vars(matcher).update(content | {"sam": sam})
        return matcher

    def _cells(self, h: np.ndarray) -> np.ndarray:
        """Cells of single words if some window is one word long, else of neighbouring pairs."""
        if self.least > 1:
            h = h[:-1] * np.uint64(0x9E3779B97F4A7C15) + h[1:]
        return (mix(h) >> np.uint64(64 - PAIR_BITS)).astype(np.int64)

    def runs(self, h: np.ndarray, first: np.ndarray) -> list[tuple[int, int]]:
        """Ranges of words that may hold a window; none crosses a document."""
        if not self.least or len(h) < self.least:
            return []
        pair = 1 if self.least > 1 else 0
        may = np.zeros(len(h) + 1, np.int8)
        may[:len(h) - pair] = self.table[self._cells(h)]
        if pair:                                    # the pair of a document's last word leaves the document
            last = first[1:] - 1
            may[last[last >= 0]] = 0
        edge = np.diff(np.concatenate([np.zeros(1, np.int8), may]))
        start, stop = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        if not pair:                                # single words: cut the runs at documents
            cuts = np.unique(first[1:-1])
            start = np.unique(np.concatenate([start, cuts[may[cuts] == 1]]))
            stop = np.unique(np.concatenate([stop, cuts[(cuts > 0) & (may[np.maximum(cuts - 1, 0)] == 1)]]))
        long = stop - start >= max(1, self.least - pair)
        return [(int(a), int(b) + pair) for a, b in zip(start[long], stop[long])]

    def hits(self, words: Words) -> dict[int, list[tuple[int, int, set[int]]]]:
        """By document: hit word ranges with their items, in order."""
        low, found = words.low, {}
        for a, b in self.runs(words.hash, words.first):
            state = length = 0
            doc = int(np.searchsorted(words.first, a, "right")) - 1
            for at in range(a, b):
                word = self.ids.get(low[words.start[at]:words.end[at]].tobytes())
                if word is None:
                    state = length = 0
                    continue
                state, length = self.sam.step(state, length, word)
                for size in self.sizes:
                    if size <= length and (items := self.windows.get((self.sam.of_length(state, size), size))):
                        found.setdefault(doc, []).append((at + 1 - size, at + 1, items))
        return found


def _merged(ranges: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(ranges):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


def _scan(column: pa.Array, matcher: Matcher) -> pa.Array:
    raw, offsets = utf8(column)
    rows = []
    for i, j in runs_of_documents(offsets):
        base = offsets[i]
        part = raw[base:offsets[j]]
        words = Words(part, offsets[i:j + 1] - base, ALNUM_WORD)
        found = matcher.hits(words)
        for k in range(j - i):
            n = int(words.first[k + 1] - words.first[k])
            if k not in found:
                rows.append({"n_words": n, "n_hit": 0, "items": [], "spans": [], "clean": None})
                continue
            merged = _merged([(a, b) for a, b, _ in found[k]])
            items = {matcher.names[x] for _, _, own in found[k] for x in own}
            at, keep, spans = int(offsets[i + k] - base), [], []
            for a, b in merged:
                keep.append(part[at:int(words.start[a])].tobytes())
                at = int(words.end[b - 1])
                spans += [a - int(words.first[k]), b - int(words.first[k])]
            keep.append(part[at:int(offsets[i + k + 1] - base)].tobytes())
            rows.append({"n_words": n, "n_hit": sum(b - a for a, b in merged),
                         "items": sorted(x for x in items if x is not None), "spans": spans,
                         "clean": b"".join(keep).decode("utf-8")})
    return pa.array(rows, ARROW)


def _item_groups(items: DataFrame, id_col: str, text_col: str, item_chars: int) -> tuple[int, Iterator]:
    """How many groups of bounded size the items make, and the groups; each is fetched alone, when it is asked for.
    Items of one text and one id count once; equal texts of several ids are dealt over the groups."""
    own = items.select(F.col(id_col).cast("string").alias("i"), F.col(text_col).alias("t")).where("t is not null").distinct()
    total = own.agg(F.sum(F.length("t"))).first()[0] or 0
    n = max(1, -(-total // item_chars))
    part = F.pmod(F.xxhash64("i", "t"), F.lit(n))
    return n, ([(r.i, r.t.encode("utf-8")) for r in own.where(part == k).orderBy("i", "t").collect()] for k in range(n))


def scan_for_items(docs: DataFrame, items: DataFrame, text_col: str = "text", item_id: str = "item_id",
                   item_text: str = "text", window: int = WINDOW, item_chars: int = ITEM_CHARS,
                   out: str = "found") -> DataFrame:
    """``docs`` with a struct column: n_words, n_hit, items (ids as sorted strings),
    spans (hit word ranges: start, end, start, end ...) and clean (the text without hit spans; null
    where nothing is hit).

    The automaton is broadcast. It holds at most ``item_chars`` characters of items; larger
    benchmarks are read in several groups, one pass over the documents each, with the
    table written between passes. Text cut by one group is read by the next as it was.
    """
    spark = docs.sparkSession
    bound_batches(spark)
    n, groups = _item_groups(items, item_id, item_text, item_chars)
    result = None
    names = []
    for k, group in enumerate(groups):
        matcher = spark.sparkContext.broadcast(Matcher(group, window).plain())

        @F.arrow_udf(RESULT)
        def scan(texts: pa.Array) -> pa.Array:
            return _scan(texts, Matcher.of_plain(matcher.value))

        name = out if n == 1 else hidden(result or docs, f"{out}_{k}")
        # nondeterministic to the optimizer: a filter on the result is not pushed below it, which would scan the texts twice
        result = (result if result is not None else docs).withColumn(name, scan.asNondeterministic()(F.col(text_col)))
        names.append(name)
        if n > 1:
            result = written(result, "decontaminate")
    if len(names) > 1:
        @F.arrow_udf(RESULT)
        def join(texts: pa.Array, *parts: pa.Array) -> pa.Array:
            return _combined(texts, parts)

        result = result.withColumn(out, join.asNondeterministic()(F.col(text_col), *[F.col(n) for n in names])).drop(*names)
    return result


def _combined(texts: pa.Array, parts) -> pa.Array:
    rows, columns = [], [p.to_pylist() for p in parts]
    for text, *found in zip(texts.to_pylist(), *columns):
        spans = _merged([(f["spans"][x], f["spans"][x + 1]) for f in found for x in range(0, len(f["spans"]), 2)])
        clean = None
        if spans:
            raw = np.frombuffer(text.encode("utf-8"), np.uint8)
            words = Words(raw, np.array([0, len(raw)]), ALNUM_WORD)
            at, keep = 0, []
            for a, b in spans:
                keep.append(raw[at:int(words.start[a])].tobytes())
                at = int(words.end[b - 1])
            clean = b"".join([*keep, raw[at:].tobytes()]).decode("utf-8")
        rows.append({"n_words": found[0]["n_words"], "n_hit": sum(b - a for a, b in spans),
                     "items": sorted({x for f in found for x in f["items"]}),
                     "spans": [x for s in spans for x in s], "clean": clean})
    return pa.array(rows, ARROW)


def decontaminate(docs: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW,
                  max_coverage: float = 0.8, **how) -> DataFrame:
    """``docs`` without hit spans; documents of which more than ``max_coverage`` of the words
    are hit go altogether. Columns stay as they were (``n_chars``, if there, follows the text)."""
    name = hidden(docs, "found")
    df = scan_for_items(docs, items, text_col, window=window, out=name, **how)
    df = df.where((F.col(f"{name}.n_hit") == 0)
                  | (F.col(f"{name}.n_hit") <= max_coverage * F.col(f"{name}.n_words")))
    text = F.when(F.col(f"{name}.n_hit") > 0, F.col(f"{name}.clean")).otherwise(F.col(text_col))
    changed = {text_col: text}
    if "n_chars" in docs.columns:
        changed["n_chars"] = F.when(F.col(f"{name}.n_hit") > 0, F.length(f"{name}.clean").cast(
            docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return df.withColumns(changed).select(*docs.columns)
