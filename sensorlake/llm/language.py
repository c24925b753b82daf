"""Language identification by prediction by partial matching (PPM) over bytes.

Each language has a context tree of order three, learned once and then frozen: the
counts of every byte after its up to three preceding bytes. A byte seen in its
longest context costs -log2 of its share there; else an escape is paid and
the next shorter context is asked, down to a uniform code (method C: a context met
n times with u different bytes escapes with probability u / (n + u)). The sum
over a text is its exact code length under that language; the shortest code wins.

Bytes are coded in two steps. First as one of 64 symbols: the 62 most frequent bytes of the
training texts, one symbol for every other byte, and white space and text start as one.
So the trees up to order two are dense tables of at most 64^3 entries, and
the longest contexts are the distinct symbol quadruples of the training texts.
Then, for a byte of the shared symbol, which byte it is: each language has a second tree of
order three for it, over the up to three preceding bytes themselves, in sparse tables of the seen
contexts, with the same escapes down to a uniform code. So all 256 bytes are learned in each
language, and a script that is rare among all texts is told by its own bytes.

Rejection: every text of the sample is also coded by trees learned from the other half of the
sample. A language's limit is the mean cost of its texts that way plus ``MARGIN`` bits a byte, and
no less than ``max_bits``: a language with few rows is not held to what a well-learned one costs. No
limit is above ``PLAIN_BITS``.

Training reads a bounded sample: about ``docs_per_language`` different texts of each of the ``MAX_LANGUAGES`` most
frequent languages, drawn by a hash of id and text, ``MAX_TRAIN_CHARS`` characters of each. Counting runs
in Spark; only the counts reach the driver.

Defined results: null texts and texts without a letter are `und` with score 0; ties go to
the language first in alphabetical order; without any training row all is `und`, and ``drop_unknown`` keeps all;
repeated rows get equal results and are learned from once; null and repeated ids are drawn by their texts;
other columns pass through untouched.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import bound_batches, hidden, written

by_value(__name__)

DOCS_PER_LANGUAGE = 1000
#: Languages learned at most, of about 2 MB each in every worker.
MAX_LANGUAGES = 100
MAX_TRAIN_CHARS = 20_000
SYMBOLS = 64
RARE = 1
#: Bytes scored at a time.
PIECE = 1 << 18
UNKNOWN = "und"
#: Bits a byte beyond which a text is in no learned language (a random byte costs 8, learned text under 4).
MAX_BITS = 7.0
#: Bits a byte above what a language's training texts cost when not learned from.
MARGIN = 1.0
#: Bits of a byte that nothing is known of: no language's limit is higher.
PLAIN_BITS = 8.0
SHORT = 64

RESULT = T.StructType([T.StructField("lang", T.StringType()), T.StructField("score", T.DoubleType()),
                       T.StructField("bits_per_byte", T.DoubleType())])
ARROW = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("bits_per_byte", pa.float64())])
_SPACE = np.frombuffer(b" \t\n\r\x0b\x0c", np.uint8)
_PLAIN = np.arange(256, dtype=np.uint8)
_PLAIN[_SPACE] = 32
#: Where the numbers of byte quadruples start among counted ones, after those of symbol quadruples.
_BYTES_FROM = SYMBOLS ** 4


def _symbol_map(frequent: list[int]) -> np.ndarray:
    """Symbol of each byte: 0 white space, 1 rare bytes, 2 and up the frequent ones."""
    table = np.full(256, RARE, np.uint8)
    for k, b in enumerate(frequent[:SYMBOLS - 2]):
        table[b] = k + 2
    table[_SPACE] = 0
    return table


def _quadruples(raw: np.ndarray, symbols: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Each byte's symbol with the three before it, as one number; ``before``: the three symbols before."""
    s = np.concatenate([before, symbols[raw]]).astype(np.uint32)
    return ((s[:-3] * SYMBOLS + s[1:-2]) * SYMBOLS + s[2:-1]) * SYMBOLS + s[3:]


def _rare_quadruples(raw: np.ndarray, symbols: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of rare bytes, and each with the three bytes before it as one number; ``before``: the three bytes before."""
    at = np.flatnonzero(symbols[raw] == RARE)
    b = _PLAIN[np.concatenate([before, raw])].astype(np.uint32)
    return at, ((b[at] << 24) | (b[at + 1] << 16) | (b[at + 2] << 8) | b[at + 3])


def _byte_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total = np.zeros(256, np.int64)
    for batch in batches:
        for text in batch.column("t").to_pylist():
            total += np.bincount(np.frombuffer(text.encode("utf-8"), np.uint8), minlength=256)
    yield pa.RecordBatch.from_arrays([pa.array(range(256), pa.int32()), pa.array(total)], ["b", "n"])


def _counter(symbols: np.ndarray):
    start, spaces = np.zeros(3, np.uint8), np.full(3, 32, np.uint8)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            by_part: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, half, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "half", "t"))):
                raw = np.frombuffer(text.encode("utf-8"), np.uint8)
                grams = by_part.setdefault((lang, half), [])
                grams.append(_quadruples(raw, symbols, start).astype(np.int64))
                grams.append(_rare_quadruples(raw, symbols, spaces)[1].astype(np.int64) + _BYTES_FROM)
            for (lang, half), grams in by_part.items():
                g, n = np.unique(np.concatenate(grams), return_counts=True)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(g)), pa.array([half] * len(g), pa.int32()), pa.array(g),
                     pa.array(n.astype(np.int64))], ["lang", "half", "g", "n"])
    return count


def _found(sorted_keys: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place of each key among the sorted ones, and whether it is there."""
    at = np.minimum(np.searchsorted(sorted_keys, keys), max(len(sorted_keys) - 1, 0))
    return at, sorted_keys[at] == keys if len(sorted_keys) else np.zeros(len(keys), bool)


def _rare_orders(langs: list[str], counts: dict[str, tuple[np.ndarray, np.ndarray]], kinds: int) -> list[tuple]:
    """Which rare byte it is: for orders 0 to 3 the seen (context, byte) numbers and their costs, the seen contexts and
    their escapes, a column for each language. ``counts``: byte quadruples; ``kinds``: rare bytes there are."""
    orders: list[tuple] = []
    for order in range(4):
        own = {}
        for lang in langs:
            g, n = counts.get(lang, (np.zeros(0, np.int64), np.zeros(0, np.int64)))
            k, back = np.unique(np.asarray(g, np.int64) & ((1 << 8 * (order + 1)) - 1), return_inverse=True)
            own[lang] = k, np.bincount(back.ravel(), n, len(k))
        keys = np.unique(np.concatenate([k for k, _ in own.values()]))
        contexts, of = np.unique(keys >> 8, return_inverse=True)
        cost, escape = (np.empty((len(x), len(langs)), np.float32) for x in (keys, contexts))
        shorter = (orders[-1][1][np.searchsorted(orders[-1][0], keys & ((1 << 8 * order) - 1))] if order
                   else np.full((len(keys), len(langs)), np.log2(max(1, kinds)), np.float32))
        for x, lang in enumerate(langs):
            seen = np.zeros(len(keys))
            seen[np.searchsorted(keys, own[lang][0])] = own[lang][1]
            total, u = np.bincount(of, seen, len(contexts)), np.bincount(of, seen > 0, len(contexts))
            with np.errstate(divide="ignore", invalid="ignore"):
                escape[:, x] = np.where(total > 0, -np.log2(u / (total + u)), 0.0)
                hit = -np.log2(seen / (total + u)[of])
            cost[:, x] = np.where(seen > 0, hit, escape[of, x] + shorter[:, x])
        orders.append((keys, cost, contexts, escape))
    return orders


class Trees:
    """Frozen context trees of all languages as cost tables (bits)."""

    def __init__(self, langs: list[str], symbols: np.ndarray, counts: dict[str, tuple[np.ndarray, np.ndarray]],
                 rare: dict[str, tuple[np.ndarray, np.ndarray]] | None = None):
        self.langs, self.symbols = langs, symbols
        self.limits: dict[str, float] = {}
        grams = np.unique(np.concatenate([counts[x][0] for x in langs])) if langs else np.zeros(0, np.int64)
        self.grams = grams.astype(np.int64)
        shape = (SYMBOLS,) * 3
        self.cost3 = np.empty((SYMBOLS ** 3, len(langs)), np.float32)
        self.escape3 = np.empty((SYMBOLS ** 3, len(langs)), np.float32)
        self.cost4 = np.empty((len(grams), len(langs)), np.float32)
        for k, lang in enumerate(langs):
            g, n = counts[lang]
            triples = np.bincount(g % SYMBOLS ** 3, n, SYMBOLS ** 3).reshape(shape)
            cost, _ = self._order(np.full(SYMBOLS, np.log2(SYMBOLS)), triples.sum(axis=(0, 1)).reshape(1, -1))
            cost, _ = self._order(cost.ravel(), triples.sum(axis=0))
            cost, _ = self._order(cost.ravel(), triples.reshape(-1, SYMBOLS))
            self.cost3[:, k] = cost.ravel()
            seen = np.zeros(len(grams))
            seen[np.searchsorted(grams, g)] = n
            total = np.bincount(g // SYMBOLS, n, SYMBOLS ** 3)
            kinds = np.bincount(g // SYMBOLS, minlength=SYMBOLS ** 3)
            with np.errstate(divide="ignore", invalid="ignore"):
                escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
                hit = -np.log2(seen / (total + kinds)[grams // SYMBOLS])
            self.escape3[:, k] = escape
            self.cost4[:, k] = np.where(seen > 0, hit, escape[grams // SYMBOLS] + self.cost3[grams % SYMBOLS ** 3, k])
        self.rare_kinds = int((symbols == RARE).sum())
        self.rare = _rare_orders(langs, rare or {}, self.rare_kinds) if langs else []

    @staticmethod
    def _order(shorter: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Costs of (context, symbol) from the costs of one order less, laid out by the context's end."""
        total, kinds = counts.sum(axis=1), (counts > 0).sum(axis=1)
        with np.errstate(divide="ignore", invalid="ignore"):
            escape = np.where(total > 0, -np.log2(kinds / (total + kinds)), 0.0)
            hit = -np.log2(counts / (total + kinds)[:, None])
        below = np.tile(shorter.reshape(-1, SYMBOLS), (len(counts) * SYMBOLS // len(shorter), 1))
        return np.where(counts > 0, hit, escape[:, None] + below), escape

    def place(self) -> tuple[np.ndarray, np.ndarray]:
        """Number of each seen context (0: unseen), and the row of ``cost4`` of each (context, symbol),
        -1 for unseen ones. Only seen contexts take room."""
        contexts, own = np.unique(self.grams // SYMBOLS, return_inverse=True)
        number = np.zeros(SYMBOLS ** 3, np.int32)
        number[contexts] = np.arange(1, len(contexts) + 1, dtype=np.int32)
        rows = np.full((len(contexts) + 1, SYMBOLS), -1, np.int32)
        rows[own + 1, self.grams % SYMBOLS] = np.arange(len(self.grams), dtype=np.int32)
        return number, rows.ravel()

    def plain(self) -> dict:
        return vars(self)

    @classmethod
    def of_plain(cls, content: dict) -> "Trees":
        trees = cls.__new__(cls)
        vars(trees).update(content)
        return trees

    def _rare_cost(self, quadruples: np.ndarray) -> np.ndarray:
        """Bits that say which rare byte it is, under each language."""
        out = np.zeros((len(quadruples), len(self.langs)), np.float32)
        left, q = np.arange(len(quadruples)), quadruples.astype(np.int64)
        for order in (3, 2, 1, 0):
            keys, cost, contexts, escape = self.rare[order]
            q = q & ((1 << 8 * (order + 1)) - 1)
            at, seen = _found(keys, q)
            out[left[seen]] += cost[at[seen]]
            left, q = left[~seen], q[~seen]
            at, seen = _found(contexts, q >> 8)
            out[left[seen]] += escape[at[seen]]
        out[left] += np.float32(np.log2(max(1, self.rare_kinds)))
        return out

    def code_lengths(self, texts: list[bytes], place: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
        """Bits of each text under each language."""
        out = np.zeros((len(texts), len(self.langs)))
        number, rows = place
        i = 0
        while i < len(texts):
            j, size = i, 0
            while j < len(texts) and (j == i or size + len(texts[j]) + 3 <= PIECE):
                size += len(texts[j]) + 3
                j += 1
            # three spaces between texts are the start context of the next; they cost nothing
            raw = np.frombuffer(b"   ".join(texts[i:j]), np.uint8)
            starts = np.concatenate([[0], np.cumsum([len(t) + 3 for t in texts[i:j - 1]])]).astype(np.int64)
            ends = starts + [len(t) for t in texts[i:j]]
            before, bytes_before = np.zeros(3, np.uint8), np.full(3, 32, np.uint8)
            for a in range(0, len(raw), PIECE):
                part = raw[a:a + PIECE]
                q = _quadruples(part, self.symbols, before)
                row = rows[number[q // SYMBOLS] * SYMBOLS + q % SYMBOLS]
                cost = self.cost4[row] if len(self.cost4) else np.zeros((len(row), len(self.langs)), np.float32)
                new = np.flatnonzero(row < 0)
                if len(new):
                    cost[new] = self.escape3[q[new] // SYMBOLS] + self.cost3[q[new] % SYMBOLS ** 3]
                at, which = _rare_quadruples(part, self.symbols, bytes_before)
                if len(at):
                    cost[at] += self._rare_cost(which)
                run = np.zeros((len(part) + 1, len(self.langs)))
                np.cumsum(cost, axis=0, out=run[1:])
                lo, hi = np.clip(starts - a, 0, len(part)), np.clip(ends - a, 0, len(part))
                out[i:j] += run[hi] - run[lo]
                before = self.symbols[raw[max(0, a + len(part) - 3):a + len(part)]]
                before = np.concatenate([np.zeros(3 - len(before), np.uint8), before])
                bytes_before = np.concatenate([bytes_before, part])[-3:]
            i = j
        return out


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, eligible: Column,
                  docs_per_language: int = DOCS_PER_LANGUAGE) -> DataFrame:
    """A sample of eligible labelled texts, written: (lang, t), about ``docs_per_language`` different ones of each of the
    ``MAX_LANGUAGES`` most frequent languages, one at least, and ``MAX_TRAIN_CHARS`` characters of each. Drawn by a hash
    of id and text, so that null and repeated ids do not stand or fall together."""
    lang = F.col(lang_col).cast("string")
    rows = docs.where(eligible & lang.isNotNull() & F.col(text_col).isNotNull()).select(
        lang.alias("lang"), F.col(text_col).alias("t"),
        F.xxhash64(F.col(id_col).cast("string"), F.col(text_col), F.lit("train")).alias("draw"))
    found = rows.groupBy("lang").count().orderBy(F.col("count").desc(), "lang").limit(MAX_LANGUAGES).collect()
    if not found:
        return rows.select("lang", "t").limit(0)
    limit = F.lit(1 << 20)
    share = F.create_map(*[F.lit(x) for r in found for x in (r["lang"], min(1.0, docs_per_language / r["count"]))])
    rows = rows.withColumn("t", F.substring("t", 1, MAX_TRAIN_CHARS))
    drawn = rows.where(F.pmod("draw", limit) / limit < share[F.col("lang")])
    sample = written(drawn.select("lang", "t").dropDuplicates(), "language-sample")
    missing = {r["lang"] for r in found} - {r["lang"] for r in sample.select("lang").distinct().collect()}
    if missing:                     # rows alike, none of which was drawn
        least = rows.where(F.col("lang").isin(sorted(missing))).groupBy("lang").agg(F.min_by("t", "draw").alias("t"))
        sample = written(sample.unionByName(least), "language-sample")
    return sample


def train(rows: DataFrame) -> Trees:
    """Context trees of (lang, t) rows; the counting is done by Spark."""
    bytes_seen = (rows.select("t").mapInArrow(_byte_counts, "b int, n long").groupBy("b").agg(F.sum("n").alias("n"))
                  .where("n > 0").collect())                                     # 256 rows at most
    order = [r["b"] for r in sorted(bytes_seen, key=lambda r: (-r["n"], r["b"])) if r["b"] not in _SPACE]
    symbols = _symbol_map(order)
    rows = rows.withColumn("half", F.pmod(F.xxhash64("t"), F.lit(2)).cast("int"))
    counted = (rows.mapInArrow(_counter(symbols), "lang string, half int, g long, n long")
               .groupBy("lang", "g").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("half") == 1, F.col("n")).otherwise(0))
                                         .alias("odd")).toArrow())
    langs = sorted(set(counted.column("lang").to_pylist()))
    lang = np.array(counted.column("lang").to_pylist(), dtype=object)
    g, n, odd = (counted.column(c).to_numpy() for c in ("g", "n", "odd"))

    def trees(n: np.ndarray) -> Trees:
        some = n > 0
        symbol, byte = some & (g < _BYTES_FROM), some & (g >= _BYTES_FROM)
        return Trees(langs, symbols, {x: (g[symbol & (lang == x)], n[symbol & (lang == x)]) for x in langs},
                     {x: (g[byte & (lang == x)] - _BYTES_FROM, n[byte & (lang == x)]) for x in langs})

    whole = trees(n)
    if langs:
        whole.limits = _limits(rows, [trees(odd), trees(n - odd)])
    return whole


def _limits(rows: DataFrame, other: list[Trees]) -> dict[str, float]:
    """Bits a byte of each language's texts (lang, half, t), coded by the trees ``other[half]`` learned from the other
    half, plus ``MARGIN``; at most ``PLAIN_BITS``."""
    found = []
    for half, trees in enumerate(other):                 # one after the other: a worker holds one set of trees
        shared = rows.sparkSession.sparkContext.broadcast(trees.plain())
        coded = rows.where(F.col("half") == half).select("lang", "t").mapInArrow(_coder(shared), "lang string, bits double, n long")
        found += coded.groupBy("lang").agg(F.sum("bits").alias("bits"), F.sum("n").alias("n")).collect()   # a row a language
        shared.destroy()
    sums = {r["lang"]: [sum(x[c] for x in found if x["lang"] == r["lang"]) for c in ("bits", "n")] for r in found}
    return {lang: min(PLAIN_BITS, bits / n + MARGIN) for lang, (bits, n) in sums.items() if n}


def _coder(shared):
    def cost(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Trees.of_plain(shared.value)
        place, column = model.place(), {x: k for k, x in enumerate(model.langs)}
        for batch in batches:
            lang, raw = batch.column("lang"), [x.encode("utf-8") for x in batch.column("t").to_pylist()]
            bits = model.code_lengths(raw, place)[np.arange(len(raw)), [column[x] for x in lang.to_pylist()]]
            yield pa.RecordBatch.from_arrays(
                [lang, pa.array(bits, pa.float64()), pa.array([len(x) for x in raw], pa.int64())], ["lang", "bits", "n"])
    return cost


def identify(docs: DataFrame, trees: Trees, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column: lang, score (the share of the best language in the
    posterior, 0 to 1) and bits_per_byte (of the best code)."""
    spark = docs.sparkSession
    bound_batches(spark)
    shared = spark.sparkContext.broadcast(trees.plain())
    kept: dict[str, tuple[np.ndarray, np.ndarray]] = {}

    @F.arrow_udf(RESULT)
    def score(texts: pa.Array) -> pa.Array:
        model = Trees.of_plain(shared.value)
        if "place" not in kept:
            kept["place"] = model.place()
        raw = texts.cast(pa.large_string()).fill_null("").cast(pa.large_binary()).to_pylist()
        bits = model.code_lengths(raw, kept["place"])
        best = bits.argmin(axis=1)
        least = bits[np.arange(len(raw)), best]
        share = 1.0 / np.exp2(np.maximum(least[:, None] - bits, -1000)).sum(axis=1)
        size = np.maximum([len(x) for x in raw], 1)
        return pa.StructArray.from_arrays(
            [pa.array([model.langs[k] for k in best]), pa.array(share), pa.array(least / size)], fields=list(ARROW))

    nothing = F.struct(F.lit(UNKNOWN).alias("lang"), F.lit(0.0).alias("score"),
                       F.lit(None).cast("double").alias("bits_per_byte"))
    if not trees.langs:
        return docs.withColumn(out, nothing)
    name = hidden(docs, "scored")
    df = docs.withColumn(name, score(F.col(text_col)))
    lettered = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    return df.withColumn(out, F.when(lettered, F.col(name)).otherwise(nothing)).drop(name)


def held_out(id_col: str = "doc_id") -> Column:
    """Rows never learned from: crc32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **how) -> Trees:
    return train(training_rows(docs, id_col, text_col, lang_col, ~held_out(id_col), **how))


def drop_unknown(docs: DataFrame, trees: Trees, text_col: str = "text", max_bits: float = MAX_BITS) -> DataFrame:
    """``docs`` without texts in no learned language: no letter at all, or a best code longer
    than its language's limit (``max_bits`` a byte at least). Texts of under ``SHORT`` bytes tell too little for the
    second test. Where nothing could be learned, all documents stay."""
    if not trees.langs:
        return docs
    name = hidden(docs, "language")
    df = identify(docs, trees, text_col, name)
    limit = F.lit(max_bits)
    for lang, bits in trees.limits.items():
        if bits > max_bits:
            limit = F.when(F.col(f"{name}.lang") == lang, bits).otherwise(limit)
    return df.where((F.col(f"{name}.lang") != UNKNOWN) & (
        (F.octet_length(text_col) < SHORT) | (F.col(f"{name}.bits_per_byte") <= limit))).drop(name)
