"""SentencePiece encoding and decoding (byte-pair pieces with byte fallback) by vectorised merge rounds.

The vocabulary file is read on the driver and broadcast as arrays, bounded by the vocabulary's size.
In a task the texts of a batch are one flat numpy array of symbols:

1. Texts get the leading blank mark, blanks become marks, every character is a symbol. Between two
   characters that are neighbours in no piece no merge can ever reach across, so the array is cut
   there into words; equal words of a batch are encoded once (compared character by character).
2. A round: the least rank of a pair in every word (segmented minimum), all its places
   from the left on, without overlap, become one symbol each, the array is compacted. Only pairs next to
   a merge are looked up again. Words without a pair that the vocabulary holds are done.
3. Where a merge makes a new pair of the same or a better rank, the pairs right of it wait for the next
   round, as they would in the sequential order (best rank first, then leftmost). So the result is that of merging one
   pair after the other. Words that take too many rounds (runs of thousands of blanks) are finished
   that way, with a heap.
4. Characters outside the vocabulary become one id for each UTF-8 byte.

Decoding gathers the pieces' bytes by id; bytes that are no valid UTF-8 become U+FFFD each.

Defined results: null and empty texts are the begin and end ids alone (without them: no ids); every row of repeated ids or
texts is encoded; null ids decode to null, null in a list of ids to nothing; bytes of a text that are not UTF-8 count as
U+FFFD; an empty table gives no rows; other columns stay, one named like ``out`` is replaced.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import bound_batches, constants, mix

by_value(__name__)

#: Characters encoded together, about (one longer text is taken alone).
BLOCK_CHARS = 1 << 20
#: Words left when the rounds have gone over so many times the symbols there were are finished one merge at a time.
MAX_WORK = 32
MARK = "▁"
NO_PAIR = np.iinfo(np.int32).max
_UNKNOWN_TEXT = " ⁇ "


def vocabulary_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


# --------------------------------------------------------------------------- the vocabulary as arrays
def read_vocabulary(model: str) -> dict:
    """Arrays of a byte-pair vocabulary file: single characters, pairs with their merged piece and rank,
    pieces as bytes. Models that change texts beyond blanks and the leading mark are an error."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=model)
    probe = "ﬁ Á  　\t①x "
    if sp.normalize(probe) != MARK + probe.replace(" ", MARK):
        raise ValueError(f"{model}: only models without normalisation, with a leading blank mark, are supported")
    n = sp.get_piece_size()
    text = [sp.id_to_piece(i) for i in range(n)]
    plain = [i for i in range(n) if not (sp.is_unknown(i) or sp.is_control(i) or sp.is_byte(i))]
    if any(sp.is_unused(i) for i in plain):
        raise ValueError(f"{model}: unused pieces are not supported")
    ids = {text[i]: i for i in plain}
    score = np.array([sp.get_score(i) for i in range(n)], np.float32)
    rank = np.unique(-score, return_inverse=True)[1].astype(np.int32)       # equal scores share a rank
    pairs = sorted((ids[p[:k]] << 32 | ids[p[k:]], ids[p]) for p in ids for k in range(1, len(p))
                   if p[:k] in ids and p[k:] in ids)
    single = sorted((ord(p), i) for p, i in ids.items() if len(p) == 1)
    inside = sorted({ord(c) for p in ids if len(p) > 1 for c in p})
    place = {c: k + 1 for k, c in enumerate(inside)}
    beside = np.zeros((len(inside) + 1, len(inside) + 1), bool)             # neighbours in some piece
    for p in ids:
        for a, b in zip(p, p[1:]):
            beside[place[ord(a)], place[ord(b)]] = True
    if set(inside) - {c for c, _ in single}:
        raise ValueError(f"{model}: pieces of characters that are no pieces are not supported")
    bytes_of = {int(text[i][3:5], 16): i for i in range(n) if sp.is_byte(i)}
    if len(bytes_of) < 256:
        raise ValueError(f"{model}: only models with byte fallback are supported")
    raw = [b"" if sp.is_control(i) else _UNKNOWN_TEXT.encode() if sp.is_unknown(i)
           else bytes([int(text[i][3:5], 16)]) if sp.is_byte(i) else text[i].replace(MARK, " ").encode() for i in range(n)]
    return {"chars": np.array([c for c, _ in single], np.int64), "char_ids": np.array([i for _, i in single], np.int32),
            "inside": np.array(inside, np.int64), "beside": beside,
            "pairs": np.array([k for k, _ in pairs], np.int64), "merged": np.array([m for _, m in pairs], np.int32),
            "rank": rank, "bytes": np.array([bytes_of[b] for b in range(256)], np.int32),
            "raw": np.frombuffer(b"".join(raw), np.uint8), "raw_at": np.cumsum([0, *map(len, raw)]),
            "marked": np.array([t.startswith(MARK) for t in text]),
            "control": np.array([sp.is_control(i) for i in range(n)]), "begin": sp.bos_id(), "end": sp.eos_id()}


class Codec:
    """Encodes and decodes batches with the arrays of ``read_vocabulary``."""

    def __init__(self, v: dict):
        self.v = v
        self.id_of = np.full(0x110000, -1, np.int32)
        self.id_of[v["chars"]] = v["char_ids"]
        self.place = np.zeros(0x110000, np.int16)
        self.place[v["inside"]] = np.arange(1, len(v["inside"]) + 1)
        # pairs in a table of open addresses: a third full, probed in vectorised steps
        bits = max(8, int(3 * len(v["pairs"])).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys = np.full(1 << bits, -1, np.int64)
        self.values = np.zeros(1 << bits, np.int32)
        waiting = np.arange(len(v["pairs"]))
        slot = self._slot(v["pairs"])
        while len(waiting):
            free = self.keys[slot] < 0
            first = np.unique(np.where(free, slot, -1), return_index=True)
            won = first[1][first[0] >= 0]
            self.keys[slot[won]], self.values[slot[won]] = v["pairs"][waiting[won]], v["merged"][waiting[won]]
            left = np.ones(len(waiting), bool)
            left[won] = False
            waiting, slot = waiting[left], (slot[left] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def pair(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Merged piece and rank of neighbouring symbols; ``NO_PAIR`` where they make none."""
        key = a.astype(np.int64) << 32 | b
        slot = self._slot(key)
        merged = np.full(len(key), -1, np.int32)
        at = np.arange(len(key))
        while len(at):
            found = self.keys[slot]
            hit = found == key[at]
            merged[at[hit]] = self.values[slot[hit]]
            more = ~hit & (found >= 0)
            at, slot = at[more], (slot[more] + 1) & self.mask
        return merged, np.where(merged >= 0, self.v["rank"][merged], NO_PAIR)

    # ----------------------------------------------------------------------- encoding
    def encode(self, texts: list[str], ends: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and where each text's ids begin."""
        begin = [self.v["begin"]] if ends else []
        end = [self.v["end"]] if ends else []
        marked = [MARK + t.replace(" ", MARK) if t else "" for t in texts]
        size = np.array([len(t) for t in marked], np.int64)
        chars = np.frombuffer("".join(marked).encode("utf-32-le"), "<u4").astype(np.int64)
        first = np.concatenate([[0], np.cumsum(size)])
        flat, at = self._words(chars, first)
        extra = len(begin) + len(end)
        offsets = at[first] + extra * np.arange(len(texts) + 1)
        out = np.empty(offsets[-1], np.int32)
        owner = np.repeat(np.arange(len(texts)), np.diff(at[first]))
        out[np.arange(len(flat)) + extra * owner + len(begin)] = flat
        if ends:
            out[offsets[:-1]], out[offsets[1:] - 1] = begin[0], end[0]
        return out, offsets

    def _words(self, chars: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all characters' words in a row, and for every character the ids before its word
        (only right at words' first characters, which texts begin with)."""
        n = len(chars)
        at = np.zeros(n + 1, np.int64)
        if not n:
            return np.zeros(0, np.int32), at
        place = self.place[chars]
        cut = np.ones(n + 1, bool)
        cut[1:-1] = ~self.v["beside"][place[:-1], place[1:]]
        cut[first] = True
        starts = np.flatnonzero(cut[:-1])
        size = np.diff(np.append(starts, n))
        ids = self.id_of[chars]
        one = np.flatnonzero(size == 1)
        long = np.flatnonzero(size > 1)

        # equal words once
        words, lengths = starts[long], size[long]
        where = _ranges(words, lengths)
        step = np.arange(len(where)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        bounds = np.cumsum(lengths) - lengths
        if len(words):
            scale = constants(int(lengths.max()), 11)
            h = np.add.reduceat(mix(ids[where].astype(np.uint64)) * scale[step], bounds) + lengths.astype(np.uint64)
            _, kept, same = np.unique(h, return_index=True, return_inverse=True)
            twin = words[kept[same]]
            if (lengths[kept[same]] != lengths).any() or (ids[np.repeat(twin, lengths) + step] != ids[where]).any():
                kept = same = np.arange(len(words))                  # hashes met: every word for itself
            symbols, count = self._merged(ids, words[kept], lengths[kept])
            begin = np.cumsum(count) - count
        else:
            symbols, count, begin, same = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)

        # characters that are words: an id, or one for each byte
        code = chars[starts[one]]
        known = ids[starts[one]] >= 0
        width = np.where(known, 1, 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        total = np.empty(len(starts), np.int64)
        total[one], total[long] = width, count[same]
        before = np.cumsum(total) - total
        out = np.empty(int(total.sum()), np.int32)
        out[before[one[known]]] = ids[starts[one[known]]]
        for k in np.flatnonzero(~known):
            for b, x in enumerate(chr(code[k]).encode("utf-8", "replace")):
                out[before[one[k]] + b] = self.v["bytes"][x]
        out[_ranges(before[long], count[same])] = symbols[_ranges(begin[same], count[same])]
        at[starts] = before
        at[n] = len(out)
        return out, at

    def _merged(self, ids: np.ndarray, words: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols of the given words after all merges, and how many each word has."""
        sym = ids[_ranges(words, lengths)]
        seg = np.repeat(np.arange(len(words)), lengths)
        last = np.ones(len(sym), bool)
        last[:-1] = seg[1:] != seg[:-1]
        new, rank = self._beside(sym, last, np.arange(len(sym)))
        done_sym, done_seg = [], []
        work, most = 0, MAX_WORK * len(sym)
        while len(sym):
            first = np.flatnonzero(np.concatenate([[True], last[:-1]]))
            best = np.minimum.reduceat(rank, first)
            live = best < NO_PAIR
            per = np.diff(np.append(first, len(sym)))
            if not live.all():
                keep = np.repeat(live, per)
                done_sym.append(sym[~keep]), done_seg.append(seg[~keep])
                sym, seg, last, new, rank = sym[keep], seg[keep], last[keep], new[keep], rank[keep]
                best, per = best[live], per[live]
                if not len(sym):
                    break
            work += len(sym)
            if work > most:
                for part, of in zip(np.split(sym, np.cumsum(per)[:-1]), seg[np.cumsum(per) - 1]):
                    rest = self._one_by_one(part)
                    done_sym.append(rest), done_seg.append(np.full(len(rest), of))
                break
            least = np.repeat(best, per)
            at = np.flatnonzero(rank == least)
            # from the left on, without overlap: every other place of a run
            run = np.flatnonzero(np.concatenate([[True], np.diff(at) != 1]))
            at = at[(np.arange(len(at)) - np.repeat(run, np.diff(np.append(run, len(at))))) % 2 == 0]
            made, limit = new[at], least[at]
            # new pairs of the same or a better rank: what is right of them waits
            left = at - 1
            inside = (left >= 0) & ~last[left]
            joined = np.concatenate([[False], at[1:] - at[:-1] == 2]) & inside
            before = np.where(joined, np.concatenate([made[:1], made[:-1]]), sym[left])
            after = np.minimum(at + 2, len(sym) - 1)
            follows = ~last[at + 1]
            early = (inside & (self.pair(before, made)[1] <= limit)) | (follows & (self.pair(made, sym[after])[1] <= limit))
            if early.any():
                stops = np.cumsum(early) - early
                word = seg[at]
                start = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
                base = np.repeat(stops[start], np.diff(np.append(start, len(at))))
                free = stops == base
                at, made = at[free], made[free]
            sym[at] = made
            last[at] = last[at + 1]
            gone = np.ones(len(sym), bool)
            gone[at + 1] = False
            place = np.cumsum(gone) - 1
            sym, seg, last, new, rank = sym[gone], seg[gone], last[gone], new[gone], rank[gone]
            near = np.zeros(len(sym), bool)
            near[place[at]] = True
            near[:-1] |= near[1:]
            touched = np.flatnonzero(near)
            new[touched], rank[touched] = self._beside(sym, last, touched)
        if not done_sym:
            return np.zeros(0, np.int32), np.zeros(len(words), np.int64)
        sym, seg = np.concatenate(done_sym), np.concatenate(done_seg)
        order = np.argsort(seg, kind="stable")
        return sym[order], np.bincount(seg, minlength=len(words))

    def _beside(self, sym: np.ndarray, last: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What the symbols at ``at`` make with the next one of their word."""
        merged, rank = self.pair(sym[at], sym[np.minimum(at + 1, len(sym) - 1)])
        rank[last[at]] = NO_PAIR
        return merged, rank

    def _one_by_one(self, sym: np.ndarray) -> np.ndarray:
        """The merges of one word in sequence: best rank first, then leftmost."""
        table = self._pair_dict()
        rank = self.v["rank"]
        sym = sym.tolist()
        n = len(sym)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap: list[tuple[int, int, int, int]] = []

        def add(i: int) -> None:
            j = after[i] if i >= 0 else n
            if j < n and (m := table.get((sym[i], sym[j]))) is not None:
                heapq.heappush(heap, (int(rank[m]), i, sym[i], sym[j]))

        for i in range(n):
            add(i)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if sym[i] != a or j >= n or sym[j] != b:
                continue
            sym[i], sym[j] = table[a, b], -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            add(before[i])
            add(i)
        return np.array([s for s in sym if s >= 0], np.int32)

    def _pair_dict(self) -> dict:
        if not hasattr(self, "_dict"):
            key = self.v["pairs"]
            self._dict = dict(zip(zip((key >> 32).tolist(), (key & 0xFFFFFFFF).tolist()), self.v["merged"].tolist()))
        return self._dict

    # ----------------------------------------------------------------------- decoding
    def decode(self, ids: np.ndarray, offsets: np.ndarray) -> list[str]:
        """Texts of lists of ids, given in a row with where each begins."""
        v = self.v
        size = np.diff(v["raw_at"])[ids]
        raw = v["raw"][_ranges(v["raw_at"][:-1][ids], size)]
        at = np.concatenate([[0], np.cumsum(size)])[offsets]
        shown = np.concatenate([[0], np.cumsum(~v["control"][ids])])
        texts = []
        for k in range(len(offsets) - 1):
            body = raw[at[k]:at[k + 1]].tobytes()
            a, b = int(offsets[k]), int(offsets[k + 1])
            # the leading mark is no blank of the text
            lead = int(np.searchsorted(shown[a:b + 1], shown[a], "right")) - 1 + a
            if lead < b and v["marked"][ids[lead]]:
                body = body[1:]
            try:
                texts.append(body.decode("utf-8"))
            except UnicodeDecodeError:
                texts.append(_replaced(body))
        return texts


def _replaced(body: bytes) -> str:
    """Bytes as text; every byte that begins no valid character becomes U+FFFD."""
    out, at = [], 0
    while at < len(body):
        try:
            out.append(body[at:].decode("utf-8"))
            break
        except UnicodeDecodeError as e:
            out.append(body[at:at + e.start].decode("utf-8") + "�")
            at += e.start + 1
    return "".join(out)


def _ranges(start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """All positions start[k] .. start[k] + length[k] - 1, one range after the other."""
    total = np.cumsum(length)
    n = int(total[-1]) if len(total) else 0
    return np.arange(n) + np.repeat(start - (total - length), length)


# --------------------------------------------------------------------------- the operators
def _blocks(texts: list[str]) -> Iterator[list[str]]:
    part, size = [], 0
    for t in texts:
        if part and size + len(t) > BLOCK_CHARS:
            yield part
            part, size = [], 0
        part.append(t)
        size += len(t)
    if part:
        yield part


def _strings(column: pa.Array) -> list[str]:
    raw = column.cast(pa.large_string()).cast(pa.large_binary())
    return ["" if b is None else b.decode("utf-8", "replace") for b in raw.to_pylist()]


def encode(docs: DataFrame, text_col: str = "text", out: str = "ids", model: str | None = None, *, ends: bool = True,
           packed: bool = False) -> DataFrame:
    """``docs`` with a column of ids: array<int>, or with ``packed`` their little-endian unsigned 32-bit
    bytes. ``ends``: with begin and end ids."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(model or vocabulary_path()))

    @F.arrow_udf(T.BinaryType() if packed else T.ArrayType(T.IntegerType()))
    def ids_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            parts = []
            for texts in _blocks(_strings(batch)):
                ids, offsets = codec.encode(texts, ends)
                if packed:
                    parts.append(pa.Array.from_buffers(pa.large_binary(), len(texts), [
                        None, pa.py_buffer((4 * offsets).astype(np.int64)), pa.py_buffer(ids.astype("<u4"))]).cast(pa.binary()))
                else:
                    parts.append(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())))
            yield pa.concat_arrays(parts) if parts else pa.array([], pa.binary() if packed else pa.list_(pa.int32()))

    return docs.withColumn(out, ids_of(F.col(text_col)))


def decode(docs: DataFrame, ids_col: str = "ids", out: str = "text", model: str | None = None) -> DataFrame:
    """``docs`` with the text of a column of ids (array<int>, or packed as ``encode`` gives them)."""
    spark = docs.sparkSession
    bound_batches(spark)
    vocabulary = spark.sparkContext.broadcast(read_vocabulary(model or vocabulary_path()))
    packed = isinstance(docs.schema[ids_col].dataType, T.BinaryType)

    @F.arrow_udf(T.StringType())
    def text_of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        codec = Codec(vocabulary.value)
        for batch in batches:
            texts: list[str | None] = []
            for part in _id_blocks(batch, packed):
                if part[0] is None:
                    texts += [None] * part[1]
                else:
                    texts += codec.decode(*part)
            yield pa.array(texts, pa.string())

    return docs.withColumn(out, text_of(F.col(ids_col)))


def _id_blocks(batch: pa.Array, packed: bool) -> Iterator[tuple]:
    """Lists of ids some at a time as (ids in a row, offsets), null rows as (None, how many)."""
    part: list[np.ndarray] = []
    size = 0
    for row in batch:
        if row.as_py() is None if packed else not row.is_valid:
            if part:
                yield _in_a_row(part)
                part, size = [], 0
            yield None, 1
            continue
        if packed:
            ids = np.frombuffer(row.as_buffer(), "<u4").astype(np.int32)
        else:
            ids = row.values.drop_null().to_numpy(zero_copy_only=False).astype(np.int32)
        if part and size + len(ids) > BLOCK_CHARS:
            yield _in_a_row(part)
            part, size = [], 0
        part.append(ids)
        size += len(ids)
    if part:
        yield _in_a_row(part)


def _in_a_row(parts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
