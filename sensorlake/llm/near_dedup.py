"""MinHash near-duplicates by fast similarity sketching, banding and exact verification.

Sketch: in round 0, 1, 2 ... every shingle of a set is hashed to one of the 256
coordinates; a coordinate keeps the smallest value of the first round that reaches
it, and after 256 such rounds round 256 + j fills coordinate j from all shingles.
So every coordinate is filled, in time close to the size of the set, and the share
of equal coordinates estimates the Jaccard similarity with concentration bounds.

Banding: as many coordinates a band as keep the chance that two sets at the limit share
no band under 1e-4 (32 bands of 8 for 0.85, 42 of 6 for 0.8); more similar sets miss each
other far less often.

Verification: pairs in a band are confirmed on the full shingle sets. Equal sets are
one node from the start. Links are found in waves, so that no group is expanded
into all its pairs: first every set against the smallest set it shares a band with;
then, in bands that still hold several components, all against one member of the
smallest; at last, in what is left, every member outside a band's largest component against
all members of other components, in blocks of bounded size that carry the sets: pairs are
compared inside a block and only links come out. Pairs within one component
need no more links, so no link between components is lost.

Defined results: null and empty texts have no shingles and are linked with nothing;
shorter texts than a shingle are one shingle; repeated rows belong to one set; a null id
is no component's smallest unless the component has only null ids. ``drop_near`` goes by rows, not by
ids: of each component one row stays, also where ids are null or repeated.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.shipping import by_value
from sensorlake.llm.bloom import cells_for, filter_of, probe
from sensorlake.llm.common import (SPACED_WORD, Words, apart, bound_batches, constants, hidden, mix, runs_of_documents, same,
                                   utf8, written)
from sensorlake.llm.components import connected, joined_up

by_value(__name__)

COORDINATES = 256
#: Chance at most that two sets just at the limit share no band.
MISS = 1e-4
SHINGLE = 5
#: Bytes of a block in the last wave, on either side.
BLOCK_BYTES = 4 << 20

_SHIFT = constants(SHINGLE, 11)
_ROUND = constants(2 * COORDINATES, 13)
_BAND = constants(COORDINATES, 17)


def shingles(words: Words, k: int = SHINGLE) -> list[np.ndarray]:
    """Distinct shingle hashes (sorted) of each document."""
    h, n = words.hash, len(words.hash)
    if n >= k:
        every = h[:n - k + 1] * _SHIFT[0]
        for x in range(1, k):
            every = every + h[x:n - k + 1 + x] * _SHIFT[x]
        every = mix(every)
    out = []
    for a, b in zip(words.first[:-1], words.first[1:]):
        if b - a >= k:
            out.append(np.unique(every[a:b - k + 1]))
        elif b > a:
            short = np.array([b - a], np.uint64)
            for x in range(a, b):
                short = mix(short + h[x])
            out.append(short)
        else:
            out.append(np.zeros(0, np.uint64))
    return out


def sketch(a: np.ndarray, t: int = COORDINATES) -> np.ndarray:
    """The similarity sketch of a set of 64-bit shingle hashes: ``t`` (= 256) filled coordinates.

    Each value holds the round and the hash of the shingle that filled the coordinate, so equal
    values mean the same shingle reached it in the same round.
    """
    value, filled = np.zeros(t, np.uint64), np.zeros(t, bool)
    at, step = 0, max(1, -(-4 * t // len(a)))
    while at < t and not filled.all():
        rounds = np.arange(at, min(t, at + step), dtype=np.uint64)
        h = mix(a[None, :] ^ _ROUND[rounds.astype(np.int64)][:, None])
        key = (h & np.uint64(0xFF << 56)) | (rounds[:, None] << np.uint64(47)) | (h & np.uint64((1 << 47) - 1))
        key = np.sort(key.ravel())
        place = (key >> np.uint64(56)).astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        first = first[~filled[place[first]]]
        value[place[first]], filled[place[first]] = key[first], True
        at += step
    for j in np.flatnonzero(~filled):
        h = mix(a ^ _ROUND[t + j])
        value[j] = (np.uint64(j) << np.uint64(56)) | (np.uint64(t + j) << np.uint64(47)) | (
            h.min() & np.uint64((1 << 47) - 1))
    return mix(value)


def _identity(a: np.ndarray) -> bytes:
    """128 bits that stand for a set of hashes."""
    with np.errstate(over="ignore"):
        return np.array([mix(a + np.uint64(1)).sum(dtype=np.uint64), mix(a ^ np.uint64(0x5851F42D4C957F2D)).sum(
            dtype=np.uint64) + np.uint64(len(a))], np.uint64).tobytes()


def _documents(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    raw, offsets = utf8(batch.column("t"))
    for i, j in runs_of_documents(offsets):
        base = offsets[i]
        words = Words(raw[base:offsets[j]], offsets[i:j + 1] - base, SPACED_WORD)
        yield from zip(range(i, j), shingles(words))


def band_rows(percent: int) -> int:
    """Coordinates of a band: the most that keep the miss chance at the limit."""
    s = percent / 100
    return max(r for r in range(1, COORDINATES + 1) if r == 1 or (1 - s ** r) ** (COORDINATES // r) <= MISS)


def _band_keys(s: np.ndarray, rows: int) -> np.ndarray:
    bands = len(s) // rows
    used = (s * _BAND)[:bands * rows].reshape(bands, rows)
    return mix(used.sum(axis=1, dtype=np.uint64) + np.arange(bands, dtype=np.uint64))


def _sketches(rows: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n, sid, bands, small = [], [], [], []
        for _, a in _documents(batch):
            n.append(len(a))
            if len(a) == 0:
                sid.append(None), bands.append(None), small.append(None)
                continue
            s = sketch(a)
            sid.append(_identity(a)), bands.append(_band_keys(s, rows).tobytes())
            small.append((s & np.uint64(255)).astype(np.uint8).tobytes())
        own = [c for c in batch.schema.names if c != "t"]
        yield pa.RecordBatch.from_arrays(
            [*(batch.column(c) for c in own), pa.array(n, pa.int64()), pa.array(sid, pa.binary()),
             pa.array(bands, pa.binary()), pa.array(small, pa.binary())],
            [*own, "n", "sid", "bands", "sketch"])


def _band_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row (key, sid) for each band of a set."""
    for batch in batches:
        keys = [np.frombuffer(b.as_buffer(), np.int64) for b in batch.column("bands")]
        of = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(keys) if keys else np.zeros(0, np.int64)), batch.column("sid").take(pa.array(of))],
            ["key", "sid"])


def _full_sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sid, body = [], []
        for _, a in _documents(batch):
            sid.append(_identity(a)), body.append(a.tobytes())
        yield pa.RecordBatch.from_arrays([pa.array(sid, pa.binary()), pa.array(body, pa.binary())], ["sid", "body"])


def _linked_pair(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    if 100 * min(len(a), len(b)) < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def _linked(percent: int):
    @F.arrow_udf("boolean")
    def linked(x: pa.Array, y: pa.Array) -> pa.Array:
        return pa.array([_linked_pair(np.frombuffer(p.as_buffer(), np.uint64), np.frombuffer(q.as_buffer(), np.uint64), percent)
                         for p, q in zip(x, y)], pa.bool_())
    return linked


def _block_links(percent: int):
    """Links between components in a block of one band: queries against the others.

    Pairs of sizes that allow a link and whose sketches agree in nearly ``percent`` of the coordinates (six standard deviations below the
    expected agreement) are confirmed on the full sets, each in the first band that both are in, most alike
    first. Components that a confirmed link has joined need no other link, so at most one link for
    each component comes out, as the pair of labels.
    """
    share = percent / 100
    least = int(COORDINATES * share - 6 * (COORDINATES * share * (1 - share)) ** 0.5)

    def links(rows: list[dict], out: list[tuple[bytes, bytes]]) -> None:
        q, s = [r for r in rows if r["query"]], [r for r in rows if r["other"]]
        if not q or not s or len({r["label"] for r in rows}) == 1:
            return
        root: dict[bytes, bytes] = {}

        def find(x: bytes) -> bytes:
            while root.get(x, x) != x:
                x = root[x]
            return x

        key = rows[0]["key"]
        near = np.frombuffer(b"".join(r["sketch"] for r in s), np.uint8).reshape(len(s), -1)
        bands = np.frombuffer(b"".join(r["bands"] for r in s), np.int64).reshape(len(s), -1)
        sizes = np.array([len(r["body"]) for r in s])
        pairs = []
        for k, r in enumerate(q):
            n = len(r["body"])
            at = np.flatnonzero(100 * np.minimum(sizes, n) >= percent * np.maximum(sizes, n))
            if not len(at):
                continue
            alike = (near[at] == np.frombuffer(r["sketch"], np.uint8)).sum(axis=1)
            at, alike = at[alike >= least], alike[alike >= least]
            if len(at):
                first = bands[at, (bands[at] == np.frombuffer(r["bands"], np.int64)).argmax(axis=1)] == key
                pairs += [(-int(n), k, int(x)) for n, x in zip(alike[first], at[first]) if s[x]["label"] != r["label"]]
        for _, k, x in sorted(pairs):
            one, two = find(q[k]["label"]), find(s[x]["label"])
            if one != two and _linked_pair(np.frombuffer(q[k]["body"], np.uint64), np.frombuffer(s[x]["body"], np.uint64), percent):
                root[max(one, two)] = min(one, two)
                labels = q[k]["label"], s[x]["label"]
                out.append((max(labels), min(labels)))

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Blocks come one after the other; most hold a few rows, so none is a call of its own."""
        block, rows = None, []
        for batch in batches:
            out: list[tuple[bytes, bytes]] = []
            for row in batch.to_pylist():
                if (row["key"], row["i"], row["j"]) != block:
                    links(rows, out)
                    block, rows = (row["key"], row["i"], row["j"]), []
                rows.append(row)
            yield _pairs(out)
        out = []
        links(rows, out)
        yield _pairs(out)
    return stream


def _pairs(found: list[tuple[bytes, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([p[k] for p in found], pa.binary()) for k in (0, 1)], ["a", "b"])


def _last_links(left: DataFrame, sets: DataFrame, bodies: DataFrame, percent: int) -> DataFrame:
    """Links between components in bands (key, sid, label) that hold several, as pairs of labels; they may repeat.

    A band whose members fit in one block is one group; else a member is copied to each block that
    it meets on the other side.
    """
    own = left.select("sid").distinct()
    content = (own.join(sets.select(F.col("sid").alias("s"), "sketch", "bands"), F.col("sid") == F.col("s")).drop("s")
               .join(bodies.select(F.col("sid").alias("s"), "body"), F.col("sid") == F.col("s"))
               .select("s", "sketch", F.col("bands").alias("band_keys"), "body"))
    content = written(content, "contents")
    size = F.octet_length("body") + F.octet_length("band_keys") + F.octet_length("sketch")
    sized = left.join(content.select("s", size.alias("size")), F.col("sid") == F.col("s")).drop("s")
    by_label = sized.groupBy("key", "label").agg(F.sum("size").alias("n"))
    per_key = by_label.groupBy(F.col("key").alias("k")).agg(
        F.max(F.struct("n", "label")).alias("most"), F.sum("n").alias("total"))
    few, outside = F.col("total") - F.col("most.n"), F.col("label") != F.col("most.label")
    blocks = [F.ceil(c / BLOCK_BYTES).cast("int") for c in (few, F.col("total"))]
    part = [F.pmod(F.xxhash64("sid", F.lit(x)), n).cast("int") for x, n in enumerate(blocks)]

    def place(i: Column, j: Column, query: Column, other: bool) -> Column:
        return F.struct(i.alias("i"), j.alias("j"), query.alias("query"), F.lit(other).alias("other"))

    def every(n: Column) -> Column:
        return F.sequence(F.lit(0), n - 1)

    # the blocks that a member is copied to: in one pass over the bands, and the sets are joined once
    as_query = F.transform(every(blocks[1]), lambda j: place(part[0], j, F.lit(True), False))
    as_other = F.transform(every(blocks[0]), lambda i: place(i, part[1], F.lit(False), True))
    places = (F.when(F.col("total") <= BLOCK_BYTES, F.array(place(F.lit(0), F.lit(0), outside, True)))
              .when(outside, F.concat(as_query, as_other)).otherwise(as_other))
    rows = left.join(apart(per_key), F.col("key") == F.col("k")).select("key", "sid", "label", F.explode(places).alias("at"))
    return (rows.join(content, F.col("sid") == F.col("s"))
            .select("key", "at.i", "at.j", "at.query", "at.other", "sid", "label", "sketch", F.col("band_keys").alias("bands"), "body")
            .repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
            .mapInArrow(_block_links(percent), "a binary, b binary"))


def _maybe(df: DataFrame, cols: list[str], wanted: DataFrame, out: str) -> DataFrame:
    """``df`` with a boolean column: the values of ``cols`` may be among the rows of ``wanted`` (by position). So only such rows
    need be shuffled with their texts."""
    h = hidden(df, "hash")
    cells = cells_for(wanted.count())
    words = written(filter_of(wanted.select(F.xxhash64(*wanted.columns).alias("h")), "h", cells), "filter")
    return probe(df.withColumn(h, F.xxhash64(*cols)), h, words, cells, out).drop(h)


def _grouped(own: DataFrame, percent: int) -> tuple[DataFrame, DataFrame]:
    """Sketches of the rows (d, t and others, which pass through), and (sid, root, d) of each set: its component and
    the smallest id of its rows."""
    bound_batches(own.sparkSession)
    passed = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in own.schema if f.name != "t")
    every = written(own.mapInArrow(
        partial(_sketches, band_rows(percent)), f"{passed}, n long, sid binary, bands binary, sketch binary"), "sketches")
    own = own.select("d", "t")

    # one node for each distinct set; of its documents the one with the smallest id stands for it
    sets = written(every.where("sid IS NOT NULL").groupBy("sid").agg(
        F.min("d").alias("d"), F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "sets")
    members = sets.mapInArrow(_band_members, "key long, sid binary")
    shared = members.groupBy(F.col("key").alias("k")).agg(F.min("sid").alias("least"), F.count("*").alias("c")).where(
        "c > 1")
    bands = written(members.join(apart(shared), F.col("key") == F.col("k")).select("key", "sid", "least"), "bands")

    # full sets of those that share a band with another
    needed = written(bands.select("sid").distinct().join(sets.select("sid", "d"), "sid").select(
        F.col("d").alias("need_d")).distinct(), "needed")
    texts = _maybe(own, ["d"], needed, "may").where("may").join(needed, same("d", "need_d"), "left_semi").select("d", "t")
    bodies = written(texts.mapInArrow(_full_sets, "sid binary, body binary").dropDuplicates(["sid"]), "shingles")
    linked = _linked(percent)

    def confirmed(pairs: DataFrame) -> DataFrame:
        a = bodies.select(F.col("sid").alias("sa"), F.col("body").alias("xa"))
        b = bodies.select(F.col("sid").alias("sb"), F.col("body").alias("xb"))
        return (pairs.join(a, F.col("a") == F.col("sa")).join(b, F.col("b") == F.col("sb"))
                .select(*pairs.columns, linked("xa", "xb").alias("ok")))

    first = bands.groupBy(F.col("sid").alias("a")).agg(F.min("least").alias("b")).where("a != b")
    tried = written(confirmed(first), "tried")
    found = written(connected(tried.where("ok").select("a", "b")), "found")
    for wave in ("star", "blocks"):
        label = written(bands.join(found, F.col("sid") == F.col("node"), "left").select(
            "key", "sid", F.coalesce("root", "sid").alias("label")), "labels")
        several = label.groupBy(F.col("key").alias("k")).agg(
            F.min(F.struct("label", "sid")).alias("m"), F.max("label").alias("top")).where("m.label != top")
        left = label.join(apart(several), F.col("key") == F.col("k"))
        # the links are pairs of labels, which are roots or sets without a link so far
        if wave == "star":
            pairs = left.where("label != m.label").select(
                F.greatest("sid", "m.sid").alias("a"), F.least("sid", "m.sid").alias("b"),
                F.greatest("label", "m.label").alias("one"), F.least("label", "m.label").alias("two")).distinct()
            pairs = written(pairs.join(tried.select("a", "b"), ["a", "b"], "left_anti"), "pairs")
            more = confirmed(pairs).where("ok").select(F.col("one").alias("a"), F.col("two").alias("b"))
        else:
            left = written(left.select("key", "sid", "label"), "left")
            if left.isEmpty():
                break
            more = _last_links(left, sets, bodies, percent)
        found = joined_up(found, more, of_roots=True)

    return every, sets.select("sid", "d").join(found, F.col("sid") == F.col("node"), "left").select(
        "sid", F.coalesce("root", "sid").alias("root"), "d")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 85) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept."""
    every, node = _grouped(docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t")), percent)
    least = node.groupBy(F.col("root").alias("r")).agg(F.min("d").alias("component"))
    of_set = node.join(apart(least), F.col("root") == F.col("r")).select(F.col("sid").alias("s"), "component")
    full = every.where("sid IS NOT NULL").select("d", "n", "sid").join(of_set, F.col("sid") == F.col("s")).select(
        "d", "n", "component")
    empty = every.where("sid IS NULL").select("d", "n", F.col("d").alias("component"))
    return full.unionByName(empty).select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"),
        F.col("d").eqNullSafe(F.col("component")).alias("kept"))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """(d, th), once each: id and 128-bit hash of the text of the rows that have a near-duplicate other than themselves."""
    own = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"), F.unhex(F.md5(text_col)).alias("th"))
    every, node = _grouped(own, percent)
    rows = written(every.where("sid IS NOT NULL").select("d", "th", "sid").join(
        apart(node.select(F.col("sid").alias("s"), "root")), F.col("sid") == F.col("s"))
        .select("root", "d", "th").distinct(), "near-rows")
    groups = rows.groupBy(F.col("root").alias("r")).agg(F.count("*").alias("n")).where("n > 1").select("r")
    return rows.join(apart(groups), F.col("root") == F.col("r")).select("d", "th")


def drop_near(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", percent: int = 80) -> DataFrame:
    """``docs`` with one row of each group of near-duplicates, columns as they were: of the smallest id, and of that the
    smallest hash of the text. Rows without shingles all stay."""
    key, th = (hidden(docs, x) for x in ("near_key", "near_text"))
    # 128 bits that tell the texts of one id, or of no id, apart
    told = docs.withColumns({key: F.col(id_col), th: F.unhex(F.md5(text_col))})
    every, node = _grouped(told.select(F.col(key).alias("d"), F.col(text_col).alias("t"), F.col(th).alias("th")), percent)
    cells = written(every.where("sid IS NOT NULL").select("d", "th", "sid").join(
        apart(node.select(F.col("sid").alias("s"), "root")), F.col("sid") == F.col("s"))
        .groupBy("root", "d", "th").agg(F.count("*").alias("n")), "near-rows")
    stays = (cells.groupBy(F.col("root").alias("r")).agg(
        F.min(F.struct(F.col("d").isNull().alias("none"), "d", "th")).alias("stay"), F.sum("n").alias("rows"))
        .where("rows > 1"))
    stay = F.col("d").eqNullSafe(F.col("stay.d")) & (F.col("th") == F.col("stay.th"))
    marks = written(cells.join(apart(stays), F.col("root") == F.col("r")).where(~stay | (F.col("n") > 1)).select(
        F.col("d").alias("mark_d"), F.col("th").alias("mark_th"), stay.alias("stays")), "near-marks")
    md, mt, ms = (hidden(told, x) for x in ("mark_d", "mark_th", "mark_stays"))
    marks = marks.select(F.col("mark_d").alias(md), F.col("mark_th").alias(mt), F.col("stays").alias(ms))
    on = same(key, md) & (F.col(th) == F.col(mt))
    may = hidden(told, "near_may")
    told = _maybe(told, [key, th], marks.select(md, mt), may)
    out = told.where(~F.col(may)).unionByName(told.where(may).join(marks, on, "left_anti"))
    repeated = marks.where(ms)
    if not repeated.isEmpty():
        out = out.unionByName(told.where(may).join(repeated, on, "left_semi").dropDuplicates([key, th]))
    return out.drop(key, th, may)
