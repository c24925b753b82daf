"""Prefix trie of conversations by van Emde Boas recursion: shared beginnings, and the tokens they would save.

A sequence of turns is cut at half its depth, again and again, into segments of ``SEGMENT`` turns at last; no
sequence is ever one group, however long it is.

1. Names. A segment's content has a digest, two neighbours' digests make that of the block twice as long (up the
   recursion). The cut prefix at half a block's depth is named by the name at its start and the
   digest of its upper half (down the recursion, all blocks of a size at once); inside a segment the same recursion runs on
   arrays. Equal prefixes of different sequences get equal names without being compared.
2. The upper trie and all lower forests are built at once: rows of equal names are a node. A node is known by its smallest
   member and its depth from then on; that member owns it.
3. Totals. Of every sequence only the nodes that it owns count. The lower half's total is grafted on every node of the upper half,
   inside segments first, then block by block up the recursion, so each row holds what its sequence owns from there on; a
   node's subtree total is the sum over its members' rows.

Every step groups by name, node or (sequence, segment); sums are combined before the shuffle, and rows of a node with very
many members can be split where they meet the node's row.

Names are 128 bits of SHA-256.

Defined results: null roles and texts are empty; rows without a conversation id belong to none and are left
out; null turns come first; rows of one turn number are ordered by the digest of role and text, repeated rows are a turn each;
conversations without any turn are members of the root; an empty table has no nodes; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import apart, bound_batches, written
from sensorlake.plans.ranking import with_position

by_value(__name__)

#: Turns of a segment: 2^6.
SEGMENT_BITS = 6
SEGMENT = 1 << SEGMENT_BITS
#: Conversation ids listed together: at most 2^14 different ones.
LIST_BITS = 14
ROOT = hashlib.sha256(b"root").digest()[:16]


def _joined(a: bytes, b: bytes) -> bytes:
    return hashlib.sha256(a + b).digest()[:16]


def _name(a: Column, b: Column) -> Column:
    """``_joined`` as a column."""
    return F.substring(F.unhex(F.sha2(F.concat(a, b), 256)), 1, 16)


# --------------------------------------------------------------------------- turns
def turns(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv, pos, key, weight): the turns in order; ``key`` is a digest of role and text, ``weight`` the
    text's UTF-8 bytes. Written; texts are not carried on."""
    who, what = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    key = _name(F.concat(F.octet_length(who).cast("string"), F.lit(":"), who).cast("binary"), what.cast("binary"))
    rows = written(conversations.where(F.col(conv).isNotNull()).select(
        F.col(conv).alias("conv"), F.col(turn).alias("turn"), key.alias("key"), F.octet_length(what).cast("long").alias("weight")), "turns")
    order = rows.withColumn("digest", F.hex("key"))
    return with_position(order, ["conv"], ["turn", "digest"]).select("conv", "pos", "key", "weight")


def branched(rows: DataFrame, group: int = 5, depths: int = 9) -> tuple[DataFrame, DataFrame]:
    """(turns, conversations) where every conversation begins with turns of its group's first one: conversation c with the first h of
    c - c % ``group``, h = crc32(c) % ``depths``, then its own after its first h."""
    rows = written(rows, "positions")
    h = F.crc32(F.col("conv").cast("string")) % depths
    first = rows.where(F.col("pos") < depths - 1).select(
        F.col("conv").alias("base"), F.col("pos").alias("base_pos"), F.col("key").alias("base_key"), F.col("weight").alias("base_weight"))
    convs = rows.groupBy("conv").agg(F.count(F.lit(1)).alias("n")).withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % group)
    bases = convs.select(F.col("conv").alias("base"), F.col("n").alias("base_n"))
    convs = written(convs.join(bases, "base", "left").select(
        "conv", "base", "h", F.least("h", F.coalesce("base_n", F.lit(0))).alias("taken")), "conversations")
    begun = (convs.join(first, "base").where(F.col("base_pos") < F.col("taken"))
             .select("conv", F.col("base_pos").alias("pos"), F.col("base_key").alias("key"), F.col("base_weight").alias("weight")))
    own = (rows.where(F.col("pos") >= h).join(apart(convs.select("conv", "h", "taken")), "conv")
           .select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "key", "weight"))
    return own.unionByName(begun), convs.select("conv")


# --------------------------------------------------------------------------- inside a segment
def _digests(keys: list[bytes], lo: int, hi: int, found: dict) -> bytes:
    """Digest of the full block lo .. hi, and of all blocks in it."""
    if hi - lo == 1:
        found[lo, hi] = keys[lo]
    else:
        mid = (lo + hi) // 2
        found[lo, hi] = _joined(_digests(keys, lo, mid, found), _digests(keys, mid, hi, found))
    return found[lo, hi]


def _named(keys: list[bytes], lo: int, hi: int, name: bytes, names: list[bytes]) -> None:
    """Names of the prefixes that end after lo, lo + 1 .. (at most hi) turns, given that before ``lo``."""
    if hi - lo == 1:
        names[lo] = _joined(name, keys[lo])
        return
    mid = (lo + hi) // 2
    if len(keys) > mid:
        blocks: dict = {}
        cut = _joined(name, _digests(keys, lo, mid, blocks))
        _named(keys, lo, mid, name, names)
        names[mid - 1] = cut
        _named(keys, mid, hi, cut, names)
    else:
        _named(keys, lo, mid, name, names)
        if len(keys) == mid:
            names[mid - 1] = _joined(name, _digests(keys, lo, mid, {}))


def _block_digest(keys: list[bytes]) -> bytes | None:
    return _digests(keys, 0, SEGMENT, {}) if len(keys) == SEGMENT else None


def _with_digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests = [_block_digest(keys) for keys in batch.column("keys").to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(digests, pa.binary())], [*batch.schema.names, "digest"])


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for every prefix that ends in a segment."""
    for batch in batches:
        row, depth, names = [], [], []
        for k, (seg, keys, name) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("seg", "keys", "name")))):
            own: list[bytes] = [b""] * len(keys)
            _named(keys, 0, SEGMENT, name, own)
            names += own
            row += [k] * len(keys)
            depth += range(seg * SEGMENT + 1, seg * SEGMENT + len(keys) + 1)
        at = pa.array(row, pa.int64())
        yield pa.RecordBatch.from_arrays(
            [batch.column("conv").take(at), pa.array(depth, pa.int64()), pa.array(names, pa.binary()),
             batch.column("weights").flatten().cast(pa.int64()), batch.column("length").take(at)],
            ["conv", "depth", "name", "weight", "length"])


def _owned_sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of every row of a segment: its parent's owner, whether its sequence owns the next row, and what the
    sequence owns from the row to the segment's end (the lower half's total is grafted on the upper half, from single rows up)."""
    for batch in batches:
        n = batch.column("depth").value_lengths().to_numpy().astype(np.int64)
        row = np.repeat(np.arange(len(n)), n)
        depth, first, n_convs, weight = (batch.column(c).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
                                         for c in ("depth", "first", "n_convs", "weight"))
        leaf = batch.column("leaf").flatten().to_numpy(zero_copy_only=False).astype(bool)
        conv, seg = (batch.column(c).to_numpy().astype(np.int64)[row] for c in ("conv", "seg"))
        own, owned = depth >> SEGMENT_BITS == seg, first == conv
        chained = np.append(row[1:] == row[:-1], False)                    # the next depth follows
        before = np.concatenate([first[:1], first[:-1]])
        orphan = ~np.concatenate([[False], chained[:-1]])
        following = chained & np.append(owned[1:], False)
        sums, totals = [], []
        for value in (np.where(owned, (n_convs - 1) * weight, 0), (owned & leaf).astype(np.int64)):
            padded = np.zeros((len(n), SEGMENT), np.int64)
            padded[row[own], depth[own] & (SEGMENT - 1)] = value[own]
            half = 1
            while half < SEGMENT:
                blocks = padded.reshape(len(padded), -1, 2, half)
                blocks[:, :, 0, :] += blocks[:, :, 1, :1]
                half *= 2
            sums.append(padded[row[own], depth[own] & (SEGMENT - 1)])
            totals.append(pa.array(padded[:, 0]))
        at = pa.array(np.concatenate([[0], np.cumsum(np.bincount(row[own], minlength=len(n)))]), pa.int32())
        rows = pa.StructArray.from_arrays(
            [pa.array(depth[own]), pa.array(first[own]), pa.array(before[own], mask=orphan[own]),
             pa.array(following[own].astype(np.int64)), *map(pa.array, sums)],
            ["depth", "first", "parent", "following", "saved", "leaves"])
        yield pa.RecordBatch.from_arrays([batch.column("conv"), batch.column("seg"), pa.ListArray.from_arrays(at, rows), *totals],
                                         ["conv", "seg", "rows", "saved_all", "leaves_all"])


# --------------------------------------------------------------------------- recursion over segments
def _halves(blocks: DataFrame, carried: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Blocks of twice the size: (conv, seg) and columns made of (even, odd) neighbours, null where one is missing."""
    even = F.col("seg") % 2 == 0
    pick = {c: (F.max(F.when(even, F.col(c))), F.max(F.when(~even, F.col(c)))) for c in carried}
    out = blocks.groupBy("conv", F.shiftright("seg", 1).alias("up")).agg(
        *[x.alias(f"{c}_{k}") for c, pair in pick.items() for k, x in enumerate(pair)])
    return out.select("conv", F.col("up").alias("seg"), *[expression.alias(c) for c, (expression, _) in carried.items()])


def _levels(last: int) -> int:
    return int(last).bit_length()


def _start_names(segments: DataFrame, last: int) -> DataFrame:
    """(conv, seg, name): the name of the prefix before each segment. ``segments``: conv, seg, digest (null
    unless full); ``last``: the largest segment number."""
    up = [segments.select("conv", "seg", "digest")]
    for _ in range(_levels(last)):
        whole = F.when(F.col("digest_0").isNotNull() & F.col("digest_1").isNotNull(), _name(F.col("digest_0"), F.col("digest_1")))
        up.append(_halves(up[-1], {"digest": (whole, whole)}))
    names = up[-1].select("conv", "seg", F.lit(ROOT).alias("name"))
    for lower in reversed(up[:-1]):
        # the block's own start, and the cut in its middle
        even = lower.where(F.col("seg") % 2 == 0).select("conv", F.shiftright("seg", 1).alias("up"), "digest")
        both = names.join(even, (names["conv"] == even["conv"]) & (names["seg"] == even["up"])).select(
            names["conv"], "up", "name", "digest")
        starts = both.select("conv", (F.col("up") * 2).alias("seg"), "name").unionByName(
            both.where(F.col("digest").isNotNull()).select(
                "conv", (F.col("up") * 2 + 1).alias("seg"), _name(F.col("name"), F.col("digest")).alias("name")))
        names = starts.join(lower.select("conv", "seg"), ["conv", "seg"], "left_semi")
    return names


def _grafts(segments: DataFrame, last: int) -> DataFrame:
    """(conv, seg, saved_after, leaves_after): totals of a sequence's later segments."""
    totals = ["saved_all", "leaves_all"]
    up = [segments.select("conv", "seg", *totals)]
    for _ in range(_levels(last)):
        up.append(_halves(up[-1], {c: ((F.coalesce(f"{c}_0", F.lit(0)) + F.coalesce(f"{c}_1", F.lit(0))), F.lit(0)) for c in totals}))
    after = up[-1].select("conv", "seg", F.lit(0).cast("long").alias("saved_after"), F.lit(0).cast("long").alias("leaves_after"))
    for lower in reversed(up[:-1]):
        # the lower half's totals on the upper half
        graft = lower.where(F.col("seg") % 2 == 1).select("conv", (F.col("seg") - 1).alias("seg"), *totals)
        above = after.select("conv", F.col("seg").alias("up"), "saved_after", "leaves_after")
        own = lower.select("conv", "seg", F.shiftright("seg", 1).alias("up")).join(above, ["conv", "up"])
        after = own.join(graft, ["conv", "seg"], "left").select(
            "conv", "seg", (F.col("saved_after") + F.coalesce("saved_all", F.lit(0))).alias("saved_after"),
            (F.col("leaves_after") + F.coalesce("leaves_all", F.lit(0))).alias("leaves_after"))
    return after


# --------------------------------------------------------------------------- lists of ids
def _list_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of every node's list, whose parts come in order; one part is in memory at a time."""
    node, state = None, None
    for batch in batches:
        done = []
        for first, depth, part in zip(*(batch.column(c).to_pylist() for c in ("first", "depth", "part"))):
            if (first, depth) != node:
                if node is not None:
                    done.append((*node, state.hexdigest()))
                node, state = (first, depth), hashlib.sha256(part.encode())
            else:
                state.update(b"," + part.encode())
        yield _digest_rows(done)
    if node is not None:
        yield _digest_rows([(*node, state.hexdigest())])


def _digest_rows(rows: list[tuple]) -> pa.RecordBatch:
    columns = list(zip(*rows)) or [(), (), ()]
    return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()),
                                       pa.array(columns[2], pa.string())], ["first", "depth", "ends_sha256"])


def list_digests(ends: DataFrame) -> DataFrame:
    """(first, depth, ends_sha256) of (first, depth, conv) rows: the ids in ascending order, comma-joined, hashed.

    Ids are listed in parts of a bounded range, so at most 2^14 together; a node's parts are hashed one after
    the other, as SHA-256 is sequential, and only parts, not ids, meet in that task."""
    parts = ends.groupBy("first", "depth", F.shiftright("conv", LIST_BITS).alias("range")).agg(
        F.array_join(F.array_sort(F.collect_list("conv")).cast("array<string>"), ",").alias("part"))
    return (parts.repartition("first", "depth").sortWithinPartitions("first", "depth", "range")
            .select("first", "depth", "part").mapInArrow(_list_digests, "first long, depth long, ends_sha256 string"))


# --------------------------------------------------------------------------- the operator
def prefix_trie(rows: DataFrame, convs: DataFrame) -> DataFrame:
    """The trie's nodes: conv_id (smallest member), depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256,
    all over whole sequences.

    ``rows``: conv long, pos (0, 1, 2 ... without gaps), key binary, weight long (what sharing this turn
    saves); ``convs``: conv, every sequence once, also those without rows."""
    spark = rows.sparkSession
    bound_batches(spark)
    rows = rows.withColumn("conv", F.col("conv").cast("long"))
    convs = convs.select(F.col("conv").cast("long").alias("conv"))

    # 1. names
    segments = (rows.groupBy("conv", F.shiftright("pos", SEGMENT_BITS).alias("seg"))
                .agg(F.array_sort(F.collect_list(F.struct("pos", "key", "weight"))).alias("turns"))
                .select("conv", "seg", F.col("turns.key").alias("keys"), F.col("turns.weight").alias("weights")))
    segments = written(segments.mapInArrow(
        _with_digest, "conv long, seg long, keys array<binary>, weights array<long>, digest binary"), "segments")
    last = segments.agg(F.max("seg")).first()[0] or 0
    lengths = written(segments.groupBy("conv").agg(F.sum(F.size("keys")).alias("length")), "lengths")
    inner = (segments.join(_start_names(segments, last), ["conv", "seg"]).join(lengths, "conv")
             .select("conv", "seg", "keys", "weights", "name", "length")
             .mapInArrow(_prefixes, "conv long, depth long, name binary, weight long, length long"))
    nought = F.lit(0).cast("long")
    roots = convs.join(lengths, "conv", "left").select(
        "conv", nought.alias("depth"), F.lit(ROOT).alias("name"), nought.alias("weight"),
        F.coalesce("length", nought).alias("length"))
    prefixes = written(roots.unionByName(inner).withColumn("ends", F.col("depth") == F.col("length")).drop("length"), "prefixes")

    # 2. the upper trie and all lower forests: equal names are a node
    nodes = prefixes.groupBy("name").agg(F.min("conv").alias("first"), F.count(F.lit(1)).alias("n_convs"),
                                         F.count_if("ends").alias("n_ends"))
    placed = written(prefixes.join(apart(nodes), "name").select(
        "conv", "depth", "first", "n_convs", "weight", "ends", (F.col("n_ends") == F.col("n_convs")).alias("leaf")), "placed")

    # 3. totals; a segment also sees the depth before its first and that after its last
    seg, inside = F.shiftright("depth", SEGMENT_BITS), F.col("depth") % SEGMENT
    seen = F.array_distinct(F.array(seg, F.when(inside == 0, F.greatest(seg - 1, nought)).when(
        inside == SEGMENT - 1, seg + 1).otherwise(seg)))
    cell = ["depth", "first", "n_convs", "weight", "leaf"]
    cells = placed.select("conv", F.explode(seen).alias("seg"), F.struct(*cell).alias("cell"))
    runs = cells.groupBy("conv", "seg").agg(F.array_sort(F.collect_list("cell")).alias("cells"))
    runs = runs.select("conv", "seg", *[F.col(f"cells.{c}").alias(c) for c in cell]).mapInArrow(
        _owned_sums, "conv long, seg long, rows array<struct<depth:long,first:long,parent:long,following:long,saved:long,leaves:long>>, "
        "saved_all long, leaves_all long")
    runs = written(runs.where(F.size("rows") > 0), "runs")
    deepest = runs.agg(F.max("seg")).first()[0] or 0
    whole = runs.join(_grafts(runs, deepest), ["conv", "seg"]).select("conv", F.explode("rows").alias("r"), "saved_after", "leaves_after")
    found = whole.groupBy(F.col("r.first").alias("first"), F.col("r.depth").alias("depth")).agg(
        F.max(F.when(F.col("r.first") == F.col("conv"), F.col("r.parent"))).alias("parent"), F.count(F.lit(1)).alias("n_convs"),
        F.sum("r.following").alias("n_children"), F.sum(F.col("r.leaves") + F.col("leaves_after")).alias("n_leaves"),
        F.sum(F.col("r.saved") + F.col("saved_after")).alias("saved_tokens"))
    lists = list_digests(placed.where("ends").select("first", "depth", "conv"))
    return found.join(lists, ["first", "depth"], "left").select(
        F.col("first").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs", "n_children", "n_leaves",
        "saved_tokens", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256"))
