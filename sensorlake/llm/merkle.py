"""Merkle manifest of a dataset: a tree a source, a tree over the sources, a proof for every row.

A leaf is the SHA-256 of a row's fields, made where the row is read; texts are never shuffled. The leaves of a
source are ranked by id without putting a source into one task. Every ``RUN`` nodes in a row make one of the
next level, so a superblock of RUN^3 leaves in a row is a whole subtree:

1. Up: a superblock's leaves are grouped and reduced to its top node. The top nodes, a table
   4096 times smaller, are leaves of the next tier, and so on up to one subroot a source; the
   subroots are leaves of a last tree, reduced in the same way.
2. Down: the nodes of a superblock are cogrouped with the outer nodes it needs, the siblings on its way to the root (one
   row, bounded by the tree's height). A tier's cogroup finishes the local reduction once more, puts the local
   siblings before the outer ones and hands that on to the superblocks of the tier below.
3. At the leaves the same cogroup joins the proof and folds it: the root that follows from the leaf as claimed.

Defined results: null fields are ``-``; rows without a source are a source of their own, the first; null ids come
first in their source; repeated rows are a leaf each, one after the other (rows of one id are ordered by
their leaves); rows without a claim claim what they are; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sensorlake.functions.shipping import by_value
from sensorlake.llm.common import written
from sensorlake.plans.ranking import with_position

by_value(__name__)

RUN_BITS = 4
RUN = 1 << RUN_BITS
#: Levels of a superblock, and its leaves.
LEVELS = 3
BLOCK_BITS = LEVELS * RUN_BITS
#: Leaves ranked together, about.
BUCKET_ROWS = 4 << BLOCK_BITS
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def leaf_digest(fields: Sequence[Column]) -> Column:
    """SHA-256 of fields, each ``-`` if null, else its UTF-8 bytes' count, ``:`` and value."""
    parts = []
    for f in fields:
        value = f.cast("string")
        parts.append(F.when(value.isNull(), F.lit("-"))
                     .otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value)))
    return F.sha2(F.concat(*parts), 256)


# --------------------------------------------------------------------------- inside a superblock
def _digest(text: str) -> str:
    return hashlib.sha256(text.encode("ascii")).hexdigest()


def _height(n: int) -> int:
    """Levels above ``n`` nodes up to a single one."""
    levels = 0
    while n > 1:
        n = -(-n // RUN)
        levels += 1
    return levels


def _subtree(block: int, digests: list[str]) -> list[list[str]]:
    """All levels of a superblock. Only a tree of one superblock may be lower than ``LEVELS``."""
    levels = [digests]
    for _ in range(LEVELS if block else _height(len(digests))):
        below = levels[-1]
        levels.append([_digest("".join(below[i:i + RUN])) for i in range(0, len(below), RUN)])
    return levels


def _siblings(levels: list[list[str]], i: int) -> list[str]:
    """Left and right siblings of node ``i``, two strings a level."""
    path = []
    for level in levels[:-1]:
        first = i >> RUN_BITS << RUN_BITS
        path += ["".join(level[first:i]), "".join(level[i + 1:first + RUN])]
        i >>= RUN_BITS
    return path


def folded(digest: str, path: list[str]) -> str:
    """The root that follows from a digest and the siblings on its way."""
    for left, right in zip(path[::2], path[1::2]):
        digest = _digest(left + digest + right)
    return digest


def _top(key: tuple, nodes: pd.DataFrame) -> pd.DataFrame:
    tree, block = key
    levels = _subtree(block, nodes.sort_values("pos")["digest"].tolist())
    return pd.DataFrame({"tree": [tree], "pos": [block], "digest": [levels[-1][0]]})


def _handed_on(key: tuple, nodes: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
    """What each node of a superblock needs from outside of it."""
    nodes = nodes.sort_values("pos")
    levels = _subtree(key[1], nodes["digest"].tolist())
    around = list(outer["path"].iloc[0])
    return pd.DataFrame({"tree": nodes["tree"], "block": nodes["pos"],
                         "path": [_siblings(levels, i) + around for i in range(len(nodes))],
                         "subroot": outer["subroot"].iloc[0], "root": outer["root"].iloc[0]})


def _proved(with_path: bool):
    def prove(key: tuple, leaves: pd.DataFrame, outer: pd.DataFrame) -> pd.DataFrame:
        leaves = leaves.sort_values("pos")
        levels = _subtree(key[1], leaves["digest"].tolist())
        around, root = list(outer["path"].iloc[0]), outer["root"].iloc[0]
        tail = "".join(around)
        proofs, roots, paths = [], [], []
        for i, claimed in enumerate(leaves["claimed"]):
            path = _siblings(levels, i)
            proofs.append(_digest("".join(path) + tail))
            roots.append(folded(claimed, path + around))
            if with_path:
                paths.append(path + around)
        out = {"id": leaves["id"], "tree": leaves["tree"], "pos": leaves["pos"], "leaf": leaves["digest"],
               "subroot": outer["subroot"].iloc[0], "root": root, "proof_sha256": proofs, "folded_root": roots,
               "verified": [r == root for r in roots]}
        return pd.DataFrame(out | ({"proof": paths} if with_path else {}))
    return prove


# --------------------------------------------------------------------------- tiers
def _block(pos: str = "pos") -> Column:
    return F.shiftright(pos, BLOCK_BITS).alias("block")


def _tiers(leaves: DataFrame, largest: int) -> list[DataFrame]:
    """(tree, pos, digest) of every tier: the leaves, the tops of their superblocks, ... one node a tree.
    ``largest``: leaves of the largest tree."""
    tiers = [leaves]
    while True:
        grouped = tiers[-1].select("tree", "pos", "digest", _block()).groupBy("tree", "block")
        tiers.append(written(grouped.applyInPandas(_top, "tree string, pos long, digest string"), "merkle-nodes"))
        largest = -(-largest >> BLOCK_BITS)
        if largest <= 1:
            return tiers


_OUTER = "tree string, block long, path array<string>, subroot string, root string"


def _paths(tiers: list[DataFrame], outer: DataFrame) -> DataFrame:
    """From what whole trees need to what the superblocks of the lowest tier need (``tiers`` without
    their last, the single nodes)."""
    for nodes in reversed(tiers):
        outer = (nodes.select("tree", "pos", "digest", _block()).groupBy("tree", "block")
                 .cogroup(outer.groupBy("tree", "block")).applyInPandas(_handed_on, _OUTER))
    return outer


def manifest(docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", fields: Sequence[str] = FIELDS,
             claims: dict[str, Column] | None = None, claimed: Column | None = None, proofs: bool = False) -> DataFrame:
    """One row per document: id, source, pos (its place in the source), leaf, subroot, root, proof_sha256 (digest of all siblings),
    folded_root (from the leaf as claimed, with the siblings of the original), verified (that is the root); with ``proofs``
    also ``proof``, the siblings themselves (left and right, level by level).

    ``claims``: other values of some fields, to be verified in rows where ``claimed`` holds."""
    spark = docs.sparkSession
    claims = claims or {}
    digest = leaf_digest([F.col(f) for f in fields])
    other = leaf_digest([claims.get(f, F.col(f)) for f in fields])
    source = F.col(group_col).cast("string")
    # in the order of sources, and never null
    tree = F.when(source.isNull(), F.lit("")).otherwise(F.concat(F.lit("="), source))
    when = F.coalesce(claimed if claimed is not None else F.lit(bool(claims)), F.lit(False))
    leaves = written(docs.select(F.col(id_col).alias("id"), tree.alias("tree"), digest.alias("digest"),
                                 F.when(when, other).alias("claimed")), "merkle-leaves")
    placed = written(with_position(leaves, ["tree"], ["id", "digest"], bucket_rows=BUCKET_ROWS), "merkle-placed")
    largest = placed.agg(F.max("pos")).first()[0]
    largest = 0 if largest is None else largest + 1

    tiers = _tiers(placed, largest)
    subroots = with_position(tiers[-1].select(F.col("tree").alias("name"), "digest", F.lit("").alias("tree")), ["tree"], ["name"],
                             bucket_rows=BUCKET_ROWS)
    subroots = written(subroots, "merkle-subroots")
    above = _tiers(subroots, subroots.count())
    nothing = F.array().cast("array<string>")
    root = above[-1].select("tree", F.col("pos").alias("block"), nothing.alias("path"),
                            F.lit(None).cast("string").alias("subroot"), F.col("digest").alias("root"))
    around = _paths(above[:-1], root).select(F.col("block").alias("at"), "path", "root")
    outer = (subroots.join(around, subroots["pos"] == around["at"])
             .select(F.col("name").alias("tree"), F.lit(0).cast("long").alias("block"), "path", F.col("digest").alias("subroot"), "root"))
    outer = written(_paths(tiers[1:-1], outer), "merkle-outer")

    # ids go through pandas as text: integers with nulls would turn into floats there
    mine = placed.select(F.col("id").cast("string").alias("id"), "tree", "pos", "digest",
                         F.coalesce("claimed", "digest").alias("claimed"), _block())
    out = mine.groupBy("tree", "block").cogroup(outer.groupBy("tree", "block")).applyInPandas(
        _proved(proofs), "id string, tree string, pos long, leaf string, subroot string, root string, proof_sha256 string, "
        "folded_root string, verified boolean" + (", proof array<string>" if proofs else ""))
    return out.select(F.col("id").cast(leaves.schema["id"].dataType).alias(id_col),
                      F.when(F.col("tree") != "", F.substring("tree", 2, 1 << 30)).alias(group_col),
                      *[c for c in out.columns if c not in ("id", "tree")])
