"""Connected components of an edge table by alternating stars, in Spark joins and groupings.

Every round links each node's larger neighbours to its smallest one, then each
node and its smaller neighbours to their smallest. A hub is never gathered in one
task: minima are aggregated before the shuffle, and the join back has exchanges of its own on
both sides, so that Spark can split a hub's rows (``apart``).

Each half of a round is a table of its own, and rounds without links are left out: Spark's driver keeps
the metrics of a plan again for every exchange that it has run, so small plans cost it little.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sensorlake.llm.common import apart, written


def _star(edges: DataFrame) -> DataFrame:
    """edges (a, b) with a > b -> (a, smallest neighbour of a), (b, the same)."""
    least = edges.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m"))
    moved = edges.join(apart(least), F.col("a") == F.col("hub")).select("b", "m").where("b != m")
    return least.select(F.col("hub").alias("a"), F.col("m").alias("b")).unionByName(
        moved.select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Each node's larger neighbours are linked to the smallest of its neighbours and itself."""
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    least = both.groupBy(F.col("a").alias("hub")).agg(F.min("b").alias("m")).select(
        "hub", F.least("hub", "m").alias("m"))
    return (both.where("b > a").join(apart(least), F.col("a") == F.col("hub"))
            .select(F.col("b").alias("a"), F.col("m").alias("b")).where("a != b"))


def _done(edges: DataFrame) -> bool:
    """Every node has one parent, and no parent has one itself."""
    nodes = edges.select(F.col("a").alias("x"), F.lit(1).alias("up")).unionByName(
        edges.select(F.col("b").alias("x"), F.lit(0).alias("up")))
    open_nodes = nodes.groupBy("x").agg(F.sum("up").alias("ups"), F.min("up").alias("low")).where(
        "ups > 1 OR (ups = 1 AND low = 0)")
    return open_nodes.isEmpty()


def _links(edges: DataFrame) -> DataFrame:
    """Distinct links (a, b) with a > b, written."""
    return written(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
                   .where("a != b").distinct(), "links")


def _roots(now: DataFrame) -> DataFrame:
    """(node, root) of written links; roots themselves are listed too."""
    while not _done(now):
        now = written(_star(written(_large_star(now), "large-stars")), "stars")
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).unionByName(
        now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())


def connected(edges: DataFrame) -> DataFrame:
    """(a, b) pairs -> (node, root): the smallest node reachable; roots themselves are listed too.

    Pairs may repeat and come in either order; a pair of equal nodes links nothing.
    """
    return _roots(_links(edges))


def joined_up(found: DataFrame, links: DataFrame, of_roots: bool = False) -> DataFrame:
    """``found`` (node, root) with more links (a, b) between nodes, of which ``found`` need not know all. ``of_roots``:
    the links are between roots, or nodes that ``found`` does not know.

    Only the components that the links touch are worked on, each as one node.
    """
    if not of_roots:
        root = found.select(F.col("node").alias("n"), "root")
        ends = (links.join(root.select(F.col("n").alias("na"), F.col("root").alias("ra")), F.col("a") == F.col("na"), "left")
                .join(root.select(F.col("n").alias("nb"), F.col("root").alias("rb")), F.col("b") == F.col("nb"), "left")
                .select("a", "b", F.coalesce("ra", "a").alias("x"), F.coalesce("rb", "b").alias("y")))
        ends = written(ends, "ends")
        own = ends.select(F.col("a").alias("node"), F.col("x").alias("root")).unionByName(
            ends.select(F.col("b").alias("node"), F.col("y").alias("root")))
        found = found.unionByName(own).distinct()
        links = ends.select(F.col("x").alias("a"), F.col("y").alias("b"))
    links = _links(links)
    if links.isEmpty():
        return found
    moved = written(_roots(links), "moved")
    was = moved.select(F.col("node").alias("was"), F.col("root").alias("now"))
    return written(found.join(was, F.col("root") == F.col("was"), "left").select(
        "node", F.coalesce("now", "root").alias("root")).unionByName(moved).distinct(), "found")
