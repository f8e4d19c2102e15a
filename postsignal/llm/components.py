"""Connected components of a link table, by repeated contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .frames import stored


def components(links: DataFrame) -> DataFrame:
    """(node, root) for every node of `links` (columns a, b; long); root is its class' name.

    Each round points every node at its smallest neighbour, follows the pointers
    to their ends, and replaces nodes by their ends in the links. A node that is
    no local minimum disappears, so the number of nodes at least halves and the
    rounds grow with the logarithm of the largest class. Only linked nodes
    appear; null ends and loops are ignored; no links give no rows.

    A hub with many links is pre-aggregated before its shuffle where rows are
    grouped; joins read stored tables on both sides, so that AQE can split it.
    """
    edges = stored(_proper(links.select("a", "b")), "cc-links")
    levels = []
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parents = both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("up"))
        parents = stored(parents.select("node", F.least("node", "up").alias("up")), "cc-up")
        parents = _follow(parents)
        levels.append(parents)
        half = edges.join(_named(parents, "a", "x"), "a").select("x", "b")
        full = half.join(_named(parents, "b", "y"), "b").select(F.col("x").alias("a"), F.col("y").alias("b"))
        edges = stored(_proper(full), "cc-links")
    if not levels:
        return links.select(F.col("a").alias("node"), F.col("b").alias("root")).limit(0)
    result = levels[0]
    for later in levels[1:]:
        moved = result.join(later.select(F.col("node").alias("up"), F.col("up").alias("top")), "up", "left")
        result = stored(moved.select("node", F.coalesce("top", "up").alias("up")), "cc-roots")
    return result.select("node", F.col("up").alias("root"))


def _proper(links: DataFrame) -> DataFrame:
    """Distinct links with the smaller end first, without loops."""
    real = links.filter(F.col("a") != F.col("b"))
    return real.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _named(parents: DataFrame, node: str, up: str) -> DataFrame:
    return parents.select(F.col("node").alias(node), F.col("up").alias(up))


def _follow(parents: DataFrame) -> DataFrame:
    """Pointers replaced by the pointers of their targets until all targets are ends."""
    while True:
        jumped = parents.join(_named(parents, "up", "top"), "up").select("node", "up", "top")
        jumped = stored(jumped, "cc-jump")
        parents = jumped.select("node", F.col("top").alias("up"))
        if jumped.filter(F.col("up") != F.col("top")).isEmpty():
            return parents
