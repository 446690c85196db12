"""Connected components of a link table, without bringing it to the driver."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tarnwell.llm.common import BROADCAST_ROWS, counted, discard, rows_of, small, thin


def _star(edges: DataFrame, large: bool, rows: int) -> DataFrame:
    """rows: bounds the edges."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    else:
        both = edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    low = thin(both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m")), 2 * rows)
    hung = both.join(F.broadcast(low) if 2 * rows <= BROADCAST_ROWS else low, "a")
    if large:
        return hung.filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
    return thin(hung.select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b"))).filter("a <> b").distinct(), 2 * rows)


def _settled(edges: DataFrame) -> bool:
    """Whether each node hangs on one other and nothing hangs on it, or the other way round: stars, and so components."""
    nodes = edges.select(F.col("a").alias("node"), F.lit(1).alias("hangs"), F.lit(0).alias("bears"))
    nodes = nodes.unionByName(edges.select(F.col("b").alias("node"), F.lit(0).alias("hangs"), F.lit(1).alias("bears")))
    each = thin(nodes.groupBy("node").agg(F.sum("hangs").alias("hangs"), F.max("bears").alias("bears")), 2 * rows_of(edges))
    return each.filter("hangs + bears > 1").isEmpty()


def _stars(links: DataFrame, rows: int) -> DataFrame:
    edges = counted(thin(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a <> b").distinct(), rows))
    while not _settled(edges):
        last, edges = edges, counted(_star(_star(edges, True, rows_of(edges)), False, rows_of(edges)))
        discard(last)
    return edges


def _rooted(stars: DataFrame) -> DataFrame:
    return stars.select(F.col("a").alias("node"), F.col("b").alias("root")).union(stars.select("b", F.col("b").alias("root")).distinct())


def components(links: DataFrame) -> DataFrame:
    """links(a, b) -> node, root: every node of a link with the smallest node of its component.

    Large-star and small-star steps in turn: each node's larger neighbours, then its smaller ones, are hung on its smallest
    neighbour, until all are stars. Nodes are of any ordered type. A node's neighbours are only aggregated to a minimum,
    so no group is gathered. The minima are broadcast only if the counted edges bound them.
    """
    return _rooted(_stars(links, rows_of(links)))


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """roots(node, root) of earlier links with new links(a, b) taken in, materialized.

    Only links between different roots are walked, so a later call costs what it connects, not what is known by then.
    """
    met, held, rows = links, None, rows_of(links)
    if roots is not None:
        held = small(roots)
        side = lambda c: held.select(F.col("node").alias(c), F.col("root").alias(f"{c}_root"))
        met = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
        met = met.select(F.coalesce("a_root", "a").alias("a"), F.coalesce("b_root", "b").alias("b"))
    stars = _stars(met, rows)
    new = out = counted(thin(_rooted(stars), 2 * rows_of(stars)))
    if held is not None:
        moved = small(new).select(F.col("node").alias("root"), F.col("root").alias("to"))
        old = roots.join(moved, "root", "left").select("node", F.coalesce("to", "root").alias("root"))
        out = counted(thin(old.unionByName(new.join(held.select("node"), "node", "left_anti")), rows_of(roots) + rows_of(new)))
        discard(new)
    discard(stars)
    return out
