"""Distributed connected components by alternating large and small stars."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, label): label is the least node of the node's component.

    edges: columns ``a`` and ``b`` of one orderable type; direction, repeats, loops and nulls don't matter. Nodes
    without edges aren't returned; an empty table of edges gives an empty result.

    A large star links every greater neighbour of a node with the least of its neighbours and itself, a small star the
    node and its lesser neighbours with the least of them (Kiveris et al., 2014). Both keep components as they are and
    never add edges; in turn they shorten any chain, however it is numbered, in a number of rounds that is logarithmic
    in practice, until every component is one star. There is no limit of rounds: the search ends when it is done.

    Scale: the least of a hub's neighbours is partially aggregated before it is exchanged, and joins have an exchange
    on either side, so adaptive execution can split a hub's rows. Each star is written to the shared folder.
    """
    pairs = edges.where("a is not null and b is not null and a <> b")
    down = pairs.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
    down = materialize(_small(materialize(down.distinct(), "cc-edges")), "cc-small")
    while not _stars(down):
        down = materialize(_large(down), "cc-large")
        down = materialize(_small(down), "cc-small")
    labels = down.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(labels.select(F.col("label").alias("node"), "label").distinct())


def _large(down: DataFrame) -> DataFrame:
    """Edges (greater, lesser): of each node's greater neighbours to the least of its neighbourhood."""
    below = down.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
    met = down.join(below, down.b == below.node, "left")  # nodes without lesser neighbours are the least themselves
    return met.select("a", F.coalesce("low", "b").alias("b")).distinct()


def _small(down: DataFrame) -> DataFrame:
    """Edges (greater, lesser): of each node and its lesser neighbours to the least of them."""
    below = down.groupBy("a").agg(F.min("b").alias("low")).select(F.col("a").alias("node"), "low")
    met = down.join(below, down.a == below.node).select("b", "low").where("b <> low")
    own = below.select(F.col("node").alias("a"), F.col("low").alias("b"))
    return own.union(met.select(F.col("b").alias("a"), F.col("low").alias("b"))).distinct()


def _stars(down: DataFrame) -> bool:
    """Whether each node has one lesser neighbour at most, and then no greater ones."""
    ends = down.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    odd = ends.groupBy("node").agg(F.sum("up").alias("up"), F.count(F.lit(1)).alias("all")).where("up > 1 or (up = 1 and all > 1)")
    return odd.limit(1).count() == 0
