"""Connected components of a table of links by stars; every round is a grouping, two joins and a distinct."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import counted, discard, fitted, materialize, small


def components(links: DataFrame) -> tuple[DataFrame, int]:
    """((node, component), rows) of every node of ``links`` (a, b): the component's least node. No links: no rows.

    Edges point from the larger node u to the smaller v. In a round every node links itself and all its neighbours to the least of them, which
    keeps the components and halves the distances to the least node. Only nodes with a smaller neighbour have a least one other than themselves, so the table
    of least neighbours is keyed by larger ends, and the hub of a star, on whose key a third of the edges may lie, has no row in it. When a round
    changes no edge, the edges are stars around the least nodes. Each round is written, so plans stay short; the write counts what changed.
    """
    edges, seen = counted(links.where("a != b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "cc-edges")
    n, moved = seen["n"], 1
    while n and moved:
        least = fitted(edges.groupBy("u").agg(F.min("v").alias("m")), n)
        mu, mv = least.select("u", F.col("m").alias("mu")), least.select(F.col("u").alias("v"), F.col("m").alias("mv"))
        met = edges.join(small(mu, n), "u").join(small(mv, n), "v", "left")
        own = F.coalesce("mv", "v")
        changes = ((F.col("mu") != F.col("v")) | F.col("mv").isNotNull()).alias("moved")
        new = F.array(F.struct(F.col("u"), F.col("mu").alias("v")), F.struct("u", own.alias("v")), F.struct(F.col("v").alias("u"), F.col("mu").alias("v")))
        new = met.select(changes, F.explode(new).alias("e")).where("e.u != e.v")
        # least and greatest are kept as they are: mu and own are never larger than what they are linked to
        new = fitted(new.groupBy("e.u", "e.v").agg(F.max("moved").alias("moved")), 3 * n)
        old = edges
        edges, seen = counted(new, "cc-edges", F.sum(F.col("moved").cast("long")).alias("moved"))
        n, moved = seen["n"], seen["moved"]
        edges = _read(edges)
        discard(old)
    nodes = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    nodes = materialize(fitted(nodes.unionByName(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()), 2 * n), "cc-nodes")
    discard(edges)
    return nodes, 2 * n


def _read(edges: DataFrame) -> DataFrame:
    out = edges.select("u", "v")
    out.written_to = edges.written_to
    return out


def merged(of: DataFrame, n: int, links: DataFrame) -> tuple[DataFrame, int]:
    """``components`` of what gave ``of`` (``n`` rows) together with more ``links`` (a, b): only components, not nodes, are linked anew. ``of`` is deleted."""
    a, b = (small(of.select(F.col("node").alias(k), F.col("component").alias("c" + k)), n) for k in "ab")
    contracted = links.join(a, "a", "left").join(b, "b", "left").select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b"))
    above, more = components(contracted)
    top = small(above.select(F.col("node").alias("component"), F.col("component").alias("top")), more)
    old = of.join(top, "component", "left").select("node", F.coalesce("top", "component").alias("component"))
    new = above.join(small(of.select("node"), n), "node", "left_anti")
    out = materialize(fitted(old.unionByName(new), n + more), "cc-nodes")
    discard(of, above)
    return out, n + more
