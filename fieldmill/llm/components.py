"""Connected components by contraction, as joins and aggregations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Scratch


def connected(edges: DataFrame) -> DataFrame:
    """(id, component) for every id in ``edges`` (columns a, b): component is
    the smallest id reachable.

    Each round points every node at its smallest neighbour, follows that
    pointer once more, and contracts the edges to the pointed-at nodes.
    The smallest node of a component always points at itself, so it is what
    remains; the edges shrink each round, and rounds grow with the logarithm
    of the longest path.  Repeated, reversed and self edges are allowed; no
    edges give no rows.
    """
    scratch = Scratch(edges.sparkSession, "components")
    live = scratch.write(edges.select(F.least("a", "b").cast("long").alias("a"),
                                      F.greatest("a", "b").cast("long").alias("b"))
                         .where("a is not null and a <> b").distinct(), "edges")
    label = scratch.write(live.select(F.col("a").alias("id")).union(live.select("b")).distinct()
                          .withColumn("component", F.col("id")), "labels")
    while not live.isEmpty():
        both = live.union(live.select(F.col("b"), F.col("a")))
        near = scratch.write(both.groupBy(F.col("a").alias("u")).agg(F.min("b").alias("m"))
                             .select("u", F.least("u", "m").alias("p")), "pointers")
        second = near.select(F.col("u").alias("v"), F.col("p").alias("pp"))
        jump = scratch.write(near.join(second, near.p == second.v, "left")
                             .select("u", F.coalesce("pp", "p").alias("p")), "jumps")
        old_label, old_live = label, live
        label = scratch.write(label.join(jump, label.component == jump.u, "left")
                              .select("id", F.coalesce("p", "component").alias("component")), "labels")
        left = jump.select(F.col("u").alias("a"), F.col("p").alias("x"))
        right = jump.select(F.col("u").alias("b"), F.col("p").alias("y"))
        live = scratch.write(live.join(left, "a").join(right, "b").where("x <> y")
                             .select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b")).distinct(),
                             "edges")
        scratch.drop(near, jump, old_label, old_live)
    return label


def components_of(scratch: Scratch, rows: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """(c, component): for every class (``node``) that is linked, the smallest
    row id reachable.  ``rows`` (id, digest) belong to ``classes`` (digest,
    node, class: its smallest id); ``links`` (a, b) are between nodes.  Classes
    that share an id are linked through it."""
    ids = rows.select("id", "digest").join(classes.select("digest", "node"), "digest").select("id", "node").distinct()
    shared = ids.groupBy("id").agg(F.min("node").alias("a"), F.max("node").alias("b")).where("a <> b")
    through = ids.join(shared.select("id", "a"), "id").select("a", F.col("node").alias("b"))
    found = scratch.write(connected(links.select("a", "b").union(through).where("a <> b")), "components")
    named = found.join(classes.select(F.col("node").alias("id"), "class"), "id")
    least = named.groupBy("component").agg(F.min("class").alias("least"))
    return found.join(least, "component").select(F.col("id").alias("c"), F.col("least").alias("component"))
