"""Weakly connected components by minimum labels with hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.sized import fits_task, in_task
from ..plans.store import settle
from . import kernels
from .graph import Graph


def min_labels(edges: DataFrame, src: str = "src", dst: str = "dst") -> DataFrame:
    """``id, label`` for every end of an edge; the label is the smallest id that is linked with it.

    Each round takes the smallest label among neighbours, hooks the old root under the smallest new label of its
    members, and jumps one pointer, so the rounds grow with the logarithm of the longest chain.  Every aggregate
    is a minimum, which combines on the map side, so a vertex of any degree costs one row per task."""
    pairs = edges.select(F.col(src).alias("src"), F.col(dst).alias("dst")).filter("src <> dst")
    both = settle(pairs.union(pairs.select("dst", "src")).distinct())
    labels = settle(both.groupBy(F.col("src").alias("id")).agg(F.least(F.min("dst"), F.first("src")).alias("label")))
    while True:
        near = both.join(labels, both.dst == labels.id).groupBy("src").agg(F.min("label").alias("near"))
        seen = labels.join(near, labels.id == near.src, "left").select("id", F.col("label").alias("old"), F.least("label", F.coalesce("near", "label")).alias("label"))
        seen = settle(seen)
        hooks = seen.groupBy(F.col("old").alias("root")).agg(F.min("label").alias("hook"))
        hooked = seen.join(hooks, seen.id == hooks.root, "left").select("id", "old", F.least("label", F.coalesce("hook", "label")).alias("label"))
        hooked = settle(hooked)
        up = hooked.select(F.col("id").alias("root"), F.col("label").alias("above"))
        after = settle(hooked.join(up, hooked.label == up.root, "left").select("id", "old", F.least("label", F.coalesce("above", "label")).alias("label")))
        changed = after.filter("label <> old").limit(1).count()
        labels = after.select("id", "label")
        if not changed:
            return labels


def connected_components(g: Graph, engine: str = "auto") -> DataFrame:
    """``id, component``: weakly connected, named by the smallest id; isolated vertices are components."""
    if fits_task(g.edges, g.vertices, engine):
        return in_task(g.edges, "id long, component long", lambda ids, s, d, w: kernels.components(ids, s, d), g.vertices)
    found = min_labels(g.edges)
    return g.vertices.join(found, "id", "left").select("id", F.coalesce("label", "id").alias("component"))


def component_sizes(components: DataFrame) -> DataFrame:
    return components.groupBy("component").agg(F.count("*").alias("size"))


def verify_components(g: Graph, components: DataFrame) -> DataFrame:
    """One row ``valid``: no edge joins two components, each is named by its smallest id, and each holds together (a
    second computation by labels gives as many)."""
    a = components.select(F.col("id").alias("src"), F.col("component").alias("a"))
    b = components.select(F.col("id").alias("dst"), F.col("component").alias("b"))
    across = g.edges.join(a, "src").join(b, "dst").agg(F.coalesce(F.sum((F.col("a") != F.col("b")).cast("int")), F.lit(0)).alias("x"))
    names = components.groupBy("component").agg(F.min("id").alias("m")).agg(F.coalesce(F.sum((F.col("m") != F.col("component")).cast("int")), F.lit(0)).alias("y"), F.count("*").alias("c"))
    again = connected_components(g, engine="cluster").agg(F.countDistinct("component").alias("d"))
    return across.crossJoin(names).crossJoin(again).select(((F.col("x") == 0) & (F.col("y") == 0) & (F.col("c") == F.col("d"))).alias("valid"))
