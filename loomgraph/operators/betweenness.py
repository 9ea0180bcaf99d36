"""Betweenness from chosen sources: path counts level by level, then dependencies back."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

from ..plans.sized import fits_task, frontier, in_task
from ..plans.store import settle
from . import kernels
from .graph import Graph


def betweenness(g: Graph, sources: list[int], include_source: bool = True, engine: str = "auto") -> DataFrame:
    """``id, score, raw``: dependencies summed over the sources (``raw``), and divided by the largest of them (NaN if all are
    0).  ``include_source=False`` leaves a source's own dependency out."""
    if fits_task(g.edges, g.vertices, engine):
        return in_task(g.edges, "id long, score double, raw double", lambda ids, s, d, w: kernels.betweenness(ids, s, d, sources, include_source), g.vertices)
    g = g.settled()
    parts = [_one(g, s, include_source) for s in sources]
    raw = reduce(DataFrame.union, parts).groupBy("id").agg(F.sum("delta").alias("delta"))
    raw = settle(g.vertices.join(raw, "id", "left").select("id", F.coalesce("delta", F.lit(0.0)).alias("raw")))
    top = raw.agg(F.max("raw").alias("m")).first().m or 0.0
    return raw.select("id", (F.col("raw") / F.lit(top) if top > 0 else F.lit(float("nan"))).alias("score"), "raw")


def _one(g: Graph, source: int, include_source: bool) -> DataFrame:
    edges = g.edges.select("src", "dst")
    # abs makes a new attribute: frames of several sources are put together, and those of one vertex column clash
    seen = settle(g.find_vertex(source).select(F.abs("id").alias("id"), F.lit(0).alias("depth"), F.lit(1.0).alias("sigma")))
    depth = 0
    while True:
        front, n = frontier(seen.filter(F.col("depth") == depth).select(F.col("id").alias("src"), "sigma"))
        if not n:
            break
        new = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("sigma").alias("sigma")).join(seen, "id", "left_anti")
        depth += 1
        seen = settle(seen.union(new.select("id", F.lit(depth).alias("depth"), "sigma")))
    # edges of the shortest-path graph: one level down
    up = seen.select(F.col("id").alias("src"), F.col("depth").alias("d"), F.col("sigma").alias("s"))
    down = seen.select(F.col("id").alias("dst"), F.col("depth").alias("e"), F.col("sigma").alias("t"))
    dag = settle(edges.join(up, "src").join(down, "dst").filter("e = d + 1").select("src", "dst", "d", (F.col("s") / F.col("t")).alias("share")))
    delta = settle(seen.filter(F.col("depth") == depth - 1).select("id", F.lit(0.0).alias("delta")))
    for level in range(depth - 2, -1, -1):
        got = dag.filter(F.col("d") == level).join(delta, F.col("dst") == F.col("id"), "left").groupBy("src").agg(F.sum(F.col("share") * (1 + F.coalesce("delta", F.lit(0.0)))).alias("delta"))
        here = seen.filter(F.col("depth") == level).join(got, F.col("id") == F.col("src"), "left").select("id", F.coalesce("delta", F.lit(0.0)).alias("delta"))
        delta = settle(delta.union(here))
    return delta if include_source else delta.filter(F.col("id") != source)
