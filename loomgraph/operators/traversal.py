"""Breadth-first search: depths and parents, reach, and discovery order."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..plans.sized import fits_task, frontier, in_task
from ..plans.store import settle, settle_by
from . import kernels
from .graph import Graph


def bfs(g: Graph, source: int, engine: str = "auto") -> DataFrame:
    """``id, depth, parent`` of every vertex reached; the smallest parent of the level before is taken, the source is
    its own.  A source that is no vertex reaches nothing."""
    if fits_task(g.edges, None, engine):
        start = g.find_vertex(source)
        return in_task(g.edges, "id long, depth int, parent long", lambda ids, s, d, w: kernels.bfs(ids, s, d, source), start)
    edges = settle_by(g.edges.select("src", "dst"), "src")
    seen = settle(g.find_vertex(source).select("id", F.lit(0).alias("depth"), F.col("id").alias("parent")))
    depth = 0
    while True:
        front, n = frontier(seen.filter(F.col("depth") == depth).select(F.col("id").alias("src")))
        if not n:
            return seen
        new = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("src").alias("parent")).join(seen, "id", "left_anti")
        depth += 1
        seen = settle(seen.union(new.select("id", F.lit(depth).alias("depth"), "parent")))


def reachable_count(g: Graph, source: int, engine: str = "auto") -> DataFrame:
    return bfs(g, source, engine).agg(F.count("*").alias("reached"))


def discovery_order(g: Graph, source: int, engine: str = "auto") -> DataFrame:
    """``id, rank``: when a first-in first-out search with ascending neighbours discovers a vertex, from 0."""
    if fits_task(g.edges, None, engine):
        return in_task(g.edges, "id long, rank long", lambda ids, s, d, w: kernels.discovery(ids, s, d, source), g.find_vertex(source))
    edges = settle_by(g.edges.select("src", "dst"), "src")
    seen = settle(g.find_vertex(source).select("id", F.lit(0).cast("long").alias("rank"), F.lit(0).alias("depth")))
    depth, count = 0, 1
    while True:
        front, n = frontier(seen.filter(F.col("depth") == depth).select(F.col("id").alias("src"), "rank"))
        if not n:
            return seen.select("id", "rank")
        new = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min("rank").alias("by")).join(seen, "id", "left_anti")
        # ranks inside a level: a total order of one level, the only step that isn't dealt out
        ranked = new.select("id", (F.row_number().over(Window.orderBy("by", "id")) - 1 + count).cast("long").alias("rank"))
        depth += 1
        seen = settle(seen.union(ranked.select("id", "rank", F.lit(depth).alias("depth"))))
        count += seen.filter(F.col("depth") == depth).count()


def bfs_goal_rank(g: Graph, source: int, goal: int | None = None, engine: str = "auto") -> DataFrame:
    """One row ``rank``: how many vertices are discovered before ``goal``; without a goal, or if it isn't reached, how
    many are reached at all.  A missing source is an error."""
    if not g.find_vertex(source).limit(1).count():
        raise ValueError(f"vertex {source} doesn't exist")
    order = discovery_order(g, source, engine)
    if goal is None:
        return order.agg(F.count("*").alias("rank"))
    if goal == source:
        # met again by the first edge that leads back: all that were discovered until its source was done with
        back = g.edges.filter(F.col("dst") == goal).join(order, g.edges.src == order.id).agg(F.min("rank").alias("r"))
        neigh = g.edges.join(order.withColumnRenamed("rank", "by"), g.edges.src == order.id).select("dst", "by").groupBy("dst").agg(F.min("by").alias("by"))
        before = neigh.crossJoin(F.broadcast(back)).filter((F.col("by") < F.col("r")) | ((F.col("by") == F.col("r")) & (F.col("dst") < goal)))
        found = before.filter(F.col("dst") != source).agg(F.count("*").alias("c"), F.max("r").alias("r"))
        total = order.agg(F.count("*").alias("n"))
        return found.crossJoin(total).crossJoin(back.withColumnRenamed("r", "there")).select(F.when(F.col("there").isNull(), F.col("n")).otherwise(F.col("c") + 1).alias("rank"))
    return order.agg(F.count("*").alias("n"), F.min(F.when(F.col("id") == goal, F.col("rank"))).alias("r")).select(F.coalesce("r", "n").alias("rank"))


def verify_bfs(g: Graph, source: int, found: DataFrame) -> DataFrame:
    """One row ``valid``: the source alone has depth 0, no edge leaves what was found or skips a level, and every other
    vertex has a parent one level above over an edge."""
    a = found.select(F.col("id").alias("src"), F.col("depth").alias("a"))
    b = found.select(F.col("id").alias("dst"), F.col("depth").alias("b"))
    bad_edge = g.edges.join(a, "src").join(b, "dst", "left").filter("b is null or b > a + 1").agg(F.count("*").alias("x"))
    kids = found.filter(F.col("id") != source).select("id", "depth", F.col("parent").alias("src"))
    proved = kids.join(a, "src", "left").join(g.edges.select("src", F.col("dst").alias("id"), F.lit(1).alias("e")), ["src", "id"], "left")
    bad_parent = proved.agg(F.sum(F.when((F.col("a") + 1 == F.col("depth")) & F.col("e").isNotNull(), 0).otherwise(1)).alias("y"))
    roots = found.agg(F.sum((F.col("depth") == 0).cast("int")).alias("z"))
    return bad_edge.crossJoin(bad_parent).crossJoin(roots).select(((F.col("x") == 0) & (F.coalesce("y", F.lit(0)) == 0) & (F.col("z") == 1)).alias("valid"))
