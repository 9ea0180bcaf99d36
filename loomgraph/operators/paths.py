"""Single-source shortest paths over non-negative whole weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.sized import fits_task, frontier, in_task
from ..plans.store import settle, settle_by
from . import kernels
from .graph import Graph

UNREACHABLE = 9_223_372_036_854_775_807


def sssp(g: Graph, source: int, delta: int | None = None, fill_unreachable: bool = False, engine: str = "auto") -> DataFrame:
    """``id, dist``.  Unreached vertices are left out, or get ``UNREACHABLE``.

    ``delta`` only orders the work: with it, a round relaxes the pending vertices of the lowest bucket.  An edge without
    a weight is an error."""
    if fits_task(g.edges, None, engine):
        found = in_task(g.edges, "id long, dist long", lambda ids, s, d, w: kernels.sssp(ids, s, d, w, source), g.find_vertex(source), weight=True)
    else:
        found = _rounds(g, source, delta)
    if fill_unreachable:
        found = g.vertices.join(found, "id", "left").select("id", F.coalesce("dist", F.lit(UNREACHABLE)).alias("dist"))
    return found


def _rounds(g: Graph, source: int, delta: int | None) -> DataFrame:
    missing = F.raise_error(F.lit("an edge has no weight")).cast("long")
    edges = settle_by(g.edges.select("src", "dst", F.coalesce("weight", missing).alias("weight")), "src")
    state = settle(g.find_vertex(source).select("id", F.lit(0).cast("long").alias("dist"), F.lit(True).alias("pending")))
    while True:
        low = state.filter("pending").agg(F.min("dist").alias("m")).first().m
        if low is None:
            return state.select("id", "dist")
        now = F.col("pending") & (F.lit(True) if delta is None else F.col("dist") < (low // delta + 1) * delta)
        front, _ = frontier(state.filter(now).select(F.col("id").alias("src"), F.col("dist").alias("d")))
        offers = edges.join(front, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("d") + F.col("weight")).alias("offer"))
        both = state.withColumn("done", now).join(offers, "id", "full")
        better = F.col("offer").isNotNull() & (F.col("dist").isNull() | (F.col("offer") < F.col("dist")))
        state = settle(both.select("id", F.least("dist", "offer").alias("dist"), F.when(better, True).otherwise(F.coalesce(F.col("pending") & ~F.col("done"), F.lit(False))).alias("pending")))


def verify_sssp(g: Graph, source: int, found: DataFrame) -> DataFrame:
    """One row ``valid``: no edge offers less, and every distance but the source's 0 is offered by a path from the source.

    Edges of weight 0 could offer each other's ends a distance in a ring; where they do, the vertices are also counted that such
    offers reach from the source."""
    a = found.select(F.col("id").alias("src"), F.col("dist").alias("a"))
    offers = g.edges.join(a, "src").groupBy(F.col("dst").alias("id")).agg(F.min(F.col("a") + F.col("weight")).alias("offer"))
    both = found.join(offers, "id", "full")
    ok = F.when(F.col("id") == source, F.col("dist") == 0).otherwise(F.col("dist").eqNullSafe(F.col("offer")))
    valid = both.agg(F.coalesce(F.min(ok), F.lit(False)).alias("valid"))
    b = found.select(F.col("id").alias("dst"), F.col("dist").alias("b"))
    tight = settle(g.edges.join(a, "src").join(b, "dst").filter("a + weight = b").select("src", "dst", "weight"))
    if tight.filter("weight = 0").isEmpty():
        return valid
    reached = settle(found.filter(F.col("id") == source).select("id"))
    level = reached
    while True:
        front, n = frontier(level.select(F.col("id").alias("src")))
        if not n:
            return valid.select((F.col("valid") & F.lit(reached.count() == found.count())).alias("valid"))
        level = settle(tight.join(front, "src").select(F.col("dst").alias("id")).distinct().join(reached, "id", "left_anti"))
        reached = settle(reached.union(level))
