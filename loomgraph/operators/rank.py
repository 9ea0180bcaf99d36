"""PageRank by pulled contributions."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.sized import fits_task, in_task
from ..plans.store import settle, settle_by
from . import kernels
from .graph import Graph

DAMPING = 0.85


def pagerank(g: Graph, max_iters: int = 20, epsilon: float | None = None, engine: str = "auto") -> DataFrame:
    """``id, score``: all contributions of a round use the scores before it; the rank of vertices without out-edges is
    not shared out.  Stops after ``max_iters`` rounds, or after the first whose summed change is below ``epsilon``."""
    if fits_task(g.edges, g.vertices, engine):
        return in_task(g.edges, "id long, score double", lambda ids, s, d, w: kernels.pagerank(ids, s, d, max_iters, epsilon or 0.0, DAMPING), g.vertices)
    n = g.num_nodes()
    degree = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = settle_by(g.edges.select("src", "dst").join(degree, "src"), "src")
    scores = g.vertices.select("id", F.lit(1.0 / max(n, 1)).alias("score"), F.lit(0.0).alias("change"))
    for _ in range(max_iters):
        scores = settle(_round(g, edges, scores, n))
        if epsilon and (scores.agg(F.sum("change").alias("e")).first().e or 0.0) < epsilon:
            break
    return scores.select("id", "score")


def _round(g: Graph, edges: DataFrame, scores: DataFrame, n: int) -> DataFrame:
    gained = edges.join(scores, edges.src == scores.id).groupBy("dst").agg(F.sum(F.col("score") / F.col("degree")).alias("gain"))
    new = F.lit((1 - DAMPING) / max(n, 1)) + DAMPING * F.coalesce("gain", F.lit(0.0))
    return scores.join(gained, scores.id == gained.dst, "left").select("id", new.alias("score"), F.abs(new - F.col("score")).alias("change"))


def verify_pagerank(g: Graph, scores: DataFrame, target: float = 4e-4) -> DataFrame:
    """One row ``error, valid``: the summed change of one more round, and whether it is below ``target``."""
    degree = g.edges.groupBy("src").agg(F.count("*").alias("degree"))
    more = _round(g, g.edges.select("src", "dst").join(degree, "src"), scores, g.num_nodes())
    return more.agg(F.coalesce(F.sum("change"), F.lit(0.0)).alias("error")).select("error", (F.col("error") < target).alias("valid"))
