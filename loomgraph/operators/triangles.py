"""Triangle counting by joins over edges oriented from the vertex of lower degree."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.store import settle
from .graph import Graph


def triangle_count_ordered(g: Graph) -> DataFrame:
    """One row ``triangles``: edges u -> v, v -> w, u -> w with u > v > w.

    They are the triangles of the edges that lead to smaller ids, taken as undirected, so a hub is no hot key here either."""
    return _closed(_oriented(g.edges.filter("src > dst"))).agg(F.count("*").alias("triangles"))


def _oriented(edges: DataFrame) -> DataFrame:
    """Each undirected edge once, ``x`` to ``y``, from the end of lower (degree, id) to the other, so that no vertex has
    more than the square root of twice the edges to give; stored, as it is read several times."""
    pairs = edges.select(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).distinct()
    degree = pairs.select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count("*").alias("d"))
    both = pairs.join(degree.select(F.col("id").alias("a"), F.col("d").alias("da")), "a").join(degree.select(F.col("id").alias("b"), F.col("d").alias("db")), "b")
    first = (F.col("da") < F.col("db")) | ((F.col("da") == F.col("db")) & (F.col("a") < F.col("b")))
    return settle(both.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("x"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("y")))


def _closed(e: DataFrame) -> DataFrame:
    """``x, y, z``: the triangles of oriented edges."""
    wedge = e.join(e.select(F.col("x").alias("y"), F.col("y").alias("z")), "y")
    return wedge.join(e.select("x", F.col("y").alias("z")), ["x", "z"]).select("x", "y", "z")


def triangles(g: Graph) -> DataFrame:
    """``x, y, z``: every triangle of the undirected graph once."""
    return _closed(_oriented(g.edges))


def triangle_count(g: Graph) -> DataFrame:
    return triangles(g).agg(F.count("*").alias("triangles"))


def triangles_per_vertex(g: Graph) -> DataFrame:
    """``id, triangles`` of the vertices that are in any."""
    return triangles(g).select(F.explode(F.array("x", "y", "z")).alias("id")).groupBy("id").agg(F.count("*").alias("triangles"))


def verify_triangles(g: Graph, count: int) -> DataFrame:
    """One row ``valid``: what the ends of each oriented edge both lead to, summed over the edges, is the count.

    The lists are as short as the orientation keeps them, a hub's included."""
    e = _oriented(g.edges)
    near = e.groupBy("x").agg(F.collect_list("y").alias("n"))
    pairs = e.join(near, "x").join(near.select(F.col("x").alias("y"), F.col("n").alias("m")), "y")
    return pairs.agg(F.coalesce(F.sum(F.size(F.array_intersect("n", "m"))), F.lit(0)).alias("s")).select((F.col("s") == count).alias("valid"))
