"""Edge-table functions: each takes and returns a DataFrame ``src, dst, weight``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

POLICIES = ("min", "max", "sum", "first", "last")


def drop_loops(edges: DataFrame) -> DataFrame:
    return edges.filter("src <> dst")


def transpose(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), *[c for c in edges.columns if c not in ("src", "dst")])


def symmetrize(edges: DataFrame) -> DataFrame:
    """Both directions of every edge; parallels are left for :func:`dedup_edges`."""
    return edges.unionByName(transpose(edges))


def dedup_edges(edges: DataFrame, policy: str = "min", order: str | None = None) -> DataFrame:
    """One edge per (src, dst).

    ``min`` needs no input order and is what shortest paths want; ``first`` and ``last`` go by the column ``order``."""
    if policy not in POLICIES:
        raise ValueError(f"policy must be one of {POLICIES}")
    w = F.col("weight")
    if policy in ("first", "last"):
        if order is None:
            raise ValueError(f"policy {policy!r} needs an order column")
        weight = (F.min_by if policy == "first" else F.max_by)(w, F.col(order))
    else:
        weight = {"min": F.min, "max": F.max, "sum": F.sum}[policy](w)
    return edges.groupBy("src", "dst").agg(weight.alias("weight"))


def restrict_to_vertices(edges: DataFrame, vertices: DataFrame) -> DataFrame:
    """Edges both of whose ends are vertices."""
    ids = vertices.select("id")
    return edges.join(ids.withColumnRenamed("id", "src"), "src", "left_semi").join(ids.withColumnRenamed("id", "dst"), "dst", "left_semi").select(*edges.columns)


def max_node_id(edges: DataFrame) -> DataFrame:
    return edges.agg(F.max(F.greatest("src", "dst")).alias("max_id"))


def count_degrees(edges: DataFrame, both_ends: bool = True) -> DataFrame:
    """How often each id occurs as an end (or only as ``src``)."""
    ends = F.array("src", "dst") if both_ends else F.array("src")
    return edges.select(F.explode(ends).alias("id")).groupBy("id").agg(F.count("*").alias("degree"))


def uniform(seed: int, *names: str | Column) -> Column:
    """A number in [0, 1) that depends on nothing but the seed and the columns."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), *names), 11) / F.lit(float(1 << 53))


def below(n: int, seed: int, *names: str | Column) -> Column:
    """A whole number in [0, n) that depends on nothing but the seed and the columns."""
    return F.pmod(F.xxhash64(F.lit(seed), *names), F.lit(n).cast("long"))
