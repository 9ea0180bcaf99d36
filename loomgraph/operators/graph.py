"""The graph: a vertex table and a simple, loop-free edge table."""

from __future__ import annotations

import dataclasses

from pyspark.sql import DataFrame, functions as F

from ..functions.normalise import dedup_edges, drop_loops, restrict_to_vertices, symmetrize, transpose
from ..plans.store import settle_by


@dataclasses.dataclass(frozen=True)
class Graph:
    """``vertices``: ``id``; ``edges``: ``src, dst, weight``, at most one per pair, without loops, in both directions if
    the graph is undirected.  Vertices are 0 .. largest id, so an id that no edge has is an isolated vertex."""

    vertices: DataFrame
    edges: DataFrame
    directed: bool = True
    records: DataFrame | None = None

    @staticmethod
    def from_edges(raw: DataFrame, directed: bool = True, num_vertices: int | None = None, weight_policy: str = "min", order: str | None = None) -> Graph:
        """Normalise raw edges.  Without ``num_vertices`` one pass finds the largest id.  Edges with an end below 0 or from
        ``num_vertices`` on are left out."""
        spark = raw.sparkSession
        if num_vertices is None:
            top = raw.agg(F.max(F.greatest("src", "dst")).alias("m")).first().m
            num_vertices = 0 if top is None else max(top + 1, 0)
        vertices = spark.range(num_vertices)
        edges = drop_loops(raw).filter(F.col("src").between(0, num_vertices - 1) & F.col("dst").between(0, num_vertices - 1))
        if not directed:
            edges = symmetrize(edges)
        return Graph(vertices, dedup_edges(edges, weight_policy, order), directed, raw)

    def num_nodes(self) -> int:
        return self.vertices.count()

    def num_edges(self) -> int:
        """Edges as stored; an undirected edge counts once."""
        return self.edges.count() // (1 if self.directed else 2)

    def num_edges_directed(self) -> int:
        """Input records, loops and parallels included, twice if undirected; the stored edges if there was no input."""
        if self.records is None:
            return self.edges.count()
        return self.records.count() * (1 if self.directed else 2)

    def out_degree(self) -> DataFrame:
        found = self.edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("out_degree"))
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("out_degree", F.lit(0)).cast("long").alias("out_degree"))

    def in_degree(self) -> DataFrame:
        found = self.edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("in_degree"))
        return self.vertices.join(found, "id", "left").select("id", F.coalesce("in_degree", F.lit(0)).cast("long").alias("in_degree"))

    def out_neigh(self, v: int) -> DataFrame:
        """Neighbours over out-edges, ascending."""
        return self.edges.filter(F.col("src") == v).select(F.col("dst").alias("id"), "weight").orderBy("id")

    def in_neigh(self, v: int) -> DataFrame:
        return self.edges.filter(F.col("dst") == v).select(F.col("src").alias("id"), "weight").orderBy("id")

    def adjacency(self) -> DataFrame:
        """``id, neighbours``: ascending array of (dst, weight) of every vertex with out-edges."""
        return self.edges.groupBy(F.col("src").alias("id")).agg(F.array_sort(F.collect_list(F.struct("dst", "weight"))).alias("neighbours"))

    def find_vertex(self, v: int) -> DataFrame:
        return self.vertices.filter(F.col("id") == v)

    def transposed(self) -> Graph:
        return dataclasses.replace(self, edges=transpose(self.edges))

    def replace_out_edges(self, new: DataFrame, sources: DataFrame | None = None) -> Graph:
        """The out-edges of every source in ``new`` replaced by those in it; ends that are no vertices are ignored.

        ``sources``: ids (``id``) that are replaced too; those without a row in ``new`` have no out-edges then."""
        gone = new.select("src") if sources is None else new.select("src").union(sources.select("id"))
        mine = self.edges.join(gone.distinct(), "src", "left_anti").select("src", "dst", "weight")
        return dataclasses.replace(self, edges=mine.unionByName(dedup_edges(drop_loops(restrict_to_vertices(new.select("src", "dst", "weight"), self.vertices)))))

    def replace_in_edges(self, new: DataFrame, targets: DataFrame | None = None) -> Graph:
        """The same for in-edges of the targets in ``new`` and in ``targets``."""
        turned = dataclasses.replace(self, edges=transpose(self.edges)).replace_out_edges(transpose(new.select("src", "dst", "weight")), targets)
        return dataclasses.replace(self, edges=transpose(turned.edges))

    def stats(self) -> DataFrame:
        """One row: nodes, edges, loops are never stored, largest out-degree."""
        e = self.edges.agg(F.count("*").alias("edges"))
        d = self.edges.groupBy("src").count().agg(F.coalesce(F.max("count"), F.lit(0)).alias("max_out_degree"))
        return self.vertices.agg(F.count("*").alias("nodes")).crossJoin(e).crossJoin(d)

    def settled(self) -> Graph:
        """The same graph with its edges computed once and kept in the shared folder, dealt by source."""
        return dataclasses.replace(self, edges=settle_by(self.edges, "src"))
