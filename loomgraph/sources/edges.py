"""Edge tables from text files and from relational tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def _whole(field: Column) -> Column:
    """A non-negative whole number, a plus sign allowed; anything else is null."""
    return F.when(field.rlike(r"^\+?[0-9]+$"), field.try_cast("long"))


def read_edge_list(spark: SparkSession, path: str) -> DataFrame:
    """``src, dst, weight`` of a delimited edge list.

    Lines are cut at single blanks or tabs; the third field is the weight if it is a non-negative whole number; further
    fields are ignored.  A line without two ids is an error, as it names no edge."""
    part = F.split("value", "[ \\t]")
    rows = spark.read.text(path).select(_whole(F.get(part, 0)).alias("src"), _whole(F.get(part, 1)).alias("dst"), _whole(F.get(part, 2)).alias("weight"), "value")
    bad = F.raise_error(F.concat(F.lit("not an edge: "), F.col("value"))).cast("long")
    return rows.select(*[F.when(F.col("src").isNull() | F.col("dst").isNull(), bad).otherwise(F.col(c)).alias(c) for c in ("src", "dst")], "weight")


def write_edge_list(edges: DataFrame, path: str) -> None:
    """The inverse of :func:`read_edge_list`: blank-separated text."""
    edges.select(F.concat_ws(" ", "src", "dst", "weight").alias("value")).write.text(path)


def edges_from_table(table: DataFrame, src: str | Column, dst: str | Column, weight: str | Column | None = None) -> DataFrame:
    """Raw edges from any two columns; rows with a null end are no edges."""
    col = lambda c: F.col(c) if isinstance(c, str) else c
    w = F.lit(None) if weight is None else col(weight)
    return table.select(col(src).cast("long").alias("src"), col(dst).cast("long").alias("dst"), w.cast("long").alias("weight")).filter("src is not null and dst is not null")
