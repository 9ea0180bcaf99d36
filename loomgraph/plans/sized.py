"""Choice of plan by checked size.

An iterative graph query over a small graph costs almost only jobs.  If the edges are at most ``TASK_EDGES``, they
are brought to one task, where the whole iteration runs on flat arrays; the count that decides it reads at most
one edge more.  Larger graphs run as rounds of joins over all executors."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

#: 24 bytes each: some 100 MB with the kernels' index arrays.
TASK_EDGES = 2_000_000


#: Rows of a frontier (some 16 bytes each) that are broadcast to the edges, which then stay where they are.
FRONTIER = 1_000_000


def frontier(df: DataFrame) -> tuple[DataFrame, int]:
    """The rows of one round, marked for a broadcast if they are few, and their number."""
    n = df.count()
    return (F.broadcast(df) if n <= FRONTIER else df), n


def spread(df: DataFrame) -> DataFrame:
    """``df``, dealt to all cores if it is read by fewer tasks (a small table of one file); else as it is."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df._jdf.queryExecution().toRdd().getNumPartitions() < cores else df


def fits_task(edges: DataFrame, vertices: DataFrame | None, engine: str) -> bool:
    """Whether the graph goes to one task; ``engine`` is "auto", "task" or "cluster"."""
    if engine not in ("auto", "task", "cluster"):
        raise ValueError("engine must be auto, task or cluster")
    if engine != "auto":
        return engine == "task"
    some = edges.select(F.lit(1)).limit(TASK_EDGES + 1)
    if vertices is not None:
        some = some.union(vertices.select(F.lit(1)).limit(TASK_EDGES + 1))
    return some.count() <= TASK_EDGES


def in_task(edges: DataFrame, schema: str, kernel: Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], dict], vertices: DataFrame | None = None, weight: bool = False) -> DataFrame:
    """Run ``kernel(ids, src, dst, weight)`` in one task over the whole graph; ends are places in ``ids``, which are
    ascending; it returns columns by name."""
    null = F.lit(None).cast("long")
    rows = edges.select("src", "dst", F.col("weight") if weight else null.alias("weight"))
    if vertices is not None:
        rows = rows.union(vertices.select("id", null, null))

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        got = list(parts)
        if not got:
            return
        t = pd.concat(got, ignore_index=True)
        edge = t["dst"].notna().to_numpy()
        src, dst = t["src"].to_numpy()[edge].astype(np.int64), t["dst"].to_numpy()[edge].astype(np.int64)
        if weight and t["weight"].to_numpy()[edge].size and pd.isna(t["weight"][edge]).any():
            raise ValueError("an edge has no weight")
        w = t["weight"].to_numpy()[edge].astype(np.int64) if weight else np.zeros(0, np.int64)
        ids = np.unique(np.concatenate([t["src"].to_numpy().astype(np.int64), dst]))
        yield pd.DataFrame(kernel(ids, np.searchsorted(ids, src), np.searchsorted(ids, dst), w))

    return rows.repartition(1).mapInPandas(run, schema)
