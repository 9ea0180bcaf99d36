"""A mutation log as a stream: each micro-batch's transactions are applied to the stored graph."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.mutation import LOG, apply_txns


class GraphStore:
    """Versions of a graph below a folder: ``v<n>/vertices``, ``v<n>/edges`` and ``v<n>/txns``.

    A version is written whole before the row in ``current`` names it, so a repeated or broken batch leaves the one
    before."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _state(self) -> dict:
        try:
            rows = self.spark.read.text(f"{self.path}/current").collect()
        except Exception as e:  # noqa: BLE001 - only a missing path means a new store
            if "PATH_NOT_FOUND" not in str(e):
                raise
            return {"version": -1, "batch": -1, "last_txn": None}
        return max((json.loads(r.value) for r in rows), key=lambda s: s["version"])

    def create(self, vertices: DataFrame, edges: DataFrame) -> None:
        self._write(0, -1, None, vertices.select("id"), edges.select("src", "dst", "weight"), None)

    def _write(self, version: int, batch: int, last_txn: int | None, vertices: DataFrame, edges: DataFrame, txns: DataFrame | None) -> None:
        at = f"{self.path}/v{version}"
        vertices.write.mode("overwrite").parquet(f"{at}/vertices")
        edges.write.mode("overwrite").parquet(f"{at}/edges")
        if txns is not None:
            txns.write.mode("overwrite").parquet(f"{at}/txns")
        line = json.dumps({"version": version, "batch": batch, "last_txn": last_txn})
        self.spark.createDataFrame([(line,)], "value string").coalesce(1).write.mode("append").text(f"{self.path}/current")

    def graph(self) -> tuple[DataFrame, DataFrame]:
        at = f"{self.path}/v{self._state()['version']}"
        return self.spark.read.parquet(f"{at}/vertices"), self.spark.read.schema("src long, dst long, weight long").parquet(f"{at}/edges")

    def results(self) -> DataFrame:
        n = self._state()["version"]
        parts = [self.spark.read.parquet(f"{self.path}/v{k}/txns") for k in range(1, n + 1)]
        out = self.spark.createDataFrame([], "txn_id long, txn_status string, failed long")
        for p in parts:
            out = out.union(p)
        return out

    def apply(self, batch: DataFrame, batch_id: int, strict: bool = False) -> None:
        """Transactions up to the last one applied are late and are reported as such; a batch is applied once."""
        state = self._state()
        if batch_id <= state["batch"]:
            return
        vertices, edges = self.graph()
        last = state["last_txn"]
        late = batch.limit(0) if last is None else batch.filter(F.col("txn_id") <= last)
        fresh = batch if last is None else batch.filter(F.col("txn_id") > last)
        vertices, edges, done = apply_txns(vertices, edges, fresh, strict)
        rejected = late.groupBy("txn_id").agg(F.lit("Late").alias("txn_status"), F.count("*").alias("failed"))
        top = fresh.agg(F.max("txn_id").alias("m")).first().m
        self._write(state["version"] + 1, batch_id, last if top is None else top, vertices, edges, done.union(rejected.select("txn_id", "txn_status", "failed")))


def stream_ops(spark: SparkSession, source: str, store: GraphStore, checkpoint: str, strict: bool = False, files_per_batch: int = 1) -> StreamingQuery:
    """Apply the Parquet log files that appear in ``source`` and stop when none is left."""
    log = spark.readStream.schema(LOG).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    return log.writeStream.option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(lambda batch, k: store.apply(batch, k, strict)).start()
