"""Where intermediate tables live.

Lineage is cut only through reliable storage: the folder named by ``spark.checkpoint.dir``, which all
executors and the driver share on a cluster.  A folder of our own is chosen only where nothing is set
(single-machine tests).
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """The shared folder of this session; sets one only if neither the conf nor the context has any."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current is None:
        if not named and not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = named or f"{tempfile.gettempdir()}/loomgraph-{uuid.uuid4().hex[:12]}"
        spark.sparkContext.setCheckpointDir(current)
    return named or current


def scratch(spark: SparkSession, label: str) -> str:
    """A new path below the shared folder."""
    return f"{shared_dir(spark).rstrip('/')}/loomgraph/{label}-{uuid.uuid4().hex[:12]}"


def settle(df: DataFrame) -> DataFrame:
    """Compute ``df`` once, eagerly, into the shared folder and return the stored copy."""
    shared_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settle_by(df: DataFrame, *keys: str) -> DataFrame:
    """Like :func:`settle`, dealt by ``keys``: joins and aggregates by them need no exchange of the stored rows.

    Spark knows how a stored table is dealt only if its plan was not adaptive."""
    conf = df.sparkSession.conf
    was = conf.get("spark.sql.adaptive.enabled")
    conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return settle(df.repartition(*keys))
    finally:
        conf.set("spark.sql.adaptive.enabled", was)


def stored(df: DataFrame, label: str) -> DataFrame:
    """Like :func:`settle`, as a Parquet table: columns can then be pruned on later reads."""
    spark = df.sparkSession
    path = scratch(spark, label)
    schema = df.schema
    df.write.parquet(path)
    return spark.read.schema(schema).parquet(path)
