"""Tables that a plan uses more than once, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that the cluster names for checkpoints; for a local master without one, in a temporary one."""
    sc = spark.sparkContext
    folder = sc.getCheckpointDir() or sc.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="cloakframe-")
    return f"{folder}/{name}-{uuid.uuid4()}"


def stored(df: DataFrame, name: str = "table") -> DataFrame:
    """`df`, computed once: written as Parquet and read again. It outlives executors and takes part in column pruning."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
