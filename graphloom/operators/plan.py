"""What the plans of several operators share: lineage that ends in the shared folder, and broadcasts behind a count."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows up to which a counted side is sent to every task; a row of ids and a short path is some hundred bytes.
MOST_SENT = 50_000


def shared_folder(spark: SparkSession) -> str:
    """The folder named by ``spark.checkpoint.dir``; only a session of one process without that setting gets its own."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared:
            if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
                raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
            shared = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(shared)
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """Cut the lineage through the shared checkpoint folder, so that a lost executor costs no recomputation."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def small(df: DataFrame, most: int = MOST_SENT) -> DataFrame:
    """The rows with a broadcast hint if a count finds at most so many; else as they are, and the join shuffles."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
