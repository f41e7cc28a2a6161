"""What operators need to know of the cluster: sizes, partitions and the folder for written tables."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame

#: Estimated bytes of a table up to which it is sent to every executor.
BROADCAST_BYTES = 8 << 20


def small(df: DataFrame, most: int = BROADCAST_BYTES) -> bool:
    """Whether the optimizer's estimate of a table's size, which joins and unknown sources only raise, is below most."""
    try:
        return int(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()) <= most
    except ValueError:  # more digits than Python reads, after many joins
        return False


def spread(df: DataFrame) -> DataFrame:
    """Rows dealt out to all cores if the source has fewer partitions than there are cores.

    Small files of one row group are one task otherwise; large tables pass as they are.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df


def settle(df: DataFrame) -> DataFrame:
    """Written to the checkpoint folder of the session; one of our own only if none is set and Spark runs on one machine (tests)."""
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        master = spark.sparkContext.master
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="runs-"))
    return df.checkpoint()
