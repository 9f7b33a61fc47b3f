"""Partitioning of inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame


def spread(scan: DataFrame) -> DataFrame:
    """Give every core a share of an input that comes in very few splits.

    For the plain scan of a table ahead of work that is heavy per byte.  A
    large table has far more splits than there are cores and is not touched.
    """
    cores = scan.sparkSession.sparkContext.defaultParallelism
    if scan.isStreaming or scan.rdd.getNumPartitions() * 2 > cores:
        return scan
    return scan.repartition(cores)
