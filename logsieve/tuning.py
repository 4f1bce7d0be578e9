"""Session settings for a given amount of data."""

from __future__ import annotations

import math

MIB = 1 << 20


def recommended_conf(input_bytes: int, cores: int, partition_bytes: int = 128 * MIB) -> dict[str, str]:
    """Settings for ``SparkSession.builder``.

    Shuffles start with partitions of about ``partition_bytes`` (adaptive execution merges the small
    ones and splits the skewed ones), and never with fewer than there are cores.  Set
    ``spark.checkpoint.dir`` to a folder that all executors share as well.
    """
    partitions = max(cores, math.ceil(input_bytes / partition_bytes))
    return {
        "spark.sql.shuffle.partitions": str(partitions),
        "spark.sql.files.maxPartitionBytes": str(2 * partition_bytes),
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.session.timeZone": "UTC",
    }
