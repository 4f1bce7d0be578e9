"""Intermediate tables that survive the loss of executors.

Some operators need two passes over one physical layout (count the rows of each partition, then number
them).  The layout is written once, as Parquet, to the shared folder named by ``spark.checkpoint.dir``;
both passes read it back, so a lost executor never changes the numbering and lineage is cut.
"""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_written: list[str] = []
_local: list[str] = []  # the folder of a local session without the setting


def scratch_dir(spark: SparkSession) -> str:
    """Shared folder for intermediate tables; a machine-local one is made only for a local session."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if configured:
        return configured.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="logsieve-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return _local[0]


def materialize(df: DataFrame, name: str = "table") -> DataFrame:
    """Write ``df`` once and return a lazy scan of the written table."""
    spark = df.sparkSession
    path = f"{scratch_dir(spark)}/logsieve/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    _written.append(path)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> int:
    """Delete the intermediate tables this process has written; returns how many there were."""
    jvm = spark.sparkContext._jvm
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    done = 0
    while _written:
        path = jvm.org.apache.hadoop.fs.Path(_written.pop())
        done += int(path.getFileSystem(conf).delete(path, True))
    return done
