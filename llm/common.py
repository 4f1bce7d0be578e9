"""Helpers that several operators share: reading tables, scratch tables, joins with small tables, components."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_ROWS = 50_000
ROWS_PER_FILE = 1 << 18  # of narrow scratch tables
written: list[str] = []  # scratch tables of this process
_local: dict[str, str] = {}  # the temporary folder of a local session
WORD = r"[^\x20\x09-\x0D]+"
BLANK = r"[\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new folder below spark.checkpoint.dir, which all executors share.

    Only a local master without the setting gets a temporary folder; elsewhere the setting is required.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = _local.setdefault("base", tempfile.mkdtemp(prefix="spark-scratch-") if not _local else "")
    return f"{base.rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, most: int | None = None) -> DataFrame:
    """Write df to the shared scratch folder and read it back: the lineage ends there.

    most: for tables of narrow rows, a number of rows that df can't exceed.  They are written by ROWS_PER_FILE rows, and
    by one task a core at least, not by one task a shuffle partition: each file costs a task and processes of the file system.
    """
    if most is not None:
        df = df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-most // ROWS_PER_FILE)))
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    written.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of 8 MB at most in this session: a batch is held several times, by the JVM and by the worker."""
    name = "spark.sql.execution.arrow.maxBytesPerBatch"
    told = re.fullmatch(r"(\d+)([kmgt]?)b?", spark.conf.get(name).strip().lower())  # anything else is no bound
    if not told or int(told[1]) << 10 * " kmgt".index(told[2] or " ") > 8 << 20:
        spark.conf.set(name, str(8 << 20))


def release(spark: SparkSession, paths: list[str]) -> None:
    """Delete scratch tables that nothing reads any more."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    for p in paths:
        path = jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(conf).delete(path, True)


@contextlib.contextmanager
def short_shuffles(spark: SparkSession) -> Iterator[None]:
    """Inside, a query's shuffle files go when it ends, not when the driver happens to collect its garbage."""
    name = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    told = spark.conf.get(name, None)
    spark.conf.set(name, "true")
    try:
        yield
    finally:
        spark.conf.unset(name) if told is None else spark.conf.set(name, told)


def join_small(df: DataFrame, small: DataFrame, keys: list[str], how: str = "left", rows: int | None = None) -> DataFrame:
    """Join with a table that is expected to be small; it is counted, and broadcast only up to BROADCAST_ROWS.

    Beyond that the small side is repeated under 16 salts, so a hot key of df is dealt over 16 tasks.
    Null keys are equal to each other.
    """
    n = small.count() if rows is None else rows
    right = small.select(*[F.col(k).alias(f"_r_{k}") for k in keys], *[c for c in small.columns if c not in keys])
    on: Column = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"_r_{k}"))
    if n <= BROADCAST_ROWS:
        return df.join(F.broadcast(right), on, how).drop(*[f"_r_{k}" for k in keys])
    right = right.withColumn("_r_salt", F.explode(F.sequence(F.lit(0), F.lit(15))))
    left = df.withColumn("_salt", (F.rand(7) * 16).cast("int"))
    return left.join(right, on & (F.col("_salt") == F.col("_r_salt")), how).drop("_salt", "_r_salt", *[f"_r_{k}" for k in keys])


def components(edges: DataFrame, name: str = "edges") -> DataFrame:
    """Connected components of edges (a, b): rows (node, component), component the least node reachable.

    Large-star and small-star rounds, each written to the scratch folder, until no edge changes.  Every round is
    two shuffles of the edges; a hub of many edges is joined, never gathered into one row.  The hub's least
    neighbour comes from an aggregate with map-side combine.  A round never has more edges than the one before.
    """
    pairs = edges.filter("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = stored(pairs, name)
    last, most = None, pairs.count()
    while True:
        # large star: every larger neighbour of a node is linked with the node's least neighbour (or itself)
        both = pairs.select("a", "b").union(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.col("a"), F.min("b")).alias("m"))
        large = both.filter("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        # small star: smaller neighbours and the node itself are linked with the least neighbour
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(low.select("a", F.col("m").alias("b")))
        pairs = stored(small.filter("a <> b").distinct(), name, most)
        state = pairs.agg(F.count("*").alias("n"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")).alias("h")).first()
        if last == state:
            break
        last, most = state, state["n"]
    return pairs.select(F.col("a").alias("node"), F.col("b").alias("component")).union(
        pairs.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    )
