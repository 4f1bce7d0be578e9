"""Writers: parsed tables, splits, reports and fitted parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def write_parsed(df: DataFrame, path: str, chunk_rows: int | None = None, mode: str = "errorifexists") -> None:
    """Parquet; with ``chunk_rows`` no file holds more rows than that."""
    writer = df.write.mode(mode)
    if chunk_rows:
        writer = writer.option("maxRecordsPerFile", chunk_rows)
    writer.parquet(path)


def write_split(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder per value of ``split``; every task writes to the folders it has rows for."""
    df.write.mode(mode).partitionBy("split").parquet(path)


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """CSV with a header; arrays become text."""
    flat = [
        F.concat_ws(", ", F.col(c).cast("array<string>")).alias(c) if t.startswith("array") else F.col(c)
        for c, t in df.dtypes
    ]
    df.select(*flat).write.mode(mode).option("header", True).csv(path)


def write_results(results: dict[str, DataFrame], path: str, run_id: str, mode: str = "errorifexists") -> dict[str, str]:
    """CSV per named result under ``path/run_id=.../name``."""
    out = {}
    for name, df in results.items():
        out[name] = f"{path}/run_id={run_id}/{name}"
        write_csv(df, out[name], mode)
    return out


def write_risk_slices(risks: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """One folder of CSV files per risk level."""
    risks.write.mode(mode).partitionBy("risk_level").option("header", True).csv(path)


def write_text_report(lines: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """A report of a few lines, given as (position, value) rows."""
    lines.orderBy("position").select("value").coalesce(1).write.mode(mode).text(path)


def _file_system(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def run_ids(spark: SparkSession, path: str) -> list[str]:
    """Run ids below a result folder, in order; empty if the folder is not there."""
    at, fs = _file_system(spark, path)
    if not fs.exists(at):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(at)]
    ids = [n.split("=", 1)[1] for n in names if n.startswith("run_id=")]
    return sorted(ids, key=lambda v: (not v.isdigit(), int(v) if v.isdigit() else 0, v))


def next_run_id(spark: SparkSession, path: str) -> str:
    """The number after the highest numbered run."""
    numbers = [int(v) for v in run_ids(spark, path) if v.isdigit()]
    return str(max(numbers, default=-1) + 1)


def latest_run(spark: SparkSession, path: str) -> str | None:
    ids = run_ids(spark, path)
    return f"{path}/run_id={ids[-1]}" if ids else None


def save_state(state: dict[str, DataFrame], path: str, mode: str = "errorifexists") -> None:
    """Fitted parameter tables, one Parquet folder per name."""
    for name, df in state.items():
        df.write.mode(mode).parquet(f"{path}/{name}")


def load_state(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    at, fs = _file_system(spark, path)
    names = sorted(s.getPath().getName() for s in fs.listStatus(at) if s.isDirectory())
    return {name: spark.read.parquet(f"{path}/{name}") for name in names}
