"""Log text and parsed-table sources."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.parsing import parse_lines

LINE_BYTES = 64  # a guess at a parsed row's text, to choose how many files to count first


def _clean(value):
    """Drop bytes that are not UTF-8; valid text is left alone."""
    repaired = F.replace(F.make_valid_utf8(value), F.lit("�"), F.lit(""))
    return F.when(F.is_valid_utf8(value), value).otherwise(repaired)


def list_logs(spark: SparkSession, path: str, pattern: str = "*.log", max_files: int | None = None) -> list[str]:
    """Sorted log files of a folder (not of its sub-folders), or the one file that was named."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path).select("path").orderBy("path")
    return [r["path"] for r in files.collect()][:max_files]


def read_lines(
    spark: SparkSession, path: str | list[str], pattern: str = "*.log", line_numbers: bool = True, keep_split: bool = False
) -> DataFrame:
    """(value, file_path, line_number) of every line of the matching files of a folder, or of one file.

    A file that cannot be read is skipped, bad bytes are dropped.  A big file is read in several splits;
    a line number is the count of lines in the splits before, plus the position in its own.  That counts
    the lines of each split in a pass of its own: leave it out where the numbers are not needed.
    ``keep_split`` adds the whole path and the start of the split, as ``_file`` and ``_block``.
    """
    reader = spark.read.option("pathGlobFilter", pattern).option("ignoreCorruptFiles", "true")
    raw = reader.text(path).select(
        "value",
        F.col("_metadata.file_name").alias("file_path"),
        F.col("_metadata.file_path").alias("_file"),
        F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_id"),
    )
    cleaned = raw.withColumn("value", _clean(F.col("value")))
    if not line_numbers:
        return cleaned.drop("_file", "_block", "_id")
    blocks = raw.groupBy("_file", "_block").agg(F.min("_id").alias("_first"), F.count("*").alias("_n"))
    # blocks of one file: its size over the split size
    from pyspark.sql import Window as W

    before = W.partitionBy("_file").orderBy("_block").rowsBetween(W.unboundedPreceding, -1)
    offsets = blocks.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    return (
        cleaned.join(offsets, ["_file", "_block"])
        .withColumn("line_number", F.col("_id") - F.col("_first") + F.col("_before") + 1)
        .select("value", "file_path", "line_number", *(["_file", "_block"] if keep_split else []))
    )


def read_logs(
    spark: SparkSession,
    path: str,
    max_files: int | None = None,
    sample_lines: int | None = None,
    max_total_lines: int | None = None,
    pattern: str = "*.log",
) -> DataFrame:
    """Parsed logs of a folder or a file.

    ``max_files``: only the first files by name; ``sample_lines``: only the first physical lines of each
    file; ``max_total_lines``: only the first parsed rows over all files, by path and line.
    """
    paths = path if max_files is None else list_logs(spark, path, pattern, max_files)
    if max_total_lines is not None:
        return first_rows(spark, paths, max_total_lines, sample_lines, pattern)
    lines = read_lines(spark, paths, pattern)
    if sample_lines is not None:
        lines = lines.filter(F.col("line_number") <= sample_lines)
    return parse_lines(lines)


def first_rows(
    spark: SparkSession, path: str | list[str], rows: int, sample_lines: int | None = None, pattern: str = "*.log"
) -> DataFrame:
    """The first parsed rows over all files, by path and line, without sorting the rows.

    Rows are counted per file, over the first files whose sizes may hold enough (twice as much each time that they
    don't).  The files before the one where the limit falls are kept whole; of that one, its splits are counted, and
    only the split where the limit falls is asked for the line of the last row.  Later files aren't opened.
    """
    sizes = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    files = sizes.select("path", "length", F.col("_metadata.file_path").alias("_file")).orderBy("path").collect()  # one small row per file
    if rows <= 0 or not files:
        return parse_lines(read_lines(spark, path, pattern)).limit(0)

    def parsed(names: list[str], keep_split: bool = False) -> DataFrame:
        lines = read_lines(spark, names, pattern, keep_split=keep_split)
        return parse_lines(lines if sample_lines is None else lines.filter(F.col("line_number") <= sample_lines))

    def counted(names: list[str], by: str) -> dict:
        return dict(parsed(names, keep_split=True).groupBy(by).count().collect())  # one row per file, or per split of a file

    budget, done, left, known = rows * LINE_BYTES, 0, rows, []
    while done < len(files) and left > 0:
        part, held = [], 0
        while done + len(part) < len(files) and (not part or held < budget):
            held += files[done + len(part)]["length"]
            part.append(files[done + len(part)])
        many = counted([r["path"] for r in part], "_file")
        for r in part:
            n = many.get(r["_file"], 0)
            known.append((r, min(n, max(left, 0)), n))
            left -= n
        done, budget = done + len(part), 2 * budget
    whole = [r["path"] for r, take, n in known if n and take == n]
    out = [parsed(whole)] if whole else []
    for r, take, n in known:
        if 0 < take < n:  # one file at most
            blocks = sorted(counted([r["path"]], "_block").items())
            for block, held in blocks:
                if take <= held:
                    break
                take -= held
            # the rows of one split, which the split size bounds
            last = parsed([r["path"]], keep_split=True).filter(F.col("_block") == block).select("line_number").orderBy("line_number").limit(take)
            out.append(parsed([r["path"]]).filter(F.col("line_number") <= last.agg(F.max("line_number")).first()[0]))
    return reduce(DataFrame.unionByName, out) if out else parsed([files[0]["path"]]).limit(0)


def read_parsed(spark: SparkSession, path: str, max_files: int | None = None) -> DataFrame:
    """A parsed table, or the first files of a folder of chunks."""
    if max_files is None:
        return spark.read.parquet(path)
    return spark.read.parquet(*sorted(spark.read.parquet(path).inputFiles())[:max_files])


def read_split(spark: SparkSession, path: str, split: str | None = None) -> DataFrame:
    """A table written by ``write_split``; only the folders of the asked split are read."""
    df = spark.read.parquet(path)
    return df if split is None else df.filter(F.col("split") == split)
