"""What a task costs its executor: files of small scratch tables, and Python workers."""

import random
from pathlib import Path

from conftest import plan_of
from llm import suffix_dedup
from llm.common import components, stored, written


def files(path: str) -> int:
    return len(list(Path(path.removeprefix("file:")).glob("*.parquet")))


def test_narrow_tables_are_written_by_few_tasks(spark):
    names = {"spark.sql.shuffle.partitions": "48", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in names}
    start = len(written)
    try:
        for k, v in names.items():
            spark.conf.set(k, v)
        numbers = list(range(3000))
        random.Random(3).shuffle(numbers)
        edges = spark.createDataFrame([(a, b) for a, b in zip(numbers, numbers[1:]) if a % 50 and b % 50], "a long, b long")
        found = components(edges, "rounds").collect()
        rounds = written[start:]
        least = spark.sparkContext.defaultParallelism
        assert len(rounds) > 3 and files(rounds[0]) > least and max(map(files, rounds[1:])) <= least
        assert files(written[-1]) and len(found) == len({r.node for r in found})
        whole = stored(spark.range(5000).repartition(48, "id"), "whole", 5000)
        assert whole.count() == 5000 and files(written[-1]) <= least
    finally:
        del written[start:]
        for k, v in before.items():
            spark.conf.set(k, v)


def test_one_worker_in_a_task(spark):
    docs = spark.createDataFrame([(i, f"{i} " * 40 + "the same words " * 20) for i in range(6)], "doc_id long, text string")
    for df in (suffix_dedup.remove_repeats(docs), suffix_dedup.digests(docs)):
        last = ""
        for line in plan_of(df).split("\n"):
            node = line.lstrip(" :+-*(0123456789)")
            if node.startswith(("MapInArrow", "FlatMapGroupsInArrow")):
                assert last != "python", "two workers at once"
                last = "python"
            elif node.startswith(("Exchange", "ShuffleQueryStage")):
                last = "exchange"
        assert df.count() == 6
