"""Copula-based outlier score (Li et al., 2020): rare in the left, right or skew-picked tail.

Per feature, distinct values are counted and ranked along one layout, which gives both tails exactly;
the rows then look their values up.  No task sees more than its share of the distinct values.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..ordering import lay_out, running_sums
from ..windows import long_features


SALTS = 8


def tails(long: DataFrame, train: str | None = None) -> DataFrame:
    """(feature, value, left, right, skewness) with -log tail probabilities, from (feature, value) rows.

    With ``train`` (a boolean column) the probabilities come from those rows alone; values beyond all
    of them count as if seen once.
    """
    n = F.count("*") if train is None else F.count_if(train)
    counted = lay_out(long.groupBy("feature", "value").agg(n.alias("n")), ["feature", "value"], "ecdf")
    # central moments from the value counts; the mean comes first for the sake of precision
    means = counted.groupBy("feature").agg(
        (F.sum(F.col("value") * F.col("n")) / F.sum("n")).alias("mean"), F.sum("n").alias("total")
    )
    dev = F.col("value") - F.col("mean")
    # one row per feature
    moments = counted.join(F.broadcast(means), "feature").groupBy("feature", "total").agg(
        (F.sum(dev * dev * F.col("n")) / F.first("total")).alias("m2"),
        (F.sum(dev * dev * dev * F.col("n")) / F.first("total")).alias("m3"),
    )
    skew = F.when(F.col("m2") > 0, F.col("m3") / F.pow("m2", F.lit(1.5))).otherwise(0.0)
    ranked = running_sums(counted, {"upto": "n"}, ["feature"])
    upto = F.greatest(F.col("upto"), F.lit(1))
    above = F.greatest(F.col("total") - F.col("upto") + F.col("n"), F.lit(1))
    return ranked.join(F.broadcast(moments.withColumn("skewness", skew)), "feature").select(
        "feature", "value",
        (-F.log(upto / F.col("total"))).alias("left"),
        (-F.log(above / F.col("total"))).alias("right"),
        "skewness",
    )


def score(df: DataFrame, cols: list[str], key: str, train: str | None = None) -> DataFrame:
    """(key, anomaly_score): the largest of the three tail sums of each row."""
    keys = [key] if train is None else [key, train]
    return score_long(long_features(df.select(*keys, *cols), cols, *keys), key, train)


def score_new(df: DataFrame, train: DataFrame, cols: list[str], key: str) -> DataFrame:
    """(key, anomaly_score) of new rows against the distribution of the training rows alone."""
    both = long_features(df.select(key, *cols), cols, key).withColumn("_train", F.lit(False)).unionByName(
        long_features(train.select(F.lit(None).cast(df.schema[key].dataType).alias(key), *cols), cols, key).withColumn("_train", F.lit(True))
    )
    return score_long(both, key, "_train", only_new=True)


def score_long(rows: DataFrame, key: str, train: str | None = None, only_new: bool = False) -> DataFrame:
    """The same from (key, feature, value) rows; with ``only_new`` just the rows that are not training rows.

    A value that most rows share is one hot key: the table side is repeated under SALTS salts.
    """
    table = tails(rows.drop(key), train)
    picked = F.when(F.col("skewness") < 0, F.col("left")).otherwise(F.col("right"))
    asked = rows.filter(~F.col(train)) if only_new else rows
    asked = asked.withColumn("_salt", F.pmod(F.xxhash64(key), F.lit(SALTS)))
    table = table.withColumn("_salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
    sums = asked.join(table, ["feature", "value", "_salt"]).groupBy(key).agg(
        F.sum("left").alias("l"), F.sum("right").alias("r"), F.sum(picked).alias("p")
    )
    return sums.select(key, F.greatest("l", "r", "p").alias("anomaly_score"))
