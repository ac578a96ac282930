"""User feature profiles."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.session import materialize


def user_count(interactions: DataFrame, user: str = "user_id") -> DataFrame:
    """One row ``n_users``: all users, also those without train rows."""
    return interactions.agg(F.count_distinct(user).alias("n_users"))


def feature_frequency(train: DataFrame) -> DataFrame:
    """``(user_id, feature, ff)``: occurrences of a feature over the user's train items."""
    return train.groupBy("user_id", "feature").agg(F.count(F.lit(1)).alias("ff"))


def feature_weights(ff: DataFrame, n_users: DataFrame) -> DataFrame:
    """``(feature, df, fw)`` with ``fw = log10(users / users holding the feature)``."""
    return (
        ff.groupBy("feature")
        .agg(F.count(F.lit(1)).alias("df"))
        .withColumn("fw", F.log10(n_users.scalar() / F.col("df")))
    )


def weight_features(ff: DataFrame, fw: DataFrame) -> DataFrame:
    """``(user_id, feature, ff, fw, weight)`` with ``weight = fw * ff``.

    The weights table has one row per feature and is written first. Its size decides whether
    it is broadcast; beyond the threshold both sides are shuffled, and hot features split.
    """
    return ff.join(materialize(fw.select("feature", "fw"), "feature-weights"), "feature").select(
        "user_id", "feature", "ff", "fw", (F.col("fw") * F.col("ff")).alias("weight")
    )


def user_profiles(split: DataFrame) -> DataFrame:
    """Weighted profiles from a split interactions table, which is read once.

    The counts are written, those of test rows as 0: the users without train rows count as users too. What is
    returned is read from them and from the weights.
    """
    train = F.count_if("is_train").alias("ff")
    counts = materialize(split.groupBy("user_id", "feature").agg(train), "feature-counts")
    ff = counts.where("ff > 0")
    return weight_features(ff, feature_weights(ff, user_count(counts)))


def feature_vocabulary(names: DataFrame, name: str = "feature") -> DataFrame:
    """``(feature_id, feature)``: dense ids in name order, from 1.

    Ranks are taken inside range partitions and shifted by the sizes of the partitions
    before, so no task ever sorts the whole vocabulary. Only the per-partition counts are
    combined, one row per partition.
    """
    from pyspark.sql import Window

    spark = names.sparkSession
    distinct = names.select(name).where(F.col(name).isNotNull()).distinct()
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    from recspark.session import materialize

    ranged = materialize(
        distinct.repartitionByRange(parts, name).withColumn("part", F.spark_partition_id()), "vocabulary"
    )
    sizes = ranged.groupBy("part").agg(F.count(F.lit(1)).alias("n"))
    before = sizes.select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset")
    )
    local = F.row_number().over(Window.partitionBy("part").orderBy(name))
    return ranged.withColumn("local", local).join(before, "part").select(
        (F.col("offset") + F.col("local")).alias("feature_id"), F.col(name)
    )
