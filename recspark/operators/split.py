"""Train/test splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions import draws


def split_holdout(interactions: DataFrame, train_pct: float = 0.75, seed: int = 7) -> DataFrame:
    """Add ``is_train``: each (user, item) goes to train with probability ``train_pct``.

    A row-local draw, so the split needs no shuffle and all feature rows of one item
    fall on the same side.
    """
    return interactions.withColumn("is_train", draws.below(train_pct, seed, "user_id", "item_id"))


def holdout_first_n(reviews: DataFrame, n: int = 2) -> DataFrame:
    """The first ``n`` reviews of each user by item: ``(user_id, idx, item_id, rating)``."""
    w = Window.partitionBy("user_id").orderBy("item_id")
    return (
        reviews.withColumn("idx", F.row_number().over(w))
        .where(F.col("idx") <= n)
        .select("user_id", F.col("idx").cast("bigint").alias("idx"), "item_id", "rating")
    )


def train_reviews(reviews: DataFrame, targets: DataFrame, leak_test: bool = True) -> DataFrame:
    """Reviews used as evidence. By default the held-out rows stay in, as in the original job."""
    if leak_test:
        return reviews
    return reviews.join(targets.select("user_id", "item_id"), ["user_id", "item_id"], "left_anti")
