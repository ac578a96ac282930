"""Repair and setting of status flags. All row-local."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.operators.enrich import is_empty


def repair_flag(table: DataFrame, flag: str, items: str, mode: str = "both") -> DataFrame:
    """Make ``flag`` agree with a list: ``both`` directions, or only true to false (``clear``)."""
    filled = ~is_empty(items)
    if mode == "both":
        return table.withColumn(flag, filled)
    if mode == "clear":
        return table.withColumn(flag, F.col(flag) & filled)
    raise ValueError(f"unknown mode {mode!r}")


def repair_user_flags(users: DataFrame) -> DataFrame:
    """Clear flags of users that claim reviews, shelves or friends they do not have.

    A user with ``reviews_retrieved`` but an empty list loses it and the shelves flag; shelves
    are never retrieved where reviews are not; friends likewise follow their list.
    """
    hollow = F.col("reviews_retrieved") & is_empty("list_reviews")
    reviews = F.col("reviews_retrieved") & ~hollow
    return users.select(
        *[
            reviews.alias(c)
            if c == "reviews_retrieved"
            else (F.col(c) & reviews).alias(c)
            if c == "shelves_reviews_retrieved"
            else (F.col(c) & ~is_empty("list_friends")).alias(c)
            if c == "friends_retrieved"
            else F.col(c)
            for c in users.columns
        ]
    )


def first_review_check(users: DataFrame) -> DataFrame:
    """Clear the shelves flag where the first review's book has no shelves."""
    first = F.get(F.col("list_reviews"), F.lit(0))
    bad = ~is_empty("list_reviews") & is_empty(first["book"]["list_shelves"])
    return users.withColumn(
        "shelves_reviews_retrieved", F.when(bad, F.lit(False)).otherwise(F.col("shelves_reviews_retrieved"))
    )


def set_flag(table: DataFrame, flag: str, value: bool | Column, where: str | Column | None = None) -> DataFrame:
    """Set ``flag`` on all rows, or on those that match."""
    new = F.lit(value) if isinstance(value, bool) else value
    if where is None:
        return table.withColumn(flag, new)
    cond = F.expr(where) if isinstance(where, str) else where
    old = F.col(flag) if flag in table.columns else F.lit(None).cast("boolean")
    return table.withColumn(flag, F.when(cond, new).otherwise(old))


def set_common_shelves_flag(recs: DataFrame) -> DataFrame:
    return recs.withColumn("common_shelves_retrieved", F.col("most_common_shelves").isNotNull())


def default_small_book(books: DataFrame) -> DataFrame:
    """A missing ``small_book`` is true."""
    return books.fillna({"small_book": True})


def mark_test_set(users: DataFrame) -> DataFrame:
    return users.withColumn("test_set", F.lit(True))
