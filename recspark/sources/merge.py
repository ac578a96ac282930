"""Keyed table updates on snapshots: insert-if-absent, update-by-key, list append."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def first_per_key(rows: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """One row per key: the lowest by ``order``. Combines before the shuffle."""
    by = [order] if isinstance(order, str) else order
    rest = [c for c in rows.columns if c not in keys]
    pick = F.min_by(F.struct(*rest), F.struct(*by))
    return rows.groupBy(*keys).agg(pick.alias("row")).select(*keys, "row.*").select(*rows.columns)


def insert_if_absent(base: DataFrame, new: DataFrame, keys: list[str], order: str | list[str]) -> DataFrame:
    """``base`` plus the new rows whose key it lacks; ``existed`` tells which rows were there.

    Several new rows of one key count as one, the lowest by ``order``.
    """
    added = first_per_key(new, keys, order).join(base.select(*keys), keys, "left_anti")
    return base.withColumn("existed", F.lit(True)).unionByName(
        added.select(*base.columns).withColumn("existed", F.lit(False))
    )


def merge_update(
    base: DataFrame,
    updates: DataFrame,
    keys: list[str],
    columns: list[str],
    constants: dict[str, object] | None = None,
) -> DataFrame:
    """Snapshot of ``base`` where matched rows take the update's ``columns``, nulls included.

    ``constants`` are set on matched rows only. ``updates`` holds one row per key.
    """
    constants = constants or {}
    packed = updates.select(*keys, F.struct(*columns).alias("_new"))
    joined = base.join(packed, keys, "left")
    hit = F.col("_new").isNotNull()

    def value(name: str) -> Column:
        if name in columns:
            return F.when(hit, F.col(f"_new.{name}")).otherwise(F.col(name)).alias(name)
        if name in constants:
            return F.when(hit, F.lit(constants[name])).otherwise(F.col(name)).alias(name)
        return F.col(name)

    return joined.select(*[value(c) for c in base.columns])


def update_small_books(books: DataFrame, details: DataFrame) -> DataFrame:
    """Fill stub books from their detail rows and clear their ``small_book`` flag."""
    columns = [c for c in details.columns if c != "gid"]
    return merge_update(books, details, ["gid"], columns, {"small_book": False, "shelves_retrieved": True})


def append_absent(base: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """List append on long rows: add what is not on the owner's list yet."""
    fresh = new.select(*base.columns).dropDuplicates(keys)
    return base.unionByName(fresh.join(base.select(*keys), keys, "left_anti"))


def fold_reviews(
    books: DataFrame, authors: DataFrame, reviews: DataFrame, users: DataFrame, scraped: DataFrame
) -> dict[str, DataFrame]:
    """Fold scraped review rows into the tables.

    ``scraped`` has one row per review: ``user_gid, review_gid, rating, text, book_gid, title,
    author_gid, author_name``. Known books, authors and reviews are kept as they are; a
    book without an author takes the scraped one. Users with scraped rows are marked
    ``reviews_retrieved`` and not ``private``. Reviews stay long, keyed by user.
    """
    all_books = insert_if_absent(
        books, scraped.select(F.col("book_gid").alias("gid"), "title", "author_gid"), ["gid"], ["title", "author_gid"]
    )
    first_author = scraped.groupBy(F.col("book_gid").alias("gid")).agg(
        F.min("author_gid").alias("scraped_author")
    )
    all_books = (
        all_books.join(first_author, "gid", "left")
        .withColumn("author_gid", F.coalesce("author_gid", "scraped_author"))
        .drop("scraped_author")
    )
    all_authors = insert_if_absent(
        authors, scraped.select(F.col("author_gid").alias("gid"), F.col("author_name").alias("name")), ["gid"], "name"
    )
    all_reviews = insert_if_absent(
        reviews,
        scraped.select(F.col("review_gid").alias("gid"), "user_gid", "book_gid", "rating", "text"),
        ["gid"],
        ["user_gid", "book_gid", "rating"],
    )
    done = scraped.select(F.col("user_gid").alias("gid")).distinct().withColumn("reviews_retrieved", F.lit(True))
    all_users = merge_update(users, done, ["gid"], ["reviews_retrieved"], {"private": False})
    return {"books": all_books, "authors": all_authors, "reviews": all_reviews, "users": all_users}
