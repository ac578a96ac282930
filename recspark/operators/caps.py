"""Review caps, and slimming of nested rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.text import ascii_fold

#: Fields kept when a review is slimmed; a book loses its shelves, a review its sentiment.
ACTOR_FIELDS = ["id", "gid", "name", "friends_count", "reviews_count", "age", "gender", "small_user", "private"]
BOOK_FIELDS = [
    "id", "gid", "title", "isbn", "isbn13", "publication_date", "average_rating", "ratings_count",
    "small_book", "author",
]


def drop_low(reviews: DataFrame, minimum: int = 3) -> DataFrame:
    """Reviews rated at least ``minimum``."""
    return reviews.where(F.col("rating") >= minimum)


def top_rated(reviews: DataFrame, limit: int = 500) -> DataFrame:
    """The best ``limit`` reviews per user with their place ``pos``.

    A bounded rank: a user with very many reviews is cut before the shuffle.
    """
    w = Window.partitionBy("user_id").orderBy(F.desc("rating"), "review_id")
    return (
        reviews.withColumn("pos", F.row_number().over(w))
        .where(F.col("pos") <= limit)
        .withColumn("pos", F.col("pos").cast("bigint"))
    )


def cap_reviews(reviews: DataFrame, limit: int = 500, minimum: int = 3) -> DataFrame:
    """The best ``limit`` reviews per user without the low ones.

    A user all of whose ratings are below ``minimum`` keeps them, as in the original job: that is
    so where the first place is low, which is looked up among the at most ``limit`` rows left.
    """
    w = Window.partitionBy("user_id").orderBy("pos")
    return (
        top_rated(reviews, limit)
        .withColumn("best", F.first("rating").over(w))
        .where((F.col("rating") >= minimum) | (F.col("best") < minimum))
        .drop("best")
    )


def review_counts(reviews: DataFrame) -> DataFrame:
    """``(user_id, reviews_count, reviews_filtered)`` after a cap."""
    return reviews.groupBy("user_id").agg(
        F.count(F.lit(1)).alias("reviews_count"), F.lit(True).alias("reviews_filtered")
    )


def _pick(struct: Column, fields: list[str], have: list[str], **changed: Column) -> Column:
    kept = [changed.get(f, struct[f]).alias(f) for f in fields if f in have]
    return F.when(struct.isNotNull(), F.struct(*kept))


def slim_review(review: Column, schema) -> Column:
    """A review struct reduced to its listed fields, texts folded to ASCII.

    ``schema`` is the struct type of the review; fields it lacks are left out.
    """
    names = {f.name: f.dataType for f in schema.fields}
    parts = [review["id"].alias("id")] if "id" in names else []
    if "actor" in names:
        parts.append(_pick(review["actor"], ACTOR_FIELDS, names["actor"].names).alias("actor"))
    if "book" in names:
        title = ascii_fold(review["book"]["title"])
        parts.append(_pick(review["book"], BOOK_FIELDS, names["book"].names, title=title).alias("book"))
    parts += [review[f].alias(f) for f in ("gid", "rating") if f in names]
    if "text" in names:
        parts.append(ascii_fold(review["text"]).alias("text"))
    return F.struct(*parts)


def cap_nested_reviews(users: DataFrame, limit: int = 500, minimum: int = 3) -> DataFrame:
    """Cap and slim ``list_reviews`` inside each row: no shuffle, one pass.

    A null list stays null; every row is marked ``reviews_filtered``.
    """
    reviews = F.col("list_reviews")
    element = users.schema["list_reviews"].dataType.elementType
    ordered = F.array_sort(
        reviews,
        lambda a, b: F.when(a["rating"] != b["rating"], F.signum(b["rating"] - a["rating"]).cast("int"))
        .otherwise(F.signum(a["gid"] - b["gid"]).cast("int")),
    )
    best = F.array_max(F.transform(reviews, lambda r: r["rating"]))
    kept = F.filter(ordered, lambda r: (r["rating"] >= minimum) | (best < minimum))
    slim = F.transform(F.slice(kept, 1, limit), lambda r: slim_review(r, element))
    return (
        users.withColumn("list_reviews", slim)
        .withColumn("reviews_count", F.when(F.col("list_reviews").isNotNull(), F.size("list_reviews").cast("bigint")))
        .withColumn("reviews_filtered", F.lit(True))
    )
