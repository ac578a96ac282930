"""Filling of missing shelves in reviews, attached details, and consistency counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_empty(col: Column | str) -> Column:
    """True for a null or empty list."""
    c = F.col(col) if isinstance(col, str) else col
    return F.coalesce(F.size(c), F.lit(0)) <= 0


def _with_shelves(books: DataFrame) -> DataFrame:
    return books.where(~is_empty("list_shelves"))


def resolve_shelves(reviews: DataFrame, books: DataFrame) -> DataFrame:
    """Fill an empty ``list_shelves`` from ``books(gid, list_shelves)`` by ``book_gid``.

    ``resolved`` tells whether the review has shelves afterwards. Only books with shelves are
    joined, and only reviews that need one, so a popular book's reviews move once at most.
    """
    known = _with_shelves(books).select(F.col("gid").alias("book_gid"), F.col("list_shelves").alias("_found"))
    need = reviews.where(is_empty("list_shelves"))
    filled = need.join(known, "book_gid", "left").withColumn("list_shelves", F.col("_found")).drop("_found")
    both = reviews.where(~is_empty("list_shelves")).unionByName(filled)
    return both.withColumn("resolved", ~is_empty("list_shelves"))


def enrich_reviews(
    users: DataFrame, reviews: DataFrame, books: DataFrame, on_missing: str = "retry"
) -> tuple[DataFrame, DataFrame]:
    """Reviews with shelves, and users with updated flags, on long rows.

    ``users(gid, reviews_retrieved, shelves_reviews_retrieved)``, ``reviews(user_gid,
    review_gid, book_gid, list_shelves)``. Users already done, and users without retrieved
    reviews, are left alone with their reviews.

    ``retry`` keeps unresolved reviews and leaves the user pending; ``drop`` removes them and
    marks the user done. A user without any review loses ``reviews_retrieved``.
    """
    if on_missing not in ("retry", "drop"):
        raise ValueError(f"unknown mode {on_missing!r}")
    todo = users.where("reviews_retrieved and not shelves_reviews_retrieved").select("gid")
    whose = todo.select(F.col("gid").alias("user_gid"), F.lit(True).alias("_todo"))
    known = _with_shelves(books).select(F.col("gid").alias("book_gid"), F.col("list_shelves").alias("_found"))
    # Only reviews without shelves meet the books; the others pass straight through.
    bare = reviews.where(is_empty("list_shelves")).join(known, "book_gid", "left").join(whose, "user_gid", "left")
    missing = F.col("_todo").isNotNull() & F.col("_found").isNull()
    stuck = bare.where(missing).select(F.col("user_gid").alias("gid")).distinct()
    kept = bare if on_missing == "retry" else bare.where(~missing)
    filled = kept.withColumn(
        "list_shelves", F.when(F.col("_todo").isNotNull(), F.col("_found")).otherwise(F.col("list_shelves"))
    ).select(*reviews.columns)
    new_reviews = reviews.where(~is_empty("list_shelves")).unionByName(filled)

    has = reviews.select(F.col("user_gid").alias("gid"), F.lit(True).alias("_has")).distinct()
    state = todo.join(has, "gid", "left").select("gid", F.coalesce("_has", F.lit(False)).alias("_has"))
    if on_missing == "retry":
        state = state.join(stuck.withColumn("_stuck", F.lit(True)), "gid", "left")
    else:
        state = state.withColumn("_stuck", F.lit(None).cast("boolean"))
    touched = F.col("_has").isNotNull()
    done = F.col("_has") & F.col("_stuck").isNull()

    def value(name: str) -> Column:
        new = {"reviews_retrieved": F.col("_has"), "shelves_reviews_retrieved": done}.get(name)
        return F.col(name) if new is None else F.when(touched, new).otherwise(F.col(name)).alias(name)

    new_users = users.join(state, "gid", "left").select(*[value(c) for c in users.columns])
    return new_users, new_reviews


def enrich_nested_users(users: DataFrame, books: DataFrame, on_missing: str = "retry") -> DataFrame:
    """The same on nested rows ``(gid, flags, list_reviews ARRAY<STRUCT<.. book STRUCT<gid,
    list_shelves>>>)``: the list is opened, joined and closed again in its old order.

    A rebuilt list is as long as the list it came from.
    """
    element = users.schema["list_reviews"].dataType.elementType
    opened = users.select("gid", "reviews_retrieved", "shelves_reviews_retrieved", F.posexplode("list_reviews").alias("pos", "r"))
    rows = opened.select(
        F.col("gid").alias("user_gid"), F.col("pos").alias("review_gid"), F.col("r.book.gid").alias("book_gid"),
        F.col("r.book.list_shelves").alias("list_shelves"), "r",
    )
    new_users, new_rows = enrich_reviews(
        users.withColumn("_had", F.col("list_reviews").isNotNull()).drop("list_reviews"), rows, books, on_missing
    )
    review = F.col("r").withField("book", F.col("r.book").withField("list_shelves", F.col("list_shelves")))
    lists = new_rows.groupBy(F.col("user_gid").alias("gid")).agg(
        F.array_sort(F.collect_list(F.struct("review_gid", review.alias("r")))).alias("l")
    )
    empty = F.array().cast(f"array<{element.simpleString()}>")
    return (
        new_users.join(lists, "gid", "left")
        .withColumn(
            "list_reviews",
            F.when(F.col("l").isNotNull(), F.transform("l", lambda x: x["r"])).when(F.col("_had"), empty),
        )
        .drop("l", "_had")
    )


def attach_item_details(recs: DataFrame, books: DataFrame) -> DataFrame:
    """``(user_gid, books_details_recommended)``: book structs in the order of the item list."""
    detail = F.struct(*[F.col(c) for c in books.columns]).alias("book")
    rows = recs.select("user_gid", F.posexplode("item_recommended").alias("pos", "gid"))
    return (
        rows.join(books.select(F.col("gid"), detail), "gid")
        .groupBy("user_gid")
        .agg(F.array_sort(F.collect_list(F.struct("pos", "book"))).alias("l"))
        .select("user_gid", F.transform("l", lambda x: x["book"]).alias("books_details_recommended"))
    )


def attach_username(recs: DataFrame, users: DataFrame) -> DataFrame:
    """Add ``username``, the first name found for the user."""
    names = users.groupBy(F.col("gid").alias("user_gid")).agg(F.min("name").alias("username"))
    return recs.join(names, "user_gid", "left")


def count_mismatch(owners: DataFrame, members: DataFrame, key: str, declared: str) -> DataFrame:
    """Owners whose declared count differs from their number of member rows."""
    actual = members.groupBy(key).agg(F.count(F.lit(1)).alias("actual"))
    return (
        owners.select(key, declared)
        .join(actual, key, "left")
        .fillna(0, ["actual"])
        .where(F.col(declared) != F.col("actual"))
    )


def nested_count_mismatch(users: DataFrame) -> DataFrame:
    """Users whose ``friends_count`` differs from the length of ``list_friends``."""
    actual = F.when(is_empty("list_friends"), F.lit(0)).otherwise(F.size("list_friends"))
    return users.where(F.col("friends_count") != actual).select(
        "gid", "friends_count", actual.cast("bigint").alias("actual")
    )


def consistency_report(users: DataFrame, reviews: DataFrame, books: DataFrame) -> DataFrame:
    """``(rule, violations)`` over the curated tables."""
    known = _with_shelves(books).select(F.col("gid").alias("book_gid"))
    bare = reviews.where(is_empty("list_shelves"))
    missing = bare.join(known, "book_gid", "left_anti")

    def rule(name: str, value: DataFrame) -> DataFrame:
        return value.select(F.lit(name).alias("rule"), F.col("n").alias("violations"))

    n = F.count(F.lit(1)).alias("n")
    return (
        rule("reviews without shelves", bare.agg(n))
        .unionByName(rule("reviews whose book has no shelves", missing.agg(n)))
        .unionByName(rule("users with such a review", missing.agg(F.count_distinct("user_gid").alias("n"))))
        .unionByName(
            rule(
                "users done without reviews",
                users.where("shelves_reviews_retrieved and not reviews_retrieved").agg(n),
            )
        )
        .unionByName(
            rule(
                "declared review count differs",
                count_mismatch(
                    users.select(F.col("gid").alias("user_gid"), "reviews_count"), reviews, "user_gid", "reviews_count"
                ).agg(n),
            )
        )
    )
