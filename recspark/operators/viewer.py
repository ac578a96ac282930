"""Read queries over the recommendation table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions.text import first_token, percent


def mark_best_shelves(recs: DataFrame) -> DataFrame:
    """Set ``best`` on each shelf of each recommended book that the user uses most. Row-local."""
    common = F.transform(F.coalesce("most_common_shelves", F.array()), lambda s: s["shelve"])
    books = F.transform(
        "books_details_recommended",
        lambda b: b.withField(
            "list_shelves",
            F.transform(
                b["list_shelves"],
                lambda s: s.withField(
                    "best",
                    F.array_contains(common, s["shelve"]) | F.coalesce(s["best"], F.lit(False)),
                ),
            ),
        ),
    )
    return recs.withColumn("books_details_recommended", books)


def with_gender(rows: DataFrame, genders: DataFrame) -> DataFrame:
    """Gender by first name from a caller's ``(name, gender)`` table, else ``unknown``."""
    table = genders.groupBy(F.lower("name").alias("_name")).agg(F.min("gender").alias("gender"))
    return (
        rows.withColumn("_name", F.lower(first_token("username")))
        .join(table, "_name", "left")
        .fillna("unknown", ["gender"])
        .drop("_name")
    )


def user_index(recs: DataFrame, genders: DataFrame) -> DataFrame:
    """Users with known shelves, best precision first."""
    rows = recs.where("common_shelves_retrieved").select("user_gid", "precision", "recall", "username")
    return (
        with_gender(rows, genders)
        .withColumn("precision_percent", percent("precision"))
        .orderBy(F.desc("precision"), "user_gid")
    )


def user_detail(recs: DataFrame, genders: DataFrame, user_gid: int) -> DataFrame:
    """One user's recommendations with best shelves marked; the key reaches the scan."""
    return with_gender(mark_best_shelves(recs.where(F.col("user_gid") == user_gid)), genders)


def item_detail(books: DataFrame, gid: int) -> DataFrame:
    return books.where(F.col("gid") == gid)
