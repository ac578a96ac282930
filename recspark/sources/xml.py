"""XML documents to typed rows, with declared schemas.

Repeated elements are declared as arrays, so one child and many children read alike.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recspark.functions.text import ascii_fold, date_from_parts

_OPTIONS = {"attributePrefix": "@", "valueTag": "#text", "mode": "PERMISSIVE"}

_AUTHORS = "authors: STRUCT<author: ARRAY<STRUCT<id: BIGINT, name: STRING, average_rating: DOUBLE, ratings_count: BIGINT>>>"
_BOOK_XML = (
    "book STRUCT<id: BIGINT, title: STRING, isbn: STRING, isbn13: STRING, publication_year: INT, "
    "publication_month: INT, publication_day: INT, description: STRING, average_rating: DOUBLE, "
    "ratings_count: BIGINT, text_reviews_count: BIGINT, "
    "popular_shelves: STRUCT<shelf: ARRAY<STRUCT<`@name`: STRING, `@count`: BIGINT>>>, "
    f"{_AUTHORS}, similar_books: STRUCT<book: ARRAY<STRUCT<id: BIGINT, title_without_series: STRING, "
    f"isbn: STRING, isbn13: STRING, average_rating: DOUBLE, ratings_count: BIGINT, {_AUTHORS}>>>>"
)
_COUNT = "STRUCT<`#text`: BIGINT, `@type`: STRING>"
_USER_XML = (
    "user STRUCT<id: BIGINT, name: STRING, location: STRING, age: BIGINT, gender: STRING, interests: STRING, "
    f"friends_count: {_COUNT}, reviews_count: {_COUNT}, "
    "favorite_authors: STRUCT<author: ARRAY<STRUCT<id: BIGINT, name: STRING>>>>"
)
_FRIENDS_XML = (
    "friends STRUCT<`@total`: BIGINT, user: ARRAY<STRUCT<id: BIGINT, name: STRING, friends_count: BIGINT, "
    "reviews_count: BIGINT>>>"
)


def _parsed(docs: DataFrame, column: str, schema: str) -> DataFrame:
    return docs.withColumn("_doc", F.from_xml(column, schema, _OPTIONS))


def first_author(authors: Column) -> Column:
    """The first of the listed authors as ``(gid, name)``, null if there is none."""
    a = F.get(authors, F.lit(0))
    return F.when(
        a["id"].isNotNull(), F.struct(a["id"].alias("gid"), ascii_fold(a["name"]).alias("name"))
    )


def parse_book_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """One row per book document: details, author, shelves and similar books."""
    b = F.col("_doc.book")
    shelves = F.transform(
        F.coalesce(b["popular_shelves"]["shelf"], F.array()),
        lambda s: F.struct(s["@name"].alias("shelve"), s["@count"].alias("count")),
    )
    similar = F.transform(
        b["similar_books"]["book"],
        lambda s: F.struct(
            s["id"].alias("gid"),
            ascii_fold(s["title_without_series"]).alias("title"),
            s["isbn"].alias("isbn"),
            s["isbn13"].alias("isbn13"),
            s["average_rating"].alias("average_rating"),
            s["ratings_count"].alias("ratings_count"),
            first_author(s["authors"]["author"]).alias("author"),
        ),
    )
    return _parsed(docs, column, _BOOK_XML).select(
        b["id"].alias("gid"),
        ascii_fold(b["title"]).alias("title"),
        ascii_fold(b["isbn"]).alias("isbn"),
        ascii_fold(b["isbn13"]).alias("isbn13"),
        date_from_parts(b["publication_year"], b["publication_month"], b["publication_day"]).alias(
            "publication_date"
        ),
        ascii_fold(b["description"]).alias("description"),
        b["average_rating"].alias("average_rating"),
        b["ratings_count"].alias("ratings_count"),
        b["text_reviews_count"].alias("reviews_count"),
        shelves.alias("list_shelves"),
        F.lit(False).alias("small_book"),
        first_author(b["authors"]["author"]).alias("author"),
        similar.alias("similar_books"),
    )


def parse_user_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """One row per user document."""
    u = F.col("_doc.user")
    return _parsed(docs, column, _USER_XML).select(
        u["id"].alias("gid"),
        ascii_fold(u["name"]).alias("name"),
        ascii_fold(u["location"]).alias("location"),
        u["age"].alias("age"),
        ascii_fold(u["gender"]).alias("gender"),
        ascii_fold(u["interests"]).alias("interests"),
        u["friends_count"]["#text"].alias("friends_count"),
        u["reviews_count"]["#text"].alias("reviews_count"),
        F.transform(
            u["favorite_authors"]["author"],
            lambda a: F.struct(a["id"].alias("gid"), ascii_fold(a["name"]).alias("name")),
        ).alias("favorite_authors"),
    )


def parse_friends_xml(docs: DataFrame, column: str = "xml") -> DataFrame:
    """Friends list and declared total, with the other columns of the document row kept."""
    f = F.col("_doc.friends")
    friends = F.transform(
        F.coalesce(f["user"], F.array()),
        lambda u: F.struct(
            u["id"].alias("gid"),
            ascii_fold(u["name"]).alias("name"),
            u["friends_count"].alias("friends_count"),
            u["reviews_count"].alias("reviews_count"),
            F.lit(True).alias("small_user"),
        ),
    )
    rest = [c for c in docs.columns if c != column]
    return _parsed(docs, column, _FRIENDS_XML).select(
        *rest, friends.alias("list_friends"), f["@total"].alias("total")
    )
