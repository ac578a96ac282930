"""Shelf statistics: inverted index, top shelves, name hashes, author links."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.text import poly_hash


def book_shelves(books: DataFrame) -> DataFrame:
    """``(book_gid, shelve, count)``, one row per book and shelf entry."""
    return books.select(F.col("gid").alias("book_gid"), F.explode("list_shelves").alias("s")).select(
        "book_gid", F.col("s.shelve").alias("shelve"), F.col("s.count").alias("count")
    )


def shelf_index(books: DataFrame) -> DataFrame:
    """Inverted index on long rows: distinct ``(shelve, book_gid)``."""
    return book_shelves(books).select("shelve", "book_gid").distinct()


def shelf_table(books: DataFrame, chunk: int = 10_000) -> DataFrame:
    """Nested index ``(shelve, chunk, n_books, list_book)`` with lists of about ``chunk`` books.

    A shelf that holds a large share of all books is spread over many rows.
    """
    index = shelf_index(books)
    sizes = index.groupBy("shelve").agg(F.count(F.lit(1)).alias("n_books"))
    part = F.pmod(F.xxhash64("book_gid"), F.ceil(F.col("n_books") / chunk))
    return (
        index.join(sizes, "shelve")
        .groupBy("shelve", part.alias("chunk"), "n_books")
        .agg(F.array_sort(F.collect_list("book_gid")).alias("list_book"))
    )


def top_shelves(reviews: DataFrame, books: DataFrame, k: int = 10, min_votes: int = 0) -> DataFrame:
    """``(user_gid, rank, shelve, votes, count)``: the shelves most frequent among a user's books.

    ``count`` is the number of the user's books on the shelf, ``votes`` the sum of the books'
    own counts for it.
    """
    mine = reviews.select("user_gid", "book_gid").distinct()
    tally = (
        mine.join(book_shelves(books), "book_gid")
        .groupBy("user_gid", "shelve")
        .agg(F.sum("count").alias("votes"), F.count(F.lit(1)).alias("count"))
        .where(F.col("votes") >= min_votes)
    )
    w = Window.partitionBy("user_gid").orderBy(F.desc("count"), F.desc("votes"), "shelve")
    return (
        tally.withColumn("rank", F.row_number().over(w))
        .where(F.col("rank") <= k)
        .withColumn("rank", F.col("rank").cast("bigint"))
    )


def hash_collisions(names: DataFrame, name: str, hash_of: Column | None = None) -> DataFrame:
    """``(hash, n_names, first_name, last_name)`` of hashes shared by several distinct names."""
    value = poly_hash(name) if hash_of is None else hash_of
    return (
        names.select(F.col(name).alias("name"))
        .distinct()
        .select("name", value.alias("hash") if hash_of is not None else poly_hash("name").alias("hash"))
        .groupBy("hash")
        .agg(
            F.count(F.lit(1)).alias("n_names"),
            F.min("name").alias("first_name"),
            F.max("name").alias("last_name"),
        )
        .where(F.col("n_names") > 1)
    )


def author_book_links(books: DataFrame) -> DataFrame:
    """Distinct ``(author_gid, book_gid)`` of ``books(gid, authors ARRAY<STRUCT<gid ..>>)``."""
    return books.select(F.explode("authors").alias("a"), F.col("gid").alias("book_gid")).select(
        F.col("a.gid").alias("author_gid"), "book_gid"
    ).distinct()


def first_author(books: DataFrame) -> DataFrame:
    """``author``: the first of a book's authors."""
    return books.withColumn("author", F.get(F.col("authors"), F.lit(0)))
