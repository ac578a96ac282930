"""Declared schemas of the input and nested tables, as DDL text for ``spark.read.schema``."""

from __future__ import annotations

INTERACTIONS_NESTED = "user_id BIGINT, items ARRAY<STRUCT<item_id: BIGINT, features: ARRAY<BIGINT>>>"
#: The first cell is read as text, to tell a header line from a row.
RATINGS = "iduser STRING, rating DOUBLE, idproduct BIGINT, idcategory BIGINT, parent BIGINT"
TRUST_REVIEWS = "iduser BIGINT, idtrusted BIGINT, idproduct BIGINT, rating DOUBLE"

_SHELVE = "gid: BIGINT, shelve: STRING, votes: BIGINT, count: BIGINT, best: BOOLEAN"
_AUTHOR = "id: STRING, gid: BIGINT, name: STRING"
_BOOK = (
    "id: STRING, gid: BIGINT, title: STRING, isbn: STRING, isbn13: STRING, publication_date: TIMESTAMP, "
    "average_rating: DOUBLE, ratings_count: BIGINT, reviews_count: BIGINT, small_book: BOOLEAN, "
    f"author: STRUCT<{_AUTHOR}>, list_shelves: ARRAY<STRUCT<{_SHELVE}>>"
)
_USER = (
    "id: STRING, gid: BIGINT, name: STRING, friends_count: BIGINT, reviews_count: BIGINT, age: BIGINT, "
    "gender: STRING, location: STRING, small_user: BOOLEAN, private: BOOLEAN"
)
_SENTENCE = "sentence_text: STRING, sentence_polarity: DOUBLE, sentence_subjectivity: DOUBLE"
_TEXTBLOB = f"instantiated: BOOLEAN, sentences: ARRAY<STRUCT<{_SENTENCE}>>"
_REVIEW = (
    f"id: STRING, gid: BIGINT, actor: STRUCT<{_USER}>, book: STRUCT<{_BOOK}>, rating: BIGINT, text: STRING, "
    f"comments_count: BIGINT, textblob: STRUCT<{_TEXTBLOB}>"
)


BOOKS = (_BOOK + ", description: STRING, reviews_retrieved: BOOLEAN, shelves_retrieved: BOOLEAN")
AUTHORS = (_AUTHOR + ", average_rating: DOUBLE, ratings_count: BIGINT")
REVIEWS = (_REVIEW)
SHELVES = (f"id: STRING, gid: BIGINT, shelve: STRING, count: BIGINT, list_book: ARRAY<STRUCT<{_BOOK}>>")
USERS = (
    _USER + ", friends_retrieved: BOOLEAN, reviews_retrieved: BOOLEAN, shelves_reviews_retrieved: BOOLEAN, "
    f"reviews_filtered: BOOLEAN, test_set: BOOLEAN, list_reviews: ARRAY<STRUCT<{_REVIEW}>>, "
    f"list_friends: ARRAY<STRUCT<{_USER}>>, most_common_shelves: ARRAY<STRUCT<{_SHELVE}>>"
)
RECOMMENDATION = (
    "user_gid: BIGINT, username: STRING, item_recommended: ARRAY<BIGINT>, "
    f"books_details_recommended: ARRAY<STRUCT<{_BOOK}>>, precision: DOUBLE, recall: DOUBLE, "
    f"book_details_retrieved: BOOLEAN, most_common_shelves: ARRAY<STRUCT<{_SHELVE}>>, "
    "common_shelves_retrieved: BOOLEAN"
)
