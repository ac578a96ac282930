"""Registered queries of the ingest, curation and viewer jobs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.functions import text as X
from recspark.operators import caps, enrich, flags, sentiment, shelves, viewer
from recspark.plans.bindings import Tables, with_views
from recspark.plans.registry import query
from recspark.session import materialize, new_path
from recspark.sources import html, merge, sinks, tables, xml
from recspark.streaming import incremental

BOOKS = with_views("books")
REVIEWS = with_views("purchases", "reviews")
ALL = with_views("purchases", "reviews", "books", "users", "book_shelves")


def _list(column: str, field: str | None = None) -> F.Column:
    """A list as text, so that engines compare it alike."""
    items = F.col(column) if field is None else F.transform(column, lambda x: x[field])
    return F.coalesce(F.array_join(F.transform(items, lambda x: x.cast("string")), ","), F.lit(""))


def _day(column: str) -> F.Column:
    return F.coalesce(F.date_format(column, "yyyy-MM-dd"), F.lit(""))


# --- status scans and keyed updates ---------------------------------------------------------


@query(with_views("users") + "SELECT gid, name FROM users WHERE NOT reviews_retrieved")
def pending_users(t: Tables) -> DataFrame:
    return tables.pending(t.users(), "reviews_retrieved", "gid", "name")


@query(with_views("users") + "SELECT gid FROM users WHERE NOT reviews_retrieved AND NOT private")
def pending_public_users(t: Tables) -> DataFrame:
    return tables.pending_public(t.users(), "reviews_retrieved", "gid")


@query(with_views("users") + "SELECT gid FROM users WHERE NOT shelves_reviews_retrieved AND reviews_retrieved ORDER BY gid LIMIT 500")
def next_pending_batch(t: Tables) -> DataFrame:
    """The job's own batch of 500 rows."""
    rows = tables.pending(t.users(), "shelves_reviews_retrieved", "gid", also="reviews_retrieved")
    return tables.next_batch(rows, "gid", 500)


@query(
    with_views("purchases", "users") + """, base AS (SELECT gid, name FROM users WHERE gid % 3 = 0)
SELECT gid, name, TRUE AS existed FROM base UNION ALL
SELECT user_id, min('line ' || line_id), FALSE FROM purchases WHERE user_id NOT IN (SELECT gid FROM base) GROUP BY user_id"""
)
def insert_if_absent(t: Tables) -> DataFrame:
    base = t.users().where("gid % 3 = 0").select("gid", "name")
    new = t.purchases().select(
        F.col("user_id").alias("gid"), F.concat(F.lit("line "), F.col("line_id").cast("string")).alias("name")
    )
    return merge.insert_if_absent(base, new, ["gid"], "name")


@query(
    BOOKS + """SELECT gid, CASE WHEN gid % 4 = 0 THEN NULLIF(upper(title), 'RED RING') ELSE title END IS NULL AS lost,
  coalesce(CASE WHEN gid % 4 = 0 THEN NULLIF(upper(title), 'RED RING') ELSE title END, '') AS title,
  CASE WHEN gid % 4 = 0 THEN ratings_count + 1 ELSE ratings_count END AS ratings_count,
  CASE WHEN gid % 4 = 0 THEN FALSE ELSE coalesce(small_book, TRUE) END AS small_book,
  CASE WHEN gid % 4 = 0 THEN TRUE ELSE shelves_retrieved END AS shelves_retrieved
FROM books"""
)
def update_by_key(t: Tables) -> DataFrame:
    """Detail rows overwrite stub books, with nulls where the details have none."""
    stubs = flags.default_small_book(t.books()).select("gid", "title", "ratings_count", "small_book", "shelves_retrieved")
    details = t.books().where("gid % 4 = 0").select(
        "gid",
        F.expr("nullif(upper(title), 'RED RING')").alias("title"),
        (F.col("ratings_count") + 1).alias("ratings_count"),
    )
    new = merge.update_small_books(stubs, details)
    return new.withColumn("lost", F.col("title").isNull()).fillna("", ["title"])


@query(
    with_views("purchases") + """SELECT DISTINCT user_id AS owner, item_id AS member FROM purchases"""
)
def append_absent(t: Tables) -> DataFrame:
    """List append without repeats: lists of early lines grow by all lines."""
    rows = t.purchases().select(F.col("user_id").alias("owner"), F.col("item_id").alias("member"), "line_id")
    base = rows.where("line_id % 2 = 0").select("owner", "member").distinct()
    return merge.append_absent(base, rows, ["owner", "member"])


_FOLD = ALL + """, base_books AS (SELECT gid, title, CASE WHEN gid % 6 <> 0 THEN gid % 97 END AS author_gid FROM books WHERE shelves_retrieved),
base_reviews AS (SELECT * FROM reviews WHERE rating >= 4),
scraped AS (SELECT r.*, title, book_gid % 97 AS author_gid FROM reviews r JOIN books b ON b.gid = book_gid)
"""


def _fold(t: Tables) -> dict[str, DataFrame]:
    """All reviews come in; those rated 4 or more, and the books with shelves, are there already."""
    books = t.books().where("shelves_retrieved").select(
        "gid", "title", F.when(F.col("gid") % 6 != 0, F.col("gid") % 97).alias("author_gid")
    )
    authors = t.books().where("gid < 40").select("gid", F.concat(F.lit("Author "), F.col("gid").cast("string")).alias("name"))
    reviews = t.reviews().select(F.col("review_gid").alias("gid"), "user_gid", "book_gid", "rating", F.lit("old").alias("text"))
    titles = t.books().select(F.col("gid").alias("book_gid"), "title")
    scraped = (
        t.reviews().join(titles, "book_gid").select(
            "user_gid", "review_gid", "rating", F.lit("new").alias("text"), "book_gid", "title",
            (F.col("book_gid") % 97).alias("author_gid"),
            F.concat(F.lit("Author "), (F.col("book_gid") % 97).cast("string")).alias("author_name"),
        )
    )
    return merge.fold_reviews(books, authors, reviews.where("rating >= 4"), t.users(), scraped)


@query(
    _FOLD + """SELECT gid, title, coalesce(author_gid, (SELECT min(author_gid) FROM scraped WHERE book_gid = gid), -1) AS author_gid, TRUE AS existed
FROM base_books UNION ALL
SELECT DISTINCT book_gid, title, author_gid, FALSE FROM scraped WHERE book_gid NOT IN (SELECT gid FROM base_books)"""
)
def folded_books(t: Tables) -> DataFrame:
    return _fold(t)["books"].fillna(-1, ["author_gid"])


@query(
    _FOLD + """SELECT gid, 'Author ' || gid AS name, TRUE AS existed FROM books WHERE gid < 40 UNION ALL
SELECT DISTINCT author_gid, 'Author ' || author_gid, FALSE FROM scraped WHERE author_gid NOT IN (SELECT gid FROM books WHERE gid < 40)"""
)
def folded_authors(t: Tables) -> DataFrame:
    return _fold(t)["authors"]


@query(
    _FOLD + """SELECT review_gid AS gid, user_gid, book_gid, rating, 'old' AS text, TRUE AS existed FROM base_reviews UNION ALL
SELECT review_gid, user_gid, book_gid, rating, 'new', FALSE FROM scraped WHERE review_gid NOT IN (SELECT review_gid FROM base_reviews)"""
)
def folded_reviews(t: Tables) -> DataFrame:
    return _fold(t)["reviews"]


@query(
    _FOLD + """SELECT gid, reviews_retrieved OR gid IN (SELECT user_gid FROM scraped) AS reviews_retrieved,
  private AND gid NOT IN (SELECT user_gid FROM scraped) AS private FROM users"""
)
def folded_users(t: Tables) -> DataFrame:
    return _fold(t)["users"].select("gid", "reviews_retrieved", "private")


# --- caps and slimming ----------------------------------------------------------------------


def _per_user(t: Tables) -> DataFrame:
    """Reviews by user; every eleventh user rates low throughout."""
    low = F.least(F.col("rating"), F.lit(2.0))
    return t.reviews().select(
        F.col("user_gid").alias("user_id"), F.col("review_gid").alias("review_id"),
        F.when(F.col("user_gid") % 11 == 0, low).otherwise(F.col("rating")).alias("rating"),
    )


_PER_USER = REVIEWS + """, mine AS (
  SELECT user_gid AS user_id, review_gid AS review_id, CASE WHEN user_gid % 11 = 0 THEN least(rating, 2.0) ELSE rating END AS rating
  FROM reviews),
capped AS (
  SELECT user_id, review_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, review_id) AS pos
  FROM (SELECT *, max(rating) OVER (PARTITION BY user_id) AS best FROM mine) WHERE rating >= 3 OR best < 3 QUALIFY pos <= 12)
"""


@query(_PER_USER + "SELECT user_id, review_id, rating, pos FROM capped")
def capped_reviews(t: Tables) -> DataFrame:
    """A cap of 12 instead of the job's 500, which no user here reaches."""
    return caps.cap_reviews(_per_user(t), limit=12)


@query(_PER_USER + "SELECT user_id, count(*) AS reviews_count, TRUE AS reviews_filtered FROM capped GROUP BY user_id")
def capped_review_counts(t: Tables) -> DataFrame:
    return caps.review_counts(caps.cap_reviews(_per_user(t), limit=12))


@query(_PER_USER + "SELECT user_id, review_id, rating, row_number() OVER (PARTITION BY user_id ORDER BY rating DESC, review_id) AS pos FROM mine QUALIFY pos <= 500")
def top_rated_reviews(t: Tables) -> DataFrame:
    return caps.top_rated(_per_user(t))


@query(_PER_USER + "SELECT user_id, review_id, rating FROM mine WHERE rating >= 3")
def reviews_without_low_ratings(t: Tables) -> DataFrame:
    return caps.drop_low(_per_user(t))


@query(
    ALL + """SELECT review_gid AS gid, CAST(rating AS BIGINT) AS rating, b.title || ' ' AS title, 'f' || gid || ' d' AS text,
  6 AS book_fields FROM reviews JOIN books b ON gid = book_gid"""
)
def slim_reviews(t: Tables) -> DataFrame:
    """Slim copies of review structs; the book's shelves and the sentiment are gone."""
    books = t.books().select(F.col("gid").alias("book_gid"), F.struct(
        "gid", F.concat("title", F.lit("é")).alias("title"), F.lit("i").alias("isbn"), "average_rating", "ratings_count",
        "small_book", "list_shelves").alias("book"))
    review = t.reviews().join(books, "book_gid").select(F.struct(
        F.col("review_gid").alias("gid"), "book", F.col("rating").cast("bigint").alias("rating"),
        F.concat(F.lit("f"), F.col("book_gid").cast("string"), F.lit("ü€d")).alias("text"),
        F.lit(True).alias("textblob")).alias("r"))
    slim = review.select(caps.slim_review(F.col("r"), review.schema["r"].dataType).alias("s"))
    fields = len(slim.schema["s"].dataType["book"].dataType.names)
    return slim.select("s.gid", "s.rating", "s.book.title", "s.text", F.lit(fields).cast("int").alias("book_fields"))


# --- enrichment -----------------------------------------------------------------------------

_ENRICHED = ALL + """, todo AS (SELECT gid FROM users WHERE reviews_retrieved AND NOT shelves_reviews_retrieved),
rows AS (
  SELECT r.*, user_gid IN (SELECT gid FROM todo) AS mine, own OR coalesce(b.has_shelves, FALSE) AS resolved
  FROM reviews r LEFT JOIN books b ON b.gid = book_gid),
state AS (SELECT user_gid AS gid, bool_and(resolved) AS all_resolved FROM rows WHERE mine GROUP BY user_gid)
"""
_SHELF_TEXT = """SELECT review_gid, user_gid, book_gid, CASE WHEN own THEN 'own' WHEN mine AND resolved
  THEN p_brand || ',' || p_type || ',size' || p_size ELSE '' END AS shelves FROM rows JOIN part ON p_partkey = book_gid"""


def _flags_sql(done: str) -> str:
    return _ENRICHED + f"""SELECT u.gid, CASE WHEN t.gid IS NULL THEN reviews_retrieved ELSE s.gid IS NOT NULL END AS reviews_retrieved,
  CASE WHEN t.gid IS NULL THEN shelves_reviews_retrieved ELSE s.gid IS NOT NULL AND {done} END AS shelves_reviews_retrieved
FROM users u LEFT JOIN todo t ON t.gid = u.gid LEFT JOIN state s ON s.gid = u.gid"""


def _enriched(t: Tables, mode: str) -> tuple[DataFrame, DataFrame]:
    users, rows = enrich.enrich_reviews(t.users(), t.reviews(), t.books().select("gid", "list_shelves"), mode)
    return (
        users.select("gid", "reviews_retrieved", "shelves_reviews_retrieved"),
        rows.select("review_gid", "user_gid", "book_gid", _list("list_shelves", "shelve").alias("shelves")),
    )


@query(_ENRICHED + _SHELF_TEXT)
def enriched_reviews_retry(t: Tables) -> DataFrame:
    return _enriched(t, "retry")[1]


@query(_flags_sql("all_resolved"))
def enriched_users_retry(t: Tables) -> DataFrame:
    return _enriched(t, "retry")[0]


@query(_ENRICHED + _SHELF_TEXT + " WHERE resolved OR NOT mine")
def enriched_reviews_drop(t: Tables) -> DataFrame:
    return _enriched(t, "drop")[1]


@query(_flags_sql("TRUE"))
def enriched_users_drop(t: Tables) -> DataFrame:
    return _enriched(t, "drop")[0]


@query(
    ALL + """SELECT review_gid, CASE WHEN own THEN 'own' WHEN has_shelves THEN p_brand || ',' || p_type || ',size' || p_size ELSE '' END AS shelves,
  own OR has_shelves AS resolved
FROM reviews JOIN books ON gid = book_gid JOIN part ON p_partkey = book_gid"""
)
def incremental_enrichment(t: Tables) -> DataFrame:
    """Reviews after three rounds in which books come late and reviews come again: the batch result."""
    rows = incremental.current_reviews(t.spark, _polled(t))
    return rows.select("review_gid", _list("list_shelves", "shelve").alias("shelves"), "resolved")


def _polled(t: Tables) -> incremental.EnrichPaths:
    root, source = new_path(t.spark, "incremental"), new_path(t.spark, "review-files")
    books = t.books().select("gid", "list_shelves")
    reviews = t.reviews()
    reviews.write.parquet(source)
    again = t.spark.read.schema(reviews.schema).parquet(source).where("review_gid % 7 = 0")
    for turn, late in enumerate((books.where("gid % 2 = 0"), books.where("gid % 3 <> 1"), books)):
        if turn == 1:
            again.coalesce(2).write.mode("append").parquet(source)
        stream = incremental.review_stream(t.spark, source, reviews.schema, files_per_batch=4)
        paths = incremental.incremental_enrich(stream, late, root, max_wait=1)
    return paths


@query(_flags_sql("all_resolved"))
def polled_user_flags(t: Tables) -> DataFrame:
    """Flags of users from the state of the rounds: those of the batch job."""
    return incremental.polled_users(t.users(), _polled(t)).select("gid", "reviews_retrieved", "shelves_reviews_retrieved")


@query(
    ALL + """SELECT 'reviews without shelves' AS rule, count(*) AS violations FROM reviews WHERE NOT own UNION ALL
SELECT 'reviews whose book has no shelves', count(*) FROM reviews JOIN books ON gid = book_gid WHERE NOT own AND NOT has_shelves UNION ALL
SELECT 'users with such a review', count(DISTINCT user_gid) FROM reviews JOIN books ON gid = book_gid WHERE NOT own AND NOT has_shelves UNION ALL
SELECT 'users done without reviews', count(*) FROM users WHERE shelves_reviews_retrieved AND NOT reviews_retrieved UNION ALL
SELECT 'declared review count differs', count(*) FROM users LEFT JOIN (SELECT user_gid, count(*) AS n FROM reviews GROUP BY ALL) ON user_gid = gid
WHERE reviews_count <> coalesce(n, 0)"""
)
def consistency_report(t: Tables) -> DataFrame:
    return enrich.consistency_report(t.users(), t.reviews(), t.books())


@query(
    ALL + """SELECT gid AS user_gid, reviews_count, coalesce(n, 0) AS actual FROM users
LEFT JOIN (SELECT user_gid, count(*) AS n FROM reviews GROUP BY ALL) ON user_gid = gid WHERE reviews_count <> coalesce(n, 0)"""
)
def declared_count_mismatch(t: Tables) -> DataFrame:
    owners = t.users().select(F.col("gid").alias("user_gid"), "reviews_count")
    return enrich.count_mismatch(owners, t.reviews(), "user_gid", "reviews_count")


# --- flags ----------------------------------------------------------------------------------


@query(BOOKS + "SELECT gid, has_shelves AS repaired, shelves_retrieved AND has_shelves AS cleared, coalesce(small_book, TRUE) AS small_book FROM books")
def repaired_book_flags(t: Tables) -> DataFrame:
    both = flags.repair_flag(t.books(), "shelves_retrieved", "list_shelves").select("gid", F.col("shelves_retrieved").alias("repaired"))
    cleared = flags.repair_flag(t.books(), "shelves_retrieved", "list_shelves", "clear")
    return both.join(
        flags.default_small_book(cleared).select("gid", F.col("shelves_retrieved").alias("cleared"), "small_book"), "gid"
    )


def _nested_users(t: Tables) -> DataFrame:
    """Users with a short nested list: none, empty, or one review with or without shelves."""
    key = F.col("gid")
    shelf = F.array(F.struct(F.col("name").alias("shelve"), F.lit(1).cast("bigint").alias("count")))
    book = F.struct(key.alias("gid"), F.when(key % 3 == 0, shelf).otherwise(F.slice(shelf, 1, 0)).alias("list_shelves"))
    review = F.array(F.struct(key.alias("gid"), book.alias("book"), F.lit(4).alias("rating")))
    friends = F.array((key + 1).alias("gid"))
    return t.users().select(
        "*",
        F.when(key % 5 == 0, F.slice(review, 1, 0)).when(key % 5 != 1, review).alias("list_reviews"),
        F.when(key % 2 == 0, friends).alias("list_friends"),
        (key % 3).alias("friends_count"),
    )


@query(
    with_views("users") + """SELECT gid, reviews_retrieved AND gid % 5 > 1 AS reviews_retrieved,
  shelves_reviews_retrieved AND reviews_retrieved AND gid % 5 > 1 AS shelves_reviews_retrieved,
  friends_retrieved AND gid % 2 = 0 AS friends_retrieved FROM users"""
)
def repaired_user_flags(t: Tables) -> DataFrame:
    return flags.repair_user_flags(_nested_users(t)).select(
        "gid", "reviews_retrieved", "shelves_reviews_retrieved", "friends_retrieved"
    )


@query(with_views("users") + "SELECT gid, shelves_reviews_retrieved AND NOT (gid % 5 > 1 AND gid % 3 <> 0) AS shelves_reviews_retrieved FROM users")
def first_review_check(t: Tables) -> DataFrame:
    return flags.first_review_check(_nested_users(t)).select("gid", "shelves_reviews_retrieved")


@query(with_views("users") + "SELECT gid, gid % 3 AS friends_count, CASE WHEN gid % 2 = 0 THEN 1 ELSE 0 END::BIGINT AS actual FROM users WHERE gid % 3 <> CASE WHEN gid % 2 = 0 THEN 1 ELSE 0 END")
def nested_count_mismatch(t: Tables) -> DataFrame:
    return enrich.nested_count_mismatch(_nested_users(t))


@query(with_views("users") + "SELECT gid, FALSE AS shelves_reviews_retrieved, friends_retrieved OR private AS friends_retrieved, TRUE AS test_set FROM users")
def set_user_flags(t: Tables) -> DataFrame:
    users = flags.set_flag(t.users(), "shelves_reviews_retrieved", False)
    users = flags.mark_test_set(flags.set_flag(users, "friends_retrieved", True, "private"))
    return users.select("gid", "shelves_reviews_retrieved", "friends_retrieved", "test_set")


# --- shelves, hashes, links -----------------------------------------------------------------


@query(with_views("book_shelves") + "SELECT DISTINCT shelve, book_gid FROM book_shelves")
def shelf_index(t: Tables) -> DataFrame:
    return shelves.shelf_index(t.books())


@query(with_views("book_shelves") + "SELECT shelve, count(*) AS n_books, CAST(sum(book_gid) AS BIGINT) AS ids FROM (SELECT DISTINCT shelve, book_gid FROM book_shelves) GROUP BY shelve")
def shelf_table(t: Tables) -> DataFrame:
    """The nested index in chunks of some 50 books, added up again per shelf."""
    total = F.aggregate("list_book", F.lit(0).cast("bigint"), lambda a, x: a + x)
    return shelves.shelf_table(t.books(), chunk=50).groupBy("shelve").agg(
        F.sum(F.size("list_book")).alias("n_books"), F.sum(total).alias("ids")
    )


_TOP = ALL + """, tally AS (
  SELECT user_gid, shelve, CAST(sum(count) AS BIGINT) AS votes, count(*) AS count
  FROM (SELECT DISTINCT user_gid, book_gid FROM reviews) JOIN book_shelves USING (book_gid) GROUP BY ALL HAVING sum(count) >= 2),
tops AS (
  SELECT user_gid, shelve, votes, count, row_number() OVER (PARTITION BY user_gid ORDER BY count DESC, votes DESC, shelve) AS rank
  FROM tally QUALIFY rank <= 10)
"""


@query(_TOP + "SELECT user_gid, rank, shelve, votes, count FROM tops")
def top_shelves(t: Tables) -> DataFrame:
    return shelves.top_shelves(t.reviews(), t.books(), 10, min_votes=2)


@query(_TOP + "SELECT user_gid, string_agg(shelve || ':' || votes || ':' || count, ',' ORDER BY rank) AS shelves FROM tops GROUP BY user_gid")
def top_shelves_text(t: Tables) -> DataFrame:
    """Top shelves written as delimited lines and parsed again."""
    one = F.concat_ws(",", "shelve", "votes", "count")
    lines = shelves.top_shelves(t.reviews(), t.books(), 10, min_votes=2).groupBy("user_gid").agg(
        F.array_sort(F.collect_list(F.struct("rank", F.concat(F.lit("("), one, F.lit(")")).alias("s")))).alias("l")
    )
    path = new_path(t.spark, "top-shelves")
    lines.select(
        F.concat(F.lit("("), F.col("user_gid").cast("string"), F.lit(" user|"), F.array_join(F.transform("l", lambda x: x["s"]), "|"), F.lit(")")).alias("value")
    ).write.text(path)
    parsed = tables.read_top_shelves(t.spark, path)
    return parsed.select(
        "user_gid",
        F.array_join(F.transform("most_common_shelves", lambda s: F.concat_ws(":", s["shelve"], s["votes"].cast("string"), s["count"].cast("string"))), ",").alias("shelves"),
    )


_POLY = """list_reduce([7::HUGEINT] || list_transform(string_split({0}, ''), lambda x: ord(x)::HUGEINT), lambda h, c: (h * 1223 + c) % 4222234741)::BIGINT"""


@query(f"SELECT doc_id, {_POLY.format('text')} AS hash FROM documents")
def poly_hash(t: Tables) -> DataFrame:
    return t("documents").select("doc_id", X.poly_hash("text").alias("hash"))


@query(
    f"""SELECT h % 1000 AS hash, count(*) AS n_names, min(c_name) AS first_name, max(c_name) AS last_name
FROM (SELECT DISTINCT c_name, {_POLY.format('c_name')} AS h FROM customer) GROUP BY 1 HAVING count(*) > 1"""
)
def hash_collisions(t: Tables) -> DataFrame:
    return shelves.hash_collisions(t("customer"), "c_name", X.poly_hash("name") % 1000)


@query("SELECT c_name, ('0x' || substr(md5(c_name), 1, 15))::BIGINT % 100000000 AS bucket FROM customer")
def bucket_ids(t: Tables) -> DataFrame:
    return t("customer").select("c_name", X.bucket_id("c_name").alias("bucket"))


@query("SELECT DISTINCT a AS author_gid, p_partkey AS book_gid FROM (SELECT p_partkey, unnest([p_partkey % 97, p_partkey % 89]) AS a FROM part)")
def author_book_links(t: Tables) -> DataFrame:
    return shelves.author_book_links(t.books())


@query("SELECT p_partkey AS gid, p_partkey % 97 AS author_gid FROM part")
def first_authors(t: Tables) -> DataFrame:
    return shelves.first_author(t.books()).select("gid", F.col("author.gid").alias("author_gid"))


# --- viewer ---------------------------------------------------------------------------------

_RECS = _TOP + """, recs AS (
  SELECT user_gid, book_gid, row_number() OVER (PARTITION BY user_gid ORDER BY rating DESC, book_gid) AS pos
  FROM (SELECT user_gid, book_gid, max(rating) AS rating FROM reviews GROUP BY ALL) QUALIFY pos <= 10),
common AS (SELECT * FROM tops WHERE rank <= 3),
names AS (SELECT gid AS user_gid, name AS username, CAST(gid % 101 AS DOUBLE) / 101 AS precision, gid % 6 <> 0 AS shown FROM users),
genders AS (SELECT DISTINCT 'Customer#' || lpad(CAST(c_custkey AS VARCHAR), 9, '0') AS name, 'f' AS gender FROM customer WHERE c_custkey % 2 = 0)
"""


def _recommendations(t: Tables) -> DataFrame:
    """A recommendation table: each user's ten best reviewed books and three top shelves."""
    best = t.reviews().groupBy("user_gid", "book_gid").agg(F.max("rating").alias("rating"))
    ranked = caps.top_rated(best.select(F.col("user_gid").alias("user_id"), F.col("book_gid").alias("review_id"), "rating"), 10)
    recs = ranked.select("user_id", F.col("pos").alias("rank"), F.col("review_id").alias("item_id"))
    quality = t.users().select(F.col("gid").alias("user_id"), (F.col("gid") % 101 / F.lit(101.0)).alias("precision"), F.lit(0.5).alias("recall"))
    table = enrich.attach_username(sinks.recommendation_table(recs, quality), t.users())
    shelf = F.struct("rank", "shelve", "votes", "count")
    common = shelves.top_shelves(t.reviews(), t.books(), 3, min_votes=2).groupBy("user_gid").agg(
        F.array_sort(F.collect_list(shelf)).alias("most_common_shelves")
    )
    return flags.set_common_shelves_flag(
        table.join(common, "user_gid", "left").withColumn(
            "most_common_shelves", F.when(F.col("user_gid") % 6 != 0, F.col("most_common_shelves"))
        )
    )


def _genders(t: Tables) -> DataFrame:
    return t("customer").where("c_custkey % 2 = 0").select(F.col("c_name").alias("name"), F.lit("f").alias("gender"))


def _marked(t: Tables) -> DataFrame:
    table = materialize(_recommendations(t), "recommendations")
    books = t.books().select("gid", "title", F.transform(
        F.coalesce("list_shelves", F.array().cast("array<struct<shelve:string,count:bigint>>")),
        lambda s: s.withField("best", F.lit(False))).alias("list_shelves"))
    return table.join(enrich.attach_item_details(table, books), "user_gid")


@query(_RECS + "SELECT user_gid, string_agg(book_gid || ':' || p_name, ',' ORDER BY pos) AS books FROM recs JOIN part ON p_partkey = book_gid GROUP BY user_gid")
def attached_item_details(t: Tables) -> DataFrame:
    books = F.transform("books_details_recommended", lambda b: F.concat_ws(":", b["gid"].cast("string"), b["title"]))
    return _marked(t).select("user_gid", F.array_join(books, ",").alias("books"))


@query(
    _RECS + """SELECT r.user_gid, r.book_gid, s.shelve,
  (r.user_gid % 6 <> 0 AND EXISTS (SELECT 1 FROM common c WHERE c.user_gid = r.user_gid AND c.shelve = s.shelve)) AS best
FROM recs r JOIN book_shelves s USING (book_gid)"""
)
def best_shelves_marked(t: Tables) -> DataFrame:
    books = viewer.mark_best_shelves(_marked(t)).select("user_gid", F.explode("books_details_recommended").alias("b"))
    return books.select("user_gid", F.col("b.gid").alias("book_gid"), F.explode("b.list_shelves").alias("s")).select(
        "user_gid", "book_gid", "s.shelve", "s.best"
    )


@query(
    _RECS + """SELECT user_gid, round(precision, 6) AS precision, CAST(round(precision * 100) AS INTEGER) AS precision_percent, username,
  CASE WHEN user_gid % 2 = 0 THEN 'f' ELSE 'unknown' END AS gender
FROM names WHERE shown AND user_gid IN (SELECT user_gid FROM recs) AND user_gid IN (SELECT user_gid FROM common)"""
)
def user_index(t: Tables) -> DataFrame:
    return viewer.user_index(_recommendations(t), _genders(t)).select(
        "user_gid", F.round("precision", 6).alias("precision"), "precision_percent", "username", "gender"
    )


@query(
    _RECS + """SELECT r.user_gid, username, 'unknown' AS gender, string_agg(r.book_gid, ',' ORDER BY pos) AS items
FROM recs r JOIN names USING (user_gid) WHERE r.user_gid = 7 GROUP BY ALL"""
)
def user_detail(t: Tables) -> DataFrame:
    return viewer.user_detail(_marked(t), _genders(t), 7).select(
        "user_gid", "username", "gender", _list("item_recommended").alias("items")
    )


@query("SELECT p_partkey AS gid, p_name AS title FROM part WHERE p_partkey = 11")
def item_detail(t: Tables) -> DataFrame:
    return viewer.item_detail(t.books(), 11).select("gid", "title")


# --- documents and text ---------------------------------------------------------------------


def _book_xml(t: Tables) -> DataFrame:
    """One book document per part: no, one or two shelves, one or two authors, bad dates."""
    key, num = F.col("p_partkey"), lambda c: c.cast("string")
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value, F.lit(f"</{name}>"))
    shelf = lambda name, n: F.concat(F.lit('<shelf name="'), name, F.lit('" count="'), num(n), F.lit('"/>'))
    author = lambda i: tag("author", F.concat(tag("id", num(i)), tag("name", F.concat(F.lit("Ann "), num(i))), F.lit("<average_rating>4.5</average_rating><ratings_count>9</ratings_count>")))
    shelf_text = F.concat(
        F.when(key % 3 > 0, shelf(F.col("p_brand"), F.col("p_size"))).otherwise(F.lit("")),
        F.when(key % 3 > 1, shelf(F.col("p_type"), key % 10)).otherwise(F.lit("")),
    )
    similar = tag("book", F.concat(tag("id", num(key + 1)), tag("title_without_series", F.lit("näxt")), F.lit("<isbn>1</isbn><isbn13>2</isbn13><average_rating>3.5</average_rating><ratings_count>4</ratings_count>"), tag("authors", author(key % 89))))
    return t("part").select(
        F.concat(
            F.lit("<response><book>"),
            tag("id", num(key)), tag("title", F.concat("p_name", F.lit("é"))), F.lit("<isbn>0123</isbn><isbn13>978</isbn13>"),
            F.lit("<publication_year>2011</publication_year>"),
            tag("publication_month", num(key % 12 + 1)),
            F.when(key % 4 > 0, tag("publication_day", num(key % 31 + 1))).otherwise(F.lit("<publication_day/>")),
            tag("description", F.lit("d")), tag("average_rating", num(F.col("p_retailprice"))),
            tag("ratings_count", num(F.col("p_size"))), F.lit("<text_reviews_count>5</text_reviews_count>"),
            tag("popular_shelves", shelf_text), tag("authors", F.concat(author(key % 97), F.when(key % 2 == 0, author(key % 89)).otherwise(F.lit("")))),
            tag("similar_books", similar), F.lit("</book></response>"),
        ).alias("xml")
    )


@query(
    """SELECT p_partkey AS gid, p_name || ' ' AS title, p_retailprice AS average_rating, CAST(p_size AS BIGINT) AS ratings_count,
  coalesce(strftime(TRY_CAST('2011-' || lpad(CAST(p_partkey % 12 + 1 AS VARCHAR), 2, '0') || '-' ||
    lpad(CAST(CASE WHEN p_partkey % 4 > 0 THEN p_partkey % 31 + 1 ELSE 1 END AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d'), '') AS published,
  CASE WHEN p_partkey % 3 = 0 THEN '' WHEN p_partkey % 3 = 1 THEN p_brand ELSE p_brand || ',' || p_type END AS shelves,
  p_partkey % 97 AS author_gid, CAST(p_partkey + 1 AS VARCHAR) AS similar, 'n xt' AS similar_title
FROM part"""
)
def book_documents(t: Tables) -> DataFrame:
    rows = xml.parse_book_xml(_book_xml(t))
    return rows.select(
        "gid", "title", "average_rating", "ratings_count", _day("publication_date").alias("published"),
        _list("list_shelves", "shelve").alias("shelves"), F.col("author.gid").alias("author_gid"),
        _list("similar_books", "gid").alias("similar"), _list("similar_books", "title").alias("similar_title"),
    )


@query(
    """SELECT c_custkey AS gid, c_name AS name, c_mktsegment AS location, CAST(c_nationkey AS BIGINT) AS age, c_custkey % 9 AS friends_count,
  CASE WHEN c_custkey % 2 = 0 THEN 'A' ELSE '' END AS favorites FROM customer"""
)
def user_documents(t: Tables) -> DataFrame:
    tag = lambda name, value: F.concat(F.lit(f"<{name}>"), value.cast("string"), F.lit(f"</{name}>"))
    key = F.col("c_custkey")
    docs = t("customer").select(
        F.concat(
            F.lit("<response><user>"), tag("id", key), tag("name", F.col("c_name")), tag("location", F.col("c_mktsegment")),
            tag("age", F.col("c_nationkey")), F.lit("<gender>x</gender><interests/><friends_count type=\"integer\">"),
            (key % 9).cast("string"), F.lit("</friends_count><reviews_count type=\"integer\">3</reviews_count>"),
            F.when(key % 2 == 0, F.lit("<favorite_authors><author><id>1</id><name>A</name></author></favorite_authors>")).otherwise(F.lit("")),
            F.lit("</user></response>"),
        ).alias("xml")
    )
    return xml.parse_user_xml(docs).select(
        "gid", "name", "location", "age", "friends_count", _list("favorite_authors", "name").alias("favorites")
    )


@query(
    """SELECT c_custkey AS user_gid, c_custkey % 4 AS total, CASE c_custkey % 3 WHEN 0 THEN '' WHEN 1 THEN CAST(c_custkey + 1 AS VARCHAR)
  ELSE (c_custkey + 1) || ',' || (c_custkey + 2) END AS friends, c_custkey % 4 <> c_custkey % 3 AS mismatch FROM customer"""
)
def friend_documents(t: Tables) -> DataFrame:
    key = F.col("c_custkey")
    user = lambda i: F.concat(F.lit("<user><id>"), i.cast("string"), F.lit("</id><name>N</name><friends_count>1</friends_count><reviews_count>2</reviews_count></user>"))
    docs = t("customer").select(
        key.alias("user_gid"),
        F.concat(
            F.lit('<response><friends total="'), (key % 4).cast("string"), F.lit('">'),
            F.when(key % 3 > 0, user(key + 1)).otherwise(F.lit("")), F.when(key % 3 > 1, user(key + 2)).otherwise(F.lit("")),
            F.lit("</friends></response>"),
        ).alias("xml"),
    )
    rows = xml.parse_friends_xml(docs)
    return rows.select(
        "user_gid", "total", _list("list_friends", "gid").alias("friends"), (F.size("list_friends") != F.col("total")).alias("mismatch")
    )


def _review_page(t: Tables) -> DataFrame:
    """One page per review, with labelled cells and the three ways of giving a rating."""
    cell = lambda name, value: F.concat(F.lit(f'<td class="field {name}"><label>{name} 7</label><div class="value">'), value, F.lit("</div></td>"))
    s = lambda c: F.col(c).cast("string")
    lit = lambda n: F.repeat(F.lit('<span class="staticStar p10"></span>'), n.cast("int"))
    how = F.col("review_gid") % 3
    rating = (
        F.when(how == 0, F.concat(F.lit('<a class="staticStars">'), lit(F.col("rating")), F.lit("</a>")))
        .when(how == 1, F.concat(F.lit('<div class="stars" data-rating="'), F.col("rating").cast("int").cast("string"), F.lit('"></div>')))
        .otherwise(lit(F.col("rating")))
    )
    text = F.concat(F.lit("<span>short</span>"), F.when(how > 0, F.concat(F.lit("<span>löng "), s("book_gid"), F.lit("</span>"))).otherwise(F.lit("")))
    name = F.when(how == 0, F.lit("Mono")).otherwise(F.concat(F.lit("Last"), s("book_gid"), F.lit(", First")))
    day = F.concat(F.lit("  "), F.date_format("l_shipdate", "MMM dd, yyyy"))
    rows = t.purchases().groupBy(
        (F.col("line_id") * 10_000_000 + F.col("item_id")).alias("review_gid"), F.col("item_id").alias("book_gid")
    ).agg(F.max("rating").alias("rating"), F.min("l_shipdate").alias("l_shipdate"))
    return rows.select(
        F.col("review_gid").alias("page_id"),
        F.concat(
            F.lit("<html><body><table><tr id='no_1'><td>menu</td></tr></table><table id=\"books\"><tbody><tr id=\"review_"), s("review_gid"), F.lit('">'),
            cell("title", F.concat(F.lit('<a href="/book/show/'), s("book_gid"), F.lit('-t">  Title '), s("book_gid"), F.lit("</a>"))),
            cell("author", F.concat(F.lit('<a href="/author/show/'), (F.col("book_gid") % 97).cast("string"), F.lit('">'), name, F.lit("</a> <span>*</span>"))),
            cell("isbn", F.lit("  0123")), cell("isbn13", F.lit("978")), cell("avg_rating", F.lit("3.75")), cell("num_ratings", F.lit("1,234")),
            cell("date_added", day), cell("rating", rating), cell("review", text),
            F.lit("</tr></tbody></table></body></html>"),
        ).alias("html"),
    )


@query(
    with_views("purchases") + """, rows AS (
  SELECT line_id * 10000000 + item_id AS review_gid, item_id AS book_gid, max(rating) AS rating, min(l_shipdate) AS shipped
  FROM purchases GROUP BY ALL)
SELECT review_gid, book_gid, 'Title ' || book_gid AS title, book_gid % 97 AS author_gid,
  CASE WHEN review_gid % 3 = 0 THEN 'Mono' ELSE 'First Last' || book_gid END AS author_name, '0123' AS isbn, 3.75::DOUBLE AS average_rating,
  1234::BIGINT AS ratings_count, strftime(shipped, '%Y-%m-%d') AS added, CAST(rating AS BIGINT) AS rating,
  CASE WHEN review_gid % 3 = 0 THEN 'short' ELSE 'l ng ' || book_gid END AS text
FROM rows WHERE rating >= 3"""
)
def review_pages(t: Tables) -> DataFrame:
    """Review rows of pages made from the line items."""
    rows = html.extract_review_rows(_review_page(t))
    return rows.select(
        "review_gid", "book_gid", "title", "author_gid", "author_name", "isbn", "average_rating", "ratings_count",
        _day("date_added").alias("added"), "rating", "text",
    )


@query(
    """SELECT page_id, 1 + CAST(page_id % 6 >= 3 AS BIGINT) AS n_reviews, page_id + CASE WHEN page_id % 6 >= 3 THEN page_id + 1 ELSE 0 END AS books,
  'page ' || page_id AS text FROM pages"""
)
def web_page_reviews(t: Tables) -> DataFrame:
    """The given pages with a table of two reviews at the end, of which the second may be rated too low."""
    key = F.col("page_id")
    row = lambda book, rating: F.concat(
        F.lit('<tr id="review_'), book.cast("string"), F.lit('"><td class="field title"><label>title 7</label><div class="value"><a href="/book/show/'),
        book.cast("string"), F.lit('">T</a></div></td><td class="field rating"><div class="value"><div class="stars" data-rating="'), rating.cast("string"),
        F.lit('"></div></div></td><td class="field review"><label>review</label><div class="value"><span>page '), key.cast("string"), F.lit("</span></div></td></tr>"),
    )
    table = F.concat(F.lit('<table id="books"><tbody>'), row(key, F.lit(5)), row(key + 1, key % 6), F.lit("</tbody></table>"))
    found = html.extract_review_rows(t("pages").select("page_id", F.concat(F.coalesce("html", F.lit("")), table).alias("html")))
    return found.groupBy("page_id").agg(F.count(F.lit(1)).alias("n_reviews"), F.sum("book_gid").alias("books"), F.max("text").alias("text"))


@query(
    r"""SELECT doc_id, regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g') AS folded, coalesce(TRY_CAST(regexp_extract(text, '[0-9]+') AS BIGINT), -1) AS number,
  replace(text, '  ', '') AS single, string_split(replace(text, '[', ''), ' ')[1] AS token FROM documents"""
)
def folded_texts(t: Tables) -> DataFrame:
    return t("documents").select(
        "doc_id",
        X.ascii_fold("text").alias("folded"),
        F.coalesce(X.first_number("text"), F.lit(-1)).alias("number"),
        X.drop_double_spaces("text").alias("single"),
        X.first_token("text").alias("token"),
    )


@query(
    """SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS parsed, CAST(floor(o_totalprice) AS BIGINT) AS total,
  coalesce(strftime(TRY_CAST('2011-02-' || lpad(CAST(o_orderkey % 31 + 1 AS VARCHAR), 2, '0') AS DATE), '%Y-%m-%d'), '') AS built,
  'B' || o_custkey || ' A' AS flipped, CAST(round((o_orderkey % 1000) / 1000.0 * 100) AS INTEGER) AS percent FROM orders"""
)
def cleaned_fields(t: Tables) -> DataFrame:
    key = F.col("o_orderkey")
    grouped = F.format_number(F.floor("o_totalprice"), 0)
    return t("orders").select(
        "o_orderkey",
        _day_of(X.parse_review_date(F.concat(F.lit("  "), F.date_format("o_orderdate", "MMM dd, yyyy")))).alias("parsed"),
        X.plain_int(grouped).alias("total"),
        _day_of(X.date_from_parts(F.lit(2011), F.lit(2), key % 31 + 1)).alias("built"),
        X.flip_name(F.concat(F.lit("A, B"), F.col("o_custkey").cast("string"))).alias("flipped"),
        X.percent((key % 1000) / F.lit(1000.0)).alias("percent"),
    )


def _day_of(col: F.Column) -> F.Column:
    return F.coalesce(F.date_format(col, "yyyy-MM-dd"), F.lit(""))


_LEXICON = r"""WITH folded AS (
  SELECT doc_id, unnest(string_split_regex(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g'), '[.!?]+')) AS part,
         generate_subscripts(string_split_regex(regexp_replace(text, '[^\x00-\x7F]+', ' ', 'g'), '[.!?]+'), 1) - 1 AS pos FROM documents),
sentences AS (
  SELECT doc_id, pos, trim(regexp_replace(part, '\s+', ' ', 'g')) AS sentence FROM folded WHERE trim(regexp_replace(part, '\s+', ' ', 'g')) <> ''),
words AS (SELECT doc_id, pos, unnest(string_split_regex(lower(sentence), '[^a-z]+')) AS word FROM sentences),
counted AS (SELECT doc_id, pos, word, count(*) AS n FROM words WHERE word <> '' GROUP BY ALL),
lexicon AS (
  SELECT word, 2 * avg(quality) - 1 AS polarity, avg(toxic) AS subjectivity
  FROM (SELECT DISTINCT doc_id, word FROM counted) JOIN labels USING (doc_id) GROUP BY word)
"""


@query(
    _LEXICON + """, units AS (
  SELECT word, CAST(round(polarity * 1000000) AS BIGINT) AS p, CAST(round(subjectivity * 1000000) AS BIGINT) AS s FROM lexicon),
sums AS (
  SELECT doc_id, pos, any_value(sentence) AS sentence, CAST(coalesce(sum(n), 0) AS BIGINT) AS words,
    sum(n * p) AS p, sum(n * s) AS s, sum(n) FILTER (WHERE p IS NOT NULL) AS known
  FROM sentences LEFT JOIN counted USING (doc_id, pos) LEFT JOIN units USING (word) GROUP BY doc_id, pos)
SELECT doc_id, pos, sentence, words, coalesce(sign(p) * ((2 * abs(p) + 10 * known) // (20 * known)) / 100000, 0.0) AS polarity,
  coalesce(sign(s) * ((2 * abs(s) + 10 * known) // (20 * known)) / 100000, 0.0) AS subjectivity
FROM sums"""
)
def sentence_sentiment(t: Tables) -> DataFrame:
    """Sentences of all documents, scored with a lexicon learned from the labels."""
    return _scored(t).select("doc_id", "pos", "sentence", "words", "polarity", "subjectivity")


def _scored(t: Tables) -> DataFrame:
    sentences = materialize(sentiment.split_sentences(t("documents"), "doc_id", "text"), "sentences")
    return sentiment.score_sentences(sentences, sentiment.lexicon_from_labels(sentences, t("labels")))


@query(
    _LEXICON + """SELECT d.doc_id, text IS NOT NULL AS instantiated, count(s.pos) AS n_sentences, coalesce(string_agg(sentence, '|' ORDER BY pos), '') AS sentences
FROM documents d LEFT JOIN sentences s USING (doc_id) GROUP BY ALL"""
)
def review_textblobs(t: Tables) -> DataFrame:
    rows = sentiment.review_textblob(t("documents").select("doc_id", "text"), _scored(t))
    n = F.coalesce(F.size("sentences"), F.lit(0)).cast("bigint")
    return rows.select("doc_id", "instantiated", F.greatest(n, F.lit(0)).alias("n_sentences"), F.coalesce(F.array_join("sentences.text", "|"), F.lit("")).alias("sentences"))
