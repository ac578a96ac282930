"""Views of the given tables in the shapes the operators expect.

Each view exists twice, as a DataFrame and as SQL text, so that results can be compared with
an independent engine.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _coarse() -> F.Column:
    """Feature number of a part: brand and size."""
    return F.substring("p_brand", 7, 9).cast("bigint") * 100 + F.col("p_size")


def _fine() -> F.Column:
    """Feature number of a part: brand, size and type (initial and length tell types apart)."""
    return _coarse() * 1000 + F.ascii("p_type") * 10 + F.length("p_type")


class Tables:
    """Lazy readers of the parquet tables of one folder."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def __call__(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def purchases(self) -> DataFrame:
        """Line items with their customer."""
        return (
            self("lineitem")
            .join(self("orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey"), "l_orderkey")
            .select(
                F.col("o_custkey").alias("user_id"),
                F.col("l_partkey").alias("item_id"),
                F.ceil(F.col("l_quantity") / 10).cast("double").alias("rating"),
                (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("line_id"),
                "l_orderkey",
                "l_quantity",
                "l_shipdate",
            )
        )

    def ratings(self) -> DataFrame:
        """One rating per (user, item), with category and optional parent category."""
        best = self.purchases().groupBy("user_id", "item_id").agg(F.max("rating").alias("rating"))
        part = self("part").select(
            F.col("p_partkey").alias("item_id"),
            _fine().alias("category"),
            F.when(F.col("p_size") <= 40, _coarse()).alias("parent"),
        )
        return best.join(part, "item_id")

    def interactions(self) -> DataFrame:
        """One row per (user, item) with the item's fine category as its feature."""
        # a user's rows together, for the distinct rows as for all that is counted by user afterwards
        pairs = self.purchases().select("user_id", "item_id").repartition("user_id").distinct()
        part = self("part").select(
            F.col("p_partkey").alias("item_id"),
            _fine().alias("feature"),
        )
        return pairs.join(part, "item_id")

    def nested_interactions(self) -> DataFrame:
        """The nested input form, one row per (user, item), three features per item."""
        # a user's rows together, for the distinct rows as for all that is counted by user afterwards
        pairs = self.purchases().select("user_id", "item_id").repartition("user_id").distinct()
        part = self("part").select(
            F.col("p_partkey").alias("item_id"),
            F.array(_fine(), _coarse(), _coarse()).alias("features"),
        )
        return pairs.join(part, "item_id").select(
            "user_id", F.array(F.struct("item_id", "features")).alias("items")
        )

    def trust_reviews(self) -> DataFrame:
        """Review rows on coarse items, several per (user, item)."""
        part = self("part").select(
            F.col("p_partkey").alias("item_id"), F.concat_ws("|", "p_brand", "p_type").alias("coarse")
        )
        return (
            self.purchases()
            .join(part, "item_id")
            .select(
                "user_id",
                F.col("coarse").alias("item_id"),
                "rating",
                F.struct("line_id", F.col("item_id").alias("part_id"), "rating").alias("source"),
            )
        )

    def trust_edges(self) -> DataFrame:
        """A customer trusts the customers whose number equals a part they bought."""
        people = self("customer").select(F.col("c_custkey").alias("dst"))
        return (
            self.purchases()
            .select(F.col("user_id").alias("src"), F.col("item_id").alias("dst"))
            .join(people, "dst", "left_semi")
            .select("src", "dst")
        )


    def books(self) -> DataFrame:
        """Parts as books with shelves; large ones have none, every ninth has no flag."""
        shelf = lambda name, count: F.struct(name.alias("shelve"), count.cast("bigint").alias("count"))
        key = F.col("p_partkey")
        return self("part").select(
            key.alias("gid"),
            F.col("p_name").alias("title"),
            F.col("p_retailprice").alias("average_rating"),
            F.col("p_size").cast("bigint").alias("ratings_count"),
            F.when(key % 9 != 0, key % 2 == 0).alias("small_book"),
            (key % 5 != 0).alias("shelves_retrieved"),
            F.when(
                F.col("p_size") <= 45,
                F.array(
                    shelf(F.col("p_brand"), F.col("p_size")),
                    shelf(F.col("p_type"), key % 10),
                    shelf(F.concat(F.lit("size"), F.col("p_size")), F.lit(1)),
                ),
            ).alias("list_shelves"),
            F.array(
                F.struct((key % 97).alias("gid"), F.concat(F.lit("Author "), key % 97).alias("name")),
                F.struct((key % 89).alias("gid"), F.concat(F.lit("Author "), key % 89).alias("name")),
            ).alias("authors"),
        )

    def reviews(self) -> DataFrame:
        """Line items as reviews; a third brings its own shelf, the rest an empty or null list."""
        rows = self.purchases().groupBy(
            (F.col("line_id") * 10_000_000 + F.col("item_id")).alias("review_gid"),
            F.col("user_id").alias("user_gid"),
            F.col("item_id").alias("book_gid"),
            "line_id",
        ).agg(F.max("rating").alias("rating"))
        own = F.array(F.struct(F.lit("own").alias("shelve"), F.lit(1).cast("bigint").alias("count")))
        return rows.select(
            "review_gid",
            "user_gid",
            "book_gid",
            "rating",
            F.when(F.col("line_id") % 3 == 0, own).when(F.col("line_id") % 3 == 1, F.slice(own, 1, 0)).alias("list_shelves"),
        )

    def users(self) -> DataFrame:
        """Customers as users with status flags."""
        key = F.col("c_custkey")
        return self("customer").select(
            key.alias("gid"),
            F.col("c_name").alias("name"),
            (key % 7 == 0).alias("private"),
            (key % 10 != 0).alias("reviews_retrieved"),
            (key % 4 == 0).alias("shelves_reviews_retrieved"),
            (key % 3 == 0).alias("friends_retrieved"),
            (key % 50).alias("reviews_count"),
        )


# --- the same views as SQL ------------------------------------------------------------------

SQL = {
    "purchases": """purchases AS (
  SELECT o_custkey AS user_id, l_partkey AS item_id, CAST(ceil(l_quantity / 10) AS DOUBLE) AS rating,
         l_orderkey * 8 + l_linenumber AS line_id, l_orderkey, l_quantity, l_shipdate
  FROM lineitem JOIN orders ON o_orderkey = l_orderkey),
features AS (
  SELECT p_partkey AS item_id, p_size, CAST(substr(p_brand, 7) AS BIGINT) * 100 + p_size AS coarse,
         (CAST(substr(p_brand, 7) AS BIGINT) * 100 + p_size) * 1000 + ascii(p_type) * 10 + length(p_type) AS fine
  FROM part)""",
    "ratings": """ratings AS (
  SELECT user_id, item_id, rating, fine AS category, CASE WHEN p_size <= 40 THEN coarse END AS parent
  FROM (SELECT user_id, item_id, max(rating) AS rating FROM purchases GROUP BY ALL)
  JOIN features USING (item_id))""",
    "interactions": """interactions AS (
  SELECT user_id, item_id, fine AS feature
  FROM (SELECT DISTINCT user_id, item_id FROM purchases) JOIN features USING (item_id))""",
    "nested_long": """nested_long AS (
  SELECT user_id, item_id, unnest([fine, coarse, coarse]) AS feature
  FROM (SELECT DISTINCT user_id, item_id FROM purchases) JOIN features USING (item_id))""",
    "positive": """positive AS (
  SELECT user_id, item_id, coalesce(parent, category) AS feature FROM ratings WHERE rating > 3.0)""",
    "trust_rows": """trust_rows AS (
  SELECT user_id, concat_ws('|', p_brand, p_type) AS item_id, rating, line_id, item_id AS part_id
  FROM purchases JOIN part ON p_partkey = item_id)""",
    "trust_reviews": """trust_reviews AS (
  SELECT user_id, item_id, rating FROM trust_rows
  QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY line_id, part_id, rating) = 1)""",
    "trust_edges": """trust_edges AS (
  SELECT user_id AS src, item_id AS dst FROM purchases WHERE item_id IN (SELECT c_custkey FROM customer))""",
    "books": """books AS (
  SELECT p_partkey AS gid, p_name AS title, p_retailprice AS average_rating, CAST(p_size AS BIGINT) AS ratings_count,
         CASE WHEN p_partkey % 9 <> 0 THEN p_partkey % 2 = 0 END AS small_book,
         p_partkey % 5 <> 0 AS shelves_retrieved, p_size <= 45 AS has_shelves
  FROM part)""",
    "book_shelves": """book_shelves AS (
  SELECT p_partkey AS book_gid, p_brand AS shelve, CAST(p_size AS BIGINT) AS count FROM part WHERE p_size <= 45
  UNION ALL SELECT p_partkey, p_type, p_partkey % 10 FROM part WHERE p_size <= 45
  UNION ALL SELECT p_partkey, 'size' || p_size, 1 FROM part WHERE p_size <= 45)""",
    "reviews": """reviews AS (
  SELECT line_id * 10000000 + item_id AS review_gid, user_id AS user_gid, item_id AS book_gid,
         max(rating) AS rating, line_id % 3 = 0 AS own
  FROM purchases GROUP BY ALL)""",
    "users": """users AS (
  SELECT c_custkey AS gid, c_name AS name, c_custkey % 7 = 0 AS private, c_custkey % 10 <> 0 AS reviews_retrieved,
         c_custkey % 4 = 0 AS shelves_reviews_retrieved, c_custkey % 3 = 0 AS friends_retrieved,
         c_custkey % 50 AS reviews_count
  FROM customer)""",
}


def with_views(*names: str) -> str:
    """``WITH`` list of the named views, in the given order."""
    return "WITH RECURSIVE " + ",\n".join(SQL[n] for n in names)
