"""Readers of the input files and status-flag scans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recspark import schemas


def read_interactions(spark: SparkSession, path: str) -> DataFrame:
    """Nested interactions ``(user_id, items)``."""
    return spark.read.schema(schemas.INTERACTIONS_NESTED).parquet(path)


def read_ratings_csv(spark: SparkSession, path: str) -> DataFrame:
    """``(user_id, rating, item_id, category, parent)`` from comma-separated text.

    A header line may occur at the top of any part file: it is the line whose first cell is
    the column name.
    """
    raw = spark.read.csv(path, schema=schemas.RATINGS, nullValue="NULL")
    return raw.where("iduser <> 'iduser'").select(
        F.col("iduser").try_cast("bigint").alias("user_id"),
        "rating",
        F.col("idproduct").alias("item_id"),
        F.col("idcategory").alias("category"),
        "parent",
    )


def read_trust_csv(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """``edges(src, dst)`` and ``reviews(user_id, item_id, rating, source)`` from the trust file.

    Product and rating belong to the trusted user, so a review repeats once for each user who
    trusts its author; ``source`` is the truster, by which repeats are resolved.
    """
    rows = spark.read.csv(path, schema=schemas.TRUST_REVIEWS)
    edges = rows.select(F.col("iduser").alias("src"), F.col("idtrusted").alias("dst"))
    reviews = rows.select(
        F.col("idtrusted").alias("user_id"),
        F.col("idproduct").alias("item_id"),
        "rating",
        F.col("iduser").alias("source"),
    )
    return edges, reviews


def pending(table: DataFrame, flag: str, *columns: str, also: str | None = None) -> DataFrame:
    """Rows whose status flag is false: projection and predicate reach the scan."""
    rows = table.where(F.col(flag) == F.lit(False))
    if also:
        rows = rows.where(also)
    return rows.select(*columns) if columns else rows


def pending_public(users: DataFrame, flag: str, *columns: str) -> DataFrame:
    """Pending rows of users who are not private."""
    return pending(users, flag, *columns, also="not private")


def next_batch(rows: DataFrame, key: str, size: int = 500) -> DataFrame:
    """The first ``size`` pending rows by key."""
    return rows.orderBy(key).limit(size)


def parse_top_shelves(lines: DataFrame, column: str = "value") -> DataFrame:
    """``(user_gid, most_common_shelves)`` from lines ``(uid ...|(shelf,votes,count)|...``.

    Row-local: the text is split and its parts turned into structs without a shuffle.
    """
    bare = F.regexp_replace(F.col(column), r"[()]", "")
    parts = F.split(bare, r"\|")
    shelf = lambda text: F.struct(
        F.split(text, ",")[0].alias("shelve"),
        F.split(text, ",")[1].try_cast("bigint").alias("votes"),
        F.split(text, ",")[2].try_cast("bigint").alias("count"),
    )
    return lines.select(
        F.split(parts[0], " ")[0].try_cast("bigint").alias("user_gid"),
        F.transform(F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))), shelf).alias(
            "most_common_shelves"
        ),
    )


def read_top_shelves(spark: SparkSession, path: str) -> DataFrame:
    return parse_top_shelves(spark.read.text(path))
