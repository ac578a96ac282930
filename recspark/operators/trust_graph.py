"""Trust graph: edges, reviews, targets and item similarity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions.text import safe_ratio
from recspark.operators.split import holdout_first_n
from recspark.session import materialize


def dedupe_reviews(rows: DataFrame, order: str) -> DataFrame:
    """One rating per (user, item): that of the lowest ``order`` value."""
    return rows.groupBy("user_id", "item_id").agg(F.min_by("rating", order).alias("rating"))


def cap_out_degree(edges: DataFrame, limit: int = 10) -> DataFrame:
    """Distinct ``(src, dst)`` edges, at most ``limit`` per source (lowest targets)."""
    w = Window.partitionBy("src").orderBy("dst")
    return (
        edges.select("src", "dst")
        .distinct()
        .withColumn("rn", F.row_number().over(w))
        .where(F.col("rn") <= limit)
        .select("src", "dst")
    )


def endpoints(edges: DataFrame) -> DataFrame:
    """Distinct users on either end of an edge."""
    return edges.select(F.col("src").alias("user_id")).union(edges.select("dst")).distinct()


def build_trust_graph(
    edges: DataFrame, reviews: DataFrame, max_out: int = 10, n_targets: int = 2
) -> tuple[DataFrame, DataFrame, DataFrame]:
    """``(edges, reviews, targets)`` of the graph.

    Edges are capped per source and kept only between users with reviews; reviews are kept
    for users of a capped edge; targets are the first reviews of each user. The two tables
    that the others derive from are written once.
    """
    capped = materialize(cap_out_degree(edges, max_out), "capped-edges")
    kept = materialize(reviews.join(endpoints(capped), "user_id", "left_semi"), "graph-reviews")
    rated = kept.select("user_id").distinct()
    walkable = (
        capped.where("src <> dst")
        .join(rated.withColumnRenamed("user_id", "src"), "src", "left_semi")
        .join(rated.withColumnRenamed("user_id", "dst"), "dst", "left_semi")
        .select("src", "dst")
    )
    return walkable, kept, holdout_first_n(kept, n_targets)


def item_cooccurrence(
    test: DataFrame, train: DataFrame, n_users: DataFrame, method: str = "support"
) -> DataFrame:
    """``(target_item, item, users, sim)`` for items met as (test, train) of one user.

    ``support`` divides by the number of all users and is asymmetric. ``jaccard`` divides by
    the users holding either item. A user has a fixed number of test items, so pairs grow
    with the train rows, not with their square.
    """
    pairs = (
        test.select("user_id", F.col("item_id").alias("target_item"))
        .join(train.select("user_id", F.col("item_id").alias("item")), "user_id")
        .groupBy("target_item", "item")
        .agg(F.count(F.lit(1)).alias("users"))
    )
    if method == "support":
        return pairs.withColumn("sim", F.col("users") / n_users.scalar())
    if method == "jaccard":
        # written first, so that the rows of a popular item can be split over tasks in the joins
        pairs = materialize(pairs, "item-pairs")
        a = test.groupBy(F.col("item_id").alias("target_item")).agg(F.count(F.lit(1)).alias("n_test"))
        b = train.groupBy(F.col("item_id").alias("item")).agg(F.count(F.lit(1)).alias("n_train"))
        union = F.col("n_test") + F.col("n_train") - F.col("users")
        return (
            pairs.join(a, "target_item")
            .join(b, "item")
            .select("target_item", "item", "users", safe_ratio("users", union).alias("sim"))
        )
    raise ValueError(f"unknown method {method!r}")


def _bit(bits: Column, position: Column) -> Column:
    """A bit of a packed block."""
    byte = F.conv(F.hex(F.substring(bits, F.floor(position / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    return F.floor(byte / F.pow(F.lit(2), position % 8)).cast("int") % 2


def _blocks(users: DataFrame) -> DataFrame:
    """``(block, bits)``: users as bits, 32,768 ids to a block of four kilobytes."""
    block, at = F.bitmap_bucket_number("user_id").alias("block"), F.bitmap_bit_position("user_id")
    return users.groupBy(block).agg(F.bitmap_construct_agg(at).alias("bits"))


def khop_expand(
    edges: DataFrame, seeds: DataFrame, max_level: int = 5, leaves: DataFrame | None = None
) -> DataFrame:
    """``(user_id, level)``: users within ``max_level`` steps of the seeds, at their least depth.

    Each level joins the frontier with the edges, which are made distinct and written once, and drops users already met,
    so cycles end. Users met are kept as packed bits, a row for each block of ids, so a level has one join with a short
    table however many were met before. Users listed in ``leaves`` are reached but not expanded. Levels are
    written out, so a lost executor costs one level at most. Ids are whole numbers, best without large gaps; null
    ids are left out.
    """
    links = edges.select("src", "dst").where("src is not null and dst is not null").distinct()
    if leaves is not None:
        links = links.join(leaves.select(F.col("user_id").alias("src")), "src", "left_anti")
    links = materialize(links, "links")
    start = seeds.select("user_id").where("user_id is not null").distinct()
    frontier = materialize(start.withColumn("level", F.lit(0).cast("bigint")), "frontier")
    met, found = materialize(_blocks(frontier), "met"), frontier
    for level in range(1, max_level + 1):
        reached = frontier.select(F.col("user_id").alias("src")).join(links, "src").select(F.col("dst").alias("user_id")).distinct()
        placed = reached.withColumn("block", F.bitmap_bucket_number("user_id")).join(met, "block", "left")
        fresh = placed.where(F.col("bits").isNull() | (_bit(F.col("bits"), F.bitmap_bit_position("user_id")) == 0))
        frontier = materialize(fresh.select("user_id", F.lit(level).cast("bigint").alias("level")), "frontier")
        if frontier.isEmpty():
            break
        found = found.unionByName(frontier)
        if level < max_level:
            both = met.unionByName(_blocks(frontier))
            met = materialize(both.groupBy("block").agg(F.bitmap_or_agg("bits").alias("bits")), "met")
    return found
