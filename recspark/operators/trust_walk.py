"""Random walks over the trust graph that stop at a user with a resembling item."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recspark.functions import draws
from recspark.session import materialize


#: Trusted users in one array of options, about; a node that trusts more users has several arrays.
CHUNK = 64


def stop_factor(hop: int) -> float:
    """``1 / (1 + e^(-hop/2))``: the later the hop, the likelier a stop."""
    return 1.0 / (1.0 + math.exp(-hop / 2.0))


def _closest(sims: DataFrame, below: int, upto: int) -> DataFrame:
    """``(target_item, item, sim)``: the items of each target at the places ``below + 1`` to ``upto``, the closest first."""
    closest = Window.partitionBy("target_item").orderBy(F.desc("sim"), "item")
    ranked = sims.withColumn("rn", F.row_number().over(closest)).where(F.col("rn") <= upto)
    return ranked.where(F.col("rn") > below).drop("rn")


def _probes(pairs: DataFrame, rows: DataFrame, by: str) -> DataFrame:
    """Pairs with what is tried for each of them: items of the target, or items of the user."""
    return pairs.join(rows, by)


def best_match(pairs: DataFrame, reviews: DataFrame, item_sim: DataFrame, head: int = 16) -> DataFrame:
    """``(dst, target_item, sim, rating)``: the rated item of ``dst`` closest to the target.

    Ties go to the lower item. Depends on the user and the target alone, so each distinct
    pair is computed once however many walks arrive there. The ``head`` closest items of a
    target settle every pair that rated one of them, since all others are no closer. Pairs
    left over try the next ``2 * head`` items, then twice as many, and so on until their first hit; a user
    who rated no more than the next range holds tries the rated items instead and is done. So a
    pair costs no more than a few times its hit's place, nor than a few times the user's items.
    """
    sims = item_sim.select("target_item", "item", "sim")
    rated = reviews.select(F.col("user_id").alias("dst"), F.col("item_id").alias("item"), "rating")

    def pick(rows: DataFrame) -> DataFrame:
        best = F.min(F.struct((-F.col("sim")).alias("minus"), "item", "rating"))
        return (
            rows.groupBy("dst", "target_item")
            .agg(best.alias("b"))
            .select("dst", "target_item", (-F.col("b.minus")).alias("sim"), F.col("b.rating").alias("rating"))
        )

    pairs = materialize(pairs.select("dst", "target_item").distinct(), "match-pairs")
    found = materialize(pick(_probes(pairs, _closest(sims, 0, head), "target_item").join(rated, ["dst", "item"])), "closest-matches")
    held = rated.groupBy("dst").agg(F.count(F.lit(1)).alias("n_rated"))
    sizes = sims.groupBy("target_item").agg(F.count(F.lit(1)).alias("n_items"))
    longer = sizes.where(F.col("n_items") > head)
    left = pairs.join(found, ["dst", "target_item"], "left_anti").join(longer, "target_item").join(held, "dst")
    left, done, width = materialize(left, "match-left"), head, 2 * head
    while not left.isEmpty():
        few, many = left.where(F.col("n_rated") <= width), left.where(F.col("n_rated") > width)
        own = pick(_probes(few, rated, "dst").join(sims, ["target_item", "item"]))
        if many.isEmpty():
            return found.unionByName(own)
        wanted = sims.join(many.select("target_item").distinct(), "target_item", "left_semi")
        near = pick(_probes(many, _closest(wanted, done, done + width), "target_item").join(rated, ["dst", "item"]))
        new = materialize(own.unionByName(near), "closest-matches")
        done, width = done + width, 2 * width
        rest = many.where(F.col("n_items") > done).join(new, ["dst", "target_item"], "left_anti")
        found, left = found.unionByName(new), materialize(rest, "match-left")
    return found


def stop_probability(
    edges: DataFrame, targets: DataFrame, reviews: DataFrame, item_sim: DataFrame, hop: int = 0
) -> DataFrame:
    """``(src, dst, target_item, prob, rating)`` for each edge and each target of its source."""
    wanted = edges.join(
        targets.select(F.col("user_id").alias("src"), F.col("item_id").alias("target_item")), "src"
    )
    match = best_match(wanted, reviews, item_sim)
    return wanted.join(match, ["dst", "target_item"]).select(
        "src", "dst", "target_item", (F.col("sim") * stop_factor(hop)).alias("prob"), "rating"
    )


def _parted(edges: DataFrame) -> DataFrame:
    """``(node, dst, part)``: the edges of each node in parts of about ``CHUNK``, by a hash of the trusted user."""
    degrees = edges.groupBy("src").agg(F.count(F.lit(1)).alias("degree"))
    part = F.pmod(F.xxhash64("dst"), F.ceil(F.col("degree") / F.lit(CHUNK)))
    return edges.join(degrees, "src").select(F.col("src").alias("node"), "dst", part.alias("part"))


def walk_options(walks: DataFrame, parted: DataFrame, reviews: DataFrame, item_sim: DataFrame) -> DataFrame:
    """``(node, target_item, part, options)``: the users that a walk at ``node`` can go to, with their best match.

    Made once for each distinct ``(node, target_item)``, however many walks and runs are there. A node without a trusted
    user who has a resembling item has no row.
    """
    moves = materialize(walks.select("node", "target_item").distinct().join(parted, "node"), "moves")
    match = best_match(moves, reviews, item_sim)
    return (
        moves.join(match, ["dst", "target_item"])
        .groupBy("node", "target_item", "part")
        .agg(F.collect_list(F.struct("dst", "sim", "rating")).alias("options"))
    )


def _drawn(walks: DataFrame, options: DataFrame, seed: int, hop: int) -> DataFrame:
    """Walks with ``c``, the option of the smallest ticket; those without one are left out.

    A walk meets one row for each part of its node, one in all where the node trusts at most ``CHUNK`` users.
    """
    open_ = F.filter("options", lambda o: F.col("avoid").isNull() | (o["dst"] != F.col("avoid")))

    def ticketed(o: Column) -> Column:
        t = draws.ticket(seed, "origin", "target_item", "run", "trail", F.lit(hop), o["dst"])
        return F.struct(t.alias("t"), o["dst"].alias("dst"), o["sim"].alias("sim"), o["rating"].alias("rating"))

    key = ["origin", "idx", "target_item", "run", "node", "trail"]
    met = walks.join(options, ["node", "target_item"]).select(*key, F.array_min(F.transform(open_, ticketed)).alias("c"))
    return met.where(F.col("c").isNotNull()).groupBy(*key).agg(F.min("c").alias("c"))


def trust_walk(
    edges: DataFrame,
    targets: DataFrame,
    reviews: DataFrame,
    item_sim: DataFrame,
    k_steps: int = 1,
    runs: int = 1,
    seed: int = 11,
    credit: str = "origin",
) -> DataFrame:
    """Walk log ``(origin, idx, target_item, run, hop, node, rating)``, one row per step.

    All walks of all origins, targets and runs move together, one join per hop, with the options of
    their nodes as arrays: a hop has as many rows as walks, not as walks and edges. A step goes
    to a uniformly drawn trusted user who has an item resembling the target; it stops there
    with the stop probability, or at the last hop if that is not the first, and then carries
    that user's rating. ``rating`` is null while a walk goes on. Walks without a next user end
    unresolved.

    ``credit='origin'`` keeps origin and target along the walk. ``credit='last_hop'`` moves
    both to the current user at each later hop, as the original job does.
    """
    if credit not in ("origin", "last_hop"):
        raise ValueError(f"unknown credit {credit!r}")
    walk_key = ["origin", "idx", "target_item", "run"]
    walks = targets.select(
        F.col("user_id").alias("origin"),
        "idx",
        F.col("item_id").alias("target_item"),
        F.explode(F.sequence(F.lit(1), F.lit(runs)).cast("array<bigint>")).alias("run"),
        F.col("user_id").alias("node"),
        F.lit(None).cast(targets.schema["user_id"].dataType).alias("avoid"),
        F.lit("").alias("trail"),
    )
    parted = materialize(_parted(edges), "parted-edges")
    log: DataFrame | None = None
    for hop in range(k_steps + 1):
        if hop > 0 and credit == "last_hop":
            own = targets.select(F.col("user_id").alias("node"), "idx", F.col("item_id").alias("own_item"))
            walks = walks.join(own, ["node", "idx"]).select(
                F.col("node").alias("origin"),
                "idx",
                F.col("own_item").alias("target_item"),
                "run",
                "node",
                "avoid",
                "trail",
            )
        # written first, so that the join can split the walks of a hot node
        options = materialize(walk_options(walks, parted, reviews, item_sim), "walk-options")
        drawn = _drawn(walks, options, seed, hop)
        chance = F.col("c.sim") * stop_factor(hop)
        stops = draws.uniform(seed, F.lit("stop"), "origin", "target_item", "run", "trail", F.lit(hop)) < chance
        if hop > 0 and hop == k_steps:
            stops = F.lit(True)
        step = drawn.select(
            *walk_key,
            F.lit(hop).cast("bigint").alias("hop"),
            F.col("c.dst").alias("node"),
            F.when(stops, F.col("c.rating")).alias("rating"),
            F.col("node").alias("came_from"),
            "trail",
        )
        step = materialize(step, "walk-step") if hop < k_steps else step
        done = step.select(*walk_key, "hop", "node", "rating")
        log = done if log is None else log.unionByName(done)
        walks = step.where("rating is null").select(
            *walk_key,
            "node",
            (F.col("origin") if credit == "origin" else F.col("came_from")).alias("avoid"),
            (F.concat_ws("/", "trail", F.col("came_from").cast("string")) if credit == "last_hop" else F.col("trail")).alias("trail"),
        )
    return log


def predict_ratings(targets: DataFrame, log: DataFrame, runs: int = 1) -> DataFrame:
    """``(user_id, item_id, prediction, resolved, runs)``: mean rating of the resolved walks.

    A target without a resolved walk keeps a null prediction.
    """
    found = (
        log.where("rating is not null")
        .groupBy(F.col("origin").alias("user_id"), F.col("target_item").alias("item_id"))
        .agg(F.avg("rating").alias("prediction"), F.count(F.lit(1)).alias("resolved"))
    )
    return (
        targets.select("user_id", "item_id")
        .join(found, ["user_id", "item_id"], "left")
        .fillna(0, ["resolved"])
        .withColumn("runs", F.lit(runs).cast("bigint"))
    )
