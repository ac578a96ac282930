"""Feature-weighted user model: interactions in, top-N items and their quality out."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators.evaluate import evaluate_topn
from recspark.operators.profile import user_profiles
from recspark.operators.recommend import (
    distinct_neighborhoods,
    item_scores,
    neighbor_items,
    neighborhood_frequency,
    share_items,
    top_items,
)
from recspark.operators.similarity import nearest_users
from recspark.operators.split import split_holdout
from recspark.session import materialize


@dataclass(frozen=True)
class FwumParams:
    """Settings of a run. Defaults are those of the nested-interactions job."""

    n_similar: int = 20
    n_items: int = 40
    train_pct: float = 0.75
    seed: int = 7


#: Settings of the ratings job. It swaps its two parts after a 70 % split, so it trains on 30 %.
RATINGS_PARAMS = FwumParams(n_similar=30, n_items=100, train_pct=0.3)


@dataclass(frozen=True)
class FwumResult:
    split: DataFrame
    profiles: DataFrame
    neighbors: DataFrame
    recommendations: DataFrame

    @property
    def test(self) -> DataFrame:
        return self.split.where("not is_train").select("user_id", "item_id").distinct()

    @property
    def metrics(self) -> DataFrame:
        return evaluate_topn(self.recommendations, self.test)


def positive_only(ratings: DataFrame, above: float = 3.0) -> DataFrame:
    """Ratings strictly above the limit."""
    return ratings.where(F.col("rating") > above)


def ratings_to_interactions(ratings: DataFrame) -> DataFrame:
    """``(user_id, item_id, feature)`` from ratings: the parent category if there is one."""
    return positive_only(ratings).select(
        "user_id", "item_id", F.coalesce("parent", "category").alias("feature")
    )


def explode_interactions(nested: DataFrame) -> DataFrame:
    """Long form of ``(user_id, items ARRAY<STRUCT<item_id, features ARRAY>>)``."""
    return nested.select("user_id", F.explode("items").alias("it")).select(
        "user_id", F.col("it.item_id").alias("item_id"), F.explode("it.features").alias("feature")
    )


def run_fwum(interactions: DataFrame, params: FwumParams = FwumParams()) -> FwumResult:
    """The whole job on a long interactions table ``(user_id, item_id, feature)``."""
    split = materialize(split_holdout(interactions, params.train_pct, params.seed), "split")
    profiles = materialize(user_profiles(split), "profiles")
    neighbors = materialize(nearest_users(profiles, params.n_similar), "neighbors")
    hoods, members = distinct_neighborhoods(neighbors)
    hoods = materialize(hoods, "neighborhoods")
    scores = item_scores(neighbor_items(hoods, split), neighborhood_frequency(hoods, profiles))
    # the items of neighborhoods are written, so both the caller and the metrics read them
    recs = share_items(top_items(scores, params.n_items), members)
    return FwumResult(split, profiles, neighbors, recs)


def fwum_recommend(interactions: DataFrame, params: FwumParams = FwumParams()) -> DataFrame:
    """``(user_id, rank, item_id, score)``."""
    return run_fwum(interactions, params).recommendations
