"""Trust-walk rating prediction from edges and reviews."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators.evaluate import assert_paired, rating_error
from recspark.operators.trust_graph import build_trust_graph, item_cooccurrence
from recspark.operators.trust_walk import predict_ratings, trust_walk
from recspark.session import materialize


@dataclass(frozen=True)
class TrustParams:
    max_out: int = 10
    n_targets: int = 2
    k_steps: int = 1
    runs: int = 1
    seed: int = 11
    credit: str = "origin"
    item_similarity: str = "support"


@dataclass(frozen=True)
class TrustGraph:
    edges: DataFrame
    reviews: DataFrame
    targets: DataFrame
    item_sim: DataFrame


@dataclass(frozen=True)
class TrustResult:
    graph: TrustGraph
    log: DataFrame
    predictions: DataFrame

    @property
    def errors(self) -> DataFrame:
        """Raises where predictions and held-out ratings don't pair up one to one."""
        assert_paired(self.predictions, self.graph.targets, ["user_id", "item_id"])
        return rating_error(self.predictions, self.graph.targets)


def prepare_graph(edges: DataFrame, reviews: DataFrame, params: TrustParams = TrustParams()) -> TrustGraph:
    """Graph tables and item similarity, each written once for the hops that follow."""
    links, kept, targets = build_trust_graph(edges, reviews, params.max_out, params.n_targets)
    links = materialize(links, "graph-edges")
    targets = materialize(targets, "graph-targets")
    n_users = kept.agg(F.count_distinct("user_id").alias("n"))
    sims = item_cooccurrence(targets, kept, n_users, params.item_similarity)
    return TrustGraph(links, kept, targets, materialize(sims, "item-sim"))


def run_trust_walk(edges: DataFrame, reviews: DataFrame, params: TrustParams = TrustParams()) -> TrustResult:
    g = prepare_graph(edges, reviews, params)
    log = trust_walk(
        g.edges, g.targets, g.reviews, g.item_sim, params.k_steps, params.runs, params.seed, params.credit
    )
    return TrustResult(g, log, materialize(predict_ratings(g.targets, log, params.runs), "predictions"))
