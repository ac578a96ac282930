"""Registered queries of the recommendation and trust jobs, each with its SQL twin."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recspark.operators import evaluate, profile, recommend, similarity, split, trust_graph, trust_walk
from recspark.plans import fwum, trust
from recspark.plans.bindings import Tables, with_views
from recspark.plans.registry import query
from recspark.session import materialize, new_path
from recspark.sources import sinks, tables

SMALL = fwum.FwumParams()
RATINGS = fwum.RATINGS_PARAMS


def _threshold(p: float) -> str:
    return f"{int(p * 2**32):08x}"


def fwum_sql(source: str, views: tuple[str, ...], params: fwum.FwumParams) -> str:
    """CTEs of the whole job, by brute force over all pairs of users."""
    return with_views(*views) + f""",
split AS MATERIALIZED (
  SELECT *, substr(md5(concat_ws(':', '{params.seed}', user_id, item_id)), 1, 8) < '{_threshold(params.train_pct)}' AS is_train
  FROM {source}),
ff AS MATERIALIZED (SELECT user_id, feature, count(*) AS ff FROM split WHERE is_train GROUP BY ALL),
fw AS MATERIALIZED (SELECT feature, count(*) AS df, log10((SELECT count(DISTINCT user_id) FROM split)::DOUBLE / count(*)) AS fw
       FROM ff GROUP BY feature),
prof AS MATERIALIZED (SELECT user_id, feature, ff, fw, fw * ff AS weight FROM ff JOIN fw USING (feature)),
sims AS MATERIALIZED (
  SELECT a.user_id, b.user_id AS neighbor_id, round(2 * sum(a.weight) / sum(a.weight * a.weight), 6) AS sim
  FROM prof a JOIN prof b ON a.feature = b.feature AND a.ff = b.ff AND a.user_id <> b.user_id AND a.weight > 0
  GROUP BY ALL),
holders AS (SELECT DISTINCT user_id FROM ff),
nn AS MATERIALIZED (
  SELECT u.user_id, v.user_id AS neighbor_id, coalesce(sim, 0.0) AS sim,
         row_number() OVER (PARTITION BY u.user_id ORDER BY coalesce(sim, 0.0) DESC, v.user_id) AS rank
  FROM holders u JOIN holders v ON u.user_id <> v.user_id
  LEFT JOIN sims s ON s.user_id = u.user_id AND s.neighbor_id = v.user_id
  QUALIFY rank <= {params.n_similar}),
nbf AS MATERIALIZED (SELECT nn.user_id, feature, CAST(sum(ff) AS BIGINT) AS nbf FROM nn JOIN ff ON ff.user_id = neighbor_id GROUP BY ALL),
scores AS MATERIALIZED (
  SELECT nn.user_id, s.item_id, CAST(sum(nbf) AS BIGINT) AS score
  FROM nn JOIN split s ON s.user_id = neighbor_id JOIN nbf ON nbf.user_id = nn.user_id AND nbf.feature = s.feature
  GROUP BY ALL),
recs AS MATERIALIZED (
  SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
  FROM scores QUALIFY rank <= {params.n_items}),
test AS (SELECT DISTINCT user_id, item_id FROM split WHERE NOT is_train),
hits AS (
  SELECT r.user_id, count(*) AS n_rec, count(t.item_id) AS tp
  FROM recs r LEFT JOIN test t ON t.user_id = r.user_id AND t.item_id = r.item_id GROUP BY r.user_id),
held AS (SELECT user_id, count(*) AS n_test FROM test GROUP BY user_id),
counts AS (
  SELECT h.user_id, tp, n_rec - tp AS fp, coalesce(n_test, 0) - tp AS fn FROM hits h LEFT JOIN held USING (user_id)),
rates AS (
  SELECT *, tp / (tp + fp) AS precision, CASE WHEN tp + fn = 0 THEN 0.0 ELSE tp / (tp + fn) END AS recall FROM counts),
metrics AS MATERIALIZED (
  SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM rates)
"""


BASE = fwum_sql("interactions", ("purchases", "interactions"), SMALL)
NESTED = fwum_sql("nested_long", ("purchases", "nested_long"), SMALL)
CSV = fwum_sql("positive", ("purchases", "ratings", "positive"), RATINGS)
METRICS = (
    "SELECT user_id, tp, fp, fn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1 "
    "FROM metrics"
)


def _split(t: Tables) -> DataFrame:
    return split.split_holdout(t.interactions(), SMALL.train_pct, SMALL.seed)


def _profiles(t: Tables) -> DataFrame:
    return profile.user_profiles(_split(t))


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    for name in names:
        df = df.withColumn(name, F.round(name, 6))
    return df


def _plain(df: DataFrame, flag: str, name: str) -> DataFrame:
    """A nullable number as a flag and a number, for comparison with other engines."""
    return df.withColumn(flag, F.col(name).isNotNull()).fillna(0.0, [name])


# --- scans ----------------------------------------------------------------------------------


@query(with_views("purchases", "nested_long") + "SELECT user_id, item_id, feature FROM nested_long")
def nested_interactions_exploded(t: Tables) -> DataFrame:
    path = new_path(t.spark, "nested")
    t.nested_interactions().write.parquet(path)
    return fwum.explode_interactions(tables.read_interactions(t.spark, path))


@query(
    with_views("purchases", "ratings") + "SELECT user_id, rating, item_id, category, coalesce(parent, -1) AS parent FROM ratings"
)
def ratings_csv_scan(t: Tables) -> DataFrame:
    """Ratings through their text form: header line, ``NULL`` for a missing parent."""
    path = new_path(t.spark, "ratings-csv")
    t.ratings().select(
        F.col("user_id").alias("iduser"), "rating", F.col("item_id").alias("idproduct"),
        F.col("category").alias("idcategory"), "parent",
    ).write.csv(path, header=True, nullValue="NULL")
    return tables.read_ratings_csv(t.spark, path).fillna(-1, ["parent"])


@query(
    with_views("purchases", "trust_edges")
    + """SELECT src, dst, CAST(count(*) AS BIGINT) AS n, CAST(sum(rating) AS DOUBLE) AS ratings FROM (
  SELECT user_id AS src, item_id AS dst, rating FROM purchases WHERE item_id IN (SELECT c_custkey FROM customer))
GROUP BY ALL"""
)
def trust_csv_scan(t: Tables) -> DataFrame:
    """Trust rows through their text form without a header."""
    people = t("customer").select(F.col("c_custkey").alias("item_id"))
    path = new_path(t.spark, "trust-csv")
    t.purchases().join(people, "item_id", "left_semi").select(
        F.col("user_id").alias("iduser"), F.col("item_id").alias("idtrusted"), F.col("item_id").alias("idproduct"), "rating"
    ).write.csv(path)
    edges, reviews = tables.read_trust_csv(t.spark, path)
    # The reviews carry both ends of their edge: truster in `source`, author in `user_id`.
    return reviews.groupBy(F.col("source").alias("src"), F.col("user_id").alias("dst")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("rating").alias("ratings")
    )


# --- feature profiles -----------------------------------------------------------------------


@query(with_views("purchases", "ratings", "positive") + "SELECT user_id, item_id, feature FROM positive")
def positive_features(t: Tables) -> DataFrame:
    return fwum.ratings_to_interactions(t.ratings())


@query(BASE + "SELECT user_id, item_id, is_train FROM split")
def holdout_split(t: Tables) -> DataFrame:
    return _split(t).select("user_id", "item_id", "is_train")


@query(with_views("purchases", "interactions") + "SELECT count(DISTINCT user_id) AS n_users FROM interactions")
def user_count(t: Tables) -> DataFrame:
    return profile.user_count(t.interactions())


@query(BASE + "SELECT user_id, feature, ff FROM ff")
def feature_frequency(t: Tables) -> DataFrame:
    return profile.feature_frequency(_split(t).where("is_train"))


@query(BASE + "SELECT feature, df, round(fw, 6) AS fw FROM fw")
def feature_weights(t: Tables) -> DataFrame:
    s = _split(t)
    ff = profile.feature_frequency(s.where("is_train"))
    return _rounded(profile.feature_weights(ff, profile.user_count(s)), "fw")


@query(BASE + "SELECT user_id, feature, ff, round(fw, 6) AS fw, round(weight, 6) AS weight FROM prof")
def weighted_profiles(t: Tables) -> DataFrame:
    return _rounded(_profiles(t), "fw", "weight")


@query(
    with_views("purchases", "interactions")
    + "SELECT row_number() OVER (ORDER BY feature) AS feature_id, feature FROM (SELECT DISTINCT feature FROM interactions)"
)
def feature_vocabulary(t: Tables) -> DataFrame:
    return profile.feature_vocabulary(t.interactions()).select(F.col("feature_id").cast("bigint").alias("feature_id"), "feature")


# --- similarity and neighbors ---------------------------------------------------------------

_EDGES = "edges AS (SELECT DISTINCT src AS user_id, dst AS neighbor_id FROM trust_edges WHERE src <> dst)"


def _edge_pairs(t: Tables) -> DataFrame:
    return (
        t.trust_edges().where("src <> dst").distinct().select(F.col("src").alias("user_id"), F.col("dst").alias("neighbor_id"))
    )


_BASE_EDGES = fwum_sql("interactions", ("purchases", "interactions", "trust_edges"), SMALL)


@query(
    _BASE_EDGES + f""", {_EDGES}
SELECT e.user_id, e.neighbor_id, coalesce(sim, 0.0) AS sim FROM edges e
LEFT JOIN sims s ON s.user_id = e.user_id AND s.neighbor_id = e.neighbor_id"""
)
def user_similarity_of_pairs(t: Tables) -> DataFrame:
    """The similarity of every pair of users on a trust edge."""
    return similarity.pair_similarity(materialize(_profiles(t), "profiles"), _edge_pairs(t))


@query(
    _BASE_EDGES + f""", {_EDGES},
cosine AS (
  SELECT e.user_id, e.neighbor_id, round(sum(a.weight * b.weight)
         / (sqrt(sum(a.weight * a.weight)) * sqrt(sum(b.weight * b.weight))), 6) AS sim
  FROM edges e JOIN prof a ON a.user_id = e.user_id AND a.weight > 0
  JOIN prof b ON b.user_id = e.neighbor_id AND b.feature = a.feature GROUP BY ALL)
SELECT e.user_id, e.neighbor_id, coalesce(sim, 0.0) AS sim FROM edges e LEFT JOIN cosine USING (user_id, neighbor_id)"""
)
def shared_cosine_of_pairs(t: Tables) -> DataFrame:
    return similarity.pair_similarity(materialize(_profiles(t), "profiles"), _edge_pairs(t), "shared_cosine")


@query(BASE + "SELECT user_id, rank, neighbor_id, sim FROM nn")
def nearest_users(t: Tables) -> DataFrame:
    return similarity.nearest_users(materialize(_profiles(t), "profiles"), SMALL.n_similar)


@query(NESTED + "SELECT user_id, rank, neighbor_id, sim FROM nn")
def nearest_users_popular_features(t: Tables) -> DataFrame:
    """Neighbors on nested interactions with correlated, widely held features."""
    s = split.split_holdout(fwum.explode_interactions(t.nested_interactions()), SMALL.train_pct, SMALL.seed)
    return similarity.nearest_users(materialize(profile.user_profiles(s), "profiles"), SMALL.n_similar, rare_limit=80)


@query(BASE + "SELECT user_id, feature, nbf FROM nbf")
def neighborhood_frequency(t: Tables) -> DataFrame:
    p = materialize(_profiles(t), "profiles")
    return recommend.neighborhood_frequency(similarity.nearest_users(p, SMALL.n_similar), p)


@query(BASE + "SELECT user_id, item_id, score FROM scores")
def item_scores(t: Tables) -> DataFrame:
    r = fwum.run_fwum(t.interactions(), SMALL)
    items = recommend.neighbor_items(r.neighbors, r.split)
    return recommend.item_scores(items, recommend.neighborhood_frequency(r.neighbors, r.profiles))


# --- whole jobs -----------------------------------------------------------------------------


@query(BASE + "SELECT user_id, rank, item_id, score FROM recs")
def fwum_recommend(t: Tables) -> DataFrame:
    return fwum.fwum_recommend(t.interactions(), SMALL)


@query(NESTED + "SELECT user_id, rank, item_id, score FROM recs")
def fwum_recommend_nested(t: Tables) -> DataFrame:
    return fwum.fwum_recommend(fwum.explode_interactions(t.nested_interactions()), SMALL)


@query(CSV + "SELECT user_id, rank, item_id, score FROM recs")
def fwum_recommend_ratings(t: Tables) -> DataFrame:
    return fwum.fwum_recommend(fwum.ratings_to_interactions(t.ratings()), RATINGS)


@query(BASE + METRICS)
def fwum_metrics(t: Tables) -> DataFrame:
    return _rounded(fwum.run_fwum(t.interactions(), SMALL).metrics, "precision", "recall", "f1")


@query(CSV + METRICS)
def fwum_metrics_ratings(t: Tables) -> DataFrame:
    r = fwum.run_fwum(fwum.ratings_to_interactions(t.ratings()), RATINGS)
    return _rounded(r.metrics, "precision", "recall", "f1")


@query(
    BASE + """SELECT user_id, item_id, score, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, item_id) AS rank
FROM scores ANTI JOIN (SELECT user_id, item_id FROM split WHERE is_train) USING (user_id, item_id) QUALIFY rank <= 40"""
)
def fwum_recommend_unseen(t: Tables) -> DataFrame:
    """Top items without those of the user's own train part."""
    r = fwum.run_fwum(t.interactions(), SMALL)
    scores = recommend.item_scores(
        recommend.neighbor_items(r.neighbors, r.split), recommend.neighborhood_frequency(r.neighbors, r.profiles)
    )
    return recommend.top_items(scores, SMALL.n_items, exclude=r.split.where("is_train"))


@query(
    BASE + "SELECT r.user_id, r.item_id, r.rank, round(m.f1, 6) AS f1, 20 AS n_similar "
    "FROM recs r JOIN metrics m USING (user_id)"
)
def results_written_and_read(t: Tables) -> DataFrame:
    """Recommendations and metrics as a published run, read back through the table of runs."""
    r = fwum.run_fwum(t.interactions(), SMALL)
    run = sinks.run_id(SMALL.n_similar, SMALL.n_items, r.recommendations.select("user_id").distinct().count())
    root = new_path(t.spark, "runs")
    results = {"recommendations": r.recommendations.select("user_id", "item_id", "rank"), "metrics": r.metrics}
    sinks.publish_run(t.spark, root, run, results, n_similar=SMALL.n_similar, n_items=SMALL.n_items)
    recs, metrics = (sinks.read_run(t.spark, root, run, name) for name in results)
    params = sinks.published_runs(t.spark, root).select("run_id", F.col("params")["n_similar"].cast("int").alias("n_similar"))
    return recs.join(metrics.select("user_id", F.round("f1", 6).alias("f1")), "user_id").join(params, "run_id").drop("run_id")


@query(
    BASE + """SELECT user_id AS user_gid, string_agg(item_id, ',' ORDER BY rank) AS items,
       round(any_value(precision), 6) AS precision, round(any_value(recall), 6) AS recall
FROM recs JOIN metrics USING (user_id) GROUP BY user_id"""
)
def recommendation_table(t: Tables) -> DataFrame:
    r = fwum.run_fwum(t.interactions(), SMALL)
    table = sinks.recommendation_table(r.recommendations, r.metrics)
    return _rounded(
        table.select("user_gid", F.array_join(F.col("item_recommended").cast("array<string>"), ",").alias("items"), "precision", "recall"),
        "precision", "recall",
    )


# --- trust graph and walks ------------------------------------------------------------------

WALK = trust.TrustParams(runs=3)

GRAPH = with_views("purchases", "trust_rows", "trust_reviews", "trust_edges") + """,
capped AS (
  SELECT src, dst FROM (SELECT DISTINCT src, dst FROM trust_edges)
  QUALIFY row_number() OVER (PARTITION BY src ORDER BY dst) <= 10),
ends AS (SELECT src AS user_id FROM capped UNION SELECT dst FROM capped),
kept AS (SELECT * FROM trust_reviews WHERE user_id IN (SELECT user_id FROM ends)),
links AS (
  SELECT src, dst FROM capped WHERE src <> dst AND src IN (SELECT user_id FROM kept) AND dst IN (SELECT user_id FROM kept)),
targets AS (
  SELECT user_id, row_number() OVER (PARTITION BY user_id ORDER BY item_id) AS idx, item_id, rating
  FROM kept QUALIFY idx <= 2),
support AS (
  SELECT a.item_id AS target_item, b.item_id AS item, count(*) AS users,
         count(*) / (SELECT count(DISTINCT user_id) FROM kept) AS sim
  FROM targets a JOIN kept b USING (user_id) GROUP BY ALL),
best AS (
  SELECT dst, target_item, sim, rating FROM (
    SELECT DISTINCT t.user_id AS dst, s.target_item, s.item, s.sim, t.rating FROM kept t JOIN support s ON s.item = t.item_id)
  QUALIFY row_number() OVER (PARTITION BY dst, target_item ORDER BY sim DESC, item) = 1)
"""

_U = "('0x' || substr(md5({key}), 1, 8))::BIGINT / 4294967296.0"


def _hop_sql(hop: int, walks: str, last: bool, avoid: str, trail: str = "trail") -> str:
    """One hop of the walks: uniform choice among neighbors with a match, then the stop draw."""
    ticket = f"md5(concat_ws(':', '11', origin, w.target_item, run, {trail}, '{hop}', l.dst))"
    key = f"concat_ws(':', '11', 'stop', origin, target_item, run, {trail}, '{hop}')"
    stop = "TRUE" if last and hop > 0 else f"{_U.format(key=key)} < sim / (1 + exp(-{hop}::DOUBLE / 2))"
    return f"""chosen{hop} AS (
  SELECT origin, idx, w.target_item, run, w.node AS came_from, trail, l.dst AS node, b.sim, b.rating
  FROM {walks} w JOIN links l ON l.src = w.node AND ({avoid})
  JOIN best b ON b.dst = l.dst AND b.target_item = w.target_item
  QUALIFY row_number() OVER (PARTITION BY origin, idx, w.target_item, run, w.node, trail ORDER BY {ticket}) = 1),
step{hop} AS (
  SELECT origin, idx, target_item, run, {hop} AS hop, node, came_from, trail, CASE WHEN {stop} THEN rating END AS rating
  FROM chosen{hop})"""


START = """start AS (
  SELECT user_id AS origin, idx, item_id AS target_item, run, user_id AS node, '' AS trail
  FROM targets, (SELECT unnest([1, 2, 3]) AS run))"""
WALKS = GRAPH + f""", {START}, {_hop_sql(0, "start", False, "TRUE")},
{_hop_sql(1, "(SELECT * FROM step0 WHERE rating IS NULL)", True, "l.dst <> w.origin")},
log AS (SELECT * FROM step0 UNION ALL SELECT * FROM step1)"""
WALKS_LAST_HOP = GRAPH + f""", {START}, {_hop_sql(0, "start", False, "TRUE")},
moved AS (
  SELECT s.node AS origin, s.idx, t.item_id AS target_item, run, s.node, s.came_from AS avoid, '/' || s.came_from AS trail
  FROM step0 s JOIN targets t ON t.user_id = s.node AND t.idx = s.idx WHERE s.rating IS NULL),
{_hop_sql(1, "moved", True, "l.dst <> w.avoid")},
log AS (SELECT * FROM step0 UNION ALL SELECT * FROM step1)"""
_PREDICTED = """, found AS (
  SELECT origin AS user_id, target_item AS item_id, avg(rating) AS prediction, count(*) AS resolved
  FROM log WHERE rating IS NOT NULL GROUP BY ALL),
pred AS (
  SELECT user_id, item_id, prediction, coalesce(resolved, 0) AS resolved, 3 AS runs
  FROM targets LEFT JOIN found USING (user_id, item_id))
"""


def _reviews(t: Tables) -> DataFrame:
    return trust_graph.dedupe_reviews(t.trust_reviews(), "source")


@query(with_views("purchases", "trust_rows", "trust_reviews") + "SELECT user_id, item_id, rating FROM trust_reviews")
def deduped_reviews(t: Tables) -> DataFrame:
    return _reviews(t)


@query(GRAPH + "SELECT src, dst FROM capped")
def capped_edges(t: Tables) -> DataFrame:
    return trust_graph.cap_out_degree(t.trust_edges(), 10)


@query(GRAPH + "SELECT user_id FROM ends")
def edge_endpoints(t: Tables) -> DataFrame:
    return trust_graph.endpoints(trust_graph.cap_out_degree(t.trust_edges(), 10))


@query(GRAPH + "SELECT src, dst FROM links")
def trust_graph_edges(t: Tables) -> DataFrame:
    return trust_graph.build_trust_graph(t.trust_edges(), _reviews(t))[0]


@query(GRAPH + "SELECT user_id, item_id, rating FROM kept")
def trust_graph_reviews(t: Tables) -> DataFrame:
    return trust_graph.build_trust_graph(t.trust_edges(), _reviews(t))[1]


@query(GRAPH + "SELECT user_id, idx, item_id, rating FROM targets")
def trust_graph_targets(t: Tables) -> DataFrame:
    return trust_graph.build_trust_graph(t.trust_edges(), _reviews(t))[2]


@query(GRAPH + "SELECT user_id, item_id, rating FROM kept ANTI JOIN targets USING (user_id, item_id)")
def train_reviews_without_targets(t: Tables) -> DataFrame:
    _, kept, targets = trust_graph.build_trust_graph(t.trust_edges(), _reviews(t))
    return split.train_reviews(kept, targets, leak_test=False)


@query(GRAPH + "SELECT target_item, item, users, round(sim, 6) AS sim FROM support")
def item_support(t: Tables) -> DataFrame:
    return _rounded(trust.prepare_graph(t.trust_edges(), _reviews(t)).item_sim, "sim")


@query(
    GRAPH + """SELECT target_item, item, users, round(users / (n_test + n_train - users), 6) AS sim FROM support
JOIN (SELECT item_id AS target_item, count(*) AS n_test FROM targets GROUP BY ALL) USING (target_item)
JOIN (SELECT item_id AS item, count(*) AS n_train FROM kept GROUP BY ALL) USING (item)"""
)
def item_jaccard(t: Tables) -> DataFrame:
    g = trust.prepare_graph(t.trust_edges(), _reviews(t), trust.TrustParams(item_similarity="jaccard"))
    return _rounded(g.item_sim, "sim")


@query(
    GRAPH + """SELECT src, dst, target_item, round(sim * 0.5, 6) AS prob, b.rating FROM links
JOIN targets ON user_id = src JOIN best b USING (dst) WHERE b.target_item = item_id"""
)
def stop_probability(t: Tables) -> DataFrame:
    g = trust.prepare_graph(t.trust_edges(), _reviews(t))
    return _rounded(trust_walk.stop_probability(g.edges, g.targets, g.reviews, g.item_sim), "prob")


@query(WALKS + "SELECT origin, idx, target_item, run, CAST(hop AS BIGINT) AS hop, node, rating IS NOT NULL AS stopped, coalesce(rating, 0) AS rating FROM log")
def trust_walk_log(t: Tables) -> DataFrame:
    return _plain(trust.run_trust_walk(t.trust_edges(), _reviews(t), WALK).log, "stopped", "rating")


@query(WALKS_LAST_HOP + "SELECT origin, idx, target_item, run, CAST(hop AS BIGINT) AS hop, node, rating IS NOT NULL AS stopped, coalesce(rating, 0) AS rating FROM log")
def trust_walk_log_last_hop(t: Tables) -> DataFrame:
    params = trust.TrustParams(runs=3, credit="last_hop")
    return _plain(trust.run_trust_walk(t.trust_edges(), _reviews(t), params).log, "stopped", "rating")


@query(WALKS + _PREDICTED + "SELECT user_id, item_id, coalesce(round(prediction, 6), 0) AS prediction, prediction IS NOT NULL AS known, resolved, CAST(runs AS BIGINT) AS runs FROM pred")
def predicted_ratings(t: Tables) -> DataFrame:
    found = trust.run_trust_walk(t.trust_edges(), _reviews(t), WALK).predictions
    return _plain(_rounded(found, "prediction"), "known", "prediction")


@query(
    WALKS + _PREDICTED + """SELECT user_id, count(*) AS targets, count(prediction) AS resolved,
       round(coalesce(sqrt(avg(abs(prediction - rating))), 0), 6) AS sqrt_mae,
       round(coalesce(sqrt(avg((prediction - rating) * (prediction - rating))), 0), 6) AS rmse
FROM pred JOIN targets USING (user_id, item_id) GROUP BY user_id"""
)
def rating_error(t: Tables) -> DataFrame:
    errors = trust.run_trust_walk(t.trust_edges(), _reviews(t), WALK).errors
    return _rounded(errors.fillna(0.0, ["sqrt_mae", "rmse"]), "sqrt_mae", "rmse")


@query(
    GRAPH + """SELECT count(*) FILTER (WHERE r.user_id IS NULL) AS left_only, count(*) FILTER (WHERE l.user_id IS NULL) AS right_only,
       (SELECT count(*) FROM (SELECT user_id, item_id FROM kept GROUP BY ALL HAVING count(*) > 1)) AS repeated
FROM kept l FULL JOIN targets r ON l.user_id = r.user_id AND l.item_id = r.item_id"""
)
def paired_ratings(t: Tables) -> DataFrame:
    """How far the held-out ratings and all ratings pair up."""
    g = trust.prepare_graph(t.trust_edges(), _reviews(t))
    return evaluate.unpaired(g.reviews, g.targets, ["user_id", "item_id"])


@query(
    with_views("purchases", "trust_edges") + """,
links AS (SELECT DISTINCT src, dst FROM trust_edges WHERE src % 7 <> 0),
hops AS (
  SELECT c_custkey AS user_id, 0 AS level FROM customer WHERE c_custkey % 500 = 1
  UNION SELECT dst, level + 1 FROM hops JOIN links ON src = user_id WHERE level < 4)
SELECT user_id, CAST(min(level) AS BIGINT) AS level FROM hops GROUP BY user_id"""
)
def khop_expansion(t: Tables) -> DataFrame:
    """Users within four steps of the seeds; every seventh user is private."""
    people = t("customer").select(F.col("c_custkey").alias("user_id"))
    return trust_graph.khop_expand(
        t.trust_edges(), people.where("user_id % 500 = 1"), 4, people.where("user_id % 7 = 0")
    )
