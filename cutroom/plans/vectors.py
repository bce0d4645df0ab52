"""Vector queries: pairs, clusters, groups, centroids and search."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cutroom.functions.vectors import cosine
from cutroom.operators import similarity
from cutroom.plans.registry import Register, greedy_groups_sql
from cutroom.session import table

_register = Register()
QUERIES, ORACLE_SQL = _register.queries, _register.sql

#: Lower than the default of 0.90, as the tables hold no closer vectors of different rows.
THRESHOLD = 0.40
_PAIRS = f"""SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) AS s FROM embeddings a JOIN embeddings b ON a.vec_id < b.vec_id
 WHERE list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[]) >= {THRESHOLD}"""


@_register.query(f"SELECT a, b, round(s, 6) AS similarity FROM ({_PAIRS})")
def similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-13: all pairs over a threshold, exactly, without a cross join."""
    found = similarity.similar_pairs(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", THRESHOLD)
    return found.select("a", "b", F.round("similarity", 6).alias("similarity"))


@_register.query(f"""
WITH RECURSIVE p AS ({_PAIRS}), e AS (SELECT a, b FROM p UNION SELECT b, a FROM p), r AS (SELECT a AS node, b AS other FROM e UNION SELECT r.node, e.b FROM r JOIN e ON e.a = r.other)
SELECT node AS vec_id, least(node, min(other)) AS component, max(count(*)) OVER (PARTITION BY least(node, min(other))) AS members FROM r GROUP BY node
""")
def similar_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-11: clusters of two or more, named by their least id."""
    return similarity.similar_clusters(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", THRESHOLD).select(F.col("node").alias("vec_id"), "component", "members")


@_register.query("""
SELECT a.label, round(min(list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])), 6) AS least, count(*) AS pairs
FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id GROUP BY a.label
""")
def group_min_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-21: how unlike the least alike two of a group are."""
    return similarity.least_within(table(spark, sf_dir, "embeddings"), "label", "vec_id", "embedding").select("label", F.round("least", 6).alias("least"), "pairs")


_CENTROID = """WITH u AS (SELECT label, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM embeddings), m AS (SELECT label, p, avg(x) AS m FROM u GROUP BY ALL),
c AS (SELECT label, list(m ORDER BY p) AS v FROM m GROUP BY label)"""


@_register.query(f"""{_CENTROID}
SELECT e.vec_id, round(list_cosine_similarity(e.embedding::DOUBLE[], c.v), 6) AS similarity, round(least(1.0, greatest(0.0, (0.95 - list_cosine_similarity(e.embedding::DOUBLE[], c.v)) / 0.45)), 6) AS interest
FROM embeddings e JOIN c ON c.label = e.label
""")
def centroid_interest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG-14: each group's mean vector, and how far from it a row lies as novelty."""
    rows = table(spark, sf_dir, "embeddings")
    joined = rows.join(similarity.centroid(rows, ["label"], "embedding"), "label").withColumn("s", cosine("embedding", "centroid"))
    return joined.select("vec_id", F.round("s", 6).alias("similarity"), F.round(similarity.novelty(F.col("s")), 6).alias("interest"))


@_register.query("""
WITH q AS (SELECT embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id = 0), f AS (SELECT vec_id // 5 AS clip, vec_id AS frame, list_cosine_similarity(embedding::DOUBLE[], q.v) AS s, embedding FROM embeddings, q WHERE vec_id > 0),
n AS (SELECT clip, p, avg(x) AS x FROM (SELECT clip, unnest(embedding)::DOUBLE AS x, generate_subscripts(embedding, 1) AS p FROM f) GROUP BY ALL), m AS (SELECT clip, list_cosine_similarity(list(x ORDER BY p), any_value(q.v)) AS mean_score FROM n, q GROUP BY clip), t AS (SELECT clip FROM m ORDER BY mean_score DESC, clip LIMIT 50),
b AS (SELECT clip, max(s) AS frame_score, max_by(frame, struct_pack(s := s, f := frame)) AS frame FROM f WHERE clip IN (SELECT clip FROM t) GROUP BY clip)
SELECT m.clip, round(mean_score, 6) AS mean_score, round(greatest(mean_score, coalesce(frame_score, mean_score)), 6) AS score, frame FROM m LEFT JOIN b ON b.clip = m.clip WHERE greatest(mean_score, coalesce(frame_score, mean_score)) >= 0.1
""")
def cosine_topk_two_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT-03, DOM-14, FLT-13: coarse ranking of clips, the best 50 ranked again by their best frame."""
    rows = table(spark, sf_dir, "embeddings")
    query = rows.where("vec_id = 0").first()["embedding"]
    frames = rows.where("vec_id > 0").select(F.floor(F.col("vec_id") / 5).alias("clip"), F.col("vec_id").alias("frame"), "embedding")
    means = similarity.centroid(frames, ["clip"], "embedding", "embedding")
    found = similarity.two_stage_search(means, frames, "clip", "frame", "embedding", query, least=0.1)
    return found.select("clip", F.round("mean_score", 6).alias("mean_score"), F.round("score", 6).alias("score"), "frame")


@_register.query("""
WITH p AS (SELECT 'kind' || (vec_id % 2) AS dimension, 'l' || (vec_id % 6) AS label, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id < 24),
s AS (SELECT e.vec_id, dimension, p.label, avg(list_cosine_similarity(e.embedding::DOUBLE[], p.v)) AS score FROM embeddings e, p GROUP BY ALL)
SELECT vec_id, dimension, CASE WHEN score >= 0.1 THEN label ELSE 'unknown' END AS label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY vec_id, dimension ORDER BY score DESC, label) AS r FROM s) WHERE r = 1
""")
def classify_dimensions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-28, DOM-29: the best label of each dimension by mean cosine to its prompts; the prompts are a small configuration."""
    rows = table(spark, sf_dir, "embeddings")
    prompts = rows.where("vec_id < 24").select(F.concat(F.lit("kind"), F.col("vec_id") % 2).alias("dimension"), F.concat(F.lit("l"), F.col("vec_id") % 6).alias("label"), F.col("embedding").alias("vector"))
    found = similarity.classify(similarity.prototype_scores(rows, "vec_id", "embedding", prompts), "vec_id", least=0.1)
    return found.withColumn("score", F.round("score", 6))


@_register.query(f"""
WITH RECURSIVE v AS (SELECT vec_id AS id, vec_id // 100 AS event, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT a.id, list(b.id) AS near FROM v a JOIN v b ON b.event = a.event AND b.id < a.id AND list_dot_product(a.e, b.e) >= 0.05 GROUP BY a.id),
o AS (SELECT v.event, v.id, row_number() OVER (PARTITION BY v.event ORDER BY v.id) AS pos, coalesce(near, CAST([] AS BIGINT[])) AS near FROM v LEFT JOIN n ON n.id = v.id), {greedy_groups_sql(200)},
k AS (SELECT event, groups, unnest(range(1, len(groups) + 1)) AS k FROM g) SELECT event, k - 1 AS cluster, unnest(groups[k]) AS vec_id FROM k
""")
def complete_link_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DOM-12: greedy complete-link groups in order inside each event of a hundred rows."""
    def close(frame, i, members):  # noqa: ANN001, ANN202
        v = frame.embedding
        return all(float(v[i] @ v[m]) >= 0.05 for m in members)

    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.floor(F.col("vec_id") / 100).alias("event"), "embedding")
    return similarity.complete_link(rows, "event", ["vec_id"], "vec_id", close, weakest=[])


@_register.query("""
WITH f AS (SELECT vec_id // 5 AS clip, vec_id AS frame, embedding::DOUBLE[] AS v FROM embeddings), n AS (SELECT clip, p, avg(x) AS x FROM (SELECT clip, unnest(v) AS x, generate_subscripts(v, 1) AS p FROM f) GROUP BY ALL), m AS (SELECT clip, list(x ORDER BY p) AS v FROM n GROUP BY clip),
c AS (SELECT a.clip AS a, b.clip AS b, list_cosine_similarity(a.v, b.v) AS s FROM m a JOIN m b ON a.clip < b.clip WHERE list_cosine_similarity(a.v, b.v) >= 0.25)
SELECT a, b FROM c WHERE s >= 0.4 OR EXISTS (SELECT 1 FROM f x JOIN f y ON x.clip = c.a AND y.clip = c.b WHERE list_cosine_similarity(x.v, y.v) >= 0.35)
""")
def refined_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-14, DOM-11: clips alike by their means, or nearly so and by any two of their frames; only those near pairs meet frame by frame."""
    rows = table(spark, sf_dir, "embeddings")
    frames = rows.select(F.floor(F.col("vec_id") / 5).alias("clip"), F.col("vec_id").alias("frame"), "embedding")
    means = similarity.centroid(frames, ["clip"], "embedding", "embedding")
    return similarity.refined_pairs(means, frames, "clip", "frame", "embedding", sure=0.4, slack=0.15, frame_sure=0.35)


@_register.query("""
WITH s AS (SELECT vec_id AS shot, label % 5 AS place, vec_id % 11 AS ep FROM embeddings), h AS (SELECT place, count(DISTINCT ep) AS episodes, max(ep) AS last FROM s WHERE ep < 8 GROUP BY place) SELECT shot, coalesce(episodes, 0) AS episodes, last FROM s LEFT JOIN h USING (place) WHERE ep >= 8
""")
def channel_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JON-17: what another table, the channel's memory, knows of each shot's place: one join in place of a look-up a shot."""
    shots = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("shot"), (F.col("label") % 5).alias("place"), (F.col("vec_id") % 11).alias("ep"))
    memory = shots.where("ep < 8").groupBy("place").agg(F.countDistinct("ep").alias("episodes"), F.max("ep").alias("last"))
    return shots.where("ep >= 8").join(memory, "place", "left").select("shot", F.coalesce("episodes", F.lit(0)).alias("episodes"), "last")
