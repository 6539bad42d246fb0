"""Queries of clustering, scaling and evaluation."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..operators import cluster, evaluate, keyed
from .registry import query, table

CENTRES_SQL = "c AS (SELECT (row_number() OVER (ORDER BY label) - 1)::INTEGER AS k, embedding AS e FROM embeddings WHERE vec_id IN (SELECT min(vec_id) FROM embeddings GROUP BY label))"


def points(spark, sf):
    return table(spark, sf, "embeddings").select(F.col("vec_id").alias("id"), "label", F.col("embedding").cast("array<double>").alias("coord"))


def first_centroids(p):
    """The point of the lowest id of each label."""
    rank = F.row_number().over(Window.partitionBy("label").orderBy("id"))
    return [r.coord for r in p.withColumn("r", rank).where("r = 1").orderBy("label").collect()]


def _nearest(spark, sf, name):
    p = points(spark, sf)
    target = F.broadcast(p.where("id = 0").select(F.col("coord").alias("target")))
    d = p.crossJoin(target).select("id", vectors.distance(name)(F.col("coord"), F.col("target")).alias("distance"))
    return d.orderBy("distance", "id").limit(20).select("id", F.round("distance", 5).alias("distance"))


def _near_sql(expr):
    return f"WITH t AS (SELECT embedding::DOUBLE[] AS t FROM embeddings WHERE vec_id = 0), d AS (SELECT vec_id AS id, {expr} AS distance FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings) CROSS JOIN t) SELECT id, round(distance, 5) AS distance FROM d ORDER BY d.distance, id LIMIT 20"


@query(_near_sql("list_distance(e, t)"))
def dist_euclid(spark, sf):
    return _nearest(spark, sf, "euclidean")


@query(_near_sql("list_sum(list_transform(range(1, len(e) + 1), lambda i: abs(e[i] - t[i])))"))
def dist_manhattan(spark, sf):
    return _nearest(spark, sf, "manhattan")


@query(_near_sql("list_cosine_distance(e, t)"))
def dist_cosine(spark, sf):
    return _nearest(spark, sf, "cosine")


@query("SELECT vec_id AS id, round(list_sum(e), 5) AS total, round(sqrt(list_sum(list_transform(e, lambda x: x * x))), 5) AS norm, len(e)::INTEGER AS dims FROM (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings)")
def vector_algebra(spark, sf):
    p = points(spark, sf)
    twice = vectors.subtract(vectors.add(F.col("coord"), F.col("coord")), F.col("coord"))
    return p.select("id", F.round(vectors.total(twice), 5).alias("total"), F.round(vectors.norm(F.col("coord")), 5).alias("norm"), F.size("coord").alias("dims"))


def _zscore_sql(n):
    return f"WITH x AS (SELECT vec_id AS id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings), s AS (SELECT dim, avg(v) AS m, sqrt(var_pop(v) * {n}) AS sd FROM x GROUP BY dim) SELECT id, dim::INTEGER AS dim, round(CASE WHEN sd > 0 THEN (v - m) / sd ELSE 0 END, 4) + 0.0 AS z FROM x JOIN s USING (dim)"


def _zscore(spark, sf, mode):
    z = cluster.zscore(points(spark, sf), mode)
    return z.select("id", F.posexplode("coord").alias("dim", "z")).withColumn("z", F.round("z", 4) + 0.0)


@query(_zscore_sql("count(*)"))
def zscore_ref(spark, sf):
    return _zscore(spark, sf, "reference")


@query(_zscore_sql("1"))
def zscore_pop(spark, sf):
    return _zscore(spark, sf, "population")


ASSIGN_SQL = f"WITH {CENTRES_SQL}, a AS (SELECT vec_id AS id, embedding, k AS cluster, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], e::DOUBLE[]), k) AS r FROM embeddings CROSS JOIN c)"


@query(f"{ASSIGN_SQL} SELECT id, cluster FROM a WHERE r = 1")
def kmeans_assign(spark, sf):
    p = points(spark, sf)
    return cluster.assign(p, first_centroids(p)).select("id", "cluster")


@query(f"{ASSIGN_SQL}, x AS (SELECT cluster, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM a WHERE r = 1) SELECT cluster, dim::INTEGER AS dim, round(avg(v), 5) + 0.0 AS mean FROM x GROUP BY cluster, dim")
def kmeans_update(spark, sf):
    p = points(spark, sf)
    a = cluster.assign(p, first_centroids(p)).select("cluster", F.posexplode("coord").alias("dim", "x"))
    return a.groupBy("cluster", "dim").agg((F.round(F.avg("x"), 5) + 0.0).alias("mean"))


def _lloyd_sql(steps: int) -> str:
    """Assignments after a number of steps from the first centres."""
    out = f"WITH {CENTRES_SQL}, c0 AS (SELECT k, e::DOUBLE[] AS e FROM c)"
    for i in range(steps + 1):
        out += f", a{i} AS (SELECT * FROM (SELECT vec_id AS id, embedding::DOUBLE[] AS x, k AS cluster, list_distance(embedding::DOUBLE[], e) AS d, row_number() OVER (PARTITION BY vec_id ORDER BY list_distance(embedding::DOUBLE[], e), k) AS r FROM embeddings CROSS JOIN c{i}) WHERE r = 1)"
        out += f", m{i} AS (SELECT cluster AS k, dim, avg(v) AS v FROM (SELECT cluster, unnest(x) AS v, generate_subscripts(x, 1) AS dim FROM a{i}) GROUP BY cluster, dim), c{i + 1} AS (SELECT (row_number() OVER (ORDER BY k) - 1)::INTEGER AS k, list(v ORDER BY dim) AS e FROM m{i} GROUP BY k)"
    return out + f" SELECT id, cluster, round((SELECT sum(d * d) FROM a{steps}), 4) AS dispersion FROM a{steps}"


@query(_lloyd_sql(3))
def kmeans_moves(spark, sf):
    """Three moves of the centroids from given starts."""
    import numpy as np

    p = points(spark, sf)
    now = np.array(first_centroids(p))
    for _ in range(3):
        now = cluster.lloyd_step(p, [now])[0][1]
    a = cluster.assign(p, now.tolist())
    return a.select("id", "cluster", F.round(F.lit(cluster.dispersion(a)), 4).alias("dispersion"))


@query("SELECT vec_id AS id, round(embedding[1]::DOUBLE, 6) AS first FROM embeddings")
def identity_points(spark, sf):
    return cluster.transform("ident", points(spark, sf)).select("id", F.round(F.col("coord")[0], 6).alias("first"))


@query()
def kmeans_run(spark, sf):
    p = points(spark, sf)
    disp, centroids = cluster.kmeans(p, 4, restarts=5)
    return cluster.assign(p, centroids).select("id", "cluster", F.lit(round(disp, 6)).alias("dispersion"))


@query()
def pca_components(spark, sf):
    moved, _ = cluster.pca(points(spark, sf))
    return moved.select("id", F.size("coord").alias("dims"), F.round(F.element_at("coord", 1), 6).alias("first"))


# --- evaluation: quality against toxicity labels, and labels against length classes ---

PRED_SQL = "p AS (SELECT l.quality AS gold, CASE WHEN d.n_chars > 400 THEN 1 ELSE 0 END AS predicted, d.doc_id FROM labels AS l JOIN documents AS d ON l.doc_id = d.doc_id)"
MATRIX_SQL = f"{PRED_SQL}, l AS (SELECT gold AS x FROM p UNION SELECT predicted FROM p), m AS (SELECT g.x AS gold, q.x AS predicted, (SELECT count(*) FROM p WHERE p.gold = g.x AND p.predicted = q.x) AS n FROM l AS g CROSS JOIN l AS q)"


def predictions(spark, sf):
    d = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") > 400, 1).otherwise(0).alias("predicted"))
    return table(spark, sf, "labels").join(d, "doc_id").select(F.col("quality").alias("gold"), "predicted", "doc_id")


@query(f"WITH {MATRIX_SQL} SELECT gold, predicted, n FROM m")
def confusion_matrix(spark, sf):
    return evaluate.confusion(predictions(spark, sf))


@query(f"WITH {PRED_SQL} SELECT gold, predicted, count(*) AS n FROM p GROUP BY CUBE (gold, predicted)")
def confusion_marginals(spark, sf):
    return evaluate.marginals(predictions(spark, sf))


@query(f"""WITH {MATRIX_SQL}, s AS (SELECT x AS label, (SELECT sum(n) FROM m WHERE gold = x) AS g, (SELECT sum(n) FROM m WHERE predicted = x) AS p, (SELECT sum(n) FROM m WHERE gold = x AND predicted = x) AS ok FROM l),
r AS (SELECT label, CASE WHEN p > 0 THEN ok / p ELSE 0 END AS precision, CASE WHEN g > 0 THEN ok / g ELSE 0 END AS recall, g::BIGINT AS n_gold, p::BIGINT AS n_predicted FROM s)
SELECT label, round(precision, 8) AS precision, round(recall, 8) AS recall, round(CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) ELSE 0 END, 8) AS f1, n_gold, n_predicted FROM r""")
def prf_report(spark, sf):
    m = evaluate.measures(evaluate.confusion(predictions(spark, sf)))
    return m.select("label", *[F.round(c, 8).alias(c) for c in ("precision", "recall", "f1")], "n_gold", "n_predicted")


@query(f"WITH {PRED_SQL} SELECT gold, predicted, string_agg(doc_id::VARCHAR, ',' ORDER BY doc_id) AS items FROM (SELECT *, row_number() OVER (PARTITION BY gold, predicted ORDER BY doc_id) AS r FROM p) WHERE r <= 3 GROUP BY gold, predicted")
def confusion_examples(spark, sf):
    e = evaluate.examples(predictions(spark, sf), "doc_id", 3)
    return e.select("gold", "predicted", F.array_join(F.transform("items", lambda x: x.cast("string")), ",").alias("items"))


@query(f"{ASSIGN_SQL} SELECT e.label AS gold, a.cluster AS predicted, count(*) AS n FROM a JOIN embeddings AS e ON e.vec_id = a.id WHERE r = 1 GROUP BY e.label, a.cluster")
def cluster_confusion(spark, sf):
    p = points(spark, sf)
    return evaluate.confusion(cluster.assign(p, first_centroids(p)), "label", "cluster", fill=False)


@query("""WITH v AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY conv_id, role), t AS (SELECT conv_id, role AS label, n, sum(n) OVER (PARTITION BY conv_id) AS total, row_number() OVER (PARTITION BY conv_id ORDER BY n DESC, role) AS r FROM v),
k AS (SELECT conv_id, label FROM t WHERE r = 1 AND n * 3 >= total * 2) SELECT conv_id, label, ((row_number() OVER (ORDER BY conv_id) - 1) * 3 // (SELECT count(*) FROM k))::INTEGER AS part FROM k""")
def vote_majority_split(spark, sf):
    from ..sources.corpora import majority_votes, split_thirds

    v = keyed.counts(table(spark, sf, "conversations"), "conv_id", "role", out="n")
    return split_thirds(majority_votes(v, "conv_id", "role", "n"), "conv_id")
