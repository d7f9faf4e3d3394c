"""Vector queries over ``embeddings`` (V1-V5, V8, W8, P5, G5 minimum slice)."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmill.operators import vectors as OV
from seqmill.plans.registry import query
from seqmill.sources.tables import Tables

_RANKS = """
el AS (SELECT vec_id, label, generate_subscripts(embedding, 1) AS i,
              CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
rk AS (SELECT vec_id, label, i,
              rank() OVER (PARTITION BY vec_id ORDER BY x)
              + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2.0 AS r FROM el),
ck AS (SELECT vec_id, label, i, r - avg(r) OVER (PARTITION BY vec_id) AS c FROM rk)"""

LABEL_COHESION_SQL = f"""
WITH {_RANKS},
sp AS (SELECT a.label, a.vec_id AS v1, b.vec_id AS v2,
              sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS s
       FROM ck a JOIN ck b ON a.label = b.label AND a.i = b.i AND a.vec_id < b.vec_id
       GROUP BY ALL),
cs AS (SELECT a.label, a.vec_id AS v1, b.vec_id AS v2,
              list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS c
       FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id < b.vec_id),
n AS (SELECT label, count(*) AS n_vectors FROM embeddings GROUP BY label)
SELECT n.label, n.n_vectors, CAST(n.n_vectors * (n.n_vectors - 1) / 2 AS BIGINT) AS n_pairs,
       round((SELECT avg(c) FROM cs WHERE cs.label = n.label), 6) AS mean_cosine,
       round((SELECT avg(s) FROM sp WHERE sp.label = n.label), 6) AS mean_spearman
FROM n
"""


@query("label_cohesion", LABEL_COHESION_SQL, bench=True)
def label_cohesion(spark, sf_dir):
    """Minimum slice: per label, mean pairwise cosine and Spearman of embeddings."""
    e = Tables(spark, sf_dir)("embeddings").select("label", F.col("embedding").alias("vec"))
    return OV.group_cohesion(e, "label", "vec")


MEAN_POOL_SQL = """
SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(x), 6) AS value
FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
      FROM embeddings)
GROUP BY label, i
"""


@query("mean_pool", MEAN_POOL_SQL)
def mean_pool(spark, sf_dir):
    """V3: per-label mean vector, long form (label, dim, value)."""
    e = Tables(spark, sf_dir)("embeddings").select("label", F.col("embedding").alias("vec"))
    lp = OV.mean_pool_long(e, "label", "vec")
    return lp.select("label", F.col("dim").cast("int").alias("dim"), F.round("value", 6).alias("value"))


@query("boundary_pools", """
WITH e AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS a,
                  row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS z FROM embeddings),
x AS (SELECT label, a > 1 AND z > 1 AS inside, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS v FROM e)
SELECT label, CAST(i - 1 AS INT) AS dim, round(avg(v), 6) AS with_boundary, round(avg(v) FILTER (WHERE inside), 6) AS stripped
FROM x GROUP BY label, i""")
def boundary_pools(spark, sf_dir):
    """V3 both ways: means of each label's vectors in order of their ids, with the first and the last one and without."""
    e = Tables(spark, sf_dir)("embeddings").select("label", "vec_id", F.col("embedding").alias("vec"))

    def long(strip, name):
        x = OV.mean_pool(e, "label", "vec", strip, "vec_id").select("label", F.posexplode("vec").alias("dim", "v"))
        return x.select("label", "dim", F.round("v", 6).alias(name))

    return long(False, "with_boundary").join(long(True, "stripped"), ["label", "dim"], "left")


PAIR_METRICS_SQL = f"""
WITH {_RANKS},
sp AS (SELECT a.vec_id AS v1, b.vec_id AS v2,
              sum(a.c * b.c) / sqrt(sum(a.c * a.c) * sum(b.c * b.c)) AS s
       FROM ck a JOIN ck b ON b.vec_id = a.vec_id + 1 AND a.i = b.i GROUP BY ALL)
SELECT a.vec_id AS id1, b.vec_id AS id2,
       round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
       round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine_distance,
       round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS l2_distance,
       round(sp.s, 6) AS spearman
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1
JOIN sp ON sp.v1 = a.vec_id AND sp.v2 = b.vec_id
"""


@query("pair_metrics", PAIR_METRICS_SQL)
def pair_metrics(spark, sf_dir):
    """V1, V2, V4, V8 on named pairs (each vector with the next id)."""
    e = Tables(spark, sf_dir)("embeddings").select("vec_id", "embedding")
    a = e.select(F.col("vec_id").alias("id1"), F.col("embedding").alias("vec1"))
    b = e.select(F.col("vec_id").alias("id2"), F.col("embedding").alias("vec2"))
    pairs = a.join(b, F.col("id2") == F.col("id1") + 1)
    return OV.pair_metrics(pairs)
