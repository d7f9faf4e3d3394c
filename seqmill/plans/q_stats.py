"""Statistics queries (G5-G11) over lineitem, events, orders and embeddings."""

from __future__ import annotations


from pyspark.sql import functions as F

from seqmill.operators import residues as R
from seqmill.operators import stats as ST
from seqmill.plans.registry import query
from seqmill.sources.tables import Tables

_LI_COLS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("event_spearman", """
WITH b AS (SELECT value AS x, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS y
           FROM events WHERE value IS NOT NULL),
r AS (SELECT rank() OVER (ORDER BY x) + (count(*) OVER (PARTITION BY x) - 1) / 2.0 AS rx,
             rank() OVER (ORDER BY y) + (count(*) OVER (PARTITION BY y) - 1) / 2.0 AS ry FROM b)
SELECT round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM r""", bench=True)
def event_spearman(spark, sf_dir):
    """Spearman between event value and the binary 'purchase' truth."""
    e = Tables(spark, sf_dir)("events").select(
        "value", F.when(F.col("event_type") == "purchase", 1).otherwise(0).alias("truth"))
    return ST.spearman(e, "value", "truth")


@query("lineitem_quantiles", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", unnest([0.25, 0.5, 0.75]) AS prob, "
    f"round(unnest(quantile_cont({c}, [0.25, 0.5, 0.75])), 6) AS value FROM lineitem" for c in _LI_COLS))
def lineitem_quantiles(spark, sf_dir):
    """Exact quartiles (linear interpolation) of lineitem measures."""
    li = Tables(spark, sf_dir)("lineitem")
    return ST.quantiles(li, _LI_COLS)


@query("price_histogram", """
WITH s AS (SELECT min(l_extendedprice) AS mn, max(l_extendedprice) AS mx FROM lineitem),
b AS (SELECT CAST(least(floor((l_extendedprice - mn) / ((mx - mn) / 20)), 19) AS INT) AS bucket, mn, mx
      FROM lineitem, s WHERE l_extendedprice IS NOT NULL)
SELECT 'l_extendedprice' AS "column", bucket, round(mn + bucket * ((mx - mn) / 20), 6) AS lower, count(*) AS n
FROM b GROUP BY bucket, mn, mx""")
def price_histogram(spark, sf_dir):
    """20-bin equal-width histogram of l_extendedprice."""
    return ST.histogram(Tables(spark, sf_dir)("lineitem"), "l_extendedprice", 20)


@query("value_density", """
WITH b AS (SELECT CAST(value AS DOUBLE) AS x FROM events WHERE value IS NOT NULL),
s AS (SELECT count(*) AS n, stddev_samp(x) AS sd, min(x) AS mn, max(x) AS mx FROM b),
h AS (SELECT n, 2.0 * sd * pow(n, -1.0 / 5.0) AS h, mn, mx FROM s),
g AS (SELECT gi, mn - 3 * h + gi * ((mx + 3 * h) - (mn - 3 * h)) / 199 AS gx, h, n FROM h, range(200) t(gi)),
d AS (SELECT x, count(*) AS c FROM b GROUP BY x)
SELECT 'value' AS "column", CAST(g.gi AS INT) AS gi, round(g.gx, 6) AS x,
       round(sum(d.c * exp(-0.5 * ((g.gx - d.x) / g.h) * ((g.gx - d.x) / g.h))) / (g.n * g.h * sqrt(2 * pi())), 6) AS density
FROM g, d GROUP BY g.gi, g.gx, g.h, g.n""")
def value_density(spark, sf_dir):
    """Gaussian KDE curve (bw_adjust 2, 200 points) of event values."""
    return ST.kde_grid(Tables(spark, sf_dir)("events"), "value", 2.0, 200)


@query("lineitem_means", "SELECT l_returnflag, " + ", ".join(
    f"round(avg({c}), 6) AS {c}" for c in _LI_COLS) + " FROM lineitem GROUP BY l_returnflag")
def lineitem_means(spark, sf_dir):
    """NaN-skipping per-key means (partial + final hash aggregation)."""
    return R.mean_scores(Tables(spark, sf_dir)("lineitem"), "l_returnflag", _LI_COLS)


@query("lineitem_summary", " UNION ALL ".join(
    f"SELECT '{c}' AS \"column\", round(min({c}), 6) AS min, round(max({c}), 6) AS max, "
    f"round(avg({c}), 6) AS mean FROM lineitem" for c in _LI_COLS))
def lineitem_summary(spark, sf_dir):
    """Transposed min/max/mean per column (unpivot + group by column)."""
    return R.summarize(Tables(spark, sf_dir)("lineitem"), _LI_COLS)


@query("label_accuracy", """
SELECT round(avg(CASE WHEN list_position(embedding, list_max(embedding)) - 1 = label
                      THEN 1.0 ELSE 0.0 END), 6) AS accuracy, count(*) AS n FROM embeddings""")
def label_accuracy(spark, sf_dir):
    """Accuracy of the argmax over the whole vector as class scores."""
    e = Tables(spark, sf_dir)("embeddings").select(F.col("embedding").alias("pred"), "label")
    return ST.accuracy(e, "pred", "label")


@query("order_profile", """
SELECT count(*) AS n_rows, count(DISTINCT o_custkey) AS n_keys FROM orders""")
def order_profile(spark, sf_dir):
    """Row and distinct group counts."""
    return ST.profile(Tables(spark, sf_dir)("orders"), "o_custkey")
