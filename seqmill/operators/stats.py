"""Statistics operators: ranks, Spearman, quantiles, histograms, KDE, accuracy.

Global order statistics avoid ``Window.orderBy`` without a partition (which
moves all rows into one task).  ``value_ranks`` pre-aggregates to distinct
values, range-partitions them, takes a running sum inside each partition
(Arrow batches, in order) and adds per-partition offsets computed from a table
with one row per partition.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from seqmill.session import cut, ship


def _prefix_partitions(d: DataFrame, cols: list[str], n_parts: int) -> DataFrame:
    """(values, cnt, _pid, _local_before) with values sorted across partitions."""
    r = d.repartitionByRange(n_parts, *cols).sortWithinPartitions(*cols)

    def local_cumsum(it):
        from pyspark import TaskContext
        pid, run = TaskContext.get().partitionId(), 0
        for b in it:
            c = b.column("cnt").to_numpy()
            before = run + np.cumsum(c) - c
            run += int(c.sum())
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(np.full(len(c), pid, np.int32)), pa.array(before.astype(np.int64))],
                names=[*b.schema.names, "_pid", "_local_before"])

    schema = T.StructType(r.schema.fields + [T.StructField("_pid", T.IntegerType()),
                                             T.StructField("_local_before", T.LongType())])
    return r.mapInArrow(local_cumsum, schema)


def value_ranks(df: DataFrame, cols, count: str | None = None, n_parts: int | None = None) -> DataFrame:
    """Distinct values of the column (or columns) with (cnt, before): ``before`` rows are
    strictly smaller.  Average tie rank = before + (cnt + 1) / 2.  ``count`` names a
    column with how often a row counts.  Offsets of the range partitions come
    by a join with a table of one row a partition."""
    cols = [cols] if isinstance(cols, str) else list(cols)
    d = df.dropna(subset=cols).groupBy(*cols).agg(
        (F.sum(count) if count else F.count(F.lit(1))).cast("long").alias("cnt"))
    n_parts = n_parts or int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    loc = cut(_prefix_partitions(d, cols, n_parts))
    totals = loc.groupBy("_pid").agg(F.sum("cnt").alias("_t"))
    before = F.sum("_t").over(Window.orderBy("_pid")) - F.col("_t")
    off = totals.select(F.col("_pid").alias("_p"), before.alias("_off"))
    return loc.join(F.broadcast(off), F.col("_pid") == F.col("_p")).select(
        *cols, "cnt", (F.col("_off") + F.col("_local_before")).cast("long").alias("before"))


def spearman(df: DataFrame, x: str, y: str, digits: int = 6) -> DataFrame:
    """Spearman correlation = Pearson of average-tie ranks (one row).

    Rows are counted by (x, y) first; both margins are ranked from that table and
    the correlation is weighted by the counts, so a value that very many rows share
    is one row of each join.
    """
    pairs = cut(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).groupBy(
        F.col(x).alias("_x"), F.col(y).alias("_y")).agg(F.count(F.lit(1)).alias("_w")))
    ranks = []
    for c in ("_x", "_y"):
        r = value_ranks(pairs, c, "_w")
        ranks.append(r.select(c, (F.col("before") + (F.col("cnt") + 1) / 2.0).alias("_r" + c)))
    r = pairs.join(ranks[0], "_x").join(ranks[1], "_y").select("_w", F.col("_r_x").alias("a"), F.col("_r_y").alias("b"))
    w = F.col("_w").cast("double")
    s = r.agg(F.sum("_w").alias("n"), *[F.sum(w * v).alias(k) for k, v in (
        ("a", F.col("a")), ("b", F.col("b")), ("aa", F.col("a") * F.col("a")), ("bb", F.col("b") * F.col("b")),
        ("ab", F.col("a") * F.col("b")))])
    va = F.col("aa") - F.col("a") * F.col("a") / F.col("n")
    vb = F.col("bb") - F.col("b") * F.col("b") / F.col("n")
    cov = F.col("ab") - F.col("a") * F.col("b") / F.col("n")
    return s.select(F.round(F.when((va > 0) & (vb > 0), cov / F.sqrt(va * vb)), digits).alias("spearman"),
                    F.coalesce("n", F.lit(0)).cast("long").alias("n"))


def _finite(df: DataFrame, col: str):
    """The column as double, with null and NaN left out."""
    x = df.select(F.col(col).cast("double").alias("_x"))
    return x.where(F.col("_x").isNotNull() & ~F.isnan("_x"))


def quantiles(df: DataFrame, cols, probs=(0.25, 0.5, 0.75), digits: int = 6) -> DataFrame:
    """Exact quantiles with linear interpolation (numpy 'linear'), all columns in one pass.

    Spark's exact ``percentile`` keeps counts of distinct values in an aggregation
    buffer; here values are counted by (column, value) first and the order
    statistics found by running counts over range partitions, so memory does not
    grow with the distinct values.  An empty column gives no rows.
    """
    cols = [cols] if isinstance(cols, str) else list(cols)
    long = df.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("_x"))
                                         for c in cols])).alias("_s")).select("_s.*")
    long = long.where(F.col("_x").isNotNull() & ~F.isnan("_x"))
    # one order over (column, value): a column's rows follow each other
    per = value_ranks(long, ["column", "_x"])
    base = per.groupBy(F.col("column").alias("_c")).agg(F.min("before").alias("_b0"), F.sum("cnt").alias("_n"))
    per = per.join(F.broadcast(base), F.col("column") == F.col("_c"))  # a row for each asked column
    per = per.withColumn("_k", F.col("before") - F.col("_b0"))
    p = per.select("*", F.explode(F.array(*[F.lit(float(q)) for q in probs])).alias("prob"))
    h = F.col("prob") * (F.col("_n") - 1)
    lo, hi = F.floor(h), F.ceil(h)
    has = lambda at: (F.col("_k") <= at) & (F.col("_k") + F.col("cnt") > at)
    got = p.where(has(lo) | has(hi)).groupBy("column", "prob").agg(
        F.max(F.when(has(lo), F.col("_x"))).alias("_lo"), F.max(F.when(has(hi), F.col("_x"))).alias("_hi"),
        F.max(h - lo).alias("_f"))
    return got.select("column", "prob", F.round(F.col("_lo") + F.col("_f") * (F.col("_hi") - F.col("_lo")), digits).alias("value"))


def histogram(df: DataFrame, col: str, bins: int = 20) -> DataFrame:
    """Equal-width histogram between min and max (max in the last bin); null and NaN are left out
    and an empty column has no bins."""
    x = _finite(df, col)
    mn, mx = x.agg(F.min("_x"), F.max("_x")).first()
    mn, mx = (0.0, 0.0) if mn is None else (float(mn), float(mx))
    width = (mx - mn) / bins if mx != mn else 1.0
    b = F.least(F.floor((F.col("_x") - F.lit(mn)) / F.lit(width)), F.lit(bins - 1)).cast("int")
    return (x.select(b.alias("bucket")).groupBy("bucket").agg(F.count(F.lit(1)).alias("n"))
             .select(F.lit(col).alias("column"), "bucket",
                     F.round(F.lit(mn) + F.col("bucket") * F.lit(width), 6).alias("lower"), "n"))


def kde_grid(df: DataFrame, col: str, bw_adjust: float = 2.0, gridsize: int = 200, margin: float = 3.0,
             digits: int = 6) -> DataFrame:
    """Gaussian KDE on a regular grid (Scott bandwidth times bw_adjust,
    grid from min - margin*h to max + margin*h).

    Each task adds up the curve of its values batch by batch and sends one row, so what is
    shuffled is a curve a task, whatever the number of values.  Null and NaN are left out; fewer than two
    values or equal ones have no bandwidth and no curve.
    """
    ship(df.sparkSession)
    base = _finite(df, col)
    st = base.agg(F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("sd"),
                  F.min("_x").alias("mn"), F.max("_x").alias("mx")).first()
    n, sd = int(st["n"]), float(st["sd"] or 0.0)
    h = bw_adjust * sd * n ** (-1.0 / 5.0) if n else 0.0
    if not h > 0:
        return df.sparkSession.createDataFrame([], "column string, gi int, x double, density double")
    lo, hi = float(st["mn"]) - margin * h, float(st["mx"]) + margin * h
    step = (hi - lo) / (gridsize - 1)
    norm = 1.0 / (n * h * math.sqrt(2.0 * math.pi))

    def run(batches):
        grid, total, seen = lo + np.arange(gridsize) * step, np.zeros(gridsize), False
        for b in batches:
            x = b.column(0).to_numpy(zero_copy_only=False)
            for at in range(0, len(x), 4096):
                z = (grid[None, :] - x[at:at + 4096, None]) / h
                total += np.exp(-0.5 * z * z).sum(0)
                seen = True
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([total], pa.list_(pa.float64()))], names=["curve"])

    curves = base.select("_x").mapInArrow(run, "curve array<double>")
    return (curves.select(F.posexplode("curve").alias("gi", "_v")).groupBy("gi").agg(F.sum("_v").alias("_s"))
            .select(F.lit(col).alias("column"), F.col("gi").cast("int").alias("gi"),
                    F.round(F.lit(lo) + F.col("gi") * F.lit(step), digits).alias("x"),
                    F.round(F.col("_s") * F.lit(norm), digits).alias("density")))


def accuracy(df: DataFrame, pred: str, label: str, digits: int = 6) -> DataFrame:
    """mean(argmax(pred) == label)."""
    am = (F.array_position(F.col(pred), F.array_max(pred)) - 1).cast("int")
    return df.agg(F.round(F.avg((am == F.col(label)).cast("double")), digits).alias("accuracy"),
                  F.count(F.lit(1)).alias("n"))


def profile(df: DataFrame, key: str) -> DataFrame:
    """Row count and distinct keys."""
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.countDistinct(key).alias("n_keys"))
