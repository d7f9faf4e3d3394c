"""Vector operators: pooling, per-group similarity without pair explosion.

group_cohesion uses the identity, for unit vectors u_1..u_n of a group,

    sum_{i<j} u_i . u_j = (|sum_i u_i|^2 - n) / 2

so the mean pairwise cosine of a group is a per-dimension sum (map-side partial
aggregation, no self join, a hot group costs the same as any other rows).  The
same holds for Spearman with centred, unit-scaled rank vectors.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.functions import vector as V
from seqmill.operators.joins import attach_by_key
from seqmill.session import cut, ship


def vector_sums(rows: DataFrame, key: list[str], vec: str) -> DataFrame:
    """(key, n, squares, total array) of a vector column: partial sums a batch, then a sum a key and place."""
    ship(rows.sparkSession)
    kinds = ", ".join(f"{c} {t}" for c, t in rows.select(*key).dtypes)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            pdf = b.select(key).to_pandas()
            group, first = pdf.groupby(key, sort=False, dropna=False).ngroup().to_numpy(), None
            v = b.column(vec)
            width = np.diff(v.offsets.to_numpy())
            flat = v.flatten().to_numpy()
            for w in np.unique(width):
                at = np.flatnonzero(width == w)
                start = v.offsets.to_numpy()[at] - v.offsets.to_numpy()[0]
                m = flat[start[:, None] + np.arange(w)[None, :]]
                names, first, inv = np.unique(group[at], return_index=True, return_inverse=True)
                total = np.zeros((len(names), w))
                np.add.at(total, inv, m)
                squares = np.bincount(inv, (m * m).sum(1), len(names))
                n = np.bincount(inv, minlength=len(names))
                idx = pa.array(at[first])
                yield pa.RecordBatch.from_arrays(
                    [*[b.column(c).take(idx) for c in key], pa.array(n.astype(np.int64)), pa.array(squares),
                     pa.ListArray.from_arrays(np.arange(len(names) + 1, dtype=np.int32) * w, pa.array(total.ravel()))],
                    names=[*key, "n", "squares", "total"])

    part = rows.select(*key, vec).mapInArrow(run, f"{kinds}, n long, squares double, total array<double>")
    place = part.select(*key, F.posexplode("total").alias("i", "t")).groupBy(*key, "i").agg(F.sum("t").alias("t"))
    whole = place.groupBy(*key).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "t"))), lambda x: x["t"]).alias("total"))
    return part.groupBy(*key).agg(F.sum("n").alias("n"), F.sum("squares").alias("squares")).join(whole, key)


def group_cohesion(df: DataFrame, key, vec: str = "vec", digits: int = 6) -> DataFrame:
    """Per group: n_vectors, n_pairs, mean pairwise cosine and Spearman.

    One pass: unit and rank vectors are computed once per row and added up by
    group in Arrow batches, so a batch sends one array a group; a small
    aggregation adds the arrays.
    """
    key = [key] if isinstance(key, str) else list(key)
    x = df.select(*key, F.col(vec).alias("_v"))
    x = x.select(*key, F.explode(F.array(
        F.struct(F.lit("u").alias("kind"), V.unit("_v").alias("v")),
        F.struct(F.lit("r").alias("kind"), V.centered_rank_unit(F.col("_v")).alias("v")))).alias("_s")).select(*key, "_s.*")
    sums = vector_sums(x.where(F.col("v").isNotNull()), [*key, "kind"], "v")
    sq = F.aggregate("total", F.lit(0.0), lambda a, t: a + t * t)
    mean = F.when(F.col("n") > 1, (sq - F.col("n")) / (F.col("n") * (F.col("n") - 1)))
    per = sums.select(*key, "kind", mean.alias("m")).groupBy(*key).agg(
        F.round(F.max(F.when(F.col("kind") == "u", F.col("m"))), digits).alias("mean_cosine"),
        F.round(F.max(F.when(F.col("kind") == "r", F.col("m"))), digits).alias("mean_spearman"))
    n = df.groupBy(*key).agg(F.count(F.lit(1)).alias("n_vectors"))
    return n.join(per, key, "left").select(
        *key, "n_vectors", (F.col("n_vectors") * (F.col("n_vectors") - 1) / 2).cast("long").alias("n_pairs"),
        "mean_cosine", "mean_spearman")


def inner_places(df: DataFrame, key: list[str], pos: str = "pos") -> DataFrame:
    """Rows whose place is neither the first nor the last of their key.

    The last places are a row a key: broadcast if small; else frequent keys are, and the others are shuffled.
    """
    ends = cut(df.groupBy(*key).agg(F.min(pos).alias("_first"), F.max(pos).alias("_last"), F.count(F.lit(1)).alias("_rows")))
    inner = (F.col(pos) > F.col("_first")) & (F.col(pos) < F.col("_last"))
    return attach_by_key(df, ends, key, "_rows").where(inner).drop("_first", "_last", "_rows")


def mean_pool_long(df: DataFrame, key, vec: str = "vec") -> DataFrame:
    """Per-key mean vector in long form (key, dim, value): exact and scalable."""
    key = [key] if isinstance(key, str) else list(key)
    e = df.select(*key, F.posexplode(vec).alias("dim", "_x"))
    return e.groupBy(*key, "dim").agg(F.avg(F.col("_x").cast("double")).alias("value"))


def mean_pool(df: DataFrame, key, vec: str = "vec", strip: bool = False, pos: str = "pos") -> DataFrame:
    """V3: per-key mean vector as ARRAY<DOUBLE> (reassembled in dimension order).

    With ``strip`` the first and the last place (``pos``) of each key are boundary
    rows and left out; a key that has nothing else has no mean and no row.
    """
    key = [key] if isinstance(key, str) else list(key)
    if strip:
        df = inner_places(df, key, pos)
    lp = mean_pool_long(df, key, vec)
    return (lp.groupBy(*key)
              .agg(F.array_sort(F.collect_list(F.struct("dim", "value"))).alias("_s"))
              .select(*key, F.transform("_s", lambda s: s["value"]).alias(vec)))


def all_pairs(vectors: DataFrame, id_col: str = "id", vec: str = "vec") -> DataFrame:
    """P5: every unordered pair (id1 < id2) of a table of *named* vectors, with both vectors.

    The caller names the ids (a report over groups or a short list); block pairs
    keep tasks bounded whatever their number.
    """
    from seqmill.operators.pairs import pairs_within

    v = vectors.select(F.col(id_col).alias("id"), F.col(vec).alias("vec"))
    return pairs_within(v.withColumn("_all", F.lit(0)), "_all", "id", ["id", "vec"]).select("id1", "id2", "vec1", "vec2")


def pair_metrics(pairs: DataFrame, digits: int = 6) -> DataFrame:
    """cosine, cosine distance, Euclidean distance and Spearman of (vec1, vec2), which ids ``id1``, ``id2`` name.

    A vector that several pairs use is ranked once.
    """
    ends = (pairs.select(F.col("id1").alias("_id"), F.col("vec1").alias("_v"))
            .unionByName(pairs.select(F.col("id2").alias("_id"), F.col("vec2").alias("_v"))).dropDuplicates(["_id"]))
    ranks = ends.select("_id", V.centered_rank_unit(F.col("_v")).alias("_r"))
    x = pairs.join(ranks.select(F.col("_id").alias("id1"), F.col("_r").alias("_r1")), "id1")
    x = x.join(ranks.select(F.col("_id").alias("id2"), F.col("_r").alias("_r2")), "id2")
    keep = [c for c in pairs.columns if c not in ("vec1", "vec2")]
    return x.select(
        *keep,
        F.round(V.cosine("vec1", "vec2"), digits).alias("cosine"),
        F.round(V.cosine_distance("vec1", "vec2"), digits).alias("cosine_distance"),
        F.round(V.l2_distance("vec1", "vec2"), digits).alias("l2_distance"),
        F.round(V.dot("_r1", "_r2"), digits).alias("spearman"),
    )
