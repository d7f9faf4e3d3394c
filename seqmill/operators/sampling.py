"""Exact, deterministic selection of the k smallest rows, overall or per group.

Used by the group split (L1/L2), stratified split (L3), row and group sampling
(L4/L5) and per-group caps (W3).  Order keys are 60-bit hashes (``seeded_hash``),
so equal-width buckets of the fixed range are evenly filled: a histogram gives the
bucket with the k-th row, and only that bucket is looked at row by row.  No
group is sorted in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HASH_BITS = 60
BUCKET_BITS = 16
#: The last bucket of a search is read when it has at most so many rows.
_FEW = 4096


def seeded_hash(seed, *cols) -> Column:
    """60-bit non-negative key from md5(seed ':' cols...); same in DuckDB as
    the first 15 hex digits of the md5 string (lexicographic == numeric)."""
    s = F.concat_ws(":", F.lit(str(seed)), *[F.col(c).cast("string") if isinstance(c, str) else c for c in cols])
    return F.conv(F.substring(F.md5(s), 1, 15), 16, 10).cast("long")


def kth_smallest(df: DataFrame, order: str, k: int) -> tuple[int, int] | None:
    """``(value, rest)``: the k-th smallest order key, and how many rows with it are among the k.

    None if there are at most k rows.  Each step counts 2^16 buckets of the range
    that holds the k-th row, so at most 2^16 counts come to the driver.
    """
    low, bits, left = 0, HASH_BITS, k
    if k <= 0:
        return -1, 0
    while True:
        shift = max(bits - BUCKET_BITS, 0)
        inside = df.where(F.shiftright(F.col(order), bits) == (low >> bits))
        counts = sorted((r["b"], r["n"]) for r in inside.groupBy(F.shiftright(F.col(order), shift).alias("b"))
                        .agg(F.count(F.lit(1)).alias("n")).collect())
        for b, n in counts:
            if left <= n:
                break
            left -= n
        else:
            return None
        low, bits = b << shift, shift
        if bits == 0:
            return low, left
        if n <= _FEW:
            rows = sorted(r[0] for r in df.where(F.shiftright(F.col(order), bits) == b).select(order).collect())
            value = rows[left - 1]
            return value, left - rows.index(value)


def flag_smallest(df: DataFrame, group: list[str], order: str, k: Column | int,
                  tiebreak: list[str] | None = None, flag: str = "_sel") -> DataFrame:
    """Add boolean ``flag``: the row is among the k smallest ``order`` keys of its group.

    ``order`` is a 60-bit hash.  Without a group ``k`` is a number and the choice is
    a filter on the k-th key; with one it is a column that agrees within a group.
    A null group is a group like any other.  Rows that share the last key are
    ordered by ``tiebreak``.
    """
    tiebreak = list(tiebreak or [])
    if not group:
        found = kth_smallest(df, order, int(k))
        if found is None:
            return df.withColumn(flag, F.lit(True))
        value, rest = found
        ties = Window.partitionBy(order).orderBy(*(tiebreak or [order]))
        sure = df.where(F.col(order) != value).withColumn(flag, F.col(order) < value)
        edge = df.where(F.col(order) == value).withColumn(flag, F.row_number().over(ties) <= rest)
        return sure.unionByName(edge)
    x = df.withColumn("_k", k.cast("long")).withColumn("_bkt", F.shiftright(F.col(order), HASH_BITS - BUCKET_BITS))
    hist = x.groupBy(*group, "_bkt").agg(F.count(F.lit(1)).alias("_c"), F.first("_k").alias("_k"))
    before = F.sum("_c").over(Window.partitionBy(*group).orderBy("_bkt")) - F.col("_c")
    hist = hist.select(*[F.col(c).alias(f"_g{i}") for i, c in enumerate(group)], F.col("_bkt").alias("_b"),
                       (F.col("_k") - before).alias("_rest"), "_c")
    on = F.col("_bkt") == F.col("_b")
    for i, c in enumerate(group):
        on = on & x[c].eqNullSafe(hist[f"_g{i}"])
    x = x.join(hist, on).drop("_b", *[f"_g{i}" for i in range(len(group))])
    # rows of a whole bucket need no rank; only a boundary bucket is ranked
    sure = (F.col("_rest") >= F.col("_c")) | (F.col("_rest") <= 0)
    ranked = x.where(~sure).withColumn(flag, F.row_number().over(
        Window.partitionBy(*group, "_bkt").orderBy(order, *tiebreak)) <= F.col("_rest"))
    return (x.where(sure).withColumn(flag, F.col("_rest") > 0).unionByName(ranked)
            .drop("_k", "_bkt", "_rest", "_c"))


def take_smallest(df: DataFrame, group: list[str], order: str, k, tiebreak=None) -> DataFrame:
    kc = F.lit(k) if group and isinstance(k, int) else k
    return flag_smallest(df, group, order, kc, tiebreak).where(F.col("_sel")).drop("_sel")


def sample_fraction(df: DataFrame, key: list[str], fraction: float, seed=0) -> DataFrame:
    """Remove int(n*(1-f)) rows chosen by seeded hash; keep the rest."""
    n = df.count()
    keep = n - int(n * (1 - fraction))
    h = df.withColumn("_h", seeded_hash(seed, *key))
    return take_smallest(h, [], "_h", keep, list(key)).drop("_h")


def sample_groups(df: DataFrame, key: str, n_groups: int, seed=0) -> DataFrame:
    """N distinct groups by seeded hash, all their rows (semi join)."""
    g = df.select(key).distinct().withColumn("_h", seeded_hash(seed, key))
    chosen = take_smallest(g, [], "_h", n_groups, [key]).select(key)
    return df.join(chosen, key, "left_semi")


def cap_per_group(df: DataFrame, key, order: str, n: int, tiebreak=None) -> DataFrame:
    """First n rows of each group in ``order``.

    Spark limits each group to n rows before the shuffle, so a hot group sends n
    rows a task.
    """
    key = [key] if isinstance(key, str) else list(key)
    w = Window.partitionBy(*key).orderBy(order, *(tiebreak or []))
    return df.withColumn("_rn", F.row_number().over(w)).where(F.col("_rn") <= n).drop("_rn")


def limit_rows(df: DataFrame, n: int, order_by: list[str]) -> DataFrame:
    """F8: the first n rows in an explicit order (a top-n, never a full sort)."""
    return df.orderBy(*order_by).limit(n)


def shuffled(df: DataFrame, key: list[str], seed=0, out: str = "position") -> DataFrame:
    """Rows with a place in a seeded random order (0-based).

    The hash's top bits deal the rows into buckets; a row's place is its rank in
    the bucket after the buckets before it, so no task sorts the table.
    """
    h = df.withColumn("_h", seeded_hash(seed, *key)).withColumn("_bkt", F.shiftright("_h", HASH_BITS - 10))
    hist = h.groupBy("_bkt").agg(F.count(F.lit(1)).alias("_c"))  # at most 1024 rows
    before = hist.select(F.col("_bkt").alias("_b"), (F.sum("_c").over(Window.orderBy("_bkt")) - F.col("_c")).alias("_before"))
    rank = F.row_number().over(Window.partitionBy("_bkt").orderBy("_h", *key))
    return (h.withColumn("_r", rank).join(F.broadcast(before), F.col("_bkt") == F.col("_b"))
            .withColumn(out, (F.col("_before") + F.col("_r") - 1).cast("long")).drop("_h", "_bkt", "_b", "_before", "_r"))
