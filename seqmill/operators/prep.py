"""Dataset build: memberships, sequence attach, group filters, splits, leaks.

All steps are set operations (explode, joins, semi/anti joins, aggregates);
none collects a group or an id list to the driver.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.operators.sampling import HASH_BITS, flag_smallest, seeded_hash
from seqmill.session import cut


def explode_members(raw: DataFrame, group_col: str = "group_name", ids_col: str = "protein_ids",
                    min_size: int = 2, dedupe: bool = True) -> DataFrame:
    """G1: split the comma list (no trim), de-duplicate, drop rows with fewer
    than ``min_size`` distinct ids, explode to (group_name, protein_id)."""
    arr = F.split(F.col(ids_col), ",")
    if dedupe:
        arr = F.array_distinct(arr)
    x = raw.select(F.col(group_col).alias("group_name"), arr.alias("_ids"))
    if min_size > 1:
        x = x.where(F.size("_ids") >= min_size)
    return x.select("group_name", F.explode("_ids").alias("protein_id"))


def attach_sequences(members: DataFrame, proteins: DataFrame) -> DataFrame:
    """J1 + F2: members joined to proteins on id, rows without sequence dropped.

    Written as the inner join the reference's left join + dropna amounts to;
    the membership side is the big one, the protein side is joined by key.
    """
    p = proteins.where(F.col("sequence").isNotNull()).select(
        F.col("id").alias("protein_id"), "description", "sequence")
    return members.join(p, "protein_id")


def drop_small_groups(df: DataFrame, key: str, min_n: int = 2) -> DataFrame:
    """Keep groups with at least ``min_n`` rows (NULL keys dropped)."""
    big = (df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
             .where(F.col("_n") >= min_n).select(key))
    return df.join(big, key, "left_semi")


def resolve_multi_group(df: DataFrame, protein: str = "protein_id", group: str = "group_name",
                        mode: str = "drop") -> DataFrame:
    """Proteins in more than one group are dropped (``mode='drop'``) or
    marked for the test split (``mode='to_test'`` adds ``force_test``)."""
    if mode not in ("drop", "to_test"):
        raise ValueError(f"mode must be 'drop' or 'to_test', got {mode!r}")
    multi = (df.groupBy(protein).agg(F.countDistinct(group).alias("_g"))
               .where(F.col("_g") > 1).select(protein))
    if mode == "drop":
        return df.join(multi, protein, "left_anti")
    return df.join(multi.withColumn("force_test", F.lit(True)), protein, "left").fillna(
        {"force_test": False})


def filter_length(df: DataFrame, seq: str, low: int | None = None, high: int | None = None) -> DataFrame:
    """rows whose sequence has ``low`` to ``high`` residues; a null sequence has no length."""
    n = F.length(seq)
    ok = n.isNotNull()
    ok = ok if low is None else ok & (n >= low)
    return df.where(ok if high is None else ok & (n <= high))


def duplicates(df: DataFrame, key: str) -> DataFrame:
    """Q3: keys that occur more than once, with how often; empty when the key is unique."""
    return df.groupBy(key).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > 1)


def _ceil(x: float) -> int:
    return int(-(-x // 1))


def labelled_keys(members: DataFrame, proteins: DataFrame, min_n: int = 2) -> DataFrame:
    """J1 + F2 + G2 without payload: (group_name, protein_id) of members with a sequence, in groups
    of at least ``min_n``.  Checkpointed once: the filters, splits and codes that follow work on
    this narrow table, and sequences are attached last (``with_sequences``)."""
    have = proteins.where(F.col("sequence").isNotNull()).select(F.col("id").alias("protein_id"))
    keys = cut(members.join(have, "protein_id").select("group_name", "protein_id"))
    return drop_small_groups(keys, "group_name", min_n)


def with_sequences(keys: DataFrame, proteins: DataFrame, *columns) -> DataFrame:
    """Keys with payload columns of their proteins (``description``, ``sequence``) or expressions of them, which are
    worked out where the protein is, so that a sequence of which only a length or digest is wanted isn't shuffled."""
    p = proteins.where(F.col("sequence").isNotNull()).select(F.col("id").alias("protein_id"), *columns)
    return keys.join(p, "protein_id")


def group_table(df: DataFrame, key: str, seed) -> DataFrame:
    """Distinct groups with their seeded hash, one narrow row each, checkpointed."""
    return cut(df.select(key).distinct().withColumn("_h", seeded_hash(seed, key)))


def group_split(df: DataFrame, key: str, fraction: float, seed=42, flag: str = "is_test") -> DataFrame:
    """L1: choose ceil(fraction * n_groups) groups (seeded hash order); rows
    follow their group.  Adds boolean ``flag``."""
    g = group_table(df, key, seed)
    chosen = flag_smallest(g, [], "_h", _ceil(fraction * g.count()), [key], flag=flag).select(key, flag)
    return df.join(chosen, key)


def three_way_split(df: DataFrame, key: str, fraction: float = 0.15, seed=42) -> DataFrame:
    """L2: test = group split of all groups, val = group split of the rest,
    same fraction and seed; adds ``split`` in {train, val, test}.

    Both choices are filters on hash thresholds over the group table; rows follow by one join.
    A row with ``force_test`` (``resolve_multi_group``) goes to test whatever its group (U3).
    """
    g = group_table(df, key, seed)
    a = flag_smallest(g, [], "_h", _ceil(fraction * g.count()), [key], flag="_t")
    rest = a.where(~F.col("_t")).drop("_t")
    b = flag_smallest(rest, [], "_h", _ceil(fraction * rest.count()), [key], flag="_v")
    assign = (a.where(F.col("_t")).select(key, F.lit("test").alias("split"))
               .unionByName(b.select(key, F.when(F.col("_v"), "val").otherwise("train").alias("split"))))
    out = df.join(cut(assign), key)
    if "force_test" in df.columns:
        out = out.withColumn("split", F.when(F.col("force_test"), "test").otherwise(F.col("split")))
    return out


def assert_disjoint(df: DataFrame, cols=("group_name", "protein_id"), split: str = "split",
                    train: str = "train") -> DataFrame:
    """Rows of non-train splits whose value of any of ``cols`` occurs in
    train.  Empty result == no leak."""
    out = None
    for c in cols:
        tr = df.where(F.col(split) == train).select(c).distinct()
        other = df.where(F.col(split) != train).select(split, c)
        leak = other.join(tr, c, "left_semi").select(
            split, F.lit(c).alias("column"), F.col(c).cast("string").alias("value"))
        out = leak if out is None else out.unionByName(leak)
    return out.distinct()


def label_codes(df: DataFrame, label: str, out: str = "label_code") -> DataFrame:
    """Sorted distinct labels -> 0..k-1.  Labels are ranked by range partitions and the
    partitions' offsets, so the label table may be as long as the data."""
    from seqmill.operators.stats import value_ranks

    d = df.select(label).where(F.col(label).isNotNull()).distinct()
    return value_ranks(d, label).select(label, F.col("before").cast("int").alias(out))


def stratified_split(df: DataFrame, label: str, key: str, fraction: float = 0.1, seed=1) -> DataFrame:
    """L3: per-label exact test counts; total = ceil(fraction * n).

    Each label gets floor(n_test * n_l / n); the remaining rows go to the
    labels with the largest remainders (ties by seeded hash of the label).
    Labels with a single row stay in train.  Inside a label the test rows are
    the smallest seeded hashes of ``key``.  Adds ``split`` in {train, test}.
    """
    counts = cut(df.groupBy(label).agg(F.count(F.lit(1)).alias("_nl")))
    n = int(counts.agg(F.sum("_nl")).first()[0] or 0)
    if not n:
        return df.withColumn("split", F.lit("train"))
    n_test = _ceil(fraction * n)
    share = F.lit(n_test) * F.col("_nl")
    c = counts.withColumn("_base", F.when(F.col("_nl") > 1, F.floor(share / n)).otherwise(0).cast("long"))
    rem = n_test - int(c.agg(F.sum("_base")).first()[0] or 0)
    # order key of a label: its remainder (largest first), then its hash, in one 60-bit number
    bits = n.bit_length()
    order = F.shiftleft(F.lit(n - 1) - share % n, HASH_BITS - bits).bitwiseOR(
        F.shiftright(seeded_hash(seed, label), bits))
    open_ = c.where((F.col("_nl") > 1) & (F.col("_base") < F.col("_nl"))).withColumn("_ord", order)
    top = flag_smallest(open_, [], "_ord", max(rem, 0), [label], flag="_extra").where("_extra").select(label, "_extra")
    c = cut(c.join(top, label, "left").select(
        label, (F.col("_base") + F.when(F.col("_extra"), 1).otherwise(0)).alias("_kt")))
    x = df.join(c, label).withColumn("_h", seeded_hash(seed, key))
    x = flag_smallest(x, [label], "_h", F.col("_kt"), [key], flag="_test")
    return x.withColumn("split", F.when(F.col("_test"), "test").otherwise("train")).drop("_test", "_kt", "_h")
