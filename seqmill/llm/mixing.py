"""Operator 6: mix sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmill.llm.common import cut, small

#: Bits of a document's hash, and bits resolved by each histogram.
HASH_BITS, STEP_BITS = 60, 12


def doc_hash(key, seed: int = 0):
    """60 bits of MD5 of a key as text; a null key hashes as the empty text."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(key).cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def word_count(text: str):
    """Runs of characters other than 0x20 and 0x09 to 0x0D; null has none."""
    return F.coalesce(F.regexp_count(F.col(text), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, weights: list[float], max_repeats: int) -> DataFrame:
    """``(source, source_size)`` -> with ``target``: shares of the total by weight, at most
    ``max_repeats`` times the size; what lies above is shared again by weight.

    Sources in code-point order (null last) take the weights in turn.  A source is
    capped when its cap over its weight lies under the level at which the rest
    share what is left; going up in that order, the level only rises, so one
    ordered pass over the sources (a row each, not the documents) finds them.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]),
                     (F.pmod(F.row_number().over(order) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("w", w).withColumn("cap", F.col("source_size") * float(max_repeats))
    up = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    rest = up.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = ((F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
             / F.sum("w").over(rest))
    s = s.withColumn("level", level)
    # the first source under its cap fixes the level for all after it
    s = s.withColumn("place", F.row_number().over(up))
    open_level = F.min(F.when(F.col("w") * F.col("level") <= F.col("cap"), F.struct("place", "level"))).over(everything)
    s = s.withColumn("open_level", open_level["level"])
    return s.select("source", "source_size",
                    F.when(F.col("open_level").isNull(), F.col("cap"))
                    .otherwise(F.least("cap", F.col("w") * F.col("open_level"))).alias("target"))


def hash_thresholds(rows: DataFrame, budgets: DataFrame, key: str) -> DataFrame:
    """The hash up to which each key's rows fill its budget best.

    ``rows(key, h, size)``, ``budgets(key, budget)`` -> ``(key, threshold)``: rows
    with ``h < threshold`` are taken.  A histogram of sizes by key and the top
    12 bits of the hash gives the bucket in which the running sum passes the
    budget; only that bucket is split by the next 12 bits, until it is one hash
    value, which is taken if that brings the sum nearer to the budget.  No row is
    sorted, and a level keeps at most 4096 sums for each key.
    """
    state = budgets.select(key, F.col("budget").cast("double").alias("left"), F.lit(0).cast("long").alias("lo"))
    for level in range(HASH_BITS // STEP_BITS):
        shift = HASH_BITS - STEP_BITS * (level + 1)
        st = state.select(F.col(key).alias("k_"), "left", "lo")
        inside = rows.join(small(st), rows[key].eqNullSafe(F.col("k_"))).where(
            F.expr(f"shiftright(h, {shift + STEP_BITS}) = shiftright(lo, {shift + STEP_BITS})") & (F.col("left") > 0))
        hist = inside.groupBy(key, F.expr(f"shiftright(h, {shift})").alias("bucket")).agg(
            F.sum("size").alias("n"))
        run = Window.partitionBy(key).orderBy("bucket")
        cum = hist.withColumn("upto", F.sum("n").over(run))
        cum = cum.withColumn("before", F.col("upto") - F.col("n"))
        j = cum.join(small(state.select(F.col(key).alias("k_"), "left")), cum[key].eqNullSafe(F.col("k_")))
        # the first bucket whose running sum passes the budget is the boundary
        hit = j.where(F.col("upto") > F.col("left")).groupBy(key).agg(
            F.min(F.struct("bucket", "before", "n")).alias("x"))
        hit = hit.select(F.col(key).alias("k_"), F.expr(f"shiftleft(x.bucket, {shift})").alias("new_lo"),
                         F.col("x.before").alias("used"), F.col("x.n").alias("n_hit"))
        s = state.alias("s").join(hit, F.col(f"s.{key}").eqNullSafe(F.col("k_")), "left")
        last = level == HASH_BITS // STEP_BITS - 1
        over = F.col("n_hit") - (F.col("left") - F.col("used"))  # beyond the budget if the boundary is taken
        bump = (F.when(over < F.col("left") - F.col("used"), 1).otherwise(0) if last else F.lit(0)).cast("long")
        all_of = F.lit(1 << HASH_BITS).cast("long")
        # no boundary at level 0: every row fits; a budget of 0 takes none
        nothing = F.when(F.col("left") > 0, all_of).otherwise(F.lit(0).cast("long")) if level == 0 else F.col("lo")
        state = cut(s.select(F.col(f"s.{key}").alias(key),
                             F.when(F.col("new_lo").isNull(), F.lit(0.0))
                             .otherwise(F.col("left") - F.col("used")).alias("left"),
                             F.when(F.col("new_lo").isNull(), nothing)
                             .otherwise(F.col("new_lo") + bump).alias("lo")))
    return state.select(key, F.col("lo").alias("threshold"))


def mix(docs: DataFrame, weights=(5.0, 2.0, 1.0), max_repeats: int = 3, seed: int = 0,
        text: str = "text", source: str = "source", key: str = "doc_id") -> DataFrame:
    """How often each document is taken so that sources come to their target weights.

    Returns ``key, source, size, source_size, target, copies, taken`` a document
    (``taken = copies * size``).  A source whose target is r times its size takes
    each document floor(r) times and those under its hash threshold once more, so
    mixes with a smaller target are contained in those with a larger one.

    Null text: size 0.  Null source: a source of its own, last in order.  Rows that
    repeat a key hash alike and are taken alike.  An empty table gives an empty
    result.  Other columns are left out, whatever their names.
    """
    rows = cut(docs.select(F.col(key).alias("k"), F.col(source).alias("source"),
                           word_count(text).alias("size"), doc_hash(key, seed).alias("h")))
    targets = cut(source_targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")),
                                 list(weights), max_repeats))
    # a source without words is taken once as it is
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(1.0)
    whole = F.floor(ratio + 1e-12)
    budgets = targets.select("source", F.greatest(F.lit(0.0), F.col("target") - whole * F.col("source_size"))
                             .alias("budget"))
    cutoff = hash_thresholds(rows, budgets, "source")
    plan = targets.withColumn("whole", whole.cast("int")).alias("t").join(
        cutoff.alias("c"), F.col("t.source").eqNullSafe(F.col("c.source"))).select(
        F.col("t.source").alias("s_"), "source_size", "target", "whole", "threshold")
    out = rows.join(small(cut(plan)), rows["source"].eqNullSafe(F.col("s_")))
    copies = F.col("whole") + F.when(F.col("whole") >= max_repeats, 0).when(
        F.col("h") < F.col("threshold"), 1).otherwise(0)
    return out.select(F.col("k").alias(key), "source", "size", "source_size", "target",
                      copies.cast("int").alias("copies"), (copies * F.col("size")).cast("long").alias("taken"))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents themselves, each as often as the mix takes it, columns unchanged.

    Rows that repeat a key are taken equally often, so the mix is joined back by
    one row a key.
    """
    key, source = options.get("key", "doc_id"), options.get("source", "source")
    plan = mix(docs, **options).where("copies > 0").groupBy(F.col(key).alias("k_"), F.col("source").alias("s_")).agg(
        F.first("copies").alias("n_"))
    j = docs.join(plan, docs[key].eqNullSafe(plan["k_"]) & docs[source].eqNullSafe(plan["s_"]))
    names = [docs[f"`{c}`"] for c in docs.columns]
    again = "__seqmill_copy"
    return j.select(*names, F.explode(F.sequence(F.lit(1), plan["n_"])).alias(again)).drop(again)
