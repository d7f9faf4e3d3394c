"""Operator 5: document fingerprints as bottom-k sketches of word shingles, in DataFrame functions alone.

A sketch is the ascending array of the k least distinct 64-bit hashes of a text's
shingles (all of them if there are fewer).  Sketches of parts merge into the sketch
of the whole, and give estimates of resemblance, containment and distinct shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from seqmill.llm.common import SPACES, cut, small

#: Hashes kept, and words of a shingle.
K, WIDTH = 128, 5


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, lower-cased; null and word-less texts have none."""
    parts = F.split(F.lower(F.coalesce(text, F.lit(""))), SPACES)
    return F.transform(F.array_remove(parts, ""), lambda w: F.xxhash64(w))


def sketch_of_hashes(words: Column, k: int = K, width: int = WIDTH) -> Column:
    """Bottom-k sketch of the shingles of ``width`` words; fewer words are one shingle, no word none."""
    n = F.size(words)
    first = F.slice(words, 1, F.greatest(n - (width - 1), F.least(n, F.lit(1))))
    shingles = F.transform(first, lambda w, i: F.xxhash64(w, *[F.get(words, i + j) for j in range(1, width)]))
    return F.slice(F.array_distinct(F.sort_array(shingles)), 1, k)


def sketched(df: DataFrame, text: str, out: str, k: int = K, width: int = WIDTH) -> DataFrame:
    """``df`` with the sketch of a text column; the word hashes are a column of their own, made once a row."""
    return (df.withColumn("words_", word_hashes(F.col(text)))
            .withColumn(out, sketch_of_hashes(F.col("words_"), k, width)).drop("words_"))


def merge_parts(parts: DataFrame, by: list[str], sketch: str = "sketch", k: int = K) -> DataFrame:
    """Sketch of each group from sketches of its parts, however many parts a group has.

    The k least distinct hashes are found with a map-side combine: hashes are made
    distinct first and those beyond the k-th of a salted share are dropped before
    the shares meet, so no task ever gathers a group's hashes.
    """
    hashes = parts.select(*by, F.explode(sketch).alias("h_")).distinct()
    share = F.pmod(F.xxhash64("h_"), F.lit(64)).alias("share_")
    least = Window.partitionBy(*by, "share_").orderBy("h_")
    top = hashes.select(*by, "h_", share).withColumn("n_", F.row_number().over(least)).where(F.col("n_") <= k)
    return top.groupBy(*by).agg(F.slice(F.sort_array(F.collect_list("h_")), 1, k).alias(sketch))


def union_bottom(a: Column, b: Column, k: int = K) -> Column:
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Share of the union's k least hashes that both have; two sketches without shingles are alike (1)."""
    union = union_bottom(a, b, k)
    both = F.size(F.array_intersect(F.array_intersect(union, a), b))
    return F.when(F.size(union) == 0, 1.0).otherwise(both / F.size(union))


def distinct_shingles(a: Column, k: int = K) -> Column:
    """Estimated number of distinct shingles: exact below k, else (k - 1) over the k-th hash's place in the range."""
    place = (F.element_at(a, -1).cast("double") + 2.0 ** 63) / 2.0 ** 64
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / place)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimated share of a's shingles that b has, from resemblance and the distinct counts."""
    r = resemblance(a, b, k)
    common = r * distinct_shingles(union_bottom(a, b, k), k)
    mine = distinct_shingles(a, k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), common / mine))


def as_text(sketch: Column) -> Column:
    """The sketch as text: 16 hexadecimal digits a hash."""
    return F.array_join(F.transform(sketch, lambda h: F.lpad(F.hex(h), 16, "0")), "")


def in_key_order(docs: DataFrame, key: str, value: str, bytes_each: int = 8 << 20) -> DataFrame:
    """``part, key, value``: rows dealt by ranges of keys, part 0 with the largest, about ``bytes_each`` a part.

    The bounds are quantiles of the keys, so the parts are even for any keys and a
    repeated evaluation deals alike.  Null keys come last.
    """
    stats = docs.agg(F.count("*").alias("n"), F.sum(F.octet_length(value)).alias("b")).first()
    parts = max(1, -(-int(stats["b"] or 0) // bytes_each))
    if parts == 1:
        return docs.withColumn("part", F.lit(0))
    at = [i / parts for i in range(1, parts)]
    bounds = sorted({x for x in docs.select(F.percentile_approx(key, at, 100 * parts)).first()[0] or []}, reverse=True)
    # the part is the number of bounds above the key
    above = F.aggregate(F.array(*[F.lit(x) for x in bounds]), F.lit(0),
                        lambda n, x: n + F.when(x > F.col(key), 1).otherwise(0))
    return docs.withColumn("part", F.when(F.col(key).isNull(), len(bounds)).otherwise(above))


def fingerprints(docs: DataFrame, k: int = K, width: int = WIDTH, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Sketches of every text, of its edited text, and their likeness to each other and to the next text.

    ``key, n_chars, edited, sketch, edited_sketch, near_edited, near_next``.  The next
    document is the one with the next smaller key, after the last the first; the
    edited text has its last floor(n_chars / 2) code points replaced by the first as
    many of the next text.  Texts are shuffled once, by key ranges; within a range
    the next row is found by a window, and the first row of every range goes to the
    range before.

    Null texts are empty and have no shingles; equal keys follow each other by text;
    a single document is its own next; an empty table gives no rows; other columns
    are left out.
    """
    rows = docs.select(F.col(key).alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    dealt = in_key_order(rows, "k", "t")
    order = [F.col("k").desc_nulls_last(), F.col("t")]
    rng = Window.partitionBy("part").orderBy(*order)
    with_sketch = sketched(dealt.repartition("part"), "t", "sketch", k, width)
    linked = with_sketch.withColumn("next_", F.lead(F.struct("t", "sketch")).over(rng))
    # the first row of every part: as many rows as parts, found by keys alone
    top = cut(dealt.groupBy("part").agg(F.max("k").alias("k")).select(
        F.col("part").alias("p_"), F.col("k").alias("k_")))
    heads = dealt.join(small(top), (F.col("part") == F.col("p_")) & F.col("k").eqNullSafe(F.col("k_")))
    heads = cut(sketched(heads.groupBy("part").agg(F.min("t").alias("t")), "t", "sketch", k, width))
    ring = Window.orderBy("part")
    first = F.first(F.struct("t", "sketch")).over(ring.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    after = heads.select(F.col("part").alias("p_"), F.coalesce(
        F.lead(F.struct("t", "sketch")).over(ring), first).alias("head_"))
    linked = linked.join(after, F.col("part") == F.col("p_")).withColumn("next_", F.coalesce("next_", "head_"))
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.col("t").substr(F.lit(1), n - half), F.col("next_.t").substr(F.lit(1), half))
    out = linked.select("k", "t", "sketch", F.col("next_.sketch").alias("next_sketch"), n.cast("long").alias("n_chars"),
                        edited.alias("edited"))
    out = sketched(out, "edited", "edited_sketch", k, width)
    return out.select(F.col("k").alias(key), "n_chars", "edited", "sketch", "edited_sketch",
                      resemblance(F.col("sketch"), F.col("edited_sketch"), k).alias("near_edited"),
                      resemblance(F.col("sketch"), F.col("next_sketch"), k).alias("near_next"))
