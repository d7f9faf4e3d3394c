"""Operator 8: SimHash near-duplicates by deletion-variant signatures."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, cut, ship, text_bytes, words
from seqmill.llm.components import components

#: The largest run of fingerprints that is compared pair by pair; a longer one is split further.
PAIRWISE = 1024


def fingerprint(text: bytes, width: int = 3, seed: int = 42, block: int = 1 << 16) -> int:
    """64-bit SimHash of a text's word shingles, each occurrence with a vote for each bit."""
    ws = words(text.lower())
    if not ws:
        return 0
    if len(ws) < width:
        ws, width = [b" ".join(ws)], 1
    h = np.fromiter((xxhash.xxh64_intdigest(b" ".join(ws[i:i + width]), seed)
                     for i in range(len(ws) - width + 1)), np.uint64, len(ws) - width + 1)
    votes = np.zeros(64, np.int64)
    for at in range(0, len(h), block):
        part = h[at:at + block].astype("<u8").view(np.uint8).reshape(-1, 8)
        votes += np.unpackbits(part, axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(h), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """``k, h, fp``: the fingerprint (its bits as a signed long) of every whole text; h: the text's XXH64.

    A-Z is lower-cased.  A text with fewer than ``width`` words is one shingle; one
    without words (empty, null) has fingerprint zero.
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                fp = np.array([fingerprint(t.as_py(), width, seed) for t in part.column("t")], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("h"), pa.array(fp.view(np.int64))],
                                                 names=["k", "h", "fp"])

    return docs.select(F.col(key).alias("k"), F.xxhash64(F.col(text)).alias("h"), text_bytes(text).alias("t")
                       ).mapInArrow(run, f"k {kind}, h long, fp long")


def _cuts(bits: int, parts: int) -> list[tuple[int, int]]:
    """``(first bit, bits)`` of the segments."""
    ends = [bits * i // parts for i in range(parts + 1)]
    return [(a, b - a) for a, b in zip(ends, ends[1:])]


def variants(fp, first: int, bits: int, parts: int) -> list:
    """Columns: the one-wildcard signatures of ``bits`` bits of ``fp`` cut into ``parts`` segments.

    Of at most ``2 * parts - 1`` differing bits some segment has one at most, so two
    such values share a signature: the segment with the bit in question cleared.
    A signature holds the segment's number, the wildcard's place and the value.
    """
    out = []
    for s, (at, n) in enumerate(_cuts(bits, parts)):
        for w in range(n):
            mask = ((1 << n) - 1) & ~(1 << w)
            value = F.shiftrightunsigned(fp, first + at).bitwiseAND(F.lit(mask).cast("long"))
            out.append(F.lit((s << 8 | w) << 40).cast("long").bitwiseOR(value))
    return out


def _near(a: np.ndarray, b: np.ndarray, most: int) -> np.ndarray:
    return np.bitwise_count(a ^ b) <= most


def _forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that join the distinct fingerprints of a short run exactly as their links do."""
    label = np.arange(len(fp))
    near = _near(fp[:, None], fp[None, :], most)
    while True:
        new = np.where(near, label[None, :], len(fp)).min(1)
        new = new[new]
        if (new == label).all():
            break
        label = new
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[at]], fp[at]


def _cube_forest(fp: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The same for a long run whose fingerprints differ in few places, by flipping those bits.

    A run of the second cut agrees in all but 18 bits, so it has 2**18 members at
    most and each has 988 values within 3 bits: the work is in proportion to the
    members, never to their pairs.
    """
    differ = int(np.bitwise_or.reduce(fp ^ fp[0]))
    bits = [i for i in range(64) if differ >> i & 1]
    masks = [0]
    for _ in range(most):
        masks = sorted({m ^ (1 << b) for m in masks for b in bits} | set(masks))
    fp = np.sort(fp)
    label = np.arange(len(fp))
    while True:
        old = label.copy()
        for m in masks[1:]:
            other = fp ^ np.uint64(m)
            at = np.minimum(np.searchsorted(fp, other), len(fp) - 1)
            label = np.where(fp[at] == other, np.minimum(label, label[at]), label)
        label = label[label]
        if (label == old).all():
            break
    at = np.flatnonzero(label != np.arange(len(fp)))
    return fp[label[at]], fp[at]


def _runs(batches, keys: list[str]):
    """Whole runs of equal keys from sorted batches: ``(keys of rows, fp, first rows of runs)``.

    A run that goes over a batch's end waits for the next; at most one run waits.
    """
    held = None
    for b in batches:
        cols = [b.column(c).to_numpy() for c in [*keys, "fp"]]
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols)]
        n = len(cols[-1])
        if not n:
            continue
        new = np.zeros(n, bool)
        new[0] = True
        for c in cols[:-1]:
            new[1:] |= c[1:] != c[:-1]
        first = np.flatnonzero(new)
        last = first[-1]
        held = [c[last:] for c in cols]
        if len(first) > 1:
            yield [c[:last] for c in cols[:-1]], cols[-1][:last], first[:-1]
    if held is not None:
        yield held[:-1], held[-1], np.array([0])


def _link(keys: list[str], most: int, split: bool):
    """Task function: forest edges of every run; with ``split`` long runs pass on as they are."""

    def run(batches):
        for cols, fp, first in _runs(batches, keys):
            fp = fp.view(np.uint64)
            size = np.diff(np.append(first, len(fp)))
            two = first[size == 2]
            near = _near(fp[two], fp[two + 1], most)
            a, b, s = [fp[two[near]]], [fp[two[near] + 1]], [np.full(near.sum(), -1)]
            for at, n in zip(first[size > 2].tolist(), size[size > 2].tolist()):
                x = fp[at:at + n]
                if n > PAIRWISE and split:
                    s.append(cols[0][at:at + n])
                    a.append(x)
                    b.append(x)
                    continue
                p, q = _forest(x, most) if n <= PAIRWISE else _cube_forest(x, most)
                a.append(p)
                b.append(q)
                s.append(np.full(len(p), -1))
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(a).view(np.int64)), pa.array(np.concatenate(b).view(np.int64)),
                 pa.array(np.concatenate(s).astype(np.int64))], names=["a", "b", "sig"])

    return run


def links(fps: DataFrame, most: int = 3) -> DataFrame:
    """``(a, b)`` edges between distinct fingerprints whose components are those of all links.

    Every pair within ``most`` bits shares a signature and is compared in the run
    of that signature.  A run gives a spanning forest, fewer edges than members,
    so a dense group makes no pairs.  Runs of over ``PAIRWISE`` members are dealt
    out again by the one-wildcard variants of the other bits.
    """
    fp = F.col("fp")
    parts = most // 2 + 1
    sigs = fps.select("fp", F.explode(F.array(*variants(fp, 0, 64, parts))).alias("sig"))
    schema = "a long, b long, sig long"
    out = cut(sigs.repartition("sig").sortWithinPartitions("sig")
              .mapInArrow(_link(["sig"], most, True), schema))
    edges = out.where("sig = -1").select("a", "b").distinct()
    hot = out.where("sig <> -1").select(F.col("a").alias("fp"), "sig")
    if hot.limit(1).isEmpty():
        return edges
    again = None
    for s, (at, n) in enumerate(_cuts(64, parts)):  # the bits outside the run's own segment
        part = hot.where(F.shiftrightunsigned("sig", 48) == s)
        for o, (first, bits) in enumerate(_cuts(64, parts)):
            if o == s:
                continue
            more = part.select("fp", "sig", F.explode(F.array(*variants(fp, first, bits, parts))).alias("sub"))
            more = more.withColumn("sub", F.col("sub") + F.lit(o << 56).cast("long"))
            again = more if again is None else again.unionByName(more)
    deep = (again.repartition("sig", "sub").sortWithinPartitions("sig", "sub")
            .mapInArrow(_link(["sig", "sub"], most, False), schema))
    return edges.unionByName(deep.select("a", "b")).distinct()


def _classed(rows: DataFrame, most: int) -> DataFrame:
    """``rows(k, h, fp)`` with ``c``, the least fingerprint of the component, and ``component_id``."""
    classes = cut(rows.groupBy("fp").agg(F.min("k").alias("least")))
    comp = components(links(classes.select("fp"), most))
    named = classes.join(comp, classes["fp"] == comp["node"], "left").select(
        "fp", "least", F.coalesce("component", "fp").alias("c"))
    least = named.groupBy("c").agg(F.min("least").alias("component_id"))
    ids = named.join(least, "c").select(F.col("fp").alias("f_"), "c", "component_id")
    return rows.join(ids, rows["fp"] == ids["f_"]).drop("f_")


def near_duplicates(docs: DataFrame, width: int = 3, most: int = 3, seed: int = 42,
                    key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, fp, component_id``: the least key that links of at most ``most`` bits reach.

    Fingerprints are compared once however many documents share one.  Rows that
    repeat a key are kept; null keys belong to a component as others do but do not
    name it (a component of null keys only has a null id).  Null, empty and
    word-less texts share fingerprint zero.  An empty table gives no rows; other
    columns are left out.
    """
    rows = cut(fingerprints(docs, width, seed, key, text))
    return _classed(rows, most).select(F.col("k").alias(key), "fp", "component_id")


def keep_one(docs: DataFrame, width: int = 3, most: int = 3, seed: int = 42,
             key: str = "doc_id", text: str = "text") -> DataFrame:
    """Of every component the row with the least key; columns unchanged.

    Rows with a null key stay only where a component has no other.  Of rows that
    share the key and the component the one with the least text hash stays, of
    identical rows one.
    """
    rows = cut(fingerprints(docs, width, seed, key, text))
    best = (_classed(rows, most).groupBy("c")
            .agg(F.min(F.struct(F.col("k").isNull().alias("n"), "k", "h")).alias("b"))
            .select(F.col("b.k").alias("k_"), F.col("b.h").alias("h_")))
    own = "__seqmill_text_hash"
    hashed = docs.withColumn(own, F.xxhash64(F.col(text)))
    kept = hashed.join(best, hashed[own].eqNullSafe(best["h_"]) & hashed[key].eqNullSafe(best["k_"]), "left_semi")
    if not rows.groupBy("k", "h").count().where("count > 1").limit(1).isEmpty():
        kept = kept.dropDuplicates([key, own])
    return kept.drop(own)
