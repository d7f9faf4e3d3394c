"""Operator 3: best-fit packing with exact-complement hashing."""

from __future__ import annotations

import zlib
from bisect import bisect_left

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, cut, ship, small, text_bytes
from seqmill.llm.tokens import encoder


def pieces(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
           key: str = "doc_id", text: str = "text") -> DataFrame:
    """Each document's token ids and the end id, cut into pieces of ``capacity`` where longer.

    ``doc_id, piece, start, length, ids_crc32``; null text counts as empty (the end id alone).
    """
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        enc = encoder(tokenizer_path)
        for batch in batches:
            for part in chunks(batch, "t", 4 << 20):
                all_ids, bounds = enc.texts(part.column("t"), end_id)
                bounds = bounds.tolist()
                src, no, start, length, crc = [], [], [], [], []
                for i, (first, end) in enumerate(zip(bounds, bounds[1:])):
                    for p, at in enumerate(range(first, end, capacity)):
                        cutout = all_ids[at:min(at + capacity, end)]
                        src.append(i)
                        no.append(p)
                        start.append(at - first)
                        length.append(len(cutout))
                        crc.append(zlib.crc32(cutout))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k").take(pa.array(src, pa.int64())), pa.array(no, pa.int32()),
                     pa.array(start, pa.int64()), pa.array(length, pa.int64()), pa.array(crc, pa.int64())],
                    names=["k", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col(key).alias("k"), text_bytes(text).alias("t")).mapInArrow(
        run, f"k {kind}, piece int, start long, length long, ids_crc32 long")


class _Stock:
    """Counts of lengths, and the search for combinations that fill a gap exactly."""

    def __init__(self, counts: np.ndarray):
        self.n = counts  # n[length]
        self.dead: set[tuple[int, int]] = set()  # (parts, gap) without a combination: stock only shrinks

    def single(self, gap: int) -> tuple[int, ...] | None:
        return (gap,) if gap > 0 and self.n[gap] > 0 else None

    def pair(self, gap: int) -> tuple[int, ...] | None:
        """The two lengths with the given sum that are there most often."""
        if gap < 2 or (2, gap) in self.dead:
            return None
        low = np.arange(1, gap // 2 + 1)
        both = np.minimum(self.n[low], self.n[gap - low])
        if gap % 2 == 0:
            both[-1] = self.n[gap // 2] // 2
        at = int(both.argmax())
        if both[at] <= 0:
            self.dead.add((2, gap))
            return None
        return gap - int(low[at]), int(low[at])

    def triple(self, gap: int) -> tuple[int, ...] | None:
        if gap < 3 or (3, gap) in self.dead:
            return None
        have = np.flatnonzero(self.n[:gap - 1])
        for b in have[::-1].tolist():
            self.n[b] -= 1
            rest = self._pair_now(gap - b)
            self.n[b] += 1
            if rest:
                return b, *rest
        self.dead.add((3, gap))
        return None

    def _pair_now(self, gap: int) -> tuple[int, ...] | None:
        """``pair`` while one length is on loan: a failure is not remembered."""
        if gap < 2 or (2, gap) in self.dead:
            return None
        low = np.arange(1, gap // 2 + 1)
        both = np.minimum(self.n[low], self.n[gap - low])
        if gap % 2 == 0:
            both[-1] = self.n[gap // 2] // 2
        at = int(both.argmax())
        return (gap - int(low[at]), int(low[at])) if both[at] > 0 else None

    def times(self, lengths: tuple[int, ...]) -> int:
        return min(int(self.n[x]) // lengths.count(x) for x in set(lengths))

    def take(self, lengths: tuple[int, ...], m: int) -> None:
        for x in lengths:
            self.n[x] -= m


def plan_patterns(counts: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Sequences as ``(lengths, how many alike)`` from ``counts[length]``, length 1..capacity.

    Exact phase: from the longest length down, its gap is filled by one, two or
    three stocked lengths with exactly that sum, as often as the counts allow; each
    round uses up a length, so there are about as many patterns as lengths.  What
    is left goes largest first into the fullest sequence that still takes it.
    """
    stock, out = _Stock(counts.copy()), []
    if stock.n[capacity]:
        out.append(((capacity,), int(stock.n[capacity])))
        stock.n[capacity] = 0
    for a in range(capacity - 1, 0, -1):
        while stock.n[a]:
            gap = capacity - a
            stock.n[a] -= 1  # the piece itself is not its own complement
            rest = stock.single(gap) or stock.pair(gap) or stock.triple(gap)
            stock.n[a] += 1
            if rest is None:
                break
            lengths = (a, *rest)
            m = stock.times(lengths)
            stock.take(lengths, m)
            out.append((lengths, m))
    return out + _best_fit(stock.n, capacity)


def _best_fit(n: np.ndarray, capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing over counts: sequences with equal content move as one group."""
    open_by_gap: dict[int, list[list]] = {}
    gaps: list[int] = []  # sorted gaps of open groups

    def put(lengths: tuple[int, ...], m: int, gap: int) -> None:
        if gap not in open_by_gap:
            gaps.insert(bisect_left(gaps, gap), gap)
            open_by_gap[gap] = []
        open_by_gap[gap].append([lengths, m])

    for a in range(capacity, 0, -1):
        left = int(n[a])
        while left:
            at = bisect_left(gaps, a)
            if at == len(gaps):
                each = capacity // a
                full, part = divmod(left, each)
                if full:
                    put((a,) * each, full, capacity - a * each)
                if part:
                    put((a,) * part, 1, capacity - a * part)
                left = 0
                continue
            gap = gaps[at]
            lengths, m = open_by_gap[gap].pop()
            if not open_by_gap[gap]:
                del open_by_gap[gap], gaps[at]
            # a group takes as many each as fit, before the next group is opened
            each = min(gap // a, max(1, left // m))
            if left < m:
                put(lengths, m - left, gap)
                m, each = left, 1
            put(lengths + (a,) * each, m, gap - a * each)
            left -= m * each
    return [(tuple(x), m) for groups in open_by_gap.values() for x, m in groups]


def _slots(patterns, capacity: int) -> dict[str, np.ndarray]:
    """For each run of equal places (length, ranks from ``rank``): first sequence id and offset."""
    rows, used, seq = [], np.zeros(capacity + 1, np.int64), 0
    for lengths, m in patterns:
        offset = 0
        for x in lengths:
            rows.append((x, int(used[x]), seq, offset))
            used[x] += m
            offset += x
        seq += m
    rows.sort()
    a = np.array(rows, np.int64).reshape(-1, 4)
    return {"length": a[:, 0], "rank": a[:, 1], "seq": a[:, 2], "offset": a[:, 3]}


def place(items: DataFrame, capacity: int, order: list[str], salts: int = 256) -> DataFrame:
    """Give every row (column ``length``, 1..capacity) a ``sequence_id`` and an ``offset``.

    Rows of one length are interchangeable, so the plan is made from the counts of
    the lengths alone: at most ``capacity`` numbers come to the driver, at any
    size of the input.  A row's number within its length is its place within
    (length, salt) after the salts before it, so a very common length is spread
    over ``salts`` groups.  The plan that goes to the tasks has a row for each
    place of a pattern.
    """
    ship(items.sparkSession)
    salted = items.withColumn("salt_", F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    by = salted.groupBy("length", "salt_").count()
    by = cut(by)  # at most capacity * salts rows
    counts = np.zeros(capacity + 1, np.int64)
    for r in by.groupBy("length").agg(F.sum("count").alias("n")).collect():
        counts[r["length"]] = r["n"]
    slots = _slots(plan_patterns(counts, capacity), capacity)
    before = by.select(F.col("length").alias("l_"), F.col("salt_").alias("s_"),
                       F.coalesce(F.sum("count").over(Window.partitionBy("length").orderBy("salt_").rowsBetween(
                           Window.unboundedPreceding, -1)), F.lit(0)).alias("before_"))
    ranked = salted.withColumn("n_", F.row_number().over(Window.partitionBy("length", "salt_").orderBy(*order)))
    ranked = ranked.join(before, (F.col("length") == F.col("l_")) & (F.col("salt_") == F.col("s_")))
    ranked = ranked.withColumn("rank_", F.col("before_") + F.col("n_") - 1).drop("l_", "s_", "salt_", "before_", "n_")
    plan = items.sparkSession.sparkContext.broadcast(slots)
    out = pa.schema([("sequence_id", pa.int64()), ("offset", pa.int64())])

    def run(batches):
        p = plan.value
        ends = np.searchsorted(p["length"], np.arange(capacity + 2))
        span = 1 << 42  # ranks stay below
        at_key = p["length"] * span + p["rank"]
        for b in batches:
            length = b.column("length").to_numpy()
            rank = b.column("rank_").to_numpy()
            at = np.searchsorted(at_key, length * span + rank, side="right") - 1
            assert len(at) == 0 or (at >= ends[length]).all()
            seq = p["seq"][at] + rank - p["rank"][at]
            keep = [c for c in b.schema.names if c != "rank_"]
            yield pa.RecordBatch.from_arrays([*[b.column(c) for c in keep], pa.array(seq, out.field(0).type),
                                              pa.array(p["offset"][at], out.field(1).type)],
                                             names=[*keep, "sequence_id", "offset"])

    kinds = ", ".join(f"`{n}` {t}" for n, t in ranked.dtypes if n != "rank_")
    return ranked.mapInArrow(run, f"{kinds}, sequence_id long, offset long")


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 4096, end_id: int = 1,
         key: str = "doc_id", text: str = "text") -> DataFrame:
    """Pack tokenised documents into sequences of at most ``capacity`` tokens.

    One row a piece: ``key, piece, start, length, ids_crc32, sequence_id, offset``.
    Null and empty texts are one end id.  Repeated rows are packed each for itself.
    A null key is kept.  An empty table gives no rows.  Other columns are left out.
    The texts are read once; only piece lengths and checksums go on.
    """
    rows = cut(pieces(docs, tokenizer_path, capacity, end_id, key, text))
    placed = place(rows, capacity, ["k", "piece", "ids_crc32"])
    return placed.select(F.col("k").alias(key), "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
