"""Operator 1: document quality by a regularised quadratic discriminant."""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import chunks, cut, ship, text_bytes, words

_CLASS = np.zeros((256, 6), np.int64)  # columns: upper, lower, digit, sentence mark, other symbol, beyond ASCII
for _i in range(0x21, 0x7F):
    _c = chr(_i)
    _CLASS[_i, 0 if _c.isupper() else 1 if _c.islower() else 2 if _c.isdigit() else 3 if _c in ".,;:!?'\"-()" else 4] = 1
_CLASS[0x80:, 5] = 1

FEATURES = ["log_bytes", "log_words", "log_word_length", "log_word_length_spread", "upper", "digits", "marks",
            "symbols", "beyond_ascii", "newlines", "distinct_words", "commonest_word", "repeats_next",
            "repeated_lines", "log_line_length", "short_words", "byte_entropy", "long_words"]


def _logit(x: float, n: float) -> float:
    return math.log((x + 0.5) / (max(n - x, 0) + 0.5))


def statistics(text: bytes) -> list[float]:
    """Transformed statistics of a whole text (``FEATURES``): logs of sizes, log-odds of shares.

    The empty text has well-defined values, as every share is smoothed.
    """
    by = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    upper, lower, digit, mark, symbol, high = (by @ _CLASS).tolist()
    ws = words(text.lower())
    n, nw = len(text), len(ws)
    lengths = np.fromiter(map(len, ws), np.int64, nw)
    mean = float(lengths.mean()) if nw else 0.0
    spread = float(lengths.std()) if nw else 0.0
    counts = Counter(ws)
    lines = [x for x in text.split(b"\n") if x]
    p = by[by > 0] / max(n, 1)
    return [math.log1p(n), math.log1p(nw), math.log1p(mean), math.log1p(spread),
            _logit(upper, upper + lower), _logit(digit, n), _logit(mark, n), _logit(symbol, n), _logit(high, n),
            _logit(int(by[10]), n), _logit(len(counts), nw), _logit(max(counts.values(), default=0), nw),
            _logit(sum(map(eq, ws, ws[1:])), nw), _logit(len(lines) - len(set(lines)), len(lines)),
            math.log1p(n / max(len(lines), 1)), _logit(int((lengths <= 3).sum()), nw),
            float(-(p * np.log(p)).sum()), _logit(int((lengths >= 12).sum()), nw)]


def _matrix(column: pa.Array) -> np.ndarray:
    return np.array([statistics(t.as_py()) for t in column], np.float64).reshape(-1, len(FEATURES))


def features(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``k, x``: the statistics of every whole text; null counts as empty."""
    ship(docs.sparkSession)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part in chunks(batch, "t"):
                m = _matrix(part.column("t"))
                x = pa.ListArray.from_arrays(np.arange(len(m) + 1, dtype=np.int32) * m.shape[1], pa.array(m.ravel()))
                yield pa.RecordBatch.from_arrays([part.column("k"), x], names=["k", "x"])

    return docs.select(F.col(key).alias("k"), text_bytes(text).alias("t")).mapInArrow(run, f"k {kind}, x array<double>")


@dataclass
class Discriminant:
    """Class means, inverted Cholesky factors and log determinants; ``prior`` is log odds of class 1.

    A class without training rows leaves ``mean`` unset, and the score is the
    smoothed share of class 1 for every text.
    """
    prior: float
    center: np.ndarray | None = None
    scale: np.ndarray | None = None
    mean: list | None = None
    inverse: list | None = None
    logdet: list | None = None

    def scores(self, x: np.ndarray) -> np.ndarray:
        if self.mean is None:
            return np.full(len(x), 1 / (1 + math.exp(-self.prior)))
        z = (x - self.center) / self.scale
        log_density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(1) - 0.5 * d
                       for m, inv, d in zip(self.mean, self.inverse, self.logdet)]
        odds = np.clip(self.prior + log_density[1] - log_density[0], -700, 700)
        return 1 / (1 + np.exp(-odds))


def fit(examples: DataFrame, to_pooled: float = 0.1, to_sphere: float = 0.05) -> Discriminant:
    """Fit from ``(x, label)`` with label 0 or 1 (other labels and null are left out).

    Counts, sums and products of both classes are summed in the tasks and then by
    Spark, so a few hundred numbers come to the driver whatever the input.  A class
    covariance is drawn to the pooled one by ``to_pooled`` and to a sphere of the
    same trace by ``to_sphere``; its Cholesky factor is made once.
    """
    d = len(FEATURES)

    def run(batches):
        total = np.zeros((2, 1 + d + d * d))
        for b in batches:
            if not b.num_rows:
                continue
            x = b.column("x").flatten().to_numpy().reshape(-1, d)
            y = b.column("label").to_numpy()
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(0), (z.T @ z).ravel()])
        c, i = np.divmod(np.arange(total.size), total.shape[1])
        yield pa.RecordBatch.from_arrays([pa.array(c.astype(np.int32)), pa.array(i.astype(np.int32)),
                                          pa.array(total.ravel())], names=["c", "i", "v"])

    sums = np.zeros((2, 1 + d + d * d))
    rows = (examples.where("label in (0, 1)").select("x", F.col("label").cast("int").alias("label"))
            .mapInArrow(run, "c int, i int, v double").groupBy("c", "i").agg(F.sum("v").alias("v")))
    for r in rows.collect():
        sums[r["c"], r["i"]] = r["v"]
    n = sums[:, 0]
    prior = math.log((n[1] + 1) / (n[0] + 1))
    if n.min() < 2:
        return Discriminant(prior)
    s, ss = sums[:, 1:1 + d], sums[:, 1 + d:].reshape(2, d, d)
    center = s.sum(0) / n.sum()
    scale = np.sqrt(np.maximum(ss.sum(0).diagonal() / n.sum() - center ** 2, 1e-9))
    mean = [(s[c] / n[c] - center) / scale for c in (0, 1)]
    cov = [(ss[c] / n[c] - np.outer(s[c], s[c]) / n[c] ** 2) / np.outer(scale, scale) for c in (0, 1)]
    pooled = (n[0] * cov[0] + n[1] * cov[1]) / n.sum()
    inverse, logdet = [], []
    for c in (0, 1):
        m = (1 - to_pooled) * cov[c] + to_pooled * pooled
        m = (1 - to_sphere) * m + (to_sphere * np.trace(m) / d + 1e-9) * np.eye(d)
        factor = np.linalg.cholesky(m)
        inverse.append(np.linalg.inv(factor))
        logdet.append(2 * float(np.log(factor.diagonal()).sum()))
    return Discriminant(prior, center, scale, mean, inverse, logdet)


def is_held_out(key: str, mod: int = 3, rest: int = 1):
    """crc32 of the key as text leaves ``rest``; a null key counts as the empty text."""
    return F.crc32(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")) % mod == rest


def train(rows: DataFrame, labels: DataFrame, key: str = "doc_id", label: str = "quality", **shrinkage) -> Discriminant:
    """Fit on the labelled rows of ``features`` outside the held-out fold.

    Null labels and labels without a document are left out; a document with
    several label rows counts with each.
    """
    y = labels.select(F.col(key).alias("k_"), F.col(label).alias("label")).where("k_ is not null")
    pairs = rows.where(~is_held_out("k")).join(y, F.col("k") == F.col("k_")).select("x", "label")
    return fit(pairs, **shrinkage)


def quality(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text",
            label: str = "quality", **shrinkage) -> DataFrame:
    """``key, held_out, score, predicted`` of every row of ``docs``.

    Null and empty texts have the score of an empty text; repeated rows score
    alike; without labels of both classes every score is the prior; an empty table
    gives no rows; other columns are left out.
    """
    rows = cut(features(docs, key, text))
    model = rows.sparkSession.sparkContext.broadcast(train(rows, labels, key, label, **shrinkage))

    def run(batches):
        for b in batches:
            x = b.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("k"), pa.array(model.value.scores(x))], names=["k", "score"])

    kind = docs.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"k {kind}, score double").select(
        F.col("k").alias(key), is_held_out("k").alias("held_out"), "score",
        F.when(F.col("score") >= 0.5, 1).otherwise(0).alias("predicted"))


def accepted(docs: DataFrame, labels: DataFrame, least: float = 0.5, key: str = "doc_id", text: str = "text",
             label: str = "quality", **shrinkage) -> DataFrame:
    """The rows whose score is at least ``least``, columns unchanged, nothing shuffled but statistics."""
    rows = cut(features(docs, key, text))
    model = rows.sparkSession.sparkContext.broadcast(train(rows, labels, key, label, **shrinkage))

    own = "__seqmill_text_bytes"

    def run(batches):
        for batch in batches:
            for part in chunks(batch, own):
                good = model.value.scores(_matrix(part.column(own))) >= least
                yield part.drop_columns([own]).filter(pa.array(good))

    return docs.withColumn(own, text_bytes(text)).mapInArrow(run, docs.schema)
