"""Operator 7: near-duplicate vectors by cross-polytope hashing after fast Hadamard rotations."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.llm.common import cut, ship, written
from seqmill.llm.components import components


@dataclass(frozen=True)
class Hashing:
    """``tables`` keys of ``functions`` hashes each; a vector also goes to the keys of ``probes`` - 1
    next likely codes of every table.  A hash is the axis nearest to the rotated vector."""
    tables: int = 4
    functions: int = 3
    probes: int = 4
    seed: int = 7

    def keys(self, unit: np.ndarray, group: np.ndarray) -> np.ndarray:
        """``(rows, tables * probes)`` unsigned 64-bit keys of unit vectors; keys of different groups differ."""
        n, d = unit.shape
        width = 1 << max(0, (d - 1).bit_length())
        padded = np.zeros((n, width))
        padded[:, :d] = unit
        rng = np.random.default_rng([self.seed, width])
        out = []
        for t in range(self.tables):
            best, second, gap = [], [], []
            for _ in range(self.functions):
                y = padded
                for _ in range(3):  # sign flips and a Hadamard transform, three times
                    y = hadamard(y * rng.choice([-1.0, 1.0], width))
                size = np.abs(y)
                rows = np.arange(n)
                a = size.argmax(1)
                top = size[rows, a]
                size[rows, a] = -1
                b = size.argmax(1)
                best.append(2 * a + (y[rows, a] < 0))
                second.append(2 * b + (y[rows, b] < 0))
                gap.append(top - size[rows, b])
            best, second, gap = (np.array(x).T.reshape(n, self.functions) for x in (best, second, gap))
            order = gap.argsort(1, kind="stable")  # the function that is nearest to another code is changed first
            for p in range(self.probes):
                code = best.copy()
                if p:
                    at = order[:, (p - 1) % self.functions]
                    code[np.arange(n), at] = second[np.arange(n), at]
                h = np.full(n, t + 1, np.uint64)
                for c in [group, *code.T]:
                    h = _mix(h ^ c.astype(np.int64).astype(np.uint64))
                out.append(h)
        return np.array(out).T.reshape(n, self.tables * self.probes)


def _mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit mixing step (multiply and shift)."""
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    return (h ^ (h >> np.uint64(29))) * np.uint64(0xD6E8FEB86659FD93)


def hadamard(x: np.ndarray) -> np.ndarray:
    """Fast Walsh-Hadamard transform of the rows (width a power of two), kept orthonormal."""
    n, d = x.shape
    step = 1
    while step < d:
        y = x.reshape(n, d // (2 * step), 2, step)
        x = np.stack([y[:, :, 0] + y[:, :, 1], y[:, :, 0] - y[:, :, 1]], 2).reshape(n, d)
        step *= 2
    return x / np.sqrt(d)


def _unit(vec: list[bytes]) -> np.ndarray:
    x = np.frombuffer(b"".join(vec), "<f8").reshape(len(vec), -1)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def vectors(rows: DataFrame, key: str, vector: str, label: str) -> DataFrame:
    """``k, label, uid, vec``: uid names the label and the vector (null where it can't link), vec its doubles."""
    ship(rows.sparkSession)
    kind = rows.schema[key].dataType.simpleString()

    def run(batches):
        for b in batches:
            uid, vec = [], []
            for y, v in zip(b.column("label").to_pylist(), b.column("v").to_pylist()):
                x = None
                if y is not None and v and None not in v:
                    x = np.array(v, "<f8") + 0.0  # one zero
                    x = x if np.isfinite(x).all() and x.any() else None
                # scaled by the largest component, so no square leaves the range
                uid.append(None if x is None else hashlib.blake2b(f"{y}:".encode() + x.tobytes(), digest_size=16).digest())
                vec.append(None if x is None else (x / np.abs(x).max()).tobytes())
            yield pa.RecordBatch.from_arrays([b.column("k"), b.column("label"), pa.array(uid, pa.binary()),
                                              pa.array(vec, pa.binary())], names=["k", "label", "uid", "vec"])

    return rows.select(F.col(key).alias("k"), F.col(label).cast("long").alias("label"), F.col(vector).alias("v")
                       ).mapInArrow(run, f"k {kind}, label long, uid binary, vec binary")


def _by_width(label: np.ndarray, vec: list[bytes], scheme: Hashing) -> list[np.ndarray]:
    """Keys of vectors that may have different lengths; vectors of different lengths share no key."""
    out: list = [None] * len(vec)
    width = np.array([len(v) for v in vec])
    for w in np.unique(width):
        at = np.flatnonzero(width == w)
        keys = scheme.keys(_unit([vec[i] for i in at]), _mix(label[at].astype(np.uint64) + np.uint64(w) * np.uint64(1 << 40)))
        for i, k in zip(at, keys):
            out[i] = k
    return out


def _compare(rows, i: int, j: int, key: int, least: float, scheme: Hashing):
    """Links of one run: ``(uid, links found here)`` and a spanning forest ``(uid, uid)``.

    A pair that shares several keys counts in the run of the least of them.
    """
    by_kind: dict[tuple, list] = {}
    for r in rows:
        by_kind.setdefault((r["label"], len(r["vec"])), []).append(r)
    counts, forest = [], []
    for (label, _), part in by_kind.items():
        if len(part) < 2:
            continue
        part.sort(key=lambda r: r["uid"])
        x = _unit([r["vec"] for r in part])
        size = np.array([r["size"] for r in part], np.int64)
        mine = np.array([r["block"] for r in part])
        near = x @ x.T >= least
        np.fill_diagonal(near, False)
        if i != j:
            near &= mine[:, None] != mine[None, :]
        near |= near.T
        if not near.any():
            continue
        keys = _by_width(np.full(len(part), label), [r["vec"] for r in part], scheme)
        smaller = [k[k < np.uint64(key & (1 << 64) - 1)] for k in keys]
        names, flat = np.unique(np.concatenate(smaller), return_inverse=True)
        has = np.zeros((len(part), len(names)), np.float32)
        has[np.repeat(np.arange(len(part)), [len(s) for s in smaller]), flat] = 1
        first = near & (has @ has.T == 0)
        links = first @ size
        counts += [(part[a]["uid"], int(links[a])) for a in np.flatnonzero(links)]
        label_of = np.arange(len(part))
        while True:
            new = np.minimum(label_of, np.where(near, label_of[None, :], len(part)).min(1))
            new = new[new]
            if (new == label_of).all():
                break
            label_of = new
        forest += [(part[label_of[a]]["uid"], part[a]["uid"]) for a in np.flatnonzero(label_of != np.arange(len(part)))]
    return counts, forest


def near_vectors(rows: DataFrame, least: float = 0.98, scheme: Hashing = Hashing(), block: int = 1024,
                 key: str = "vec_id", vector: str = "embedding", label: str = "label") -> DataFrame:
    """``key, n_links, component_id, kept`` of every row: vectors of one label with cosine >= ``least`` link.

    Equal vectors are one class, so copies cost nothing more.  Keys of class
    representatives are counted first and only keys that two share go on with the
    vectors.  A run of more than ``block`` members is dealt out as pairs of blocks,
    each compared as a matrix product in double precision; a run returns sums of
    links and a spanning forest, never its pairs.

    Rows whose label or vector is null, or whose vector is empty, zero or has null
    or non-finite components, link with nothing and are their own component.
    Vectors of different lengths don't link.  Rows that repeat an id count as other vectors.
    A null id names no component unless nothing else is in it.  An empty table gives no rows;
    other columns are left out.
    """
    members = written(vectors(rows, key, vector, label), "vectors")
    reps = written(members.where("uid is not null").groupBy("uid").agg(
        F.min("k").alias("least"), F.count("*").alias("size"), F.first("label").alias("label"),
        F.first("vec").alias("vec")), "vector-classes")

    def hashed(batches):
        for b in batches:
            if not b.num_rows:
                continue
            keys = _by_width(b.column("label").to_numpy(), b.column("vec").to_pylist(), scheme)
            keys = [np.unique(k) for k in keys]
            at = np.repeat(np.arange(len(keys)), [len(k) for k in keys])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys).view(np.int64)),
                                              b.column("uid").take(pa.array(at))], names=["key", "uid"])

    keys = cut(reps.select("label", "vec", "uid").mapInArrow(hashed, "key long, uid binary"))
    shared = keys.groupBy("key").count().where("count > 1").select(
        F.col("key").alias("k_"), F.ceil(F.col("count") / block).cast("int").alias("blocks"))
    dealt = keys.join(shared, F.col("key") == F.col("k_")).withColumn(
        "block", F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int"))
    dealt = dealt.select("key", "uid", "block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o"))
    dealt = dealt.select("key", "block", F.least("block", "o").alias("i"), F.greatest("block", "o").alias("j"),
                         F.col("uid").alias("u_"))
    full = dealt.join(reps.select("uid", "label", "size", "vec"), F.col("u_") == F.col("uid")).drop("u_")

    def compare(batches):
        run, name = [], None
        for b in batches:
            counts, forest = [], []
            for r in b.to_pylist():
                if (r["key"], r["i"], r["j"]) != name:
                    if len(run) > 1:
                        c, f = _compare(run, name[1], name[2], name[0], least, scheme)
                        counts += c
                        forest += f
                    run, name = [], (r["key"], r["i"], r["j"])
                run.append(r)
            yield _found(counts, forest)
        if len(run) > 1:
            yield _found(*_compare(run, name[1], name[2], name[0], least, scheme))

    found = cut(full.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
                .mapInArrow(compare, "a binary, b binary, links long"))
    comp = components(found.where("b is not null").select("a", "b"))
    degree = found.where("b is null").groupBy(F.col("a").alias("d_")).agg(F.sum("links").alias("links"))
    named = reps.select("uid", "least", "size").join(comp, F.col("uid") == F.col("node"), "left").withColumn(
        "c", F.coalesce("component", "uid")).drop("node", "component")
    ids = named.groupBy("c").agg(F.min("least").alias("component_id"))
    named = named.join(ids, "c").join(degree, F.col("uid") == F.col("d_"), "left").select(
        F.col("uid").alias("u_"), "component_id", (F.col("size") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    out = members.select("k", "uid").join(named, F.col("uid") == F.col("u_"), "left")
    component = F.when(F.col("u_").isNull(), F.col("k")).otherwise(F.col("component_id"))
    return out.select(F.col("k").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
                      component.alias("component_id"), F.col("k").eqNullSafe(component).alias("kept"))


def _found(counts, forest) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([c[0] for c in counts] + [f[0] for f in forest], pa.binary()),
         pa.array([None] * len(counts) + [f[1] for f in forest], pa.binary()),
         pa.array([c[1] for c in counts] + [0] * len(forest), pa.int64())], names=["a", "b", "links"])
