"""Batch embedding with a caller's model, and its checks."""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from seqmill.session import ship


def strip_boundary(vectors: DataFrame, key: list[str]) -> DataFrame:
    """Drop the first and the last place of each key's vectors and number the rest from 0."""
    # the table of ends has a row a key and is the one that is hashed: vectors dealt out by key are neither sorted nor shuffled
    n = vectors.groupBy(*key).agg(F.max("pos").alias("_n")).hint("shuffle_hash")
    return vectors.join(n, key).where((F.col("pos") > 0) & (F.col("pos") < F.col("_n"))).withColumn(
        "pos", F.col("pos") - 1).drop("_n")


def select_layers(vectors: DataFrame, layers: list[int] | None = None) -> DataFrame:
    """Rows of the layers asked for; by default of the last layer there is."""
    if layers is None:
        last = vectors.agg(F.max("layer")).first()[0]
        layers = [] if last is None else [last]
    return vectors.where(F.col("layer").isin(*layers)) if layers else vectors.limit(0)


def embed_sequences(seqs: DataFrame, make_predict: Callable[[], Callable], layers: list[int] | None = None,
                    batch: int = 16, done: DataFrame | None = None, max_len: int | None = None,
                    strip: bool = True) -> tuple[DataFrame, DataFrame]:
    """M1: (vectors, errors) of ``seqs(seq_id, seq_str)``.

    ``make_predict()`` runs once in each worker task and returns ``predict(list of str)`` ->
    a list of ``{layer: array (L + 2, D)}``.  The first and last rows (boundary tokens)
    are dropped, the layers asked for (default: the last) pooled to their mean;
    without ``strip`` the boundary rows count in the mean, and ``n`` counts them too.
    ``vectors(seq_id, layer, n, vec)``; ``errors(seq_id, message)`` has sequences that
    are null, empty, longer than ``max_len``, whose row count is not their length (Q1), or on which the model
    failed; the others of a failing batch are tried one by one.  Ids in ``done`` are skipped, so a
    stopped job goes on where it was.
    """
    from seqmill.session import cut

    ship(seqs.sparkSession)
    todo = seqs.select("seq_id", "seq_str")
    if done is not None:
        todo = todo.join(done.select("seq_id").distinct(), "seq_id", "left_anti")

    def pooled(seq, by_layer):
        wanted = [max(by_layer)] if layers is None else layers
        for layer in wanted:
            m = np.asarray(by_layer[layer])
            if len(m) - 2 != len(seq):
                raise ValueError(f"{max(len(m) - 2, 0)} vectors for {len(seq)} residues")
            m = m[1:-1] if strip else m
            yield layer, len(m), m.mean(0, dtype=np.float64).tolist()

    def run(frames):
        predict = make_predict()
        for pdf in frames:
            out = []
            ok = []
            for i, s in zip(pdf["seq_id"], pdf["seq_str"]):
                why = "no sequence" if not s else f"longer than {max_len}" if max_len and len(s) > max_len else None
                if why:
                    out.append((i, None, None, None, why))
                else:
                    ok.append((i, s))
            ok.sort(key=lambda x: len(x[1]))
            for at in range(0, len(ok), batch):
                part = ok[at:at + batch]
                try:
                    got = predict([s for _, s in part])
                except Exception:  # one sequence of the batch may be the cause
                    got = None
                for n, (i, s) in enumerate(part):
                    try:
                        by_layer = got[n] if got is not None else predict([s])[0]
                        out += [(i, *row, None) for row in pooled(s, by_layer)]
                    except Exception as e:
                        out.append((i, None, None, None, f"{type(e).__name__}: {e}"))
            yield pd.DataFrame(out, columns=["seq_id", "layer", "n", "vec", "message"]).astype(
                {"layer": "Int32", "n": "Int64"})

    rows = cut(todo.mapInPandas(run, "seq_id string, layer int, n long, vec array<double>, message string"))
    return (rows.where("message is null").drop("message"),
            rows.where("message is not null").select("seq_id", "message"))


def embed_into(seqs: DataFrame, make_predict: Callable[[], Callable], folder: str, chunks: int = 4, **options) -> tuple[DataFrame, DataFrame]:
    """M1 with its own sink: (vectors, errors) that ``folder`` holds after ``embed_sequences`` of all ``seqs`` that it lacks.

    Ids are dealt into ``chunks`` by hash and each chunk is one commit of vectors and errors, so a job that is stopped keeps its
    finished chunks, and a later one goes on with the ids that no commit has.  Ids with an error are not tried again.
    What is missing is found from ids alone: the sequences of a chunk that is all done are not made again, and only those of
    a chunk that is done in part are shuffled to be told apart.
    """
    from seqmill.sources.commits import commit, committed

    spark = seqs.sparkSession
    for c in range(chunks):
        mine = F.pmod(F.xxhash64("seq_id"), F.lit(chunks)) == c
        part, done = seqs.where(mine), committed(spark, folder)
        done = None if done is None else done.where(mine)
        if done is not None and done.isEmpty():
            done = None
        elif done is not None and part.select("seq_id").join(done.select("seq_id"), "seq_id", "left_anti").isEmpty():
            continue
        vectors, errors = embed_sequences(part, make_predict, done=done, **options)
        rows = vectors.withColumn("message", F.lit(None).cast("string")).unionByName(errors, allowMissingColumns=True)
        if not rows.isEmpty():
            commit(rows, folder)
    rows = committed(spark, folder)
    if rows is None:
        rows = spark.createDataFrame([], "seq_id string, layer int, n long, vec array<double>, message string, commit string")
    return (rows.where("message is null").select("seq_id", "layer", "n", "vec"),
            rows.where("message is not null").select("seq_id", "message"))


def kmer_embed(seqs: DataFrame, k: int = 3, dim: int = 64) -> DataFrame:
    """M2: (seq_id, dim, value): hashed k-mer counts of whole sequences, scaled to unit length, in long form
    (only places that aren't zero)."""
    ship(seqs.sparkSession)
    kind = dict(seqs.dtypes)["seq_id"]

    def run(batches):
        known: dict[str, int] = {}
        for b in batches:
            for at in range(0, b.num_rows, 64):
                part = b.slice(at, 64)
                row, d, c = _kmer_counts(part.column("seq_str").to_pylist(), k, dim, known)
                yield pa.RecordBatch.from_arrays([part.column("seq_id").take(pa.array(row)), pa.array(d.astype(np.int32)),
                                                  pa.array(c.astype(np.int64))], names=["seq_id", "dim", "c"])

    x = seqs.where(F.col("seq_id").isNotNull() & (F.length("seq_str") >= k)).select("seq_id", "seq_str")
    x = _dealt(x).mapInArrow(run, f"seq_id {kind}, dim int, c long")  # k-mers are counted before anything is shuffled
    x = x.repartition("seq_id").groupBy("seq_id", "dim").agg(F.sum("c").alias("c"))
    norm = F.sqrt(F.sum(F.col("c").cast("double") * F.col("c")).over(Window.partitionBy("seq_id")))  # at most dim rows
    return x.select("seq_id", "dim", (F.col("c") / norm).alias("value"))


def _kmer_counts(texts: list[str], k: int, dim: int, known: dict[str, int]):
    """(row, dim, count), only counts that aren't zero: k-mers are numbers of the letters that occur, each hashed once."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    size = np.array([len(t) for t in texts])
    rows = np.repeat(np.arange(len(texts)), size)
    there = np.zeros(int(codes.max()) + 1, bool)
    there[codes] = True
    letters, number = np.flatnonzero(there), np.cumsum(there) - 1
    letter = number[codes]
    windows = len(codes) - k + 1
    key, first = np.zeros(windows, np.int64), np.zeros(1, np.int64)
    names = [""]  # the k-mers so far, by number
    for i in range(k):
        key = key * len(letters) + letter[i:i + windows]
        first = np.unique(key) if len(names) * len(letters) > 1 << 20 else np.flatnonzero(np.bincount(key))
        names = [names[n // len(letters)] + chr(letters[n % len(letters)]) for n in first.tolist()]
        key = np.searchsorted(first, key) if len(names) > 1 << 20 else _renumbered(key, first)
    inside = rows[:windows] == rows[k - 1:]
    if len(known) > 1 << 20:
        known.clear()
    for w in names:
        if w not in known:
            known[w] = int(hashlib.md5(w.encode()).hexdigest()[:8], 16) % dim
    place = rows[:windows][inside] * dim + np.array([known[w] for w in names])[key[inside]]
    counts = np.bincount(place, minlength=1)
    at = np.flatnonzero(counts)
    return at // dim, at % dim, counts[at]


def _renumbered(key: np.ndarray, first: np.ndarray) -> np.ndarray:
    table = np.zeros(int(first[-1]) + 1, np.int64)
    table[first] = np.arange(len(first))
    return table[key]


def _dealt(seqs: DataFrame) -> DataFrame:
    """Sequences dealt out by id before they become rows a letter (their file may be a single split)."""
    spark = seqs.sparkSession
    return seqs.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "seq_id")


def explode_residues(seqs: DataFrame) -> DataFrame:
    """M6: (seq_id, pos, aa) of every residue, dealt out by sequence; an empty sequence has none."""
    x = _dealt(seqs.where(F.length("seq_str") > 0).select("seq_id", "seq_str"))
    return x.select("seq_id", F.posexplode(F.split("seq_str", "")).alias("pos", "aa"))


def check_lengths(seqs: DataFrame, vectors: DataFrame) -> DataFrame:
    """Sequences with vectors of a model whose number is not their length: (model, seq_id, seq_len, n_vectors)."""
    n = vectors.groupBy("model", "seq_id").agg(F.count(F.lit(1)).alias("n_vectors"))
    s = seqs.select("seq_id", F.length("seq_str").alias("seq_len"))
    return n.join(s, "seq_id").where(F.col("n_vectors") != F.col("seq_len")).select("model", "seq_id", "seq_len", "n_vectors")


def missing_vectors(seqs: DataFrame, vectors: DataFrame, models) -> DataFrame:
    """Q5: (seq_id, model) of sequences without any vector of a model."""
    have = vectors.select("seq_id", "model").distinct()
    want = seqs.select("seq_id", F.explode(F.array(*[F.lit(m) for m in models])).alias("model"))
    return want.join(have, ["seq_id", "model"], "left_anti")
