"""Sinks under failures: nothing of a failed job is seen, nothing is there twice."""

import hashlib
import os
import uuid

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.operators import embed as EM
from seqmill.sources import files as FS


def test_failed_and_repeated_writes_of_matrices(spark, tmp_path):
    folder = f"file://{tmp_path}/npy"
    rows = [("m/1", f"s {i}", [[float(i), 1.0], [2.0, 3.0]]) for i in range(20)]
    df = spark.createDataFrame(rows, "model string, seq_id string, rows array<array<double>>").repartition(4)
    # ragged rows can't be stored: the job dies after other tasks have written files
    broken = df.unionByName(spark.createDataFrame([("m/1", "bad", [[1.0], [1.0, 2.0]])], df.schema))
    with pytest.raises(Exception):
        FS.write_npy(broken, folder)
    assert FS.read_committed_npy(spark, folder).count() == 0
    FS.write_npy(df, folder)
    FS.write_npy(df.where("seq_id < 's 2'").withColumn("rows", F.expr("array(array(9D))")), folder)
    got = {}
    for r in FS.read_committed_npy(spark, folder).collect():
        got.setdefault((r.model, r.seq_id), {})[r.pos] = list(r.vec)
    assert set(got) == {(m, s) for m, s, _ in rows}
    assert all(got[m, s] == ({0: [9.0]} if s < "s 2" else {0: v[0], 1: v[1]}) for m, s, v in rows)


def test_results_have_one_header_and_no_repeats(spark, tmp_path):
    path = f"{tmp_path}/results"
    a = spark.createDataFrame([(1, "x\ty", None), (2, "", 0.5)], "k int, t string, v double").repartition(2)
    FS.append_results(a, path, "one")
    FS.append_results(a, path, "one")
    FS.append_results(a.withColumn("k", F.col("k") + 10), path)
    os.remove(f"{path}/commits/{FS.append_results(a, path, 'stopped')}/_SUCCESS")
    got = sorted((r.k, r.v) for r in FS.read_results(spark, path, "v double, k int").collect())
    assert got == [(1, None), (2, 0.5), (11, None), (12, 0.5)]
    heads = [line for d, _, fs in os.walk(path) for f in fs if f.startswith("part") for line in open(f"{d}/{f}") if line.startswith("k\t")]
    assert heads == ["k\tt\tv\n"]
    assert FS.read_results(spark, f"{tmp_path}/none", "k int").count() == 0


def test_embedding_job_goes_on_where_it_was_stopped(spark, tmp_path):
    folder, log = f"{tmp_path}/emb", f"{tmp_path}/log"
    os.makedirs(log)
    seqs = spark.createDataFrame([(f"s{i}", "A" * (i % 7)) for i in range(40)], "seq_id string, seq_str string").repartition(3)

    def make(stop):
        def start():
            def predict(texts):
                if stop and len(os.listdir(log)) > 8:
                    os._exit(1)  # the worker is lost
                for t in texts:
                    open(f"{log}/{os.getpid()}-{len(os.listdir(log))}", "w").close()
                return [{1: np.ones((len(t) + 2, 2))} for t in texts]
            return predict
        return start

    with pytest.raises(Exception):
        EM.embed_into(seqs, make(True), folder, chunks=6, batch=1)
    from seqmill.sources.commits import committed
    before = committed(spark, folder)
    kept = {r.seq_id for r in before.collect()} if before is not None else set()
    for name in os.listdir(log):
        os.replace(f"{log}/{name}", f"{tmp_path}/{name}")
    v, e = EM.embed_into(seqs, make(False), folder, chunks=6, batch=1)
    ids = [r.seq_id for r in v.collect()]
    assert sorted(ids) == sorted(f"s{i}" for i in range(40) if i % 7) and {r.seq_id for r in e.collect()} == {f"s{i}" for i in range(0, 40, 7)}
    assert len(os.listdir(log)) == len(set(ids) - kept)  # what was kept is not computed again


def test_a_finished_embedding_job_makes_no_sequence_again(spark, tmp_path):
    """Which ids are missing is found without their sequences; a table that has grown is gone on with."""
    folder, log = f"{tmp_path}/emb", tmp_path / "log"
    log.mkdir()

    @F.udf("string")
    def made(i):
        (log / f"{i}-{uuid.uuid4().hex}").touch()
        return "A" * (i % 7)

    def seqs(n):
        return spark.range(n, numPartitions=3).select(F.concat(F.lit("s"), "id").alias("seq_id"), made("id").alias("seq_str"))

    def make():
        return lambda texts: [{1: np.ones((len(t) + 2, 2), np.float32)} for t in texts]

    EM.embed_into(seqs(40), make, folder)
    first = len(os.listdir(log))
    v, e = EM.embed_into(seqs(40), make, folder)
    assert first >= 40 and len(os.listdir(log)) == first
    assert v.count() == sum(i % 7 > 0 for i in range(40)) and e.count() == 6
    v, _ = EM.embed_into(seqs(43), make, folder)
    assert sorted(r.seq_id for r in v.collect()) == sorted(f"s{i}" for i in range(43) if i % 7)


def test_the_letter_model_hashes_each_letter_once(monkeypatch):
    from seqmill.plans import q_misc

    predict, calls, md5 = q_misc._letter_model(), [], hashlib.md5
    monkeypatch.setattr(q_misc.hashlib, "md5", lambda x: calls.append(x) or md5(x))
    out = predict(["ABBA" * 50, "", "CA"])
    assert sorted(calls) == [b"A", b"B", b"C"]
    for text, by_layer in zip(["ABBA" * 50, "", "CA"], out):
        want = np.zeros((len(text) + 2, q_misc.DIM))
        for i, c in enumerate(text):
            want[i + 1, int(md5(c.encode()).hexdigest()[:8], 16) % q_misc.DIM] = 1
        assert (by_layer[1] == want).all() and (by_layer[2] == 2 * want).all()
