import itertools

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqmill.functions import strings as S
from seqmill.functions import vector as V
from seqmill.operators import pairs as P
from seqmill.operators import sampling as SM
from seqmill.operators import stats as ST
from seqmill.operators import residues as R


def test_strip_prefix_and_hamming(spark):
    df = spark.createDataFrame([("123.YP_1.1", "ABC", "ABD"), ("nodot", "AB", "AB"), ("a.b", "A", "AB")],
                               "id string, a string, b string")
    r = df.select(S.strip_prefix("id").alias("s"), S.hamming("a", "b").alias("h")).collect()
    assert [x.s for x in r] == ["YP_1.1", "", "b"]
    assert [x.h for x in r] == [1, 0, None]


def test_cosine_strict_and_eps(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0]), ([1.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    r = df.select(V.cosine("a", "b").alias("c"), V.cosine("a", "b", eps=1e-6).alias("e")).collect()
    assert r[0].c is None and r[0].e == 0.0
    assert abs(r[1].c - 1.0) < 1e-12


def test_rank_vector_ties_constant_reversed():
    assert V._centered_rank_unit_np([1.0, 1.0, 1.0]) is None
    a = np.array(V._centered_rank_unit_np([1.0, 2.0, 3.0, 4.0]))
    b = np.array(V._centered_rank_unit_np([4.0, 3.0, 2.0, 1.0]))
    assert abs(a @ b + 1.0) < 1e-12
    assert V._centered_rank_unit_np([]) is None and V._centered_rank_unit_np(None) is None


def test_pairs_within_blocked_equals_combinations(spark):
    rows = [("g1" if i < 37 else "g2", i) for i in range(45)]
    df = spark.createDataFrame(rows, "g string, o long")
    got = {(r.g, r.o1, r.o2) for r in P.pairs_within(df, "g", "o", ["o"], block_rows=5).collect()}
    want = set()
    for g in ("g1", "g2"):
        ids = [o for gg, o in rows if gg == g]
        want |= {(g, a, b) for a, b in itertools.combinations(ids, 2)}
    assert got == want


def test_take_smallest_exact(spark):
    df = spark.createDataFrame([(i % 3, (i * 7919) % 1000) for i in range(300)], "g int, x long")
    got = sorted((r.g, r.x) for r in SM.take_smallest(df, ["g"], "x", 7, ["x"]).collect())
    want = []
    for g in range(3):
        want += [(g, x) for x in sorted((i * 7919) % 1000 for i in range(300) if i % 3 == g)[:7]]
    assert got == sorted(want)


def test_value_ranks_and_spearman(spark):
    xs = [3.0, 1.0, 2.0, 2.0, 5.0, 4.0]
    ys = [1, 0, 0, 1, 1, 0]
    df = spark.createDataFrame(list(zip(xs, ys)), "x double, y int")
    r = ST.spearman(df, "x", "y").first()
    rx, ry = pd.Series(xs).rank(), pd.Series(ys).rank()
    assert abs(r.spearman - round(float(np.corrcoef(rx, ry)[0, 1]), 6)) < 1e-9


def test_budget_takes_first_two(spark):
    df = spark.createDataFrame([("a", 10), ("b", 10), ("c", 10)], "k string, w long")
    assert [r.k for r in R.take_until_budget(df, "k", "w", 15).orderBy("k").collect()] == ["a", "b"]
