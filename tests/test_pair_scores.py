"""Scores of very many pairs, a batch at a time; distances of alignment rows of uneven length."""

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from seqmill.functions import vector as V
from seqmill.operators import evaluation as EV
from seqmill.operators import residues as R
from seqmill.session import ship


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_pair_scores_are_those_of_single_rows(spark):
    ship(spark)
    rows = [([1.0, 2.0, 3.0], [3.0, 2.0, 2.5]), ([0.0, 0.0], [1.0, 2.0]), ([1.0, 1.0], [1.0, 2.0]), ([1.0], [1.0, 2.0]), (None, [1.0]),
            ([], []), ([1.0, None], [1.0, 2.0]), ([float("nan"), 1.0], [1.0, 2.0]), ([4.0, 1.0, 1.0], [1.0, 0.0, 5.0])]
    for kind in ("float", "double"):
        df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], f"i int, a array<{kind}>, b array<{kind}>")
        got = df.select("i", V.pair_cosine("a", "b").alias("c"), V.cosine("a", "b").alias("cw"), V.pair_spearman("a", "b").alias("s"))
        rank = df.where("i in (0, 8)").select("i", V.dot(V.centered_rank_unit("a"), V.centered_rank_unit("b")).alias("sw"))
        for r in got.collect():
            assert (r.c is None) == (r.cw is None), r
            assert r.c is None or np.isnan(r.c) == np.isnan(r.cw) and (np.isnan(r.c) or abs(r.c - r.cw) < 1e-12)
        for r in got.join(rank, "i").collect():
            assert abs(r.s - r.sw) < 1e-12
        assert [r.s for r in got.where("i between 1 and 6").orderBy("i").collect()] == [None] * 6


def test_scores_of_pairs_without_a_loop_a_component(spark):
    rng = np.random.default_rng(5)
    ends = [(s, p, m, rng.normal(size=6).tolist()) for s in "ab" for p in range(3) for m in R.MODELS]
    ends = [e for e in ends if e[:3] != ("b", 2, "cont")]  # this end lacks a model
    vectors = spark.createDataFrame(ends, "seq_id string, pos int, model string, vec array<float>")
    pairs = spark.createDataFrame([("x", "a", "b", i, j) for i in range(3) for j in range(3)],
                                  "align_id string, seq1_id string, seq2_id string, emb_idx1 int, emb_idx2 int")
    ep = R.endpoint_vectors(R._ends(pairs), vectors)
    out = R.score_pairs(pairs, ep)
    assert "lambda" not in plan(out)
    at = {e[:3]: np.array(e[3], np.float32).astype(float) for e in ends}
    rows = out.collect()
    assert len(rows) == 6
    for r in rows:
        for m in R.MODELS:
            x, y = at["a", r.emb_idx1, m], at["b", r.emb_idx2, m]
            assert abs(r[R.SCORE_COLS[m]] - x @ y / np.linalg.norm(x) / np.linalg.norm(y)) < 2e-6
            assert abs(r[R.RANK_COLS[m]] - np.corrcoef(pd.Series(x).rank(), pd.Series(y).rank())[0, 1]) < 2e-6
    needed = vectors.withColumnRenamed("pos", "emb_idx")
    assert [r.align_id for r in R._errors(pairs, R.complete_ends(needed)).collect()] == ["x"]
    assert R._errors(pairs.where("emb_idx2 < 2"), R.complete_ends(needed)).count() == 0


def test_distances_of_one_long_row_among_short_ones():
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("AB-"), n)) for n in [3, 900, 0, 7, 7, 40, 1, 12]]
    pdf = pd.DataFrame({"align_id": "x", "seq_id": [f"s{i}" for i in range(8)], "seq_ord": range(8), "seq_str": texts})
    for side, n in (([0] * 8, 28), ([0, 1, 0, 1, 1, 0, 0, 1], 16)):
        out = R._hamming_block(pdf.assign(_side=side))
        got = {(a, b): d for a, b, d in zip(out["seq1_id"], out["seq2_id"], out["hdist"])}
        assert len(got) == n
        for (a, b), d in got.items():
            s, t = (texts[int(x[1:])].ljust(900, "-") for x in (a, b))
            assert a < b and d == sum(x != y for x, y in zip(s, t))


def test_separation_without_a_loop_a_component(spark, monkeypatch):
    seen = []
    monkeypatch.setattr(EV, "spearman", lambda df, *c: seen.append(df) or df)
    df = spark.createDataFrame([(i, i % 3, [float(i % 3), float(i), 1.0]) for i in range(30)], "id int, grp int, vec array<float>")
    EV.group_separation(df)
    assert "lambda" not in plan(seen[0]) and seen[0].where(F.col("dist").isNull()).count() == 0
