"""Dataset build, statistics, clustering, alignment and files against brute force and on edge cases."""

import math
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from seqmill.functions import encode as E
from seqmill.functions import vector as V
from seqmill.operators import align as A
from seqmill.operators import cluster as C
from seqmill.operators import embed as EM
from seqmill.operators import evaluation as EV
from seqmill.operators import joins as J
from seqmill.operators import prep as P
from seqmill.operators import residues as R
from seqmill.operators import sampling as SM
from seqmill.operators import stats as ST
from seqmill.operators import vectors as OV
from seqmill.sources import files as FS


# ---- selection and splits

def test_smallest_with_null_groups_and_ties(spark):
    rows = [(None if i % 4 == 0 else i % 4, i % 7, i) for i in range(200)]
    df = spark.createDataFrame(rows, "g int, x long, id int").withColumn("h", SM.seeded_hash(1, "x"))
    got = SM.flag_smallest(df, ["g"], "h", F.lit(9), ["id"])
    assert got.count() == 200
    per = {r.g: r.n for r in got.where("_sel").groupBy("g").agg(F.count("*").alias("n")).collect()}
    assert per == {None: 9, 1: 9, 2: 9, 3: 9}
    h = sorted(r.h for r in df.collect())
    for k in (0, 1, 57, 199, 200, 500):
        sel = [r.h for r in SM.flag_smallest(df, [], "h", k, ["id"]).where("_sel").collect()]
        assert sorted(sel) == h[:k]


def test_kth_smallest_goes_through_levels(spark, monkeypatch):
    monkeypatch.setattr(SM, "_FEW", 3)
    values = [5] * 10 + [1 << 59, (1 << 59) + 1, (1 << 59) + 1, (1 << 60) - 1] + list(range(100, 140))
    df = spark.createDataFrame([(v,) for v in values], "h long")
    s = sorted(values)
    for k in range(1, len(s)):
        value, rest = SM.kth_smallest(df, "h", k)
        assert value == s[k - 1] and rest == k - s.index(value)


def test_three_way_split_keeps_groups_apart(spark):
    df = spark.createDataFrame([(f"g{i % 40}", f"p{i}") for i in range(400)], "group_name string, protein_id string")
    s = P.three_way_split(df, "group_name", 0.15, 42)
    assert s.count() == 400 and P.assert_disjoint(s).count() == 0
    n = {r.split: r.n for r in s.groupBy("split").agg(F.countDistinct("group_name").alias("n")).collect()}
    assert n == {"test": 6, "val": 6, "train": 28}


def test_stratified_split_counts(spark):
    r = random.Random(1)
    rows = [(r.choice("aaabbc"), f"x{i}") for i in range(300)] + [("single", "y")]
    s = P.stratified_split(spark.createDataFrame(rows, "label string, id string"), "label", "id", 0.1, 1)
    got = pd.DataFrame(s.collect(), columns=s.columns)
    test = got[got.split == "test"].groupby("label").size()
    assert test.sum() == math.ceil(0.1 * 301) and "single" not in test
    n = got.groupby("label").size()
    assert all(abs(test[c] - 31 * n[c] / 301) < 1 for c in "abc")
    assert P.stratified_split(spark.createDataFrame([], "label string, id string"), "label", "id").count() == 0


def test_shuffle_is_a_permutation(spark):
    df = spark.range(500)
    got = [r.position for r in SM.shuffled(df, ["id"], 3).orderBy("id").collect()]
    assert sorted(got) == list(range(500)) and got != list(range(500))


def test_label_codes_are_sorted(spark):
    df = spark.createDataFrame([(f"l{i % 13}",) for i in range(90)] + [(None,)], "l string")
    got = {r.l: r.label_code for r in P.label_codes(df, "l").collect()}
    assert got == {x: i for i, x in enumerate(sorted(got))} and len(got) == 13


def test_encode_whole_or_counted(spark):
    df = spark.createDataFrame([("LAG",), ("",), ("LA?",)], "s string")
    v = E.vocab_map(E.default_vocab(spark))
    ids, mask, n = E.encode_sequence("s", v)
    assert [list(r[0]) for r in df.select(ids).collect()] == [[0, 4, 5, 6, 2], [0, 2], [0, 4, 5, 3, 2]]
    ids, mask, n = E.encode_sequence("s", v, 4)
    got = df.select(ids.alias("i"), mask.alias("m"), n.alias("n")).collect()
    assert [(list(r.i), list(r.m), r.n) for r in got] == [([0, 4, 5, 2], [1] * 4, 1), ([0, 2, 1, 1], [1, 1, 0, 0], 0), ([0, 4, 5, 2], [1] * 4, 1)]
    t = df.select(E.next_targets(E.encode_sequence("s", v)[0]).alias("t")).first().t
    assert list(t) == [4, 5, 6, 2, -100]


def test_encode_tokens_equals_the_map(spark):
    df = spark.createDataFrame([(1, ["L", "A", "A", "?"], "x"), (2, [], "y"), (3, None, None), (4, ["G", None, "L"], "x"),
                                (5, ["L"] * 3000, "z")], "k long, token array<string>, _map string")
    voc = E.default_vocab(spark)
    for most in (None, 4):
        got = {r.k: r for r in E.encode_tokens(df, "k", "token", voc, most).collect()}
        assert got[1]._map == "x" and list(got[2].input_ids)[:2] == [0, 2]
        for k, ts in ((1, "LAA?"), (2, ""), (3, ""), (4, "G?L"), (5, "L" * 3000)):
            ids = [4 + E.DEFAULT_RESIDUES.index(c) if c != "?" else 3 for c in ts]
            want = [0, *(ids if most is None else ids[:2]), 2]
            pad = 0 if most is None else most - len(want)
            assert list(got[k].input_ids) == want + [1] * pad and list(got[k].attention_mask) == [1] * len(want) + [0] * pad
            assert got[k].n_dropped == len(ts) + 2 - len(want)
    assert E.encode_tokens(df.limit(0), "k", "token", voc).count() == 0
    with pytest.raises(ValueError):
        E.vocab_map(voc, most=5)


def test_pools_with_and_without_boundary_rows(spark):
    rows = [(k, p, [float(p * p + i) for i in range(3)]) for k, n in (("a", 5), ("b", 2), ("c", 1)) for p in range(n)]
    df = spark.createDataFrame(rows, "k string, pos int, vec array<double>")
    both = {r.k: list(r.vec) for r in OV.mean_pool(df, "k").collect()}
    inner = {r.k: list(r.vec) for r in OV.mean_pool(df, "k", strip=True).collect()}
    assert both == {"a": [6.0, 7.0, 8.0], "b": [0.5, 1.5, 2.5], "c": [0.0, 1.0, 2.0]}
    assert set(inner) == {"a"} and inner["a"] == pytest.approx([14 / 3, 17 / 3, 20 / 3])


def test_embedding_job_pools_boundary_rows_on_demand(spark):
    def make():
        return lambda texts: [{0: np.arange(len(t) + 2, dtype=float)[:, None] ** 2} for t in texts]

    df = spark.createDataFrame([("s", "LAG")], "seq_id string, seq_str string")
    for strip, n, mean in ((True, 3, 14 / 3), (False, 5, 6.0)):
        r = EM.embed_sequences(df, make, strip=strip)[0].first()
        assert r.n == n and list(r.vec) == pytest.approx([mean])


def test_numbered_groups_with_and_without_broadcast(spark, monkeypatch):
    df = spark.createDataFrame([(i, "hot" if i % 3 else f"g{i % 7}") for i in range(300)], "id long, grp string")
    want = sorted(map(tuple, EV.numbered(df, "id", "grp").collect()))
    monkeypatch.setattr(EV, "attach_by_key", lambda r, t, on, count: J.attach_by_key(r, t, on, count, 50, 0))
    assert sorted(map(tuple, EV.numbered(df, "id", "grp").collect())) == want and len(want) == 300


# ---- statistics

def test_statistics_of_odd_columns(spark):
    empty = spark.createDataFrame([], "x double")
    assert ST.histogram(empty, "x").count() == 0 and ST.kde_grid(empty, "x").count() == 0 and ST.quantiles(empty, "x").count() == 0
    s = ST.spearman(spark.createDataFrame([], "x double, y int"), "x", "y").first()
    assert s.spearman is None and s.n == 0
    odd = spark.createDataFrame([(1.0,), (2.0,), (float("nan"),), (None,), (2.0,), (4.0,)], "x double")
    assert ST.histogram(odd, "x", 3).agg(F.sum("n")).first()[0] == 4
    assert [r.value for r in ST.quantiles(odd, "x").orderBy("prob").collect()] == [1.75, 2.0, 2.5]
    assert ST.kde_grid(spark.createDataFrame([(3.0,)] * 4, "x double"), "x").count() == 0


def test_ranks_of_matrix_rows():
    r = np.random.default_rng(0)
    m = r.integers(0, 5, (40, 9)).astype(float)
    m[3] = 2.0
    want = pd.DataFrame(m).rank(axis=1).to_numpy()
    want = want - want.mean(1, keepdims=True)
    with np.errstate(invalid="ignore"):
        want = want / np.sqrt((want ** 2).sum(1, keepdims=True))
    assert np.allclose(V._rank_matrix(m), want, equal_nan=True)


def test_budget_with_zero_weights(spark):
    df = spark.createDataFrame([(f"k{i:03d}", 0 if i % 3 else 5) for i in range(90)], "k string, w int")
    got = sorted(r.k for r in R.take_until_budget(df, "k", "w", 12).collect())
    run, want = 0, []
    for i in range(90):
        if run < 12:
            want.append(f"k{i:03d}")
        run += 0 if i % 3 else 5
    assert got == want


# ---- clustering

def _vectors(spark, points):
    return spark.createDataFrame([(i, [float(x) for x in p]) for i, p in enumerate(points)], "id long, vec array<double>")


def _prim(points, core):
    n = len(points)
    d = np.sqrt(((points[:, None] - points[None]) ** 2).sum(2))
    w = np.maximum(d, np.maximum.outer(core, core))
    seen, total, best = {0}, 0.0, w[0].copy()
    while len(seen) < n:
        j = min((x for x in range(n) if x not in seen), key=lambda x: best[x])
        total += best[j]
        seen.add(j)
        best = np.minimum(best, w[j])
    return total


@pytest.mark.parametrize("name", ["random", "grid with ties", "star", "duplicates"])
def test_spanning_tree_against_prim(spark, name):
    r = np.random.default_rng(3)
    points = {"random": r.normal(size=(60, 3)), "grid with ties": np.array([(x, y) for x in range(7) for y in range(6)], float),
              "star": np.array([[0, 0], [1, 0], [-1, 0], [0, 1], [0, -1]], float),
              "duplicates": np.repeat(r.normal(size=(8, 2)), 3, axis=0)}[name]
    v = _vectors(spark, points)
    core = C.core_distances(v, 2)
    c = np.array([x.core for x in core.orderBy("id").collect()])
    tree = C.mst(v, core, block_rows=16).collect()
    assert len(tree) == len(points) - 1
    parent = list(range(len(points)))

    def root(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for e in tree:
        a, b = root(e.u), root(e.v)
        assert a != b
        parent[a] = b
    assert abs(sum(e.w for e in tree) - _prim(points, c)) < 1e-9


def test_knn_core_and_silhouette_edges(spark):
    points = np.array([[0.0], [1.0], [1.0], [5.0]])
    v = _vectors(spark, points)
    nn = {(x.id, x["rank"]): (x.nbr, x.dist) for x in C.knn(v, 2, block_rows=2).collect()}
    assert nn[(0, 1)] == (1, 1.0) and nn[(0, 2)] == (2, 1.0) and nn[(1, 1)] == (2, 0.0)
    core = {x.id: x.core for x in C.core_distances(v, 4).collect()}
    assert len(core) == 4 and all(math.isinf(x) for x in core.values())
    same = spark.createDataFrame([(i, [1.0], i % 2) for i in range(6)], "id long, vec array<double>, label int")
    assert C.silhouette(same).first().silhouette == 0.0
    with pytest.raises(ValueError):
        C.silhouette(same.withColumn("label", F.lit(1)))


def test_benchmark_samples_groups_for_each_iteration(spark):
    r = np.random.default_rng(4)
    points = {k: r.normal(size=2) * 0.1 + [(k // 12) * 5, (k // 12) ** 2] for k in range(72)}
    groups = spark.createDataFrame([(k, f"g{k // 12}") for k in points], "id long, grp string")
    models = {n: spark.createDataFrame([(k, [float(z) * f for z in v]) for k, v in points.items()], "id long, vec array<double>")
              for n, f in (("p", 1.0), ("q", 1.5))}
    got = {(x.iteration, x.title): x for x in C.cluster_benchmark(models, groups, 3, 1.5, 5, n_groups=3, iterations=3).collect()}
    assert set(got) == {(i, n) for i in range(3) for n in "pq"}
    samples = set()
    for i in range(3):
        ids = [x.id for x in SM.sample_groups(groups, "grp", 3, seed=i).collect()]
        samples.add(frozenset(ids))
        x, g = np.array([points[k] for k in ids]), np.array([k // 12 for k in ids])
        d = np.linalg.norm(x[:, None] - x[None], axis=2)
        inner = np.array([d[k][(g == g[k])].sum() / 11 for k in range(len(g))])
        near = np.array([min(d[k][g == h].mean() for h in set(g) - {g[k]}) for k in range(len(g))])
        want = ((near - inner) / np.maximum(near, inner)).mean()
        for n in "pq":  # lengths of another unit leave it as it is
            assert got[i, n].n_clusters == 3 and abs(got[i, n].silhouette - want) < 0.0051
    assert len(samples) > 1


# ---- residues

def test_given_columns_and_indexes(spark):
    msa = spark.createDataFrame([("a", "s1", 0, "AC-D", [0, 1, None, 2]), ("a", "s2", 1, "A-CD", [5, None, 6, 7]), ("b", "s3", 0, "AA", [0, 1])],
                                "align_id string, seq_id string, seq_ord int, seq_str string, aa_idx2emb_idx array<int>")
    cons = spark.createDataFrame([("a", [0, 2, 3]), ("z", [1])], "align_id string, cons_col array<int>")
    got = sorted((r.seq_id, r.col, r.emb_idx) for r in R.conserved_cells(msa, cons).collect())
    assert got == [("s1", 0, 0), ("s1", 3, 2), ("s2", 0, 5), ("s2", 2, 6), ("s2", 3, 7)]


def test_given_columns_reach_the_whole_width(spark, tmp_path):
    from seqmill.plans import registry

    registry.load_all()
    r = random.Random(5)
    base = "".join(r.choice("ACDEFG") for _ in range(900))
    texts = [base, base[:500] + "W" * 300, base[:40], "", "1 2"]
    spark.createDataFrame([(i, t, "s", "en") for i, t in enumerate(texts)],
                          "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = [t.replace("E", "-E") for t in texts[:3]]
    width = max(map(len, rows))
    rows = [t.ljust(width, "-") for t in rows]
    n_cells = n_cols = total = 0
    for c in range(width):
        there = [x[c] for x in rows if x[c] != "-"]
        if there and max(map(there.count, there)) >= 0.4 * len(rows):
            n_cols, n_cells = n_cols + 1, n_cells + len(there)
            total += sum(len(x[:c].replace("-", "")) for x in rows if x[c] != "-")
    got = [tuple(x) for x in registry.QUERIES["given_columns"](spark, str(tmp_path)).collect()]
    assert got == [("s/en", n_cells, n_cols, total)] and n_cols > 200


# ---- alignment

def _soft(s, t, x, y, n=4, min_len=10):
    """The alignment of one pair, step by step over the whole matrix."""
    a, b = x / np.linalg.norm(x, axis=1, keepdims=True), y / np.linalg.norm(y, axis=1, keepdims=True)
    m = a @ b.T
    key = np.round(-m, 12)
    rows = [sorted(range(m.shape[1]), key=lambda j: (key[i, j], j))[:n] for i in range(m.shape[0])]
    cols = [sorted(range(m.shape[0]), key=lambda i: (key[i, j], i))[:n] for j in range(m.shape[1])]
    found = {(i, j) for i in range(len(s)) for j in rows[i] if i in cols[j]}
    for i, j in list(found):
        for d in (-1, 1):
            p, q = i + d, j + d
            if 0 <= p < len(s) and 0 <= q < len(t) and s[p] == t[q]:
                found.add((p, q))
    support = {}
    for diag in range(-len(t) + 1, len(s)):
        def hit(i):
            j = i - diag
            return 0 <= j < len(t) and (((s[i] == t[j]) and (j <= i or j < len(s))) or (i, j) in found)
        for start in range(len(s) - 2):
            if sum(hit(i) for i in range(start, min(start + 5, len(s)))) >= 3:
                support[diag] = support.get(diag, 0) + 3
    kept = [c for c in found if support.get(c[0] - c[1], 0) >= min_len]
    last = max((i for i, _ in kept), default=0)
    cells = sorted((c for c in kept if c[0] < last), key=lambda c: c[1])
    length = []
    for k, (i, j) in enumerate(cells):
        length.append(1 + max((length[q] for q in range(k) if cells[q][0] < i and cells[q][1] < j), default=0))
    best = max(length, default=0)
    return len(found), len(kept), best if best >= 2 else 0


def test_soft_alignment_against_brute_force(spark):
    r = np.random.default_rng(7)
    letters = "ACDE"
    base = "".join(r.choice(list(letters), 30))
    texts = [base, base[3:] + "AC", "".join(r.choice(list(letters), 25)), base[:12] + "EE" + base[12:], "A" * 40, ""]
    seqs = spark.createDataFrame([(f"s{i}", t) for i, t in enumerate(texts)], "seq_id string, seq_str string")
    vec = {(m, i): r.normal(size=(len(t), 6)) for m in ("p", "q") for i, t in enumerate(texts)}
    rows = [(m, f"s{i}", k, [float(z) for z in v]) for (m, i), mat in vec.items() for k, v in enumerate(mat) if (m, i) != ("q", 2)]
    vectors = spark.createDataFrame(rows, "model string, seq_id string, pos int, vec array<double>")
    pairs = [(0, 0, 1), (1, 0, 3), (2, 0, 2), (3, 1, 3), (4, 0, 5), (5, 0, 9), (6, 4, 0)]
    df = spark.createDataFrame([(p, f"s{a}", f"s{b}") for p, a, b in pairs], "pair_id int, qid string, hid string")
    out, errors = A.soft_align(df, seqs, vectors, ("p", "q"), max_len=35)
    got = {x.pair_id: x for x in out.collect()}
    assert set(got) == {0, 1, 3}
    for p, a, b in pairs:
        if p in got:
            for m in ("p", "q"):
                assert got[p][f"len_{m}"] == _soft(texts[a], texts[b], vec[(m, a)], vec[(m, b)])[2]
    assert {(e.pair_id, e.seq_id, e.reason) for e in errors.collect()} == {
        (2, "s2", "no vectors"), (4, "s5", "empty"), (5, "s9", "missing"), (6, "s4", "too long")}


def test_alignment_queries_take_the_reference_length(spark, tmp_path):
    from seqmill.plans import registry

    registry.load_all()
    r = np.random.default_rng(3)
    base = "".join(r.choice(list("ACDEFG"), 1025))
    texts = [base[100:620], base[:1024], base, "ACD"]
    emb = r.normal(size=(320, 6))
    spark.createDataFrame([(i, t, "s", "en", len(t)) for i, t in enumerate(texts)],
                          "doc_id long, text string, source string, lang string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, [float(z) for z in v], "l") for i, v in enumerate(emb)],
                          "vec_id long, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")

    def rows(name):
        return registry.QUERIES[name](spark, str(tmp_path)).collect()

    rejects = {(1, "S2", "too long"), (2, "S2", "too long"), (3, "S4", "missing")}
    assert {tuple(x) for x in rows("alignment_rejects")} == {tuple(x) for x in rows("soft_alignment_errors")} == rejects
    assert [(x.pair_id, x.n_cells) for x in rows("similarity_profile")] == [(0, 520 * 1024)]
    x, y = (np.array([emb[(ord(c) * 7 + i % 3) % len(emb)] for i, c in enumerate(t)], np.float32).astype(float) for t in texts[:2])
    found, kept, length = _soft(texts[0], texts[1], x, y)
    assert len(rows("extended_matches")) == found and len(rows("clean_matches")) == kept
    got = rows("soft_alignment")
    assert [(g.pair_id, g.len_pt, g.len_q, g.len_h) for g in got] == [(0, length, 520, 1024)] and length > 1
    for name in ("mutual_matches", "pca_matches", "diagonal_support"):
        assert {g.pair_id for g in rows(name)} == {0}


def test_longest_chain_and_interval_pruning(spark):
    r = random.Random(4)
    for _ in range(200):
        cells = list({(r.randrange(9), r.randrange(9)) for _ in range(r.randint(0, 14))})
        path = A.longest_chain(cells)
        assert all(a[0] < b[0] and a[1] < b[1] for a, b in zip(path, path[1:]))
        last = max((i for i, _ in cells), default=0)
        free = sorted((c for c in cells if c[0] < last), key=lambda c: c[1])
        size = []
        for k, (i, j) in enumerate(free):
            size.append(1 + max((size[q] for q in range(k) if free[q][0] < i and free[q][1] < j), default=0))
        best = max(size, default=0)
        assert len(path) == (best if best >= 2 else 0)
    df = spark.createDataFrame([("k", 0, 9), ("k", 2, 5), ("k", 0, 4), ("k", 3, 12)], "k string, a int, b int")
    assert sorted((x.a, x.b) for x in A.prune_contained(df, ["k"], "a", "b").collect()) == [(0, 9), (3, 12)]


def test_windows_and_kernel_choose_the_same_cells(spark):
    r = np.random.default_rng(2)
    seqs = spark.createDataFrame([("a", "A" * 9), ("b", "A" * 7)], "seq_id string, seq_str string")
    vec = spark.createDataFrame([("m", s, i, [float(x) for x in r.integers(0, 3, 4)]) for s, n in (("a", 9), ("b", 7)) for i in range(n)],
                                "model string, seq_id string, pos int, vec array<double>")
    ok, _ = A.guard_length(A.resolve_pairs(spark.createDataFrame([(1, "a", "b")], "pair_id int, qid string, hid string"), seqs))
    one = {(x.i, x.j) for x in A.mutual_matches(ok, vec, 3).collect()}
    cells = A.similarity_cells(ok, vec).withColumn("sim", F.round("sim", 12))
    assert one == {(x.i, x.j) for x in A.top_n_cells(cells, 3).collect()} and one


# ---- evaluation and embedding

def test_balanced_pairs_are_clean(spark):
    df = spark.createDataFrame([(i, f"g{i % 4}" if i else None, [float(i % 4), 1.0]) for i in range(60)], "id long, grp string, vec array<double>")
    pairs = [(p.id1, p.id2, p.truth) for p in EV.balanced_pairs(df).collect()]
    assert len({p[:2] for p in pairs}) == len(pairs) and all(a < b for a, b, _ in pairs)
    assert all((a % 4 == b % 4) == (t == 0) for a, b, t in pairs)
    n = [sum(p[2] == t for p in pairs) for t in (0, 1)]
    sizes = [14, 15, 15, 15]
    assert n[0] == sum(s * (s - 1) // 2 for s in sizes) and 0.7 * n[0] < n[1] <= n[0]
    assert EV.group_separation(df).first().spearman > 0.8
    c = EV.contrastive_samples(df).collect()
    assert all((x.id % 4 == x.other % 4) == (x.kind == "positive") and x.id != x.other for x in c)
    assert len({(x.id, x.other) for x in c}) == len(c) == 59 * 10


def test_classifier_beats_the_prior(spark):
    r = np.random.default_rng(0)
    df = spark.createDataFrame([(i, i % 3, [float(x) for x in r.normal(size=4) + 2 * np.eye(4)[i % 3]]) for i in range(300)],
                               "id long, label int, v array<float>")
    got = {x.split: x for x in EV.group_classifier(P.stratified_split(df, "label", "id"), "v", "label").collect()}
    assert got["test"].n == 30 and got["test"].accuracy > 0.6


def test_embedding_job_reports_and_resumes(spark):
    def make():
        def predict(texts):
            if any("!" in t for t in texts):
                raise RuntimeError("no")
            return [{1: np.ones((len(t) + 2, 2)), 3: np.arange((len(t) + 2) * 2.0).reshape(-1, 2)} for t in texts]
        return predict
    seqs = spark.createDataFrame([("a", "AB"), ("b", "!"), ("c", None), ("d", "ABCDEFGH"), ("e", "A")], "seq_id string, seq_str string")
    v, e = EM.embed_sequences(seqs, make, max_len=5)
    assert {(x.seq_id, x.layer, x.n, tuple(x.vec)) for x in v.collect()} == {("a", 3, 2, (3.0, 4.0)), ("e", 3, 1, (2.0, 3.0))}
    assert {x.seq_id for x in e.collect()} == {"b", "c", "d"}
    v2, _ = EM.embed_sequences(seqs, make, layers=[1], done=v)
    assert {(x.seq_id, x.layer) for x in v2.collect()} == {("d", 1)}


def test_bad_fasta_headers(spark, tmp_path):
    (tmp_path / "x.fa").write_text(">db id1 a b c\r\nAC\r\nDE\r\n>db id2\nAA\n>db  empty id\nTT\n>t id3 d\n")
    got = {(r.id, r.description, r.sequence, r._corrupt) for r in FS.read_fasta(spark, f"file://{tmp_path}", "tagged").collect()}
    assert got == {("id1", "a b c", "ACDE", None), (None, None, "AA", "db id2"), ("id3", "d", "", None)}
    with pytest.raises(Exception, match="bad FASTA header"):
        FS.read_fasta(spark, f"file://{tmp_path}", "tagged", "FAILFAST").collect()
    std = {r.id for r in FS.read_fasta(spark, f"file://{tmp_path}").collect()}
    assert std == {"db", "t"}


def test_draws_of_other_groups_are_not_shuffled(spark):
    """The drawn pairs outnumber the rows, so the rows go to them."""
    df = spark.createDataFrame([(i, f"g{i % 4}") for i in range(60)], "id long, grp string")
    rows = EV.numbered(df, "id", "grp")
    drawn = EV._others(rows, rows, 60, F.lit(5), 0)
    plan = drawn._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
    assert drawn.count() == 300 and drawn.where(F.pmod(F.col("id"), F.lit(4)) == F.pmod(F.col("other"), F.lit(4))).isEmpty()
