"""Sequence queries at scale: what is made where the sequence is, and what is shuffled."""

import hashlib
import math
from collections import Counter

from pyspark.sql import functions as F

from seqmill.functions import encode as E
from seqmill.functions import strings as S
from seqmill.operators import embed as EM
from seqmill.operators import prep as P


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_encoding_is_no_search_a_letter(spark):
    df = spark.createDataFrame([(1, "LAGV?"), (2, "Lé𝄞A"), (3, ""), (4, None)], "i int, s string")
    v = E.vocab_map(E.default_vocab(spark))
    ids, mask, n = E.encode_sequence("s", v)
    x = df.select("i", ids.alias("ids"), mask.alias("mask"), n.alias("n"))
    assert "lambda" not in plan(x)
    got = {r.i: (r.ids, r.mask, r.n) for r in x.collect()}
    assert got[1] == ([0, 4, 5, 6, 7, 3, 2], [1] * 7, 0)
    assert got[2] == ([0, 4, 3, 3, 5, 2], [1] * 6, 0)
    assert got[3] == got[4] == ([0, 2], [1, 1], 0)
    ids, mask, n = E.encode_sequence("s", v, 5)
    got = {r.i: (r.a, r.b, r.c) for r in df.select("i", ids.alias("a"), mask.alias("b"), n.alias("c")).collect()}
    assert got[1] == ([0, 4, 5, 6, 2], [1] * 5, 2) and got[4] == ([0, 2, 1, 1, 1], [1, 1, 0, 0, 0], 0)


def test_a_map_of_its_own_in_each_row(spark):
    df = spark.createDataFrame([("AB", {"A": 1, "B": None}), ("AB", {"A": 7, "B": 8}), ("AB", {})], "s string, m map<string,int>")
    ids = E.encode_sequence("s", F.col("m"), add_special=False)[0]
    assert [r.x for r in df.select(ids.alias("x")).collect()] == [[1, 3], [7, 8], [3, 3]]


def test_digest_of_ids(spark):
    rows = [([1, 22, 333],), ([],), (None,), ([1, None, -100],), ([1 << 30, 0, -(1 << 30)],)]
    df = spark.createDataFrame(rows, "ids array<int>")
    for part in (df, df.where("not exists(ids, x -> x is null)"), df.where("get(ids, 0) = 1")):
        for r in part.select(E.ids_md5("ids").alias("a"), F.md5(F.array_join("ids", ",")).alias("b")).collect():
            assert r.a == r.b


def test_spaces_between_letters(spark):
    df = spark.createDataFrame([("ABC",), ("A",), ("",), (None,), ("AB\nC",), ("é𝄞Z",)], "s string")
    x = df.select(S.space_out("s").alias("a"), F.regexp_replace("s", r"(?<=.)(?=.)", " ").alias("b"),
                  S.normalize_residues(F.lit("UZOB-A")).alias("n"))
    assert "regexp_replace(s" not in plan(df.select(S.space_out("s")))
    for r in x.collect():
        assert r.a == r.b and r.n == "XXXXXA"


def test_lengths_are_taken_before_the_join(spark):
    keys = spark.createDataFrame([("g", "a"), ("g", "b"), ("h", "a"), ("h", "c")], "group_name string, protein_id string")
    proteins = spark.createDataFrame([("a", "AAA"), ("b", None), ("c", "C")], "id string, sequence string")
    x = P.with_sequences(keys, proteins, F.length("sequence").alias("n"))
    below = [line for line in plan(x.hint("merge")).splitlines() if "Join" in line or "length(sequence" in line]
    assert "Join" in below[0] and "length(sequence" in below[-1]
    assert sorted(tuple(r) for r in x.select("group_name", "protein_id", "n").collect()) == [("g", "a", 3), ("h", "a", 3), ("h", "c", 1)]


def test_kmers_are_counted_in_the_task(spark):
    texts = {"a": "ABCABCABD", "b": "AB", "c": "Zé𝄞Zé𝄞", "d": "AAAA" * 50, "e": None, "f": ""}
    df = spark.createDataFrame(list(texts.items()) + [(None, "ABCD"), ("a", "XYZ")], "seq_id string, seq_str string")
    for k, dim in ((3, 64), (1, 8), (5, 16)):
        x = EM.kmer_embed(df, k, dim)
        assert "Generate" not in plan(x)
        got = {}
        for r in x.collect():
            got.setdefault(r.seq_id, {})[r.dim] = r.value
        want = {}
        for i, t in [*texts.items(), ("a", "XYZ")]:
            for j in range(len(t or "") - k + 1):
                w = hashlib.md5(t[j:j + k].encode()).hexdigest()
                want.setdefault(i, Counter())[int(w[:8], 16) % dim] += 1
        assert set(got) == set(want)
        for i, c in want.items():
            norm = math.sqrt(sum(n * n for n in c.values()))
            assert got[i].keys() == c.keys() and all(abs(got[i][d] - n / norm) < 1e-12 for d, n in c.items())


def test_boundaries_without_a_shuffle_of_residues(spark):
    df = spark.createDataFrame([("a", "ABCDE"), ("b", "AB"), ("c", "XYZ"), ("d", ""), ("e", None)], "seq_id string, seq_str string")
    x = EM.strip_boundary(EM.explode_residues(df), ["seq_id"])
    text = plan(x)
    assert "SortMergeJoin" not in text and "Generate" in text
    lines = text.splitlines()
    first = max(i for i, line in enumerate(lines) if "Exchange" in line)
    assert all(i < first for i, line in enumerate(lines) if "Generate" in line)  # only texts are dealt out
    assert sorted((r.seq_id, r.pos, r.aa) for r in x.collect()) == [("a", 0, "B"), ("a", 1, "C"), ("a", 2, "D"), ("c", 0, "Y")]
