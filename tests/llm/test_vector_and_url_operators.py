import hashlib
import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from seqmill.llm import codes, urlfilter, whitening

WIDE = "vec_id long, embedding array<float>, label int, k string, w int, n string, y int, code string, error int"


def vectors(spark, rows, parts=3):
    """A vector table with further columns whose names are also used inside the operators."""
    return spark.createDataFrame([(i, v, y, "k", 1, "n", 2, "c", 3) for i, v, y in rows], WIDE).repartition(parts)


def odd_rows(seed=1, n=300, d=12):
    r = np.random.default_rng(seed)
    rows = [(i, [float(np.float32(c)) for c in r.normal(size=d) * np.linspace(0.05, 1.5, d)], int(i % 4) or None) for i in range(n)]
    rows += [rows[5]] * 40 + [(n, rows[7][1], 3), (None, rows[9][1], 1), (n + 1, [0.0] * d, 2)]
    bad = [(900, None, 1), (901, [], 1), (902, [1.0] * (d - 1) + [None], 1), (903, [float("nan")] + [0.0] * (d - 1), 1),
           (904, [float("inf")] + [0.0] * (d - 1), 1), (905, [1.0, 2.0], 1)]
    return rows, bad


# ---- 11 whitening

def exact(rows):
    x = [[math.floor(1024 * c) + 100_000 for c in v] for _, v, _ in rows]
    n, d = len(x), len(x[0])
    s = [sum(v[j] for v in x) for j in range(d)]
    dev = [sum((n * v[j] - s[j]) ** 2 for j in range(d)) for v in x]
    c = np.array([[n * a - b for a, b in zip(v, s)] for v in x], object)
    cov = np.array([[int(q) / n ** 3 for q in row] for row in c.T.dot(c)])
    return x, s, dev, cov


def test_whitening_against_exact_covariance(spark):
    rows, bad = odd_rows()
    got = whitening.whiten(vectors(spark, rows + bad), components=8).collect()
    x, s, dev, cov = exact(rows)
    n = len(rows)
    assert len(got) == 8 * n and {r.n for r in got} == {n}
    values, axes = np.linalg.eigh(cov)
    values, axes = values[::-1], axes[:, ::-1]
    by_row = {}
    for r in got:
        by_row.setdefault((r.vec_id, int(r.deviation)), {}).setdefault(r.component, []).append(r.whitened)
        assert abs(r.explained - values[r.component - 1] / np.trace(cov)) < 1e-9
        assert r.identity_error < 1e-9
    want = {}
    centred = np.array([[(n * a - b) / n for a, b in zip(v, s)] for v in x])
    for (key, *_), d, y in zip(rows, dev, centred @ axes[:, :8] / np.sqrt(values[:8])):
        want.setdefault((key, d), []).append(y)
    assert set(want) == set(by_row)
    for name, ys in want.items():
        for c in range(8):
            assert np.allclose(np.abs([y[c] for y in ys]), np.abs(by_row[name][c + 1]), atol=1e-7)


def test_whitening_without_spread_and_without_rows(spark):
    same = [(i, [0.5, -0.25, 0.125], 1) for i in range(5)]
    got = whitening.whiten(vectors(spark, same), components=8).collect()
    assert len(got) == 15 and all(r.whitened is None and r.deviation == 0 and r.identity_error is None for r in got)
    line = [(i, [float(i), 2.0 * i, 0.0], 1) for i in range(9)]  # one direction only
    got = whitening.whiten(vectors(spark, line), components=2).collect()
    assert [r.whitened is None for r in sorted(got, key=lambda r: r.component)] == [False] * 9 + [True] * 9
    assert all(r.identity_error < 1e-9 for r in got)
    assert whitening.whiten(vectors(spark, []), components=8).count() == 0
    assert whitening.whiten(vectors(spark, [(1, None, 1)]), components=8).count() == 0


def test_whitening_keeps_large_entries_exact(spark):
    rows = [(i, [float((-1) ** i * (3 << 20) + i), float(i * i), 2.0 ** -12], 1) for i in range(20)]
    got = {r.vec_id: r for r in whitening.whiten(vectors(spark, rows), components=1).collect()}
    _, _, dev, _ = exact(rows)
    assert [int(got[i].deviation) for i in range(20)] == dev
    assert whitening.whiten(vectors(spark, rows + [(99, [3e38, 0.0, 0.0], 1)]), components=1).count() == 21


# ---- 12 URL rules

def judged(url, rules, default="allow"):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
        path = rest[cut:].split("?")[0].split("#")[0]
    fits = [(len(h) + len(p), h.count("."), v == "block", h + p) for h, p, v in rules
            if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits) if fits else None
    return host, path, best and best[3], default if best is None else "block" if best[2] else "allow"


RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"),
         ("net", "/fr/", "block"), ("a.b.net", "", "allow"), ("a.b.net", "/fr", "block"), ("b.net", "/fr/x/deep", "allow"),
         ("example.com", "/en/", "allow"), ("x.org", "/é/", "block")]
URLS = ["http://www.example.com/en/1", "https://EXAMPLE.com/en/?q=http://z.net/es/", "http://sub.example.com/en", "ftp://example.com",
        "http://notexample.com/en/", "http://x.net/es/", "//x.net/es/", "", None, "x.net/fr/", "http://a.b.net", "http://q.a.b.net#/fr",
        "http://b.net/fr/x/deeper", "http://a.b.net/fr/x/deep", "http://.net/es/", "http://net/es/", "http://com", "http://com/", "http://",
        "http://u@example.com:80/en/", "http://x.net:80/es/", "http://x.org/é/ü", "http://ÄB.com/", "http://a.net//es/",
        "http://" + "a." * 5000 + "net/es/" + "x/" * 20_000, "http://h.com/" + "y" * 100_000]


@pytest.mark.parametrize("bounds", [{}, {"most_rules": 0}, {"most_shapes": 1, "most_rows": 20}])
def test_url_rules_against_brute_force(spark, bounds):
    r = random.Random(4)
    urls = URLS + URLS[:6] + [f"http://{r.choice(['', 'www.', 'a.b.', 'q.'])}{r.choice(['example.com', 'net', 'b.net', 'x.org'])}"
                              f"{r.choice(['/en/', '/fr/', '/es', '/fr/x/deep/', ''])}{r.choice(['', '7', '?a', '#b'])}" for _ in range(200)]
    urls += ["http://hot.example.com/en/9"] * 120
    pages = spark.createDataFrame([(i if i % 50 else None, u, "mine", "r", 7, "x") for i, u in enumerate(urls)],
                                  "page_id long, url string, host string, row string, row_no int, s string").repartition(4)
    rules = spark.createDataFrame(RULES + [(None, "/", "block"), ("", "/", "block"), ("net", "/", "maybe"), ("zz", None, "block")],
                                  "host string, path string, verdict string")
    # of two rules for the same host and path block wins
    want = [judged(u, [x for x in RULES if x != ("example.com", "/en/", "allow")]) for u in urls]
    out = urlfilter.judge(pages, rules, **bounds)
    assert set(out.columns) == {"page_id", "url", "row", "row_no", "s", "host", "path", "rule", "verdict"}
    got = out.select("page_id", "url", "host", "path", "rule", "verdict").collect()
    key = repr
    assert sorted([(i if i % 50 else None, u, *w) for i, (u, w) in enumerate(zip(urls, want))], key=key) == sorted(map(tuple, got), key=key)
    assert urlfilter.judge(pages.limit(0), rules, **bounds).count() == 0
    none = urlfilter.judge(pages, rules.limit(0), default="block", **bounds).groupBy("rule", "verdict").count().collect()
    assert [tuple(x) for x in none] == [(None, "block", len(urls))]


# ---- 13 codes

def plain_codes(rows, parts=4, entries=256, rounds=4):
    """Vectors, codes, errors and codebooks by comparing every part with every entry."""
    rows = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))
    x = np.array([[math.floor(1024 * c) for c in v] for _, v, _ in rows], np.int64)
    edges = [j * x.shape[1] // parts for j in range(parts + 1)]
    books = [x[:entries, a:b].copy() for a, b in zip(edges, edges[1:])]
    for turn in range(rounds + 1):
        squares = [((x[:, None, a:b] - book[None]) ** 2).sum(2) for a, b, book in zip(edges, edges[1:], books)]
        code = [s.argmin(1) for s in squares]
        if turn < rounds:
            for (a, b), book, c in zip(zip(edges, edges[1:]), books, code):
                for e in set(c.tolist()):
                    mine = x[c == e, a:b]
                    book[e] = mine.sum(0) // len(mine)
    error = sum(s.min(1) for s in squares)
    digest = hashlib.sha256(",".join(str(v) for b in books for v in b.ravel()).encode()).hexdigest()
    texts = ["".join(f"{c[i]:02x}" for c in code) for i in range(len(rows))]
    return rows, texts, error, digest


@pytest.mark.parametrize("entries,block_rows", [(256, 8192), (7, 100), (1, 33)])
def test_codes_against_brute_force(spark, entries, block_rows):
    rows, bad = odd_rows(seed=entries, n=700, d=14)  # 14 components: parts of 3 and 4
    rows, texts, error, digest = plain_codes(rows, entries=entries)
    got = codes.compress(vectors(spark, rows + bad), entries=entries, block_rows=block_rows).collect()
    assert {r.codebooks_sha256 for r in got} == {digest}
    by_label = {}
    for (_, _, y), e in zip(rows, error):
        by_label[y] = by_label.get(y, 0) + int(e)
    want = [(i, y, t, int(e), by_label[y]) for (i, _, y), t, e in zip(rows, texts, error)]
    assert sorted(want, key=repr) == sorted([(r.vec_id, r.label, r.code, r.error, r.label_error) for r in got], key=repr)


def test_codes_of_few_rows_and_none(spark):
    got = codes.compress(vectors(spark, [(2, [1.0, -1.0, 0.5, 0.25], None), (1, [1.0, -1.0, 0.5, 0.25], 4)])).collect()
    assert {(r.vec_id, r.code, r.error, r.label_error) for r in got} == {(1, "00000000", 0, 0), (2, "00000000", 0, 0)}
    assert codes.compress(vectors(spark, [])).count() == 0
    assert codes.compress(vectors(spark, [(1, None, 1), (2, [], 1)])).count() == 0
    assert codes.compress(vectors(spark, [(1, [3e38, 0.0, 1.0, 2.0], 1), (2, [0.0] * 4, 1)])).count() == 2


def test_trees_hold_every_row_once_and_prune():
    r = np.random.default_rng(3)
    centres = r.integers(-3000, 3000, (40, 5))
    x = np.concatenate([c + r.integers(-20, 20, (150, 5)) for c in centres] + [np.tile(centres[:1], (3000, 1))])
    t = codes.tree(x)
    assert sorted(t["order"].tolist()) == list(range(len(x)))
    for ball in range(len(t["lo"])):
        a, b = t["lo"][ball], t["hi"][ball]
        assert (t["total"][ball] == x[t["order"][a:b]].sum(0)).all()
        if t["left"][ball] >= 0:
            left, right = t["left"][ball], t["right"][ball]
            assert (t["lo"][left], t["hi"][left], t["hi"][right]) == (a, t["lo"][right], b)
        mean = t["total"][ball] / (b - a)
        assert np.sqrt(((x[t["order"][a:b]] - mean) ** 2).sum(1)).max() <= t["radius"][ball] + 1e-9
    book = np.concatenate([centres, centres[:3]])  # equal entries: the lower number is taken
    code, sums, counts, singly = codes.nearest(t, book)
    plain = ((x[t["order"]][:, None] - book[None]) ** 2).sum(2).argmin(1)
    assert (code == plain).all() and (counts == np.bincount(plain, minlength=43)).all()
    assert singly < len(x) / 10  # nearly all balls are counted whole
    big = x.astype(np.int64) * 20_000  # squares beyond what doubles hold exactly
    t = codes.tree(big)
    assert (codes.nearest(t, book * 20_000)[0] == ((big[t["order"]][:, None] - book[None] * 20_000) ** 2).sum(2).argmin(1)).all()


def test_label_totals_of_many_labels(spark):
    from seqmill.llm.common import total_joined
    rows = spark.range(2000).select(F.when(F.col("id") > 500, F.lit(7)).when(F.col("id") > 2, F.col("id")).alias("y"))
    totals = rows.groupBy("y").agg(F.count("*").alias("s"), F.count("*").alias("n"))
    got = {(r.y, r.s): r["count"] for r in total_joined(rows, totals, "y", "s").groupBy("y", "s").count().collect()}
    assert got[7, 1500] == 1500 and got[None, 3] == 3 and len(got) == 499
    split = {(r.y, r.s): r["count"] for r in total_joined(rows, totals, "y", "s", most_rows=2, most_keys=1).groupBy("y", "s").count().collect()}
    assert split == got
