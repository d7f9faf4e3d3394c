import base64
import hashlib
import math
import random
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from seqmill.llm import (crosspoly, ctxmix, htmltext, mixing, packing, quality, simhash, sketch, tokenfile, tokens, warc)
from seqmill.llm.components import components
from seqmill.llm.common import shared_path
from tests.llm import brute

VOCAB = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, source string, lang string, k string, h string, t int, size int, word string, part int"


def documents(spark, texts, sources=None, ids=None, extra=0):
    """A documents table with further columns whose names are also used inside the operators."""
    rows = [(ids[i] if ids else i, t, sources[i] if sources else "s", "en", "x", "y", 1, 2, "w", 3)
            for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


def corpus(n=120, seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice(["an", "th", "er", "on", "re", "é", "Ü"]) for _ in range(r.randint(1, 5))) for _ in range(400)]
    out = [" ".join(r.choice(vocab) for _ in range(r.randint(1, 90))) for _ in range(n)]
    for i in range(0, n, 6):  # near copies
        ws = out[i].split()
        ws[r.randrange(len(ws))] = "changed"
        out[(i + 1) % n] = " ".join(ws)
    out[5] = out[11] = out[17]
    out[20], out[21], out[22], out[23] = None, "", " \t\n ", "one two"
    out[30] = " ".join(r.choice(vocab) for _ in range(9000))
    out[31] = "x" * 50_000
    return out


# ---- 1 quality

def test_quality_learns_and_handles_odd_rows(spark):
    r = random.Random(1)
    good = [" ".join(r.choice(["the", "and", "word", "stone", "river,", "house."]) for _ in range(r.randint(30, 200))) for _ in range(150)]
    bad = [" ".join(r.choice(["a###", "b$$$", "|", "12%%"]) for _ in range(r.randint(30, 200))) for _ in range(150)]
    texts = good + bad + [None, "", "z" * 100_000, good[0]]
    docs = documents(spark, texts)
    labels = spark.createDataFrame([(i, 1 if i < 150 else 0, 0) for i in range(300)] + [(5, None, 0), (9999, 1, 0)],
                                   "doc_id long, quality int, toxic int")
    got = {x.doc_id: x for x in quality.quality(docs, labels).collect()}
    assert len(got) == len(texts)
    assert all(got[i].held_out == brute.held_out(i, 3, 1) for i in got)
    assert all(0 <= x.score <= 1 and x.predicted == int(x.score >= 0.5) for x in got.values())
    held = [i for i in range(300) if got[i].held_out]
    assert np.mean([got[i].predicted == (i < 150) for i in held]) > 0.97
    assert got[300].score == got[301].score  # null is the empty text
    kept = quality.accepted(docs, labels)
    assert kept.schema == docs.schema
    assert {x.doc_id for x in kept.collect()} == {i for i, x in got.items() if x.predicted}
    none = labels.where("quality is null")
    assert {x.score for x in quality.quality(docs, none).collect()} == {0.5}
    assert quality.quality(docs.limit(0), labels).count() == 0
    assert quality.accepted(docs.limit(0), labels).count() == 0


def test_discriminant_against_direct_formula(spark):
    r = np.random.default_rng(0)
    d = len(quality.FEATURES)
    x = np.concatenate([r.normal(size=(80, d)), r.normal(size=(60, d)) @ np.diag(np.linspace(0.5, 2, d)) + 1])
    y = [0] * 80 + [1] * 60
    df = spark.createDataFrame([(v.tolist(), c) for v, c in zip(x, y)], "x array<double>, label int").repartition(4)
    m = quality.fit(df, to_pooled=0.2, to_sphere=0.1)
    z = (x - x.mean(0)) / x.std(0)
    cov = [np.cov(z[np.array(y) == c].T, bias=True) for c in (0, 1)]
    pooled = (80 * cov[0] + 60 * cov[1]) / 140
    dens = []
    for c in (0, 1):
        s = 0.8 * cov[c] + 0.2 * pooled
        s = 0.9 * s + 0.1 * np.trace(s) / d * np.eye(d)
        mu = z[np.array(y) == c].mean(0)
        dens.append([-0.5 * (v - mu) @ np.linalg.solve(s, v - mu) - 0.5 * np.linalg.slogdet(s)[1] for v in z])
    want = 1 / (1 + np.exp(-(math.log(61 / 81) + np.array(dens[1]) - np.array(dens[0]))))
    assert np.allclose(m.scores(x), want, atol=1e-6)


# ---- 2 language model

def test_context_mixing_counts_and_scores(spark):
    texts = corpus()
    docs = documents(spark, texts)
    got = {x.doc_id: x for x in ctxmix.scores(docs, chunk_bytes=20_000).collect()}
    n, want = brute.base_scores(list(enumerate(texts)))
    assert set(got) == set(want)
    for k, (tokens_, known, base) in want.items():
        x = got[k]
        assert (x.n_tokens, x.n_known, x.train_tokens, x.held_out) == (tokens_, known, n, brute.held_out(k, 7, 2))
        assert abs(x.base_score - base) < 1e-6 * max(1, abs(base)) and x.score < 0 and x.bits_per_byte > 0
    again = {x.doc_id: x.score for x in ctxmix.scores(docs.repartition(5), chunk_bytes=1 << 24).collect()}
    assert all(abs(again[k] - got[k].score) < 1e-5 * abs(again[k]) + 1e-3 for k in got)  # however the rows are dealt out
    assert ctxmix.scores(docs.limit(0)).count() == 0


def test_context_mixing_is_a_probability():
    """All words of up to two bytes, all longer ones that begin with them: bit probabilities add up to one."""
    r = np.random.default_rng(2)
    ws = [bytes(r.integers(97, 103, r.integers(1, 6)).astype(np.uint8)) for _ in range(500)] + [b""]
    counts = np.zeros(2 * ctxmix.SLOTS)
    ctxmix.count_bits(ctxmix.Coded(ws), np.ones(len(ws)), counts)
    m = ctxmix.Mixer()
    m.learn(counts.astype(np.float32), ctxmix.Coded(ws), np.ones(len(ws)))
    model = ctxmix.Model.of(counts.astype(np.float32), m.weights, m.seen)
    # the first byte is the end, or any byte: all 256 first bytes share the mass
    coded = ctxmix.Coded([bytes([b]) for b in range(256)])
    bits = np.zeros(len(coded.byte))
    for bit, slots in coded.bits():
        gate = model.gate[slots[-1] - ctxmix._BASE[-2]]
        mixed = sum(model.odds[s] * model.weights[gate, i] for i, s in enumerate(slots))
        mixed = 0.5 * (mixed + model.refined[gate, ctxmix._bin(mixed)])
        bits -= np.logaddexp(0, np.where(bit == 1, -mixed, mixed))
    assert abs(np.exp(bits[coded.first]).sum() - 1) < 1e-4


def _follow_data():
    r = np.random.default_rng(5)
    texts = [[int(w) for w in r.zipf(1.3, n) if w < 40] + [0] for n in (30, 1, 0, 60, 25)]
    flat = np.array([w for t in texts for w in t])
    size = np.array([len(t) for t in texts])
    word = np.log10(r.dirichlet(np.ones(40)))
    word[7] = -400.0  # smaller than any double
    seen = np.bincount(flat, minlength=40)
    pairs = Counter()
    for t in texts:
        pairs.update(zip([0] + t, t))
    return texts, flat, size, word, seen, pairs


def test_word_mixture_against_plain_sums():
    texts, flat, size, word, seen, pairs = _follow_data()
    pair = np.array([pairs[p, w] for t in texts for p, w in zip([0] + t, t)], float)
    sums = ctxmix._log_sums(flat, size, word, seen, pair)
    gates = len(ctxmix._BEFORE) + 1
    for d, t in enumerate(texts):
        for f, follow in enumerate(ctxmix.FOLLOW):
            for i, share in enumerate(ctxmix.SHARES):
                want = np.zeros(gates)
                for at, (p, w) in enumerate(zip([0] + t, t)):
                    gate = int((ctxmix._BEFORE <= seen[p]).sum())
                    cache = t[:at].count(w) / max(at, 1)
                    rest = share * cache + (1 - share) * follow * pairs[p, w] / seen[p]
                    own = word[w] + math.log10((1 - share) * (1 - follow))
                    want[gate] += own if not rest else math.log10(rest + 10.0 ** own)
                assert np.allclose(sums[d, :, f, i], want, atol=1e-9)
    # the gates' shares as learnt: each word without its own occurrence
    train = np.repeat(np.arange(len(size)) % 2 == 0, size)
    gain = ctxmix.follow_gains(10.0 ** word[flat], ctxmix._before(flat, seen), pair, train)
    want = np.zeros(gain.shape)
    for d, t in enumerate(texts):
        for p, w in zip([0] + t, t):
            if d % 2 == 0 and seen[p] > 1:
                gate, q = int((ctxmix._BEFORE <= seen[p] - 1).sum()), (pairs[p, w] - 1) / (seen[p] - 1)
                want[gate] += np.log10(1 - ctxmix.FOLLOW + ctxmix.FOLLOW * q / max(10.0 ** word[w], 1e-300))
            elif d % 2 == 0:
                want[0] += np.log10(1 - ctxmix.FOLLOW)
    assert np.allclose(gain / 1e6, want, atol=1e-4)
    best = gain.argmax(1)
    every = sums[:, np.arange(len(best)), best].sum(1)
    assert np.allclose(10 ** (ctxmix._chosen(sums, best) - every.max(1)), (10 ** (every - every.max(1, keepdims=True))).mean(1))


@pytest.mark.parametrize("task_pairs", [1 << 20, 3000, 1])
def test_pair_counts_against_a_counter(spark, monkeypatch, task_pairs):
    """Buckets put together, as they are, and cut into finer ones."""
    monkeypatch.setattr(ctxmix, "_TASK_PAIRS", task_pairs)
    r = np.random.default_rng(6)
    rows, want, chunks_ = [], Counter(), {}
    low = ctxmix._PAIR_BITS - ctxmix._BUCKET_BITS
    pool = r.integers(0, 1 << ctxmix._PAIR_BITS, 6000, dtype=np.uint64)
    for chunk in range(3):
        keys = np.unique(r.choice(pool, 4000))
        counts = r.integers(0, 300, len(keys)).astype(np.uint32)
        chunks_[chunk] = keys
        want.update(dict(zip(keys.tolist(), counts.tolist())))
        name = (keys >> np.uint64(low)).astype(np.int64)
        for b in np.unique(name):
            at = name == b
            rows.append((chunk, int(b), int(at.sum()), ctxmix._packed_keys(keys[at]), ctxmix._packed_counts(counts[at])))
    ctxmix.ship(spark)
    df = spark.createDataFrame(rows, "chunk long, bucket long, n long, keys binary, counts binary")
    got = {}
    for x in ctxmix.pair_counts(df).orderBy("chunk", "bucket").collect():
        got.setdefault(x.chunk, []).append(np.frombuffer(zlib.decompress(x.totals), "<f4"))
    for chunk, keys in chunks_.items():
        assert np.concatenate(got[chunk]).tolist() == [want[k] for k in keys.tolist()]


def test_context_mixing_learns_the_order_of_words(spark):
    r = np.random.default_rng(8)
    names = [f"w{i}" for i in range(60)]
    after = {w: list(r.choice(names, 3)) for w in names}

    def text(n=80):
        ws = [str(r.choice(names))]
        while len(ws) < n:
            ws.append(str(r.choice(after[ws[-1]])))
        return ws
    texts = [text() for _ in range(150)]
    shuffled = [list(r.permutation(t)) if brute.held_out(k, 7, 2) else t for k, t in enumerate(texts)]
    real, mixed = ({x.doc_id: x for x in ctxmix.scores(documents(spark, [" ".join(t) for t in ts])).collect()}
                   for ts in (texts, shuffled))
    for k, x in real.items():
        assert x.score > x.base_score
        assert not x.held_out or x.score > mixed[k].score + 20


def test_context_mixing_repeats_nulls_and_clashing_columns(spark):
    rows = [(1, "one two one", 5), (1, "one two one", 6), (None, None, 7), (2, "", 8), (3, "zebra", 9), (4, "q" * 5000, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, chunk int")
    docs = docs.withColumn("held", F.lit("x")).withColumn("totals", F.lit(1)).withColumn("word", F.col("chunk"))
    got = ctxmix.scores(docs).collect()
    assert len(got) == 6 and all(x.score < 0 and math.isfinite(x.score) for x in got)
    twice = [x for x in got if x.doc_id == 1]
    assert twice[0] == twice[1] and "held" not in twice[0]
    assert all(x.n_tokens == 1 for x in got if x.doc_id in (None, 2))


def test_distinct_pairs_in_little_memory():
    r = np.random.default_rng(9)
    texts = [np.append(r.integers(1, 300, n), 0).astype(np.uint32) for n in r.integers(0, 4000, 400)]
    train = [i % 3 > 0 for i in range(len(texts))]
    hashes = r.integers(0, 1 << 48, 300, dtype=np.uint64)
    tracemalloc.start()
    keys, times = ctxmix.distinct_pairs(texts, train, hashes)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    want = Counter()
    for x, learnt in zip(texts, train):
        for k in ctxmix._pairs(x, hashes).tolist():
            want[k] += learnt
    assert keys.tolist() == sorted(want) and times.tolist() == [want[k] for k in keys.tolist()]
    assert most < 32 * sum(map(len, texts))  # bytes a word; 8 of them are the key


def test_places_of_words_go_to_their_chunks_and_back():
    r = np.random.default_rng(10)
    chunks_, idx = [np.concatenate(x) for x in zip(*((np.full(n, c), r.permutation(n)) for c, n in ((3, 5000), (1 << 40, 70), (7, 1))))]
    total = r.integers(0, 9, len(idx))
    total[17] = 1 << 33  # more than 32 bits
    lp, hashes, size = r.normal(size=len(idx)).astype(np.float32), r.integers(0, 1 << 48, len(idx), dtype=np.uint64), r.integers(0, 1 << 20, len(idx))
    at = r.permutation(len(idx))
    rows = [b for part in np.array_split(at, 3) for b in ctxmix.packed_places(*(x[part] for x in (chunks_, idx, total, lp, hashes, size)))]
    rows = pa.Table.from_batches(rows).to_pylist()
    for c in np.unique(chunks_):
        got = ctxmix.unpacked_places(pa.Table.from_pylist([x for x in rows if x["chunk"] == c]))
        own = np.flatnonzero(chunks_ == c)[np.argsort(idx[chunks_ == c])]
        assert [x.tolist() for x in got] == [x[own].tolist() for x in (total, lp.astype(float), hashes, size)]


# ---- 3 packing

def test_packing_is_gapless_and_tight(spark):
    texts = corpus()
    docs = documents(spark, texts).unionByName(documents(spark, ["same text"] * 40, ids=[7] * 40))
    rows = packing.pack(docs, VOCAB, capacity=512).collect()
    tok = __import__("tokenizers").Tokenizer.from_file(VOCAB)
    by_doc = {}
    for x in rows:
        by_doc.setdefault(x.doc_id, []).append(x)
    for i, t in enumerate(texts):
        if i == 7:
            continue
        ids = tok.encode(t or "", add_special_tokens=False).ids + [1]
        ps = sorted(by_doc[i], key=lambda x: x.piece)
        want = [ids[a:a + 512] for a in range(0, len(ids), 512)]
        assert [(p.piece, p.start, p.length, p.ids_crc32) for p in ps] == [
            (j, 512 * j, len(w), zlib.crc32(np.array(w, "<u4").tobytes())) for j, w in enumerate(want)]
    assert len(by_doc[7]) == 41
    seqs = {}
    for x in rows:
        seqs.setdefault(x.sequence_id, []).append((x.offset, x.length))
    for parts in seqs.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 512
    assert len(seqs) <= -(-sum(x.length for x in rows) // 512) + 1
    assert packing.pack(docs.limit(0), VOCAB).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_patterns_use_every_length_once(seed):
    r = np.random.default_rng(seed)
    counts = np.zeros(65, np.int64)
    for x in r.integers(1, 65 if seed % 2 else 30, r.integers(1, 400)):
        counts[x] += 1
    got = np.zeros(65, np.int64)
    bins = 0
    for lengths, m in packing.plan_patterns(counts, 64):
        assert sum(lengths) <= 64 and m > 0
        bins += m
        for x in lengths:
            got[x] += m
    assert (got == counts).all()
    assert bins <= 1.25 * (counts * np.arange(65)).sum() / 64 + 1


# ---- 4 WARC

def test_warc_round_trip_and_splits(spark):
    r = random.Random(5)
    html = [f"<p>{i} " + "".join(r.choice("abc\x1f é\n") for _ in range(r.randint(0, 3000))) for i in range(60)]
    html[3] = html[40] = html[41]
    html[10], html[11], html[12] = None, "", "y" * 400_000
    html[13] = "WARC/1.1\r\nWARC-Type: response\r\n\r\n"
    rows = [(i, f"http://e.example/{i} \r\nX: y", h, "x") for i, h in enumerate(html)] + [
        (None, None, html[3], "x"), (40, "u", html[40], "x"), (41, "u", html[41], "x"), (None, None, "only null", "x")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string").repartition(4)
    for least in (0, 30):
        got = sorted(warc.round_trip(pages, least, split_bytes=997).collect(), key=str)
        want = []
        for i, _, h, _ in rows:
            data = (h or "").encode()
            same = [j for j, _, g, _ in rows if (g or "").encode() == data]
            top = max((j for j in same if j is not None), default=None)
            whole = len(data) < least or i == top
            want.append((i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(),
                         "response" if whole else "revisit", None if whole else top))
        assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    folder = shared_path(spark, "warc-test")
    files = warc.write_archives(pages, folder)
    back = warc.read_archives(spark, folder, files, split_bytes=5000).where("record_type = 'response'")
    texts = {x.k if "k" in x else x.page_id: x.payload for x in back.collect()}
    assert bytes(texts[12]).decode() == html[12]
    assert warc.round_trip(pages.limit(0)).count() == 0


# ---- 5 fingerprints

def test_fingerprints_against_brute_force(spark):
    texts = corpus()
    ids = [3 * i - 50 for i in range(len(texts))]
    ids[-1] = None
    docs = documents(spark, texts, ids=ids)
    k, width = 16, 5
    got = {x.doc_id: x for x in sketch.fingerprints(docs, k, width).collect()}
    order = sorted([i for i in range(len(texts)) if ids[i] is not None], key=lambda i: -ids[i]) + [len(texts) - 1]
    after = {i: order[(a + 1) % len(order)] for a, i in enumerate(order)}
    edited = {}
    for i in order:
        t, nxt = texts[i] or "", texts[after[i]] or ""
        half = len(t) // 2
        edited[i] = t[:len(t) - half] + nxt[:half]
    # hashes by Spark itself: of words, and of lists of word hashes
    lists = set()
    for t in list(texts) + list(edited.values()):
        ws = brute.split_words((t or "").lower())
        lists.update(tuple(ws[a:a + width]) for a in range(max(len(ws) - width + 1, 1)) if ws)
    table = spark.createDataFrame([(list(x),) for x in lists], "w array<string>")
    hashed = {}
    for n in range(1, width + 1):
        part = table.where(F.size("w") == n).withColumn("h", F.transform("w", lambda w: F.xxhash64(w)))
        for x in part.select("w", F.xxhash64(*[F.col("h")[j] for j in range(n)],
                                             *[F.lit(None).cast("long")] * (width - n)).alias("h")).collect():
            hashed[tuple(x.w)] = x.h
    for i in order:
        x = got[ids[i]]
        mine, other = (brute.sketch(t, k, width, lambda s: hashed[tuple(s)]) for t in (texts[i], edited[i]))
        nxt = brute.sketch(texts[after[i]], k, width, lambda s: hashed[tuple(s)])

        def near(a, b):
            u = sorted(set(a) | set(b))[:k]
            return len([h for h in u if h in a and h in b]) / len(u) if u else 1.0

        assert (x.n_chars, x.edited, list(x.sketch), list(x.edited_sketch)) == (len(texts[i] or ""), edited[i], mine, other)
        assert abs(x.near_edited - near(mine, other)) < 1e-12 and abs(x.near_next - near(mine, nxt)) < 1e-12
    assert sketch.fingerprints(docs.limit(0)).count() == 0
    one = sketch.fingerprints(documents(spark, ["a b c"])).first()
    assert one.near_next == 1.0


def test_sketches_merge_and_estimate(spark):
    a, b = range(0, 4000), range(2000, 5000)
    rows = [("a", i) for i in a] + [("b", i) for i in b]
    df = spark.createDataFrame(rows, "g string, x long").withColumn("p", F.pmod("x", F.lit(7)))
    parts = df.groupBy("g", "p").agg(F.sort_array(F.collect_set(F.xxhash64("x"))).alias("sketch"))
    whole = {x.g: x.sketch for x in sketch.merge_parts(parts.select("g", F.slice("sketch", 1, 128).alias("sketch")), ["g"]).collect()}
    exact = {x.g: x.s[:128] for x in df.groupBy("g").agg(F.sort_array(F.collect_set(F.xxhash64("x"))).alias("s")).collect()}
    assert whole == exact
    x = spark.createDataFrame([(whole["a"], whole["b"])], "a array<long>, b array<long>").select(
        sketch.resemblance(F.col("a"), F.col("b")).alias("r"), sketch.containment(F.col("b"), F.col("a")).alias("c"),
        sketch.distinct_shingles(F.col("a")).alias("n")).first()
    assert abs(x.r - 0.4) < 0.15 and abs(x.c - 2 / 3) < 0.25 and abs(x.n - 4000) < 1200


def test_in_key_order_deals_ranges(spark):
    df = documents(spark, ["some text " * 50] * 200, ids=[i * i for i in range(200)])
    got = sketch.in_key_order(df.select("doc_id", "text"), "doc_id", "text", bytes_each=10_000).collect()
    parts = {}
    for x in got:
        parts.setdefault(x.part, []).append(x.doc_id)
    assert len(parts) > 5
    spans = [(min(v), max(v)) for _, v in sorted(parts.items())]
    assert all(a[0] > b[1] for a, b in zip(spans, spans[1:]))


# ---- 6 mixing

def test_mixing_targets_and_nesting(spark):
    r = random.Random(8)
    texts = [" ".join(["w"] * r.randint(0, 60)) for _ in range(400)] + [None, "", "v " * 5000]
    sources = [r.choice(["b", "a", "a", "a", "c", None]) for _ in texts]
    docs = documents(spark, texts, sources)
    got = mixing.mix(docs).collect()
    sizes, weight = {}, {}
    for t, s in zip(texts, sources):
        sizes[s] = sizes.get(s, 0) + len(brute.split_words(t))
    for i, s in enumerate(sorted(sizes, key=lambda s: (s is None, s or ""))):
        weight[s] = [5, 2, 1][i % 3]
    total, target, free = sum(sizes.values()), {}, set(sizes)
    while True:
        rest = total - sum(target.values())
        share = {s: rest * weight[s] / sum(weight[x] for x in free) for s in free}
        over = [s for s in free if share[s] > 3 * sizes[s]]
        if not over:
            target.update(share)
            break
        for s in over:
            target[s] = 3 * sizes[s]
            free.discard(s)
    taken = {}
    for x in got:
        assert (x.size, x.source_size) == (len(brute.split_words(texts[x.doc_id])), sizes[x.source])
        assert abs(x.target - target[x.source]) < 1e-6 and 0 <= x.taken <= 3 * x.size and x.taken == x.copies * x.size
        taken[x.source] = taken.get(x.source, 0) + x.taken
    big = max(len(brute.split_words(t)) for t in texts)
    assert all(abs(taken[s] - target[s]) <= big / 2 + 1 for s in taken)
    again = {(x.doc_id, x.taken) for x in mixing.mix(docs.repartition(7)).collect()}
    assert again == {(x.doc_id, x.taken) for x in got}
    less = {x.doc_id: x.copies for x in mixing.mix(docs, weights=(1.0, 2.0, 5.0)).collect()}
    more = {x.doc_id: x.copies for x in got}
    by = {}
    for d in more:
        by.setdefault(sources[d], set()).add(np.sign(more[d] - less[d]))
    assert all(len(v - {0}) <= 1 for v in by.values())  # a larger target takes all that a smaller one takes
    copies = mixing.mixed_documents(docs)
    assert copies.schema == docs.schema and copies.count() == sum(x.copies for x in got)
    assert mixing.mix(docs.limit(0)).count() == 0 and mixing.mixed_documents(docs.limit(0)).count() == 0


# ---- 7 vectors

def test_cross_polytope_links_against_brute_force(spark):
    r = np.random.default_rng(4)
    base = r.normal(size=(60, 20))
    vecs = [v for b in base for v in [b, b + r.normal(size=20) * 0.08, b + r.normal(size=20) * 0.03, b * 2.5]]
    vecs += [base[0]] * 30 + [base[1] + r.normal(size=20) * 0.01 for _ in range(90)]
    rows = [(i, [float(x) for x in np.float32(v)], int(i % 2) if i < 240 else 0, "u") for i, v in enumerate(vecs)]
    n = len(rows)
    rows += [(n, None, 0, "u"), (n + 1, [0.0] * 20, 0, "u"), (n + 2, [1.0, None], 0, "u"), (n + 3, [float("nan")] * 20, 0, "u"),
             (n + 4, rows[0][1], None, "u"), (n + 5, [], 0, "u"), (n + 6, [1.0, 2.0], 0, "u"), (n + 7, [2.0, 4.0], 0, "u")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int, uid string").repartition(4)
    ok = [i for i, (_, v, y, _) in enumerate(rows) if y is not None and v and None not in v and np.isfinite(v).all() and any(v)]

    def linked(i, j):
        a, b = np.array(rows[i][1], float), np.array(rows[j][1], float)
        return rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / math.sqrt((a @ a) * (b @ b)) >= 0.98

    links = {i: sum(linked(i, j) for j in ok if j != i) for i in ok}
    comp = brute.reach(len(ok), lambda a, b: linked(ok[a], ok[b]))
    for block in (1024, 16):
        got = {x.vec_id: x for x in crosspoly.near_vectors(df, block=block).collect()}
        assert len(got) == len(rows)
        for a, i in enumerate(ok):
            assert (got[i].n_links, got[i].component_id) == (links[i], ok[comp[a]]), i
        for i in set(range(len(rows))) - set(ok):
            assert (got[i].n_links, got[i].component_id, got[i].kept) == (0, i, True)
        assert all(x.kept == (x.vec_id == x.component_id) for x in got.values())
    assert crosspoly.near_vectors(df.limit(0)).count() == 0


def test_hadamard_is_orthonormal():
    h = crosspoly.hadamard(np.eye(16))
    assert np.allclose(h @ h.T, np.eye(16))


# ---- 8 SimHash

def test_simhash_components_against_brute_force(spark):
    texts = corpus(150)
    docs = documents(spark, texts)
    got = {x.doc_id: x for x in simhash.near_duplicates(docs).collect()}
    fps = [brute.simhash(t) for t in texts]
    comp = brute.reach(len(texts), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    assert {i: (x.fp % 2 ** 64, x.component_id) for i, x in got.items()} == {i: (fps[i], comp[i]) for i in range(len(texts))}
    kept = simhash.keep_one(docs)
    assert kept.schema == docs.schema and sorted(x.doc_id for x in kept.collect()) == sorted(set(comp))
    twice = docs.unionByName(docs).unionByName(documents(spark, ["zz yy xx", None], ids=[None, None]))
    assert sorted(str(x.doc_id) for x in simhash.keep_one(twice).collect()) == sorted(map(str, [*set(comp), None]))
    assert simhash.near_duplicates(docs.limit(0)).count() == 0 and simhash.keep_one(docs.limit(0)).count() == 0


def test_dense_groups_of_fingerprints(spark, monkeypatch):
    """Runs over the pairwise size take the second cut; a chain, a ball and strangers keep their components."""
    monkeypatch.setattr(simhash, "PAIRWISE", 8)
    r = random.Random(2)
    center = r.getrandbits(64)
    fps = {center}
    for _ in range(150):
        x = center
        for b in r.sample(range(64), r.randint(1, 5)):
            x ^= 1 << b
        fps.add(x)
    chain = r.getrandbits(64)
    for b in range(0, 60, 3):
        chain ^= 0b111 << b
        fps.add(chain)
    fps |= {r.getrandbits(64) for _ in range(50)}
    fps = sorted(fps)
    df = spark.createDataFrame([(f - 2 ** 64 if f >= 2 ** 63 else f,) for f in fps], "fp long")
    comp = {x.node % 2 ** 64: x.component for x in components(simhash.links(df)).collect()}
    want = brute.reach(len(fps), lambda i, j: (fps[i] ^ fps[j]).bit_count() <= 3)
    groups, mine = {}, {}
    for i, f in enumerate(fps):
        groups.setdefault(want[i], set()).add(f)
        mine.setdefault(comp.get(f, ("alone", f)), set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, mine.values()))


def test_forests_agree():
    r = np.random.default_rng(0)
    x = np.unique(r.integers(0, 1 << 14, 300).astype(np.uint64))

    def groups(a, b):
        comp = {int(v): int(v) for v in x}
        for _ in range(len(x)):
            for p, q in zip(a.tolist(), b.tolist()):
                comp[p] = comp[q] = min(comp[p], comp[q])
        return comp
    assert groups(*simhash._forest(x, 1)) == groups(*simhash._cube_forest(x, 1))


# ---- 9 pages

@pytest.mark.parametrize("page, want", [
    ("", ""), ("plain  text\n here", "plain text here"),
    ("<p>a<p>b", "a\n\nb"), ("<div>a</div><div>b</div>", "a\nb"),
    ("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>", "- a\n- b\n  - c\n- d"),
    ("<ol start=9><li>a<li>b</ol>", "9. a\n10. b"),
    ("<table><tr><td>a<td>long cell<tr><td>wider<td>x</table>", "a      long cell\nwider  x"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
    ("<style>p{}</style><script>if (a<b) '</p>'</script><p hidden>x</p><p style='display: none'>y</p>z", "z"),
    ("<head><title>t</title></head><body>b", "b"), ("a<br>b<!-- c --><b>d", "a\nbd"),
    ("<pre> a\n  b</pre>", " a\n  b"), ("&lt;b&gt; &amp;amp; &#233;", "<b> &amp; é"),
    ("<details><summary>s</summary>t</details>u", "s\nu"), ("1 < 2 <", "1 < 2 <"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"), ("<a title='x > y'>k</a></p></div>", "k"),
    ("<select><option>a<option>b</select>", "a\nb"),
])
def test_visible_text(page, want):
    assert htmltext.visible_text(page) == want


@pytest.mark.parametrize("page, want", [
    ("a <svg><title>t</title><desc><p>d</desc><defs><text>e</text></defs><text x=1>b<tspan>c</tspan></text>"
     "<text>f</text></svg> g", "a\nbc\nf\ng"),
    ("x <math><semantics><mrow><mi>y</mi><mo>=</mo><mn>2</mn></mrow><annotation>y=2</annotation></semantics></math> z", "x y=2 z"),
    ("<svg><title/><path d='M0'/><style/><text>a</text></svg><p>b", "a\n\nb"),
    ("<p>a<svg><foreignObject><p>b</p><div hidden>c</div></foreignObject><g display=none><text>d</text></g></svg>e", "a\n\nb\n\ne"),
    ("<svg><g><text>a<p>b</p>c", "a\n\nb\n\nc"), ("<svg><text><![CDATA[1 < 2 > 0]]></text></svg>", "1 < 2 > 0"),
    ("<math><mtable><mtr><mtd><mn>1</mn></mtd><mtd><mn>2</mn></mtd></mtr><mtr><mtd>3</mtd></mtr></mtable></math>", "1 2\n3"),
])
def test_svg_and_math_text(page, want):
    assert htmltext.visible_text(page) == want


@pytest.mark.parametrize("outer", ["<font>", "<b><i>", "<span>", "<div>", "<blockquote>", "<ul><li>", "<table><tr><td>"])
def test_rules_hold_at_any_depth(outer):
    page = outer * 3000 + ("<p hidden>x</p><template>y</template><svg><desc>z</desc></svg><details>w</details>"
                           "<ul><li>a</li><li>b</li></ul><table><tr><td>1</td><td>2</td></tr><tr><td>3</td></tr></table>")
    text = htmltext.visible_text(page)
    # the leading markers are those of the outer items
    assert [x.split() for x in text.split("\n") if x.strip()][-4:] == [
        (["-"] * 3000 if "li" in outer else []) + ["-", "a"], ["-", "b"], ["1", "2"], ["3"]]
    assert htmltext.visible_text("<b>" * 300 + "<i><u>1</i>2</u>" + "<p>3<div style=display:none>4<u>5</u></div>6") == "12\n\n3\n\n6"


def test_pages_keep_all_words(spark):
    deep = "<div>" * 5000 + "deep" + "<b>" * 5000 + "er"
    html = [None, "", deep, "<table>" * 300 + "<tr><td>x", "<p>" + "w " * 100_000, "<td>q</td>", "\x00<퟿"]
    df = spark.createDataFrame([(i, h, "z") for i, h in enumerate(html)] + [(1, "", "z")], "page_id long, html string, text string")
    got = {x.page_id: x.text for x in htmltext.extract(df).collect()}
    assert got[0] == got[1] == "" and "".join(got[2].split()) == "deeper" and got[3].strip() == "x"
    assert len(got[4].split()) == 100_000 and got[5] == "q"
    assert htmltext.extract(df).count() == len(html) + 1 and htmltext.extract(df.limit(0)).count() == 0


# ---- 10 token files

@pytest.mark.parametrize("keep", [200_000, 40])
def test_texts_of_a_column_equal_the_library(keep):
    tok = __import__("tokenizers").Tokenizer.from_file(VOCAB)
    rnd = random.Random(3)
    parts = ["a", "B", "É", "é", "ß", "×", "÷", "ÿ", "Ÿ", "œ", "İ", "1", "2", "'s", "'t", "'", "’", "<|", "<", ">", "!", "..",
             "\t", "\n", " ", " ", "\x0b", "\x1c", "\x85", "\xa0", "\u3000", "日", "e\u0301", "\x00", "Þ", "'LL", "<|endoftext|>", "🙂"]
    texts = ["", "  ", " a", "b ", "word " * 3000] + ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 14))) for _ in range(3000)]
    column = pa.array([t.encode() for t in texts], pa.binary())
    enc = tokens.WordEncoder(VOCAB, keep=keep)
    for at, n in ((0, len(texts)), (100, 7), (0, 1), (5, 0)):
        ids, bounds = enc.texts(column.slice(at, n), 1)
        assert len(bounds) == n + 1 and bounds[-1] == len(ids)
        for i in range(n):
            want = tok.encode(texts[at + i], add_special_tokens=False).ids + [1]
            assert ids[bounds[i]:bounds[i + 1]].tolist() == want, repr(texts[at + i])


def test_word_encoder_equals_the_library():
    tok = __import__("tokenizers").Tokenizer.from_file(VOCAB)
    r = random.Random(6)
    alphabet = "abcXYZ 019.,'|#-_ \n\t\x0b\x1c éÉßÄñ×÷ªµİıſŒ中文日¼²éΣς😀​"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += ["it's we'll I'M x<|endoftext|>y <|startoftext|>", "ΑΣ ΑΣΑ ﬁ Ǆ"]
    enc = tokens.WordEncoder(VOCAB, keep=500)
    for t in texts:
        ws = t.encode().split()
        enc.prepare([ws])
        assert list(np.frombuffer(enc.ids(ws), "<u4")) == tok.encode(t, add_special_tokens=False).ids, repr(t)


def test_rank_coding_round_trip():
    r = np.random.default_rng(0)
    for n in (0, 1, 3, 4, 5, 1000):
        x = np.minimum(r.integers(0, 2 ** 32, n), 2 ** r.integers(1, 32, n)).astype(np.uint32)
        control, data = tokenfile.encode_ranks(x)
        assert len(control) == (n + 3) // 4 and (tokenfile.decode_ranks(control, data, n) == x).all()


def test_token_files(spark):
    texts = corpus()
    ids = [i * 7 % 997 - 300 for i in range(len(texts))]
    ids[0] = None
    docs = documents(spark, texts, ids=ids).unionByName(documents(spark, ["again"] * 3, ids=[5000] * 3))
    got = sorted(tokenfile.round_trip(docs, VOCAB).collect(), key=lambda x: x.start)
    tok = __import__("tokenizers").Tokenizer.from_file(VOCAB)
    rows = sorted(zip(ids, texts), key=lambda x: (x[0] is not None, x[0] or 0)) + [(5000, "again")] * 3
    at = 0
    for (i, t), x in zip(rows, got, strict=True):
        want = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        assert (x.doc_id, x.start, x.n_tokens, x.ids_crc32) == (i, at, len(want), zlib.crc32(want.tobytes()))
        at += len(want)
    assert tokenfile.round_trip(docs.limit(0), VOCAB).count() == 0


# ---- components

def test_components_of_stars_chains_and_ties(spark):
    r = random.Random(9)
    edges = [(0, i) for i in range(1, 40)] + [(100 + i, 101 + i) for i in range(50)] + [(300, 300), (7, 7)]
    edges += [(r.randrange(400, 600), r.randrange(400, 600)) for _ in range(120)] + [(5, 3), (3, 5)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(5)
    got = {x.node: x.component for x in components(df).collect()}
    names = sorted({x for e in edges for x in e if e[0] != e[1]})
    pairs = set(edges) | {(b, a) for a, b in edges}
    want = brute.reach(len(names), lambda i, j: (names[i], names[j]) in pairs)
    assert got == {n: names[c] for n, c in zip(names, want)}
    assert components(df.limit(0)).count() == 0
