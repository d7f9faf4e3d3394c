"""The corpus pipeline stage by stage against brute force on a small folder of tables."""

import random

import corpus_pipeline
from seqmill.llm import quality
from tests.llm import brute


def _folder(spark, path):
    r = random.Random(12)
    vocab = ["".join(r.choice(["an", "th", "er", "on", "re"]) for _ in range(r.randint(1, 4))) for _ in range(300)]
    texts = [" ".join(r.choice(vocab) for _ in range(r.randint(20, 120))) for _ in range(90)]
    texts += [" ".join(w + "###" for w in r.sample(vocab, 40)) for _ in range(60)]
    texts += [texts[i] for i in range(0, 90, 5)] + [texts[1] + " more", None, ""]
    rows = [(i, t, "en", f"s{i % 4}" if i % 7 else None, len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(i, int(i < 90), 0) for i in range(150)], "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return {i: t for i, t in enumerate(texts)}


def test_stages(spark, tmp_path):
    texts = _folder(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, str(tmp_path))
        if name != corpus_pipeline.STAGES[-1][0]:
            assert out.columns == docs.columns
        rows = out.collect()
        kept.append(rows)
        if len(kept) < 4:
            docs = spark.createDataFrame(rows, docs.schema)
    first = {x.doc_id for x in kept[0]}
    scores = quality.quality(spark.read.parquet(f"{tmp_path}/documents.parquet"), spark.read.parquet(f"{tmp_path}/labels.parquet"))
    assert first == {x.doc_id for x in scores.where("predicted = 1").collect()}
    assert set(range(90)) <= first and not first & set(range(90, 150))
    ids = sorted(first)
    fps = [brute.simhash(texts[i]) for i in ids]
    comp = brute.reach(len(ids), lambda a, b: (fps[a] ^ fps[b]).bit_count() <= 3)
    assert sorted(x.doc_id for x in kept[1]) == sorted({ids[c] for c in comp})
    sizes = {x.doc_id: len(brute.split_words(x.text)) for x in kept[1]}
    times = {}
    for x in kept[2]:
        times[x.doc_id] = times.get(x.doc_id, 0) + 1
        assert x.text == texts[x.doc_id]
    assert set(times) <= set(sizes) and max(times.values()) <= 3
    packed = {}
    for x in kept[3]:
        packed.setdefault(x.sequence_id, []).append((x.offset, x.length))
    assert sum(x.piece == 0 for x in kept[3]) == sum(times.values())
    for parts in packed.values():
        at = 0
        for o, n in sorted(parts):
            assert o == at
            at += n
        assert at <= 4096


def test_run(spark, tmp_path):
    _folder(spark, str(tmp_path))
    rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert rows and {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"} <= set(rows[0].asDict())
