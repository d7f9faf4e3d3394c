"""Sources and sinks, evaluation pairs, embedding job, small functions."""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
from pyspark.sql import functions as F

from seqmill.functions import register as RG
from seqmill.functions import strings as S
from seqmill.functions import vector as V
from seqmill.operators import cluster as C
from seqmill.operators import embed as EM
from seqmill.operators import evaluation as EV
from seqmill.operators import prep as P
from seqmill.operators import vectors as OV
from seqmill.plans import fixtures as FX
from seqmill.plans.oracle_fx import with_fx
from seqmill.plans.q_dataset import split_rows
from seqmill.plans.registry import query
from seqmill.session import checkpoint_dir, cut
from seqmill.sources import files as FS
from seqmill.sources.tables import Tables, write_table


def _folder(spark, name: str) -> str:
    return f"{checkpoint_dir(spark).rstrip('/')}/seqmill/{name}-{uuid.uuid4().hex}"


# ---- sources and sinks: files are written from the given tables and read back ------

@query("fasta_records", with_fx(["fx_seq"], """
SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ord, seq_id AS id, seq_id || ' ' || grp || ' ' || lang AS description,
       CAST(length(seq_str) AS INT) AS seq_len, md5(seq_str) AS seq_md5
FROM fx_seq"""))
def fasta_records(spark, sf_dir):
    """FASTA files with plain headers, long sequences over many lines, records numbered in file order."""
    path = _folder(spark, "fasta")
    FS.write_fasta(FX.fx_seq(Tables(spark, sf_dir)).orderBy("doc_id"), path, F.concat_ws(" ", "seq_id", "grp", "lang"), "seq_str")
    x = FS.read_fasta(spark, path)
    return x.select("ord", "id", "description", F.length("sequence").alias("seq_len"), F.md5("sequence").alias("seq_md5"))


@query("tagged_fasta_records", with_fx(["fx_seq"], """
SELECT CASE WHEN lang <> 'es' THEN seq_id END AS id, CASE WHEN lang <> 'es' THEN grp || ' of ' || lang END AS description,
       md5(seq_str) AS seq_md5, CASE WHEN lang = 'es' THEN 'db ' || seq_id END AS _corrupt
FROM fx_seq"""))
def tagged_fasta_records(spark, sf_dir):
    """Headers of three parts; headers with fewer stay in ``_corrupt``."""
    path = _folder(spark, "tagged")
    head = F.when(F.col("lang") == "es", F.concat(F.lit("db "), "seq_id")).otherwise(
        F.concat(F.lit("db "), "seq_id", F.lit(" "), "grp", F.lit(" of "), "lang"))
    FS.write_fasta(FX.fx_seq(Tables(spark, sf_dir)), path, head, "seq_str")
    return FS.read_fasta(spark, path, "tagged").select("id", "description", F.md5("sequence").alias("seq_md5"), "_corrupt")


@query("membership_file", with_fx(["fx_members_raw"], "SELECT group_name, protein_ids FROM fx_members_raw"))
def membership_file(spark, sf_dir):
    """S3: the membership TSV."""
    path = _folder(spark, "members")
    FS.write_memberships(FX.fx_members_raw(Tables(spark, sf_dir)), path)
    return FS.read_memberships(spark, path)


@query("split_files", with_fx(["fx_split"], "SELECT split, group_name, protein_id FROM fx_split WHERE split <> 'train'"))
def split_files(spark, sf_dir):
    """The dataset written by split; the val and test folders read again."""
    path = _folder(spark, "splits")
    FS.write_splits(split_rows(Tables(spark, sf_dir)).select("group_name", "protein_id", "split"), path)
    return FS.read_split(spark, path, "val").unionByName(FS.read_split(spark, path, "test")).select("split", "group_name", "protein_id")


@query("table_file", "SELECT vec_id, label FROM embeddings")
def table_file(spark, sf_dir):
    """A table written as Parquet and read again."""
    path = _folder(spark, "table")
    write_table(Tables(spark, sf_dir)("embeddings").select("vec_id", "label"), path)
    return spark.read.parquet(path)


def _vector_rows(t: Tables):
    e = t("embeddings").select(F.when(F.col("label") < 5, "low").otherwise("high").alias("model"),
                               F.concat(F.lit("V"), F.col("vec_id").cast("string")).alias("seq_id"), "embedding")
    return e


@query("npy_vectors", """
SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS model, 'V' || CAST(vec_id AS VARCHAR) AS seq_id, CAST(h AS INT) AS pos,
       round(list_sum(list_transform(list_slice(embedding, h * (len(embedding) // 2) + 1, CASE WHEN h = 0 THEN len(embedding) // 2
             ELSE len(embedding) END), lambda x: CAST(x AS DOUBLE))), 5) AS total
FROM embeddings, range(2) t(h)""")
def npy_vectors(spark, sf_dir):
    """One .npy matrix (two rows, the vector's halves) for each vector, written, one model again, and read back."""
    path = _folder(spark, "npy")
    half = F.floor(F.size("embedding") / 2).cast("int")
    rows = _vector_rows(Tables(spark, sf_dir)).select("model", "seq_id", F.array(
        F.slice("embedding", F.lit(1), half), F.slice("embedding", half + 1, F.size("embedding"))).alias("rows"))
    FS.write_npy(rows, path)
    FS.write_npy(rows.where("model = 'low'"), path)
    x = FS.read_committed_npy(spark, path)
    return x.select("model", "seq_id", "pos", F.round(F.aggregate(
        "vec", F.lit(0.0), lambda s, v: s + v.cast("double")), 5).alias("total"))


@query("vector_sink", """
SELECT CASE WHEN label < 5 THEN 'low' ELSE 'high' END AS model, count(*) AS n FROM embeddings GROUP BY 1""")
def vector_sink(spark, sf_dir):
    """Vectors written by model, one model twice (it replaces itself), and read back."""
    path = _folder(spark, "vectors")
    v = _vector_rows(Tables(spark, sf_dir)).select("model", "seq_id", F.lit(0).alias("pos"), F.col("embedding").alias("vec"))
    FS.write_vectors(v, path)
    FS.write_vectors(v.where("model = 'low'"), path)
    return FS.read_vectors(spark, path).groupBy("model").agg(F.count(F.lit(1)).alias("n"))


@query("result_sink", """
SELECT label, count(*) * 2 AS n FROM embeddings GROUP BY label""")
def result_sink(spark, sf_dir):
    """Results appended twice, the second append repeated: every row is there twice, the header once."""
    path = _folder(spark, "results")
    r = Tables(spark, sf_dir)("embeddings").select("label", "vec_id")
    FS.append_results(r, path)
    FS.append_results(r, path, "again")
    FS.append_results(r, path, "again")  # a repeated job
    return FS.read_results(spark, path, "label int, vec_id long").groupBy("label").agg(F.count(F.lit(1)).alias("n"))


# ---- evaluation pairs ------------------------------------------------------------

_NUM = """
num AS (SELECT vec_id AS id, label AS grp, row_number() OVER (ORDER BY label, md5('4:' || vec_id), vec_id) - 1 AS r
        FROM embeddings WHERE label IS NOT NULL),
rw AS (SELECT *, min(r) OVER (PARTITION BY grp) AS b0, count(*) OVER (PARTITION BY grp) AS size, count(*) OVER () AS n FROM num)"""


def _neg(wanted: str) -> str:
    return f"""
dr AS (SELECT id, k, (b0 + size + (CAST('0x' || substr(md5('4:' || id || ':neg'), 1, 15) AS BIGINT) % (n - size)
              + k * ((n - size) // m)) % (n - size)) % n AS r
       FROM (SELECT *, unnest(range(m)) AS k FROM (SELECT *, least({wanted}, n - size) AS m FROM rw) WHERE m > 0)),
neg AS (SELECT dr.id, rw.id AS other, dr.k FROM dr JOIN rw USING (r))"""


_PAIRS_SQL = f"""
WITH {_NUM.strip()}, {_neg('b0 + size - 1 - r').strip()},
bp AS (SELECT least(a.id, b.id) AS id1, greatest(a.id, b.id) AS id2, 0 AS truth FROM rw a JOIN rw b ON a.grp = b.grp AND a.r < b.r
       UNION ALL SELECT DISTINCT least(id, other), greatest(id, other), 1 FROM neg)"""


def _items(spark, sf_dir):
    return Tables(spark, sf_dir)("embeddings").select(F.col("vec_id").alias("id"), F.col("label").alias("grp"), F.col("embedding").alias("vec"))


@query("balanced_pairs", _PAIRS_SQL + " SELECT id1, id2, truth FROM bp")
def balanced_pairs(spark, sf_dir):
    """All pairs of a label and as many with other labels."""
    return EV.balanced_pairs(_items(spark, sf_dir), seed=4)


@query("group_separation", _PAIRS_SQL + """,
d AS (SELECT truth, round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) AS dist
      FROM bp JOIN embeddings a ON a.vec_id = id1 JOIN embeddings b ON b.vec_id = id2),
rk AS (SELECT rank() OVER (ORDER BY dist) + (count(*) OVER (PARTITION BY dist) - 1) / 2.0 AS x,
              rank() OVER (ORDER BY truth) + (count(*) OVER (PARTITION BY truth) - 1) / 2.0 AS y FROM d)
SELECT round(corr(x, y), 6) AS spearman, count(*) AS n FROM rk""")
def group_separation(spark, sf_dir):
    """Does distance tell pairs of a label from others: Spearman over the balanced pairs."""
    return EV.group_separation(_items(spark, sf_dir), seed=4)


@query("contrastive_samples", f"""
WITH {_NUM.strip()}, {_neg('4').strip()},
pos AS (SELECT id, b0 + (r - b0 + k) % size AS r, k FROM (SELECT *, unnest(range(1, 7)) AS k FROM rw) WHERE k < size)
SELECT pos.id, rw.id AS other, 'positive' AS kind, CAST(k - 1 AS INT) AS k FROM pos JOIN rw USING (r)
UNION ALL SELECT id, other, 'negative', CAST(k AS INT) FROM neg""")
def contrastive_samples(spark, sf_dir):
    """Six members of the same label and four of others for every vector."""
    return EV.contrastive_samples(_items(spark, sf_dir), seed=4)


@query("hard_negatives", f"""
WITH {_NUM.strip()}, {_neg('8').strip()},
s AS (SELECT neg.id, other, row_number() OVER (PARTITION BY neg.id ORDER BY round(list_cosine_similarity(
             CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 12) DESC, other) - 1 AS k
      FROM neg JOIN embeddings a ON a.vec_id = neg.id JOIN embeddings b ON b.vec_id = other)
SELECT id, other, CAST(k AS INT) AS k FROM s WHERE k < 4""")
def hard_negatives(spark, sf_dir):
    """Of eight drawn vectors of other labels the four most similar ones."""
    x = EV.contrastive_samples(_items(spark, sf_dir), seed=4, vec="vec")
    return x.where("kind = 'negative'").select("id", "other", "k")


@query("label_classifier")
def label_classifier(spark, sf_dir):
    """M4: a multinomial linear head on the vectors, 10 % stratified test rows (its weights are fitted, so the
    tests hold its accuracy against the prior)."""
    e = Tables(spark, sf_dir)("embeddings").where("label IS NOT NULL")
    s = P.stratified_split(e.select("vec_id", "label", "embedding"), "label", "vec_id", 0.1, 1)
    return EV.group_classifier(cut(s), "embedding", "label")


# ---- vectors of named ids, cosine neighbours --------------------------------------

@query("label_pair_metrics", """
WITH m AS (SELECT label, list(a ORDER BY i) AS v FROM (
  SELECT label, i, avg(x) AS a FROM (SELECT label, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x
    FROM embeddings) GROUP BY label, i) GROUP BY label)
SELECT a.label AS id1, b.label AS id2, round(list_cosine_similarity(a.v, b.v), 6) AS cosine, round(list_distance(a.v, b.v), 6) AS l2_distance
FROM m a JOIN m b ON a.label < b.label""")
def label_pair_metrics(spark, sf_dir):
    """P5/V3: pooled vectors of the labels, every pair of them."""
    e = Tables(spark, sf_dir)("embeddings").select("label", F.col("embedding").alias("vec"))
    pooled = cut(OV.mean_pool(e, "label"))
    return OV.pair_metrics(OV.all_pairs(pooled, "label")).select("id1", "id2", "cosine", "l2_distance")


@query("cosine_neighbours", """
WITH s AS (SELECT a.vec_id AS id, b.vec_id AS nbr,
                  list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim
           FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id),
n AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(sim, 12) DESC, nbr) AS rank FROM s)
SELECT id, nbr, round(sim, 6) AS sim, CAST(rank AS INT) AS rank FROM n WHERE rank <= 5""")
def cosine_neighbours(spark, sf_dir):
    """The five most similar vectors by cosine."""
    e = Tables(spark, sf_dir)("embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    return C.knn_cosine(e, 5, block_rows=256).select("id", "nbr", F.round("sim", 6).alias("sim"), F.col("rank").cast("int").alias("rank"))


# ---- embedding job and checks ------------------------------------------------------

DIM = 16


def _letter_model():
    """A model for the tests of the job: layer 1 marks each residue's hashed letter, layer 2 twice as much;
    one row before and one after the residues; it refuses a sequence that begins with ``XX``."""
    known: dict[int, int] = {}  # places of the letters so far

    def place(letter):
        if letter not in known:
            known[letter] = int(hashlib.md5(chr(letter).encode()).hexdigest()[:8], 16) % DIM
        return known[letter]

    def predict(texts):
        out = []
        for s in texts:
            if s.startswith("XX"):
                raise ValueError("refused")
            codes = np.frombuffer(s.encode("utf-32-le"), np.uint32)
            table = np.zeros(int(codes.max(initial=0)) + 1, np.int64)
            there = np.flatnonzero(np.bincount(codes))
            table[there] = [place(c) for c in there.tolist()]
            at = table[codes]
            m = np.zeros((len(s) + 2, DIM), np.float32)
            m[np.arange(1, len(s) + 1), at] = 1
            out.append({1: m, 2: 2 * m})
        return out

    return predict


_LETTERS = f"""
l AS (SELECT seq_id, CAST('0x' || substr(md5(substr(seq_str, i + 1, 1)), 1, 8) AS BIGINT) % {DIM} AS dim, length(seq_str) AS n
      FROM (SELECT *, unnest(range(length(seq_str))) AS i FROM fx_seq WHERE seq_str <> '' AND seq_str NOT LIKE 'XX%'))"""


@query("embedding_job", with_fx(["fx_seq"], f"""
WITH {_LETTERS.strip()}
SELECT seq_id, 2 AS layer, CAST(n AS BIGINT) AS n, CAST(dim AS INT) AS dim, round(2.0 * count(*) / n, 6) AS value FROM l GROUP BY seq_id, n, dim"""))
def embedding_job(spark, sf_dir):
    """Batch embedding of whole sequences into a sink, the last layer pooled; the second call finds all done."""
    path, seqs = _folder(spark, "embedded"), FX.fx_seq(Tables(spark, sf_dir))
    EM.embed_into(seqs, _letter_model, path)
    v, _ = EM.embed_into(seqs, _letter_model, path)
    x = v.select("seq_id", "layer", "n", F.posexplode("vec").alias("dim", "value")).where("value > 0")
    return x.select("seq_id", "layer", "n", "dim", F.round("value", 6).alias("value"))


@query("embedding_errors", with_fx(["fx_seq"], """
SELECT seq_id, CASE WHEN seq_str = '' THEN 'no sequence' ELSE 'ValueError: refused' END AS message
FROM fx_seq WHERE seq_str = '' OR seq_str LIKE 'XX%'"""))
def embedding_errors(spark, sf_dir):
    """M1: sequences that the job could not embed, with the reason."""
    return EM.embed_sequences(FX.fx_seq(Tables(spark, sf_dir)), _letter_model)[1]


@query("kmer_vectors", with_fx(["fx_seq"], """
WITH k AS (SELECT seq_id, substr(seq_str, i + 1, 3) AS w FROM (SELECT *, unnest(range(length(seq_str) - 2)) AS i FROM fx_seq
           WHERE length(seq_str) >= 3)),
b AS (SELECT seq_id, CAST(('0x' || substr(md5(w), 1, 8))::BIGINT % 64 AS INT) AS dim, count(*) AS c FROM k GROUP BY ALL)
SELECT seq_id, dim, round(c / sqrt(sum(CAST(c AS DOUBLE) * c) OVER (PARTITION BY seq_id)), 6) AS value FROM b"""))
def kmer_vectors(spark, sf_dir):
    """M2: hashed 3-mer vectors of whole sequences."""
    return EM.kmer_embed(FX.fx_seq(Tables(spark, sf_dir)), 3, 64).withColumn("value", F.round("value", 6))


@query("residue_counts", with_fx(["fx_residues"], "SELECT seq_id, aa, count(*) AS n, CAST(max(pos) AS INT) AS last FROM fx_residues GROUP BY ALL"))
def residue_counts(spark, sf_dir):
    """M6: residues exploded, counted by letter."""
    r = EM.explode_residues(FX.fx_seq(Tables(spark, sf_dir)))
    return r.groupBy("seq_id", "aa").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


@query("length_check", with_fx(["fx_seq"], """
SELECT 'pt' AS model, seq_id, CAST(length(seq_str) AS INT) AS seq_len, CAST(length(seq_str) - 1 AS BIGINT) AS n_vectors
FROM fx_seq WHERE lang = 'fr' AND length(seq_str) > 1"""))
def length_check(spark, sf_dir):
    """Sequences whose vectors are not as many as their residues (French ones lose their first here)."""
    t = Tables(spark, sf_dir)
    s = FX.fx_seq(t)
    v = FX.fx_residue_vec(t).where("model = 'pt'").select("model", "seq_id", "pos").join(s.select("seq_id", "lang"), "seq_id")
    return EM.check_lengths(s, v.where(~((F.col("lang") == "fr") & (F.col("pos") == 0))))


@query("missing_ids", with_fx(["fx_seq"], """
SELECT seq_id, model FROM fx_seq, (VALUES ('pt'), ('cls'), ('mlm'), ('cont')) m(model)
WHERE seq_str = '' OR (grp = 'src7' AND model = 'cont')"""))
def missing_ids(spark, sf_dir):
    """Q5: sequences without vectors of a model."""
    t = Tables(spark, sf_dir)
    return EM.missing_vectors(FX.fx_seq(t), FX.fx_residue_vec(t), FX.MODELS)


@query("boundary_strip", with_fx(["fx_residues"], """
SELECT seq_id, CAST(count(*) - 2 AS BIGINT) AS n, CAST(max(pos) - 2 AS INT) AS last FROM fx_residues GROUP BY seq_id HAVING count(*) > 2"""))
def boundary_strip(spark, sf_dir):
    """The first and last place of every sequence dropped, the rest numbered from 0."""
    r = EM.explode_residues(FX.fx_seq(Tables(spark, sf_dir)))
    x = EM.strip_boundary(r, ["seq_id"])
    return x.groupBy("seq_id").agg(F.count(F.lit(1)).alias("n"), F.max("pos").alias("last"))


@query("last_layer", "SELECT vec_id, label AS layer FROM embeddings WHERE label = (SELECT max(label) FROM embeddings)")
def last_layer(spark, sf_dir):
    """The rows of the last layer (labels stand for layers)."""
    return EM.select_layers(Tables(spark, sf_dir)("embeddings").select("vec_id", F.col("label").alias("layer")))


@query("shifted_strings", with_fx(["fx_seq"], """
SELECT seq_id, CASE WHEN length(seq_str) > 7 THEN md5('-------' || substr(seq_str, 1, length(seq_str) - 7)) END AS right_md5,
       CASE WHEN length(seq_str) > 7 THEN md5(substr(seq_str, 8) || '-------') END AS left_md5 FROM fx_seq"""))
def shifted_strings(spark, sf_dir):
    """X11: sequences shifted by seven places; null where a sequence is no longer than that."""
    return FX.fx_seq(Tables(spark, sf_dir)).select(
        "seq_id", F.md5(S.shift_string("seq_str", 7, "right")).alias("right_md5"),
        F.md5(S.shift_string("seq_str", 7, "left")).alias("left_md5"))


@query("sql_functions", """
WITH el AS (SELECT vec_id, generate_subscripts(embedding, 1) AS i, CAST(unnest(embedding) AS DOUBLE) AS x FROM embeddings),
rk AS (SELECT vec_id, i, rank() OVER (PARTITION BY vec_id ORDER BY x) + (count(*) OVER (PARTITION BY vec_id, x) - 1) / 2.0 AS r FROM el),
sp AS (SELECT a.vec_id, corr(a.r, b.r) AS sp FROM rk a JOIN rk b ON b.vec_id = a.vec_id + 1 AND b.i = a.i GROUP BY a.vec_id)
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine,
       round(1 - list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS cosine_distance,
       round(list_distance(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS l2, round(sp, 6) AS spearman,
       'b.' || a.vec_id AS stripped, 'XAXC' AS normal, 2 AS differing
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 JOIN sp ON sp.vec_id = a.vec_id""")
def sql_functions(spark, sf_dir):
    """M5: the functions by their SQL names."""
    RG.register_functions(spark)
    Tables(spark, sf_dir)("embeddings").createOrReplaceTempView("seqmill_vectors")
    return spark.sql("""
        SELECT a.vec_id, round(seq_cosine(a.embedding, b.embedding), 6) AS cosine,
               round(seq_cosine_distance(a.embedding, b.embedding), 6) AS cosine_distance,
               round(seq_l2_distance(a.embedding, b.embedding), 6) AS l2, round(seq_spearman(a.embedding, b.embedding), 6) AS spearman,
               seq_strip_prefix(concat('a.b.', a.vec_id)) AS stripped, seq_normalize('UA-C') AS normal, seq_hamming('ABCD', 'AXCY') AS differing
        FROM seqmill_vectors a JOIN seqmill_vectors b ON b.vec_id = a.vec_id + 1""")


@query("cosine_forms", """
SELECT a.vec_id, round(list_cosine_similarity(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])), 6) AS clamped
FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1""")
def cosine_forms(spark, sf_dir):
    """V1 with eps: norms clamped from below (no difference for vectors of ordinary size)."""
    e = Tables(spark, sf_dir)("embeddings")
    a = e.select("vec_id", F.col("embedding").alias("a"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("b"))
    return a.join(b, "vec_id").select("vec_id", F.round(V.cosine("a", "b", eps=1e-6), 6).alias("clamped"))
