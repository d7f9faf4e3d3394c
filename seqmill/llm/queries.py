"""The registered queries: each applies one operator to its whole table."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from seqmill.llm import (codes, crosspoly, ctxmix, htmltext, mixing, packing, quality, simhash, sketch, tokenfile, urlfilter,
                         warc, whitening)
from seqmill.llm.common import read_table
from seqmill.llm.registry import query


def word_vocabulary() -> str:
    """The vocabulary file that the token queries take as their parameter."""
    return public_tokenizers.path("word_bpe_49k.json")


@query("op1_quality_discriminant")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


@query("op3_exact_complement_packing")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read_table(spark, sf_dir, "documents"), word_vocabulary(), capacity=4096, end_id=1)


@query("op4_warc_archives")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.round_trip(read_table(spark, sf_dir, "pages"), min_bytes=0)


@query("op5_bottom_k_fingerprints")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = sketch.fingerprints(read_table(spark, sf_dir, "documents"))
    return rows.select("doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
                       sketch.as_text(F.col("sketch")).alias("fingerprint"),
                       sketch.as_text(F.col("edited_sketch")).alias("edited_fingerprint"),
                       "near_edited", "near_next")


@query("op6_source_mixing", """
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT AS h FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         [5.0, 2.0, 1.0][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT]::DOUBLE AS w
  FROM d GROUP BY source),
levels AS (
  SELECT *, ((sum(source_size) OVER ()
      - coalesce(sum(3.0 * source_size) OVER (ORDER BY source_size / w, source NULLS LAST
          ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(w) OVER (ORDER BY source_size / w, source NULLS LAST
          ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS level,
      row_number() OVER (ORDER BY source_size / w, source NULLS LAST) AS place FROM s),
t AS (
  SELECT source, source_size, least(3.0 * source_size,
      coalesce(w * (SELECT arg_min(level, place) FROM levels WHERE w * level <= 3.0 * source_size), 3.0 * source_size))::DOUBLE AS target
  FROM levels),
e AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size + 1e-12) ELSE 1 END AS whole FROM t),
g AS (  -- equal hashes are taken together
  SELECT d.source, d.h, sum(d.size) AS n, any_value(e.target - e.whole * e.source_size) AS budget
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source GROUP BY d.source, d.h),
c AS (
  SELECT *, sum(n) OVER (PARTITION BY source ORDER BY h) AS upto FROM g),
took AS (  -- the last group goes in if that brings the sum nearer
  SELECT source, h FROM c WHERE budget > 0 AND (upto <= budget OR (upto - n < budget AND upto - budget < budget - (upto - n))))
SELECT d.doc_id, d.size, e.source_size, e.target,
       ((e.whole + CASE WHEN e.whole < 3 AND k.h IS NOT NULL THEN 1 ELSE 0 END) * d.size)::BIGINT AS taken
FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source
LEFT JOIN took k ON d.source IS NOT DISTINCT FROM k.source AND d.h = k.h
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read_table(spark, sf_dir, "documents"), weights=(5.0, 2.0, 1.0), max_repeats=3)
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


@query("op8_simhash_components")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    near = simhash.near_duplicates(read_table(spark, sf_dir, "documents"), width=3, most=3, seed=42)
    return near.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


@query("op9_html_layout_text")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return htmltext.extract(read_table(spark, sf_dir, "pages"))


@query("op10_token_files")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tokenfile.round_trip(read_table(spark, sf_dir, "documents"), word_vocabulary(), end_id=1)


@query("op7_cross_polytope_links")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return crosspoly.near_vectors(read_table(spark, sf_dir, "embeddings"), least=0.98)


@query("op2_context_mixing")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ctxmix.scores(read_table(spark, sf_dir, "documents"), mod=7, rest=2)


@query("op11_polarised_whitening")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = whitening.whiten(read_table(spark, sf_dir, "embeddings"), components=8)
    return rows.withColumn("deviation", F.expr("try_cast(deviation as bigint)"))


URL_RULES = [("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"),
             ("net", "/es/", "block"), ("net", "/fr/", "block")]


@query("op12_url_rules", """
WITH rules(rh, rp, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
r AS (SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) ELSE '' END AS rest FROM pages),
p AS (SELECT row_number() OVER () AS n, page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
  'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM r),
b AS (SELECT n, arg_max(rh || rp, len(rh || rp)) AS rule, arg_max(v, len(rh || rp)) AS verdict
  FROM p JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY n)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict FROM p LEFT JOIN b USING (n)
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, rules).select("page_id", "host", "path", "rule", "verdict")


PARTS, ENTRIES, ROUNDS = 4, 256, 4


def _code_sql() -> str:
    """The rounds of code assignment one after the other, as common table expressions."""
    sql = f"""WITH d AS (
  SELECT row_number() OVER (ORDER BY vec_id) AS n, vec_id, label,
         list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT n, j, v[j * len(v) // {PARTS} + 1:(j + 1) * len(v) // {PARTS}]::DOUBLE[] AS x
  FROM d, range({PARTS}) t(j)),
c0 AS MATERIALIZED (SELECT j, n - 1 AS e, x AS c FROM p WHERE n <= {ENTRIES})"""
    for r in range(ROUNDS + 1):
        sql += f""",
a{r} AS MATERIALIZED (SELECT n, p.j, any_value(x) AS x, min(struct_pack(
    dist := list_dot_product(x, x) - 2 * list_dot_product(x, c) + list_dot_product(c, c), e := e)) AS best
  FROM p JOIN c{r} k ON p.j = k.j GROUP BY n, p.j)"""
        if r < ROUNDS:
            sql += f""",
s{r} AS (SELECT j, best.e AS e, i, CAST(floor(sum(x[i]) / count(*)) AS DOUBLE) AS m
  FROM a{r}, (SELECT unnest(range(1, 1 + (SELECT max(len(x)) FROM p))) AS i) WHERE i <= len(x) GROUP BY ALL),
c{r + 1} AS MATERIALIZED (SELECT j, e, coalesce(u.m, c) AS c FROM c{r} LEFT JOIN
  (SELECT j, e, list(m ORDER BY i) AS m FROM s{r} GROUP BY j, e) u USING (j, e))"""
    return sql + f""",
f AS (SELECT n, string_agg(lpad(lower(to_hex(best.e)), 2, '0'), '' ORDER BY j) AS code, CAST(sum(best.dist) AS BIGINT) AS error
  FROM a{ROUNDS} GROUP BY n),
b AS (SELECT sha256(string_agg(array_to_string(c::BIGINT[], ','), ',' ORDER BY j, e)) AS h FROM c{ROUNDS})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, h AS codebooks_sha256
FROM d JOIN f USING (n), b"""


@query("op13_ball_tree_codes", _code_sql())
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = codes.compress(read_table(spark, sf_dir, "embeddings"), parts=PARTS, entries=ENTRIES, rounds=ROUNDS)
    return rows.select("vec_id", "code", "error", "label_error", "codebooks_sha256")
