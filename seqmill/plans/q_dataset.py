"""Dataset-build and classifier-prep queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from seqmill.functions import encode as E
from seqmill.functions import strings as S
from seqmill.operators import prep as P
from seqmill.operators import sampling as SM
from seqmill.operators.stats import value_ranks
from seqmill.plans import fixtures as FX
from seqmill.plans.oracle_fx import with_fx
from seqmill.plans.registry import query
from seqmill.session import cut
from seqmill.sources.tables import Tables


def labelled(t: Tables):
    """Keys only; payload is attached last."""
    return P.labelled_keys(P.explode_members(FX.fx_members_raw(t)), FX.fx_proteins(t))


def split_rows(t: Tables):
    return P.three_way_split(P.resolve_multi_group(labelled(t)), "group_name", 0.15, 42)


@query("members_exploded", with_fx(["fx_members"], "SELECT group_name, protein_id FROM fx_members"))
def members_exploded(spark, sf_dir):
    """G1: raw comma lists -> distinct ids per row, rows with <2 ids dropped."""
    return P.explode_members(FX.fx_members_raw(Tables(spark, sf_dir)))


@query("labelled_sequences", with_fx(["fx_labelled"], """
SELECT group_name, protein_id, description, CAST(length(sequence) AS INT) AS seq_len, md5(sequence) AS seq_md5
FROM fx_labelled"""))
def labelled_sequences(spark, sf_dir):
    """J1 + F2 + G2: memberships joined to sequences, singleton groups dropped."""
    t = Tables(spark, sf_dir)
    r = P.with_sequences(labelled(t), FX.fx_proteins(t), "description",
                         F.length("sequence").alias("seq_len"), F.md5("sequence").alias("seq_md5"))
    return r.select("group_name", "protein_id", "description", "seq_len", "seq_md5")


@query("multi_group_dropped", with_fx(["fx_labelled", "fx_single"], """
SELECT group_name, count(*) AS n_rows
FROM fx_labelled WHERE protein_id NOT IN (SELECT protein_id FROM fx_single)
GROUP BY group_name"""))
def multi_group_dropped(spark, sf_dir):
    """Rows removed because their protein sits in more than one group."""
    lab = labelled(Tables(spark, sf_dir))
    kept = P.resolve_multi_group(lab)
    gone = lab.join(kept.select("protein_id").distinct(), "protein_id", "left_anti")
    return gone.groupBy("group_name").agg(F.count(F.lit(1)).alias("n_rows"))


@query("dataset_split", with_fx(["fx_split"], "SELECT group_name, protein_id, split FROM fx_split"), bench=True)
def dataset_split(spark, sf_dir):
    """L1/L2 (+G3): group-level train/val/test split, seed 42, fraction 0.15."""
    return split_rows(Tables(spark, sf_dir)).select("group_name", "protein_id", "split")


@query("split_summary", with_fx(["fx_split"], """
SELECT split, count(DISTINCT group_name) AS n_groups, count(*) AS n_rows,
       count(DISTINCT protein_id) AS n_proteins, CAST(sum(length(sequence)) AS BIGINT) AS n_residues
FROM fx_split GROUP BY split"""))
def split_summary(spark, sf_dir):
    """Profile of each split (groups, rows, proteins, residues)."""
    t = Tables(spark, sf_dir)
    s = P.with_sequences(split_rows(t), FX.fx_proteins(t), F.length("sequence").alias("seq_len"))
    return s.groupBy("split").agg(F.countDistinct("group_name").alias("n_groups"),
                                  F.count(F.lit(1)).alias("n_rows"),
                                  F.countDistinct("protein_id").alias("n_proteins"),
                                  F.sum("seq_len").cast("long").alias("n_residues"))


@query("split_leaks", with_fx(["fx_split"], """
SELECT split, 'group_name' AS "column", group_name AS value FROM fx_split
WHERE split <> 'train' AND group_name IN (SELECT group_name FROM fx_split WHERE split = 'train')
UNION
SELECT split, 'protein_id', protein_id FROM fx_split
WHERE split <> 'train' AND protein_id IN (SELECT protein_id FROM fx_split WHERE split = 'train')"""))
def split_leaks(spark, sf_dir):
    """Ids or groups of val/test present in train (must be empty)."""
    return P.assert_disjoint(split_rows(Tables(spark, sf_dir)))


_CLS = """
cf0 AS (SELECT group_name AS labels,
               array_to_string(string_split(protein_id, '.')[2:], '.') AS protein_id,
               sequence AS protein_seq FROM fx_labelled),
cf AS (SELECT * FROM cf0 WHERE labels IN (SELECT labels FROM cf0 GROUP BY labels HAVING count(*) >= 10)),
codes AS (SELECT labels, CAST(row_number() OVER (ORDER BY labels) - 1 AS INT) AS label_code
          FROM (SELECT DISTINCT labels FROM cf)),
nl AS (SELECT labels, count(*) AS n_l FROM cf GROUP BY labels),
tot AS (SELECT count(*) AS n, ceil(0.1 * count(*)) AS n_test FROM cf),
q AS (SELECT labels, n_l, CASE WHEN n_l > 1 THEN floor(n_test * n_l / n) ELSE 0 END AS base,
             n_test * n_l / n - floor(n_test * n_l / n) AS frac, md5('1:' || labels) AS lh
      FROM nl, tot),
rem AS (SELECT (SELECT n_test FROM tot) - sum(base) AS r FROM q),
ex AS (SELECT labels, row_number() OVER (ORDER BY frac DESC, lh, labels) <= (SELECT r FROM rem) AS extra
       FROM q WHERE n_l > 1 AND base < n_l),
kt AS (SELECT q.labels, q.base + CASE WHEN ex.extra THEN 1 ELSE 0 END AS k FROM q LEFT JOIN ex USING (labels)),
st AS (SELECT cf.*, row_number() OVER (PARTITION BY cf.labels ORDER BY md5('1:' || cf.protein_id), cf.protein_id)
                    <= kt.k AS is_test
       FROM cf JOIN kt USING (labels))"""


def classifier_keys(t: Tables):
    """G4, F6, W4 on the key table: labels with at least 10 rows, and their codes."""
    cf = P.drop_small_groups(labelled(t).withColumnRenamed("group_name", "labels"), "labels", 10)
    cf = cut(cf)
    return cf.join(P.label_codes(cf, "labels"), "labels")


@query("classifier_frame", with_fx(["fx_labelled"], f"""
WITH {_CLS.strip()}
SELECT st.labels, st.protein_id, codes.label_code, CASE WHEN is_test THEN 'test' ELSE 'train' END AS split,
       CAST(length(protein_seq) AS INT) AS seq_len
FROM st JOIN codes USING (labels)"""))
def classifier_frame_q(spark, sf_dir):
    """Classifier frame with label codes and a 10 %
    stratified split (seed 1)."""
    t = Tables(spark, sf_dir)
    keys = classifier_keys(t).withColumn("_id", S.strip_prefix("protein_id"))
    s = P.stratified_split(keys, "labels", "_id", 0.1, 1)
    s = P.with_sequences(s, FX.fx_proteins(t), F.length("sequence").alias("seq_len"))
    return s.select("labels", F.col("_id").alias("protein_id"), "label_code", "split", "seq_len")


_VOCAB_SQL = ", ".join(f"('{c}', {4 + i})" for i, c in enumerate(E.DEFAULT_RESIDUES))


@query("encoded_sequences", with_fx(["fx_labelled"], f"""
WITH voc AS (SELECT * FROM (VALUES {_VOCAB_SQL}) v(tok, id)),
cf0 AS (SELECT array_to_string(string_split(protein_id, '.')[2:], '.') AS protein_id,
               translate(sequence, 'UZOB-', 'XXXXX') AS s, group_name FROM fx_labelled),
cf AS (SELECT * FROM cf0 WHERE group_name IN (SELECT group_name FROM cf0 GROUP BY 1 HAVING count(*) >= 10)),
tk AS (SELECT cf.group_name, cf.protein_id, r.pos, coalesce(voc.id, 3) AS tid
       FROM cf, unnest(range(length(cf.s))) AS r(pos)
       LEFT JOIN voc ON voc.tok = substr(cf.s, r.pos + 1, 1))
SELECT group_name, protein_id, CAST(count(*) + 2 AS INT) AS n_tokens,
       md5('0,' || string_agg(CAST(tid AS VARCHAR), ',' ORDER BY pos) || ',2') AS ids_md5
FROM tk GROUP BY group_name, protein_id"""))
def encoded_sequences(spark, sf_dir):
    """X2 + X4: residue normalisation and token ids of whole sequences with cls/eos;
    reported as (token count, md5 of the comma-joined ids)."""
    t = Tables(spark, sf_dir)
    vmap = E.vocab_map(E.default_vocab(spark))
    ids, mask, _ = E.encode_sequence(S.normalize_residues("sequence"), vmap)
    lab = P.with_sequences(P.drop_small_groups(labelled(t), "group_name", 10), FX.fx_proteins(t),
                           F.size(F.array_remove(mask, 0)).alias("n_tokens"), E.ids_md5(ids).alias("ids_md5"))
    return lab.select("group_name", S.strip_prefix("protein_id").alias("protein_id"), "n_tokens", "ids_md5")


@query("encoded_padded", with_fx(["fx_labelled"], """
SELECT group_name, protein_id, CAST(least(length(sequence), 1022) + 2 AS INT) AS n_tokens, 1024 AS n_ids,
       CAST(greatest(length(sequence) - 1022, 0) AS INT) AS n_dropped FROM fx_labelled"""))
def encoded_padded(spark, sf_dir):
    """X4 with a length: ids padded to 1024, and how many residues did not fit."""
    t = Tables(spark, sf_dir)
    ids, mask, dropped = E.encode_sequence("sequence", E.vocab_map(E.default_vocab(spark)), 1024)
    lab = P.with_sequences(labelled(t), FX.fx_proteins(t), F.size(F.array_remove(mask, 0)).alias("n_tokens"),
                           F.size(ids).alias("n_ids"), dropped.alias("n_dropped"))
    return lab.select("group_name", "protein_id", "n_tokens", "n_ids", "n_dropped")


@query("encoded_words", """
WITH w AS (SELECT doc_id, unnest(ws) AS token, unnest(range(len(ws))) AS pos FROM (
  SELECT doc_id, regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+') AS ws FROM documents)),
n AS (SELECT token, count(*) AS c FROM w GROUP BY token),
v AS (SELECT token, row_number() OVER (ORDER BY token) + 3 AS id FROM n WHERE c >= 2),
e AS (SELECT w.doc_id, string_agg(CAST(coalesce(v.id, 3) AS VARCHAR), ',' ORDER BY w.pos) AS ids, count(*) AS n,
             count(*) FILTER (WHERE v.id IS NULL) AS unknown FROM w LEFT JOIN v USING (token) GROUP BY w.doc_id)
SELECT d.doc_id, CAST(coalesce(e.n, 0) + 2 AS INT) AS n_tokens, CAST(coalesce(e.unknown, 0) AS INT) AS n_unknown,
       md5('0,' || coalesce(e.ids || ',', '') || '2') AS ids_md5 FROM documents d LEFT JOIN e USING (doc_id)""")
def encoded_words(spark, sf_dir):
    """X4 by join: whole documents in ids of a vocabulary that grows with them (all words that occur twice or more)."""
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    docs = Tables(spark, sf_dir)("documents").select("doc_id", words.alias("words"))
    often = docs.select(F.explode("words").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n")).where("n >= 2")
    vocab = value_ranks(often, "token").select("token", (F.col("before") + 4).alias("id"))
    x = E.encode_tokens(docs, "doc_id", "words", vocab)
    return x.select("doc_id", F.size("input_ids").alias("n_tokens"),
                    F.size(F.filter("input_ids", lambda i: i == E.DEFAULT_SPECIALS["unk"])).alias("n_unknown"),
                    F.md5(F.array_join("input_ids", ",")).alias("ids_md5"))


@query("label_one_hot", with_fx(["fx_labelled"], f"""
WITH {_CLS.strip()}
SELECT labels, label_code, CAST((SELECT count(*) FROM codes) AS INT) AS size, [label_code] AS indices, [1.0::DOUBLE] AS "values"
FROM codes"""))
def label_one_hot(spark, sf_dir):
    """W5 + L7: label map with one-hot vectors in sparse form (size, indices, values), as labels
    grow with the data."""
    codes = cut(classifier_keys(Tables(spark, sf_dir)).select("labels", "label_code").distinct())
    k = codes.count()
    return codes.select("labels", "label_code", F.lit(k).alias("size"), F.array("label_code").alias("indices"),
                        F.array(F.lit(1.0)).alias("values"))


@query("spaced_sequences", with_fx(["fx_labelled"], """
SELECT protein_id, md5(array_to_string(string_split(translate(sequence, 'UZOB-', 'XXXXX'), ''), ' ')) AS spaced_md5,
       CAST(length(sequence) * 2 - 1 AS INT) AS spaced_len
FROM fx_labelled"""))
def spaced_sequences(spark, sf_dir):
    """X2 + X3: normalised, space-separated residues (T5-style input)."""
    t = Tables(spark, sf_dir)
    sp = S.space_out(S.normalize_residues("sequence"))
    lab = P.with_sequences(labelled(t), FX.fx_proteins(t), F.md5(sp).alias("spaced_md5"), F.length(sp).alias("spaced_len"))
    return lab.select("protein_id", "spaced_md5", "spaced_len")


@query("group_downsample", with_fx(["fx_split"], """
SELECT group_name, protein_id FROM (
  SELECT group_name, protein_id,
         row_number() OVER (PARTITION BY group_name ORDER BY CAST(split_part(protein_id, '.', 2) AS BIGINT)) AS rn
  FROM fx_split WHERE split = 'val')
WHERE rn <= 3"""))
def group_downsample(spark, sf_dir):
    """Keep the first 3 rows (by id) of every group of the val split."""
    s = split_rows(Tables(spark, sf_dir)).where(F.col("split") == "val").select(
        "group_name", "protein_id", F.split("protein_id", r"\.")[1].cast("long").alias("_ord"))
    return SM.cap_per_group(s, "group_name", "_ord", 3, ["protein_id"]).drop("_ord")


@query("sampled_groups", with_fx(["fx_labelled"], """
SELECT group_name, protein_id FROM fx_labelled
WHERE group_name IN (SELECT group_name FROM (SELECT DISTINCT group_name FROM fx_labelled)
                     ORDER BY md5('7:' || group_name), group_name LIMIT 500)"""))
def sampled_groups(spark, sf_dir):
    """500 groups by seeded hash (seed 7) with all their rows."""
    lab = labelled(Tables(spark, sf_dir)).select("group_name", "protein_id")
    return SM.sample_groups(lab, "group_name", 500, seed=7)


@query("sampled_rows", with_fx(["fx_labelled"], """
SELECT protein_id, group_name FROM (
  SELECT protein_id, group_name, row_number() OVER (ORDER BY md5('3:' || protein_id || ':' || group_name), protein_id, group_name) AS rn
  FROM fx_labelled)
WHERE rn <= (SELECT count(*) - CAST(floor(count(*) * (1 - 0.25)) AS BIGINT) FROM fx_labelled)"""))
def sampled_rows(spark, sf_dir):
    """Keep a 25 % row fraction (drop int(n*0.75) rows by seeded hash)."""
    lab = labelled(Tables(spark, sf_dir)).select("protein_id", "group_name")
    return SM.sample_fraction(lab, ["protein_id", "group_name"], 0.25, seed=3)


@query("shuffled_rows", with_fx(["fx_labelled"], """
SELECT protein_id, group_name, CAST(row_number() OVER (
         ORDER BY md5('11:' || protein_id || ':' || group_name), protein_id, group_name) - 1 AS BIGINT) AS position
FROM fx_labelled"""))
def shuffled_rows(spark, sf_dir):
    """Every row with its place in a seeded random order."""
    lab = labelled(Tables(spark, sf_dir)).select("protein_id", "group_name")
    return SM.shuffled(lab, ["protein_id", "group_name"], seed=11)


@query("first_rows", with_fx(["fx_labelled"], """
SELECT protein_id, group_name FROM fx_labelled ORDER BY protein_id, group_name LIMIT 100"""))
def first_rows(spark, sf_dir):
    """F8: the first 100 rows in an explicit order (the limit is the feature)."""
    return SM.limit_rows(labelled(Tables(spark, sf_dir)).select("protein_id", "group_name"), 100,
                         ["protein_id", "group_name"])


@query("split_to_test", with_fx(["fx_labelled", "fx_single"], """
WITH t AS (SELECT group_name, row_number() OVER (ORDER BY md5('42:' || group_name), group_name)
                  <= (SELECT ceil(0.15 * count(DISTINCT group_name)) FROM fx_labelled) AS is_test
           FROM (SELECT DISTINCT group_name FROM fx_labelled)),
v AS (SELECT group_name, row_number() OVER (ORDER BY md5('42:' || group_name), group_name)
             <= (SELECT ceil(0.15 * count(*)) FROM t WHERE NOT is_test) AS is_val FROM t WHERE NOT is_test)
SELECT l.group_name, l.protein_id,
       CASE WHEN t.is_test OR l.protein_id NOT IN (SELECT protein_id FROM fx_single) THEN 'test'
            WHEN v.is_val THEN 'val' ELSE 'train' END AS split
FROM fx_labelled l JOIN t USING (group_name) LEFT JOIN v USING (group_name)"""))
def split_to_test(spark, sf_dir):
    """G3 with mode to_test, L1, U3: proteins of several groups go to the test split."""
    keys = P.resolve_multi_group(labelled(Tables(spark, sf_dir)), mode="to_test")
    return P.three_way_split(keys, "group_name", 0.15, 42).select("group_name", "protein_id", "split")


@query("leaking_split", with_fx(["fx_labelled"], """
WITH s AS (SELECT group_name, protein_id, CASE WHEN md5('5:' || group_name) < '4' THEN 'test' ELSE 'train' END AS split
           FROM fx_labelled)
SELECT split, 'group_name' AS "column", group_name AS value FROM s
WHERE split <> 'train' AND group_name IN (SELECT group_name FROM s WHERE split = 'train')
UNION
SELECT split, 'protein_id', protein_id FROM s
WHERE split <> 'train' AND protein_id IN (SELECT protein_id FROM s WHERE split = 'train')"""))
def leaking_split(spark, sf_dir):
    """J7/U4/Q2 on a split that leaks: groups are kept apart, but proteins of several groups are not."""
    keys = labelled(Tables(spark, sf_dir)).withColumn("split", F.when(
        F.md5(F.concat(F.lit("5:"), "group_name")) < "4", "test").otherwise("train"))
    return P.assert_disjoint(keys)


@query("length_filtered", with_fx(["fx_labelled"], """
SELECT group_name, protein_id, CAST(length(sequence) AS INT) AS seq_len FROM fx_labelled
WHERE length(sequence) BETWEEN 500 AND 5000"""))
def length_filtered(spark, sf_dir):
    """sequences of 500 to 5000 residues."""
    t = Tables(spark, sf_dir)
    fit = P.filter_length(FX.fx_proteins(t), "sequence", 500, 5000)
    lab = P.with_sequences(labelled(t), fit, F.length("sequence").alias("seq_len"))
    return lab.select("group_name", "protein_id", "seq_len")


_IDS = "list_transform(string_split(sequence, ''), lambda c: coalesce(map_extract(vm, c)[1], 3))"


@query("lm_targets", with_fx(["fx_labelled"], f"""
WITH v AS (SELECT map(list(token), list(id)) AS vm FROM (
  SELECT substr('{E.DEFAULT_RESIDUES}', CAST(i + 1 AS INT), 1) AS token, CAST(4 + i AS INT) AS id FROM range({len(E.DEFAULT_RESIDUES)}) t(i))),
x AS (SELECT group_name, protein_id, list_concat([0], {_IDS}, [2]) AS ids FROM fx_labelled, v)
SELECT group_name, protein_id, CAST(len(ids) AS INT) AS n_tokens, md5(array_to_string(ids, ',')) AS ids_md5,
       md5(array_to_string(ids, ',')) AS labels_md5, md5(array_to_string(list_concat(ids[2:], [-100]), ',')) AS shifted_md5 FROM x"""))
def lm_targets(spark, sf_dir):
    """Labels are a copy of the input ids; beside them the shifted targets (the next id, -100 at the end)."""
    t = Tables(spark, sf_dir)
    ids, _, _ = E.encode_sequence("sequence", E.vocab_map(E.default_vocab(spark)))
    lab = P.with_sequences(labelled(t), FX.fx_proteins(t), F.size(ids).alias("n_tokens"), E.ids_md5(ids).alias("ids_md5"),
                           E.ids_md5(E.lm_labels(ids)).alias("labels_md5"), E.ids_md5(E.next_targets(ids)).alias("shifted_md5"))
    return lab.select("group_name", "protein_id", "n_tokens", "ids_md5", "labels_md5", "shifted_md5")


@query("duplicate_ids", """
SELECT protein_id, count(*) AS n FROM (
  SELECT 'P.' || CAST(l_orderkey AS VARCHAR) || '.1' AS protein_id FROM lineitem) GROUP BY protein_id HAVING count(*) > 1""")
def duplicate_ids(spark, sf_dir):
    """Q3: ids that a table has more than once."""
    li = Tables(spark, sf_dir)("lineitem").select(F.concat(F.lit("P."), F.col("l_orderkey").cast("string"), F.lit(".1")).alias("protein_id"))
    return P.duplicates(li, "protein_id")
