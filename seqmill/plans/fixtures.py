"""Fixture views derived from the driver tables (Spark side).

The same definitions are written in DuckDB SQL in ``seqmill.plans.oracle_fx``;
both must stay in step.  Every view uses whole tables and whole texts; the rules
that create edge cases (duplicate members, a protein in two groups, a model with
missing vectors) add or remove rows by data attributes, never by id ranges.

  fx_seq          seq_id, doc_id, grp, lang, seq_str   (all letters, upper case; letters
                                                        beyond A-Z are the unknown residue X)
  fx_members_raw  group_name, protein_ids              (comma list per group/year)
  fx_proteins     id, description, sequence            (one per order)
  fx_msa          align_id, seq_id, seq_ord, seq_str   (gap '-' before every E,
                                                        right-padded to the width)
  fx_residue_vec  model, seq_id, pos, vec              (per residue, 4 models)
  fx_clust        vec_id, label, vec                   (0.1*embedding + one_hot)
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seqmill.functions.strings import letters_upper
from seqmill.sources.tables import Tables

# fixed values of the fixture contract
MODELS = ("pt", "cls", "mlm", "cont")
MISSING_MODEL = "cont"        # this model has no vectors for one source ...
MISSING_SOURCE = "src7"       # ... namely this one (missing-vector case)
DUP_STATUS = "P"              # orders with this status are listed twice (dedupe case)
MULTI_PRIORITY = "1-URGENT"   # orders with this priority also join group custkey+1


def fx_seq(t: Tables) -> DataFrame:
    d = t("documents").select("doc_id", "source", "lang", "text")
    return d.select(
        F.concat(F.lit("S"), F.col("doc_id").cast("string")).alias("seq_id"),
        "doc_id",
        F.col("source").alias("grp"),
        "lang",
        letters_upper("text").alias("seq_str"),
    )


def _member_rows(t: Tables) -> DataFrame:
    o = t("orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority", "o_orderdate")
    pid = F.concat(F.lit("P."), F.col("o_orderkey").cast("string"), F.lit(".1"))
    yr = F.year("o_orderdate")
    own = o.select(F.concat(F.lit("G"), F.col("o_custkey").cast("string")).alias("group_name"),
                   yr.alias("yr"), pid.alias("protein_id"), "o_orderstatus")
    other = o.where(F.col("o_orderpriority") == MULTI_PRIORITY).select(
        F.concat(F.lit("G"), (F.col("o_custkey") + 1).cast("string")).alias("group_name"),
        yr.alias("yr"), pid.alias("protein_id"), "o_orderstatus")
    rows = own.unionByName(other)
    dups = rows.where(F.col("o_orderstatus") == DUP_STATUS)
    return rows.unionByName(dups).select("group_name", "yr", "protein_id")


def fx_members_raw(t: Tables) -> DataFrame:
    """Raw membership rows: one comma-joined list per (group, order year).

    A list holds one customer's orders of one year, so its size is bounded by
    the data itself; the same group name may occur on several rows.
    """
    m = _member_rows(t)
    return (m.groupBy("group_name", "yr")
             .agg(F.array_join(F.array_sort(F.collect_list("protein_id")), ",").alias("protein_ids"))
             .select("group_name", "protein_ids"))


def fx_proteins(t: Tables) -> DataFrame:
    """One protein per order; sequence of document ``o_orderkey mod (n_docs + 1)``.

    There is no document ``n_docs``, and a text without letters has no residues:
    those orders get a NULL sequence.
    """
    n_docs = t("documents").count()  # parquet footer count
    o = t("orders").select("o_orderkey", "o_orderpriority")
    s = fx_seq(t).select("doc_id", F.nullif("seq_str", F.lit("")).alias("sequence"))
    p = o.select(F.concat(F.lit("P."), F.col("o_orderkey").cast("string"), F.lit(".1")).alias("id"),
                 F.col("o_orderpriority").alias("description"),
                 F.pmod(F.col("o_orderkey"), F.lit(n_docs + 1)).alias("doc_id"))
    return p.join(s, "doc_id", "left").select("id", "description", "sequence")


def fx_msa(t: Tables) -> DataFrame:
    """One alignment family for each (source, language); a family grows with the data."""
    s = fx_seq(t).where("seq_str <> ''")
    g = s.select(
        F.concat_ws("/", "grp", "lang").alias("align_id"),
        "seq_id", F.col("doc_id").alias("seq_ord"),
        F.replace(F.col("seq_str"), F.lit("E"), F.lit("-E")).alias("gapped"))
    w = g.groupBy("align_id").agg(F.max(F.length("gapped")).alias("width"))
    return (g.join(w, "align_id")
             .select("align_id", "seq_id", "seq_ord",
                     F.expr("rpad(gapped, width, repeat('-', 1024))").alias("seq_str")))


def n_vectors(t: Tables) -> int:
    return t("embeddings").count()


def fx_residues(t: Tables) -> DataFrame:
    """(seq_id, grp, pos, aa) for every residue of every sequence."""
    s = fx_seq(t).select("seq_id", "grp", "seq_str").where("seq_str <> ''")
    spark = s.sparkSession
    # a text becomes a row a letter, so texts are dealt out before (their file may be a single split)
    s = s.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), "seq_id")
    return s.select("seq_id", "grp", F.posexplode(F.split("seq_str", "")).alias("pos", "aa"))


def fx_residue_vec(t: Tables) -> DataFrame:
    """Per-residue vectors of the four models, keyed (model, seq_id, pos).

    vec = embedding[(ascii(aa)*7 + pos%3 + 13*m) mod n_vec]; model ``cont`` has
    no vectors for source ``src7``.  The rule names at most 312 vector ids (26
    letters, 3 places, 4 models), so that many rows of the embedding table are broadcast.
    """
    nv = n_vectors(t)
    named = sorted({(ord(a) * 7 + p + 13 * m) % max(nv, 1) for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for p in range(3)
                    for m in range(len(MODELS))})
    models = F.array(*[F.struct(F.lit(i).alias("m"), F.lit(n).alias("model")) for i, n in enumerate(MODELS)])
    r = fx_residues(t).select("seq_id", "grp", "pos", "aa", F.explode(models).alias("mm"))
    r = r.select("seq_id", "pos", "aa", F.col("mm.model").alias("model"),
                 F.pmod(F.ascii("aa") * 7 + F.pmod("pos", F.lit(3)) + F.col("mm.m") * 13, F.lit(nv)).cast("long").alias("vec_id"),
                 "grp")
    r = r.where(~((F.col("model") == MISSING_MODEL) & (F.col("grp") == MISSING_SOURCE)))
    e = t("embeddings").where(F.col("vec_id").isin(named)).select("vec_id", F.col("embedding").alias("vec"))
    return (r.join(F.broadcast(e), "vec_id")
             .select("model", "seq_id", "pos", "vec"))


def fx_clust(t: Tables) -> DataFrame:
    e = t("embeddings").select("vec_id", "label", "embedding")
    vec = F.zip_with(
        F.col("embedding"),
        F.sequence(F.lit(0), F.size("embedding") - 1),
        lambda x, i: (x.cast("double") * 0.1 + F.when(i == F.col("label"), 1.0).otherwise(0.0)),
    )
    return e.select("vec_id", "label", vec.alias("vec"))


def fx_clust_model(t: Tables, m: int) -> DataFrame:
    """(id, vec) of model number ``m``: ``fx_clust`` with the embedding of id ``(vec_id + 13 m) mod n_vec``,
    as ``fx_residue_vec`` shifts ids."""
    e = t("embeddings").select(F.col("vec_id").alias("at"), "embedding")
    at = F.pmod(F.col("vec_id") + 13 * m, F.lit(n_vectors(t))).cast("long").alias("at")
    own = t("embeddings").select(F.col("vec_id").alias("id"), "label", at)
    return own.join(e, "at").select("id", F.transform("embedding", lambda x, i: (
        x.cast("double") * 0.1 + F.when(i == F.col("label"), 1.0).otherwise(0.0))).alias("vec"))
