"""FASTA files read in splits that cut records."""

import random

from seqmill.sources import files as FS


def test_records_larger_than_a_split_keep_their_order(spark, tmp_path):
    r = random.Random(3)
    want, n = [], 0
    for name in ("a.fasta", "b.fasta", "c.fasta", "d.fasta"):
        lines = ["orphan line", ""] if name == "b.fasta" else []
        for i in range(r.randint(3, 30)) if name != "d.fasta" else []:
            seq = "".join(r.choice("ACDEFG") for _ in range(r.choice([0, 5, 70, 9000])))
            lines += [f">{name[0]}{i} some words"] + [seq[k:k + 61] + r.choice(["", " ", "\r"]) for k in range(0, len(seq), 61)] + [""]
            want.append((n, f"{name[0]}{i}", f"{name[0]}{i} some words", seq))
            n += 1
        (tmp_path / name).write_text("\n".join(lines))
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    try:
        for size in ("128MB", "700", "5000"):
            spark.conf.set("spark.sql.files.maxPartitionBytes", size)
            spark.conf.set("spark.sql.files.openCostInBytes", "10")
            if size == "700":
                assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
            got = sorted((x.ord, x.id, x.description, x.sequence) for x in FS.read_fasta(spark, str(tmp_path)).collect())
            assert got == want, size
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
