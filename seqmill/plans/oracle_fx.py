"""DuckDB text of the fixture views (mirror of ``seqmill.plans.fixtures``).

``with_fx(names, body)`` returns ``WITH <needed views> <body>`` with the
dependencies of each view pulled in, in order.
"""

from __future__ import annotations

_FX: dict[str, tuple[list[str], str]] = {
    "fx_seq": ([], """
        SELECT 'S' || CAST(doc_id AS VARCHAR) AS seq_id, doc_id, source AS grp, lang,
               upper(regexp_replace(regexp_replace(coalesce(text, ''), '[^\\p{L}]', '', 'g'), '[^A-Za-z]', 'X', 'g')) AS seq_str
        FROM documents"""),
    "fx_member_rows": ([], """
        SELECT group_name, yr, protein_id FROM (
          SELECT 'G' || CAST(o_custkey AS VARCHAR) AS group_name, year(o_orderdate) AS yr,
                 'P.' || CAST(o_orderkey AS VARCHAR) || '.1' AS protein_id, o_orderstatus
          FROM orders
          UNION ALL
          SELECT 'G' || CAST(o_custkey + 1 AS VARCHAR), year(o_orderdate),
                 'P.' || CAST(o_orderkey AS VARCHAR) || '.1', o_orderstatus
          FROM orders WHERE o_orderpriority = '1-URGENT') r
        UNION ALL
        SELECT group_name, yr, protein_id FROM (
          SELECT 'G' || CAST(o_custkey AS VARCHAR) AS group_name, year(o_orderdate) AS yr,
                 'P.' || CAST(o_orderkey AS VARCHAR) || '.1' AS protein_id, o_orderstatus
          FROM orders
          UNION ALL
          SELECT 'G' || CAST(o_custkey + 1 AS VARCHAR), year(o_orderdate),
                 'P.' || CAST(o_orderkey AS VARCHAR) || '.1', o_orderstatus
          FROM orders WHERE o_orderpriority = '1-URGENT') d
        WHERE o_orderstatus = 'P'"""),
    "fx_members_raw": (["fx_member_rows"], """
        SELECT group_name, string_agg(protein_id, ',' ORDER BY protein_id) AS protein_ids
        FROM fx_member_rows GROUP BY group_name, yr"""),
    "fx_members": (["fx_members_raw"], """
        SELECT group_name, unnest(ids) AS protein_id
        FROM (SELECT group_name, list_distinct(string_split(protein_ids, ',')) AS ids FROM fx_members_raw)
        WHERE len(ids) >= 2"""),
    "fx_labelled0": (["fx_members", "fx_proteins"], """
        SELECT m.protein_id, m.group_name, p.description, p.sequence
        FROM fx_members m JOIN fx_proteins p ON p.id = m.protein_id
        WHERE p.sequence IS NOT NULL"""),
    "fx_labelled": (["fx_labelled0"], """
        SELECT * FROM fx_labelled0
        WHERE group_name IN (SELECT group_name FROM fx_labelled0 GROUP BY group_name HAVING count(*) >= 2)"""),
    "fx_single": (["fx_labelled"], """
        SELECT * FROM fx_labelled
        WHERE protein_id NOT IN (SELECT protein_id FROM fx_labelled GROUP BY protein_id
                                 HAVING count(DISTINCT group_name) > 1)"""),
    "fx_split_t": (["fx_single"], """
        SELECT group_name, row_number() OVER (ORDER BY md5('42:' || group_name), group_name)
               <= (SELECT ceil(0.15 * count(DISTINCT group_name)) FROM fx_single) AS is_test
        FROM (SELECT DISTINCT group_name FROM fx_single)"""),
    "fx_split_v": (["fx_split_t"], """
        SELECT group_name, row_number() OVER (ORDER BY md5('42:' || group_name), group_name)
               <= (SELECT ceil(0.15 * count(*)) FROM fx_split_t WHERE NOT is_test) AS is_val
        FROM fx_split_t WHERE NOT is_test"""),
    "fx_split": (["fx_single", "fx_split_t", "fx_split_v"], """
        SELECT s.*, CASE WHEN t.is_test THEN 'test' WHEN v.is_val THEN 'val' ELSE 'train' END AS split
        FROM fx_single s JOIN fx_split_t t USING (group_name) LEFT JOIN fx_split_v v USING (group_name)"""),
    "fx_proteins": (["fx_seq"], """
        SELECT 'P.' || CAST(o.o_orderkey AS VARCHAR) || '.1' AS id, o.o_orderpriority AS description,
               nullif(s.seq_str, '') AS sequence
        FROM orders o LEFT JOIN fx_seq s
          ON s.doc_id = o.o_orderkey % (SELECT count(*) + 1 FROM documents)"""),
    "fx_msa_g": (["fx_seq"], """
        SELECT grp || '/' || lang AS align_id,
               seq_id, doc_id AS seq_ord, replace(seq_str, 'E', '-E') AS gapped
        FROM fx_seq WHERE seq_str <> ''"""),
    "fx_msa": (["fx_msa_g"], """
        SELECT g.align_id, g.seq_id, g.seq_ord, rpad(g.gapped, CAST(w.width AS INTEGER), '-') AS seq_str
        FROM fx_msa_g g JOIN (SELECT align_id, max(length(gapped)) AS width FROM fx_msa_g GROUP BY align_id) w
          USING (align_id)"""),
    "fx_residues": (["fx_seq"], """
        SELECT seq_id, grp, pos, substr(seq_str, pos + 1, 1) AS aa
        FROM (SELECT seq_id, grp, seq_str, unnest(range(length(seq_str))) AS pos FROM fx_seq)"""),
    "fx_residue_vec": (["fx_residues"], """
        SELECT m.model, r.seq_id, r.pos, e.embedding AS vec
        FROM fx_residues r
        CROSS JOIN (VALUES (0, 'pt'), (1, 'cls'), (2, 'mlm'), (3, 'cont')) AS m(mi, model)
        JOIN embeddings e
          ON e.vec_id = (ascii(r.aa) * 7 + r.pos % 3 + 13 * m.mi) % (SELECT count(*) FROM embeddings)
        WHERE NOT (m.model = 'cont' AND r.grp = 'src7')"""),
    "fx_clust": ([], """
        SELECT vec_id, label,
               list_transform(generate_series(0, len(embedding) - 1),
                              lambda i: CAST(embedding[i + 1] AS DOUBLE) * 0.1 + CASE WHEN i = label THEN 1.0 ELSE 0.0 END) AS vec
        FROM embeddings"""),
}


def with_fx(names, body: str) -> str:
    order: list[str] = []

    def visit(n):
        if n in order:
            return
        for d in _FX[n][0]:
            visit(d)
        order.append(n)

    for n in names:
        visit(n)
    body = body.strip()
    if not order:
        return body
    ctes = ",\n".join(f"{n} AS ({_FX[n][1]}\n)" for n in order)
    if body[:15].upper() == "WITH RECURSIVE ":
        return f"WITH RECURSIVE {ctes},\n{body[15:]}"
    if body[:5].upper() == "WITH ":
        return f"WITH {ctes},\n{body[5:]}"
    return f"WITH {ctes}\n{body}"
