"""Views over the given tables in the shape of aligned reads, interval calls, sequences and genotypes.

Each view is one SELECT in Spark SQL. `duck()` gives the same text with the one function that is named otherwise.
"""

from __future__ import annotations

import re

DAY = "CAST(datediff(CAST({} AS DATE), DATE '1995-01-01') AS INT)"
DUCK_DAY = "CAST(date_diff('day', DATE '1995-01-01', CAST({} AS DATE)) AS INT)"

TEXT = {
    "fx_read": """SELECT o_orderkey AS read_id, CAST(floor(o_orderkey / 2) AS BIGINT) AS template_id,
      CAST(o_custkey % 24 AS INT) AS tid, DAY[o_orderdate] AS pos, CAST(30 + o_orderkey % 71 AS INT) AS l_qseq,
      CAST((o_orderkey * 7) % 61 AS INT) AS mapq,
      CAST(1 + (CASE WHEN o_orderstatus = 'F' THEN 2 ELSE 0 END) + (CASE WHEN o_orderkey % 37 = 0 THEN 4 ELSE 0 END)
        + 16 * (o_orderkey % 2) + 32 * ((o_orderkey + 1) % 2) + (CASE WHEN o_orderkey % 2 = 0 THEN 64 ELSE 128 END)
        + (CASE WHEN o_orderkey % 41 = 0 THEN 256 ELSE 0 END) + (CASE WHEN o_orderkey % 43 = 0 THEN 512 ELSE 0 END)
        + (CASE WHEN o_orderpriority = '5-LOW' THEN 1024 ELSE 0 END) AS INT) AS flag FROM orders""",
    "fx_cnv": """SELECT DISTINCT CAST(l_linenumber AS INT) AS sample_no, CAST(l_suppkey % 24 AS INT) AS tid,
      DAY[l_shipdate] AS p1, DAY[l_shipdate] + CAST(floor(l_quantity) AS INT) AS p2,
      CASE l_returnflag WHEN 'A' THEN 'DUP' WHEN 'R' THEN 'DEL' ELSE 'VAR' END AS type FROM lineitem""",
    "fx_whole": """SELECT doc_id, translate(lower(text), 'abcdefghijklmnopqrstuvwxyz',
      'ACGTNACGTACGTACGTACGTACGTA') AS seq FROM documents""",
    "fx_region": """SELECT CAST(n_nationkey AS INT) AS region_no, CAST(n_nationkey % 24 AS INT) AS tid,
      CAST(n_nationkey * 90 AS INT) AS beg, CAST(n_nationkey * 90 + 120 AS INT) AS fin FROM nation""",
    "fx_pair": """SELECT a.template_id, a.tid, a.pos AS f1, a.pos + a.l_qseq AS f2, b.pos AS r1, b.pos + b.l_qseq AS r2,
      b.pos + b.l_qseq - a.pos AS isize FROM (SELECT * FROM READ[fx_read] x WHERE flag % 32 < 16) a
      JOIN (SELECT * FROM READ[fx_read] y WHERE flag % 32 >= 16) b ON a.template_id = b.template_id AND a.tid = b.tid""",
    "fx_sam": """SELECT read_id, tid, pos, mapq, flag, concat(CASE WHEN read_id % 3 = 0 THEN concat(5 + read_id % 9, 'S') ELSE '' END,
      20 + read_id % 11, 'M', CASE read_id % 4 WHEN 0 THEN '2I10M' WHEN 1 THEN '3D10M' WHEN 2 THEN '40N10M' ELSE '' END,
      CASE WHEN read_id % 5 = 0 THEN concat(6 + read_id % 7, 'S') ELSE '' END) AS cigar FROM READ[fx_read] x""",
    "fx_geno": """SELECT CAST(user_id % 97 AS INT) AS site, CAST(user_id AS BIGINT) AS sample, event_type AS grp,
      CAST(count(*) % 3 AS INT) AS gt, CAST(count(*) AS INT) AS dp FROM events GROUP BY user_id, event_type""",
    # Contigs, reads of 60 bases every 20 of them (some with a changed base) in three samples, and calls on contigs.
    "fx_ref": """SELECT doc_id AS tid, CLEAN[translate(text, 'abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ',
      'ACGTNACGTACGTACGTACGTACGTAACGTNACGTACGTACGTACGTACGTA')] AS seq FROM documents WHERE text IS NOT NULL""",
    "fx_aln": """SELECT CAST(tid * 100000 + k AS BIGINT) AS read_id, tid, CAST(20 * k AS INT) AS pos, 60 AS l_qseq, CAST((k * 13 + tid * 7) % 61 AS INT) AS mapq,
      CAST(1 + 16 * (k % 2) + (CASE WHEN k % 4 < 2 THEN 64 ELSE 128 END) + (CASE WHEN k % 11 = 0 THEN 1024 ELSE 0 END) AS INT) AS flag, CAST(k % 3 AS INT) AS sample_no,
      '60M' AS cigar, CASE WHEN k % 3 = 0 THEN concat(substr(raw, 1, m), translate(substr(raw, m + 1, 1), 'ACGTN', 'CGTAA'), substr(raw, m + 2)) ELSE raw END AS seq,
      translate(raw, 'ACGTN', 'I5?+#') AS qual, raw AS ref FROM (SELECT tid, k, CAST((k * 7 + tid) % 60 AS INT) AS m, substr(seq, CAST(20 * k + 1 AS INT), 60) AS raw FROM (
      SELECT tid, seq, EACH[0;CAST(floor((length(seq) - 60) / 20.0) AS INT)] AS k FROM READ[fx_ref] r WHERE length(seq) >= 60) e) c""",
    "fx_dcall": """SELECT tid, CAST(50 * k + 10 AS INT) AS p1, CAST(50 * k + 30 + (k * 7) % 90 AS INT) AS p2, CAST((k + tid) % 5 AS INT) AS rdscore,
      CASE WHEN k % 2 = 0 THEN 'DEL' ELSE 'DUP' END AS type FROM (SELECT tid, EACH[0;CAST(floor((length(seq) - 60) / 50.0) AS INT)] AS k FROM READ[fx_ref] r WHERE length(seq) >= 60) e""",
    # Reads over joins of two places of a contig, clipped at either end, some with a gap or a changed base.
    "fx_split": """SELECT CAST(tid * 1000000 + k * 8 + i AS BIGINT) AS read_id, tid, CAST(CASE WHEN i = 6 THEN f2 - 39 WHEN i % 2 = 0 THEN f2 - a + 1 ELSE r1 END AS INT) AS pos,
      CAST((k * 13 + i * 17) % 61 AS INT) AS mapq, CAST(16 * (i % 2) + (CASE WHEN (k * 3 + i) % 23 = 0 THEN 1024 ELSE 0 END) AS INT) AS flag, cigar,
      CASE WHEN (k + i) % 4 = 0 THEN concat(substr(raw, 1, m), translate(substr(raw, m + 1, 1), 'ACGTN', 'CGTAA'), substr(raw, m + 2)) ELSE raw END AS seq, translate(raw, 'ACGTN', 'I5?+#') AS qual
      FROM (SELECT *, CAST((k * 7 + i * 5) % 60 AS INT) AS m, CASE WHEN i = 6 THEN '20M2D18M22S' WHEN i = 7 THEN '15S20M3I22M' WHEN i % 2 = 0 THEN concat(a, 'M', 60 - a, 'S') ELSE concat(a, 'S', 60 - a, 'M') END AS cigar,
        CASE WHEN i = 6 THEN concat(substr(seq, f2 - 38, 20), substr(seq, f2 - 16, 18), substr(seq, r1 + 1, 22)) WHEN i = 7 THEN concat(substr(seq, f2 - 13, 15), substr(seq, r1 + 1, 20), 'ACG', substr(seq, r1 + 21, 22))
          ELSE concat(substr(seq, f2 - a + 2, a), substr(seq, r1 + 1, 60 - a)) END AS raw
        FROM (SELECT *, CAST(14 + (i * 9 + k) % 33 AS INT) AS a, CAST(f2 + 30 + (k * 11 + tid) % 60 AS INT) AS r1 FROM (SELECT *, EACH[0;7] AS i, CAST(150 * k + 70 AS INT) AS f2 FROM (
          SELECT tid, seq, EACH[0;CAST(floor((length(seq) - 300) / 150.0) AS INT)] AS k FROM READ[fx_ref] r WHERE length(seq) >= 300) c) d) e) f""",
    # Deletions of half of the copies of long contigs, and reads of all kinds around them: cover of depth 15, pairs of which
    # some span a deletion, and clipped reads over its join.
    "fx_site": """SELECT tid, k, seq, CAST(1200 * k + 300 AS INT) AS f2, CAST(1200 * k + 601 + (k * 37 + tid) % 150 AS INT) AS r1 FROM (
      SELECT tid, seq, EACH[0;CAST(floor((length(seq) - 1100) / 1200.0) AS INT)] AS k FROM READ[fx_ref] r WHERE length(seq) >= 1200) c""",
    "fx_cover": """SELECT CAST(tid * 1000000 + j AS BIGINT) AS read_id, tid, CAST(4 * j AS INT) AS pos, CAST((j * 13 + tid * 7) % 61 AS INT) AS mapq, CAST(99 - 16 * (j % 2) AS INT) AS flag,
      CAST(4 * j + 140 AS INT) AS mpos, 200 AS tlen, '60M' AS cigar, substr(seq, CAST(4 * j + 1 AS INT), 60) AS seq FROM (SELECT tid, seq, EACH[0;CAST(floor((length(seq) - 260) / 4.0) AS INT)] AS j FROM READ[fx_ref] r WHERE length(seq) >= 1200) c
      WHERE j % 2 = 0 OR NOT (4 * j % 1200 BETWEEN 241 AND 601 + (CAST(floor(4 * j / 1200.0) AS INT) * 37 + tid) % 150)""",
    "fx_span": """SELECT CAST(tid * 1000000 + 500000 + k * 32 + i AS BIGINT) AS read_id, tid, CAST(CASE WHEN i < 16 THEN CASE WHEN i % 2 = 0 THEN f2 - a + 1 ELSE r1 END WHEN i % 2 = 0 THEN fpos ELSE rpos END AS INT) AS pos,
      CAST(20 + (k * 13 + i * 17) % 41 AS INT) AS mapq, CAST(CASE WHEN i < 16 THEN 16 * (i % 2) WHEN i % 2 = 0 THEN 97 ELSE 145 END AS INT) AS flag, CAST(CASE WHEN i < 16 THEN -1 WHEN i % 2 = 0 THEN rpos ELSE fpos END AS INT) AS mpos,
      CAST(CASE WHEN i < 16 THEN 0 WHEN i % 2 = 0 THEN rpos + 60 - fpos ELSE fpos - rpos - 60 END AS INT) AS tlen, CASE WHEN i >= 16 THEN '60M' WHEN i % 2 = 0 THEN concat(a, 'M', 60 - a, 'S') ELSE concat(a, 'S', 60 - a, 'M') END AS cigar,
      CASE WHEN i < 16 THEN concat(substr(seq, f2 - a + 2, a), substr(seq, r1 + 1, 60 - a)) WHEN i % 2 = 0 THEN substr(seq, fpos + 1, 60) ELSE substr(seq, rpos + 1, 60) END AS seq
      FROM (SELECT *, CAST(14 + (i * 7 + k) % 33 AS INT) AS a, CAST(f2 - 62 - 5 * CAST(floor(i / 2.0) AS INT) + 40 AS INT) AS fpos, CAST(r1 + 60 - 5 * CAST(floor(i / 2.0) AS INT) + 40 AS INT) AS rpos
        FROM (SELECT *, EACH[0;31] AS i FROM READ[fx_site] t) d) e""",
    # Reads of two haplotypes that differ in the middle of some stretches of 25 letters: het says which haplotype has the other letter.
    "fx_hap": """SELECT CAST(tid * 1000000 + k * 3 + i AS BIGINT) AS read_id, tid, CAST(25 * k + 5 * i AS INT) AS pos, CAST(60 AS INT) AS l_qseq, CAST((k * 13 + i * 17) % 40 + 20 AS INT) AS mapq, CAST(16 * ((k + i) % 2) AS INT) AS flag, '60M' AS cigar,
      CAST(h AS INT) AS hap, substr(concat(CASE WHEN (k * k + tid) % 5 % 3 = h THEN concat(substr(a, 1, 12), translate(substr(a, 13, 1), 'ACGTN', 'GTACA'), substr(a, 14)) ELSE a END,
        CASE WHEN ((k + 1) * (k + 1) + tid) % 5 % 3 = h THEN concat(substr(b, 1, 12), translate(substr(b, 13, 1), 'ACGTN', 'GTACA'), substr(b, 14)) ELSE b END,
        CASE WHEN ((k + 2) * (k + 2) + tid) % 5 % 3 = h THEN concat(substr(c, 1, 12), translate(substr(c, 13, 1), 'ACGTN', 'GTACA'), substr(c, 14)) ELSE c END), CAST(5 * i + 1 AS INT), 60) AS seq,
      translate(substr(concat(a, b, c), CAST(5 * i + 1 AS INT), 60), 'ACGTN', 'I5?+#') AS qual, substr(concat(a, b, c), CAST(5 * i + 1 AS INT), 60) AS ref
      FROM (SELECT tid, k, i, (k * 7 + i * 5 + tid) % 2 AS h, substr(raw, 1, 25) AS a, substr(raw, 26, 25) AS b, substr(raw, 51) AS c
        FROM (SELECT *, EACH[0;2] AS i FROM (SELECT tid, k, substr(seq, CAST(25 * k + 1 AS INT), 75) AS raw FROM (SELECT tid, seq, EACH[0;CAST(floor((length(seq) - 75) / 25.0) AS INT)] AS k FROM READ[fx_ref] r WHERE length(seq) >= 300) x) w) y) z""",
    # Reads with one letter inserted or deleted, over letters with long runs of equal ones, in four groups.
    "fx_gap": """SELECT CAST(tid * 100000 + k AS BIGINT) AS read_id, tid, CAST(20 * k AS INT) AS pos, CAST((k * 13 + tid * 7) % 61 AS INT) AS mapq, CASE WHEN k % 9 = 8 THEN NULL ELSE concat('rg', k % 4) END AS grp,
      CASE k % 3 WHEN 0 THEN '60M' WHEN 1 THEN concat(m, 'M1D', 60 - m, 'M') ELSE concat(m, 'M1I', 59 - m, 'M') END AS cigar,
      CASE k % 3 WHEN 0 THEN substr(raw, 1, 60) WHEN 1 THEN concat(substr(raw, 1, m), substr(raw, m + 2)) ELSE concat(substr(raw, 1, m), 'A', substr(raw, m + 1, 59 - m)) END AS seq
      FROM (SELECT tid, k, CAST(5 + (k * 7 + tid) % 50 AS INT) AS m, translate(substr(seq, CAST(20 * k + 1 AS INT), 61), 'GT', 'AA') AS raw FROM (
        SELECT tid, seq, EACH[0;CAST(floor((length(seq) - 61) / 20.0) AS INT)] AS k FROM READ[fx_ref] r WHERE length(seq) >= 61) e) c""",
    # Pairs with both reads' own fields.
    "fx_mates": """SELECT a.template_id, a.tid, a.read_id AS f_id, a.pos AS f_pos, a.l_qseq AS f_len, a.flag AS f_flag, a.mapq AS f_mapq,
      b.read_id AS r_id, b.pos AS r_pos, b.l_qseq AS r_len, b.flag AS r_flag, b.mapq AS r_mapq, b.pos + b.l_qseq - a.pos AS isize
      FROM (SELECT * FROM READ[fx_read] x WHERE flag % 32 < 16) a JOIN (SELECT * FROM READ[fx_read] y WHERE flag % 32 >= 16) b ON a.template_id = b.template_id AND a.tid = b.tid""",
    # Variant records: one for each order, on 24 chromosomes.
    "fx_var": """SELECT o_orderkey AS id, CAST(o_custkey % 24 AS INT) AS tid, CAST(DAY[o_orderdate] * 20 + o_orderkey % 20 AS INT) AS pos,
      CASE WHEN o_orderkey % 7 = 0 THEN 'AC' ELSE substr('ACGT', CAST(1 + o_orderkey % 4 AS INT), 1) END AS ref,
      CASE WHEN o_orderkey % 7 = 0 THEN 'A' WHEN o_orderkey % 11 = 0 THEN 'ATT' WHEN o_orderkey % 13 = 0 THEN '.' ELSE substr('CGTA', CAST(1 + o_orderkey % 4 AS INT), 1) END AS alt,
      CAST(o_orderkey % 97 AS INT) AS qual, CAST(o_orderkey % 40 AS INT) AS dp, CAST((o_orderkey * 3) % 61 AS INT) AS mq,
      CAST(o_orderkey % 9 AS INT) AS alt_fwd, CAST(o_orderkey % 5 AS INT) AS alt_rev, (o_orderkey % 1009) / 1009.0 AS pv FROM orders""",
}


def text_of(view: str, dialect: str) -> str:
    day = DAY if dialect == "spark" else DUCK_DAY
    sql = re.sub(r"READ\[(\w+)\]", lambda m: f"({text_of(m[1], dialect)})", TEXT[view])
    each = "explode(sequence({}, {}))" if dialect == "spark" else "unnest(range({}, {} + 1))"
    sql = re.sub(r"EACH\[([^;\]]+);([^\]]+)\]", lambda m: each.format(m[1], m[2]), sql)
    clean = "regexp_replace({}, '[^ACGTN]', 'N')" if dialect == "spark" else "regexp_replace({}, '[^ACGTN]', 'N', 'g')"
    sql = re.sub(r"CLEAN\[([^\]]+)\]", lambda m: clean.format(m[1]), sql)
    return re.sub(r"DAY\[(\w+)\]", lambda m: day.format(m[1]), sql)


def cut_by_bytes(sql: str) -> str:
    """`sql` with substr(seq, ...) taken from bytes: contigs hold nothing but A, C, G, T and N, and Spark looks for a place
    among characters from the text's beginning on, which made the work of a text's reads grow with its length squared."""
    out, head = "", "substr(seq, "
    while head in sql:
        before, _, sql = sql.partition(head)
        n, open_ = 0, 1
        while open_:
            open_ += {"(": 1, ")": -1}.get(sql[n], 0)
            n += 1
        out += f"{before}CAST(substr(CAST(seq AS BINARY), {sql[: n - 1]}) AS STRING)"
        sql = sql[n:]
    return out + sql


TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents")


def view(spark, sf_dir: str, name: str):
    """A fixture, or one of the given tables, as a DataFrame."""
    if name in TABLES:
        return spark.read.parquet(f"{sf_dir}/{name}.parquet")
    sql = cut_by_bytes(text_of(name, "spark"))
    used = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in TABLES if f" {t}" in sql}
    for t in used:
        sql = sql.replace(f"FROM {t}", "FROM {" + t + "}")
    return spark.sql(sql, **used)


def duck(sql: str) -> str:
    """`sql` with the views that it names as common table expressions of DuckDB."""
    used = [v for v in TEXT if re.search(rf"\b{v}\b", sql)]
    with_ = ", ".join(f"{v} AS ({text_of(v, 'duck')})" for v in used)
    if not used:
        return sql
    return f"WITH {with_}, {sql[5:]}" if sql.startswith("WITH ") else f"WITH {with_} {sql}"
