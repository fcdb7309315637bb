"""Queries over sequences."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions import sequences as sq
from lociq.plans.fixtures import duck, view


def clean(c="seq"):
    """Only the five letters; all else counts as N."""
    return F.regexp_replace(c, "[^ACGTN]", "N")


def wholes(spark, sf_dir):
    return view(spark, sf_dir, "fx_whole")


def n_islands(spark, sf_dir):
    runs = wholes(spark, sf_dir).select("doc_id", F.explode(sq.n_runs_of("seq")).alias("r"))
    return runs.select("doc_id", F.col("r.beg").alias("beg"), F.col("r.end").alias("fin"))


def read_overlap_match(spark, sf_dir):
    a = wholes(spark, sf_dir)
    b = a.select((F.col("doc_id") - 1).alias("doc_id"), F.col("seq").alias("other"))
    return a.join(b, "doc_id").select("doc_id", sq.overlap_of("seq", "other").alias("o")).select("doc_id", "o.length", "o.mismatches")


def fragments(seqs):
    """doc_id, fragment_no, seq: fragments of up to 60 letters that together hold every letter; an empty text has one."""
    parts = F.when(F.length(clean()) == 0, F.array(F.lit(""))).otherwise(F.regexp_extract_all(clean(), F.lit("[ACGTN]{1,60}"), F.lit(0)))
    return seqs.select("doc_id", F.posexplode_outer(parts).alias("fragment_no", "seq"))


def edit_distance(spark, sf_dir):
    return fragments(wholes(spark, sf_dir)).select("doc_id", "fragment_no", F.levenshtein("seq", F.reverse("seq")).alias("distance"))


QUERIES = {
    "read_overlap_match": read_overlap_match,
    "tandem_length": lambda s, d: wholes(s, d).select("doc_id", sq.tandem_of("seq").alias("length")),
    "reverse_complement": lambda s, d: wholes(s, d).select("doc_id", sq.reverse_complement(F.col("seq")).alias("rc")),
    "gc_content": lambda s, d: wholes(s, d).select("doc_id", sq.gc(F.col("seq")).alias("gc"), F.length("seq").alias("n")),
    "edit_distance": edit_distance,
    "sequence_md5": lambda s, d: wholes(s, d).select("doc_id", F.md5(F.upper(clean())).alias("md5")),
    "n_islands": n_islands,
}

ORACLES = {
    "reverse_complement": duck("SELECT doc_id, reverse(translate(seq, 'ACGT', 'TGCA')) AS rc FROM fx_whole"),
    "gc_content": duck("SELECT doc_id, CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS INT) AS gc, CAST(length(seq) AS INT) AS n FROM fx_whole"),
    "edit_distance": duck(
        """WITH c AS (SELECT doc_id, regexp_replace(seq, '[^ACGTN]', 'N', 'g') AS seq FROM fx_whole),
        f AS (SELECT doc_id, unnest(range(greatest(1, (length(seq) + 59) // 60))) AS k, unnest(CASE WHEN seq = '' THEN [''] ELSE regexp_extract_all(seq, '[ACGTN]{1,60}') END) AS s FROM c)
        SELECT doc_id, CAST(k AS INT) AS fragment_no, CAST(levenshtein(s, reverse(s)) AS INT) AS distance FROM f"""
    ),
    "sequence_md5": duck("SELECT doc_id, md5(upper(regexp_replace(seq, '[^ACGTN]', 'N', 'g'))) AS md5 FROM fx_whole"),
    "n_islands": duck(
        """WITH chars AS (SELECT doc_id, unnest(range(1, length(seq) + 1)) AS i, unnest(string_split(seq, '')) AS c FROM fx_whole),
        ns AS (SELECT doc_id, i, i - row_number() OVER (PARTITION BY doc_id ORDER BY i) AS g FROM chars WHERE c = 'N')
        SELECT doc_id, CAST(min(i) - 1 AS INT) AS beg, CAST(max(i) AS INT) AS fin FROM ns GROUP BY doc_id, g"""
    ),
}
