"""Queries over text formats, alignment operations, pileups, genotype likelihoods and linkage."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions import cigar as cg
from lociq.operators import genotypes as gn
from lociq.operators.pileup import pileup_counts
from lociq.operators.reads import usable
from lociq.plans.fixtures import duck, view
from lociq.sources import text as tx


def sam(spark, sf_dir):
    return view(spark, sf_dir, "fx_sam")


def lines(spark, sf_dir):
    own = sam(spark, sf_dir).select(
        F.concat(F.lit("r"), "read_id").alias("qname"), "flag", F.concat(F.lit("chr"), "tid").alias("rname"), "pos", "mapq", "cigar",
        F.lit(None).cast("string").alias("rnext"), F.lit(-1).alias("pnext"), F.lit(0).alias("tlen"), F.lit(None).cast("string").alias("seq"), F.lit(None).cast("string").alias("qual"),
    )
    return tx.format_alignments(own)


def cigar_spans(spark, sf_dir):
    ops = cg.operations(F.col("cigar"))
    return sam(spark, sf_dir).select(
        "read_id", cg.total(ops, cg.ON_READ).alias("on_read"), (F.col("pos") + cg.total(ops, cg.ON_REFERENCE)).alias("fin"),
        cg.clip(ops, 1).alias("left_clip"), cg.clip(ops, -1).alias("right_clip"),
    )


def cigar_resolved(spark, sf_dir):
    rows = sam(spark, sf_dir).select("read_id", F.posexplode(cg.resolved(cg.operations(F.col("cigar")), F.col("pos"))).alias("no", "o"))
    return rows.select("read_id", "no", "o.op", "o.size", "o.query_from", "o.ref_from")


def alignment_lines_parsed(spark, sf_dir):
    """Lines are written and read again; a tag is added on the way."""
    tagged = lines(spark, sf_dir).select(F.concat("value", F.lit("\tNM:i:3")).alias("value"))
    return tx.parse_alignments(tagged).select("qname", "flag", "rname", "pos", "mapq", "cigar", F.col("tags")["NM"]["value"].cast("int").alias("nm"))


def variant_cells(spark, sf_dir):
    own = view(spark, sf_dir, "fx_geno").select(
        F.concat_ws("\t", F.col("grp"), (F.col("sample") + 1).cast("string"), F.lit("."), F.lit("A"), F.lit("C"), F.lit("30"), F.lit("."), F.concat(F.lit("DP="), "dp"), F.lit("GT:DP"), F.concat_ws(":", "gt", "dp")).alias("value")
    )
    rows = tx.parse_variants(own)
    return tx.sample_cells(rows).select("chrom", "pos", F.col("fields")["GT"].cast("int").alias("gt"), F.col("fields")["DP"].cast("int").alias("dp"))


def allele_freq_em(spark, sf_dir):
    own = view(spark, sf_dir, "fx_geno")
    pl = [(F.abs(F.col("gt") - g) * 5 * F.least("dp", F.lit(12))).alias(f"pl{g}") for g in range(3)]
    return gn.frequency_em(own.select("site", "sample", *pl)).select("site", "samples", F.round("freq", 6).alias("freq"))


SITES = "SELECT CAST(dense_rank() OVER (ORDER BY grp) AS INT) AS site, sample, gt FROM fx_geno"


def ld_r2(spark, sf_dir):
    own = view(spark, sf_dir, "fx_geno")
    # Sites are numbered from their list, not by a window over all rows.
    names = spark.sql("SELECT grp, CAST(row_number() OVER (ORDER BY grp) AS INT) AS site FROM {g}", g=own.select("grp").distinct())
    return gn.ld_pairs(own.drop("site").join(names, "grp").select("site", "sample", "gt"), 2).withColumn("r2", F.round("r2", 6))


QUERIES = {
    "cigar_spans": cigar_spans,
    "cigar_resolved": cigar_resolved,
    "pileup_counts": lambda s, d: pileup_counts(usable(sam(s, d))),
    "alignment_lines": lines,
    "alignment_lines_parsed": alignment_lines_parsed,
    "variant_cells": variant_cells,
    "allele_freq_em": allele_freq_em,
    "ld_r2": ld_r2,
}

OPS = """WITH o AS (SELECT read_id, tid, pos, flag, mapq, unnest(range(len(ops))) AS i, CAST(unnest(sizes) AS INT) AS n, unnest(ops) AS op FROM (
      SELECT *, regexp_extract_all(cigar, '([0-9]+)([A-Z=])', 1) AS sizes, regexp_extract_all(cigar, '([0-9]+)([A-Z=])', 2) AS ops FROM fx_sam)),
    placed AS (SELECT *, coalesce(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) OVER w, 0) AS q,
      pos + coalesce(sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) OVER w, 0) AS r
      FROM o WINDOW w AS (PARTITION BY read_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)) """
ORACLES = {
    "cigar_spans": duck(
        OPS + """SELECT read_id, CAST(sum(CASE WHEN op IN ('M', 'I', 'S') THEN n ELSE 0 END) AS INT) AS on_read,
        CAST(min(pos) + sum(CASE WHEN op IN ('M', 'D', 'N') THEN n ELSE 0 END) AS INT) AS fin,
        CAST(CASE WHEN arg_min(op, i) = 'S' THEN arg_min(n, i) ELSE 0 END AS INT) AS left_clip,
        CAST(CASE WHEN arg_max(op, i) = 'S' THEN arg_max(n, i) ELSE 0 END AS INT) AS right_clip FROM o GROUP BY read_id"""
    ),
    "cigar_resolved": duck(OPS + "SELECT read_id, CAST(i AS INT) AS no, op, n AS size, CAST(q AS INT) AS query_from, CAST(r AS INT) AS ref_from FROM placed"),
    "pileup_counts": duck(
        OPS + """, cells AS (SELECT tid, flag, op, CAST(unnest(range(r, r + n)) AS INT) AS pos FROM (SELECT tid, flag, op, n, CAST(r AS BIGINT) AS r FROM placed
        WHERE (flag & 1796) = 0 AND op IN ('M', 'D')))
        SELECT tid, pos, count(*) FILTER (op = 'M') AS depth, count(*) FILTER (op = 'D') AS deleted, count(*) FILTER ((flag & 16) <> 0) AS reverse FROM cells GROUP BY tid, pos"""
    ),
    "alignment_lines": duck(
        "SELECT concat_ws(chr(9), concat('r', read_id), flag, concat('chr', tid), pos + 1, mapq, cigar, '*', 0, 0, '*', '*') AS value FROM fx_sam"
    ),
    "alignment_lines_parsed": duck("SELECT concat('r', read_id) AS qname, flag, concat('chr', tid) AS rname, pos, mapq, cigar, 3 AS nm FROM fx_sam"),
    "variant_cells": duck("SELECT grp AS chrom, CAST(sample + 1 AS INT) AS pos, gt, dp FROM fx_geno"),
    "ld_r2": duck(
        f"""WITH s AS ({SITES}) SELECT first, second, samples, round(CASE WHEN vx * vy > 0 THEN CAST(c AS DOUBLE) * c / (CAST(vx AS DOUBLE) * vy) END, 6) AS r2 FROM (
        SELECT a.site AS first, b.site AS second, count(*) AS samples, CAST(count(*) * sum(a.gt * b.gt) - sum(a.gt) * sum(b.gt) AS BIGINT) AS c,
        CAST(count(*) * sum(a.gt * a.gt) - sum(a.gt) * sum(a.gt) AS BIGINT) AS vx, CAST(count(*) * sum(b.gt * b.gt) - sum(b.gt) * sum(b.gt) AS BIGINT) AS vy
        FROM s a JOIN s b ON a.sample = b.sample AND b.site - a.site BETWEEN 1 AND 2 GROUP BY ALL)"""
    ),
}
