"""Queries over the bases of aligned reads."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.operators import bases as bs
from lociq.operators.reads import usable
from lociq.plans.fixtures import duck, view


def aligned(spark, sf_dir):
    return view(spark, sf_dir, "fx_aln")


def good(spark, sf_dir):
    return usable(aligned(spark, sf_dir))


def mismatch_tags(spark, sf_dir):
    nm, md = bs.mismatch_tags(F.col("seq"), F.col("ref"))
    return aligned(spark, sf_dir).select("read_id", nm.alias("nm"), md.alias("md"))


def capped_mapping_quality(spark, sf_dir):
    return aligned(spark, sf_dir).select("read_id", bs.capped_quality(F.col("seq"), F.col("qual"), F.col("ref")).alias("cap"))


def quality_sum(spark, sf_dir):
    own = bs.phred_list(F.col("qual"))
    return aligned(spark, sf_dir).select("read_id", F.aggregate(own, F.lit(0), lambda a, x: a + x).alias("quality"))


def depth_by_sample(spark, sf_dir):
    """Depth of each covered position in each of the samples; bases of low quality don't count."""
    rows = bs.exploded(good(spark, sf_dir), "sample_no").where("q >= 13")
    return rows.groupBy("tid", "site").agg(*[F.count_if(F.col("sample_no") == i).alias(f"s{i}") for i in range(3)])


def quality_by_cycle(spark, sf_dir):
    """How many bases have each quality at each cycle, of first and of last reads."""
    rows = bs.exploded(aligned(spark, sf_dir), "flag", "l_qseq")
    cycle = F.when(F.col("reverse"), F.col("l_qseq") - F.col("place")).otherwise(F.col("place") + 1)
    return rows.groupBy((F.col("flag").bitwiseAND(64) != 0).alias("first"), cycle.alias("cycle"), "q").agg(F.count("*").alias("n"))


def mismatches_by_cycle(spark, sf_dir):
    rows = bs.exploded(aligned(spark, sf_dir), "l_qseq").where("base <> ref_base and base <> 'N'")
    cycle = F.when(F.col("reverse"), F.col("l_qseq") - F.col("place")).otherwise(F.col("place") + 1)
    return rows.groupBy(cycle.alias("cycle"), "q").agg(F.count("*").alias("n"))


def base_content_by_cycle(spark, sf_dir):
    rows = bs.exploded(aligned(spark, sf_dir), "l_qseq")
    cycle = F.when(F.col("reverse"), F.col("l_qseq") - F.col("place")).otherwise(F.col("place") + 1)
    return rows.groupBy(cycle.alias("cycle")).agg(*[F.count_if(F.col("base") == c).alias(c.lower()) for c in "ACGTN"])


def read_gc_histogram(spark, sf_dir):
    return aligned(spark, sf_dir).groupBy(F.length(F.regexp_replace("seq", "[^GC]", "")).alias("gc")).agg(F.count("*").alias("n"))


def reference_gc_histogram(spark, sf_dir):
    """G and C in each line of 60 bases of the contigs."""
    lines = view(spark, sf_dir, "fx_ref").select(F.explode(F.regexp_extract_all("seq", F.lit("[ACGTN]{1,60}"), F.lit(0))).alias("line"))
    return lines.groupBy(F.length(F.regexp_replace("line", "[^GC]", "")).alias("gc")).agg(F.count("*").alias("n"))


def statistics_summary(spark, sf_dir):
    """Counters of an alignment report, by name."""
    own = aligned(spark, sf_dir)
    gone = F.col("flag").bitwiseAND(1024) != 0
    sums = own.agg(
        F.count("*").alias("sequences"), F.count_if(F.col("flag").bitwiseAND(64) != 0).alias("first"), F.count_if(F.col("flag").bitwiseAND(128) != 0).alias("last"),
        F.count_if(gone).alias("duplicated"), F.count_if(F.col("mapq") == 0).alias("mapping_zero"), F.sum("l_qseq").alias("length"),
        F.sum(F.when(gone, F.col("l_qseq")).otherwise(0)).alias("length_duplicated"), F.max("l_qseq").cast("long").alias("longest"),
    )
    return sums.select(F.explode(F.create_map(*[x for c in sums.columns for x in (F.lit(c), F.col(c))])).alias("name", "value"))


QUERIES = {f.__name__: f for f in (
    mismatch_tags, capped_mapping_quality, quality_sum, depth_by_sample, quality_by_cycle, mismatches_by_cycle, base_content_by_cycle, read_gc_histogram, reference_gc_histogram, statistics_summary,
)} | {
    "pileup_text": lambda s, d: bs.pileup_text(good(s, d)),
    "strand_sums": lambda s, d: bs.strand_sums(good(s, d)),
    "bias_tests": lambda s, d: bs.bias_tests(bs.strand_sums(good(s, d), varying=True)),
    "genotype_costs": lambda s, d: bs.genotype_costs(good(s, d)),
    "majority_bases": lambda s, d: bs.majority(good(s, d)),
    "consensus": lambda s, d: bs.consensus(good(s, d)),
}

#: Every base of every read; g: only usable reads.
ROWS = """rows_ AS (SELECT read_id, tid, pos, mapq, flag, sample_no, l_qseq, CAST(i AS INT) AS place, CAST(pos + i AS INT) AS site, substr(seq, CAST(i + 1 AS INT), 1) AS base, ascii(substr(qual, CAST(i + 1 AS INT), 1)) - 33 AS q,
    substr(ref, CAST(i + 1 AS INT), 1) AS ref_base, flag & 16 <> 0 AS reverse, CASE WHEN flag & 16 <> 0 THEN 60 - i ELSE i + 1 END AS cycle FROM (SELECT *, unnest(range(60)) AS i FROM fx_aln)), g AS (SELECT * FROM rows_ WHERE flag & 1796 = 0)"""
BEST = """m AS (SELECT tid, site, base, count(*) AS n FROM g WHERE q >= 13 AND base <> 'N' GROUP BY ALL),
  best AS (SELECT tid, site, CAST(sum(n) AS BIGINT) AS depth, first(base ORDER BY n DESC, base) AS base, max(n) AS share FROM m GROUP BY tid, site)"""
KINDS = [("q", "q"), ("mapq", "least(mapq, 60)"), ("end", "least(place, 59 - place, 25)")]
SUMS = ", ".join(
    [f"count(*) FILTER ({'' if d else 'NOT '}diff AND {'' if r else 'NOT '}reverse) AS i{2 * d + r}" for d in (0, 1) for r in (0, 1)]
    + [f"CAST(coalesce(sum(({v}) {'* (' + v + ')' if sq else ''}) FILTER ({'' if d else 'NOT '}diff), 0) AS BIGINT) AS i{4 * k + 2 * d + sq}" for k, (_, v) in enumerate(KINDS, 1) for d in (0, 1) for sq in (0, 1)]
)
ORACLES = {
    "mismatch_tags": duck(f"""WITH {ROWS}, w AS (SELECT read_id, place, ref_base, row_number() OVER (PARTITION BY read_id ORDER BY place) AS k FROM rows_ WHERE base <> ref_base OR base = 'N'),
      s AS (SELECT read_id, k, place, ref_base, place - coalesce(lag(place) OVER (PARTITION BY read_id ORDER BY place), -1) - 1 AS run FROM w)
      SELECT a.read_id, CAST(count(s.k) AS INT) AS nm, concat(coalesce(string_agg(concat(run, ref_base), '' ORDER BY k), ''), 59 - coalesce(max(place), -1)) AS md FROM fx_aln a LEFT JOIN s ON a.read_id = s.read_id GROUP BY a.read_id"""),
    "capped_mapping_quality": duck(f"""WITH {ROWS}, x AS (SELECT read_id, count(*) FILTER (ok) + 60 AS len, count(*) FILTER (ok AND base <> ref_base) AS mm, coalesce(sum(least(q, 33)) FILTER (ok AND base <> ref_base), 0) AS cost
        FROM (SELECT *, base <> 'N' AND ref_base <> 'N' AND q >= 13 AS ok FROM rows_) GROUP BY read_id),
      y AS (SELECT read_id, cost - 4.343 * coalesce(list_sum(list_transform(range(1, mm + 1), lambda i: ln(len / CAST(i AS DOUBLE)))), 0) AS t FROM x)
      SELECT read_id, CAST(CASE WHEN t > 40 THEN -1 ELSE floor(sqrt((40 - greatest(t, 0)) / 40) * 40 + 0.499) END AS INT) AS cap FROM y"""),
    "quality_sum": duck(f"WITH {ROWS} SELECT read_id, CAST(sum(q) AS INT) AS quality FROM rows_ GROUP BY read_id"),
    "depth_by_sample": duck(f"WITH {ROWS} SELECT tid, site, " + ", ".join(f"count(*) FILTER (sample_no = {i}) AS s{i}" for i in range(3)) + " FROM g WHERE q >= 13 GROUP BY tid, site"),
    "quality_by_cycle": duck(f"WITH {ROWS} SELECT flag & 64 <> 0 AS first, CAST(cycle AS INT) AS cycle, q, count(*) AS n FROM rows_ GROUP BY ALL"),
    "mismatches_by_cycle": duck(f"WITH {ROWS} SELECT CAST(cycle AS INT) AS cycle, q, count(*) AS n FROM rows_ WHERE base <> ref_base AND base <> 'N' GROUP BY ALL"),
    "base_content_by_cycle": duck(f"WITH {ROWS} SELECT CAST(cycle AS INT) AS cycle, " + ", ".join(f"count(*) FILTER (base = '{c}') AS {c.lower()}" for c in "ACGTN") + " FROM rows_ GROUP BY 1"),
    "read_gc_histogram": duck("SELECT CAST(length(regexp_replace(seq, '[^GC]', '', 'g')) AS INT) AS gc, count(*) AS n FROM fx_aln GROUP BY 1"),
    "reference_gc_histogram": duck("""WITH l AS (SELECT seq, unnest(range(0, CAST(length(seq) AS BIGINT), 60)) AS i FROM fx_ref)
      SELECT CAST(length(regexp_replace(substr(seq, CAST(i + 1 AS INT), 60), '[^GC]', '', 'g')) AS INT) AS gc, count(*) AS n FROM l GROUP BY 1"""),
    "statistics_summary": duck("""WITH s AS (SELECT count(*) AS sequences, count(*) FILTER (flag & 64 <> 0) AS first, count(*) FILTER (flag & 128 <> 0) AS last, count(*) FILTER (flag & 1024 <> 0) AS duplicated, count(*) FILTER (mapq = 0) AS mapping_zero,
        CAST(sum(l_qseq) AS BIGINT) AS length, CAST(sum(l_qseq) FILTER (flag & 1024 <> 0) AS BIGINT) AS length_duplicated, CAST(max(l_qseq) AS BIGINT) AS longest FROM fx_aln)
      SELECT * FROM (UNPIVOT s ON COLUMNS(*) INTO NAME name VALUE value)"""),
    "pileup_text": duck(f"""WITH {ROWS}, c AS (SELECT tid, site, pos, read_id, concat(CASE WHEN place = 0 THEN concat('^', chr(least(mapq, 93) + 33)) ELSE '' END,
        CASE WHEN base = ref_base AND base <> 'N' THEN CASE WHEN reverse THEN ',' ELSE '.' END WHEN reverse THEN lower(base) ELSE base END, CASE WHEN place = 59 THEN '$' ELSE '' END) AS b, chr(q + 33) AS q FROM g)
      SELECT tid, site, CAST(count(*) AS INT) AS n, string_agg(b, '' ORDER BY pos, read_id) AS bases, string_agg(q, '' ORDER BY pos, read_id) AS quals FROM c GROUP BY tid, site"""),
    "strand_sums": duck(f"WITH {ROWS} SELECT tid, site, {SUMS} FROM (SELECT *, base <> ref_base OR base = 'N' AS diff FROM g WHERE q >= 13) GROUP BY tid, site"),
    "majority_bases": duck(f"WITH {ROWS}, {BEST} SELECT * FROM best"),
    "consensus": duck(f"""WITH {ROWS}, {BEST}, p AS (SELECT tid, site, concat(repeat('n', coalesce(site - lag(site) OVER (PARTITION BY tid ORDER BY site) - 1, 0)), CASE WHEN depth >= 2 THEN base ELSE lower(base) END) AS piece FROM best)
      SELECT tid, min(site) AS beg, string_agg(piece, '' ORDER BY site) AS seq FROM p GROUP BY tid"""),
}
