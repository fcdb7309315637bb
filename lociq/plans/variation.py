"""Queries over variant records, genotype likelihoods, calls on contigs, and the text tables around them."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociq.functions import cigar as cg
from lociq.functions import sequences as sq
from lociq.operators import association as ac
from lociq.operators import bases as bs
from lociq.operators import depth as dp
from lociq.operators import filters as fl
from lociq.operators import intervals as iv
from lociq.operators import reads as rd
from lociq.plans.fixtures import duck, view
from lociq.plans.formats import OPS
from lociq.plans.variants import PL
from lociq.sources import tables as tb

LONGEST = 512


def likelihoods(spark, sf_dir):
    return view(spark, sf_dir, "fx_geno").selectExpr("site", "sample", "grp", *PL, "CASE WHEN grp IN ('click', 'view') THEN 1 ELSE 2 END AS `group`")


def numbered(spark, sf_dir):
    """Event types as sites in order, users as samples."""
    own = likelihoods(spark, sf_dir)
    names = spark.sql("SELECT grp, CAST(row_number() OVER (ORDER BY grp) AS INT) AS site FROM {g}", g=own.select("grp").distinct())
    return own.drop("site").join(names, "grp")


def rounded(df, *cols, digits=5):
    return df.withColumns({c: F.round(c, digits) for c in cols})


def genotype_counts(spark, sf_dir):
    return view(spark, sf_dir, "fx_geno").groupBy("site").agg(*[F.count_if(F.col("gt") == g).alias(f"n{g}") for g in range(3)])


def posterior_calls(spark, sf_dir):
    own = likelihoods(spark, sf_dir).join(view(spark, sf_dir, "fx_geno").select("site", "sample", "grp", "gt"), ["site", "sample", "grp"])
    freq = own.groupBy("site").agg((F.sum("gt") / (2 * F.count("*"))).alias("freq"))
    rows = own.drop("gt").join(freq, "site").withColumn("ploidy", (F.col("sample") % 2 + 1).cast("int"))
    return ac.posterior_calls(rows).select("site", "sample", "grp", "gt", "gq")


def trios(spark, sf_dir):
    costs = lambda k: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda i: ((F.col("sample") * 7 + i * (13 + k) + F.col("site") * k) % 60).cast("int"))
    return view(spark, sf_dir, "fx_geno").select("site", "sample", "grp", *[costs(k).alias(n) for k, n in enumerate(("father", "mother", "child"), 1)])


def trio_calls(spark, sf_dir):
    return ac.trio_calls(trios(spark, sf_dir)).select("site", "sample", "grp", "free", "bound", "ratio")


def pair_calls(spark, sf_dir):
    return trios(spark, sf_dir).select("site", "sample", "grp", ac.pair_ratio(F.col("father"), F.col("mother")).alias("ratio"))


def shrunken_costs(spark, sf_dir):
    gl = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda i: -((F.col("sample") * 3 + i * 7) % 40) / 10.0)
    pl = ac.kept_alleles(ac.to_costs(gl), 3, 2)
    return view(spark, sf_dir, "fx_geno").select("site", "sample", "grp", *[pl[i].alias(f"pl{i}") for i in range(3)])


def records(spark, sf_dir):
    return view(spark, sf_dir, "fx_var").withColumn("dp_alt", F.col("alt_fwd") + F.col("alt_rev"))


def annotation_filter(spark, sf_dir):
    return fl.annotation_filter(records(spark, sf_dir).where("alt <> '.'"), least_p=0.01).select("id", "filter")


def window_filter(spark, sf_dir):
    return fl.window_filter(fl.annotation_filter(records(spark, sf_dir).where("alt <> '.'"), least_p=0.01)).select("id", "filter")


def known_sites(spark, sf_dir):
    """Records with whether one of another day's records is at their site."""
    own = records(spark, sf_dir).where("alt <> '.'").select("id", "tid", "pos", "alt")
    known = records(spark, sf_dir).where("dp > 20").select("tid", "pos", "alt").distinct().withColumn("known", F.lit(True))
    return own.join(known, ["tid", "pos", "alt"], "left").na.fill(False, ["known"]).select("id", "known")


def linked_intervals(spark, sf_dir):
    sites = records(spark, sf_dir).groupBy("tid", "pos").agg(F.max("pv").alias("r"))
    return fl.linked_intervals(sites, 0.9)


def scored_alignments(spark, sf_dir):
    ops = cg.operations(F.col("cigar"))
    gaps = F.filter(ops, lambda o: o["op"].isin("I", "D"))
    score = cg.total(ops, "M") - 5 * F.size(gaps) - 2 * F.aggregate(gaps, F.lit(0), lambda a, o: a + o["size"])
    return view(spark, sf_dir, "fx_sam").select(F.floor(F.col("read_id") / 4).alias("name"), F.col("read_id").alias("id"), score.alias("score"))


def alignments_compared(spark, sf_dir):
    own = view(spark, sf_dir, "fx_read").select(F.col("read_id").alias("name"), "tid", "pos", rd.bit("flag", 16).alias("reverse"), "mapq")
    other = own.where("mapq <> 7").withColumns({"pos": F.col("pos") + F.col("name") % 150, "mapq": (F.col("mapq") * 3 + 1) % 61})
    return fl.alignments_compared(own.where("mapq <> 11"), other)


def runs_of_n(spark, sf_dir):
    runs = view(spark, sf_dir, "fx_ref").select("tid", F.explode(sq.n_runs_of("seq")).alias("r"))
    return runs.select("tid", F.col("r.beg").alias("q1"), (F.col("r.end") - 1).alias("q2"))


#: Letters of a contig's block in which calls look for an N.
BLOCK = 512


def sequence_pass(spark, sf_dir):
    """FAIL for calls that leave their contig or hold an N, which is looked for in the blocks of the contig that the call touches."""
    calls = view(spark, sf_dir, "fx_dcall").select("tid", "p1", "p2").distinct()
    contigs = view(spark, sf_dir, "fx_ref")
    size = F.length("seq")
    blocks = contigs.select("tid", "seq", F.explode(F.sequence(F.lit(0), F.floor(F.greatest(size - 1, F.lit(0)) / BLOCK).cast("int"))).alias("block"))
    blocks = blocks.select("tid", "block", F.substr(F.col("seq").cast("binary"), F.col("block") * BLOCK + 1, F.lit(BLOCK)).cast("string").alias("text"))
    inside = calls.join(contigs.select("tid", size.alias("length")), "tid").withColumn("out", F.col("p2") >= F.col("length"))
    # A call that leaves its contig fails as it is.
    touched = F.when(F.col("out"), F.array(F.lit(0))).otherwise(F.sequence(F.floor(F.col("p1") / BLOCK).cast("int"), F.floor(F.col("p2") / BLOCK).cast("int")))
    met = inside.withColumn("block", F.explode(touched)).join(blocks, ["tid", "block"])
    at = F.expr(f"locate('N', text, greatest(0, p1 - block * {BLOCK}) + 1)")
    bad = F.col("out") | ((at > 0) & (at <= F.col("p2") - F.col("block") * BLOCK + 1))
    return met.groupBy("tid", "p1", "p2").agg(F.when(F.max(bad), "FAIL").otherwise("PASS").alias("verdict"))


def outside_n_regions(spark, sf_dir):
    """Calls but for those with depth evidence of which a run of N covers more than a third."""
    calls = view(spark, sf_dir, "fx_dcall").select("tid", "p1", "p2", "rdscore")
    met = iv.overlap_join(calls.where("rdscore >= 1"), runs_of_n(spark, sf_dir), longest=1 << 20)
    bad = met.where((F.least("p2", "q2") - F.greatest("p1", "q1")) * 3 > F.col("p2") - F.col("p1")).select(*calls.columns).distinct()
    return calls.join(bad, calls.columns, "left_anti")


def mismatch_masks(spark, sf_dir):
    """Stretches of a contig in which reads keep differing from it."""
    return bs.mismatch_masks(view(spark, sf_dir, "fx_aln"))


def target_segments(spark, sf_dir):
    """Stretches of a contig that a two-state chain takes for covered, from good bases at each position."""
    return bs.target_segments(rd.usable(view(spark, sf_dir, "fx_aln")))


def het_in_calls(spark, sf_dir):
    """Heterozygous sites strictly inside each call: how many, the root mean square of their quality, and up to ten places."""
    calls = view(spark, sf_dir, "fx_cnv").select("tid", "p1", "p2").distinct()
    sites = records(spark, sf_dir).where("qual > 0 and alt <> '.'").select("id", "tid", F.floor(F.col("pos") / 20).cast("int").alias("pos"), "qual")
    met = iv.point_in(sites, calls, LONGEST).groupBy("tid", "p1", "p2").agg(F.count("*").alias("n"), F.sum(F.col("qual") * F.col("qual")).alias("ss"), F.array_sort(F.collect_set("pos")).alias("places"))
    return met.select("tid", "p1", "p2", "n", F.round(F.sqrt(F.col("ss") / F.col("n")), 4).alias("rms"), F.when(F.size("places") <= 10, F.concat_ws(",", F.transform("places", lambda x: x.cast("string")))).otherwise("").alias("places"))


def type_matrix(spark, sf_dir):
    """The type's letter of each sample at each place, 0 for none; of several the last."""
    letter = F.when(F.col("type") == "DEL", "D").when(F.col("type") == "DUP", "A").otherwise("V")
    own = view(spark, sf_dir, "fx_cnv").groupBy("tid", "p1", "p2").agg(*[F.coalesce(F.max(F.when(F.col("sample_no") == i, letter)), F.lit("0")).alias(f"s{i}") for i in range(1, 8)])
    return own.withColumn("rowsum", sum(F.when(F.col(f"s{i}") != "0", 1).otherwise(0) for i in range(1, 8)))


def region_share(spark, sf_dir):
    """Calls that overlap a region by more than half of the longer one."""
    g = view(spark, sf_dir, "fx_region").select("tid", F.col("beg").alias("q1"), F.col("fin").alias("q2"))
    return iv.reciprocal_join(view(spark, sf_dir, "fx_cnv"), g, 0.3).select("sample_no", "tid", "p1", "p2", "type").distinct()


def low_quality_share(spark, sf_dir):
    """Share of a region's reads of mapping quality 0 and at most 10; null for a region with fewer than two."""
    own = view(spark, sf_dir, "fx_read").select("mapq", "tid", F.col("pos").alias("q1"), (F.col("pos") + F.col("l_qseq") - 1).alias("q2"))
    regions = view(spark, sf_dir, "fx_region").select("region_no", "tid", F.col("beg").alias("p1"), (F.col("fin") - 1).alias("p2"))
    met = iv.overlap_join(regions, own, longest=LONGEST).groupBy("region_no").agg(F.count("*").alias("n"), *[F.avg((F.col("mapq") <= q).cast("int")).alias(f"q{q}") for q in (0, 10)])
    return met.select("region_no", *[F.when(F.col("n") > 1, F.round(f"q{q}", 6)).alias(f"q{q}") for q in (0, 10)])


def depth_moments(spark, sf_dir):
    """Mean and standard deviation of the depth between the first and last covered position of each chromosome."""
    from lociq.plans.reads import depth_spans

    runs = depth_spans(rd.depth_runs(rd.usable(view(spark, sf_dir, "fx_read")))).where("until is not null").withColumn("n", F.col("until") - F.col("pos"))
    sums = runs.groupBy("tid").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("depth")).alias("s"), F.sum(F.col("n") * F.col("depth") * F.col("depth")).alias("ss"), F.min("pos").alias("beg"), F.max("until").alias("fin"))
    mean = F.col("s") / F.col("n")
    return sums.select("tid", "beg", "fin", F.round(mean, 4).alias("mean"), F.round(F.sqrt(F.col("ss") / F.col("n") - mean * mean), 4).alias("sd"))


def depth_slope(spark, sf_dir):
    """At each call's start the mean depth of the 25 positions from it on less that of the 25 before."""
    calls = view(spark, sf_dir, "fx_cnv").select("tid", "p1").distinct()
    got = dp.bases_before(calls, dp.depth_steps(rd.usable(view(spark, sf_dir, "fx_read"))), {"a": F.col("p1") - 25, "b": F.col("p1"), "c": F.col("p1") + 25})
    return got.select("tid", "p1", F.round((F.col("c") - 2 * F.col("b") + F.col("a")) / 25, 4).alias("slope"))


def even_sample(spark, sf_dir, wanted: int = 50):
    """Reads of each chromosome, `wanted` of them evenly spaced by position and id."""
    own = view(spark, sf_dir, "fx_read").select("tid", "pos", "read_id")
    places = rd.running(own.groupBy("tid", "pos").agg(F.count("*").alias("here")), "here", "upto").select("tid", "pos", (F.col("upto") - F.col("here")).alias("base"))
    ranked = own.withColumn("no", F.row_number().over(Window.partitionBy("tid", "pos").orderBy("read_id"))).join(places, ["tid", "pos"])
    ranked = ranked.join(own.groupBy("tid").agg(F.count("*").alias("n")), "tid").withColumn("k", F.col("base") + F.col("no"))
    step = lambda k: F.floor(k * F.least(F.lit(wanted), F.col("n")) / F.col("n"))
    return ranked.where(step(F.col("k")) > step(F.col("k") - 1)).select("tid", "pos", "read_id")


def base_positions(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_sam").select("read_id", F.posexplode(cg.positions(cg.operations(F.col("cigar")), F.col("pos"))).alias("base", "site"))
    return rows.groupBy("read_id").agg(F.count("*").alias("n"), F.sum(F.col("site").cast("long")).alias("total"), F.max("site").alias("last"))


def aligned_length(spark, sf_dir):
    return view(spark, sf_dir, "fx_sam").select("read_id", cg.total(cg.operations(F.col("cigar")), "MI").alias("length"))


def split_records(spark, sf_dir):
    """Each read whole, and its first and last seven tenths."""
    n = F.floor(F.col("l_qseq") * 0.7).cast("int")
    parts = [("whole", F.lit(1), F.col("l_qseq")), ("left", F.lit(1), n), ("right", F.col("l_qseq") - n + 1, n)]
    cut = F.array(*[F.struct(F.lit(k).alias("part"), F.col("seq").substr(a, b).alias("seq"), F.col("qual").substr(a, b).alias("qual")) for k, a, b in parts])
    return view(spark, sf_dir, "fx_aln").select("read_id", F.explode(cut).alias("r")).select("read_id", "r.*")


def common_substring(spark, sf_dir):
    from lociq.plans.sequences import fragments, wholes

    own = fragments(wholes(spark, sf_dir))
    return own.select("doc_id", "fragment_no", sq.common_of("seq", sq.reverse_complement(F.col("seq"))).alias("c")).select("doc_id", "fragment_no", "c.*")


def header_lines(spark, sf_dir):
    n = view(spark, sf_dir, "nation")
    return n.select(F.concat_ws("\t", F.lit("@SQ"), F.concat(F.lit("SN:chr"), "n_nationkey"), F.concat(F.lit("LN:"), F.col("n_nationkey") * 1000 + 7), F.concat(F.lit("AS:"), "n_name")).alias("value"))


def call_lines(spark, sf_dir):
    swap = F.col("tid") % 2 == 1
    return view(spark, sf_dir, "fx_cnv").select(F.concat_ws("  ", F.concat(F.lit("chr"), "tid"), F.when(swap, F.col("p2")).otherwise(F.col("p1")), F.when(swap, F.col("p1")).otherwise(F.col("p2")), "type").alias("value"))


def score_filter(spark, sf_dir):
    """Calls none of whose scores is 0 or 1; -1 stands for evidence that wasn't gathered."""
    own = view(spark, sf_dir, "fx_dcall").withColumns({"rp": (F.col("p1") + F.col("tid")) % 6 - 1, "sr": F.col("p2") % 5 - 1})
    return own.where("rdscore not in (0, 1) and rp not in (0, 1) and sr not in (0, 1)").select("tid", "p1", "p2")


def strand_variants(spark, sf_dir):
    own = records(spark, sf_dir).where("alt <> '.' and length(ref) = 1 and length(alt) = 1").withColumn("strand", F.when(F.col("id") % 2 == 0, "-").otherwise("+"))
    turn = lambda c: F.when(F.col("strand") == "-", F.translate(c, "ACGT", "TGCA")).otherwise(F.col(c))
    rows = own.select("id", F.col("tid").alias("chrom"), "pos", "ref", "strand", F.when(F.col("id") % 17 == 0, F.concat_ws("/", turn("alt"), turn("alt"))).otherwise(F.concat_ws("/", turn("ref"), turn("alt"))).alias("observed"))
    return tb.strand_variants(rows)


def annotation_notes(spark, sf_dir):
    rows = view(spark, sf_dir, "fx_cnv").select(F.col("tid").alias("chrom"), F.col("p1").alias("beg"), F.col("p2").alias("fin"), F.col("sample_no").alias("no"), "type")
    notes = rows.where("type <> 'VAR'").groupBy("chrom", "beg", "fin", "no").agg(F.max("type").alias("note"))
    return tb.annotated(rows.select("chrom", "beg", "fin").distinct(), notes)


def merged_headers(spark, sf_dir):
    own = header_lines(spark, sf_dir)
    return tb.merged_headers(own, own.select(F.replace("value", F.lit("AS:"), F.lit("AS:x")).alias("value")), own.limit(0))


def metadata_groups(spark, sf_dir):
    own = view(spark, sf_dir, "supplier").select(F.format_string('<RUN accession="R%d" sample="S%d" platform="P%d" />', F.col("s_suppkey"), F.col("s_suppkey") % 7, F.col("s_nationkey")).alias("value"))
    return tb.read_groups(own)


QUERIES = {f.__name__: f for f in (
    posterior_calls, trio_calls, pair_calls, shrunken_costs, annotation_filter, window_filter, known_sites, linked_intervals, alignments_compared, sequence_pass, outside_n_regions,
    mismatch_masks, target_segments, het_in_calls, type_matrix, region_share, low_quality_share, depth_moments, depth_slope, even_sample, base_positions, aligned_length, split_records, common_substring,
    score_filter, strand_variants, annotation_notes, merged_headers, metadata_groups,
)} | {
    "frequency_tests": lambda s, d: ac.frequency_tests(likelihoods(s, d)),
    "haplotype_em": lambda s, d: ac.haplotypes(numbered(s, d)),
    "hardy_weinberg_exact": lambda s, d: ac.exact_hardy_weinberg(genotype_counts(s, d)),
    "allele_spectrum": lambda s, d: ac.spectrum(likelihoods(s, d)),
    "permutation_test": lambda s, d: ac.permutation_test(view(s, d, "fx_geno").selectExpr("site", "gt", "CASE WHEN grp IN ('click', 'view') THEN 1 ELSE 2 END AS `group`")),
    "variant_filter": lambda s, d: fl.record_filter(records(s, d), gaps=False).select("id", "ref", "alt"),
    "gap_spectrum": lambda s, d: fl.gap_spectrum(records(s, d)),
    "best_alignments": lambda s, d: fl.best_alignments(scored_alignments(s, d)),
    "header_table": lambda s, d: tb.header_table(header_lines(s, d), "SQ", ["SN", "LN", "M5"]),
    "calls_parsed": lambda s, d: tb.parse_calls(call_lines(s, d)),
    "viewer_batch": lambda s, d: tb.viewer_batch(tb.parse_calls(call_lines(s, d)).distinct()),
    "regions_parsed": lambda s, d: view(s, d, "fx_region").select("region_no", tb.parse_region(F.format_string("chr%d:%,d-%d", F.col("tid"), F.col("beg") + 1, F.col("fin"))).alias("r")).select("region_no", "r.*"),
    "tiles": lambda s, d: tb.tiles(view(s, d, "fx_ref").select("tid", F.length("seq").alias("length")).where("length > 0"), 500),
    "bed_lines": lambda s, d: tb.bed_of(view(s, d, "fx_sam"), cg.total(cg.operations(F.col("cigar")), "MDN")),
    "genotype_probabilities": lambda s, d: tb.genotype_probabilities(likelihoods(s, d)).select("site", "sample", "value"),
}

VAR = "v AS (SELECT *, alt_fwd + alt_rev AS dp_alt FROM fx_var)"
TEN = "list_transform(range(10), lambda i: CAST((sample * 7 + i * ({} + 13) + site * {}) % 60 AS INT))"
TRIO = "t AS (SELECT site, sample, grp, " + ", ".join(f"{TEN.format(k, k)} AS {n}" for k, n in enumerate(("f", "m", "c"), 1)) + " FROM fx_geno)"
RUNS = """chars AS (SELECT tid, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS ch FROM fx_ref), ns AS (SELECT tid, i, i - row_number() OVER (PARTITION BY tid ORDER BY i) AS g FROM chars WHERE ch = 'N'),
  runs AS (SELECT tid, min(i) AS q1, max(i) AS q2 FROM ns GROUP BY tid, g)"""
GOOD = "flag & 1796 = 0"
BASES = f"bases AS (SELECT tid, CAST(p AS INT) AS p, count(*) AS n FROM (SELECT tid, unnest(range(CAST(pos AS BIGINT), CAST(pos + l_qseq AS BIGINT))) AS p FROM fx_read WHERE {GOOD}) GROUP BY ALL)"
ORACLES = {
    "posterior_calls": duck(f"""WITH l AS (SELECT site, sample, grp, gt, {', '.join(PL)} FROM fx_geno), s AS (SELECT site, sum(gt) / (2.0 * count(*)) AS f FROM l GROUP BY site),
      p AS (SELECT site, sample, grp, pow(10.0, -pl0 / 10.0) * CASE WHEN sample % 2 = 1 THEN (1 - f) * (1 - f) ELSE 1 - f END AS a, pow(10.0, -pl1 / 10.0) * CASE WHEN sample % 2 = 1 THEN 2 * f * (1 - f) ELSE 0 END AS b,
        pow(10.0, -pl2 / 10.0) * CASE WHEN sample % 2 = 1 THEN f * f ELSE f END AS c FROM l JOIN s USING (site))
      SELECT site, sample, grp, CAST(CASE greatest(a, b, c) WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS INT) AS gt, CAST(least(99, floor(-4.343 * ln(greatest(1e-308, 1 - greatest(a, b, c) / (a + b + c))) + 0.499)) AS INT) AS gq FROM p"""),
    "trio_calls": duck(f"""WITH {TRIO}, g AS (SELECT row_number() OVER (ORDER BY i, j) AS k, i, j FROM range(4) a(i), range(4) b(j) WHERE i <= j),
      fits AS (SELECT f.k AS fk, m.k AS mk, c.k AS ck FROM g f, g m, g c WHERE (c.i IN (f.i, f.j) AND c.j IN (m.i, m.j)) OR (c.j IN (f.i, f.j) AND c.i IN (m.i, m.j))),
      b AS (SELECT site, sample, grp, min(f[fk] + m[mk] + c[ck]) AS bound, any_value(list_min(f) + list_min(m) + list_min(c)) AS free FROM t, fits GROUP BY site, sample, grp)
      SELECT site, sample, grp, CAST(free AS INT) AS free, CAST(bound AS INT) AS bound, CAST(bound - free AS INT) AS ratio FROM b"""),
    "pair_calls": duck(f"WITH {TRIO} SELECT site, sample, grp, CAST(list_min(list_transform(range(1, 11), lambda i: f[i] + m[i])) - list_min(f) - list_min(m) AS INT) AS ratio FROM t"),
    "shrunken_costs": duck("""WITH g AS (SELECT site, sample, grp, list_transform(range(6), lambda i: -((sample * 3 + i * 7) % 40) / 10.0) AS gl FROM fx_geno),
      p AS (SELECT *, list_transform(gl, lambda x: CAST(least(255, floor(-10 * (x - list_max(gl)) + 0.499)) AS INT)) AS pl FROM g) SELECT site, sample, grp, pl[1] AS pl0, pl[2] AS pl1, pl[3] AS pl2 FROM p"""),
    "annotation_filter": duck(f"""WITH {VAR} SELECT id, CAST(CASE WHEN dp_alt < 2 THEN 4 WHEN dp < 2 THEN 2 WHEN dp > 10000000 THEN 3 WHEN mq < 10 THEN 1 WHEN pv < 0.01 THEN 7 ELSE 0 END AS INT) AS filter FROM v WHERE alt <> '.'"""),
    "known_sites": duck(f"WITH {VAR} SELECT id, EXISTS (SELECT 1 FROM v w WHERE w.dp > 20 AND w.tid = v.tid AND w.pos = v.pos AND w.alt = v.alt) AS known FROM v WHERE alt <> '.'"),
    "linked_intervals": duck("""WITH s AS (SELECT tid, pos, max(pv) AS r FROM fx_var GROUP BY tid, pos), l AS (SELECT *, lag(pos) OVER (PARTITION BY tid ORDER BY pos) AS b FROM s)
      SELECT count(*) AS intervals, count(*) FILTER (r > 0.9 AND b IS NOT NULL) AS linked, CAST(coalesce(sum(pos - b) FILTER (r > 0.9), 0) AS BIGINT) AS bases FROM l"""),
    "alignments_compared": duck("""WITH a AS (SELECT read_id, tid, pos, flag & 16 <> 0 AS rev, mapq FROM fx_read WHERE mapq <> 11), b AS (SELECT read_id, tid, pos + read_id % 150 AS pos, flag & 16 <> 0 AS rev, (mapq * 3 + 1) % 61 AS mapq FROM fx_read WHERE mapq <> 7)
      SELECT CASE WHEN a.read_id IS NULL THEN 'first missing' WHEN b.read_id IS NULL THEN 'second missing' WHEN a.tid = b.tid AND a.rev = b.rev AND abs(a.pos - b.pos) < 100 THEN 'consistent' ELSE 'inconsistent' END AS kind,
      concat_ws('/', CASE WHEN a.mapq >= 10 THEN 'high' WHEN a.mapq IS NOT NULL THEN 'low' END, CASE WHEN b.mapq >= 10 THEN 'high' WHEN b.mapq IS NOT NULL THEN 'low' END) AS quality, count(*) AS n FROM a FULL JOIN b ON a.read_id = b.read_id GROUP BY 1, 2"""),
    "sequence_pass": duck("""SELECT DISTINCT c.tid, p1, p2, CASE WHEN p2 >= length(seq) OR contains(substr(seq, p1 + 1, p2 - p1 + 1), 'N') THEN 'FAIL' ELSE 'PASS' END AS verdict FROM fx_dcall c JOIN fx_ref r ON c.tid = r.tid"""),
    "outside_n_regions": duck(f"WITH {RUNS} SELECT tid, p1, p2, rdscore FROM fx_dcall c WHERE NOT (rdscore >= 1 AND EXISTS (SELECT 1 FROM runs r WHERE r.tid = c.tid AND q1 <= p2 AND p1 <= q2 AND (least(p2, q2) - greatest(p1, q1)) * 3 > p2 - p1))"),
    "het_in_calls": duck("""WITH h AS (SELECT tid, CAST(floor(pos / 20) AS INT) AS pos, qual FROM fx_var WHERE qual > 0 AND alt <> '.'), c AS (SELECT DISTINCT tid, p1, p2 FROM fx_cnv),
      m AS (SELECT c.tid, p1, p2, count(*) AS n, sum(qual * qual) AS ss, list_sort(list(DISTINCT pos)) AS l FROM c JOIN h ON c.tid = h.tid AND p1 < pos AND pos < p2 GROUP BY ALL)
      SELECT tid, p1, p2, n, round(sqrt(CAST(ss AS DOUBLE) / n), 4) AS rms, CASE WHEN len(l) <= 10 THEN array_to_string(l, ',') ELSE '' END AS places FROM m"""),
    "type_matrix": duck("WITH l AS (SELECT tid, p1, p2, sample_no, max(CASE type WHEN 'DEL' THEN 'D' WHEN 'DUP' THEN 'A' ELSE 'V' END) AS t FROM fx_cnv GROUP BY ALL) SELECT tid, p1, p2, "
      + ", ".join(f"coalesce(max(t) FILTER (sample_no = {i}), '0') AS s{i}" for i in range(1, 8)) + ", CAST(count(*) AS INT) AS rowsum FROM l GROUP BY tid, p1, p2"),
    "region_share": duck("SELECT DISTINCT c.* FROM fx_cnv c JOIN fx_region g ON c.tid = g.tid WHERE least(p2, fin) - greatest(p1, beg) + 1 > 0.3 * greatest(p2 - p1, fin - beg)"),
    "low_quality_share": duck("""SELECT region_no, CASE WHEN count(*) > 1 THEN round(avg(CASE WHEN mapq = 0 THEN 1.0 ELSE 0 END), 6) END AS q0, CASE WHEN count(*) > 1 THEN round(avg(CASE WHEN mapq <= 10 THEN 1.0 ELSE 0 END), 6) END AS q10
      FROM fx_region g JOIN fx_read r ON g.tid = r.tid AND pos <= fin - 1 AND beg <= pos + l_qseq - 1 GROUP BY region_no"""),
    "depth_moments": duck(f"""WITH {BASES}, e AS (SELECT tid, CAST(min(p) AS INT) AS beg, CAST(max(p) + 1 AS INT) AS fin, sum(n) AS s, CAST(sum(n * n) AS DOUBLE) AS ss FROM bases GROUP BY tid)
      SELECT tid, beg, fin, round(s / CAST(fin - beg AS DOUBLE), 4) AS mean, round(sqrt(ss / (fin - beg) - (s / CAST(fin - beg AS DOUBLE)) * (s / CAST(fin - beg AS DOUBLE))), 4) AS sd FROM e"""),
    "depth_slope": duck(f"""WITH {BASES}, c AS (SELECT DISTINCT tid, p1 FROM fx_cnv) SELECT c.tid, p1, round(coalesce(sum(CASE WHEN p >= p1 THEN n ELSE -n END), 0) / 25.0, 4) AS slope
      FROM c LEFT JOIN bases b ON b.tid = c.tid AND p >= p1 - 25 AND p < p1 + 25 GROUP BY c.tid, p1"""),
    "even_sample": duck("""WITH r AS (SELECT tid, pos, read_id, row_number() OVER (PARTITION BY tid ORDER BY pos, read_id) AS k, count(*) OVER (PARTITION BY tid) AS n FROM fx_read)
      SELECT tid, pos, read_id FROM r WHERE (k * least(50, n)) // n > ((k - 1) * least(50, n)) // n"""),
    "aligned_length": duck("SELECT read_id, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MI]', 1), lambda x: CAST(x AS INT))) AS INT) AS length FROM fx_sam"),
    "split_records": duck("""SELECT read_id, 'whole' AS part, seq, qual FROM fx_aln UNION ALL SELECT read_id, 'left', substr(seq, 1, 42), substr(qual, 1, 42) FROM fx_aln UNION ALL SELECT read_id, 'right', substr(seq, 19), substr(qual, 19) FROM fx_aln"""),
    "score_filter": duck("SELECT tid, p1, p2 FROM fx_dcall WHERE rdscore >= 2 AND (p1 + tid) % 6 - 1 NOT IN (0, 1) AND p2 % 5 - 1 NOT IN (0, 1)"),
    "base_positions": duck(OPS + """SELECT read_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN op = 'M' THEN n * r + n * (n - 1) // 2 ELSE -n END) AS BIGINT) AS total, CAST(max(CASE WHEN op = 'M' THEN r + n - 1 ELSE -1 END) AS INT) AS last
      FROM placed WHERE op IN ('M', 'I', 'S') GROUP BY read_id"""),
    "genotype_probabilities": lambda s, d: tb.genotype_probabilities(likelihoods(s, d)).select("site", "sample", "value"),
}

VAR = "v AS (SELECT *, alt_fwd + alt_rev AS dp_alt FROM fx_var)"
TEN = "list_transform(range(10), lambda i: CAST((sample * 7 + i * ({} + 13) + site * {}) % 60 AS INT))"
TRIO = "t AS (SELECT site, sample, grp, " + ", ".join(f"{TEN.format(k, k)} AS {n}" for k, n in enumerate(("f", "m", "c"), 1)) + " FROM fx_geno)"
RUNS = """chars AS (SELECT tid, unnest(range(length(seq))) AS i, unnest(string_split(seq, '')) AS ch FROM fx_ref), ns AS (SELECT tid, i, i - row_number() OVER (PARTITION BY tid ORDER BY i) AS g FROM chars WHERE ch = 'N'),
  runs AS (SELECT tid, min(i) AS q1, max(i) AS q2 FROM ns GROUP BY tid, g)"""
GOOD = "flag & 1796 = 0"
BASES = f"bases AS (SELECT tid, CAST(p AS INT) AS p, count(*) AS n FROM (SELECT tid, unnest(range(CAST(pos AS BIGINT), CAST(pos + l_qseq AS BIGINT))) AS p FROM fx_read WHERE {GOOD}) GROUP BY ALL)"
ORACLES = {
    "posterior_calls": duck(f"""WITH l AS (SELECT site, sample, grp, gt, {', '.join(PL)} FROM fx_geno), s AS (SELECT site, sum(gt) / (2.0 * count(*)) AS f FROM l GROUP BY site),
      p AS (SELECT site, sample, grp, pow(10.0, -pl0 / 10.0) * CASE WHEN sample % 2 = 1 THEN (1 - f) * (1 - f) ELSE 1 - f END AS a, pow(10.0, -pl1 / 10.0) * CASE WHEN sample % 2 = 1 THEN 2 * f * (1 - f) ELSE 0 END AS b,
        pow(10.0, -pl2 / 10.0) * CASE WHEN sample % 2 = 1 THEN f * f ELSE f END AS c FROM l JOIN s USING (site))
      SELECT site, sample, grp, CAST(CASE greatest(a, b, c) WHEN a THEN 0 WHEN b THEN 1 ELSE 2 END AS INT) AS gt, CAST(least(99, floor(-4.343 * ln(greatest(1e-308, 1 - greatest(a, b, c) / (a + b + c))) + 0.499)) AS INT) AS gq FROM p"""),
    "trio_calls": duck(f"""WITH {TRIO}, g AS (SELECT row_number() OVER (ORDER BY i, j) AS k, i, j FROM range(4) a(i), range(4) b(j) WHERE i <= j),
      fits AS (SELECT f.k AS fk, m.k AS mk, c.k AS ck FROM g f, g m, g c WHERE (c.i IN (f.i, f.j) AND c.j IN (m.i, m.j)) OR (c.j IN (f.i, f.j) AND c.i IN (m.i, m.j))),
      b AS (SELECT site, sample, grp, min(f[fk] + m[mk] + c[ck]) AS bound, any_value(list_min(f) + list_min(m) + list_min(c)) AS free FROM t, fits GROUP BY site, sample, grp)
      SELECT site, sample, grp, CAST(free AS INT) AS free, CAST(bound AS INT) AS bound, CAST(bound - free AS INT) AS ratio FROM b"""),
    "pair_calls": duck(f"WITH {TRIO} SELECT site, sample, grp, CAST(list_min(list_transform(range(1, 11), lambda i: f[i] + m[i])) - list_min(f) - list_min(m) AS INT) AS ratio FROM t"),
    "shrunken_costs": duck("""WITH g AS (SELECT site, sample, grp, list_transform(range(6), lambda i: -((sample * 3 + i * 7) % 40) / 10.0) AS gl FROM fx_geno),
      p AS (SELECT *, list_transform(gl, lambda x: CAST(least(255, floor(-10 * (x - list_max(gl)) + 0.499)) AS INT)) AS pl FROM g) SELECT site, sample, grp, pl[1] AS pl0, pl[2] AS pl1, pl[3] AS pl2 FROM p"""),
    "annotation_filter": duck(f"""WITH {VAR} SELECT id, CAST(CASE WHEN dp_alt < 2 THEN 4 WHEN dp < 2 THEN 2 WHEN dp > 10000000 THEN 3 WHEN mq < 10 THEN 1 WHEN pv < 0.01 THEN 7 ELSE 0 END AS INT) AS filter FROM v WHERE alt <> '.'"""),
    "known_sites": duck(f"WITH {VAR} SELECT id, EXISTS (SELECT 1 FROM v w WHERE w.dp > 20 AND w.tid = v.tid AND w.pos = v.pos AND w.alt = v.alt) AS known FROM v WHERE alt <> '.'"),
    "linked_intervals": duck("""WITH s AS (SELECT tid, pos, max(pv) AS r FROM fx_var GROUP BY tid, pos), l AS (SELECT *, lag(pos) OVER (PARTITION BY tid ORDER BY pos) AS b FROM s)
      SELECT count(*) AS intervals, count(*) FILTER (r > 0.9 AND b IS NOT NULL) AS linked, CAST(coalesce(sum(pos - b) FILTER (r > 0.9), 0) AS BIGINT) AS bases FROM l"""),
    "alignments_compared": duck("""WITH a AS (SELECT read_id, tid, pos, flag & 16 <> 0 AS rev, mapq FROM fx_read WHERE mapq <> 11), b AS (SELECT read_id, tid, pos + read_id % 150 AS pos, flag & 16 <> 0 AS rev, (mapq * 3 + 1) % 61 AS mapq FROM fx_read WHERE mapq <> 7)
      SELECT CASE WHEN a.read_id IS NULL THEN 'first missing' WHEN b.read_id IS NULL THEN 'second missing' WHEN a.tid = b.tid AND a.rev = b.rev AND abs(a.pos - b.pos) < 100 THEN 'consistent' ELSE 'inconsistent' END AS kind,
      concat_ws('/', CASE WHEN a.mapq >= 10 THEN 'high' WHEN a.mapq IS NOT NULL THEN 'low' END, CASE WHEN b.mapq >= 10 THEN 'high' WHEN b.mapq IS NOT NULL THEN 'low' END) AS quality, count(*) AS n FROM a FULL JOIN b ON a.read_id = b.read_id GROUP BY 1, 2"""),
    "sequence_pass": duck("""SELECT DISTINCT c.tid, p1, p2, CASE WHEN p2 >= length(seq) OR contains(substr(seq, p1 + 1, p2 - p1 + 1), 'N') THEN 'FAIL' ELSE 'PASS' END AS verdict FROM fx_dcall c JOIN fx_ref r ON c.tid = r.tid"""),
    "outside_n_regions": duck(f"WITH {RUNS} SELECT tid, p1, p2, rdscore FROM fx_dcall c WHERE NOT (rdscore >= 1 AND EXISTS (SELECT 1 FROM runs r WHERE r.tid = c.tid AND q1 <= p2 AND p1 <= q2 AND (least(p2, q2) - greatest(p1, q1)) * 3 > p2 - p1))"),
    "het_in_calls": duck("""WITH h AS (SELECT tid, CAST(floor(pos / 20) AS INT) AS pos, qual FROM fx_var WHERE qual > 0 AND alt <> '.'), c AS (SELECT DISTINCT tid, p1, p2 FROM fx_cnv),
      m AS (SELECT c.tid, p1, p2, count(*) AS n, sum(qual * qual) AS ss, list_sort(list(DISTINCT pos)) AS l FROM c JOIN h ON c.tid = h.tid AND p1 < pos AND pos < p2 GROUP BY ALL)
      SELECT tid, p1, p2, n, round(sqrt(CAST(ss AS DOUBLE) / n), 4) AS rms, CASE WHEN len(l) <= 10 THEN array_to_string(l, ',') ELSE '' END AS places FROM m"""),
    "type_matrix": duck("WITH l AS (SELECT tid, p1, p2, sample_no, max(CASE type WHEN 'DEL' THEN 'D' WHEN 'DUP' THEN 'A' ELSE 'V' END) AS t FROM fx_cnv GROUP BY ALL) SELECT tid, p1, p2, "
      + ", ".join(f"coalesce(max(t) FILTER (sample_no = {i}), '0') AS s{i}" for i in range(1, 8)) + ", CAST(count(*) AS INT) AS rowsum FROM l GROUP BY tid, p1, p2"),
    "region_share": duck("SELECT DISTINCT c.* FROM fx_cnv c JOIN fx_region g ON c.tid = g.tid WHERE least(p2, fin) - greatest(p1, beg) + 1 > 0.3 * greatest(p2 - p1, fin - beg)"),
    "low_quality_share": duck("""SELECT region_no, CASE WHEN count(*) > 1 THEN round(avg(CASE WHEN mapq = 0 THEN 1.0 ELSE 0 END), 6) END AS q0, CASE WHEN count(*) > 1 THEN round(avg(CASE WHEN mapq <= 10 THEN 1.0 ELSE 0 END), 6) END AS q10
      FROM fx_region g JOIN fx_read r ON g.tid = r.tid AND pos <= fin - 1 AND beg <= pos + l_qseq - 1 GROUP BY region_no"""),
    "depth_moments": duck(f"""WITH {BASES}, e AS (SELECT tid, CAST(min(p) AS INT) AS beg, CAST(max(p) + 1 AS INT) AS fin, sum(n) AS s, CAST(sum(n * n) AS DOUBLE) AS ss FROM bases GROUP BY tid)
      SELECT tid, beg, fin, round(s / CAST(fin - beg AS DOUBLE), 4) AS mean, round(sqrt(ss / (fin - beg) - (s / CAST(fin - beg AS DOUBLE)) * (s / CAST(fin - beg AS DOUBLE))), 4) AS sd FROM e"""),
    "depth_slope": duck(f"""WITH {BASES}, c AS (SELECT DISTINCT tid, p1 FROM fx_cnv) SELECT c.tid, p1, round(coalesce(sum(CASE WHEN p >= p1 THEN n ELSE -n END), 0) / 25.0, 4) AS slope
      FROM c LEFT JOIN bases b ON b.tid = c.tid AND p >= p1 - 25 AND p < p1 + 25 GROUP BY c.tid, p1"""),
    "even_sample": duck("""WITH r AS (SELECT tid, pos, read_id, row_number() OVER (PARTITION BY tid ORDER BY pos, read_id) AS k, count(*) OVER (PARTITION BY tid) AS n FROM fx_read)
      SELECT tid, pos, read_id FROM r WHERE (k * least(50, n)) // n > ((k - 1) * least(50, n)) // n"""),
    "aligned_length": duck("SELECT read_id, CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MI]', 1), lambda x: CAST(x AS INT))) AS INT) AS length FROM fx_sam"),
    "split_records": duck("""SELECT read_id, 'whole' AS part, seq, qual FROM fx_aln UNION ALL SELECT read_id, 'left', substr(seq, 1, 42), substr(qual, 1, 42) FROM fx_aln UNION ALL SELECT read_id, 'right', substr(seq, 19), substr(qual, 19) FROM fx_aln"""),
    "score_filter": duck("SELECT tid, p1, p2 FROM fx_dcall WHERE rdscore >= 2 AND (p1 + tid) % 6 - 1 NOT IN (0, 1) AND p2 % 5 - 1 NOT IN (0, 1)"),
    "base_positions": duck(OPS + """SELECT read_id, CAST(sum(n) AS BIGINT) AS n, CAST(sum(CASE WHEN op = 'M' THEN n * r + n * (n - 1) // 2 ELSE -n END) AS BIGINT) AS total, CAST(max(CASE WHEN op = 'M' THEN r + n - 1 ELSE -1 END) AS INT) AS last
      FROM placed WHERE op IN ('M', 'I', 'S') GROUP BY read_id"""),
    "scored_lines": duck("WITH c AS (SELECT DISTINCT tid, p1 AS f, p2 AS r FROM fx_cnv) SELECT concat_ws(chr(9), concat('chr', tid), f + 1, r + 1, 'DEL', r - f, concat('UN:', (f * 2 + r) % 50), "
      "concat('RD:', (f * 3 + r) % 50, ';', (f * 4 + r) % 50, ';', (f * 5 + r) % 50, ':', (f * 6 + r) % 50), concat('RP:', (f * 7 + r) % 50, ';', (f * 8 + r) % 50, ';', (f * 9 + r) % 50, ':', (f * 10 + r) % 50), "
      "concat('SR:', (f * 11 + r) % 50, ';', (f * 12 + r) % 50, ':', (f * 13 + r) % 50)) AS value FROM c"),
    "genotype_probabilities": duck(f"""WITH l AS (SELECT site, sample, {', '.join(PL)} FROM fx_geno), p AS (SELECT site, sample, pow(10.0, -pl0 / 10.0) AS a, pow(10.0, -pl1 / 10.0) AS b, pow(10.0, -pl2 / 10.0) AS c FROM l)
      SELECT site, sample, concat_ws(' ', printf('%.4f', a / (a + b + c)), printf('%.4f', b / (a + b + c)), printf('%.4f', c / (a + b + c))) AS value FROM p"""),
    "strand_variants": duck("SELECT tid AS chrom, pos, ref, alt FROM fx_var WHERE alt <> '.' AND length(ref) = 1 AND length(alt) = 1 AND id % 17 <> 0"),
    "annotation_notes": duck("""WITH n AS (SELECT tid, p1, p2, sample_no, max(type) AS note FROM fx_cnv WHERE type <> 'VAR' GROUP BY ALL), l AS (SELECT tid, p1, p2, arg_max(note, sample_no) AS note FROM n GROUP BY ALL)
      SELECT DISTINCT c.tid AS chrom, c.p1 AS beg, c.p2 AS fin, coalesce(note, '#') AS note FROM fx_cnv c LEFT JOIN l USING (tid, p1, p2)"""),
    "merged_headers": "SELECT concat_ws(chr(9), '@SQ', concat('SN:chr', n_nationkey), concat('LN:', n_nationkey * 1000 + 7), concat('AS:', n_name)) AS value FROM nation",
    "metadata_groups": "SELECT concat_ws(chr(9), '@RG', concat('ID:R', s_suppkey), concat('SM:S', s_suppkey % 7), concat('PL:P', s_nationkey)) AS value FROM supplier",
    "variant_filter": duck("SELECT id, ref, alt FROM fx_var WHERE alt <> '.' AND length(ref) = length(alt)"),
    "gap_spectrum": duck("SELECT CAST(length(alt) - length(ref) AS INT) AS size, CAST(count(*) AS DOUBLE) AS n, (length(alt) - length(ref)) % 3 = 0 AS in_frame FROM fx_var WHERE alt <> '.' AND length(alt) <> length(ref) GROUP BY ALL"),
    "best_alignments": duck("""WITH o AS (SELECT read_id, regexp_extract_all(cigar, '([0-9]+)M', 1) AS m, regexp_extract_all(cigar, '([0-9]+)[ID]', 1) AS g FROM fx_sam),
      s AS (SELECT CAST(read_id // 4 AS BIGINT) AS name, read_id AS id, CAST(greatest(1, list_sum(list_transform(m, lambda x: CAST(x AS INT))) - 5 * len(g) - 2 * coalesce(list_sum(list_transform(g, lambda x: CAST(x AS INT))), 0)) AS INT) AS score FROM o),
      r AS (SELECT *, row_number() OVER w AS k, coalesce(lead(score) OVER w, 0) AS second FROM s WINDOW w AS (PARTITION BY name ORDER BY score DESC, id))
      SELECT name, id, score, CAST(least(250, floor(250.0 * (score - second) / score + 0.499)) AS INT) AS mapq FROM r WHERE k = 1"""),
    "header_table": "SELECT concat('chr', n_nationkey) AS sn, CAST(n_nationkey * 1000 + 7 AS VARCHAR) AS ln, CAST(NULL AS VARCHAR) AS m5 FROM nation",
    "calls_parsed": duck("SELECT concat('chr', tid) AS rname, p1, p2, type FROM fx_cnv"),
    "viewer_batch": duck("""WITH c AS (SELECT DISTINCT concat('chr', tid) AS r, p1, p2, type, least(5000, greatest(100, p2 - p1)) AS x FROM fx_cnv)
      SELECT concat_ws(chr(10), concat('region ', r, ' ', p1, ' ', p2), concat('goto ', r, ':', greatest(1, p1 - x), '-', p2 + x), 'collapse', concat('snapshot ', r, '_', p1, '_', p2, '.png')) AS value FROM c"""),
    "regions_parsed": duck("SELECT region_no, concat('chr', tid) AS chrom, beg, fin FROM fx_region"),
    "tiles": duck("""WITH l AS (SELECT tid, length(seq) AS n FROM fx_ref WHERE length(seq) > 0), t AS (SELECT tid, n, unnest(range(0, greatest(1, n), 500)) AS b FROM l)
      SELECT tid, CAST(b + 1 AS INT) AS beg, CAST(CASE WHEN n - b < 550 THEN n ELSE b + 500 END AS INT) AS fin FROM t WHERE b = 0 OR n - b >= 50"""),
    "bed_lines": duck("""SELECT concat_ws(chr(9), concat('chr', tid), pos, pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN]', 1), lambda x: CAST(x AS INT))) AS INT), concat('r', read_id), mapq,
      CASE WHEN flag & 16 <> 0 THEN '-' ELSE '+' END) AS value FROM fx_sam"""),
}
