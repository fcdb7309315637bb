"""Queries of the calling path: pair filters and ends, insert sizes, evidence, scores and the final choice."""

from __future__ import annotations

from pyspark.sql import functions as F

from lociq.functions import cigar as cg
from lociq.operators import calling as ca
from lociq.operators import depth as dp
from lociq.operators import reads as rd
from lociq.plans.fixtures import duck, view

LENGTH, INSERT, SD, OVERLAP, CLIP = 65, 200, 30, 25, 11
#: Bound on the lengths of the fixture's reads, windows and calls.
LONGEST = 512


def mated(spark, sf_dir):
    """Reads with their mate's place, where that is on the same chromosome (null elsewhere)."""
    m = view(spark, sf_dir, "fx_mates")
    fields = ("read_id", "tid", "pos", "l_qseq", "flag", "mapq", "mtid", "mpos", "tlen", "fin")
    f = m.selectExpr("f_id", "tid", "f_pos", "f_len", "f_flag", "f_mapq", "tid", "r_pos", "isize", "f_pos + f_len").toDF(*fields)
    return f.unionByName(m.selectExpr("r_id", "tid", "r_pos", "r_len", "r_flag", "r_mapq", "tid", "f_pos", "-isize", "r_pos + r_len").toDF(*fields))


def mate_rows(spark, sf_dir):
    ok = lambda s: (F.col(f"{s}_flag").bitwiseAND(rd.MASK) == 0)
    return view(spark, sf_dir, "fx_mates").withColumns({"f_ok": ok("f"), "r_ok": ok("r")})


def candidates(spark, sf_dir):
    deleted = F.col("type") == "DEL"
    own = view(spark, sf_dir, "fx_cnv").where("type <> 'VAR' and p2 - p1 >= 5")
    return own.select("tid", F.when(deleted, F.col("p1")).otherwise(F.col("p2")).alias("f2"), F.when(deleted, F.col("p2")).otherwise(F.col("p1")).alias("r1")).distinct()


def steps(spark, sf_dir):
    return dp.depth_steps(rd.usable(view(spark, sf_dir, "fx_read")), short=1)


def flank_width(calls):
    """Five read lengths, no more than three spans, no less than a read length."""
    span = F.abs(F.col("f2") - F.col("r1"))
    return calls.withColumn("dx", F.greatest(F.lit(LENGTH), F.when(5 * LENGTH / 3 > span, 3 * span).otherwise(5 * LENGTH)).cast("int"))


def flank_inside_depth(spark, sf_dir):
    return dp.flank_means(flank_width(candidates(spark, sf_dir)), steps(spark, sf_dir))


def derivative_depth(spark, sf_dir):
    return dp.step_means(candidates(spark, sf_dir), steps(spark, sf_dir))


def pair_evidence(spark, sf_dir):
    return ca.pair_evidence(candidates(spark, sf_dir).persist(), mate_rows(spark, sf_dir).persist(), INSERT, SD, LONGEST)


def insert_sample_stats(spark, sf_dir):
    """From the first 10,001 proper pairs of each chromosome, by position."""
    proper = ca.proper_pairs(mated(spark, sf_dir)).select("tid", "pos", "read_id", F.col("tlen").alias("isize"))
    places = rd.running(proper.groupBy("tid", "pos").agg(F.count("*").alias("here")), "here", "upto").select("tid", "pos", (F.col("upto") - F.col("here")).alias("base"))
    first = proper.join(places.where("base < 10001"), ["tid", "pos"])
    at = ca.Window.partitionBy("tid", "pos").orderBy("read_id")
    return ca.insert_sample(first.withColumn("no", F.row_number().over(at)).where("base + no <= 10001"))


def insert_full_stats(spark, sf_dir):
    proper = ca.proper_pairs(mated(spark, sf_dir)).select("tid", F.col("tlen").alias("isize"))
    return ca.insert_full(proper, insert_sample_stats(spark, sf_dir))


def clip_edges(spark, sf_dir):
    """tid, f2 or r1, and how many usable reads are clipped there, from (MS) or up to (SM) it."""
    ops = cg.operations(F.col("cigar"))
    own = rd.usable(view(spark, sf_dir, "fx_sam")).select(
        "tid", "pos", (F.col("pos") + cg.total(ops, cg.ON_REFERENCE) - 1).alias("last"), cg.clip(ops, 1).alias("head"), cg.clip(ops, -1).alias("tail")
    )
    ms = own.where("tail > 0").groupBy("tid", F.col("last").alias("at")).agg(F.count("*").alias("n"))
    sm = own.where("head > 0").groupBy("tid", F.col("pos").alias("at")).agg(F.count("*").alias("n"))
    return ms, sm


def clipped_reads(calls, edges, at: str, name: str):
    """`calls` with the number of clipped reads within two bases of `at`."""
    near = edges.select("tid", F.explode(F.sequence(F.col("at") - 2, F.col("at") + 2)).alias(at), "n").groupBy("tid", at).agg(F.sum("n").alias(name))
    return calls.join(near, ["tid", at], "left").na.fill(0, [name])


def evidence(spark, sf_dir):
    calls = candidates(spark, sf_dir)
    keys = calls.columns
    # All depths of a call from one pass over its places.
    found = dp.bases_before(flank_width(calls), steps(spark, sf_dir), dp.flank_places() | dp.step_places() | {"f2_at": F.col("f2"), "r1_at": F.col("r1")})
    depths = found.select(*keys, *dp.flank_columns(), *dp.step_columns(), F.col("f2_at_depth").alias("f2_depth"), F.col("r1_at_depth").alias("r1_depth"))
    ms, sm = clip_edges(spark, sf_dir)
    clipped = clipped_reads(clipped_reads(calls, ms, "f2", "f2_sr"), sm, "r1", "r1_sr")
    return depths.join(pair_evidence(spark, sf_dir), keys).join(clipped, keys).withColumn("ms_ed", (F.col("f2") + F.col("r1")) % 40)


SCORES = ("rpscore", "rdscore", "ddscore", "srscore")


def evidence_scores(spark, sf_dir):
    return ca.assessed(evidence(spark, sf_dir), LENGTH).select("tid", "f2", "r1", "f2_rd", "r1_rd", "rd", "frrp", "f2_sr", "r1_sr", *SCORES)


def sources(spark, sf_dir):
    """Candidates of pairs, without split reads, and of split reads, without pairs, one after the other."""
    all_ = evidence(spark, sf_dir).withColumn("un", (F.col("f2") + F.col("tid")) % 30)
    pairs = all_.withColumns({c: F.lit(-1).cast("long") for c in ("f2_sr", "r1_sr")}).withColumns({"source": F.lit(0), "sr_count": F.lit(0).cast("long")})
    split = all_.withColumns({c: F.lit(-1).cast("long") for c in ("f2_rp", "r1_rp", "frrp")}).withColumns({"source": F.lit(1), "sr_count": F.col("f2_sr") + F.col("r1_sr")})
    return ca.assessed(pairs.unionByName(split), LENGTH)


def strong_weak_router(spark, sf_dir):
    calls = ca.strength(ca.without_duplicates(sources(spark, sf_dir)), LENGTH, SD, OVERLAP, CLIP)
    return calls.groupBy("strength", F.when(F.col("f2") < F.col("r1"), "DEL").otherwise("DUP").alias("type")).agg(F.count("*").alias("n"))


def pair_group_sizes(spark, sf_dir):
    far = ca.abnormal_pairs(mated(spark, sf_dir), INSERT + 6 * SD).select("tid", "f2", "r1")
    return ca.pair_groups(far, INSERT, SD, LENGTH, 4).groupBy("tid", "session").agg(F.count("*").alias("size"), F.max("f2").alias("f2"), F.min("r1").alias("r1"))


def break_point_resolve(spark, sf_dir):
    own = view(spark, sf_dir, "fx_mates").selectExpr("tid", "f_pos + f_len AS f2", "r_pos AS r1", "CAST(abs(isize) % 7 AS INT) AS ed")
    return ca.break_points(own, LENGTH)


QUERIES = {f.__name__: f for f in (
    flank_inside_depth, derivative_depth, pair_evidence, insert_sample_stats, insert_full_stats, evidence_scores, strong_weak_router, pair_group_sizes, break_point_resolve,
)} | {
    "pair_filter": lambda s, d: ca.counts_for_pairs(mated(s, d), 10).select("read_id", "tid"),
    "proper_pair_sample": lambda s, d: ca.proper_pairs(mated(s, d), 10).select("read_id", "tid"),
    "abnormal_pairs": lambda s, d: ca.abnormal_pairs(mated(s, d), INSERT + 6 * SD).select("read_id", "tid", "f2", "r1"),
    "pair_ends": lambda s, d: ca.pair_ends(mated(s, d)),
}

MATED = """mated AS (SELECT f_id AS read_id, tid, f_pos AS pos, f_len AS len, f_flag AS flag, f_mapq AS mapq, r_pos AS mpos, isize AS tlen FROM fx_mates
  UNION ALL SELECT r_id, tid, r_pos, r_len, r_flag, r_mapq, f_pos, -isize FROM fx_mates)"""
CALLS = "calls AS (SELECT DISTINCT tid, CASE type WHEN 'DEL' THEN p1 ELSE p2 END AS f2, CASE type WHEN 'DEL' THEN p2 ELSE p1 END AS r1 FROM fx_cnv WHERE type <> 'VAR' AND p2 - p1 >= 5)"
#: Depth of every base, one base of each read short.
BASES = """bases AS (SELECT tid, CAST(p AS INT) AS p, count(*) AS n FROM (SELECT tid, unnest(range(CAST(pos AS BIGINT), CAST(pos + l_qseq - 1 AS BIGINT))) AS p FROM fx_read WHERE flag & 1796 = 0) GROUP BY ALL),
  ends AS (SELECT *, least(f2, r1) AS b, greatest(f2, r1) AS e, CASE WHEN f2 > r1 THEN 1 ELSE 0 END AS s, greatest(65, CASE WHEN 5 * 65 / 3.0 > abs(f2 - r1) THEN 3 * abs(f2 - r1) ELSE 325 END) AS dx FROM calls)"""
OUTER = """outer_ AS (SELECT ends.tid, f2, r1, s, dx, floor(coalesce(sum(n) FILTER (p BETWEEN b - dx + 1 - s AND b - s), 0) / dx + 0.5) AS lo,
    floor(coalesce(sum(n) FILTER (p BETWEEN e + s AND e + s + dx - 1), 0) / dx + 0.5) AS hi,
    floor(coalesce(sum(n) FILTER (p BETWEEN b + 1 - s AND e - 1 + s), 0) / (e - b - 1 + 2 * s + 1e-9) + 0.5) AS i
    FROM ends LEFT JOIN bases ON ends.tid = bases.tid AND p BETWEEN b - dx - 1 AND e + dx + 1 GROUP BY ends.tid, f2, r1, s, dx, b, e),
  flanks AS (SELECT tid, f2, r1, CAST(dx AS INT) AS dx, CAST(CASE s WHEN 0 THEN lo ELSE hi END AS INT) AS f2_rd, CAST(CASE s WHEN 0 THEN hi ELSE lo END AS INT) AS r1_rd, CAST(i AS INT) AS rd FROM outer_)"""
INNER = """near_ AS (SELECT ends.tid, f2, r1, s, floor(coalesce(sum(n) FILTER (p BETWEEN b - 99 - s AND b - s), 0) / 100.0 + 0.5) AS lo, floor(coalesce(sum(n) FILTER (p BETWEEN e + s AND e + s + 99), 0) / 100.0 + 0.5) AS hi,
    floor(CASE WHEN e - b <= 100 THEN coalesce(sum(n) FILTER (p BETWEEN b + 1 - s AND e - 1 + s), 0) / (e - b - 1 + 2 * s + 1e-9) ELSE coalesce(sum(n) FILTER (p BETWEEN b + 1 - s AND b + 101 - s), 0) / (100 + 1e-9) END + 0.5) AS li,
    floor(CASE WHEN e - b <= 100 THEN coalesce(sum(n) FILTER (p BETWEEN b + 1 - s AND e - 1 + s), 0) / (e - b - 1 + 2 * s + 1e-9) ELSE coalesce(sum(n) FILTER (p BETWEEN e + s - 100 AND e + s - 1), 0) / (100 + 1e-9) END + 0.5) AS ri
    FROM ends LEFT JOIN bases ON ends.tid = bases.tid AND p BETWEEN b - 101 AND e + 101 GROUP BY ends.tid, f2, r1, s, b, e),
  slopes AS (SELECT tid, f2, r1, CAST(CASE s WHEN 0 THEN lo ELSE hi END AS INT) AS f2_out, CAST(CASE s WHEN 0 THEN li ELSE ri END AS INT) AS f2_in, CAST(CASE s WHEN 0 THEN ri ELSE li END AS INT) AS r1_in,
    CAST(CASE s WHEN 0 THEN hi ELSE lo END AS INT) AS r1_out FROM near_)"""
#: Insert 200, sd 30, so 350 bases either way.
PAIRS = """f AS (SELECT tid, f_pos AS beg, f_pos + f_len AS fin, f_pos AS a, f_pos + isize - CASE WHEN isize > 0 THEN 1 ELSE -1 END AS z, isize FROM fx_mates WHERE f_flag & 1796 = 0),
  r AS (SELECT tid, r_pos AS beg, r_pos + r_len AS fin, f_pos AS a, r_pos + r_len AS z, isize FROM fx_mates WHERE r_flag & 1796 = 0),
  spots AS (SELECT tid, f2, r1, 'F' AS side, f2 AS x, greatest(1, f2 - 350) AS w0, f2 AS w1, 'f' AS reads FROM calls UNION ALL SELECT tid, f2, r1, 'R', r1, r1, r1 + 350, 'r' FROM calls
    UNION ALL SELECT tid, f2, r1, 'R2', r1, greatest(1, r1 - 350), r1, 'f' FROM calls UNION ALL SELECT tid, f2, r1, 'F2', f2, f2, f2 + 350, 'r' FROM calls),
  both_ AS (SELECT 'f' AS reads, * FROM f UNION ALL SELECT 'r', * FROM r),
  seen AS (SELECT s.tid, f2, r1, side, a < x AND z > x AS point, a <= f2 AND z >= r1 AS sv, abs(z - a - 200) AS own, abs(f2 - a + z - r1 - 200) AS via, abs(isize) BETWEEN 50 AND 350 AND a < x AND z > x AS usual, beg <= x AS upto
    FROM spots s JOIN both_ b ON s.tid = b.tid AND s.reads = b.reads AND fin > w0 AND beg < w1),
  counted AS (SELECT tid, f2, r1, count(*) FILTER (side = 'F' AND point AND own < 150 AND (NOT sv OR own < via)) AS ln, count(*) FILTER (side = 'R' AND point AND own < 150 AND (NOT sv OR own < via)) AS rn,
    count(*) FILTER (side = 'F' AND sv AND via < 210 AND CASE WHEN point THEN own >= via ELSE via < own END) AS lc, count(*) FILTER (side = 'R' AND sv AND via < 210 AND CASE WHEN point THEN own >= via ELSE via < own END) AS rc,
    count(*) FILTER (side = 'F' AND usual) AS l1, count(*) FILTER (side = 'F2' AND usual AND upto) AS l2, count(*) FILTER (side = 'R2' AND usual) AS r1_, count(*) FILTER (side = 'R' AND usual AND upto) AS r2_ FROM seen GROUP BY ALL),
  paired AS (SELECT c.tid, c.f2, c.r1, coalesce(CASE WHEN ln >= 10 THEN ln WHEN l1 >= 10 THEN l1 ELSE greatest(l1, l2) END, 0) AS f2_rp, coalesce(CASE WHEN rn >= 10 THEN rn WHEN r1_ >= 10 THEN r1_ ELSE greatest(r1_, r2_) END, 0) AS r1_rp,
    coalesce(greatest(lc, rc), 0) AS frrp FROM calls c LEFT JOIN counted k ON c.tid = k.tid AND c.f2 = k.f2 AND c.r1 = k.r1)"""
CLIPS = """cig AS (SELECT tid, pos, pos + CAST(list_sum(list_transform(regexp_extract_all(cigar, '([0-9]+)[MDN]', 1), lambda x: CAST(x AS INT))) AS INT) - 1 AS last, regexp_matches(cigar, '^[0-9]+S') AS head, regexp_matches(cigar, 'S$') AS tail
    FROM fx_sam WHERE flag & 1796 = 0),
  clipped AS (SELECT c.tid, c.f2, c.r1, (SELECT count(*) FROM cig g WHERE g.tid = c.tid AND g.tail AND g.last BETWEEN c.f2 - 2 AND c.f2 + 2) AS f2_sr, (SELECT count(*) FROM cig g WHERE g.tid = c.tid AND g.head AND g.pos BETWEEN c.r1 - 2 AND c.r1 + 2) AS r1_sr FROM calls c)"""
EVIDENCE = f"""WITH {CALLS}, {BASES}, {OUTER}, {INNER}, {PAIRS}, {CLIPS},
  ev AS (SELECT tid, f2, r1, f2_rd, r1_rd, rd, f2_out, f2_in, r1_in, r1_out, f2_rp, r1_rp, frrp, f2_sr, r1_sr, coalesce(x.n, 0) AS f2_depth, coalesce(y.n, 0) AS r1_depth, (f2 + r1) % 40 AS ms_ed
    FROM flanks JOIN slopes USING (tid, f2, r1) JOIN paired USING (tid, f2, r1) JOIN clipped USING (tid, f2, r1) LEFT JOIN bases x ON x.tid = flanks.tid AND x.p = flanks.f2 LEFT JOIN bases y ON y.tid = flanks.tid AND y.p = flanks.r1)"""
STEPS = {"rd": ("3 / 4", "2 / 3", "5 / 9", "1 / 5"), "up": ("5 / 4", "4 / 3", "3 / 2", "2 / 1"), "in": ("3 / 4", "2 / 3", "4 / 7", "1 / 2"), "out": ("5 / 4", "4 / 3", "3 / 2", "9 / 5")}


def case(steps, test: str) -> str:
    """The number of the last step that passes; division is that of whole numbers."""
    return "CASE " + " ".join(f"WHEN {test.format(s.replace('/', '//'))} THEN {4 - i}" for i, s in enumerate(reversed(steps))) + " ELSE 0 END"


def scored(source: str) -> str:
    """Scores of the evidence in `source`; what is -1 wasn't gathered."""
    rd = f"CASE WHEN least(f2_rd, r1_rd) < 8 THEN 0 WHEN f2 < r1 THEN {case(STEPS['rd'], 'rd < least(f2_rd, r1_rd) * {}')} ELSE {case(STEPS['up'], 'rd > greatest(f2_rd, r1_rd) * {}')} END"
    dd = f"CASE WHEN least(f2_out, r1_out) < 8 THEN 0 WHEN f2 < r1 THEN {case(STEPS['in'], 'f2_in < f2_out * {0} AND r1_in < r1_out * {0}')} ELSE {case(STEPS['out'], 'f2_in > f2_out * {0} AND r1_in > r1_out * {0}')} END"
    rp = f"CASE WHEN frrp <= 4 OR greatest(f2_rp, r1_rp, frrp) < 6 THEN 0 ELSE {case(('1 / 3', '1 / 2', '2 / 3', '3 / 4'), 'frrp > expected * {}')} END"
    sr = """CASE WHEN least(f2_rd, r1_rd) <= 0 OR ms_ed > 32 OR greatest(f2_sr, r1_sr) <= 2 THEN 0 WHEN least(f2_sr, r1_sr) <= 2 THEN least(1, sr0) ELSE sr0 END"""
    sr0 = """CASE WHEN f2_sr * 3 > f2_depth AND r1_sr * 3 > r1_depth THEN 4 WHEN (f2_sr * 3 > f2_depth OR r1_sr * 3 > r1_depth) AND f2_sr * 4 > f2_depth AND r1_sr * 4 > r1_depth THEN 3
      WHEN (f2_sr * 4 > f2_depth OR r1_sr * 4 > r1_depth) AND f2_sr * 8 > f2_depth AND r1_sr * 8 > r1_depth THEN 2 WHEN f2_sr * 8 > f2_depth OR r1_sr * 8 > r1_depth THEN 1 ELSE 0 END"""
    return f"""(SELECT *, CASE WHEN f2_rp < 0 THEN -1 ELSE {rp} END AS rpscore, CASE WHEN f2_rd < 0 THEN -1 WHEN dd = 0 THEN 0 ELSE {rd} END AS rdscore, CASE WHEN f2_out < 0 THEN -1 ELSE dd END AS ddscore,
      CASE WHEN f2_sr < 0 THEN -1 ELSE {sr} END AS srscore FROM (SELECT *, {dd} AS dd, {sr0} AS sr0, greatest(20, f2_rp, r1_rp) // CASE WHEN f2 > r1 THEN 2 ELSE 1 END AS expected FROM {source}))"""


BOTH = f"""{EVIDENCE}, p AS (SELECT * FROM {scored('(SELECT * REPLACE (-1 AS f2_sr, -1 AS r1_sr), (f2 + tid) % 30 AS un, 0 AS sr_count FROM ev)')}),
  q AS (SELECT * FROM {scored('(SELECT * REPLACE (-1 AS f2_rp, -1 AS r1_rp, -1 AS frrp), (f2 + tid) % 30 AS un, f2_sr + r1_sr AS sr_count FROM ev)')}),
  w AS (SELECT p.tid, p.f2, p.r1, p.sr_count > q.sr_count AS k1, p, q FROM p JOIN q ON p.tid = q.tid AND p.f2 = q.f2 AND p.r1 = q.r1),
  x AS (SELECT *, CASE WHEN p.rdscore <> q.rdscore THEN p.rdscore > q.rdscore ELSE k1 END AS k2 FROM w), y AS (SELECT *, CASE WHEN p.rpscore <> q.rpscore THEN p.rpscore > q.rpscore ELSE k2 END AS k3 FROM x),
  z AS (SELECT *, CASE WHEN p.srscore <> q.srscore THEN p.srscore > q.srscore ELSE k3 END AS k4 FROM y),
  one AS (SELECT tid, f2, r1, CASE WHEN k1 THEN p.un ELSE q.un END AS un, CASE WHEN k1 THEN p.sr_count ELSE q.sr_count END AS sr_count, CASE WHEN k2 THEN p.f2_rd ELSE q.f2_rd END AS f2_rd, CASE WHEN k2 THEN p.r1_rd ELSE q.r1_rd END AS r1_rd,
    CASE WHEN k2 THEN p.rd ELSE q.rd END AS rd, CASE WHEN k2 THEN p.rdscore ELSE q.rdscore END AS rdscore, CASE WHEN k3 THEN p.rpscore ELSE q.rpscore END AS rpscore, CASE WHEN k4 THEN p.srscore ELSE q.srscore END AS srscore, abs(f2 - r1) AS span FROM z),
  judged AS (SELECT *, CASE WHEN greatest(rdscore, rpscore, srscore) <= 0 AND (sr_count <= 3 OR (un >= 25 AND un >= span)) THEN 'none'
    WHEN greatest(0, rpscore) + greatest(0, rdscore) + greatest(0, srscore) >= 2 OR (un < 37.5 AND (span < 65 AND rdscore >= 2 OR rpscore < 0 AND srscore > 2 OR span < 150 AND srscore > 2
      OR sr_count >= greatest(20, (f2_rd + r1_rd) // 2 * 0.25 * (1 - 25 / 65.0) * (1 - 22 / 65.0))))
    THEN CASE WHEN least(f2_rd, r1_rd) < 10 OR (span > 210 AND rpscore = 0 AND srscore <= 1) OR (un * 2 > 65 AND rdscore <= 0 AND rpscore <= 0) OR (rpscore <= 0 AND srscore <= 0 AND (f2_rd * 4 < r1_rd OR r1_rd * 4 < f2_rd
      OR (f2 > r1 AND rd < greatest(f2_rd, r1_rd)) OR (f2 < r1 AND rd > least(f2_rd, r1_rd)) OR (rd > 50 AND span > 210 AND rdscore <= 1))) THEN 'weak' ELSE 'strong' END
    WHEN sr_count < 3 AND span <= un THEN 'none' ELSE 'weak' END AS strength FROM one)"""
GOOD = "flag & 1796 = 0 AND (flag & 16 <> 0) <> (flag & 32 <> 0)"
INSERTS = f"""{MATED}, own AS (SELECT tid, abs(tlen) AS x, row_number() OVER (PARTITION BY tid ORDER BY pos, read_id) AS k FROM mated WHERE {GOOD} AND flag & 2 <> 0),
  lists AS (SELECT tid, list(x ORDER BY x) AS l, count(*) AS n FROM own WHERE k <= 10001 GROUP BY tid HAVING count(*) > 2),
  q AS (SELECT tid, n, l[n // 2 + 1] AS insert, (l[n // 4 * 3 + 1] - l[n // 4 + 1]) / 1.35 AS raw FROM lists),
  sampled AS (SELECT tid, n, CAST(insert AS INT) AS insert, CAST(CASE WHEN insert > 1000 OR raw > 2 * insert THEN insert // 2 ELSE trunc(raw) END AS INT) AS sd FROM q)"""
ENDS = """CASE WHEN flag & 16 <> 0 THEN mpos + len - 1 ELSE pos + len END AS f2, CASE WHEN flag & 16 <> 0 THEN pos ELSE mpos END AS r1"""
ORACLES = {
    "flank_inside_depth": duck(f"WITH {CALLS}, {BASES}, {OUTER} SELECT * FROM flanks"),
    "derivative_depth": duck(f"WITH {CALLS}, {BASES}, {INNER} SELECT * FROM slopes"),
    "pair_evidence": duck(f"WITH {CALLS}, {PAIRS} SELECT * FROM paired"),
    "insert_sample_stats": duck(f"WITH {INSERTS} SELECT * FROM sampled"),
    "insert_full_stats": duck(f"""WITH {INSERTS}, near_ AS (SELECT tid, x FROM own JOIN sampled USING (tid) WHERE x > insert - 10 * sd AND x < insert + 10 * sd)
      SELECT tid, count(*) AS n, CAST(trunc(avg(x)) AS INT) AS insert, CAST(CASE WHEN stddev_pop(x) < 30 THEN 50 ELSE trunc(stddev_pop(x)) END AS INT) AS sd FROM near_ GROUP BY tid HAVING count(*) > 2"""),
    "evidence_scores": duck(f"{EVIDENCE} SELECT tid, f2, r1, f2_rd, r1_rd, rd, frrp, f2_sr, r1_sr, {', '.join(SCORES)} FROM {scored('ev')}"),
    "strong_weak_router": duck(f"{BOTH} SELECT strength, CASE WHEN f2 < r1 THEN 'DEL' ELSE 'DUP' END AS type, count(*) AS n FROM judged GROUP BY 1, 2"),
    "pair_filter": duck(f"WITH {MATED} SELECT read_id, tid FROM mated WHERE {GOOD} AND mapq >= 10"),
    "proper_pair_sample": duck(f"WITH {MATED} SELECT read_id, tid FROM mated WHERE {GOOD} AND mapq >= 10 AND flag & 2 <> 0"),
    "abnormal_pairs": duck(f"WITH {MATED} SELECT * FROM (SELECT read_id, tid, {ENDS} FROM mated WHERE {GOOD} AND abs(tlen) >= 380) WHERE f2 > 0 AND r1 > 0"),
    "pair_ends": duck(f"""WITH {MATED} SELECT read_id, {ENDS}, CASE WHEN flag & 16 <> 0 THEN mpos ELSE pos END AS f1,
      CASE WHEN flag & 16 <> 0 THEN pos + len ELSE pos + tlen - CASE WHEN tlen > 0 THEN 1 ELSE -1 END END AS r2, CASE WHEN flag & 16 <> 0 THEN -tlen ELSE tlen END AS isize FROM mated"""),
    "pair_group_sizes": duck(f"""WITH {MATED}, far AS (SELECT * FROM (SELECT tid, {ENDS} FROM mated WHERE {GOOD} AND abs(tlen) >= 380) WHERE f2 > 0 AND r1 > 0),
      g AS (SELECT *, f2 - lag(f2) OVER (PARTITION BY tid ORDER BY f2) AS gap FROM far), s AS (SELECT *, CAST(sum(CASE WHEN gap IS NULL OR gap > 318 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY f2) AS BIGINT) AS session FROM g),
      t AS (SELECT tid, session, count(*) AS size, max(f2) AS f2, min(r1) AS r1 FROM s GROUP BY tid, session) SELECT * FROM t WHERE size >= CASE WHEN session = (SELECT max(session) FROM t u WHERE u.tid = t.tid) THEN 2 ELSE 4 END"""),
}
