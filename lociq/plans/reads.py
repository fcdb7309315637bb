"""Queries over aligned reads and read pairs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lociq.operators import intervals as iv
from lociq.operators import reads as rd
from lociq.plans.fixtures import duck, view


def reads(spark, sf_dir):
    return view(spark, sf_dir, "fx_read")


def pairs(spark, sf_dir):
    return view(spark, sf_dir, "fx_pair")


def idxstats(spark, sf_dir):
    own = reads(spark, sf_dir).groupBy("tid").agg(F.count_if(~rd.bit("flag", 4)).alias("mapped"), F.count_if(rd.bit("flag", 4)).alias("unmapped"))
    targets = spark.range(24).select(F.col("id").cast("int").alias("tid"))
    return targets.join(own, "tid", "left").na.fill(0)


def with_mates(spark, sf_dir):
    """Reads with their mate's chromosome, null without a mate."""
    own = reads(spark, sf_dir)
    mate = own.select("template_id", F.col("read_id").alias("mate"), F.col("tid").alias("mtid"))
    return own.join(mate, (own["template_id"] == mate["template_id"]) & (own["read_id"] != mate["mate"]), "left").drop(mate["template_id"])


def depth_spans(runs):
    """Depth runs with `until`, the next position of change; that of the last in a stretch is the next stretch's first."""
    cut = runs.withColumn("stretch", F.floor(F.col("pos") / rd.STRIDE))
    firsts = cut.groupBy("tid", "stretch").agg(F.min("pos").alias("first"))
    after = firsts.select("tid", "stretch", F.lead("first").over(Window.partitionBy("tid").orderBy("stretch")).alias("later"))
    nxt = F.lead("pos").over(Window.partitionBy("tid", "stretch").orderBy("pos"))
    return cut.withColumn("nxt", nxt).join(after, ["tid", "stretch"]).select("tid", "pos", "depth", F.coalesce("nxt", "later").alias("until"))


def coverage(own):
    spans = depth_spans(rd.depth_runs(own)).where("until is not null and depth > 0")
    return spans.groupBy(F.least("depth", F.lit(60)).cast("int").alias("depth")).agg(F.sum(F.col("until") - F.col("pos")).cast("long").alias("bases"))


def coverage_histogram(spark, sf_dir):
    return coverage(rd.usable(reads(spark, sf_dir)))


def physical_coverage(spark, sf_dir):
    """Depth of what lies between the reads of a pair, from where the first ends to where the second begins."""
    gaps = pairs(spark, sf_dir).where("r1 > f2").select("tid", F.col("f2").alias("pos"), (F.col("r1") - F.col("f2")).alias("l_qseq"))
    return rd.depth_runs(gaps).select("tid", "pos", F.col("depth").cast("long").alias("depth"))


def region_sums(spark, sf_dir, flank: int = 0):
    """Sum over each region of the reads' bases in it."""
    own = rd.usable(reads(spark, sf_dir)).select("read_id", "tid", F.col("pos").alias("q1"), (F.col("pos") + F.col("l_qseq") - 1).alias("q2"))
    regions = view(spark, sf_dir, "fx_region").select("region_no", "tid", (F.col("beg") - flank).alias("p1"), (F.col("fin") - 1 + flank).alias("p2"))
    met = iv.overlap_join(regions, own)
    return met.groupBy("region_no").agg(F.sum(iv.overlap(*[F.col(c) for c in ("p1", "p2", "q1", "q2")])).alias("bases"), F.count("*").alias("reads"))


def low_mapq_fraction(spark, sf_dir):
    own = reads(spark, sf_dir).select("mapq", "tid", F.col("pos").alias("q1"), (F.col("pos") + F.col("l_qseq") - 1).alias("q2"))
    regions = view(spark, sf_dir, "fx_region").select("region_no", "tid", F.col("beg").alias("p1"), (F.col("fin") - 1).alias("p2"))
    return iv.overlap_join(regions, own).groupBy("region_no").agg(
        F.count("*").alias("n"), F.count_if(F.col("mapq") == 0).alias("zero"), F.count_if(F.col("mapq") <= 10).alias("low")
    )


def insert_size_stats(spark, sf_dir):
    own = pairs(spark, sf_dir)
    return own.agg(
        F.count("*").alias("n"), F.round(F.avg("isize"), 4).alias("mean"), F.round(F.stddev_pop("isize"), 4).alias("sd"),
        F.min("isize").alias("least"), F.max("isize").alias("most"),
    )


def orientation(spark, sf_dir):
    kind = F.when(F.col("f1") <= F.col("r1"), "inward").when(F.col("f1") > F.col("r2"), "outward").otherwise("other")
    return pairs(spark, sf_dir).groupBy(kind.alias("kind")).agg(F.count("*").alias("n"))


def mate_join(spark, sf_dir):
    own = reads(spark, sf_dir)
    mate = own.select("template_id", F.col("read_id").alias("mate"), F.col("tid").alias("mtid"), F.col("pos").alias("mpos"), F.col("flag").alias("mflag"))
    return own.join(mate, "template_id").where("read_id <> mate").select(
        "read_id", "mtid", "mpos", F.when(F.col("tid") == F.col("mtid"), F.col("mpos") - F.col("pos")).otherwise(0).alias("isize"),
        rd.bit("mflag", 16).alias("mate_reverse"),
    )


def sessions(spark, sf_dir):
    own = pairs(spark, sf_dir).where("isize > 0").select("template_id", "tid", "f2", "r1", "isize")
    return rd.gap_sessions(own, "f2", 20)


def pair_gap_sessions(spark, sf_dir):
    return sessions(spark, sf_dir).groupBy("tid", "session").agg(F.count("*").alias("n"), F.max("f2").alias("f2"), F.min("r1").alias("r1"))


def pair_leader_clusters(spark, sf_dir):
    return rd.leader_clusters(sessions(spark, sf_dir), 200)


def break_point_merge(spark, sf_dir):
    ed = F.abs(F.col("isize")) % 7
    return pairs(spark, sf_dir).groupBy("tid", "f2", "r1").agg(F.count("*").alias("n"), F.sum(ed).alias("ed"))


def clip_band_join(spark, sf_dir):
    own = rd.usable(reads(spark, sf_dir))
    left = own.where(~rd.bit("flag", 16)).select("tid", "pos", "read_id")
    right = own.where(rd.bit("flag", 16)).select("tid", F.col("pos").alias("rpos"), F.col("read_id").alias("other"))
    return iv.band_join(left, right, 5).select("tid", "read_id", "other")


def call_format(spark, sf_dir):
    size = F.when(F.col("type") == "DUP", F.col("p1") - F.col("p2")).otherwise(F.col("p2") - F.col("p1"))
    line = F.concat_ws("\t", F.concat(F.lit("chr"), F.col("tid") + 1), F.col("p1") + 1, F.col("p2") + 1, "type", size)
    return view(spark, sf_dir, "fx_cnv").select(line.alias("line")).distinct()


def systematic_sample(spark, sf_dir):
    """Every third read of a chromosome by position and id: counts of earlier places and the rank at its own."""
    own = reads(spark, sf_dir).select("tid", "pos", "read_id")
    places = rd.running(own.groupBy("tid", "pos").agg(F.count("*").alias("here")), "here", "upto").select("tid", "pos", (F.col("upto") - F.col("here")).alias("base"))
    at = Window.partitionBy("tid", "pos").orderBy("read_id")
    ranked = own.withColumn("no", F.row_number().over(at)).join(places, ["tid", "pos"])
    return ranked.where("(base + no) % 3 = 0").select("tid", "pos", "read_id")


def pick(f, *cols):
    return lambda s, d: f(s, d).select(*cols)


QUERIES = {
    "flagstat": lambda s, d: rd.flagstat(with_mates(s, d)),
    "idxstats": idxstats,
    "depth_filter": lambda s, d: rd.usable(reads(s, d), 10).select("read_id"),
    "view_filter": lambda s, d: rd.view_filter(reads(s, d), 20, 1, 1280).select("read_id", "flag"),
    "depth_runs": lambda s, d: rd.depth_runs(rd.usable(reads(s, d))).select("tid", "pos", F.col("depth").cast("long").alias("depth")),
    "coverage_histogram": coverage_histogram,
    "physical_coverage": physical_coverage,
    "bedcov": region_sums,
    "flank_depth": lambda s, d: region_sums(s, d, 50),
    "low_mapq_fraction": low_mapq_fraction,
    "insert_size_stats": insert_size_stats,
    "insert_orientation": orientation,
    "mate_join": mate_join,
    "pair_gap_sessions": pair_gap_sessions,
    "pair_leader_clusters": pair_leader_clusters,
    "break_point_merge": break_point_merge,
    "rmdup_se": lambda s, d: rd.dedup_single(rd.usable(reads(s, d), mask=772).withColumns({"quality": F.expr("read_id * 31 % 97"), "library": F.expr("template_id % 3")}), "library").select("read_id"),
    "rmdup_pe": lambda s, d: rd.dedup_pairs(
        view(s, d, "fx_mates").select("tid", "f_pos", "isize", "template_id", F.expr("f_id * 31 % 97").alias("quality"), F.expr("template_id % 3").alias("library")), "library"
    ).select("template_id", "copies"),
    "clip_band_join": clip_band_join,
    "call_format": call_format,
    "systematic_sample": systematic_sample,
}

GOOD = "(flag // 4) % 2 = 0 AND (flag // 256) % 2 = 0 AND (flag // 512) % 2 = 0 AND (flag // 1024) % 2 = 0"
EVENTS = f"""WITH ev AS (SELECT tid, pos, 1 AS d FROM fx_read WHERE {GOOD} UNION ALL SELECT tid, pos + l_qseq, -1 FROM fx_read WHERE {GOOD}),
  ch AS (SELECT tid, pos, sum(d) AS d FROM ev GROUP BY tid, pos HAVING sum(d) <> 0),
  runs AS (SELECT tid, pos, CAST(sum(d) OVER (PARTITION BY tid ORDER BY pos) AS BIGINT) AS depth, lead(pos) OVER (PARTITION BY tid ORDER BY pos) AS until FROM ch)
"""


def regions(flank: int) -> str:
    return duck(f"""SELECT region_no, CAST(sum(least(fin - 1 + {flank}, pos + l_qseq - 1) - greatest(beg - {flank}, pos) + 1) AS BIGINT) AS bases, count(*) AS reads
      FROM fx_region g JOIN fx_read r ON g.tid = r.tid AND pos <= fin - 1 + {flank} AND beg - {flank} <= pos + l_qseq - 1 WHERE {GOOD} GROUP BY region_no""")


def has(v: int) -> str:
    return f"(flag // {v}) % 2 = 1"


ORACLES = {
    "flagstat": duck(f"""WITH m AS (SELECT r.*, o.tid AS mtid FROM fx_read r LEFT JOIN fx_read o ON r.template_id = o.template_id AND r.read_id <> o.read_id)
      SELECT {has(512)} AS failed, count(*) AS total, count(*) FILTER ({has(256)}) AS secondary, count(*) FILTER ({has(1024)}) AS duplicates,
      count(*) FILTER (NOT {has(4)}) AS mapped, count(*) FILTER ({has(1)}) AS paired, count(*) FILTER ({has(1)} AND {has(64)}) AS read1, count(*) FILTER ({has(1)} AND {has(128)}) AS read2,
      count(*) FILTER ({has(1)} AND {has(2)}) AS proper, count(*) FILTER ({has(1)} AND NOT {has(4)} AND NOT {has(8)}) AS both_mapped, count(*) FILTER ({has(1)} AND {has(8)} AND NOT {has(4)}) AS singletons,
      count(*) FILTER ({has(1)} AND NOT {has(4)} AND NOT {has(8)} AND mtid IS DISTINCT FROM tid) AS mate_elsewhere,
      count(*) FILTER ({has(1)} AND NOT {has(4)} AND NOT {has(8)} AND mtid IS DISTINCT FROM tid AND mapq >= 5) AS mate_elsewhere_q5 FROM m GROUP BY 1"""),
    "idxstats": duck(f"""SELECT CAST(t.range AS INT) AS tid, count(read_id) FILTER (NOT {has(4)}) AS mapped, count(read_id) FILTER ({has(4)}) AS unmapped
      FROM range(24) t LEFT JOIN fx_read r ON r.tid = t.range GROUP BY 1"""),
    "depth_filter": duck(f"SELECT read_id FROM fx_read WHERE {GOOD} AND mapq >= 10"),
    "view_filter": duck(f"SELECT read_id, flag FROM fx_read WHERE mapq >= 20 AND {has(1)} AND NOT {has(1024)} AND NOT {has(256)}"),
    "depth_runs": duck(EVENTS + "SELECT tid, pos, depth FROM runs"),
    "coverage_histogram": duck(EVENTS + "SELECT CAST(least(depth, 60) AS INT) AS depth, CAST(sum(until - pos) AS BIGINT) AS bases FROM runs WHERE until IS NOT NULL AND depth > 0 GROUP BY 1"),
    "bedcov": regions(0),
    "flank_depth": regions(50),
    "low_mapq_fraction": duck("""SELECT region_no, count(*) AS n, count(*) FILTER (mapq = 0) AS zero, count(*) FILTER (mapq <= 10) AS low
      FROM fx_region g JOIN fx_read r ON g.tid = r.tid AND pos <= fin - 1 AND beg <= pos + l_qseq - 1 GROUP BY region_no"""),
    "insert_size_stats": duck("SELECT count(*) AS n, round(avg(isize), 4) AS mean, round(stddev_pop(isize), 4) AS sd, min(isize) AS least, max(isize) AS most FROM fx_pair"),
    "insert_orientation": duck("SELECT CASE WHEN f1 <= r1 THEN 'inward' WHEN f1 > r2 THEN 'outward' ELSE 'other' END AS kind, count(*) AS n FROM fx_pair GROUP BY 1"),
    "mate_join": duck(f"""SELECT a.read_id, b.tid AS mtid, b.pos AS mpos, CASE WHEN a.tid = b.tid THEN b.pos - a.pos ELSE 0 END AS isize, (b.flag // 16) % 2 = 1 AS mate_reverse
      FROM fx_read a JOIN fx_read b ON a.template_id = b.template_id AND a.read_id <> b.read_id"""),
    "pair_gap_sessions": duck("""WITH p AS (SELECT tid, f2, r1, f2 - lag(f2) OVER (PARTITION BY tid ORDER BY f2) AS gap FROM fx_pair WHERE isize > 0),
      s AS (SELECT tid, f2, r1, CAST(sum(CASE WHEN gap IS NULL OR gap > 20 THEN 1 ELSE 0 END) OVER (PARTITION BY tid ORDER BY f2) AS BIGINT) AS session FROM p)
      SELECT tid, session, count(*) AS n, max(f2) AS f2, min(r1) AS r1 FROM s GROUP BY tid, session"""),
    "break_point_merge": duck("SELECT tid, f2, r1, count(*) AS n, CAST(sum(abs(isize) % 7) AS BIGINT) AS ed FROM fx_pair GROUP BY tid, f2, r1"),
    "rmdup_se": duck(f"""WITH r AS (SELECT read_id, row_number() OVER (PARTITION BY tid, template_id % 3, {has(16)}, CASE WHEN {has(16)} THEN pos + l_qseq ELSE pos END ORDER BY read_id * 31 % 97 DESC, read_id) AS k
      FROM fx_read WHERE NOT {has(4)} AND NOT {has(256)} AND NOT {has(512)}) SELECT read_id FROM r WHERE k = 1"""),
    "rmdup_pe": duck("""WITH p AS (SELECT *, row_number() OVER w AS k, count(*) OVER (PARTITION BY tid, f_pos, isize, template_id % 3) AS n FROM fx_mates
      WINDOW w AS (PARTITION BY tid, f_pos, isize, template_id % 3 ORDER BY f_id * 31 % 97 DESC, template_id)) SELECT template_id, CASE WHEN isize > 0 THEN n ELSE 1 END AS copies FROM p WHERE k = 1 OR isize <= 0"""),
    "physical_coverage": duck("""WITH ev AS (SELECT tid, f2 AS pos, 1 AS d FROM fx_pair WHERE r1 > f2 UNION ALL SELECT tid, r1, -1 FROM fx_pair WHERE r1 > f2), ch AS (SELECT tid, pos, sum(d) AS d FROM ev GROUP BY tid, pos HAVING sum(d) <> 0)
      SELECT tid, pos, CAST(sum(d) OVER (PARTITION BY tid ORDER BY pos) AS BIGINT) AS depth FROM ch"""),
    "clip_band_join": duck(f"""WITH g AS (SELECT * FROM fx_read WHERE {GOOD}) SELECT a.tid, a.read_id, b.read_id AS other FROM g a JOIN g b ON a.tid = b.tid AND abs(a.pos - b.pos) <= 5
      WHERE (a.flag // 16) % 2 = 0 AND (b.flag // 16) % 2 = 1"""),
    "call_format": duck("""SELECT DISTINCT concat_ws(chr(9), 'chr' || (tid + 1), p1 + 1, p2 + 1, type, CASE WHEN type = 'DUP' THEN p1 - p2 ELSE p2 - p1 END) AS line FROM fx_cnv"""),
    "systematic_sample": duck("""SELECT tid, pos, read_id FROM (SELECT tid, pos, read_id, row_number() OVER (PARTITION BY tid ORDER BY pos, read_id) AS k FROM fx_read) WHERE k % 3 = 0"""),
}
