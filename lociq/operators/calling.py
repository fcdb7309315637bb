"""From reads and pairs to scored calls: pair filters and ends, evidence at break points, scores, and the final choice.

A candidate call has tid, f2 and r1: the last base before its first break point and the first one after its second.
A deletion has f2 < r1, a duplication f2 > r1.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.operators import intervals as iv
from lociq.operators.reads import MASK, bit, gap_sessions, ladder

PROPER, REVERSE, MATE_REVERSE = 2, 16, 32


def counts_for_pairs(reads: DataFrame, least_mapq: int = 0) -> DataFrame:
    """Usable reads whose mate is on the same chromosome and on the other strand (reads with mtid)."""
    return reads.where(~bit("flag", MASK) & (F.col("mapq") >= least_mapq) & (F.col("mtid") == F.col("tid")) & (bit("flag", REVERSE) != bit("flag", MATE_REVERSE)))


def proper_pairs(reads: DataFrame, least_mapq: int = 0) -> DataFrame:
    """Reads for insert-size statistics: proper, usable, on a chromosome, opposite strands; mates of tid 0 or none also count."""
    same = (F.col("mtid") == F.col("tid")) | (F.col("mtid") <= 0)
    return reads.where(same & (F.col("tid") >= 0) & bit("flag", PROPER) & ~bit("flag", MASK) & (F.col("mapq") >= least_mapq) & (bit("flag", REVERSE) != bit("flag", MATE_REVERSE)))


def pair_ends(reads: DataFrame) -> DataFrame:
    """Inner ends f2 and r1, outer ends f1 and r2, and the signed insert size of each pair, as one of its reads shows them.

    `reads` has pos, l_qseq, fin (end of the alignment), mpos, tlen, flag. The end of a mate isn't known: a reverse read takes
    its own length for the mate's.
    """
    back = bit("flag", REVERSE)
    return reads.select(
        "read_id", F.when(back, F.col("mpos") + F.col("l_qseq") - 1).otherwise(F.col("fin")).alias("f2"), F.when(back, F.col("pos")).otherwise(F.col("mpos")).alias("r1"),
        F.when(back, F.col("mpos")).otherwise(F.col("pos")).alias("f1"),
        F.when(back, F.col("fin")).otherwise(F.col("pos") + F.col("tlen") - F.when(F.col("tlen") > 0, 1).otherwise(-1)).alias("r2"),
        F.when(back, -F.col("tlen")).otherwise(F.col("tlen")).alias("isize"),
    )


def abnormal_pairs(reads: DataFrame, least: int) -> DataFrame:
    """Inner ends of pairs whose insert is `least` or more either way, both ends past the first position."""
    far = counts_for_pairs(reads).where(F.abs("tlen") >= least)
    return pair_ends(far).where("f2 > 0 and r1 > 0").join(far.select("read_id", "tid"), "read_id")


def order_statistics(rows: DataFrame, keys: list[str], value: str, ranks: dict[str, Column]) -> DataFrame:
    """For each group the values at 0-based ranks, given as expressions over n; exact, from counts of distinct values."""
    counts = rows.groupBy(*keys, value).agg(F.count("*").alias("here"))
    w = Window.partitionBy(*keys)
    upto = counts.withColumns({"upto": F.sum("here").over(w.orderBy(value)), "n": F.sum("here").over(w)})
    at = lambda r: F.min(F.when(F.col("upto") > r, F.col(value)))
    return upto.groupBy(*keys).agg(F.max("n").alias("n"), *[at(r).alias(k) for k, r in ranks.items()])


def insert_sample(proper: DataFrame, ranked: Column | None = None) -> DataFrame:
    """n, insert and sd of each chromosome's sampled pairs (tid, isize): the upper median, and the quartiles' distance over 1.35.

    Where that looks wrong (a median over 1000, or an sd over twice as large), the sd is half the insert size.
    """
    size = F.abs("isize").cast("int")
    quarter = F.floor(F.col("n") / 4)
    got = order_statistics(proper.select("tid", size.alias("isize")), ["tid"], "isize", {"q1": quarter, "q2": F.floor(F.col("n") / 2), "q3": quarter * 3})
    sd = ((F.col("q3") - F.col("q1")) / 1.35).cast("int")
    odd = (F.col("q2") > 1000) | ((F.col("q3") - F.col("q1")) / 1.35 > 2 * F.col("q2"))
    return got.where("n > 2").select("tid", "n", F.col("q2").alias("insert"), F.when(odd, F.floor(F.col("q2") / 2)).otherwise(sd).cast("int").alias("sd"))


def insert_full(proper: DataFrame, sample: DataFrame) -> DataFrame:
    """n, insert and sd over all pairs strictly within ten sd of the sample's insert; whole numbers, and 50 for an sd under 30."""
    size = F.abs("isize").cast("double")
    near = proper.join(sample.select("tid", "insert", "sd"), "tid").where((size > F.col("insert") - 10 * F.col("sd")) & (size < F.col("insert") + 10 * F.col("sd")))
    got = near.groupBy("tid").agg(F.count("*").alias("n"), F.sum(size).alias("s"), F.sum(size * size).alias("ss")).where("n > 2")
    mean = F.col("s") / F.col("n")
    sd = F.sqrt(F.greatest(F.lit(0.0), (F.col("ss") - mean * mean * F.col("n")) / F.col("n")))
    return got.select("tid", "n", mean.cast("int").alias("insert"), F.when(sd < 30, 50).otherwise(sd.cast("int")).alias("sd"))


def pair_evidence(calls: DataFrame, mates: DataFrame, insert: int, sd: int, longest: int = iv.LONGEST) -> DataFrame:
    """`calls` (tid, f2, r1) with f2_rp, r1_rp and frrp: normal pairs across each end, and pairs that the call explains.

    `mates` has both reads of a pair (f_pos, f_len, r_pos, r_len, isize), each fit for counting (f_ok, r_ok). Forward reads are looked at up
    to insert + 5 sd before a break point, reverse ones as far after it. A pair that crosses the break point and the
    call counts for the nearer of its insert sizes with and without the call. Few normal pairs are counted again,
    from any that cross the point with a normal insert size.
    """
    keys, dx, step = calls.columns, insert + 5 * sd, 14 * sd
    size = F.col("r2") - F.col("f1")
    fwd = mates.where("f_ok").select(
        "tid", F.lit(0).alias("strand"), F.col("f_pos").alias("q1"), (F.col("f_pos") + F.col("f_len") - 1).alias("q2"), F.col("f_pos").alias("f1"),
        (F.col("f_pos") + F.col("isize") - F.when(F.col("isize") > 0, 1).otherwise(-1)).alias("r2"), "isize", F.col("f_pos").alias("own"),
    )
    rev = mates.where("r_ok").select(
        "tid", F.lit(1).alias("strand"), F.col("r_pos").alias("q1"), (F.col("r_pos") + F.col("r_len") - 1).alias("q2"), F.col("f_pos").alias("f1"),
        (F.col("r_pos") + F.col("r_len")).alias("r2"), "isize", F.col("r_pos").alias("own"),
    )
    reads = fwd.unionByName(rev)
    near = lambda at, after: [
        (F.col(at) if after else F.greatest(F.lit(1), F.col(at) - dx)).alias("p1"), (F.col(at) + dx - 1 if after else F.col(at) - 1).alias("p2"), F.col(at).alias("at"),
    ]
    point = (F.col("f1") < F.col("at")) & (F.col("r2") > F.col("at"))

    # Usual pairs depend on one end only: each end is looked at once, with reads of usual pairs.
    sides = (("l1", 0, "f2", False), ("l2", 1, "f2", True), ("r1_", 0, "r1", False), ("r2_", 1, "r1", True))
    spots = [calls.select(F.struct("tid", F.lit(strand).alias("strand")).alias("tid"), F.lit(role).alias("role"), *near(at, after)).distinct() for role, strand, at, after in sides]
    spots = spots[0].unionByName(spots[1]).unionByName(spots[2]).unionByName(spots[3]).where("p1 <= p2")
    usual_reads = reads.where(F.abs("isize").between(insert - 5 * sd, insert + 5 * sd)).withColumn("tid", F.struct("tid", "strand")).drop("strand")
    usual = iv.overlap_join(spots, usual_reads, longest=longest).where(point & (F.col("role").isin("l1", "r1_") | (F.col("own") <= F.col("at"))))
    ends = [
        usual.where(F.col("role").isin(*roles)).groupBy(F.col("tid.tid").alias("tid"), F.col("at").alias(at)).agg(*[F.count_if(F.col("role") == r).alias(r) for r in roles])
        for at, roles in (("f2", ("l1", "l2")), ("r1", ("r1_", "r2_")))
    ]

    # Normal pairs and those that a call explains have sizes of some steps only, so that others don't meet the call.
    call = F.struct(*keys)
    steps_of = lambda middle, reach: F.sequence(F.floor((middle - reach) / step), F.floor((middle + reach) / step))
    steps = F.explode(F.array_union(steps_of(F.lit(insert), 5 * sd), steps_of(F.col("r1") - F.col("f2") + insert, 7 * sd))).alias("step")
    sided = [calls.select(call.alias("call"), F.lit(role).alias("role"), "tid", F.lit(strand).alias("strand"), *near(at, after), steps) for role, strand, at, after in (sides[0], sides[3])]
    group = F.struct("tid", "strand", "step")
    windows = sided[0].unionByName(sided[1]).where("p1 <= p2").withColumn("tid", group).drop("strand", "step")
    sized = reads.withColumn("step", F.floor(size / step)).withColumn("tid", group).drop("strand", "step", "isize", "own")
    f2, r1 = F.col("call.f2"), F.col("call.r1")
    bridged = f2 - F.col("f1") + F.col("r2") - r1
    call_crossed = (F.col("f1") <= f2) & (F.col("r2") >= r1)
    normal, abnormal = F.abs(size - insert) < 5 * sd, F.abs(bridged - insert) < 7 * sd
    nearer = F.abs(size - insert) < F.abs(bridged - insert)
    as_normal = point & normal & (~call_crossed | nearer)
    as_call = call_crossed & abnormal & F.when(point, ~nearer).otherwise(F.abs(bridged - insert) < F.abs(size - insert))
    met = iv.overlap_join(windows, sized, longest=longest).select("call", (F.col("role") == "l1").alias("left"), as_normal.alias("normal"), as_call.alias("explained")).where("normal or explained")
    of = lambda left, what: F.count_if((F.col("left") if left else ~F.col("left")) & F.col(what))
    sums = met.groupBy("call").agg(of(True, "normal").alias("ln"), of(True, "explained").alias("lc"), of(False, "normal").alias("rn"), of(False, "explained").alias("rc")).select("call.*", "ln", "lc", "rn", "rc")
    counts = ("ln", "lc", "rn", "rc", "l1", "l2", "r1_", "r2_")
    seen = calls.join(sums, keys, "left").join(ends[0], ["tid", "f2"], "left").join(ends[1], ["tid", "r1"], "left").na.fill(0, counts)
    again = lambda n, first, second: F.when(F.col(n) >= 10, F.col(n)).when(F.col(first) >= 10, F.col(first)).otherwise(F.greatest(first, second))
    return seen.select(*keys, again("ln", "l1", "l2").alias("f2_rp"), again("rn", "r1_", "r2_").alias("r1_rp"), F.greatest("lc", "rc").alias("frrp"))


def pair_groups(pairs: DataFrame, insert: int, sd: int, read_length: int, least: int = 6) -> DataFrame:
    """Groups (tid, session) of abnormal pairs (tid, f2, r1) whose f2 follow each other closely; groups of fewer than `least` go.

    The last group of a chromosome needs half as many.
    """
    grouped = gap_sessions(pairs, "f2", insert + 5 * sd - read_length // 2)
    sizes = grouped.groupBy("tid", "session").agg(F.count("*").alias("size"))
    last = sizes.groupBy("tid").agg(F.max("session").alias("last"))
    kept = sizes.join(last, "tid").where(F.col("size") >= F.when(F.col("session") == F.col("last"), least // 2).otherwise(least)).drop("last")
    return grouped.join(kept, ["tid", "session"])


def compact(rows: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """The one or two break points (f2, r1, count, mean error) that stand for a group of them (f2, r1, count, summed error), in order.

    Those that moved alike on both sides by up to ten bases are one, and those within four bases on both sides; the most
    frequent of them stands for all. A second one stays unless the first has more than twice its count.
    """
    found = [[f2, r1, n, e // n] for f2, r1, n, e in rows if f2 + 1 != r1]
    shifted = lambda a, b: a[0] - b[0] == a[1] - b[1] and abs(a[0] - b[0]) < min(11, abs(a[0] - a[1]))
    close = lambda a, b: abs(a[0] - b[0]) < 5 and abs(a[1] - b[1]) < 5
    for alike in (shifted, close):
        for i, a in enumerate(found):
            same = [b for b in found[i + 1 :] if b[2] and alike(a, b)] if a[2] else []
            if same:
                # The first of equals, but that the opening one stands before the later ones.
                chosen = max([a, *same], key=lambda b: b[2])
                n, e = sum(b[2] for b in (a, *same)), sum(b[2] * b[3] for b in (a, *same))
                for b in (a, *same):
                    b[2] = 0
                chosen[2], chosen[3] = n, int(e / n + 0.5)
    best = sorted((b for b in found if b[2]), key=lambda b: (-b[2], b[3], b[0], b[1]))[:2]
    return [tuple(b) for b in (best if len(best) < 2 or best[0][2] <= 2 * best[1][2] else best[:1])]


def break_points(matches: DataFrame, read_length: int) -> DataFrame:
    """tid, f2, r1, count, ed: break points of matched clipped reads (tid, f2, r1, ed), compacted group by group.

    Equal ones are counted first. Groups are told apart by gaps in f2 of more than a fifth of the read length.
    """
    equal = matches.where("f2 > 0 and r1 > 0").groupBy("tid", "f2", "r1").agg(F.count("*").alias("count"), F.sum("ed").alias("ed"))
    grouped = gap_sessions(equal, "f2", max(5, read_length // 5))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        rows = pdf.sort_values(["f2", "r1"])[["f2", "r1", "count", "ed"]].astype(int).itertuples(index=False, name=None)
        return pd.DataFrame(compact(list(rows)), columns=["f2", "r1", "count", "ed"]).assign(tid=pdf["tid"].iloc[0])[["tid", "f2", "r1", "count", "ed"]]

    return grouped.groupBy("tid", "session").applyInPandas(run, "tid int, f2 int, r1 int, count long, ed long")


def whole(share: Column) -> Column:
    """Towards zero, as whole-number division of numbers from 0 on."""
    return F.floor(share)


def assessed(calls: DataFrame, read_length: int) -> DataFrame:
    """Adds rpscore, rdscore, ddscore and srscore (-1 where their evidence is -1, not gathered) to calls with all evidence.

    Evidence: f2_rp, r1_rp, frrp (pairs); f2_rd, r1_rd, rd (depths); f2_out, f2_in, r1_in, r1_out (depths near the ends);
    f2_sr, r1_sr (clipped reads), f2_depth, r1_depth (depth at the ends), ms_ed (mismatches).
    """
    c = F.col
    deleted = c("f2") < c("r1")
    normal = F.greatest(F.lit(20), c("f2_rp"), c("r1_rp"))
    expected = F.when(c("f2") > c("r1"), whole(normal / 2)).otherwise(normal)
    rp = ladder(c("frrp"), [whole(expected / 3), whole(expected / 2), whole(expected * 2 / 3), whole(expected * 3 / 4)], True)
    rp = F.when((c("frrp") <= 4) | (F.greatest("f2_rp", "r1_rp", "frrp") < 6), 0).otherwise(rp)
    low, high = F.least("f2_rd", "r1_rd"), F.greatest("f2_rd", "r1_rd")
    down = ladder(c("rd"), [whole(low * 3 / 4), whole(low * 2 / 3), whole(low * 5 / 9), whole(low / 5)], False)
    up = ladder(c("rd"), [whole(high * 5 / 4), whole(high * 4 / 3), whole(high * 3 / 2), high * 2], True)
    rd = F.when((low < 8) | (c("rd") < 0) | (F.greatest("f2_rd", "r1_rd", "rd") < 6), 0).otherwise(F.when(deleted, down).otherwise(up))

    def both(steps: list[tuple[int, int]], above: bool) -> Column:
        out = F.lit(0)
        for i, (a, b) in enumerate(steps, 1):
            parts = [(c(f"{e}_in"), whole(c(f"{e}_out") * a / b)) for e in ("f2", "r1")]
            ok = [x > y if above else x < y for x, y in parts]
            out = F.when(ok[0] & ok[1], i).otherwise(out)
        return out

    dd = F.when(deleted, both([(3, 4), (2, 3), (4, 7), (1, 2)], False)).otherwise(both([(5, 4), (4, 3), (3, 2), (9, 5)], True))
    dd = F.when(F.least("f2_out", "r1_out") < 8, 0).otherwise(dd)
    over = lambda k: [c(f"{e}_sr") * k > c(f"{e}_depth") for e in ("f2", "r1")]
    (a3, b3), (a4, b4), (a8, b8) = over(3), over(4), over(8)
    sr = F.when(a3 & b3, 4).when((a3 | b3) & a4 & b4, 3).when((a4 | b4) & a8 & b8, 2).when(a8 | b8, 1).otherwise(0)
    sr = F.when((c("f2_rd") <= 0) | (c("r1_rd") <= 0) | (c("ms_ed") > read_length // 2), 0).otherwise(sr)
    few = [c(f"{e}_sr") <= 2 for e in ("f2", "r1")]
    sr = F.when(few[0] & few[1], 0).when(few[0] | few[1], F.least(sr, F.lit(1))).otherwise(sr)
    given = lambda score, by: F.when(c(by) >= 0, score).otherwise(-1)
    return calls.withColumns({
        "rpscore": given(rp, "f2_rp"), "rdscore": given(F.when(dd == 0, 0).otherwise(rd), "f2_rd"), "ddscore": given(dd, "f2_out"), "srscore": given(sr, "f2_sr"),
    })


#: Evidence of a call that one source gathers together, and the score that the sources are compared by.
BLOCKS = (
    (("un", "sr_count"), "sr_count", True), (("f2_rd", "r1_rd", "rd", "rdscore"), "rdscore", False),
    (("f2_rp", "r1_rp", "frrp", "rpscore"), "rpscore", False), (("f2_sr", "r1_sr", "ms_ed", "srscore"), "srscore", False),
)
#: The same with all that a call's line tells.
FULL_BLOCKS = (
    (("un", "sr_count", "sr_ed"), "sr_count", True), (("f2_rd", "r1_rd", "rd", "rdscore", "f2_out", "f2_in", "r1_in", "r1_out", "ddscore"), "rdscore", False), *BLOCKS[2:],
)


def without_duplicates(calls: DataFrame, blocks: tuple = BLOCKS) -> DataFrame:
    """One call for each (tid, f2, r1) of several sources (source): of each block of evidence the one with the better score.

    Sources are compared one after the other. Equal scores leave a block to the source that won the block before; equal
    counts of split reads to the later source.
    """
    fields = [f for block, _, _ in blocks for f in block]
    rows = calls.groupBy("tid", "f2", "r1").agg(F.array_sort(F.collect_list(F.struct("source", *fields))).alias("rows"))

    def merged(a: Column, b: Column) -> Column:
        first, cols = F.lit(False), [b["source"].alias("source")]
        for block, score, strict in blocks:
            ahead = a[score] > b[score]
            first = ahead if strict else F.when(a[score] != b[score], ahead).otherwise(first)
            cols += [F.when(first, a[f]).otherwise(b[f]).alias(f) for f in block]
        return F.struct(*cols)

    best = F.aggregate(F.slice("rows", F.lit(2), F.size("rows")), F.element_at("rows", 1), merged)
    return rows.select("tid", "f2", "r1", best.alias("best")).select("tid", "f2", "r1", "best.*").drop("source")


def strength(calls: DataFrame, read_length: int, insert_sd: int, least_overlap: int, least_clip: int) -> DataFrame:
    """Adds strength: strong, weak or none (to be discarded), from a call's scores, micro-homology (un) and evidence."""
    c = F.col
    rd, rp, sr, un, n = c("rdscore"), c("rpscore"), c("srscore"), c("un"), c("sr_count")
    span = F.abs(c("f2") - c("r1"))
    low, high = F.least("f2_rd", "r1_rd"), F.greatest("f2_rd", "r1_rd")
    none = (rd <= 0) & (rp <= 0) & (sr <= 0)
    unclear = un >= 1.5 * least_overlap
    middle = whole((c("f2_rd") + c("r1_rd")) / 2)
    enough = F.greatest(F.lit(20.0), middle * 0.25 * (1 - least_overlap / read_length) * (1 - 2 * least_clip / read_length))
    positive = sum(F.greatest(F.lit(0), x) for x in (rp, rd, sr))
    strong = (
        (positive >= 2) | (~unclear & (span < read_length) & (rd >= 2)) | (~unclear & (sr > 2) & ((rp < 0) | (span < 5 * insert_sd))) | (~unclear & (n >= enough))
    )
    bare = (rp <= 0) & (sr <= 0)
    uneven = (c("f2_rd") * 4 < c("r1_rd")) | (c("r1_rd") * 4 < c("f2_rd")) | ((c("f2") > c("r1")) & (c("rd") < high)) | ((c("f2") < c("r1")) & (c("rd") > low))
    demoted = (
        (low < 10) | ((span > 7 * insert_sd) & (rp == 0) & (sr <= 1)) | ((un * 2 > read_length) & (rd <= 0) & (rp <= 0)) | (bare & uneven)
        | (bare & (c("rd") > 50) & (span > 7 * insert_sd) & (rd <= 1))
    )
    gone = (none & (n <= 3)) | (none & (un >= least_overlap) & (un >= span))
    kind = F.when(gone, "none").when(strong, F.when(demoted, "weak").otherwise("strong")).when((n < 3) & (span <= un), "none").otherwise("weak")
    return calls.withColumn("strength", kind)
