"""Operators over aligned reads (read_id, template_id, tid, pos, l_qseq, mapq, flag)."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Reads that are unmapped, secondary, failed or duplicate.
MASK = 1796
#: Positions of a bin in which running sums are taken apart.
STRIDE = 1 << 14


def bit(flag: Column | str, value: int) -> Column:
    flag = F.col(flag) if isinstance(flag, str) else flag
    return flag.bitwiseAND(F.lit(value)) != 0


def usable(reads: DataFrame, least_mapq: int = 0, mask: int = MASK) -> DataFrame:
    return reads.where(~bit("flag", mask) & (F.col("mapq") >= least_mapq))


def view_filter(reads: DataFrame, least_mapq: int = 0, on: int = 0, off: int = 0, keep: float = 1.0) -> DataFrame:
    """Minimal quality, bits that must and mustn't be set, and a share of the templates, chosen by hash."""
    out = reads.where((F.col("mapq") >= least_mapq) & (F.col("flag").bitwiseAND(F.lit(on)) == on) & ~bit("flag", off))
    return out if keep >= 1 else out.where(F.pmod(F.xxhash64("template_id"), F.lit(10_000)) < int(keep * 10_000))


def running(df: DataFrame, value: str, out: str, stride: int = STRIDE) -> DataFrame:
    """Running sum of `value` over pos within tid; rows of one position all get the sum up to and with it.

    Sums of whole bins come first, then each bin is scanned apart: no window holds more than a bin, but for one over
    the bins' sums.
    """
    binned = df.withColumn("stretch", F.floor(F.col("pos") / stride))
    sums = binned.groupBy("tid", "stretch").agg(F.sum(value).alias("own"))
    before = Window.partitionBy("tid").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("tid", "stretch", F.coalesce(F.sum("own").over(before), F.lit(0)).alias("base"))
    within = Window.partitionBy("tid", "stretch").orderBy("pos").rangeBetween(Window.unboundedPreceding, 0)
    return binned.join(base, ["tid", "stretch"]).withColumn(out, F.col("base") + F.sum(value).over(within)).drop("base", "stretch")


def depth_runs(reads: DataFrame) -> DataFrame:
    """tid, pos, depth: the depth from each position where it changes, from +1 and -1 events; nothing per base."""
    events = reads.select("tid", F.explode(F.array(
        F.struct(F.col("pos").alias("pos"), F.lit(1).alias("d")), F.struct((F.col("pos") + F.col("l_qseq")).alias("pos"), F.lit(-1).alias("d"))
    )).alias("e")).select("tid", "e.pos", "e.d")
    changes = events.groupBy("tid", "pos").agg(F.sum("d").alias("d")).where("d <> 0")
    return running(changes, "d", "depth").select("tid", "pos", "depth")


def flagstat(reads: DataFrame) -> DataFrame:
    """Counters of `reads` (flag, mapq, tid, and mtid, the mate's), apart for reads that failed quality checks."""
    f = lambda v: bit("flag", v)
    mapped, paired = ~f(4), f(1)
    both = paired & mapped & ~f(8)
    away = both & ~F.col("mtid").eqNullSafe(F.col("tid"))
    counts = {
        "total": F.lit(True), "secondary": f(256), "duplicates": f(1024), "mapped": mapped, "paired": paired, "read1": paired & f(64), "read2": paired & f(128),
        "proper": paired & f(2), "both_mapped": both, "singletons": paired & f(8) & mapped, "mate_elsewhere": away, "mate_elsewhere_q5": away & (F.col("mapq") >= 5),
    }
    return reads.groupBy(f(512).alias("failed")).agg(*[F.count_if(c).alias(n) for n, c in counts.items()])


def dedup_single(reads: DataFrame, library: str | None = None) -> DataFrame:
    """Of reads with one tid, strand and 5' end (and `library`) the one with the most `quality`, the first of equals."""
    reverse = bit("flag", 16)
    end = F.when(reverse, F.col("pos") + F.col("l_qseq")).otherwise(F.col("pos"))
    keys = ["tid", "end", "reverse", *([library] if library else [])]
    return reads.withColumns({"end": end, "reverse": reverse}).groupBy(*keys).agg(F.max_by("read_id", F.struct("quality", -F.col("read_id"))).alias("read_id"))


def dedup_pairs(pairs: DataFrame, library: str | None = None) -> DataFrame:
    """Of templates with one tid, position and insert size (and `library`) the one with the most `quality`, the first of equals.

    Only pairs whose first read lies before its mate (isize > 0) can be duplicates; the others all stay.
    """
    keys = ["tid", "f_pos", "isize", *([library] if library else [])]
    best = pairs.where("isize > 0").groupBy(*keys).agg(F.max_by("template_id", F.struct("quality", -F.col("template_id"))).alias("template_id"), F.count("*").alias("copies"))
    rest = pairs.where("isize <= 0").select(*keys, "template_id", F.lit(1).cast("long").alias("copies"))
    return best.unionByName(rest)


def gap_sessions(df: DataFrame, at: str, gap: int) -> DataFrame:
    """session: numbers of groups within tid whose successive `at` lie within `gap`.

    Rows are first put into stretches; only the last row of each stretch matters to the next one, so the windows
    over a whole tid run over stretches.
    """
    cut = df.withColumn("stretch", F.floor(F.col(at) / STRIDE))
    w = Window.partitionBy("tid", "stretch").orderBy(at)
    ends = cut.groupBy("tid", "stretch").agg(F.max(at).alias("last"))
    before = ends.withColumn("earlier", F.lag("last").over(Window.partitionBy("tid").orderBy("stretch"))).drop("last")
    seen = cut.withColumn("previous", F.lag(at).over(w)).join(before, ["tid", "stretch"])
    new = F.when(F.col(at) - F.coalesce("previous", "earlier", F.col(at) - gap - 1) > gap, 1).otherwise(0)
    marked = seen.withColumns({"new": new, "pos": F.col(at)})
    return running(marked, "new", "session").drop("previous", "earlier", "new")


def leader_clusters(pairs: DataFrame, reach: int) -> DataFrame:
    """Clusters of a session's pairs by length: a new one begins `reach` past the first length of the last."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, first, number, out = pdf.sort_values(["isize", "template_id"]), None, -1, []
        for x in pdf["isize"]:
            if first is None or x - first > reach:
                first, number = x, number + 1
            out.append(number)
        got = pdf.assign(cluster=out).groupby("cluster", as_index=False).agg(f2=("f2", "max"), r1=("r1", "min"), size=("f2", "size"))
        return got.assign(tid=pdf["tid"].iloc[0], session=pdf["session"].iloc[0])[["tid", "session", "cluster", "f2", "r1", "size"]]

    return pairs.groupBy("tid", "session").applyInPandas(fold, "tid int, session long, cluster int, f2 int, r1 int, size long")


def ladder(value: Column, steps: list[Column], above: bool) -> Column:
    """Score 0 to len(steps): how many steps in a row the value passes."""
    out = F.lit(0)
    for i, s in enumerate(steps, 1):
        out = F.when((value > s) if above else (value < s), F.lit(i)).otherwise(out)
    return out


def depth_scores(kind: Column, inside: Column, left: Column, right: Column) -> Column:
    """Read-depth score of a call from the mean depth inside and in its flanks; 0 where a flank is under 8."""
    low, high = F.least(left, right), F.greatest(left, right)
    deleted = ladder(inside, [low * 3 / 4, low * 2 / 3, low * 5 / 9, low / 5], False)
    doubled = ladder(inside, [high * 5 / 4, high * 4 / 3, high * 3 / 2, high * 2], True)
    return F.when(low < 8, 0).when(kind == "DEL", deleted).otherwise(doubled)


def pair_scores(kind: Column, abnormal: Column, normal: Column) -> Column:
    """Read-pair score from the abnormal pairs over a call and the normal ones at its ends."""
    expected = F.when(kind == "DEL", F.greatest(F.lit(20), normal)).otherwise(F.greatest(F.lit(20), normal) / 2)
    return F.when(abnormal <= 4, 0).otherwise(ladder(abnormal, [expected / 3, expected / 2, expected * 2 / 3, expected * 3 / 4], True))
