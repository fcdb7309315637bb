"""Reads as FASTQ records, and how far their ends are trimmed by quality."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lociq.functions.sequences import reverse_complement

REVERSE, FIRST, SECOND = 16, 64, 128


def record(name: Column, flag: Column, seq: Column, qual: Column) -> Column:
    """Four lines; reads of the reverse strand are turned back, and one-sided mates are numbered."""
    ends, back = flag.bitwiseAND(FIRST | SECOND), flag.bitwiseAND(REVERSE) != 0
    mate = F.when(ends == FIRST, "/1").when(ends == SECOND, "/2").otherwise("")
    bases, marks = F.when(back, reverse_complement(seq)).otherwise(seq), F.when(back, F.reverse(qual)).otherwise(qual)
    return F.concat_ws("\n", F.concat(F.lit("@"), name, mate), bases, F.lit("+"), marks)


def trimmed(qual: Column, reverse: Column, cutoff: int = 20, least: int = 35) -> Column:
    """Bases to trim from the 3' end: where the running sum of `cutoff` less the quality is highest before it falls below 0.

    The place itself isn't counted, so that one base more is left; fewer than `least` bases are never trimmed.
    """
    # From the 3' end inwards, and only as far as may be trimmed.
    inward = F.substring(F.when(reverse, qual).otherwise(F.reverse(qual)), F.lit(1), F.greatest(F.length(qual) - (least - 1), F.lit(0)))
    costs = F.transform(F.filter(F.split(inward, ""), lambda c: c != ""), lambda c: F.lit(cutoff + 33) - F.ascii(c))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("best"), F.lit(0).alias("at"), F.lit(0).alias("i"), F.lit(True).alias("open"))

    def step(s: Column, cost: Column) -> Column:
        total = s["total"] + cost
        still = s["open"] & (total >= 0)
        up = still & (total > s["best"])
        return F.struct(
            total.alias("total"), F.when(up, total).otherwise(s["best"]).alias("best"), F.when(up, s["i"]).otherwise(s["at"]).alias("at"),
            (s["i"] + 1).alias("i"), still.alias("open"),
        )

    return F.aggregate(costs, start, step, lambda s: s["at"])
