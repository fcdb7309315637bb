"""Pileups: what reads show at each position of the reference."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.functions import cigar as cg


def pileup_counts(reads: DataFrame) -> DataFrame:
    """tid, pos, depth, deleted, reverse: reads with a base at each position, with a deletion there, and on the reverse strand.

    Reads (tid, pos, flag, cigar) become blocks of matched or deleted positions, which are exploded and counted before
    the shuffle. Skipped stretches (N) count nowhere.
    """
    parts = F.filter(cg.resolved(cg.operations(F.col("cigar")), F.col("pos")), lambda o: o["op"].isin("M", "=", "X", "D") & (o["size"] > 0))
    blocks = reads.select("tid", F.col("flag").bitwiseAND(F.lit(16)).alias("back"), F.explode(parts).alias("o"))
    cells = blocks.select("tid", "back", (F.col("o.op") == "D").alias("gone"), F.explode(F.sequence("o.ref_from", F.col("o.ref_from") + F.col("o.size") - 1)).alias("pos"))
    return cells.groupBy("tid", "pos").agg(
        F.count_if(~F.col("gone")).alias("depth"), F.count_if("gone").alias("deleted"), F.count_if(F.col("back") != 0).alias("reverse")
    )
