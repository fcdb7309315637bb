"""Position by position results of reads that come sorted by position, as streams.

Genome coordinates take the place of time: position p of a chromosome is p seconds after the epoch. A watermark on it
says that a position is complete once reads have come from `late` positions further on; later reads for it are dropped.
Each chromosome is a stream of its own, or comes after the one before with its coordinates moved on. On a table all
positions are given.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.streaming.events import marked


def as_time(pos: Column) -> Column:
    return F.timestamp_seconds(pos)


def as_position(at: Column) -> Column:
    return F.unix_timestamp(at).cast("int")


def depth_counts(reads: DataFrame, late: int) -> DataFrame:
    """tid, pos, depth, reverse: reads (tid, pos, l_qseq, flag) over each position, given out once it is complete.

    `late` must exceed the longest read, whose end comes before the starts of those that follow it.
    """
    cells = reads.select("tid", F.col("flag").bitwiseAND(16).alias("back"), F.explode(F.sequence("pos", F.col("pos") + F.col("l_qseq") - 1)).alias("site"))
    # A window begins at its position and is complete one position later; a read's end runs ahead of the reads to come.
    at = marked(cells.withColumn("at", as_time(F.col("site"))), "at", f"{late} seconds")
    counts = at.groupBy("tid", F.window("at", "1 second").alias("w")).agg(F.count("*").alias("depth"), F.count_if(F.col("back") != 0).alias("reverse"))
    return counts.select("tid", as_position(F.col("w.start")).alias("pos"), "depth", "reverse")


def best_rows(reads: DataFrame, keys: list[str], score: str, late: int) -> DataFrame:
    """keys, pos, read_id: of reads with the same keys and position the one with the highest score, the first of equals.

    The best so far of a position is kept until the position is complete.
    """
    own = marked(reads.withColumn("start", as_time(F.col("pos"))), "start", f"{late} seconds")
    best = own.groupBy(*keys, F.window("start", "1 second").alias("w")).agg(F.max_by("read_id", F.struct(score, -F.col("read_id"))).alias("read_id"))
    return best.select(*keys, as_position(F.col("w.start")).alias("pos"), "read_id")


def crowded(records: DataFrame, width: int, late: int) -> DataFrame:
    """tid, beg, n, gaps: how many records (tid, pos, gap) fall into each stretch of `width` positions, and how many gaps.

    What a filter of near variants has to look at together; stretches are given out once they are complete.
    """
    own = marked(records.withColumn("start", as_time(F.col("pos"))), "start", f"{late} seconds")
    counts = own.groupBy("tid", F.window("start", f"{width} seconds").alias("w")).agg(F.count("*").alias("n"), F.count_if("gap").alias("gaps"))
    return counts.select("tid", as_position(F.col("w.start")).alias("beg"), "n", "gaps")
