"""Mixing of sources to target numbers of words by entropy balancing.

Every document gets a rate, the number of times that its words are taken on average. Of all rates that give each source
its target and stay at `most` or below, those are wanted that are nearest to 1 by relative entropy: exp(a * size),
held at `most`, with one multiplier a for each source. The multipliers solve the convex dual, one constraint of words
for each source:

1. Documents are counted by source and size (cells); what follows works on cells, not on documents.
2. Newton steps: each is one aggregation of the cells, which gives every source's words and their slope at its present
   multiplier. A step that leaves the interval known to hold the solution becomes a bisection. Sums are of decimals, so
   they don't depend on the order of rows and reruns agree.
3. Rates become copies: the cells of a source pass in descending size, each takes a number of copies next to what it
   and the cells before it are short of, so that little more than half of the smallest document is missing in the
   end, where documents that small and the limit of `most` copies leave room for it.
4. The documents of a cell share its copies by rank of a hash of their id; ranks are those of a part of the cell plus
   the number of documents in the parts before it, so a large cell is never in one task.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.shared import forget, keep

WORD = r"[^\x20\x09-\x0D]+"
MOST = 3
#: Parts of a cell at least, and documents of a part on average if the documents of all cells were in one.
PARTS, PART_ROWS = 256, 20_000
#: A source is done when its words are within this share of its target; steps that find no solution end the run.
CLOSE, STEPS = 1e-9, 200
#: Steps that are taken before the multipliers are written.
AT_ONCE = 4
EXACT = "decimal(38,6)"


def numbered(sources: DataFrame) -> DataFrame:
    """`sources` (one row for each key) with `place`, the number of its key by code point from 0 on, the empty key last.

    The order is made by ranges, and only the number of rows of each range is brought together.
    """
    ordered = keep(sources.orderBy(F.col("key") == "", "key").withColumn("at", F.monotonically_increasing_id()))
    part = F.shiftright("at", 33)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = ordered.groupBy(part.alias("part")).count().select("part", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("start"))
    place = F.col("start") + F.col("at").bitwiseAND((1 << 33) - 1)
    return ordered.withColumn("part", part).join(starts, "part").select(*sources.columns, place.alias("place"))


def targets(sources: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """`sources` (key, words) with its target: weights, repeating in order of key, share the sum of all words.

    No target is over `most` times the source's words; what is over is shared by the weights of those below.
    """
    weight = F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int"))
    rows = keep(numbered(sources).select("key", "words", weight.alias("weight")))
    level, full = 0.0, F.lit(False)
    while True:  # the level only rises, so a source that is full stays so
        left, share = rows.agg(
            F.sum("words") - F.sum(F.when(full, F.col("words") * most).otherwise(0)), F.sum(F.when(~full, F.col("weight")).otherwise(0))
        ).first()
        if not share or left / share == level:
            break
        level = left / share
        full = F.col("words") * most <= F.col("weight") * F.lit(level)
    limit = (F.col("words") * most).cast("double")
    return rows.select("key", "words", F.when(full, limit).otherwise(F.col("weight") * F.lit(level)).alias("target"))


def tilt(cells: DataFrame, goals: DataFrame, most: int = MOST) -> DataFrame:
    """key and `multiplier` of each of `goals` (key, words, target) that needs one: the words of `cells` (key, size,
    docs) at the rates min(most, exp(multiplier * size)) add up to the target.

    None is needed without words, or if all documents are taken `most` times. Sources are balanced apart from each
    other, as none of a document's words count for two of them.
    """
    words = F.col("docs") * F.col("size").cast(EXACT)
    unit = cells.groupBy("key").agg((F.sum(words * F.col("size")) / F.sum(words)).cast("double").alias("unit"))
    share = F.log(F.col("target") / F.col("words"))
    # A document has a word at least, so `low` and `high` are on either side of the solution.
    state = keep(goals.where((F.col("words") > 0) & (F.col("target") < most * F.col("words"))).join(unit, "key").select(
        "key", "target", "unit", share.alias("x"), F.when(share < 0, share * F.col("unit")).otherwise(0.0).alias("low"),
        F.when(share < 0, 0.0).otherwise(F.lit(math.log(most)) * F.col("unit")).alias("high"), F.lit(False).alias("done"),
    ))

    def step(state: DataFrame) -> DataFrame:
        part = F.col("size") / F.col("unit")
        rate = F.least(F.lit(float(most)), F.exp(F.col("x") * part))
        words = F.col("docs") * F.col("size") * rate
        slope = F.when(rate < most, words * part).otherwise(0.0)
        sums = cells.join(state.select("key", "x", "unit"), "key").groupBy("key").agg(
            F.sum(words.cast(EXACT)).cast("double").alias("got"), F.sum(slope.cast(EXACT)).cast("double").alias("slope")
        )
        over = F.col("got") > F.col("target")
        low, high = F.when(over, F.col("low")).otherwise(F.col("x")), F.when(over, F.col("x")).otherwise(F.col("high"))
        newton = F.when(F.col("slope") > 0, F.col("x") - (F.col("got") - F.col("target")) / F.col("slope"))
        done = F.col("done") | (F.abs(F.col("got") - F.col("target")) <= CLOSE * F.col("target") + 1e-6)
        moved = state.join(sums, "key").select("key", "target", "unit", "x", low.alias("low"), high.alias("high"), newton.alias("newton"), done.alias("done"))
        inside = (F.col("newton") > F.col("low")) & (F.col("newton") < F.col("high"))
        x = F.when(F.col("done"), F.col("x")).when(inside, F.col("newton")).otherwise((F.col("low") + F.col("high")) / 2)
        return moved.select("key", "target", "unit", x.alias("x"), "low", "high", (F.col("done") | (x == F.col("x"))).alias("done"))

    for _ in range(0, STEPS, AT_ONCE):
        if state.where(~F.col("done")).isEmpty():
            return state.select("key", (F.col("x") / F.col("unit")).alias("multiplier"))
        now = state
        for _ in range(AT_ONCE):
            now = step(now)
        now = keep(now)
        forget(state)
        state = now
    raise RuntimeError("multipliers did not settle")


def rounded(most: int):
    """The copies of each cell of one source; a source has fewer cells than the root of twice its words.

    A cell takes the number below or above what is wanted so far, whichever the smaller cells can make up for better;
    of both, if they can, the nearer.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("size", ascending=False, ignore_index=True)
        after = lambda c: c[::-1].cumsum()[::-1] - c
        more, room = after(pdf["wanted"]).tolist(), after(most * pdf["docs"] * pdf["size"]).tolist()
        carry, out = 0.0, []
        for size, n, words, m, r in zip(pdf["size"].tolist(), pdf["docs"].tolist(), pdf["wanted"].tolist(), more, room, strict=True):
            carry += words
            some = {min(max(int(carry // size) + up, 0), most * n) for up in (0, 1)}
            off = {c: carry - c * size for c in some}
            missed = {c: round(max(0.0, -o - m, o - (r - m)), 3) for c, o in off.items()}
            copies = min(some, key=lambda c: (missed[c], abs(off[c]), c))
            carry = off[copies]
            out.append(copies)
        return pdf[["key", "size"]].assign(each=np.array(out, np.int64) // pdf["docs"], rest=np.array(out, np.int64) % pdf["docs"])

    return run


def mix(docs: DataFrame, weights: tuple[int, ...] = (1, 2, 3), most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, copies and taken (copies times size) of every row of `docs`.

    A size is the number of words between spaces and the characters 9 to 13; null and empty texts have none and are
    taken 0 times. A null source is one of its own, the last. Repeated rows are mixed each. Documents of one source
    and size are taken equally often but for one copy, which goes by a hash of doc_id, null ids last; rows of one id
    take either number. Further columns, whatever their names, are left out; an empty table gives an empty result.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit(""))  # empty: no source
    rows = keep(docs.select("doc_id", key.alias("key"), size.alias("size")))
    cells = keep(rows.groupBy("key", "size").agg(F.count("*").alias("docs")))
    goals = keep(targets(cells.groupBy("key").agg(F.sum(F.col("docs") * F.col("size")).alias("words")), weights, most))
    worded = cells.where("size > 0")
    rate = F.least(F.lit(float(most)), F.coalesce(F.exp(F.col("multiplier") * F.col("size")), F.lit(float(most))))
    wanted = worded.join(tilt(worded, goals, most), "key", "left").withColumn("wanted", F.col("docs") * F.col("size") * rate)
    copies = wanted.groupBy("key").applyInPandas(rounded(most), "key string, size long, each long, rest long")

    # Parts of cells: with an id by its hash; rows without one come after all others, dealt by where they stand.
    n = max(PARTS, (cells.agg(F.sum("docs")).first()[0] or 0) // PART_ROWS)
    no_id = F.col("doc_id").isNull()
    order = F.when(no_id, F.xxhash64(F.monotonically_increasing_id())).otherwise(F.xxhash64("doc_id"))
    dealt = rows.withColumn("order", order).withColumn("part", F.pmod("order", F.lit(n)) + F.when(no_id, n).otherwise(0))
    before = Window.partitionBy("key", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = dealt.groupBy("key", "size", "part").agg(F.count("*").alias("rows"))
    parts = parts.withColumn("start", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(copies, ["key", "size"], "left")
    parts = parts.join(goals, "key").select(
        "key", "size", "part", "start", F.coalesce("each", F.lit(0)).alias("each"), F.coalesce("rest", F.lit(0)).alias("rest"), "words", "target"
    )
    within = Window.partitionBy("key", "size", "part").orderBy("order", "doc_id")
    ranked = dealt.withColumn("rank", F.row_number().over(within)).drop("order")
    number = (F.col("each") + (F.col("start") + F.col("rank") <= F.col("rest")).cast("int")).cast("long")
    return ranked.join(parts, ["key", "size", "part"]).select(
        "doc_id", "size", F.col("words").alias("source_size"), "target", number.alias("copies"), (number * F.col("size")).alias("taken")
    )


def op11(spark, sf_dir: str) -> DataFrame:
    return mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
