"""Invertible Bloom lookup sketches of documents' paragraphs.

A document's paragraphs (lines, cut into blocks of a few words) are hashed to digests. Each digest falls into one
cell in each of three regions; a cell holds the number of its digests, their exclusive or, and the exclusive or of
their checks. Subtracting the cells of two versions leaves the digests in which they differ. Peeling takes cells
with one digest, subtracts it from the other regions, and goes on until nothing is left. Where a small table can't
be peeled, a larger one that fits the pair is; since nearly all pairs of different texts need that, both are built in
one pass. Pairs whose larger table can't be peeled either are built again, eight times as large, until all are.

A table is a set of rows (group columns, slot, cell, n, x, k), empty cells left out. Rows of one document never
leave the partition that its text was dealt to: the aggregates need no further exchange.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lociq.llm.shared import keep

REGIONS = 3
WORDS = 12
#: Cells of a region in the stored sketch: a power of two.
SMALL = 8
#: Least cells of a region in the larger table, cells for each paragraph of the pair, and times as many for each retry.
LARGE, ROOM, AGAIN = 256, 4, 8
#: Rounds over the regions in which a table must be peeled.
CYCLES = 2
#: Most pairs to try again whose numbers are broadcast; more are joined by a shuffle.
FEW = 100_000
#: Rows of a bucket, the most buckets, and buckets of a task: a task's sketches should fit into its memory.
BUCKET_ROWS, MOST_BUCKETS, TASK_BUCKETS = 250, 1 << 16, 2


def digests(text: Column, words: int = WORDS) -> Column:
    """Distinct 64-bit digests of the paragraphs of a text; none for an empty one."""
    cut = F.regexp_replace(text, r"((?:[^ \n]++ ){%d})" % words, "$1\n")
    return F.array_distinct(
        F.transform(F.filter(F.split(cut, "\n"), lambda p: F.trim(p) != ""), lambda p: F.xxhash64(F.trim(p)))
    )


def check(x: Column) -> Column:
    return F.xxhash64(x, F.lit(97))


def cell(x: Column, region: int, mask: Column) -> Column:
    return F.xxhash64(x, F.lit(region)).bitwiseAND(mask)


def large_mask(n: Column, room: float, least: int) -> Column:
    """Cells of a region less one, for a pair with `n` paragraphs in all."""
    bits = F.ceil(F.log2(F.greatest(F.lit(least), n * room)))
    return F.expr("bigint(1)") * F.pow(F.lit(2), bits).cast("bigint") - 1


def in_buckets(docs: DataFrame) -> tuple[DataFrame, int]:
    """Rows (doc_id, text, key, bucket, copy) for next_texts(), and the number of tasks that the buckets are for.

    Rows go to buckets between quantiles of doc_id; the head of each bucket is also put at the end of the one
    before, so that no window spans buckets. Null ids come last, and null texts are empty.
    """
    key = F.coalesce("doc_id", F.lit(-(2**62)))
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), key.alias("key"))
    ids = docs.select(key.alias("key"))
    n = ids.count()
    k = max(1, min(MOST_BUCKETS, n // BUCKET_ROWS))
    cuts = ids.select(F.percentile_approx("key", [i / k for i in range(1, k)] or [0.5], 20 * k).alias("q")).first()["q"] or []
    cuts = sorted(set(cuts))
    # Two looks instead of one over all cuts: which stretch of cuts, then which cut in it.
    width = max(1, int(len(cuts) ** 0.5))
    stretches = [cuts[i : i + width] for i in range(0, len(cuts), width)] or [[]]
    firsts = F.lit([s[0] for s in stretches[1:]]) if len(stretches) > 1 else F.expr("cast(array() as array<bigint>)")
    table = F.array(*[F.lit(s) if s else F.expr("cast(array() as array<bigint>)") for s in stretches])
    below = lambda a: F.size(F.filter(a, lambda c: c < F.col("key")))
    at = rows.withColumn("stretch", below(firsts))
    at = at.withColumn("bucket", F.col("stretch") * width + below(F.element_at(table, F.col("stretch") + 1))).drop("stretch")
    heads = at.groupBy("bucket").agg(F.max("key").alias("key")).orderBy(F.desc("bucket")).collect()
    if not heads:
        return rows.select("doc_id", "text", "key", F.lit(0).alias("bucket"), F.lit(0).alias("copy")), 1
    # A head closes the bucket above its own; that of the highest bucket closes the lowest.
    closes = docs.sparkSession.createDataFrame(
        [(h["key"], heads[i - 1]["bucket"]) for i, h in enumerate(heads)], "key bigint, closes int"
    )
    copied = at.join(F.broadcast(closes), "key", "left").select(
        "doc_id",
        "text",
        "key",
        F.explode(
            F.when(
                F.col("closes").isNotNull(),
                F.array(F.struct("bucket", F.lit(0).alias("copy")), F.struct(F.col("closes").alias("bucket"), F.lit(1).alias("copy"))),
            ).otherwise(F.array(F.struct("bucket", F.lit(0).alias("copy"))))
        ).alias("place"),
    ).select("doc_id", "text", "key", "place.bucket", "place.copy")
    return copied, max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), len(heads) // TASK_BUCKETS)


def next_texts(copied: DataFrame, tasks: int) -> DataFrame:
    """bucket, doc_id, row, text and the text of the next document in descending order of doc_id (after the last: the first).

    Ties are ordered by the text's hash. `row` tells the rows of a bucket apart.
    """
    copied = copied.repartition(tasks, "bucket")
    w = Window.partitionBy("bucket").orderBy("copy", F.desc("key"), F.xxhash64("text"))
    placed = copied.withColumns({"next": F.lead("text").over(w), "row": F.row_number().over(w)})
    return placed.where("copy = 0").select("bucket", "doc_id", "row", "text", "next")


def put(arrays: dict[str, Column], mask: Column) -> Column:
    """Array of (slot, cell, and n, x, k for each array), one entry for each digest and region."""
    kinds = list(arrays)

    def entry(kind: str, region: int, d: Column) -> Column:
        zero = F.lit(0).cast("bigint")
        cols = [F.lit(region).alias("slot"), cell(d, region, mask).alias("cell")]
        for k in kinds:
            cols += [
                F.lit(int(k == kind)).cast("bigint").alias(f"n_{k}"),
                (d if k == kind else zero).alias(f"x_{k}"),
                (check(d) if k == kind else zero).alias(f"k_{k}"),
            ]
        return F.struct(*cols)

    return F.flatten(F.concat(*[F.transform(a, placed(entry, kind)) for kind, a in arrays.items()]))


def placed(entry, kind: str):
    return lambda d: F.array(*[entry(kind, region, d) for region in range(REGIONS)])


def gathered(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.sum("n").alias("n"), F.bit_xor("x").alias("x"), F.bit_xor("k").alias("k"))


def peel(table: DataFrame, group: list[str], cycles: int = CYCLES, digests: bool = False) -> DataFrame:
    """Takes cells of one digest out of `table` (group, mask, slot, cell, n, x, k), region after region.

    A digest has one cell in each region, so within a region no two cells give the same digest. Digests found are
    counted in slot REGIONS, or, if `digests`, listed there (x, with n = 1 for the first version's and -1 for the other's);
    cells with slots above that pass unchanged. What is left in the regions wasn't peeled.
    """
    keys = [*group, "mask", "slot", "cell"]
    for region in [*range(REGIONS)] * cycles:
        pure = (F.col("slot") == region) & (F.abs("n") == 1) & (check(F.col("x")) == F.col("k"))
        others = [
            F.struct(F.lit(r).alias("slot"), cell(F.col("x"), r, F.col("mask")).alias("cell"), (-F.col("n")).alias("n"), "x", "k")
            for r in range(REGIONS)
            if r != region
        ]
        zero = F.lit(0).cast("bigint")
        one = F.struct(F.lit(REGIONS).alias("slot"), zero.alias("cell"), F.lit(1).cast("bigint").alias("n"), zero.alias("x"), zero.alias("k"))
        if digests:
            one = F.struct(F.lit(REGIONS).alias("slot"), F.col("x").alias("cell"), F.col("n").alias("n"), "x", zero.alias("k"))
        own = F.struct("slot", "cell", "n", "x", "k")
        rows = table.select(*group, "mask", F.explode(F.when(pure, F.array(*others, one)).otherwise(F.array(own))).alias("r"))
        table = gathered(rows.select(*group, "mask", "r.*"), keys).where(
            (F.col("slot") >= REGIONS) | (F.col("n") != 0) | (F.col("x") != 0) | (F.col("k") != 0)
        )
    return table


#: Tables of a document, as small numbers; E and B are the texts that A is compared with.
E_LARGE, B_LARGE, E_SMALL, B_SMALL, OWN_A, OWN_E, SIZE_A, SIZE_E, SIZE_B, NOTE_1, NOTE_2 = range(11)
#: Slots from here on hold cells of single texts, sizes and notes, which peeling passes on.
KEPT = REGIONS + 1
NOTES = 2 * KEPT
IDS = ["bucket", "doc_id", "row"]


def compare(rows: DataFrame, room: float = ROOM, least: int = LARGE) -> DataFrame:
    """Fingerprints and likenesses of the texts a, e and b in each row (bucket, doc_id, row, a, e, b).

    The rows must be dealt by `bucket`. Returns bucket, doc_id, row, chars_a, sha_e, print_a, print_e, like_e, like_b,
    diff_e, diff_b: the length of a, the SHA-256 of e, the sketches of a and e, and for a against e and a against b
    the likeness (of two sets of paragraphs, twice the common ones over the sum of their sizes; 1 for two empty
    ones) and the number of paragraphs that differ. Both are null where neither table could be peeled.
    """
    return summed(peel(tables(rows, room, least), [*IDS, "t"]))


def differing(rows: DataFrame, room: float = ROOM, least: int = LARGE) -> DataFrame:
    """bucket, doc_id, row, other (e or b), digest, side: the paragraph digests in which a differs from e and from b.

    `side` is 1 for paragraphs of a only and -1 for those of the other text only. Rows are as for compare(); pairs
    whose larger table can't be peeled lack digests, and need more `room`.
    """
    done = peel(tables(rows, room, least), [*IDS, "t"], digests=True)
    other = F.when(F.col("t") == E_LARGE, "e").when(F.col("t") == B_LARGE, "b")
    return done.where((F.col("slot") == REGIONS) & other.isNotNull()).select(*IDS, other.alias("other"), F.col("x").alias("digest"), F.col("n").cast("int").alias("side"))


def tables(rows: DataFrame, room: float, least: int) -> DataFrame:
    """The tables (t) of each row's texts, and the entries that carry its sizes and notes."""
    ids = IDS
    zero = F.lit(0).cast("bigint")
    hexes = F.sha2("e", 256)
    words = [F.conv(F.substring(hexes, 1 + 16 * i, 16), 16, -10).cast("bigint") for i in range(4)]
    notes = F.struct(F.length("a").cast("bigint").alias("chars"), *[w.alias(f"w{i}") for i, w in enumerate(words)])
    made = rows.select(*ids, *[digests(F.col(k)).alias(f"d_{k}") for k in "aeb"], notes.alias("notes"))
    total = F.size("d_a") + F.greatest(F.size("d_e"), F.size("d_b"))
    sized = made.withColumn("mask", large_mask(total, room, least))
    # One entry for each document carries sizes and notes along, so that no join has to bring them back.
    marks = F.array(
        *[
            F.struct(
                F.lit(NOTES + i).alias("slot"), zero.alias("cell"),
                *[c.cast("bigint").alias(f"{n}_{k}") for k, cols in zip("aeb", three, strict=True) for n, c in zip("nxk", cols, strict=True)],
            )
            for i, three in enumerate(
                (
                    [(F.size(f"d_{k}"), zero, zero) for k in "aeb"],
                    [[F.col(f"notes.w{i}") for i in range(3)], (F.col("notes.w3"), F.col("notes.chars"), zero), (zero, zero, zero)],
                )
            )
        ]
    )
    keys = ["mask", "slot", "cell"]
    cells = (
        sized.select(*ids, "mask", F.explode(F.concat(put({k: F.col(f"d_{k}") for k in "aeb"}, F.col("mask")), marks)).alias("r"))
        .select(*ids, "mask", "r.*")
        .groupBy(*ids, *keys)
        .agg(*[f(f"{c}_{k}").alias(f"{c}_{k}") for k in "aeb" for c, f in (("n", F.sum), ("x", F.bit_xor), ("k", F.bit_xor))])
    )
    small = F.lit(SMALL - 1).cast("bigint")

    def row(table: int, slot: Column, mask: Column, n: Column, x: Column, k: Column) -> Column:
        return F.struct(
            F.lit(table).alias("t"), mask.alias("mask"), slot.alias("slot"),
            F.col("cell").bitwiseAND(mask).alias("cell"), n.alias("n"), x.alias("x"), k.alias("k"),
        )

    def less(k: str) -> tuple[Column, Column, Column]:
        return F.col("n_a") - F.col(f"n_{k}"), F.col("x_a").bitwiseXOR(F.col(f"x_{k}")), F.col("k_a").bitwiseXOR(F.col(f"k_{k}"))

    def own(k: str) -> tuple[Column, Column, Column]:
        return F.col(f"n_{k}"), F.col(f"x_{k}"), F.col(f"k_{k}")

    slot, past, mask = F.col("slot"), F.col("slot") + KEPT, F.col("mask")
    parts = F.array(
        row(E_LARGE, slot, mask, *less("e")), row(B_LARGE, slot, mask, *less("b")),
        row(E_SMALL, slot, small, *less("e")), row(B_SMALL, slot, small, *less("b")),
        row(OWN_A, past, small, *own("a")), row(OWN_E, past, small, *own("e")),
    )
    full = F.filter(parts, lambda r: (r["n"] != 0) | (r["x"] != 0) | (r["k"] != 0))
    sizes = F.array(*[row(t, slot, mask, *own(k)) for t, k in ((SIZE_A, "a"), (SIZE_E, "e"), (SIZE_B, "b"))])
    noted = F.array(row(NOTE_1, slot, mask, *own("a")), row(NOTE_2, slot, mask, *own("e")))
    out = F.when(slot < REGIONS, full).when(slot == NOTES, sizes).otherwise(noted)
    return gathered(cells.select(*ids, F.explode(out).alias("r")).select(*ids, "r.*"), [*ids, "t", *keys])


def summed(done: DataFrame) -> DataFrame:
    """One row of each document from its peeled tables."""
    ids = IDS

    def given(table: int, value: Column, where: Column | None = None) -> Column:
        here = F.col("t") == table
        return F.coalesce(F.sum(F.when(here if where is None else here & where, value)), F.lit(0)).cast("bigint")

    def found(table: int) -> Column:
        return given(table, F.col("n"), F.col("slot") == REGIONS)

    def stuck(table: int) -> Column:
        return F.max(F.when((F.col("t") == table) & (F.col("slot") < REGIONS), 1).otherwise(0))

    hexed = F.concat_ws(".", F.col("slot") - KEPT, "cell", "n", F.hex("x"), F.hex("k"))
    prints = lambda t: F.array_join(F.array_sort(F.collect_list(F.when(F.col("t") == t, hexed))), " ")
    sums = done.groupBy(*ids).agg(
        prints(OWN_A).alias("cells_a"), prints(OWN_E).alias("cells_e"),
        *[given(t, F.col("n")).alias(f"s_{k}") for t, k in ((SIZE_A, "a"), (SIZE_E, "e"), (SIZE_B, "b"))],
        *[given(NOTE_1, F.col(c)).alias(f"w{i}") for i, c in enumerate("nxk")],
        given(NOTE_2, F.col("n")).alias("w3"), given(NOTE_2, F.col("x")).alias("chars_a"),
        F.when(stuck(E_SMALL) == 0, found(E_SMALL)).when(stuck(E_LARGE) == 0, found(E_LARGE)).alias("diff_e"),
        F.when(stuck(B_SMALL) == 0, found(B_SMALL)).when(stuck(B_LARGE) == 0, found(B_LARGE)).alias("diff_b"),
    )

    def like(k: str) -> Column:
        both = F.col("s_a") + F.col(f"s_{k}")
        share = (both - F.col(f"diff_{k}")) / F.greatest(both, F.lit(1))
        own = F.when(both == 0, 1.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)))
        return F.when(F.col(f"diff_{k}").isNotNull(), own)

    return sums.select(
        *ids, "chars_a",
        F.lower(F.concat(*[F.lpad(F.hex(f"w{i}"), 16, "0") for i in range(4)])).alias("sha_e"),
        F.concat_ws("|", "s_a", "cells_a").alias("print_a"), F.concat_ws("|", "s_e", "cells_e").alias("print_e"),
        like("e").alias("like_e"), like("b").alias("like_b"), "diff_e", "diff_b",
    )


def fingerprint_versions(docs: DataFrame, room: float = ROOM, least: int = LARGE) -> DataFrame:
    """Fingerprints of documents and of texts edited from them, and how alike they are.

    The edited text is the document's with its last half replaced by the start of the next document's (descending
    doc_id). Null texts are empty; an empty table gives an empty result; repeated rows are kept, each with its own
    result; further columns are ignored. Two texts without paragraphs are alike (1).
    """
    copied, tasks = in_buckets(docs)
    done = keep(compare(versions(next_texts(copied, tasks)), room, least))
    solved = F.col("diff_e").isNotNull() & F.col("diff_b").isNotNull()
    parts = [done.where(solved)]
    while n := done.where(~solved).count():
        room, least = room * AGAIN, least * AGAIN
        stuck = done.where(~solved).select("bucket", F.col("row").alias("at"))
        stuck = F.broadcast(stuck) if n <= FEW else stuck
        # Only buckets with such pairs are dealt anew; within a bucket, rows have the same numbers again.
        near = next_texts(copied.join(stuck, "bucket", "left_semi"), tasks)
        again = near.join(stuck, (near["bucket"] == stuck["bucket"]) & (near["row"] == stuck["at"]), "left_semi")
        done = keep(compare(versions(again), room, least))
        parts.append(done.where(solved))
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def versions(rows: DataFrame) -> DataFrame:
    """Rows of next_texts() for compare(): the text, the edited text, and the next one."""
    half = F.floor(F.length("text") / 2).cast("int")
    edited = F.concat(F.col("text").substr(F.lit(1), F.length("text") - half), F.col("next").substr(F.lit(1), half))
    return rows.select("bucket", "doc_id", "row", F.col("text").alias("a"), edited.alias("e"), F.col("next").alias("b"))


def op2(spark, sf_dir: str) -> DataFrame:
    return fingerprint_versions(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", F.col("chars_a").alias("n_chars"), F.col("sha_e").alias("edited_sha256"),
        F.col("print_a").alias("fingerprint"), F.col("print_e").alias("edited_fingerprint"),
        F.col("like_e").alias("near_edited"), F.col("like_b").alias("near_next"),
    )
