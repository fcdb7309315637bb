"""N-gram Jaccard join by signature trees.

1. Every shingle's document frequency comes back to the documents. Shingles of one document only can't be shared:
   with more of them than a partner may lack, a document has no partner.
2. The others are ordered by rarity; two documents with enough overlap share one of their first shingles. Sharing one,
   with sizes near enough, puts documents into the same cluster, by links to the least of each group.
3. In a cluster, trees over the documents hold OR-combined bitmaps and size ranges in their nodes. Two trees are walked
   together; pairs of nodes that can't reach the overlap are left out; what is below the others is compared exactly,
   every pair. A large cluster is taken in chunks of bounded size, each with each.
4. Equal sets are compared once; a document's links are counted with the copies of each set that is linked with its own.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.shared import components, keep
from lociq.llm.tally import NO_ID, answered, blocks_of, merged, tallied
from lociq.llm.words import LOWER, WordHashes, grams, let_go

SHINGLE = 3
#: Links need 100 * intersection >= PERCENT * union.
PERCENT = 90
CHUNK = 512
BITS = 1024
#: Sets of a side that are compared exactly at once, and how many hashes of them.
TOGETHER = 64
SLICE = 8192
DOCS = "doc_id long, n long, sid long, prefix array<long>, tokens binary"


def shingle_set(text: bytes, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """Sorted distinct shingle hashes; a text of fewer words has its whole sequence as one, one without words none."""
    h = hashes.of(text.translate(LOWER).split())
    return np.unique(grams(h, min(size, len(h)))) if len(h) else np.empty(0, np.uint64)


def linked(a: np.ndarray, b: np.ndarray, percent: int = PERCENT) -> bool:
    if min(len(a), len(b)) * 100 < percent * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= percent * (len(a) + len(b) - both)


def describe(size: int, percent: int):
    """Two functions: a block's shingles, and its documents' rows once their frequencies are known."""

    def sets(texts: list[bytes]) -> list[np.ndarray]:
        hashes = WordHashes()
        return [shingle_set(t, hashes, size) for t in texts]

    def keys_of(ids, texts):
        return merged(sets(texts))

    def rows(ids, texts, totals):
        own = sets(texts)
        keys = merged(own)[0]
        if len(keys) != len(totals):
            raise RuntimeError("a block's frequencies aren't complete")
        out = []
        for doc_id, s in zip(ids.tolist(), own, strict=True):
            n = len(s)
            sid = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if n else 0
            df = totals[np.searchsorted(keys, s)].astype(np.int64)
            most = n - -(-percent * n // 100)  # shingles that a partner may lack
            lone = int((df == 1).sum())
            if not n or lone > most:
                out.append((doc_id, n, sid, None, None))
                continue
            order = np.lexsort((s, df))[lone : most + 1]
            out.append((doc_id, n, sid, s[order].view(np.int64), s.tobytes()))
        return pd.DataFrame(out, columns=["doc_id", "n", "sid", "prefix", "tokens"])

    return keys_of, rows


@dataclass
class Node:
    lo: int
    hi: int
    least: int
    most: int
    bits: int
    fewest: int
    kids: list


def bitmap(s: np.ndarray) -> int:
    bits = np.zeros(BITS, bool)
    bits[(s & np.uint64(BITS - 1)).astype(np.int64)] = True
    return int.from_bytes(np.packbits(bits).tobytes(), "big")


def tree(sets: list[np.ndarray], maps: list[int], fan: int = 4) -> Node:
    """A tree over sets that are ordered by size; `fewest` is the least number of bits of a set below."""
    level = [Node(i, i + 1, len(s), len(s), m, m.bit_count(), []) for i, (s, m) in enumerate(zip(sets, maps, strict=True))]
    while len(level) > 1:
        up = []
        for i in range(0, len(level), fan):
            kids = level[i : i + fan]
            bits = 0
            for k in kids:
                bits |= k.bits
            up.append(Node(kids[0].lo, kids[-1].hi, min(k.least for k in kids), max(k.most for k in kids), bits, min(k.fewest for k in kids), kids))
        level = up
    return level[0]


def overlap_bound(a: Node, b: Node) -> int:
    """Most shingles that a set below `a` can share with one below `b`: bits that the other side lacks can't be shared."""
    shared = (a.bits & b.bits).bit_count()
    return min(a.most - max(0, a.fewest - shared), b.most - max(0, b.fewest - shared))


def tree_links(left: list[np.ndarray], right: list[np.ndarray], same: list[tuple[int, int]], percent: int = PERCENT) -> list[tuple[int, int]]:
    """Links (i, j) of left[i] and right[j] that join all linked sets; `same` has pairs that are one set."""
    if not left or not right:
        return []
    parent = list(range(len(left) + len(right)))

    def find(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    order_l, order_r = (sorted(range(len(s)), key=lambda i: len(s[i])) for s in (left, right))
    sides = [[side[i] for i in order] for side, order in ((left, order_l), (right, order_r))]
    maps = [[bitmap(s) for s in side] for side in sides]
    at_l, at_r = order_l, [len(left) + j for j in order_r]
    for i, j in same:
        parent[find(len(left) + j)] = find(i)
    stack, out = [(tree(sides[0], maps[0]), tree(sides[1], maps[1]))], []
    while stack:
        a, b = stack.pop()
        if overlap_bound(a, b) * (100 + percent) < percent * (a.least + b.least):
            continue
        if len({find(at_l[i]) for i in range(a.lo, a.hi)} | {find(at_r[j]) for j in range(b.lo, b.hi)}) == 1:
            continue
        if a.kids and (not b.kids or a.hi - a.lo >= b.hi - b.lo):
            stack.extend((k, b) for k in a.kids)
        elif b.kids:
            stack.extend((a, k) for k in b.kids)
        elif linked(sides[0][a.lo], sides[1][b.lo], percent):
            i, j = at_l[a.lo], at_r[b.lo]
            parent[find(j)] = find(i)
            out.append((i, j - len(left)))
    return out


def token_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint64) for t in column]


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many hashes each set of `left` shares with each of `right`."""
    out = np.zeros((len(left), len(right)), np.float32)
    sides = [(np.concatenate(s), np.repeat(np.arange(len(s)), [len(x) for x in s])) for s in (left, right)]
    common = np.intersect1d(sides[0][0], sides[1][0])
    if not len(common):
        return out.astype(np.int64)
    at = [np.minimum(np.searchsorted(common, t), len(common) - 1) for t, _ in sides]
    hits = [common[i] == t for i, (t, _) in zip(at, sides, strict=True)]
    at, rows = [i[h] for i, h in zip(at, hits, strict=True)], [r[h] for (_, r), h in zip(sides, hits, strict=True)]
    for lo in range(0, len(common), SLICE):
        held = []
        for i, r, n in zip(at, rows, out.shape, strict=True):
            own = (i >= lo) & (i < lo + SLICE)
            m = np.zeros((n, min(SLICE, len(common) - lo)), np.float32)
            m[r[own], i[own] - lo] = 1
            held.append(m)
        out += held[0] @ held[1].T
    return out.astype(np.int64)


def all_links(left: list[np.ndarray], right: list[np.ndarray], percent: int = PERCENT) -> np.ndarray:
    """Whether left[i] and right[j] are linked, for all pairs; blocks of them that can't be are left out by trees."""
    found = np.zeros((len(left), len(right)), bool)
    if not left or not right:
        return found
    orders = [np.array(sorted(range(len(s)), key=lambda i: len(s[i]))) for s in (left, right)]
    sides = [[s[i] for i in o] for s, o in zip((left, right), orders, strict=True)]
    sizes = [np.array([len(x) for x in s]) for s in sides]
    stack = [tuple(tree(s, [bitmap(x) for x in s]) for s in sides)]
    while stack:
        a, b = stack.pop()
        if overlap_bound(a, b) * (100 + percent) < percent * (a.least + b.least):
            continue
        if max(a.hi - a.lo, b.hi - b.lo) > TOGETHER:
            stack.extend(((k, b) for k in a.kids) if a.hi - a.lo >= b.hi - b.lo else ((a, k) for k in b.kids))
            continue
        both = shared_counts(sides[0][a.lo : a.hi], sides[1][b.lo : b.hi])
        every = sizes[0][a.lo : a.hi, None] + sizes[1][None, b.lo : b.hi] - both
        found[np.ix_(orders[0][a.lo : a.hi], orders[1][b.lo : b.hi])] = 100 * both >= percent * every
    return found


def leaders_of(links: np.ndarray) -> np.ndarray:
    """The first place that links reach from each place of a symmetric matrix."""
    out = np.full(len(links), -1)
    for i in range(len(links)):
        new = np.array([i]) if out[i] < 0 else np.empty(0, np.int64)
        while len(new):
            out[new] = i
            new = np.flatnonzero(links[new].any(axis=0) & (out < 0))
    return out


def token_sets(column) -> list[np.ndarray]:
    return [np.frombuffer(t, np.uint64) for t in column]


def count_chunk(percent: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        left, right = pdf[~pdf["right"]], pdf[pdf["right"]]
        # A part meets itself, or two parts that share no set meet.
        itself = pdf["m"].iloc[0] == pdf["q"].iloc[0]
        links = all_links(token_sets(left["tokens"]), token_sets((left if itself else right)["tokens"]), percent)
        if itself:
            np.fill_diagonal(links, False)
        else:
            none = [np.zeros((n, n), bool) for n in links.shape]
            links = np.block([[none[0], links], [links.T, none[1]]])
        sids = pd.concat([left, right])["sid"].to_numpy()
        copies = pd.concat([left, right])["copies"].to_numpy()
        some = links.any(axis=1)
        let_go()
        return pd.DataFrame({"a": sids, "b": sids[leaders_of(links)], "n": (links * copies).sum(axis=1)}, dtype="int64")[some]

    return run


def links_between(members: DataFrame, percent: int, chunk: int) -> DataFrame:
    """a, b, n: `members` (cluster, sid, copies, tokens) that are linked, one that links reach, and the copies of the linked.

    Every pair of a cluster meets in one cell of a grid of parts. A cell counts its links and gives a row for each
    member, not for each link; a member's counts are to be added up. Rows (a, b) join all that is linked.
    """
    large = members.groupBy("cluster").agg(F.count("*").alias("size")).where(F.col("size") > chunk)
    parts = large.select("cluster", F.ceil(F.col("size") / chunk).cast("int").alias("parts"))
    dealt = members.join(parts, "cluster", "left").withColumn("parts", F.coalesce("parts", F.lit(1)))
    met = dealt.withColumn("own", F.pmod(F.xxhash64("sid"), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cells = met.select(
        "cluster", F.least("own", "other").alias("m"), F.greatest("own", "other").alias("q"), (F.col("other") < F.col("own")).alias("right"), "sid", "copies", "tokens"
    )
    # Rows that a join has dealt by cluster would stay together; the cells of a large cluster go to tasks of their own.
    cells = cells.repartition("cluster", "m", "q")
    return cells.groupBy("cluster", "m", "q").applyInPandas(count_chunk(percent), "a long, b long, n long")


def jaccard_components(docs: DataFrame, size: int = SHINGLE, percent: int = PERCENT, chunk: int = CHUNK) -> DataFrame:
    """doc_id, n_shingles, component_id and n_links of every row of `docs`: the smallest doc_id that links reach, and the other rows linked with it.

    Null and empty texts have no shingles and are linked with nothing, so they are their own component; equal
    texts are linked; repeated rows of one doc_id each get a row; null ids stay null and form components as the
    smallest id of all; further columns are ignored; an empty table gives an empty result.
    """
    keys_of, rows = describe(size, percent)
    blocks = blocks_of(docs)
    told = keep(answered(blocks, tallied(docs, keys_of), rows, DOCS))
    sets = told.where("prefix is not null").groupBy("sid").agg(
        F.min("doc_id").alias("doc_id"), F.count("*").alias("copies")
    )
    # Groups by a first shingle and a size band; a set is also in the next band, so sizes near enough meet in one.
    band = F.floor(F.log("n") / -np.log(percent / 100)).cast("int")
    grouped = (
        told.where("prefix is not null")
        .select("sid", "n", F.explode("prefix").alias("token"))
        .distinct()
        .select("sid", F.explode(F.array(F.xxhash64("token", band), F.xxhash64("token", band + 1))).alias("key"))
    )
    leaders = grouped.groupBy("key").agg(F.min("sid").alias("leader"), F.count("*").alias("has")).where("has > 1")
    edges = grouped.join(leaders, "key").where("sid <> leader").select(F.col("sid").alias("a"), F.col("leader").alias("b")).distinct()
    clusters = keep(components(edges).select(F.col("node").alias("sid"), F.col("component").alias("cluster")))
    chosen = sets.join(clusters, "sid")
    members = keep(
        chosen.select("sid", "doc_id", "cluster", "copies").join(told.select("doc_id", "sid", "tokens").where("tokens is not null"), ["doc_id", "sid"])
        .groupBy("sid", "cluster").agg(F.first("copies").alias("copies"), F.first("tokens").alias("tokens"))
    )
    found = keep(links_between(members, percent, chunk))
    near = components(found.select("a", "b")).withColumnsRenamed({"node": "sid", "component": "group"})
    others = found.groupBy(F.col("a").alias("sid")).agg(F.sum("n").alias("others"))
    # A text whose shingles stand nowhere else has no copy either.
    own = sets.select("sid", "copies").join(others, "sid", "left").join(near, "sid", "left")
    with_words = told.where("n > 0").select("doc_id", "n", "sid").join(own, "sid", "left").select(
        "doc_id", "n", F.coalesce("group", "sid").alias("group"), (F.coalesce("copies", F.lit(1)) - 1 + F.coalesce("others", F.lit(0))).alias("n_links")
    )
    least = with_words.groupBy("group").agg(F.min("doc_id").alias("component_id"))
    linked_rows = with_words.join(least, "group").select("doc_id", "n", "component_id", "n_links")
    alone = told.where("n = 0").select("doc_id", "n", F.col("doc_id").alias("component_id"), F.lit(0).cast("long").alias("n_links"))
    out = linked_rows.unionByName(alone)
    real = lambda c: F.when(F.col(c) != NO_ID, F.col(c)).alias(c)
    return out.select(real("doc_id"), F.col("n").alias("n_shingles"), real("component_id"), "n_links")


def op9(spark, sf_dir: str) -> DataFrame:
    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"))


ORACLE = r"""
WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: concat_ws(' ', w[i], w[i + 1], w[i + 2])) END) AS g FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS both_ FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * both_ >= 90 * (x.n + y.n - both_)),
reached AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reached r JOIN links l ON r.b = l.a),
least_ AS (SELECT a, min(b) AS b FROM reached GROUP BY a), counts AS (SELECT a, count(*) AS n_links FROM links GROUP BY a)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) AS component_id, coalesce(n_links, 0) AS n_links
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least_ l ON l.a = d.doc_id LEFT JOIN counts c ON c.a = d.doc_id
"""
