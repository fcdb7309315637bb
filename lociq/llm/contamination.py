"""Benchmark contamination: a prefix-filtered join of item windows with documents' shingles.

An item's window is a set of shingles (runs of a few words) with fixed places. Shingles are ordered by rarity in the
corpus. A document that contains a window contains all its shingles, so the window's first shingle in that order is
the only prefix that must be joined. A joined place gives the window's place in the document; windows that would
leave the text are dropped by length and position, and the rest are compared word by word.

A benchmark is taken in blocks of bounded size. A row passes the blocks one after the other and carries the words
that earlier ones have hit, so it is judged by itself and alike however many blocks there are.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, StringType, StructType

from lociq.llm.shared import keep
from lociq.llm.words import WordHashes, grams, let_go, plain_words

WINDOW = 13
SHINGLE = 3
#: Bytes of item texts in one broadcast index (at least one item); a larger benchmark is joined block after block.
BLOCK_BYTES = 4 << 20
#: Windows whose shingles are ranked at once.
RANKED = 1 << 16


@dataclass
class Index:
    """Distinct windows of a block of items, as arrays: some 40 bytes for each beside the texts themselves.

    Window i is the words text[begin[i]:end[i]], `size[i]` of them, and stands in the items owner[owned[i]:owned[i + 1]].
    Windows with the prefix shingle keys[j] are order[first[j]:first[j + 1]], at `place` in them; windows shorter than a
    shingle are found by their first word.
    """

    text: bytes
    items: list[str]
    begin: np.ndarray
    end: np.ndarray
    size: np.ndarray
    owned: np.ndarray
    owner: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    order: np.ndarray
    place: np.ndarray
    short: dict[bytes, list[int]]


class Windows:
    """All windows of a block of items; an item of fewer words than `size` is one window, one without words none."""

    def __init__(self, items: list[tuple[object, str | None]], size: int):
        hashes, texts, own, lengths, starts, sizes, owners, marks, at = WordHashes(), [], [], [], [], [], [], [], 0
        for i, (_, text) in enumerate(items):
            words = plain_words(text)
            if not words:
                continue
            h, k = hashes.of(words), min(size, len(words))
            n = len(words) - k + 1
            texts.append(b" ".join(words))
            own.append(h)
            lengths.append(np.fromiter(map(len, words), np.int64, len(words)))
            starts.append(at + np.arange(n))
            sizes.append(np.full(n, k))
            owners.append(np.full(n, i))
            marks.append(grams(h, k))
            at += len(words)
        joined = lambda a, kind: np.concatenate([np.empty(0, kind), *a])
        self.items, self.text = [str(i) for i, _ in items], b" ".join(texts)
        length = joined(lengths, np.int64)
        self.ends = np.cumsum(length + 1) - 1
        self.begins = self.ends - length
        self.start, self.size, self.owner, self.mark = joined(starts, np.int64), joined(sizes, np.int64), joined(owners, np.int64), joined(marks, np.uint64)
        self.shingle = grams(joined(own, np.uint64), SHINGLE)

    def wanted(self) -> np.ndarray:
        """Distinct shingle hashes of the items (and of where one item meets the next, which do no harm)."""
        return np.unique(self.shingle)

    def words(self, i: int) -> bytes:
        return self.text[self.begins[self.start[i]] : self.ends[self.start[i] + self.size[i] - 1]]

    def distinct(self) -> tuple[np.ndarray, np.ndarray]:
        """One row of each distinct window, and for every row the number of its window."""
        order = np.lexsort((self.start, self.mark, self.size))
        size, mark = self.size[order], self.mark[order]
        new = np.ones(len(order), bool)
        new[1:] = (size[1:] != size[:-1]) | (mark[1:] != mark[:-1])
        starts = np.append(np.flatnonzero(new), len(order))
        for s, e in zip(starts[:-1].tolist(), starts[1:].tolist(), strict=True):
            if e - s > 1:
                own = [self.words(i) for i in order[s:e].tolist()]
                if any(w != own[0] for w in own):  # different windows under one hash
                    by = sorted(range(e - s), key=own.__getitem__)
                    order[s:e] = order[s:e][by]
                    new[s:e] = [j == 0 or own[by[j]] != own[by[j - 1]] for j in range(e - s)]
        group = np.empty(len(order), np.int64)
        group[order] = np.cumsum(new) - 1
        return order[new], group

    def index(self, counts: np.ndarray) -> Index:
        """`counts`: how often each shingle of wanted() stands in the corpus."""
        rows, group = self.distinct()
        pairs = np.unique(np.column_stack([group, self.owner]), axis=0) if len(group) else np.empty((0, 2), np.int64)
        start, size = self.start[rows], self.size[rows]
        seen = counts[np.searchsorted(self.wanted(), self.shingle)] if len(self.shingle) else np.empty(0, np.int64)
        place = np.zeros(len(rows), np.int64)
        for k in np.unique(size[size >= SHINGLE]).tolist():
            of = np.flatnonzero(size == k)
            for part in np.array_split(of, -(-len(of) // RANKED)):
                at = start[part][:, None] + np.arange(k - SHINGLE + 1)
                n, g = seen[at], self.shingle[at]
                place[part] = np.where(n == n.min(axis=1, keepdims=True), g, np.uint64(2**64 - 1)).argmin(axis=1)
        long = np.flatnonzero(size >= SHINGLE)
        prefix = self.shingle[start[long] + place[long]] if len(long) else np.empty(0, np.uint64)
        by = np.argsort(prefix, kind="stable")
        keys, first = np.unique(prefix[by], return_index=True)
        short = defaultdict(list)
        for i in np.flatnonzero(size < SHINGLE).tolist():
            short[self.words(int(rows[i])).split(b" ", 1)[0]].append(i)
        return Index(
            self.text, self.items, self.begins[start], self.ends[start + size - 1], size, np.searchsorted(pairs[:, 0], np.arange(len(rows) + 1)), pairs[:, 1],
            keys, np.append(first, len(by)), long[by], place, dict(short),
        )


def shingles(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Shingle hashes at each place."""
    return grams(hashes.of(words), SHINGLE)


def shingle_counts(docs: DataFrame, wanted: np.ndarray) -> np.ndarray:
    """How often each of the block's shingles stands in the corpus; a partition gives a row for each that it holds."""
    shared = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches):
        hashes, keys = WordHashes(), shared.value
        total = np.zeros(len(keys), np.int64)
        for b in batches:
            for text in b["text"]:
                g = shingles(plain_words(text), hashes)
                if len(g) and len(keys):
                    at = np.searchsorted(keys, g)
                    at[at == len(keys)] = 0
                    at = at[keys[at] == g]
                    np.add.at(total, at, 1)
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"i": seen, "n": total[seen]})
        del hashes
        let_go()

    rows = docs.select("text").mapInPandas(run, "i long, n long").groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    counts = np.zeros(len(wanted), np.int64)
    counts[rows["i"].to_numpy()] = rows["n"].to_numpy()
    return counts


def hits_of(words: list[bytes], index: Index, hashes: WordHashes) -> tuple[np.ndarray, set[int]]:
    """Which words stand in a window, and the windows."""
    covered, found, n = np.zeros(len(words), bool), set(), len(words)
    keys = index.keys

    def compare(start: int, i: int) -> None:
        k = int(index.size[i])
        if start >= 0 and start + k <= n and b" ".join(words[start : start + k]) == index.text[index.begin[i] : index.end[i]]:
            covered[start : start + k] = True
            found.add(i)

    g = shingles(words, hashes)
    if len(g) and len(keys):
        at = np.searchsorted(keys, g)
        at[at == len(keys)] = 0
        for p in np.flatnonzero(keys[at] == g).tolist():
            j = at[p]
            for i in index.order[index.first[j] : index.first[j + 1]].tolist():
                compare(p - int(index.place[i]), i)
    if index.short:
        for p, w in enumerate(words):
            for i in index.short.get(w, ()):
                compare(p, i)
    return covered, found


def blocks_of(items: DataFrame, most: int) -> Iterator[list[tuple[object, str | None]]]:
    """Items in lists of bounded size, one after the other; no more than one partition is on the driver at a time."""
    block, held = [], 0
    for r in items.select("item_id", "text").toLocalIterator():
        block.append((r["item_id"], r["text"]))
        held += len(r["text"] or "")
        if held >= most:
            yield block
            block, held = [], 0
    yield block


def over_blocks(docs: DataFrame, items: DataFrame, size: int, block_bytes: int, finish, schema) -> DataFrame:
    """finish(batch, words, hits, item ids of each row) over `docs` (with text), once all blocks of `items` have passed.

    Between two blocks the rows are kept with what they have been hit by so far.
    """
    share, blocks = docs.sparkSession.sparkContext.broadcast, blocks_of(items, block_bytes)
    names = list(docs.columns)
    hit, owned = (next(n for n in (f"{base}{'_' * i}" for i in range(len(names) + 1)) if n not in names) for base in ("hit", "owned"))
    state = StructType([*docs.schema.fields]).add(hit, BinaryType()).add(owned, ArrayType(StringType()))
    block = next(blocks)
    while True:
        following = next(blocks, None)
        windows = Windows(block, size)
        shared = share(windows.index(shingle_counts(docs, windows.wanted())))
        if following is None or not following:
            return docs.mapInArrow(passing(shared, hit, owned, names, finish), schema)
        docs = keep(docs.mapInArrow(passing(shared, hit, owned, names, None), state))
        block = following


def passing(shared, hit: str, owned: str, names: list[str], finish):
    def run(batches):
        hashes, index = WordHashes(), shared.value
        for b in batches:
            carried = hit in b.schema.names
            before = zip(b.column(hit).to_pylist(), b.column(owned).to_pylist(), strict=True) if carried else None
            n_words, n_hit, bits, ids = [], [], [], []
            for text in b.column("text").to_pylist():
                words = plain_words(text)
                covered, found = hits_of(words, index, hashes)
                own = {index.items[j] for i in found for j in index.owner[index.owned[i] : index.owned[i + 1]].tolist()}
                if carried:
                    old, more = next(before)
                    covered |= np.unpackbits(np.frombuffer(old, np.uint8), count=len(words)).astype(bool)
                    own.update(more)
                n_words.append(len(words))
                n_hit.append(int(covered.sum()))
                ids.append(sorted(own))
                if not finish:
                    bits.append(np.packbits(covered).tobytes())
            own = b.select(names)
            if finish:
                yield finish(own, n_words, n_hit, ids)
            else:
                more = [pa.array(bits, pa.binary()), pa.array(ids, pa.list_(pa.string()))]
                yield pa.RecordBatch.from_arrays([*own.columns, *more], [*names, hit, owned])
        del hashes
        let_go()

    return run


def contamination(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids as strings) for every row of `docs`.

    Null and empty texts have no words and no hits; items without words have no windows; equal items each count;
    without items nothing is hit. Repeated rows are judged each; further columns are ignored. Each block of items
    is broadcast as an index of a small multiple of `block_bytes`; documents aren't shuffled.
    """

    def report(b, n_words, n_hit, ids):
        return pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n_words, pa.int64()), pa.array(n_hit, pa.int64()), pa.array(ids, pa.list_(pa.string()))], ["doc_id", "n_words", "n_hit", "items"])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return over_blocks(rows, items, size, block_bytes, report, "doc_id long, n_words long, n_hit long, items array<string>")


def contaminated(n_hit, n_words):
    """A twentieth of the words at least stand in benchmark windows."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def without_contaminated(docs: DataFrame, items: DataFrame, size: int = WINDOW, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Rows of `docs`, with all their columns, that aren't contaminated; each row is judged by its own text."""

    def clean(b, n_words, n_hit, ids):
        return b.filter(pa.array(~contaminated(np.array(n_hit, np.int64), np.array(n_words, np.int64))))

    return over_blocks(docs, items, size, block_bytes, clean, docs.schema)


def op4(spark, sf_dir: str) -> DataFrame:
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    return contamination(docs, items).select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contaminated(F.col("n_hit"), F.col("n_words")).alias("contaminated"),
    )


ORACLE = r"""
WITH low AS (SELECT 0 AS src, doc_id AS id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
  UNION ALL SELECT 1, item_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') FROM benchmark),
words AS (SELECT src, id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM low),
item_windows AS (SELECT id, unnest(list_transform(range(1, greatest(len(w) - 12, 1) + 1), lambda i: array_to_string(w[i:i+12], ' '))) AS win, least(len(w), 13) AS n
  FROM words WHERE src = 1 AND len(w) > 0),
sizes AS (SELECT DISTINCT n FROM item_windows),
doc_windows AS (SELECT id AS doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i+n-1], ' '))) AS win
  FROM words, sizes WHERE src = 0 AND len(w) >= n),
hits AS (SELECT doc_id, d.n, i, b.id AS item FROM doc_windows d JOIN item_windows b ON d.win = b.win AND d.n = b.n),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item AS VARCHAR) AS item FROM hits) GROUP BY doc_id)
SELECT id AS doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered ON id = covered.doc_id LEFT JOIN found ON id = found.doc_id WHERE src = 0
"""
