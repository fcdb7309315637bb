"""Removal of word windows that occur again anywhere in the corpus, by suffix automata of reference shards.

1. Anchors (hashes of a few words, least in a short stretch) are chosen by what stands around them alone, so equal
   windows have equal anchors. Their numbers in the corpus come back to the documents; a window is a candidate if all
   its anchors occur twice or more. That leaves little but what is repeated.
2. A candidate window is routed by its rarest anchor. Runs of windows with one route are segments; they are gathered
   in shards by route. Equal windows have equal routes, so they meet in one shard, and since the rarest anchor counts,
   text around a frequent phrase isn't drawn to it. Equal segments of a block travel once.
3. A shard holds a suffix automaton for each route that several different segments share. Its segments are streamed
   through: the state reached by their last words tells how often a window occurs in the corpus. Automata are built
   where the segments are, not broadcast, since all repeated text of a corpus has no bound.
4. Blocks get the marks of their windows back and drop the words that repeated windows cover.
"""

from __future__ import annotations

from collections import defaultdict

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.tally import NO_ID, answered, blocks_of, bucket_bits, merged, open_block, squeezed, tallied, whole
from lociq.llm.words import WordHashes, grams, let_go, mixed, window_min

WINDOW = 35
#: Words of an anchor, and anchors of the stretch in which one is the least.
ANCHOR, STRETCH = 6, 10
#: Most windows in a segment.
RUN = 64
PLACE_BITS = 24
PARTS = "block long, shard int, body binary, local binary"
MARKS = "block long, local binary, marks binary"


def anchors(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each stretch of a document's words its anchor's place and hash; of equally low hashes the first counts.

    Stretches are looked at by parts of as many words as PLACE_BITS can number.
    """
    g = grams(h, ANCHOR)
    size, low = 1 << PLACE_BITS, np.uint64((1 << PLACE_BITS) - 1)
    found = []
    for at in range(0, max(1, len(g) - STRETCH + 1), size - STRETCH + 1):
        part = g[at : at + size]
        ranked = (mixed(part) & ~low) | np.arange(len(part), dtype=np.uint64)
        found.append((window_min(ranked, STRETCH) & low).astype(np.int64) + at)
    places = np.concatenate(found)
    return places, g[places]


def segments_of(h: np.ndarray, keys: np.ndarray, totals: np.ndarray, window: int):
    """(start, number of windows, route) of a document's segments of candidate windows."""
    places, own = anchors(h)
    n = totals[np.searchsorted(keys, own)].astype(np.uint64)
    ranked = (np.minimum(n, np.uint64(0xFFFF)) << np.uint64(48)) | (own >> np.uint64(16))
    route = window_min(ranked, window - ANCHOR - STRETCH + 2)
    good = np.flatnonzero(route >= np.uint64(2 << 48))
    if not len(good):
        return []
    cut = np.flatnonzero((np.diff(good) != 1) | (route[good[1:]] != route[good[:-1]])) + 1
    out = []
    for s, e in zip([0, *cut.tolist()], [*cut.tolist(), len(good)], strict=True):
        for at in range(s, e, RUN):
            out.append((int(good[at]), min(RUN, e - at), int(route[good[at]])))
    return out


def find_segments(window: int, bits: int):
    """Two functions: a block's anchors, and its segments by shard once the anchors' numbers are known."""

    def hashed(texts):
        hashes = WordHashes()
        return [hashes.of(t.split()) for t in texts]

    def keys_of(ids, texts):
        own = []
        for h in hashed(texts):
            if len(h) >= window:
                places, values = anchors(h)
                own.append(values[np.flatnonzero(np.diff(places, prepend=-1))])
        return merged(own)

    def rows(ids, texts, totals):
        hs = hashed(texts)
        keys = keys_of(ids, texts)[0]
        if len(keys) != len(totals):
            raise RuntimeError("a block's anchor counts aren't complete")
        shards = defaultdict(lambda: ({}, []))
        for doc, h in enumerate(hs):
            if len(h) < window:
                continue
            for start, n, route in segments_of(h, keys, totals, window):
                known, places = shards[int(mixed(np.array([route], np.uint64))[0]) >> (64 - bits)]
                content = (route, h[start : start + n + window - 1].tobytes())
                places.append((doc, start, n, known.setdefault(content, len(known))))
        out = []
        for shard, (known, places) in shards.items():
            local = np.array(places, np.uint32)
            times = np.bincount(local[:, 3], minlength=len(known)).astype(np.uint32)
            routes = np.array([r for r, _ in known], np.uint64)
            lengths = np.array([len(w) // 8 for _, w in known], np.uint32)
            body = np.uint32(len(known)).tobytes() + routes.tobytes() + lengths.tobytes() + times.tobytes() + b"".join(w for _, w in known)
            out.append((shard, squeezed(body), squeezed(local.tobytes())))
        return pd.DataFrame(out, columns=["shard", "body", "local"])

    return keys_of, rows


class Automaton:
    """Suffix automaton of several sequences; occurrences() counts the sequences' weights at each state."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.count = [-1], [0], [0]

    def add(self, sequence: list[int], weight: int) -> None:
        last = 0
        for c in sequence:
            last = self.extended(last, c)
            self.count[last] += weight

    def extended(self, last: int, c: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        if (q := nxt[last].get(c)) is not None:
            return q if length[q] == length[last] + 1 else self.cloned(last, c, q)
        cur = self.state({}, length[last] + 1)
        p = last
        while p != -1 and c not in nxt[p]:
            nxt[p][c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = nxt[p][c]
            link[cur] = q if length[q] == length[p] + 1 else self.cloned(p, c, q)
        return cur

    def state(self, edges: dict, length: int) -> int:
        self.next.append(edges)
        self.link.append(0)
        self.length.append(length)
        self.count.append(0)
        return len(self.next) - 1

    def cloned(self, p: int, c: int, q: int) -> int:
        clone = self.state(dict(self.next[q]), self.length[p] + 1)
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p != -1 and self.next[p].get(c) == q:
            self.next[p][c] = clone
            p = self.link[p]
        return clone

    def occurrences(self) -> None:
        for v in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            self.count[self.link[v]] += self.count[v]

    def statistics(self, sequence: list[int], window: int) -> np.ndarray:
        """For each window of an added sequence how often it occurs; matches are held to the window's length."""
        v, out = 0, []
        for i, c in enumerate(sequence):
            v = self.next[v][c]
            while self.length[self.link[v]] >= window:
                v = self.link[v]
            if i >= window - 1:
                out.append(self.count[v])
        return np.array(out)


def repeated_windows(contents: dict[bytes, int], window: int) -> dict[bytes, np.ndarray]:
    """For each segment of one route (with the times it occurs) which of its windows occur twice or more."""
    sequences = {w: np.frombuffer(w, np.uint64).tolist() for w in contents}
    if len(contents) == 1:
        (w, times), words = next(iter(contents.items())), next(iter(sequences.values()))
        n = len(words) - window + 1
        if times > 1 or len(set(words[:n])) == n:  # windows that begin with different words differ
            return {w: np.full(n, times > 1)}
    automaton = Automaton()
    for w, times in contents.items():
        automaton.add(sequences[w], times)
    automaton.occurrences()
    return {w: automaton.statistics(s, window) >= 2 for w, s in sequences.items()}


def mark_shard(window: int):
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        routes = defaultdict(lambda: defaultdict(int))
        rows = []
        for body in pdf["body"]:
            data = whole(body)
            n = int(np.frombuffer(data[:4], np.uint32)[0])
            own = np.frombuffer(data[4 : 4 + 8 * n], np.uint64).tolist()
            lengths, times = np.frombuffer(data[4 + 8 * n : 4 + 16 * n], np.uint32).reshape(2, n).tolist()
            at, mine = 4 + 16 * n, []
            for route, length, t in zip(own, lengths, times, strict=True):
                w = data[at : at + 8 * length]
                at += 8 * length
                routes[route][w] += t
                mine.append((route, w))
            rows.append(mine)
        marks = {(route, w): m for route, contents in routes.items() for w, m in repeated_windows(contents, window).items()}
        out = [squeezed(np.concatenate([marks[k] for k in mine]).tobytes()) for mine in rows]
        del routes, marks, rows
        let_go()
        return pd.DataFrame({"block": pdf["block"], "local": pdf["local"], "marks": out})

    return run


def cut(window: int):
    def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left):
            raise RuntimeError("marks for a block that isn't there: the input changed its order between two reads")
        ids, texts = open_block(left["ids"].iloc[0], left["texts"].iloc[0])
        starts = defaultdict(list)
        for local, marks in zip(right["local"], right["marks"], strict=True):
            places = np.frombuffer(whole(local), np.uint32).reshape(-1, 4)
            flags = np.frombuffer(whole(marks), bool)
            lengths = np.zeros(int(places[:, 3].max()) + 1, np.int64)
            lengths[places[:, 3]] = places[:, 2]
            begin = np.cumsum(lengths) - lengths
            for doc, start, n, known in places.tolist():
                hit = np.flatnonzero(flags[begin[known] : begin[known] + n])
                if len(hit):
                    starts[doc].append(hit + start)
        out = []
        for doc, (doc_id, text) in enumerate(zip(ids.tolist(), texts, strict=True)):
            words = text.split()
            removed = np.zeros(len(words), bool)
            if doc in starts:
                change = np.zeros(len(words) + 1, np.int64)
                at = np.concatenate(starts[doc])
                np.add.at(change, at, 1)
                np.add.at(change, at + window, -1)
                removed = np.cumsum(change[:-1]) > 0
                words_kept = [w for w, r in zip(words, removed.tolist(), strict=True) if not r]
            else:
                words_kept = words
            out.append((doc_id, len(words), int(removed.sum()), b" ".join(words_kept).decode("utf-8", "replace")))
        del texts, starts
        let_go()
        return pd.DataFrame(out, columns=["doc_id", "n_words", "n_removed", "kept"])

    return run


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_removed and kept (the words left, joined by one space) of every row of `docs`.

    A word goes if a window of `window` words that covers it starts anywhere else too, in the same document or
    another, also in a repeated row. Null and empty texts have no words; shorter texts lose none; null ids stay
    null; further columns are ignored; an empty table gives an empty result. `window` is 15 at least.
    """
    spark = docs.sparkSession
    if window < ANCHOR + STRETCH - 1:
        raise ValueError("the window is shorter than the stretch that an anchor is chosen from")
    bits = bucket_bits(spark)
    keys_of, rows = find_segments(window, bits)
    blocks = blocks_of(docs)

    segments = answered(blocks, tallied(docs, keys_of), rows, PARTS)
    marks = segments.groupBy("shard").applyInPandas(mark_shard(window), MARKS)
    out = blocks.groupBy("block").cogroup(marks.groupBy("block")).applyInPandas(
        cut(window), "doc_id long, n_words long, n_removed long, kept string"
    )
    return out.withColumn("doc_id", F.when(F.col("doc_id") != NO_ID, F.col("doc_id")))


def op3(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(spark.read.parquet(f"{sf_dir}/documents.parquet")).select(
        "doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256")
    )


ORACLE = r"""
WITH words AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT doc_id, unnest(range(1, len(w) - 33)) AS i, unnest(list_transform(range(1, len(w) - 33), lambda i: array_to_string(w[i:i+34], ' '))) AS win
  FROM words WHERE len(w) >= 35),
again AS (SELECT doc_id, i FROM windows WHERE win IN (SELECT win FROM windows GROUP BY win HAVING count(*) > 1)),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM again),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(list_transform(list_filter(list_zip(w, range(1, len(w) + 1)), lambda x: ps IS NULL OR NOT list_contains(ps, x[2])), lambda x: x[1]), ' ')) AS kept_sha256
FROM words LEFT JOIN lists USING (doc_id)
"""
