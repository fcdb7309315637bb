"""Scores of texts under an n-gram model with deleted interpolation.

p(w | h) = l2 * c(h w) / c(h) + l1 * c(w) / N + l0 / (V + 1), where the weights l depend on how frequent the
context h is. Weights are learned by expectation-maximisation on held-out counts: every training token in turn is
deleted from the counts, and the weights make the deleted tokens most likely. All counts are exact and cover all
training documents; they go from the documents to buckets and back (see tally), none through the driver. What the
driver sees for the weights is a histogram of bounded size.
"""

from __future__ import annotations

import zlib
from decimal import Decimal

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.shared import keep
from lociq.llm.tally import NO_ID, answered, blocks_of, packed, squeezed, tallied, unpacked, whole
from lociq.llm.words import LOWER, WordHashes, distinct, let_go, mixed, places_in

FOLDS, HELD_OUT = 5, 1
END, START = np.uint64(0x5EED0E4D0E4D5EED), np.uint64(0x5EED57A257A25EED)
#: Context buckets: 0, 1, 2-3, 4-7, ... up to all counts of 64 bits.
BUCKETS = 65
#: Histogram bins for each doubling of a count or ratio, and their number.
FINE, BINS = 2, 130
#: Types are added up in shares of one over this; as many shares as 10 ** 19 may be off by less than one, altogether by less than half a type.
SHARES = 10**20
#: A block's training tokens, its shares of types, its histogram and what scores of its documents need.
BLOCKS = "n_tokens long, types decimal(38,0), cells binary, docs binary, single binary, pair binary"


def crc_fold(ids: np.ndarray) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i == NO_ID else str(i).encode()) % FOLDS for i in ids.tolist()])


def bucket_of(c: np.ndarray) -> np.ndarray:
    """0 for 0, else one more than the whole part of the binary logarithm."""
    return np.where(c > 0, np.frexp(np.maximum(c, 1).astype(np.float64))[1], 0).astype(np.int64)


class Block:
    """Tokens of a block's documents: hashes of each, of its context and of both, and whose they are."""

    def __init__(self, ids: np.ndarray, texts: list[bytes]):
        hashes = WordHashes()
        words = [hashes.of(t.translate(LOWER).split()) for t in texts]
        self.sizes = np.array([len(w) + 1 for w in words])
        ends = np.cumsum(self.sizes)
        self.starts = ends - self.sizes
        self.token = np.full(int(ends[-1]), END)
        self.context = np.full(int(ends[-1]), START)
        for w, s in zip(words, self.starts.tolist(), strict=True):
            self.token[s : s + len(w)] = w
            self.context[s + 1 : s + 1 + len(w)] = w
        self.pair = mixed(self.context * np.uint64(0x9E3779B97F4A7C15) + self.token)
        self.token, self.context = mixed(self.token), mixed(self.context)
        self.learned = crc_fold(ids) != HELD_OUT
        self.doc = np.repeat(np.arange(len(ids)), self.sizes)

    def keys(self) -> np.ndarray:
        start = mixed(np.array([START]))
        return distinct(np.concatenate([self.token, self.pair, start]))


def keys_of(ids, texts):
    b = Block(ids, texts)
    keys = b.keys()
    counts = np.zeros(len(keys), np.int64)
    of = b.learned[b.doc]
    learned = np.concatenate([b.token[of], b.pair[of], np.full(int(b.learned.sum()), mixed(np.array([START]))[0])])
    own, n = np.unique(learned, return_counts=True)
    counts[np.searchsorted(keys, own)] = n
    return keys, counts


def fine_bin(log: np.ndarray) -> np.ndarray:
    """By the natural logarithm of a number of 1 at least."""
    return 1 + np.minimum(BINS - 2, (FINE / np.log(2) * log + 1e-9).astype(np.int64))


def held_out_cells(context: np.ndarray, single: np.ndarray, pair: np.ndarray) -> bytes:
    """Histogram of training tokens, each deleted from the counts: cell, number, sums of the logarithms of c(h w) / c(h) and c(w)."""
    h, w, hw = context - 1, single - 1, pair - 1
    log_h, log_w, log_hw = (np.log(np.maximum(x, 1)) for x in (h, w, hw))
    two = hw > 0
    cell = (bucket_of(h) * BINS + np.where(two, fine_bin(log_h - log_hw), 0)) * BINS + np.where(w > 0, fine_bin(log_w), 0)
    number = np.bincount(cell)
    cells = np.flatnonzero(number)
    sums = (np.bincount(cell, x)[cells] for x in (np.where(two, log_hw - log_h, 0), log_w))
    return squeezed(np.column_stack([cells, number[cells], *sums]).astype(np.float64).tobytes())


def type_shares(own: np.ndarray, total: np.ndarray) -> int:
    """What a block's training tokens are of their types, in SHARES, from both numbers of each type: every type is the sum of its tokens' shares."""
    return sum(SHARES * o // t for o, t in zip(own.tolist(), total.tolist(), strict=True) if o)


def block_row(ids, texts, totals):
    b = Block(ids, texts)
    keys = b.keys()
    if len(keys) != len(totals):
        raise RuntimeError("a block's counts aren't complete")
    at = places_in(keys, b.token)
    single, pair = totals[at], totals[places_in(keys, b.pair)]
    context = np.empty_like(single)
    context[1:] = single[:-1]
    context[b.starts] = begin = totals[np.searchsorted(keys, mixed(np.array([START])))][0]
    of = b.learned[b.doc]
    docs = np.stack([ids, ~b.learned, b.sizes, np.full(len(ids), begin)]).astype(np.int64)
    own = np.bincount(at[of], minlength=len(keys))
    row = (int(of.sum()), Decimal(type_shares(own, totals)), held_out_cells(context[of], single[of], pair[of]), squeezed(docs.tobytes()), packed(single), packed(pair))
    return pd.DataFrame([row], columns=[c.split()[0] for c in BLOCKS.split(", ")])


def open_cells(batches):
    for b in batches:
        for c in b["cells"]:
            rows = np.frombuffer(whole(c), np.float64).reshape(-1, 4)
            yield pd.DataFrame({"cell": rows[:, 0].astype(int), "n": rows[:, 1], "pair": rows[:, 2], "single": rows[:, 3]})


def mixture_weights(cells: np.ndarray, n_tokens: int, n_types: int, steps: int = 200) -> np.ndarray:
    """Weights (l2, l1, l0) of each context bucket by expectation-maximisation over the histogram's cells."""
    weights = np.tile([0.3, 0.6, 0.1], (BUCKETS, 1))
    weights[0] = [0.0, 0.9, 0.1]
    number = cells[:, 1]
    bucket = (cells[:, 0] // (BINS * BINS)).astype(int)
    has_pair, has_single = (cells[:, 0] // BINS) % BINS > 0, cells[:, 0] % BINS > 0
    f = np.column_stack(
        [
            np.where(has_pair, np.exp(cells[:, 2] / number), 0.0),
            np.where(has_single, np.exp(cells[:, 3] / number) / max(1, n_tokens - 1), 0.0),
            np.full(len(cells), 1 / (n_types + 1)),
        ]
    )
    for _ in range(steps):
        part = weights[bucket] * f
        part *= (number / part.sum(axis=1))[:, None]
        new = np.zeros_like(weights)
        np.add.at(new, bucket, part)
        seen = new.sum(axis=1) > 0
        # A little of each estimate stays, so that no text has probability 0.
        made = new[seen] / new[seen].sum(axis=1, keepdims=True)
        weights[seen] = (1 - 1e-6) * made + 1e-6 * np.array([0.0, 0.0, 1.0])
    return weights


def scorer(weights: np.ndarray, n_tokens: int, n_types: int):
    """Rows of the documents of blocks, with their base scores and scores."""

    def run(batches):
        for b in batches:
            for docs, s, p in zip(b["docs"], b["single"], b["pair"], strict=True):
                ids, held, sizes, begin = np.frombuffer(whole(docs), np.int64).reshape(4, -1)
                single, pair = unpacked(s), unpacked(p)
                starts = np.cumsum(sizes) - sizes
                context = np.append(0, single[:-1])
                context[starts] = begin
                w = weights[bucket_of(context)]
                mixture = w[:, 0] * pair / np.maximum(context, 1) + w[:, 1] * single / max(1, n_tokens) + w[:, 2] / (n_types + 1)
                base = np.log10((single + 0.5) / (n_tokens + 0.5 * (n_types + 1)))
                add = lambda x: np.add.reduceat(x, starts)
                yield pd.DataFrame({"doc_id": ids, "held_out": held.astype(bool), "n_tokens": sizes, "n_known": add((single > 0).astype(np.int64)), "base_score": add(base), "score": add(np.log10(mixture))})
                del single, pair, context, w, mixture, base
                let_go()

    return run


def score_texts(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of `docs`.

    Documents whose crc32(doc_id as text) mod 5 is 1 are held out, others are learned from; a null id's text is
    empty. Null and empty texts are one token, the end. Repeated rows are counted and scored each; further columns
    are ignored; an empty table gives an empty result; without training documents N and V are 0.
    """
    told = keep(answered(blocks_of(docs), tallied(docs, keys_of), block_row, BLOCKS))
    n, v = told.agg(F.sum("n_tokens"), F.sum("types")).first()
    n, v = int(n or 0), (2 * int(v or 0) + SHARES) // (2 * SHARES)
    cells = (
        told.select("cells").mapInPandas(open_cells, "cell long, n double, pair double, single double")
        .groupBy("cell").agg(F.sum("n"), F.sum("pair"), F.sum("single")).orderBy("cell").collect()
    )
    weights = mixture_weights(np.array(cells, np.float64).reshape(-1, 4), n, v)
    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double"
    out = told.select("docs", "single", "pair").mapInPandas(scorer(weights, n, v), schema)
    return out.select(
        F.when(F.col("doc_id") != NO_ID, F.col("doc_id")).alias("doc_id"), "held_out", "n_tokens", "n_known",
        F.lit(n).cast("long").alias("train_tokens"), "base_score", "score",
    )


def op5(spark, sf_dir: str) -> DataFrame:
    return score_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"))
