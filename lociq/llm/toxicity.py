"""Toxic passages: maximum-scoring segments of token log-odds, calibrated as extreme values.

Token weights are log-odds between toxic and clean documents under an informative Dirichlet prior. One linear scan
finds all maximal-scoring segments of a document. The score of a segment becomes a p-value through the
extreme-value law of such maxima; the document's evidence goes through a logistic curve to a probability.

Labelled documents are dealt into two halves by a hash of doc_id. Weights of one half score the other, so the
extreme-value law of clean documents and the curve are fitted on documents that their weights haven't seen; the
weights of all of them then score the corpus.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.llm.words import plain_words

#: Bound on the labelled documents that the model is fitted on, for each class; the first ones by a hash of doc_id.
MOST_PER_CLASS = 20_000
#: Tokens that the prior counts as, at most and as a share of the training tokens.
PRIOR, PRIOR_SHARE = 50_000.0, 0.1
LEAST_Z = 3.0
LEAST_DOCS = 4
#: Share of the words of a toxic passage that carry weight, which sets what other words cost.
DENSITY = 0.05
DRIFT = math.log(1 - DENSITY)


@dataclass
class Model:
    weights: dict[bytes, float]
    drift: float
    lam: float
    k: float
    coef: list[float]


def segments(at: np.ndarray, weight: np.ndarray, drift: float) -> list[tuple[int, int, float]]:
    """All maximal-scoring segments (start, end, score), end exclusive, of a text's words.

    Words at the positions `at` have their weight, all others `drift` < 0; only positions with positive weight can
    begin or end a segment, so the scan walks those with a weight and charges gaps at once. Each position is
    pushed and popped once.
    """
    out: list[list] = []  # start, end, cumulative score before it and at its end, nearest earlier one with a smaller score before
    total, seen = 0.0, 0
    for p, w in zip(at.tolist(), weight.tolist(), strict=True):
        total += drift * (p - seen)
        seen = p + 1
        before = total
        total += w
        if w <= 0:
            continue
        new = [p, p + 1, before, total]
        while True:
            j = len(out) - 1
            while j >= 0 and out[j][2] >= new[2]:
                j = out[j][4]
            if j < 0 or out[j][3] >= new[3]:
                out.append([*new, j])
                break
            new = [out[j][0], new[1], out[j][2], new[3]]
            del out[j:]
    return [(s, e, hi - lo) for s, e, lo, hi, _ in out]


def scored_segments(words: list[bytes], model: Model) -> list[tuple[int, int, float]]:
    get = model.weights.get
    hits = [(i, w) for i, x in enumerate(words) if (w := get(x)) is not None]
    return segments(np.array([h[0] for h in hits]), np.array([h[1] for h in hits]), model.drift) if hits else []


def top_score(words: list[bytes], model: Model) -> float:
    return max((score for _, _, score in scored_segments(words, model)), default=0.0)


def evidence(words: list[bytes], model: Model) -> tuple[float, float, list[tuple[int, int, float]]]:
    """Largest normal score of a segment, the sum over significant ones, and these with their p-values."""
    best, total, found = 0.0, 0.0, []
    for s, e, score in scored_segments(words, model):
        normal = model.lam * score - math.log(max(model.k * len(words), 1e-9))
        best = max(best, normal)
        p = -math.expm1(-math.exp(-normal)) if normal > -30 else 1.0
        if p < 0.05:
            total += normal
            found.append((s, e, p))
    return best, total, found


def features(best: np.ndarray, total: np.ndarray) -> np.ndarray:
    return np.column_stack([np.ones(len(best)), np.minimum(best, 60), np.log1p(best), np.log1p(total)])


def half_of(doc_id: str) -> Column:
    return F.pmod(F.xxhash64(doc_id, F.lit(7)), F.lit(2)).cast("int")


def known_labels(labels: DataFrame) -> DataFrame:
    """doc_id and toxic (0 or 1) of the labelled documents whose fold isn't 0."""
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    known = labels.where("toxic is not null and doc_id is not null").where(fold != 0)
    return known.groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))


def training_rows(docs: DataFrame, known: DataFrame, most: int) -> DataFrame:
    """doc_id, toxic, half, text of at most `most` documents of each class."""
    order = [F.xxhash64("doc_id"), F.col("doc_id")]
    chosen = [known.where(F.col("toxic") == c).orderBy(*order).limit(most) for c in (0, 1)]
    # At most 2 * most rows of two numbers: the bound of the broadcast.
    return docs.select("doc_id", "text").join(F.broadcast(chosen[0].unionByName(chosen[1])), "doc_id").withColumn("half", half_of("doc_id"))


#: Counts of a word: clean and toxic in the first half, then in the second.
COUNTS = ("clean0", "tox0", "clean1", "tox1")


def count_words(batches):
    for b in batches:
        counts = [Counter() for _ in COUNTS]
        for text, toxic, half in zip(b["text"], b["toxic"], b["half"], strict=True):
            counts[2 * int(half) + int(toxic > 0)].update(plain_words(text))
        words = list(set().union(*counts))
        yield pd.DataFrame({"word": words} | {n: [c[w] for w in words] for n, c in zip(COUNTS, counts, strict=True)})


def weigh(words: list[bytes], clean: np.ndarray, tox: np.ndarray) -> tuple[dict[bytes, float], np.ndarray, np.ndarray] | None:
    """Weights of the words that speak clearly, and weights and shares of clean text for the segments' law; None without toxic ones.

    A word counts if its log-odds under the Dirichlet prior are LEAST_Z standard deviations from 0.
    """
    n_clean, n_tox = float(clean.sum()), float(tox.sum())
    if not n_clean or not n_tox:
        return None
    a0 = min(PRIOR, PRIOR_SHARE * (n_clean + n_tox))
    prior = a0 * (clean + tox) / (n_clean + n_tox)
    with np.errstate(divide="ignore", invalid="ignore"):
        odds = lambda c, n: np.log((c + prior) / (n + a0 - c - prior))
        z = (odds(tox, n_tox) - odds(clean, n_clean)) / np.sqrt(1 / (tox + prior) + 1 / (clean + prior))
    # The prior shrinks the odds of a word for its rank; the scan takes the odds of the counts with one half added.
    raw = np.log((tox + 0.5) / (n_tox + 1)) - np.log((clean + 0.5) / (n_clean + 1))
    used = np.flatnonzero((clean + tox >= LEAST_DOCS) & (np.abs(z) >= LEAST_Z) & ((raw > 0) | (raw < DRIFT)))
    if not (raw[used] > 0).any():
        return None
    return {words[i]: float(raw[i]) for i in used.tolist()}, raw[used], clean[used] / n_clean


def fit(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> Model | None:
    """The model, or None where one of the classes has no document to learn from.

    What the driver gets is bounded by the labelled sample: its words, and two numbers for each of its documents.
    """
    known = known_labels(labels)
    rows = training_rows(docs, known, most)
    counts = rows.mapInPandas(count_words, "word binary, " + ", ".join(f"{c} long" for c in COUNTS)).groupBy("word").agg(*[F.sum(c).alias(c) for c in COUNTS])
    table = counts.where(" + ".join(COUNTS) + f" >= {LEAST_DOCS}").orderBy("word").toArrow()
    words = table["word"].to_pylist()
    clean0, tox0, clean1, tox1 = (table[c].to_numpy().astype(np.float64) for c in COUNTS)
    every = weigh(words, clean0 + clean1, tox0 + tox1)
    if every is None:
        return None
    # Half h is scored by the weights of the other half, if that half has any.
    halves = [got[0] if (got := weigh(words, *part)) else every[0] for part in ((clean1, tox1), (clean0, tox0))]
    unseen = [Model(w, DRIFT, 1.0, 1.0, []) for w in halves]
    got = measured(rows, unseen)
    clean = got[got["toxic"] <= 0]
    lam, k = extreme_law(clean["top"].to_numpy(), clean["n"].to_numpy(), segment_rate(every[1], every[2]))
    for m in unseen:
        m.lam, m.k = lam, k
    got = measured(rows, unseen)
    # The bound may cut one class more than the other; the curve is that of their shares among all labelled documents.
    toxic = got["toxic"].to_numpy() > 0
    share = known.agg(F.avg("toxic")).first()[0]
    weight = np.where(toxic, share / max(toxic.mean(), 1e-9), (1 - share) / max(1 - toxic.mean(), 1e-9))
    coef = logistic(features(got["best"].to_numpy(), got["total"].to_numpy()), toxic.astype(float), weight)
    return Model(every[0], DRIFT, lam, k, coef.tolist())


def measured(rows: DataFrame, models: list[Model]) -> pd.DataFrame:
    """toxic, n (words), top (highest segment's score), best and total of each training document, repeated ids once."""

    def run(batches):
        for b in batches:
            out = []
            for i, text, toxic, half in zip(b["doc_id"], b["text"], b["toxic"], b["half"], strict=True):
                words = plain_words(text)
                m = models[int(half)]
                best, total, _ = evidence(words, m)
                out.append((i, int(toxic), len(words), top_score(words, m), best, total))
            yield pd.DataFrame(out, columns=["doc_id", "toxic", "n", "top", "best", "total"])

    schema = "doc_id long, toxic int, n long, top double, best double, total double"
    made = rows.select(F.col("doc_id").cast("long"), "text", "toxic", "half").mapInPandas(run, schema)
    one = made.groupBy("doc_id").agg(F.max(F.struct("toxic", "n", "top", "best", "total")).alias("r"))
    return one.select("doc_id", "r.*").orderBy("doc_id").toPandas()


def extreme_law(top: np.ndarray, n: np.ndarray, guess: float) -> tuple[float, float]:
    """lambda and K by maximum likelihood of the highest segment scores `top` of clean texts of `n` words (0: no segment).

    P(top < x) = exp(-K n exp(-lambda x)), also at 0. Given lambda, K is the number of texts with a segment over the sum of
    n exp(-lambda top). Without any such text, `guess` is lambda and K is that of half a text.
    """
    some = top > 0
    if not n.sum():
        return guess, 1.0
    if not some.any():
        return guess, 0.5 / n.sum()
    lo, hi = 1e-3, 20.0
    for _ in range(80):
        lam = (lo + hi) / 2
        w = n * np.exp(-lam * top)
        slope = 1 / lam - top[some].mean() + (w * top).sum() / w.sum()
        lo, hi = (lam, hi) if slope > 0 else (lo, lam)
    return lo, some.sum() / (n * np.exp(-lo * top)).sum()


def segment_rate(weight: np.ndarray, share: np.ndarray) -> float:
    """The positive root of sum p exp(lambda s) = 1 over the words of clean documents; 1 where scores don't fall on average."""
    s = np.append(weight, DRIFT)
    p = np.append(np.maximum(share, 1e-9), max(1e-9, 1 - share.sum()))
    lo, hi = 1e-6, 10.0
    if (p * s).sum() >= 0:
        return 1.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if (p * np.exp(np.minimum(mid * s, 700))).sum() < 1 else (lo, mid)
    return lo


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 50) -> np.ndarray:
    """Coefficients by Newton's method, each row as often as its weight says."""
    b = np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        g = x.T @ (weight * (y - p)) - ridge * b
        h = (x * (weight * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b))
        d = np.linalg.solve(h, g)
        b = b + d
        if np.abs(d).max() < 1e-8:
            break
    return b


def apply_model(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, score and the significant passages (start and end word, p-value) of every row."""
    schema = "doc_id long, score double, passages array<struct<start:int,end:int,p:double>>"

    passage = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("p", pa.float64())]))

    def run(batches):
        for b in batches:
            got = [(0.0, 0.0, []) if model is None else evidence(plain_words(t), model) for t in b.column("text").to_pylist()]
            x = features(np.array([g[0] for g in got]), np.array([g[1] for g in got]))
            score = np.zeros(len(got)) if model is None else 1 / (1 + np.exp(-np.clip(x @ np.array(model.coef), -30, 30)))
            spans = pa.array([[{"start": s, "end": e, "p": p} for s, e, p in g[2]] for g in got], passage)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), spans], ["doc_id", "score", "passages"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


def without_toxic(docs: DataFrame, model: Model | None) -> DataFrame:
    """Rows of `docs`, with all their columns, whose score is below 0.5."""
    if model is None:
        return docs

    def run(batches):
        for b in batches:
            got = [evidence(plain_words(t), model) for t in b.column("text").to_pylist()]
            x = features(np.array([g[0] for g in got]), np.array([g[1] for g in got]))
            yield b.filter(pa.array(x @ np.array(model.coef) < 0))

    return docs.mapInArrow(run, docs.schema)


def toxicity(docs: DataFrame, labels: DataFrame, most: int = MOST_PER_CLASS) -> DataFrame:
    """doc_id, held_out, score, predicted, passages for every row of `docs`.

    Null and empty texts have no passages and the score of a text without evidence. Without labelled documents of
    both classes all scores are 0. Repeated rows are scored each; a document labelled twice counts as toxic if
    either label does; further columns are ignored; an empty table gives an empty result. Scoring keeps the
    partitions of `docs`; nothing but the bounded training rows is shuffled.
    """
    out = apply_model(docs, fit(docs, labels, most))
    fold = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5
    return out.select(
        "doc_id", (fold == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "passages"
    )


def op10(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return toxicity(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
