"""Encoding to and decoding from the pieces of a SentencePiece vocabulary, with the N best segmentations.

A text's lattice has an arc for every piece that stands at a place. A forward Viterbi pass gives each place the best
score of reaching it; these are exact heuristics for an A-star search from the end backwards, which so gives the N
best paths in order and expands no partial path that isn't part of one. Pieces hold the word mark only at their
start, so a lattice falls into one for each word: words are searched apart (and remembered), and a document's N best
paths differ from the best only in the N - 1 words whose second path costs least, which one more search combines.

Scores are log-probabilities. A vocabulary of merges has ranks in their place (-1, -2, ...), which don't add up to
anything; there the piece of rank r counts as having the probability 1 / (r + RANK_OFFSET), up to a factor, as word
frequencies fall off with rank. So the search isn't the library's own greedy merging; README.md has how far apart they are.
"""

from __future__ import annotations

import gc
import heapq
import math
import re
from array import array
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.words import let_go

MARK = "▁"
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Setting of the session that names another model file.
SETTING = "spark.lociq.pieces.model"
#: Added to a merge's rank; frequent pieces differ less than their ranks.
RANK_OFFSET = 100
#: Scores below this mark pieces that aren't to be used; they cost as much as a character that no piece holds.
NEVER = -1e6
#: Words known beyond which an encoder starts anew.
REMEMBERED = 50_000
#: Characters of the documents whose words are searched together (one document at least).
TOGETHER = 8_000_000
#: Stands for a byte past ASCII until it is known what characters the bytes make.
HIGH = "\U0010fffe"


@dataclass
class Vocabulary:
    """Pieces with ids and scores; 256 byte pieces stand for characters that no piece holds."""

    ids: dict[str, int]
    scores: dict[str, float]
    texts: list[str]
    bytes_: list[int]
    longest: int
    lowest: float
    lone: str
    byte_of: dict[int, int] = field(default_factory=dict)


def load(path: str = MODEL) -> Vocabulary:
    """The vocabulary in a model file, read by the driver; some tens of thousands of pieces, so small enough to send."""
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    ids, scores, bytes_, texts = {}, {}, [-1] * 256, []
    for i in range(sp.get_piece_size()):
        piece = sp.id_to_piece(i)
        texts.append("" if sp.is_control(i) else piece)
        if sp.is_byte(i):
            bytes_[int(piece[3:5], 16)] = i
        elif not (sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i)):
            ids[piece], scores[piece] = i, sp.get_score(i)
    used = {p: s for p, s in scores.items() if s > NEVER}
    if all(s == int(s) for s in used.values()) and len(set(used.values())) == len(used):
        scores |= {p: -math.log(RANK_OFFSET - s) for p, s in used.items()}
    lowest = min(s for s in scores.values() if s > NEVER) - 10
    scores = {p: max(s, lowest) for p, s in scores.items()}
    if any(MARK in p.lstrip(MARK) for p in ids):
        raise ValueError("a piece holds the word mark after other characters; words can't be searched apart")
    if min(bytes_) < 0:
        raise ValueError("the vocabulary has no byte pieces")
    lone = "".join(c for c in "\n\t\r" if not any(c in p for p in ids))
    return Vocabulary(ids, scores, texts, bytes_, max(map(len, ids)), lowest, lone, {b: i for i, b in enumerate(bytes_)})


def best_paths(arcs: list[list[tuple]], n: int) -> list[tuple[float, list]]:
    """The n best paths from node 0 to the last, best first, as (score, labels).

    arcs[j] has (start, score, label) of the arcs that end at node j. Equal scores: first the one whose last arc
    comes first in its list.
    """
    forward = [0.0] + [float("-inf")] * (len(arcs) - 1)
    for j in range(1, len(arcs)):
        for start, score, _ in arcs[j]:
            if forward[start] + score > forward[j]:
                forward[j] = forward[start] + score
    heap, serial, out = [(-forward[-1], len(arcs) - 1, 0, 0.0, None)], 0, []
    while heap and len(out) < n:
        f, node, _, tail, link = heapq.heappop(heap)
        if node == 0:
            labels = []
            while link:
                labels.append(link[0])
                link = link[1]
            out.append((-f, labels))
            continue
        for start, score, label in arcs[node]:
            serial += 1
            heapq.heappush(heap, (-(forward[start] + score + tail), start, serial, score + tail, (label, link)))
    return out


class Encoder:
    """Searches words once; `known` gives the number of a word's row in the columns ids, score and second-path cost.

    A key of `known` lacks the mark that its word begins with; a word that begins with a character of `lone` (a line
    end) stands as it is. learn() drops all that is known once it exceeds a bound.
    """

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.forget()
        self.pieces = {p: (vocabulary.scores[p], (i,)) for p, i in vocabulary.ids.items()}
        self.ends = {p[i:]: None for p in self.pieces for i in range(len(p))} | self.pieces
        out = f"{MARK}{re.escape(vocabulary.lone)}"
        self.parts = re.compile(f"{MARK}+[^{out}]*|[^{MARK}][^{out}]*")
        self.shown = [x if i not in vocabulary.byte_of else chr(b) if (b := vocabulary.byte_of[i]) < 128 else HIGH for i, x in enumerate(vocabulary.texts)]

    def forget(self) -> None:
        self.known: dict[str, int] = {}
        self.ids, self.at, self.score, self.cost = array("i"), array("q", [0]), array("d"), array("d")

    def spelled(self, char: str) -> tuple[float, tuple[int, ...]]:
        """Score and byte pieces of a character that no piece holds alone."""
        return self.v.lowest, tuple(self.v.bytes_[b] for b in char.encode("utf-8", "surrogatepass"))

    def arcs(self, word: str) -> list[list[tuple]]:
        out: list[list[tuple]] = [[]]
        for j in range(1, len(word) + 1):
            ends = [(i, *hit) for i in range(max(0, j - self.v.longest), j) if (hit := self.pieces.get(word[i:j]))]
            if word[j - 1] not in self.pieces:
                ends.append((j - 1, *self.spelled(word[j - 1])))
            out.append(ends)
        return out

    def search(self, keys: set[str]) -> None:
        """Adds each word's row: the ids and score of its best path and what the second path costs more.

        Forward scores of the first and second path to each place depend on the word up to there, so in sorted
        order only what a word doesn't share with the one before it is searched.
        """
        get, longest, low = self.ends.get, self.v.longest, float("-inf")
        before = ""
        first, second, last = [0.0], [low], [None]
        for key in sorted(keys):
            word = self.full(key)
            n, p = len(word), 0
            for x, y in zip(word, before, strict=False):
                if x != y:
                    break
                p += 1
            before = word
            del first[p + 1 :], second[p + 1 :], last[p + 1 :]
            for j in range(p + 1, n + 1):
                one = two = low
                arc = None
                alone = get(word[j - 1])
                for i in range(j - 1, j - longest - 1 if j > longest else -1, -1):
                    hit = get(word[i:j], 0)
                    if hit:
                        score, other = first[i] + hit[0], second[i] + hit[0]
                        if score >= one:
                            two = one if one > other else other
                            one, arc = score, (i, hit[1])
                        elif score > two:
                            two = score
                    elif hit == 0:  # no piece ends with these characters
                        break
                if not alone:
                    score, ids = self.spelled(word[j - 1])
                    if first[j - 1] + score > one:
                        two = max(one, second[j - 1] + score)
                        one, arc = first[j - 1] + score, (j - 1, ids)
                    else:
                        two = max(two, first[j - 1] + score)
                first.append(one)
                second.append(two)
                last.append(arc)
            path, j = [], n
            while j:
                j, ids = last[j]
                path.append(ids)
            path.reverse()
            self.known[key] = len(self.score)
            self.ids.extend(chain.from_iterable(path))
            self.at.append(len(self.ids))
            self.score.append(first[n])
            self.cost.append(first[n] - second[n])

    def keys(self, text: str) -> list[str]:
        """The words of a text as keys of `known`."""
        if "\n" in self.v.lone and text[0] != " " and not self.odd(text):
            return text.replace("\n", " \n").split(" ")
        found = self.parts.findall(MARK + text.replace(" ", MARK))
        return [w[1:] if w[0] == MARK else w for w in found]

    @staticmethod
    def odd(text: str) -> bool:
        return "  " in text or MARK in text or "\t" in text or "\r" in text

    def full(self, key: str) -> str:
        return key if key and key[0] in self.v.lone else MARK + key

    def learn(self, texts: list[str | None]) -> None:
        """Searches the words of `texts` that aren't known yet, in one sorted pass."""
        if len(self.known) > REMEMBERED:
            self.forget()
        new: set[str] = set()
        for t in texts:
            if t:
                new.update(self.keys(t))
        new.difference_update(self.known)
        self.search(new)

    def rows(self) -> tuple[np.ndarray, ...]:
        """The columns as arrays; they must be let go before more words are learnt."""
        return np.frombuffer(self.ids, np.int32), np.frombuffer(self.at, np.int64), np.frombuffer(self.score), np.frombuffer(self.cost)

    def encode(self, text: str | None, n: int) -> tuple[list[int], list[float], list[str]]:
        """segment() of a text whose words may be new, its ids as a list."""
        self.learn([text])
        ids, scores, changes = self.segment(text, n, self.rows())
        return ids.tolist(), scores, changes

    def segment(self, text: str | None, n: int, rows: tuple) -> tuple[np.ndarray, list[float], list[str]]:
        """Ids of the best segmentation, scores of the n best, and how each other one differs from the best.

        A difference reads "word:ids" for each word (by its number) that is parted in another way. `rows` is what
        rows() gives once learn() has seen the text.
        """
        if not text:
            return np.zeros(0, np.int32), [0.0], []
        all_ids, starts, word_scores, word_costs = rows
        keys = self.keys(text)
        got = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))
        begin = starts[got]
        sizes = starts[got + 1] - begin
        until = np.cumsum(sizes)
        ids = all_ids[np.repeat(begin - until + sizes, sizes) + np.arange(until[-1])]
        best = float(word_scores[got].sum())
        if n == 1:
            return ids, [best], []
        costs = word_costs[got]
        near = np.argpartition(costs, n - 2)[: n - 1] if len(costs) > n - 1 else np.arange(len(costs))
        least = costs[near].max()
        free = np.sort(np.concatenate([np.flatnonzero(costs < least), np.flatnonzero(costs == least)])[: n - 1]).tolist()
        lattice: list[list[tuple]] = [[]]
        for k, at in enumerate(free):
            local = best_paths(self.arcs(self.full(keys[at])), n)
            lattice.append([(k, score, (at, rank, label)) for rank, (score, label) in enumerate(local)])
        paths = best_paths(lattice, n)
        scores = [best + s - paths[0][0] for s, _ in paths]
        changes = [
            ";".join(f"{at}:{' '.join(str(i) for part in label for i in part)}" for at, rank, label in labels if rank)
            for _, labels in paths[1:]
        ]
        return ids, scores, changes

    def decode(self, ids: Iterable[int]) -> str:
        """The text of a sequence of ids; bytes that aren't UTF-8 become U+FFFD."""
        text = "".join(map(self.shown.__getitem__, ids))
        if HIGH not in text:
            return text.replace(MARK, " ").removeprefix(" ")
        byte_of, texts = self.v.byte_of, self.v.texts
        out, raw = [], bytearray()
        for i in ids:
            if i in byte_of:
                raw.append(byte_of[i])
                continue
            if raw:
                out.append(raw.decode("utf-8", "replace"))
                raw = bytearray()
            out.append(texts[i])
        if raw:
            out.append(raw.decode("utf-8", "replace"))
        text = "".join(out).replace(MARK, " ")
        return text.removeprefix(" ")


SCHEMA = "doc_id long, n_chars long, n_pieces long, ids array<int>, scores array<double>, changes array<string>, whole boolean"


def slices(batch: pa.RecordBatch):
    """Runs of rows of `batch` with about TOGETHER characters each."""
    sizes = pc.fill_null(pc.utf8_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    run = np.cumsum(sizes) // TOGETHER
    cuts = [0, *(np.flatnonzero(np.diff(run)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if b > a:
            yield batch.slice(a, b - a)


def encode_texts(docs: DataFrame, n: int = 3, model: str = MODEL) -> DataFrame:
    """doc_id, n_chars, n_pieces, ids, scores, changes, whole for every row of `docs`.

    `ids` is the best segmentation, `scores` has those of the n best (fewer where there are fewer), `changes` tells
    how the second and further ones differ, and `whole` says whether decoding `ids` gives the text back (with word
    marks as spaces). Null and empty texts have no pieces and one segmentation of score 0. Equal rows get equal
    results; further columns are ignored. Rows stay where they are; only the vocabulary is broadcast, whose size
    the model file bounds.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(load(model)))

    def run(batches):
        encoder = Encoder(Vocabulary(**shared.value))
        gc.disable()  # nothing here makes cycles, and collections would walk all known words
        try:
            for b in batches:
                for part in slices(b):
                    yield encoded(encoder, part)
        finally:
            gc.enable()
            del encoder
            let_go()

    def encoded(encoder, part):
        texts, rows = part.column("text").to_pylist(), []
        encoder.learn(texts)
        known = encoder.rows()
        for text in texts:
            ids, scores, changes = encoder.segment(text, n, known)
            back = encoder.decode(ids.tolist()) == (text or "").replace(MARK, " ")
            rows.append((len(text or ""), len(ids), ids, scores, changes, back))
        cols = [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)]
        return pa.RecordBatch.from_arrays([part.column("doc_id"), *cols], names)

    kinds = [pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.float64()), pa.list_(pa.string()), pa.bool_()]
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, SCHEMA)


def decode_ids(rows: DataFrame, model: str = MODEL) -> DataFrame:
    """doc_id and the text of each row's `ids`; null ids give null."""
    shared = rows.sparkSession.sparkContext.broadcast(vars(load(model)))

    def run(batches):
        encoder = Encoder(Vocabulary(**shared.value))
        for b in batches:
            texts = [None if i is None else encoder.decode(i) for i in b.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return rows.select(F.col("doc_id").cast("long"), "ids").mapInArrow(run, "doc_id long, text string")


def op1(spark, sf_dir: str) -> DataFrame:
    return encode_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), model=spark.conf.get(SETTING, MODEL))
