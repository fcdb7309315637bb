"""Counts over the whole corpus of what documents hold, returned to the documents.

Documents are packed into blocks. A block's distinct keys (64-bit hashes) go to buckets by their leading bits, each
bucket adds up the counts of all blocks, and sends each block the totals of its keys in the order that they came in.
So a key costs a few bytes on its way there and on the way back however often a block holds it, and a frequent key
comes once from each block.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lociq.llm.words import encoded, let_go

#: Bytes of text in a block; a longer text is a block of its own.
BLOCK_BYTES = 6 << 20
BLOCK = "block long, ids binary, texts binary"
PARTS = "block long, bucket int, keys binary, counts binary"
TOTALS = "block long, bucket int, totals binary"


def squeezed(data: bytes, level: int = 1) -> bytes:
    return zstandard.ZstdCompressor(level=level).compress(data)


def whole(data: bytes) -> bytes:
    return zstandard.ZstdDecompressor().decompress(data)


def packed_keys(keys: np.ndarray) -> bytes:
    """Sorted keys as differences, byte plane after byte plane."""
    steps = np.diff(keys, prepend=np.uint64(0))
    return squeezed(steps.view(np.uint8).reshape(-1, 8).T.tobytes())


def unpacked_keys(data: bytes) -> np.ndarray:
    planes = np.frombuffer(whole(data), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view(np.uint64).ravel(), dtype=np.uint64)


def packed(a: np.ndarray) -> bytes:
    """An array of numbers from 0 on (64 bits), byte plane after byte plane, as many planes as the largest needs."""
    planes = max(1, (int(a.max()).bit_length() + 7) // 8) if len(a) else 1
    rows = np.ascontiguousarray(a.astype("<u8")).view(np.uint8).reshape(-1, 8)[:, :planes]
    return bytes([planes]) + squeezed(rows.T.tobytes())


def unpacked(data: bytes) -> np.ndarray:
    planes = np.frombuffer(whole(data[1:]), np.uint8).reshape(data[0], -1)
    rows = np.zeros((planes.shape[1], 8), np.uint8)
    rows[:, : data[0]] = planes.T
    return rows.view("<u8").ravel().astype(np.int64)


def numbered(ids: list[int], texts: list[bytes], place: tuple[int, int]) -> tuple[int, bytes, bytes]:
    """A block's number, document ids (null: the least long) and texts; the number tells place and contents."""
    lengths = np.array([len(t) for t in texts], np.uint64)
    i = np.array(ids, np.int64)
    body = lengths.tobytes() + b"".join(texts)
    number = xxhash.xxh3_64_intdigest(i.tobytes() + body, seed=place[0] * 1_000_003 + place[1]) - (1 << 63)
    return number, i.tobytes(), body


def open_block(ids: bytes, texts: bytes) -> tuple[np.ndarray, list[bytes]]:
    i = np.frombuffer(ids, np.int64)
    body = whole(texts)
    lengths = np.frombuffer(body[: 8 * len(i)], np.uint64).tolist()
    at, out = 8 * len(i), []
    for n in lengths:
        out.append(body[at : at + n])
        at += n
    return i, out


NO_ID = -(1 << 63)


def gathered(batches):
    """(ids, texts, place) of one block of rows after the other."""
    pid, seq = TaskContext.get().partitionId(), 0
    ids: list[int] = []
    texts: list[bytes] = []
    held = 0
    for b in batches:
        for doc_id, text in zip(b.column("doc_id").fill_null(NO_ID).to_pylist(), b.column("text").to_pylist(), strict=True):
            t = encoded(text)
            ids.append(doc_id)
            texts.append(t)
            held += len(t) + 8
            if held >= BLOCK_BYTES:
                yield ids, texts, (pid, seq)
                ids, texts, held, seq = [], [], 0, seq + 1
    if ids:
        yield ids, texts, (pid, seq)


def packer(batches):
    for block in gathered(batches):
        number, i, body = numbered(*block)
        yield pa.RecordBatch.from_arrays([pa.array([number]), pa.array([i]), pa.array([squeezed(body, 3)])], ["block", "ids", "texts"])
        let_go()


def blocks_of(docs: DataFrame) -> DataFrame:
    """`docs` (doc_id, text) in blocks. Null ids become NO_ID, null texts empty.

    It is computed wherever it is used; a block's number holds its contents' hash, and totals that miss a block
    end the run, so an input that doesn't come in the same order again can't give wrong counts.
    """
    return read_for_blocks(docs).mapInArrow(packer, BLOCK)


def read_for_blocks(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text")


def bucket_bits(spark) -> int:
    """Buckets are four times the shuffle partitions, as a power of two, so that a bucket stays small as both grow."""
    return max(4, (4 * int(spark.conf.get("spark.sql.shuffle.partitions")) - 1).bit_length())


def tallied(docs: DataFrame, keys_of: Callable) -> DataFrame:
    """block, bucket, totals: the corpus totals of the keys of each of blocks_of(docs), in the order of the keys.

    keys_of(ids, texts) gives a block's sorted distinct keys and their counts (0 for keys that are only asked for).
    The blocks themselves aren't made here, only their numbers.
    """
    bits = bucket_bits(docs.sparkSession)

    def ask(batches):
        for ids, texts, place in gathered(batches):
            number = numbered(ids, texts, place)[0]
            keys, counts = keys_of(np.array(ids, np.int64), texts)
            edges = np.searchsorted(keys, np.arange(1 << bits, dtype=np.uint64) << np.uint64(64 - bits))
            edges = [*edges.tolist(), len(keys)]
            own = [(i, s, e) for i, (s, e) in enumerate(zip(edges, edges[1:], strict=False)) if e > s]
            cols = [pa.array([number] * len(own), pa.int64()), pa.array([i for i, _, _ in own], pa.int32())]
            cols += [pa.array([packed_keys(keys[s:e]) for _, s, e in own], pa.binary()), pa.array([packed(counts[s:e]) for _, s, e in own], pa.binary())]
            yield pa.RecordBatch.from_arrays(cols, ["block", "bucket", "keys", "counts"])
            del ids, texts, keys, counts, cols
            let_go()

    def add_up(pdf: pd.DataFrame) -> pd.DataFrame:
        own = [unpacked_keys(k) for k in pdf["keys"]]
        counts = np.concatenate([unpacked(c) for c in pdf["counts"]]).astype(np.int64)
        _, at = np.unique(np.concatenate(own), return_inverse=True)
        total = np.zeros(at.max() + 1, np.int64)
        np.add.at(total, at, counts)
        total = total[at]
        ends = np.cumsum([len(k) for k in own])
        parts = [packed(total[e - len(k) : e]) for k, e in zip(own, ends, strict=True)]
        del own, counts, at, total
        let_go()
        return pd.DataFrame({"block": pdf["block"], "bucket": pdf["bucket"], "totals": parts})

    return read_for_blocks(docs).mapInArrow(ask, PARTS).groupBy("bucket").applyInPandas(add_up, TOTALS)


def answered(blocks: DataFrame, totals: DataFrame, run: Callable, schema: str) -> DataFrame:
    """run(ids, texts, totals of its sorted keys) for every block; it gives data frames of `schema`.

    Where `schema` has the column block, that is added.
    """

    def meet(left: pd.DataFrame, right: pd.DataFrame):
        if not len(left):
            raise RuntimeError("totals for a block that isn't there: the input changed its order between two reads")
        ids, texts = open_block(left["ids"].iloc[0], left["texts"].iloc[0])
        own = [unpacked(t) for t in right.sort_values("bucket")["totals"]]
        out = run(ids, texts, np.concatenate(own) if own else np.empty(0, np.int64))
        del texts, own
        let_go()
        return out.assign(block=left["block"].iloc[0]) if schema.startswith("block ") else out

    return blocks.groupBy("block").cogroup(totals.groupBy("block")).applyInPandas(meet, schema)


def merged(arrays: list[np.ndarray], counts: list[np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct keys of all arrays with how often they come, or the sums of their counts."""
    every = np.concatenate([np.empty(0, np.uint64), *arrays])
    if counts is None:
        return np.unique(every, return_counts=True)
    keys, at = np.unique(every, return_inverse=True)
    total = np.zeros(len(keys), np.int64)
    np.add.at(total, at, np.concatenate([np.empty(0, np.int64), *counts]))
    return keys, total
