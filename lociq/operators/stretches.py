"""Reads dealt to stretches of the reference in packed form, for operators that count what reads have at each position.

A row for each base of each read would be shuffled, and reads of depth d hold each position d times. Here tasks pack
their reads by stretch, so that letters that neighbouring reads share cost little, and the task that a stretch goes to
lays the bases of some stretches side by side and counts them as arrays. A read that crosses into another stretch goes to both.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Positions of a stretch, and bases that are counted at once (but for a stretch that alone has more).
WIDTH, AT_ONCE = 2048, 1 << 19
TEXTS = ("seq", "qual", "ref")
PACKED = "tid long, stretch long, body binary"


def within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, ... for each of `sizes`, one after the other."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


@dataclass
class Bases:
    """Bases of some stretches: `slot` is their place among `size` slots, of which each stretch has WIDTH."""

    tids: np.ndarray
    stretches: np.ndarray
    of_read: dict[str, np.ndarray]
    sizes: np.ndarray
    read: np.ndarray
    place: np.ndarray
    slot: np.ndarray
    seq: np.ndarray
    qual: np.ndarray
    ref: np.ndarray

    @property
    def size(self) -> int:
        return len(self.tids) * WIDTH

    @property
    def q(self) -> np.ndarray:
        """Qualities; those that are missing are below all others."""
        return self.qual.astype(np.int16) - 33

    def own(self, name: str) -> np.ndarray:
        """A column of the reads, for each base."""
        return self.of_read[name][self.read]

    def where(self, keep: np.ndarray) -> Bases:
        cut = [x[keep] for x in (self.read, self.place, self.slot, self.seq, self.qual, self.ref)]
        return Bases(self.tids, self.stretches, self.of_read, self.sizes, *cut)

    def places(self, slots: np.ndarray) -> dict[str, np.ndarray]:
        """tid and site of slots."""
        group = slots // WIDTH
        return {"tid": self.tids[group], "site": (self.stretches[group] * WIDTH + slots % WIDTH).astype(np.int32)}


def laid(column: pa.Array, sizes: np.ndarray) -> np.ndarray:
    """Bytes of texts, each filled up with 0 to its size."""
    starts = np.frombuffer(column.buffers()[1], np.int32, len(column) + 1, 4 * column.offset)
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[starts[0] : starts[-1]] if data is not None else np.empty(0, np.uint8)
    own = np.diff(starts)
    if (own == sizes).all():
        return data
    out = np.zeros(sizes.sum(), np.uint8)
    out[np.repeat(np.cumsum(sizes) - sizes, own) + within(own)] = data
    return out


def packer(keep: tuple[str, ...]) -> Callable:
    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        squeeze = zstandard.ZstdCompressor(level=1)
        for b in batches:
            # Not in a where(), which would be pushed down to where the texts are made, and make them twice.
            b = b.drop_null() if any(c.null_count for c in b.columns) else b
            if not b.num_rows:
                continue
            tid, pos = (b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("tid", "pos"))
            sizes = np.max([np.diff(np.frombuffer(b.column(c).buffers()[1], np.int32, b.num_rows + 1, 4 * b.column(c).offset)) for c in TEXTS], axis=0).astype(np.int64)
            texts = [laid(b.column(c), sizes) for c in TEXTS]
            numbers = [b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in keep]
            first = pos // WIDTH
            times = np.where(sizes > 0, (pos + np.maximum(sizes, 1) - 1) // WIDTH - first + 1, 0)
            rows = np.repeat(np.arange(len(pos)), times)
            stretch = first[rows] + within(times)
            order = np.lexsort((stretch, tid[rows]))
            rows, stretch = rows[order], stretch[order]
            if not len(rows):
                continue
            cuts = np.flatnonzero(np.diff(tid[rows], prepend=tid[rows[0]] - 1) | np.diff(stretch, prepend=stretch[0] - 1))
            starts = np.cumsum(sizes) - sizes
            if not (len(rows) == len(pos) and (rows[1:] > rows[:-1]).all()):
                at = np.repeat(starts[rows], sizes[rows]) + within(sizes[rows])
                texts = [t[at] for t in texts]
            edges = np.append(np.cumsum(sizes[rows]) - sizes[rows], sizes[rows].sum())
            numbers = np.stack([pos[rows], sizes[rows], *(x[rows] for x in numbers)])
            bodies = []
            for a, z in zip(cuts.tolist(), [*cuts[1:].tolist(), len(rows)], strict=True):
                own = slice(int(edges[a]), int(edges[z]))
                bodies.append(squeeze.compress(np.int64(z - a).tobytes() + numbers[:, a:z].tobytes() + b"".join(t[own].tobytes() for t in texts)))
            yield pa.RecordBatch.from_arrays([pa.array(tid[rows[cuts]]), pa.array(stretch[cuts]), pa.array(bodies, pa.binary())], ["tid", "stretch", "body"])

    return pack


def opened(keys: list[tuple[int, int]], bodies: list[list[bytes]], keep: tuple[str, ...]) -> Bases:
    whole = zstandard.ZstdDecompressor()
    numbers, texts, group = [], [[], [], []], []
    for k, own in enumerate(bodies):
        for body in own:
            data = whole.decompress(body)
            n = int(np.frombuffer(data, np.int64, 1)[0])
            part = np.frombuffer(data, np.int64, n * (2 + len(keep)), 8).reshape(2 + len(keep), n)
            total, at = int(part[1].sum()), 8 + part.nbytes
            for i, t in enumerate(texts):
                t.append(np.frombuffer(data, np.uint8, total, at + i * total))
            numbers.append(part)
            group.append(np.full(n, k))
    numbers, group = np.concatenate(numbers, axis=1), np.concatenate(group)
    tids, stretches = (np.array(x, np.int64) for x in zip(*keys, strict=True))
    pos, sizes = numbers[:2]
    read, place = np.repeat(np.arange(len(pos)), sizes), within(sizes)
    inside = (pos - stretches[group] * WIDTH)[read] + place
    b = Bases(tids, stretches, dict(zip(("pos", *keep), (pos, *numbers[2:]), strict=True)), sizes, read, place, group[read] * WIDTH + inside, *(np.concatenate(t) for t in texts))
    ok = (inside >= 0) & (inside < WIDTH)
    return b if ok.all() else b.where(ok)


def by_stretch(reads: DataFrame, run: Callable[[Bases], dict[str, np.ndarray] | None], schema: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """run(bases) of all stretches of `reads` (tid, pos, seq, qual, ref of ASCII letters, and whole-number columns `keep`); it gives columns of `schema`.

    Reads that lack one of these are left out. A stretch comes whole, so `run` may count its positions for good.
    """
    names = [c.split()[0] for c in schema.split(", ")]
    packed = reads.select("tid", "pos", *TEXTS, *[F.col(c).cast("long") for c in keep]).mapInArrow(packer(keep), PACKED)

    def counted(keys, bodies):
        out = run(opened(keys, bodies, keep))
        if out is not None and len(out[names[0]]):
            yield pa.RecordBatch.from_arrays([x if isinstance(x, pa.Array) else pa.array(x) for x in (out[c] for c in names)], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys: list[tuple[int, int]] = []
        bodies: list[list[bytes]] = []
        held = 0
        for b in batches:
            for tid, stretch, body in zip(*(b.column(c).to_pylist() for c in ("tid", "stretch", "body")), strict=True):
                if not keys or keys[-1] != (tid, stretch):
                    if held >= AT_ONCE:
                        yield from counted(keys, bodies)
                        keys, bodies, held = [], [], 0
                    keys.append((tid, stretch))
                    bodies.append([])
                bodies[-1].append(body)
                held += zstandard.frame_content_size(body) // len(TEXTS)
        if keys:
            yield from counted(keys, bodies)

    return packed.repartition("tid", "stretch").sortWithinPartitions("tid", "stretch").mapInArrow(meet, schema)


def by_contig(pieces: DataFrame, run: Callable[[list[int], list[list[tuple[int, bytes]]]], dict[str, np.ndarray] | None], schema: str) -> DataFrame:
    """run(tids, their (stretch, body) in order) of some contigs at once, from `pieces` (tid, stretch, body) of by_stretch()."""
    names = [c.split()[0] for c in schema.split(", ")]

    def counted(tids, parts):
        out = run(tids, parts)
        if out is not None and len(out["tid"]):
            yield pa.RecordBatch.from_arrays([pa.array(out[c]) for c in names], names)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tids: list[int] = []
        parts: list[list[tuple[int, bytes]]] = []
        held = 0
        for b in batches:
            for tid, stretch, body in zip(*(b.column(c).to_pylist() for c in ("tid", "stretch", "body")), strict=True):
                if not tids or tids[-1] != tid:
                    if held >= AT_ONCE:
                        yield from counted(tids, parts)
                        tids, parts, held = [], [], 0
                    tids.append(tid)
                    parts.append([])
                parts[-1].append((stretch, body))
                held += len(body)
        if tids:
            yield from counted(tids, parts)

    return pieces.repartition("tid").sortWithinPartitions("tid", "stretch").mapInArrow(meet, schema)
