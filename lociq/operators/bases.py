"""Bases of aligned reads (tid, pos, seq, qual, flag, mapq, and `ref`, the reference under the read), position by position.

Reads here match their reference without gaps over their whole length; see functions/cigar.py for the operations of others.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions import statistics as st
from lociq.operators.reads import bit
from lociq.operators.stretches import PACKED, WIDTH, Bases, by_contig, by_stretch

LETTERS, N, REVERSE = "ACGT", ord("N"), 16


def letters(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def phred(c: Column) -> Column:
    return F.ascii(c) - 33


def exploded(reads: DataFrame, *keep: str) -> DataFrame:
    """A row for each base: tid, site, base, q, ref_base, place (in the read, from 0), reverse, and the columns `keep`."""
    parts = F.arrays_zip(letters(F.col("seq")).alias("base"), letters(F.col("qual")).alias("q"), letters(F.col("ref")).alias("ref_base"))
    rows = reads.select("tid", "pos", bit("flag", 16).alias("reverse"), *keep, F.posexplode(parts).alias("place", "b"))
    return rows.select("tid", (F.col("pos") + F.col("place")).alias("site"), "b.base", phred(F.col("b.q")).alias("q"), "b.ref_base", "place", "reverse", *keep)


def mismatch_tags(seq: Column, ref: Column) -> tuple[Column, Column]:
    """Number of mismatches, and the text of matched stretches and the reference's letters between them; N never matches."""
    pairs = F.zip_with(letters(seq), letters(ref), lambda s, r: F.when((s == r) & (s != "N"), F.lit("=")).otherwise(r))
    marks = F.array_join(pairs, "")
    runs = F.transform(F.split(marks, "[^=]"), lambda r: F.length(r).cast("string"))
    at = F.concat(F.filter(letters(marks), lambda c: c != "="), F.array(F.lit("")))
    return F.size(F.filter(pairs, lambda c: c != "=")), F.array_join(F.zip_with(runs, at, lambda n, c: F.concat(n, c)), "")


def capped_quality(seq: Column, qual: Column, ref: Column, most: int = 40) -> Column:
    """Mapping quality that a read's mismatches of good bases allow, `most` at best; -1 where they allow none.

    The length counts matched bases of good quality and, once more, all bases of the alignment.
    """
    good = F.filter(F.arrays_zip(letters(seq).alias("s"), phred_list(qual).alias("q"), letters(ref).alias("r")), lambda x: (x["s"] != "N") & (x["r"] != "N") & (x["q"] >= 13))
    wrong = F.filter(good, lambda x: x["s"] != x["r"])
    size = (F.size(good) + F.length(seq)).cast("double")
    ways = F.aggregate(F.transform(wrong, lambda x, i: F.log(size / (i + 1))), F.lit(0.0), lambda a, x: a + x)
    cost = F.aggregate(wrong, F.lit(0), lambda a, x: a + F.least(x["q"], F.lit(33))) - 4.343 * ways
    t = F.greatest(F.lit(0.0), cost)
    return F.when(cost > most, -1).otherwise(F.floor(F.sqrt((most - t) / most) * most + 0.499)).cast("int")


def phred_list(qual: Column) -> Column:
    return F.transform(letters(qual), phred)


def pileup_text(reads: DataFrame) -> DataFrame:
    """tid, site, n, bases, quals: each position's column of reads in order of start and id.

    A match is . or , by strand, another base its letter; ^ and the quality's letter open a read, $ closes it.
    """

    def run(b: Bases):
        order = np.lexsort((b.own("read_id"), b.own("pos"), b.slot))
        b = b.where(order)
        new = np.flatnonzero(np.diff(b.slot, prepend=-1))
        back = (b.own("flag") & REVERSE) != 0
        same = (b.seq == b.ref) & (b.seq != N) & (b.seq != 0)
        lower = np.where((b.seq >= 65) & (b.seq <= 90), b.seq + 32, b.seq)
        letter = np.where(same, np.where(back, ord(","), ord(".")), np.where(back, lower, b.seq))
        known = b.seq != 0
        opens, closes = known & (b.place == 0), known & (b.place == b.own("l_qseq") - 1)
        sizes = known + 2 * opens + closes
        ends = np.cumsum(sizes)
        text = np.zeros(ends[-1] if len(ends) else 0, np.uint8)
        starts = ends - sizes
        text[starts[opens]] = ord("^")
        text[starts[opens] + 1] = np.minimum(b.own("mapq")[opens], 93) + 33
        text[(starts + 2 * opens)[known]] = letter[known]
        text[ends[closes] - 1] = ord("$")
        fits = b.qual != 0
        return b.places(b.slot[new]) | {
            "n": np.diff(np.append(new, len(b.slot))).astype(np.int32), "bases": texts_of(text, np.append(starts[new], ends[-1:])),
            "quals": texts_of(b.qual[fits], np.append(np.cumsum(fits)[new] - fits[new], fits.sum())),
        }

    return by_stretch(reads, run, "tid long, site int, n int, bases string, quals string", ("read_id", "flag", "mapq", "l_qseq"))


def texts_of(data: np.ndarray, edges: np.ndarray) -> pa.Array:
    return pa.StringArray.from_buffers(len(edges) - 1, pa.py_buffer(edges.astype(np.int32).tobytes()), pa.py_buffer(data.tobytes()))


def strand_sums(reads: DataFrame, least_q: int = 13, cap: int = 60, varying: bool = False) -> DataFrame:
    """tid, site and sixteen sums over the bases of a position: counts by (alternative or not) x strand, then for quality,
    mapping quality and distance from the read's end, of either kind, the sum and the sum of squares.

    `varying` leaves out positions without alternatives.
    """

    def run(b: Bases):
        b = b.where(b.q >= least_q)
        known = (b.seq != 0) & (b.ref != 0)
        diff = (b.seq == N) | (known & (b.seq != b.ref))
        sites = np.flatnonzero(np.bincount(b.slot[diff] if varying else b.slot, minlength=b.size))
        kind = 2 * b.slot + diff
        back = (b.own("flag") & REVERSE) != 0
        sure = known | diff
        if not sure.all():
            kind, back, b = kind[sure], back[sure], b.where(sure)
        counts = np.bincount(2 * kind + back, minlength=4 * b.size).reshape(-1, 4)[sites]
        out = {f"i{k}": counts[:, k] for k in range(4)}
        q = b.q.astype(float)
        mq = np.minimum(b.own("mapq"), cap).astype(float)
        end = np.minimum(np.minimum(b.place, b.own("l_qseq") - 1 - b.place), 25).astype(float)
        for k, v in enumerate((q, mq, end), 1):
            for sq, w in enumerate((v, v * v)):
                total = np.bincount(kind, w, minlength=2 * b.size).reshape(-1, 2)[sites].astype(np.int64)
                out |= {f"i{4 * k + 2 * d + sq}": total[:, d] for d in (0, 1)}
        return b.places(sites) | out

    return by_stretch(reads, run, "tid long, site int, " + ", ".join(f"i{k} long" for k in range(16)), ("flag", "mapq", "l_qseq"))


def bias_tests(sums: DataFrame) -> DataFrame:
    """tid, site, strand_p, quality_p, mapping_p, end_p of rows of strand_sums(), by Fisher's exact test and one-sided t-tests."""

    def run(batches):
        for b in batches:
            rows = b[[f"i{k}" for k in range(16)]].to_numpy()
            ps = [[st.fisher(*map(int, r[:4])), *(st.mean_drop(int(r[0] + r[1]), int(r[2] + r[3]), *map(float, r[4 * k : 4 * k + 4])) for k in (1, 2, 3))] for r in rows]
            yield pd.concat([b[["tid", "site"]].reset_index(drop=True), pd.DataFrame(ps, columns=["strand_p", "quality_p", "mapping_p", "end_p"])], axis=1)

    return sums.mapInPandas(run, "tid long, site int, strand_p double, quality_p double, mapping_p double, end_p double")


def genotype_costs(reads: DataFrame, least_q: int = 13, most: int = 255, varying: bool = True) -> DataFrame:
    """tid, site, sample_no, ref_base, pl (Phred-scaled costs of AA, AC, ..., TT less the least, 255 at most) and depth.

    Bases of a position are counted by quality, strand and letter before they meet, so that a deep position's array is
    short; beyond `most` bases the best ones are taken. `varying` leaves out sites where all bases are the reference's.
    """
    tails: dict = {}
    known: dict = {}

    def tail_costs(q, n):
        if (q, n) not in tails:
            tails[q, n] = st.tail_costs(q, n)
        return tails[q, n]

    def costs_of(cells: bytes) -> list[int]:
        """Costs from rows of quality, strand, letter and number, the worst first."""
        if cells not in known:
            if len(known) >= 1 << 16:
                known.clear()
            q, strand, letter, n = np.frombuffer(cells, np.int64).reshape(4, -1)[:, ::-1]
            bases = np.repeat(np.stack([q, strand, letter], axis=1), np.minimum(n, most), axis=0)[:most]
            c = st.base_costs(bases, tail_costs, 4)
            own = np.array([c[j, k] for j in range(4) for k in range(j, 4)])
            known[cells] = np.minimum(255, (own - own.min() + 0.499).astype(int)).tolist()
        return known[cells]

    code = np.full(256, -1, np.int64)
    code[[ord(c) for c in LETTERS]] = range(4)

    def run(b: Bases):
        b = b.where((b.q >= least_q) & (b.seq != N) & (b.seq != 0) & (b.ref != 0))
        if varying:
            b = b.where((np.bincount(b.slot[b.seq != b.ref], minlength=b.size) > 0)[b.slot])
        if not len(b.slot):
            return None
        letter = code[b.seq]
        if (letter < 0).any():
            raise ValueError("bases are A, C, G, T or N")
        # Cells in order of position, reference letter and sample, then of quality, strand and letter.
        q = np.clip(np.minimum(b.q, b.own("mapq")), 4, 63)
        samples, sample = np.unique(b.own("sample_no"), return_inverse=True)
        group = (b.slot * 256 + b.ref) * len(samples) + sample
        cells, n = np.unique(group * 512 + q * 8 + ((b.own("flag") & REVERSE) != 0) * 4 + letter, return_counts=True)
        group, cell = cells // 512, cells % 512
        new = np.flatnonzero(np.diff(group, prepend=-1))
        table = np.stack([cell // 8, cell // 4 % 2, cell % 4, n])
        pl = [costs_of(table[:, a:z].tobytes()) for a, z in zip(new.tolist(), [*new[1:].tolist(), len(cells)], strict=True)]
        group = group[new]
        ref = np.array([chr(c) for c in range(256)], object)[group // len(samples) % 256]
        return b.places(group // len(samples) // 256) | {
            "sample_no": samples[group % len(samples)].astype(np.int32), "ref_base": ref, "pl": pa.array(pl, pa.list_(pa.int32())), "depth": np.add.reduceat(n, new),
        }

    return by_stretch(reads, run, "tid long, site int, sample_no int, ref_base string, depth long, pl array<int>", ("flag", "mapq", "sample_no"))


def commonest(b: Bases, least_q: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Slots with good bases, how many, the commonest letter of each (the first of equals), and how many are that."""
    b = b.where((b.q >= least_q) & (b.seq != N) & (b.seq != 0))
    seen = np.flatnonzero(np.bincount(b.seq, minlength=256))
    kinds = np.array(sorted(seen.tolist(), key=lambda c: (LETTERS.find(chr(c)), c)), np.uint8)
    if not len(kinds):
        return (np.empty(0, np.int64),) * 4
    counts = np.stack([np.bincount(b.slot[b.seq == c], minlength=b.size) for c in kinds])
    depth = counts.sum(axis=0)
    sites = np.flatnonzero(depth)
    counts = counts[:, sites]
    return sites, depth[sites], kinds[counts.argmax(axis=0)], counts.max(axis=0)


def majority(reads: DataFrame, least_q: int = 13) -> DataFrame:
    """tid, site, depth, base, share: the commonest letter of each position (the first of equals) and how many bases have it."""

    def run(b: Bases):
        sites, depth, base, share = commonest(b, least_q)
        return b.places(sites) | {"depth": depth, "base": texts_of(base.astype(np.uint8), np.arange(len(sites) + 1)), "share": share} if len(sites) else None

    return by_stretch(reads, run, "tid long, site int, depth long, base string, share long")


def consensus(reads: DataFrame, least_q: int = 13, least_depth: int = 2) -> DataFrame:
    """tid, beg, seq: each contig's called letters from its first to its last site; n where there is none, lower case below `least_depth`.

    Stretches are written where their bases are counted; a contig's group joins the pieces.
    """

    def run(b: Bases):
        sites, depth, base, _ = commonest(b, least_q)
        if not len(sites):
            return None
        line = np.full(b.size, ord("n"), np.uint8)
        line[sites] = np.where((depth < least_depth) & (base >= 65) & (base <= 90), base + 32, base)
        group, first = np.unique(sites // WIDTH, return_index=True)
        last = np.append(first[1:], len(sites)) - 1
        where = b.places(sites)["site"]
        return {"tid": b.tids[group], "beg": where[first], "fin": where[last], "piece": [line[a : z + 1].tobytes().decode("latin-1") for a, z in zip(sites[first], sites[last], strict=True)]}

    pieces = by_stretch(reads, run, "tid long, beg int, fin int, piece string")
    parts = pieces.groupBy("tid").agg(F.array_sort(F.collect_list(F.struct("beg", "fin", "piece"))).alias("p"))
    gap = lambda x, i: F.when(i > 0, F.repeat(F.lit("n"), x["beg"] - F.get("p.fin", i - 1) - 1)).otherwise("")
    return parts.select("tid", F.element_at("p.beg", 1).alias("beg"), F.array_join(F.transform("p", lambda x, i: F.concat(gap(x, i), x["piece"])), "").alias("seq"))


SEGMENTS = "tid long, beg int, fin int"


def segments(tids: list[int], beg: list[np.ndarray], fin: list[np.ndarray]) -> dict[str, np.ndarray]:
    return {"tid": np.repeat(np.array(tids, np.int64), [len(x) for x in beg]), "beg": np.concatenate(beg).astype(np.int32), "fin": np.concatenate(fin).astype(np.int32)}


def mismatch_masks(reads: DataFrame, gain: int = 40, least: int = 45) -> DataFrame:
    """tid, beg, fin (inclusive): stretches in which reads keep differing from the contig. Each differing base gains `gain`, each covered position costs 1.

    Only positions where a read differs go on, with their rank among the covered ones.
    """

    def run(b: Bases):
        covered = (np.bincount(b.slot, minlength=b.size) > 0).reshape(-1, WIDTH)
        ranks = (np.cumsum(covered, axis=1) - 1).ravel()
        wrong = np.bincount(b.slot[(b.seq != b.ref) & (b.seq != 0) & (b.ref != 0)], minlength=b.size)
        sites = np.flatnonzero(wrong)
        table = np.stack([b.places(sites)["site"], ranks[sites], wrong[sites]]).astype(np.int32)
        edges = np.searchsorted(sites // WIDTH, np.arange(len(b.tids) + 1))
        n = covered.sum(axis=1).astype(np.int32)
        return {"tid": b.tids, "stretch": b.stretches, "body": pa.array([n[k].tobytes() + table[:, a:z].tobytes() for k, (a, z) in enumerate(zip(edges, edges[1:], strict=False))], pa.binary())}

    def fold(tids, parts):
        beg, fin = [], []
        for own in parts:
            n, tables = 0, []
            for _, body in own:
                t = np.frombuffer(body, np.int32, offset=4).reshape(3, -1).astype(np.int64)
                t[1] += n
                n += int(np.frombuffer(body, np.int32, 1)[0])
                tables.append(t)
            site, rank, wrong = np.concatenate(tables, axis=1)
            found = np.array(st.sparse_segments(rank, gain * wrong - 1, n, least), np.int64).reshape(-1, 2)
            at = np.searchsorted(rank, found)
            beg.append(site[at[:, 0]])
            fin.append(site[at[:, 1]])
        return segments(tids, beg, fin)

    return by_contig(by_stretch(reads, run, PACKED), fold, SEGMENTS)


def target_segments(reads: DataFrame, least_q: int = 13) -> DataFrame:
    """tid, beg, fin (not inclusive): stretches that a two-state chain takes for covered, from good bases at each position."""

    def run(b: Bases):
        sites, depth, _, share = commonest(b, least_q)
        if not len(sites):
            return None
        line = np.zeros(b.size, np.uint8)
        line[sites] = np.where(share * 2 > depth, 2, 1)
        group, first = np.unique(sites // WIDTH, return_index=True)
        last = sites[np.append(first[1:], len(sites)) - 1]
        return {"tid": b.tids[group], "stretch": b.stretches[group], "body": pa.array([line[g * WIDTH : z + 1].tobytes() for g, z in zip(group, last, strict=True)], pa.binary())}

    def fold(tids, parts):
        lines = []
        for own in parts:
            line = np.zeros(own[-1][0] * WIDTH + len(own[-1][1]), np.uint8)
            for stretch, body in own:
                line[stretch * WIDTH : stretch * WIDTH + len(body)] = np.frombuffer(body, np.uint8)
            lines.append(line)
        paths = st.two_states_of(lines, np.array([[0, 0, 0], [-4, 1, 2]]), np.array([[0, -20], [-10, 0]]))
        edges = [np.flatnonzero(np.diff(np.concatenate([[0], p, [0]]))) for p in paths]
        return segments(tids, [e[::2] for e in edges], [e[1::2] for e in edges])

    return by_contig(by_stretch(reads, run, PACKED), fold, SEGMENTS)
