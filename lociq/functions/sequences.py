"""Functions of nucleotide strings."""

from __future__ import annotations

import re

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


def reverse_complement(seq: Column) -> Column:
    return F.reverse(F.translate(seq, "ACGT", "TGCA"))


def gc(seq: Column) -> Column:
    return F.length(F.regexp_replace(seq, "[^GC]", ""))


def n_runs(seq: Column) -> Column:
    """Array of (beg, end) of the runs of N, 0-based and half open, from the lengths of what stands between them."""
    runs, gaps = F.regexp_extract_all(seq, F.lit("N+"), F.lit(0)), F.split(seq, "N+", -1)
    parts = F.filter(F.arrays_zip(runs.alias("r"), gaps.alias("g")), lambda p: p["r"].isNotNull())
    return F.aggregate(
        parts,
        F.struct(F.lit(0).alias("at"), F.expr("cast(array() as array<struct<beg:int,end:int>>)").alias("out")),
        lambda a, p: F.struct(
            (a["at"] + F.length(p["g"]) + F.length(p["r"])).alias("at"),
            F.concat(a["out"], F.array(F.struct((a["at"] + F.length(p["g"])).alias("beg"), (a["at"] + F.length(p["g"]) + F.length(p["r"])).alias("end")))).alias("out"),
        ),
    )["out"]


#: Places at an overlap's start that are compared for all lengths together.
SCREEN = 24


def best_overlap(a: str, b: str, least: int, errors: int) -> tuple[int, int]:
    """Length and mismatches of the overlap of a's end with b's start that has the lowest error rate (0, -1: none).

    Starts run from short overlaps (more than `least`) to long ones; of equal rates the shorter one stays, and an
    exact overlap ends the search.
    """
    x, y = np.frombuffer(a.encode("latin-1", "replace"), np.uint8), np.frombuffer(b.encode("latin-1", "replace"), np.uint8)
    best, rate = (0, -1), None
    lengths = np.arange(least + 1, min(len(x), len(y)) + 1)
    errs = np.zeros(len(lengths), np.int64)
    for k in range(SCREEN):  # all starts at once; few come through the first places
        if not len(lengths):
            break
        errs += (lengths > k) & (x[np.minimum(len(x) - lengths + k, len(x) - 1)] != y[min(k, len(y) - 1)])
        lengths, errs = lengths[errs <= errors], errs[errs <= errors]
    for n in lengths.tolist():
        wrong = int((x[len(x) - n :] != y[:n]).sum())
        if wrong <= errors and (rate is None or wrong / n < rate):
            best, rate = (n, wrong), wrong / n
            if wrong == 0:
                break
    return best


RUNS = T.ArrayType(T.StructType([T.StructField("beg", T.IntegerType()), T.StructField("end", T.IntegerType())]))


def n_runs_of(column: str) -> Column:
    """As n_runs, in time linear in the length."""

    @pandas_udf(RUNS)
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda t: None if t is None else [{"beg": m.start(), "end": m.end()} for m in re.finditer("N+", t)])

    return run(column)


OVERLAP = T.StructType([T.StructField("length", T.IntegerType()), T.StructField("mismatches", T.IntegerType())])


def overlap_of(*columns: str) -> Column:
    @pandas_udf(OVERLAP)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([best_overlap(x, y, 10, 2) for x, y in zip(a, b, strict=True)], columns=["length", "mismatches"])

    return run(*columns)


def tandem_length(s: str, longest: int = 5, errors: int = 1) -> int:
    """Length of the longest repetition of a unit of up to `longest` characters, the unit itself not counted.

    The units that follow may differ from the first one in up to `errors` characters altogether. The string's last
    character isn't reached by a unit.
    """
    best, x = 0, np.frombuffer(s.encode("latin-1", "replace"), np.uint8)
    for k in range(1, longest + 1):
        at = np.arange(max(0, len(x) - 2 * k))  # starts with room for one unit more
        wrong, m = np.zeros(len(at), np.int64), 0
        while len(at):
            m += 1
            for d in range(k):
                wrong += x[at + d] != x[at + m * k + d]
            at, wrong = at[wrong <= errors], wrong[wrong <= errors]
            best = max(best, m * k) if len(at) else best
            room = at + (m + 2) * k < len(x)
            at, wrong = at[room], wrong[room]
    return best


def tandem_of(column: str) -> Column:
    @pandas_udf(T.IntegerType())
    def run(s: pd.Series) -> pd.Series:
        return s.map(tandem_length)

    return run(column)


def common_substring(a: str, b: str) -> tuple[int, int, int]:
    """Length of the longest string that both hold, and where it first begins in each (0, 0, 0: none)."""
    return tuple(common_substrings([a], [b])[0].tolist())


def letter_table(texts: list[str], other: int) -> np.ndarray:
    """A row of code points for each text, filled up with `other`."""
    sizes = np.array([len(t) for t in texts])
    out = np.full((len(texts), max(1, sizes.max(initial=0))), other, np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out


def common_substrings(a: list[str], b: list[str], at_once: int = 1 << 18) -> np.ndarray:
    """As common_substring() for each pair, pairs of like lengths side by side; about `at_once` letters at a time."""
    out = np.zeros((len(a), 3), np.int64)
    order = sorted(range(len(a)), key=lambda i: max(len(a[i]), len(b[i])))
    while order:
        longest = max(1, len(a[order[-1]]), len(b[order[-1]]))
        own = order[-max(1, at_once // longest) :]
        del order[-len(own) :]
        x, y = letter_table([a[i] for i in own], -1), letter_table([b[i] for i in own], -2)
        best, run = np.zeros((len(own), 3), np.int64), np.zeros((len(own), y.shape[1] + 1), np.int32)
        for i in range(x.shape[1]):
            new = run[:, :-1] + 1
            new[y != x[:, i : i + 1]] = 0
            run[:, 1:] = new
            j = run.argmax(axis=1)
            n = run[np.arange(len(own)), j]
            more = np.flatnonzero(n > best[:, 0])
            best[more] = np.stack([n, i + 1 - n, j - n], axis=1)[more]
        out[own] = best
    return out


COMMON = T.StructType([T.StructField(n, T.IntegerType()) for n in ("length", "at", "other_at")])


def common_of(*columns: str | Column) -> Column:
    @pandas_udf(COMMON)
    def run(a: pd.Series, b: pd.Series) -> pd.DataFrame:
        return pd.DataFrame(common_substrings(a.tolist(), b.tolist()), columns=["length", "at", "other_at"])

    return run(*columns)


def same_run(x: np.ndarray, y: np.ndarray, step: int = 64) -> int:
    """How many values agree from the start of both on."""
    n, at = min(len(x), len(y)), 0
    while at < n:
        wrong = np.flatnonzero(x[at : min(n, at + step)] != y[at : min(n, at + step)])
        if len(wrong):
            return at + int(wrong[0])
        at, step = min(n, at + step), step * 2
    return n


def displacement(seq: str, f2: int, r1: int) -> tuple[int, int]:
    """How far the break points f2 and r1 can move together along `seq`, to the right and to the left, the joined text being the same."""
    x = np.frombuffer(seq.encode("latin-1", "replace"), np.uint8)
    if not (0 < f2 < len(x) and 0 < r1 < len(x)):
        return 0, 0
    return same_run(x[f2 + 1 :], x[r1:]), same_run(x[1 : f2 + 1][::-1], x[1:r1][::-1])
