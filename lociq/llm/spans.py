"""Positions of regular-expression matches as native expressions.

A span is a struct (start, end, match, before, after): code-point offsets, end exclusive, and the text between the
previous match, this one and the next one. Patterns passed in should use possessive quantifiers, so that the regular
expression engine neither backtracks over long runs nor recurses on them.

Folds that append to an array copy it at each step, so long arrays are folded in chunks: within a chunk the array
is short, and over the chunks there are few steps.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,match:string,before:string,after:string>"
EMPTY = f"cast(array() as array<{SPAN}>)"
#: Elements that are folded at once.
CHUNK = 256


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), with `value` computed once however often `use` names it."""
    return F.element_at(F.transform(F.array(value), use), 1)


def chunks(rows: Column) -> Column:
    """`rows` in arrays of CHUNK elements, the last shorter; none of an empty array. `rows` should be bound."""
    last = F.floor((F.size(rows) - 1) / CHUNK).cast("int")
    return F.transform(F.when(F.size(rows) > 0, F.sequence(F.lit(0), last)).otherwise(F.expr("cast(array() as array<int>)")), lambda i: F.slice(rows, i * CHUNK + 1, CHUNK))


def find_spans(text: Column, pattern: str, unless_absent: str | None = None) -> Column:
    """Leftmost non-overlapping matches of `pattern` in `text` (not null), in order.

    `split` and `regexp_extract_all` walk the same matches, so the lengths of gaps and matches add up to
    positions. `unless_absent` names a string without which nothing can match; texts lacking it are skipped.
    """
    matches = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.split(text, pattern, -1)

    def step(acc: Column, p: Column) -> Column:
        start = acc["at"] + F.length(p["g"])
        return bound(
            F.struct(start.alias("s"), (start + F.length(p["m"])).alias("e")),
            lambda x: F.struct(
                x["e"].alias("at"),
                F.concat(acc["out"], F.array(F.struct(x["s"].alias("start"), x["e"].alias("end"), p["m"].alias("match"), p["g"].alias("before"), p["n"].alias("after")))).alias("out"),
            ),
        )

    def chunk(acc: Column, part: Column) -> Column:
        own = F.aggregate(part, F.struct(acc["at"].alias("at"), F.expr(EMPTY).alias("out")), step)
        return bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(x["out"])).alias("out")))

    def placed(parts: Column) -> Column:
        start = F.struct(F.lit(0).alias("at"), F.expr(f"cast(array() as array<array<{SPAN}>>)").alias("out"))
        return F.flatten(F.aggregate(chunks(parts), start, chunk)["out"])

    def zipped(g: Column) -> Column:
        following = F.slice(g, F.lit(2), F.greatest(F.size(g) - 1, F.lit(0)))
        return F.filter(F.arrays_zip(matches.alias("m"), g.alias("g"), following.alias("n")), lambda p: p["m"].isNotNull())

    found = bound(bound(gaps, zipped), placed)
    if unless_absent is None:
        return found
    return F.when(F.contains(text, F.lit(unless_absent)), found).otherwise(F.expr(EMPTY))


def ranked(spans: Column, rank: int, kind: str) -> Column:
    """Spans as structs that sort by start, then by the rank of their kind."""
    return F.transform(
        spans,
        lambda s: F.struct(s["start"].alias("start"), F.lit(rank).alias("rank"), s["end"].alias("end"), F.lit(kind).alias("kind")),
    )


def listed(kinds: list[tuple[str, Column]]) -> Column:
    """kind:start:end of all spans, by start, then kind in the order given, joined by commas."""
    rows = [ranked(spans, rank, kind) for rank, (kind, spans) in enumerate(kinds)]
    ordered = F.array_sort(F.concat(*rows))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def replaced(text: Column, rows: Column) -> Column:
    """`text` with the places of `rows` (start, kind, end, in order) replaced by their kind in angle brackets.

    Overlapping ones are replaced together, under the kind that begins first. A chunk works on the part of the text
    that it covers, so a long text isn't counted through for each place.
    """
    none = F.expr("cast(array() as array<string>)")

    def chunk(acc: Column, part: Column) -> Column:
        reach = F.greatest(acc["at"], F.array_max(F.transform(part, lambda s: s["end"])))

        def within(own: Column) -> Column:
            def step(a: Column, s: Column) -> Column:
                gap = own.substr(a["at"] - acc["at"] + 1, s["start"] - a["at"])
                return F.when(
                    s["start"] >= a["at"],
                    F.struct(s["end"].alias("at"), F.concat(a["out"], F.array(gap, F.concat(F.lit("<"), s["kind"], F.lit(">")))).alias("out")),
                ).otherwise(F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["out"].alias("out")))

            return F.aggregate(part, F.struct(acc["at"].alias("at"), none.alias("out")), step)

        own = bound(text.substr(acc["at"] + 1, reach - acc["at"]), within)
        return bound(own, lambda x: F.struct(x["at"].alias("at"), F.concat(acc["out"], F.array(F.array_join(x["out"], ""))).alias("out")))

    return F.aggregate(
        chunks(rows), F.struct(F.lit(0).alias("at"), none.alias("out")), chunk,
        lambda acc: F.concat(F.array_join(acc["out"], ""), text.substr(acc["at"] + 1, F.length(text))),
    )
