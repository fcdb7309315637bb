"""Functions of alignment operation strings (such as 5S40M2D10M), as built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The operations that use up bases of the read, and positions of the reference.
ON_READ = "MIS=X"
ON_REFERENCE = "MDN=X"
EACH = "([0-9]+)([MIDNSHP=XB])"


def operations(cigar: Column) -> Column:
    """Array of (size, op); `*`, empty and null have none."""
    sizes = F.transform(F.regexp_extract_all(cigar, F.lit(EACH), F.lit(1)), lambda x: x.cast("int"))
    ops = F.regexp_extract_all(cigar, F.lit(EACH), F.lit(2))
    return F.coalesce(F.arrays_zip(sizes.alias("size"), ops.alias("op")), F.expr("cast(array() as array<struct<size:int,op:string>>)"))


def used(op: Column, size: Column, by: str) -> Column:
    return F.when(op.isin(*by), size).otherwise(0)


def total(ops: Column, by: str) -> Column:
    """Sum of the sizes of the operations in `by`."""
    return F.aggregate(ops, F.lit(0), lambda a, o: a + used(o["op"], o["size"], by))


def resolved(ops: Column, pos: Column, on_reference: str = ON_REFERENCE) -> Column:
    """Array of (op, size, query_from, ref_from): where in the read and on the reference each operation begins.

    `on_reference` names what moves along the reference; some callers count clipped bases as well.
    """
    empty = F.expr("cast(array() as array<struct<op:string,size:int,query_from:int,ref_from:int>>)")

    def step(a: Column, o: Column) -> Column:
        row = F.struct(o["op"].alias("op"), o["size"].alias("size"), a["q"].alias("query_from"), a["r"].alias("ref_from"))
        q, r = a["q"] + used(o["op"], o["size"], ON_READ), a["r"] + used(o["op"], o["size"], on_reference)
        return F.struct(q.alias("q"), r.alias("r"), F.concat(a["out"], F.array(row)).alias("out"))

    return F.aggregate(ops, F.struct(F.lit(0).alias("q"), pos.cast("int").alias("r"), empty.alias("out")), step)["out"]


def positions(ops: Column, pos: Column) -> Column:
    """The reference position of each base of a read: -1 for inserted and clipped ones."""
    parts = F.filter(resolved(ops, pos), lambda o: o["op"].isin(*ON_READ) & (o["size"] > 0))
    place = lambda o: F.when(o["op"].isin("I", "S"), F.array_repeat(F.lit(-1), o["size"])).otherwise(F.sequence(o["ref_from"], o["ref_from"] + o["size"] - 1))
    return F.flatten(F.transform(parts, place))


def clip(ops: Column, at: int) -> Column:
    """Size of the soft clip that is the first (at=1) or last (at=-1) operation, else 0."""
    o = F.try_element_at(ops, F.lit(at))
    return F.coalesce(F.when(o["op"] == "S", o["size"]), F.lit(0))
