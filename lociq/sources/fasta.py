"""Reference sequences in FASTA text: records, their index, and parts of sequences by name and place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """Records (column value, without the leading >) of FASTA files; files are cut at the records' marks, not read whole."""
    return spark.read.option("lineSep", ">").text(path).where(F.trim("value") != "")


def parse(records: DataFrame) -> DataFrame:
    """name, seq, line_bases, line_width: the first word of each record's header, all letters, and the length of a full line without and with its end."""
    lines = F.split("value", "\n")
    rest = F.slice(lines, F.lit(2), F.greatest(F.size(lines) - 1, F.lit(0)))
    bare = F.transform(rest, lambda x: F.replace(x, F.lit("\r"), F.lit("")))
    first = F.length(F.coalesce(F.get(bare, F.lit(0)), F.lit("")))
    return records.select(
        F.regexp_extract("value", r"^(\S*)", 1).alias("name"), F.array_join(bare, "").alias("seq"), first.alias("line_bases"),
        (F.length(F.coalesce(F.get(rest, F.lit(0)), F.lit(""))) + 1).alias("line_width"),
    )


def folded(seq: Column, width: int = 60) -> Column:
    return F.array_join(F.regexp_extract_all(seq, F.lit(f".{{1,{width}}}"), F.lit(0)), "\n")


def write_records(contigs: DataFrame, width: int = 60) -> DataFrame:
    """Records as read_records() gives them, from name and seq."""
    return contigs.select(F.concat(F.col("name"), F.lit("\n"), folded(F.col("seq"), width), F.lit("\n")).alias("value"))


def fetch(contigs: DataFrame, regions: DataFrame) -> DataFrame:
    """`regions` (name, beg, fin; 0-based, half open) with their bases; a name that isn't there is looked up with or without chr."""
    other = lambda n: F.when(n.startswith("chr"), F.substring(n, 4, 1 << 30)).otherwise(F.concat(F.lit("chr"), n))
    names = contigs.select(F.col("name").alias("known"))
    keys = regions.select("name").distinct()
    exact = keys.join(names, keys["name"] == names["known"], "left").select("name", "known")
    turned = exact.where("known is null").select("name", other(F.col("name")).alias("known"))
    named = exact.where("known is not null").unionByName(turned)
    met = regions.join(named, "name").join(contigs.select(F.col("name").alias("known"), "seq"), "known")
    return met.select("name", "beg", "fin", F.col("seq").substr(F.col("beg") + 1, F.col("fin") - F.col("beg")).alias("bases"))
