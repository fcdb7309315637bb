"""Readers and writers of tab-separated text: alignments, intervals and variants, as expressions over lines."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# The columns of an alignment line and of a variant line.
ALIGNED = ("qname", "flag", "rname", "pos", "mapq", "cigar", "rnext", "pnext", "tlen", "seq", "qual")
NUMBERS = ("flag", "pos", "mapq", "pnext", "tlen")
VARIANT = ("chrom", "pos", "id", "ref", "alt", "qual", "filter", "info", "format")


def parse_alignments(lines: DataFrame) -> DataFrame:
    """Alignment lines (column value) as columns; pos and pnext become 0-based, `*` null, tags a map by name.

    Header lines and lines of fewer than 11 fields are left out.
    """
    cells = F.split("value", "\t")
    cols = {c: F.nullif(cells[i], F.lit("*")) for i, c in enumerate(ALIGNED)}
    typed = {c: cols[c].try_cast("int") - (1 if c in ("pos", "pnext") else 0) if c in NUMBERS else cols[c] for c in ALIGNED}
    tags = F.map_from_entries(F.transform(F.slice(cells, 12, F.greatest(F.size(cells) - 11, F.lit(0))), lambda t: F.struct(F.substring(t, 1, 2), F.struct(F.substring(t, 4, 1).alias("type"), F.substring(t, 6, 1 << 30).alias("value")))))
    kept = lines.where(~F.col("value").startswith("@") & (F.size(cells) >= len(ALIGNED)))
    return kept.select(*[v.alias(c) for c, v in typed.items()], tags.alias("tags"))


def format_alignments(reads: DataFrame) -> DataFrame:
    """Lines (column value) of rows with the columns of parse_alignments but for tags."""
    cells = [F.coalesce((F.col(c) + (1 if c in ("pos", "pnext") else 0)).cast("string"), F.lit("0")) if c in NUMBERS else F.coalesce(c, F.lit("*")) for c in ALIGNED]
    return reads.select(F.concat_ws("\t", *cells).alias("value"))


def parse_intervals(lines: DataFrame) -> DataFrame:
    """chrom, beg, fin (0-based, half open) of lines with two or three fields; a single position p is [p - 1, p)."""
    cells = F.split(F.trim("value"), r"\s+")
    first, second = cells[1].try_cast("int"), F.get(cells, F.lit(2)).try_cast("int")
    rows = lines.where(~F.col("value").rlike(r"^\s*(#|track|browser|$)") & (F.size(cells) >= 2))
    return rows.select(cells[0].alias("chrom"), F.when(second.isNull(), first - 1).otherwise(first).alias("beg"), F.coalesce(second, first).alias("fin"))


def parse_variants(lines: DataFrame) -> DataFrame:
    """The nine fixed columns of variant lines, info as a map, and `cells`, the samples' texts in order."""
    cells = F.split("value", "\t")
    cols = {c: F.nullif(F.get(cells, F.lit(i)), F.lit(".")) for i, c in enumerate(VARIANT)}
    cols |= {"pos": cols["pos"].try_cast("int"), "qual": cols["qual"].try_cast("double"), "info": F.expr("str_to_map(nullif(get(split(value, '\t'), 7), '.'), ';', '=')")}
    kept = lines.where(~F.col("value").startswith("#") & (F.size(cells) >= 8))
    return kept.select(*[v.alias(c) for c, v in cols.items()], F.slice(cells, 10, F.greatest(F.size(cells) - 9, F.lit(0))).alias("cells"))


def sample_cells(variants: DataFrame) -> DataFrame:
    """One row for each variant and sample: chrom, pos, sample_no (from 0) and `fields`, a map from format key to text."""
    long = variants.select("chrom", "pos", "format", F.posexplode("cells").alias("sample_no", "cell"))
    keys, values = F.split("format", ":"), F.split("cell", ":")
    # Trailing fields may be left out.
    pairs = F.filter(F.arrays_zip(keys.alias("k"), values.alias("v")), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    return long.select("chrom", "pos", "sample_no", F.map_from_entries(pairs).alias("fields"))
