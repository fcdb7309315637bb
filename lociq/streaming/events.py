"""Groups, windows and first rows of time-stamped rows; each works on streams and on tables.

On a stream, `late` bounds the state: groups are given out once the watermark has passed their end, and later rows
for them are dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def marked(rows: DataFrame, at: str, late: str) -> DataFrame:
    """`rows` with a watermark if they are a stream."""
    return rows.withColumn(at, F.col(at).cast("timestamp")).withWatermark(at, late) if rows.isStreaming else rows


def gap_sessions(rows: DataFrame, key: str, at: str, gap: str, late: str, *aggs) -> DataFrame:
    """One row for each run of a key's rows in which successive ones are less than `gap` apart."""
    return marked(rows, at, late).groupBy(key, F.session_window(at, gap).alias("span")).agg(*aggs)


def windowed(rows: DataFrame, key: str, at: str, width: str, late: str, *aggs) -> DataFrame:
    """One row for each key and window of fixed width that has rows."""
    return marked(rows, at, late).groupBy(key, F.window(at, width).alias("span")).agg(*aggs)


def first_rows(rows: DataFrame, keys: list[str], at: str, late: str) -> DataFrame:
    """One row of each key; on a stream, of those that come within `late` of each other."""
    own = marked(rows, at, late)
    return own.dropDuplicatesWithinWatermark(keys) if rows.isStreaming else own.dropDuplicates(keys)
