"""Tables kept in the folder that the cluster shares, and connected components of links."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def keep(df: DataFrame) -> DataFrame:
    """Writes `df` under spark.checkpoint.dir and reads it again, so that what follows doesn't recompute it."""
    path = new_folder(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def new_folder(spark: SparkSession) -> str:
    """A path of its own under spark.checkpoint.dir.

    Where that setting is missing, a master on one machine gets a temporary folder; on a cluster that is an error,
    since each executor would write to a disk of its own.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not re.fullmatch(r"local(\[[^\]]*\])?", spark.sparkContext.master):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        folder = f"file://{tempfile.mkdtemp(prefix='spark-')}"
        spark.sparkContext.setCheckpointDir(folder)
    return f"{folder}/{uuid.uuid4().hex}"


def forget(kept: DataFrame) -> None:
    """Deletes the table of a frame that keep() gave, which nothing reads any more."""
    spark = kept.sparkSession
    for folder in {f.rpartition("/")[0] for f in kept.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node and component (the smallest node linked to it) of every node in `links` (a, b).

    Rounds of large-star and small-star: each node passes its smallest neighbour on to the larger, then to the smaller
    ones. Minima are taken by partial aggregates, so a node with many links is no hot group. Rounds end when the
    links are stars; their number grows with the logarithm of the longest path.
    """
    edges = keep(links.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    before = None
    for _ in range(most_rounds):
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        # A node smaller than all its neighbours keeps no link of its own in a large star.
        large = large.where("a <> b").distinct()
        own = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(own, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        done, edges = edges, keep(small.unionByName(own.select("a", F.col("m").alias("b"))).distinct())
        forget(done)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            break
        before = now
    else:
        raise RuntimeError("components did not settle")
    roots = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        roots.select("node", F.col("node").alias("component"))
    )
