"""Genotype calls and their certainty from Phred-scaled likelihoods (columns pl0, pl1, pl2), and running quality strata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PLS = ("pl0", "pl1", "pl2")


def gap(*pls: str) -> Column:
    """What the second best genotype costs more than the best."""
    low = F.array_sort(F.array(*pls))
    return low[1] - low[0]


def called(likelihoods: DataFrame) -> DataFrame:
    """Adds gt, the genotype of the least cost (the first of equals), and gq, its certainty, 99 at most."""
    best = F.array_position(F.array(*PLS), F.least(*PLS)) - 1
    return likelihoods.withColumn("gt", best.cast("int")).withColumn("gq", F.least(gap(*PLS), F.lit(99)))


def gap_histogram(likelihoods: DataFrame) -> DataFrame:
    """gap, sites: how many sites have that least gap among their samples; 255 stands for all above."""
    sites = likelihoods.groupBy("site").agg(F.min(gap(*PLS)).alias("gap"))
    return sites.groupBy(F.least("gap", F.lit(255)).alias("gap")).agg(F.count("*").alias("sites"))


def quality_strata(records: DataFrame) -> DataFrame:
    """qual, records, known, transitions: how many records have at least that quality, from (qual, known, transition).

    Records are counted by whole quality first, so the ordered window holds only the distinct qualities.
    """
    counts = records.groupBy(F.floor("qual").cast("int").alias("qual")).agg(
        F.count("*").alias("records"), F.sum(F.col("known").cast("long")).alias("known"), F.sum(F.col("transition").cast("long")).alias("transitions")
    )
    w = Window.orderBy(F.desc("qual")).rowsBetween(Window.unboundedPreceding, 0)
    return counts.select("qual", *[F.sum(c).over(w).alias(c) for c in ("records", "known", "transitions")])


def annotation_maxima(genotypes: DataFrame, least_gq: int = 20) -> DataFrame:
    """site, mxsp, mxgq: the greatest strand bias and genotype quality of a site's samples that aren't of the reference twice.

    `genotypes` has (site, gt, gq, sp), gt being the number of other alleles; null qualities count as 0. The more
    heterozygous samples of good quality a site has, the less its greatest bias tells: it goes down by ten times their logarithm.
    """
    other = F.col("gt") > 0
    most = lambda c: F.coalesce(F.max(F.when(other, F.greatest(c, F.lit(0)))), F.lit(0))
    sites = genotypes.groupBy("site").agg(most("sp").alias("sp"), most("gq").alias("mxgq"), F.count_if((F.col("gt") == 1) & (F.col("gq") >= least_gq)).alias("hets"))
    down = F.when(F.col("hets") > 0, F.floor(4.343 * F.log("hets") + 0.499).cast("int")).otherwise(0)
    return sites.select("site", F.greatest(F.col("sp") - down, F.lit(0)).alias("mxsp"), "mxgq")
