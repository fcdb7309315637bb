"""Statistics of genotype likelihoods (site, sample, pl0, pl1, pl2: Phred-scaled) and of genotypes (site, sample, gt)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def frequency_em(likelihoods: DataFrame, rounds: int = 50) -> DataFrame:
    """site, samples, freq: the alternative allele's frequency by expectation-maximisation from 1/2, in Hardy-Weinberg proportions.

    Samples of one site with equal likelihoods are counted first, so a site's array has one entry for each distinct
    triple (Phred values are small integers), however many samples there are.
    """
    counted = likelihoods.groupBy("site", "pl0", "pl1", "pl2").agg(F.count("*").alias("n"))
    like = [F.pow(F.lit(10.0), -F.col(f"pl{g}") / 10).alias(f"l{g}") for g in range(3)]
    # Sorted, so that sums don't depend on the order of arrival.
    sites = counted.groupBy("site").agg(F.sum("n").alias("samples"), F.array_sort(F.collect_list(F.struct(*like, "n"))).alias("seen"))

    def expected(f, x):
        a, b, c = x["l0"] * (1 - f) * (1 - f), x["l1"] * 2 * f * (1 - f), x["l2"] * f * f
        return x["n"] * (b + 2 * c) / (a + b + c)

    freq = F.aggregate(
        F.sequence(F.lit(1), F.lit(rounds)), F.lit(0.5),
        lambda f, _: F.aggregate("seen", F.lit(0.0), lambda t, x: t + expected(f, x)) / (2 * F.col("samples")),
    )
    return sites.select("site", "samples", freq.alias("freq"))


def ld_pairs(genotypes: DataFrame, reach: int) -> DataFrame:
    """first, second, samples, r2: squared correlation of the genotypes of sites at most `reach` apart.

    Each row meets only the sites that follow within reach, as an equality join on (sample, site); null where a
    site doesn't vary.
    """
    later = genotypes.select("sample", F.col("site").alias("second"), F.col("gt").alias("y"))
    ahead = genotypes.select("sample", F.col("site").alias("first"), F.col("gt").alias("x"), F.explode(F.sequence(F.lit(1), F.lit(reach))).alias("step"))
    met = ahead.withColumn("second", (F.col("first") + F.col("step")).cast("int")).join(later, ["sample", "second"])
    # Whole numbers until the last step.
    s = {k: F.sum(F.expr(e).cast("long")) for k, e in {"x": "x", "y": "y", "xx": "x * x", "yy": "y * y", "xy": "x * y"}.items()}
    n = F.count("*")
    own = met.groupBy("first", "second").agg(n.alias("samples"), (n * s["xy"] - s["x"] * s["y"]).alias("c"), (n * s["xx"] - s["x"] * s["x"]).alias("vx"), (n * s["yy"] - s["y"] * s["y"]).alias("vy"))
    c, v = F.col("c").cast("double"), F.col("vx").cast("double") * F.col("vy")
    return own.select("first", "second", "samples", F.when(v > 0, c * c / v).alias("r2"))
