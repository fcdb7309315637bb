"""Models and tests over genotype likelihoods (site, sample, pl0, pl1, pl2) and genotypes, site by site.

Samples of a site with equal likelihoods are counted before they meet, as Phred values are small integers: a site's
array has an entry for each distinct triple and group.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lociq.functions import statistics as st

PLS = ("pl0", "pl1", "pl2")


def gathered(likelihoods: DataFrame, *more: str) -> DataFrame:
    """site and `seen`, the distinct (pl0, pl1, pl2, more) with their number n, in order."""
    counted = likelihoods.groupBy("site", *PLS, *more).agg(F.count("*").alias("n"))
    return counted.groupBy("site").agg(F.array_sort(F.collect_list(F.struct(*PLS, *more, "n"))).alias("seen"))


def likelihood_rows(seen) -> np.ndarray:
    """One row of likelihoods for each sample."""
    n = [x["n"] for x in seen]
    return np.repeat(10 ** (-np.array([[x[p] for p in PLS] for x in seen], float) / 10), n, axis=0)


def frequency_tests(likelihoods: DataFrame) -> DataFrame:
    """site, freq, g0, g1, g2, hwe_p, freq1, freq2, lrt1_p, lrt2_p of samples in two groups (group: 1 or 2).

    The allele's frequency, the genotypes' shares, the test that these are in Hardy-Weinberg proportions, the groups'
    frequencies, and likelihood-ratio tests that the groups are alike by frequency or by genotypes.
    """

    def run(batches):
        for b in batches:
            out = []
            for site, seen in zip(b["site"], b["seen"], strict=True):
                like = likelihood_rows(seen)
                group = np.repeat([x["group"] for x in seen], [x["n"] for x in seen])
                f = st.best_frequency(like, 0.5)
                g = st.genotype_shares(like, st.hardy_shares(f))
                hwe = st.upper_gamma(0.5, max(0.0, st.log_likelihood(like, g) - st.log_likelihood(like, st.hardy_shares(f))))
                parts = [like[group == k] for k in (1, 2)]
                row = [site, f, *g, hwe]
                if all(len(p) for p in parts):
                    fs = [st.best_frequency(p, f) for p in parts]
                    gs = [st.genotype_shares(p, g) for p in parts]
                    one = sum(st.log_likelihood(p, st.hardy_shares(x)) for p, x in zip(parts, fs, strict=True)) - st.log_likelihood(like, st.hardy_shares(f))
                    two = sum(st.log_likelihood(p, x) for p, x in zip(parts, gs, strict=True)) - st.log_likelihood(like, g)
                    row += [*fs, st.upper_gamma(0.5, max(0.0, one)), st.upper_gamma(1.0, max(0.0, two))]
                else:
                    row += [None] * 4
                out.append(row)
            yield pd.DataFrame(out, columns=names)

    names = ["site", "freq", "g0", "g1", "g2", "hwe_p", "freq1", "freq2", "lrt1_p", "lrt2_p"]
    return gathered(likelihoods, "group").mapInPandas(run, "site int, " + ", ".join(f"{n} double" for n in names[1:]))


def haplotypes(likelihoods: DataFrame, reach: int = 1) -> DataFrame:
    """first, second, h00, h01, h10, h11, r of sites at most `reach` apart, over the samples that both have."""
    a = likelihoods.select(F.col("site").alias("first"), "sample", *PLS)
    b = likelihoods.select(F.col("site").alias("second"), "sample", *[F.col(p).alias(f"q{p[2]}") for p in PLS])
    ahead = a.withColumn("second", F.explode(F.sequence(F.col("first") + 1, F.col("first") + reach)))
    met = ahead.join(b, ["second", "sample"])
    both = [*PLS, "q0", "q1", "q2"]
    counted = met.groupBy("first", "second", *both).agg(F.count("*").alias("n"))
    pairs = counted.groupBy("first", "second").agg(F.array_sort(F.collect_list(F.struct(*both, "n"))).alias("seen"))

    def run(batches):
        for rows in batches:
            out = []
            for first, second, seen in zip(rows["first"], rows["second"], rows["seen"], strict=True):
                like = np.repeat(10 ** (-np.array([[x[p] for p in both] for x in seen], float) / 10), [x["n"] for x in seen], axis=0)
                f = st.haplotype_shares(like[:, :3], like[:, 3:])
                out.append((first, second, *f, st.linkage(f)))
            yield pd.DataFrame(out, columns=["first", "second", "h00", "h01", "h10", "h11", "r"])

    return pairs.mapInPandas(run, "first int, second int, h00 double, h01 double, h10 double, h11 double, r double")


def exact_hardy_weinberg(counts: DataFrame) -> DataFrame:
    """Adds p to `counts` (n0, n1, n2: samples by genotype); equal counts are computed once a batch."""

    @F.pandas_udf("double")
    def p(n0: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
        memo: dict = {}
        rows = list(zip(n0.tolist(), n1.tolist(), n2.tolist(), strict=True))
        for r in rows:
            if r not in memo:
                memo[r] = st.hardy_weinberg(*r)
        return pd.Series([memo[r] for r in rows])

    return counts.withColumn("p", p("n0", "n1", "n2"))


def spectrum(likelihoods: DataFrame, theta: float = 1e-3) -> DataFrame:
    """site, p_ref, expected, freq: chance that no sample has the alternative allele, and its expected number and frequency."""

    def run(batches):
        for b in batches:
            out = []
            for site, seen in zip(b["site"], b["seen"], strict=True):
                post = st.allele_counts_posterior(likelihood_rows(seen), theta)
                m = len(post) - 1
                expected = float(post @ (m - np.arange(m + 1)))
                out.append((site, float(post[m]), expected, expected / m))
            yield pd.DataFrame(out, columns=["site", "p_ref", "expected", "freq"])

    return gathered(likelihoods).mapInPandas(run, "site int, p_ref double, expected double, freq double")


def posterior_calls(likelihoods: DataFrame) -> DataFrame:
    """Adds gt and gq by the posterior of each genotype under the site's frequency (freq) and the sample's ploidy."""
    f = F.col("freq")
    like = [F.pow(F.lit(10.0), -F.col(p) / 10) for p in PLS]
    diploid = [(1 - f) * (1 - f), 2 * f * (1 - f), f * f]
    haploid = [1 - f, F.lit(0.0), f]
    g = [x * F.when(F.col("ploidy") == 2, d).otherwise(h) for x, d, h in zip(like, diploid, haploid, strict=True)]
    best = F.greatest(*g)
    gt = F.when(g[0] == best, 0).when(g[1] == best, 1).otherwise(2)
    left = F.greatest(F.lit(1e-308), 1 - best / (g[0] + g[1] + g[2]))
    return likelihoods.withColumns({"gt": gt, "gq": F.least(F.lit(99), F.floor(-4.343 * F.log(left) + 0.499)).cast("int")})


#: Genotypes of four alleles as pairs, in the order of their costs.
PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def trio_calls(trios: DataFrame) -> DataFrame:
    """Adds free, bound and ratio to `trios` (father, mother, child: arrays of ten costs in the order of PAIRS).

    The least sum of costs without and with the rule that a child has one allele of each parent, and what that costs.
    """
    fits = [(f, m, c) for f, a in enumerate(PAIRS) for m, b in enumerate(PAIRS) for c, k in enumerate(PAIRS) if any({k[0], k[1]} == {x, y} for x in a for y in b)]
    rows = np.array(fits)

    @F.pandas_udf("free int, bound int")
    def run(father: pd.Series, mother: pd.Series, child: pd.Series) -> pd.DataFrame:
        costs = [np.array(x.tolist()) for x in (father, mother, child)]
        bound = [int((x[rows[:, 0]] + y[rows[:, 1]] + z[rows[:, 2]]).min()) for x, y, z in zip(*costs, strict=True)]
        return pd.DataFrame({"free": sum(c.min(axis=1) for c in costs).astype("int32"), "bound": bound})

    out = trios.withColumn("t", run("father", "mother", "child"))
    return out.select(*trios.columns, "t.free", "t.bound", (F.col("t.bound") - F.col("t.free")).alias("ratio"))


def pair_ratio(first: Column, second: Column) -> Column:
    """What it costs that two samples have one genotype, from their arrays of costs."""
    return F.array_min(F.zip_with(first, second, lambda a, b: a + b)) - F.array_min(first) - F.array_min(second)


def permutation_test(genotypes: DataFrame, rounds: int = 200, seed: int = 7) -> DataFrame:
    """site, statistic, p: the groups' difference in alternative alleles (gt) and the share of shuffles that reach it.

    `genotypes` has site, gt and group (1 or 2). A site's samples are counted by group and genotype; shuffles deal the first group's
    number of samples out of the genotypes' counts, by draws without replacement.
    """
    counts = genotypes.groupBy("site").agg(*[F.count_if((F.col("group") == k) & (F.col("gt") == g)).alias(f"n{k}{g}") for k in (1, 2) for g in range(3)])

    def run(batches):
        for b in batches:
            out = []
            for r in b.itertuples(index=False):
                n = np.array([[getattr(r, f"n{k}{g}") for g in range(3)] for k in (1, 2)])
                total, size = n.sum(axis=0), n.sum(axis=1)
                if not size.all():
                    out.append((r.site, None, None))
                    continue
                dose = np.arange(3)
                gap = lambda x: np.abs((x @ dose) / size[0] - ((total - x) @ dose) / size[1])
                drawn = np.random.default_rng([seed, int(r.site)]).multivariate_hypergeometric(total, int(size[0]), rounds)
                seen = float(gap(n[0]))
                out.append((r.site, seen, (1 + int((gap(drawn) >= seen - 1e-12).sum())) / (rounds + 1)))
            yield pd.DataFrame(out, columns=["site", "statistic", "p"])

    return counts.mapInPandas(run, "site int, statistic double, p double")


def to_costs(gl: Column, most: int = 255) -> Column:
    """Phred-scaled costs of log10 likelihoods, the least 0."""
    return F.transform(gl, lambda x: F.least(F.lit(most), F.floor(-10 * (x - F.array_max(gl)) + 0.499)).cast("int"))


def kept_alleles(pl: Column, alleles: int, kept: int) -> Column:
    """The costs of the genotypes of the first `kept` of `alleles` alleles, pairs ordered by their second allele."""
    return F.array(*[F.element_at(pl, j * (j + 1) // 2 + i + 1) for j in range(min(kept, alleles)) for i in range(j + 1)])

