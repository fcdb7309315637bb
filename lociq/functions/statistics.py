"""Tests and models of genetics as functions of arrays; small helpers for the operators that run them on Spark."""

from __future__ import annotations

import math

import numpy as np


def hardy_weinberg(common: int, hets: int, rare: int) -> float:
    """Exact p-value of the number of heterozygotes given both alleles' counts: all outcomes no likelier than the seen one."""
    low, n = 2 * min(common, rare) + hets, common + hets + rare
    if n == 0:
        return 1.0
    h = np.arange(low % 2, low + 1, 2)
    lf = np.vectorize(math.lgamma)
    # log of n! / (homozygotes! heterozygotes! homozygotes!) * 2^h, up to what all outcomes share.
    log = h * math.log(2) - lf(h + 1) - lf((low - h) / 2 + 1) - lf(n - (low + h) / 2 + 1)
    p = np.exp(log - log.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[(hets - low % 2) // 2] * (1 + 1e-9)].sum()))


def fisher(a: int, b: int, c: int, d: int) -> float:
    """Two-sided exact p-value of a 2 x 2 table."""
    row, col, n = a + b, a + c, a + b + c + d
    k = np.arange(max(0, row + col - n), min(row, col) + 1)
    lf = np.vectorize(math.lgamma)
    log = -(lf(k + 1) + lf(row - k + 1) + lf(col - k + 1) + lf(n - row - col + k + 1))
    p = np.exp(log - log.max())
    p /= p.sum()
    return float(min(1.0, p[p <= p[a - k[0]] * (1 + 1e-9)].sum()))


def upper_gamma(s: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(s * math.log(x) - x - math.lgamma(s))
    if x < s + 1:  # series of the lower one
        term = total = 1 / s
        k = s
        while term > total * 1e-15:
            k += 1
            term *= x / k
            total += term
        return max(0.0, 1 - scale * total)
    tiny = 1e-300
    b = x + 1 - s
    c, d = 1 / tiny, 1 / b
    h = d
    for i in range(1, 500):
        a = -i * (i - s)
        b += 2
        d = 1 / (a * d + b or tiny)
        c = b + a / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return scale * h


def beta_share(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    if x > (a + 1) / (a + b + 2):
        return 1 - beta_share(b, a, 1 - x)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log(1 - x)) / a
    tiny = 1e-300
    c, d = 1.0, 1 / (1 - (a + b) * x / (a + 1) or tiny)
    f = d
    for m in range(1, 500):
        for top in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 / (1 + top * d or tiny)
            c = 1 + top / c or tiny
            f *= c * d
        if abs(c * d - 1) < 1e-15:
            break
    return front * f


def mean_drop(n1: int, n2: int, s1: float, ss1: float, s2: float, ss2: float) -> float:
    """One-sided p-value of the t-test that the first group's mean isn't the larger; 1 where it isn't or groups are too small."""
    if not n1 or not n2 or n1 + n2 < 3 or s1 / n1 <= s2 / n2:
        return 1.0
    u1, u2, v = s1 / n1, s2 / n2, n1 + n2 - 2
    spread = (ss1 - n1 * u1 * u1 + ss2 - n2 * u2 * u2) / v * (1 / n1 + 1 / n2)
    if spread <= 0:
        return 0.0
    t = (u1 - u2) / math.sqrt(spread)
    return 0.5 * beta_share(v / 2, 0.5, v / (v + t * t))


def genotype_shares(like: np.ndarray, start: np.ndarray, rounds: int = 50, eps: float = 1e-5) -> np.ndarray:
    """Shares of the three genotypes by expectation-maximisation over `like` (samples x 3)."""
    g = start
    for _ in range(rounds):
        part = like * g
        new = (part / part.sum(axis=1, keepdims=True)).mean(axis=0)
        done = np.abs(new - g).max() < eps
        g = new
        if done:
            break
    return g


def hardy_shares(f: float) -> np.ndarray:
    return np.array([(1 - f) ** 2, 2 * f * (1 - f), f * f])


def best_frequency(like: np.ndarray, start: float, rounds: int = 50, eps: float = 1e-5) -> float:
    """Frequency of the alternative allele by expectation-maximisation, in Hardy-Weinberg proportions."""
    f = start
    for _ in range(rounds):
        part = like * hardy_shares(f)
        new = float((part @ np.array([0.0, 1.0, 2.0]) / part.sum(axis=1)).mean() / 2)
        done = abs(new - f) < eps
        f = new
        if done:
            break
    return f


def log_likelihood(like: np.ndarray, shares: np.ndarray) -> float:
    return float(np.log(like @ shares).sum())


def haplotype_shares(first: np.ndarray, second: np.ndarray, rounds: int = 50, eps: float = 1e-5) -> np.ndarray:
    """Shares of the haplotypes (0,0), (0,1), (1,0), (1,1) of two sites by expectation-maximisation over genotype likelihoods."""
    # like[i, h, k]: likelihood of sample i with the haplotypes h and k.
    g = np.add.outer([0, 0, 1, 1], [0, 0, 1, 1]), np.add.outer([0, 1, 0, 1], [0, 1, 0, 1])
    like = first[:, g[0]] * second[:, g[1]]
    a, b = best_frequency(first, 0.5), best_frequency(second, 0.5)
    f = np.array([(1 - a) * (1 - b), (1 - a) * b, a * (1 - b), a * b])
    for _ in range(rounds):
        part = like * f[:, None] * f
        new = (part / part.sum(axis=(1, 2), keepdims=True)).sum(axis=2).mean(axis=0)
        done = np.abs(new - f).max() < eps
        f = new
        if done:
            break
    return f


def linkage(f: np.ndarray) -> float:
    """Correlation of two sites from their haplotypes' shares; -1 where one doesn't vary."""
    p, q = f[0] + f[1], f[0] + f[2]
    below = p * q * (1 - p) * (1 - q)
    return float(abs(f[0] * f[3] - f[1] * f[2]) / math.sqrt(below)) if below > 0 else -1.0


def allele_counts_posterior(like: np.ndarray, theta: float = 1e-3) -> np.ndarray:
    """Posterior of the number of reference alleles in the sample (0 to 2n), from genotype likelihoods (samples x 3, by alternative alleles).

    The likelihood of a count is that of all genotypes that have it, each weighed alike among arrangements of alleles;
    the prior is theta over the number of alternative alleles, with the rest on none.
    """
    z = np.array([1.0])
    for p in like[:, ::-1]:  # by reference alleles
        z = np.convolve(z, p * np.array([1.0, 2.0, 1.0]))
        z /= z.sum()
    m = len(z) - 1
    log_ways = np.array([math.lgamma(m + 1) - math.lgamma(k + 1) - math.lgamma(m - k + 1) for k in range(m + 1)])
    with np.errstate(divide="ignore"):
        log = np.log(z) - log_ways
    prior = np.append(theta / np.arange(m, 0, -1), 0.0)
    prior[m] = 1 - prior.sum()
    w = np.exp(log - log[np.isfinite(log)].max()) * prior
    return w / w.sum()


#: Parameters of the model of dependent errors: how much errors of one strand depend on each other, and the least weight.
DEPENDENCE, LEAST_WEIGHT = 0.17, 0.03
#: Ten over the natural logarithm of ten, as the format rounds it.
PHRED = 4.343


def tail_costs(q: int, n: int) -> np.ndarray:
    """cost[k]: Phred-scaled chance of more than k errors among n bases of quality q, given k at least (k from 0 on)."""
    e = 10 ** (-q / 10)
    k = np.arange(n + 1)
    lf = np.vectorize(math.lgamma)
    log = lf(n + 1.0) - lf(k + 1.0) - lf(n - k + 1.0) + k * math.log(e) + (n - k) * math.log1p(-e)
    upto = np.cumsum(np.exp(log)[::-1])[::-1]  # chance of k errors or more
    with np.errstate(divide="ignore", invalid="ignore"):
        return -10 / math.log(10) * np.log(np.append(upto[1:], 0.0) / upto)


def ranks(codes: np.ndarray) -> np.ndarray:
    """How many equal codes come before each."""
    order = np.argsort(codes, kind="stable")
    first = np.flatnonzero(np.diff(codes[order], prepend=codes[order[:1]] - 1))
    out = np.empty(len(codes), np.int64)
    out[order] = np.arange(len(codes)) - np.repeat(first, np.diff(np.append(first, len(codes))))
    return out


def base_costs(bases: np.ndarray, costs=tail_costs, alleles: int = 5) -> np.ndarray:
    """Phred-scaled costs of all genotypes (alleles x alleles) from bases (quality, strand, allele), at most 255 of them.

    A genotype pays for the bases that are of neither allele, and for how unlikely the shares of its two alleles are. A
    base costs by its quality and the number of better ones of its allele; it weighs less for each better one of its
    allele and strand, as errors depend on each other.
    """
    if not len(bases):
        return np.zeros((alleles, alleles))
    quality, strand, allele = bases[np.lexsort((bases[:, 2], bases[:, 1], bases[:, 0]))[::-1]].T
    levels, level = np.unique(np.clip(quality, 4, 63), return_inverse=True)
    table = np.stack([costs(int(q), len(bases)) for q in levels])
    weight = LEAST_WEIGHT + (1 - LEAST_WEIGHT) * (1 - DEPENDENCE) ** ranks(strand * alleles + allele)
    paid = np.bincount(allele, weight * table[level, ranks(allele)], minlength=alleles)
    number = np.bincount(allele, minlength=alleles)
    factorials = np.append(0.0, np.cumsum(np.log(np.arange(1, len(bases) + 1))))
    both = number[:, None] + number
    both[np.diag_indices(alleles)] = number
    ways = factorials[both] - factorials[number][:, None] - factorials[number]
    mixed = paid.sum() - paid[:, None] - paid + PHRED * (math.log(2) * both - ways)
    np.fill_diagonal(mixed, np.where(number == len(bases), 0.0, paid.sum() - paid))
    return np.maximum(mixed, 0.0)


def best_segments(steps: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Segments (first, last) whose running sum, reset at 0, rises to `least`; each ends where its sum is highest, and the next begins after."""
    out, i, n = [], 0, len(steps)
    while i < n:
        total, best, best_at, beg = 0, 0, -1, i
        ended = False
        for j in range(i, n):
            before, total = total, max(0, total + int(steps[j]))
            beg = j if before == 0 and total > 0 else beg
            if total > best:
                best, best_at = total, j
            if (j == n - 1 or total == 0) and best >= least:
                out.append((beg, best_at))
                i, ended = best_at + 1, True
                break
            if total == 0:
                best = 0
        if not ended:
            break
    return out


def two_states(classes: np.ndarray, emit: np.ndarray, move: np.ndarray) -> np.ndarray:
    """The best path of a two-state chain through `classes`, by whole-number scores; equal scores come from state 1."""
    n = len(classes)
    came, score = np.zeros((n, 2), np.int8), np.zeros(2, np.int64)
    for i, c in enumerate(classes.tolist()):
        new = np.empty(2, np.int64)
        for s in range(2):
            a, b = score[0] + move[0][s], score[1] + move[1][s]
            came[i, s] = 0 if a > b else 1
            new[s] = max(a, b) + emit[s][c]
        score = new
    path, s = np.zeros(n, np.int8), 0 if score[0] > score[1] else 1
    for i in range(n - 1, -1, -1):
        path[i] = s
        s = came[i, s]
    return path


def sparse_segments(at: np.ndarray, gain: np.ndarray, n: int, least: int) -> list[tuple[int, int]]:
    """As best_segments() for `n` steps of -1, but of `gain` (above 0) at the places `at`; work grows with these places only."""
    out, first, at, gain = [], 0, at.tolist(), gain.tolist()
    while first < len(at):
        total, best, best_k, beg, before = 0, 0, first, at[first], at[first] - 1
        for k in range(first, len(at)):
            gap = at[k] - before - 1
            if total <= gap:  # back at 0 before the next gain
                if best >= least:
                    break
                total, best, beg = 0, 0, at[k]
            else:
                total -= gap
            total, before = total + gain[k], at[k]
            if total > best:
                best, best_k = total, k
        if best < least:
            break
        out.append((beg, at[best_k]))
        first = best_k + 1
    return out


def two_states_of(classes: list[np.ndarray], emit: np.ndarray, move: np.ndarray, block: int = 256) -> list[np.ndarray]:
    """two_states() of each of several sequences, all cut into blocks that are stepped through side by side.

    Only the difference of the two scores counts. A step clamps it and adds to it, and so do any number of steps, so a
    block's steps are put together first, then blocks begin where the one before ends. Changing states mustn't pay.
    """
    low, high = move[1][0] - move[0][0], move[1][1] - move[0][1]
    if low > high:
        raise ValueError("changing states must cost more than staying")
    added = emit[0] - emit[1] + move[0][0] - move[1][1]
    sizes = [-(-len(c) // block) for c in classes]
    steps = np.zeros((sum(sizes), block), np.int64)
    edges = np.cumsum([0, *sizes])
    for c, a in zip(classes, edges[:-1].tolist(), strict=True):
        steps[a : a + -(-len(c) // block)].reshape(-1)[: len(c)] = added[c]
    steps = np.ascontiguousarray(steps.T)
    wide = np.int64(1) << 60
    own, least, most = np.zeros(steps.shape[1], np.int64), np.full(steps.shape[1], -wide), np.full(steps.shape[1], wide)
    for s in steps:
        own, least, most = own + s, np.clip(least, low, high) + s, np.clip(most, low, high) + s
    starts = np.zeros(steps.shape[1], np.int64)
    fresh = set(edges[:-1].tolist())
    for k, (a, x, y) in enumerate(zip(own.tolist(), least.tolist(), most.tolist(), strict=True)):
        if k + 1 < len(starts) and k + 1 not in fresh:
            starts[k + 1] = min(max(int(starts[k]) + a, x), y)
    seen = np.empty((block + 1, steps.shape[1]), np.int64)
    seen[0] = starts
    for t, s in enumerate(steps):
        seen[t + 1] = np.clip(seen[t], low, high) + s
    before, after = (np.ascontiguousarray(x.T) for x in (seen[:-1], seen[1:]))
    out = []
    for c, a in zip(classes, edges[:-1].tolist(), strict=True):
        rows = slice(a, a + -(-len(c) // block))
        d = before[rows].reshape(-1)[: len(c)]
        # At these places both states come from one: 1 at or below the low bound, 0 above the high one.
        forced = np.append((d[1:] <= low) | (d[1:] > high), True) if len(c) else np.empty(0, bool)
        last = after[rows].reshape(-1)[len(c) - 1] if len(c) else 0
        value = np.append(d[1:] <= low, not last > 0)
        fixed = np.flatnonzero(forced)
        out.append(value[fixed[np.searchsorted(fixed, np.arange(len(c)))]].astype(np.int8))
    return out
