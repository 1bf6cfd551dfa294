"""Distances between samples and between populations.

Everything about a variant is computed in its row; what is aggregated over variants is one row a
pair, summed in the tasks before anything is shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..variations import Variations

#: Cells of a matrix of variants, classes of calls and samples that are held at once.
CELLS = 4_000_000


def kosman_dist(v: Variations, min_num_snps: int | None = None) -> DataFrame:
    """(i, j, n, dist) for each pair of samples i < j, in that order of the condensed list.

    Per variant 1, 0.5 or 0 by the alleles that two fully called diploid samples share, averaged
    over the variants where both are called; NULL where there are none, 0 where there are fewer
    than min_num_snps. Each task adds up its variants by products of matrices, in matrices of
    samples by samples, and sends one row a pair.
    """
    n = v.num_samples
    if v.df.filter(F.exists("gt", lambda c: F.size(c) != 2)).limit(1).count():
        raise ValueError("the distance is for diploid samples")

    def run(batches):
        same, shared, both = (np.zeros((n, n)) for _ in range(3))
        for b in batches:
            g = np.asarray(b.column(0).flatten().flatten().to_numpy(), np.int64).reshape(-1, n, 2)
            k = int(g.max(initial=0)) + 1
            a, c = np.triu_indices(k)
            # a call's class is its set of alleles; two calls share nothing, everything or something by their classes
            number = np.zeros((k, k), np.int64)
            number[a, c] = number[c, a] = np.arange(a.size)
            meets = ((a[:, None] == a) | (a[:, None] == c) | (c[:, None] == a) | (c[:, None] == c)).astype(np.float32)
            step = max(1, CELLS // (n * a.size))
            for lo in range(0, len(g), step):
                part = g[lo : lo + step]
                called = (part >= 0).all(2)
                row, sample = np.nonzero(called)
                one = np.zeros((len(part), a.size, n), np.float32)
                one[row, number[part[row, sample, 0], part[row, sample, 1]], sample] = 1
                flat = one.reshape(-1, n)
                same += flat.T @ flat
                shared += flat.T @ np.matmul(meets, one).reshape(-1, n)
                both += called.T.astype(np.float32) @ called.astype(np.float32)
        i, j = np.triu_indices(n, 1)
        d = (both - shared + 0.5 * (shared - same))[i, j]
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(d), pa.array(both[i, j].astype(np.int64))], ["i", "j", "d", "n"])

    sums = v.df.select("gt").mapInArrow(run, "i int, j int, d double, n long").groupBy("i", "j").agg(F.sum("d").alias("d"), F.sum("n").alias("n"))
    dist = F.try_divide(F.col("d"), F.col("n").cast("double"))
    if min_num_snps is not None:
        dist = F.when((F.col("n") > 0) & (F.col("n") < min_num_snps), F.lit(0.0)).otherwise(dist)
    return sums.select("i", "j", "n", dist.alias("dist"))


def _populations(v: Variations, populations) -> list[list[int]]:
    at = {s: i for i, s in enumerate(v.samples)}
    return [[at[s] for s in p] for p in populations]


def _pairs(n: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(n) for j in range(i + 1, n)]


def _by_pair(df: DataFrame, n: int, measures, names: list[str]) -> DataFrame:
    """(p1, p2, name..., count of rows with the first measure): sums over variants of measures(i, j) for each pair of populations."""
    rows = [F.struct(F.lit(i).alias("p1"), F.lit(j).alias("p2"), *[m.alias(k) for k, m in zip(names, measures(i, j))]) for i, j in _pairs(n)]
    return df.select(F.explode(F.array(*rows)).alias("x")).select("x.*").groupBy("p1", "p2").agg(*[F.sum(k).alias(k) for k in names], *[F.count(k).alias(f"n_{k}") for k in names])


def _dot(a: Column, b: Column) -> Column:
    return G.real_total(F.zip_with(a, b, lambda x, y: x * y))


def _minus_log(identity: Column, clamp: bool) -> Column:
    d = F.when(identity == 0, F.lit(float("inf"))).otherwise(-F.ln(identity))
    return F.when(d < 0, F.lit(0.0)).otherwise(d) if clamp else d


def nei_dists(v: Variations, max_alleles: int, populations, min_num_genotypes: int | None = G.MIN_NUM_GENOTYPES) -> DataFrame:
    """(p1, p2, dist): Nei's unbiased distance. Infinite where populations share no allele, NULL where no variant serves."""
    pops = _populations(v, populations)
    gts = v.df.select(*[G.pick(F.col("gt"), p).alias(f"g{k}") for k, p in enumerate(pops)])
    freqs = gts.select(*[G.allele_freqs(F.col(f"g{k}"), max_alleles, min_num_genotypes).alias(f"f{k}") for k in range(len(pops))])

    def own(k: int) -> Column:
        n2 = 2.0 * len(pops[k])
        return F.try_divide(n2 * _dot(F.col(f"f{k}"), F.col(f"f{k}")) - 1, F.lit(n2 - 1))

    with_own = freqs.select("*", *[own(k).alias(f"u{k}") for k in range(len(pops))])
    sums = _by_pair(with_own, len(pops), lambda i, j: (_dot(F.col(f"f{i}"), F.col(f"f{j}")), F.col(f"u{i}"), F.col(f"u{j}")), ["jxy", "jx", "jy"])
    identity = F.try_divide(F.col("jxy"), F.sqrt(F.col("jx") * F.col("jy")))
    return sums.select("p1", "p2", _minus_log(identity, True).alias("dist"))


def nei_dists_by_depth(v: Variations, n_alleles: int, populations) -> DataFrame:
    """(p1, p2, dist): Nei's distance on allele frequencies by read depth; not clamped at 0."""
    pops = _populations(v, populations)
    ads = v.df.select(*[G.pick(F.col("ad"), p).alias(f"a{k}") for k, p in enumerate(pops)])
    freqs = ads.select(*[G.allele_freqs_by_depth(F.col(f"a{k}"), n_alleles).alias(f"f{k}") for k in range(len(pops))])
    f = lambda k: F.col(f"f{k}")
    sums = _by_pair(freqs, len(pops), lambda i, j: (_dot(f(i), f(j)), _dot(f(i), f(i)), _dot(f(j), f(j))), ["jxy", "jx", "jy"])
    identity = F.try_divide(F.col("jxy"), F.sqrt(F.col("jx") * F.col("jy")))
    return sums.select("p1", "p2", _minus_log(identity, False).alias("dist"))


def dset_dists(v: Variations, max_alleles: int, populations, min_num_genotypes: int = G.MIN_NUM_GENOTYPES, min_dp: int | None = 0) -> DataFrame:
    """(p1, p2, dist): Jost's D as the mean over variants of corrected heterozygosities; NULL where no variant serves."""
    pops = _populations(v, populations)
    cut = v.df.select(*[G.pick(F.col("gt"), p).alias(f"g{k}") for k, p in enumerate(pops)], *([G.pick(F.col("dp"), p).alias(f"d{k}") for k, p in enumerate(pops)] if min_dp is not None else []))
    stats = []
    for k in range(len(pops)):
        g, d = F.col(f"g{k}"), F.col(f"d{k}") if min_dp is not None else None
        het, called = G.het_counts(g, d, min_dp, None)
        stats += [G.allele_freqs(g, max_alleles, None).alias(f"f{k}"), het.cast("double").alias(f"h{k}"), called.cast("double").alias(f"c{k}"), G.ploidy(g).cast("double").alias(f"p{k}")]
    base = cut.select(*stats)

    def measures(i: int, j: int):
        f1, f2, p = F.col(f"f{i}"), F.col(f"f{j}"), F.col(f"p{i}")
        inner = lambda f: 1 - G.real_total(F.transform(f, lambda x: F.pow(x, p)))
        hs = (inner(f1) + inner(f2)) / 2
        ht = inner(F.zip_with(f1, f2, lambda x, y: (x + y) / 2))
        o1, o2 = (F.try_divide(F.col(f"h{k}"), F.col(f"c{k}")) for k in (i, j))
        seen = F.coalesce((o1 + o2) / 2, o1, o2)
        n = G.harmonic_mean(F.col(f"c{i}"), F.col(f"c{j}"))
        hs2 = F.try_divide(n, n - 1) * (hs - F.try_divide(seen, 2 * n))
        ht2 = ht + F.try_divide(hs2, 2 * n) - F.try_divide(seen, 4 * n)
        enough = (F.col(f"c{i}") >= min_num_genotypes) & (F.col(f"c{j}") >= min_num_genotypes)
        return F.when(enough, hs2), F.when(enough, ht2)

    sums = _by_pair(base, len(pops), measures, ["hs", "ht"])
    hs, ht = F.try_divide(F.col("hs"), F.col("n_hs").cast("double")), F.try_divide(F.col("ht"), F.col("n_hs").cast("double"))
    mean = sums.select("p1", "p2", hs.alias("hs"), ht.alias("ht"))
    return mean.select("p1", "p2", F.try_divide(2 * (F.col("ht") - F.col("hs")), 1 - F.col("hs")).alias("dist"))
