"""Statistics of whole variation sets."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions.histogram import BINS, bin_of, edges_of
from ..variations import Variations

#: Below this a major-allele frequency counts as variable.
ALL_BUT_ONE = 0.9999999999


def _with(v: Variations, **stats) -> DataFrame:
    return v.df.select("variant_idx", "chrom", "pos", *[c.alias(n) for n, c in stats.items()])


def missing_gt(v: Variations, rates: bool = True) -> DataFrame:
    return _with(v, missing=G.missing_rate(F.col("gt")) if rates else G.missing_count(F.col("gt")))


def called_gt(v: Variations, rates: bool = True) -> DataFrame:
    return _with(v, called=G.called_rate(F.col("gt")) if rates else G.called_count(F.col("gt")))


def allele_counts(v: Variations, max_alleles: int, count_missing: bool = True) -> DataFrame:
    return _with(v, counts=G.allele_counts(F.col("gt"), max_alleles, count_missing))


def maf_by_gt(v: Variations, max_alleles: int, min_num_genotypes=G.MIN_NUM_GENOTYPES) -> DataFrame:
    return _with(v, maf=G.major_freq(F.col("gt"), max_alleles, min_num_genotypes))


def maf_by_allele_count(v: Variations, n_alts: int, min_num_genotypes=G.MIN_NUM_GENOTYPES) -> DataFrame:
    return _with(v, maf=G.major_freq_by_depth(F.col("gt"), F.col("ro"), F.col("ao"), n_alts, min_num_genotypes))


def mac(v: Variations, max_alleles: int, min_num_genotypes=G.MIN_NUM_GENOTYPES) -> DataFrame:
    return _with(v, mac=G.major_count(F.col("gt"), max_alleles, min_num_genotypes))


def allele_freq(v: Variations, max_alleles: int, min_num_genotypes=G.MIN_NUM_GENOTYPES) -> DataFrame:
    return _with(v, freqs=G.allele_freqs(F.col("gt"), max_alleles, min_num_genotypes))


def allele_freq_by_depth(v: Variations, n_alleles: int) -> DataFrame:
    return _with(v, freqs=G.allele_freqs_by_depth(F.col("ad"), n_alleles))


def expected_het(v: Variations, max_alleles: int, min_num_genotypes=G.MIN_NUM_GENOTYPES) -> DataFrame:
    return _with(v, exp_het=G.expected_het(F.col("gt"), max_alleles, min_num_genotypes))


def unbiased_expected_het(v: Variations, max_alleles: int, min_num_genotypes=G.MIN_NUM_GENOTYPES) -> DataFrame:
    return _with(v, exp_het=G.unbiased_expected_het(F.col("gt"), max_alleles, min_num_genotypes))


def obs_het(v: Variations, min_num_genotypes=G.MIN_NUM_GENOTYPES, min_dp: int | None = 0, max_dp: int | None = None) -> DataFrame:
    return _with(v, obs_het=G.obs_het(F.col("gt"), F.col("dp") if "dp" in v else None, min_dp, max_dp, min_num_genotypes))


def obs_het_per_sample(v: Variations, min_dp: int | None = 0, max_dp: int | None = None) -> DataFrame:
    """(sample_idx, het, called, obs_het): sums go variant by variant in the tasks, so samples, not calls, are shuffled."""
    fields = ["gt", *(["dp"] if min_dp is not None or max_dp is not None else [])]
    calls = v.df.select(F.posexplode(F.arrays_zip(*fields)).alias("sample_idx", "c"))
    ok = G.usable(F.col("c.gt"), F.col("c.dp") if "dp" in fields else None, min_dp, max_dp)
    counted = calls.groupBy("sample_idx").agg(F.count_if(ok & G.is_het(F.col("c.gt"))).alias("het"), F.count_if(ok).alias("called"))
    return counted.withColumn("obs_het", F.try_divide(F.col("het").cast("double"), F.col("called").cast("double")))


def diversities(v: Variations, max_alleles: int, min_num_genotypes=G.MIN_NUM_GENOTYPES, min_dp: int | None = 20, polymorphic_threshold: float = 0.95) -> DataFrame:
    """One row for the whole set, in one pass."""
    gt = F.col("gt")
    s = v.df.select(G.major_freq(gt, max_alleles, min_num_genotypes).alias("maf"), G.expected_het(gt, max_alleles, min_num_genotypes).alias("e"), G.obs_het(gt, F.col("dp") if "dp" in v else None, min_dp, None, min_num_genotypes).alias("o"))
    return s.agg(F.count_if(F.col("maf") < ALL_BUT_ONE).alias("num_variable"), F.count_if(F.col("maf") <= polymorphic_threshold).alias("num_polymorphic"), F.avg("e").alias("exp_het"), F.avg("o").alias("obs_het"), F.count("*").alias("num_variations"))


def summary(v: Variations, max_alleles: int | None, min_dp: int | None = 20, min_num_genotypes=G.MIN_NUM_GENOTYPES, bins: int = BINS, kinds=("called", "mac", "maf", "obs_het")) -> DataFrame:
    """(kind, bin, lo, hi, n): histograms of up to four statistics from one pass over the variants; bins without a variant are 0."""
    gt = F.col("gt")
    stats = {
        "called": (G.called_rate(gt), (0.0, 1.0)), "mac": (G.major_count(gt, max_alleles, min_num_genotypes), (0.0, float(v.num_samples))),
        "maf": (G.major_freq(gt, max_alleles, min_num_genotypes), (0.0, 1.0)), "obs_het": (G.obs_het(gt, F.col("dp") if "dp" in v else None, min_dp, None, min_num_genotypes), (0.0, 1.0)),
    }
    named = [F.struct(F.lit(k).alias("kind"), bin_of(stats[k][0], edges_of(bins, *stats[k][1])).alias("bin")) for k in kinds]
    found = v.df.select(F.explode(F.array(*named)).alias("x")).select("x.*").filter("bin is not null").groupBy("kind", "bin").agg(F.count("*").alias("n"))
    edges = [(k, b, e[b], e[b + 1]) for k in kinds for e in [edges_of(bins, *stats[k][1])] for b in range(bins)]
    every = v.df.sparkSession.createDataFrame(edges, "kind string, bin int, lo double, hi double")
    return every.join(F.broadcast(found), ["kind", "bin"], "left").select("kind", "bin", "lo", "hi", F.coalesce("n", F.lit(0)).alias("n"))


def write_summary(v: Variations, folder, name: str, max_alleles: int | None = None, min_dp: int | None = 20, min_num_genotypes=G.MIN_NUM_GENOTYPES, bins: int = BINS) -> None:
    """A folder with stats.txt, the numbers of variations and samples of the set called name, and each histogram as a table."""
    rows = summary(v, max_alleles, min_dp, min_num_genotypes, bins).orderBy("kind", "bin").collect()
    folder = Path(folder)
    folder.mkdir(parents=True, exist_ok=True)
    title = f"STATS FOR: {name}"
    (folder / "stats.txt").write_text(f"{title}\n{'-' * len(title)}\nNum. variations: {v.num_variations}\nNum. samples: {v.num_samples}\n\n")
    for kind in sorted({r.kind for r in rows}):
        lines = ["lo,hi,n", *(f"{r.lo},{r.hi},{r.n}" for r in rows if r.kind == kind)]
        (folder / f"{kind}.csv").write_text("\n".join(lines) + "\n")
