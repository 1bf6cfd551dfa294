"""Linkage disequilibrium: correlations of dosages between variants."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..variations import Variations


def correlation(a: Column, b: Column, min_num: int) -> Column:
    """Pearson's r of two arrays over the places where both are 0 or more; NULL for fewer than min_num of them or without variance."""
    both = F.filter(F.zip_with(a, b, lambda x, y: F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))), lambda p: (p["x"] >= 0) & (p["y"] >= 0))
    zero = F.struct(*[F.lit(0.0).alias(k) for k in ("n", "x", "y", "xx", "yy", "xy")])
    add = lambda s, p: F.struct((s["n"] + 1).alias("n"), (s["x"] + p["x"]).alias("x"), (s["y"] + p["y"]).alias("y"), (s["xx"] + p["x"] * p["x"]).alias("xx"), (s["yy"] + p["y"] * p["y"]).alias("yy"), (s["xy"] + p["x"] * p["y"]).alias("xy"))
    r = lambda s: F.when(s["n"] >= min_num, F.try_divide(s["n"] * s["xy"] - s["x"] * s["y"], F.sqrt((s["n"] * s["xx"] - s["x"] * s["x"]) * (s["n"] * s["yy"] - s["y"] * s["y"]))))
    return F.aggregate(both, zero, add, r)


def check_maf(v: Variations, max_alleles: int, max_maf: float, min_num_gts: int) -> None:
    """Correlations go wrong for nearly fixed variants, and without genotypes there are none."""
    maf = G.major_freq(F.col("gt"), max_alleles, min_num_gts)
    if v.df.filter(maf.isNull() | (maf > max_maf)).limit(1).count():
        raise RuntimeError("not enough genotypes, or a major-allele frequency above the allowed maximum")


def _dosages(v: Variations) -> Column:
    return G.dosages(F.col("gt")).cast("array<tinyint>")


def ld_along_genome(v: Variations, max_distance: int, max_alleles: int, min_num_gts: int = G.MIN_NUM_GENOTYPES, max_maf: float = 0.95, check: bool = True) -> DataFrame:
    """(variant_idx1, variant_idx2, chrom, pos1, pos2, dist, ld) of pairs on a chromosome at most max_distance apart, each once, pos1 < pos2.

    ld is |r|. A range join by bins of max_distance: the earlier variant stays in its own bin, the
    later one also goes to the bin before.
    """
    if check:
        check_maf(v, max_alleles, max_maf, min_num_gts)
    base = v.df.select("variant_idx", "chrom", "pos", _dosages(v).alias("d"), F.floor(F.col("pos") / max_distance).alias("bin"))
    a = base.select(F.col("variant_idx").alias("variant_idx1"), "chrom", "bin", F.col("pos").alias("pos1"), F.col("d").alias("d1"))
    b = base.select(F.col("variant_idx").alias("variant_idx2"), "chrom", F.explode(F.array(F.col("bin"), F.col("bin") - 1)).alias("bin"), F.col("pos").alias("pos2"), F.col("d").alias("d2"))
    near = (F.col("pos2") > F.col("pos1")) & (F.col("pos2") - F.col("pos1") <= max_distance)
    pairs = a.join(b, ["chrom", "bin"]).filter(near)
    ld = F.abs(correlation(F.col("d1"), F.col("d2"), min_num_gts))
    return pairs.select("variant_idx1", "variant_idx2", "chrom", "pos1", "pos2", (F.col("pos2") - F.col("pos1")).alias("dist"), ld.alias("ld")).filter("ld is not null")


def ld_random_pairs(v: Variations, num_pairs: int, max_alleles: int, seed: int = 1, min_num_gts: int = G.MIN_NUM_GENOTYPES, max_maf: float = 0.95, unit: str = "dosage", attempts: int | None = None, check: bool = True) -> DataFrame:
    """(k, chrom1, variant_idx1, chrom2, variant_idx2, r): seeded pairs of variants on different chromosomes, with replacement, the first num_pairs that have a correlation.

    Pairs are drawn by the variants' places, so gaps in variant_idx don't matter, in rounds of
    attempts until there are enough. A round without any raises a RuntimeError. unit: dosage, or
    allele for a correlation over single alleles.
    """
    ranked, n = v.ranked()
    if v.df.select("chrom").distinct().limit(2).count() < 2:
        raise ValueError("at least two chromosomes are needed")
    if check:
        check_maf(v, max_alleles, max_maf, min_num_gts)
    values = _dosages(v) if unit == "dosage" else G.alleles(F.col("gt")).cast("array<tinyint>")
    side = lambda x: ranked.select(F.col("__rank").alias(f"rank{x}"), F.col("variant_idx").alias(f"variant_idx{x}"), F.col("chrom").alias(f"chrom{x}"), values.alias(f"d{x}"))
    k, size = F.col("id"), attempts or 4 * num_pairs + 100
    first = ((k * 2654435761 + seed * 40503) % 4294967296) % n
    second = ((k * 2246822519 + seed * 3266489 + 374761393) % 4294967296) % n

    def drawn(upto: int) -> DataFrame:
        pairs = v.df.sparkSession.range(upto).select(k.alias("k"), first.alias("rank1"), second.alias("rank2"))
        pairs = pairs.join(side(1), "rank1").join(side(2), "rank2").filter("chrom1 <> chrom2")
        return pairs.select("k", "chrom1", "variant_idx1", "chrom2", "variant_idx2", correlation(F.col("d1"), F.col("d2"), min_num_gts).alias("r")).filter("r is not null")

    upto, had = size, 0
    while (found := drawn(upto).count()) < num_pairs:
        if found == had:
            raise RuntimeError(f"only {found} of {num_pairs} pairs have a correlation")
        upto, had = 2 * upto, found
    return drawn(upto).orderBy("k").limit(num_pairs)
