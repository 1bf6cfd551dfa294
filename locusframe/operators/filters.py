"""Filters of variants, samples and calls. Each gives a FilterResult: the variants that stay, and what was counted on the way."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, Observation
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..functions.histogram import BINS, bins_row, edges_of
from ..variations import Variations


@dataclass
class FilterResult:
    """stats() is filled by the first action on variations: the counters ride on that pass and need none of their own.

    That action should run each task once, as a write or a collect does; a global sort above the
    filter samples its input first and is counted twice. plans.pipeline.step_counts counts exactly
    under any plan, in a pass of its own.
    """

    variations: Variations
    filter_id: str
    observation: Observation | None = None
    edges: list[float] = field(default_factory=list)
    limits: tuple = ()

    def stats(self) -> dict:
        if self.observation is None:
            return {}
        got = self.observation.get
        out = {"n_kept": got["n_kept"], "n_filtered_out": got["n_filtered_out"]}
        if self.edges:
            out |= {"counts": [got[f"b{k}"] for k in range(len(self.edges) - 1)], "bin_edges": self.edges, "limits": list(self.limits)}
        return out


def _apply(v: Variations, cond: Column, filter_id: str, stats: bool, value: Column | None = None, bins: int = BINS, range_: tuple | None = None, limits: tuple = ()) -> FilterResult:
    """Keeps rows for which cond is true. An observation stops filters from reaching the scan, so stats=False leaves it out."""
    if not stats:
        return FilterResult(v.with_df(v.df.filter(cond)), filter_id)
    keep = F.coalesce(cond, F.lit(False))
    seen = Observation()
    marked = v.df.withColumn("__locusframe_keep", keep)
    counters = [F.count_if("__locusframe_keep").alias("n_kept"), F.count_if(~F.col("__locusframe_keep")).alias("n_filtered_out")]
    edges: list[float] = []
    if value is not None and range_ is not None:
        edges = edges_of(bins, *range_)
        counters += [c.alias(f"b{k}") for k, c in enumerate(bins_row(value, bins, range_))]
    df = marked.observe(seen, *counters).filter("__locusframe_keep").drop("__locusframe_keep")
    return FilterResult(v.with_df(df), filter_id, seen, edges, limits)


def between(value: Column, least=None, most=None) -> Column:
    """Both bounds count in; a missing value stays only where there are no bounds."""
    cond = F.lit(True)
    if least is not None:
        cond = cond & (value >= least)
    if most is not None:
        cond = cond & (value <= most)
    return cond


def _stat_filter(v, value, least, most, filter_id, stats, calc_histogram, n_bins, range_):
    return _apply(v, between(value, least, most), filter_id, stats, value if calc_histogram else None, n_bins, range_, tuple(x for x in (least, most) if x is not None))


def remove_low_call_rate_vars(v: Variations, min_call_rate, rates: bool = True, filter_id="call_rate", stats=True, calc_histogram=False, n_bins=BINS) -> FilterResult:
    value = G.called_rate(F.col("gt")) if rates else G.called_count(F.col("gt"))
    return _stat_filter(v, value, min_call_rate, None, filter_id, stats, calc_histogram, n_bins, (0.0, 1.0 if rates else float(v.num_samples)))


def filter_by_maf(v: Variations, max_alleles, max_allowable_maf=None, min_allowable_maf=None, min_num_genotypes=G.MIN_NUM_GENOTYPES, filter_id="maf", stats=True, calc_histogram=False, n_bins=BINS, limits=(0.0, 1.0)) -> FilterResult:
    return _stat_filter(v, G.major_freq(F.col("gt"), max_alleles, min_num_genotypes), min_allowable_maf, max_allowable_maf, filter_id, stats, calc_histogram, n_bins, limits)


def filter_by_maf_by_allele_count(v: Variations, n_alts, max_allowable_maf=None, min_allowable_maf=None, min_num_genotypes=G.MIN_NUM_GENOTYPES, filter_id="maf_by_allele_count", stats=True, calc_histogram=False, n_bins=BINS, limits=(0.0, 1.0)) -> FilterResult:
    return _stat_filter(v, G.major_freq_by_depth(F.col("gt"), F.col("ro"), F.col("ao"), n_alts, min_num_genotypes), min_allowable_maf, max_allowable_maf, filter_id, stats, calc_histogram, n_bins, limits)


def filter_by_mac(v: Variations, max_alleles, max_allowable_mac=None, min_allowable_mac=None, min_num_genotypes=G.MIN_NUM_GENOTYPES, filter_id="mac", stats=True, calc_histogram=False, n_bins=BINS, limits=None) -> FilterResult:
    return _stat_filter(v, G.major_count(F.col("gt"), max_alleles, min_num_genotypes), min_allowable_mac, max_allowable_mac, filter_id, stats, calc_histogram, n_bins, limits or (0.0, float(v.num_samples)))


def filter_by_obs_het(v: Variations, max_allowable_het=None, min_allowable_het=None, min_dp=None, max_dp=None, min_num_genotypes=G.MIN_NUM_GENOTYPES, filter_id="obs_het", stats=True, calc_histogram=False, n_bins=BINS, limits=(0.0, 1.0)) -> FilterResult:
    dp = F.col("dp") if min_dp is not None or max_dp is not None else None
    return _stat_filter(v, G.obs_het(F.col("gt"), dp, min_dp, max_dp, min_num_genotypes), min_allowable_het, max_allowable_het, filter_id, stats, calc_histogram, n_bins, limits)


def keep_variable_variations(v: Variations, max_alleles, filter_id="variable", stats=True) -> FilterResult:
    return _apply(v, G.is_variable(F.col("gt"), max_alleles), filter_id, stats)


#: Regions up to which they become one predicate, which reaches the scan; rows of bins up to which more of them are joined as a broadcast table.
PREDICATE_REGIONS, BROADCAST_BINS = 64, 500_000


def _merged(regions) -> tuple[list[str], list[tuple[str, int, int]]]:
    """Whole chromosomes, and the regions on others as intervals that don't touch, so that a row is in one at most."""
    whole = sorted({r[0] for r in regions if len(r) == 1})
    out: list[list] = []
    for chrom, start, end in sorted(r for r in regions if len(r) == 3 and r[0] not in whole and r[1] < r[2]):
        if out and out[-1][0] == chrom and start <= out[-1][2]:
            out[-1][2] = max(out[-1][2], end)
        else:
            out.append([chrom, start, end])
    return whole, [tuple(r) for r in out]


def _in_regions(whole, parts) -> Column:
    cond = F.col("chrom").isin(whole) if whole else F.lit(False)
    for chrom, start, end in parts:
        cond = cond | ((F.col("chrom") == chrom) & (F.col("pos") >= start) & (F.col("pos") < end))
    return cond


def _checked(regions) -> list[tuple]:
    out = []
    for r in regions:
        if not isinstance(r, (tuple, list)) or len(r) not in (1, 3) or not isinstance(r[0], str):
            raise ValueError(f"a region is (chrom,) or (chrom, start, end): {r!r}")
        out.append(tuple(r))
    return out


def _by_region(v: Variations, regions, keep: bool, filter_id: str, stats: bool) -> FilterResult:
    whole, parts = _merged(_checked(regions))
    if len(parts) <= PREDICATE_REGIONS:
        cond = _in_regions(whole, parts)
        return _apply(v, cond if keep else ~F.coalesce(cond, F.lit(False)), filter_id, stats)
    # by bins of positions: about four a region, so that no task has a chromosome's rows and regions
    width = max(1, sum(end - start for _, start, end in parts) // (4 * len(parts)))
    names = {c: f"__locusframe_{c}" for c in ("chrom", "bin", "start", "end")}
    table = v.df.sparkSession.createDataFrame(parts, ", ".join(f"{names[c]} {t}" for c, t in (("chrom", "string"), ("start", "long"), ("end", "long"))))
    table = table.withColumn(names["bin"], F.explode(F.expr(f"sequence({names['start']} div {width}, ({names['end']} - 1) div {width})")))
    bins = sum((end - 1) // width - start // width + 1 for _, start, end in parts)
    met = (F.col("chrom") == F.col(names["chrom"])) & (F.floor(F.col("pos") / width) == F.col(names["bin"])) & (F.col("pos") >= F.col(names["start"])) & (F.col("pos") < F.col(names["end"]))
    flagged = v.df.join(F.broadcast(table) if bins <= BROADCAST_BINS else table, met, "left")
    hit = F.col(names["chrom"]).isNotNull() | F.coalesce(_in_regions(whole, []), F.lit(False))
    got = _apply(v.with_df(flagged), hit if keep else ~hit, filter_id, stats)
    got.variations = got.variations.with_df(got.variations.df.drop(*names.values()))
    return got


def keep_variations_in_regions(v: Variations, regions, filter_id="keep_regions", stats=True) -> FilterResult:
    """Half-open regions; no regions keep nothing."""
    return _by_region(v, regions, True, filter_id, stats)


def remove_variations_in_regions(v: Variations, regions, filter_id="remove_regions", stats=True) -> FilterResult:
    return _by_region(v, regions, False, filter_id, stats)


def _by_sample(v: Variations, indices: list[int], filter_id: str) -> FilterResult:
    from ..variations import CALL_FIELDS

    df = v.df.withColumns({c: G.pick(F.col(c), indices) for c in CALL_FIELDS if c in v})
    return FilterResult(Variations(df, [v.samples[i] for i in indices], v.metadata), filter_id)


def _known(v: Variations, samples) -> None:
    if lost := [s for s in samples if s not in v.samples]:
        raise ValueError(f"unknown samples: {lost}")


def keep_samples(v: Variations, samples, filter_id="keep_samples") -> FilterResult:
    """In the set's order, whatever the order asked for."""
    _known(v, samples)
    return _by_sample(v, [i for i, s in enumerate(v.samples) if s in set(samples)], filter_id)


def remove_samples(v: Variations, samples, filter_id="remove_samples") -> FilterResult:
    _known(v, samples)
    return _by_sample(v, [i for i, s in enumerate(v.samples) if s not in set(samples)], filter_id)


def min_depth_gt_to_missing(v: Variations, min_depth: int, filter_id="min_depth") -> FilterResult:
    """Calls of less depth, or of none, become missing."""
    return FilterResult(v.with_df(v.df.withColumn("gt", G.set_missing(F.col("gt"), F.transform("dp", lambda d: d >= min_depth)))), filter_id)


def min_gq_gt_to_missing(v: Variations, min_gq: int, filter_id="min_gq") -> FilterResult:
    return FilterResult(v.with_df(v.df.withColumn("gt", G.set_missing(F.col("gt"), F.transform("gq", lambda q: q >= min_gq)))), filter_id)


def min_qual_gt_to_missing(v: Variations, min_qual: float, filter_id="min_qual") -> FilterResult:
    """All calls of a variant of less quality, or of none, become missing."""
    ok = F.coalesce(F.col("qual") >= min_qual, F.lit(False))
    return FilterResult(v.with_df(v.df.withColumn("gt", G.set_missing(F.col("gt"), F.transform("gt", lambda _: ok)))), filter_id)
