"""Statistics of one variant as column expressions over its per-sample arrays.

gt is array<array<int>> (samples, alleles of the call), -1 where an allele is missing. Depths and
qualities are array<int>, -1 where missing. A statistic that can't be computed is NULL, never NaN:
NULL fails every comparison, as it should in a filter.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING = -1
MIN_NUM_GENOTYPES = 10


def _double(c) -> Column:
    return c.cast("double")


def total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0).cast("long"), lambda acc, x: acc + x)


def real_total(array: Column) -> Column:
    return F.aggregate(array, F.lit(0.0), lambda acc, x: acc + x)


def alleles(gt: Column) -> Column:
    return F.flatten(gt)


def ploidy(gt: Column) -> Column:
    return F.size(F.get(gt, F.lit(0)))


def count_of(array: Column, value: int) -> Column:
    return F.size(F.filter(array, lambda x: x == value))


def allele_counts(gt: Column, max_alleles: int | None, count_missing: bool = False) -> Column:
    """Counts of alleles 0 .. max_alleles - 1, the missing ones last where asked for; higher alleles are not counted. None counts all alleles that the variant has."""
    a = alleles(gt)
    if max_alleles is None:
        found = F.transform(F.sequence(F.lit(0), F.greatest(F.array_max(a), F.lit(0))), lambda k: F.size(F.filter(a, lambda x: x == k)))
        return F.concat(found, F.array(count_of(a, MISSING))) if count_missing else found
    return F.array(*[count_of(a, k) for k in [*range(max_alleles), *([MISSING] if count_missing else [])]])


def missing_count(gt: Column) -> Column:
    """Missing alleles by the ploidy: a half-missing call counts as a half."""
    return F.try_divide(_double(count_of(alleles(gt), MISSING)), _double(ploidy(gt)))


def missing_rate(gt: Column) -> Column:
    return F.try_divide(missing_count(gt), _double(F.size(gt)))


def called_count(gt: Column) -> Column:
    return F.try_divide(_double(F.size(F.filter(alleles(gt), lambda x: x != MISSING))), _double(ploidy(gt)))


def called_rate(gt: Column) -> Column:
    return 1 - missing_rate(gt)


def masked(stat: Column, called: Column, least: int | None) -> Column:
    """NULL where fewer are called; None masks nothing."""
    return stat if least is None else F.when(called >= least, stat)


def major_freq(gt: Column, max_alleles: int, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    """Frequency of the most frequent allele."""
    c = allele_counts(gt, max_alleles)
    return masked(F.try_divide(_double(F.array_max(c)), _double(total(c))), called_count(gt), min_num_genotypes)


def _depths(per_sample: Column) -> Column:
    return total(F.transform(per_sample, lambda x: F.greatest(x, F.lit(0))))


def depth_totals(per_sample: Column, n: int) -> Column:
    """Sums over samples of an array<array<int>>, one for each of n alleles; -1 counts as 0."""
    # a lambda's second parameter would be the element's index, so k is bound outside it
    of_allele = lambda k: F.transform(per_sample, lambda a: F.coalesce(F.get(a, F.lit(k)), F.lit(0)))
    return F.array(*[_depths(of_allele(k)) for k in range(n)])


def major_freq_by_depth(gt: Column, ro: Column, ao: Column, n_alts: int, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    r, a = _depths(ro), depth_totals(ao, n_alts)
    return masked(F.try_divide(_double(F.greatest(r, F.array_max(a))), _double(r + total(a))), called_count(gt), min_num_genotypes)


def major_count(gt: Column, max_alleles: int, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    """Individuals that carry the most frequent allele; missing alleles count as carriers. NULL where nothing is called."""
    c = allele_counts(gt, max_alleles)
    p, n = _double(ploidy(gt)), F.size(gt)
    mac = n - F.try_divide(n * p - count_of(alleles(gt), MISSING) - F.array_max(c), p)
    return masked(F.when(total(c) > 0, mac), called_count(gt), min_num_genotypes)


def _freqs(counts: Column) -> Column:
    t = total(counts)
    return F.when(t > 0, F.transform(counts, lambda x: F.try_divide(_double(x), _double(t))))


def allele_freqs(gt: Column, max_alleles: int, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    return masked(_freqs(allele_counts(gt, max_alleles)), called_count(gt), min_num_genotypes)


def allele_freqs_by_depth(ad: Column, n_alleles: int) -> Column:
    return _freqs(depth_totals(ad, n_alleles))


def expected_het(gt: Column, max_alleles: int, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    """One less the sum of frequencies to the power of the ploidy."""
    p = _double(ploidy(gt))
    return 1 - F.aggregate(allele_freqs(gt, max_alleles, min_num_genotypes), F.lit(0.0), lambda acc, x: acc + F.pow(x, p))


def unbiased_expected_het(gt: Column, max_alleles: int, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    n2 = 2 * called_count(gt)
    return F.try_divide(n2, n2 - 1) * expected_het(gt, max_alleles, min_num_genotypes)


def is_missing(call: Column) -> Column:
    return F.exists(call, lambda x: x == MISSING)


def is_hom(call: Column) -> Column:
    return ~is_missing(call) & F.forall(call, lambda x: x == F.get(call, F.lit(0)))


def is_het(call: Column) -> Column:
    return ~is_missing(call) & F.exists(call, lambda x: x != F.get(call, F.lit(0)))


def usable(call: Column, dp: Column | None, min_dp: int | None, max_dp: int | None) -> Column:
    ok = ~is_missing(call)
    if min_dp is not None:
        ok = ok & (dp >= min_dp)
    if max_dp is not None:
        ok = ok & (dp <= max_dp)
    return ok


def het_counts(gt: Column, dp: Column | None = None, min_dp: int | None = None, max_dp: int | None = None) -> tuple[Column, Column]:
    """(heterozygous calls, calls): a call counts where no allele is missing and its depth is within the bounds."""
    if min_dp is None and max_dp is None:
        calls = F.filter(gt, lambda c: ~is_missing(c))
    else:
        pairs = F.filter(F.zip_with(gt, dp, lambda g, d: F.struct(g.alias("g"), d.alias("d"))), lambda z: usable(z["g"], z["d"], min_dp, max_dp))
        calls = F.transform(pairs, lambda z: z["g"])
    return F.size(F.filter(calls, is_het)), F.size(calls)


def obs_het(gt: Column, dp: Column | None = None, min_dp: int | None = None, max_dp: int | None = None, min_num_genotypes: int | None = MIN_NUM_GENOTYPES) -> Column:
    het, called = het_counts(gt, dp, min_dp, max_dp)
    return masked(F.try_divide(_double(het), _double(called)), called, min_num_genotypes)


def dosages(gt: Column) -> Column:
    """Per call -1 with any allele missing, 0 with reference alleles only, 1 with some, 2 with none."""
    return F.transform(gt, lambda c: F.when(is_missing(c), -1).when(F.forall(c, lambda x: x == 0), 0).when(F.exists(c, lambda x: x == 0), 1).otherwise(2))


def is_variable(gt: Column, max_alleles: int | None) -> Column:
    """Whether there is more than one allele among those below max_alleles; among all where it is None."""
    known = F.filter(alleles(gt), lambda x: (x >= 0) if max_alleles is None else (x >= 0) & (x < max_alleles))
    return F.size(F.array_distinct(known)) > 1


def set_missing(gt: Column, keep: Column) -> Column:
    """gt with the calls all missing for which keep, an array<boolean> over samples, is not true."""
    return F.zip_with(gt, keep, lambda c, k: F.when(F.coalesce(k, F.lit(False)), c).otherwise(F.transform(c, lambda _: F.lit(MISSING))))


def pick(array: Column, indices: list[int]) -> Column:
    """The elements at these places, by one expression however many there are."""
    return F.transform(F.lit([int(i) for i in indices]) if indices else F.array().cast("array<int>"), lambda i: F.get(array, i))


def harmonic_mean(*values: Column) -> Column:
    """NULL where a value is missing, zero or not finite."""
    return F.try_divide(F.lit(float(len(values))), sum((F.try_divide(F.lit(1.0), v) for v in values[1:]), F.try_divide(F.lit(1.0), values[0])))
