"""The filter pipeline: fixed order of steps, one pass, counters for each step, a text report."""

from __future__ import annotations

import csv
import sys
from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..operators import filters as flt
from ..sources.store import read_store, write_store
from ..variations import Variations


def build(
    v: Variations, samples_to_keep=None, samples_to_remove=None, regions_to_remove=None, regions_to_keep=None, min_call_rate=None, min_dp_setter=None,
    remove_non_variable_snvs=None, max_allowable_mac=None, max_allowable_het=None, min_call_dp_for_het_call=None, calc_histogram=False,
    max_alleles: int | None = None, min_num_genotypes=G.MIN_NUM_GENOTYPES, stats: bool = True,
) -> tuple[Variations, list[flt.FilterResult]]:
    """The steps in their order; all alleles count unless max_alleles is given. max_allowable_mac counts other than the major allele's carriers, among the samples that are kept."""
    results: list[flt.FilterResult] = []

    def step(r: flt.FilterResult) -> None:
        nonlocal v
        v = r.variations
        results.append(r)

    if samples_to_keep is not None:
        step(flt.keep_samples(v, samples_to_keep))
    if samples_to_remove is not None:
        step(flt.remove_samples(v, samples_to_remove))
    if regions_to_remove is not None:
        step(flt.remove_variations_in_regions(v, regions_to_remove, stats=stats))
    if regions_to_keep is not None:
        step(flt.keep_variations_in_regions(v, regions_to_keep, stats=stats))
    if min_dp_setter is not None:
        step(flt.min_depth_gt_to_missing(v, min_dp_setter))
    if remove_non_variable_snvs:
        step(flt.keep_variable_variations(v, max_alleles, stats=stats))
    if max_allowable_mac is not None:
        step(flt.filter_by_mac(v, max_alleles, max_allowable_mac=v.num_samples - max_allowable_mac, min_num_genotypes=min_num_genotypes, calc_histogram=calc_histogram, stats=stats))
    if min_call_rate:
        step(flt.remove_low_call_rate_vars(v, min_call_rate, calc_histogram=calc_histogram, stats=stats))
    if max_allowable_het is not None and min_call_dp_for_het_call is not None:
        step(flt.filter_by_obs_het(v, max_allowable_het=max_allowable_het, min_dp=min_call_dp_for_het_call, min_num_genotypes=min_num_genotypes, calc_histogram=calc_histogram, stats=stats))
    return v, results


def report(results: list[flt.FilterResult], out) -> None:
    for r in results:
        if not (s := r.stats()):
            continue
        name = f"Filter: {r.filter_id}"
        out.write(f"{name}\n{'-' * len(name)}\nProcessed: {s['n_kept'] + s['n_filtered_out']}\nKept vars: {s['n_kept']}\nFiltered out: {s['n_filtered_out']}\n\n")


def filter_variations(spark, in_path: str, out_path: str, verbose: bool = True, out=None, **steps) -> dict[str, dict]:
    """Reads a store, filters, writes a store; all counters come with that one write."""
    v, results = build(read_store(spark, in_path), **steps)
    write_store(v, out_path)
    if verbose:
        report(results, out or sys.stdout)
    return {r.filter_id: r.stats() for r in results}


def step_counts(v: Variations, steps: list[tuple[str, Callable]]) -> DataFrame:
    """(step_no, step, n_kept, n_filtered_out) in one aggregate; a step is a condition on gt, or a new gt where the name starts with set_."""
    df, alive, kept = v.df.withColumn("__gt", F.col("gt")), F.lit(True), []
    for k, (name, f) in enumerate(steps):
        if name.startswith("set_"):
            df = df.withColumn("__gt", f(F.col("__gt")))
            continue
        df = df.withColumn(f"__in{k}", alive).withColumn(f"__ok{k}", F.col(f"__in{k}") & F.coalesce(f(F.col("__gt")), F.lit(False)))
        alive = F.col(f"__ok{k}")
        kept.append((k, name))
    sums = df.agg(*[c for k, _ in kept for c in (F.count_if(f"__ok{k}").alias(f"kept{k}"), F.count_if(F.col(f"__in{k}") & ~F.col(f"__ok{k}")).alias(f"out{k}"))])
    rows = [F.struct(F.lit(i).alias("step_no"), F.lit(name).alias("step"), F.col(f"kept{k}").alias("n_kept"), F.col(f"out{k}").alias("n_filtered_out")) for i, (k, name) in enumerate(kept, 1)]
    return sums.select(F.explode(F.array(*rows)).alias("x")).select("x.*")


def write_histograms(results: list[flt.FilterResult], folder) -> list[Path]:
    """A table of bins for each filter that counted them, and a plot where matplotlib is there."""
    written = []
    for r in results:
        s = r.stats()
        if "counts" not in s:
            continue
        path = Path(folder) / f"{r.filter_id}.csv"
        with path.open("w", newline="") as f:
            rows = csv.writer(f)
            rows.writerow(["lo", "hi", "n"])
            rows.writerows(zip(s["bin_edges"][:-1], s["bin_edges"][1:], s["counts"]))
        written.append(path)
        plot_histogram(s["counts"], s["bin_edges"], Path(folder) / f"{r.filter_id}.png", s["limits"])
    return written


def plot_histogram(counts, edges, path, lines=()) -> bool:
    """A bar plot on a logarithmic scale with lines at the thresholds; False where matplotlib is not installed."""
    return plot_stacked_histograms([("", counts)], edges, path, lines)


def plot_stacked_histograms(series, edges, path, lines=()) -> bool:
    """Bars of (label, counts) on top of each other, over the same edges."""
    try:
        from matplotlib.backends.backend_agg import FigureCanvasAgg
        from matplotlib.figure import Figure
    except ImportError:
        return False
    figure = Figure()
    FigureCanvasAgg(figure)
    axes = figure.add_subplot()
    widths, bottom = [b - a for a, b in zip(edges[:-1], edges[1:])], [0] * (len(edges) - 1)
    for label, counts in series:
        axes.bar(edges[:-1], counts, widths, bottom=bottom, align="edge", label=label or None)
        bottom = [x + y for x, y in zip(bottom, counts)]
    axes.set_yscale("log")
    axes.set_xbound(edges[0], edges[-1])
    for x in lines:
        axes.axvline(x)
    figure.savefig(path)
    return True


def evaluate(data: dict, materialize: bool = False) -> dict:
    """A nested dict with its lazy values in place: DataFrames become lists of rows, filter results their counters.

    A filter result's variations run once; with materialize their rows are kept beside the
    counters, else only the counters.
    """
    out = {}
    for k, x in data.items():
        if isinstance(x, dict):
            out[k] = evaluate(x, materialize)
        elif isinstance(x, flt.FilterResult):
            rows = x.variations.df.collect() if materialize else x.variations.df.write.format("noop").mode("overwrite").save()
            out[k] = {"id": x.filter_id, "stats": x.stats()} | ({"rows": rows, "samples": x.variations.samples} if materialize else {})
        elif isinstance(x, Variations):
            if materialize:
                out[k] = {"rows": x.df.collect(), "samples": x.samples}
        else:
            out[k] = x.collect() if isinstance(x, DataFrame) else x
    return out
