"""Histograms of equal bins in limits; the last bin is closed, what is outside or missing is left out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 40


def edges_of(bins: int, lo: float, hi: float) -> list[float]:
    step = (hi - lo) / bins
    return [lo + k * step for k in range(bins)] + [float(hi)]


def bin_of(value: Column, edges: list[float]) -> Column:
    """The bin's number by comparison with the edges, so that values on an edge fall where the edge says; NULL outside."""
    e = F.array(*[F.lit(float(x)) for x in edges])
    below = F.size(F.filter(e, lambda x: x <= value)) - 1
    inside = (value >= edges[0]) & (value <= edges[-1]) & ~F.isnan(value)
    return F.when(inside, F.least(below, F.lit(len(edges) - 2)))


def histogram(df: DataFrame, value: Column, bins: int = BINS, limits: tuple[float, float] | None = None, weight: Column | None = None) -> DataFrame:
    """(bin, lo, hi, n) for each bin, empty ones too; n sums the weights where there are any. Without limits those of the data."""
    value = value.cast("double")
    if limits is None:
        finite = F.when(F.abs(value) < float("inf"), value)
        lo, hi = df.agg(F.min(finite), F.max(finite)).first()
        lo, hi = (0.0, 1.0) if lo is None else (lo, hi) if lo < hi else (lo - 0.5, hi + 0.5)
        limits = (lo, hi)
    edges = edges_of(bins, *map(float, limits))
    counted = df.select(bin_of(value, edges).alias("bin"), *([] if weight is None else [weight.alias("weight")]))
    counted = counted.filter("bin is not null").groupBy("bin").agg((F.count("*") if weight is None else F.sum("weight")).alias("n"))
    e = F.array(*[F.lit(x) for x in edges])
    every = df.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", F.get(e, F.col("bin")).alias("lo"), F.get(e, F.col("bin") + 1).alias("hi"), F.coalesce("n", F.lit(0)).alias("n"))


def bins_row(value: Column, bins: int, limits: tuple[float, float]) -> list[Column]:
    """One counter for each bin, to be observed or aggregated beside others in the same pass."""
    b = bin_of(value.cast("double"), edges_of(bins, *map(float, limits)))
    return [F.count_if(F.coalesce(b == k, F.lit(False))) for k in range(bins)]
