"""Principal components of the samples."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import genotype as G
from ..variations import Variations


#: Samples whose matrix fits the driver and an executor: 3.2 GB.
MOST_SAMPLES = 20_000


def _centred(dosages: pa.Array, n: int) -> np.ndarray:
    x = dosages.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)
    return x - x.mean(1, keepdims=True)


def gram(v: Variations) -> DataFrame:
    """(i, j, value) for i <= j: products of samples over the variants, each variant centred over the samples. A missing call counts as -1, as in the dosages. One matrix of samples a task."""
    n = v.num_samples

    def run(batches):
        total = np.zeros((n, n))
        for b in batches:
            x = _centred(b.column(0), n)
            total += x.T @ x
        i, j = np.triu_indices(n)
        yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int32)), pa.array(j.astype(np.int32)), pa.array(total[i, j])], ["i", "j", "value"])

    return v.df.select(G.dosages(F.col("gt")).alias("d")).mapInArrow(run, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


@dataclass
class PCA:
    samples: tuple[str, ...]
    projections: np.ndarray
    var_percentages: np.ndarray
    princomps: DataFrame


def pca(v: Variations) -> PCA:
    """At most MOST_SAMPLES samples. projections: samples by components; princomps: (variant_idx, weights). Signs are arbitrary. The driver holds one matrix of samples by samples, and so does each executor for princomps."""
    n = v.num_samples
    if n > MOST_SAMPLES:
        raise ValueError(f"more than {MOST_SAMPLES} samples: the matrix of samples by samples is held whole")
    if v.num_variations < n:
        raise RuntimeError("there are fewer variants than samples")
    g = np.zeros((n, n))
    got = gram(v).toArrow()
    i, j = (got[c].to_numpy() for c in ("i", "j"))
    g[i, j] = g[j, i] = got["value"].to_numpy()
    values, vectors = np.linalg.eigh(g)
    order = np.argsort(values)[::-1]
    values, vectors = np.clip(values[order], 0, None), vectors[:, order]
    s = np.sqrt(values)
    scaled = vectors / np.where(s > 1e-9 * max(s[0], 1e-300), s, np.inf)
    shipped = v.df.sparkSession.sparkContext.broadcast(scaled)

    def run(batches):
        for b in batches:
            x = _centred(b.column("d"), n) @ shipped.value
            weights = pa.ListArray.from_arrays(np.arange(0, x.size + 1, n, dtype=np.int32), pa.array(x.ravel()))
            yield pa.RecordBatch.from_arrays([b.column("variant_idx"), weights], ["variant_idx", "weights"])

    princomps = v.df.select("variant_idx", G.dosages(F.col("gt")).alias("d")).mapInArrow(run, "variant_idx long, weights array<double>")
    return PCA(v.samples, vectors * s, values / values.sum() * 100 if values.sum() else values, princomps)


def projections_table(spark, found: PCA) -> DataFrame:
    rows = [(i, s, k + 1, float(found.projections[i, k]), float(found.var_percentages[k])) for i, s in enumerate(found.samples) for k in range(found.projections.shape[1])]
    return spark.createDataFrame(rows, "sample_idx int, sample string, component int, projection double, var_percentage double")
