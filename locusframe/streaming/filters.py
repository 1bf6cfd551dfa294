"""Filters over a stream of variants: they look at one row at a time, so they need no state."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import SparkSession

from ..sources.store import read_meta
from ..variations import Variations


def stream_store(spark: SparkSession, path: str) -> Variations:
    """A store as a stream of its variants; new files are picked up as they come."""
    meta = read_meta(spark, path)
    schema = spark.read.format(meta["format"]).load(f"{path}/variants").schema
    return Variations(spark.readStream.schema(schema).format(meta["format"]).load(f"{path}/variants"), meta["samples"], meta["metadata"])


def filter_stream(v: Variations, steps: list[Callable[[Variations], Variations]], out: str, checkpoint: str):
    """Starts a query that writes what the steps keep; it ends when all that is there has been read."""
    for step in steps:
        v = step(v)
    return v.df.writeStream.format("parquet").option("checkpointLocation", checkpoint).trigger(availableNow=True).start(out)
