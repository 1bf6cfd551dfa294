"""The columnar store: variants as Parquet (or ORC), samples and metadata as JSON beside them."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..variations import Variations


def write_store(v: Variations, path: str, fmt: str = "parquet", mode: str = "overwrite") -> None:
    """mode append lets a store grow; samples must be the same then, and variant_idx goes on behind the largest that is there."""
    spark, df = v.df.sparkSession, v.df
    if mode == "append":
        if read_meta(spark, path)["samples"] != list(v.samples):
            raise ValueError("the store has other samples")
        last = read_store(spark, path, []).df.agg(F.max("variant_idx")).first()[0]
        first = df.agg(F.min("variant_idx")).first()[0]
        if last is not None and first is not None:
            df = df.withColumn("variant_idx", F.col("variant_idx") + (last + 1 - first))
    df.write.mode(mode).format(fmt).save(f"{path}/variants")
    meta = json.dumps({"samples": list(v.samples), "metadata": v.metadata, "format": fmt})
    spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/meta")


def read_meta(spark, path: str) -> dict:
    return json.loads(spark.read.text(f"{path}/meta", wholetext=True).first().value)


def read_store(spark, path: str, fields: list[str] | None = None, strict: bool = False) -> Variations:
    """fields prunes the columns that are read; unknown ones are skipped, or a KeyError when strict."""
    meta = read_meta(spark, path)
    df = spark.read.format(meta["format"]).load(f"{path}/variants")
    if fields is not None:
        if strict and (lost := [f for f in fields if f not in df.columns]):
            raise KeyError(lost)
        df = df.select("variant_idx", *[f for f in fields if f in df.columns and f != "variant_idx"])
    return Variations(df, meta["samples"], meta["metadata"])


def ordered(v: Variations) -> DataFrame:
    return v.df.orderBy("variant_idx")
