"""Bounded samples of labelled documents to fit a classifier on."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import residue


def training_rows(docs: DataFrame, labels: DataFrame, label: str, fold: int, held_out: int, rows: int) -> DataFrame:
    """(doc_id, text, label) of at most rows labelled documents outside the held-out fold, chosen by a hash of the id.

    The sample's ids are bounded by rows, so they are broadcast. Rows without an id or a label are
    not used; where an id has several labels the largest counts. Where documents repeat an id,
    each is a row, and the first rows by the same hash and by text stay. Empty tables give no rows.
    """
    known = labels.filter(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & (residue(F.col("doc_id"), fold) != held_out))
    chosen = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)
    found = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id")
    return found.orderBy(F.xxhash64("doc_id"), "doc_id", "text").limit(rows)
