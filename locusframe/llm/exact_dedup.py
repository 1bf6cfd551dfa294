"""Exact deduplication by deterministic block naming (DataFrame functions only).

A normalised text is cut into fixed-size blocks of bytes. Distinct blocks are sorted and
numbered, so that a block's name is an integer that no other content has; then neighbouring
names are paired, distinct pairs sorted and numbered, and so on until one name is left of each
document. Every row of every document is named, and names are given to contents, never to hashes,
so equal names of texts of one length mean equal texts. A row leaves the recursion at the level
at which it has one name.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, drop

BLOCK_BYTES = 4096
#: Texts up to which a table of their digests is broadcast: 80 bytes each.
BROADCAST_TEXTS = 500_000
SPACE = r"[\x20\x09-\x0D]+"


def _bytes_of(text):
    return F.regexp_replace(F.coalesce(text, F.lit("")), SPACE, " ").cast("binary")


def _named(contents: DataFrame, keys: list[str], keep: list[str]) -> DataFrame:
    """contents with a name for each row in place of its keys: equal contents have one, different ones have not.

    Contents that occur several times are sorted and numbered, by the place in the sorted partition
    below the partition's number; a global sort would send samples of whole blocks to the driver.
    They are written as a table of their own, so that the join to it shuffles both sides and a hot
    content can be split among tasks. One that occurs once needs no partner to be named after: its
    row gets a number below zero.
    """
    shared = contents.groupBy(*keys).agg(F.count("*").alias("uses")).filter("uses > 1").drop("uses")
    numbers = cut(shared.sortWithinPartitions(*keys).withColumn("number", F.monotonically_increasing_id()), "numbers")
    out = contents.join(numbers, keys, "left").select("n_bytes", *keep, F.coalesce(F.col("number"), -2 - F.monotonically_increasing_id()).alias("name"))
    out = cut(out, "names")
    drop(numbers)
    return out


def name_rows(rows: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """(row, n_bytes, name) of each of rows(row, n_bytes, blocks): rows with equal blocks alone have the same (n_bytes, name).

    blocks are all of block_bytes bytes but the last. The number of levels is the logarithm of the
    longest text's number of blocks; a level holds only the rows that still have several names.
    """
    blocks = rows.select("row", "n_bytes", F.posexplode("blocks").alias("idx", "block"))
    most = rows.agg(F.max(F.size("blocks"))).first()[0] or 0
    level = _named(blocks, ["n_bytes", "block"], ["row", "idx"])
    done, span = [], block_bytes
    while True:
        # texts of up to span bytes have one name by now
        done.append(level.filter(F.col("n_bytes") <= span).select("row", "n_bytes", "name"))
        if most <= 1:
            return reduce(DataFrame.unionByName, done)
        # an odd number of names carries the last one up with -1 beside it
        side = lambda k: F.max(F.when(F.col("idx") % 2 == k, F.col("name")))
        pairs = level.filter(F.col("n_bytes") > span).groupBy("row", "n_bytes", F.expr("cast(idx div 2 as int)").alias("pair")).agg(side(0).alias("l"), F.coalesce(side(1), F.lit(-1)).alias("r"))
        level = _named(cut(pairs.withColumnRenamed("pair", "idx"), "pairs"), ["n_bytes", "l", "r"], ["row", "idx"])
        span, most = 2 * span, (most + 1) // 2


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """One row (doc_id, keep_id, group_size, kept, text_sha256) for each row of docs.

    Texts are equal when equal after each run of ASCII white space has become one space; a null
    text is an empty one, and empty texts are equal to each other. The smallest id of a group
    stays. A null id is smaller than no id, so it stays only where all ids of its group are null.
    Rows that repeat an id and its text all count in group_size and are all marked alike. Texts of
    any length are named whole. No rows give no rows. Other columns are not looked at.
    """
    norm = docs.select(F.col(id_col).alias("doc_id"), _bytes_of(F.col(text_col)).alias("norm"))
    blocks = F.expr(f"transform(sequence(0, cast(greatest(octet_length(norm) - 1, 0) div {block_bytes} as int)), i -> substring(norm, i * {block_bytes} + 1, {block_bytes}))")
    # written once: the row's number, its digest and its blocks
    rows = cut(norm.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.octet_length("norm").cast("long").alias("n_bytes"), F.sha2("norm", 256).alias("text_sha256"), blocks.alias("blocks")), "rows")
    identity = cut(name_rows(rows.select("row", "n_bytes", "blocks"), block_bytes).join(rows.select("row", "doc_id", "text_sha256"), "row").drop("row"), "identity")
    # written too, so that a hot group can be split in the join
    groups = cut(identity.groupBy("n_bytes", "name").agg(F.min("doc_id").alias("keep_id"), F.count("*").alias("group_size")), "groups")
    drop(rows)
    return identity.join(groups, ["n_bytes", "name"]).select("doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def keep_first(docs: DataFrame) -> DataFrame:
    """docs with one row of each text, the same columns: the one of the smallest id, and one of the rows that repeat that id. Null texts, null ids and empty tables as in exact_dedup."""
    marks = cut(exact_dedup(docs), "marks")
    keys = marks.groupBy("doc_id", "text_sha256", "kept").agg(F.count("*").alias("n")).filter("not kept or n > 1")
    keys = cut(keys.select("doc_id", "text_sha256", "kept"), "drop")
    few = keys.count()
    rows = docs.select(F.col("doc_id").alias("doc_id"), F.sha2(_bytes_of(F.col("text")), 256).alias("text_sha256"), F.struct(*docs.columns).alias("row")).alias("a")
    met = F.expr("a.doc_id <=> b.doc_id and a.text_sha256 = b.text_sha256")
    single = rows.join(broadcast_if_small(keys, few, BROADCAST_TEXTS).alias("b"), met, "left_anti")
    repeated = rows.join(broadcast_if_small(keys.filter("kept"), few, BROADCAST_TEXTS).alias("b"), met, "left_semi").dropDuplicates(["doc_id", "text_sha256"])
    return single.unionByName(repeated).select("row.*")
