"""A genotype set derived from the star-schema tables: a variant for each part, a sample for each nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..variations import Variations

#: The long form, as SQL that Spark and DuckDB read alike.
CALLS_SQL = """
WITH raw AS (
  SELECT l_partkey AS vid, s_nationkey AS sid, COUNT(*) AS dp,
         CAST(SUM(l_linenumber) AS BIGINT) AS s, CAST(MAX(l_linenumber) AS BIGINT) AS mx,
         CAST(SUM(l_quantity) AS BIGINT) AS gq,
         SUM(CASE WHEN l_returnflag='A' THEN 1 ELSE 0 END) AS ro,
         SUM(CASE WHEN l_returnflag='N' THEN 1 ELSE 0 END) AS ao1,
         SUM(CASE WHEN l_returnflag='R' THEN 1 ELSE 0 END) AS ao2
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY l_partkey, s_nationkey),
calls AS (
  SELECT p_partkey AS vid, CONCAT('chr', CAST(p_partkey % 5 + 1 AS VARCHAR(8))) AS chrom,
         p_partkey*10 AS pos, p_retailprice AS qual, n_nationkey AS sid, n_regionkey AS pop,
         COALESCE(r.dp,-1) AS dp, COALESCE(r.gq,-1) AS gq,
         COALESCE(r.ro,-1) AS ro, COALESCE(r.ao1,-1) AS ao1, COALESCE(r.ao2,-1) AS ao2,
         CASE WHEN r.vid IS NULL THEN -1
              WHEN (s+p_partkey) % (p_partkey % 4 + 2) = 0 THEN 1 ELSE 0 END AS a1,
         CASE WHEN r.vid IS NULL OR s % 23 = 0 THEN -1
              WHEN mx=7 AND s % 5 = 0 THEN 2
              WHEN (gq+p_partkey) % (p_partkey % 4 + 2) = 0 THEN 1 ELSE 0 END AS a2
  FROM part CROSS JOIN nation LEFT JOIN raw r ON r.vid=p_partkey AND r.sid=n_nationkey)
"""


def nations(spark: SparkSession, sf_dir: str) -> list[tuple[int, int]]:
    """(nation, region) in the samples' order; there are 25."""
    rows = spark.read.parquet(f"{sf_dir}/nation.parquet").select("n_nationkey", "n_regionkey").collect()
    return sorted((r.n_nationkey, r.n_regionkey) for r in rows)


def variations(spark: SparkSession, sf_dir: str) -> Variations:
    """The wide form. Line items are summed by part and nation and then gathered by part: at most 25 small structs a variant; samples without lines are filled in in the row, so no part meets every nation."""
    read = lambda t: spark.read.parquet(f"{sf_dir}/{t}.parquet")
    order = [n for n, _ in nations(spark, sf_dir)]
    lines = read("lineitem").join(read("supplier").select("s_suppkey", "s_nationkey"), F.col("l_suppkey") == F.col("s_suppkey"))
    flag = lambda x: F.count_if(F.col("l_returnflag") == x).alias
    raw = lines.groupBy(F.col("l_partkey").alias("vid"), F.col("s_nationkey").alias("sid")).agg(
        F.count("*").alias("dp"), F.sum("l_linenumber").alias("s"), F.max("l_linenumber").alias("mx"), F.sum("l_quantity").cast("long").alias("gq"), flag("A")("ro"), flag("N")("ao1"), flag("R")("ao2")
    )
    by_part = raw.groupBy("vid").agg(F.map_from_entries(F.collect_list(F.struct("sid", F.struct("dp", "s", "mx", "gq", "ro", "ao1", "ao2")))).alias("m"))
    part = read("part").select(F.col("p_partkey").alias("vid"), F.col("p_retailprice").alias("qual"))
    rows = part.join(by_part, "vid", "left").withColumn("c", F.transform(F.array(*[F.lit(n) for n in order]), lambda n: F.try_element_at("m", n)))
    vid = F.col("vid")
    mod = vid % 4 + 2
    first = lambda c: F.when(c.isNull(), -1).when((c["s"] + vid) % mod == 0, 1).otherwise(0)
    second = lambda c: F.when(c.isNull() | (c["s"] % 23 == 0), -1).when((c["mx"] == 7) & (c["s"] % 5 == 0), 2).when((c["gq"] + vid) % mod == 0, 1).otherwise(0)
    get = lambda c, f: F.coalesce(c[f], F.lit(-1)).cast("int")
    per = lambda f: F.transform("c", f)
    df = rows.select(
        vid.alias("variant_idx"), F.concat(F.lit("chr"), (vid % 5 + 1).cast("string")).alias("chrom"), (vid * 10).alias("pos"), F.lit(None).cast("string").alias("id"),
        F.lit("A").alias("ref"), F.array(F.lit("C"), F.lit("G")).alias("alt"), "qual", per(lambda c: F.array(first(c), second(c))).alias("gt"),
        per(lambda c: get(c, "gq")).alias("gq"), per(lambda c: get(c, "dp")).alias("dp"), per(lambda c: get(c, "ro")).alias("ro"),
        per(lambda c: F.array(get(c, "ao1"), get(c, "ao2"))).alias("ao"), per(lambda c: F.array(get(c, "ro"), get(c, "ao1"), get(c, "ao2"))).alias("ad"),
    )
    return Variations(df, [str(n) for n in order])


def populations(spark: SparkSession, sf_dir: str) -> list[list[str]]:
    """Samples by region."""
    rows = nations(spark, sf_dir)
    return [[str(n) for n, r in rows if r == p] for p in sorted({r for _, r in rows})]


def long_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variations(spark, sf_dir).long()
