"""The variant queries over the derived genotype set, and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import genotype as G
from .functions.histogram import histogram
from .operators import distances, filters, ld, multivariate, stats
from .plans.pipeline import build, step_counts
from .plans.pipeline import filter_variations as run_filters
from .sources import derived, store, vcf
from .sources.scratch import scratch

#: Alleles of the derived set, and the least number of genotypes that its small sizes allow.
ALLELES, ALTS, LEAST = 3, 2, 5
#: Digits that both sides round to.
DIGITS = 6

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def _r(name: str, c=None):
    return F.round(F.col(name) if c is None else c, DIGITS).alias(name)


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: f(spark, sf_dir)
        QUERIES[f.__name__].__doc__ = f.__doc__
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return register


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return QUERIES["flt_maf"](spark, sf_dir)


C = derived.CALLS_SQL
#: Statistics of a variant in SQL, from the long form.
STATS = C + """, per AS (
  SELECT vid AS variant_idx, chrom, pos, COUNT(*) AS n,
    CAST(SUM(CAST(a1 = 0 AS INT) + CAST(a2 = 0 AS INT)) AS BIGINT) AS c0, CAST(SUM(CAST(a1 = 1 AS INT) + CAST(a2 = 1 AS INT)) AS BIGINT) AS c1,
    CAST(SUM(CAST(a1 = 2 AS INT) + CAST(a2 = 2 AS INT)) AS BIGINT) AS c2, CAST(SUM(CAST(a1 = -1 AS INT) + CAST(a2 = -1 AS INT)) AS BIGINT) AS cm,
    CAST(SUM(GREATEST(ro, 0)) AS DOUBLE) AS d0, CAST(SUM(GREATEST(ao1, 0)) AS DOUBLE) AS d1, CAST(SUM(GREATEST(ao2, 0)) AS DOUBLE) AS d2,
    CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0) AS DOUBLE) AS called, CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND a1 <> a2) AS DOUBLE) AS het,
    CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1) AS DOUBLE) AS called_dp, CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND a1 <> a2 AND dp >= 1) AS DOUBLE) AS het_dp
  FROM calls GROUP BY vid, chrom, pos),
st AS (
  SELECT *, CAST(c0 + c1 + c2 AS DOUBLE) AS t, n - cm / 2.0::DOUBLE AS called_n,
    CASE WHEN n - cm / 2.0::DOUBLE >= 5 THEN GREATEST(c0, c1, c2) / NULLIF(CAST(c0 + c1 + c2 AS DOUBLE), 0) END AS maf,
    CASE WHEN n - cm / 2.0::DOUBLE >= 5 THEN GREATEST(d0, d1, d2) / NULLIF(d0 + d1 + d2, 0) END AS maf_dp,
    CASE WHEN n - cm / 2.0::DOUBLE >= 5 AND c0 + c1 + c2 > 0 THEN n - (2 * n - cm - GREATEST(c0, c1, c2)) / 2.0::DOUBLE END AS mac,
    CASE WHEN n - cm / 2.0::DOUBLE >= 5 AND c0 + c1 + c2 > 0 THEN 1 - (c0 * c0 + c1 * c1 + c2 * c2) / (CAST(c0 + c1 + c2 AS DOUBLE) * (c0 + c1 + c2)) END AS exp_het,
    CASE WHEN called >= 5 THEN het / NULLIF(called, 0) END AS obs_het
  FROM per)
"""
KEYS = "variant_idx, chrom, pos"


def _keyed(df: DataFrame, *cols) -> DataFrame:
    return df.select("variant_idx", "chrom", "pos", *cols)


@query(C + "SELECT vid AS variant_idx, chrom, pos, MAX(qual) AS qual, CAST(SUM(a1) AS BIGINT) AS s1, CAST(SUM(a2) AS BIGINT) AS s2, CAST(SUM(dp) AS BIGINT) AS s_dp, CAST(SUM(gq) AS BIGINT) AS s_gq, COUNT(*) AS n FROM calls GROUP BY vid, chrom, pos")
def scan_variants(spark, sf):
    df = derived.variations(spark, sf).df
    allele = lambda k: G.total(F.transform("gt", lambda c: F.get(c, F.lit(k))))
    return df.select("variant_idx", "chrom", "pos", "qual", allele(0).alias("s1"), allele(1).alias("s2"), G.total(F.col("dp")).alias("s_dp"), G.total(F.col("gq")).alias("s_gq"), F.size("gt").cast("long").alias("n"))


@query(C + "SELECT vid AS variant_idx, chrom, pos, CAST(sid AS INT) AS sample_idx, a1, a2, CAST(gq AS INT) AS gq, CAST(dp AS INT) AS dp, CAST(ro AS INT) AS ro, CAST(ao1 AS INT) AS ao1, CAST(ao2 AS INT) AS ao2 FROM calls")
def scan_calls_long(spark, sf):
    return derived.long_calls(spark, sf).select("variant_idx", "chrom", "pos", "sample_idx", "a1", "a2", "gq", "dp", "ro", F.get("ao", F.lit(0)).alias("ao1"), F.get("ao", F.lit(1)).alias("ao2"))


_CELL = "CASE WHEN {0} = -1 THEN '.' ELSE CAST({0} AS VARCHAR) END"


def _list_sql(*xs: str) -> str:
    return "regexp_replace(" + " || ',' || ".join(_CELL.format(x) for x in xs) + r", '(,\.)+$', '')"


@query(
    C
    + f"""SELECT vid AS variant_idx, chrom || chr(9) || CAST(pos AS VARCHAR) || chr(9) || '.' || chr(9) || 'A' || chr(9) || 'C,G' || chr(9)
      || regexp_replace(printf('%.4f', MAX(qual)), '(\\.\\d+?)0+$', '\\1') || chr(9) || '.' || chr(9) || '.' || chr(9) || 'GT:AD:AO:DP:GQ:RO' || chr(9)
      || string_agg({_CELL.format('a1')} || '/' || {_CELL.format('a2')} || ':' || {_list_sql('ro', 'ao1', 'ao2')} || ':' || {_list_sql('ao1', 'ao2')} || ':' || {_CELL.format('dp')} || ':' || {_CELL.format('gq')} || ':' || {_CELL.format('ro')}, chr(9) ORDER BY sid) AS line
      FROM calls GROUP BY vid, chrom, pos"""
)
def vcf_body_lines(spark, sf):
    return vcf.body_lines(derived.variations(spark, sf))


@query(C + "SELECT vid AS variant_idx, CAST(sid AS INT) AS sample_idx, CASE WHEN a1 = -1 OR a2 = -1 THEN -1 WHEN a1 = 0 AND a2 = 0 THEN 0 WHEN a1 = 0 OR a2 = 0 THEN 1 ELSE 2 END AS dosage FROM calls")
def gts_as_mat012(spark, sf):
    return derived.variations(spark, sf).df.select("variant_idx", F.posexplode(G.dosages(F.col("gt"))).alias("sample_idx", "dosage"))


def _bins_sql(value: str, weight: str | None, n: int = 40, hi: str = "1.0") -> str:
    w = f"CAST(SUM({weight}) AS BIGINT)" if weight else "COUNT(*)"
    return STATS + f""", e AS (SELECT CAST(k AS INT) AS bin, k * ({hi}::DOUBLE / {n}) AS lo, CASE WHEN k = {n - 1} THEN {hi}::DOUBLE ELSE (k + 1) * ({hi}::DOUBLE / {n}) END AS hi FROM range({n}) r(k)),
      h AS (SELECT e.bin, {w} AS n FROM st JOIN e ON {value} >= e.lo AND ({value} < e.hi OR (e.bin = {n - 1} AND {value} = e.hi)) GROUP BY e.bin)
      SELECT e.bin, ROUND(e.lo, 6) AS lo, ROUND(e.hi, 6) AS hi, COALESCE(h.n, 0) AS n FROM e LEFT JOIN h ON h.bin = e.bin"""


@query(_bins_sql("maf", None))
def histogram_maf(spark, sf):
    df = stats.maf_by_gt(derived.variations(spark, sf), ALLELES, LEAST)
    return histogram(df, F.col("maf"), limits=(0.0, 1.0)).select("bin", _r("lo"), _r("hi"), "n")


@query(_bins_sql("maf", "c1", 20))
def histogram_weighted(spark, sf):
    df = derived.variations(spark, sf).df
    return histogram(df, G.major_freq(F.col("gt"), ALLELES, LEAST), 20, (0.0, 1.0), F.get(G.allele_counts(F.col("gt"), ALLELES), F.lit(1)).cast("long")).select("bin", _r("lo"), _r("hi"), "n")


@query(STATS + f"SELECT {KEYS}, ROUND(cm / 2.0::DOUBLE / n, 6) AS missing FROM st")
def missing_gt(spark, sf):
    return _keyed(stats.missing_gt(derived.variations(spark, sf)), _r("missing"))


@query(STATS + f"SELECT {KEYS}, ROUND(called_n, 6) AS called FROM st")
def called_gt(spark, sf):
    return _keyed(stats.called_gt(derived.variations(spark, sf), rates=False), _r("called"))


@query(STATS + f"SELECT {KEYS}, CAST(c0 AS INT) AS a0, CAST(c1 AS INT) AS a1, CAST(c2 AS INT) AS a2, CAST(cm AS INT) AS missing FROM st")
def allele_counts(spark, sf):
    df = stats.allele_counts(derived.variations(spark, sf), ALLELES)
    return _keyed(df, *[F.get("counts", F.lit(k)).alias(n) for k, n in enumerate(("a0", "a1", "a2", "missing"))])


@query(STATS + f"SELECT {KEYS}, ROUND(maf, 6) AS maf FROM st")
def maf_by_gt(spark, sf):
    return _keyed(stats.maf_by_gt(derived.variations(spark, sf), ALLELES, LEAST), _r("maf"))


@query(STATS + f"SELECT {KEYS}, ROUND(maf_dp, 6) AS maf FROM st")
def maf_by_allele_count(spark, sf):
    return _keyed(stats.maf_by_allele_count(derived.variations(spark, sf), ALTS, LEAST), _r("maf"))


@query(STATS + f"SELECT {KEYS}, ROUND(mac, 6) AS mac FROM st")
def mac(spark, sf):
    return _keyed(stats.mac(derived.variations(spark, sf), ALLELES, LEAST), _r("mac"))


def _freq_sql(xs: str, cond: str, total: str) -> str:
    return ", ".join(f"ROUND(CASE WHEN {cond} THEN {x} / NULLIF({total}, 0) END, 6) AS f{k}" for k, x in enumerate(xs.split()))


def _freq_cols():
    return [_r(f"f{k}", F.get("freqs", F.lit(k))) for k in range(ALLELES)]


@query(STATS + f"SELECT {KEYS}, {_freq_sql('c0 c1 c2', 'called_n >= 5', 't')} FROM st")
def allele_freq(spark, sf):
    return _keyed(stats.allele_freq(derived.variations(spark, sf), ALLELES, LEAST), *_freq_cols())


@query(STATS + f"SELECT {KEYS}, {_freq_sql('d0 d1 d2', 'TRUE', 'd0 + d1 + d2')} FROM st")
def allele_freq_by_depth(spark, sf):
    return _keyed(stats.allele_freq_by_depth(derived.variations(spark, sf), ALLELES), *_freq_cols())


@query(STATS + f"SELECT {KEYS}, ROUND(exp_het, 6) AS exp_het FROM st")
def expected_het(spark, sf):
    return _keyed(stats.expected_het(derived.variations(spark, sf), ALLELES, LEAST), _r("exp_het"))


@query(STATS + f"SELECT {KEYS}, ROUND(2 * called_n / NULLIF(2 * called_n - 1, 0) * exp_het, 6) AS exp_het FROM st")
def unbiased_expected_het(spark, sf):
    return _keyed(stats.unbiased_expected_het(derived.variations(spark, sf), ALLELES, LEAST), _r("exp_het"))


@query(STATS + f"SELECT {KEYS}, ROUND(CASE WHEN called_dp >= 5 THEN het_dp / NULLIF(called_dp, 0) END, 6) AS obs_het FROM st")
def obs_het(spark, sf):
    return _keyed(stats.obs_het(derived.variations(spark, sf), LEAST, 1), _r("obs_het"))


@query(C + """SELECT CAST(sid AS INT) AS sample_idx, COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1 AND a1 <> a2) AS het, COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1) AS called,
  ROUND(CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1 AND a1 <> a2) AS DOUBLE) / NULLIF(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1), 0), 6) AS obs_het FROM calls GROUP BY sid""")
def obs_het_per_sample(spark, sf):
    return stats.obs_het_per_sample(derived.variations(spark, sf), 1).select("sample_idx", "het", "called", _r("obs_het"))


@query(STATS + "SELECT COUNT(*) FILTER (maf < 0.9999999999) AS num_variable, COUNT(*) FILTER (maf <= 0.95) AS num_polymorphic, ROUND(AVG(exp_het), 6) AS exp_het, ROUND(AVG(CASE WHEN called_dp >= 5 THEN het_dp / NULLIF(called_dp, 0) END), 6) AS obs_het, COUNT(*) AS num_variations FROM st")
def diversities(spark, sf):
    df = stats.diversities(derived.variations(spark, sf), ALLELES, LEAST, 1)
    return df.select("num_variable", "num_polymorphic", _r("exp_het"), _r("obs_het"), "num_variations")


@query(
    STATS
    + """, k AS (SELECT 'called' AS kind, 1.0::DOUBLE AS top UNION ALL SELECT 'mac', 25.0::DOUBLE UNION ALL SELECT 'maf', 1.0::DOUBLE UNION ALL SELECT 'obs_het', 1.0::DOUBLE),
    e AS (SELECT kind, CAST(b AS INT) AS bin, b * (top / 40) AS lo, CASE WHEN b = 39 THEN top ELSE (b + 1) * (top / 40) END AS hi FROM k, range(40) r(b)),
    x AS (SELECT 'called' AS kind, 1 - cm / 2.0::DOUBLE / n AS v FROM st UNION ALL SELECT 'mac', mac FROM st UNION ALL SELECT 'maf', maf FROM st
          UNION ALL SELECT 'obs_het', CASE WHEN called_dp >= 5 THEN het_dp / NULLIF(called_dp, 0) END FROM st),
    h AS (SELECT e.kind, e.bin, COUNT(*) AS n FROM x JOIN e ON e.kind = x.kind AND v >= lo AND (v < hi OR (e.bin = 39 AND v = hi)) GROUP BY e.kind, e.bin)
    SELECT e.kind, e.bin, ROUND(lo, 6) AS lo, ROUND(hi, 6) AS hi, COALESCE(h.n, 0) AS n FROM e LEFT JOIN h ON h.kind = e.kind AND h.bin = e.bin"""
)
def summarize(spark, sf):
    return stats.summary(derived.variations(spark, sf), ALLELES, 1, LEAST).select("kind", "bin", _r("lo"), _r("hi"), "n")


def _kept(result) -> DataFrame:
    return result.variations.df.select("variant_idx", "chrom", "pos")


@query(STATS + f"SELECT {KEYS} FROM st WHERE 1 - cm / 2.0::DOUBLE / n >= 0.7")
def flt_call_rate(spark, sf):
    return _kept(filters.remove_low_call_rate_vars(derived.variations(spark, sf), 0.7, stats=False))


@query(STATS + f"SELECT {KEYS}, ROUND(maf, 6) AS maf FROM st WHERE maf <= 0.95")
def flt_maf(spark, sf):
    v = filters.filter_by_maf(derived.variations(spark, sf), ALLELES, 0.95, None, LEAST, stats=False).variations
    return _keyed(stats.maf_by_gt(v, ALLELES, LEAST), _r("maf"))


@query(STATS + f"SELECT {KEYS} FROM st WHERE maf_dp <= 0.6 AND maf_dp >= 0.4")
def flt_maf_by_allele_count(spark, sf):
    return _kept(filters.filter_by_maf_by_allele_count(derived.variations(spark, sf), ALTS, 0.6, 0.4, LEAST, stats=False))


@query(STATS + f"SELECT {KEYS} FROM st WHERE mac <= 18 AND mac >= 10")
def flt_mac(spark, sf):
    return _kept(filters.filter_by_mac(derived.variations(spark, sf), ALLELES, 18, 10, LEAST, stats=False))


@query(STATS + f"SELECT {KEYS} FROM st WHERE obs_het <= 0.5 AND obs_het >= 0.2")
def flt_obs_het(spark, sf):
    return _kept(filters.filter_by_obs_het(derived.variations(spark, sf), 0.5, 0.2, min_num_genotypes=LEAST, stats=False))


@query(STATS + f"SELECT {KEYS} FROM st WHERE CAST(c0 > 0 AS INT) + CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT) > 1")
def flt_variable(spark, sf):
    return _kept(filters.keep_variable_variations(derived.variations(spark, sf), ALLELES, stats=False))


REGIONS = [("chr1", 0, 5000), ("chr3",)]
_IN = "((chrom = 'chr1' AND pos >= 0 AND pos < 5000) OR chrom = 'chr3')"


@query(STATS + f"SELECT {KEYS} FROM st WHERE {_IN}")
def keep_regions(spark, sf):
    return _kept(filters.keep_variations_in_regions(derived.variations(spark, sf), REGIONS, stats=False))


@query(STATS + f"SELECT {KEYS} FROM st WHERE NOT {_IN}")
def remove_regions(spark, sf):
    return _kept(filters.remove_variations_in_regions(derived.variations(spark, sf), REGIONS, stats=False))


CHOSEN = ["3", "1", "7"]
_SAMPLES = "SELECT vid AS variant_idx, CAST(RANK() OVER (PARTITION BY vid ORDER BY sid) - 1 AS INT) AS sample_idx, a1, a2, CAST(dp AS INT) AS dp FROM calls WHERE sid "


def _calls(v) -> DataFrame:
    return v.long().select("variant_idx", "sample_idx", "a1", "a2", "dp")


@query(C + _SAMPLES + "IN (3, 1, 7)")
def keep_samples(spark, sf):
    return _calls(filters.keep_samples(derived.variations(spark, sf), CHOSEN).variations)


@query(C + _SAMPLES + "NOT IN (3, 1, 7)")
def remove_samples(spark, sf):
    return _calls(filters.remove_samples(derived.variations(spark, sf), CHOSEN).variations)


def _masked_sql(cond: str) -> str:
    return C + f"SELECT vid AS variant_idx, CAST(sid AS INT) AS sample_idx, CASE WHEN {cond} THEN a1 ELSE -1 END AS a1, CASE WHEN {cond} THEN a2 ELSE -1 END AS a2, CAST(dp AS INT) AS dp FROM calls"


@query(_masked_sql("dp >= 2"))
def min_depth_to_missing(spark, sf):
    return _calls(filters.min_depth_gt_to_missing(derived.variations(spark, sf), 2).variations)


@query(_masked_sql("gq >= 30"))
def min_gq_to_missing(spark, sf):
    return _calls(filters.min_gq_gt_to_missing(derived.variations(spark, sf), 30).variations)


@query(_masked_sql("qual >= 1000"))
def min_qual_to_missing(spark, sf):
    return _calls(filters.min_qual_gt_to_missing(derived.variations(spark, sf), 1000.0).variations)


STEPS = (
    C
    + """, per AS (
      SELECT vid, chrom, pos, COUNT(*) AS n, SUM(CAST(a1 = 0 AS INT) + CAST(a2 = 0 AS INT)) AS c0, SUM(CAST(a1 = 1 AS INT) + CAST(a2 = 1 AS INT)) AS c1, SUM(CAST(a1 = 2 AS INT) + CAST(a2 = 2 AS INT)) AS c2,
        SUM(CAST(a1 = -1 AS INT) + CAST(a2 = -1 AS INT)) AS cm, CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0) AS DOUBLE) AS called, CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND a1 <> a2) AS DOUBLE) AS het
      FROM (SELECT vid, chrom, pos, sid, CASE WHEN dp >= 1 THEN a1 ELSE -1 END AS a1, CASE WHEN dp >= 1 THEN a2 ELSE -1 END AS a2 FROM calls) GROUP BY vid, chrom, pos),
    f AS (SELECT *, NOT (chrom = 'chr1' AND pos >= 0 AND pos < 5000) AS k1, CAST(c0 > 0 AS INT) + CAST(c1 > 0 AS INT) + CAST(c2 > 0 AS INT) > 1 AS k2,
        COALESCE(n - cm / 2.0::DOUBLE >= 5 AND c0 + c1 + c2 > 0 AND n - (2 * n - cm - GREATEST(c0, c1, c2)) / 2.0::DOUBLE <= 20, FALSE) AS k3,
        1 - cm / 2.0::DOUBLE / n >= 0.5 AS k4, COALESCE(called >= 5 AND het / NULLIF(called, 0) <= 0.6, FALSE) AS k5 FROM per)
"""
)
STEP_COUNTS = STEPS + """
    SELECT 1 AS step_no, 'remove_regions' AS step, COUNT(*) FILTER (k1) AS n_kept, COUNT(*) FILTER (NOT k1) AS n_filtered_out FROM f
    UNION ALL SELECT 2, 'variable', COUNT(*) FILTER (k1 AND k2), COUNT(*) FILTER (k1 AND NOT k2) FROM f
    UNION ALL SELECT 3, 'mac', COUNT(*) FILTER (k1 AND k2 AND k3), COUNT(*) FILTER (k1 AND k2 AND NOT k3) FROM f
    UNION ALL SELECT 4, 'call_rate', COUNT(*) FILTER (k1 AND k2 AND k3 AND k4), COUNT(*) FILTER (k1 AND k2 AND k3 AND NOT k4) FROM f
    UNION ALL SELECT 5, 'obs_het', COUNT(*) FILTER (k1 AND k2 AND k3 AND k4 AND k5), COUNT(*) FILTER (k1 AND k2 AND k3 AND k4 AND NOT k5) FROM f"""


@query(STEP_COUNTS)
def pipeline_stats(spark, sf):
    v = derived.variations(spark, sf)
    return step_counts(v, [
        ("remove_regions", lambda gt: ~((F.col("chrom") == "chr1") & (F.col("pos") >= 0) & (F.col("pos") < 5000))),
        ("set_min_depth", lambda gt: G.set_missing(gt, F.transform("dp", lambda d: d >= 1))),
        ("variable", lambda gt: G.is_variable(gt, ALLELES)),
        ("mac", lambda gt: G.major_count(gt, ALLELES, LEAST) <= 20),
        ("call_rate", lambda gt: G.called_rate(gt) >= 0.5),
        ("obs_het", lambda gt: G.obs_het(gt, min_num_genotypes=LEAST) <= 0.6),
    ])


STEP_PARAMETERS = {"regions_to_remove": [("chr1", 0, 5000)], "min_dp_setter": 1, "remove_non_variable_snvs": True, "max_allowable_mac": 5, "min_call_rate": 0.5, "max_allowable_het": 0.6, "min_call_dp_for_het_call": 0, "min_num_genotypes": LEAST}


@query(STEP_COUNTS)
def filter_counters(spark, sf):
    """The driver of the filters with its counters, all from one pass."""
    v, results = build(derived.variations(spark, sf), **STEP_PARAMETERS)
    v.df.write.format("noop").mode("overwrite").save()
    counted = [(r.filter_id, r.stats()) for r in results if r.observation is not None]
    rows = [(k, name, s["n_kept"], s["n_filtered_out"]) for k, (name, s) in enumerate(counted, 1)]
    return spark.createDataFrame(rows, "step_no int, step string, n_kept long, n_filtered_out long")


@query(STEPS + "SELECT vid AS variant_idx, chrom, pos FROM f WHERE k1 AND k2 AND k3 AND k4 AND k5")
def filter_variations(spark, sf):
    """From a store to a store."""
    folder = scratch(spark, "filter")
    store.write_store(derived.variations(spark, sf), f"{folder}/in")
    run_filters(spark, f"{folder}/in", f"{folder}/out", verbose=False, **STEP_PARAMETERS)
    return store.read_store(spark, f"{folder}/out", ["chrom", "pos"]).df


@query(C + "SELECT vid AS variant_idx, CAST(SUM(GREATEST(gq, 0)) AS BIGINT) AS s_gq, CAST(SUM(CAST(a1 = 1 AS INT)) AS BIGINT) AS ones FROM calls GROUP BY vid")
def store_scan(spark, sf):
    """Written as a store in two parts, the second appended; three columns of it are read."""
    folder, v = scratch(spark, "store"), derived.variations(spark, sf)
    first = v.df.agg(F.min("variant_idx"), F.max("variant_idx")).first()
    middle = (first[0] + first[1]) // 2
    store.write_store(v.with_df(v.df.filter(F.col("variant_idx") <= middle)), folder)
    store.write_store(v.with_df(v.df.filter(F.col("variant_idx") > middle)), folder, mode="append")
    df = store.read_store(spark, folder, ["gt", "gq"], strict=True).df
    return df.select("variant_idx", G.total(F.transform("gq", lambda x: F.greatest(x, F.lit(0)))).alias("s_gq"), F.size(F.filter("gt", lambda c: F.get(c, F.lit(0)) == 1)).cast("long").alias("ones"))


@query(C + """SELECT CAST(DENSE_RANK() OVER (ORDER BY vid) - 1 AS BIGINT) AS variant_idx, chrom, pos, ROUND(qual, 4) AS qual, CAST(sid AS INT) AS sample_idx, a1, a2,
  CAST(gq AS INT) AS gq, CAST(dp AS INT) AS dp, CAST(ro AS INT) AS ro, CAST(ao1 AS INT) AS ao1, CAST(ao2 AS INT) AS ao2 FROM calls""")
def vcf_roundtrip(spark, sf):
    """Written as VCF text by the executors and read again."""
    folder = scratch(spark, "vcf")
    vcf.write_vcf_parts(derived.variations(spark, sf), folder)
    v = vcf.read_vcf(spark, f"{folder}/{{header,body}}")
    calls = v.long().join(v.df.select("variant_idx", F.round("qual", 4).alias("qual")), "variant_idx")
    return calls.select("variant_idx", "chrom", "pos", "qual", "sample_idx", "a1", "a2", "gq", "dp", "ro", F.get("ao", F.lit(0)).alias("ao1"), F.get("ao", F.lit(1)).alias("ao2"))


MANY = [(f"chr{k % 5 + 1}", k * 97, k * 97 + 150) for k in range(400)]
_IN_MANY = "EXISTS (SELECT 1 FROM range(400) r(k) WHERE chrom = 'chr' || CAST(k % 5 + 1 AS VARCHAR) AND pos >= k * 97 AND pos < k * 97 + 150)"


@query(STATS + f"SELECT {KEYS} FROM st WHERE {_IN_MANY}")
def regions_many(spark, sf):
    """More regions than a predicate takes, some of which overlap."""
    return _kept(filters.keep_variations_in_regions(derived.variations(spark, sf), MANY, stats=False))


@query(STATS + f"SELECT {KEYS} FROM st WHERE variant_idx >= 50 AND variant_idx < 150")
def get_vars_slice(spark, sf):
    return derived.variations(spark, sf).get_vars(slice(50, 150)).df.select("variant_idx", "chrom", "pos")


@query(C + """, d AS (SELECT x.sid AS i, y.sid AS j,
    CAST(x.a1 = y.a1 OR x.a1 = y.a2 AS INT) + CAST(x.a2 = y.a1 OR x.a2 = y.a2 AS INT) + CAST(y.a1 = x.a1 OR y.a1 = x.a2 AS INT) + CAST(y.a2 = x.a1 OR y.a2 = x.a2 AS INT) AS s,
    x.a1 >= 0 AND x.a2 >= 0 AND y.a1 >= 0 AND y.a2 >= 0 AS ok
    FROM calls x JOIN calls y ON x.vid = y.vid AND x.sid < y.sid)
  SELECT CAST(i AS INT) AS i, CAST(j AS INT) AS j, COUNT(*) FILTER (ok) AS n,
    ROUND(SUM(CASE WHEN ok THEN CASE WHEN s = 0 THEN 1.0::DOUBLE WHEN s = 4 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END END) / NULLIF(COUNT(*) FILTER (ok), 0), 6) AS dist FROM d GROUP BY i, j""")
def kosman(spark, sf):
    return distances.kosman_dist(derived.variations(spark, sf)).select("i", "j", "n", _r("dist"))


_POP_FREQS = """, f AS (SELECT vid, pop, COUNT(*) AS n, SUM(CAST(a1 >= 0 AS INT) + CAST(a2 >= 0 AS INT)) / 2.0::DOUBLE AS cn,
      CAST(SUM(CAST(a1 = 0 AS INT) + CAST(a2 = 0 AS INT)) AS DOUBLE) AS c0, CAST(SUM(CAST(a1 = 1 AS INT) + CAST(a2 = 1 AS INT)) AS DOUBLE) AS c1, CAST(SUM(CAST(a1 = 2 AS INT) + CAST(a2 = 2 AS INT)) AS DOUBLE) AS c2,
      CAST(SUM(GREATEST(ro, 0)) AS DOUBLE) AS d0, CAST(SUM(GREATEST(ao1, 0)) AS DOUBLE) AS d1, CAST(SUM(GREATEST(ao2, 0)) AS DOUBLE) AS d2,
      CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1) AS DOUBLE) AS c, CAST(COUNT(*) FILTER (a1 >= 0 AND a2 >= 0 AND dp >= 1 AND a1 <> a2) AS DOUBLE) AS h
    FROM calls GROUP BY vid, pop)"""
_NEI = """, s AS (SELECT x.pop AS p1, y.pop AS p2, SUM(x.p0 * y.p0 + x.p1_ * y.p1_ + x.p2_ * y.p2_) AS jxy, SUM(x.u) AS jx, SUM(y.u) AS jy FROM q x JOIN q y ON x.vid = y.vid AND x.pop < y.pop GROUP BY x.pop, y.pop)
  SELECT CAST(p1 AS INT) AS p1, CAST(p2 AS INT) AS p2, ROUND({d}, 6) AS dist FROM s"""
_D = "CASE WHEN jxy / NULLIF(sqrt(jx * jy), 0) = 0 THEN 'Infinity'::DOUBLE ELSE -ln(jxy / NULLIF(sqrt(jx * jy), 0)) END"


@query(C + _POP_FREQS + """, t AS (SELECT vid, pop, n, CASE WHEN cn >= 2 THEN c0 / NULLIF(c0 + c1 + c2, 0) END AS p0, CASE WHEN cn >= 2 THEN c1 / NULLIF(c0 + c1 + c2, 0) END AS p1_, CASE WHEN cn >= 2 THEN c2 / NULLIF(c0 + c1 + c2, 0) END AS p2_ FROM f),
  q AS (SELECT *, (2 * n * (p0 * p0 + p1_ * p1_ + p2_ * p2_) - 1) / (2 * n - 1) AS u FROM t)""" + _NEI.format(d=f"CASE WHEN {_D} < 0 THEN 0 ELSE {_D} END"))
def nei_unbiased(spark, sf):
    return distances.nei_dists(derived.variations(spark, sf), ALLELES, derived.populations(spark, sf), 2).select("p1", "p2", _r("dist"))


@query(C + _POP_FREQS + """, t AS (SELECT vid, pop, d0 / NULLIF(d0 + d1 + d2, 0) AS p0, d1 / NULLIF(d0 + d1 + d2, 0) AS p1_, d2 / NULLIF(d0 + d1 + d2, 0) AS p2_ FROM f),
  q AS (SELECT *, p0 * p0 + p1_ * p1_ + p2_ * p2_ AS u FROM t)""" + _NEI.format(d=_D))
def nei_by_depth(spark, sf):
    return distances.nei_dists_by_depth(derived.variations(spark, sf), ALLELES, derived.populations(spark, sf)).select("p1", "p2", _r("dist"))


@query(C + _POP_FREQS + """, q AS (SELECT vid, pop, c, h / NULLIF(c, 0) AS o, c0 / NULLIF(c0 + c1 + c2, 0) AS f0, c1 / NULLIF(c0 + c1 + c2, 0) AS f1, c2 / NULLIF(c0 + c1 + c2, 0) AS f2 FROM f),
  m AS (SELECT x.pop AS p1, y.pop AS p2, ((1 - x.f0 * x.f0 - x.f1 * x.f1 - x.f2 * x.f2) + (1 - y.f0 * y.f0 - y.f1 * y.f1 - y.f2 * y.f2)) / 2 AS hs,
      1 - pow((x.f0 + y.f0) / 2, 2) - pow((x.f1 + y.f1) / 2, 2) - pow((x.f2 + y.f2) / 2, 2) AS ht, COALESCE((x.o + y.o) / 2, x.o, y.o) AS o,
      2 / NULLIF(1 / NULLIF(x.c, 0) + 1 / NULLIF(y.c, 0), 0) AS nn, x.c AS cx, y.c AS cy FROM q x JOIN q y ON x.vid = y.vid AND x.pop < y.pop),
  k AS (SELECT *, nn / NULLIF(nn - 1, 0) * (hs - o / (2 * nn)) AS hs2 FROM m WHERE cx >= 2 AND cy >= 2),
  a AS (SELECT p1, p2, AVG(hs2) AS hs, AVG(ht + hs2 / (2 * nn) - o / (4 * nn)) AS ht FROM k GROUP BY p1, p2),
  e AS (SELECT DISTINCT x.pop AS p1, y.pop AS p2 FROM f x JOIN f y ON x.pop < y.pop)
  SELECT CAST(e.p1 AS INT) AS p1, CAST(e.p2 AS INT) AS p2, ROUND(2 * (ht - hs) / NULLIF(1 - hs, 0), 6) AS dist FROM e LEFT JOIN a ON a.p1 = e.p1 AND a.p2 = e.p2""")
def dest_jost(spark, sf):
    return distances.dset_dists(derived.variations(spark, sf), ALLELES, derived.populations(spark, sf), 2, 1).select("p1", "p2", _r("dist"))


_DOSE = """, g AS (SELECT vid, chrom, pos, sid, CASE WHEN a1 = -1 OR a2 = -1 THEN NULL WHEN a1 = 0 AND a2 = 0 THEN 0 WHEN a1 = 0 OR a2 = 0 THEN 1 ELSE 2 END AS d FROM calls WHERE vid IN (SELECT variant_idx FROM st WHERE maf <= 0.95))"""
_R = """COUNT(*) AS n, CAST(SUM(x.d) AS DOUBLE) AS sx, CAST(SUM(y.d) AS DOUBLE) AS sy, CAST(SUM(x.d * x.d) AS DOUBLE) AS sxx, CAST(SUM(y.d * y.d) AS DOUBLE) AS syy, CAST(SUM(x.d * y.d) AS DOUBLE) AS sxy"""
_RHO = "(n * sxy - sx * sy) / NULLIF(sqrt((n * sxx - sx * sx) * (n * syy - sy * sy)), 0)"


def _checked(spark, sf):
    """Nearly fixed variants are refused by the check, so they are filtered first."""
    return filters.filter_by_maf(derived.variations(spark, sf), ALLELES, 0.95, None, LEAST, stats=False).variations


@query(STATS + _DOSE + f""", s AS (SELECT x.vid AS variant_idx1, y.vid AS variant_idx2, x.chrom, x.pos AS pos1, y.pos AS pos2, y.pos - x.pos AS dist, {_R}
    FROM g x JOIN g y ON x.sid = y.sid AND x.chrom = y.chrom AND y.pos > x.pos AND y.pos - x.pos <= 300 WHERE x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, ABS({_RHO}) AS ld FROM s WHERE n >= 5)
  SELECT variant_idx1, variant_idx2, chrom, pos1, pos2, dist, ROUND(ld, 6) AS ld FROM r WHERE ld IS NOT NULL""")
def ld_along_genome(spark, sf):
    df = ld.ld_along_genome(_checked(spark, sf), 300, ALLELES, LEAST)
    return df.select("variant_idx1", "variant_idx2", "chrom", "pos1", "pos2", "dist", _r("ld"))


@query(STATS + f""", n AS (SELECT MIN(variant_idx) AS lo, COUNT(*) AS n FROM st),
  k AS (SELECT k, lo + ((k * 2654435761 + 40503) % 4294967296) % n AS v1, lo + ((k * 2246822519 + 3266489 + 374761393) % 4294967296) % n AS v2 FROM n, range(900) r(k)),
  g AS (SELECT vid, chrom, sid, CASE WHEN a1 = -1 OR a2 = -1 THEN NULL WHEN a1 = 0 AND a2 = 0 THEN 0 WHEN a1 = 0 OR a2 = 0 THEN 1 ELSE 2 END AS d FROM calls),
  s AS (SELECT k.k, x.chrom AS chrom1, x.vid AS variant_idx1, y.chrom AS chrom2, y.vid AS variant_idx2, {_R} FROM k JOIN g x ON x.vid = v1 JOIN g y ON y.vid = v2 AND x.sid = y.sid AND x.chrom <> y.chrom WHERE x.d IS NOT NULL AND y.d IS NOT NULL GROUP BY ALL),
  r AS (SELECT *, {_RHO} AS r FROM s WHERE n >= 5)
  SELECT k, chrom1, variant_idx1, chrom2, variant_idx2, ROUND(r, 6) AS r FROM r WHERE r IS NOT NULL ORDER BY k LIMIT 200""")
def ld_random_pairs(spark, sf):
    df = ld.ld_random_pairs(derived.variations(spark, sf), 200, ALLELES, min_num_gts=LEAST, check=False)
    return df.select("k", "chrom1", "variant_idx1", "chrom2", "variant_idx2", _r("r"))


GRAM = C + """, d AS (SELECT vid, sid, CASE WHEN a1 = -1 OR a2 = -1 THEN -1.0::DOUBLE WHEN a1 = 0 AND a2 = 0 THEN 0 WHEN a1 = 0 OR a2 = 0 THEN 1 ELSE 2 END AS d FROM calls),
  c AS (SELECT vid, sid, d - AVG(d) OVER (PARTITION BY vid) AS d FROM d)
  SELECT CAST(x.sid AS INT) AS i, CAST(y.sid AS INT) AS j, ROUND(SUM(x.d * y.d), 6) AS value FROM c x JOIN c y ON x.vid = y.vid AND x.sid <= y.sid GROUP BY x.sid, y.sid"""


@query(GRAM)
def pca_gram(spark, sf):
    return multivariate.gram(derived.variations(spark, sf)).select("i", "j", _r("value"))


@query(GRAM)
def pca_projections(spark, sf):
    """Products of the samples' projections over all components: free of the components' signs, and equal to the Gram matrix."""
    table = multivariate.projections_table(spark, multivariate.pca(derived.variations(spark, sf))).select("sample_idx", "component", "projection")
    other = table.select(F.col("sample_idx").alias("j"), "component", F.col("projection").alias("other"))
    both = table.join(other, "component").filter("sample_idx <= j")
    return both.groupBy(F.col("sample_idx").alias("i"), "j").agg(F.sum(F.col("projection") * F.col("other")).alias("value")).select("i", "j", _r("value"))
