import io
import math
import random

import numpy as np
import pyarrow.compute as pc
import pytest
from data import M, SAMPLES, simple, t7, values
from pyspark.sql import functions as F

from locusframe.functions import genotype as G
from locusframe.functions.histogram import bin_of, edges_of, histogram
from locusframe.operators import distances, filters, ld, multivariate, stats
from locusframe.plans import pipeline
from locusframe.sources import derived, store, vcf
from locusframe.streaming.filters import filter_stream, stream_store
from locusframe.variations import EmptyVariationsError, Variations, missing_value


def near(a, b, tol=1e-6):
    assert len(a) == len(b)
    for x, y in zip(a, b):
        assert (x is None) == (y is None), (a, b)
        if isinstance(x, (list, tuple)):
            near(x, y, tol)
        elif x is not None:
            assert abs(x - y) < tol, (a, b)


@pytest.fixture(scope="module")
def v(spark):
    return t7(spark)


def test_counts_and_dosages(v):
    assert values(stats.allele_counts(v, 3), "counts") == [[2, 2, 0, 2]] * 3 + [[3, 1, 0, 2], [0, 0, 0, 6], [1, 1, 0, 4], [1, 3, 0, 2]]
    assert values(v.df.select("variant_idx", G.dosages(F.col("gt")).alias("d")), "d") == [[-1, 0, 2]] * 3 + [[1, -1, 0], [-1, -1, -1], [-1, 1, -1], [-1, 1, 2]]


def test_counts_of_literal_sets(spark):
    a = simple(spark, [[[0, 2], M], [[0, 2], [1, -1]], [[0, 0], [1, 1]], [M, M]])
    assert values(stats.allele_counts(a, 3), "counts") == [[1, 0, 1, 2], [1, 1, 1, 1], [2, 2, 0, 0], [0, 0, 0, 4]]
    near(values(stats.maf_by_gt(a, 3, 0), "maf"), [0.5, 1 / 3, 0.5, None])
    b = simple(spark, [[[0, 0], [0, 0]], [[0, 2], [1, -1]], [[0, 0], [1, 1]], [M, M]])
    near(values(stats.mac(b, 3, 0), "mac"), [2, 1, 1, None])
    hap = simple(spark, [[[x] for x in row] for row in ([0, 0, 0, 0], [0, 0, 1, 1], [0, 0, 0, 1], [-1] * 4)])
    near(values(stats.mac(hap, 3, 1), "mac"), [4, 2, 3, None])
    assert values(stats.maf_by_gt(a, 3, 10), "maf") == [None] * 4


def test_missing_and_called(v, spark):
    two = filters.keep_samples(v, ["upv196", "pepo"]).variations
    near(values(stats.missing_gt(two, rates=False), "missing"), [1, 1, 1, 0, 2, 2, 1])
    near(values(stats.missing_gt(two), "missing"), [0.5, 0.5, 0.5, 0, 1, 1, 0.5])
    a = simple(spark, [[[0, 0]] * 4 + [[0, -1]], [[0, 0]] * 4 + [M], [[0, 0]] * 3 + [M, M], [[0, 0]] + [M] * 4])
    near(values(stats.missing_gt(a, rates=False), "missing"), [0.5, 1, 2, 4])
    near(values(stats.called_gt(a, rates=False), "called"), [4.5, 4, 3, 1])


def test_major_frequency_by_depth(spark):
    a = simple(spark, [[[0, 1]] * 2] * 3, ro=[[-1, 8], [-1, -1], [6, 4]], ao=[[[1, 4], [2, 1]], [M, [3, 3]], [[1, 4], [5, 1]]])
    near(values(stats.maf_by_allele_count(a, 2, 0), "maf"), [0.5, 0.5, 10 / 21])
    b = simple(spark, [[[0, 1]] * 2], ad=[[[4, -1, 1], [2, 3, -1]]])
    near(values(stats.allele_freq_by_depth(b, 3), "freqs"), [[0.6, 0.3, 0.1]])


def test_observed_het(spark):
    a = simple(spark, [[[0, 0], [0, 1], [0, -1], M], [[0, 0], [0, 0], [0, -1], M]], dp=[[5, 12, 10, 10], [10] * 4])
    for kw, expected in (({"min_dp": 0}, [0.5, 0]), ({"min_dp": 10}, [1, 0]), ({"min_dp": 0, "max_dp": 11}, [0, 0]), ({"min_dp": 5}, [0.5, 0]), ({"min_dp": None}, [0.5, 0])):
        near(values(stats.obs_het(a, 0, **kw), "obs_het"), expected)
    assert values(stats.obs_het(a, 10), "obs_het") == [None, None]
    per = {r.sample_idx: (r.het, r.called) for r in stats.obs_het_per_sample(a).collect()}
    assert per == {0: (0, 2), 1: (1, 2), 2: (0, 0), 3: (0, 0)}


def test_frequencies_and_expected_het(v, spark):
    a = simple(spark, [[[0, 0], [1, 1], [0, -1], M], [[0, -1], [0, 0], [0, -1], M], [[0, 1], [0, 2], [0, 0], M]])
    near(values(stats.allele_freq(a, 3, 0), "freqs"), [[0.6, 0.4, 0], [1, 0, 0], [4 / 6, 1 / 6, 1 / 6]])
    near([x and x[:2] for x in values(stats.allele_freq(v, 3, 0), "freqs")], [[0.5, 0.5]] * 3 + [[0.75, 0.25], None, [0.5, 0.5], [0.25, 0.75]])
    near(values(stats.expected_het(v, 3, 0), "exp_het"), [0.5, 0.5, 0.5, 0.375, None, 0.5, 0.375])
    b = simple(spark, [[[0, 0]] * 3 + [[1, 1]] * 3 + [[1, 0]], [[0, 0]] * 3 + [[1, 1]] * 4, [[0, 0]] * 3 + [[1, 1]] * 4])
    near(values(stats.expected_het(b, 2, 0), "exp_het"), [0.5, 0.48979592, 0.48979592])
    near(values(stats.unbiased_expected_het(b, 2, 0), "exp_het"), [0.53846154, 0.52747253, 0.52747253])


def test_diversities_and_summary(v):
    r = stats.diversities(v, 3, 0, 0, 0.5).first()
    assert (r.num_variable, r.num_polymorphic, r.num_variations) == (6, 4, 7)
    near([r.exp_het, r.obs_het], [0.458333, 0.333333], 1e-3)
    h = stats.summary(v, 3, 0, 0, 5, ("maf",)).orderBy("bin").collect()
    assert [x.n for x in h] == [0, 0, 4, 2, 0]
    near([x.lo for x in h] + [h[-1].hi], [0, 0.2, 0.4, 0.6, 0.8, 1])


def test_histogram_edges_are_numpys(spark):
    xs = [k / n for n in range(1, 60) for k in range(n + 1)] + [-0.1, 1.1]
    df = spark.createDataFrame([(x,) for x in xs] + [(None,), (float("nan"),)], "x double")
    for bins in (5, 40):
        got = [r.n for r in histogram(df, F.col("x"), bins, (0, 1)).orderBy("bin").collect()]
        assert got == np.histogram([x for x in xs if 0 <= x <= 1], bins, (0, 1))[0].tolist()
    weighted = [r.n for r in histogram(df.filter("x between 0 and 1"), F.col("x"), 10, (0, 1), F.lit(2)).orderBy("bin").collect()]
    assert weighted == (2 * np.histogram([x for x in xs if 0 <= x <= 1], 10, (0, 1))[0]).tolist()
    assert sum(r.n for r in histogram(df.filter("x is not null and not isnan(x)"), F.col("x"), 7).collect()) == len(xs)


def run(result):
    rows = sorted(r.variant_idx for r in result.variations.df.select("variant_idx").collect())
    return rows, result.stats()


def test_call_rate_filter(v):
    rows, s = run(first := filters.remove_low_call_rate_vars(v, 0.5, calc_histogram=True))
    assert (s["n_kept"], s["n_filtered_out"], sum(s["counts"])) == (5, 2, 7)
    assert len(rows) == 5
    _, again = run(filters.remove_low_call_rate_vars(first.variations.with_df(v.df.filter(F.col("variant_idx").isin(rows))), 0.5))
    assert (again["n_kept"], again["n_filtered_out"]) == (5, 0)
    assert len(run(filters.remove_low_call_rate_vars(v, 2, rates=False))[0]) == 5


def test_frequency_filters(v, spark):
    assert run(filters.filter_by_maf_by_allele_count(v, 1, 0.6, min_num_genotypes=2))[1] == {"n_kept": 4, "n_filtered_out": 3}
    assert run(filters.filter_by_maf(v, 3, 0.6, min_num_genotypes=2))[1] == {"n_kept": 3, "n_filtered_out": 4}
    assert run(filters.filter_by_mac(v, 3, 1))[1] == {"n_kept": 0, "n_filtered_out": 7}
    assert run(filters.filter_by_maf(v, 3, min_num_genotypes=2))[1] == {"n_kept": 7, "n_filtered_out": 0}
    a = simple(spark, [[[0, 0], [0, 0]], [[0, 2], [1, -1]], [[0, 0], [1, 1]], [M, M]])
    assert run(filters.keep_variable_variations(a, 3)) == ([1, 2], {"n_kept": 2, "n_filtered_out": 2})
    het = simple(spark, [[[0, 0]] * 4 + [[0, 1]], [[0, 0]] * 5, [[0, 1]] * 2 + [[0, 0]] * 3, [[0, 1]] * 5])
    assert run(filters.filter_by_obs_het(het, None, 0.2, min_num_genotypes=0))[0] == [0, 2, 3]
    assert run(filters.filter_by_obs_het(het, 0.1, min_num_genotypes=0))[0] == [1]
    assert run(filters.filter_by_obs_het(het, 0.1))[0] == []


@pytest.mark.parametrize("many", [False, True])
@pytest.mark.parametrize("counted", [False, True])
def test_regions(spark, many, counted, monkeypatch):
    if many:
        monkeypatch.setattr(filters, "PREDICATE_REGIONS", 0)
    pos = [*range(1, 10), 0] * 2
    a = simple(spark, [[[0, 0]]] * 20, chroms=["chr1"] * 10 + ["chr2"] * 10, positions=pos)
    regions = [("chr1", 4, 6), ("chr2",)]
    keep, drop = (f(a, regions, stats=counted) for f in (filters.keep_variations_in_regions, filters.remove_variations_in_regions))
    assert run(keep)[0] == [3, 4, *range(10, 20)]
    assert run(drop)[0] == [0, 1, 2, 5, 6, 7, 8, 9]
    if counted:
        assert keep.stats() == {"n_kept": 12, "n_filtered_out": 8} and drop.stats() == {"n_kept": 8, "n_filtered_out": 12}
    assert run(filters.keep_variations_in_regions(a, []))[0] == [] and len(run(filters.remove_variations_in_regions(a, []))[0]) == 20
    for bad in ([("chr1", 3)], ["chr1"], [(("a",), 1, 2)]):
        with pytest.raises(ValueError):
            filters.keep_variations_in_regions(a, bad)


def test_samples(v):
    kept = filters.keep_samples(v, ["upv196", "pepo"]).variations
    assert kept.samples == ("pepo", "upv196")
    assert values(kept.df, "dp") == [[-1, 9], [-1, 8], [-1, 8], [14, 6], [-1, -1], [-1, -1], [-1, 6]]
    left = filters.remove_samples(v, ["upv196", "pepo"]).variations
    assert [x[0] for x in values(left.df, "dp")] == [10, 9, 9, -1, -1, 9, 10]
    with pytest.raises(ValueError):
        filters.keep_samples(v, ["nobody"])


def test_calls_to_missing(v):
    assert values(filters.min_depth_gt_to_missing(v, 10).variations.df, "gt")[0] == [M, [0, 0], M]
    assert values(filters.min_gq_gt_to_missing(v, 18).variations.df, "gt")[0] == [M, M, [1, 1]]
    assert values(filters.min_qual_gt_to_missing(v, 1.0).variations.df, "gt")[0] == [M, M, M]


KOSMAN = [[0, 1, 0, 1, 0, 1, 0, 0], [1, 1, 1, 1, 0, 1, 0, 0]]


def plain_kosman(x, y):
    s = sum(a in y for a in x) + sum(b in x for b in y)
    return 1.0 if s == 0 else 0.0 if s == 4 else 0.5


def test_kosman(spark):
    r = random.Random(4)
    gts = [[[r.choice([-1, 0, 1, 2]), r.choice([0, 1, 2])] for _ in range(5)] for _ in range(60)]
    a = simple(spark, gts)
    got = {(x.i, x.j): (x.n, x.dist) for x in distances.kosman_dist(a).collect()}
    for i in range(5):
        for j in range(i + 1, 5):
            both = [(g[i], g[j]) for g in gts if min(g[i] + g[j]) >= 0]
            assert got[i, j][0] == len(both) and abs(got[i, j][1] - np.mean([plain_kosman(x, y) for x, y in both])) < 1e-9
    few = distances.kosman_dist(a, min_num_snps=1000).collect()
    assert {x.dist for x in few} == {0.0}
    none = distances.kosman_dist(simple(spark, [[M, [0, 0]]])).first()
    assert (none.n, none.dist) == (0, None)
    with pytest.raises(ValueError):
        distances.kosman_dist(simple(spark, [[[0], [1]]]))


def test_nei(spark):
    a = simple(spark, [[[1, 1], [5, 2], [2, 2], [3, 2]], [[1, 1], [1, 2], [2, 2], [2, 1]], [M] * 4])
    pops = [["s0", "s1"], ["s2", "s3"]]
    assert abs(distances.nei_dists(a, 6, pops, 1).first().dist - 0.3726315908494797) < 1e-9
    assert distances.nei_dists(simple(spark, [[M] * 4]), 6, pops, 1).first().dist is None
    apart = simple(spark, [[[0, 0], [0, 0], [1, 1], [1, 1]]])
    assert distances.nei_dists(apart, 2, pops, 1).first().dist == math.inf
    depth = simple(spark, [[[0, 0]] * 4] * 2, ad=[[[3, 1], [1, 1], [0, 4], [2, 2]], [[5, 0], [5, 0], [5, 0], [4, 1]]])
    p, q = np.array([[4 / 6, 2 / 6], [1, 0]]), np.array([[2 / 8, 6 / 8], [0.9, 0.1]])
    expected = -math.log((p * q).sum() / math.sqrt((p * p).sum() * (q * q).sum()))
    assert abs(distances.nei_dists_by_depth(depth, 2, pops).first().dist - expected) < 1e-9


def test_dest(spark):
    one = [[[0, 0]] * 2 + [[0, 1]] * 2 + [[1, 1]] + [[1, 1]] * 3 + [[0, 1]] + [[2, 2]] * 2, [[0, 1]] * 5 + [[0, 0]] * 6]
    a = simple(spark, one, dp=[[20] * 11] * 2)
    pops = [[f"s{i}" for i in range(5)], [f"s{i}" for i in range(5, 11)]]

    def plain(rows):
        hs, ht = [], []
        for g in rows:
            f, o, n = [], [], []
            for idx in (range(5), range(5, 11)):
                x = [c for i in idx for c in g[i]]
                f.append(np.array([x.count(k) / len(x) for k in range(3)]))
                o.append(np.mean([g[i][0] != g[i][1] for i in idx]))
                n.append(len(idx))
            m = 2 / (1 / n[0] + 1 / n[1])
            s = ((1 - (f[0] ** 2).sum()) + (1 - (f[1] ** 2).sum())) / 2
            s2 = m / (m - 1) * (s - np.mean(o) / (2 * m))
            hs.append(s2)
            ht.append(1 - (((f[0] + f[1]) / 2) ** 2).sum() + s2 / (2 * m) - np.mean(o) / (4 * m))
        return 2 * (np.mean(ht) - np.mean(hs)) / (1 - np.mean(hs))

    assert abs(distances.dset_dists(a, 5, pops, 0).first().dist - plain(one)) < 1e-9
    assert distances.dset_dists(a, 5, pops, 7).first().dist is None
    extra = simple(spark, [*one, [M] * 5 + [[0, 0]] * 6], dp=[[20] * 11] * 3)
    assert abs(distances.dset_dists(extra, 5, pops, 1).first().dist - plain(one)) < 1e-9


def test_harmonic_mean(spark):
    df = spark.createDataFrame([(1.0, 3.0), (0.0, 1.0), (None, 1.0)], "a double, b double")
    near([r.h for r in df.select(G.harmonic_mean(F.col("a"), F.col("b")).alias("h")).collect()], [1.5, None, None])


def dosage_gts(xs):
    return [{-1: M, 0: [0, 0], 1: [0, 1], 2: [1, 1]}[x] for x in xs]


def test_ld_along_genome(spark):
    r = random.Random(1)
    rows = [[r.choice([-1, 0, 1, 2, 2]) for _ in range(40)] for _ in range(40)]
    pos, chroms = sorted(r.randrange(2000) for _ in rows), ["c1"] * 25 + ["c2"] * 15
    a = simple(spark, [dosage_gts(x) for x in rows], chroms=chroms, positions=pos)
    found = {(x.variant_idx1, x.variant_idx2): x.ld for x in ld.ld_along_genome(a, 400, 2, 10).collect()}
    expected = {}
    for i in range(40):
        for j in range(40):
            if chroms[i] == chroms[j] and 0 < pos[j] - pos[i] <= 400:
                both = [(x, y) for x, y in zip(rows[i], rows[j]) if x >= 0 and y >= 0]
                if len(both) >= 10:
                    expected[i, j] = abs(np.corrcoef(np.array(both).T)[0, 1])
    assert found.keys() == expected.keys() and all(abs(found[k] - expected[k]) < 1e-9 for k in found)
    assert ld.ld_along_genome(a, 400, 2, 41, check=False).count() == 0
    with pytest.raises(RuntimeError):
        ld.ld_along_genome(a, 400, 2, 10, max_maf=0.5)


def test_ld_random_pairs(spark):
    r = random.Random(2)
    a = simple(spark, [dosage_gts([r.choice([0, 1, 2]) for _ in range(30)]) for _ in range(30)], chroms=["c1"] * 10 + ["c2"] * 20)
    one = ld.ld_random_pairs(a, 50, 2).collect()
    assert len(one) == 50 and all(x.chrom1 != x.chrom2 for x in one) and one == ld.ld_random_pairs(a, 50, 2).collect()
    assert one != ld.ld_random_pairs(a, 50, 2, seed=9).collect()
    assert ld.ld_random_pairs(a, 20, 2, unit="allele").count() == 20
    with pytest.raises(ValueError):
        ld.ld_random_pairs(simple(spark, [[[0, 1]]] * 3), 5, 2)


def test_pca(spark):
    r = random.Random(3)
    rows = [[x, x, r.choice([0, 1, 2]), r.choice([-1, 0, 2])] for x in (r.choice([0, 1, 2]) for _ in range(30))]
    found = multivariate.pca(simple(spark, [dosage_gts(x) for x in rows]))
    x = np.array(rows, float)
    x -= x.mean(1, keepdims=True)
    u, s, vt = np.linalg.svd(x.T, full_matrices=False)
    assert np.allclose(np.abs(found.projections[:, :3]), np.abs((u * s)[:, :3]), atol=1e-6)
    assert np.allclose(found.var_percentages, s**2 / (s**2).sum() * 100, atol=1e-6)
    assert np.allclose(found.projections[0], found.projections[1], atol=1e-6)
    weights = np.array(values(found.princomps, "weights"))
    assert np.allclose(np.abs(weights[:, :2]), np.abs(vt[:2].T), atol=1e-6)
    with pytest.raises(RuntimeError):
        multivariate.pca(simple(spark, [[[0, 1], [1, 1]]]))


def test_variation_set(v, spark):
    assert v.ploidy == 2 and v.num_variations == 7 and v.num_samples == 3 and "gt" in v and v["nothing"] is None
    assert [r.variant_idx for r in v.get_vars([5, 1]).df.collect()] == [1, 5]
    assert v.get_vars(slice(2, 5)).num_variations == 3 and v.get_vars(slice(0, 7, 3)).num_variations == 3
    assert [c.num_variations for c in v.iterate_chunks(3)] == [3, 3, 1]
    with pytest.raises(ValueError):
        Variations(v.df, [])
    with pytest.raises(Exception, match="another number of samples"):
        v.with_field("dp", F.array(F.lit(1))).df.select("dp").collect()
    with pytest.raises(EmptyVariationsError):
        _ = v.get_vars(slice(100, 200)).ploidy
    assert missing_value("int") == -1 and missing_value("genotype") == [-1, -1] and missing_value("boolean") is False
    with pytest.raises(ValueError):
        missing_value("complex")


def test_store_round_trip(v, spark, tmp_path):
    v = Variations(v.df, v.samples, {"FORMAT/DP": {"Number": "1", "Type": "Integer", "Description": "depth"}, "source": "x"})
    for fmt in ("parquet", "orc"):
        path = f"{tmp_path}/{fmt}"
        store.write_store(v, path, fmt)
        got = store.read_store(spark, path)
        assert got.samples == SAMPLES and got.metadata == v.metadata
        assert store.ordered(got).collect() == store.ordered(v).select(got.df.columns).collect()
    store.write_store(v, path, fmt, mode="append")
    assert store.read_store(spark, path, ["pos", "unknown"]).df.count() == 14
    with pytest.raises(KeyError):
        store.read_store(spark, path, ["unknown"], strict=True)


GOLDEN = "CUUC00007_TC01\t640\t.\tA\tC\t.\t.\t.\tGT:AO:DP:GQ:RO\t./.:.:.:.:.\t0/0:0:10:17:10\t1/1:9:9:46:0"
LEGACY = "CUUC00007_TC01\t640\t.\tA\tC\t.\t.\t.\tGT:AO:DP:GQ:GT:RO\t.:.:.:.:.:.\t0,0:0:10:17:0,0:10\t1,1:9:9:46:1,1:0"


def test_vcf_round_trip(v, spark, tmp_path):
    out = io.StringIO()
    v = Variations(v.df, v.samples, {"FORMAT/DP": {"Number": "1", "Type": "Integer", "Description": "Read depth"}, "source": "here"})
    vcf.write_vcf(v, out)
    lines = out.getvalue().splitlines()
    assert lines[0] == "##fileformat=VCFv4.2" and "##source=here" in lines and '##FORMAT=<ID=DP,Number=1,Type=Integer,Description="Read depth">' in lines
    assert lines[3] == "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\tpepo\tmu16\tupv196" and lines[4] == GOLDEN and len(lines) == 11
    assert vcf.body_lines(v, legacy=True).orderBy("variant_idx").first().line == LEGACY
    path = tmp_path / "a.vcf"
    path.write_text(out.getvalue())
    got = vcf.read_vcf(spark, str(path))
    assert got.samples == SAMPLES and got.metadata == v.metadata
    cols = ["variant_idx", "chrom", "pos", "id", "ref", "alt", "qual", "gt", "gq", "dp", "ro", "ao"]
    assert got.df.select(cols).orderBy("variant_idx").collect() == v.df.select(cols).orderBy("variant_idx").collect()
    vcf.vcf_to_store(spark, str(path), f"{tmp_path}/store")
    again = io.StringIO()
    vcf.store_to_vcf(spark, f"{tmp_path}/store", again)
    assert again.getvalue() == out.getvalue()
    vcf.write_vcf_parts(v, f"{tmp_path}/parts")
    assert [r.value for r in spark.read.text(f"{tmp_path}/parts/body").collect()][0] == GOLDEN


def test_vcf_details(spark, tmp_path):
    import gzip

    text = (
        "##fileformat=VCFv4.2\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ta\tb\r\n"
        "1\t10\trs1\tA\tCTTTT,G\t30.12345\tPASS\tDP=3\tGT:AD:AO\t0|2:3,.,1:.,1\t.\n2\t5\t.\tA\t.\t.\t.\t.\tDP:GT\t7:1/1\t.:./.\n"
    )
    path = tmp_path / "b.vcf.gz"
    with gzip.open(path, "wt") as f:
        f.write(text)
    got = vcf.read_vcf(spark, str(path))
    a, b = got.df.orderBy("variant_idx").collect()
    assert (a.variant_idx, b.variant_idx) == (0, 1) and a.gt == [[0, 2], M] and a.ad == [[3, -1, 1], [-1] * 3] and a.ao == [[-1, 1], [-1, -1]]
    assert b.alt == [] and b.qual is None and b.dp == [7, -1] and b.gt == [[1, 1], M] and a.alt == ["CTTTT", "G"]
    lines = [r.line for r in vcf.body_lines(got).orderBy("variant_idx").collect()]
    assert lines[0].split("\t")[:8] == ["1", "10", "rs1", "A", "CTTTT,G", "30.1235", "PASS", "DP=3"]
    assert vcf.read_vcf(spark, str(path), ["pos"]).df.columns == ["variant_idx", "pos"]
    df = spark.createDataFrame([(True, False, 3, 2.5, [1, -1, -1])], "a boolean, b boolean, n int, x double, l array<int>")
    r = df.select(
        vcf.flags_text({"long_name": F.col("a"), "other": F.col("b")}).alias("f"), vcf.flags_text({"other": F.col("b")}).alias("g"),
        vcf.info_text({"H2": ("flag", F.col("a")), "NS": ("int", F.col("n")), "AF": ("float", F.col("x")), "L": ("ints", F.col("l")), "Z": ("flag", F.col("b"))}).alias("i"),
    ).first()
    assert tuple(r) == ("long_name", ".", "H2;NS=3;AF=2.5;L=1")


def test_pipeline_and_report(spark, tmp_path, v):
    store.write_store(v, f"{tmp_path}/in")
    out = io.StringIO()
    found = pipeline.filter_variations(
        spark, f"{tmp_path}/in", f"{tmp_path}/out", out=out, samples_to_keep=["mu16", "upv196"], regions_to_remove=[("CUUC00029_TC01", 0, 30)], min_call_rate=0.5, remove_non_variable_snvs=True,
        max_allowable_mac=2, min_num_genotypes=0, max_allowable_het=1.0, min_call_dp_for_het_call=0, min_dp_setter=5, calc_histogram=True,
    )
    assert [k for k, s in found.items() if s] == ["remove_regions", "variable", "mac", "call_rate", "obs_het"]
    assert found["remove_regions"] == {"n_kept": 6, "n_filtered_out": 1} and found["variable"]["n_kept"] == 4
    assert "Filter: variable\n" + "-" * 16 + "\nProcessed: 6\nKept vars: 4\nFiltered out: 2\n" in out.getvalue()
    kept = store.read_store(spark, f"{tmp_path}/out")
    assert kept.samples == ("mu16", "upv196") and kept.num_variations == found["obs_het"]["n_kept"]
    nothing = pipeline.filter_variations(spark, f"{tmp_path}/in", f"{tmp_path}/same", out=out)
    assert nothing == {} and store.read_store(spark, f"{tmp_path}/same").num_variations == 7
    _, results = pipeline.build(v, min_call_rate=0.5, calc_histogram=True)
    results[0].variations.df.count()
    results[0].variations.df.collect()
    assert [p.name for p in pipeline.write_histograms(results, tmp_path)] == ["call_rate.csv"]


def test_evaluate(v):
    data = {"a": filters.remove_low_call_rate_vars(v, 0.5), "b": {"c": stats.diversities(v, 3, 0, 0), "v": v}, "d": 3}
    got = pipeline.evaluate(data)
    assert got["a"]["stats"]["n_kept"] == 5 and got["b"]["c"][0].num_variations == 7 and got["d"] == 3 and "v" not in got["b"]
    assert len(pipeline.evaluate({"v": v}, True)["v"]["rows"]) == 7


def test_stream(v, spark, tmp_path):
    store.write_store(v, f"{tmp_path}/in")
    streamed = stream_store(spark, f"{tmp_path}/in")
    q = filter_stream(streamed, [lambda x: filters.remove_low_call_rate_vars(x, 0.5, stats=False).variations], f"{tmp_path}/out", f"{tmp_path}/cp")
    q.awaitTermination(60)
    assert spark.read.parquet(f"{tmp_path}/out").count() == 5


def test_region_predicate_reaches_the_scan(spark, tmp_path):
    a = simple(spark, [[[0, 0]]] * 4, chroms=["c1", "c1", "c2", "c3"])
    store.write_store(a, f"{tmp_path}/s")
    df = filters.keep_variations_in_regions(store.read_store(spark, f"{tmp_path}/s"), [("c2",), ("c1", 0, 2)], stats=False).variations.df
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(" in plan
    narrow = stats.called_gt(store.read_store(spark, f"{tmp_path}/s"))._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in narrow


def test_derived_set_needs_no_cross_join(spark, sf):
    v = derived.variations(spark, sf)
    assert "Cartesian" not in v.df._jdf.queryExecution().executedPlan().toString() and "NestedLoop" not in v.df._jdf.queryExecution().executedPlan().toString()
    assert v.num_variations == 200 and v.num_samples == 25


def test_bins_of_missing_values(spark):
    df = spark.createDataFrame([(None,), (1.0,), (0.0,), (2.0,)], "x double")
    assert [r[0] for r in df.select(bin_of(F.col("x"), edges_of(4, 0, 1))).collect()] == [None, 3, 0, None]


def test_array_functions(spark):
    from locusframe.functions import arrays as A

    df = spark.createDataFrame([([1.0, 2.0, 4.0], [True, None, False], [1.0, None, 3.0])], "a array<double>, b array<boolean>, n array<double>")
    a, b, n = F.col("a"), F.col("b"), F.col("n")
    got = df.select(
        A.total(a), A.minimum(a), A.maximum(a), A.total(n), A.minimum(n), A.nansum(n), A.nanmean(n), A.count_nonzero(a), A.any_of(b), A.all_of(b), A.add(a, a), A.assign_with_mask(a, F.lit(-1.0), b),
        A.stack(F.lit(1), F.lit(2)), A.full(2, 7), A.ones(3), A.logical_and(F.lit(True), F.lit(None).cast("boolean")), A.logical_or(F.lit(True), F.lit(None).cast("boolean")), A.logical_not(F.lit(None).cast("boolean")),
        A.is_missing(F.lit(float("nan"))), A.is_infinite(F.lit(float("-inf"))), A.is_finite(F.lit(1.0)), A.is_finite(F.lit(None).cast("double")),
    ).first()
    assert list(got) == [7, 1, 4, None, None, 4, 2, 3, True, False, [2, 4, 8], [-1, 2, 4], [1, 2], [7, 7], [1, 1, 1], False, True, True, True, True, True, False]
    doubled = A.map_blocks(spark.range(5), lambda t: t.set_column(0, "id", pc.multiply(t.column(0), 2)), "id long")
    assert sorted(r.id for r in doubled.collect()) == [0, 2, 4, 6, 8]


def test_all_alleles_count_unless_limited(spark):
    a = simple(spark, [[[0, 2], [2, 2], [0, 0]], [[0, 0], [0, 0], [0, 0]]])
    kept, _ = pipeline.build(a, remove_non_variable_snvs=True, stats=False)
    assert [r.variant_idx for r in kept.df.collect()] == [0]
    counts = a.df.orderBy("variant_idx").select(G.allele_counts(F.col("gt"), None).alias("c"), G.major_freq(F.col("gt"), None, None).alias("m")).collect()
    assert [r.c for r in counts] == [[3, 0, 3], [6]] and [r.m for r in counts] == [0.5, 1.0]


def test_numbers_of_vcf_in_all_forms(spark, tmp_path):
    path = tmp_path / "n.vcf"
    head = ["##fileformat=VCFv4.2", '##INFO=<ID=AF,Number=A,Type=Float,Description="f">', '##INFO=<ID=DP,Number=1,Type=Integer,Description="d">', '##INFO=<ID=DB,Number=0,Type=Flag,Description="x">', "#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts0"]
    quals, infos = ["2.21684e-10", "1234.5678912", "1e3", ".", "nan"], ["AF=0.5,1e-3;DP=7;DB", "DP=.", ".", "DB;AF=.", "XDP=3;DP=4"]
    body = [f"c\t{k + 1}\t.\tA\tC,G\t{q}\t.\t{i}\tGT:GQ\t0/1:{g}" for k, (q, i, g) in enumerate(zip(quals, infos, ["35.2", "7", ".", "1e1", "99"]))]
    path.write_text("\n".join(head + body) + "\n")
    a = vcf.read_vcf(spark, str(path), info_fields=["AF", "DP", "DB"])
    rows = a.df.orderBy("variant_idx").collect()
    assert [r.qual for r in rows] == [2.21684e-10, 1234.5678912, 1000.0, None, None]
    assert [r.gq for r in rows] == [[35], [7], [-1], [10], [99]]
    assert [(r.info_AF, r.info_DP, r.info_DB) for r in rows] == [([0.5, 0.001], 7, True), (None, None, False), (None, None, False), (None, None, True), (None, 4, False)]
    again = vcf.body_lines(a.with_df(a.df.drop("info"))).orderBy("variant_idx").collect()
    assert [r.line.split("\t")[7] for r in again] == ["AF=0.5,0.001;DP=7;DB", ".", ".", "DB", "DP=4"]
    with pytest.raises(KeyError):
        vcf.read_vcf(spark, str(path), info_fields=["NO"])


def test_growing_stores_have_dense_indices(v, spark, tmp_path):
    path = f"{tmp_path}/grown"
    store.write_store(v, path)
    store.write_store(v, path, mode="append")
    assert sorted(r.variant_idx for r in store.read_store(spark, path).df.collect()) == list(range(14))


def test_many_regions_keep_repeated_indices(spark):
    a = simple(spark, [[[0, 1]]] * 4, positions=[5, 100, 205, 900])
    a = a.with_df(a.df.withColumn("variant_idx", F.lit(1).cast("long")))
    regions = [("chr1", k * 100, k * 100 + 10) for k in range(80) if k != 9] + [("chr1", 3, 7), ("chr1", 200, 206)]
    for stats in (True, False):
        kept = filters.keep_variations_in_regions(a, regions, stats=stats)
        assert sorted(r.pos for r in kept.variations.df.collect()) == [5, 100, 205]
        gone = filters.remove_variations_in_regions(a, regions, stats=stats)
        assert [r.pos for r in gone.variations.df.collect()] == [900] and gone.variations.df.columns == a.df.columns
    assert kept.stats() == {} and filters.keep_variations_in_regions(a, regions).stats is not None


def test_random_pairs_after_a_filter(spark):
    rng = np.random.default_rng(3)
    gts = rng.integers(0, 2, (60, 30, 2)).tolist()
    a = simple(spark, gts, chroms=[f"chr{k % 2}" for k in range(60)])
    sparse = a.with_df(a.df.withColumn("variant_idx", F.col("variant_idx") * 17 + 3).filter(F.col("variant_idx") % 3 != 0))
    known = {r.variant_idx for r in sparse.df.collect()}
    rows = ld.ld_random_pairs(sparse, 100, 2, attempts=20, check=False).collect()
    assert len(rows) == 100 and {i for r in rows for i in (r.variant_idx1, r.variant_idx2)} <= known
    flat = a.with_df(a.df.withColumn("gt", F.transform("gt", lambda c: F.array(F.lit(0), F.lit(0)))))
    with pytest.raises(RuntimeError):
        ld.ld_random_pairs(flat, 5, 2, check=False)


def test_masks_and_negative_places(v):
    of = lambda x: sorted(r.variant_idx for r in x.df.collect())
    assert of(v.get_vars([True, False, True, False, False, False, False])) == [0, 2]
    assert of(v.get_vars(np.array([False] * 6 + [True]))) == [6] and of(v.get_vars([-1, 0])) == [0, 6]
    assert of(v.get_vars(slice(-2, None))) == [5, 6] and of(v.get_vars(slice(None, None, -3))) == [0, 3, 6]
    gaps = v.with_df(v.df.filter(F.col("variant_idx") % 2 == 1))
    assert of(gaps.get_vars([False, True, True])) == [3, 5] and of(gaps.get_vars(slice(-1, None))) == [5]
    with pytest.raises(IndexError):
        v.get_vars([True])


def test_summary_folder(v, tmp_path):
    stats.write_summary(v, tmp_path / "s", "calls", min_num_genotypes=0, min_dp=0)
    text = (tmp_path / "s" / "stats.txt").read_text().splitlines()
    assert text[0] == "STATS FOR: calls" and text[2:4] == ["Num. variations: 7", "Num. samples: 3"]
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["called.csv", "mac.csv", "maf.csv", "obs_het.csv", "stats.txt"]
