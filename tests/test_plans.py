"""Plans that must hold at scale: no shuffle where a row suffices, no cross joins, small exchanges."""

import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(n for n in entry.catalog.QUERIES if n not in ("pca_projections",)))
def test_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_statistics_add_no_shuffle(spark):
    base = plan(entry.queries()["scan_variants"](spark, SF)).count("Exchange")
    for name in ("allele_counts", "maf_by_gt", "obs_het", "expected_het", "mac", "flt_maf", "keep_samples", "min_depth_to_missing"):
        assert plan(entry.queries()[name](spark, SF)).count("Exchange") <= base
