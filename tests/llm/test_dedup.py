import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import exact_dedup, near_dedup, substring_dedup
from locusframe.llm.components import components


def pairs(rows):
    return [(r[0], r[1]) for r in rows]


def test_exact_matches_brute_force(messy, rows):
    brute.same(exact_dedup.exact_dedup(messy).collect(), brute.exact(pairs(rows)))


def test_exact_with_small_blocks_names_through_levels(messy, rows):
    brute.same(exact_dedup.exact_dedup(messy, block_bytes=64).collect(), brute.exact(pairs(rows)))


def test_naming_tells_apart_texts_that_share_length_and_first_block(spark):
    texts = ["a" * 64 + x for x in ("bb" * 100, "bc" * 100, "bb" * 99 + "bc", "bb" * 100)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted((r.doc_id, r.keep_id) for r in exact_dedup.exact_dedup(docs, block_bytes=64).collect()) == [(0, 0), (1, 1), (2, 2), (3, 0)]


def test_exact_empty(empty):
    assert exact_dedup.exact_dedup(empty).count() == 0


def test_keep_first_keeps_columns_and_one_row_of_each(messy, rows):
    kept = exact_dedup.keep_first(messy)
    assert kept.columns == messy.columns
    expected = {(i, s) for i, _, _, k, s in brute.exact(pairs(rows)) if k}
    got = [(r.doc_id, brute.sha(brute.SPACE.sub(" ", r.text or ""))) for r in kept.collect()]
    assert len(got) == len(set(got)) and set(got) == expected


def test_near_matches_brute_force(messy, rows):
    brute.same(near_dedup.near_dedup(messy).collect(), brute.near(pairs(rows)))


def test_near_finds_chains_and_hubs(spark):
    base = brute.words(400, 11, 10_000).split()
    docs = [(1000, " ".join(base))]
    for k in range(150):  # each near the hub, few near each other
        w = list(base)
        for j in range(6):
            w[(k * 37 + j * 61) % 400] = f"new{k}-{j}"
        docs.append((k, " ".join(w)))
    df = spark.createDataFrame(docs, "doc_id long, text string")
    brute.same(near_dedup.near_dedup(df).collect(), brute.near(docs))


def test_near_empty(empty):
    assert near_dedup.near_dedup(empty).count() == 0


def test_keep_one_of_each(messy, rows):
    kept = near_dedup.keep_one_of_each(messy)
    assert kept.columns == messy.columns
    expected = sorted((brute.key((i,)) for i, _, _, k in brute.near(pairs(rows)) if k))
    assert sorted(brute.key((r.doc_id,)) for r in kept.collect()) == expected


def test_estimates_are_corrected_for_chance():
    rng = np.random.default_rng(0)
    a = [np.unique(rng.integers(1, 1 << 63, 400, dtype=np.uint64)) for _ in range(40)]
    near_sets = [np.concatenate([x[:360], rng.integers(1, 1 << 63, 40, dtype=np.uint64)]) for x in a]
    planes = lambda s: np.frombuffer(b"".join(near_dedup.planes_of(near_dedup.minima(x)) for x in s), np.uint64).reshape(len(s), near_dedup.BITS, -1)
    e = near_dedup.estimates(planes(a), planes(near_sets))
    assert abs(np.diag(e).mean() - 360 / 440) < 0.03
    assert abs(e[~np.eye(40, dtype=bool)].mean()) < 0.01


def test_divided_buckets_and_small_blocks_lose_nothing(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_SHINGLES", 8000)
    monkeypatch.setattr(near_dedup, "CELLS", 1)
    test_near_finds_chains_and_hubs(spark)


def test_buckets_of_many_small_sets_are_divided(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "BUCKET_MEMBERS", 10)
    docs = [(k, f"a b c d e f g h i j k l m n o p q r s t u v w x{k % 40} y") for k in range(80)]
    found = near_dedup.near_dedup(spark.createDataFrame(docs, "doc_id long, text string"))
    brute.same(found.collect(), brute.near(docs))


def test_components(spark):
    links = [(1, 2), (2, 3), (10, 11), (3, 9), (20, 20), (9, 30), (30, 31), (31, 32)]
    found = dict(map(tuple, components(spark.createDataFrame(links, "a long, b long")).collect()))
    assert found == {1: 1, 2: 1, 3: 1, 9: 1, 30: 1, 31: 1, 32: 1, 10: 10, 11: 10}


@pytest.mark.parametrize("batches", [1, 3])
def test_substring_matches_brute_force(messy, rows, batches):
    found = substring_dedup.substring_dedup(messy, batches=batches)
    brute.same(substring_dedup.report(found).collect(), brute.windows(pairs(rows)))


def test_substring_whole_table_matches_brute_force(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    brute.same(substring_dedup.report(substring_dedup.substring_dedup(docs)).collect(), brute.windows(rows))


def test_substring_empty(empty):
    assert substring_dedup.substring_dedup(empty).count() == 0


def test_index_lasts_and_compacts_its_runs(spark, messy, rows, tmp_path):
    known = substring_dedup.keyed(messy).filter("doc_id is not null")
    folder, gone = f"file://{tmp_path}/index", []
    for lo in range(0, 30, 6):
        # another job that opens what is there
        index = substring_dedup.FingerprintIndex(spark, folder, buckets=5, most_runs=2)
        gone.append(index.ingest(known.filter(F.col("doc_id").between(lo, lo + 5)), known.filter(F.col("doc_id") <= lo + 5)))
        for name, _ in index.runs:
            spark.sql(f"DROP TABLE {name}")
    again = substring_dedup.FingerprintIndex(spark, folder)
    assert again.buckets == 5 and len(again.runs) <= 3
    again.compact()
    assert len(again.runs) == 1 and again.tables[0].groupBy("h", "ctx").count().filter("count > 1").count() == 0
    union = gone[0]
    for g in gone[1:]:
        union = union.unionByName(g)
    brute.same(substring_dedup.report(substring_dedup.without(substring_dedup.keyed(messy), union)).collect(), brute.windows(pairs(rows)))


def test_runs_meet_without_a_shuffle(spark, messy):
    index = substring_dedup.FingerprintIndex(spark, most_runs=5)
    known = substring_dedup.keyed(messy).filter("doc_id is not null")
    for lo in (0, 10):
        index.ingest(known.filter(F.col("doc_id").between(lo, lo + 9)), known.filter(F.col("doc_id") <= lo + 9))
    both = substring_dedup._merged(index.tables, ["h", "part", "ctx"])
    assert "Exchange" not in both._jdf.queryExecution().executedPlan().toString()


def test_hot_anchors_and_entries_are_dealt_apart(monkeypatch, messy, rows):
    monkeypatch.setattr(substring_dedup, "LAYOUT_SHARE", 1.0)
    monkeypatch.setattr(substring_dedup, "LAYOUT_ROWS", 1)
    monkeypatch.setattr(substring_dedup, "_hot", lambda prints, keys, counted: [tuple(r) for r in prints.groupBy(*keys).agg(counted.alias("k")).filter("k > 1").select(*keys).collect()])
    found = substring_dedup.substring_dedup(messy, batches=3)
    brute.same(substring_dedup.report(found).collect(), brute.windows(pairs(rows)))


def test_fewest_ranges_cover_the_same_words():
    rng = np.random.default_rng(9)
    words = lambda rows, s, e: {(r, w) for r, a, b in zip(rows, s, e) for w in range(a, b)}
    for n in (1, 2, 5, 30, 200):
        row, s = rng.integers(0, 3, n), rng.integers(0, 300, n)
        e = s + rng.integers(1, 60, n)
        keep = substring_dedup.covering(row, s, e)
        assert words(row, s, e) == words(row[keep], s[keep], e[keep])
        # no word of three of them
        assert all(sum(r == row[k] and s[k] <= w < e[k] for k in keep) <= 2 for r, w in words(row, s, e))


def test_claims_are_verified_by_words():
    words = [b"w%d" % i for i in range(60)]
    claim = {"start": 3, "n": 2, "m": 2, "words": b" ".join(words[3:54])}
    assert substring_dedup.holds(words, claim) and not substring_dedup.holds([*words[:40], b"other", *words[41:]], claim)
    same = [b"the"] * 60
    row = {"start": 0, "n": 11, "m": 1, "words": b" ".join(same[:50])}
    assert substring_dedup.holds(same, row) and not substring_dedup.holds([*same[:55], b"end", *same[56:]], row)


def long_words():
    """Words of more than 4,096 bytes that differ by a swap of bytes 4,096 apart."""
    a, b = bytearray(b"m" * 9000), bytearray(b"m" * 9000)
    a[10], a[10 + 4096] = ord("x"), ord("y")
    b[10], b[10 + 4096] = ord("y"), ord("x")
    return a.decode(), b.decode()


def test_long_words_are_told_apart(spark):
    x, y = long_words()
    w = brute.words(60, 12).split()
    docs = [(1, " ".join([*w[:30], x, *w[30:]])), (2, " ".join([*w[:30], y, *w[30:]])), (3, x), (4, y), (5, " ".join([*w[:30], y, *w[30:]]))]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    brute.same(near_dedup.near_dedup(df).collect(), brute.near(docs))
    brute.same(substring_dedup.report(substring_dedup.substring_dedup(df)).collect(), brute.windows(docs))
