import brute
import numpy as np
import pytest
from pyspark.sql import functions as F

from locusframe.llm import quality, toxicity


def auc(scores, labels):
    order = np.argsort(scores, kind="stable")
    rank = np.empty(len(scores))
    rank[order] = np.arange(len(scores))
    p = labels == 1
    return (rank[p].mean() - (p.sum() - 1) / 2) / (~p).sum()


@pytest.fixture(scope="module")
def larger(spark):
    return [spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels")]


@pytest.mark.parametrize("run, label, fold, held_out", [(quality.classify_quality, "quality", 5, 0), (toxicity.classify_toxicity, "toxic", 4, 2)])
def test_held_out_accuracy(larger, run, label, fold, held_out):
    docs, labels = larger
    found = run(docs.join(labels.select("doc_id"), "doc_id", "left_semi"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (brute.fold(r.doc_id, fold) == held_out) for r in found)
    out = [r for r in found if r.held_out]
    y, s = np.array([r[label] for r in out]), np.array([r.score for r in out])
    assert ((s >= 0) & (s <= 1)).all() and all(r.predicted == int(r.score >= 0.3) for r in found)
    assert auc(s, y) > 0.97
    clean = (y == 1) if label == "quality" else (y == 0)
    assert ((s[clean] >= 0.3) == (label == "quality")).mean() > 0.98


@pytest.mark.parametrize("run", [quality.classify_quality, toxicity.classify_toxicity])
def test_messy_rows_and_no_labels(run, messy, rows, empty, labels, spark):
    assert run(messy, labels).count() == len(rows)
    none = labels.limit(0)
    assert {r.score for r in run(messy, none).collect()} == {0.5}
    assert run(empty, labels).count() == 0
    odd = spark.createDataFrame([(4, None, None), (4, 1, 1), (4, 0, 0), (None, 1, 1), (6, 1, 0)], "doc_id long, quality int, toxic int")
    assert run(messy, odd).count() == len(rows)


def test_keep_good_keeps_columns(messy):
    network = quality.Network().fit([], np.zeros(0, np.float32))
    assert sorted(map(brute.key, quality.keep_good(messy, network).collect())) == sorted(map(brute.key, messy.collect()))


def test_pieces_of_long_texts_give_the_same_score(monkeypatch):
    rng = np.random.default_rng(3)
    net = quality.Network()
    texts = [bytes(rng.integers(32, 127, n, dtype=np.uint8)) for n in (0, 1, 11, 12, 13, 127, 128, 129, 1000, 4096, 5001)]
    whole = [net.score(t) for t in texts]
    monkeypatch.setattr(quality, "PIECE", 512)
    assert np.allclose([net.score(t) for t in texts], whole, atol=1e-6)


def test_gradients_lower_the_loss():
    good, bad = [b"plain words in a row " * k for k in range(1, 20)], [b"PLAIN!! WORDS!! IN!! " * k for k in range(1, 20)]
    net = quality.Network().fit(good + bad, np.array([1] * 19 + [0] * 19, np.float32))
    assert min(map(net.score, good)) > 0.5 > max(map(net.score, bad))


def test_isotonic():
    ends, values = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert (np.diff(values) >= 0).all() and ends.tolist() == [1, 3, 4]


def test_features_see_disguise_and_second_person():
    plain, leet, near = (toxicity.features(t, {}) for t in (b"he is an idiot and so on", b"he is an 1d1ot xid1ot and so on", b"you idiot and so on"))
    assert len(plain) == toxicity.FEATURES
    assert plain[1] > 0 and leet[1] == 0 and leet[15] > 0 and near[6] == 1 and plain[6] == 0


def plain_convolution(net, text):
    """Each window of bytes by itself, chunk by chunk."""
    w = np.concatenate([net.w[j] for j in range(quality._PARTS)]).astype(np.float64)
    raw = text + bytes(quality.WIDTH + quality.STRIDE)
    n = max(1, -(-len(text) // quality.STRIDE))
    z = [np.concatenate([quality.VECTORS[b] for b in raw[i * quality.STRIDE : i * quality.STRIDE + quality.WIDTH]]) @ w + net.b for i in range(n)]
    step = quality.BLOCK
    chunks = [np.max(z[i : i + 2 * step], axis=0) for i in range(0, max(1, n - step), step)]
    m = np.maximum(np.array(chunks), 0)
    return 1 / (1 + np.exp(-(np.concatenate([m.max(0), m.mean(0)]) @ net.v + net.c[0])))


def test_network_matches_a_plain_convolution(larger):
    docs, _ = larger
    net = quality.Network()
    net.v += np.random.default_rng(1).normal(0, 0.5, net.v.size).astype(np.float32)
    texts = [b"", b"a", b"x" * 13] + [r.text.encode()[:3000] for r in docs.orderBy("doc_id").limit(12).collect()]
    assert np.allclose([net.score(t) for t in texts], [plain_convolution(net, t) for t in texts], atol=1e-4)


def test_trees_match_a_plain_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, toxicity.FEATURES))
    y = ((x[:, 3] > 0.4) & (x[:, 7] < 0.5)).astype(float)
    model = toxicity.Boosted(x, y)

    def walk(tree, row):
        while isinstance(tree, tuple):
            f, k, left, right = tree
            tree = left if sum(row[f] > e for e in model.edges[f]) <= k else right
        return tree

    for row, s in zip(x[:40], model.score(x[:40])):
        raw = model.trees[0] + sum(toxicity.RATE * walk(t, row) for t in model.trees[1:])
        pool = min(sum(raw > e for e in model.ends), len(model.ends) - 1)
        assert abs(s - (0.999 * model.values[pool] + 0.001 / (1 + np.exp(-raw)))) < 1e-9
    assert ((model.score(x) > 0.5) == (y == 1)).mean() > 0.97
    few = toxicity.Boosted(x[:20], (x[:20, 0] > 0).astype(float))
    assert few.trees and few.score(x[:20]).std() > 0


def test_repeated_ids_stay_within_the_sample(spark):
    from locusframe.llm.labelled import training_rows

    docs = spark.createDataFrame([(7, f"text {k}") for k in range(50)], "doc_id long, text string")
    labels = spark.createDataFrame([(7, 1)], "doc_id long, quality int")
    assert training_rows(docs, labels, "quality", 5, brute.fold(7, 5) + 1, 3).count() == 3


def test_columns_with_clashing_names_stay(messy):
    df = messy.withColumnRenamed("size", "quality_score").withColumnRenamed("kept", "QUALITY_SCORE_")
    network = quality.Network().fit([], np.zeros(0, np.float32))
    assert quality.score_quality(df, network).columns == [*df.columns, "quality_score__"]
