import brute
import pytest

from locusframe.llm import near_dedup


def kept_at(rows, percent):
    """Ids that stay, of rows with distinct ids, by all pairs."""
    sets = [(i, brute.shingles(t)) for i, t in rows]
    to = {i: i for i, _ in rows}
    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            if a and b and to[i] != to[j] and 100 * len(a & b) >= percent * len(a | b):
                low, high = sorted((to[i], to[j]))
                to = {x: low if y == high else y for x, y in to.items()}
    return sorted(i for i in to if to[i] == i)


def ids(df):
    return sorted(r.doc_id for r in df.select("doc_id").collect())


def test_pipeline_stage_drops_copies_of_80_percent(spark, sf):
    import corpus_pipeline as p

    base = [f"v{k}" for k in range(104)]
    rows = [(1, " ".join(base)), (2, " ".join(base[:-10] + [f"x{k}" for k in range(10)])), (3, " ".join(base[:-13] + [f"y{k}" for k in range(13)]))]
    a, b, c = (brute.shingles(t) for _, t in rows)
    assert len(a & b) / len(a | b) == 90 / 110 and len(a & c) / len(a | c) < 0.8 and len(b & c) / len(b | c) < 0.8
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert ids(p.drop_near_copies(spark, docs, sf)) == [1, 3]
    assert ids(near_dedup.keep_one_of_each(docs)) == [1, 2, 3]


def test_pipeline_stage_matches_brute_force_at_80(spark, sf, docs):
    import corpus_pipeline as p

    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert kept_at(rows, 80) != kept_at(rows, 85)
    assert ids(p.drop_near_copies(spark, docs, sf)) == kept_at(rows, 80)


@pytest.mark.parametrize("percent, rows, screen", [(85, 5, 0.65), (80, 4, 0.575)])
def test_bands_and_screen_follow_the_similarity(percent, rows, screen):
    assert near_dedup.rows_of(percent) == rows
    assert near_dedup.screen_of(percent) == pytest.approx(screen)
