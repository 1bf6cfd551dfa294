import brute
import numpy as np
import public_tokenizers
import tiktoken

from locusframe.llm import byte_bpe


def test_pipeline_stages_follow_from_their_inputs(spark, sf):
    import corpus_pipeline as p

    docs = p.table(spark, sf, "documents")
    columns = docs.columns
    names = [n for n, _ in p.STAGES]
    assert len(names) == 5
    before, outs = docs, []
    for name, stage in p.STAGES:
        before = p.cut(stage(spark, before, sf), "test")
        outs.append(before)
        if name != names[-1]:
            assert before.columns == columns
    good, exact, near, mixed, encoded = ([tuple(r) for r in o.collect()] for o in outs)
    ids = lambda rows: sorted(r[0] for r in rows)
    assert ids(exact) == sorted(r[0] for r in brute.exact([(r[0], r[1]) for r in good]) if r[3])
    assert ids(near) == sorted(r[0] for r in brute.near([(r[0], r[1]) for r in exact], p.SIMILARITY) if r[3])
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = byte_bpe.read_ranks(f.read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r[0], np.array(library.encode_ordinary(r[1]), "<u4").tobytes()) for r in mixed)
    assert sorted((r["doc_id"], bytes(r["ids"])) for r in outs[-1].collect()) == want
    labels = {r.doc_id: r.quality for r in p.table(spark, sf, "labels").collect()}
    kept = set(ids(good))
    clean = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in clean) >= 0.97 * len(clean)
