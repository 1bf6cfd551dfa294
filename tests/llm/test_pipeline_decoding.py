import brute


def test_last_stage_decodes_what_it_encodes(spark, sf, messy, rows):
    import corpus_pipeline as p

    found = p.encode(spark, messy, sf)
    assert found.columns == [c for c in messy.columns if c != "text"] + ["ids", "n_tokens", "decoded_sha256"]
    brute.same([(r.doc_id, r.decoded_sha256) for r in found.select("doc_id", "decoded_sha256").collect()], [(i, brute.sha(t or "")) for i, t, *_ in rows])
