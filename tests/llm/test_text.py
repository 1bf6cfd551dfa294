import brute
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from locusframe.llm import byte_bpe, edit_fingerprint, lattice_lm, license_scan, mixing
from locusframe.llm.words import Words, run_hashes

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")


@pytest.fixture(scope="module")
def codec():
    with open(RANKS, "rb") as f:
        return byte_bpe.codec_of(f.read(), public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(codec):
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=codec.ranks, special_tokens={})


def test_minimal_perfect_hash_is_one(codec):
    assert sorted(map(codec.hash, codec.ranks)) == list(range(len(codec.ranks)))


def test_codec_agrees_with_the_library(codec, library, docs, rows):
    texts = [t or "" for _, t, *_ in rows] + [r.text for r in docs.select("text").collect()]
    texts += ["a b  c", "\x1c\x1d x", "tab\t\tend  ", "’s 's 'S", "́x ½ ²", "z" * 3000, "<|endoftext|>"]
    for t in texts:
        ids = codec.encode(t)
        assert np.frombuffer(ids, "<u4").tolist() == library.encode_ordinary(t)
        assert codec.decode(ids).decode() == t


def test_bpe_query_rows(messy, rows, library):
    found = byte_bpe.digests(byte_bpe.encode(messy, RANKS, public_tokenizers.PATTERN)).collect()
    ids = [(i, np.array(library.encode_ordinary(t or ""), "<u4")) for i, t, *_ in rows]
    brute.same(found, [(i, x.size, brute.sha(x.tobytes()), brute.sha(t or "")) for (i, x), (_, t, *_) in zip(ids, rows)])


def test_bpe_empty_and_columns(empty, messy):
    assert byte_bpe.encode(empty, RANKS, public_tokenizers.PATTERN).count() == 0
    assert byte_bpe.encoded_documents(messy, RANKS, public_tokenizers.PATTERN).columns == [c for c in messy.columns if c != "text"] + ["ids", "n_tokens"]
    clash = messy.withColumnRenamed("size", "ids").withColumnRenamed("kept", "n_tokens")
    found = byte_bpe.encoded_documents(clash, RANKS, public_tokenizers.PATTERN)
    assert found.columns == [c for c in clash.columns if c != "text"] + ["ids_", "n_tokens_"]
    assert {r.ids for r in found.select("ids").collect()} == {"size"}


def test_license_base_matches_brute_force(messy, rows, docs, empty):
    for df, data in ((messy, [(r[0], r[1]) for r in rows]), (docs, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])):
        found = license_scan.license_report(license_scan.scan_licenses(df))
        brute.same(found.select("doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels").collect(), brute.licenses(data))
    assert license_scan.scan_licenses(empty).count() == 0


def test_license_statistics_match_brute_force():
    s = license_scan.Scanner()
    sequences = [*s.sequences, *s.phrases]
    factors = {tuple(q[i:j]) for q in sequences for i in range(len(q)) for j in range(i + 1, len(q) + 1)}
    rng = np.random.default_rng(1)
    run = [c for _ in range(60) for q in [sequences[rng.integers(len(sequences))]] for a in [rng.integers(len(q))] for c in q[a : a + rng.integers(1, 9)]]
    for i, (_, length) in enumerate(s.statistics(run)):
        best = max(n for n in range(0, i + 2) if n == 0 or tuple(run[i + 1 - n : i + 1]) in factors)
        assert length == best


def test_license_spans_survive_edits():
    s = license_scan.Scanner()
    text = "foo bar. Permission is hereby granted, free of charge, to any individual obtaining a copy of this software and associated documentation files (the Software), to deal in the software without restriction baz"
    _, _, spans = s.scan(text.encode())
    assert [s.labels[k] for _, _, k, _ in spans] == ["mit"] and spans[0][0] == 2
    assert s.scan(b"of the software and the terms of this")[2] == []


def test_fingerprints(messy, rows, empty):
    found = {(r.doc_id, r.n_chars): r for r in edit_fingerprint.fingerprint(messy).collect()}
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    assert len(order) == edit_fingerprint.fingerprint(messy).count()
    for k, (i, t) in enumerate(order):
        if sum(j == i for j, _ in order) > 1:
            continue
        follows = order[(k + 1) % len(order)][1]
        r = found[i, len(t)]
        n = len(t) // 4
        assert r.edited == t[: len(t) - n] + follows[:n]
        assert 0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1
    assert edit_fingerprint.fingerprint(empty).count() == 0
    prints = {}
    for r in edit_fingerprint.fingerprint(messy).collect():
        prints[r.doc_id, r.n_chars] = r.fingerprint
    assert prints[4, len(rows[3][1])] == prints[6, len(rows[3][1])]


def test_fingerprint_likeness_follows_edit_distance():
    rng = np.random.default_rng(2)
    base = "".join(chr(97 + c) for c in rng.integers(0, 26, 3000))
    def edit(t, k):
        t = list(t)
        for p in rng.integers(0, len(t), k):
            if rng.random() < 0.5:
                t[p] = chr(97 + int(rng.integers(26)))
            else:
                t.insert(int(p), "q")
        return "".join(t)
    texts = [base, edit(base, 3), edit(base, 60), "".join(chr(97 + c) for c in rng.integers(0, 26, 3000))]
    p = edit_fingerprint.fingerprints([edit_fingerprint.symbols(t) for t in texts])
    a, b, c = (edit_fingerprint.likeness(p[0], x) for x in p[1:])
    assert a > b > c and a > 0.8 and c < 0.2


@pytest.mark.parametrize("few", [0, 12])
def test_walks_match_a_plain_walk(monkeypatch, few):
    t = edit_fingerprint.symbols("the quick brown fox " * 30)
    scale = edit_fingerprint.scale_of(t.size)
    i, seen = 0, []
    for step in range(4 << scale):
        c = int(t[i]) if i < t.size else 0
        seen.append("0123456789abcdef"[c])
        i += int(edit_fingerprint._BITS[step % edit_fingerprint.PERIOD, c])
    expected = ["".join(seen[x] for x in edit_fingerprint.times_of(scale + d)) for d in (0, 1)]
    monkeypatch.setattr(edit_fingerprint, "FEW", few)
    assert edit_fingerprint.fingerprints([t]) == [f"{scale:02x}:{expected[0].ljust(256, '0')}:{expected[1].ljust(256, '0')}"]


def test_long_walks_alone_are_the_same(monkeypatch):
    rng = np.random.default_rng(6)
    texts = [rng.integers(1, 16, n).astype(np.uint8) for n in (0, 1, 70, 5000, 200_000, 131_072)]
    alone = edit_fingerprint.fingerprints(texts)
    monkeypatch.setattr(edit_fingerprint, "FEW", 0)
    assert edit_fingerprint.fingerprints(texts) == alone


def test_fingerprint_report_holds_classes_and_likeness(messy, rows, empty):
    found = edit_fingerprint.report(edit_fingerprint.fingerprint(messy)).collect()
    assert len(found) == len(rows)
    order = sorted(((r[0], r[1] or "") for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    prints = dict(zip([t for _, t in order], edit_fingerprint.fingerprints([edit_fingerprint.symbols(t) for _, t in order])))
    once = {i: k for k, (i, _) in enumerate(order) if sum(j == i for j, _ in order) == 1}
    for r in found:
        if r.doc_id in once:
            k = once[r.doc_id]
            own, follows = order[k][1], order[(k + 1) % len(order)][1]
            e = edit_fingerprint.edited(own, follows)
            print_e = edit_fingerprint.fingerprints([edit_fingerprint.symbols(e)])[0]
            assert r.fingerprint == prints[own] and r.edited_fingerprint == print_e and r.edited_sha256 == brute.sha(e)
            assert r.near_edited == edit_fingerprint.likeness(prints[own], print_e) and r.near_next == edit_fingerprint.likeness(prints[own], prints[follows])
    classes = {r.doc_id: r.class_id for r in found if r.doc_id is not None}
    assert classes[6] == classes[7] == 4 and classes[10] == 9 and classes[15] == 15
    assert all(r.class_id is None for r in found if r.doc_id is None)
    assert edit_fingerprint.report(edit_fingerprint.fingerprint(empty)).count() == 0


def test_near_classes_match_all_pairs(spark, monkeypatch):
    rng = np.random.default_rng(5)
    texts = []
    for k in range(12):
        base = "".join(chr(97 + c) for c in rng.integers(0, 26, 400 + 60 * k))
        texts += [base] + ["".join(chr(97 + int(rng.integers(26))) if rng.random() < 0.01 * m else c for c in base) for m in range(1, 6)] + [base]
    prints = edit_fingerprint.fingerprints([edit_fingerprint.symbols(t) for t in texts])
    df = spark.createDataFrame(list(enumerate(prints)), "doc_id long, fingerprint string")
    parent = list(range(len(prints)))
    for i in range(len(prints)):
        for j in range(i):
            if edit_fingerprint.likeness(prints[i], prints[j]) >= 0.8:
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    assert len(set(parent)) < len(parent) - 20
    for bucket in (4096, 3):
        monkeypatch.setattr(edit_fingerprint, "BUCKET", bucket)
        assert dict(map(tuple, edit_fingerprint.near_classes(df).collect())) == dict(enumerate(parent))


VOCABULARY = public_tokenizers.path("piece_bpe_32k.model")


def test_lm_base_matches_brute_force(messy, rows, empty):
    found = lattice_lm.lm_score(messy, VOCABULARY, rounds=1).collect()
    expected = brute.base_scores([(r[0], r[1]) for r in rows])
    strip = lambda r: (*r[:5], round(r[5], 6))
    brute.same([strip(tuple(r)) for r in found], [strip(r) for r in expected])
    assert all(r.score < 0 for r in found)
    assert lattice_lm.lm_score(empty, VOCABULARY).count() == 0


def test_lattice_sums_over_all_segmentations():
    pieces = [b" a", b" ab", b"b", b"c", b"bc", b" ", b"a"]
    weights = np.log(np.array([0.2, 0.1, 0.2, 0.1, 0.1, 0.1, 0.2]))
    p = dict(zip(pieces, np.exp(weights)))

    def ways(s):
        return 1.0 if not s else sum(p[s[:k]] * ways(s[k:]) for k in range(1, len(s) + 1) if s[:k] in p)

    def uses(s):
        if not s:
            return [((), 1.0)]
        return [((s[:k], *u), p[s[:k]] * w) for k in range(1, len(s) + 1) if s[:k] in p for u, w in uses(s[k:])]

    lattice = lattice_lm.Lattice(pieces)
    words = [b"abc", b"a", b"abcbc", b"ca"]
    assert np.allclose(np.exp(lattice.score(words, weights)[0]), [ways(b" " + w) for w in words])
    expected = np.zeros(len(pieces))
    for w in words:
        every = uses(b" " + w)
        total = sum(x for _, x in every)
        for u, x in every:
            for piece in u:
                expected[pieces.index(piece)] += x / total
    got = sum(lattice.expected(lattice.arcs(m), weights, np.ones(len(m))) for _, m in lattice.batches(words))
    assert np.allclose(got, expected)


def test_long_words_are_read_through_a_window(monkeypatch):
    rng = np.random.default_rng(4)
    lattice = lattice_lm.Lattice(lattice_lm.read_pieces(VOCABULARY))
    weights = lattice_lm.first_weights(lattice.order.size)
    words = [bytes(rng.choice(list(b"abcdetion"), n).astype(np.uint8)) for n in (40, 97, 333)]
    whole, expected = lattice.score(words, weights)[0], sum(lattice.expected(lattice.arcs(m), weights, np.ones(len(m))) for _, m in lattice.batches(words))
    monkeypatch.setattr(lattice_lm, "LONG", 32)
    assert np.allclose(lattice.score(words, weights)[0], whole)
    assert np.allclose(sum(lattice.long_expected(b" " + w, weights) for w in words), expected)


def test_lm_document_scores_match_brute_force(messy, rows):
    """Every segmentation of every word of a text, by a plain recursion over its pieces."""
    pieces = lattice_lm.read_pieces(VOCABULARY)
    logs = dict(zip(pieces, lattice_lm.first_weights(len(pieces))))
    train = [t or "" for i, t, *_ in rows if brute.fold(i, 5) != 1]
    used = sum(len(lattice_lm.words_of(t.encode())) for t in train)
    p_end = (len(train) + 0.5) / (used + len(train) + 1)

    def word(w):
        w, sums = b" " + w, [1.0]
        for e in range(1, len(w) + 1):
            sums.append(sum(sums[s] * np.exp(logs[w[s:e]]) for s in range(max(0, e - 30), e) if w[s:e] in logs))
        return np.log(sums[-1]) + np.log(1 - p_end)

    found = sorted((brute.key((r.doc_id, r.n_tokens)), r.score) for r in lattice_lm.lm_score(messy, VOCABULARY).collect())
    short = [(i, t or "") for i, t, *_ in rows]
    expected = sorted((brute.key((i, len(w) + 1)), (sum(map(word, w)) + np.log(p_end)) / np.log(10)) for i, t in short for w in [lattice_lm.words_of(t.encode())] if not w or max(map(len, w)) < 200)
    keys = {k for k, _ in expected}
    got = [f for f in found if f[0] in keys]
    assert [k for k, _ in got] == [k for k, _ in expected] and np.allclose([s for _, s in got], [s for _, s in expected])


def test_lm_tells_long_words_apart(spark):
    from test_dedup import long_words

    x, y = long_words()
    docs = [(k, t) for k, t in enumerate(["a " + x, "a b", "b a", "c " + y, "b c", "c " + x, "a " + y])]
    found = lattice_lm.lm_score(spark.createDataFrame(docs, "doc_id long, text string"), VOCABULARY).collect()
    strip = lambda r: (*r[:5], round(r[5], 6))
    brute.same([strip(tuple(r)) for r in found], [strip(r) for r in brute.base_scores(docs)])


def test_lm_scores_do_not_depend_on_the_head(messy, monkeypatch):
    a = sorted((brute.key((r.doc_id, r.n_tokens)), round(r.score, 6), round(r.fitted_score, 6)) for r in lattice_lm.lm_score(messy, VOCABULARY, rounds=1).collect())
    monkeypatch.setattr(lattice_lm, "HEAD_WORDS", 3)
    b = sorted((brute.key((r.doc_id, r.n_tokens)), round(r.score, 6), round(r.fitted_score, 6)) for r in lattice_lm.lm_score(messy, VOCABULARY, rounds=1).collect())
    assert a == b


def test_word_kernel():
    texts = [b"one two\tthree", b"", b"two", b"  three  one " + b"x" * 5000]
    w = Words(texts)
    by_text = [list(h) for h in w]
    assert [len(x) for x in by_text] == [3, 0, 1, 3]
    assert by_text[0][1] == by_text[2][0] and by_text[0][0] == by_text[3][1] and by_text[0][2] == by_text[3][0]
    a = np.arange(1, 200, dtype=np.uint64) % np.uint64(7)
    h = run_hashes(a, 50)
    assert h.size == 150 and (h[7:] == h[:-7]).all() and len(set(h.tolist())) == 7


def plain_targets(sizes):
    names = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    w = {s: (3, 1, 2)[k % 3] for k, s in enumerate(names)}
    need, open_, target = 1.5 * sum(sizes.values()), set(names), {}
    while open_:
        share = need / sum(w[s] for s in open_)
        over = {s for s in open_ if share * w[s] > 2 * sizes[s]}
        for s in over or open_:
            target[s] = 2 * sizes[s] if over else share * w[s]
        need -= sum(target[s] for s in over)
        open_ -= over or open_
    return target


def test_mix_targets_and_takes(spark, docs, messy, rows, empty):
    for df in (docs, messy):
        data = [(r.doc_id, r.text, r.source) for r in df.select("doc_id", "text", "source").collect()]
        sizes = {}
        for _, t, s in data:
            sizes[s] = sizes.get(s, 0) + len(brute.WORD.findall(t or ""))
        target = plain_targets(sizes)
        sources = {(i, len(brute.WORD.findall(t or ""))): s for i, t, s in data}
        found = mixing.mix_report(df).collect()
        assert len(found) == len(data)
        taken = {}
        for r in found:
            s = sources[r.doc_id, r.size]
            assert r.source_size == sizes[s] and abs(r.target - target[s]) < 1e-6 * max(1, target[s])
            assert 0 <= r.taken <= 2 * r.size
            taken[s] = taken.get(s, 0) + r.taken
        for s in sizes:
            assert abs(taken[s] - target[s]) <= 128
        assert sorted(map(tuple, mixing.mix_report(df).collect()), key=brute.key) == sorted(map(tuple, found), key=brute.key)
    assert mixing.mix_report(empty).count() == 0


def test_mixed_documents_hold_the_taken_words(docs, messy):
    for df in (docs, messy):
        got = mixing.mixed_documents(df)
        assert got.columns == df.columns
        words = {}
        for r in got.collect():
            words[r.doc_id] = words.get(r.doc_id, 0) + len(brute.WORD.findall(r.text))
            assert r.n_chars == len(r.text)
        taken = {}
        for r in mixing.mix_report(df).collect():
            taken[r.doc_id] = taken.get(r.doc_id, 0) + r.taken
        assert {i: n for i, n in taken.items() if n} == words


def test_rows_that_repeat_an_id_are_mixed_apart(spark):
    texts = [" ".join(f"{name}{i}" for i in range(n)) for name, n in (("a", 300), ("b", 200), ("c", 70))]
    rows = [(1, "", "x"), (1, None, "x"), *[(1, t, "x") for t in texts], (1, texts[1], "x"), (1, texts[0], "y"), (None, texts[2], None), (None, "", None), (None, texts[1], None), (2, texts[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    plain = {i: brute.WORD.findall(t or "") for i, t in enumerate(texts)}
    words = {}
    for r in mixing.mixed_documents(df).collect():
        got = r.text.split(" ")
        (whole,) = [w for w in plain.values() if w[0][0] == got[0][0]]
        assert got == [w for w in whole if w in set(got)]
        key = r.doc_id, r.source, len(whole)
        words[key] = words.get(key, 0) + len(got)
    taken, sizes = {}, {(t, s): len(brute.WORD.findall(t or "")) for _, t, s in rows}
    laid, slots = mixing.mix(df)
    for r in mixing.taken_spans(laid, slots).collect():
        key = r.doc_id, r.source, r.size
        taken[key] = taken.get(key, 0) + r.times * (r.hi - r.lo)
    assert words == taken and {k[2] for k in taken} <= set(sizes.values())
    pieces = {}
    for r in mixing.mixed_shards(df, shard_slots=4).collect():
        key = r.doc_id, r.source
        pieces[key] = pieces.get(key, 0) + len(r.text.split(" "))
    sums = {}
    for (i, s, _), n in taken.items():
        sums[i, s] = sums.get((i, s), 0) + n
    assert pieces == sums


def test_slots_permute_blocks(spark):
    targets = spark.createDataFrame([(0, "a", 64 * 1000003, 1.5 * 64 * 1000003 / 1000), (1, "b", 6400, 12800.0), (2, None, 65, 100.0)], "k long, source string, source_size long, target double")
    slots = mixing.draw_slots(targets).collect()
    blocks = {}
    for r in slots:
        blocks.setdefault(r.source, []).append(r.block)
    assert sorted(blocks["b"]) == sorted([*range(100)] * 2) and sorted(blocks[None]) == [0, 0, 1]
    assert len(set(blocks["a"])) == len(blocks["a"]) == 1500 and 0 <= min(blocks["a"]) and max(blocks["a"]) < 1000003
    # slots that follow each other don't take neighbours
    a = np.array([r.block for r in sorted((r for r in slots if r.source == "a"), key=lambda r: r.slot)])
    assert np.mean(np.abs(np.diff(a)) < 50_000) < 0.3 and abs(np.corrcoef(a[:-1], a[1:])[0, 1]) < 0.15


def test_shards_draw_their_sources(spark):
    targets = spark.createDataFrame([(0, "a", 64 * 4000, 64 * 6000.0), (1, "b", 64 * 9000, 64 * 3000.0), (2, "c", 64 * 2000, 64 * 1000.0)], "k long, source string, source_size long, target double")
    counts = mixing.shard_counts(mixing.slot_totals(targets), 250).collect()
    shards, totals = {}, {}
    for r in counts:
        shards.setdefault(r.shard, {})[r.k] = r.n
        totals[r.k] = totals.get(r.k, 0) + r.n
    assert totals == {0: 6000, 1: 3000, 2: 1000}
    assert sorted(shards) == list(range(40)) and all(sum(s.values()) == 250 for s in shards.values())
    # the spread of a multinomial draw: 250 * 0.6 * 0.4 = 60
    assert 25 < np.var([shards[s].get(0, 0) for s in range(36)]) < 120


def test_mixed_shards_hold_the_mix(docs, messy, empty):
    for df in (docs, messy):
        rows = mixing.mixed_shards(df, shard_slots=16).collect()
        taken, size = {}, {}
        for r in rows:
            taken[r.doc_id] = taken.get(r.doc_id, 0) + len(r.text.split(" "))
        for r in mixing.mix_report(df).collect():
            size[r.doc_id] = size.get(r.doc_id, 0) + r.taken
        assert taken == {i: n for i, n in size.items() if n}
    assert mixing.mixed_shards(empty).count() == 0
