import numpy as np
import pytest

from locusframe.llm import license_scan
from locusframe.llm.license_scan import TEMPLATES


def labels_of(spans, s):
    return {s.labels[k] for _, _, k, _ in spans}


@pytest.fixture(scope="module")
def scanner():
    return license_scan.Scanner()


@pytest.mark.parametrize("text", [
    "Licensed under the Apache License, Version 2.0. The rest follows",
    'Licensed under the Apache License, Version 2.0 (the "License") applies',
    " ".join(TEMPLATES[1][1].split()[:15]) + " or else",
])
def test_template_is_found_where_a_longer_one_goes_on(scanner, text):
    spans = scanner.scan(text.encode())[2]
    assert labels_of(spans, scanner) == {"apache-2.0"}
    assert max(c for *_, c in spans) == 1


def test_every_template_is_found_before_and_after_words_of_the_others(scanner):
    for k, (label, text) in enumerate(TEMPLATES):
        n = len(scanner.sequences[k])
        for _, other in TEMPLATES:
            words = other.split()
            for i in range(len(words)):
                spans = scanner.scan(f"{text} {' '.join(words[i:])}".encode())[2]
                assert any(s == 0 and t == k and c == 1 for s, _, t, c in spans), (text, words[i:])
                before = license_scan.split_words(" ".join(words[:i]).encode())
                spans = scanner.scan(f"{' '.join(words[:i])} {text}".encode())[2]
                assert any(e >= len(before) + n and t == k and c == 1 for _, e, t, c in spans), (words[:i], text)


def test_matches_are_the_longest_of_each_template(scanner):
    rng = np.random.default_rng(4)
    taken = []
    scanner = license_scan.Scanner()
    scanner._chained = lambda m: taken.append(sorted(set(m))) or []
    words = [license_scan.split_words(t.encode()) for _, t in TEMPLATES]
    for _ in range(40):
        text = [w for _ in range(12) for q in [words[rng.integers(len(words))]] for a in [rng.integers(len(q))] for w in q[a : a + rng.integers(1, 12)]]
        scanner.scan(b" ".join(text))
        expected = []
        for k, q in enumerate(words):
            for p in range(len(text)):
                for a in range(len(q)):
                    if text[p] != q[a] or p and a and text[p - 1] == q[a - 1]:
                        continue
                    n = 1
                    while p + n < len(text) and a + n < len(q) and text[p + n] == q[a + n]:
                        n += 1
                    if n >= 3:
                        expected.append((k, p, a, n))
        assert taken.pop() == sorted(expected)


def test_a_licence_is_not_named_after_its_like(scanner):
    for k in (11, 13):
        spans = scanner.scan(TEMPLATES[k][1].encode())[2]
        assert labels_of(spans, scanner) == {TEMPLATES[k][0]}


def test_a_short_match_before_a_template_does_not_hide_it(scanner):
    text = "the free software foundation " + TEMPLATES[8][1]
    assert any(t == 8 and c == 1 for _, _, t, c in scanner.scan(text.encode())[2])
