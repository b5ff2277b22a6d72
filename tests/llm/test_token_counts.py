import os
import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import token_counts as T


def greedy(word, pieces, longest):
    """Tokens of a word's symbols by trying the longest piece first; -1 if none fits."""
    s, at, n = (*word, T.END), 0, 0
    while at < len(s) - 1:
        k = next((k for k in range(min(longest, len(s) - at), 0, -1) if s[at : at + k] in pieces), 0)
        if not k:
            return -1
        at, n = at + k, n + 1
    return n


@given(st.lists(st.lists(st.integers(97, 100), min_size=1, max_size=5), max_size=25), st.lists(st.booleans(), min_size=25, max_size=25), st.lists(st.lists(st.integers(97, 101), min_size=1, max_size=14), min_size=1, max_size=12))
@settings(max_examples=300, deadline=None)
def test_against_greedy_matching(bodies, ends, words):
    pieces = {(*b, T.END) if e else tuple(b) for b, e in zip(bodies, ends)}
    automaton = T.Automaton(sorted(pieces))
    flat = np.array([x for w in words for x in w], np.uint8)
    end = np.cumsum([len(w) for w in words])
    got = automaton.counts(flat, end - [len(w) for w in words], end)
    assert got.tolist() == [greedy(tuple(w), pieces, 6) for w in words]


def test_very_long_words_are_walked_whole():
    pieces = {(97,), (98,), (97, 98), (97, 98, 97), (98, 98, T.END), (99, 99, 99)}
    automaton = T.Automaton(sorted(pieces))
    rng = random.Random(4)
    words = [bytes(rng.choice(b"ab") for _ in range(n)) for n in (1_000_000, 70_000, 300, 299, 3, 1)] + [b"a" * 500_000 + b"c" + b"b" * 500_000, b"c" * 300_000]
    flat, end = np.frombuffer(b"".join(words), np.uint8), np.cumsum([len(w) for w in words])
    assert automaton.counts(flat, end - [len(w) for w in words], end).tolist() == [greedy(tuple(w), pieces, 3) for w in words]


@pytest.mark.skipif(not os.path.exists(T.VOCABULARY), reason="needs the vocabulary")
def test_rows(spark):
    rng = random.Random(3)
    pieces = set(T.load_pieces())
    longest = max(map(len, pieces))
    words = ["the", "Éai", "unbelievable", "x" * 3000, "anon!!", "réeuxê", "🎉", "2024-01-01", "antidisestablishmentarianism"]
    texts = [None, "", " \n", *(" ".join(rng.choice(words) for _ in range(rng.choice([1, 5, 60]))) for _ in range(40)), "THE the\tThe"]
    rows = [(i, t, 0) for i, t in enumerate(texts)] + [(5, texts[5], 0), (None, "the", 0)]
    got = T.count(spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")).collect()
    want = []
    for i, t, _ in rows:
        w = [x.encode().lower() for x in (t or "").translate({c: " " for c in range(9, 14)}).split(" ") if x]
        n = [greedy(tuple(x), pieces, longest) for x in w]
        want.append((i, len(w), sum(map(abs, n)), sum(x < 0 for x in n)))
    assert sorted(map(tuple, got), key=repr) == sorted(want, key=repr)
    assert T.count(spark.createDataFrame([], "doc_id long, text string")).count() == 0
