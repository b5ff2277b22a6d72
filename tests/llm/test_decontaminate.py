import hashlib
import random
import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import decontaminate
from tallyframe.llm.fmindex import FMIndex, suffix_order

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(text, items, width=13):
    w = words(text)
    hit, ids = set(), set()
    for item, t in items:
        iw = words(t)
        size = min(width, len(iw))
        if not size:
            continue
        grams = {tuple(iw[i : i + size]) for i in range(len(iw) - size + 1)}
        for i in range(len(w) - size + 1):
            if tuple(w[i : i + size]) in grams:
                hit.update(range(i, i + size))
                ids.add("null" if item is None else str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest(), len(hit) > 0 and 20 * len(hit) >= len(w)


@given(st.lists(st.integers(0, 3), max_size=60), st.integers(1, 5))
@settings(max_examples=150, deadline=None)
def test_index_against_plain_search(symbols, every):
    text = np.array([*symbols, 0], np.int64)
    order = suffix_order(text)
    zeros = np.cumsum(text == 0)
    suffixes = sorted(range(len(text)), key=lambda i: [(0, int(zeros[j])) if text[j] == 0 else (1, int(text[j])) for j in range(i, len(text))])
    assert order.tolist() == suffixes
    index = FMIndex(text, 3, every)
    patterns = [[1], [2, 1], [1, 2, 3], [3, 3], [1, 1, 1, 1]]
    grid = np.zeros((len(patterns), 4), np.int64)
    for k, p in enumerate(patterns):
        grid[k, : len(p)] = p
    low, high = index.search(grid, np.array([len(p) for p in patterns]))
    for k, p in enumerate(patterns):
        want = [i for i in range(len(text)) if text[i : i + len(p)].tolist() == p]
        assert sorted(index.locate(np.arange(low[k], high[k])).tolist()) == want


def corpus():
    rng = random.Random(5)
    vocab = [f"w{i}" for i in range(40)] + ["Étage", "naïve", "x1"]
    text = lambda n: " ".join(rng.choice(vocab) for _ in range(n))
    items = [(i, text(rng.choice([15, 20, 40]))) for i in range(8)] + [(8, "w1 W2 w3"), (9, "Étage"), (10, ""), (11, None), (None, text(14)), (0, text(16)), (12, text(13))]
    docs = []
    for i in range(60):
        t = text(rng.choice([0, 1, 5, 30, 300]))
        if i % 3 == 0:
            t += ", " + items[i % 8][1].upper().replace(" ", " -- ") + "! " + text(20)
        if i % 5 == 0:
            t = items[12][1] + "\n" + t
        docs.append((i, t))
    docs += [(100, None), (101, ""), (102, "…"), (3, docs[3][1]), (None, docs[6][1]), (103, text(30_000) + " " + items[2][1]), (104, items[0][1] + " " + items[0][1])]
    return docs, items


def check(spark, **settings):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "clash", 1) for i, t in docs], "doc_id long, text string, items string, n_words int")
    bench = spark.createDataFrame([(i, t, "clash") for i, t in items], "item_id long, text string, window string")
    got = decontaminate.judged(frame, bench, **settings).collect()
    want = sorted((repr(i), *brute(t, items)) for i, t in docs)
    assert sorted((repr(r.doc_id), r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got) == want
    assert any(r.contaminated for r in got) and not all(r.contaminated for r in got)
    for r in got:
        assert all(a.end < b.start for a, b in zip(r.spans, r.spans[1:]))


def test_against_brute_force(spark):
    check(spark)


def test_blocks_of_windows_give_the_same(spark):
    check(spark, block_windows=40, every=3)


def test_a_window_of_very_many_items_is_spread_over_blocks(spark):
    """All items share a passage; each block holds some of them."""
    shared = " ".join(f"w{k}" for k in range(14))
    bench = spark.createDataFrame([(k, shared + f" own{k}") for k in range(300)], "item_id long, text string")
    docs = spark.createDataFrame([(1, "x " * 20 + shared), (2, "x " * 20 + shared + " own7"), (3, "x")], "doc_id long, text string")
    assert decontaminate.Blocks(bench, 13, 100).count > 1
    for most in (100, 200_000):
        got = {r.doc_id: (r.n_hit, r.n_items) for r in decontaminate.judged(docs, bench, block_windows=most).collect()}
        assert got == {1: (14, 300), 2: (15, 300), 3: (0, 0)}


def test_empty_tables(spark):
    docs, items = corpus()
    none = spark.createDataFrame([], "item_id long, text string")
    got = decontaminate.judged(spark.createDataFrame(docs, "doc_id long, text string"), none).collect()
    assert len(got) == len(docs) and not any(r.n_hit for r in got)
    assert decontaminate.judged(spark.createDataFrame([], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).count() == 0


def test_clean_keeps_all_columns_and_all_clean_documents(spark):
    docs, items = corpus()
    frame = spark.createDataFrame([(i, t, "x", k) for k, (i, t) in enumerate(docs)], "doc_id long, text string, spans string, number int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = [k for k, (_, t) in enumerate(docs) if not brute(t, items)[4]]
    for settings in ({}, {"block_windows": 40}):
        kept = decontaminate.clean(frame, bench, **settings)
        assert kept.columns == frame.columns and sorted(r.number for r in kept.collect()) == want
