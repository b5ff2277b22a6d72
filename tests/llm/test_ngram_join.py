import random
import re
from pathlib import Path

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import ngram_join, store
from tallyframe.llm.graph import components


def shingles(text, k=4):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(w[i : i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(docs, percent=85):
    sets = [shingles(t) for _, t in docs]
    parent = list(range(len(docs)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[root(i)] = root(j)
    least = {}
    for i, (d, _) in enumerate(docs):
        if d is not None:
            least[root(i)] = min(d, least.get(root(i), d))
    return sorted(((d, len(sets[i]), least.get(root(i)) if sets[i] else d) for i, (d, _) in enumerate(docs)), key=repr)


def corpus(n=240, seed=3):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(300)]
    text = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage = text(40)
    docs = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4 or not docs:
            w = text(rng.choice([1, 2, 3, 4, 30, 60, 200]))
        elif kind < 0.6:
            w = list(rng.choice(docs))
        elif kind < 0.9:
            w = list(rng.choice(docs))
            for _ in range(rng.choice([1, 1, 2, 3])):
                w[rng.randrange(len(w))] = rng.choice(vocab)
        else:
            w = passage + text(rng.choice([5, 10, 60]))
        docs.append(w)
    rows = [(i * 7 % 1009, " ".join(w).replace("w1 ", "W1\t\n") + " " * (i % 2)) for i, w in enumerate(docs)]
    return rows + [(2000, None), (2001, ""), (2002, " \n "), (None, rows[5][1]), (rows[9][0], rows[9][1]), (2003, " ".join(text(20_000))), (2004, "ONE two")]


def got(spark, docs, cfg=ngram_join.Settings()):
    frame = spark.createDataFrame([(d, t, "clash", 5) for d, t in docs], "doc_id long, text string, class string, n int").repartition(3)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in ngram_join.join(frame, cfg).collect()), key=repr)


def test_against_brute_force(spark):
    docs = corpus()
    assert got(spark, docs) == brute(docs)


def test_salted_shingles_and_dealt_groups_give_the_same(spark):
    docs = corpus(200, 8)
    # a chain of near copies, so that one set of candidates is large
    rng, base = random.Random(1), [f"b{i}" for i in range(120)]
    for i in range(60):
        if rng.random() < 0.5:
            base = list(base)
            base[rng.randrange(120)] = f"c{i}"
        w = list(base)
        for _ in range(rng.choice([0, 1, 2, 4])):
            w[rng.randrange(120)] = f"d{rng.randrange(1000)}"
        docs.append((3000 + i, " ".join(w)))
    assert got(spark, docs, ngram_join.Settings(hot=5, group_docs=7, sketch_bits=8)) == brute(docs)


def ties(spark, texts, cfg, parts=1):
    frame = spark.createDataFrame([(t,) for t in texts], "text string").repartition(parts)
    return ngram_join._ties(frame, np.zeros(1 << cfg.sketch_bits, np.int32), cfg).count()


def test_two_meetings_in_long_lists_tie_no_large_sets(spark):
    # each text has a phrase in common with two others, and another one with two others; lists of three are long
    rng = random.Random(4)
    own = lambda i, k: [f"x{i}.{j}.{rng.random()}" for j in range(k)]
    phrase = lambda i: [f"p{i}.{j}" for j in range(4)]
    texts = [" ".join(own(i, 100) + phrase(f"a{i // 3}") + own(i, 50) + phrase(f"b{(i + 1) // 3}") + own(i, 50)) for i in range(60)]
    assert ties(spark, texts, ngram_join.Settings(short=2, percent=50)) == 0


def test_copies_make_no_list_long(spark):
    rng = random.Random(6)
    texts = [" ".join([*"abcd"] + [f"x{rng.random()}" for _ in range(60)]) for _ in range(2)]
    assert ties(spark, texts * 20, ngram_join.Settings(percent=10), 8) == 0


def test_short_lists_of_two_give_the_same(spark):
    docs = corpus(220, 11)
    assert got(spark, docs, ngram_join.Settings(short=2)) == brute(docs)
    assert got(spark, docs, ngram_join.Settings(short=3, percent=60, sketch_bits=6, per_meeting=9)) == brute(docs, 60)


def test_slices_of_the_lists_give_the_same_and_keep_only_what_meets(spark, monkeypatch):
    docs = corpus(200, 5)
    assert got(spark, docs, ngram_join.Settings(slices=7)) == brute(docs)
    kept = []
    monkeypatch.setattr(ngram_join, "written", lambda df, tag: kept.append((tag, df.count())) or df)
    alone = [" ".join(f"x{i}.{j}" for j in range(50)) for i in range(20)]
    assert ties(spark, [*alone, alone[0] + " y"], ngram_join.Settings(slices=4)) > 0
    assert [tag for tag, _ in kept] == ["lists"] * 4 and 0 < sum(n for _, n in kept) <= 2 * 50


def shuffled(spark):
    """Bytes that the session's tasks have written to shuffles so far."""
    sc = spark.sparkContext._jsc.sc()
    sc.listenerBus().waitUntilEmpty()
    stages = sc.statusStore().stageList(None, False, False, spark.sparkContext._gateway.new_array(spark.sparkContext._jvm.double, 0), None)
    return sum(stages.apply(i).shuffleWriteBytes() for i in range(stages.size()))


def test_texts_without_copies_are_not_shuffled(spark):
    rng = random.Random(12)
    words = lambda k: " ".join(f"{rng.getrandbits(40):x}" for _ in range(k))
    rows = [(i, words(400)) for i in range(200)]
    rows += [(900, rows[3][1]), (901, rows[7][1] + " more"), (None, words(9)), (902, None), (903, " ")]
    out = ngram_join.distinct(store.written(spark.createDataFrame(rows, "doc_id long, text string"), "docs"))
    before = shuffled(spark)
    kept = [tuple(r) for r in out.collect()]
    assert sorted(kept, key=repr) == sorted((r for r in rows if r[0] not in (900, 901)), key=repr)
    assert shuffled(spark) - before < sum(len(t or "") for _, t in rows) / 4


def test_tables_go_once_they_are_read(spark):
    tables = lambda: {p.name for p in Path(store.shared_dir(spark).removeprefix("file://")).iterdir()}
    before = tables()
    docs = spark.createDataFrame([(d, t) for d, t in corpus(60, 2)], "doc_id long, text string")
    ngram_join.distinct(docs).collect()
    left = sorted({x.split("-")[0] for x in tables() - before})
    assert not {"profiles", "lists", "candidates"} & set(left), left


def test_empty_table(spark):
    assert got(spark, []) == []
    assert got(spark, [(1, None), (2, "")]) == [(1, 0, 1), (2, 0, 2)]


@given(st.lists(st.lists(st.integers(0, 9), max_size=8, unique=True), min_size=1, max_size=9), st.integers(1, 9))
@settings(max_examples=200, deadline=None)
def test_merge_skips_nothing(lists, least):
    lists = [np.array(sorted(x), np.int64) for x in lists if x]
    met, times = ngram_join._merge(lists, least)
    count = {v: sum(v in x for x in lists) for v in range(10)}
    assert dict(zip(met.tolist(), times.tolist())) == {v: c for v, c in count.items() if c >= least}


def test_components(spark):
    rng = random.Random(0)
    edges = [(i, i + 1) for i in range(50)] + [(rng.randrange(100, 160), rng.randrange(100, 160)) for _ in range(40)] + [(7, 7)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u int, v int")).collect()}
    assert all(got[i] == 0 for i in range(51)) and all(got[a] == got[b] <= min(a, b) for a, b in edges if a != b)
