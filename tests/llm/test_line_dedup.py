import random

from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import line_dedup


@given(st.lists(st.integers(0, 6), max_size=25), st.lists(st.integers(0, 6), max_size=25))
@settings(max_examples=300, deadline=None)
def test_alignment_is_increasing_and_equal(a, b):
    pairs = line_dedup.align(a, b)
    assert all(a[i] == b[j] for i, j in pairs)
    assert all(x[0] < y[0] and x[1] < y[1] for x, y in zip(pairs, pairs[1:]))


@given(st.lists(st.integers(), max_size=30, unique=True), st.data())
@settings(max_examples=150, deadline=None)
def test_alignment_of_unique_lines_is_a_longest_common_subsequence(a, data):
    b = data.draw(st.permutations(a)) if a else []
    b = b[: data.draw(st.integers(0, len(b)))] + [10**30]
    best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
    # equal ends are always matched, which never costs a pair of unique lines
    assert len(line_dedup.align(a, b)) == best[-1][-1]


def line(rng, n):
    return " ".join(f"w{rng.randrange(10**6)}" for _ in range(n))


def test_repeated_passages_go_from_later_documents_only(spark):
    rng = random.Random(2)
    passage = [line(rng, 20), line(rng, 15), "", line(rng, 18)]
    short = line(rng, 8)
    docs = []
    for i in range(60):
        own = [line(rng, rng.choice([5, 12, 30])) for _ in range(6)]
        if i % 3 == 0:
            own[2:2] = passage
        if i % 2 == 0:
            own.insert(rng.randrange(len(own)), short) if i % 3 else own.append(short)
        docs.append((i, "\n".join(own)))
    long = "\n".join(line(rng, 10) for _ in range(3000))
    docs += [(100, docs[1][1]), (101, None), (102, ""), (103, long), (104, long + "\n" + line(rng, 3)), (105, "\n\n"), (None, docs[2][1]), (5, docs[5][1])]
    frame = spark.createDataFrame([(i, t, "x", b"id") for i, t in docs], "doc_id long, text string, blocks string, id binary").repartition(5)
    rows = line_dedup.apply(frame).collect()
    assert len(rows) == len(docs) and {"blocks", "id"} <= set(rows[0].asDict())
    got = {}
    for r in rows:
        got.setdefault(r.doc_id, []).append(r)
    texts = dict(docs)
    for i in range(60):
        r, want = got[i][0], texts[i]
        if i % 3 == 0 and i:
            want = want.replace("\n".join(passage) + "\n", "")
            assert r.lines_deleted == 4 and r.words_deleted == 53
        assert r.text == want
    assert got[100][0].text == "" and got[None][0].text == ""
    assert got[101][0].text is None and got[102][0].text == "" and got[105][0].text == "\n\n"
    assert got[103][0].text == long and got[104][0].text == texts[104].rsplit("\n", 1)[1]
    assert [r.text for r in got[5]] == [texts[5]] * 2


def test_every_deleted_line_is_in_an_earlier_document(spark):
    rng = random.Random(9)
    pool = [line(rng, rng.choice([1, 4, 15, 40])) for _ in range(60)]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 3, 10])))) for i in range(120)]
    kept = {r.doc_id: r.text.split("\n") for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    first = {}
    for i, t in docs:
        for x in t.split("\n"):
            first.setdefault(x, i)
    assert all(x in kept[i] for x, i in first.items())
    assert sum(map(len, kept.values())) < sum(len(t.split("\n")) for _, t in docs)


def test_empty_table(spark):
    assert line_dedup.apply(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def by_all_pairs(docs, least_words=30):
    """Texts after every block of lines that any earlier document has went, by comparing all pairs of blocks."""
    out = {}
    for n, (i, text) in enumerate(docs):
        rows, dead = text.split("\n"), set()
        earlier = {tuple(o[s:e]) for _, t in docs[:n] for o in [t.split("\n")] for s in range(len(o)) for e in range(s + 1, len(o) + 1)}
        for s in range(len(rows)):
            for e in range(s + 1, len(rows) + 1):
                if sum(len(x.split()) for x in rows[s:e]) >= least_words and tuple(rows[s:e]) in earlier:
                    dead |= set(range(s, e))
        out[i] = "\n".join(r for k, r in enumerate(rows) if k not in dead)
    return out


def test_a_passage_whose_lines_begin_in_different_documents_goes_at_any_number_of_holders(spark):
    rng = random.Random(4)
    a, b = line(rng, 26), line(rng, 26)
    docs = [(1, a + "\n" + line(rng, 9)), (2, line(rng, 9) + "\n" + b)] + [(i, "\n".join([line(rng, 7), a, b, line(rng, 8)])) for i in range(3, 31)]
    rows = line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id: r.text for r in rows} == by_all_pairs(docs)
    assert sorted(r.doc_id for r in rows if r.words_deleted == 52) == list(range(4, 31))


def test_moved_and_repeated_passages_go(spark):
    rng = random.Random(5)
    p, q = [line(rng, 20) for _ in range(3)], [line(rng, 15) for _ in range(4)]
    docs = [(1, "\n".join([*p, line(rng, 5), *q])), (2, "\n".join([*q, line(rng, 6), *p])), (3, "\n".join([line(rng, 6), *p, line(rng, 6), *p, line(rng, 6)]))]
    got = {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    assert got == by_all_pairs(docs) and [len(got[i].split("\n")) for i in (1, 2, 3)] == [8, 1, 3]


def test_equals_the_comparison_of_all_pairs(spark):
    rng = random.Random(6)
    pool = ["", *(line(rng, rng.choice([1, 4, 9, 15, 31])) for _ in range(12))]
    docs = [(i, "\n".join(rng.choice(pool) for _ in range(rng.choice([1, 4, 12])))) for i in range(60)]
    got = {r.doc_id: r.text for r in line_dedup.report(spark.createDataFrame(docs, "doc_id long, text string").repartition(3)).collect()}
    assert got == by_all_pairs(docs)


@given(st.lists(st.integers(0, 5), max_size=14), st.lists(st.integers(0, 7), max_size=14))
@settings(max_examples=300, deadline=None)
def test_common_blocks_of_a_pair_are_whole(a, b):
    words = [0, 3, 5, 9, 12, 30]
    held = {tuple(b[s:e]) for s in range(len(b)) for e in range(s + 1, len(b) + 1)}
    want = {k for s in range(len(a)) for e in range(s + 1, len(a) + 1) if sum(words[x] for x in a[s:e]) >= 20 and tuple(a[s:e]) in held for k in range(s, e)}
    assert {k for s, e in line_dedup.common_blocks(a, b, [words[x] for x in a], 20) for k in range(s, e)} == want
