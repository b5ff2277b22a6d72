import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tallyframe.llm import packing


@given(st.lists(st.integers(1, 64), max_size=80))
@settings(max_examples=200, deadline=None)
def test_bins_hold_their_pieces_and_shrink(sizes):
    lengths = (8, 16, 40, 64)
    bin_of, offset, length, filled = packing.pack_lengths(np.array(sizes, np.int64), lengths)
    for b in range(len(length)):
        at = sorted((int(offset[k]), sizes[k]) for k in np.flatnonzero(bin_of == b))
        assert [o for o, _ in at] == list(np.cumsum([0] + [n for _, n in at])[:-1])
        assert filled[b] == sum(n for _, n in at) and length[b] == min(c for c in lengths if c >= filled[b])
    assert len(bin_of) == len(sizes)


@given(st.lists(st.integers(1, 20), min_size=1, max_size=60))
@settings(max_examples=200, deadline=None)
def test_one_length_is_best_fit_decreasing(sizes):
    room, want = [], {}
    for k in sorted(range(len(sizes)), key=lambda k: (-sizes[k], k)):
        fits = [r for r in room if r >= sizes[k]]
        if fits:
            room[room.index(min(fits))] -= sizes[k]
        else:
            room.append(20 - sizes[k])
    assert len(packing.pack_lengths(np.array(sizes), (20,))[2]) == len(room)


@given(st.lists(st.integers(1, 64), min_size=1, max_size=60))
@settings(max_examples=150, deadline=None)
def test_several_lengths_never_cost_more_than_one(sizes):
    cost, lengths = packing.Cost(4.0, 64.0), (8, 16, 40, 64)
    total = lambda found: sum(cost.of(int(c)) for c in found[2])
    together = total(packing.pack_lengths(np.array(sizes), lengths, cost))
    for c in lengths:
        if max(sizes) <= c:
            assert together <= total(packing.pack_lengths(np.array(sizes), (c,), cost)) + 1e-9


@given(st.lists(st.integers(1, 20), min_size=1, max_size=7))
@settings(max_examples=100, deadline=None)
def test_costs_are_near_the_least_possible(sizes):
    """Against every way to part a few pieces into bins."""
    cost, lengths = packing.Cost(3.0, 40.0), (5, 9, 20)
    price = lambda n: min((cost.of(c) for c in lengths if c >= n), default=float("inf"))

    def least(rest, bins):
        if not rest:
            return sum(map(price, bins))
        ways = [least(rest[1:], [*bins[:k], b + rest[0], *bins[k + 1 :]]) for k, b in enumerate(bins) if b + rest[0] <= 20]
        return min([*ways, least(rest[1:], [*bins, rest[0]])])

    found = sum(cost.of(int(c)) for c in packing.pack_lengths(np.array(sizes), lengths, cost)[2])
    best = least(sizes, [])
    assert best - 1e-9 <= found <= 1.25 * best


def test_new_bins_take_the_length_that_waiting_pieces_fill():
    sizes = np.array([300] * 3 + [100] * 2 + [5])
    bin_of, _, length, filled = packing.pack_lengths(sizes, (256, 512, 1024))
    assert sorted(length.tolist()) == [256, 1024] or sum(packing.Cost().of(int(c)) for c in length) <= packing.Cost().of(1024) + packing.Cost().of(256)


def test_bins_dont_depend_on_files(spark):
    docs = spark.createDataFrame([(k, "w " * (k % 97)) for k in range(600)], "doc_id long, text string")
    fill = []
    for parts in (1, 40):
        rows = packing.pack(docs.repartition(parts), block_pieces=300).collect()
        bins = {r.bin_id: (r.bin_tokens, r.bin_length) for r in rows}
        fill.append(sum(a for a, _ in bins.values()) / sum(b for _, b in bins.values()))
    assert len({round(x, 2) for x in fill}) == 1 and fill[0] > 0.97


def test_every_row_is_packed_once(spark):
    texts = [None, "", "a", "a b\tc\n d", "w " * 20_000, "  ", "x" * 5000, "w " * 8191, "w " * 8192]
    rows = [(i, t, 7) for i, t in enumerate(texts)] + [(2, "a", 7), (None, "q r", 7)]
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string, bin_id int").repartition(2), block_pieces=4).collect()
    want = {}
    for i, t, _ in rows:
        want[i] = want.get(i, 0) + len((t or "").split()) + 1
    have = {}
    for r in got:
        have[r.doc_id] = have.get(r.doc_id, 0) + r.n_tokens
        assert r.bin_offset + r.n_tokens <= r.bin_tokens <= r.bin_length in packing.LENGTHS and r.first_token == 8192 * r.piece
    assert have == want
    assert sorted((r.piece, r.n_tokens) for r in got if r.doc_id == 4) == [(0, 8192), (1, 8192), (2, 3617)]
    bins = {}
    for r in got:
        bins.setdefault(r.bin_id, []).append((r.bin_offset, r.n_tokens))
    for pieces in bins.values():
        pieces.sort()
        assert all(a + n == b for (a, n), (b, _) in zip(pieces, pieces[1:]))
    assert packing.pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    with pytest.raises(ValueError):
        packing.pack(spark.createDataFrame([], "doc_id long, text string"), lengths=(0, 5))
