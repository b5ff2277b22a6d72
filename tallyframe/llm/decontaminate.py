"""Benchmark decontamination with an FM-index for each training shard.

A shard is a run of documents of one task, of a few MB of text.  Its words become
symbols of the benchmark's vocabulary (any other word, and each end of a document,
separates) and get an FM-index.  The windows of the benchmark are searched
backward, all at once, through ranks of a wavelet tree; their occurrences are
located by sampled suffix positions, and overlapping ones are merged into removal
spans.  Documents are read once and never shuffled.  The windows come in blocks of
bounded size, each a broadcast of its own; a task holds one of them at a time.

Defined cases: a null or empty text has no words and is never contaminated; an item
without words has no window; a null item_id counts as the id ``null``; repeated
documents give a row each; repeated items count once for each id; other columns
are ignored; empty tables give no hits or no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textnum
from tallyframe.llm.fmindex import FMIndex
from tallyframe.llm.store import written

WINDOW = 13
#: Windows in a block: 13 words of 8 bytes and an id each.
BLOCK_WINDOWS = 200_000
#: Text whose shards are searched between two loads of a block.
SHARDS_BYTES = 4_000_000
FOUND = "doc_id bigint, n_words bigint, items array<string>, spans array<struct<start:bigint,end:bigint>>"


def windows_of(items: DataFrame, width: int = WINDOW) -> DataFrame:
    """(item, window): the word hashes of each window of each item, as bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                texts = textnum.Texts(part.column("text"))
                a, b, doc = texts.spans(textnum.ALNUM)
                words = texts.hashes(a, b)
                bounds = np.searchsorted(doc, np.arange(texts.n + 1))
                item, window = [], []
                for d in range(texts.n):
                    lo, hi = bounds[d], bounds[d + 1]
                    size = min(width, hi - lo)
                    for k in range(lo, hi - size + 1) if size else ():
                        item.append(d)
                        window.append(words[k : k + size].tobytes())
                yield pa.RecordBatch.from_arrays([part.column("item").take(pa.array(item, pa.int64())), pa.array(window, pa.binary())], ["item", "window"])

    rows = items.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(textnum.lean(run), "item string, window binary").distinct()


class Windows:
    """A block of windows, ready to be searched."""

    def __init__(self, rows: list[tuple[str, bytes]]):
        keys = sorted({bytes(w) for _, w in rows})
        number = {w: k for k, w in enumerate(keys)}
        self.lengths = np.array([len(w) // 8 for w in keys], np.int64)
        flat = np.frombuffer(b"".join(keys), np.uint64)
        self.vocabulary, symbols = np.unique(flat, return_inverse=True)
        self.patterns = np.zeros((len(keys), int(self.lengths.max(initial=1))), np.int64)
        inside = np.arange(self.patterns.shape[1]) < self.lengths[:, None]
        self.patterns[inside] = symbols + 1
        self.items: list[list[str]] = [[] for _ in keys]
        for item, w in rows:
            self.items[number[bytes(w)]].append(item)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """1 and up for the vocabulary, 0 for all other words."""
        if not len(self.vocabulary):
            return np.zeros(len(words), np.int64)
        k = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        return np.where(self.vocabulary[k] == words, k + 1, 0)


def _merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for k in np.argsort(starts, kind="stable"):
        s, e = int(starts[k]), int(ends[k])
        if out and s <= out[-1][1]:
            out[-1] = out[-1][0], max(e, out[-1][1])
        else:
            out.append((s, e))
    return out


def find_in(texts: textnum.Texts, block: Windows, every: int) -> tuple[np.ndarray, dict[int, tuple[set[str], list[tuple[int, int]]]]]:
    """Words of each text, and for those with hits the items and the merged spans of words."""
    a, b, doc = texts.spans(textnum.ALNUM)
    counts = np.bincount(doc, minlength=texts.n)
    symbols = block.symbols(texts.hashes(a, b))
    if not symbols.any():
        return counts, {}
    shard = np.zeros(len(symbols) + texts.n, np.int64)  # one separator behind each text
    shard[np.arange(len(symbols)) + doc] = symbols
    index = FMIndex(shard, len(block.vocabulary), every)
    low, high = index.search(block.patterns, block.lengths)
    many = high - low
    window = np.repeat(np.arange(len(many)), many)
    if not len(window):
        return counts, {}
    rows = np.repeat(low, many) + np.arange(len(window)) - np.repeat(np.cumsum(many) - many, many)
    at = index.locate(rows)
    first = np.cumsum(counts + 1) - counts - 1
    owner = np.searchsorted(first, at, side="right") - 1
    order = np.argsort(owner, kind="stable")
    owner, at, window = owner[order], at[order], window[order]
    cuts = np.flatnonzero(np.diff(owner)) + 1
    found = {}
    for o, p, w in zip(np.split(owner, cuts), np.split(at, cuts), np.split(window, cuts)):
        start = p - first[o[0]]
        found[int(o[0])] = {i for k in np.unique(w) for i in block.items[k]}, _merged(start, start + block.lengths[w])
    return counts, found


class Blocks:
    """The windows of a benchmark in blocks of bounded size, each a broadcast that tasks hold one at a time."""

    def __init__(self, bench: DataFrame, width: int, most: int):
        windows = written(windows_of(bench, width), "windows")
        self.count = max(1, -(-windows.count() // most))
        # dealt by window and item, so a window of very many items is spread over the blocks, too
        mine = lambda k: windows.where(F.pmod(F.xxhash64("window", "item"), F.lit(self.count)) == k).toLocalIterator()
        self.held = [bench.sparkSession.sparkContext.broadcast(Windows([(r.item, r.window) for r in mine(k)])) for k in range(self.count)]

    def find(self, parts: list[textnum.Texts], every: int) -> list[tuple[np.ndarray, dict[int, tuple[set[str], list[tuple[int, int]]]]]]:
        """``find_in`` of some shards over all blocks."""
        out: list = [None] * len(parts)
        for held in self.held:
            block = held.value
            for k, texts in enumerate(parts):
                counts, found = find_in(texts, block, every)
                if out[k] is None:
                    out[k] = counts, found
                    continue
                for d, (items, spans) in found.items():
                    if d in out[k][1]:
                        more, others = out[k][1][d]
                        items, spans = items | more, _joined(spans, others)
                    out[k][1][d] = items, spans
            if self.count > 1:  # one block in memory, whatever their number
                held.__dict__.pop("_value", None)
                block = None
        return out

    def shards(self, batches: Iterator[pa.RecordBatch], every: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict]]:
        """Each part of the documents with its word counts and hits; some parts share a load of each block."""
        waiting: list[pa.RecordBatch] = []
        size = 0
        for part in (p for batch in batches for p in textnum.slices(batch)):
            waiting.append(part)
            size += part.nbytes
            if size >= SHARDS_BYTES:
                yield from self._done(waiting, every)
                waiting, size = [], 0
        yield from self._done(waiting, every)

    def _done(self, parts: list[pa.RecordBatch], every: int) -> Iterator[tuple[pa.RecordBatch, np.ndarray, dict]]:
        for part, (counts, found) in zip(parts, self.find([textnum.Texts(p.column("text")) for p in parts], every)):
            yield part, counts, found


def _joined(a: list[tuple[int, int]], b: list[tuple[int, int]]) -> list[tuple[int, int]]:
    return _merged(*(np.array(x, np.int64) for x in zip(*a, *b)))


def occurrences(docs: DataFrame, bench: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS, every: int = 16) -> DataFrame:
    """One row per row of ``docs``: words, items that occur, removal spans in words (end exclusive)."""
    windows = Blocks(bench, width, block_windows)
    spans_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts, found in windows.shards(batches, every):
            items = [sorted(found[d][0]) if d in found else [] for d in range(len(counts))]
            spans = [[{"start": s, "end": e} for s, e in found[d][1]] if d in found else [] for d in range(len(counts))]
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(items, pa.list_(pa.string())), pa.array(spans, spans_type)], ["doc_id", "n_words", "items", "spans"])

    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(textnum.lean(run), FOUND)


HIT = "aggregate(spans, 0L, (n, x) -> n + x.end - x.start)"


def clean(docs: DataFrame, bench: DataFrame, width: int = WINDOW, block_windows: int = BLOCK_WINDOWS, every: int = 16) -> DataFrame:
    """``docs`` without those that ``judged`` calls contaminated; the others are left as they are."""
    windows = Blocks(bench, width, block_windows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, counts, found in windows.shards(batches, every):
            bad = {d for d, (_, spans) in found.items() if 20 * sum(e - s for s, e in spans) >= counts[d]}
            yield part.filter(pa.array([d not in bad for d in range(part.num_rows)], pa.bool_()))

    return docs.mapInArrow(textnum.lean(run), docs.schema)


def judged(docs: DataFrame, bench: DataFrame, **settings) -> DataFrame:
    """``occurrences`` with counts, the digest of the items and the verdict: at least one word in twenty is hit."""
    found = occurrences(docs, bench, **settings)
    hit = F.expr(HIT)
    return found.select(
        "doc_id", "n_words", hit.alias("n_hit"), F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        ((hit > 0) & (20 * hit >= F.col("n_words"))).alias("contaminated"), "spans",
    )
