"""Deletes passages that an earlier document has, by aligning pairs of documents.

1. Each text becomes the sequence of its line hashes.
2. Documents overlap if they share a block of ``least_words`` words.  The keys of a
   document are its least blocks: from each line on, and up to each line, the fewest
   lines with that many words.  For each key, every later holder is paired with the
   first one, however many there are.  Each line of a block that two documents share is
   in a least block inside it, so a first holder of all that must go is always a
   partner, and pairs grow with the number of repeated keys, not with the square of a
   key's holders.  Keys and lines are hashed independently, so a line goes only if two
   hashes of 64 bits agree.
3. Each pair is aligned by patience diff: lines unique on both sides are anchors, their
   longest increasing run is kept, and what lies between anchors is aligned again.
4. Runs of aligned lines with at least ``least_words`` words are deleted from the later
   document, and so are the least blocks of both that the alignment leaves: moved or
   repeated passages.  So every block of lines that any earlier document has goes.

An earlier document holds every deleted line, so of all holders of a line the first
never loses it.  Order is by doc_id, then by a digest of the row.

Defined cases: a null text stays null, an empty one stays empty; a null doc_id comes
last; rows with equal doc_id and text are one document and share their fate; lines
without words are deleted only inside a longer block; other columns are kept by
``apply`` as they are; an empty table gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import store, textnum
from tallyframe.llm.store import written

LEAST_WORDS = 30


def _keys(ids: pa.Array, texts: textnum.Texts) -> list[bytes]:
    """A digest of doc_id and text."""
    data = texts.data
    return [xxhash.xxh3_128_digest(repr(i).encode() + b"\n" + data[a:b].tobytes()) for i, a, b in zip(ids.to_pylist(), texts.starts.tolist(), texts.ends.tolist())]


def least_blocks(words: np.ndarray, bounds: np.ndarray, least_words: int) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of lines (end exclusive): from each line on, and up to each line, the fewest with ``least_words`` words.

    ``bounds`` are the first lines of the documents and the end of the last.
    """
    sums = np.concatenate([[0], np.cumsum(words)])
    line = np.arange(len(words))
    doc = np.searchsorted(bounds, line, side="right")
    ends = np.searchsorted(sums, sums[:-1] + least_words)
    starts = np.searchsorted(sums, sums[1:] - least_words, side="right") - 1
    on, up = ends <= bounds[doc], starts >= bounds[doc - 1]
    return np.concatenate([line[on], starts[up]]), np.concatenate([ends[on], line[up] + 1])


def sequences(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(doc_id, id, lines, words, keys): hashes and word counts of the lines of each document, and hashes of its least blocks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                texts = textnum.Texts(part.column("text"))
                starts, ends, at = _lines(texts)
                values = texts.hashes(starts, ends, lower=False).view(np.int64)
                others = texts.hashes(starts, ends, lower=False, seed=1)  # text goes only where both hashes agree
                begins = texts.spans(textnum.SPACED)[0]
                counts = np.searchsorted(begins, ends) - np.searchsorted(begins, starts)
                bounds = np.searchsorted(at, np.arange(texts.n + 1))
                hashes = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(values))
                words = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(counts, pa.int32()))
                first, end = least_blocks(counts, bounds, least_words)
                doc, key = np.unique(np.stack([at[first], textnum.runs(others, first, end).view(np.int64)]), axis=1)
                keys = pa.ListArray.from_arrays(pa.array(np.searchsorted(doc, np.arange(texts.n + 1)), pa.int32()), pa.array(key))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(_keys(part.column("doc_id"), texts), pa.binary()), hashes, words, keys], ["doc_id", "id", "lines", "words", "keys"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(textnum.lean(run), "doc_id bigint, id binary, lines array<bigint>, words array<int>, keys array<bigint>")


def _lines(texts: textnum.Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of each line, the empty ones too, and its text; an empty text has none."""
    feeds = np.flatnonzero(texts.data == 10)
    owner = np.searchsorted(texts.ends, feeds, side="right")
    inside = (owner < texts.n) & (feeds >= texts.starts[np.minimum(owner, texts.n - 1)]) if texts.n else np.zeros(0, bool)
    feeds, owner = feeds[inside], owner[inside]
    full = np.flatnonzero(texts.ends > texts.starts)
    starts = np.concatenate([texts.starts[full], feeds + 1])
    ends = np.concatenate([feeds, texts.ends[full]])
    at = np.sort(np.concatenate([full, owner]))
    return np.sort(starts), np.sort(ends), at


def align(a: Sequence[int], b: Sequence[int]) -> list[tuple[int, int]]:
    """Index pairs of equal lines, increasing on both sides (patience diff)."""
    out: list[tuple[int, int]] = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, k, j, m = todo.pop()
        while i < k and j < m and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < k and j < m and a[k - 1] == b[m - 1]:
            k, m = k - 1, m - 1
            out.append((k, m))
        if i == k or j == m:
            continue
        left, right = Counter(a[i:k]), Counter(b[j:m])
        at = {x: q for q, x in enumerate(b[j:m], j) if right[x] == 1 and left[x] == 1}
        pairs = [(p, at[x]) for p, x in enumerate(a[i:k], i) if x in at]
        if not pairs:  # no line is unique on both sides: the n-th occurrences are matched
            seen: Counter = Counter()
            where = {}
            for q in range(j, m):
                seen[b[q]] += 1
                where[b[q], seen[b[q]]] = q
            seen = Counter()
            for p in range(i, k):
                seen[a[p]] += 1
                if (q := where.get((a[p], seen[a[p]]))) is not None:
                    pairs.append((p, q))
            out += _increasing(pairs)
            continue
        i0, j0 = i, j
        for p, q in _increasing(pairs):
            todo.append((i0, p, j0, q))
            out.append((p, q))
            i0, j0 = p + 1, q + 1
        todo.append((i0, k, j0, m))
    return sorted(out)


def _increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """A longest run of pairs that increases on the right; the left sides are increasing already."""
    tops: list[int] = []
    last: list[int] = []
    back = [-1] * len(pairs)
    for n, (_, q) in enumerate(pairs):
        k = bisect_left(tops, q)
        back[n] = last[k - 1] if k else -1
        tops[k : k + 1] = [q]
        last[k : k + 1] = [n]
    out, n = [], last[-1] if last else -1
    while n >= 0:
        out.append(pairs[n])
        n = back[n]
    return out[::-1]


def common_blocks(a: Sequence[int], b: Sequence[int], words: Sequence[int], least_words: int) -> list[tuple[int, int]]:
    """Ranges of lines of ``a`` (end exclusive) that stand in ``b`` as one block, too, and have enough words.

    Together they hold every line of every such block: what the alignment leaves, since it
    is moved, repeated or on another side of an anchor, is looked up by its least blocks.
    """
    out = []
    pairs = align(a, b)
    first = 0
    for n in range(1, len(pairs) + 1):
        if n == len(pairs) or (pairs[n][0], pairs[n][1]) != (pairs[n - 1][0] + 1, pairs[n - 1][1] + 1):
            i, k = pairs[first][0], pairs[n - 1][0] + 1
            if sum(words[i:k]) >= least_words:
                out.append((i, k))
            first = n
    left = np.ones(len(a) + 1, np.int64)
    for i, k in out:
        left[i:k] = 0
    left = np.cumsum(left) - left
    starts, ends = least_blocks(np.array(words, np.int64), np.array([0, len(a)]), least_words)
    some = left[ends] > left[starts]
    starts, ends = starts[some], ends[some]
    if len(starts):
        known = dict(zip(a, words))  # a line that ``a`` lacks is in no block of both, whatever its words
        of_b = least_blocks(np.array([known.get(x, least_words) for x in b], np.int64), np.array([0, len(b)]), least_words)
        held = np.isin(_run_hashes(a, starts, ends), _run_hashes(b, *of_b))
        out += zip(starts[held].tolist(), ends[held].tolist())
    return out


def _run_hashes(lines: Sequence[int], starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return textnum.runs(np.array(lines, np.int64).view(np.uint64), starts, ends)


def pairs_of(seqs: DataFrame) -> DataFrame:
    """(later, earlier): ids of documents that share a least block, with the first holder of each."""
    place = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "id").alias("place")
    held = seqs.select(F.explode("keys").alias("key"), place)
    of_key = held.groupBy("key").agg(F.min("place").alias("first"), F.count("*").alias("holders")).where("holders > 1")
    return held.join(of_key, "key").where(F.col("place") != F.col("first")).select(F.col("place.id").alias("later"), F.col("first.id").alias("earlier")).distinct()


def deletions(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """(id, blocks) of the documents that lose lines: ranges of lines, end exclusive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, starts, ends = [], [], []
            for id_, a, words, b in zip(*(batch.column(c) for c in ("later", "a", "words", "b"))):
                for s, e in common_blocks(a.as_py(), b.as_py(), words.as_py(), least_words):
                    ids.append(id_.as_py())
                    starts.append(s)
                    ends.append(e)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.binary()), pa.array(starts, pa.int32()), pa.array(ends, pa.int32())], ["id", "s", "e"])

    seqs = written(sequences(docs, least_words).dropDuplicates(["id"]), "lines")
    pairs = written(pairs_of(seqs), "pairs")
    both = pairs.join(seqs.select(F.col("id").alias("later"), F.col("lines").alias("a"), "words"), "later").join(seqs.select(F.col("id").alias("earlier"), F.col("lines").alias("b")), "earlier")
    found = both.select("later", "a", "words", "b").mapInArrow(textnum.lean(run), "id binary, s int, e int")
    blocks = written(found.groupBy("id").agg(F.collect_set(F.struct("s", "e")).alias("blocks")), "blocks")
    store.drop(docs.sparkSession, seqs, pairs)
    return blocks


def apply(docs: DataFrame, least_words: int = LEAST_WORDS, lines_deleted: str = "lines_deleted", words_deleted: str = "words_deleted") -> DataFrame:
    """``docs`` with the deleted lines taken out of ``text``, and their numbers in two more columns of these names, which ``docs`` must not have."""
    gone = deletions(docs, least_words)
    names = docs.columns
    spare, blocks = store.spare(names, "_line_dedup_id"), store.spare(names, "_line_dedup_blocks")
    schema = docs.schema

    def with_id(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                ids = part.column("doc_id").cast(pa.int64())
                keys = pa.array(_keys(ids, textnum.Texts(part.column("text"))), pa.binary())
                yield pa.RecordBatch.from_arrays([*part.columns, keys], [*part.schema.names, spare])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                texts, lines, words = [], [], []
                for text, found in zip(part.column("text"), part.column(spare)):
                    text, n, w = text.as_py(), 0, 0
                    if found.is_valid:
                        dead = {k for x in found.as_py() for k in range(x["s"], x["e"])}
                        rows = text.split("\n")
                        w = sum(_words(rows[k]) for k in dead)
                        n, text = len(dead), "\n".join(r for k, r in enumerate(rows) if k not in dead)
                    texts.append(text)
                    lines.append(n)
                    words.append(w)
                columns = [pa.array(texts, part.schema.field("text").type) if c == "text" else part.column(c) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(lines, pa.int32()), pa.array(words, pa.int64())], [*names, lines_deleted, words_deleted])

    # the same plan at every size: what is deleted grows with the input, so it is never broadcast; texts are never sorted
    keyed = docs.mapInArrow(textnum.lean(with_id), _fields(schema, f"{spare} binary"))
    joined = keyed.join(gone.select(F.col("id").alias(spare), F.col("blocks").alias(blocks)).hint("shuffle_hash"), spare, "left").select(*names, F.col(blocks).alias(spare))
    return joined.mapInArrow(textnum.lean(cut), _fields(schema, f"`{lines_deleted}` int", f"`{words_deleted}` bigint"))


_SPACES = {c: " " for c in range(9, 14)}


def _words(line: str) -> int:
    """Words between ASCII white space."""
    return sum(1 for w in line.translate(_SPACES).split(" ") if w)


def _fields(schema, *more: str) -> str:
    return ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in schema), *more])


def report(docs: DataFrame, least_words: int = LEAST_WORDS) -> DataFrame:
    """``apply``, with a row per document: doc_id, lines and words deleted, and the text that stays."""
    return apply(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), least_words)
