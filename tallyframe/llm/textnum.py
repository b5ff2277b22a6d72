"""Words, lines and shingles of Arrow text columns, as numpy arrays.

Texts are never turned into Python strings here: the UTF-8 bytes of a record
batch are classified through 256-entry tables, words become 64-bit hashes eight
bytes a step for all words at once, and shingles are combinations of neighbouring
word hashes.  The classes used by the operators are ASCII rules in which every byte
above 0x7F is a word byte, so working on bytes equals working on code points.
"""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
import xxhash

#: Bytes of text handled at once; bounds the memory of every function below.
SLICE_BYTES = 1_000_000

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def byte_class(*spans: tuple[int, int]) -> np.ndarray:
    """A 256-entry table that is true within the given inclusive spans."""
    table = np.zeros(256, bool)
    for a, b in spans:
        table[a : b + 1] = True
    return table


#: Words between ASCII white space (space and 0x09-0x0D).
SPACED = ~byte_class((0x20, 0x20), (0x09, 0x0D))
#: Words of digits, lower-case letters and everything above ASCII (text is lower-cased first).
ALNUM = byte_class((0x30, 0x39), (0x61, 0x7A), (0x80, 0xFF))
#: Lines: all but the line feed.
IN_LINE = ~byte_class((0x0A, 0x0A))

M1, M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
#: Values of a sequence that are hashed in step with those of all others.
_STEPWISE = 16
_STEPS = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit values one to one."""
    x = (x ^ (x >> np.uint64(30))) * M1
    x = (x ^ (x >> np.uint64(27))) * M2
    return x ^ (x >> np.uint64(31))


def _folded(many: np.ndarray, value: Callable[[np.ndarray, int], np.ndarray], whole: Callable[[int], int], seed: int) -> np.ndarray:
    """A 64-bit hash of each sequence of 64-bit values, of which ``many`` has the lengths.

    value(k, j): the j-th value of the sequences k.  Sequences of over ``_STEPWISE``
    values are hashed one by one by ``whole``.
    """
    h = mix(many.astype(np.uint64) * _STEPS[0] + np.uint64(seed))
    live = np.flatnonzero(many <= _STEPWISE)
    for j in range(_STEPWISE):
        live = live[many[live] > j]
        if not len(live):
            break
        h[live] = mix((h[live] ^ value(live, j)) * _STEPS[1] + _STEPS[2])
    for k in np.flatnonzero(many > _STEPWISE).tolist():
        h[k] ^= np.uint64(whole(k))
    return h


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, after which the worker gives free memory back: workers outlive their tasks, and the next operator finds them large."""

    def wrapped(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        if (trim := getattr(ctypes.CDLL(None), "malloc_trim", None)) is not None:
            trim(0)

    return wrapped


class Texts:
    """The bytes of some texts and where each begins and ends (null: empty)."""

    def __init__(self, column: pa.Array | pa.ChunkedArray):
        if isinstance(column, pa.ChunkedArray):
            column = column.combine_chunks()
        wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
        n = len(column)
        buffers = column.buffers()
        offsets = np.frombuffer(buffers[1], np.int64 if wide else np.int32, n + 1 + column.offset)[column.offset :].astype(np.int64) if n else np.zeros(1, np.int64)
        lo, hi = int(offsets[0]), int(offsets[-1])
        self.data = np.frombuffer(buffers[2], np.uint8, hi)[lo:] if hi > lo else np.zeros(0, np.uint8)
        self.starts, self.ends = offsets[:-1] - lo, offsets[1:] - lo
        if column.null_count:
            gone = ~np.asarray(column.is_valid().to_numpy(zero_copy_only=False), bool)
            self.ends = np.where(gone, self.starts, self.ends)
        self.n = n

    def spans(self, inside: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Starts and ends (bytes) of the maximal runs of a byte class, and the text each is in."""
        data = LOWER[self.data] if lower else self.data
        mask = inside[data]
        full = self.ends > self.starts
        live = np.zeros(len(data) + 1, bool)
        begin, end = mask.copy(), mask.copy()
        begin[1:] &= ~mask[:-1]
        end[:-1] &= ~mask[1:]
        s, e = self.starts[full], self.ends[full]
        begin[s] = mask[s]
        end[e - 1] = mask[e - 1]
        if np.any(self.starts[1:] != self.ends[:-1]):  # bytes below a null belong to no text
            live[s] = True
            held = np.zeros(len(data) + 1, np.int32)
            np.add.at(held, s, 1)
            np.add.at(held, e, -1)
            ok = np.cumsum(held)[:-1] > 0
            begin &= ok
            end &= ok
        a, b = np.flatnonzero(begin), np.flatnonzero(end) + 1
        return a, b, np.searchsorted(self.ends, a, side="right")

    def hashes(self, a: np.ndarray, b: np.ndarray, lower: bool = True, seed: int = 0) -> np.ndarray:
        """A 64-bit hash of each byte span; equal spans of different places have equal hashes, other seeds give independent ones."""
        data = np.zeros(len(self.data) + 8, np.uint8)
        data[: len(self.data)] = LOWER[self.data] if lower else self.data
        eight = np.ndarray((len(self.data) + 1,), "<u8", data, strides=(1,))  # the eight bytes from each place on
        size = b - a

        def value(k: np.ndarray, j: int) -> np.ndarray:
            spare = np.maximum(8 * (j + 1) - size[k], 0).astype(np.uint64) << np.uint64(3)
            return eight[a[k] + 8 * j] << spare  # bytes behind the span go

        return mix(_folded(-(-size // 8), value, lambda k: xxhash.xxh3_64_intdigest(data[a[k] : b[k]].tobytes(), seed), seed) ^ size.astype(np.uint64))


def runs(hashes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run of hashes; equal runs of different places have equal hashes."""
    return _folded(b - a, lambda k, j: hashes[a[k] + j], lambda k: xxhash.xxh3_64_intdigest(hashes[a[k] : b[k]].tobytes()), 1)


def slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a record batch of at most ``most`` bytes of text; a longer text comes alone and whole."""
    col = batch.column(column)
    if not len(col):
        return
    lengths = np.asarray(pa.compute.fill_null(pa.compute.binary_length(col), 0).to_numpy(zero_copy_only=False), np.int64)
    first, total = 0, 0
    for i, n in enumerate(lengths):
        if i > first and total + n > most:
            yield batch.slice(first, i - first)
            first, total = i, 0
        total += int(n)
    yield batch.slice(first)


def shingle_sets(texts: Texts, k: int, inside: np.ndarray = SPACED) -> tuple[list[np.ndarray], np.ndarray]:
    """Per text the sorted distinct hashes of its k-word shingles, and its number of words.

    With fewer than k words, but not none, the whole word sequence is the one shingle.
    """
    a, b, doc = texts.spans(inside)
    words = texts.hashes(a, b)
    counts = np.bincount(doc, minlength=texts.n)
    bounds = np.zeros(texts.n + 1, np.int64)
    np.cumsum(counts, out=bounds[1:])
    if len(words) >= k:
        rolled = np.zeros(len(words) - k + 1, np.uint64)
        for j in range(k):
            rolled = mix(rolled + words[j : len(words) - k + 1 + j] * _STEPS[j % 4] + np.uint64(j))
    else:
        rolled = np.zeros(0, np.uint64)
    out = []
    for d in range(texts.n):
        lo, hi = bounds[d], bounds[d + 1]
        if hi - lo >= k:
            out.append(np.unique(rolled[lo : hi - k + 1]))
        elif hi > lo:
            h = np.uint64(hi - lo)
            with np.errstate(over="ignore"):
                for w in words[lo:hi]:
                    h = mix(h * _STEPS[1] + w)
            out.append(np.array([h ^ _STEPS[2]], np.uint64))
        else:
            out.append(np.zeros(0, np.uint64))
    return out, counts
