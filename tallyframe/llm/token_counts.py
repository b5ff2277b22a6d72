"""Word-piece counts by a linear longest-match automaton.

The pieces of a vocabulary form a trie.  Each node knows how many pieces are popped when
the next symbol doesn't continue it, and the node that stands for what is left over, so
greedy longest-match counts come from one walk over the symbols of a word, without going
back and without making a piece.  The distinct words of a few texts walk in step, as
numpy arrays, through a hash table of transitions.

A word is a run between ASCII white space, with A-Z lower-cased, and ends with a mark; a
piece that ends words contains the mark.  A mark that is left over alone costs nothing.

Defined cases: a null or empty text has no tokens; a word that the pieces can't cover is
one unknown token; repeated rows count once a row; other columns are ignored; an empty
table gives no rows.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyframe.llm import textnum

#: Where the vocabulary lies, if no other path is given.
VOCABULARY = "/opt/tokenizers/word_bpe_49k.json"
END = 256
#: Bounds of what is broadcast: pieces, and bytes of the file they come from.
MOST_PIECES, MOST_BYTES = 2_000_000, 64_000_000
_SYMBOLS = 257
#: Fewer words than this are walked one by one: a step of all costs as much as some dozens of single ones.
_IN_STEP = 64
_MULTIPLY = np.uint64(0x9E3779B97F4A7C15)


def byte_letters() -> dict[str, int]:
    """The letter that byte-level vocabularies write for each byte, by their rule: printable ones stand for themselves."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(other)}


def load_pieces(path: str = VOCABULARY) -> list[tuple[int, ...]]:
    """Pieces as symbols (bytes, and END) of a tokenizer file with word-end marks."""
    if os.path.getsize(path) > MOST_BYTES:
        raise ValueError("the vocabulary file is too large to be broadcast")
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, letters, out = model.get("end_of_word_suffix") or "</w>", byte_letters(), []
    if len(model["vocab"]) > MOST_PIECES:
        raise ValueError("the vocabulary is too large to be broadcast")
    for token in model["vocab"]:
        body = token.removesuffix(suffix)
        if body and all(c in letters for c in body):
            out.append(tuple(letters[c] for c in body) + ((END,) if body != token else ()))
    return out


class Automaton:
    """Transitions in an open hash table; for each node what a failure pops and where it leads."""

    def __init__(self, pieces: Iterable[tuple[int, ...]]):
        children: list[dict[int, int]] = [{}]
        weight: list[int] = [-1]  # tokens that a piece counts, -1 for no piece

        def insert(piece: tuple[int, ...], w: int) -> None:
            node = 0
            for s in piece:
                if s not in children[node]:
                    children[node][s] = len(children)
                    children.append({})
                    weight.append(-1)
                node = children[node][s]
            weight[node] = max(weight[node], w)

        for piece in pieces:
            if piece:
                insert(piece, 1)
        insert((END,), 0)
        fail, popped = [-1] * len(children), [0] * len(children)
        queue = [0]
        for parent in queue:
            for s, node in children[parent].items():
                queue.append(node)
                if weight[node] >= 0:
                    fail[node], popped[node] = 0, weight[node]
                    continue
                z, n = fail[parent], popped[parent]
                while z >= 0 and s not in children[z]:
                    n += popped[z]
                    z = fail[z]
                if z >= 0:
                    fail[node], popped[node] = children[z][s], n
        self.fail, self.popped = np.array(fail, np.int32), np.array(popped, np.int32)
        edges = [(node * _SYMBOLS + s, child) for node, c in enumerate(children) for s, child in c.items()]
        self.bits = max(4, (4 * len(edges)).bit_length())
        key, target = (np.array(x, np.int64) for x in zip(*edges))
        self.keys, self.targets = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        slot = self._slot(key)
        while len(key):  # one of the keys that want a free slot gets it, the rest moves on
            first = np.unique(slot, return_index=True)[1]
            first = first[self.keys[slot[first]] < 0]
            self.keys[slot[first]], self.targets[slot[first]] = key[first], target[first]
            left = np.ones(len(key), bool)
            left[first] = False
            key, target, slot = key[left], target[left], (slot[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * _MULTIPLY) >> np.uint64(64 - self.bits)).astype(np.int64)

    def step(self, node: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        """The next nodes, -1 where there is none."""
        key = node.astype(np.int64) * _SYMBOLS + symbol
        slot = self._slot(key)
        out = np.full(len(key), -1, np.int32)
        left = np.arange(len(key))
        while len(left):
            found = self.keys[slot]
            hit = found == key
            out[left[hit]] = self.targets[slot[hit]]
            on = ~hit & (found >= 0)
            left, key, slot = left[on], key[on], (slot[on] + 1) & ((1 << self.bits) - 1)
        return out

    def _walk(self, node: int, total: int, symbols: list[int]) -> tuple[int, int, bool]:
        """Tokens, node and whether no piece fits, after the symbols."""
        if not hasattr(self, "_children"):
            used = self.keys >= 0
            self._children = dict(zip(self.keys[used].tolist(), self.targets[used].tolist()))
            self._back = list(zip(self.fail.tolist(), self.popped.tolist()))
        children, back = self._children, self._back
        for s in symbols:
            while (after := children.get(node * _SYMBOLS + s)) is None:
                up, popped = back[node]
                if up < 0:
                    return total, node, True
                total, node = total + popped, up
            node = after
        return total, node, False

    def counts(self, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Tokens of each byte span, which is one word; -1 for a word that pieces can't cover."""
        order = np.argsort(start - end, kind="stable")  # longer words first: those in play are a prefix
        a, size = start[order], (end - start)[order]
        total, node = np.zeros(len(a), np.int64), np.zeros(len(a), np.int32)
        dead = np.zeros(len(a), bool)
        in_play = np.searchsorted(-size, -np.arange(int(size.max(initial=0)) + 1), side="right")  # with the mark
        # in step as long as that pays; the few longest words go on one by one
        alone = int(np.searchsorted(-in_play, -_IN_STEP, side="right"))
        for k, m in enumerate(in_play[:alone].tolist()):
            at = a[:m] + k
            symbol = np.where(size[:m] > k, data[np.minimum(at, len(data) - 1)].astype(np.int64), END)
            lanes = np.flatnonzero(~dead[:m])
            while len(lanes):
                after = self.step(node[lanes], symbol[lanes])
                ok = after >= 0
                node[lanes[ok]] = after[ok]
                lanes = lanes[~ok]
                back = self.fail[node[lanes]]
                dead[lanes[back < 0]] = True
                lanes, back = lanes[back >= 0], back[back >= 0]
                total[lanes] += self.popped[node[lanes]]
                node[lanes] = back
        for lane in range(int(in_play[alone]) if alone < len(in_play) else 0):
            if not dead[lane]:
                rest = data[a[lane] + alone : a[lane] + size[lane]].tolist()
                total[lane], node[lane], dead[lane] = self._walk(int(node[lane]), int(total[lane]), [*rest, END])
        lanes = np.flatnonzero(~dead & (node != 0))
        while len(lanes):  # what is left over after the mark
            back = self.fail[node[lanes]]
            dead[lanes[back < 0]] = True
            lanes = lanes[back >= 0]
            total[lanes] += self.popped[node[lanes]]
            node[lanes] = self.fail[node[lanes]]
            lanes = lanes[node[lanes] != 0]
        out = np.empty(len(a), np.int64)
        out[order] = np.where(dead, -1, total)
        return out


def count(docs: DataFrame, path: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens and n_unknown of every row of ``docs`` (doc_id, text)."""
    held = docs.sparkSession.sparkContext.broadcast(Automaton(load_pieces(path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                t = textnum.Texts(part.column("text"))
                a, b, doc = t.spans(textnum.SPACED)
                _, first, inverse = np.unique(t.hashes(a, b), return_index=True, return_inverse=True)
                tokens = held.value.counts(textnum.LOWER[t.data], a[first], b[first])[inverse]
                sums = lambda x: pa.array(np.bincount(doc, x, t.n).astype(np.int64))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(np.bincount(doc, minlength=t.n)), sums(np.abs(tokens)), sums(tokens < 0)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(textnum.lean(run), "doc_id bigint, n_words bigint, n_tokens bigint, n_unknown bigint")
