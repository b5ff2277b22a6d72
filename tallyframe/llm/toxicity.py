"""Toxicity by a small recurrent network over words and their characters, in numpy.

A word's input is its vector, if the training documents use the word often enough, and the
largest response of each filter of a convolution over its characters (UTF-8 bytes, ends
marked), so words never seen are read by their letters.  A bidirectional gated recurrent
network reads windows of words, attention pools its states, and a document scores as its
highest window.  Windows overlap by half and cover all words of the whole text.

All of it is trained by backpropagation from random values: first on windows that are
drawn from all windows of the training documents, with the labels of their documents,
then on the highest window of each drawn document.  Nothing counts labels.

Training takes a bounded sample of labelled documents (``Settings``: their number by
label, bytes of one and of all), the first by a hash of doc_id, never those held out.
doc_id, lang and source are never inputs.

Defined cases: a null or empty text has one window without words, whose score is that
of the bias alone; a very long text is all its windows; without labels of both kinds all
scores are the smoothed share of label 1; of several labels of a document the largest
counts, of several texts of a doc_id the shortest; rows with a null label are no labels; a
null doc_id isn't held out; equal texts have equal scores; other columns are kept by
``scored`` and ``clean`` and ignored by ``classify``; an empty table gives no rows.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import textnum

#: Words in a window, and from one window to the next.
WINDOW, STRIDE = 64, 32
THRESHOLD = 0.7
HIDDEN = 8
#: Components of a word's vector, and filters over its characters, which see ``SPAN`` bytes at once.
WORD_DIMS, FILTERS, SPAN = 8, 16, 6
DIMS = WORD_DIMS + FILTERS
#: Codes of characters: 0 behind a word, 1 and 2 its ends, bytes from 3 on.
CODES = 259
#: Windows in one batch of the network.
BATCH = 1024


@dataclass(frozen=True)
class Settings:
    toxic: int = 3000  # most labelled documents of either label that are used
    clean: int = 6000
    most_bytes: int = 1_000_000  # a longer text doesn't train
    all_bytes: int = 48_000_000  # of all texts that train
    known: int = 5  # training documents that use a word, if it is to have a vector
    window_steps: int = 500
    windows: int = 96  # in such a step, of which two in five are from toxic documents
    doc_steps: int = 350
    docs: int = 32  # in such a step, of which one in four is toxic
    dropped: float = 0.0  # share of word vectors that a step leaves out
    rate: float = 0.012
    seed: int = 7


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


class Words:
    """The distinct words of some texts, their characters, and the texts as numbers of words."""

    def __init__(self, texts: textnum.Texts):
        a, b, self.doc = texts.spans(textnum.ALNUM)
        self.hash, first, self.number = np.unique(texts.hashes(a, b), return_index=True, return_inverse=True)
        self.counts = np.bincount(self.doc, minlength=texts.n)
        self.n = len(first)
        a, b = a[first], b[first]
        self.size = b - a + 2  # with a mark at either end, and zeros behind
        self.begin = np.cumsum(self.size + SPAN - 1) - (self.size + SPAN - 1)
        self.code = np.zeros(int((self.size + SPAN - 1).sum()), np.int16)
        for k in range(0, self.n, 20_000):  # some words at a time: what is made beside is of their size
            at, place = self._characters(np.arange(k, min(self.n, k + 20_000)))
            size = self.size[k : k + 20_000]
            inner = (place > 0) & (place < np.repeat(size, size) - 1)
            self.code[at[inner]] = textnum.LOWER[texts.data[(np.repeat(a[k : k + 20_000], size) + place - 1)[inner]]].astype(np.int16) + 3
        self.code[self.begin], self.code[self.begin + self.size - 1] = 1, 2

    def _characters(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the characters of some words are, and the place of each in its word."""
        size = self.size[some]
        place = np.arange(int(size.sum())) - np.repeat(np.cumsum(size) - size, size)
        return np.repeat(self.begin[some], size) + place, place

    @classmethod
    def gathered(cls, texts: pa.Array) -> Words:
        """The same, slice by slice: only distinct words are held as bytes."""
        place: dict[int, int] = {}
        seen: list[bytes] = []
        number, doc, counts, first = [np.zeros(0, np.int32)], [np.zeros(0, np.int32)], [np.zeros(0, np.int64)], 0
        for part in textnum.slices(pa.record_batch([texts], ["text"])):
            t = textnum.Texts(part.column("text"))
            a, b, d = t.spans(textnum.ALNUM)
            distinct, at, inverse = np.unique(t.hashes(a, b), return_index=True, return_inverse=True)
            local = np.empty(len(distinct), np.int32)
            for k, (h, x, y) in enumerate(zip(distinct.tolist(), a[at].tolist(), b[at].tolist())):
                local[k] = n = place.setdefault(h, len(place))
                if n == len(seen):
                    seen.append(t.data[x:y].tobytes())
            number.append(local[inverse])
            doc.append((d + first).astype(np.int32))
            counts.append(np.bincount(d, minlength=t.n))
            first += t.n
        # words as texts are numbered by their hashes
        order = np.argsort(np.fromiter(place, np.uint64, len(place)))
        out = cls(textnum.Texts(pa.array([seen[k] for k in order], pa.large_binary())))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order))
        out.number, out.doc, out.counts = rank[np.concatenate(number)], np.concatenate(doc), np.concatenate(counts)
        return out

    def known(self, least: int) -> np.ndarray:
        """Hashes of the words that at least so many texts use."""
        pair = np.unique(self.doc.astype(np.int64) * max(self.n, 1) + self.number)
        return self.hash[np.bincount(pair % max(self.n, 1), minlength=self.n) >= least] if self.n else self.hash

    def read(self, some: np.ndarray, filters: np.ndarray, places: bool) -> tuple[np.ndarray, np.ndarray | None]:
        """Of some words the largest response of each filter, and if asked for, the place of its first character."""
        many = self.size[some]
        off = np.cumsum(many) - many
        at = self._characters(some)[0]
        x = filters[0].take(self.code[at], 0)
        for j in range(1, SPAN):
            x += filters[j].take(self.code[at + j], 0)
        top = np.maximum.reduceat(x, off)
        if not places:
            return top, None
        hit = x == np.repeat(top, many, axis=0)
        best = np.empty((len(some), FILTERS), np.int64)
        owner = np.repeat(np.arange(len(some)), many)
        for c in range(FILTERS):
            k = np.flatnonzero(hit[:, c])[::-1]
            best[owner[k], c] = at[k]
        return top, best

    def windows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, number of words and text of each window; a text without words has one, empty."""
        n = self.counts
        many = np.maximum(1, -(-(n - STRIDE) // STRIDE))
        doc = np.repeat(np.arange(len(n)), many)
        k = np.arange(len(doc)) - np.repeat(np.cumsum(many) - many, many)
        start = (np.cumsum(n) - n)[doc] + STRIDE * k
        return start, np.minimum(WINDOW, n[doc] - STRIDE * k), doc


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fresh(rng: np.random.Generator) -> dict[str, np.ndarray]:
    """First values of the network; both directions are stacked."""
    f = lambda *shape: (rng.standard_normal(shape) / np.sqrt(shape[-2] if len(shape) > 1 else 4)).astype(np.float32)
    return {"W": f(2, DIMS, 3 * HIDDEN), "b": np.zeros((2, 1, 3 * HIDDEN), np.float32), "U": f(2, HIDDEN, 3 * HIDDEN), "A": f(2 * HIDDEN, HIDDEN), "a": np.zeros(HIDDEN, np.float32), "v": f(HIDDEN), "o": f(2 * HIDDEN), "bias": np.zeros(1, np.float32)}


def forward(p: dict[str, np.ndarray], projected: np.ndarray, index: np.ndarray, sizes: np.ndarray, keep: bool = False):
    """Logits of windows.  projected: a row per word and direction; index: (windows, steps) of words, -1 for none."""
    steps, m = index.shape[1], len(index)
    h = np.zeros((2, m, HIDDEN), np.float32)
    states = np.zeros((steps, m, 2 * HIDDEN), np.float32)
    saved = []
    for t in range(steps):
        back = steps - 1 - t
        x = np.stack([projected[0][index[:, t]], projected[1][index[:, back]]])
        s = h @ p["U"]
        z = _sigmoid(x[..., : 2 * HIDDEN] + s[..., : 2 * HIDDEN])
        r, z = z[..., HIDDEN:], z[..., :HIDDEN]
        c = np.tanh(x[..., 2 * HIDDEN :] + r * s[..., 2 * HIDDEN :])
        new = c + z * (h - c)
        live = np.stack([t < sizes, back < sizes])[..., None]
        if keep:
            saved.append((h, z, r, c, s[..., 2 * HIDDEN :], live))
        h = np.where(live, new, h)
        states[t, :, :HIDDEN], states[back, :, HIDDEN:] = h[0], h[1]
    inner = np.tanh(states @ p["A"] + p["a"])
    weight = inner @ p["v"]
    weight = np.where(np.arange(steps)[:, None] < sizes, weight, -1e9)
    weight = np.exp(weight - weight.max(0)) * (np.arange(steps)[:, None] < sizes)
    weight /= np.maximum(weight.sum(0), 1e-9)
    pooled = np.einsum("tm,tmh->mh", weight, states)
    logits = pooled @ p["o"] + p["bias"][0]
    return (logits, (saved, states, inner, weight, pooled)) if keep else logits


def backward(p: dict[str, np.ndarray], index: np.ndarray, cache, grad: np.ndarray) -> tuple[dict[str, np.ndarray], np.ndarray]:
    """Gradients of the parameters (but for W and b) and of the projected inputs of both directions, by step."""
    saved, states, inner, weight, pooled = cache
    steps = len(states)
    g = {"o": pooled.T @ grad, "bias": np.array([grad.sum()], np.float32), "U": np.zeros_like(p["U"])}
    d_pooled = grad[:, None] * p["o"]
    d_states = weight[..., None] * d_pooled
    d_weight = np.einsum("tmh,mh->tm", states, d_pooled)
    d_weight = weight * (d_weight - (weight * d_weight).sum(0))
    g["v"] = np.einsum("tm,tmh->h", d_weight, inner)
    d_inner = d_weight[..., None] * p["v"] * (1 - inner**2)
    g["A"] = np.einsum("tmi,tmj->ij", states, d_inner)
    g["a"] = d_inner.sum((0, 1))
    d_states += d_inner @ p["A"].T
    dh = np.zeros_like(saved[0][0])
    dx = np.zeros((steps, 2, len(grad), 3 * HIDDEN), np.float32)
    for t in range(steps - 1, -1, -1):
        h, z, r, c, sc, live = saved[t]
        dh = dh + np.stack([d_states[t, :, :HIDDEN], d_states[steps - 1 - t, :, HIDDEN:]])
        new = np.where(live, dh, 0)
        dz = new * (h - c) * z * (1 - z)
        dc = new * (1 - z) * (1 - c**2)
        dr = dc * sc * r * (1 - r)
        ds = np.concatenate([dz, dr, dc * r], axis=-1)
        dx[t] = np.concatenate([dz, dr, dc], axis=-1)
        g["U"] += np.swapaxes(h, 1, 2) @ ds
        dh = np.where(live, new * z, dh) + ds @ np.swapaxes(p["U"], 1, 2)
    return g, dx


def _grid(start: np.ndarray, size: np.ndarray, number: np.ndarray) -> np.ndarray:
    steps = np.arange(max(1, int(size.max(initial=1))))
    at = start[:, None] + steps
    return np.where(steps < size[:, None], number[np.minimum(at, max(len(number) - 1, 0))] if len(number) else 0, -1)


class Model:
    """Weights by name: those of the network, ``words`` (a row each of ``known``, and zeros last), ``filters`` and ``level``."""

    def __init__(self, net: dict[str, np.ndarray], known: np.ndarray):
        self.net, self.known = net, known

    def rows(self, w: Words) -> np.ndarray:
        """The row of each distinct word's vector."""
        if not len(self.known):
            return np.zeros(w.n, np.int64)
        k = np.minimum(np.searchsorted(self.known, w.hash), len(self.known) - 1)
        return np.where(self.known[k] == w.hash, k, len(self.known))

    def inputs(self, w: Words, some: np.ndarray, rows: np.ndarray, places: bool = False) -> tuple[np.ndarray, np.ndarray | None]:
        """A row for each of some words, and if asked for, where the filters found theirs."""
        if not len(some):
            return np.zeros((0, DIMS), np.float32), np.zeros((0, FILTERS), np.int64)
        top, best = w.read(some, self.net["filters"], places)
        return np.concatenate([self.net["words"][rows[some]], np.maximum(top + self.net["level"], 0)], axis=1), best

    def window_logits(self, w: Words, start: np.ndarray, size: np.ndarray) -> np.ndarray:
        rows = self.rows(w)
        x = np.zeros((w.n + 1, DIMS), np.float32)  # the last row is for index -1
        for k in range(0, w.n, 20_000):
            some = np.arange(k, min(w.n, k + 20_000))
            x[some] = self.inputs(w, some, rows)[0]
        projected = x @ self.net["W"] + self.net["b"]
        out = np.empty(len(start), np.float32)
        order = np.argsort(size, kind="stable")  # like sizes together
        for k in range(0, len(order), BATCH):
            at = order[k : k + BATCH]
            out[at] = forward(self.net, projected, _grid(start[at], size[at], w.number), size[at])
        return out

    def score(self, texts: textnum.Texts) -> tuple[np.ndarray, np.ndarray]:
        """Score and number of windows of each text."""
        if texts.n == 1 and len(texts.data) > textnum.SLICE_BYTES:
            return self._score_long(texts)
        w = Words(texts)
        start, size, doc = w.windows()
        many = np.bincount(doc, minlength=texts.n)
        if not texts.n:
            return np.zeros(0), many
        top = np.maximum.reduceat(self.window_logits(w, start, size), np.cumsum(many) - many)
        return _sigmoid(top.astype(np.float64)), many


    def _score_long(self, texts: textnum.Texts, windows: int = 4096) -> tuple[np.ndarray, np.ndarray]:
        """The same for one long text, some windows at a time: parts begin with a window and reach half a window into the next part, so together they have the windows of the whole."""
        a, b, _ = texts.spans(textnum.ALNUM)
        top, many = -np.inf, 0
        for lo in range(0, max(1, len(a) - STRIDE), STRIDE * windows):
            hi = min(len(a), lo + STRIDE * (windows + 1))
            w = Words(textnum.Texts(pa.array([texts.data[a[lo] : b[hi - 1]].tobytes() if hi else b""], pa.large_binary())))
            start, size, _ = w.windows()
            top, many = max(top, float(self.window_logits(w, start, size).max())), many + len(start)
        return _sigmoid(np.array([top])), np.array([many])


class Trainer:
    """A model, what it learns from, and the running averages of its gradients."""

    def __init__(self, w: Words, labels: np.ndarray, cfg: Settings):
        self.w, self.labels, self.cfg = w, labels, cfg
        self.rng = np.random.default_rng(cfg.seed)
        known = w.known(cfg.known)
        net = fresh(self.rng)
        net["words"] = np.concatenate([self.rng.standard_normal((len(known), WORD_DIMS)) * 0.05, np.zeros((1, WORD_DIMS))]).astype(np.float32)
        net["filters"] = (self.rng.standard_normal((SPAN, CODES, FILTERS)) * 0.3).astype(np.float32)
        net["filters"][:, 0] = 0
        net["level"] = np.zeros(FILTERS, np.float32)
        self.model = Model(net, known)
        self.rows = self.model.rows(w)
        self.start, self.size, self.doc = w.windows()
        self.bounds = np.searchsorted(self.doc, np.arange(len(labels) + 1))
        self.memory = {k: [np.zeros_like(x), np.zeros_like(x)] for k, x in net.items() if k != "words"}
        self.squares = np.full(len(net["words"]), 0.1, np.float32)
        self.steps = 0

    def _batch(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Distinct words of some windows, and the windows by these (a last one, without input, pads)."""
        index = _grid(self.start[at], self.size[at], self.w.number)
        some, local = np.unique(index, return_inverse=True)
        local = local.reshape(index.shape)
        return (some[1:], np.where(index < 0, len(some) - 1, local - 1), index) if some[0] < 0 else (some, local, index)

    def highest(self, docs: np.ndarray) -> np.ndarray:
        """The highest window of each document."""
        at = np.concatenate([np.arange(self.bounds[d], self.bounds[d + 1]) for d in docs])
        owner = np.repeat(np.arange(len(docs)), self.bounds[docs + 1] - self.bounds[docs])
        logits = np.empty(len(at), np.float32)
        for k in range(0, len(at), BATCH):
            some, local, _ = self._batch(at[k : k + BATCH])
            x = np.concatenate([self.model.inputs(self.w, some, self.rows)[0], np.zeros((1, DIMS), np.float32)])
            logits[k : k + BATCH] = forward(self.model.net, x @ self.model.net["W"] + self.model.net["b"], local, self.size[at[k : k + BATCH]])
        order = np.lexsort((-logits, owner))
        return at[order[np.searchsorted(owner[order], np.arange(len(docs)))]]

    def learn(self, at: np.ndarray, rate: float) -> None:
        """One step on some windows, with the labels of their documents."""
        net = self.model.net
        some, local, _ = self._batch(at)
        x, best = self.model.inputs(self.w, some, self.rows, True)
        kept = self.rng.random(len(some)) >= self.cfg.dropped
        x[:, :WORD_DIMS] *= kept[:, None]
        x = np.concatenate([x, np.zeros((1, DIMS), np.float32)])
        logits, cache = forward(net, x @ net["W"] + net["b"], local, self.size[at], keep=True)
        g, dx = backward(net, local, cache, ((_sigmoid(logits) - self.labels[self.doc[at]]) / len(at)).astype(np.float32))
        # sums by word; by step, the second direction reads backward
        flat = np.zeros((2, len(x), 3 * HIDDEN), np.float32)
        for side, places in enumerate((local.T, local.T[::-1])):
            order = np.argsort(places, axis=None, kind="stable")
            begins = np.searchsorted(places.reshape(-1)[order], np.arange(len(x)))
            used = np.flatnonzero(np.diff(np.append(begins, len(order))))
            flat[side, used] = np.add.reduceat(dx[:, side].reshape(-1, 3 * HIDDEN)[order], begins[used])
        flat[:, len(some) :] = 0
        g["W"], g["b"] = x.T[None] @ flat, flat.sum(1, keepdims=True)
        back = (flat @ np.swapaxes(net["W"], 1, 2)).sum(0)[: len(some)]
        felt = back[:, WORD_DIMS:] * (x[: len(some), WORD_DIMS:] > 0)
        g["level"] = felt.sum(0)
        g["filters"] = np.zeros_like(net["filters"])
        for j in range(SPAN):
            code = self.w.code[best + j].astype(np.int64)
            g["filters"][j] = np.bincount((code * FILTERS + np.arange(FILTERS)).reshape(-1), felt.reshape(-1), CODES * FILTERS).reshape(CODES, FILTERS)
        g["filters"][:, 0] = 0
        self.steps += 1
        for name, (m, v) in self.memory.items():
            grad = g[name].reshape(net[name].shape)
            m += 0.1 * (grad - m)
            v += 0.01 * (grad**2 - v)
            net[name] -= rate * (m / (1 - 0.9**self.steps)) / (np.sqrt(v / (1 - 0.99**self.steps)) + 1e-6)
        # each known word stands once among the distinct ones
        mine = np.flatnonzero(kept & (self.rows[some] < len(self.model.known)))
        row, grad = self.rows[some[mine]], back[mine, :WORD_DIMS]
        self.squares[row] += (grad**2).sum(1)
        net["words"][row] -= rate * grad / np.sqrt(self.squares[row])[:, None]

    def run(self) -> Model:
        cfg, rng = self.cfg, self.rng
        docs = [np.flatnonzero(self.labels == k) for k in (0, 1)]
        windows = [np.flatnonzero(self.labels[self.doc] == k) for k in (0, 1)]
        toxic = max(1, 2 * cfg.windows // 5)
        for _ in range(cfg.window_steps):
            self.learn(np.concatenate([rng.choice(windows[1], toxic), rng.choice(windows[0], cfg.windows - toxic)]), cfg.rate)
        toxic = max(1, cfg.docs // 4)
        for k in range(cfg.doc_steps):
            drawn = np.concatenate([rng.choice(docs[1], toxic), rng.choice(docs[0], cfg.docs - toxic)])
            self.learn(self.highest(drawn), cfg.rate * (1 if 2 * k < cfg.doc_steps else 0.3))
        return self.model


def train(w: Words, labels: np.ndarray, cfg: Settings = Settings()) -> Model:
    """A model of labelled texts (labels 0 and 1), given by their words."""
    trainer = Trainer(w, labels, cfg)
    positive = int(labels.sum())
    trainer.model.net["bias"][0] = np.log((positive + 0.5) / (len(labels) - positive + 0.5))
    if min(positive, len(labels) - positive) < 4 or not w.n:  # nothing to tell apart
        trainer.model.net["o"][:] = 0
        return trainer.model
    return trainer.run()


def sample(docs: DataFrame, labels: DataFrame, cfg: Settings) -> DataFrame:
    """(doc_id, text, toxic): the labelled texts that train, of each label those with the least hashes of doc_id.

    Only ids and lengths are shuffled until the sample is chosen; then its texts are.
    """
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id")).agg(F.max(F.col("toxic").cast("int")).alias("toxic")).where(~held_out(F.col("doc_id")))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    lengths = texts.select("doc_id", F.octet_length("text").alias("bytes")).groupBy("doc_id").agg(F.min("bytes").alias("bytes"))
    there = known.join(lengths, "doc_id").where(F.col("bytes") <= cfg.most_bytes).withColumn("mark", F.xxhash64(F.col("doc_id"), F.lit(cfg.seed)))
    first = lambda label, most: there.where(F.col("toxic") == label).orderBy("mark", "doc_id").limit(most)
    chosen = first(1, cfg.toxic).unionByName(first(0, cfg.clean))
    # of bounded size: cfg.toxic + cfg.clean rows of numbers
    chosen = chosen.withColumn("so_far", F.sum("bytes").over(Window.orderBy("mark", "doc_id"))).where(F.col("so_far") <= cfg.all_bytes).select("doc_id", "toxic", "bytes")
    found = texts.join(F.broadcast(chosen), "doc_id").where(F.octet_length("text") == F.col("bytes"))
    return found.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic"))


def fitted(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> Model:
    """A model of the labelled documents; one task trains it on the bounded sample, and a lost one starts again with the same rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        rows = pa.Table.from_batches(held).sort_by([("doc_id", "ascending")])
        model = train(Words.gathered(rows.column("text").cast(pa.large_string()).combine_chunks()), rows.column("toxic").to_numpy().astype(np.int64), cfg)
        yield pa.record_batch([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = sample(docs, labels, cfg).select("doc_id", "text", "toxic").repartition(1).mapInArrow(textnum.lean(run), "model binary").collect()
    return pickle.loads(found[0].model) if found else train(Words.gathered(pa.array([], pa.large_string())), np.zeros(0, np.int64), cfg)


def scored(docs: DataFrame, model: Model, score: str = "score", windows: str = "n_windows") -> DataFrame:
    """``docs`` with its score and number of windows in two columns of these names."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                found, many = held.value.score(textnum.Texts(part.column("text")))
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(found, pa.float64()), pa.array(many, pa.int64())], [*part.schema.names, score, windows])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"`{score}` double", f"`{windows}` bigint"])
    return docs.mapInArrow(textnum.lean(run), fields)


def clean(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """``docs``, with all its columns, without those that score ``threshold`` or more."""
    held = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                yield part.filter(pa.array(held.value.score(textnum.Texts(part.column("text")))[0] < threshold))

    return docs.mapInArrow(textnum.lean(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, score, predicted, n_windows of every row of ``docs``."""
    model = fitted(docs, labels, cfg)
    rows = scored(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"), "n_windows")
