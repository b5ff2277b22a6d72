import random
import zlib

import numpy as np
import pyarrow as pa

from tallyframe.llm import textnum, toxicity

SYLLABLES = ["an", "er", "th", "ion", "ou", "st", "re", "ha", "nd", "tion"]


def corpus(n, seed=1):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice(SYLLABLES) for _ in range(rng.choice([1, 2, 2, 3, 4])))
    docs, labels = [], []
    for i in range(n):
        w = [word() for _ in range(rng.choice([8, 40, 90, 300]))]
        toxic = int(rng.random() < 0.25)
        if toxic:
            for _ in range(2):
                w[rng.randrange(len(w))] = "Grumpf" + word() if rng.random() < 0.5 else "BLEUGH!"
        docs.append((i, " ".join(w)))
        labels.append((i, 1 - toxic, toxic))
    return docs, labels


def test_held_out_accuracy(spark):
    docs, labels = corpus(900)
    docs += [(5000, None), (5001, ""), (None, docs[0][1]), (5002, "an " * 50_000 + "bleugh " + "re " * 50), (3, docs[3][1]), (5003, "!!! ???")]
    frame = spark.createDataFrame([(i, t, "clash", 1.0) for i, t in docs], "doc_id long, text string, lang string, score double")
    marks = spark.createDataFrame([(i, q, t, "x") for i, q, t in labels] + [(7, None, None, "x"), (None, 1, 1, "x")], "doc_id long, quality int, toxic int, text string")
    rows = toxicity.classify(frame, marks, toxicity.Settings(window_steps=150, doc_steps=60)).collect()
    assert len(rows) == len(docs) and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in rows)
    assert all(r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    truth = {i: t for i, _, t in labels}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) >= 0.95 * len(held)
    by_id = {r.doc_id: r for r in rows}
    assert by_id[5002].predicted == 1 and by_id[5002].n_windows == -(-(50_051 - 32) // 32)
    assert by_id[5000].score == by_id[5001].score == by_id[5003].score < 0.7
    assert len({r.score for r in rows if r.doc_id == 3}) == 1


def test_all_windows_cover_all_words():
    for n in (0, 1, 32, 33, 64, 65, 96, 97, 1000):
        w = toxicity.Words(textnum.Texts(pa.array(["x", " ".join(["w"] * n)])))
        start, size, doc = w.windows()
        seen = {k for s, z, d in zip(start, size, doc) if d == 1 for k in range(s, s + z)}
        assert seen == set(range(1, n + 1)) and all(z <= toxicity.WINDOW for z in size)
        assert n <= 64 or (size[doc == 1] > toxicity.STRIDE).all()


def test_long_texts_are_scored_part_by_part(monkeypatch):
    rng = random.Random(8)
    docs, labels = corpus(60)
    model = toxicity.train(toxicity.Words(textnum.Texts(pa.array([t for _, t in docs]))), np.array([t for _, _, t in labels]), toxicity.Settings(window_steps=5, doc_steps=0, known=2))
    for n in (0, 1, 31, 32, 33, 63, 64, 65, 96, 128, 129, 160, 161, 1000, 4000):
        text = textnum.Texts(pa.array([" ".join(rng.choice(SYLLABLES) + rng.choice(SYLLABLES) for _ in range(n))]))
        score, many = model.score(text)
        for part in (1, 2, 3, 50):
            other, also = model._score_long(text, part)
            assert also.tolist() == many.tolist() and abs(other - score).max() < 1e-5


def test_gradients_agree_with_differences():
    rng = np.random.default_rng(0)
    p = {k: v.astype(np.float64) for k, v in toxicity.fresh(rng).items()}
    x = rng.standard_normal((6, toxicity.DIMS))
    x[-1] = 0
    index = np.array([[0, 1, 2, 3], [4, 0, -1, -1], [2, -1, -1, -1]])
    sizes = (index >= 0).sum(1)
    upstream = np.array([0.3, -0.7, 1.1])
    value = lambda: float(toxicity.forward(p, x @ p["W"] + p["b"], index, sizes).astype(np.float64) @ upstream)
    _, cache = toxicity.forward(p, x @ p["W"] + p["b"], index, sizes, keep=True)
    g, dx = toxicity.backward(p, index, cache, upstream)
    for name in ("U", "A", "a", "v", "o", "bias"):
        for at in [tuple(rng.integers(0, s) for s in p[name].shape) for _ in range(4)]:
            old, e = p[name][at], 1e-2
            p[name][at] = old + e
            up = value()
            p[name][at] = old - e
            down = value()
            p[name][at] = old
            assert abs((up - down) / (2 * e) - g[name].reshape(p[name].shape)[at]) < 2e-3


def test_gradients_of_tables_agree_with_differences(monkeypatch):
    """Filters, levels and word vectors, by what a small step of each does to the loss."""
    docs, labels = corpus(40)
    y = np.array([t for _, _, t in labels])
    trainer = toxicity.Trainer(toxicity.Words(textnum.Texts(pa.array([t for _, t in docs]))), y, toxicity.Settings(dropped=0, known=2))
    net = trainer.model.net
    for k in net:
        net[k] = net[k].astype(np.float64)
    at = np.arange(12)

    def loss():
        z = trainer.model.window_logits(trainer.w, trainer.start[at], trainer.size[at]).astype(np.float64)
        return float(np.mean(np.log1p(np.exp(-z * (2 * y[trainer.doc[at]] - 1)))))

    before, old = loss(), {k: v.copy() for k, v in net.items()}
    trainer.learn(at, 1e-4)
    new = {k: v.copy() for k, v in net.items()}
    for name in ("filters", "level", "words"):  # each part alone goes downhill
        net.update({k: v.copy() for k, v in old.items()})
        net[name] = new[name]
        assert loss() < before
        net[name] = 2 * old[name] - new[name]
        assert loss() > before


def test_the_sample_is_bounded(spark):
    docs = spark.createDataFrame([(k // 3000, "w " * (k % 50 + 1)) for k in range(6000)] + [(k, "x" * 5000) for k in range(10, 40)] + [(50, "y" * 900_000)], "doc_id long, text string")
    labels = spark.createDataFrame([(k, k % 2) for k in range(60)] + [(0, 1), (0, 0), (12, 0)], "doc_id long, toxic int")
    got = toxicity.sample(docs, labels, toxicity.Settings(toxic=8, clean=9, most_bytes=100_000, all_bytes=40_000)).collect()
    assert len({r.doc_id for r in got}) == len(got) and sum(len(r.text) for r in got) <= 40_000 and 7 <= len(got) <= 17
    every = {r.doc_id: r for r in toxicity.sample(docs, labels, toxicity.Settings()).collect()}
    assert {0, 1} & set(every) == {k for k in (0, 1) if zlib.crc32(str(k).encode()) % 3 != 1} and 45 not in every
    assert all(every[k].text == "w " and every[k].toxic == 1 for k in (0, 1) if k in every)


def test_columns_of_the_callers_own_stay(spark):
    docs, labels = corpus(30)
    frame = spark.createDataFrame([(i, t, 9.0, "n") for i, t in docs], "doc_id long, text string, score double, n_windows string")
    model = toxicity.fitted(frame, spark.createDataFrame([], "doc_id long, toxic int"))
    assert sorted(toxicity.clean(frame, model).collect()) == sorted(frame.collect())
    assert toxicity.clean(frame, model, 0.0).count() == 0


def test_without_labels_of_both_kinds(spark):
    docs, _ = corpus(20)
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    none = spark.createDataFrame([], "doc_id long, toxic int")
    got = toxicity.classify(frame, none).collect()
    assert len(got) == 20 and len({round(r.score, 6) for r in got}) == 1 and not any(r.predicted for r in got)
    assert toxicity.classify(spark.createDataFrame([], "doc_id long, text string"), none).count() == 0
