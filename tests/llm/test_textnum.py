import random

import numpy as np
import pyarrow as pa
import pytest

from tallyframe.llm import line_dedup, ngram_join, store, textnum


def thue_morse(bits, a="a", b="b"):
    return "".join(b if bin(k).count("1") % 2 else a for k in range(1 << bits))


def test_hashes_tell_words_apart_at_every_length_and_place():
    pick = random.Random(1)
    words = [thue_morse(k, *ab) for k in range(13) for ab in (("a", "b"), ("b", "a"))]
    words += ["".join(pick.choice("ab") for _ in range(n)) for n in range(1, 400)] + ["x" * n for n in range(1, 400)] + ["x" * n + "\0" for n in range(1, 40)]
    words = sorted(set(words))
    text = " ".join(words + words[::-1])
    t = textnum.Texts(pa.array([text]))
    a = np.array([k for k in range(len(text)) if k == 0 or text[k - 1] == " "])
    b = np.array([k for k in range(1, len(text) + 1) if k == len(text) or text[k] == " "])
    for seed in (0, 1):
        h = t.hashes(a, b, seed=seed)
        assert (h[: len(words)] == h[len(words) :][::-1]).all() and len(set(h.tolist())) == len(words)
    assert not np.intersect1d(t.hashes(a, b), t.hashes(a, b, seed=1)).size


def test_runs_tell_sequences_apart():
    h = np.random.default_rng(2).integers(0, 1 << 63, 3).astype(np.uint64)
    order = np.array([int(c) for c in thue_morse(11, "0", "1") + thue_morse(11, "1", "0")])
    for size in (1, 2, 15, 16, 17, 40, 2048):
        starts = np.arange(0, len(order) - size + 1)
        got = textnum.runs(h[order], starts, starts + size)
        assert len(set(got.tolist())) == len({order[s : s + size].tobytes() for s in starts})


def test_structured_words_are_unlike(spark):
    rows = [(1, thue_morse(11)), (2, thue_morse(11, "b", "a")), (3, thue_morse(10) + " x" * 40), (4, thue_morse(10, "b", "a") + " x" * 40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in ngram_join.join(docs).collect()} == {1: 1, 2: 2, 3: 3, 4: 4}
    assert {r.doc_id: r.text for r in line_dedup.report(docs).collect()} == dict(rows)


def test_damaged_tables_are_not_read(spark):
    import pathlib

    df = store.written(spark.range(1000).selectExpr("id", "md5(cast(id as string)) AS x").coalesce(1), "damaged")
    assert df.agg({"id": "sum"}).first()[0] == 499500
    file = next(pathlib.Path(df.inputFiles()[0].removeprefix("file://")).parent.glob("*.parquet"))
    data = bytearray(file.read_bytes())
    data[len(data) // 2] ^= 1
    file.write_bytes(data)
    with pytest.raises(Exception, match="(?i)crc|checksum|corrupt"):
        df.select("x").collect()
