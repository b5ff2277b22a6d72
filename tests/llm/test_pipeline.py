"""The stages of the pipeline, each on what its predecessor kept, against brute force."""

import os

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from test_decontaminate import brute as contamination
from test_ngram_join import shingles

from tallyframe.llm import toxicity
from tallyframe.llm.store import table, written

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
def test_stages(spark):
    docs = table(spark, SF, "documents")
    columns, steps = docs.columns, []
    for name, stage in corpus_pipeline.STAGES:
        before = docs.collect()
        docs = written(stage(spark, docs, SF), "stage")
        steps.append((name, before, docs.collect()))
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert docs.columns == columns
    toxic, lines, near, contaminated, packed = steps

    scores = {r.doc_id: r.predicted for r in toxicity.classify(table(spark, SF, "documents"), table(spark, SF, "labels")).collect()}
    assert {r.doc_id for r in toxic[2]} == {r.doc_id for r in toxic[1] if not scores[r.doc_id]}

    texts = {r.doc_id: r.text for r in lines[1]}
    first = {}
    for i in sorted(texts):
        for x in texts[i].split("\n"):
            first.setdefault(x, i)
    kept = {r.doc_id: r for r in lines[2]}
    assert all(i in kept and x in kept[i].text.split("\n") for x, i in first.items() if x.split())
    for i, r in kept.items():
        assert r.n_chars == len(r.text)
        if all(first[x] == i for x in texts[i].split("\n")):
            assert r.text == texts[i]

    rows = sorted((r.doc_id, r.text) for r in near[1])
    sets = {i: shingles(t, 5) for i, t in rows}
    group = {i: i for i, _ in rows}
    for i, _ in rows:
        for j, _ in rows:
            if j < i and sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j]) and group[i] != group[j]:
                a, b = min(group[i], group[j]), max(group[i], group[j])
                group = {k: a if g == b else g for k, g in group.items()}
    assert sorted(r.doc_id for r in near[2]) == sorted(set(group.values()))

    items = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    assert sorted(r.doc_id for r in contaminated[2]) == sorted(r.doc_id for r in contaminated[1] if not contamination(r.text, items)[4])

    pieces = {}
    for r in packed[2]:
        pieces.setdefault(r.doc_id, []).append(r)
    assert set(pieces) == {r.doc_id for r in packed[1]}
    for r in packed[1]:
        assert sum(p.n_tokens for p in pieces[r.doc_id]) == len(r.text.translate({c: " " for c in range(9, 14)}).split(" ")) - r.text.translate({c: " " for c in range(9, 14)}).split(" ").count("") + 1


def test_stages_keep_columns_of_clashing_names(spark, tmp_path):
    """Columns that stages make for themselves are a caller's own, too."""
    names = ["score", "n_windows", "lines_deleted", "words_deleted", "_line_dedup_id", "_line_dedup_blocks", "_ngram_join_class", "_ngram_join_rank", "class", "row"]
    rows = [(k, "one two three four five six seven eight nine ten eleven " * (k % 3 + 2) + f"tail {k % 4}", *([float(k)] * len(names))) for k in range(8)]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, "nothing of it")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    docs = spark.createDataFrame(rows, ", ".join(["doc_id long, text string", *(f"{c} double" for c in names)]))
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = written(stage(spark, docs, str(tmp_path)), "stage")
        assert docs.columns == ["doc_id", "text", *names]
        assert all(r[c] == r.doc_id for r in docs.collect() for c in names)


def test_an_empty_corpus(spark, tmp_path):
    for name, schema in (("documents", "doc_id long, text string, lang string, source string, n_chars long"), ("labels", "doc_id long, quality int, toxic int"), ("benchmark", "item_id long, text string")):
        spark.createDataFrame([], schema).write.parquet(str(tmp_path / f"{name}.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the small tables")
def test_line_stage_deletes_every_block_that_an_earlier_document_has(spark):
    docs = table(spark, SF, "documents").where("size(split(text, '\\n')) <= 60")
    earlier, want = set(), {}
    for r in sorted(docs.collect(), key=lambda r: (r.doc_id, r.text)):
        rows, own, dead = r.text.split("\n"), set(), set()
        for s in range(len(rows)):
            for e in range(s + 1, len(rows) + 1):
                own.add(tuple(rows[s:e]))
                if tuple(rows[s:e]) in earlier and sum(len(x.split()) for x in rows[s:e]) >= 30:
                    dead |= set(range(s, e))
        earlier |= own
        text = "\n".join(x for k, x in enumerate(rows) if k not in dead)
        if text.split() or not dead:
            want[r.doc_id] = text
    got = {r.doc_id: r.text for r in corpus_pipeline.drop_repeated_lines(spark, docs, SF).collect()}
    assert got == want and sum(map(len, want.values())) < sum(len(r.text) for r in docs.collect())
