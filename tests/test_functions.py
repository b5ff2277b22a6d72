import pytest
from pyspark.sql import functions as F

from tallyframe.functions import scalars, similarity
from tallyframe.operators import intake, labels, models, ocr


def values(spark, rows, schema, *exprs):
    return [tuple(r) for r in spark.createDataFrame(rows, schema).select(*exprs).collect()]


def test_rounding_is_half_even_on_the_binary_value(spark):
    xs = [2.675, 0.125, 1234.565, 1.005, -0.125, 1e16, 0.005, -3.14159, float("inf"), float("-inf")]
    got = values(spark, [(x,) for x in xs] + [(None,)], "x double", scalars.rounded("x"), scalars.rounded("x", 4))
    assert got[:-1] == [(round(x, 2), round(x, 4)) for x in xs] and got[-1] == (None, None)


def test_safe_float(spark):
    cases = [(None, None), ("123.45", 123.45), ("abc", None), ("100", 100.0), (" 12 ", 12.0), ("1_000", 1000.0), ("1.5d", None), ("1.5f", None), ("1e3", 1000.0), ("+5", 5.0), ("1,200", None), ("", None), ("inf", float("inf")), ("_1", None)]
    assert [r[0] for r in values(spark, [(c,) for c, _ in cases], "x string", scalars.safe_float("x"))] == [v for _, v in cases]


def test_fences_and_names(spark):
    cases = ['```json\n{"a": 1}\n```', '{"a": 1}', '  ```{"a": 1}```\n']
    assert {r[0] for r in values(spark, [(c,) for c in cases], "x string", scalars.without_fences("x"))} == {'{"a": 1}'}
    assert values(spark, [("  X-Ray (CHEST)\tfull ",), ("बिल",)], "x string", scalars.normalised("x")) == [("x ray chest full",), ("",)]


def test_matching_blocks_are_not_symmetric(spark):
    got = values(spark, [("tide", "diet"), ("diet", "tide"), ("", ""), ("abc", "abc")], "a string, b string", similarity.block_ratio("a", "b"))
    assert got == [(0.25,), (0.5,), (1.0,), (1.0,)]


def test_errors_and_backoff(spark):
    cases = [("404 gone, quota", "retired", False), ("429", "throttled", True), ("Permission denied", "denied", False), ("odd", "failed", False), ("Connection reset", "failed", True)]
    got = values(spark, [(c,) for c, _, _ in cases], "m string", models.bucket(F.col("m")), models.transient(F.col("m")))
    assert got == [(b, t or "quota" in m) for m, b, t in cases]
    assert values(spark, [(k,) for k in range(5)], "a int", scalars.backoff_seconds("a")) == [(1.0,), (2.0,), (4.0,), (8.0,), (8.0,)]


def test_urls_and_files(spark):
    cases = [("http://h.example.com/a/b.PDF?x=1", None, ".pdf"), ("file:///etc/passwd", "scheme", ".pdf"), ("no url", "scheme", ".pdf"), ("https:///x", "host", ".pdf"), ("http://h/archive.zip", None, ".pdf")]
    got = values(spark, [(u,) for u, _, _ in cases], "u string", intake.url_problem(F.col("u")), intake.suffix(F.col("u"), F.lit(b"%PDF-1.4")))
    assert [g[0] for g in got] == [p for _, p, _ in cases] and got[0][1] == ".pdf" and got[4][1] == ".pdf"
    assert values(spark, [("8.8.8.8",), ("10.1.2.3",), ("::1",), ("169.254.169.254",), ("host",), (None,)], "a string", intake.public_address("a")) == [(True,), (False,), (False,), (False,), (None,), (None,)]


def test_labels(spark):
    assert values(spark, [(1,)], "x int", labels.from_digits("1 2\n 5")) == [(["Bill Summary", "Bill Detail", "Other"],)]
    with pytest.raises(Exception, match="out of range"):
        values(spark, [(1,)], "x int", labels.from_digits("1 6"))
    got = values(spark, [("it's a LAB BILL",), ("no idea",), ("pharmacy bill, or a bill detail",)], "x string", labels.from_answer("x"))
    assert got == [("Lab Bill",), ("Other",), ("Bill Detail",)]
    rows = spark.createDataFrame([(0, "b"), (1, "a"), (2, "a"), (3, "b"), (4, "c")], "position int, label string")
    assert tuple(labels.majority(rows).first()) == ("b", 2, 0.4)
    assert labels.majority(rows.where("position < 0")).count() == 0


def test_groups_stay_whole(spark):
    rows = spark.createDataFrame([(f"d{i % 10}", i) for i in range(50)], "document string, i int")
    aliases = spark.createDataFrame([("d1", "d0")], "document string, alias string")
    found = labels.groups_of(rows, aliases)
    split = {r.grp: r.in_test for r in labels.split(found).collect()}
    assert len(split) == 9 and sum(split.values()) == 3 and "d1" not in split
    assert {r.grp: r.in_test for r in labels.split(found.repartition(7)).collect()} == split


def test_ocr_text(spark):
    rows = [(1, 0, "b", "90", 0, 0, 1), (1, 1, "a", "80", 0, 0, 0), (1, 2, " ", "99", 0, 0, 0), (1, 3, "c", "-1", 0, 0, 0), (1, 4, "d", "x", 0, 0, 0), (1, 5, "e", "70", 0, 0, 0), (2, 0, "f", "10", 0, 0, 0)]
    words = spark.createDataFrame(rows, "page int, idx int, text string, conf string, block int, par int, line int")
    got = {r.page: (r.mean_conf, r.text) for r in ocr.page_text(words).collect()}
    assert got == {1: (80.0, "a e\nb"), 2: (10.0, "")}


def test_ranking(spark):
    names = ["models/gemini-2.0-flash", "models/gemini-flash-latest", "models/gemini-2.5-flash-preview", "models/gemini-2.5-flash", "models/gemini-3-pro", "models/gemini-2.5-flash-lite", "models/gemini-2.5-flash-image"]
    cat = spark.createDataFrame([(k, n, ["generateContent"]) for k, n in enumerate(names)] + [(9, "models/gemini-9-flash", ["embed"])], "position int, name string, methods array<string>")
    ranked = models.ranked(models.usable(cat))
    assert [r.name for r in ranked.where("tier = 'flash'").orderBy("rank").collect()] == ["gemini-2.5-flash", "gemini-2.5-flash-preview", "gemini-2.0-flash", "gemini-flash-latest"]
    assert [(r.role, r.name) for r in models.suggested(ranked).orderBy("place").collect()] == [("model", "gemini-2.5-flash"), ("fallback", "gemini-2.5-flash-preview"), ("fallback", "gemini-2.0-flash")]
