import hashlib
import ipaddress
import json
import random

import pytest
from pyspark.sql import functions as F

from tallyframe.operators import bills, ingest, intake, labels
from tallyframe.sources import files
from tallyframe.streaming.replies import reply_stream, running_totals


def test_documents_and_pages(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-1.4 xx")
    (tmp_path / "b.bin").write_bytes(b"%PDF-1.4 yy")
    (tmp_path / "c.bin").write_bytes(b"x" * 100)
    docs = files.documents(spark, str(tmp_path), most=50)
    got = {r.path.rsplit("/", 1)[1]: (r.suffix, r.too_large, r.content is None) for r in docs.collect()}
    assert got == {"a.pdf": (".pdf", False, False), "b.bin": (".pdf", False, False), "c.bin": (".png", True, True)}

    def render(content, kind):
        if content.endswith(b"yy"):
            raise ValueError("broken")
        return [content[:2], content[2:4], content[4:6], content[6:8]]

    pages = files.pages_of(docs, render)
    assert sorted((r.page_pos, bytes(r.image)) for r in pages.collect()) == [(0, b"%P"), (1, b"DF"), (2, b"-1"), (3, b".4")]
    replies = files.replies(pages.withColumnRenamed("path", "doc_id"), lambda images: json.dumps([len(x) for x in images]) if len(images) > 1 else 1 / 0)
    assert sorted((r.batch_no, r.expected, r.raw, r.error) for r in replies.collect()) == [(0, 3, "[2, 2, 2]", None), (1, 1, None, "ZeroDivisionError: division by zero")]


def test_mock_mode_end_to_end(spark):
    pages = spark.range(5).selectExpr("7 AS doc_id", "cast(id AS int) AS page_pos")
    parsed = ingest.pages(files.mock_replies(pages))
    items = ingest.items_of(parsed)
    assert [r.page_no for r in parsed.orderBy("page_pos").collect()] == ["1", "2", "3", "1", "2"]
    assert sum(r.item_amount for r in items.collect()) == 900.0
    assert {r.page_type for r in parsed.collect()} == {"Bill Detail"} and not bills.is_summary() is None


def test_gold_files(spark, tmp_path):
    for name, verified in (("b.json", True), ("a.json", True), ("c.json", False)):
        (tmp_path / name).write_text(json.dumps({"source": f"{name}.pdf", "_instructions": "", "verified": verified, "bill_items": [{"item_name": "é", "item_amount": 1.5}]}, indent=2))
    gold = files.gold(spark, str(tmp_path))
    assert [r.source for r in gold.orderBy("file").collect()] == ["a.json.pdf", "b.json.pdf"]
    there, missing = files.with_document(gold, spark.createDataFrame([("/x/a.json.pdf",)], "path string"))
    assert [r.source for r in there.collect()] == ["a.json.pdf"] and [r.source for r in missing.collect()] == ["b.json.pdf"]
    out = str(tmp_path / "out")
    files.write_json(files.gold_template(gold.select("source", "bill_items")), out)
    assert {r.verified for r in spark.read.json(out).collect()} == {False}


def test_only_metadata_of_large_files_is_read(spark, tmp_path):
    (tmp_path / "big.pdf").write_bytes(b"x" * 100)
    plan = files.documents(spark, str(tmp_path), most=50)._jdf.queryExecution().toString()
    assert "LessThanOrEqual(length,50)" in plan and "GreaterThan(length,50)" in plan


def test_replies_want_pages_in_order(spark):
    pages = spark.createDataFrame([(1, 1, b"a"), (1, 0, b"b")], "doc_id int, page_pos int, image binary").coalesce(1)
    with pytest.raises(Exception, match="in order"):
        files.replies(pages, lambda images: "{}").collect()
    many = spark.range(7).selectExpr("cast(id / 4 as int) AS doc_id", "cast(id % 4 as int) AS page_pos", "cast('x' as binary) AS image").coalesce(1)
    assert [(r.doc_id, r.batch_no, r.expected, r.raw) for r in files.replies(many, lambda images: str(len(images))).collect()] == [(0, 0, 3, "3"), (0, 1, 1, "1"), (1, 0, 3, "3")]


def test_results_and_options(spark, tmp_path):
    scores = spark.createDataFrame([(1, 3, 1, 0, 1.0)], "doc_id int, matched bigint, missed bigint, spurious bigint, f1 double")
    files.write_results(scores, str(tmp_path / "results"))
    assert spark.read.json(str(tmp_path / "results" / "micro")).first().documents == 1 and spark.read.json(str(tmp_path / "results" / "per_document")).first().doc_id == 1
    with pytest.raises(ValueError, match="no gold"):
        files.required(scores.where("doc_id = 2"), "no gold")
    assert files.health(spark).first().batch_pages == 3
    spark.conf.set("spark.tallyframe.batchPages", "5")
    spark.conf.set("spark.tallyframe.modelFallbacks", "a, b,")
    assert files.health(spark).first().batch_pages == 5 and files.options(spark)["modelFallbacks"] == ["a", "b"]
    for name in ("batchPages", "modelFallbacks"):
        spark.conf.unset(f"spark.tallyframe.{name}")


def test_labels_and_groups(spark):
    pages = spark.range(4).selectExpr("cast(id as int) AS position")
    assert [r.label for r in labels.numbered(pages, "1 5 2 2").orderBy("position").collect()] == ["Bill Summary", "Other", "Bill Detail", "Bill Detail"]
    with pytest.raises(ValueError, match="3 labels for 4 pages"):
        labels.numbered(pages, "1 5 2")
    groups = spark.range(3000).selectExpr("concat('g', id) AS grp")
    got = {r.grp: r.in_test for r in labels.split(groups, 0.3, 42).collect()}
    order = sorted(got, key=lambda g: (hashlib.md5(f"42:{g}".encode()).hexdigest(), g))
    assert labels.split(spark.createDataFrame([("a",), (None,)], "grp string")).count() == 2
    assert {g for g, t in got.items() if t} == set(order[:900]) and labels.split(groups.limit(1), 0.1).first().in_test


def test_public_addresses_agree_with_the_standard_library(spark):
    rng = random.Random(6)
    text = [".".join(str(rng.choice((0, 1, 9, 10, 64, 100, 127, 169, 172, 192, 168, 198, 203, 224, 240, 255, 254, 31, 16, 18, 51, 113))) for _ in range(4)) for _ in range(3000)]
    text += ["::1", "2606:4700::1111", "fe80::1", "::ffff:10.0.0.1", "256.1.1.1", "1.2.3", "01.2.3.4", "x", "", None, "192.0.0.9", "192.0.0.10", "192.0.0.8"]

    def want(t):
        try:
            ip = ipaddress.ip_address(t or "")
        except ValueError:
            return None
        return not (ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_reserved or ip.is_multicast or ip.is_unspecified)

    got = spark.createDataFrame([(t,) for t in text], "a string").select("a", intake.public_address(F.col("a")).alias("p")).collect()
    assert [(r.a, r.p) for r in got if r.p != want(r.a)] == []
    hosts = spark.createDataFrame([("u", "8.8.8.8"), ("u", "10.0.0.1"), ("v", "8.8.8.8"), ("w", None)], "url string, address string")
    assert {r.url: r.problem for r in intake.host_problems(hosts).collect()} == {"u": "not public", "v": None, "w": "unresolved"}


def test_replies_as_a_stream(spark, tmp_path):
    rows = [(1, 0, '{"bill_items": [{"item_amount": 5}, {"item_amount": "x"}], "printed_total": 9}'), (1, 1, '{"page_type": "Bill Summary", "bill_items": [{"item_amount": 9}]}'), (2, 0, "no JSON")]
    spark.createDataFrame(rows, "doc_id bigint, page_pos int, raw string").selectExpr("*", "current_timestamp() AS ts").write.parquet(str(tmp_path / "in"))
    spark.createDataFrame(rows[:1], "doc_id bigint, page_pos int, raw string").selectExpr("*", "current_timestamp() AS ts").write.mode("append").parquet(str(tmp_path / "in"))
    q = running_totals(reply_stream(spark, str(tmp_path / "in"))).writeStream.outputMode("complete").format("memory").queryName("totals").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(map(tuple, spark.table("totals").collect())) == [(1, 2, 5.0, 9.0), (2, 1, 0.0, None)]
