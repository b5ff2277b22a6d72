import json

import pytest

from tallyframe.operators import bills, ingest, scoring
from tallyframe.schema import PAGE

SCHEMA = f"doc_id int, page_pos int, {', '.join(f'{f.name} {f.dataType.simpleString()}' for f in PAGE)}"


def item(name, amount):
    return (name, float(amount), None, None)


def pages(spark, *rows):
    return spark.createDataFrame([(d, p, str(p + 1), kind, items, total, flags) for d, p, kind, items, total, flags in rows], SCHEMA)


def test_summary_pages_lose_their_items_beside_details(spark):
    df = pages(spark, (1, 0, "Bill Summary", [item("all", 5000)], 5000.0, []), (1, 1, "Bill Detail", [item("a", 2000), item("b", 3000)], None, []), (2, 0, "Bill Summary", [item("x", 1000)], None, []))
    got = {(r.doc_id, r.page_pos): len(r.bill_items) for r in bills.suppressed(df).collect()}
    assert got == {(1, 0): 0, (1, 1): 2, (2, 0): 1}
    totals = {r.doc_id: (r.grand_total, r.total_item_count, r.printed_total) for r in bills.totals(df).collect()}
    assert totals == {1: (5000.0, 2, 5000.0), 2: (0.0, 1, None)}


def test_repeated_items_are_never_merged(spark):
    df = pages(spark, (1, 0, "Bill Detail", [item("test", 80)] * 20, None, []))
    assert bills.items_of(df).count() == 20
    assert bills.totals(df).first().grand_total == 1600.0


@pytest.mark.parametrize(
    "printed,computed,matches,difference,word",
    [([1500.0], 1500.0, True, 0.0, "match"), ([1500.0], 1000.0, False, -500.0, "LOWER"), ([1500.0], 3000.0, False, 1500.0, "HIGHER"), ([1500.0] * 3, 1500.0, True, 0.0, "match"), ([None], 100.0, None, None, "nothing to verify"), ([1500.0], 1495.0, True, -5.0, "match"), ([0.001], 5.0, False, 5.0, "HIGHER"), ([-3.0], 5.0, None, None, "nothing"), ([float("nan"), 5.0], 5.0, True, 0.0, "match"), ([1000.0], 989.96, True, -10.04, "match")],
)
def test_reconciliation(spark, printed, computed, matches, difference, word):
    df = pages(spark, *[(1, k, "Bill Detail", [item("a", computed)] if not k else [], p, []) for k, p in enumerate(printed)])
    r = bills.reconciled(bills.totals(df)).first()
    assert (r.matches, r.difference) == (matches, difference) and word in r.note


def test_flags_keep_the_order_first_seen(spark):
    df = pages(spark, (1, 1, "Bill Detail", [], None, ["b", "a"]), (1, 0, "Bill Summary", [], None, ["c", "b"]), (1, 2, "Other", [], None, None))
    assert bills.flags_in_order(df).first().fraud_flags == ["c", "b", "a"]


def test_responses(spark):
    df = pages(spark, (1, 1, "Bill Detail", [item("a", 10)], None, ["f"]), (1, 0, "Bill Summary", [item("all", 10)], 10.0, []))
    data = json.loads(bills.responses(df).first().response)["data"]
    assert [p["page_no"] for p in data["pagewise_line_items"]] == ["1", "2"] and data["pagewise_line_items"][0]["bill_items"] == []
    assert data["grand_total"] == 10.0 and data["reconciliation"]["matches"] is True and data["fraud_flags"] == ["f"] and data["total_item_count"] == 1


def test_responses_keep_nulls_and_tell_of_failures(spark):
    df = pages(spark, (1, 0, "Bill Detail", [item("a", 10)], None, None), (2, 0, "Bill Detail", [], None, []))
    outcomes = spark.createDataFrame([(1, True, "1 of 2", 5, None), (2, True, None, None, None), (3, False, "all failed", 1, 0)], "doc_id int, is_success boolean, error string, input_tokens int, output_tokens int")
    got = {r.doc_id: json.loads(r.response) for r in bills.responses(df, outcomes).collect()}
    assert got[1]["error"] == "1 of 2" and got[1]["token_usage"] == {"total_tokens": 5, "input_tokens": 5, "output_tokens": 0}
    assert got[1]["data"]["pagewise_line_items"] == [{"page_no": "1", "page_type": "Bill Detail", "bill_items": [{"item_name": "a", "item_amount": 10.0, "item_rate": None, "item_quantity": None}], "printed_total": None, "fraud_flags": None}]
    assert got[1]["data"]["reconciliation"]["matches"] is None and got[1]["data"]["sub_totals"] is None and got[1]["data"]["fraud_flags"] == []
    assert got[2]["data"]["total_item_count"] == 0 and got[2]["error"] is None
    assert got[3] == {"is_success": False, "token_usage": {"total_tokens": 1, "input_tokens": 1, "output_tokens": 0}, "data": None, "error": "all failed"}


def test_status(spark):
    shapes = [f"page {k}: keys=[]" for k in range(4)]
    rows = [(1, 0, True, 0, 0, 3, [], "e0"), (1, 1, True, 0, 0, 1, [], "e1"), (2, 1, False, 50, 0, 4, shapes, None), (2, 0, False, 1950, 0, 4, ["x"] * 3, None), (3, 0, True, 0, 0, 3, None, "x"), (3, 1, False, 70, 2, 1, [], None), (4, 0, False, 9, 3, 1, [], None)]
    got = {r.doc_id: (r.is_success, r.error) for r in bills.status(spark.createDataFrame(rows, "doc_id int, batch_no int, failed boolean, output_tokens int, items int, pages int, diagnostics array<string>, error string")).collect()}
    assert got[1] == (False, "Extraction failed: every request failed (2/2 batches). Last error -- e1")
    assert got[2] == (True, "Model returned 2,000 output tokens but no line items parsed from any of 8 page(s). Response shapes seen -- x; x; x; page 0: keys=[]; page 1: keys=[]; page 2: keys=[]. Try BATCH_SIZE=1: dense pages batched together are the usual cause.")
    assert got[3][1].startswith("1 of 2 page batches failed") and got[4] == (True, None)


def test_diagnostics(spark):
    from pyspark.sql import functions as F

    raw = ['{"a": 1, "b": {"c": 2}}', "```json\n{}\n```", "it's", "a\nb'\"", "x" * 100, "[1]"]
    got = [r[0] for r in spark.createDataFrame([(x,) for x in raw], "raw string").select(ingest.diagnostic(F.lit(3), F.col("raw"))).collect()]
    assert got[:2] == ["page 3: keys=['a', 'b']", "page 3: keys=[]"] and got[2:] == [f"page 3: unparseable, starts {x[:80]!r}" for x in raw[2:]]


def parse(spark, *raw):
    p = ingest.pages(spark.createDataFrame([(k, 0, r) for k, r in enumerate(raw)], "doc_id int, page_pos int, raw string"))
    return {r.doc_id: r for r in p.drop("items").collect()}, {d: [tuple(r)[3:] for r in rows] for d, rows in _by(ingest.items_of(p).orderBy("doc_id", "item_pos").collect())}


def _by(rows):
    out = {}
    for r in rows:
        out.setdefault(r.doc_id, []).append(r)
    return out.items()


def test_tolerant_parsing(spark):
    page, items = parse(
        spark,
        '```json\n{"page_no": "3", "page_type": "Lab Bill", "bill_items": [{"item_name": "x", "item_amount": 500.0, "item_rate": 500, "item_quantity": 1}], "printed_total": 100.0}\n```',
        "plain text", '{"bill_items": [{"item_name": "a", "item_amount": null}, {"item_amount": "1,200"}, {"item_amount": "7"}, 3, null, {"item_name": null, "item_amount": true, "item_rate": ""}]}',
        '{"bill_items": null}', "[1]", '{"page_type": null, "page_no": null, "fraud_flags": ["a", " ", 5, null, true]}', "{}", '{"bill_items": []} trailing', '{"bill_items": []} x}', '{"a": 1}, {"b": 2}', '{"a": 1} ] {}', '{"a": 1} } {}', '{"a": 1, "a": 2}', '{"printed_total": NaN}', '{"fraud_flags": "xy"}', "",
    )
    assert (page[0].page_no, page[0].page_type, page[0].printed_total, items[0]) == ("3", "Lab Bill", 100.0, [("x", 500.0, 500.0, 1.0)])
    assert page[1].page_type == "Other" and 1 not in items
    assert items[2] == [("a", 0.0, None, None), ("Unknown", 7.0, None, None), ("None", 1.0, None, None)]
    assert page[3].broken and page[4].broken and not page[6].broken and page[6].page_type == "Bill Detail"
    assert (page[5].page_no, page[5].page_type, page[5].fraud_flags) == ("None", "None", ["a", "5", "None", "True"])
    assert [page[k].page_type for k in (7, 8, 9, 10, 11, 12, 13, 15)] == ["Other"] * 8 and page[14].fraud_flags == [] and page[14].page_type == "Bill Detail"


def test_split_batches(spark):
    from pyspark.sql import functions as F

    cases = ['[{"a":1},{"a":2},{"a":3}]', '[{"a":1}]', '{"pages":[{"a":1},{"a":2}]}', '{"a":1}', 'x {"a":1} y {"b":{"c":2}}', "none", "5"]
    df = spark.createDataFrame([(c,) for c in cases], "raw string").select("raw", ingest.split_batch(F.col("raw"), F.lit(2)).alias("x"))
    assert [r.pages for r in ingest.split_batches(df.withColumn("expected", F.lit(2))).collect()] == [r.x for r in df.collect()]
    assert [r.x for r in df.collect()] == [['{"a":1}', '{"a":2}', '{"a":3}'], ['{"a":1}'], ['{"a":1}', '{"a":2}'], ['{"a":1}', "{}"], ['{"a":1}', '{"b":{"c":2}}'], ["{}", "{}"], ["{}", "{}"]]


def scores(spark, gold, pred):
    g = spark.createDataFrame([(1, k, n, float(a)) for k, (n, a) in enumerate(gold)], "doc_id int, gi int, item_name string, item_amount double")
    p = spark.createDataFrame([(1, k, n, float(a)) for k, (n, a) in enumerate(pred)], "doc_id int, pi int, item_name string, item_amount double")
    m = scoring.greedy(scoring.candidates(g, p))
    return scoring.scored(g, p, m).first(), sorted((r.gi, r.pi) for r in m.collect())


def test_matching_is_one_to_one(spark):
    r, m = scores(spark, [("Glucose test", 80)] * 20, [("glucose  TEST", 80)])
    assert (r.matched, r.missed, r.spurious, r.precision, r.recall) == (1, 19, 0, 1.0, 0.05) and m == [(19, 0)]
    r, m = scores(spark, [("x-ray chest", 100), ("bed charge", 50)], [("xray chest", 100.9), ("bed charge", 51)])
    assert m == [(0, 0)] and r.total_abs_pct_error == 1.27 and r.missed_examples == ["bed charge"] and r.spurious_examples == ["bed charge"]


def test_micro_average(spark):
    df = spark.createDataFrame([(3, 1, 0), (0, 0, 2)], "matched bigint, missed bigint, spurious bigint")
    assert tuple(scoring.micro(df).first()) == (2, 3, 1, 2, 0.6, 0.75, 0.6667)
    with pytest.raises(ValueError, match="nothing scored"):
        scoring.results(df.where("matched > 9"))
