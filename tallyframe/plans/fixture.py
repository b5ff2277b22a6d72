"""The bill model over the retail tables.

A document is an order, a page one of its line numbers, an item a line; the printed total
is the order's price, missing for orders that are partly shipped.  Predictions, replies,
words and errors are derived from keys by arithmetic, so that SQL can state them too.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.schema import ITEM

PAGE_TYPE = "CASE l_linenumber WHEN 1 THEN 'Bill Summary' WHEN 5 THEN 'Pharmacy Bill' WHEN 6 THEN 'Lab Bill' WHEN 7 THEN 'Other' ELSE 'Bill Detail' END"
#: Of a page: the order's price on every third page, a figure that must be ignored on every other third.
PAGE_PRINTED = "CASE WHEN o_orderstatus = 'P' THEN NULL WHEN l_linenumber % 3 = 1 THEN o_totalprice WHEN l_linenumber % 3 = 2 THEN -1.0 END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, page_no, page_type, item_amount and keys of each line, without a join."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.select(F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page_no"), F.expr(PAGE_TYPE).alias("page_type"), F.col("l_extendedprice").alias("item_amount"), F.col("l_quantity").alias("item_quantity"), "l_partkey", "l_suppkey", "l_returnflag", "l_linestatus")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lines`` with the part's name; the part table is the smaller side and Spark picks the join by its size."""
    parts = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_name").alias("item_name"))
    return lines(spark, sf_dir).join(parts, "l_partkey")


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nested pages: doc_id, page_pos, page_no, page_type, bill_items, printed_total, fraud_flags."""
    rows = items(spark, sf_dir)
    item = F.struct("item_name", "item_amount", (F.col("item_amount") / F.col("item_quantity")).alias("item_rate"), "item_quantity")
    nested = rows.groupBy("doc_id", "page_no", "page_type").agg(F.sort_array(F.collect_list(F.struct("l_partkey", "l_suppkey", "item_amount", item.alias("item")))).alias("rows"), F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("fraud_flags"))
    orders = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), "o_orderstatus", "o_totalprice")
    return nested.withColumn("l_linenumber", F.col("page_no")).join(orders, "doc_id").select(
        "doc_id", (F.col("page_no") - 1).alias("page_pos"), F.col("page_no").cast("string").alias("page_no"), "page_type",
        F.transform("rows", lambda r: r["item"]).cast(f"array<{ITEM.simpleString()}>").alias("bill_items"), F.expr(PAGE_PRINTED).cast("double").alias("printed_total"), "fraud_flags",
    )


def key() -> Column:
    return F.expr("(l_partkey * 7 + l_suppkey * 3 + page_no) % 10")


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, gi, item_name, item_amount of the items that aren't on summary pages; gi is a line's place among its keys."""
    rows = items(spark, sf_dir).where("page_type <> 'Bill Summary'")
    return rows.select("doc_id", F.expr("cast(page_no as bigint) * 1000000000000 + l_partkey * 1000000 + l_suppkey").alias("gi"), "item_name", "item_amount", key().alias("k"))


def predicted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gold with errors by key: 0 is missing, 1 off by a hundredth, 2 by far too much, 3 spelled otherwise, 4 misspelled, 5 another name."""
    name = F.expr("CASE k WHEN 3 THEN concat(upper(item_name), '.') WHEN 4 THEN concat(substr(item_name, 1, length(item_name) - 1), 'x') WHEN 5 THEN 'freight' ELSE item_name END")
    amount = F.expr("CASE k WHEN 1 THEN item_amount + 0.01D WHEN 2 THEN item_amount + 5000 ELSE item_amount END")
    return gold(spark, sf_dir).where("k <> 0").select("doc_id", F.col("gi").alias("pi"), name.alias("item_name"), amount.cast("double").alias("item_amount"))


#: Replies by the last digit of event_id: whole, fenced, missing and null fields, bad numbers, no JSON, no object, empty.
REPLY = """CASE event_id % 10
    WHEN 0 THEN concat('{"page_no": "', user_id, '", "page_type": "Bill Detail", "bill_items": [{"item_name": "', event_type, '", "item_amount": ', event_id, '.5, "item_rate": ', user_id, ', "item_quantity": 2}], "printed_total": ', event_id, '.5, "fraud_flags": ["x", " ", "y"]}')
    WHEN 1 THEN concat('```json', chr(10), '{"page_type": "Lab Bill", "bill_items": [{"item_name": "', event_type, '", "item_amount": "', user_id, '.25"}]}', chr(10), '```')
    WHEN 2 THEN concat('{"page_no": ', user_id, ', "bill_items": [{"item_amount": null}, {"item_name": null, "item_amount": 3}]}')
    WHEN 3 THEN '{"page_type": null, "bill_items": [{"item_name": "a", "item_amount": "1,200"}, {"item_name": "b", "item_amount": true}], "printed_total": "12.50"}'
    WHEN 4 THEN concat('no JSON at all ', event_id)
    WHEN 5 THEN '{}'
    WHEN 6 THEN '{"bill_items": [], "printed_total": "abc", "fraud_flags": null}'
    WHEN 7 THEN concat('{"page_type": "Bill Summary", "bill_items": [{"item_name": "', event_type, '", "item_amount": "", "item_rate": "x"}, 5, "text"], "printed_total": ', user_id, '}')
    WHEN 8 THEN '{"bill_items": [{"item_name": 12, "item_amount": false, "item_quantity": "7"}]}'
    ELSE concat('  {"page_no": "9", "bill_items": [{"item_name": "', event_type, '", "item_amount": -', user_id, '}]}  ') END"""


def replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.lit(0).alias("page_pos"), F.expr(REPLY).alias("raw"))


#: What a remote call may say, by event.
MESSAGE = """CASE event_id % 8 WHEN 0 THEN '429 Quota exceeded' WHEN 1 THEN '404 model is no longer available' WHEN 2 THEN '403 Permission denied' WHEN 3 THEN 'DeadlineExceeded: Timeout'
    WHEN 4 THEN 'Invalid argument' WHEN 5 THEN 'Model Not Found' WHEN 6 THEN 'RESOURCE_EXHAUSTED' ELSE concat('Internal error ', event_type) END"""
