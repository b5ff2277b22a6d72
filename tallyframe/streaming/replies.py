"""Extension: bills from a stream of replies, with the batch operators.

Replies that land as files are parsed as they come; each document's running totals are
one stateful aggregation, and a late page adds to its document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.operators import bills, ingest

REPLY = "doc_id bigint, page_pos int, raw string, ts timestamp"


def reply_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(REPLY).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def running_totals(replies: DataFrame) -> DataFrame:
    """Per document, as far as its pages have come: pages, total of detail pages, and the largest printed total.

    A page that comes again counts once, as it first came; printed totals that are no numbers don't count.
    """
    pages = ingest.pages(replies.dropDuplicates(["doc_id", "page_pos"]))
    amounts = F.aggregate(F.transform(F.coalesce("items", F.array().cast("array<variant>")), lambda v: F.coalesce(ingest.amount(F.try_variant_get(v, "$.item_amount", "variant")), F.lit(0.0))), F.lit(0.0), lambda s, x: s + x)
    rows = pages.withColumn("total", amounts)
    printed = F.when((F.col("printed_total") > 0) & ~F.isnan("printed_total"), F.col("printed_total"))
    return rows.groupBy("doc_id").agg(F.count("*").alias("pages"), F.sum(F.when(~bills.is_summary(), F.col("total")).otherwise(0.0)).alias("grand_total"), F.max(printed).alias("printed_total"))
