"""Types of the bill model, as Spark schemas.

Order is part of the data: whatever is a list in a document carries its position.
"""

from __future__ import annotations

from pyspark.sql import types as T

ITEM = T.StructType([
    T.StructField("item_name", T.StringType(), False), T.StructField("item_amount", T.DoubleType(), False),
    T.StructField("item_rate", T.DoubleType()), T.StructField("item_quantity", T.DoubleType()),
])
PAGE = T.StructType([
    T.StructField("page_no", T.StringType()), T.StructField("page_type", T.StringType()), T.StructField("bill_items", T.ArrayType(ITEM)),
    T.StructField("printed_total", T.DoubleType()), T.StructField("fraud_flags", T.ArrayType(T.StringType())),
])
RECONCILIATION = T.StructType([
    T.StructField("printed_total", T.DoubleType()), T.StructField("computed_total", T.DoubleType()), T.StructField("difference", T.DoubleType()),
    T.StructField("pct_difference", T.DoubleType()), T.StructField("matches", T.BooleanType()), T.StructField("tolerance_pct", T.DoubleType()), T.StructField("note", T.StringType()),
])
GOLD = T.StructType([
    T.StructField("source", T.StringType()), T.StructField("_instructions", T.StringType()), T.StructField("verified", T.BooleanType()), T.StructField("bill_items", T.ArrayType(ITEM)),
])
LABELLED_PAGE = T.StructType([
    T.StructField("image_path", T.StringType()), T.StructField("document", T.StringType()), T.StructField("page_number", T.IntegerType()), T.StructField("label", T.StringType()),
])

#: The page types of the model, and the label options in the order of their digits.
SUMMARY, DETAIL = "Bill Summary", "Bill Detail"
PAGE_TYPES = ("Bill Summary", "Bill Detail", "Pharmacy Bill", "Lab Bill", "Other")
#: Suffixes taken as they are.  Per cent by which extracted and printed totals may differ; pages in one request.
TOLERANCE_PCT, BATCH_PAGES = 1.0, 3
SUFFIXES = (".pdf", ".png", ".jpg", ".jpeg", ".tif", ".tiff", ".webp")
