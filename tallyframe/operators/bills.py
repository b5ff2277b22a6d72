"""Summary suppression, totals, reconciliation and document status.

``pages`` is one row per page: doc_id, page_pos, page_no, page_type, bill_items (array of
items), printed_total, fraud_flags.  All of it is one aggregation per document, so the
only shuffle is by doc_id, with partial sums before it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scalars import money, rounded, signed_money
from tallyframe.schema import ITEM, SUMMARY, TOLERANCE_PCT

#: What a reader of a verdict or of a failed extraction is told; shapes of replies that are told at most.
MOST_SHAPES = 6
NO_TOTAL = "No total printed on the document; nothing to verify against."
MATCHED = "Extracted items match the printed total."


def is_summary() -> Column:
    """Exactly the summary type: case and blanks count; a null type is no summary."""
    return F.col("page_type").eqNullSafe(F.lit(SUMMARY))


def suppressed(pages: DataFrame) -> DataFrame:
    """Summary pages lose their items where the document has any other page; they keep all else."""
    detail = F.max((~is_summary()).cast("int")).over(Window.partitionBy("doc_id")) == 1
    empty = F.array().cast(f"array<{ITEM.simpleString()}>")
    return pages.withColumn("bill_items", F.when(is_summary() & detail, empty).otherwise(F.col("bill_items")))


def items_of(pages: DataFrame) -> DataFrame:
    """One row per item, summary pages left out; equal items stay apart."""
    rows = pages.where(~is_summary()).select("doc_id", "page_pos", F.posexplode("bill_items").alias("item_pos", "item"))
    return rows.select("doc_id", "page_pos", "item_pos", "item.*")


def totals(pages: DataFrame) -> DataFrame:
    """Per document: grand_total (never of summary pages), total_item_count (after suppression), the largest positive printed total."""
    amounts = F.aggregate("bill_items", F.lit(0.0), lambda s, x: s + x["item_amount"])
    printed = F.when((F.col("printed_total") > 0) & ~F.isnan("printed_total"), F.col("printed_total"))
    out = pages.groupBy("doc_id").agg(
        F.coalesce(F.sum(F.when(~is_summary(), amounts)), F.lit(0.0)).alias("grand_total"),
        F.sum(F.when(~is_summary(), F.size("bill_items"))).alias("detail_items"), F.sum(F.size("bill_items")).alias("all_items"),
        F.max(printed).alias("printed_total"),
    )
    return out.select("doc_id", "grand_total", F.coalesce("detail_items", "all_items").alias("total_item_count"), "printed_total")


def verdict(computed: Column, printed: Column, tolerance: float = TOLERANCE_PCT) -> dict[str, Column]:
    """Reconciliation of a computed with a printed total (null: none printed): three-valued ``matches``.

    The percentage is rounded before it is compared; a printed total that rounds to 0 has none.
    """
    computed, printed = rounded(computed), rounded(printed)
    difference = rounded(computed - printed)
    pct = F.when(printed != 0, rounded(F.abs(difference) / printed * 100))
    matches = F.when(printed.isNotNull(), F.coalesce(pct <= tolerance, F.lit(False)))
    lower = F.concat(F.lit("Extracted total is "), money(F.abs(difference)), F.lit(" LOWER than printed - line items were likely missed, or the document is a partial excerpt."))
    higher = F.concat(F.lit("Extracted total is "), money(difference), F.lit(" HIGHER than printed - likely double-counting, e.g. a summary page counted alongside detail pages."))
    note = F.when(printed.isNull(), F.lit(NO_TOTAL)).when(matches, F.lit(MATCHED)).when(difference < 0, lower).otherwise(higher)
    return {"printed_total": printed, "computed_total": computed, "difference": difference, "pct_difference": pct, "matches": matches, "note": note}


def reconciled(totals: DataFrame, computed: str = "grand_total", printed: str = "printed_total", tolerance: float = TOLERANCE_PCT) -> DataFrame:
    """``totals`` with the columns of ``verdict``.  Each step is a column of its own, so nothing is computed twice."""
    v = verdict(F.col("_computed"), F.col("_printed"), tolerance)
    keep = [c for c in totals.columns if c not in {*v, computed, printed}]
    return totals.withColumns({"_computed": F.col(computed), "_printed": F.col(printed)}).select(*keep, *[x.alias(n) for n, x in v.items()])


def display(matches: Column, printed: Column, difference: Column, pct: Column, note: Column) -> Column:
    """What a reader is told: verified, mismatch with the signed difference, or nothing to verify."""
    verified = F.concat(F.lit("Verified "), money(printed))
    mismatch = F.concat(F.lit("Mismatch ("), pct.cast("string"), F.lit("%) "), signed_money(difference))
    return F.when(matches.isNull(), note).when(matches, verified).otherwise(mismatch)


def banner(is_success: Column, error: Column) -> Column:
    """What stands above a result: that there is none, that it is incomplete, or nothing (null)."""
    return F.when(~is_success, F.concat(F.lit("Extraction failed: "), F.coalesce(error, F.lit("no error detail returned")))).when(error.isNotNull(), error)


def flags_in_order(pages: DataFrame) -> DataFrame:
    """(doc_id, fraud_flags): distinct, in the order first seen, suppressed pages included."""
    ordered = F.array_sort(F.collect_list(F.struct("page_pos", "fraud_flags")))
    return pages.groupBy("doc_id").agg(F.array_distinct(F.flatten(F.transform(ordered, lambda x: F.coalesce(x["fraud_flags"], F.array().cast("array<string>"))))).alias("fraud_flags"))


def status(batches: DataFrame) -> DataFrame:
    """Per document, from one row per batch (doc_id, batch_no, failed, output_tokens, items, pages, diagnostics, error): success and the message that goes with it.

    All batches failed: no success.  Some failed: a warning, which wins over the one for
    replies that cost tokens and held no items, which tells the first ``diagnostics``
    (texts on pages without items, by ``ingest.diagnostic``).
    """
    seen = F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("batch_no", "diagnostics"))), lambda x: F.coalesce(x["diagnostics"], F.array().cast("array<string>"))))
    b = batches.groupBy("doc_id").agg(
        F.count("*").alias("attempted"), F.count_if("failed").alias("failed_batches"), F.sum("items").alias("items"), F.sum("pages").alias("pages"), seen.alias("seen"),
        F.sum(F.coalesce("output_tokens", F.lit(0))).cast("bigint").alias("output_tokens"), F.max_by("error", F.when(F.col("failed"), F.col("batch_no"))).alias("last_error"),
    )
    every = F.col("failed_batches") == F.col("attempted")
    error = (
        F.when(every, F.format_string("Extraction failed: every request failed (%d/%d batches). Last error -- %s", "failed_batches", "attempted", "last_error"))
        .when(F.col("failed_batches") > 0, F.format_string("%d of %d page batches failed; results are incomplete. Last error -- %s", "failed_batches", "attempted", "last_error"))
        .when((F.col("items") == 0) & (F.col("output_tokens") > 0), F.concat(
            F.lit("Model returned "), F.format_number("output_tokens", 0), F.lit(" output tokens but no line items parsed from any of "), F.col("pages").cast("string"),
            F.lit(" page(s). Response shapes seen -- "), F.array_join(F.slice("seen", 1, MOST_SHAPES), "; "), F.lit(". Try BATCH_SIZE=1: dense pages batched together are the usual cause."),
        ))
    )
    return b.select("doc_id", (~every).alias("is_success"), "attempted", "failed_batches", "items", "output_tokens", error.alias("error"))


def responses(pages: DataFrame, outcomes: DataFrame | None = None, tolerance: float = TOLERANCE_PCT) -> DataFrame:
    """(doc_id, response): the nested result of each document as JSON, pages in order, nulls kept.

    outcomes: doc_id, is_success, error, input_tokens, output_tokens of each document (see
    ``status`` and ``models.token_usage``); one that failed has no data.  Without them, all
    have succeeded and cost nothing.  All that a document needs is in its pages, which are
    collected once.
    """
    page = F.struct("page_pos", "page_no", "page_type", "bill_items", "printed_total", "fraud_flags")
    rows = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(page)).alias("pages"))
    no_items, no_flags = F.array().cast(f"array<{ITEM.simpleString()}>"), F.array().cast("array<string>")
    summary = lambda p: p["page_type"].eqNullSafe(F.lit(SUMMARY))
    rows = rows.withColumn("detail", F.exists("pages", lambda p: ~summary(p)))
    rows = rows.withColumn("pages", F.transform("pages", lambda p: p.withField("bill_items", F.when(F.col("detail") & summary(p), no_items).otherwise(p["bill_items"]))))
    total = lambda p: F.aggregate(F.coalesce(p["bill_items"], no_items), F.lit(0.0), lambda s, x: s + x["item_amount"])
    printed = F.array_max(F.transform("pages", lambda p: F.when((p["printed_total"] > 0) & ~F.isnan(p["printed_total"]), p["printed_total"])))
    rows = rows.withColumns({
        "grand_total": F.aggregate("pages", F.lit(0.0), lambda s, p: s + F.when(summary(p), 0.0).otherwise(total(p))), "printed_total": printed,
        "total_item_count": F.aggregate("pages", F.lit(0), lambda s, p: s + F.size(F.coalesce(p["bill_items"], no_items))),
        "fraud_flags": F.array_distinct(F.flatten(F.transform("pages", lambda p: F.coalesce(p["fraud_flags"], no_flags)))),
    })
    rows = reconciled(rows, tolerance=tolerance)
    reconciliation = F.struct(*(c for c in ("printed_total", "computed_total", "difference", "pct_difference", "matches")), F.lit(tolerance).alias("tolerance_pct"), "note")
    data = F.struct(
        F.transform("pages", lambda p: p.dropFields("page_pos")).alias("pagewise_line_items"), F.col("total_item_count"), F.col("computed_total").alias("grand_total"),
        F.lit(None).cast("map<string,double>").alias("sub_totals"), reconciliation.alias("reconciliation"), F.col("fraud_flags"),
    )
    rows = rows.select("doc_id", data.alias("data"))
    if outcomes is None:
        rows = rows.withColumns({"is_success": F.lit(True), "error": F.lit(None).cast("string"), "input_tokens": F.lit(0), "output_tokens": F.lit(0)})
    else:
        rows = outcomes.select("doc_id", "is_success", "error", "input_tokens", "output_tokens").join(rows, "doc_id", "left")
    tokens = {c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") for c in ("input_tokens", "output_tokens")}
    usage = F.struct((tokens["input_tokens"] + tokens["output_tokens"]).alias("total_tokens"), *(c.alias(n) for n, c in tokens.items()))
    response = F.struct("is_success", usage.alias("token_usage"), F.when(F.col("is_success"), F.col("data")).alias("data"), "error")
    return rows.select("doc_id", F.to_json(response, {"ignoreNullFields": "false"}).alias("response"))


def fraud_checks(items: DataFrame) -> DataFrame:
    """Extension: the rule that a model is only told in words. Amounts that aren't rate times quantity (one in a hundred may be off)."""
    product = F.col("item_rate") * F.col("item_quantity")
    return items.withColumn("off", product.isNotNull() & (F.abs(F.col("item_amount") - product) > F.greatest(F.abs(product) * 0.01, F.lit(0.01))))
