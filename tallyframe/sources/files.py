"""Sources and sinks: landed documents, gold and label files, results."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe import schema
from tallyframe.operators import ingest, scoring
from tallyframe.operators.intake import MOST_BYTES, suffix


def documents(spark: SparkSession, path: str, pattern: str = "*", most: int = MOST_BYTES) -> DataFrame:
    """Landed files (path, length, suffix, too_large, content); of a file over the limit only its metadata is read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(path)
    # the length filters are pushed into the scan, which then never opens what they leave out
    small = files.where(F.col("length") <= most).select("path", "length", suffix(F.col("path"), F.col("content")).alias("suffix"), F.lit(False).alias("too_large"), "content")
    large = files.where(F.col("length") > most).select("path", "length", suffix(F.col("path"), F.lit(None).cast("binary")).alias("suffix"), F.lit(True).alias("too_large"), F.lit(None).cast("binary").alias("content"))
    return small.unionByName(large)


def page_list(documents: DataFrame) -> DataFrame:
    """(document, page_number, key): every page of documents (document, n_pages), pages from 1; ordered by key, documents come by name and not by number."""
    rows = documents.select("document", F.explode(F.sequence(F.lit(1), F.col("n_pages").cast("int"))).alias("page_number"))
    return rows.withColumn("key", F.format_string("%s/%05d", "document", "page_number"))


def pages_of(files: DataFrame, render: Callable[[bytes, str], list[bytes]], schema_: str = "path string, page_pos int, image binary") -> DataFrame:
    """One row per page of each file, by a renderer of the caller; a file that can't be rendered has no pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            out = []
            for path, content, kind in zip(rows["path"], rows["content"], rows["suffix"]):
                try:
                    images = render(bytes(content), kind) if content is not None else []
                except Exception:  # noqa: BLE001  the renderer is the caller's
                    images = []
                out += [(path, k, image) for k, image in enumerate(images)]
            yield pd.DataFrame(out, columns=["path", "page_pos", "image"])

    return files.select("path", "content", "suffix").mapInPandas(run, schema_)


def replies(pages: DataFrame, call: Callable[[list[bytes]], str], batch: int = schema.BATCH_PAGES) -> DataFrame:
    """(doc_id, batch_no, expected, raw, error): one remote call per batch of pages, by a caller that retries as it sees fit; an error leaves raw null.

    Pages of a document come in order and in one partition, as ``pages_of`` makes them, so
    images are never shuffled; anything else is an error.
    """
    kind = pages.schema["doc_id"].dataType.simpleString()
    names = ["doc_id", "batch_no", "expected", "raw", "error"]

    def ask(doc, number: int, images: list[bytes]) -> tuple:
        try:
            return doc, number, len(images), call(images), None
        except Exception as e:  # noqa: BLE001  the caller is remote
            return doc, number, len(images), None, f"{type(e).__name__}: {e}"

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        now, last, images = None, -1, []
        for rows in batches:
            out = []
            for doc, page, image in zip(rows["doc_id"].tolist(), rows["page_pos"].tolist(), rows["image"]):
                key = doc, page // batch
                if now is not None and doc == now[0] and page <= last:
                    raise ValueError(f"pages of {doc} don't come in order")
                if key != now:
                    if images:
                        out.append(ask(*now, images))
                    now, images = key, []
                last = page
                images.append(bytes(image))
            if out:
                yield pd.DataFrame(out, columns=names)
        if images:
            yield pd.DataFrame([ask(*now, images)], columns=names)

    return pages.select("doc_id", "page_pos", "image").mapInPandas(run, f"doc_id {kind}, batch_no int, expected int, raw string, error string")


def page_batches(pages: DataFrame, batch: int = schema.BATCH_PAGES) -> DataFrame:
    """(doc_id, batch_no, n_pages, first_page): how pages (doc_id, page_pos from 0) are dealt into requests."""
    return pages.groupBy("doc_id", F.floor(F.col("page_pos") / batch).cast("int").alias("batch_no")).agg(F.count("*").alias("n_pages"), F.min("page_pos").alias("first_page"))


def zipped(pages: DataFrame, replies: DataFrame) -> DataFrame:
    """Pages with the reply of their place in the batch (doc_id, batch_no, pos); what one side has more of is lost."""
    return pages.join(replies, ["doc_id", "batch_no", "pos"])


def mock_replies(pages: DataFrame, batch: int = schema.BATCH_PAGES) -> DataFrame:
    """(doc_id, page_pos, raw): deterministic replies; page numbers start again with each batch."""
    return pages.select("doc_id", "page_pos", ingest.mock_reply(F.col("page_pos") % batch).alias("raw"))


def gold(spark: SparkSession, path: str) -> DataFrame:
    """Verified gold documents, in the order of their file names."""
    rows = spark.read.schema(schema.GOLD).option("multiLine", True).json(path)
    return rows.withColumn("file", F.element_at(F.split(F.input_file_name(), "/"), -1)).where(F.coalesce("verified", F.lit(False))).orderBy("file")


def with_document(gold: DataFrame, files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Gold documents whose file is there, and those that are skipped."""
    names = files.select(F.element_at(F.split("path", "/"), -1).alias("source")).distinct()
    return gold.join(names, "source", "left_semi"), gold.join(names, "source", "left_anti")


def gold_template(items: DataFrame) -> DataFrame:
    """Documents (source, bill_items) as unverified gold rows for a person to correct."""
    return items.select("source", F.lit("Correct bill_items against the document, then set verified to true.").alias("_instructions"), F.lit(False).alias("verified"), "bill_items")


def labels(spark: SparkSession, path: str) -> DataFrame:
    """Saved labels of pages."""
    return spark.read.schema(schema.LABELLED_PAGE).option("multiLine", True).json(path)


def write_results(scores: DataFrame, path: str) -> None:
    """A results file as two folders of JSON: ``micro`` and ``per_document``; an error if nothing was scored."""
    one, each = scoring.results(scores)
    write_json(one, f"{path}/micro")
    write_json(each, f"{path}/per_document")


def required(rows: DataFrame, message: str) -> DataFrame:
    """``rows``; an error with the message if there are none (no gold, no labels, nothing verified)."""
    if rows.isEmpty():
        raise ValueError(message)
    return rows


def write_json(rows: DataFrame, path: str) -> None:
    """Results as JSON, replacing what was there."""
    rows.write.mode("overwrite").json(path)


#: Options by name: what spark.conf may say below ``spark.tallyframe.``, the type of a value and its default.
OPTIONS: dict[str, tuple[type, object]] = {
    "mock": (bool, True), "batchPages": (int, schema.BATCH_PAGES), "tolerancePct": (float, schema.TOLERANCE_PCT), "maxDocumentBytes": (int, MOST_BYTES),
    "hintChars": (int, 6000), "leastConfidence": (float, 35.0), "retries": (int, 5), "maxBackoffSeconds": (int, 8), "modelFallbacks": (list, []),
}


def options(spark: SparkSession) -> dict[str, object]:
    """All options with their values; a value that isn't of its type is an error."""

    def read(kind: type, text: str):
        if kind is bool:
            return text.strip().lower() in ("1", "true", "yes", "on")
        return [x.strip() for x in text.split(",") if x.strip()] if kind is list else kind(text)

    given = {name: spark.conf.get(f"spark.tallyframe.{name}", None) for name in OPTIONS}
    return {name: default if given[name] is None else read(kind, given[name]) for name, (kind, default) in OPTIONS.items()}


def health(spark: SparkSession) -> DataFrame:
    """One row on how this engine is set up."""
    found = options(spark)
    return spark.range(1).select(F.lit("ok").alias("status"), F.lit(found["mock"]).alias("mock"), F.lit(found["batchPages"]).alias("batch_pages"), F.lit(found["tolerancePct"]).alias("tolerance_pct"))
