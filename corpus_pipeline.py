"""A corpus from documents: toxic ones go, repeated passages go, one of each group of
near copies stays, contaminated ones go, and the rest is packed into sequences.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept; all
but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import decontaminate, line_dedup, ngram_join, packing, toxicity
from tallyframe.llm.store import drop, settle, spare, table, written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold; learned from the labels that aren't held out."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.clean(docs, model)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the blocks that an earlier one has; one that keeps no word goes."""
    lines, words = (spare(docs.columns, x) for x in ("lines_deleted", "words_deleted"))
    cut = line_dedup.apply(docs, lines_deleted=lines, words_deleted=words)
    emptied = (F.col(words) > 0) & ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    cut = cut.where(~emptied)
    if "n_chars" in docs.columns:
        cut = cut.withColumn("n_chars", F.when(F.col(lines) > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cut.select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8."""
    return ngram_join.distinct(docs, ngram_join.Settings(words=5, percent=80))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth is in windows of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row per piece of each document, with its place in a sequence."""
    return packing.pack(docs)


STAGES = [("toxicity", drop_toxic), ("line dedup", drop_repeated_lines), ("n-gram Jaccard join", drop_near_copies), ("benchmark decontamination", drop_contaminated), ("best-fit packing", pack)]

#: A trained network and document alignment are not for SQL; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each from the table that the one before wrote, which goes once it is read."""
    docs, last = table(spark, sf_dir, "documents"), None
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        if last is not None:
            drop(spark, last)
        settle(spark)
        last = docs
    return docs
