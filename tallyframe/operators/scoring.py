"""Predicted items against gold items: one-to-one fuzzy matches, then precision and recall.

``gold``: doc_id, gi, item_name, item_amount; ``pred``: doc_id, pi, item_name, item_amount.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalars import exact, normalised, ratio, rounded
from tallyframe.functions.similarity import block_ratio

#: Least similarity of names; share of the gold amount by which a prediction may be off.
NAME_THRESHOLD, AMOUNT_SHARE, AMOUNT_FLOOR = 0.80, 0.01, 0.01


def near(gold: Column, pred: Column) -> Column:
    """Relative to the gold amount alone, and one hundredth at least."""
    g, p = F.coalesce(gold, F.lit(0.0)), F.coalesce(pred, F.lit(0.0))
    return F.abs(g - p) <= F.greatest(AMOUNT_SHARE * F.abs(g), F.lit(AMOUNT_FLOOR))


def candidates(gold: DataFrame, pred: DataFrame, threshold: float = NAME_THRESHOLD) -> DataFrame:
    """(doc_id, gi, pi, similarity): pairs of a document whose amounts and names agree.

    The cheap test on amounts runs inside the join by doc_id; names are compared after it,
    and equal normalised names without Python.
    """
    g = gold.select("doc_id", "gi", normalised("item_name").alias("gold_name"), F.col("item_amount").alias("gold_amount"))
    p = pred.select(F.col("doc_id").alias("pred_doc"), "pi", normalised("item_name").alias("pred_name"), F.col("item_amount").alias("pred_amount"))
    pairs = g.join(p, (F.col("doc_id") == F.col("pred_doc")) & near(F.col("gold_amount"), F.col("pred_amount"))).select("doc_id", "gi", "pi", "gold_name", "pred_name")
    same = pairs.where(F.col("gold_name") == F.col("pred_name")).withColumn("similarity", F.lit(1.0))
    rest = pairs.where(F.col("gold_name") != F.col("pred_name")).withColumn("similarity", block_ratio("gold_name", "pred_name")).where(F.col("similarity") >= threshold)
    return same.unionByName(rest).select("doc_id", "gi", "pi", "similarity")


def greedy(pairs: DataFrame) -> DataFrame:
    """(doc_id, gi, pi, similarity): the best pair first, ties to the highest gi, then pi; no item twice.

    The choice within a document is sequential, so pairs come to Python by document, best
    first, many documents to a batch; what is kept from batch to batch is one document's.
    """
    names = ["doc_id", "gi", "pi", "similarity"]

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        doc, gold, pred = None, set(), set()
        for rows in batches:
            keep = []
            for k, (d, g, p) in enumerate(zip(rows["doc_id"].tolist(), rows["gi"].tolist(), rows["pi"].tolist())):
                if d != doc:
                    doc, gold, pred = d, set(), set()
                if g not in gold and p not in pred:
                    gold.add(g)
                    pred.add(p)
                    keep.append(k)
            yield rows.iloc[keep]

    best = [F.col("doc_id"), F.desc("similarity"), F.desc("gi"), F.desc("pi")]
    return pairs.select(*names).repartition("doc_id").sortWithinPartitions(*best).mapInPandas(choose, pairs.select(*names).schema)


def missed(gold: DataFrame, matches: DataFrame) -> DataFrame:
    return gold.join(matches, ["doc_id", "gi"], "left_anti")


def spurious(pred: DataFrame, matches: DataFrame) -> DataFrame:
    return pred.join(matches, ["doc_id", "pi"], "left_anti")


def exact_matches(gold: DataFrame, pred: DataFrame) -> DataFrame:
    """(doc_id, name, amount, n): the multiset intersection of equal names and amounts."""
    key = ["doc_id", "name", "amount"]
    count = lambda df, n: df.select("doc_id", normalised("item_name").alias("name"), exact("item_amount").alias("amount")).groupBy(*key).agg(F.count("*").alias(n))
    return count(gold, "n_gold").join(count(pred, "n_pred"), key).select(*key, F.least("n_gold", "n_pred").alias("n"))


def rates(tp: Column, fn: Column, fp: Column) -> dict[str, Column]:
    """Precision, recall and their harmonic mean; 0 where there is nothing to divide by."""
    p, r = ratio(tp, tp + fp), ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))}


def scored(gold: DataFrame, pred: DataFrame, matches: DataFrame, examples: int = 5) -> DataFrame:
    """One row per document of gold or pred: counts, rates, totals and first examples of what didn't match.

    Items of both sides are one table, which meets the matches once.
    """
    side = lambda df, name, at: df.select("doc_id", F.lit(name).alias("side"), F.col(at).cast("bigint").alias("at"), "item_name", exact("item_amount").alias("amount"))
    items = side(gold, "gold", "gi").unionByName(side(pred, "pred", "pi"))
    ends = F.array(*(F.struct(F.lit(name).alias("side"), F.col(at).cast("bigint").alias("at")) for name, at in (("gold", "gi"), ("pred", "pi"))))
    hits = matches.select("doc_id", F.explode(ends).alias("end")).select("doc_id", "end.*", F.lit(True).alias("hit"))
    rows = items.join(hits, ["doc_id", "side", "at"], "left")

    def of(name: str) -> list[Column]:
        mine, left = F.col("side") == name, F.col("hit").isNull()
        first = F.slice(F.array_sort(F.collect_list(F.when(mine & left, F.struct("at", "item_name")))), 1, examples)["item_name"]
        return [F.count_if(mine).alias(f"{name}_items"), F.coalesce(F.sum(F.when(mine, F.col("amount"))), F.lit(0)).cast("double").alias(f"{name}_total"), first.alias(f"{name}_left")]

    rows = rows.groupBy("doc_id").agg(*of("gold"), *of("pred"), F.count_if((F.col("side") == "gold") & F.col("hit").isNotNull()).alias("matched"))
    rows = rows.withColumns({"missed": F.col("gold_items") - F.col("matched"), "spurious": F.col("pred_items") - F.col("matched")})
    error = F.when(F.col("gold_total") != 0, rounded(F.abs(F.col("pred_total") - F.col("gold_total")) / F.col("gold_total") * 100))
    return rows.select(
        "doc_id", "gold_items", "pred_items", "matched", "missed", "spurious", *[rounded(c, 4).alias(n) for n, c in rates(F.col("matched"), F.col("missed"), F.col("spurious")).items()],
        "gold_total", "pred_total", error.alias("total_abs_pct_error"), F.col("gold_left").alias("missed_examples"), F.col("pred_left").alias("spurious_examples"),
    )


def with_signal(scores: DataFrame, documents: DataFrame) -> DataFrame:
    """``scores`` with ``source`` and ``reconciles``, from documents (doc_id, source, matches); both null where a document isn't known."""
    return scores.join(documents.select("doc_id", "source", F.col("matches").alias("reconciles")), "doc_id", "left")


def micro(scores: DataFrame) -> DataFrame:
    """Documents, counts over all of them, and the rates of the sums."""
    total = scores.agg(F.count("*").alias("documents"), *(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in ("matched", "missed", "spurious")))
    return total.select("*", *[rounded(c, 4).alias(n) for n, c in rates(F.col("matched"), F.col("missed"), F.col("spurious")).items()])


def by_verdict(scores: DataFrame) -> DataFrame:
    """Mean f1 of documents that reconcile and of those that don't (``reconciles``); null verdicts count for neither."""
    on = F.col("reconciles")
    return scores.agg(F.count_if(on).alias("n_reconciled"), F.count_if(~on).alias("n_not_reconciled"), F.avg(F.when(on, F.col("f1"))).alias("f1_reconciled"), F.avg(F.when(~on, F.col("f1"))).alias("f1_not_reconciled"))


def report(scores: DataFrame) -> DataFrame:
    """(source, line): a line of a report for each document of ``with_signal``."""
    line = F.format_string("  %-28s F1 %.3f  (+%d -%d ~%d)  total err %s%%", "source", rounded("f1", 3), "matched", "missed", "spurious", F.coalesce(F.col("total_abs_pct_error").cast("string"), F.lit("None")))
    return scores.select("source", line.alias("line"))


def results(scores: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The two parts of a results file: one row of micro averages, and a row per document; an error if nothing was scored."""
    if scores.isEmpty():
        raise ValueError("nothing scored")
    return micro(scores).select("precision", "recall", "f1", "documents"), scores
