"""Page labels: histograms, the majority baseline, leakage-safe splits, accuracy."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scalars import first_contained
from tallyframe.schema import PAGE_TYPES


def from_digits(digits: str | Column, options: tuple[str, ...] = PAGE_TYPES) -> Column:
    """An array of labels from white-space separated groups of digits, 1 being the first option; any other digit is an error."""
    text = F.lit(digits) if isinstance(digits, str) else digits
    each = F.filter(F.split(text, r"\s+"), lambda x: x != "")
    bad = F.raise_error(F.lit("a label digit out of range"))
    named = F.array(*map(F.lit, options))
    return F.transform(each, lambda x: F.when((x.try_cast("int") >= 1) & (x.try_cast("int") <= len(options)), F.element_at(named, x.try_cast("int"))).otherwise(bad.cast("string")))


def numbered(pages: DataFrame, digits: str, options: tuple[str, ...] = PAGE_TYPES) -> DataFrame:
    """``pages`` (position from 0) with the label that a line of digits gives each; an error if there aren't as many digits as pages."""
    each, count = digits.split(), pages.count()
    if len(each) != count:
        raise ValueError(f"{len(each)} labels for {count} pages")
    given = pages.sparkSession.range(1).select(F.posexplode(from_digits(digits, options)).alias("position", "label"))
    return pages.join(given, "position")


def examples(rows: DataFrame, question: str) -> DataFrame:
    """(image_path, question, answer): what a model is trained on."""
    return rows.select("image_path", F.lit(question).alias("question"), F.col("label").alias("answer"))


def from_answer(answer: Column | str, options: tuple[str, ...] = PAGE_TYPES, default: str = "Other") -> Column:
    """The first option that a free-text answer contains."""
    return first_contained(answer, options, default)


def from_input(typed: Column, options: tuple[str, ...] = PAGE_TYPES) -> Column:
    """A typed digit, or an option's name in any case, else Other."""
    t = F.trim(typed)
    out = F.when(t.rlike(f"^[1-{len(options)}]$"), F.element_at(F.array(*map(F.lit, options)), t.try_cast("int")))
    for o in options:
        out = out.when(F.lower(t) == o.lower(), F.lit(o))
    return out.otherwise(F.lit("Other"))


def resumed(pages: DataFrame, saved: DataFrame) -> DataFrame:
    """Pages (key) with the labels saved before, null where there is none."""
    return pages.join(saved.select("key", "label"), "key", "left")


def histogram(rows: DataFrame) -> DataFrame:
    return rows.groupBy("label").agg(F.count("*").alias("n"))


def majority(rows: DataFrame) -> DataFrame:
    """(label, n, share) of the commonest label; of equally common ones that with the least ``position``."""
    counts = rows.groupBy("label").agg(F.count("*").alias("n"), F.min("position").alias("first"))
    total = counts.agg(F.sum("n").alias("all"), F.max_by(F.struct("label", "n"), F.struct("n", -F.col("first"))).alias("top"))
    return total.where("all > 0").select("top.label", "top.n", (F.col("top.n") / F.col("all")).alias("share"))


def groups_of(rows: DataFrame, aliases: DataFrame | None = None) -> DataFrame:
    """``rows`` with ``grp``: the document, or what its alias (document, alias) says it is part of."""
    if aliases is None:
        return rows.withColumn("grp", F.col("document"))
    return rows.join(aliases, "document", "left").withColumn("grp", F.coalesce("alias", "document")).drop("alias")


def split(rows: DataFrame, share: float = 0.3, seed: int = 42) -> DataFrame:
    """(grp, in_test): each group wholly on one side; the first ``max(1, round(share * groups))`` in seeded hash order are for tests.

    Groups fall into 4,096 ranges of their hashes; the counts of these (which are all that one
    task orders) say how many of a range are for tests, and groups are ranked within ranges.
    """
    groups = rows.select("grp").distinct().withColumn("hash", F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("grp").cast("string"), F.lit(""))).cast("binary"))).withColumn("part", F.substring("hash", 1, 3))
    parts = groups.groupBy("part").agg(F.count("*").alias("n"))
    so_far = parts.withColumn("before", F.sum("n").over(Window.orderBy("part")) - F.col("n")).withColumn("all", F.sum("n").over(Window.partitionBy()))
    # at most 4,096 rows
    cut = so_far.select("part", (F.greatest(F.lit(1), F.bround(F.col("all") * share)) - F.col("before")).alias("tests"))
    ranked = groups.withColumn("rank", F.row_number().over(Window.partitionBy("part").orderBy("hash", "grp")))
    return ranked.join(F.broadcast(cut), "part").select("grp", (F.col("rank") <= F.col("tests")).alias("in_test"))


def accuracy(rows: DataFrame) -> DataFrame:
    """(n, correct, accuracy) of ``label`` against ``predicted``."""
    right = F.col("label").eqNullSafe(F.col("predicted"))
    return rows.agg(F.count("*").alias("n"), F.count_if(right).alias("correct"), F.avg(right.cast("int")).alias("accuracy"))


def errors(rows: DataFrame) -> DataFrame:
    return rows.where(~F.col("label").eqNullSafe(F.col("predicted")))


def judgement(baseline: Column, before: Column, after: Column) -> Column:
    """What a trained classifier has shown against the majority class and against itself before."""
    return F.when(after <= baseline, "no better than the majority class").when(after > before, "training helped").otherwise("training didn't help")
