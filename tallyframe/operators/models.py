"""Choice among remote models, and what their errors mean."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.functions.scalars import contains_any

#: What marks an error as passing, and a model as specialised; the words in ``bucket`` are fixed, too.
TRANSIENT = ("quota", "rate limit", "429", "timeout", "deadline", "unavailable", "503", "500", "internal", "overloaded", "connection", "temporarily")
SPECIAL = ("tts", "image", "robotics", "computer-use", "deep-research", "lyria", "nano-banana", "omni", "antigravity", "customtools")
#: Seconds between tries double up to this.
MOST_BACKOFF, TRIES = 8, 5


def key_tail(key: Column) -> Column:
    """All that is shown of a key."""
    return F.concat(F.lit("..."), F.right(key, F.lit(4)))


def transient(message: Column) -> Column:
    """Worth another try."""
    return contains_any(F.lower(message), TRANSIENT)


def bucket(message: Column) -> Column:
    """retired, throttled, denied or failed, in this order."""
    low = F.lower(message)
    return (
        F.when(contains_any(low, ("no longer available", "not found", "404")), "retired")
        .when(contains_any(low, ("429", "quota", "exhausted")), "throttled").when(contains_any(low, ("403", "denied", "permission")), "denied").otherwise("failed")
    )


def needs_new_model(messages: Column) -> Column:
    """Any message says that a model isn't there."""
    return F.exists(messages, lambda m: F.contains(F.lower(m), F.lit("not found")) | F.contains(m, F.lit("404")))


def usable(catalogue: DataFrame) -> DataFrame:
    """Models (position, name, methods) that generate text, without the path before their name, with their tier."""
    name = F.element_at(F.split("name", "/", 2), -1)
    rows = catalogue.where(F.array_contains("methods", "generateContent")).withColumn("name", name)
    tier = F.when(F.contains("name", F.lit("flash")) & ~F.contains("name", F.lit("lite")), "flash").when(F.contains("name", F.lit("pro")), "pro")
    return rows.where(~contains_any("name", SPECIAL)).withColumn("tier", tier).where("tier is not null")


def ranked(models: DataFrame) -> DataFrame:
    """``usable`` models with ``rank`` within their tier: version, then released before preview, then latest aliases, then the catalogue's order."""
    version = F.coalesce(F.nullif(F.regexp_extract("name", r"gemini-(\d+(?:\.\d+)?)", 1), F.lit("")).try_cast("double"), F.lit(0.0))
    rows = models.withColumns({"version": version, "preview": F.contains("name", F.lit("preview")), "latest": F.endswith("name", F.lit("-latest"))})
    order = Window.partitionBy("tier").orderBy(F.desc("version"), F.asc("preview"), F.desc("latest"), F.asc("position"))
    return rows.withColumn("rank", F.row_number().over(order))


def suggested(models: DataFrame) -> DataFrame:
    """(role, name): the best of the cheap tier and two to fall back on; the best of the other tier if there is none."""
    best = Window.orderBy(F.col("tier") != "flash", "rank")
    rows = models.withColumn("place", F.row_number().over(best)).withColumn("flash", F.max((F.col("tier") == "flash").cast("int")).over(Window.partitionBy()))
    return rows.where((F.col("place") == 1) | ((F.col("tier") == "flash") & (F.col("place") <= 3))).select(F.when(F.col("place") == 1, "model").otherwise("fallback").alias("role"), "name", "place")


#: Models that are tried at most, and those that must work before no more are; characters shown of a reply and of an error.
MOST_PROBES, ENOUGH, REPLY_CHARS, ERROR_CHARS = 6, 3, 30, 110


def probes(models: DataFrame) -> DataFrame:
    """(place, name): ``ranked`` models in the order they are tried, the cheap tier first."""
    order = Window.orderBy(F.col("tier") != "flash", "rank")
    return models.withColumn("place", F.row_number().over(order)).where(F.col("place") <= MOST_PROBES).select("place", "name")


def probed(answers: DataFrame) -> DataFrame:
    """(place, name, outcome, shown) of tries (place, name, reply, error): what came, cut for display; none after enough have worked."""
    before = F.coalesce(F.count("reply").over(Window.orderBy("place").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    shown = F.coalesce(F.substring(F.translate(F.trim("reply"), "\n", " "), 1, REPLY_CHARS), F.substring("error", 1, ERROR_CHARS))
    rows = answers.withColumn("before", before).where(F.col("before") < ENOUGH)  # at most MOST_PROBES rows
    return rows.select("place", "name", F.when(F.col("reply").isNotNull(), "working").otherwise(bucket(F.col("error"))).alias("outcome"), shown.alias("shown"))


def chosen(outcomes: DataFrame) -> DataFrame:
    """(role, name): of ``probed`` models the first that works, and the two after it to fall back on."""
    place = F.row_number().over(Window.orderBy("place"))
    rows = outcomes.where("outcome = 'working'").withColumn("n", place).where(F.col("n") <= ENOUGH)
    return rows.select(F.when(F.col("n") == 1, "model").otherwise("fallback").alias("role"), "name")


def last_errors(attempts: DataFrame) -> DataFrame:
    """(batch, errors): of each model the last error, models in the order first tried, joined by bars."""
    each = attempts.groupBy("batch", "model").agg(F.max_by("error", "attempt").alias("error"), F.min("attempt").alias("first"))
    rows = F.array_sort(F.collect_list(F.struct("first", F.concat("model", F.lit(": "), "error").alias("text"))))
    return each.groupBy("batch").agg(F.concat_ws(" | ", F.transform(rows, lambda x: x["text"])).alias("errors"))


def token_usage(replies: DataFrame) -> DataFrame:
    """Sums over replies that came with metadata; a null count is 0."""
    add = lambda c: F.sum(F.coalesce(F.col(c), F.lit(0))).cast("bigint")
    out = replies.groupBy("doc_id").agg(add("input_tokens").alias("input_tokens"), add("output_tokens").alias("output_tokens"))
    return out.withColumn("total_tokens", F.col("input_tokens") + F.col("output_tokens"))
