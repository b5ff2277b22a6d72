"""Tolerant parsing of model replies: JSON text to typed pages and items.

A typed JSON reader loses a whole page for one bad element, so replies become VARIANT
values and are coerced field by field.  A missing key is not a null: missing takes the
default, null becomes the text ``None``, as the model's clients expect.  What would stop
a client (items that are null, a reply that is no object) marks the page ``broken``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.functions.scalars import safe_float, trimmed, without_fences
from tallyframe.schema import DETAIL

#: Fixed value: an object with at most one level of objects inside.
OBJECT = r"\{[^{}]*(?:\{[^{}]*\}[^{}]*)?\}"


def _kind(v: Column) -> Column:
    """OBJECT<..>, ARRAY<..>, STRING, BIGINT, DECIMAL(..), DOUBLE, BOOLEAN, VOID; null for no value."""
    return F.schema_of_variant(v)


def parsed(text: Column) -> Column:
    """A reply as VARIANT; null if it isn't JSON from its first to its last character."""
    clean = without_fences(text)
    return _whole(_boxed(clean), clean)


def _boxed(clean: Column) -> Column:
    """A text as the only element of a JSON array."""
    return F.try_parse_json(F.concat(F.lit("["), clean, F.lit("]")))


def _whole(boxed: Column, clean: Column) -> Column:
    """That element, if it is the whole text.

    The lenient parser ignores what follows a value.  Inside an array only a comma or the
    bracket can follow one, inside an object only a comma or the brace, so a value that is
    whole in both, and alone in the array, has nothing behind it.
    """
    alone = F.try_variant_get(boxed, "$[1]", "variant").isNull() & F.try_parse_json(F.concat(F.lit('{"x":'), clean, F.lit("}"))).isNotNull()
    return F.when(alone, F.try_variant_get(boxed, "$[0]", "variant"))


def diagnostic(page_no: Column, raw: Column) -> Column:
    """What a page without items came as: the keys of its reply, or how it starts."""
    keys = F.transform(shape(raw), lambda k: F.concat(F.lit("'"), k, F.lit("'")))
    start, quote = F.substring(raw, 1, 80), F.lit("'")
    for plain, escaped in (("\\", "\\\\"), ("\n", "\\n"), ("\r", "\\r"), ("\t", "\\t")):
        start = F.replace(start, F.lit(plain), F.lit(escaped))
    double = F.contains(start, quote) & ~F.contains(start, F.lit('"'))
    start = F.when(double, F.concat(F.lit('"'), start, F.lit('"'))).otherwise(F.concat(quote, F.replace(start, quote, F.lit("\\'")), quote))
    return F.concat(F.lit("page "), page_no.cast("string"), F.coalesce(F.concat(F.lit(": keys=["), F.array_join(keys, ", "), F.lit("]")), F.concat(F.lit(": unparseable, starts "), start)))


def spelled(v: Column) -> Column:
    """Any JSON value as text, null and booleans the way clients print them."""
    kind = _kind(v)
    s = F.try_variant_get(v, "$", "string")
    return F.when(kind == "VOID", F.lit("None")).when(kind == "BOOLEAN", F.initcap(s)).otherwise(s)


def number(v: Column) -> Column:
    """A JSON value as a number, or null: numeric texts count, booleans are 0 and 1."""
    kind = _kind(v)
    plain = F.when(kind == "STRING", safe_float(F.try_variant_get(v, "$", "string"))).when(kind == "BOOLEAN", F.try_variant_get(v, "$", "boolean").cast("int").cast("double"))
    return plain.when(kind.startswith("ARRAY") | kind.startswith("OBJECT") | (kind == "VOID"), F.lit(None)).otherwise(F.try_variant_get(v, "$", "double"))


def amount(v: Column) -> Column:
    """0 for whatever counts as false (missing, null, 0, empty text, list or object, false); null for what is no number."""
    kind = _kind(v)
    text = F.try_variant_get(v, "$", "string")
    nothing = v.isNull() | (kind == "VOID") | ((kind == "STRING") & (text == "")) | (kind == "ARRAY<VOID>") & (text == "[]") | (kind == "OBJECT<>")
    return F.when(nothing, F.lit(0.0)).otherwise(number(v))


def pages(replies: DataFrame) -> DataFrame:
    """Typed page fields of replies (doc_id, page_pos, raw): page_no, page_type, printed_total, fraud_flags, items, broken.

    ``items`` stays VARIANT; ``items_of`` takes it apart.  A reply that isn't JSON is an
    empty page of type Other; so is one with a key twice or a bare NaN, which isn't JSON
    by its standard.  Flags that aren't a list are none.
    """
    # step by step, so that each is computed once a reply
    rows = replies.withColumn("clean", without_fences(F.col("raw"))).withColumn("boxed", _boxed(F.col("clean")))
    rows = rows.withColumn("value", _whole(F.col("boxed"), F.col("clean"))).withColumn("kind", _kind(F.col("value")))
    field = lambda k: F.try_variant_get("value", f"$.{k}", "variant")
    ok = F.coalesce(F.col("kind").startswith("OBJECT"), F.lit(False))
    items_kind = _kind(field("bill_items"))
    broken = F.col("kind").isNotNull() & (~ok | F.coalesce((items_kind == "VOID") | items_kind.isin("BIGINT", "BOOLEAN", "DOUBLE") | items_kind.startswith("DECIMAL"), F.lit(False)))
    position = (F.col("page_pos") + 1).cast("string")
    flags = F.filter(F.transform(F.coalesce(F.try_variant_get("value", "$.fraud_flags", "array<variant>"), F.array().cast("array<variant>")), spelled), lambda f: trimmed(f) != "")
    return rows.select(
        "doc_id", "page_pos", F.coalesce(F.when(ok, spelled(field("page_no"))), position).alias("page_no"),
        F.when(F.col("kind").isNull(), F.lit("Other")).otherwise(F.coalesce(F.when(ok, spelled(field("page_type"))), F.lit(DETAIL))).alias("page_type"),
        F.when(ok, number(field("printed_total"))).alias("printed_total"), flags.alias("fraud_flags"), F.when(ok, F.try_variant_get("value", "$.bill_items", "array<variant>")).alias("items"), broken.alias("broken"),
    )


def items_of(pages: DataFrame) -> DataFrame:
    """Typed items of ``pages``; an element that can't be coerced goes alone."""
    # the outer form: from the inner one Spark infers a filter that parses every reply again
    rows = pages.select("doc_id", "page_pos", F.posexplode_outer("items").alias("item_pos", "v")).where("v is not null")
    fields = {k: F.try_variant_get("v", f"$.{k}", "variant").alias(k) for k in ("item_name", "item_amount", "item_rate", "item_quantity")}
    parts = rows.select("doc_id", "page_pos", "item_pos", _kind(F.col("v")).alias("kind"), *fields.values())
    typed = parts.select(
        "doc_id", "page_pos", "item_pos", F.coalesce(spelled(F.col("item_name")), F.lit("Unknown")).alias("item_name"), amount(F.col("item_amount")).alias("item_amount"),
        number(F.col("item_rate")).alias("item_rate"), number(F.col("item_quantity")).alias("item_quantity"), F.col("kind").startswith("OBJECT").alias("is_object"),
    )
    return typed.where(F.col("is_object") & F.col("item_amount").isNotNull()).drop("is_object")


def split_batch(raw: Column, expected: Column) -> Column:
    """The replies of a batch, as texts: a list is taken as it is, whatever its length.

    An object with exactly one list as long as the batch is an envelope around it; any
    other object is the first page and the rest is empty; text that isn't JSON gives up
    the objects that can be found in it.
    """
    v = parsed(raw)
    return _split(v, _kind(v), without_fences(raw), expected)


def split_batches(batches: DataFrame) -> DataFrame:
    """``batches`` (raw, expected) with ``pages``, the array of ``split_batch``; each reply is parsed once."""
    rows = batches.withColumn("_clean", without_fences(F.col("raw"))).withColumn("_boxed", _boxed(F.col("_clean")))
    rows = rows.withColumn("_value", _whole(F.col("_boxed"), F.col("_clean"))).withColumn("_kind", _kind(F.col("_value")))
    return rows.withColumn("pages", _split(F.col("_value"), F.col("_kind"), F.col("_clean"), F.col("expected"))).drop("_clean", "_boxed", "_kind", "_value")


def _split(v: Column, kind: Column, clean: Column, expected: Column) -> Column:
    texts = lambda a: F.transform(a, lambda x: F.to_json(x))
    lists = F.filter(F.map_values(F.try_variant_get(v, "$", "map<string,variant>")), lambda x: _kind(x).startswith("ARRAY"))
    inner = F.try_variant_get(F.get(lists, F.lit(0)), "$", "array<variant>")
    envelope = (expected > 1) & (F.size(lists) == 1) & (F.size(inner) == expected)
    filled = lambda a: F.slice(F.concat(a, F.array_repeat(F.lit("{}"), expected)), F.lit(1), expected)
    found = F.regexp_extract_all(clean, F.lit(OBJECT), F.lit(0))
    return (
        F.when(kind.startswith("ARRAY"), texts(F.try_variant_get(v, "$", "array<variant>")))
        .when(kind.startswith("OBJECT") & envelope, texts(inner))
        .when(kind.startswith("OBJECT"), filled(F.array(F.to_json(v))))
        .otherwise(filled(found))
    )


def shape(raw: Column) -> Column:
    """Keys of a reply that is an object, for diagnostics."""
    return F.json_object_keys(without_fences(raw))


def mock_reply(page: Column) -> Column:
    """The deterministic reply for the page with this number within its batch (from 0)."""
    n = page + 1
    item = F.struct(F.format_string("Mock Item %d", n).alias("item_name"), (n * 100.0).alias("item_amount"), F.lit(100.0).alias("item_rate"), n.alias("item_quantity"))
    return F.to_json(F.struct(n.cast("string").alias("page_no"), F.lit(DETAIL).alias("page_type"), F.array(item).alias("bill_items"), F.array().cast("array<string>").alias("fraud_flags")))
