"""The registered queries over the retail tables, each with the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.functions import scalars
from tallyframe.operators import bills, ingest, intake, labels, models, ocr, scoring
from tallyframe.plans import fixture
from tallyframe.plans.fixture import MESSAGE, PAGE_PRINTED, PAGE_TYPE, REPLY
from tallyframe.sources import files

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a function under its name, with the SQL for its rows."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLES[f.__name__] = sql
        return f

    return add


R2 = "CAST(printf('%.2f', {}) AS DOUBLE)"
R4 = "CAST(printf('%.4f', {}) AS DOUBLE)"
_LINES = f"lines AS (SELECT l_orderkey AS doc_id, l_linenumber AS page_no, {PAGE_TYPE} AS page_type, l_extendedprice AS item_amount, CAST(l_extendedprice AS DECIMAL(18,2)) AS cents, l_quantity AS item_quantity, l_partkey, l_suppkey, l_returnflag, l_linestatus FROM lineitem)"
_ITEMS = f"{_LINES}, items AS (SELECT lines.*, p_name AS item_name FROM lines JOIN part ON p_partkey = l_partkey)"
_VERDICT = f"""totals AS (
    SELECT o_orderkey AS doc_id, CAST(coalesce(sum(CAST(l_extendedprice AS DECIMAL(18,2))) FILTER (WHERE l_linenumber <> 1), 0) AS DOUBLE) AS c,
           CASE WHEN any_value(o_orderstatus) <> 'P' AND any_value(o_totalprice) > 0 THEN any_value(o_totalprice) END AS p
    FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey),
  r1 AS (SELECT doc_id, {R2.format('c')} AS computed_total, {R2.format('p')} AS printed_total FROM totals),
  r2 AS (SELECT *, {R2.format('computed_total - printed_total')} AS difference FROM r1),
  r3 AS (SELECT *, CASE WHEN printed_total <> 0 THEN {R2.format('abs(difference) / printed_total * 100')} END AS pct_difference FROM r2),
  verdicts AS (SELECT *, CASE WHEN printed_total IS NOT NULL THEN coalesce(pct_difference <= 1.0, false) END AS matches FROM r3)"""
_NOTE = f"""CASE WHEN printed_total IS NULL THEN '{bills.NO_TOTAL}' WHEN matches THEN '{bills.MATCHED}'
    WHEN difference < 0 THEN 'Extracted total is ' || format('{{:,.2f}}', abs(difference)) || ' LOWER than printed - line items were likely missed, or the document is a partial excerpt.'
    ELSE 'Extracted total is ' || format('{{:,.2f}}', difference) || ' HIGHER than printed - likely double-counting, e.g. a summary page counted alongside detail pages.' END"""


# Bills


def _order_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums by order before the join with orders: both sides are dealt by the same key once."""
    sums = fixture.lines(spark, sf_dir).where("page_type <> 'Bill Summary'").groupBy("doc_id").agg(F.sum(scalars.exact("item_amount")).alias("total"))
    orders = fixture.table(spark, sf_dir, "orders")
    printed = F.when((F.col("o_orderstatus") != "P") & (F.col("o_totalprice") > 0), F.col("o_totalprice"))
    rows = orders.select(F.col("o_orderkey").alias("doc_id"), printed.alias("printed_total")).join(sums, "doc_id", "left")
    return rows.select("doc_id", F.coalesce("total", F.lit(0)).cast("double").alias("grand_total"), "printed_total")


@query(f"WITH {_VERDICT} SELECT doc_id, printed_total, computed_total, difference, pct_difference, matches, {_NOTE} AS note FROM verdicts")
def reconcile_bills(spark, sf_dir):
    """Every order's sum of lines against its price."""
    return bills.reconciled(_order_totals(spark, sf_dir))


@query(f"WITH {_VERDICT} SELECT CASE WHEN matches IS NULL THEN 'unknown' WHEN matches THEN 'match' WHEN difference < 0 THEN 'lower' ELSE 'higher' END AS verdict, count(*) AS n FROM verdicts GROUP BY 1")
def reconcile_summary(spark, sf_dir):
    verdict = F.when(F.col("matches").isNull(), "unknown").when(F.col("matches"), "match").when(F.col("difference") < 0, "lower").otherwise("higher")
    return reconcile_bills(spark, sf_dir).groupBy(verdict.alias("verdict")).agg(F.count("*").alias("n"))


@query(f"""WITH {_VERDICT} SELECT doc_id, CASE WHEN matches IS NULL THEN {_NOTE} WHEN matches THEN 'Verified ' || format('{{:,.2f}}', printed_total)
    ELSE 'Mismatch (' || CAST(pct_difference AS VARCHAR) || '%)' || CASE WHEN difference >= 0 THEN ' +' ELSE ' ' END || format('{{:,.2f}}', difference) END AS shown FROM verdicts""")
def verdict_display(spark, sf_dir):
    c = [F.col(x) for x in ("matches", "printed_total", "difference", "pct_difference", "note")]
    return reconcile_bills(spark, sf_dir).select("doc_id", bills.display(*c).alias("shown"))


_PAGES = f"""{_LINES}, pages AS (SELECT doc_id, page_no, page_type, count(*) AS n_items, sum(cents) AS total FROM lines GROUP BY ALL),
  marked AS (SELECT *, bool_or(page_type <> 'Bill Summary') OVER (PARTITION BY doc_id) AS has_detail FROM pages)"""


@query(f"WITH {_PAGES} SELECT doc_id, CAST(page_no AS VARCHAR) AS page_no, page_type, CASE WHEN has_detail AND page_type = 'Bill Summary' THEN 0 ELSE n_items END AS kept_items FROM marked")
def suppress_summary_pages(spark, sf_dir):
    return bills.suppressed(fixture.pages(spark, sf_dir)).select("doc_id", "page_no", "page_type", F.size("bill_items").cast("bigint").alias("kept_items"))


@query(f"WITH {_PAGES} SELECT doc_id, CAST(sum(n_items) AS BIGINT) AS total_item_count, CAST(coalesce(sum(total) FILTER (WHERE page_type <> 'Bill Summary'), 0) AS DOUBLE) AS grand_total FROM marked WHERE NOT has_detail GROUP BY doc_id")
def summary_only_totals(spark, sf_dir):
    """Documents of summary pages alone: items are counted and nothing is summed."""
    detail = fixture.lines(spark, sf_dir).where("page_type <> 'Bill Summary'").select("doc_id")
    rows = bills.totals(fixture.pages(spark, sf_dir).join(detail, "doc_id", "left_anti"))
    return rows.select("doc_id", F.col("total_item_count").cast("bigint").alias("total_item_count"), "grand_total")


@query(f"""WITH {_PAGES} SELECT doc_id, CAST(coalesce(sum(n_items) FILTER (WHERE page_type <> 'Bill Summary'), sum(n_items)) AS BIGINT) AS total_item_count,
    {R2.format("CAST(coalesce(sum(total) FILTER (WHERE page_type <> 'Bill Summary'), 0) AS DOUBLE)")} AS grand_total,
    (SELECT max(CASE WHEN x > 0 THEN x END) FROM (SELECT {PAGE_PRINTED} AS x FROM lineitem, orders o2 WHERE o2.o_orderkey = l_orderkey AND l_orderkey = marked.doc_id)) AS printed_total FROM marked GROUP BY doc_id""")
def document_totals(spark, sf_dir):
    return bills.totals(fixture.pages(spark, sf_dir)).select("doc_id", F.col("total_item_count").cast("bigint").alias("total_item_count"), scalars.rounded("grand_total").alias("grand_total"), "printed_total")


@query(f"WITH {_PAGES} SELECT doc_id, page_no, page_type, n_items FROM pages")
def page_item_counts(spark, sf_dir):
    return fixture.lines(spark, sf_dir).groupBy("doc_id", "page_no", "page_type").agg(F.count("*").alias("n_items"))


@query(f"WITH {_ITEMS} SELECT doc_id, CAST(page_no - 1 AS INTEGER) AS page_pos, item_name, item_amount, item_quantity FROM items WHERE page_type <> 'Bill Summary'")
def flatten_items(spark, sf_dir):
    return bills.items_of(fixture.pages(spark, sf_dir)).select("doc_id", "page_pos", "item_name", "item_amount", "item_quantity")


@query(f"WITH {_ITEMS} SELECT doc_id, item_name, count(*) AS n, CAST(sum(cents) AS DOUBLE) AS total FROM items GROUP BY doc_id, item_name HAVING count(*) > 1")
def repeated_items(spark, sf_dir):
    """Names that a document charges again: counted, never merged."""
    rows = fixture.items(spark, sf_dir).groupBy("doc_id", "item_name").agg(F.count("*").alias("n"), F.sum(scalars.exact("item_amount")).cast("double").alias("total"))
    return rows.where("n > 1")


@query(f"SELECT l_orderkey AS doc_id, max(CASE WHEN x > 0 THEN x END) AS printed_total FROM (SELECT l_orderkey, {PAGE_PRINTED} AS x FROM lineitem JOIN orders ON o_orderkey = l_orderkey) GROUP BY 1")
def printed_total_max(spark, sf_dir):
    return bills.totals(fixture.pages(spark, sf_dir)).select("doc_id", "printed_total")


_BATCHES = f"""{_LINES}, counted AS (SELECT doc_id, (page_no - 1) // 3 AS batch_no, count(*) AS n FROM lines GROUP BY ALL),
  batches AS (SELECT doc_id, batch_no, (doc_id + batch_no) % 3 = 0 AS failed, CASE WHEN (doc_id + batch_no) % 3 = 0 OR doc_id % 11 = 0 THEN 0 ELSE n END AS items, 100 * n AS tokens FROM counted),
  numbered AS (SELECT doc_id, page_no, row_number() OVER (PARTITION BY doc_id ORDER BY page_no) AS place, count(*) OVER (PARTITION BY doc_id) AS pages FROM (SELECT DISTINCT doc_id, page_no FROM lines)),
  shapes AS (SELECT doc_id, max(pages) AS pages, string_agg('page ' || page_no || CASE WHEN page_no % 2 = 0 THEN ': keys=[''page_type'', ''bill_items'']' ELSE ': unparseable, starts "no ''JSON'' here"' END, '; ' ORDER BY page_no) FILTER (WHERE place <= 6) AS seen FROM numbered GROUP BY doc_id),
  docs AS (SELECT doc_id, count(*) AS attempted, count(*) FILTER (WHERE failed) AS failed_batches, CAST(sum(items) AS BIGINT) AS items, CAST(sum(tokens) AS BIGINT) AS output_tokens, 'batch ' || max(batch_no) FILTER (WHERE failed) AS last_error FROM batches GROUP BY doc_id)"""


@query(f"""WITH {_BATCHES} SELECT doc_id, failed_batches <> attempted AS is_success, attempted, failed_batches, items, output_tokens,
    CASE WHEN failed_batches = attempted THEN 'Extraction failed: every request failed (' || failed_batches || '/' || attempted || ' batches). Last error -- ' || last_error
         WHEN failed_batches > 0 THEN failed_batches || ' of ' || attempted || ' page batches failed; results are incomplete. Last error -- ' || last_error
         WHEN items = 0 AND output_tokens > 0 THEN 'Model returned ' || format('{{:,}}', output_tokens) || ' output tokens but no line items parsed from any of ' || shapes.pages || ' page(s). Response shapes seen -- ' || seen || '. Try BATCH_SIZE=1: dense pages batched together are the usual cause.' END AS error FROM docs JOIN shapes USING (doc_id)""")
def document_status(spark, sf_dir):
    return bills.status(_outcomes(spark, sf_dir))


@query(f"WITH {_BATCHES} SELECT doc_id, CASE WHEN failed_batches = attempted THEN 'Extraction failed: ' || last_error WHEN failed_batches > 0 THEN last_error END AS banner FROM docs")
def result_banner(spark, sf_dir):
    """What stands above each result, by the last error of its requests."""
    rows = bills.status(_outcomes(spark, sf_dir)).withColumn("last", F.when(F.col("failed_batches") > 0, F.regexp_extract("error", "Last error -- (.*)$", 1)))
    return rows.select("doc_id", bills.banner(F.col("is_success"), F.col("last")).alias("banner"))


@query("SELECT c_custkey, '...' || right(c_name, 4) AS shown FROM customer")
def key_tails(spark, sf_dir):
    return fixture.table(spark, sf_dir, "customer").select("c_custkey", models.key_tail(F.col("c_name")).alias("shown"))


def _outcomes(spark, sf_dir):
    """Requests of three pages: every third fails, and documents of every eleventh order come without items, in two shapes."""
    rows = fixture.lines(spark, sf_dir).withColumn("batch_no", F.floor((F.col("page_no") - 1) / 3).cast("int")).withColumn("failed", (F.col("doc_id") + F.col("batch_no")) % 3 == 0)
    items = F.when(F.col("failed") | (F.col("doc_id") % 11 == 0), 0).otherwise(F.count("*"))
    raw = F.when(F.col("page_no") % 2 == 0, '```json\n{"page_type": "Other", "bill_items": []}\n```').otherwise("no 'JSON' here")
    seen = F.transform(F.sort_array(F.collect_set(F.struct("page_no", ingest.diagnostic(F.col("page_no"), raw).alias("text")))), lambda x: x["text"])
    batches = rows.groupBy("doc_id", "batch_no", "failed").agg(items.alias("items"), (100 * F.count("*")).alias("output_tokens"), F.count_distinct("page_no").alias("pages"), seen.alias("diagnostics"))
    return batches.withColumn("error", F.concat(F.lit("batch "), F.col("batch_no").cast("string")))


@query(f"""WITH {_LINES}, flags AS (SELECT doc_id, f, min(page_no) AS page FROM (SELECT doc_id, page_no, l_returnflag || l_linestatus AS f FROM lines) GROUP BY doc_id, f)
    SELECT doc_id, string_agg(f, '|' ORDER BY page, f) AS fraud_flags FROM flags GROUP BY doc_id""")
def ordered_distinct_flags(spark, sf_dir):
    """Flags of all pages in the order first seen."""
    pages = fixture.lines(spark, sf_dir).groupBy("doc_id", F.col("page_no").alias("page_pos")).agg(F.sort_array(F.collect_set(F.concat("l_returnflag", "l_linestatus"))).alias("fraud_flags"))
    return bills.flags_in_order(pages).select("doc_id", F.array_join("fraud_flags", "|").alias("fraud_flags"))


_NESTED = f"""WITH {_BATCHES},
  pages AS (SELECT doc_id, page_no, page_type, count(*) AS n_items, sum(cents) AS total FROM lines GROUP BY ALL),
  marked AS (SELECT *, bool_or(page_type <> 'Bill Summary') OVER (PARTITION BY doc_id) AS has_detail FROM pages),
  flags AS (SELECT doc_id, string_agg('"' || f || '"', ',' ORDER BY page, f) AS fraud_flags FROM (SELECT doc_id, l_returnflag || l_linestatus AS f, min(page_no) AS page FROM lines GROUP BY ALL) GROUP BY doc_id),
  t AS (SELECT doc_id, count(*) AS n_pages, arg_min(page_type, page_no) AS first_type, CAST(sum(CASE WHEN has_detail AND page_type = 'Bill Summary' THEN 0 ELSE n_items END) AS BIGINT) AS total_item_count,
      {R2.format("CAST(coalesce(sum(total) FILTER (WHERE page_type <> 'Bill Summary'), 0) AS DOUBLE)")} AS grand_total, max(CASE WHEN page_no % 3 = 1 AND o_orderstatus <> 'P' AND o_totalprice > 0 THEN {R2.format("o_totalprice")} END) AS printed
      FROM marked JOIN orders ON o_orderkey = doc_id GROUP BY doc_id),
  v AS (SELECT *, CASE WHEN printed <> 0 THEN {R2.format("abs(" + R2.format("grand_total - printed") + ") / printed * 100")} END AS pct FROM t)"""


@query(f"""{_NESTED} SELECT docs.doc_id, failed_batches <> attempted AS is_success, output_tokens + 7 AS total_tokens, CASE WHEN failed_batches = attempted THEN NULL ELSE n_pages END AS n_pages,
    CASE WHEN failed_batches <> attempted THEN first_type END AS first_type, CASE WHEN failed_batches <> attempted THEN total_item_count END AS total_item_count, CASE WHEN failed_batches <> attempted THEN grand_total END AS grand_total,
    CASE WHEN failed_batches <> attempted THEN printed END AS printed_total, CASE WHEN failed_batches <> attempted AND printed IS NOT NULL THEN coalesce(pct <= 1.0, false) END AS matches,
    CASE WHEN failed_batches <> attempted THEN '[' || fraud_flags || ']' END AS fraud_flags, failed_batches > 0 AS has_error FROM docs JOIN v USING (doc_id) JOIN flags USING (doc_id)""")
def document_responses(spark, sf_dir):
    """What the nested responses say, read back from their JSON."""
    outcomes = bills.status(_outcomes(spark, sf_dir)).withColumn("error", F.when(F.col("failed_batches") > 0, F.col("error"))).withColumn("input_tokens", F.lit(7))
    rows = bills.responses(fixture.pages(spark, sf_dir), outcomes)
    at = lambda path: F.get_json_object("response", f"$.{path}")
    return rows.select(
        "doc_id", at("is_success").cast("boolean").alias("is_success"), at("token_usage.total_tokens").cast("bigint").alias("total_tokens"),
        F.json_array_length(at("data.pagewise_line_items")).cast("bigint").alias("n_pages"), at("data.pagewise_line_items[0].page_type").alias("first_type"),
        at("data.total_item_count").cast("bigint").alias("total_item_count"), at("data.grand_total").cast("double").alias("grand_total"), at("data.reconciliation.printed_total").cast("double").alias("printed_total"),
        at("data.reconciliation.matches").cast("boolean").alias("matches"), at("data.fraud_flags").alias("fraud_flags"), at("error").isNotNull().alias("has_error"),
    )


@query(f"""WITH {_LINES}, x AS (SELECT *, item_amount / item_quantity AS r FROM lines)
    SELECT page_type, count(*) AS n, count(*) FILTER (WHERE abs(item_amount * (CASE WHEN l_partkey % 20 = 0 THEN 1.1 ELSE 1.0 END) - r * item_quantity) > greatest(abs(r * item_quantity) * 0.01, 0.01)) AS n_off FROM x GROUP BY page_type""")
def rate_quantity_checks(spark, sf_dir):
    """Extension: lines whose amount isn't rate times quantity; one part in twenty is charged a tenth too much."""
    rows = fixture.lines(spark, sf_dir).withColumn("item_rate", F.col("item_amount") / F.col("item_quantity"))
    rows = rows.withColumn("item_amount", F.col("item_amount") * F.when(F.col("l_partkey") % 20 == 0, 1.1).otherwise(1.0))
    return bills.fraud_checks(rows).groupBy("page_type").agg(F.count("*").alias("n"), F.count_if("off").alias("n_off"))


# Replies

_REPLIES = f"replies AS (SELECT event_id AS doc_id, event_id % 10 AS k, user_id, event_type, {REPLY} AS raw FROM events), clean AS (SELECT *, regexp_replace(regexp_replace(trim(raw), '^```(json)?\\s*', ''), '\\s*```$', '') AS j FROM replies), good AS (SELECT *, try_cast(j AS JSON) AS v FROM clean)"


@query(f"""WITH {_REPLIES} SELECT doc_id, CASE WHEN json_type(v, '$.page_no') IS NULL THEN '1' WHEN json_type(v, '$.page_no') = 'NULL' THEN 'None' ELSE v->>'$.page_no' END AS page_no,
    CASE WHEN v IS NULL THEN 'Other' WHEN json_type(v, '$.page_type') IS NULL THEN 'Bill Detail' WHEN json_type(v, '$.page_type') = 'NULL' THEN 'None' ELSE v->>'$.page_type' END AS page_type,
    try_cast(v->>'$.printed_total' AS DOUBLE) AS printed_total, CASE WHEN k = 0 THEN 'x|y' ELSE '' END AS fraud_flags, CAST(coalesce(json_array_length(v, '$.bill_items'), 0) AS INTEGER) AS n_items FROM good""")
def parse_page_json(spark, sf_dir):
    p = ingest.pages(fixture.replies(spark, sf_dir))
    return p.select("doc_id", "page_no", "page_type", "printed_total", F.array_join("fraud_flags", "|").alias("fraud_flags"), F.coalesce(F.size("items"), F.lit(0)).alias("n_items"))


@query(f"""WITH {_REPLIES}, e AS (SELECT doc_id, unnest(CAST(v->'$.bill_items' AS JSON[])) AS x, generate_subscripts(CAST(v->'$.bill_items' AS JSON[]), 1) - 1 AS item_pos FROM good WHERE v IS NOT NULL),
  t AS (SELECT *, json_type(x, '$.item_amount') AS ka, x->>'$.item_amount' AS a FROM e WHERE json_type(x) = 'OBJECT'),
  n AS (SELECT *, CASE WHEN ka IS NULL OR ka = 'NULL' OR a IN ('', 'false') THEN 0.0 WHEN a = 'true' THEN 1.0 ELSE try_cast(a AS DOUBLE) END AS item_amount FROM t)
  SELECT doc_id, CAST(item_pos AS INTEGER) AS item_pos, CASE WHEN json_type(x, '$.item_name') IS NULL THEN 'Unknown' WHEN json_type(x, '$.item_name') = 'NULL' THEN 'None' ELSE x->>'$.item_name' END AS item_name,
    item_amount, try_cast(x->>'$.item_rate' AS DOUBLE) AS item_rate, try_cast(x->>'$.item_quantity' AS DOUBLE) AS item_quantity FROM n WHERE item_amount IS NOT NULL""")
def parse_items_json(spark, sf_dir):
    return ingest.items_of(ingest.pages(fixture.replies(spark, sf_dir))).drop("page_pos")


_BATCH_REPLY = "CASE event_id % 5 WHEN 0 THEN concat('[{\"a\":', user_id, '},{\"a\":2}]') WHEN 1 THEN concat('{\"pages\":[{\"a\":', user_id, '},{\"a\":2},{\"a\":3}]}') WHEN 2 THEN concat('{\"a\":', user_id, '}') WHEN 3 THEN concat('first {\"a\":', user_id, '} then {\"b\":{\"c\":1}}') ELSE 'nothing' END"


@query("""SELECT event_id AS doc_id, unnest(range(0, CASE WHEN event_id % 5 = 0 THEN 2 ELSE 3 END))::INTEGER AS pos,
    unnest(CASE event_id % 5 WHEN 0 THEN ['{"a":' || user_id || '}', '{"a":2}'] WHEN 1 THEN ['{"a":' || user_id || '}', '{"a":2}', '{"a":3}'] WHEN 2 THEN ['{"a":' || user_id || '}', '{}', '{}']
           WHEN 3 THEN ['{"a":' || user_id || '}', '{"b":{"c":1}}', '{}'] ELSE ['{}', '{}', '{}'] END) AS page FROM events""")
def split_batch_reply(spark, sf_dir):
    """Batches of three: a list (one short), an envelope, a single page, text around objects, and nothing."""
    rows = fixture.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.expr(_BATCH_REPLY).alias("raw"))
    return ingest.split_batches(rows.withColumn("expected", F.lit(3))).select("doc_id", F.posexplode_outer("pages").alias("pos", "page")).where("page is not null")


@query("SELECT n_nationkey AS page_pos, CAST(n_nationkey % 3 + 1 AS VARCHAR) AS page_no, 'Mock Item ' || (n_nationkey % 3 + 1) AS item_name, CAST(100 * (n_nationkey % 3 + 1) AS DOUBLE) AS item_amount, CAST(100 AS DOUBLE) AS item_rate, CAST(n_nationkey % 3 + 1 AS DOUBLE) AS item_quantity FROM nation")
def mock_pages(spark, sf_dir):
    """Mock replies of a document with a page per nation, parsed like any others."""
    pages = fixture.table(spark, sf_dir, "nation").select(F.lit(0).alias("doc_id"), F.col("n_nationkey").alias("page_pos"))
    p = ingest.pages(files.mock_replies(pages))
    return ingest.items_of(p).join(p.select("page_pos", "page_no"), "page_pos").select("page_pos", "page_no", "item_name", "item_amount", "item_rate", "item_quantity")


@query("SELECT l_orderkey AS doc_id, (l_linenumber - 1) // 3 AS batch_no, count(DISTINCT l_linenumber) AS n_pages, min(l_linenumber) - 1 AS first_page FROM lineitem GROUP BY ALL")
def page_batches(spark, sf_dir):
    return files.page_batches(fixture.lines(spark, sf_dir).select("doc_id", (F.col("page_no") - 1).alias("page_pos")).distinct())


@query("SELECT event_id AS doc_id, CAST(CASE WHEN props LIKE '{%' THEN 'k' END AS VARCHAR) AS top_keys FROM events")
def reply_shapes(spark, sf_dir):
    return fixture.table(spark, sf_dir, "events").select(F.col("event_id").alias("doc_id"), F.array_join(ingest.shape(F.col("props")), ",").alias("top_keys"))


# Scores

_GOLD = f"""{_ITEMS}, gold AS (SELECT doc_id, item_name, item_amount, (l_partkey * 7 + l_suppkey * 3 + page_no) % 10 AS k FROM items WHERE page_type <> 'Bill Summary'),
  pred AS (SELECT doc_id, CASE k WHEN 3 THEN upper(item_name) || '.' WHEN 4 THEN substr(item_name, 1, length(item_name) - 1) || 'x' WHEN 5 THEN 'freight' ELSE item_name END AS item_name,
      CASE k WHEN 1 THEN item_amount + 0.01 WHEN 2 THEN item_amount + 5000 ELSE item_amount END AS item_amount FROM gold WHERE k <> 0),
  g AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(item_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, CAST(item_amount AS DECIMAL(18,2)) AS amount, count(*) AS n_gold FROM gold GROUP BY ALL),
  p AS (SELECT doc_id, trim(regexp_replace(regexp_replace(lower(item_name), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name, CAST(item_amount AS DECIMAL(18,2)) AS amount, count(*) AS n_pred FROM pred GROUP BY ALL)"""


def _sides(spark, sf_dir):
    return fixture.gold(spark, sf_dir), fixture.predicted(spark, sf_dir)


@query(f"WITH {_GOLD} SELECT doc_id, name, CAST(amount AS DOUBLE) AS amount, least(n_gold, n_pred) AS n FROM g JOIN p USING (doc_id, name, amount)")
def exact_item_match(spark, sf_dir):
    return scoring.exact_matches(*_sides(spark, sf_dir)).select("doc_id", "name", F.col("amount").cast("double").alias("amount"), "n")


_NAME = "trim(regexp_replace(regexp_replace(lower({}), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g'))"
#: Similarity by the definition of matching blocks (the longest common run, the first of equally long ones, then the same on either side), and matches one by one.
_FUZZY = f"""WITH RECURSIVE {_ITEMS}, gi AS (SELECT doc_id, item_name, item_amount, page_no * 1000000000000::BIGINT + l_partkey * 1000000 + l_suppkey AS gi, (l_partkey * 7 + l_suppkey * 3 + page_no) % 10 AS k FROM items WHERE page_type <> 'Bill Summary'),
  pi AS (SELECT doc_id, gi AS pi, CASE k WHEN 3 THEN upper(item_name) || '.' WHEN 4 THEN substr(item_name, 1, length(item_name) - 1) || 'x' WHEN 5 THEN 'freight' ELSE item_name END AS item_name, CASE k WHEN 1 THEN item_amount + 0.01 WHEN 2 THEN item_amount + 5000 ELSE item_amount END AS item_amount FROM gi WHERE k <> 0),
  near AS (SELECT doc_id, gi, pi, {_NAME.format('g.item_name')} AS a, {_NAME.format('p.item_name')} AS b FROM gi g JOIN pi p USING (doc_id) WHERE abs(g.item_amount - p.item_amount) <= greatest(0.01 * abs(g.item_amount), 0.01)),
  pairs AS (SELECT DISTINCT a, b FROM near WHERE a <> b),
  cells AS (SELECT a, b, i, j, (SELECT coalesce(max(n), 0) FROM unnest(range(1, least(length(a) - i, length(b) - j) + 2)) t(n) WHERE substr(a, i, n) = substr(b, j, n)) AS run FROM (SELECT a, b, i, unnest(range(1, length(b) + 1)) AS j FROM (SELECT a, b, unnest(range(1, length(a) + 1)) AS i FROM pairs)) WHERE substr(a, i, 1) = substr(b, j, 1)),
  parts AS (SELECT a, b, 1::BIGINT AS i0, length(a) + 1 AS i1, 1::BIGINT AS j0, length(b) + 1 AS j1, 0::BIGINT AS size FROM pairs
    UNION ALL
    SELECT a, b, CASE side WHEN 0 THEN i0 ELSE i + n END, CASE side WHEN 0 THEN i ELSE i1 END, CASE side WHEN 0 THEN j0 ELSE j + n END, CASE side WHEN 0 THEN j ELSE j1 END, CASE side WHEN 0 THEN n ELSE 0 END
    FROM (SELECT a, b, i0, i1, j0, j1, best.i AS i, best.j AS j, best.n AS n, unnest([0, 1]) AS side
      FROM (SELECT a, b, i0, i1, j0, j1, max_by({{'i': i, 'j': j, 'n': least(run, i1 - i, j1 - j)}}, least(run, i1 - i, j1 - j) * 1000000 - i * 1000 - j) AS best FROM parts JOIN cells USING (a, b) WHERE i >= i0 AND i < i1 AND j >= j0 AND j < j1 GROUP BY a, b, i0, i1, j0, j1))),
  ratios AS (SELECT a, b, 2.0::DOUBLE * sum(size) / (length(a) + length(b)) AS similarity FROM parts GROUP BY a, b),
  candidates AS (SELECT doc_id, gi, pi, CASE WHEN a = b THEN 1.0::DOUBLE ELSE similarity END AS similarity FROM near LEFT JOIN ratios USING (a, b) WHERE a = b OR similarity >= 0.8),
  lists AS (SELECT doc_id, list({{'gi': gi, 'pi': pi, 's': similarity}} ORDER BY similarity DESC, gi DESC, pi DESC) AS c, count(*) AS n FROM candidates GROUP BY doc_id),
  steps AS (SELECT doc_id, c, n, 0::BIGINT AS k, []::BIGINT[] AS gs, []::BIGINT[] AS ps, NULL::BIGINT AS gi, NULL::BIGINT AS pi, NULL::DOUBLE AS similarity FROM lists
    UNION ALL
    SELECT doc_id, c, n, k + 1, CASE WHEN free THEN list_append(gs, x.gi) ELSE gs END, CASE WHEN free THEN list_append(ps, x.pi) ELSE ps END, CASE WHEN free THEN x.gi END, CASE WHEN free THEN x.pi END, CASE WHEN free THEN x.s END
    FROM (SELECT *, c[k + 1] AS x, NOT list_contains(gs, c[k + 1].gi) AND NOT list_contains(ps, c[k + 1].pi) AS free FROM (SELECT doc_id, c, n, k, gs, ps FROM steps WHERE k < n))),
  matches AS (SELECT doc_id, gi, pi, similarity FROM steps WHERE gi IS NOT NULL),
  gl AS (SELECT gi.*, m.gi IS NULL AS lone FROM gi LEFT JOIN matches m USING (doc_id, gi)), pl AS (SELECT pi.*, m.pi IS NULL AS lone FROM pi LEFT JOIN matches m USING (doc_id, pi)),
  gs AS (SELECT doc_id, count(*) AS ng, count(*) FILTER (WHERE NOT lone) AS tp, CAST(sum(CAST(item_amount AS DECIMAL(18,2))) AS DOUBLE) AS gt, array_to_string((list(item_name ORDER BY gi) FILTER (WHERE lone))[1:5], '|') AS ge FROM gl GROUP BY doc_id),
  ps AS (SELECT doc_id, count(*) AS np, CAST(sum(CAST(item_amount AS DECIMAL(18,2))) AS DOUBLE) AS pt, array_to_string((list(item_name ORDER BY pi) FILTER (WHERE lone))[1:5], '|') AS pe FROM pl GROUP BY doc_id),
  counts AS (SELECT doc_id, ng AS gold_items, coalesce(np, 0) AS pred_items, tp AS matched, ng - tp AS missed, coalesce(np, 0) - tp AS spurious, gt AS gold_total, coalesce(pt, 0) AS pred_total, coalesce(ge, '') AS missed_examples, coalesce(pe, '') AS spurious_examples FROM gs LEFT JOIN ps USING (doc_id)),
  r AS (SELECT *, coalesce(CAST(matched AS DOUBLE) / nullif(matched + spurious, 0), 0) AS p_, coalesce(CAST(matched AS DOUBLE) / nullif(matched + missed, 0), 0) AS r_ FROM counts),
  scores AS (SELECT doc_id, gold_items, pred_items, matched, missed, spurious, {R4.format('p_')} AS "precision", {R4.format('r_')} AS recall, {R4.format('coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0)')} AS f1,
      gold_total, pred_total, CASE WHEN gold_total <> 0 THEN {R2.format('abs(pred_total - gold_total) / gold_total * 100')} END AS total_abs_pct_error, missed_examples, spurious_examples FROM r)"""


@query(f"{_FUZZY} SELECT doc_id, gi, item_name, item_amount FROM gl WHERE lone")
def missed_items(spark, sf_dir):
    gold, pred = _sides(spark, sf_dir)
    return scoring.missed(gold, scoring.greedy(scoring.candidates(gold, pred))).select("doc_id", "gi", "item_name", "item_amount")


@query(f"{_FUZZY} SELECT doc_id, pi, item_name, item_amount FROM pl WHERE lone")
def spurious_items(spark, sf_dir):
    gold, pred = _sides(spark, sf_dir)
    return scoring.spurious(pred, scoring.greedy(scoring.candidates(gold, pred))).select("doc_id", "pi", "item_name", "item_amount")


@query(f"{_FUZZY} SELECT * FROM candidates")
def fuzzy_candidates(spark, sf_dir):
    return scoring.candidates(*_sides(spark, sf_dir))


@query(f"{_FUZZY} SELECT * FROM matches")
def greedy_item_match(spark, sf_dir):
    return scoring.greedy(fuzzy_candidates(spark, sf_dir))


def _scores(spark, sf_dir):
    gold, pred = _sides(spark, sf_dir)
    return scoring.scored(gold, pred, scoring.greedy(scoring.candidates(gold, pred)))


@query(f"{_FUZZY} SELECT * FROM scores")
def score_documents(spark, sf_dir):
    """Lists of examples as texts."""
    return _scores(spark, sf_dir).withColumns({c: F.array_join(c, "|") for c in ("missed_examples", "spurious_examples")})


_MICRO = """SELECT count(*) AS documents, CAST(coalesce(sum(matched), 0) AS BIGINT) AS matched, CAST(coalesce(sum(missed), 0) AS BIGINT) AS missed, CAST(coalesce(sum(spurious), 0) AS BIGINT) AS spurious FROM scores"""
_MICRO_RATES = f"""micro AS ({_MICRO}), mr AS (SELECT *, coalesce(CAST(matched AS DOUBLE) / nullif(matched + spurious, 0), 0) AS p_, coalesce(CAST(matched AS DOUBLE) / nullif(matched + missed, 0), 0) AS r_ FROM micro),
  mi AS (SELECT documents, matched, missed, spurious, {R4.format('p_')} AS "precision", {R4.format('r_')} AS recall, {R4.format('coalesce(2 * p_ * r_ / nullif(p_ + r_, 0), 0)')} AS f1 FROM mr)"""


@query(f"{_FUZZY}, {_MICRO_RATES} SELECT * FROM mi")
def micro_scores(spark, sf_dir):
    return scoring.micro(_scores(spark, sf_dir))


def _signal(spark, sf_dir):
    known = reconcile_bills(spark, sf_dir).select("doc_id", F.concat(F.lit("bill_"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("source"), "matches")
    return scoring.with_signal(_scores(spark, sf_dir), known)


@query(f"{_FUZZY}, {_VERDICT} SELECT doc_id, 'bill_' || doc_id || '.pdf' AS source, f1, matches AS reconciles FROM scores JOIN verdicts USING (doc_id)")
def scores_with_signal(spark, sf_dir):
    return _signal(spark, sf_dir).select("doc_id", "source", "f1", "reconciles")


@query(f"{_FUZZY} SELECT 'bill_' || doc_id || '.pdf' AS source, printf('  %-28s F1 %.3f  (+%d -%d ~%d)  total err %s%%', 'bill_' || doc_id || '.pdf', f1, matched, missed, spurious, coalesce(CAST(total_abs_pct_error AS VARCHAR), 'None')) AS line FROM scores")
def scoring_report(spark, sf_dir):
    return scoring.report(_signal(spark, sf_dir))


@query(f"{_FUZZY}, {_MICRO_RATES} SELECT 'micro' AS part, NULL AS doc_id, documents, \"precision\", recall, f1 FROM mi UNION ALL SELECT 'per_document', doc_id, NULL, \"precision\", recall, f1 FROM scores")
def scoring_results(spark, sf_dir):
    """Both parts of a results file."""
    one, each = scoring.results(_scores(spark, sf_dir))
    rates = ["precision", "recall", "f1"]
    return one.select(F.lit("micro").alias("part"), F.lit(None).cast("bigint").alias("doc_id"), "documents", *rates).unionByName(each.select(F.lit("per_document").alias("part"), "doc_id", F.lit(None).cast("bigint").alias("documents"), *rates))


_EXACT = f"""{_GOLD}, m AS (SELECT doc_id, sum(least(n_gold, n_pred)) AS tp FROM g JOIN p USING (doc_id, name, amount) GROUP BY doc_id),
  c AS (SELECT doc_id, sum(n_gold) AS n FROM g GROUP BY doc_id), d AS (SELECT doc_id, sum(n_pred) AS n FROM p GROUP BY doc_id),
  s AS (SELECT c.doc_id, coalesce(tp, 0) AS tp, c.n - coalesce(tp, 0) AS fn, coalesce(d.n, 0) - coalesce(tp, 0) AS fp FROM c LEFT JOIN d USING (doc_id) LEFT JOIN m USING (doc_id)),
  f AS (SELECT doc_id, CAST(tp AS BIGINT) AS tp, CAST(fn AS BIGINT) AS fn, CAST(fp AS BIGINT) AS fp, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fp AS DOUBLE), 0), 0) AS pr, coalesce(CAST(tp AS DOUBLE) / nullif(CAST(tp + fn AS DOUBLE), 0), 0) AS re FROM s),
  scores AS (SELECT doc_id, tp, fn, fp, {R4.format('pr')} AS "precision", {R4.format('re')} AS recall, {R4.format('coalesce(2 * pr * re / nullif(pr + re, 0), 0)')} AS f1 FROM f)"""


def _exact_scores(spark, sf_dir):
    """Rates by equal names and amounts: what fuzzy matching is at similarity 1 and no tolerance."""
    gold, pred = _sides(spark, sf_dir)
    count = lambda df, n: df.groupBy("doc_id").agg(F.count("*").alias(n))
    hits = scoring.exact_matches(gold, pred).groupBy("doc_id").agg(F.sum("n").alias("tp"))
    rows = count(gold, "ng").join(count(pred, "np"), "doc_id", "left").join(hits, "doc_id", "left").fillna(0, ["np", "tp"])
    rows = rows.select("doc_id", "tp", (F.col("ng") - F.col("tp")).alias("fn"), (F.col("np") - F.col("tp")).alias("fp"))
    return rows.select("*", *[scalars.rounded(c, 4).alias(n) for n, c in scoring.rates(F.col("tp"), F.col("fn"), F.col("fp")).items()])


@query(f"WITH {_EXACT} SELECT * FROM scores")
def exact_scores(spark, sf_dir):
    return _exact_scores(spark, sf_dir)


@query(f"""{_FUZZY}, {_VERDICT} SELECT count(*) FILTER (WHERE matches) AS n_reconciled, count(*) FILTER (WHERE NOT matches) AS n_not_reconciled,
    {R4.format('CAST(avg(CAST(f1 AS DECIMAL(18,4))) FILTER (WHERE matches) AS DOUBLE)')} AS f1_reconciled, {R4.format('CAST(avg(CAST(f1 AS DECIMAL(18,4))) FILTER (WHERE NOT matches) AS DOUBLE)')} AS f1_not_reconciled FROM scores JOIN verdicts USING (doc_id)""")
def f1_by_reconciliation(spark, sf_dir):
    """Whether the label-free verdict agrees with fuzzy matching against gold."""
    out = scoring.by_verdict(_signal(spark, sf_dir).withColumn("f1", F.col("f1").cast("decimal(18,4)")))
    return out.select("n_reconciled", "n_not_reconciled", *[scalars.rounded(F.col(c).cast("double"), 4).alias(c) for c in ("f1_reconciled", "f1_not_reconciled")])


# Labels

_LABELS = "l AS (SELECT doc_id, list_extract(['Bill Summary', 'Bill Detail', 'Pharmacy Bill', 'Lab Bill', 'Other'], CAST(CASE WHEN quality = 1 THEN 2 ELSE 1 + doc_id % 5 END AS INTEGER)) AS label, CASE WHEN toxic = 1 THEN 'Other' WHEN doc_id % 7 = 0 THEN 'Lab Bill' ELSE 'Bill Detail' END AS predicted, source FROM labels JOIN documents USING (doc_id))"


def _labelled(spark, sf_dir):
    """Page labels from quality, predictions from toxicity, the source as the document a page is of."""
    rows = fixture.table(spark, sf_dir, "labels").join(fixture.table(spark, sf_dir, "documents").select("doc_id", F.col("source").alias("document")), "doc_id")
    digit = F.when(F.col("quality") == 1, F.lit(2)).otherwise((1 + F.col("doc_id") % 5).cast("int"))
    label = F.get(labels.from_digits(digit.cast("string")), F.lit(0))
    predicted = F.when(F.col("toxic") == 1, "Other").when(F.col("doc_id") % 7 == 0, "Lab Bill").otherwise("Bill Detail")
    return rows.select("doc_id", F.col("doc_id").alias("position"), "document", label.alias("label"), predicted.alias("predicted"))


@query(f"WITH {_LABELS} SELECT label, count(*) AS n FROM l GROUP BY label")
def label_histogram(spark, sf_dir):
    return labels.histogram(_labelled(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT label, n, CAST(n AS DOUBLE) / total AS share FROM (SELECT label, count(*) AS n, min(doc_id) AS f, sum(count(*)) OVER () AS total FROM l GROUP BY label) ORDER BY n DESC, f LIMIT 1")
def majority_baseline(spark, sf_dir):
    return labels.majority(_labelled(spark, sf_dir))


_SPLIT = f"""{_LABELS}, grp AS (SELECT doc_id, CASE source WHEN 'src3' THEN 'src2' ELSE source END AS grp FROM l),
  gr AS (SELECT grp, row_number() OVER (ORDER BY md5('42:' || grp), grp) AS r, count(*) OVER () AS n FROM (SELECT DISTINCT grp FROM grp)),
  sp AS (SELECT grp, r <= greatest(1, round_even(0.3 * n, 0)) AS in_test FROM gr)"""


def _split(spark, sf_dir):
    """Two sources are parts of one document."""
    aliases = spark.createDataFrame([("src3", "src2")], "document string, alias string")
    rows = labels.groups_of(_labelled(spark, sf_dir), aliases)
    return rows, labels.split(rows)


@query(f"WITH {_SPLIT} SELECT * FROM sp")
def group_split(spark, sf_dir):
    return _split(spark, sf_dir)[1]


@query(f"WITH {_SPLIT} SELECT count(*) FILTER (WHERE in_test) AS n_test, count(*) FILTER (WHERE NOT in_test) AS n_train, (SELECT count(*) FROM (SELECT grp FROM sp GROUP BY grp HAVING count(DISTINCT in_test) > 1)) AS shared_groups FROM grp JOIN sp USING (grp)")
def split_disjointness(spark, sf_dir):
    rows, split = _split(spark, sf_dir)
    test, train = rows.join(split.where("in_test"), "grp", "left_semi"), rows.join(split.where("in_test"), "grp", "left_anti")
    shared = test.select("grp").intersect(train.select("grp")).agg(F.count("*").alias("shared_groups"))
    return test.agg(F.count("*").alias("n_test")).crossJoin(train.agg(F.count("*").alias("n_train"))).crossJoin(shared)  # one row each


@query(f"WITH {_LABELS} SELECT count(*) AS n, count(*) FILTER (WHERE label = predicted) AS correct, avg(CAST(label = predicted AS INTEGER)) AS accuracy FROM l")
def classification_accuracy(spark, sf_dir):
    return labels.accuracy(_labelled(spark, sf_dir))


@query(f"WITH {_LABELS} SELECT doc_id, label, predicted FROM l WHERE label <> predicted")
def classification_errors(spark, sf_dir):
    return labels.errors(_labelled(spark, sf_dir)).select("doc_id", "label", "predicted")


@query(f"""WITH {_LABELS}, a AS (SELECT (SELECT max(n) FROM (SELECT count(*) AS n FROM l GROUP BY label)) / CAST(count(*) AS DOUBLE) AS baseline, avg(CAST(label = predicted AS INTEGER)) AS before, avg(CAST(label = (CASE WHEN doc_id % 10 = 0 THEN 'Other' ELSE label END) AS INTEGER)) AS after FROM l)
    SELECT CASE WHEN after <= baseline THEN 'no better than the majority class' WHEN after > before THEN 'training helped' ELSE 'training didn''t help' END AS judgement FROM a""")
def training_judgement(spark, sf_dir):
    rows = _labelled(spark, sf_dir)
    after = rows.withColumn("predicted", F.when(F.col("doc_id") % 10 == 0, "Other").otherwise(F.col("label")))
    one = labels.majority(rows).select(F.col("share").alias("b")).crossJoin(labels.accuracy(rows).select(F.col("accuracy").alias("x"))).crossJoin(labels.accuracy(after).select(F.col("accuracy").alias("y")))
    return one.select(labels.judgement(F.col("b"), F.col("x"), F.col("y")).alias("judgement"))


@query("SELECT d.doc_id, CASE WHEN quality IS NULL THEN NULL WHEN quality = 1 THEN 'Bill Detail' ELSE 'Other' END AS label FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def resume_labels(spark, sf_dir):
    """Every document with the label saved before, if any."""
    saved = fixture.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("key"), F.when(F.col("quality") == 1, "Bill Detail").otherwise("Other").alias("label"))
    return labels.resumed(fixture.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("key")), saved).select(F.col("key").alias("doc_id"), "label")


@query("SELECT count(quality) AS labelled, count(*) - count(quality) AS unlabelled FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id")
def label_progress(spark, sf_dir):
    return resume_labels(spark, sf_dir).agg(F.count("label").alias("labelled"), F.count_if(F.col("label").isNull()).alias("unlabelled"))


@query("SELECT conv_id, turn, CASE WHEN contains(lower(text), 'bill summary') THEN 'Bill Summary' WHEN contains(lower(text), 'bill detail') THEN 'Bill Detail' WHEN contains(lower(text), 'pharmacy bill') THEN 'Pharmacy Bill' WHEN contains(lower(text), 'lab bill') THEN 'Lab Bill' ELSE 'Other' END AS label FROM (SELECT conv_id, turn, CASE turn % 4 WHEN 0 THEN 'This is a Lab Bill or PHARMACY BILL. ' WHEN 1 THEN 'bill detail? ' ELSE '' END || text AS text FROM conversations)")
def label_from_text(spark, sf_dir):
    text = F.concat(F.when(F.col("turn") % 4 == 0, "This is a Lab Bill or PHARMACY BILL. ").when(F.col("turn") % 4 == 1, "bill detail? ").otherwise(""), F.col("text"))
    return fixture.table(spark, sf_dir, "conversations").select("conv_id", "turn", labels.from_answer(text).alias("label"))


@query("SELECT c_custkey, CASE WHEN c_custkey % 4 = 0 THEN list_extract(['Bill Summary', 'Bill Detail', 'Pharmacy Bill', 'Lab Bill', 'Other'], CAST(c_custkey % 5 + 1 AS INTEGER)) WHEN c_custkey % 4 = 1 THEN 'Lab Bill' ELSE 'Other' END AS label FROM customer")
def label_input(spark, sf_dir):
    typed = F.when(F.col("c_custkey") % 4 == 0, (F.col("c_custkey") % 5 + 1).cast("string")).when(F.col("c_custkey") % 4 == 1, " lab BILL").otherwise("whatever")
    return fixture.table(spark, sf_dir, "customer").select("c_custkey", labels.from_input(typed).alias("label"))


_QUESTION = "Which type of page is this?"


@query(f"WITH {_LABELS} SELECT doc_id || '.png' AS image_path, '{_QUESTION}' AS question, label AS answer FROM l")
def training_examples(spark, sf_dir):
    return labels.examples(_labelled(spark, sf_dir).withColumn("image_path", F.concat(F.col("doc_id").cast("string"), F.lit(".png"))), _QUESTION)


@query("SELECT n_nationkey AS position, n_name AS document, list_extract(['Bill Summary', 'Bill Detail', 'Pharmacy Bill', 'Lab Bill', 'Other'], CAST(n_nationkey * 3 % 5 + 1 AS INTEGER)) AS label FROM nation")
def numbered_labels(spark, sf_dir):
    """A page per nation and a line of digits."""
    pages = fixture.table(spark, sf_dir, "nation").select(F.col("n_nationkey").alias("position"), F.col("n_name").alias("document"))
    return labels.numbered(pages, " ".join(str(k * 3 % 5 + 1) for k in range(25))).select("position", "document", "label")


# Text

_WORDS = """words AS (SELECT doc_id AS page, i AS idx, w AS text, (i * 37 + doc_id * 11) % 120 - 10 AS conf, i // 40 AS block, i // 20 % 2 AS par, i // 10 % 2 AS line
    FROM (SELECT doc_id, unnest(string_split(text, ' ')) AS w, generate_subscripts(string_split(text, ' '), 1) - 1 AS i FROM documents)),
  kept AS (SELECT * FROM words WHERE regexp_replace(text, '\\s', '', 'g') <> '' AND conf >= 0)"""


def _words(spark, sf_dir):
    rows = fixture.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page"), F.posexplode(F.split("text", " ")).alias("idx", "text"))
    i = F.col("idx").cast("bigint")
    return rows.select("page", i.alias("idx"), "text", ((i * 37 + F.col("page") * 11) % 120 - 10).alias("conf"), F.floor(i / 40).alias("block"), F.floor(i / 20) % 2, F.floor(i / 10) % 2).toDF("page", "idx", "text", "conf", "block", "par", "line")


@query(f"WITH {_WORDS} SELECT page, block, par, line, count(*) AS n, string_agg(text, ' ' ORDER BY idx) AS text FROM kept GROUP BY page, block, par, line")
def ocr_lines(spark, sf_dir):
    return ocr.lines(_words(spark, sf_dir)).select("page", "block", "par", "line", "n", "text")


@query(f"WITH {_WORDS} SELECT page, CAST(sum(conf) AS DOUBLE) / count(*) AS mean_conf, CAST(sum(conf) AS DOUBLE) / count(*) >= 50 AS trusted FROM kept GROUP BY page")
def ocr_confidence_gate(spark, sf_dir):
    return ocr.confidence(_words(spark, sf_dir), least=50.0)


@query("SELECT conv_id, turn, text FROM conversations WHERE regexp_replace(text, '\\s', '', 'g') <> '' AND (conv_id * 37 + turn * 11) % 100 >= 50")
def trusted_lines(spark, sf_dir):
    """Lines of an engine that rates whole lines, from what was said."""
    found = fixture.table(spark, sf_dir, "conversations").select("conv_id", "turn", "text", ((F.col("conv_id") * 37 + F.col("turn") * 11) % 100 / 100).alias("confidence"))
    return ocr.trusted_lines(found).select("conv_id", "turn", "text")


@query(f"""WITH {_WORDS}, lines AS (SELECT page, block, par, line, string_agg(text, ' ' ORDER BY idx) AS text, sum(conf) AS c, count(*) AS n FROM kept GROUP BY page, block, par, line)
    SELECT page, CASE WHEN CAST(sum(c) AS DOUBLE) / sum(n) >= 50 THEN substr(regexp_replace(string_agg(text, chr(10) ORDER BY block, par, line), '^\\s+|\\s+$', '', 'g'), 1, 6000) ELSE '' END AS text FROM lines GROUP BY page""")
def ocr_page_text(spark, sf_dir):
    return ocr.page_text(_words(spark, sf_dir), least=50.0).select("page", "text")


@query("SELECT doc_id, CAST(i - 1 AS INTEGER) AS line_no, CAST(20 + 18 * (i - 1) AS INTEGER) AS y, substr(line, 1, 120) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents) WHERE i <= 80")
def text_page_lines(spark, sf_dir):
    return ocr.fallback_lines(fixture.table(spark, sf_dir, "documents"))


@query("SELECT p_partkey, trim(regexp_replace(regexp_replace(lower(p_name || ' -- ' || p_brand || '!'), '[^a-z0-9 ]', ' ', 'g'), '\\s+', ' ', 'g')) AS name FROM part")
def normalise_names(spark, sf_dir):
    return fixture.table(spark, sf_dir, "part").select("p_partkey", scalars.normalised(F.concat("p_name", F.lit(" -- "), "p_brand", F.lit("!"))).alias("name"))


@query("SELECT event_id, props AS reply FROM events")
def strip_fences(spark, sf_dir):
    fenced = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.concat(F.lit(" \t```"), "props", F.lit("```\n"))).otherwise(F.col("props"))
    return fixture.table(spark, sf_dir, "events").select("event_id", scalars.without_fences(fenced).alias("reply"))


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN value WHEN event_id % 4 = 2 THEN NULL ELSE CAST(event_id AS DOUBLE) * 1000 END AS number FROM events")
def safe_float(spark, sf_dir):
    text = F.expr("CASE event_id % 4 WHEN 0 THEN cast(value AS string) WHEN 1 THEN concat(' ', cast(value AS string), ' ') WHEN 2 THEN concat(cast(value AS string), 'd') ELSE concat(cast(event_id AS string), '_000') END")
    return fixture.table(spark, sf_dir, "events").select("event_id", scalars.safe_float(text).alias("number"))


@query("SELECT n_nationkey % 5 AS attempt, CAST(least(power(2, n_nationkey % 5), 8) AS DOUBLE) AS seconds FROM nation WHERE n_nationkey < 5")
def backoff_schedule(spark, sf_dir):
    return spark.range(models.TRIES).select(F.col("id").cast("int").alias("attempt"), scalars.backoff_seconds("id", models.MOST_BACKOFF).alias("seconds"))


@query("SELECT c_custkey, array_to_string([trim(x) for x in string_split(c_mktsegment || ' , ,' || c_name, ',') if trim(x) <> ''], '|') AS parts FROM customer")
def config_lists(spark, sf_dir):
    return fixture.table(spark, sf_dir, "customer").select("c_custkey", F.array_join(scalars.config_list(F.concat("c_mktsegment", F.lit(" , ,"), "c_name")), "|").alias("parts"))


@query("SELECT s_suppkey, CASE WHEN px < 100 THEN 'blank' WHEN abs(a) < 0.3 THEN 'straight' WHEN abs(a) > 15 THEN 'implausible' ELSE 'turn' END AS action, a AS angle FROM (SELECT s_suppkey, px, CASE WHEN x < -45 THEN 90 + x WHEN x > 45 THEN x - 90 ELSE x END AS a FROM (SELECT s_suppkey, s_suppkey * 13 % 300 AS px, CAST(s_suppkey * 7 % 181 - 90 AS DOUBLE) / 4 AS x FROM supplier))")
def deskew_gate(spark, sf_dir):
    rows = fixture.table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_suppkey") * 13 % 300).alias("px"), scalars.upright((F.col("s_suppkey") * 7 % 181 - 90).cast("double") / 4).alias("angle"))
    return rows.select("s_suppkey", ocr.skew_action(F.col("px"), F.col("angle")).alias("action"), "angle")


@query("SELECT page_id, to_base64(encode(html)) AS encoded FROM pages")
def encoded_content(spark, sf_dir):
    return fixture.table(spark, sf_dir, "pages").select("page_id", scalars.encoded("html").alias("encoded"))


# Models and intake

_MODELS = """m AS (SELECT p_partkey AS position, CASE p_size % 5 WHEN 0 THEN 'gemini-' || (p_partkey % 4) || '.' || (p_size % 3) || '-flash' WHEN 1 THEN 'gemini-' || (p_partkey % 4) || '-pro-preview' WHEN 2 THEN 'gemini-flash-latest' WHEN 3 THEN 'gemini-' || (p_partkey % 4) || '-flash-lite' ELSE 'gemini-' || (p_partkey % 3) || '-pro-image' END || CASE WHEN p_partkey % 7 = 0 THEN '-preview' ELSE '' END AS name FROM part WHERE p_partkey % 3 <> 0),
  u AS (SELECT position, name, CASE WHEN contains(name, 'flash') AND NOT contains(name, 'lite') THEN 'flash' WHEN contains(name, 'pro') THEN 'pro' END AS tier FROM m WHERE NOT contains(name, 'image')),
  k AS (SELECT *, coalesce(try_cast(nullif(regexp_extract(name, 'gemini-(\\d+(\\.\\d+)?)', 1), '') AS DOUBLE), 0) AS version FROM u WHERE tier IS NOT NULL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY tier ORDER BY version DESC, contains(name, 'preview'), name LIKE '%-latest' DESC, position) AS rank FROM k)"""


def _models(spark, sf_dir):
    name = F.expr("concat('models/', CASE p_size % 5 WHEN 0 THEN concat('gemini-', p_partkey % 4, '.', p_size % 3, '-flash') WHEN 1 THEN concat('gemini-', p_partkey % 4, '-pro-preview') WHEN 2 THEN 'gemini-flash-latest' WHEN 3 THEN concat('gemini-', p_partkey % 4, '-flash-lite') ELSE concat('gemini-', p_partkey % 3, '-pro-image') END, CASE WHEN p_partkey % 7 = 0 THEN '-preview' ELSE '' END)")
    methods = F.when(F.col("p_partkey") % 3 != 0, F.array(F.lit("countTokens"), F.lit("generateContent"))).otherwise(F.array(F.lit("embedContent")))
    return models.usable(fixture.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("position"), name.alias("name"), methods.alias("methods")))


@query(f"WITH {_MODELS} SELECT position, name, tier, version, CAST(rank AS INTEGER) AS rank FROM ranked")
def rank_models(spark, sf_dir):
    return models.ranked(_models(spark, sf_dir)).select("position", "name", "tier", "version", "rank")


@query(f"WITH {_MODELS} SELECT CASE WHEN rank = 1 THEN 'model' ELSE 'fallback' END AS role, name, CAST(rank AS INTEGER) AS place FROM ranked WHERE tier = 'flash' AND rank <= 3")
def suggest_models(spark, sf_dir):
    """The model to use and two to fall back on."""
    return models.suggested(models.ranked(_models(spark, sf_dir)))


@query(f"""WITH {_MODELS}, tried AS (SELECT name, row_number() OVER (ORDER BY tier <> 'flash', rank) AS place FROM ranked QUALIFY place <= 6),
    answers AS (SELECT *, place IN (2, 3, 5, 6) AS ok FROM tried), seen AS (SELECT *, coalesce(count(*) FILTER (WHERE ok) OVER (ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM answers)
    SELECT CAST(place AS INTEGER) AS place, name, CASE WHEN ok THEN 'working' WHEN place = 1 THEN 'retired' ELSE 'throttled' END AS outcome, CASE WHEN ok THEN substr('ok from ' || name || ' and a long tail of words', 1, 30) WHEN place = 1 THEN '404 not found' ELSE '429 quota' END AS shown FROM seen WHERE before < 3""")
def probe_models(spark, sf_dir):
    """The first six models tried until three have worked."""
    tries = models.probes(models.ranked(_models(spark, sf_dir)))
    ok = F.col("place").isin(2, 3, 5, 6)
    tries = tries.withColumns({"reply": F.when(ok, F.concat(F.lit(" ok\nfrom "), F.col("name"), F.lit(" and a long tail of words"))), "error": F.when(F.col("place") == 1, "404 not found").when(~ok, "429 quota")})
    return models.probed(tries)


@query(f"""SELECT bucket, transient, count(*) AS n FROM (SELECT CASE WHEN l LIKE '%no longer available%' OR l LIKE '%not found%' OR l LIKE '%404%' THEN 'retired' WHEN l LIKE '%429%' OR l LIKE '%quota%' OR l LIKE '%exhausted%' THEN 'throttled'
    WHEN l LIKE '%403%' OR l LIKE '%denied%' OR l LIKE '%permission%' THEN 'denied' ELSE 'failed' END AS bucket, regexp_matches(l, '{"|".join(models.TRANSIENT)}') AS transient FROM (SELECT lower({MESSAGE}) AS l FROM events)) GROUP BY ALL""")
def bucket_errors(spark, sf_dir):
    m = F.expr(MESSAGE)
    return fixture.table(spark, sf_dir, "events").groupBy(models.bucket(m).alias("bucket"), models.transient(m).alias("transient")).agg(F.count("*").alias("n"))


_ATTEMPTS = f"a AS (SELECT user_id AS batch, event_type AS model, event_id AS attempt, {MESSAGE} AS error FROM events)"


def _attempts(spark, sf_dir):
    return fixture.table(spark, sf_dir, "events").select(F.col("user_id").alias("batch"), F.col("event_type").alias("model"), F.col("event_id").alias("attempt"), F.expr(MESSAGE).alias("error"))


@query(f"WITH {_ATTEMPTS} SELECT batch, string_agg(model || ': ' || error, ' | ' ORDER BY first) AS errors FROM (SELECT batch, model, arg_max(error, attempt) AS error, min(attempt) AS first FROM a GROUP BY batch, model) GROUP BY batch")
def last_model_errors(spark, sf_dir):
    return models.last_errors(_attempts(spark, sf_dir))


@query(f"WITH {_ATTEMPTS} SELECT batch, bool_or(contains(lower(error), 'not found') OR contains(error, '404')) AS needs_new_model FROM a GROUP BY batch")
def retired_model_advice(spark, sf_dir):
    rows = _attempts(spark, sf_dir).groupBy("batch").agg(F.collect_set("error").alias("errors"))
    return rows.select("batch", models.needs_new_model(F.col("errors")).alias("needs_new_model"))


@query("SELECT user_id AS doc_id, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END) AS BIGINT) AS input_tokens, CAST(sum(event_id % 100) AS BIGINT) AS output_tokens, CAST(sum(CASE WHEN event_id % 5 = 0 THEN 0 ELSE event_id END) + sum(event_id % 100) AS BIGINT) AS total_tokens FROM events WHERE event_type <> 'error' GROUP BY user_id")
def token_usage(spark, sf_dir):
    """Tokens of replies that came; every fifth says nothing of its input."""
    rows = fixture.table(spark, sf_dir, "events").where("event_type <> 'error'")
    return models.token_usage(rows.select(F.col("user_id").alias("doc_id"), F.when(F.col("event_id") % 5 != 0, F.col("event_id")).alias("input_tokens"), (F.col("event_id") % 100).alias("output_tokens")))


_URL = "CASE page_id % 6 WHEN 0 THEN 'ftp' || substr(url, 5) WHEN 1 THEN 'http:///none/' || page_id WHEN 2 THEN url || '/x.PDF?y=1' WHEN 3 THEN 'http://h.example.com/a.tiff' WHEN 4 THEN 'file:///etc/hosts' ELSE url END"


@query(f"SELECT page_id, CASE WHEN page_id % 6 IN (0, 4) THEN 'scheme' WHEN page_id % 6 = 1 THEN 'host' END AS problem FROM pages")
def url_intake_filter(spark, sf_dir):
    return fixture.table(spark, sf_dir, "pages").select("page_id", intake.url_problem(F.expr(_SPARK_URL)).alias("problem"))


_SPARK_URL = "CASE page_id % 6 WHEN 0 THEN concat('ftp', substr(url, 5)) WHEN 1 THEN concat('http:///none/', page_id) WHEN 2 THEN concat('http://h.example.com/', page_id, '/x.PDF?y=1') WHEN 3 THEN 'http://h.example.com/a.tiff' WHEN 4 THEN 'file:///etc/hosts' ELSE url END"


@query("SELECT page_id, CASE page_id % 6 WHEN 2 THEN '.pdf' WHEN 3 THEN '.tiff' ELSE CASE WHEN page_id % 2 = 0 THEN '.pdf' ELSE '.png' END END AS suffix FROM pages")
def sniff_suffix(spark, sf_dir):
    content = F.when(F.col("page_id") % 2 == 0, "%PDF-1.7").otherwise("\x89PNG").cast("binary")
    return fixture.table(spark, sf_dir, "pages").select("page_id", intake.suffix(F.expr(_SPARK_URL), content).alias("suffix"))


@query("SELECT page_id, octet_length(encode(html)) > 4000 AS too_large FROM pages")
def size_cap(spark, sf_dir):
    return fixture.table(spark, sf_dir, "pages").select("page_id", intake.too_large(F.octet_length("html"), 4000).alias("too_large"))


@query("SELECT s_suppkey, CASE s_suppkey % 8 WHEN 3 THEN true WHEN 5 THEN NULL WHEN 6 THEN s_suppkey % 3 = 0 WHEN 7 THEN true ELSE false END AS is_public FROM supplier")
def public_addresses(spark, sf_dir):
    return fixture.table(spark, sf_dir, "supplier").select("s_suppkey", intake.public_address(F.expr(_ADDRESS)).alias("is_public"))


_ADDRESS = "CASE s_suppkey % 8 WHEN 0 THEN concat('10.0.0.', s_suppkey % 256) WHEN 1 THEN '127.0.0.1' WHEN 2 THEN '169.254.169.254' WHEN 3 THEN concat('8.8.8.', s_suppkey % 256) WHEN 4 THEN '::1' WHEN 5 THEN '256.1.1.1' WHEN 6 THEN if(s_suppkey % 3 = 0, '192.0.0.9', '192.168.7.7') ELSE '2606:4700::1111' END"


@query("SELECT s_nationkey AS nation, CASE WHEN bool_and(CASE s_suppkey % 8 WHEN 3 THEN true WHEN 6 THEN s_suppkey % 3 = 0 WHEN 7 THEN true ELSE false END) THEN NULL ELSE 'not public' END AS problem FROM supplier GROUP BY s_nationkey")
def host_problems(spark, sf_dir):
    """Hosts by nation, each with the addresses of its suppliers: all must be public."""
    rows = fixture.table(spark, sf_dir, "supplier").select(F.col("s_nationkey").alias("url"), F.expr(_ADDRESS).alias("address"))
    return intake.host_problems(rows).withColumnRenamed("url", "nation")


@query("SELECT 'ok' AS status, true AS mock, CAST(3 AS INTEGER) AS batch_pages, CAST(1.0 AS DOUBLE) AS tolerance_pct")
def health(spark, sf_dir):
    return files.health(spark)


@query("SELECT 'doc_' || doc_id AS document, CAST(p AS INTEGER) AS page_number, printf('doc_%d/%05d', doc_id, p) AS key FROM (SELECT doc_id, unnest(range(1, n_chars // 2000 + 2)) AS p FROM documents)")
def page_list(spark, sf_dir):
    """Documents as files with a page for every 2,000 characters."""
    rows = fixture.table(spark, sf_dir, "documents")
    return files.page_list(rows.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("document"), (F.floor(F.col("n_chars") / 2000) + 1).alias("n_pages")))


@query("SELECT l_orderkey AS doc_id, count(*) AS n FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem) WHERE (l_linenumber - 1) % 3 < 2 GROUP BY 1")
def truncating_zip(spark, sf_dir):
    """Pages meet replies by position; with two replies to each request of three pages the third is lost."""
    pos = F.col("page_no") - 1
    pages = fixture.lines(spark, sf_dir).select("doc_id", F.floor(pos / 3).cast("int").alias("batch_no"), (pos % 3).alias("pos")).distinct()
    replies = pages.select("doc_id", "batch_no").distinct().withColumn("pos", F.explode(F.array(F.lit(0), F.lit(1)))).withColumn("raw", F.lit("{}"))
    return files.zipped(pages, replies).groupBy("doc_id").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey AS doc_id FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def skipped_documents(spark, sf_dir):
    """Gold without a document."""
    gold = fixture.table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc_id"), F.concat(F.col("o_orderkey").cast("string"), F.lit(".pdf")).alias("source"))
    landed = fixture.lines(spark, sf_dir).select(F.concat(F.lit("file:/bills/"), F.col("doc_id").cast("string"), F.lit(".pdf")).alias("path"))
    return files.with_document(gold, landed)[1].select("doc_id")


@query(f"WITH {_ITEMS} SELECT doc_id || '.pdf' AS source, 'Correct bill_items against the document, then set verified to true.' AS _instructions, false AS verified, count(*) AS n_items FROM items GROUP BY doc_id")
def gold_templates(spark, sf_dir):
    """What a person corrects to make gold: every bill's items, not yet verified."""
    rows = fixture.items(spark, sf_dir).groupBy("doc_id").agg(F.collect_list(F.struct("item_name", "item_amount")).alias("bill_items"))
    made = files.gold_template(rows.withColumn("source", F.concat(F.col("doc_id").cast("string"), F.lit(".pdf"))))
    return made.select("source", "_instructions", "verified", F.size("bill_items").cast("bigint").alias("n_items"))
