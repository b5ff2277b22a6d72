"""The queries of this subpackage and, where SQL can state them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tallyframe.llm.store import table


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with its bin."""
    from tallyframe.llm.packing import pack

    return pack(table(spark, sf_dir, "documents"))


def op2_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of 4-word shingles have a Jaccard similarity of 0.85 or more."""
    from tallyframe.llm.ngram_join import join

    return join(table(spark, sf_dir, "documents"))


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of benchmark windows in every document, and the verdict."""
    from tallyframe.llm.decontaminate import judged

    return judged(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learned from the labels that aren't held out."""
    from tallyframe.llm.toxicity import classify

    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words and word pieces of every document."""
    from tallyframe.llm.token_counts import count

    return count(table(spark, sf_dir, "documents"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages say of each page."""
    from tallyframe.llm.warc import archived

    return archived(table(spark, sf_dir, "pages"))


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the blocks of lines that an earlier one has."""
    from tallyframe.llm.line_dedup import report

    return report(table(spark, sf_dir, "documents"))


def op8_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of every page."""
    from tallyframe.llm.html_text import extract

    return extract(table(spark, sf_dir, "pages"))


def op9_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets and linked weak parts of every document."""
    from tallyframe.llm.secrets import scan

    return scan(table(spark, sf_dir, "documents"))


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digests of every document as a FLAC stream that was read back."""
    from tallyframe.llm.flac import digests

    return digests(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = {name: f for name, f in globals().items() if name[:2] == "op" and name[2].isdigit()}
    return dict(sorted(found.items(), key=lambda x: int(x[0][2:].split("_")[0])))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_SPACED = rf"regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+')"
_ALNUM = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLES: dict[str, str] = {
    "op2_ngram_jaccard_join": f"""WITH RECURSIVE w AS (SELECT row_number() OVER () AS r, doc_id, {_SPACED} AS ws FROM documents),
  s AS (SELECT DISTINCT r, array_to_string(ws[i:i + 3], ' ') AS g FROM (SELECT r, ws, unnest(range(1, greatest(len(ws) - 2, 2))) AS i FROM w WHERE len(ws) > 0)),
  n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
  c AS (SELECT a.r AS a, b.r AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY ALL),
  l AS (SELECT a, b FROM c JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * k >= 85 * (x.n + y.n - k)),
  reach AS (SELECT r, r AS m FROM w UNION SELECT reach.r, l.b FROM reach JOIN l ON l.a = reach.m)
SELECT w.doc_id, coalesce(any_value(n.n), 0) AS n_shingles, min(o.doc_id) AS component_id FROM w LEFT JOIN n ON n.r = w.r JOIN reach ON reach.r = w.r JOIN w o ON o.r = reach.m GROUP BY w.r, w.doc_id""",
    "op3_benchmark_decontamination": f"""WITH w AS (SELECT row_number() OVER () AS r, doc_id, {_ALNUM} AS ws FROM documents),
  i AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, {_ALNUM} AS ws FROM benchmark),
  iw AS (SELECT DISTINCT item, least(13, len(ws)) AS n, array_to_string(ws[s:s + least(13, len(ws)) - 1], ' ') AS g FROM (SELECT item, ws, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS s FROM i WHERE len(ws) > 0)),
  dw AS (SELECT r, n, s, array_to_string(ws[s:s + n - 1], ' ') AS g FROM (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS s FROM w, (SELECT DISTINCT n FROM iw) WHERE len(ws) >= n)),
  hits AS (SELECT r, n, s, item FROM dw JOIN iw USING (n, g)),
  h AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT r, s, n FROM hits)) GROUP BY r),
  t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN h USING (r) LEFT JOIN t USING (r)""",
    "op6_warc": """WITH p AS (SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
  m AS (SELECT *, max(page_id) OVER (PARTITION BY html) AS original FROM p)
SELECT page_id, octet_length(encode(html)) AS payload_bytes,
  array_to_string([substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(hex, (i // 4) * 5 + 1, 5) AS INTEGER) >> (15 - 5 * (i % 4))) & 31 AS INTEGER) + 1, 1) for i in range(0, 32)], '') AS payload_digest,
  CASE WHEN page_id = original THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> original THEN original END AS refers_to FROM m""",
}




def _secrets_sql() -> str:
    """Spans from gaps and matches, and a plain join of weak candidates with all parts in scope."""
    from tallyframe.llm import secrets as m

    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    number = lambda kind: m.KINDS.index(kind)
    rows = lambda kind, pattern, group: f"SELECT r, {number(kind)} AS k, unnest(range(1, len(hit) + 1)) AS i, hit, gap, grp FROM (SELECT r, regexp_extract_all(text, {quoted(pattern)}, 0) AS hit, regexp_extract_all(text, {quoted(pattern)}, {group}) AS grp, string_split_regex(text, {quoted(pattern)}) AS gap FROM t)"
    found = " UNION ALL ".join(rows(kind, *m._SCANNED[kind]) for kind in m._SCANNED)
    side = {"id": ("access", "weak_id"), "secret": ("assign", "hex", "weak_secret")}
    near = lambda which: f"EXISTS (SELECT 1 FROM s o WHERE o.r = s.r AND o.k IN ({', '.join(str(number(x)) for x in side[which])}) AND abs(o.s - s.s) <= {m.SCOPE})"
    kept = " OR ".join([f"k <= {number('hex')}", *(f"(k = {number(kind)} AND {' AND '.join(map(near, needs))})" for kind, needs in m.NEEDS.items())])
    names = ", ".join(f"'{x}'" for x in m.KINDS)
    listed = lambda where: f"coalesce(string_agg([{names}][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k, e) FILTER (WHERE {where}), '')"
    return f"""WITH t AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
  f AS ({found}),
  p AS (SELECT r, k, length(grp[i]) AS n, length(hit[i]) AS w, CAST(sum(length(gap[i]) + length(hit[i])) OVER (PARTITION BY r, k ORDER BY i) AS BIGINT) AS e FROM f),
  s AS (SELECT r, CASE WHEN k = 0 AND n < {m.LEAST_SECRET} THEN {number("weak_secret")} ELSE k END AS k, e - w AS s, e FROM p WHERE k <> 0 OR n >= {m.WEAK_SECRET}),
  x AS (SELECT r, k, s, e FROM s WHERE {kept}),
  a AS (SELECT r, count(*) FILTER (WHERE k = 0) AS n_assign, count(*) FILTER (WHERE k = 1) AS n_access, count(*) FILTER (WHERE k = 2) AS n_hex, {listed("k <= 2")} AS base, {listed("TRUE")} AS spans FROM x GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM t LEFT JOIN a USING (r)"""


def oracle_sql() -> dict[str, str]:
    return ORACLES | {"op9_secret_scans": _secrets_sql()}
