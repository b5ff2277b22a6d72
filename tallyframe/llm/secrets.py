"""Secret scan with multipart credential linking, in DataFrame functions only.

Base spans are the leftmost non-overlapping matches of three patterns.  Their
offsets come from ``split`` and ``regexp_extract_all`` on the same pattern: the
lengths of gaps and matches add up to positions in code points.

A credential often has several parts, of which some look like nothing alone: a
short secret, a user name, a host.  Such weak candidates are reported only when
complementary parts are in scope, that is, start within ``SCOPE`` code points:
a short secret needs an identifier, an identifier needs a secret, an endpoint
needs both.  The interval join is an equi-join on blocks of ``SCOPE`` code points:
of the parts of a kind in a block only the first and the last can decide for a
candidate outside that block, and all of them do for one inside, so each block
carries two numbers a kind and no pair of parts is ever emitted.

Defined cases: a null or empty text has no spans; equal rows give equal rows
(rows are told apart by their place in the input, never by doc_id); spans of the
same start are ordered by kind; other columns are ignored; an empty table gives
no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyframe.llm.store import written

#: Patterns of the base kinds, in the order in which kinds are listed.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
#: A run shorter than the least length holds no longer match, so the length can be part of these two.
ACCESS = r"AKIA[A-Z0-9]{14,}"
HEX = r"[0-9a-f]{16,}"
LEAST_SECRET = 12
#: Weak parts: a named identifier, a secret of 4 to 11 characters, an address.  No pattern repeats a group: the JVM
#: would recurse for each repetition, and a long run of them would overflow its stack.
NAMED_ID = r"""(?i)(access_key_id|client_id|account|username|user|login)["']?\x20*[:=]\x20*["']?([A-Za-z0-9@+/_.-]{3,})"""
WEAK_SECRET = 4
ENDPOINT = r"""(?i)(https?://|(?:host|endpoint|server)["']?\x20*[:=]\x20*["']?)([a-z0-9-]+\.[a-z0-9-][^\s"'<>]*)"""
SCOPE = 256

#: Kinds in the order of the list, each with its pattern and the group whose length decides.
KINDS = ("assign", "access", "hex", "weak_id", "weak_secret", "endpoint")
_SCANNED = {"assign": (ASSIGN, 2), "access": (ACCESS, 0), "hex": (HEX, 0), "weak_id": (NAMED_ID, 0), "endpoint": (ENDPOINT, 0)}
#: What a weak candidate of each kind needs in scope.
NEEDS = {"weak_id": ("secret",), "weak_secret": ("id",), "endpoint": ("id", "secret")}
#: The running totals below are taken in chunks of chunks, so that a span costs a few dozen additions in any text.
_CHUNK = 32
_SPAN = "array<struct<s:bigint,e:bigint,n:int>>"


def _total(values: str, first: str, many: str) -> str:
    """The sum of some elements, each taken by its index: ``slice`` would copy the whole array first."""
    return f"if({many} = 0, 0L, aggregate(sequence({first}, {first} + {many} - 1), 0L, (x, j) -> x + {values}[j]))"


def _chunk_sums(values: str) -> str:
    return f"transform(sequence(0, cast((size({values}) - 1) div {_CHUNK} as int)), c -> {_total(values, f'c * {_CHUNK}', f'least({_CHUNK}, size({values}) - c * {_CHUNK})')})"


def _running(levels: list[str]) -> str:
    """Totals up to each element of the first level, from the sums of chunks that the others hold."""
    at = [f"cast((i + 1) div {_CHUNK**n} as int)" for n in range(len(levels) + 1)]  # whole chunks of each level up to here
    parts = [_total(values, f"{at[n + 1]} * {_CHUNK}", f"({at[n]} - {at[n + 1]} * {_CHUNK})") for n, values in enumerate(levels[:-1])]
    return f"transform({levels[0]}, (g, i) -> {' + '.join([*parts, _total(levels[-1], '0', at[len(levels) - 1])])})"


def _all_spans(df: DataFrame) -> DataFrame:
    """Adds an array of (s, e, n) for each scanned kind: start, end, and length of the deciding group."""
    each = lambda f: {f"{k}{suffix}": x for k in _SCANNED for suffix, x in f(k).items()}
    df = df.withColumns(each(lambda k: {"_hits": F.regexp_extract_all("text", F.lit(_SCANNED[k][0]), F.lit(0))}))

    def lengths(k: str) -> dict[str, Column]:
        pattern, group = _SCANNED[k]
        some = F.size(f"{k}_hits") > 0
        out = {"_len": F.transform(f"{k}_hits", F.length), "_gap": F.when(some, F.transform(F.split("text", pattern, -1), F.length))}
        return out | ({"_n": F.when(some, F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)), F.length))} if group else {})

    df = df.withColumns(each(lengths))
    df = df.withColumns(each(lambda k: {"_step": F.expr(f"zip_with(slice({k}_gap, 1, size({k}_len)), {k}_len, (g, h) -> cast(g + h as bigint))")}))
    # sums of chunks, of chunks of chunks and so on, and from these the running total at each span
    for above, below in (("_sums1", "_step"), ("_sums2", "_sums1"), ("_sums3", "_sums2")):
        df = df.withColumns(each(lambda k: {above: F.expr(_chunk_sums(f"{k}{below}"))}))
    df = df.withColumns(each(lambda k: {"_ends": F.expr(_running([f"{k}{x}" for x in ("_step", "_sums1", "_sums2", "_sums3")]))}))
    return df.withColumns({k: F.expr(f"cast(coalesce(transform({k}_ends, (e, i) -> struct(e - {k}_len[i] as s, e as e, {k}_{'n' if _SCANNED[k][1] else 'len'}[i] as n)), array()) as {_SPAN})") for k in _SCANNED})


def _listed(*kinds: str) -> Column:
    """kind:start:end of the given arrays by start, then kind as listed."""
    rows = ", ".join(f"transform({k}, x -> struct(x.s as s, {KINDS.index(k)} as k, x.e as e))" for k in kinds)
    names = ", ".join(f"'{k}'" for k in KINDS)
    return F.expr(f"array_join(transform(array_sort(concat({rows})), x -> concat(array({names})[x.k], ':', x.s, ':', x.e)), ',')")


def scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): counts, base spans and all spans.

    The texts are read once; what follows works on a table of span arrays, and
    only rows that hold weak candidates and parts of two sorts enter the join.
    """
    df = docs.select(F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    df = _all_spans(df)
    df = df.withColumn("weak_secret", F.filter("assign", lambda x: (x.n >= WEAK_SECRET) & (x.n < LEAST_SECRET))).withColumn("assign", F.filter("assign", lambda x: x.n >= LEAST_SECRET))
    found = written(df.select("row", "doc_id", *KINDS), "secrets")

    has = {k: F.size(k) > 0 for k in KINDS}
    ids, secrets = has["access"] | has["weak_id"], has["assign"] | has["hex"] | has["weak_secret"]
    linkable = (has["weak_id"] & secrets) | (has["weak_secret"] & ids) | (has["endpoint"] & ids & secrets)
    sides = {"access": "id", "weak_id": "id", "assign": "secret", "hex": "secret", "weak_secret": "secret"}
    linked = found.where(linkable)
    parts = linked.select("row", F.explode(F.concat(*[F.expr(f"transform({k}, x -> struct('{side}' as side, x.s as s))") for k, side in sides.items()])).alias("p")).select("row", "p.*")
    blocks = parts.groupBy("row", "side", F.floor(F.col("s") / scope).alias("block")).agg(F.min("s").alias("low"), F.max("s").alias("high"))
    # what each block sees: all of its own parts, the last one before it and the first one after it
    seen = blocks.select("row", "side", F.explode(F.array(*[F.struct((F.col("block") + d).alias("block"), F.when(F.lit(d == 0), F.lit(True)).alias("own"), F.when(F.lit(d == 1), F.col("high")).alias("before"), F.when(F.lit(d == -1), F.col("low")).alias("after")) for d in (-1, 0, 1)])).alias("x")).select("row", "side", "x.*")
    sight = seen.groupBy("row", "block").agg(*[x for side in ("id", "secret") for x in (F.max(F.when(F.col("side") == side, F.col("own"))).alias(f"{side}_own"), F.max(F.when(F.col("side") == side, F.col("before"))).alias(f"{side}_before"), F.min(F.when(F.col("side") == side, F.col("after"))).alias(f"{side}_after"))])
    weak = linked.select("row", F.explode(F.concat(*[F.expr(f"transform({k}, x -> struct('{k}' as kind, x.s as s, x.e as e, x.n as n))") for k in NEEDS])).alias("w")).select("row", "w.*").withColumn("block", F.floor(F.col("s") / scope))
    in_scope = {side: F.coalesce(F.col(f"{side}_own"), F.lit(False)) | F.coalesce(F.col("s") - F.col(f"{side}_before") <= scope, F.lit(False)) | F.coalesce(F.col(f"{side}_after") - F.col("s") <= scope, F.lit(False)) for side in ("id", "secret")}
    allowed = F.lit(False)
    for kind, needs in NEEDS.items():
        both = F.col("kind") == kind
        for side in needs:
            both = both & in_scope[side]
        allowed = allowed | both
    kept = weak.join(sight, ["row", "block"], "left").where(allowed).groupBy("row").agg(*[F.expr(f"collect_list(struct(s, e, n)) filter (where kind = '{k}')").alias(f"kept_{k}") for k in NEEDS])
    out = found.where(~linkable).select("doc_id", "assign", "access", "hex", *[F.expr(f"cast(array() as {_SPAN})").alias(k) for k in NEEDS])
    out = out.unionByName(linked.drop(*NEEDS).join(kept, "row", "left").select("doc_id", "assign", "access", "hex", *[F.expr(f"coalesce(kept_{k}, cast(array() as {_SPAN}))").alias(k) for k in NEEDS]))
    return out.select(
        "doc_id", *[F.size(k).cast("bigint").alias(f"n_{k}") for k in ("assign", "access", "hex")],
        F.sha2(_listed("assign", "access", "hex").cast("binary"), 256).alias("base_sha256"), _listed(*KINDS).alias("spans"),
    )
