"""Exact Jaccard join of documents on their sets of word shingles.

1. Every text becomes the sorted set of 64-bit hashes of its shingles.  Texts with
   equal sets form a class, named by a 128-bit digest of the set; what follows works
   on classes, so exact copies cost nothing.
2. A table of fixed size counts all shingles of all documents by a part of their hash.
   It only orders shingles from rare to frequent (any order gives the same links).
3. Two sets that link, the smaller of n shingles, share ``shared(n)`` of their rarest
   ``n - ceil(t n) + meetings(n)`` shingles, a number that grows with n.  Each class lists
   those.  In a short list a class meets the few before it, and a pair that meets in over
   half of that number of lists is a tie.  Any other pair that links shares the other half
   in long lists.  So a class leaves all but one of such a half out, those of its longest
   lists; in what stays of a long list, all classes of a run of sizes close enough to link
   are tied to the smallest.  So a pair that links is tied either way, the ties grow with
   the lists and not with their squares, and chance meetings in a few lists tie nothing,
   however many shingles a text has.  A shingle with very many classes is dealt into
   salted groups first.  The components of the ties are small sets of candidates.
   Most listed shingles have one class.  What has more is found slice by slice of the
   shingles, and only that is kept, so the disk never holds the lists of all at once.
4. Within them a T-occurrence search decides: inverted lists of the group, the longest
   ones set aside, the short ones merged in order, and what is met often enough there
   looked up in the long ones by binary search (DivideSkip).  Members of one component so far need no search among
   themselves.
5. Components of the links; each takes its smallest doc_id.

Candidates of more than ``group_docs`` classes are searched block by block, with
``pivots`` of them in every block, which ties the parts of a large component together;
if links leave several components, classes outside the largest one search all blocks.

Defined cases: a text without words has the empty set and links with nothing; with
fewer than k words the word sequence is the one shingle; repeated rows are copies;
rows with a null doc_id take part and have the smallest other doc_id, or null; other
columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallyframe.llm import store, textnum
from tallyframe.llm.filters import PARTS, filter_of, in_parts, may_hold, reduced
from tallyframe.llm.graph import components
from tallyframe.llm.store import written


@dataclass(frozen=True)
class Settings:
    words: int = 4  # in a shingle
    percent: int = 85  # least Jaccard similarity
    sketch_bits: int = 20  # counters: 2 ** bits
    meetings: int = 4  # shared shingles asked of small sets
    per_meeting: int = 50  # shingles of a set for which one more is asked
    slices: int = 3  # passes over the documents in which the lists are made
    short: int = 16  # classes in a short list
    hot: int = 100_000  # classes of one shingle that stay together
    group_docs: int = 4096
    group_shingles: int = 1_000_000
    pivots: int = 32  # classes of a dealt set of candidates that stand in each of its blocks


def prefix_size(n: int, cfg: Settings) -> int:
    return min(n, n + (-cfg.percent * n) // 100 + cfg.meetings + n // cfg.per_meeting)


def shared(n: Column, cfg: Settings) -> Column:
    """Shingles that two sets which link share in their lists at least, the smaller one of size n; grows with n."""
    return F.least(cfg.meetings + F.floor(n / cfg.per_meeting), F.ceil(cfg.percent * n / 100)).cast("int")


def _digest(s: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(s.tobytes())


def profiles(docs: DataFrame, cfg: Settings) -> DataFrame:
    """A row per document (doc_id, n, class) and, of each task, its counts of shingles in parts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << cfg.sketch_bits, np.int64)
        shift = np.uint64(64 - cfg.sketch_bits)
        names = ["doc_id", "n", "class", "part", "counts"]
        for batch in batches:
            for part in textnum.slices(batch):
                sets, _ = textnum.shingle_sets(textnum.Texts(part.column("text")), cfg.words)
                n = len(sets)
                if full := [s for s in sets if len(s)]:
                    counts += np.bincount((np.concatenate(full) >> shift).astype(np.int64), minlength=len(counts))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) if len(s) else None for s in sets], pa.binary()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names)
        if counts.any():
            yield pa.RecordBatch.from_arrays([pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.int64()), pa.nulls(PARTS, pa.binary()), pa.array(range(PARTS), pa.int32()), pa.array(in_parts(counts.astype(np.int32)), pa.binary())], names)

    return docs.mapInArrow(textnum.lean(run), "doc_id bigint, n bigint, class binary, part int, counts binary")


def _ties(docs: DataFrame, counts: np.ndarray, cfg: Settings, tables: list[DataFrame] | None = None) -> DataFrame:
    """(u, v): classes that share enough rare shingles, or a chain of them, and may link by size.

    ``tables`` gets the tables that the result is read from.
    """
    held = docs.sparkSession.sparkContext.broadcast(counts)
    tables = [] if tables is None else tables

    def rows_of(batches: Iterator[pa.RecordBatch], hot_only: bool, at: int = 0, slices: int = 1) -> Iterator[pa.RecordBatch]:
        counts, shift = held.value, np.uint64(64 - cfg.sketch_bits)
        for batch in batches:
            for part in textnum.slices(batch):
                sets, _ = textnum.shingle_sets(textnum.Texts(part.column("text")), cfg.words)
                classes = {_digest(s): s for s in sets if len(s)}
                tokens, often = [], []
                for s in classes.values():
                    c = counts[(s >> shift).astype(np.int64)]
                    p = prefix_size(len(s), cfg)
                    first = np.lexsort((s, c))[:p]
                    first = first[s[first] % np.uint64(slices) == at]
                    tokens.append(s[first])
                    often.append(c[first])
                sizes = [len(x) for x in tokens]
                if not sum(sizes):
                    continue
                owner = np.repeat(np.arange(len(sizes)), sizes)
                names = pa.array(list(classes), pa.binary())
                keys = np.frombuffer(b"".join(classes), np.uint64)[::2]
                groups = np.concatenate(often).astype(np.uint64) // np.uint64(cfg.hot) + np.uint64(1)
                out = pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate(tokens).view(np.int64)), pa.array((keys[owner] % groups).astype(np.int32)), names.take(pa.array(owner)), pa.array(np.array([len(s) for s in classes.values()], np.int32)[owner])],
                    ["token", "salt", "class", "n"],
                )
                yield out.filter(pa.array(groups > 1)) if hot_only else out

    schema = "token bigint, salt int, class binary, n int"
    group = Window.partitionBy("token", "salt")
    order = group.orderBy("n", "class")

    def met_in(at: int) -> DataFrame:
        """Rows of the shingles of a slice that several classes list."""
        rows = docs.select("text").mapInArrow(textnum.lean(lambda batches: rows_of(batches, False, at, cfg.slices)), schema)
        # a class comes from each task that has a copy of it
        rows = rows.withColumn("before", F.lag("class").over(order)).where("before is null or before <> class").drop("before")
        return rows.withColumn("many", F.count("*").over(group)).where("many > 1")

    for at in range(cfg.slices):
        tables.append(written(met_in(at), "lists"))
        store.settle(docs.sparkSession)
    rows = reduce(DataFrame.unionByName, tables)
    # long lists, each class without its longest ones: the smallest set of each run of sizes stands for the run
    long = rows.where(F.col("many") > cfg.short)
    of_class = Window.partitionBy("class").orderBy(F.desc("many"), "token", "salt")
    half = shared(F.ceil(cfg.percent * F.col("n") / 100), cfg)  # of the smallest set that may link
    long = long.withColumn("place", F.row_number().over(of_class)).where(F.col("place") >= half - F.floor(half / 2)).withColumn("last_n", F.lag("n").over(order))
    begins = F.col("last_n").isNull() | (100 * F.col("last_n") < cfg.percent * F.col("n"))
    long = long.withColumn("hub", F.last(F.when(begins, F.col("class")), ignorenulls=True).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    long = long.where(F.col("hub") != F.col("class")).select(F.col("class").alias("u"), F.col("hub").alias("v")).distinct()
    # short lists: meetings with those before, counted over all lists
    met = F.collect_list(F.struct(F.col("class").alias("v"), F.col("n").alias("m"))).over(order.rowsBetween(1 - cfg.short, -1))
    short = rows.where(F.col("many") <= cfg.short).withColumn("met", met).select(F.col("class").alias("u"), "n", F.explode("met").alias("x")).select("u", "n", "x.v", "x.m")
    short = short.where(100 * F.col("m") >= cfg.percent * F.col("n")).groupBy("u", "v", "n", "m").agg(F.count("*").alias("times")).where(F.col("times") > F.floor(shared(F.col("m"), cfg) / 2)).select("u", "v")
    ties = long.unionByName(short)
    if int(counts.max(initial=0)) < cfg.hot:
        return ties
    # groups of one salted shingle meet in their smallest members
    salted = written(docs.select("text").mapInArrow(textnum.lean(lambda batches: rows_of(batches, True)), schema).select("token", "salt", "class").distinct(), "salted")
    tables.append(salted)
    heads = salted.groupBy("token", "salt").agg(F.min("class").alias("class"))
    tops = heads.groupBy("token").agg(F.min("class").alias("top"), F.count("*").alias("k")).where("k > 1")
    across = heads.join(tops, "token").where("class <> top").select(F.col("class").alias("u"), F.col("top").alias("v"))
    inside = salted.join(tops.select("token"), "token", "left_semi").join(heads.withColumnRenamed("class", "head"), ["token", "salt"]).where("class <> head").select(F.col("class").alias("u"), F.col("head").alias("v"))
    return ties.unionByName(across).unionByName(inside).distinct()


class Group:
    """Classes that may link, with their inverted lists; finds links that join components."""

    def __init__(self, sets: list[np.ndarray], percent: int):
        self.percent = percent
        self.sizes = np.array([len(s) for s in sets], np.int64)
        self.label = np.arange(len(sets))
        flat = np.concatenate(sets)
        owner = np.repeat(np.arange(len(sets)), self.sizes)
        _, token = np.unique(flat, return_inverse=True)
        order = np.argsort(token, kind="stable")  # the sets come by size, so each list does, too
        self.postings = owner[order]
        bounds = np.concatenate([[0], np.cumsum(np.bincount(token))])
        shared = (bounds[1:] - bounds[:-1])[token] > 1
        self.low, self.high = bounds[:-1], bounds[1:]
        cuts = np.cumsum(self.sizes)[:-1]
        self.tokens = [t[keep] for t, keep in zip(np.split(token, cuts), np.split(shared, cuts))]

    def overlap(self, x: int, y: int) -> int:
        return len(np.intersect1d(self.tokens[x], self.tokens[y], assume_unique=True))

    def links(self, x: int, y: int, common: int) -> bool:
        return (100 + self.percent) * common >= self.percent * int(self.sizes[x] + self.sizes[y])

    def join(self, x: int, y: int) -> None:
        self.label[self.label == self.label[y]] = self.label[x]

    def search(self, x: int, among: slice, index: np.ndarray | None = None) -> list[int]:
        """Members of other components in the range which link with x (T-occurrence search)."""
        n = int(self.sizes[x])
        need = -(-self.percent * n // 100)
        tokens = self.tokens[x]
        if len(tokens) < need:
            return []
        other = self.label[among] != self.label[x]
        if index is not None:
            other &= index[among]
        if not other.any():
            return []
        lists = []
        for t in tokens:
            mine = self.postings[self.low[t] : self.high[t]]
            a, b = np.searchsorted(mine, (among.start, among.stop))
            if b > a:
                mine = mine[a:b]
                mine = mine[other[mine - among.start]]
                if len(mine):
                    lists.append(mine)
        if len(lists) < need:
            return []
        lists.sort(key=len)
        long = min(need - 1, max(int(need / (0.01 * np.log2(len(lists[-1]) + 1) + 1)), 0))
        short, far = lists[: len(lists) - long], lists[len(lists) - long :]
        met, times = _merge(short, need - long)
        for rest, probe in zip(range(len(far), 0, -1), reversed(far)):
            if not len(met):
                break
            at = np.minimum(np.searchsorted(probe, met), len(probe) - 1)
            times = times + (probe[at] == met)
            keep = times + rest - 1 >= need
            met, times = met[keep], times[keep]
        enough = (100 + self.percent) * times >= self.percent * (n + self.sizes[met])
        return met[enough].tolist()


def _merge(lists: list[np.ndarray], least: int) -> tuple[np.ndarray, np.ndarray]:
    """Members of at least so many of some sorted lists, with their counts.

    A stable sort merges the sorted lists run by run with galloping, which is a heap's order
    without a Python object a posting; equal members come to stand side by side.
    """
    merged = np.concatenate([np.zeros(0, np.int64), *lists])
    merged.sort(kind="stable")
    if len(merged) < least:
        return merged[:0], merged[:0]
    often = merged[: len(merged) - least + 1][merged[: len(merged) - least + 1] == merged[least - 1 :]]
    met = often[np.flatnonzero(np.diff(often, prepend=-1))]
    return met, np.searchsorted(merged, met, side="right") - np.searchsorted(merged, met)


def search_group(names: list[bytes], sets: list[np.ndarray], percent: int, labels: list[bytes] | None = None, asks: list[bool] | None = None) -> list[tuple[bytes, bytes]]:
    """Links that join what is not yet joined: between all classes, or between those that ask and the others."""
    order = sorted(range(len(sets)), key=lambda k: (len(sets[k]), names[k]))
    group = Group([sets[k] for k in order], percent)
    if labels is not None:
        number: dict[bytes, int] = {}
        group.label = np.array([number.setdefault(labels[k], len(number)) for k in order])
    asking = np.array([asks is None or asks[k] for k in order])
    out = []

    def try_link(x: int, y: int) -> None:
        if group.label[x] != group.label[y]:
            out.append((names[order[x]], names[order[y]]))
            group.join(x, y)

    for x in range(len(order)):
        low = int(np.searchsorted(group.sizes[:x], -(-percent * int(group.sizes[x]) // 100)))
        if low == x:
            continue
        if asks is None and x - low > 8:  # a close one, often of a large component
            t = group.tokens[x]
            near = [int(group.postings[at - 1]) for at in {int(np.searchsorted(group.postings[group.low[k] : group.high[k]], x)) + int(group.low[k]) for k in t[:: max(1, len(t) // 4)]} if at > 0]
            for y in {y for y in near if low <= y < x}:
                if group.label[x] != group.label[y] and group.links(x, y, group.overlap(x, y)):
                    try_link(x, y)
        for y in group.search(x, slice(low, x), None if asks is None or asking[x] else asking):
            try_link(x, y)
    return out


def _searched(rows: DataFrame, percent: int, deep: bool) -> DataFrame:
    """Runs ``search_group`` on each value of ``key``; rows of a key are in one task, in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, {}

        def flush() -> pa.RecordBatch | None:
            if len(held) < 2:
                return None
            rows_ = list(held.values())
            found = search_group([r[0] for r in rows_], [np.frombuffer(r[1], np.uint64) for r in rows_], percent, *([[r[2] for r in rows_], [r[3] for r in rows_]] if deep else []))
            return pa.RecordBatch.from_arrays([pa.array([a for a, _ in found], pa.binary()), pa.array([b for _, b in found], pa.binary())], ["u", "v"]) if found else None

        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in (["class", "shingles", "label", "asks"] if deep else ["class", "shingles"])]
            for k, row in zip(batch.column("key").to_pylist(), zip(*columns)):
                if k != key:
                    if (out := flush()) is not None:
                        yield out
                    key, held = k, {}
                held.setdefault(row[0], row)  # a class may come from several tasks
        if (out := flush()) is not None:
            yield out

    return rows.repartition("key").sortWithinPartitions("key").mapInArrow(textnum.lean(run), "u binary, v binary")


def _shingles_of(docs: DataFrame, wanted: np.ndarray, cfg: Settings) -> DataFrame:
    """(class, shingles) of the classes that a filter of fixed size may hold."""
    held = docs.sparkSession.sparkContext.broadcast(wanted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()  # of this task
        for batch in batches:
            for part in textnum.slices(batch):
                sets, _ = textnum.shingle_sets(textnum.Texts(part.column("text")), cfg.words)
                classes = {_digest(s): s for s in sets if len(s)}
                kept = {c: s for c, s in classes.items() if c not in done and may_hold(held.value, c)}
                done.update(kept)
                yield pa.RecordBatch.from_arrays([pa.array(list(kept), pa.binary()), pa.array([s.tobytes() for s in kept.values()], pa.binary())], ["class", "shingles"])

    return docs.select("text").mapInArrow(textnum.lean(run), "class binary, shingles binary")


def _links(docs: DataFrame, candidates: DataFrame, cfg: Settings) -> DataFrame:
    """Links between classes, enough of them for the components.  candidates: (node, root, n)."""
    sizes = candidates.groupBy("root").agg(F.count("*").alias("docs"), F.sum("n").alias("total"))
    # large sets of candidates are dealt into blocks
    sizes = sizes.select("root", F.ceil(F.greatest(F.col("docs") / cfg.group_docs, F.col("total") / cfg.group_shingles)).cast("int").alias("blocks"))
    places = written(candidates.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks"))).select("node", "root", "blocks", "block"), "places")
    shingles = _shingles_of(docs, filter_of(candidates, "node"), cfg)
    # some classes of a dealt set stand in each of its blocks: they tie the parts of a large component
    salted = places.where("blocks > 1").groupBy("root", "blocks", F.pmod(F.xxhash64("node", F.lit(2)), F.lit(cfg.pivots)).alias("salt")).agg(F.min("node").alias("node"))
    pivots = salted.select("node", "root", "blocks", F.explode(F.expr("sequence(cast(0 as bigint), blocks - 1L)")).alias("block"))
    placed = places.unionByName(pivots)
    placed = placed.join(shingles, placed["node"] == shingles["class"]).select("class", "root", "blocks", "block", "shingles")
    local = placed.select(F.concat("root", F.lit(b"/"), F.col("block").cast("string").cast("binary")).alias("key"), "class", "shingles")
    found = _searched(local, cfg.percent, False)
    if places.where("blocks > 1").isEmpty():
        return found
    found = written(found, "links")
    # those outside the largest component of a dealt set ask all blocks
    large = placed.where("blocks > 1").dropDuplicates(["class"])
    so_far = components(found)
    large = written(large.join(so_far.withColumnsRenamed({"node": "class", "root": "found"}), "class", "left").withColumn("label", F.coalesce("found", "class")).drop("found"), "large")
    sizes = large.groupBy("root", "label").agg(F.count("*").alias("k"))
    main = sizes.groupBy("root").agg(F.max_by("label", F.struct("k", "label")).alias("main"))
    large = large.join(main, "root").withColumn("asks", F.col("label") != F.col("main"))
    asking = large.where("asks")
    parts = asking.groupBy("root").agg(F.ceil(F.greatest(F.count("*") / cfg.group_docs, F.sum(F.length("shingles") / 8) / cfg.group_shingles)).cast("int").alias("ask_blocks"))
    large = large.join(parts, "root")
    cell = lambda a, b: F.concat("root", F.lit(b"/"), F.concat_ws("/", a, b).cast("binary")).alias("key")
    askers = asking.join(parts, "root").withColumn("part", F.pmod(F.xxhash64("class", F.lit(1)), F.col("ask_blocks"))).withColumn("at", F.explode(F.expr("sequence(0, blocks - 1)"))).select(cell(F.col("at").cast("string"), F.col("part").cast("string")), "class", "shingles", "label", "asks")
    asked = large.withColumn("part", F.explode(F.expr("sequence(0, ask_blocks - 1)"))).select(cell(F.col("block").cast("string"), F.col("part").cast("string")), "class", "shingles", "label", F.lit(False).alias("asks"))
    # a class in both roles comes once, as one that asks
    both = askers.unionByName(asked).groupBy("key", "class").agg(F.first("shingles").alias("shingles"), F.first("label").alias("label"), F.max("asks").alias("asks"))
    found = found.unionByName(written(_searched(both, cfg.percent, True), "links"))
    store.drop(docs.sparkSession, places, large)
    return found


def _classes(docs: DataFrame, cfg: Settings) -> tuple[DataFrame, DataFrame]:
    """Documents (doc_id, n, class), and of each class its component: (class, n, least doc_id of the class, copies, root or null)."""
    docs = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = written(profiles(docs, cfg), "profiles")
    counts = np.minimum(reduced(rows.where("part is not null"), np.int32, np.int64, np.add), 2**31 - 1).astype(np.int32)
    of_docs = written(rows.where("part is null").select("doc_id", "n", "class"), "sets")
    store.drop(docs.sparkSession, rows)  # the counts of a task take more than its documents
    least = of_docs.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("least"), F.first("n").alias("n"), F.count("*").alias("copies"))
    if not len(counts):
        return of_docs, least.withColumn("root", F.lit(None).cast("binary"))
    sized = least.select(F.col("class").alias("node"), "n")
    lists: list[DataFrame] = []
    candidates = written(components(_ties(docs, counts, cfg, lists)).join(sized, "node"), "candidates")
    store.drop(docs.sparkSession, *lists)
    store.settle(docs.sparkSession)
    roots = written(components(_links(docs, candidates, cfg)), "roots")
    store.drop(docs.sparkSession, candidates)
    store.settle(docs.sparkSession)
    return of_docs, least.join(roots, least["class"] == roots["node"], "left").select("class", "n", "least", "copies", "root")


def join(docs: DataFrame, cfg: Settings = Settings()) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): size of its set and the smallest doc_id of its component."""
    of_docs, classes = _classes(docs, cfg)
    tops = classes.where("root is not null").groupBy("root").agg(F.min("least").alias("top"))
    known = classes.select("class", "least", "root").join(tops, "root", "left").select("class", F.coalesce("top", "least").alias("least"))
    out = of_docs.where("n > 0").join(known, "class").select("doc_id", F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))
    return out.unionByName(of_docs.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id")))


def distinct(docs: DataFrame, cfg: Settings = Settings(words=5, percent=80)) -> DataFrame:
    """``docs`` with one row of each component, that of the smallest doc_id; rows without words all stay.

    Of several rows with that doc_id and set of shingles, the one with the least text stays.
    A filter of fixed size holds the classes of several rows and those of components; only
    rows that it may hold are dealt with their texts, all others stay where they are.
    """
    _, classes = _classes(docs, cfg)
    alone = classes.where("root is null").select("class", "least")
    first = F.min(F.struct(F.col("least").isNull().alias("none"), "least", "class")).alias("x")
    chosen = alone.unionByName(classes.where("root is not null").groupBy("root").agg(first).select("x.class", "x.least")).toDF("_class", "_least")
    touched = docs.sparkSession.sparkContext.broadcast(filter_of(classes.where("copies > 1 or root is not null"), "class"))
    names = docs.columns
    spare, ranked = store.spare(names, "_ngram_join_class"), store.spare(names, "_ngram_join_rank")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in textnum.slices(batch):
                sets, _ = textnum.shingle_sets(textnum.Texts(part.column("text")), cfg.words)
                keys = (_digest(s) if len(s) else None for s in sets)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array([k if k and may_hold(touched.value, k) else None for k in keys], pa.binary())], [*part.schema.names, spare])

    fields = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), f"{spare} binary"])
    keyed = docs.mapInArrow(textnum.lean(run), fields)
    # the same plan at every size: the chosen rows grow with the input, so they're never broadcast
    same = (keyed[spare] == chosen["_class"]) & keyed["doc_id"].cast("bigint").eqNullSafe(chosen["_least"])
    kept = keyed.join(chosen.hint("shuffle_hash"), same, "left_semi")
    rank = F.row_number().over(Window.partitionBy(spare, "doc_id").orderBy("text"))
    kept = kept.withColumn(ranked, rank).where(F.col(ranked) == 1).select(*names)
    return kept.unionByName(keyed.where(F.col(spare).isNull()).select(*names))
