"""WARC archives of pages, in which a repeated payload is stored once.

1. Headers (page_id, url, payload digest) are shuffled by digest.  Of equal payloads the
   page with the largest page_id is the response; the others revisit it.
2. Each page gets a record with fresh headers: a response with its payload, or a revisit
   that names its original by its URI and date.  Spark's text sink writes them; its separator is the two
   line ends that close a WARC record, so its gzip files are archives.
3. Reading back, archives are parsed by Content-Length and payload digests verified;
   revisits are joined to their originals by digest.

Defined cases: a null html is an empty payload; payloads under ``least_bytes`` are all
responses; rows with one payload and the largest page_id twice are both responses; a
null page_id is below all others, and alone a response; a null url becomes
``urn:page:<page_id>``, control characters and spaces in one are escaped; other columns
are ignored; an empty table gives no records.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator
from datetime import datetime, timezone

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyframe.llm import textnum
from tallyframe.llm.filters import filter_of, may_hold
from tallyframe.llm.store import fresh_path, written

#: Names of the format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
#: Records in a file at most.
FILE_RECORDS = 500
RECORD = "page_id bigint, record_type string, refers_to bigint, payload_digest string, payload_bytes bigint, payload binary"


def base32(hexadecimal: str) -> Column:
    """Base32 of a column of 40 hexadecimal digits: each five of them are four characters."""
    return F.expr(f"array_join(transform(sequence(0, 31), i -> substr('{BASE32}', cast((shiftright(cast(conv(substr({hexadecimal}, (i div 4) * 5 + 1, 5), 16, 10) as int), 15 - 5 * cast(i % 4 as int)) & 31) + 1 as int), 1)), '')")


def _name(sha: Column, *more: Column) -> Column:
    """16 bytes for a payload, or for a payload and what else is given."""
    return F.unhex(F.md5(F.concat_ws(":", sha, *(F.coalesce(x.cast("string"), F.lit("null")) for x in more)).cast("binary")))


def _maybe(bits: np.ndarray, spark: SparkSession):
    """A test of names against a filter, by batches of names alone."""
    held = spark.sparkContext.broadcast(bits)

    @F.pandas_udf("boolean")
    def test(names: pd.Series) -> pd.Series:
        return pd.Series([may_hold(held.value, x) for x in names], dtype=bool)

    return test


def resolved(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """(page_id, url, html, digest, record_type, refers_to, refers_to_url) of each page; revisits have no html.

    Headers alone decide.  Two filters of fixed size say which pages can have a repeated
    payload, and which of those can be the response; only these go by a shuffle with their
    html, so of a repeated payload one copy does, and of the others none.
    """
    spark = pages.sparkSession
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("bigint").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html")).withColumn("sha", F.sha1(F.col("html").cast("binary")))
    heads = written(rows.select("page_id", "url", "sha", F.octet_length("html").alias("bytes")), "heads")
    groups = heads.where((F.col("bytes") >= least_bytes) & F.col("page_id").isNotNull()).groupBy("sha").agg(F.max(F.struct("page_id", "url")).alias("top"))
    copies = heads.where(F.col("bytes") >= least_bytes).groupBy("sha").agg(F.count("*").alias("copies")).where("copies > 1").select("sha")
    repeated = written(groups.join(copies, "sha").select("sha", F.col("top.page_id").alias("original"), F.col("top.url").alias("original_url")), "repeated")
    maybe_repeated = _maybe(filter_of(repeated.select(_name(F.col("sha")).alias("name")), "name"), spark)
    able = heads.where(maybe_repeated(_name(F.col("sha")))).join(repeated.hint("merge"), "sha", "left")
    revisit = F.col("original").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("original"))
    kept = able.where(~revisit).select("sha", F.col("page_id").alias("kept")).distinct()
    maybe_kept = _maybe(filter_of(kept.select(_name(F.col("sha"), F.col("kept")).alias("name")), "name"), spark)
    alone = rows.where(~maybe_repeated(_name(F.col("sha"))))
    firsts = rows.where(maybe_repeated(_name(F.col("sha")))).where(maybe_kept(_name(F.col("sha"), F.col("page_id"))))
    firsts = firsts.join(kept.withColumnRenamed("sha", "kept_sha"), (F.col("sha") == F.col("kept_sha")) & F.col("page_id").eqNullSafe(F.col("kept")), "left_semi")
    none = lambda kind: F.lit(None).cast(kind)
    responses = alone.unionByName(firsts).select("page_id", "url", "html", "sha", F.lit("response").alias("record_type"), none("bigint").alias("refers_to"), none("string").alias("refers_to_url"))
    revisits = able.where(revisit).select("page_id", "url", none("string").alias("html"), "sha", F.lit("revisit").alias("record_type"), F.col("original").alias("refers_to"), F.col("original_url").alias("refers_to_url"))
    return responses.unionByName(revisits).withColumn("digest", base32("sha")).drop("sha")


def _uri(url: Column, page_id: Column) -> Column:
    return F.coalesce(F.regexp_replace(url, r"[\x00-\x20\x7f]+", "%20"), F.concat(F.lit("urn:page:"), F.coalesce(page_id.cast("string"), F.lit("null"))))


def records(found: DataFrame, date: str | None = None) -> DataFrame:
    """The text of each record, without its end; ``date`` is now, if none is given."""
    date = date or datetime.now(timezone.utc).strftime("%Y-%m-%dT%H:%M:%SZ")
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    response = F.col("record_type") == "response"
    name = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length("html").cast("string"), F.lit(END))
    # the place among all records makes an id its own, even of equal rows
    mark = F.md5(F.concat_ws(":", F.lit(date), F.col("digest"), name, F.col("place").cast("string")).cast("binary"))
    uuid = F.concat_ws("-", *(F.substr(mark, F.lit(a), F.lit(n)) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    rows = found.withColumn("place", F.monotonically_increasing_id()).withColumn("block", F.when(response, F.concat(http, "html")).otherwise(F.lit("")))
    value = F.concat(
        F.lit(f"{VERSION}\r\n"), line("WARC-Type", F.col("record_type")), line("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), uuid, F.lit(">"))), line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _uri(F.col("url"), F.col("page_id"))), line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.when(response, F.lit("")).otherwise(F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To-Target-URI", _uri(F.col("refers_to_url"), F.col("refers_to"))), line("WARC-Refers-To-Date", F.lit(date)), line("X-Refers-To-Page", F.coalesce(F.col("refers_to").cast("string"), F.lit("null"))))),
        line("X-Page", name), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length("block").cast("string")), F.lit("\r\n"), F.col("block"),
    )
    return rows.select(value.alias("value"))


def write(pages: DataFrame, path: str, least_bytes: int = 0, file_records: int = FILE_RECORDS) -> None:
    """Archives of ``pages`` (page_id, url, html) below ``path``."""
    out = records(resolved(pages, least_bytes)).write.option("lineSep", END).option("compression", "gzip").option("maxRecordsPerFile", file_records)
    out.option("zlib.compress.level", "BEST_SPEED").text(path)


def parsed(chunks: Iterator[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an archive that comes in pieces."""
    held, headers, need = bytearray(), None, 0
    for chunk in chunks:
        held += chunk
        at = 0
        while True:
            if headers is None:
                stop = held.find(END.encode(), at)
                if stop < 0:
                    break
                first, *lines = held[at:stop].decode().split("\r\n")
                if first != VERSION:
                    raise ValueError(f"no WARC record where one should begin: {first[:40]!r}")
                headers = dict(x.split(": ", 1) for x in lines)
                at, need = stop + len(END), int(headers["Content-Length"])
            if len(held) - at < need + len(END):
                break
            block = bytes(held[at : at + need])
            if held[at + need : at + need + len(END)] != END.encode():
                raise ValueError("a WARC record doesn't end where it should")
            yield headers, block
            at += need + len(END)
            headers = None
        del held[:at]
    if held.strip() or headers is not None:
        raise ValueError("an archive ends within a record")


def _unzipped(content: memoryview, step: int = 1 << 20) -> Iterator[bytes]:
    """The bytes of a gzip file of any number of members, from pieces of the file that are each copied once."""
    member = None
    for at in range(0, len(content), step):
        rest = bytes(content[at : at + step])
        while rest:
            member = member or zlib.decompressobj(31)
            out = member.decompress(rest, step)
            rest = member.unused_data if member.eof else member.unconsumed_tail
            if member.eof:
                member = None
            if out:
                yield out
        while member is not None and (out := member.decompress(b"", step)):  # what the limit held back
            yield out
        if member is not None and member.eof:
            member = None
    if member is not None:
        raise ValueError("a gzip member ends too early")


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of archives; each response's payload is checked against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                size = 0
                for headers, block in parsed(_unzipped(memoryview(content.as_buffer()))):
                    page = headers["X-Page"]
                    digest = headers["WARC-Payload-Digest"].removeprefix("sha1:")
                    payload, refers = None, None
                    if headers["WARC-Type"] == "response":
                        payload = block[block.index(END.encode()) + len(END) :]
                        if base64.b32encode(hashlib.sha1(payload).digest()).decode() != digest:
                            raise ValueError(f"the payload of page {page} doesn't have its digest")
                    else:
                        refers = headers["X-Refers-To-Page"]
                    rows.append((None if page == "null" else int(page), headers["WARC-Type"], int(refers) if refers is not None else None, digest, None if payload is None else len(payload), payload if payloads else None))
                    size += len(block)
                    if size > 4_000_000:
                        yield _batch(rows)
                        rows, size = [], 0
                if rows:
                    yield _batch(rows)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(textnum.lean(run), RECORD)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], ["page_id", "record_type", "refers_to", "payload_digest", "payload_bytes", "payload"])


def rejoined(found: DataFrame) -> DataFrame:
    """``read`` records, in which revisits have the length (and the payload, if read) of their originals."""
    responses = found.where("record_type = 'response'")
    originals = responses.groupBy("payload_digest").agg(F.max("payload_bytes").alias("n"), F.first("payload").alias("p"))
    revisits = found.where("record_type = 'revisit'").join(originals, "payload_digest")
    columns = ["page_id", "record_type", "refers_to", "payload_digest"]
    return responses.select(*columns, "payload_bytes", "payload").unionByName(revisits.select(*columns, F.col("n").alias("payload_bytes"), F.col("p").alias("payload")))


def archived(pages: DataFrame, least_bytes: int = 0, path: str | None = None) -> DataFrame:
    """Writes archives (in the shared folder, if no path is given) and returns what reading them shows of each page."""
    spark = pages.sparkSession
    path = path or fresh_path(spark, "warc")
    write(pages, path, least_bytes)
    found = written(read(spark, path, payloads=False).drop("payload"), "records").withColumn("payload", F.lit(None).cast("binary"))
    return rejoined(found).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
