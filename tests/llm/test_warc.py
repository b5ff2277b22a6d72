import base64
import hashlib
import random

import pytest

from tallyframe.llm import warc


def brute(pages, least):
    most = {}
    for i, _, h in pages:
        h = (h or "").encode()
        if len(h) >= least and i is not None:
            most[h] = max(i, most.get(h, i))
    out = []
    for i, _, h in pages:
        h = (h or "").encode()
        revisit = h in most and most[h] != i
        out.append((i, len(h), base64.b32encode(hashlib.sha1(h).digest()).decode(), "revisit" if revisit else "response", most[h] if revisit else None))
    return sorted(out, key=repr)


def corpus():
    rng = random.Random(4)
    bodies = ["", "<p>é🎉</p>", "a\r\n\r\nWARC/1.1\r\nContent-Length: 5\r\n\r\nb", "\r\n\r\n", "x" * 300_000, *("<html>" + "".join(rng.choice("abc \n") for _ in range(rng.choice([10, 3000]))) for _ in range(20))]
    pages = [(i, f"http://h/{i}", rng.choice(bodies)) for i in range(150)]
    return pages + [(200, None, None), (201, "a b\r\nX-Page: 9", "<p>unique</p>"), (None, "u", "<i>only here</i>"), (None, "u", bodies[1]), (7, "again", pages[7][2]), (300, "u", "twice"), (300, "u", "twice")]


@pytest.mark.parametrize("least", [0, 12])
def test_round_trip_against_brute_force(spark, least):
    pages = corpus()
    frame = spark.createDataFrame([(i, u, h, "clash", 1) for i, u, h in pages], "page_id long, url string, html string, sha string, original int").repartition(3)
    got = sorted((tuple(r) for r in warc.archived(frame, least).collect()), key=repr)
    assert got == brute(pages, least)


def test_payloads_come_back_and_are_stored_once(spark, tmp_path):
    pages = corpus()
    frame = spark.createDataFrame(pages, "page_id long, url string, html string")
    path = str(tmp_path / "archives")
    warc.write(frame, path, file_records=20)
    found = warc.read(spark, path)
    stored = [bytes(r.payload) for r in found.collect() if r.payload is not None]
    assert len(stored) == len(set(stored)) + 1  # page 300 is there twice
    assert sorted(((r.page_id, bytes(r.payload).decode()) for r in warc.rejoined(found).collect()), key=repr) == sorted(((i, h or "") for i, _, h in pages), key=repr)


def test_record_ids_are_unique_and_revisits_name_their_original(spark, tmp_path):
    pages = corpus() + [(9, "same", "row")] * 3
    path = tmp_path / "archives"
    warc.write(spark.createDataFrame(pages, "page_id long, url string, html string"), str(path), file_records=20)
    headers = [h for f in path.glob("part-*") for h, _ in warc.parsed(warc._unzipped(memoryview(f.read_bytes()), 100))]
    assert len({h["WARC-Record-ID"] for h in headers}) == len(headers) == len(pages)
    targets = {(h["X-Page"], h["WARC-Target-URI"]) for h in headers if h["WARC-Type"] == "response"}
    assert all((h["X-Refers-To-Page"], h["WARC-Refers-To-Target-URI"]) in targets and h["WARC-Refers-To-Date"] for h in headers if h["WARC-Type"] == "revisit")


def test_a_damaged_archive_is_refused():
    record = b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
    assert [(h["Content-Length"], b) for h, b in warc.parsed(iter([record[:20], record[20:31], record[31:] + record]))] == [("3", b"abc")] * 2
    for bad in (record[:-3], record.replace(b"3", b"2"), b"x" + record):
        with pytest.raises(ValueError):
            list(warc.parsed(iter([bad])))


def test_empty_table(spark):
    assert warc.archived(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
