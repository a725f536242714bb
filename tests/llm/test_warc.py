import base64
import hashlib

import pytest

from lexengine.llm import warc
from lexengine.llm.common import table

SCHEMA = "page_id long, url string, html string, row string, response int"


def brute(rows, least=0):
    top = {}
    for i, h in rows:
        top[h or ""] = max(top.get(h or "", -1), i)
    out = {}
    for i, h in rows:
        b = (h or "").encode()
        revisit = len(b) >= least and top[h or ""] != i
        out[i] = (len(b), base64.b32encode(hashlib.sha1(b).digest()).decode(), "revisit" if revisit else "response", top[h or ""] if revisit else None)
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_round_trip(spark, version):
    pages = table(spark, "/root/testdata/sf0.001", "pages")
    rows = [(r.page_id, r.html) for r in pages.collect()] + [(1000, ""), (1001, None), (1002, "x\r\n\r\nWARC/1.1\r\n"), (1003, "x\r\n\r\nWARC/1.1\r\n"), (1004, "filedesc://x 1\n")]
    docs = spark.createDataFrame([(i, f"http://x/{i} y", h, "", 0) for i, h in rows], SCHEMA)
    for least in (0, 5):
        found = warc.read_warc(spark, warc.convert(docs, version, least, pages_per_file=7))
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found.collect()} == brute(rows, least)


def test_edges(spark):
    rows = [(4, None, "a", "", 1), (4, None, "a", "", 1), (None, "u", "b", "", 1)]
    found = sorted((r.page_id or -1, r.record_type, r.refers_to) for r in warc.read_warc(spark, warc.convert(spark.createDataFrame(rows, SCHEMA))).collect())
    assert found == [(-1, "response", None), (4, "response", None), (4, "revisit", 4)]
    assert warc.read_warc(spark, warc.convert(spark.createDataFrame([], SCHEMA))).count() == 0


def test_any_url(spark):
    urls = ["filedesc://part-0.arc", "filedesc://x 1", "filedesc://", " ", "", "a\r\nContent-Length: 5", "\x85\u2028é", "WARC/1.1", "1 0 x", "http://a b?c#d"]
    rows = [(i, u, f"1 0 lexengine {i % 4}\n", "", 1) for i, u in enumerate(urls * 2)]
    for version in (1, 2):
        found = warc.read_warc(spark, warc.convert(spark.createDataFrame(rows, SCHEMA), version)).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in found} == brute([(r[0], r[2]) for r in rows])
        assert {r.url for r in found if "filedesc" in r.url} == {"filedesc://part-0.arc", "filedesc://x%201", "filedesc://"}


def test_files_are_cut_by_their_characters(spark):
    rows = [(i, f"u{i}", "é" * 1000 if i % 2 else f"x{i % 3}", "", 1) for i in range(30)] + [(99, "u", "long " * 5000, "", 1)]
    docs = spark.createDataFrame(rows, SCHEMA).coalesce(1)
    folder = warc.convert(docs, file_chars=5000)
    sizes = [len(warc._inflated(bytes(r.content)).decode()) for r in warc._files(spark, folder).collect()]
    # Each file but that of the long page stays below the bound, with room for the last end of a record.
    assert len(sizes) > 5 and sorted(sizes)[-2] <= 5200 < 25000 < max(sizes)
    assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in warc.read_warc(spark, folder).collect()} == brute([(r[0], r[2]) for r in rows])


def test_versions_and_broken_records():
    one = warc.arc_filedesc(1, 0) + "\nhttp://a 1.2.3.4 20200102030405 text/html 3\nabc\n"
    two = warc.arc_filedesc(2, 0) + "\nhttp://a 1.2.3.4 20200102030405 text/html 200 - - 0 f.arc 3\nabc\n"
    for text in (one, two):
        (r,) = warc.parse_arc(text.encode())
        assert (r["url"], r["mime"], r["content"]) == ("http://a", "text/html", b"abc")
    for bad in (one.replace("html 3", "html 30"), one.replace("html 3", "html x"), one.replace("text/html 3", "text/html 200 3")):
        with pytest.raises(ValueError):
            list(warc.parse_arc(bad.encode()))
