"""Legacy web archives: ARC files are parsed and converted to WARC files.

ARC (versions 1 and 2) gives each record one header line with blank-separated fields, the last of
which declares the length of the content. The file's first record, filedesc, names the version and so
the fields. The converter reads records by the declared lengths and makes up what WARC needs: record
identifiers, ISO timestamps, record types and digests.

Archives are written and read by Spark, so they may lie in any store that Spark reaches: records are
text (their payloads are UTF-8), written by the text writer as gzip files, and whole files come back
through the binary reader. A file holds a bounded number of records and of characters (but for one record that
is longer alone), so what a task holds at once does not grow with the length of pages.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lexengine.llm.common import BATCH_BYTES, in_arrow, join_hot, shared_dir, stored, table

#: Records in one archive file, and characters unless one record has more.
PAGES_PER_FILE, FILE_CHARS = 2000, 16 << 20
#: Payloads of fewer bytes are never revisits.
REVISIT_BYTES = 0

#: The fields of an ARC header line by version; the last one is the declared length.
ARC_FIELDS = {
    1: ("url", "ip", "date", "mime", "length"),
    2: ("url", "ip", "date", "mime", "status", "checksum", "location", "offset", "filename", "length"),
}
ARC_NAMES = {
    1: "URL IP-address Archive-date Content-type Archive-length",
    2: "URL IP-address Archive-date Content-type Result-code Checksum Location Offset Filename Archive-length",
}
CAPTURED, ADDRESS = "20240101000000", "0.0.0.0"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
PAGE_HEADER, REFERS_HEADER = "X-Page-Id", "X-Refers-To-Page-Id"
WARC_END = "\r\n\r\n"


def base32_sha1(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def _http(page_id: int | None, body_bytes: int) -> str:
    key = "" if page_id is None else page_id
    return f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{PAGE_HEADER}: {key}\r\nContent-Length: {body_bytes}\r\n\r\n"


def _header(block: bytes, name: str) -> str | None:
    found = re.search(rb"(?im)^" + re.escape(name.encode()) + rb":[ \t]*([^\r\n]*)", block)
    return found[1].decode() if found and found[1] else None


def arc_filedesc(version: int, number: int) -> str:
    """The first record of an ARC file; its content names the version and the fields."""
    content = f"{version} 0 lexengine\n{ARC_NAMES[version]}\n\n"
    fields = {"url": f"filedesc://part-{number}.arc", "ip": ADDRESS, "date": CAPTURED, "mime": "text/plain"}
    return _arc_record(version, fields, content.encode())


def _arc_record(version: int, fields: dict[str, str], content: bytes) -> str:
    line = " ".join(re.sub(r"\s", "%20", fields.get(f) or "-") for f in ARC_FIELDS[version][:-1])
    return f"{line} {len(content)}\n{content.decode()}"


def _filled(records: Iterable[str], end: str, most: int, chars: int) -> Iterator[str]:
    """The records file by file, with end between them: at most so many, and so many characters unless one has more."""
    held, size = [], 0
    for record in records:
        if held and (len(held) == most or size + len(record) > chars):
            yield end.join(held)
            held, size = [], 0
        held.append(record)
        size += len(record)
    if held:
        yield end.join(held)


def _write_files(df: DataFrame, files, path: str, end: str) -> None:
    """Each row that files (a function over Arrow batches) makes becomes a gzip file, with end behind it."""
    writer = in_arrow(df, files, "value string").write.option("maxRecordsPerFile", 1)
    writer.option("compression", "gzip").option("lineSep", end).text(path)


def write_arc(pages: DataFrame, version: int, path: str, pages_per_file: int = PAGES_PER_FILE, file_chars: int = FILE_CHARS) -> None:
    """pages (page_id, url, html) as ARC files, each with a filedesc in front."""

    def record(page_id: int | None, url: str | None, html: str | None) -> str:
        body = (html or "").encode()
        content = _http(page_id, len(body)).encode() + body
        return _arc_record(version, {"url": url or "unknown:", "ip": ADDRESS, "date": CAPTURED, "mime": "text/html", "status": "200", "offset": "0", "filename": "part.arc"}, content)

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        records = (record(*(column[i].as_py() for column in batch.columns)) for batch in batches for i in range(batch.num_rows))
        for number, content in enumerate(_filled(records, "\n", pages_per_file, file_chars)):
            yield pa.RecordBatch.from_pydict({"value": [f"{arc_filedesc(version, number)}\n{content}"]})

    _write_files(pages.select("page_id", "url", "html"), files, path, "\n")


def _inflated(data: bytes) -> bytes:
    """All gzip members of a file; a file that is not compressed comes back as it is."""
    if data[:2] != b"\x1f\x8b":
        return data
    parts = []
    while data:
        one = zlib.decompressobj(31)
        parts.append(one.decompress(data) + one.flush())
        data = one.unused_data
    return b"".join(parts)


def parse_arc(data: bytes) -> Iterator[dict]:
    """The records of an ARC file but for its filedesc: the header's fields and content.

    Only the first record can be the filedesc, and only if its content begins with a version; any other record may have any url.
    """
    at, fields, first = 0, ARC_FIELDS[1], True
    while at < len(data):
        end = data.find(b"\n", at)
        line = data[at : end if end >= 0 else len(data)]
        if not line.strip():
            at += len(line) + 1
            continue
        values = line.decode().split(" ")
        if not values[-1].isdigit():
            raise ValueError(f"no declared length in {line[:80]!r}")
        content = data[end + 1 : end + 1 + int(values[-1])]
        if len(content) != int(values[-1]):
            raise ValueError(f"the record at {at} is cut off")
        at = end + 1 + len(content)
        head, first = first and line.startswith(b"filedesc://") and re.match(rb"([0-9]+) [0-9]+ ", content), False
        if head:
            if int(head[1]) not in ARC_FIELDS:
                raise ValueError(f"version {int(head[1])} is not known")
            fields = ARC_FIELDS[int(head[1])]
            continue
        if len(values) != len(fields):
            raise ValueError(f"{len(values)} fields where the version has {len(fields)}")
        yield dict(zip(fields, values, strict=True)) | {"content": content}


def _arc_rows(data: bytes) -> Iterator[dict]:
    """What the converter needs of each record: page_id, url, captured, the body and its length and digest."""
    for r in parse_arc(_inflated(data)):
        head, _, body = r["content"].partition(b"\r\n\r\n")
        key, d = _header(head, PAGE_HEADER), r["date"]
        yield {
            "page_id": None if key is None else int(key),
            "url": r["url"],
            "captured": f"{d[:4]}-{d[4:6]}-{d[6:8]}T{d[8:10]}:{d[10:12]}:{d[12:14]}Z",
            "body": body.decode(),
            "payload_bytes": len(body),
            "payload_digest": base32_sha1(body),
        }


_ARC_ROWS = pa.schema([("row", pa.struct([("file", pa.string()), ("number", pa.int64())])), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string())])


def _files(spark: SparkSession, path: str) -> DataFrame:
    """file (its name) and content of each file in path."""
    return spark.read.format("binaryFile").load(path).select(F.regexp_extract("path", "[^/]*$", 0).alias("file"), "content")


def read_arc(spark: SparkSession, path: str) -> DataFrame:
    """Each record's place (row: file and number), page_id and the length and digest of its body."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                file = batch.column(0)[i].as_py()
                found = [{n: r[n] for n in _ARC_ROWS.names[1:]} | {"row": {"file": file, "number": k}} for k, r in enumerate(_arc_rows(batch.column(1)[i].as_py()))]
                yield pa.RecordBatch.from_pylist(found, schema=_ARC_ROWS)

    return in_arrow(_files(spark, path), rows, "row struct<file:string,number:bigint>, page_id long, payload_bytes long, payload_digest string")


def _record_id(*parts: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, '|'.join(map(str, parts)))}>"


def warc_record(r: dict, response: bool, keeper: int | None) -> str:
    """A WARC record without its end: response with the payload, revisit with the HTTP head alone."""
    block = _http(r["page_id"], r["payload_bytes"]) + (r["body"] if response else "")
    raw = block.encode()
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if response else 'revisit'}",
        f"WARC-Record-ID: {_record_id(r['page_id'], r['url'], r['captured'], r['payload_digest'])}",
        f"WARC-Date: {r['captured']}",
        f"WARC-Target-URI: {r['url']}",
        f"WARC-Payload-Digest: sha1:{r['payload_digest']}",
        f"WARC-Block-Digest: sha1:{base32_sha1(raw)}",
        "Content-Type: application/http; msgtype=response",
    ]
    if not response:
        lines += [f"WARC-Profile: {REVISIT_PROFILE}", f"{REFERS_HEADER}: {'' if keeper is None else keeper}"]
    lines += [f"Content-Length: {len(raw)}"]
    return "\r\n".join(lines) + "\r\n\r\n" + block


def with_types(records: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Adds response (boolean) and keeper: of equal payloads the record with the largest page_id answers.

    Records that also share their page_id are told apart by their place in the archive (row).
    """
    rows = records.count()
    long = records.filter(F.col("payload_bytes") >= least)
    groups = long.groupBy("payload_digest").agg(F.max(F.struct("page_id", "row")).alias("top"), F.count(F.lit(1)).alias("copies"))
    typed = join_hot(long, groups, "payload_digest", "copies", rows)
    typed = typed.withColumns({"response": F.col("row") == F.col("top.row"), "keeper": F.col("top.page_id")}).drop("top", "copies")
    short = records.filter(F.col("payload_bytes") < least).withColumns({"response": F.lit(True), "keeper": F.col("page_id")})
    return typed.unionByName(short)


def write_warc(arc: DataFrame, typed: DataFrame, path: str, records_per_file: int = PAGES_PER_FILE, file_chars: int = FILE_CHARS) -> None:
    """Converts the files in arc (file, content); typed says of each record whether it answers.

    What is said of the records of one file meets in one row; that is bounded, as the file is.
    """
    said = typed.groupBy("row.file").agg(F.array_sort(F.collect_list(F.struct("row.number", "response", "keeper"))).alias("said"))

    def files(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                own = batch.column(1)[i].as_py()
                records = (warc_record(r, o["response"], o["keeper"]) for r, o in zip(_arc_rows(batch.column(0)[i].as_py()), own, strict=True))
                for content in _filled(records, WARC_END, records_per_file, file_chars):
                    yield pa.RecordBatch.from_pydict({"value": [content]})

    _write_files(arc.join(said, "file").select("content", "said"), files, path, WARC_END)


def parse_warc(data: bytes) -> Iterator[tuple[bytes, bytes]]:
    """(header, block) of each record, by the declared Content-Length."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end]
        if not head.startswith(b"WARC/"):
            raise ValueError(f"no record at {at}")
        length = int(_header(head, "Content-Length"))
        block = data[end + 4 : end + 4 + length]
        if len(block) != length:
            raise ValueError(f"the record at {at} is cut off")
        yield head, block
        at = end + 4 + length + 4


_WARC_ROWS = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("url", pa.string()), ("payload", pa.binary())])


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """The records of all WARC files in path.

    A response's length and digest are taken from the payload itself, which must match the declared
    digest; a revisit, which has no payload, tells both in its headers. A record without a page_id has null there, records
    that repeat come each, and archives without records give no rows.
    """

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                out, held = {n: [] for n in _WARC_ROWS.names}, 0
                for head, block in parse_warc(_inflated(batch.column(0)[i].as_py())):
                    http, _, body = block.partition(b"\r\n\r\n")
                    kind = _header(head, "WARC-Type")
                    said = _header(head, "WARC-Payload-Digest").removeprefix("sha1:")
                    if kind == "response" and base32_sha1(body) != said:
                        raise ValueError("a payload does not match its digest")
                    key, keeper = _header(http, PAGE_HEADER), _header(head, REFERS_HEADER)
                    out["page_id"].append(None if key is None else int(key))
                    out["payload_bytes"].append(len(body) if kind == "response" else int(_header(http, "Content-Length")))
                    out["payload_digest"].append(said)
                    out["record_type"].append(kind)
                    out["refers_to"].append(None if keeper is None else int(keeper))
                    out["url"].append(_header(head, "WARC-Target-URI"))
                    out["payload"].append(body if kind == "response" else None)
                    held += len(block)
                    if held > BATCH_BYTES:
                        yield pa.RecordBatch.from_pydict(out, schema=_WARC_ROWS)
                        out, held = {n: [] for n in _WARC_ROWS.names}, 0
                yield pa.RecordBatch.from_pydict(out, schema=_WARC_ROWS)

    return in_arrow(_files(spark, path).select("content"), rows, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, url string, payload binary")


def convert(pages: DataFrame, version: int = 2, least: int = REVISIT_BYTES, pages_per_file: int = PAGES_PER_FILE, file_chars: int = FILE_CHARS) -> str:
    """Writes pages (page_id, url, html) as ARC, converts the archive to WARC and returns its folder.

    Null html counts as empty, a null url becomes "unknown:", white space inside urls is
    percent-encoded, a null page_id stays null and is the smallest. Rows that repeat become records of their own; equal
    payloads of at least `least` bytes keep one response. Other columns are ignored. An empty table gives archives without records.
    """
    spark = pages.sparkSession
    old, new = shared_dir(spark), shared_dir(spark)
    pages = pages.select("page_id", "url", "html")
    write_arc(pages, version, old, pages_per_file, file_chars)
    # The digests choose the responses; the files are read again when the WARC files are written.
    write_warc(_files(spark, old), with_types(stored(read_arc(spark, old)), least), new, pages_per_file, file_chars)
    return new


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = convert(table(spark, sf_dir, "pages"))
    return read_warc(spark, folder).drop("url", "payload")

