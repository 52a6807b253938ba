"""WARC derivatives: metadata and plain-text conversion records of response records.

A derivative names its response in WARC-Refers-To and has the response's target and
date. The metadata record holds the source's HTTP status and headers and its digests;
the conversion record holds the visible text of HTML and plain-text payloads.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from glossa.llm.html import visible_text
from glossa.llm.shared import bounded_batches

HEADER_ORDER = (
    "WARC-Type", "WARC-Record-ID", "WARC-Date", "WARC-Target-URI", "WARC-Refers-To", "WARC-Block-Digest", "WARC-Payload-Digest", "Content-Type", "Content-Length",
)
#: What identifiers of derivatives are derived from, so that a repeated run gives the same ones.
NAMESPACE = uuid.UUID("6ba7b811-9dad-11d1-80b4-00c04fd430c8")
MOST_INFLATED = 256 << 20
RECORD = "record_id string, warc_type string, refers_to string, target_uri string, date string, content_type string, content_length long, block_digest string, payload_digest string, source_status int, source_headers map<string,string>, source_block_digest string, source_payload_digest string, block string"


def digest(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def parse_http(block: bytes) -> tuple[int | None, dict[str, str], bytes]:
    """Status, headers (lower-case names; repeats joined by a comma) and the payload of an HTTP response."""
    head, gap, payload = block.partition(b"\r\n\r\n")
    if not gap:
        head, gap, payload = block.partition(b"\n\n")
    lines = head.decode("utf-8", "replace").splitlines()
    if not gap or not lines or not lines[0].startswith("HTTP/"):
        return None, {}, block
    words = lines[0].split()
    status = int(words[1]) if len(words) > 1 and re.fullmatch("[0-9]{1,5}", words[1]) else None
    headers: dict[str, str] = {}
    for line in lines[1:]:
        name, colon, value = line.partition(":")
        if colon:
            name = name.strip().lower()
            headers[name] = f"{headers[name]}, {value.strip()}" if name in headers else value.strip()
    return status, headers, payload


def inflated(payload: bytes, encoding: str, most: int) -> bytes | None:
    """The bytes of a gzip payload, of all its members, or of a deflate payload, with or without zlib's frame.

    What breaks off gives what is there. Named gzip and not so (without its first two
    bytes), or deflate and plain ASCII text, it is taken as it is. None: an encoding
    that isn't known, bytes that aren't of it, or more than `most` of them.
    """
    if encoding in ("gzip", "x-gzip"):
        if not payload.startswith(b"\x1f\x8b"):
            return payload
        kinds = (31,)
    elif encoding == "deflate":
        kinds = (15, -15)
    else:
        return None
    for kind in kinds:
        out, size, rest = [], 0, payload
        try:
            while rest and (not out or kind == 31 and rest.startswith(b"\x1f\x8b")):
                inflate = zlib.decompressobj(kind)
                out.append(inflate.decompress(rest, most + 1 - size))
                size += len(out[-1])
                if size > most:
                    return None
                rest = inflate.unused_data
            return b"".join(out)
        except zlib.error:
            continue
    return payload if encoding == "deflate" and payload.isascii() else None


def decoded(payload: bytes, headers: dict[str, str], most: int = MOST_INFLATED) -> str | None:
    """The payload as text: transfer and content encodings undone, bytes by the charset named (else UTF-8).

    Encodings are undone from the last one named to the first. None if one isn't known or
    fails, or if the payload inflates to more than `most` bytes.
    """
    if "chunked" in headers.get("transfer-encoding", "").lower():
        out, at = [], 0
        while (end := payload.find(b"\r\n", at)) >= 0:
            size = payload[at:end].split(b";")[0].strip()
            if not re.fullmatch(rb"[0-9A-Fa-f]{1,8}", size):
                break
            n = int(size, 16)
            out.append(payload[end + 2 : end + 2 + n])
            at = end + 4 + n
            if not n:
                break
        payload = b"".join(out) if out else payload
    for encoding in reversed([e.strip() for e in headers.get("content-encoding", "").lower().split(",")]):
        if encoding in ("", "identity"):
            continue
        payload = inflated(payload, encoding, most)
        if payload is None:
            return None
    charset = re.search(r"charset=[\"']?([\w.:-]+)", headers.get("content-type", ""), re.I)
    try:
        return payload.decode(charset[1] if charset else "utf-8", "replace")
    except LookupError:
        return payload.decode("utf-8", "replace")


def derivatives_of(record_id: str | None, uri: str | None, date: str | None, block: bytes | None) -> Iterator[tuple]:
    block = block or b""
    status, headers, payload = parse_http(block)
    sources = status, list(headers.items()), digest(block), digest(payload)
    kind = headers.get("content-type", "").split(";")[0].strip().lower()
    fields = [("source-status", "" if status is None else str(status)), ("source-block-digest", sources[2]), ("source-payload-digest", sources[3])]
    fields += [(f"source-header-{k}", v) for k, v in headers.items()]
    made = [("metadata", "application/warc-fields", "".join(f"{k}: {v}\r\n" for k, v in fields))]
    html = kind in ("text/html", "application/xhtml+xml")
    if (html or kind == "text/plain") and (text := decoded(payload, headers)) is not None:
        made.append(("conversion", "text/plain; charset=utf-8", visible_text(text) if html else text))
    for warc_type, content_type, text in made:
        own = f"<urn:uuid:{uuid.uuid5(NAMESPACE, f'{warc_type} {record_id} {uri} {date} {sources[2]}')}>"
        data = text.encode("utf-8", "replace")
        yield own, warc_type, record_id, uri, date, content_type, len(data), digest(data), digest(data), *sources, data.decode("utf-8")


def derivatives(responses: DataFrame) -> DataFrame:
    """One metadata record of each response, and one conversion record if its payload is HTML or plain text.

    responses: record_id, target_uri, date, block (binary: the HTTP message). Columns of
    the result: those of RECORD. Null blocks count as empty: they have no status, no
    headers and no conversion. Blocks that aren't HTTP are payload as a whole. A payload
    that inflates to more than MOST_INFLATED bytes has no conversion. Rows that
    repeat give the same records again, with the same identifiers; null identifiers,
    targets and dates stay null. Extra columns are ignored; no responses, no records.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [f.split()[0] for f in RECORD.replace("map<string,string>", "map").split(", ")]
        types = {"content_length": pa.int64(), "source_status": pa.int32(), "source_headers": pa.map_(pa.string(), pa.string())}
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                rows = [r for x in zip(*(c.to_pylist() for c in batch.slice(lo, 256).columns)) for r in derivatives_of(*x)]
                columns = zip(*rows) if rows else [[] for _ in names]
                yield pa.RecordBatch.from_arrays([pa.array(c, types.get(n, pa.string())) for n, c in zip(names, columns)], names=names)

    bounded_batches(responses.sparkSession)
    return responses.select(
        F.col("record_id").cast("string"), F.col("target_uri").cast("string"), F.col("date").cast("string"), F.col("block").cast("binary")
    ).mapInArrow(run, RECORD)


#: Between two records. What precedes it isn't read as text: Spark's text source keeps a line's bytes as they are.
BETWEEN = "\r\n\r\nWARC/1."
_READ = "warc_type string, record_id string, target_uri string, refers_to string, date string, headers map<string,string>, block binary"


def parse_record(data: bytes) -> tuple[dict[str, str], bytes, int | None]:
    """Headers, block and the block's length as named (None if it isn't) of a record without its first "WARC/1."."""
    head, _, block = data.partition(b"\r\n\r\n")
    headers = {k.strip(): v.strip() for k, _, v in (line.partition(":") for line in head.decode("utf-8", "replace").split("\r\n")[1:])}
    length = headers.get("Content-Length", "")
    return headers, block, int(length) if re.fullmatch("[0-9]{1,18}", length) else None


def _records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(file, piece) to _READ: a record whose block is shorter than named goes on in the next pieces of its file."""
    named = ("WARC-Type", "WARC-Record-ID", "WARC-Target-URI", "WARC-Refers-To", "WARC-Date")
    names = [f.split()[0] for f in _READ.replace("map<string,string>", "map").split(", ")]

    def out(data: bytes) -> Iterator[pa.RecordBatch]:
        headers, block, n = parse_record(data)
        if headers:
            values = [pa.array([headers.get(x)], pa.string()) for x in named]
            values += [pa.array([list(headers.items())], pa.map_(pa.string(), pa.string())), pa.array([block if n is None else block[:n]], pa.binary())]
            yield pa.RecordBatch.from_arrays(values, names=names)

    file, held, short = None, [], 0
    for batch in batches:
        for name, piece in zip(batch.column(0).to_pylist(), batch.column(1)):
            data = piece.as_py()
            if held and name == file and short > 0:
                short -= len(BETWEEN) + len(data)
                held.append(data)
                continue
            if held:
                yield from out(BETWEEN.encode().join(held))
            data = data.removeprefix(b"WARC/1.") if name != file else data
            _, block, n = parse_record(data)
            file, held, short = name, [data], (n or 0) - len(block)
    if held:
        yield from out(BETWEEN.encode().join(held))


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """warc_type, record_id, target_uri, refers_to, date, headers, block: one row per record of the WARC files.

    Files may be of any size, as Spark's text source streams them with the border of two
    records as its line end: plain files in parallel parts, gzip files (by record or
    whole) by one task each. Records without or with a bad Content-Length end at the next
    border. A file that breaks off, or whose gzip stream does, gives the records before,
    and of the last what is there. A block that has a record's border in it is put together
    again by its Content-Length, unless a plain file is parted in it.
    """
    pieces = spark.read.option("lineSep", BETWEEN).option("ignoreCorruptFiles", "true").text(path)
    bounded_batches(spark)
    return pieces.select(F.col("_metadata.file_path").alias("file"), F.col("value").cast("binary").alias("piece")).mapInArrow(_records, _READ)


def write_warc(records: DataFrame, path: str, compression: str = "gzip") -> None:
    """Writes records of derivatives() as WARC files; the text writer's separator is the end of a record."""
    fields = {
        "WARC-Type": "warc_type", "WARC-Record-ID": "record_id", "WARC-Date": "date", "WARC-Target-URI": "target_uri", "WARC-Refers-To": "refers_to",
        "WARC-Block-Digest": "block_digest", "WARC-Payload-Digest": "payload_digest", "Content-Type": "content_type", "Content-Length": "content_length",
    }
    lines = [F.concat(F.lit(f"{name}: "), F.col(fields[name]).cast("string")) for name in HEADER_ORDER]  # null, and so left out, where the value is
    head = F.concat_ws("\r\n", F.lit("WARC/1.1"), *lines)
    record = F.concat(head, F.lit("\r\n\r\n"), F.coalesce("block", F.lit("")))
    records.select(record.alias("value")).write.option("lineSep", "\r\n\r\n").option("compression", compression).text(path)


def page_responses(pages: DataFrame) -> DataFrame:
    """Response records of the rows of a table page_id, url, html, as a crawler would have stored them."""
    html = F.coalesce(F.col("html"), F.lit(""))
    head = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(html).cast("string"), F.lit("\r\n\r\n"))
    key = F.md5(F.concat_ws("|", F.col("page_id").cast("string"), "url"))
    parts = [F.substring(key, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return pages.select(
        "page_id", F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">")).alias("record_id"),
        F.col("url").alias("target_uri"), F.lit("2024-01-01T00:00:00Z").alias("date"), F.encode(F.concat(head, html), "UTF-8").alias("block"),
    )


def op3_warc_derivatives(spark, sf_dir: str) -> DataFrame:
    return derivatives(page_responses(spark.read.parquet(f"{sf_dir}/pages.parquet")))
