"""Operator 9, WARC: builds metadata and conversion records that are linked to responses.

From each response record come two derivatives:

* ``metadata`` (application/warc-fields): size, type and character set of the payload, the
  page's title, language and number of links;
* ``conversion`` (text/plain): the payload's text as its Content-Type has it: all visible text of
  HTML, other text as it is, nothing of anything else.

Both name the response's WARC-Record-ID in WARC-Refers-To and its digest in
WARC-Refers-To-Payload-Digest, keep its target URI, date and HTTP headers (as
``http-header-*`` fields of the metadata, with their order and spelling), and carry the
digest and length of their own block.  Record ids are name-based, so that a retried task
makes the same records; the order of the fields is fixed.

Record files are written and read by Spark's text source, with the end of a record as line
separator: any file system will do, a retried task commits once, and records are streamed, not
files loaded.  ``responses_of`` describes pages that were not fetched as WARC as response records;
the query writes them, reads them back and converts them.

Defined results
---------------
* null payload: an empty one, both records are still made; null uri or headers: the field is left out;
* null date: 1970-01-01T00:00:00Z, since every record must have one;
* null record_id: a name-based id of uri and payload;
* a payload of another type than text (no or an unknown type counts as HTML where a tag starts it,
  as text otherwise): an empty conversion; bytes that don't fit the character set become U+FFFD;
* repeated responses give repeated records of equal ids; an empty table gives no rows;
* extra columns are not carried along;
* a record read whose block is shorter than its Content-Length, or without one, has ``problem`` set
  and isn't converted (a block that holds the line ``WARC/1.`` behind an empty one can't be told apart);
* line ends in header values become blanks, as a header field is one line.
"""

from __future__ import annotations

import hashlib
import html as entities
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.html_text import all_text
from tessera.llm.shared import temporary_path

#: Name space of derived record ids (fixed: any UUID will do).
NAMESPACE = uuid.UUID("6f0a6c0e-3a0d-5a52-9d7e-2c1c5f1e8a11")
EPOCH = "1970-01-01T00:00:00Z"

_TITLE = re.compile(r"<title[^>]*>(.*?)</title", re.S | re.I)
_LANG = re.compile(r"<html[^>]*?\slang\s*=\s*[\"']?([A-Za-z-]+)", re.I)
_LINK = re.compile(r"<a\s[^>]*?href\s*=", re.I)
_CHARSET = re.compile(r"<meta[^>]*?charset\s*=\s*[\"']?([\w-]+)", re.I)


def _line(value: str) -> str:
    return " ".join(value.split())


def record_id(*parts: str) -> str:
    return f"<urn:uuid:{uuid.uuid5(NAMESPACE, chr(10).join(parts))}>"


def digest(block: bytes) -> str:
    return f"sha256:{hashlib.sha256(block).hexdigest()}"


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    """One WARC/1.1 record: version, fields, blank line, block, two line ends."""
    head = "".join(f"{k}: {v}\r\n" for k, v in fields)
    return f"WARC/1.1\r\n{head}\r\n".encode() + block + b"\r\n\r\n"


def parse_record(record: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(fields, block) of one record."""
    head, _, rest = record.partition(b"\r\n\r\n")
    version, *lines = head.decode(errors="replace").split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)]
    length = next((v for k, v in fields if k.lower() == "content-length"), "")
    if not length.isdigit() or len(rest) < int(length):
        raise ValueError("the block is shorter than its Content-Length")
    return fields, rest[: int(length)]


def parse_http(block: bytes) -> tuple[list[tuple[str, str]], bytes]:
    """(headers, payload) of an HTTP response."""
    head, _, payload = block.partition(b"\r\n\r\n")
    lines = head.decode("latin-1").split("\r\n")[1:]
    return [(k.strip(), v.strip()) for k, _, v in (x.partition(":") for x in lines)], payload


def kind_and_charset(headers: list[tuple[str, str]], payload: bytes) -> tuple[str, str]:
    """("html", "text" or "other"; character set) of a payload."""
    said = next((v for k, v in headers if k.lower() == "content-type"), "").lower()
    kind = said.split(";")[0].strip()
    named = re.search(r"charset\s*=\s*[\"']?([\w.:-]+)", said)
    if kind in ("text/html", "application/xhtml+xml"):
        out = "html"
    elif kind.startswith("text/") or kind.endswith(("/json", "/xml", "+json", "+xml")):
        out = "text"
    elif kind:
        out = "other"
    else:
        out = "html" if re.match(rb"\s*<[!?a-zA-Z]", payload) else "text"
    charset = named.group(1) if named else ""
    if not charset and out == "html":
        charset = m.group(1) if (m := _CHARSET.search(payload[:4096].decode("latin-1"))) else ""
    return out, charset


def _decoded(payload: bytes, charset: str) -> str:
    try:
        return payload.decode(charset or "utf-8", errors="replace")
    except LookupError:
        return payload.decode("utf-8", errors="replace")


def derive(ref: str | None, uri: str | None, date: str | None, headers: list[tuple[str, str]] | None, payload: bytes | None) -> list[dict]:
    """The metadata and the conversion record of one response."""
    raw, headers = payload or b"", headers or []
    ref = ref or record_id("response", uri or "", hashlib.sha256(raw).hexdigest())
    source_digest = digest(raw)
    kind, charset = kind_and_charset(headers, raw)
    said = _decoded(raw, charset) if kind != "other" else ""
    title, lang = ((m.group(1) if (m := p.search(said)) else "") if kind == "html" else "" for p in (_TITLE, _LANG))
    links = str(len(_LINK.findall(said))) if kind == "html" else ""
    notes = [("payload-length", str(len(raw))), ("payload-charset", _line(charset)), ("title", _line(entities.unescape(re.sub(r"<[^>]*>", " ", title)))), ("language", lang), ("outlinks", links)]
    notes += [(f"http-header-{k}", _line(v)) for k, v in headers]
    metadata = "".join(f"{k}: {v}\r\n" for k, v in notes if v != "").encode()
    text = (all_text(said) if kind == "html" else said).encode(errors="replace")
    out = []
    for kind, content_type, block in (("metadata", "application/warc-fields", metadata), ("conversion", "text/plain; charset=utf-8", text)):
        own = record_id(kind, ref, source_digest)
        fields = [("WARC-Type", kind), ("WARC-Record-ID", own), ("WARC-Refers-To", ref), ("WARC-Refers-To-Payload-Digest", source_digest)]
        fields += [("WARC-Target-URI", _line(uri))] if uri else []
        fields += [("WARC-Date", _line(date or EPOCH)), ("Content-Type", content_type), ("WARC-Block-Digest", digest(block)), ("Content-Length", str(len(block)))]
        out.append({"warc_type": kind, "record_id": own, "refers_to": ref, "source_digest": source_digest, "block_digest": digest(block), "content_length": len(block), "record": warc_record(fields, block)})
    return out


# -- record files ---------------------------------------------------------------------

_END = "\r\n\r\n"
_NEXT = f"{_END}WARC/1."


def write_warc(records: DataFrame, folder: str, compression: str = "gzip") -> None:
    """Write the column ``record`` (whole records) as record files."""
    # The text source writes each row's bytes and the separator, which is the end that every record has.
    body = F.substring("record", F.lit(1), F.octet_length("record") - len(_END))
    records.select(body.cast("string").alias("value")).write.option("lineSep", _END).option("compression", compression).option("zlib.compress.level", "BEST_SPEED").text(folder)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """(warc_type, record_id, target_uri, date, fields, page_id, http_headers, payload, problem) of every record of the files.

    The payload of a record that isn't an HTTP message is its block."""
    pairs = pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))
    kinds = {"warc_type": pa.string(), "record_id": pa.string(), "target_uri": pa.string(), "date": pa.string(), "fields": pairs, "page_id": pa.int64(), "http_headers": pairs, "payload": pa.binary(), "problem": pa.string()}

    def one(raw: bytes) -> dict:
        if not raw.startswith(b"WARC/"):
            raw = b"WARC/1." + raw
        try:
            fields, block = parse_record(raw)
        except ValueError as e:
            return {"problem": str(e)}
        found = {k.lower(): v for k, v in reversed(fields)}
        own = {"warc_type": "warc-type", "record_id": "warc-record-id", "target_uri": "warc-target-uri", "date": "warc-date"}
        headers, payload = parse_http(block) if found.get("content-type", "").startswith("application/http") else ([], block)
        number = found.get("x-page-id", "")
        listed = {k: [{"name": x, "value": v} for x, v in rows] for k, rows in (("fields", fields), ("http_headers", headers))}
        return {k: found.get(x) for k, x in own.items()} | listed | {"page_id": int(number) if number.lstrip("-").isdigit() else None, "payload": payload}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [one(x) for x in batch.column(0).to_pylist() if x.strip()]
            yield pa.record_batch([pa.array([x.get(k) for x in out], t) for k, t in kinds.items()], names=list(kinds))

    lines = spark.read.option("lineSep", _NEXT).text(path)
    schema = "warc_type string, record_id string, target_uri string, date string, fields array<struct<name:string,value:string>>, page_id long, http_headers array<struct<name:string,value:string>>, payload binary, problem string"
    return lines.select(F.col("value").cast("binary")).mapInArrow(run, schema)


def responses_of(pages: DataFrame) -> DataFrame:
    """(record): a response record for each fetched page, whose number stands in ``X-Page-Id``."""
    hexed = F.md5(F.concat_ws("\n", F.coalesce(F.col("page_id").cast("string"), F.lit("")), F.coalesce("url", F.lit(""))))
    uid = F.concat(F.lit("<urn:uuid:"), *(x for k, (a, n) in enumerate(((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))) for x in ([F.lit("-")] if k else []) + [F.substring(hexed, a, n)]), F.lit(">"))
    payload = F.coalesce("html", F.lit(""))
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.octet_length(payload).cast("string"), F.lit(_END), payload)
    line = lambda name, value: F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit("\r\n")), F.lit(""))
    fields = [line("WARC-Type", F.lit("response")), line("WARC-Record-ID", uid), line("WARC-Target-URI", F.regexp_replace("url", r"\s+", " ")), line("WARC-Date", F.lit(EPOCH))]
    fields += [line("X-Page-Id", F.col("page_id").cast("string")), line("Content-Type", F.lit("application/http; msgtype=response")), line("Content-Length", F.octet_length(http).cast("string"))]
    return pages.select(F.concat(F.lit("WARC/1.1\r\n"), *fields, F.lit("\r\n"), http, F.lit(_END)).cast("binary").alias("record"))


def build_derivatives(responses: DataFrame) -> DataFrame:
    """Two rows a response (page_id, record_id, target_uri, date, http_headers, payload): its number,
    the fields that link it, and the whole record."""
    kinds = {"page_id": pa.int64(), "warc_type": pa.string(), "record_id": pa.string(), "refers_to": pa.string(), "source_digest": pa.string(), "block_digest": pa.string(), "content_length": pa.int64(), "record": pa.binary()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[dict] = []
            for r in batch.to_pylist():
                headers = [(x["name"], x["value"]) for x in r["http_headers"] or [] if x and x["name"] and x["value"] is not None]
                out.extend({"page_id": r["page_id"]} | x for x in derive(r["record_id"], r["target_uri"], r["date"], headers, r["payload"]))
            yield pa.record_batch([pa.array([x[k] for x in out], t) for k, t in kinds.items()], names=list(kinds))

    schema = "page_id long, warc_type string, record_id string, refers_to string, source_digest string, block_digest string, content_length long, record binary"
    return responses.select("page_id", "record_id", "target_uri", "date", "http_headers", F.col("payload").cast("binary").alias("payload")).mapInArrow(run, schema)


def warc_derivatives(pages: DataFrame, folder: str | None = None) -> DataFrame:
    """The derivatives of ``pages``, by way of record files in ``folder``."""
    spark = pages.sparkSession
    folder = folder or temporary_path(spark, "responses")
    write_warc(responses_of(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")), folder)
    return build_derivatives(read_warc(spark, folder).where("problem is null and warc_type = 'response'"))
