import hashlib

from tessera.llm import warc_derivatives as W
from tessera.llm.html_text import all_text


def test_records_are_linked_and_whole(spark, sf_dir, tmp_path):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    folder = str(tmp_path / "w")
    W.write_warc(W.responses_of(pages), folder)
    responses = {r.page_id: r for r in W.read_warc(spark, folder).collect()}
    html = {r.page_id: r.html for r in pages.collect()}
    assert {k: r.payload.decode() for k, r in responses.items()} == html and all(r.problem is None for r in responses.values())
    rows = W.warc_derivatives(pages).collect()
    assert len(rows) == 2 * len(responses) and len({r.record_id for r in rows}) == len(rows)
    for r in rows:
        source = responses[r.page_id]
        fields, block = W.parse_record(bytes(r.record))
        named = dict(fields)
        assert named["WARC-Refers-To"] == r.refers_to == source.record_id and named["WARC-Record-ID"] == r.record_id
        assert named["WARC-Target-URI"] == source.target_uri and named["WARC-Type"] == r.warc_type
        assert named["WARC-Refers-To-Payload-Digest"] == r.source_digest == "sha256:" + hashlib.sha256(source.payload).hexdigest()
        assert named["WARC-Block-Digest"] == "sha256:" + hashlib.sha256(block).hexdigest() and len(block) == r.content_length
        assert bytes(r.record).endswith(block + b"\r\n\r\n")
        if r.warc_type == "conversion":
            assert block.decode() == all_text(source.payload.decode())
        else:
            assert b"http-header-Content-Type: text/html; charset=utf-8\r\n" in block


def test_odd(spark):
    kinds = "page_id long, record_id string, target_uri string, date string, http_headers array<struct<name:string,value:string>>, payload string, record string"
    rows = [(1, None, None, None, None, None, "x"), (2, "<urn:a>", "http://x/", "2020-01-01T00:00:00Z", [("X-A", "1\r\n2"), (None, "z"), ("X-a", "3")], "<p>é", "x"), (2, "<urn:a>", "http://x/", "2020-01-01T00:00:00Z", [], "<p>é", "x"), (None, "<urn:b>", "", "", [], "", "x")]
    out = W.build_derivatives(spark.createDataFrame(rows, kinds)).collect()
    assert len(out) == 8
    parsed = [(r, *W.parse_record(bytes(r.record))) for r in out]
    assert all("WARC-Target-URI" not in dict(f) for r, f, _ in parsed if r.page_id != 2)
    notes = next(b for r, f, b in parsed if r.page_id == 2 and r.warc_type == "metadata")
    assert b"http-header-X-A: 1 2\r\nhttp-header-X-a: 3\r\n" in notes
    assert W.build_derivatives(spark.createDataFrame([], kinds)).collect() == []


def made(headers, payload):
    return {x["warc_type"]: W.parse_record(x["record"])[1].decode() for x in W.derive("<urn:x>", "http://x/", None, headers, payload)}


def test_the_content_type_decides():
    plain = made([("Content-Type", "text/plain")], b"if a <b and c> d then")
    assert plain["conversion"] == "if a <b and c> d then" and "title" not in plain["metadata"]
    assert made([("content-type", "text/html; charset=latin-1")], "<title>A &amp; é</title><p>\xfc".encode("latin-1")) == {
        "conversion": "\xfc", "metadata": "payload-length: 28\r\npayload-charset: latin-1\r\ntitle: A & é\r\noutlinks: 0\r\nhttp-header-content-type: text/html; charset=latin-1\r\n"
    }
    assert made([("Content-Type", "image/png")], b"\x89PNG<p>x")["conversion"] == ""
    assert made([], b" <p>x")["conversion"] == "x" and made([], b"x < y")["conversion"] == "x < y"
    assert made([("Content-Type", "text/plain; charset=nonsense")], b"a\xff")["conversion"] == "a\ufffd"


def test_every_record_has_a_date():
    assert all(dict(W.parse_record(x["record"])[0])["WARC-Date"] == W.EPOCH for x in W.derive(None, None, None, None, None))


def test_record_files(spark, tmp_path):
    """Any bytes come back, from plain and packed files; records that can't be told apart are reported."""
    blocks = [bytes(range(256)), b"", b"line\r\n\r\nline", b"\xff\r\n\r\nWARC/9", b"x" * 300_000]
    records = [W.warc_record([("WARC-Type", "resource"), ("X-Page-Id", str(k)), ("Content-Length", str(len(b)))], b) for k, b in enumerate(blocks)]
    records.append(W.warc_record([("WARC-Type", "resource"), ("Content-Length", "20")], b"a\r\n\r\nWARC/1.1 and more"))
    frame = spark.createDataFrame([(bytearray(x),) for x in records], "record binary").coalesce(1)
    for packed in ("gzip", "none"):
        folder = str(tmp_path / packed)
        W.write_warc(frame, folder, packed)
        got = W.read_warc(spark, folder).collect()
        assert {r.page_id: bytes(r.payload) for r in got if r.problem is None} == dict(enumerate(blocks))
        assert sum(r.problem is not None for r in got) >= 1
    import gzip
    import glob

    raw = b"".join(gzip.open(x).read() for x in glob.glob(str(tmp_path / "gzip" / "part-*")))
    assert raw == b"".join(records)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None), (None, "http://x/ y", "<p>a\r\n\r\nb"), (2, "u", ""), (2, "u", "")], "page_id long, url string, html string")
    out = W.warc_derivatives(pages).collect()
    assert len(out) == 8 and {r.page_id for r in out} == {1, None, 2}
    assert W.warc_derivatives(pages.limit(0)).collect() == []
