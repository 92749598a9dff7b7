"""Archives written, read back byte for byte, and assembled."""

import gzip
import hashlib

from faultline.llm import warc
from faultline.session import fresh_path

LONG = "<p>é🙂\r\n\r\nWARC/1.1\r\nWARC-Type: response\r\n\r\n</p>" * 5
PAGES = [
    (4, "http://b/", LONG),
    (1, "http://a/?x=1\r\nInjected: 1", LONG),
    (2, None, None),
    (3, "http://c/", ""),
    (5, "http://d/", "tiny"),
    (6, "http://e/", "tiny"),
    (7, "http://f/", "z" * 300000),
    (8, "http://g/", LONG),
]


def frame(spark, rows):
    return spark.createDataFrame(
        [(*r, "x") for r in rows], "page_id long, url string, html string, payload string"
    )


def test_round_trip(spark):
    path = fresh_path(spark, "warc")
    warc.write_warc(frame(spark, PAGES), path, records_per_file=4)
    records = warc.read_warc(spark, path)
    captures = {}
    for r in warc.assemble_captures(records).collect():
        page = int(bytes(r.metadata.block).decode()[4:-2])
        assert r.request.concurrent_to == [r.capture_id] and page not in captures
        captures[page] = r
    assert len(captures) == len(PAGES)
    for page, url, html in PAGES:
        r, body = captures[page].response, (html or "").encode()
        assert r.payload_bytes == len(body)
        assert r.payload_digest == "sha256:" + hashlib.sha256(body).hexdigest()
        assert r.uri == (url and url.replace("\r", "%0D").replace("\n", "%0A"))
        if page in (4, 8):
            assert (r.type, r.refers_to) == ("revisit", captures[1].capture_id)
            assert bytes(r.block).endswith(b"\r\n\r\n")
        else:
            assert (r.type, r.refers_to) == ("response", None)
            assert bytes(r.block).endswith(b"\r\n\r\n" + body)


def test_response_that_names_its_request(spark):
    rows = [
        ("a", "response", ["b"], None),
        ("b", "request", [], None),
        ("b", "request", [], None),
        ("c", "metadata", ["zzz"], None),
        ("d", "revisit", [], "a"),
    ]
    records = spark.createDataFrame(
        [(*r, None, None, None, None, None) for r in rows], warc.RECORD_SCHEMA
    )
    found = {r.capture_id: r for r in warc.assemble_captures(records).collect()}
    assert found.keys() == {"a", "d"}
    assert found["a"].request.record_id == "b" and found["a"].metadata is None
    assert found["d"].request is None


def test_every_row_is_a_capture(spark):
    """Rows of one id, equal or not: one capture each; revisits name a response that is there."""
    body = "<p>" + "x" * 200 + "</p>"
    rows = [(1, "u", "a"), (1, "u", "a"), (1, "u", "b"), (1, "v", "a"), (1, None, "a"), (1, "", "a")]
    rows += [(2, "u", body)] * 3 + [(2, "w", body), (3, "u", body), (3, "u", body), (None, "u", body), (None, "u", body)]
    path = fresh_path(spark, "warc")
    warc.write_warc(frame(spark, rows), path)
    found = warc.assemble_captures(warc.read_warc(spark, path)).collect()
    assert len(found) == len({r.capture_id for r in found}) == len(rows)
    responses = {r.capture_id: r for r in found if r.response.type == "response"}
    revisits = [r for r in found if r.response.type == "revisit"]
    assert len(revisits) == 4 and all(responses[r.response.refers_to].response.payload_bytes == len(body) for r in revisits)
    assert sum(r.response.payload_bytes == len(body) for r in responses.values()) == 4
    path = fresh_path(spark, "warc")
    warc.write_warc(frame(spark, []), path)
    assert warc.assemble_captures(warc.read_warc(spark, path)).count() == 0


def test_files_are_cut_by_size(spark):
    """Larger pages lie in files with fewer records."""
    rows = [(k, "u", str(k) * 10) for k in range(100)] + [(200 + k, "u", chr(97 + k) * 5000) for k in range(8)]
    path = fresh_path(spark, "warc")
    warc.write_warc(frame(spark, rows), path, records_per_file=60, page_bytes=1000)
    files = spark.read.format("binaryFile").load(path).select("content").collect()
    parsed = [[len(block) for _, block in warc.parse_records(gzip.decompress(bytes(r.content)))] for r in files if r.content]
    parsed = [own for own in parsed if own]
    assert sum(map(len, parsed)) == 3 * len(rows) and max(map(len, parsed)) <= 60
    assert all(len(own) <= 6 for own in parsed if max(own) >= 5000)
    assert warc.assemble_captures(warc.read_warc(spark, path)).count() == len(rows)
