"""WARC archives: written by Spark's text sink, read back, assembled into captures."""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from faultline.llm.ordinals import number_rows
from faultline.session import materialise

#: Fixed values of the format.
END = "\r\n"
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORD_SCHEMA = (
    "record_id string, type string, concurrent_to array<string>, refers_to string, uri string, "
    "date string, payload_digest string, payload_bytes long, block binary"
)


def record_id(kind: str, key: Column) -> Column:
    """Name of a record, the same in every run: a UUID made of the key's digest."""
    digest = F.md5(F.concat_ws("/", F.lit(kind), key.cast("string")))
    parts = [F.substring(digest, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))]
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *parts), F.lit(">"))


def _record(fields: list[tuple[str, Column | str]], block: Column) -> Column:
    """Header and block; a field with a null value is left out."""
    lines = [F.lit("WARC/1.1" + END)]
    for name, value in [*fields, ("Content-Length", F.octet_length(block).cast("string"))]:
        value = F.lit(value) if isinstance(value, str) else value
        line = F.concat(F.lit(f"{name}: "), value, F.lit(END))
        lines.append(F.coalesce(line, F.lit("")))
    return F.concat(*lines, F.lit(END), block)


def mark_revisits(rows: DataFrame, min_payload: int = 100) -> DataFrame:
    """``id, url, body`` with payload, payload_bytes, payload_digest, first, nth and key.

    ``first`` is the (id, url) of the smallest id with the same payload where the payload has
    ``min_payload`` bytes or more and more than one page; else null. ``nth`` numbers rows
    that agree in id, URL and payload, so that every row is a capture of its own. ``key`` names
    it. Equal rows are counted before any join; only rows that have a twin are dealt out to
    be numbered, in ranges, so a page in any number of equal rows is spread.
    """
    payload = F.coalesce(F.col("body"), F.lit(""))
    rows = rows.withColumn("payload", payload).withColumns(
        {
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": F.sha2("payload", 256),
        }
    )
    same = ["id", "url", "payload_digest", "payload_bytes"]
    kinds = materialise(rows.groupBy(*same).agg(F.count(F.lit(1)).alias("copies")), "warc-pages")
    least = F.min(F.struct(F.col("id").isNull().alias("none"), "id", "url"))
    firsts = (
        kinds.where(F.col("payload_bytes") >= min_payload)
        .groupBy("payload_digest")
        .agg(least.alias("first"), F.sum("copies").alias("copies"))
        .where(F.col("copies") > 1)
        .drop("copies")
    )
    twins = kinds.where("copies > 1").select(*[F.col(c).alias(f"_{c}") for c in same[:3]])
    if twins.take(1):
        equal = F.lit(True)
        for c in same[:3]:
            equal = equal & rows[c].eqNullSafe(F.col(f"_{c}"))
        numbered = number_rows(rows.join(twins, equal, "left_semi"), same[:3], [], "nth")
        rows = rows.join(twins, equal, "left_anti").withColumn("nth", F.lit(0).cast("long")).unionByName(numbered)
    else:
        rows = rows.withColumn("nth", F.lit(0).cast("long"))
    rows = rows.join(firsts, "payload_digest", "left")
    return rows.withColumn("key", capture_key(F.col("id"), F.col("url"), F.col("nth")))


def capture_key(id_: Column, url: Column, nth: Column) -> Column:
    """Name of a row among those of its payload."""
    told = [F.coalesce(F.concat(F.lit("="), c.cast("string")), F.lit("-")) for c in (id_, url)]
    return F.concat_ws("/", *told, F.col("payload_digest"), nth.cast("string"))


def write_warc(
    pages: DataFrame,
    path: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    date: str = "1970-01-01T00:00:00Z",
    min_payload: int = 100,
    records_per_file: int = 3000,
    page_bytes: int = 1 << 18,
) -> None:
    """A request, a response or revisit, and a metadata record for each page.

    The text sink writes the records with the format's own terminator between
    them, gzipped. Files have at most ``records_per_file`` records; pages above
    ``page_bytes`` go to files of their own size class, with half as many records for each
    doubling, so a file holds a bounded number of bytes or one capture. Every row is a
    capture, rows that agree in all columns too. A null payload
    is empty; a null URL leaves the field out; line ends in a URL are escaped.
    Pages with a null id are never the first of a payload. Other columns are left out;
    an empty table writes no record.
    """
    own = pages.select(
        F.col(id_col).alias("id"), F.col(url_col).alias("url"), F.col(payload_col).alias("body")
    )
    marked = mark_revisits(own, min_payload)
    largest = own.agg(F.max(F.octet_length("body"))).first()[0] or 0
    size = F.coalesce(F.octet_length("body"), F.lit(0))
    klass, low = 0, -1
    while klass == 0 or low < largest:
        high = page_bytes << klass
        records = _records(marked.where((size > low) & (size <= high)), date)
        (
            records.write.mode("append")
            .option("lineSep", END + END)
            .option("compression", "gzip")
            .option("maxRecordsPerFile", max(3, records_per_file >> klass) // 3 * 3)
            .text(path)
        )
        klass, low = klass + 1, high


def _records(marked: DataFrame, date: str) -> DataFrame:
    """One row ``value`` for each record."""
    rows = marked.withColumn("uri", F.replace(F.replace("url", F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A")))
    revisit = F.col("first.id").isNotNull() & ~F.col("id").eqNullSafe(F.col("first.id"))
    key = F.col("key")
    capture = record_id("response", key)
    http = F.concat(
        F.lit(f"HTTP/1.1 200 OK{END}Content-Type: text/html; charset=utf-8{END}Content-Length: "),
        F.col("payload_bytes").cast("string"),
        F.lit(END + END),
    )
    request = _record(
        [
            ("WARC-Type", "request"),
            ("WARC-Record-ID", record_id("request", key)),
            ("WARC-Concurrent-To", capture),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("uri")),
            ("Content-Type", "application/http;msgtype=request"),
        ],
        F.concat(
            F.lit("GET "), F.coalesce("uri", F.lit("/")), F.lit(f" HTTP/1.1{END}Accept: */*{END * 2}")
        ),
    )
    response = _record(
        [
            ("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
            ("WARC-Record-ID", capture),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("uri")),
            ("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("payload_digest"))),
            ("WARC-Profile", F.when(revisit, REVISIT_PROFILE)),
            (
                "WARC-Refers-To",
                F.when(revisit, record_id("response", capture_key(F.col("first.id"), F.col("first.url"), F.lit(0)))),
            ),
            ("Content-Type", "application/http;msgtype=response"),
        ],
        F.when(revisit, http).otherwise(F.concat(http, F.col("payload"))),
    )
    metadata = _record(
        [
            ("WARC-Type", "metadata"),
            ("WARC-Record-ID", record_id("metadata", key)),
            ("WARC-Concurrent-To", capture),
            ("WARC-Date", date),
            ("WARC-Target-URI", F.col("uri")),
            ("Content-Type", "application/warc-fields"),
        ],
        F.concat(F.lit("id: "), F.coalesce(F.col("id").cast("string"), F.lit("")), F.lit(END)),
    )
    return rows.select(F.explode(F.array(request, response, metadata)).alias("value"))


def parse_records(data: bytes) -> Iterator[tuple[dict[str, list[str]], memoryview]]:
    """Fields (lower-case names) and block of each record of an archive."""
    view, at = memoryview(data), 0
    while True:
        while data[at : at + 2] == b"\r\n":
            at += 2
        if at >= len(data):
            return
        end = data.find(b"\r\n\r\n", at)
        if end < 0 or not data.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        fields: dict[str, list[str]] = {}
        for line in data[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            fields.setdefault(name.strip().lower(), []).append(value.strip())
        size = int(fields["content-length"][0])
        yield fields, view[end + 4 : end + 4 + size]
        at = end + 4 + size


def _row(fields: dict[str, list[str]], block: memoryview, blocks: bool) -> tuple:
    kind = fields["warc-type"][0]
    one = lambda name: fields.get(name, [None])[0]
    digest, size = one("warc-payload-digest"), None
    if kind in ("response", "revisit") and (one("content-type") or "").startswith("application/http"):
        head, _, payload = bytes(block).partition(b"\r\n\r\n")
        if kind == "response":
            digest, size = "sha256:" + hashlib.sha256(payload).hexdigest(), len(payload)
        else:
            for line in head.decode("latin-1").split("\r\n"):
                name, _, value = line.partition(":")
                if name.lower() == "content-length":
                    size = int(value)
    return (
        one("warc-record-id"),
        kind,
        fields.get("warc-concurrent-to", []),
        one("warc-refers-to"),
        one("warc-target-uri"),
        one("warc-date"),
        digest,
        size,
        bytes(block) if blocks or kind == "metadata" else None,
    )


def read_warc(spark: SparkSession, path: str, blocks: bool = True) -> DataFrame:
    """Every record of the archives below ``path``, gzipped or not.

    The digest and length of a response's payload are measured, those of a revisit
    are read from its fields. Without ``blocks`` only metadata keep their block.
    A file without records gives no rows; a broken one ends the job with its place.
    """
    kinds = [
        pa.string(), pa.string(), pa.list_(pa.string()), pa.string(), pa.string(), pa.string(),
        pa.string(), pa.int64(), pa.binary(),
    ]
    names = [field.split(" ")[0] for field in RECORD_SCHEMA.split(", ")]

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for value in batch.column(0):
                data, out = value.as_py(), []
                if data[:2] == b"\x1f\x8b":
                    data = b"".join(_members(data))
                held = 0
                for fields, block in parse_records(data):
                    out.append(_row(fields, block, blocks))
                    held += len(block)
                    if len(out) >= 2000 or held >= 1 << 23:
                        yield _batch(out, kinds, names)
                        out, held = [], 0
                if out:
                    yield _batch(out, kinds, names)

    files = spark.read.format("binaryFile").load(path).where(F.col("length") > 0)
    return files.select("content").mapInArrow(parse, RECORD_SCHEMA)


def _members(data: bytes) -> Iterator[bytes]:
    while data:
        inflate = zlib.decompressobj(31)
        yield inflate.decompress(data)
        data = inflate.unused_data


def _batch(rows: list[tuple], kinds: list, names: list[str]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names
    )


def assemble_captures(records: DataFrame) -> DataFrame:
    """One row per capture: the response or revisit with its request and metadata nested.

    Records belong together through the concurrent-to field, whichever of the two
    names the other. Of several requests or metadata records of one capture, and of
    records with the same id, the smallest stays. A capture without a request or
    metadata has null there; a request or metadata without a capture is left out.
    """
    content = F.struct(
        "record_id", "type", "concurrent_to", "refers_to", "uri", "date", "payload_digest",
        "payload_bytes", "block",
    )
    captured = F.col("type").isin("response", "revisit")
    captures = (
        records.where(captured)
        .groupBy(F.col("record_id").alias("capture_id"))
        .agg(F.min(content).alias("response"))
    )
    named = records.where(captured).select(
        F.explode("concurrent_to").alias("record_id"), F.col("record_id").alias("capture_id")
    )

    def side(kind: str) -> DataFrame:
        own = records.where(F.col("type") == kind)
        forward = own.select(F.explode("concurrent_to").alias("capture_id"), content.alias(kind))
        backward = own.join(named, "record_id").select("capture_id", content.alias(kind))
        return forward.unionByName(backward).groupBy("capture_id").agg(F.min(kind).alias(kind))

    return captures.join(side("request"), "capture_id", "left").join(
        side("metadata"), "capture_id", "left"
    )
