"""WARC archives: writing with segmentation, reading with segment reassembly.

Method
------
Writing: a payload becomes an HTTP message with chunked transfer framing. A
message longer than ``SEGMENT_BYTES`` is cut into segments: the first is the
record itself (WARC-Segment-Number 1), the others are continuation records that
name it (WARC-Segment-Origin-ID) and count on; the last one holds
WARC-Segment-Total-Length. Records are built by column functions and written by
Spark's text writer with the record's end mark as line separator, so files are
committed like any other output. A file has at most ``FILE_RECORDS`` records of
bounded size.

Reading: the files are parsed by content length. Records go by origin identifier
to one task each in order of segment number and are read as a stream: numbers
must run from 1 without a gap, and their bytes must add up to the total length.
The chunked framing is then decoded and the payload's digest compared.

Of equal payloads of at least ``REVISIT_BYTES``, one record keeps the payload
and the others are revisit records that refer to it. Equality is of SHA-256 and
length. A payload that a third of all rows share is one row in the pre-aggregated
table of first records. Payloads are written with their numbers and digests
once; that table is broadcast while it is small (``common.small_side``), so they
aren't shuffled.

Defined cases: a null html is an empty payload; repeated page ids, and repeated
rows, give a record each (of equal payloads all but one revisit, and refer to a
record of the same id); a null id never becomes the record that others refer to
and never a revisit; a null url gives a record without target; an empty table
gives an empty archive; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, materialise, read_table, scratch_path, small_side, with_row_id

SEGMENT_BYTES = 32_768
CHUNK_BYTES = 8_192
FILE_RECORDS = 1_024
REVISIT_BYTES = 100
#: Fixed values of the format.
CRLF, VERSION = "\r\n", "WARC/1.1"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def plan_records(pages: DataFrame) -> tuple[DataFrame, tuple[DataFrame, ...]]:
    """Each page with its payload, digest and role, response or revisit with what it
    refers to; and the written tables that this reads."""
    rows = pages.select("page_id", F.col("url").cast("string").alias("url"), F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8").alias("payload"))
    rows = with_row_id(rows.withColumn("payload_bytes", F.octet_length("payload").cast("bigint")).withColumn("digest", F.sha2("payload", 256)))
    able = (F.col("payload_bytes") >= REVISIT_BYTES) & F.col("page_id").isNotNull()
    firsts = rows.where(able).groupBy("digest", "payload_bytes").agg(F.min(F.struct("page_id", "_row")).alias("first"), F.count("*").alias("n")).where("n > 1")
    firsts = materialise(firsts.select(F.col("digest").alias("key"), "first"), "firsts")
    keyed = rows.withColumn("key", F.when(able, F.col("digest")))
    # a null key joins with nothing; payloads stay where they are while few of them are repeated
    joined = keyed.join(small_side(firsts), "key", "left")
    planned = joined.select("page_id", "url", "payload", "payload_bytes", "digest", "_row", F.when(F.col("first._row") != F.col("_row"), F.col("first")).alias("refers"))
    return planned, (rows, firsts)


def _record_id(page, row):
    return F.concat(F.lit("<urn:page:"), F.coalesce(page.cast("string"), F.lit("")), F.lit(":"), row.cast("string"), F.lit(">"))


def write_archive(pages: DataFrame, path: str, compression: str = "gzip") -> None:
    """Write one record for each row of pages (page_id, url, html) to a new folder."""
    text = lambda *parts: F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts])
    rows, written = plan_records(pages)
    # bytes are handled as strings from here: the writer puts them out as they are
    cut = "transform(sequence(0L, payload_bytes - 1, {0}L), i -> concat(lower(hex(least({0}L, payload_bytes - i))), '\\r\\n', cast(substring(payload, int(i) + 1, {0}) as string), '\\r\\n'))".format(CHUNK_BYTES)
    framed = text(HTTP_HEAD, F.when(F.col("payload_bytes") > 0, F.array_join(F.expr(cut), "")).otherwise(F.lit("")), "0\r\n\r\n")
    rows = rows.withColumn("id", _record_id(F.col("page_id"), F.col("_row"))).withColumn("revisit", F.col("refers").isNotNull())
    rows = rows.withColumn("block", F.when(F.col("revisit"), F.lit(HTTP_HEAD).cast("binary")).otherwise(framed.cast("binary"))).withColumn("size", F.octet_length("block"))
    target = F.coalesce(F.concat(F.lit("WARC-Target-URI: "), F.regexp_replace("url", r"[\r\n]", ""), F.lit(CRLF)), F.lit(""))
    head = text(
        f"{VERSION}{CRLF}WARC-Type: ", F.when(F.col("revisit"), F.lit("revisit")).otherwise(F.lit("response")), f"{CRLF}WARC-Record-ID: ", F.col("id"), f"{CRLF}WARC-Date: 2020-01-01T00:00:00Z{CRLF}", target,
        "Content-Type: application/http; msgtype=response\r\nWARC-Payload-Digest: sha256:", F.col("digest"), f"{CRLF}WARC-Payload-Length: ", F.col("payload_bytes").cast("string"), CRLF,
        F.when(F.col("revisit"), text("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: ", _record_id(F.col("refers.page_id"), F.col("refers._row")), CRLF)).otherwise(F.lit("")),
    )
    first = f"concat(head, if(size > {SEGMENT_BYTES}, 'WARC-Segment-Number: 1\\r\\n', ''), 'Content-Length: ', cast(least(size, {SEGMENT_BYTES}) as string), '\\r\\n\\r\\n', cast(substring(block, 1, {SEGMENT_BYTES}) as string))"
    rest = f"""transform(sequence(1, int((size - 1) div {SEGMENT_BYTES})), i -> concat(
        '{VERSION}\\r\\nWARC-Type: continuation\\r\\nWARC-Record-ID: ', substring(id, 1, length(id) - 1), ':', cast(i + 1 as string), '>\\r\\nWARC-Date: 2020-01-01T00:00:00Z\\r\\nWARC-Segment-Origin-ID: ', id,
        '\\r\\nWARC-Segment-Number: ', cast(i + 1 as string), '\\r\\n', if(i = (size - 1) div {SEGMENT_BYTES}, concat('WARC-Segment-Total-Length: ', cast(size as string), '\\r\\n'), ''),
        'Content-Length: ', cast(least(size - i * {SEGMENT_BYTES}, {SEGMENT_BYTES}) as string), '\\r\\n\\r\\n', cast(substring(block, i * {SEGMENT_BYTES} + 1, {SEGMENT_BYTES}) as string)))"""
    records = rows.withColumn("head", head).select(F.explode(F.expr(f"concat(array({first}), if(size > {SEGMENT_BYTES}, {rest}, cast(array() as array<string>)))")).alias("value"))
    records.write.option("lineSep", CRLF * 2).option("compression", compression).option("maxRecordsPerFile", FILE_RECORDS).text(path)
    discard(*written)


def parse_file(content: bytes):
    """Yield (headers by lower-case name, block) for the records of an archive file.

    Raises ValueError where a record is cut short or isn't one.
    """
    import zlib

    if content[:2] == b"\x1f\x8b":
        parts, rest = [], content
        while rest:
            member = zlib.decompressobj(31)
            parts.append(member.decompress(rest))
            if not member.eof:
                raise ValueError("the archive file is cut short")
            rest = member.unused_data
        content = b"".join(parts)
    at = 0
    while at < len(content):
        end = content.find(b"\r\n\r\n", at)
        if end < 0 or not content.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {at}")
        headers = {}
        for line in content[at:end].decode("utf-8", "replace").split("\r\n")[1:]:
            name, _, value = line.partition(":")
            headers[name.strip().lower()] = value.strip()
        begin = end + 4
        at = begin + int(headers["content-length"])
        if content[at : at + 4] != b"\r\n\r\n":
            raise ValueError(f"the record at byte {begin} is cut short")
        yield headers, content[begin:at]
        at += 4


def decode_chunked(body: bytes) -> bytes:
    """Take chunked transfer framing off; ValueError where it is broken."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("a chunk has no size")
        n = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if n == 0:
            return b"".join(out)
        if body[at + n : at + n + 2] != b"\r\n":
            raise ValueError("a chunk is cut short")
        out.append(body[at : at + n])
        at += n + 2


def http_payload(message: bytes) -> bytes:
    head, _, body = message.partition(b"\r\n\r\n")
    return decode_chunked(body) if b"transfer-encoding: chunked" in head.lower() else body


RECORDS = "record_id string, record_type string, target_uri string, refers_to string, payload_bytes bigint, payload_digest string, complete boolean, payload binary"


def read_archive(spark, path: str, with_payload: bool = True) -> DataFrame:
    """The records of an archive, continuations put back together.

    ``complete`` is false where segments are missing, doubled or of a wrong
    total length, where the chunked framing is broken or where the payload isn't
    what its digest says; length and digest are then null. A revisit has no
    payload of its own, and has length and digest from its headers. Without
    ``with_payload``, payload is null.
    """
    import hashlib

    files = spark.read.format("binaryFile").load(path).select("content")
    fields = "origin string, number bigint, kind string, uri string, refers string, length bigint, digest string, total bigint, block binary"

    def decoded(block: bytes):
        try:
            payload = http_payload(block)
        except ValueError:
            return None
        return payload

    def outcome(kind, uri, refers, length, digest, payload, whole):
        if kind == "revisit":
            return kind, uri, refers, length, digest, digest is not None, None
        if payload is None or not whole:
            return kind, uri, refers, None, None, False, None
        found = hashlib.sha256(payload).hexdigest()
        good = digest in (None, found)
        return kind, uri, refers, len(payload) if good else None, found if good else None, good, payload if with_payload else None

    def parse(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
        names = [f.split()[0] for f in fields.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                out = [[] for _ in kinds]
                for h, block in parse_file(content.as_py()):
                    number = h.get("warc-segment-number")
                    digest = (h.get("warc-payload-digest") or "").removeprefix("sha256:") or None
                    length = int(h["warc-payload-length"]) if "warc-payload-length" in h else None
                    total = h.get("warc-segment-total-length")
                    row = (h.get("warc-segment-origin-id") or h["warc-record-id"], int(number) if number else None, h["warc-type"], h.get("warc-target-uri"), h.get("warc-refers-to"), length, digest, int(total) if total else None, block)
                    if number is None and row[2] == "response":  # a whole record: only what is asked for goes on
                        payload = decoded(block)
                        r = outcome(*row[2:7], payload, True)
                        row = (row[0], None, r[0], r[1], r[2], r[3], r[4], None, r[6] if r[5] else b"")
                        row = (*row[:7], -1 if not r[5] else None, row[8])
                    elif row[2] == "revisit":
                        row = (*row[:8], None)
                    for column, v in zip(out, row, strict=True):
                        column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, kinds, strict=True)], names=names)

    def reassemble(batches):
        import pyarrow as pa

        kinds = [pa.string()] * 4 + [pa.int64(), pa.string(), pa.bool_(), pa.binary()]
        names = [f.split()[0] for f in RECORDS.split(", ")]
        head, blocks, right, total = None, [], False, None

        def close():
            message = b"".join(blocks)
            whole = right and total == len(message)
            return (head[0], *outcome(*head[1:], decoded(message) if whole else None, whole))

        for batch in batches:
            out = []
            for origin, number, kind, uri, refers, length, digest, all_bytes, block in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if number is None:
                    if kind == "revisit":
                        out.append((origin, *outcome(kind, uri, refers, length, digest, None, True)))
                    else:
                        out.append((origin, kind, uri, refers, length, digest, all_bytes != -1, block if with_payload and all_bytes != -1 else None))
                    continue
                if head is None or head[0] != origin:
                    if head is not None:
                        out.append(close())
                    head, blocks, right, total = (origin, kind, uri, refers, length, digest), [], number == 1 and kind != "continuation", None
                else:
                    right = right and number == len(blocks) + 1 and total is None
                blocks.append(block)
                total = all_bytes if all_bytes is not None else total
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out, strict=True), kinds, strict=True)], names=names)
        if head is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(close(), kinds, strict=True)], names=names)

    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return files.mapInArrow(parse, fields).repartition(partitions, "origin").sortWithinPartitions("origin", "number").mapInArrow(reassemble, RECORDS)


def op1_warc(spark, sf_dir: str) -> DataFrame:
    """Write all pages to archives and read them back."""
    pages = read_table(spark, sf_dir, "pages").select("page_id", "url", "html")
    path = scratch_path(spark, "archive")
    write_archive(pages, path)
    page = lambda c: F.regexp_extract(c, r"^<urn:page:(-?\d*):", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("bigint")
    return read_archive(spark, path, with_payload=False).select(number("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to").alias("refers_to"), "complete")


OP1_SQL = """
WITH p AS (
  SELECT page_id, encode(coalesce(html, '')) AS payload FROM pages
), d AS (
  SELECT page_id, octet_length(payload)::BIGINT AS payload_bytes, sha256(payload) AS payload_digest FROM p
), f AS (
  SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM d
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND first_id <> page_id THEN first_id END AS refers_to,
       true AS complete
FROM f
"""
