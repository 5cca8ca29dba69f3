"""WARC archives with segmented records: writing, reading and reassembly (operator 2).

Every page becomes a WARC/1.1 record, a gzip member of its own. Of pages with equal payloads the one with the largest
page_id is a response and the others are revisits that refer to it. A response's block is an HTTP message in chunked
transfer coding; a block over SEGMENT bytes is cut into a first record with WARC-Segment-Number 1 and continuation
records, which readers bring together by the origin's identifier, in order of the segment number; the last one states
the total length. Record identifiers hold page_id and digest, so equal identifiers mean equal payloads.

Defined results: a null html is an empty payload, and empty payloads are equal payloads; rows equal in page_id and html
are all responses, or all revisits, as often as they come; a null page_id is smaller than any other; a null url gives no
target; an empty table gives no archive and no rows; other columns of the input are ignored.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessella.llm.common import Stage, shared_dir, ship

#: Bytes of a block in one record, of a chunk of the transfer coding, and of an archive before the next one begins.
SEGMENT, CHUNK, ARCHIVE = 32 << 10, 8 << 10, 32 << 20
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"


class Damaged(ValueError):
    """An archive whose records don't fit together."""


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def to_chunks(payload: bytes, chunk: int = CHUNK) -> bytes:
    parts = []
    for i in range(0, len(payload), chunk):
        part = payload[i : i + chunk]
        parts.append(b"%x\r\n%b\r\n" % (len(part), part))
    return b"".join([*parts, b"0\r\n\r\n"])


def from_chunks(body: bytes) -> bytes:
    """The payload of a chunked body; chunk extensions and trailers are read over."""
    parts, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise Damaged("a chunk's size is missing")
        try:
            n = int(body[at:end].split(b";")[0].strip(), 16)
        except ValueError:
            raise Damaged("a chunk's size is no number") from None
        at = end + 2
        if n == 0:
            break
        if n < 0 or body[at + n : at + n + 2] != b"\r\n":
            raise Damaged("a chunk ends before its size")
        parts.append(body[at : at + n])
        at += n + 2
    if not (body[at : at + 2] == b"\r\n" or b"\r\n\r\n" in body[at:]):
        raise Damaged("the last chunk isn't closed")
    return b"".join(parts)


def payload_of(block: bytes) -> bytes:
    """What the HTTP message in a response's block carries."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise Damaged("a response without the end of its HTTP header")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") == b"chunked":
        return from_chunks(body)
    n = int(fields.get(b"content-length", len(body)))
    if len(body) < n:
        raise Damaged("a body shorter than its Content-Length")
    return body[:n]


def record(fields: list[tuple[str, object]], block: bytes, level: int = 1) -> bytes:
    head = "".join(f"{k}: {v}\r\n" for k, v in [*fields, ("Content-Length", len(block))] if v is not None)
    return gzip.compress(b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n", level, mtime=0)


def identifier(page_id: int | None, digest: str) -> str:
    return f"<urn:x-page:{'' if page_id is None else page_id}:{digest}>"


def page_of(name: str) -> int | None:
    """The page_id in an identifier."""
    number = name.strip("<>").split(":")[2]
    return int(number) if number else None


def records_of(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, segment: int = SEGMENT) -> list[bytes]:
    digest = digest_of(payload)
    target = None if url is None else url.replace("\r", "").replace("\n", "")
    common = [("WARC-Date", DATE), ("WARC-Target-URI", target), ("WARC-Payload-Digest", f"sha1:{digest}")]
    name = identifier(page_id, digest)
    if refers_to is not None:
        block = HTTP + b"Content-Length: %d\r\n\r\n" % len(payload)
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", name), *common, ("WARC-Profile", PROFILE), ("WARC-Refers-To", identifier(refers_to, digest)), ("Content-Type", "application/http;msgtype=response")], block)]
    block = HTTP + b"Transfer-Encoding: chunked\r\n\r\n" + to_chunks(payload)
    first = [("WARC-Type", "response"), ("WARC-Record-ID", name), *common, ("Content-Type", "application/http;msgtype=response")]
    if len(block) <= segment:
        return [record(first, block)]
    out = [record([*first, ("WARC-Segment-Number", 1)], block[:segment])]
    for k, at in enumerate(range(segment, len(block), segment), 2):
        total = len(block) if at + segment >= len(block) else None
        out.append(record([("WARC-Type", "continuation"), ("WARC-Record-ID", f"<{name.strip('<>')}:{k}>"), ("WARC-Date", DATE), ("WARC-Segment-Origin-ID", name), ("WARC-Segment-Number", k), ("WARC-Segment-Total-Length", total)], block[at : at + segment]))
    return out


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (names in lower case) and block of each record of a gzipped archive."""
    lines = io.BufferedReader(gzip.GzipFile(fileobj=stream, mode="rb"), 1 << 18)
    while True:
        line = lines.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise Damaged("a record that doesn't begin with its version")
        fields: dict[str, str] = {}
        while (line := lines.readline()).strip():
            name, _, value = line.decode().partition(":")
            fields[name.strip().lower()] = value.strip()
        n = int(fields["content-length"])
        block = lines.read(n)
        if len(block) != n:
            raise Damaged("a block shorter than its Content-Length")
        yield fields, block


def write(pages: DataFrame, *, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", segment: int = SEGMENT) -> DataFrame:
    """Writes the archives under the shared folder; returns their manifest: path, folder, records.

    An archive is one task's work under a name of its own, and only finished tasks are in the manifest. Digests that
    occur once need no partner, so the side joined to the pages has a row for each repeated payload only; a payload that
    many pages share is split by Spark's skew join.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = shared_dir(spark)
    html = F.coalesce(F.col(f"`{html_col}`"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{url_col}`").alias("url"), html.alias("payload"), F.sha1(html).alias("digest"))
    repeated = rows.groupBy("digest").agg(F.max("id").alias("response"), F.count(F.lit(1)).alias("n")).where("n > 1").select("digest", "response")
    rows = rows.join(Stage(repeated).df, "digest", "left")
    rows = rows.select("id", "url", "payload", F.when(F.col("response").isNotNull() & ~F.col("id").eqNullSafe(F.col("response")), F.col("response")).alias("refers_to"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        files, base = fs.FileSystem.from_uri(folder)
        files.create_dir(base, recursive=True)
        out, done, path, n, size = None, [], "", 0, 0
        for batch in batches:
            columns = [batch.column(k) for k in range(4)]
            for k in range(batch.num_rows):
                page_id, url, payload, refers_to = (c[k].as_py() for c in columns)
                if out is None:
                    path, n, size = f"{base}/{uuid.uuid4().hex}.warc.gz", 0, 0
                    out = files.open_output_stream(path, compression=None)
                for data in records_of(page_id, url, payload, refers_to, segment):
                    out.write(data)
                    n += 1
                size += len(payload)
                if size >= ARCHIVE:
                    out.close()
                    done.append((path, n))
                    out = None
        if out is not None:
            out.close()
            done.append((path, n))
        if done:
            yield pa.RecordBatch.from_pydict({"path": [p for p, _ in done], "records": pa.array([c for _, c in done], pa.int64())})

    return Stage(rows.mapInArrow(run, "path string, records long")).df.withColumn("folder", F.lit(folder))


def read(manifest: DataFrame) -> DataFrame:
    """One row per record that isn't a part of another: page_id, record_type, refers_to, digest, payload (null for revisits), payload_bytes.

    Records of one piece are decoded where they are read. Only segments are shuffled, by their origin's identifier.
    """
    ship(manifest.sparkSession)
    n = max(1, manifest.count())
    schema = "origin string, number int, total long, type string, refers_to string, digest string, block binary"

    def records(segmented: bool):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            from pyarrow import fs

            held, size = [], 0
            for batch in batches:
                for row in batch.to_pylist():
                    where, _ = fs.FileSystem.from_uri(row["folder"])
                    with where.open_input_stream(row["path"], compression=None) as stream:
                        for fields, block in parse(stream):
                            number = fields.get("warc-segment-number")
                            if (number is not None) != segmented:
                                continue
                            kind, digest = fields["warc-type"], fields.get("warc-payload-digest", "").removeprefix("sha1:")
                            total = fields.get("warc-segment-total-length")
                            origin = fields.get("warc-segment-origin-id", fields["warc-record-id"])
                            held.append((origin, int(number or 0), None if total is None else int(total), kind, fields.get("warc-refers-to"), digest or None, block))
                            size += len(block)
                            if size > 4 << 20 or len(held) > 5000:
                                yield to_batch(held)
                                held, size = [], 0
            if held:
                yield to_batch(held)

        def to_batch(rows: list[tuple]) -> pa.RecordBatch:
            kinds = [pa.string(), pa.int32(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], ["origin", "number", "total", "type", "refers_to", "digest", "block"])

        return manifest.repartition(n, "path").mapInArrow(run, schema)

    parts = reassemble(records(True))
    whole = records(False).withColumn("copies", F.lit(1).cast("long"))
    return decode(whole.unionByName(parts))


def reassemble(segments: DataFrame) -> DataFrame:
    """Joins the segments of each origin in order of their numbers; an origin's segments are one record's block.

    Raises when a number is missing, a length isn't the one stated, or copies of a segment differ.
    """
    one = segments.groupBy("origin", "number").agg(F.count(F.lit(1)).alias("copies"), F.max("total").alias("total"), F.max("type").alias("type"), F.max("digest").alias("digest"), F.min("block").alias("block"), F.max("block").alias("other"))
    one = one.withColumn("block", F.when(F.col("block") == F.col("other"), F.col("block")).otherwise(F.raise_error(F.concat(F.lit("copies of a segment differ: "), "origin")).cast("binary")))
    joined = one.groupBy("origin").agg(F.sort_array(F.collect_list(F.struct("number", "block"))).alias("s"), F.max("total").alias("total"), F.max("digest").alias("digest"), F.min("copies").alias("copies"), F.max("copies").alias("most"), F.max("number").alias("last"))
    # joined as hex digits, in one pass: bytes added one by one are copied again for each segment
    block = F.unhex(F.array_join(F.transform("s", lambda x: F.hex(x["block"])), ""))
    joined = joined.select("*", block.alias("block"))
    sound = (F.size("s") == F.col("last")) & (F.col("copies") == F.col("most")) & F.coalesce(F.octet_length("block") == F.col("total"), F.lit(False))
    checked = F.when(sound, F.col("block")).otherwise(F.raise_error(F.concat(F.lit("segments missing, or not of the stated length: "), "origin")).cast("binary"))
    none = F.lit(None).cast("string")
    return joined.select("origin", F.lit(1).alias("number"), "total", F.lit("response").alias("type"), none.alias("refers_to"), "digest", checked.alias("block"), "copies")


def decode(records: DataFrame) -> DataFrame:
    """Payloads of whole records, each checked against the digest that its header states."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                if r["type"] == "revisit":
                    fields = r["block"].lower().partition(b"content-length:")[2]
                    out.append((page_of(r["origin"]), "revisit", page_of(r["refers_to"]), r["digest"], None, int(fields.split(b"\r\n")[0])))
                    continue
                payload = payload_of(r["block"])
                digest = digest_of(payload)
                if r["digest"] is not None and r["digest"] != digest:
                    raise Damaged(f"payload and digest of {r['origin']} differ")
                out += [(page_of(r["origin"]), "response", None, digest, payload, len(payload))] * r["copies"]
            if out:
                kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.binary(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["page_id", "record_type", "refers_to", "digest", "payload", "payload_bytes"])

    return records.mapInArrow(run, "page_id long, record_type string, refers_to long, digest string, payload binary, payload_bytes long")


def op2_segmented_warc(spark, sf_dir: str) -> DataFrame:
    rows = read(write(spark.read.parquet(f"{sf_dir}/pages.parquet")))
    return rows.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), "record_type", "refers_to")
