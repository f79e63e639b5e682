"""WARC archives: writing with revisits, chunked framing and segments; reading with reassembly.

Writing.  A page becomes a record whose block is an HTTP response with chunked transfer framing.  Of
pages with equal payloads of at least ``REVISIT_BYTES``, that with the least id is the response; the
others become ``revisit`` records that name its id, URI and payload digest and hold no payload.  A block
longer than ``segment`` bytes is cut: the first record carries segment number 1, ``continuation`` records
carry the rest, their number and the first record's id, the last one the total length.  Records are
written by Spark's text writer with CRLF between them, each file as gzip, so every store that Spark
writes to will do; binary blocks pass through as they are.

Reading.  Files are read whole (the writer keeps them to about ``FILE_BYTES``), plain or as gzip
members, and parsed record by record.  Records with a segment number are grouped by the id of their
origin, ordered by number and joined, and the total length is verified; then the transfer framing is
decoded and the payload digest verified.  What fails is reported in ``problem``, not dropped.

Corner cases: a null or empty page is a response with an empty payload; null ids are never preferred, and
are written as ``null``; rows that share the least id of equal payloads are all responses; repeated rows
are records of their own (record ids are random); an empty table gives an empty archive; further columns
of the pages are not archived.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.chunks import write_chunks
from gaugeline.llm.links import stored

REVISIT_BYTES = 100
SEGMENT, CHUNK = 16 << 10, 4 << 10
FILE_BYTES = 32 << 20

_HTTP = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nTransfer-Encoding: chunked\r\n\r\n"


# --- writing ---------------------------------------------------------------------------------


def _raw(data: Column) -> Column:
    """Bytes as a string of the same bytes."""
    return data.cast("string")


def _chunked(payload: Column, size: int) -> Column:
    """Chunked transfer framing of binary data, as a string of raw bytes."""
    begins = F.when(F.octet_length(payload) > 0, F.sequence(F.lit(1), F.octet_length(payload), F.lit(size))).otherwise(
        F.array().cast("array<int>")
    )

    def framed(begin: Column) -> Column:
        part = F.substring(payload, begin, F.lit(size))
        return F.concat(F.lower(F.hex(F.octet_length(part).cast("bigint"))), F.lit("\r\n"), _raw(part), F.lit("\r\n"))

    return F.concat(F.array_join(F.transform(begins, framed), ""), F.lit("0\r\n\r\n"))


def _measured(rows: DataFrame) -> DataFrame:
    """With ``payload`` (bytes), its ``digest`` and ``size``."""
    payload = F.coalesce(F.encode(F.col("html"), "UTF-8"), F.lit(b""))
    return rows.withColumn("payload", payload).withColumn("digest", F.sha2("payload", 256)).withColumn("size", F.octet_length("payload"))


def _revisits(chunks: DataFrame) -> DataFrame:
    """``chunk`` and, for its rows that repeat the payload of another, ``again``: place to what they refer to."""
    rows = chunks.select("chunk", F.posexplode("rows").alias("place", "row")).select("chunk", "place", "row.*")
    narrow = _measured(rows).where(F.col("size") >= REVISIT_BYTES).select("chunk", "place", "page_id", "url", "digest")
    # stored, so that the join is between plain shuffles, which Spark splits where a payload has many copies
    firsts = stored(
        narrow.groupBy("digest").agg(F.min("page_id").alias("to_page"), F.min_by("url", "page_id").alias("to_uri"), F.count("*").alias("n"))
        .where("n > 1 and to_page is not null").drop("n"),
        "payloads",
    )
    found = narrow.join(firsts.hint("merge"), "digest").where("not (page_id <=> to_page)")
    entry = F.struct("place", F.struct("to_page", "to_uri"))
    return found.groupBy("chunk").agg(F.map_from_entries(F.collect_list(entry)).alias("again"))


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", segment: int = SEGMENT, chunk: int = CHUNK) -> None:
    """Write one record per page (more for segments) into ``folder``.

    Pages are written as chunks first (``chunks``): what is found about a page then joins its chunk, and
    no page is shuffled.
    """
    chunks, _ = write_chunks(pages.select(F.col(key).alias("page_id"), F.col(url).alias("url"), F.col(html).alias("html")), "html")
    known = chunks.join(_revisits(chunks).hint("merge"), "chunk", "left")
    rows = known.select("again", F.posexplode("rows").alias("place", "row")).select(
        "row.*", F.try_element_at("again", F.col("place")).alias("to")
    )
    joined = _measured(rows).withColumn("refers_to", F.col("to.to_page")).withColumn("refers_uri", F.col("to.to_uri"))
    again = F.col("refers_to").isNotNull()
    block = F.when(again, F.lit(_HTTP)).otherwise(F.concat(F.lit(_HTTP), _chunked(F.col("payload"), chunk)))
    records = joined.select(
        F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")).alias("id"), "page_id", "url", "digest", "size", "refers_to", "refers_uri",
        again.alias("again"), block.cast("binary").alias("whole"),
    )
    total = F.octet_length("whole")
    begins = F.sequence(F.lit(1), F.greatest(total, F.lit(1)), F.lit(segment))
    cut = records.select("*", total.alias("total"), F.size(begins).alias("n"), F.posexplode(begins).alias("k", "begin"))
    part = F.substring(F.col("whole"), F.col("begin"), F.lit(segment))
    first, segmented, last = F.col("k") == 0, F.col("n") > 1, F.col("k") == F.col("n") - 1

    def line(name: str, value: Column, when: Column | None = None) -> Column:
        text = F.concat(F.lit(f"{name}: "), value.cast("string"), F.lit("\r\n"))
        return F.coalesce(text if when is None else F.when(when, text), F.lit(""))

    kind = F.when(~first, "continuation").when(F.col("again"), "revisit").otherwise("response")
    own = F.when(first, F.col("id")).otherwise(F.concat(F.lit("<urn:uuid:"), F.uuid(), F.lit(">")))
    head = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", kind),
        line("WARC-Record-ID", own),
        line("WARC-Date", F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss'Z'")),
        line("WARC-Target-URI", F.regexp_replace(F.col("url"), r"[\r\n]", "")),
        line("Content-Type", F.lit("application/http; msgtype=response"), first),
        line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest")), first),
        line("X-Page-ID", F.coalesce(F.col("page_id").cast("string"), F.lit("null")), first),
        line("X-Payload-Length", F.col("size"), first),
        line("WARC-Profile", F.lit("http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), F.col("again") & first),
        line("WARC-Refers-To-Target-URI", F.regexp_replace(F.col("refers_uri"), r"[\r\n]", ""), F.col("again") & first),
        line("X-Refers-To-Page", F.col("refers_to"), F.col("again") & first),
        line("WARC-Segment-Number", F.col("k") + 1, segmented),
        line("WARC-Segment-Origin-ID", F.col("id"), segmented & ~first),
        line("WARC-Segment-Total-Length", F.col("total"), segmented & last),
        line("Content-Length", F.octet_length(part)),
    )
    out = cut.select(F.concat(head, F.lit("\r\n"), _raw(part), F.lit("\r\n")).alias("value"))
    # a record holds at most a segment and its header
    out.write.option("compression", "gzip").option("lineSep", "\r\n").option("maxRecordsPerFile", max(1, FILE_BYTES // (segment + 1024))).text(folder)


# --- reading ---------------------------------------------------------------------------------


def unpacked(content: bytes) -> tuple[bytes, str | None]:
    """All gzip members on end, up to one that is damaged; other content as it is."""
    if content[:2] != b"\x1f\x8b":
        return content, None
    out, rest = [], content
    while rest[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(rest))
        except zlib.error as e:
            return b"".join(out), f"gzip member: {e}"
        if not member.eof:
            return b"".join(out), "gzip member is cut"
        rest = member.unused_data
    return b"".join(out), None


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes, str | None]]:
    """Header fields (lower case names), block and problem of each record of a file.  Behind a record that
    can't be read, reading goes on at the next line that begins one."""
    content, damage = unpacked(content)
    at = 0
    while 0 <= at < len(content):
        fields: dict[str, str] = {}
        end = content.find(b"\r\n\r\n", at)
        if content[at : at + 5] != b"WARC/":
            problem, after = f"no record at byte {at}", at
        elif end < 0 or content.find(b"\r\nWARC/", at, end) >= 0:
            problem, after = f"header is cut at byte {at}", at + 5
        else:
            problem, after = None, end + 4
            for text in content[at:end].split(b"\r\n")[1:]:
                name, _, value = text.partition(b":")
                fields[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
            size = fields.get("content-length", "")
            if not re.fullmatch("[0-9]{1,18}", size):
                problem = "no content length"
            elif after + int(size) > len(content):
                problem = f"block is cut at byte {len(content)}"
            elif not all(re.fullmatch("[0-9]{0,18}", fields.get(n, "")) for n in ("warc-segment-number", "warc-segment-total-length")):
                problem = "segment number or length is no number"
        if problem is not None:
            yield fields, b"", problem
            mark = content.find(b"\r\nWARC/", max(0, after - 2))
            at = mark + 2 if mark >= 0 else -1
            continue
        yield fields, content[after : after + int(size)], None
        at = after + int(size)
        while content[at : at + 2] == b"\r\n":
            at += 2
    if damage is not None:
        yield {}, b"", damage


def dechunk(body: bytes) -> bytes:
    """Decode chunked transfer framing; ``ValueError`` if it is damaged."""
    out, at = [], 0
    while True:
        end = body.find(b"\r\n", at)
        if end < 0:
            raise ValueError("chunk size is cut")
        size = int(body[at:end].split(b";")[0], 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("chunk is cut")
        out.append(body[at : at + size])
        at += size + 2


def payload_of(block: bytes) -> bytes:
    head, blank, body = block.partition(b"\r\n\r\n")
    if not blank or not head.startswith(b"HTTP/"):
        return block
    fields = {n.strip().lower(): v.strip().lower() for n, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    return dechunk(body) if b"chunked" in fields.get(b"transfer-encoding", b"") else body


OUT = [
    ("record_id", pa.string()), ("record_type", pa.string()), ("target_uri", pa.string()),
    ("headers", pa.map_(pa.string(), pa.string())), ("payload", pa.binary()), ("problem", pa.string()),
]
_OUT_DDL = "record_id string, record_type string, target_uri string, headers map<string,string>, payload binary, problem string"
_SEGMENT_DDL = "origin string, number int, total bigint, headers map<string,string>, block binary"


def _finished(fields: dict[str, str], block: bytes, problem: str | None) -> tuple:
    payload = None
    if problem is None and fields.get("warc-type") != "revisit":
        try:
            payload = payload_of(block)
            said = fields.get("warc-payload-digest", "")
            if said.startswith("sha256:") and hashlib.sha256(payload).hexdigest() != said[7:]:
                problem = "payload digest differs"
        except ValueError as e:
            problem = str(e)
    return fields.get("warc-record-id"), fields.get("warc-type"), fields.get("warc-target-uri"), list(fields.items()), payload, problem


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [()] * len(OUT)
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, (_, t) in zip(columns, OUT, strict=True)], names=[n for n, _ in OUT])


def _segmented(fields: dict[str, str]) -> bool:
    return fields.get("warc-type") == "continuation" or "warc-segment-number" in fields


def read(spark: SparkSession, folder: str) -> DataFrame:
    """``record_id, record_type, target_uri, headers, payload, problem`` of every whole record of the
    archive; segmented records are joined and appear once, under the first segment's id."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder).select("content")

    def whole(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block, problem in records(content.as_buffer().to_pybytes()):
                    if problem is not None or not _segmented(fields):
                        rows.append(_finished(fields, block, problem))
                        if len(rows) == 1000:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    def parts(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows = []
                for fields, block, problem in records(content.as_buffer().to_pybytes()):
                    if problem is None and _segmented(fields):
                        number = int(fields.get("warc-segment-number") or 0)
                        origin = fields.get("warc-segment-origin-id") or fields.get("warc-record-id")
                        total = fields.get("warc-segment-total-length")
                        rows.append((origin, number, int(total) if total else None, list(fields.items()) if number == 1 else None, block))
                columns = zip(*rows, strict=True) if rows else [()] * 5
                types = [pa.string(), pa.int32(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=["origin", "number", "total", "headers", "block"]
                )

    def joined(batches):
        for batch in batches:
            rows = []
            for r in batch.to_pylist():
                numbers = [p["number"] for p in r["parts"]]
                block = b"".join(p["block"] for p in r["parts"])
                fields = next((dict(p["headers"]) for p in r["parts"] if p["headers"] is not None), {"warc-record-id": r["origin"]})
                problem = None
                if numbers != list(range(1, len(numbers) + 1)):
                    problem = f"segments {numbers}"
                elif r["total"] is None:
                    problem = "last segment is missing"
                elif r["total"] != len(block):
                    problem = f"{len(block)} bytes of {r['total']}"
                rows.append(_finished(fields, block, problem))
            yield _batch(rows)

    # a group is the segments of one record, no larger than the record
    groups = (
        files.mapInArrow(parts, _SEGMENT_DDL)
        .groupBy("origin")
        .agg(F.max("total").alias("total"), F.collect_list(F.struct("number", "headers", "block")).alias("parts"))
        .withColumn("parts", F.array_sort("parts", lambda a, b: a["number"] - b["number"]))
    )
    return files.mapInArrow(whole, _OUT_DDL).union(groups.mapInArrow(joined, _OUT_DDL))


def pages(read_back: DataFrame) -> DataFrame:
    """Per page: ``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``, ``problem``."""
    said = lambda name: F.col("headers")[name]
    again = F.col("record_type") == "revisit"
    return read_back.select(
        F.when(said("x-page-id") != "null", said("x-page-id")).cast("bigint").alias("page_id"),
        F.when(again, said("x-payload-length").cast("bigint")).otherwise(F.octet_length("payload").cast("bigint")).alias("payload_bytes"),
        F.when(again, F.substring(said("warc-payload-digest"), 8, 64)).otherwise(F.sha2("payload", 256)).alias("payload_digest"),
        "record_type", said("x-refers-to-page").cast("bigint").alias("refers_to"), "problem",
    )
