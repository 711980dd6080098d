"""Operator 5: WARC archives, from monolithic gzip to one member a record.

``write_monolithic`` writes whole-file gzip streams, as a naive crawler would.
``normalise`` inflates each stream once and rewrites every record as a gzip
member of its own.  ``index`` walks the members of the rewritten archives and
gives the sidecar table of offsets, from which ``read_record`` fetches one
record by a range read.

All files go through Spark's text writer and binaryFile reader, so they can lie
in any store that Spark reaches.  That writer ends every row with a separator;
for rewritten archives it is an empty gzip member, which inflates to nothing.

Defined results: a null payload is empty; a null id is written as an empty id
and read back as null; a null url is written as an empty url.  Rows that repeat
both the payload and the smallest id of its group are all responses.  Extra
columns are not read.  An empty table gives archives without records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import unquote_plus

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from memlake.session import materialize

CRAWLED_AT = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:page:"
#: an empty gzip member
EMPTY_MEMBER = gzip.compress(b"", mtime=0)
INDEX_SCHEMA = ("archive string, record_no long, offset long, length long, record_id string, record_type string, "
                "refers_to string, payload_bytes long, payload_digest string, intact boolean")
_PIECE = 1 << 20


def decide(pages: DataFrame, *, page_id: str, url: str, payload: str, min_bytes: int = 100) -> DataFrame:
    """Per row ``id, url, payload, payload_bytes, payload_digest, refers_to`` (null for responses)."""
    rows = pages.select(
        F.col(page_id).alias("id"), F.coalesce(F.col(url).cast("string"), F.lit("")).alias("url"),
        F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")).withColumns({
            "payload_bytes": F.octet_length("payload").cast("long"),
            "payload_digest": F.sha2(F.col("payload").cast("binary"), 256)})
    # written before the join, so that Spark can split the rows of a frequent payload over tasks
    firsts = materialize(rows.where(F.col("payload_bytes") >= min_bytes).groupBy("payload_digest")
                         .agg(F.min("id").alias("first_id"), F.count("*").alias("copies"))
                         .where("copies > 1 AND first_id IS NOT NULL").drop("copies"), "warc-firsts")
    joined = rows.join(firsts, "payload_digest", "left")
    return joined.withColumn("refers_to", F.when(~F.col("id").eqNullSafe(F.col("first_id")), F.col("first_id"))
                             ).drop("first_id")


def _urn(column: str) -> Column:
    return F.concat(F.lit(f"<{URN}"), F.coalesce(F.url_encode(F.col(column).cast("string")), F.lit("")), F.lit(">"))


def record_text(decided: DataFrame) -> DataFrame:
    """One WARC/1.1 record per row as a string that lacks its last line feed, which the text writer adds."""
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes").cast("string"), F.lit("\r\n\r\n"))
    block = F.when(F.col("refers_to").isNull(), F.concat(http, F.col("payload"))).otherwise(http)
    refers = F.when(F.col("refers_to").isNotNull(), F.concat(
        F.lit("WARC-Refers-To: "), _urn("refers_to"), F.lit(f"\r\nWARC-Profile: {PROFILE}\r\n"))).otherwise("")
    kind = F.when(F.col("refers_to").isNull(), "response").otherwise("revisit")
    return decided.withColumn("block", block).select(F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), kind, F.lit("\r\nWARC-Record-ID: "), _urn("id"),
        F.lit("\r\nWARC-Target-URI: "), F.regexp_replace("url", "[\r\n]", ""),
        F.lit(f"\r\nWARC-Date: {CRAWLED_AT}\r\n"), refers,
        F.lit("WARC-Payload-Digest: sha256:"), F.col("payload_digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length("block").cast("string"), F.lit("\r\n\r\n"), F.col("block"), F.lit("\r\n\r")).alias("value"))


def write_monolithic(decided: DataFrame, path: str, records_per_file: int = 2_000) -> None:
    """Archives of at most ``records_per_file`` records, each file one gzip stream."""
    (record_text(decided).write.option("compression", "gzip").option("maxRecordsPerFile", records_per_file)
     .text(path))


def _archives(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "content")


def _inflated(content: bytes) -> Iterator[bytes]:
    """Pieces of bounded size of a gzip file of one or many members."""
    stream, rest = zlib.decompressobj(31), content
    while rest:
        piece = stream.decompress(rest, _PIECE)
        if piece:
            yield piece
        if stream.eof:
            rest, stream = stream.unused_data, zlib.decompressobj(31)
        else:
            rest = stream.unconsumed_tail
            if not rest and not piece:
                break


def _headers(head: bytes) -> dict[str, str]:
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}


def _records(content: bytes) -> Iterator[bytes]:
    """Whole records of an archive, in order."""
    buffer, need = bytearray(), 0
    for piece in _inflated(content):
        buffer += piece
        while len(buffer) >= max(need, 1):
            end = buffer.find(b"\r\n\r\n")
            if end < 0:
                break
            need = end + 4 + int(_headers(bytes(buffer[:end])).get("content-length", 0)) + 4
            if len(buffer) < need:
                break
            yield bytes(buffer[:need])
            del buffer[:need]
            need = 0
    if buffer.strip():
        raise ValueError("an archive ends inside a record")


def _rewrite(level: int):
    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                members, held = [], 0
                for record in _records(content):
                    members.append(gzip.compress(record, level, mtime=0))
                    held += len(members[-1])
                    if held > _PIECE:
                        yield pd.DataFrame({"member": members})
                        members, held = [], 0
                if members:
                    yield pd.DataFrame({"member": members})
    return rewrite


def normalise(spark: SparkSession, monolithic: str, path: str, level: int = 1) -> None:
    """Rewrite archives so that each record is a member of its own.

    Each file is inflated once, in pieces; a task holds one compressed file,
    whose size ``write_monolithic`` bounds by its records, and one record.
    """
    members = _archives(spark, monolithic).mapInPandas(_rewrite(level), "member binary")
    (members.select(F.col("member").cast("string")).write
     .option("lineSep", EMPTY_MEMBER.decode("latin-1")).option("encoding", "ISO-8859-1").text(path))


def _payload(record: bytes) -> tuple[dict[str, str], dict[str, str], bytes]:
    end = record.index(b"\r\n\r\n")
    head = _headers(record[:end])
    block = record[end + 4:end + 4 + int(head["content-length"])]
    cut = block.index(b"\r\n\r\n")
    return head, _headers(block[:cut]), block[cut + 4:]


def _page(urn: str | None) -> str | None:
    return None if urn is None else unquote_plus(urn.strip("<>").removeprefix(URN)) or None


def _walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in INDEX_SCHEMA.split(", ")]
    for batch in batches:
        for path, content in zip(batch["path"], batch["content"]):
            rows, offset, number, view = [], 0, 0, memoryview(content)
            while offset < len(content):
                stream, record, at = zlib.decompressobj(31), bytearray(), offset
                while not stream.eof and at < len(content):
                    piece = view[at:at + 65_536]
                    record += stream.decompress(piece)
                    at += len(piece)
                at -= len(stream.unused_data)
                if record:
                    head, http, payload = _payload(bytes(record))
                    kept = head["warc-type"] == "response"
                    named = head["warc-payload-digest"].removeprefix("sha256:")
                    digest = hashlib.sha256(payload).hexdigest() if kept else named
                    rows.append((path, number, offset, at - offset, _page(head["warc-record-id"]), head["warc-type"],
                                 _page(head.get("warc-refers-to")),
                                 len(payload) if kept else int(http["content-length"]), digest, digest == named))
                    number += 1
                    if len(rows) == 5_000:
                        yield pd.DataFrame(rows, columns=columns)
                        rows = []
                offset = at
            if rows:
                yield pd.DataFrame(rows, columns=columns)


def index(spark: SparkSession, path: str) -> DataFrame:
    """The sidecar index of rewritten archives: where each record's member lies and what it holds.

    Digest and size of a response are taken from the payload as read back;
    ``intact`` says whether that digest is the one named in the header.
    """
    return _archives(spark, path).mapInPandas(_walk, INDEX_SCHEMA)


def read_record(path: str, offset: int, length: int) -> bytes:
    """One record of an archive on a mounted file system, by its index entry."""
    with open(path.removeprefix("file:"), "rb") as f:
        f.seek(offset)
        return gzip.decompress(f.read(length))


def write_archives(pages: DataFrame, folder: str, *, page_id: str = "page_id", url: str = "url",
                   payload: str = "html", min_bytes: int = 100) -> DataFrame:
    """Write, rewrite and index the archives of ``pages`` below ``folder``; returns the written index."""
    spark = pages.sparkSession
    write_monolithic(decide(pages, page_id=page_id, url=url, payload=payload, min_bytes=min_bytes),
                     f"{folder}/monolithic")
    normalise(spark, f"{folder}/monolithic", f"{folder}/archives")
    index(spark, f"{folder}/archives").write.parquet(f"{folder}/index")
    return spark.read.schema(INDEX_SCHEMA).parquet(f"{folder}/index")
