"""Content-addressed WARC archive.

Payload bytes are stored once, gzip-framed as in ``.warc.gz`` files, under a verified digest; exact record headers lie in
a table of their own. The original records come back by joining both.

A payload's address is its SHA-256 and length; the SHA-1 of the WARC header is computed over the same bytes, and both are
checked again when records are rebuilt. Each task keeps one copy of a payload before anything is shuffled, so a
payload that a third of all pages share moves once per task, and the join back is salted by its number of records.
"""

from __future__ import annotations

import gzip
import hashlib
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinproof.llm.common import map_arrow, saved, utf8

#: Records that one copy of a payload serves in the join back.
SALT_ROWS = 2000


@dataclass
class Archive:
    """``headers``: page_id, address, salt, header. ``payloads``: address, copies, stored (gzip bytes), one row each."""

    headers: DataFrame
    payloads: DataFrame


#: Date of records whose pages name none; the standard asks for one in every record.
NO_DATE = "1970-01-01T00:00:00Z"


def record_id(page_id: int | None, place: str) -> str:
    """Own to each record: repeated rows of a page differ in their place."""
    return f"<urn:page:{'' if page_id is None else page_id}:{place}>"


def header_bytes(page_id: int | None, place: str, url: str | None, sha1: str, length: int, refers_to: str | None, date: str) -> bytes:
    """Header block of a record, with the blank line that ends it. A record that refers to another is a revisit and carries no block."""
    revisit = refers_to is not None
    uri = (url or "").replace("\r", "%0D").replace("\n", "%0A")
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, place)}",
        f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{sha1}",
    ]
    if revisit:
        lines += [
            "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest",
            f"WARC-Refers-To: {refers_to}",
        ]
    lines += ["Content-Type: text/html; charset=utf-8", f"Content-Length: {0 if revisit else length}"]
    return ("\r\n".join(lines) + "\r\n\r\n").encode()


def parse_header(block: bytes) -> dict[str, str]:
    lines = block.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    return dict(line.split(": ", 1) for line in lines[1:] if line)


def write_archive(pages: DataFrame, min_revisit: int = 1000, date: str | None = None) -> Archive:
    """Write one record per row of ``pages`` (page_id, url, html) to the shared folder.

    Of the records with one payload of at least ``min_revisit`` bytes, that with the largest page_id is the response
    and the others revisit it; a repeated row of the response is a response too. Smaller payloads are
    responses all. A null html is empty, a null url an empty target; other columns are left out.
    ``date`` names a timestamp column with the time of capture; without one, or where it is null, the date is NO_DATE.
    """

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        task, nth = TaskContext.get().partitionId(), 0
        for batch in batches:
            rows = []
            for page, url, body, day in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), utf8(batch.column(2)), batch.column(3).to_pylist()):
                nth += 1
                address = hashlib.sha256(body).digest() + len(body).to_bytes(8, "big")
                stored = None
                if address not in seen:
                    if len(seen) > 200_000:
                        seen.clear()
                    seen.add(address)
                    stored = gzip.compress(body, 6, mtime=0)
                rows.append((page, f"{task}.{nth}", url, day, address, hashlib.sha1(body).hexdigest(), len(body), stored))
            if rows:
                kinds = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], ["page_id", "place", "url", "day", "address", "sha1", "length", "stored"])

    day = F.lit(NO_DATE) if date is None else F.coalesce(F.date_format(F.col(date).cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(NO_DATE))  # the session is pinned to UTC
    rows = pages.select(F.col("page_id").cast("long"), F.col("url").cast("string"), F.col("html").cast("string"), day.alias("day"))
    rows = saved(map_arrow(rows, digest, "page_id long, place string, url string, day string, address binary, sha1 string, length long, stored binary"), "warc-rows")

    groups = rows.groupBy("address").agg(F.max(F.struct("page_id", "place")).alias("last"), F.count("*").alias("records"))
    groups = groups.select("address", "records", F.col("last.page_id").alias("response"), F.col("last.place").alias("response_place"))
    groups = groups.withColumn("parts", F.ceil(F.col("records") / SALT_ROWS).cast("int"))
    # One copy from each task at most; any of them is the payload.
    copies = rows.filter("stored IS NOT NULL").select("address", "stored").dropDuplicates(["address"])
    payloads = saved(copies.join(groups.select("address", "parts"), "address"), "warc-payloads")

    def headers(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [header_bytes(*r) for r in zip(*(batch.column(c).to_pylist() for c in ("page_id", "place", "url", "sha1", "length", "refers_to", "day")))]
            kept = [batch.column(c) for c in ("page_id", "address", "salt", "length")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(out, pa.binary())], ["page_id", "address", "salt", "length", "header"])

    revisit = (F.col("length") >= min_revisit) & F.col("response").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("response"))
    salt = F.pmod(F.xxhash64("page_id"), F.col("parts")).cast("int")
    joined = rows.drop("stored").join(groups, "address").withColumn("salt", salt)
    joined = joined.withColumn("refers_to", F.when(revisit, F.format_string("<urn:page:%d:%s>", "response", "response_place")))
    return Archive(saved(map_arrow(joined, headers, "page_id long, address binary, salt int, length long, header binary"), "warc-headers"), payloads)


def read_records(archive: Archive) -> DataFrame:
    """page_id, header and payload of every record, rebuilt by a join and verified against all digests."""

    def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size, begin = 0, 0
            payloads: list[bytes] = []
            columns = [batch.column(c).to_pylist() for c in ("page_id", "header", "address", "stored")]
            for i, (_, header, address, stored) in enumerate(zip(*columns)):
                body = zlib.decompress(stored, 31)
                if hashlib.sha256(body).digest() + len(body).to_bytes(8, "big") != address:
                    raise ValueError("a stored payload does not match its address")
                if parse_header(header)["WARC-Payload-Digest"] != f"sha1:{hashlib.sha1(body).hexdigest()}":
                    raise ValueError("a payload does not match its record's digest")
                payloads.append(body)
                size += len(body)
                if size > 8 << 20 or i + 1 == len(batch):
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, len(payloads)), batch.column(1).slice(begin, len(payloads)), pa.array(payloads, pa.binary())], ["page_id", "header", "payload"])
                    begin, size, payloads = i + 1, 0, []

    copies = archive.payloads.select("address", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("salt"), "stored")
    both = archive.headers.join(copies, ["address", "salt"]).select("page_id", "header", "address", "stored")
    return map_arrow(both, rebuild, "page_id long, header binary, payload binary")


def record_facts(records: DataFrame) -> DataFrame:
    """What rebuilt records say: payload_bytes, payload_digest, record_type and refers_to per page."""
    header = F.decode("header", "UTF-8")

    def field(name: str):
        return F.regexp_extract(header, rf"\r\n{name}: ([^\r]*)", 1)

    refers = F.regexp_extract(header, r"\r\nWARC-Refers-To: <urn:page:(-?\d+):", 1)
    return records.select(
        "page_id",
        F.length("payload").cast("long").alias("payload_bytes"),
        F.sha1("payload").alias("payload_digest"),
        field("WARC-Type").alias("record_type"),
        F.when(refers != "", refers.cast("long")).alias("refers_to"),
    )
