"""WARC archives: a writer of one gzip member a record, and a splittable reader.

Files live wherever pyarrow's file systems reach.  The reader deals out byte
ranges; a task looks for gzip magic in its range, decodes a candidate's headers
to tell records from chance bytes, and owns the records that start inside,
reading past the range's end to finish the last.
"""

from __future__ import annotations

import base64
import datetime
import hashlib
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F

from newsmill.llm.common import new_folder, ship, stored, table

MAGIC = b"\x1f\x8b\x08"
VERSION = b"WARC/1.1\r\n"
SPLIT_BYTES = 16 << 20
#: Tasks that read at most; of more ranges several share one.
MOST_TASKS = 100_000
_BLOCK = 1 << 16
_PREFIX = "urn:page:"
_DATE = datetime.datetime(2024, 1, 1, tzinfo=datetime.timezone.utc)


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_bytes(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as a gzip member of its own."""
    lines = "".join(f"{k}: {v}\r\n" for k, v in [*headers, ("Content-Length", str(len(block)))])
    squeeze = zlib.compressobj(6, zlib.DEFLATED, 31)
    return squeeze.compress(VERSION + lines.encode() + b"\r\n" + block + b"\r\n\r\n") + squeeze.flush()


def page_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, warc_date: str) -> bytes:
    """A response with its payload or, if ``refers_to`` is given, a revisit with the HTTP headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = refers_to is not None
    headers = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{_PREFIX}{'' if page_id is None else page_id}>"),
        ("WARC-Date", warc_date),
        ("WARC-Target-URI", re.sub(r"[\r\n]", " ", url or "")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("Content-Type", "application/http; msgtype=response"),
    ]
    if revisit:
        headers += [
            ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
            ("WARC-Refers-To", f"<{_PREFIX}{refers_to}>"),
        ]
    return record_bytes(headers, http if revisit else http + payload)


def plan_records(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """(page_id, url, payload binary, refers_to): of equal payloads of ``min_bytes`` or more, all but the largest id refer to it.

    Payloads are equal if length and SHA-1 are.  A null html is an empty
    payload.  Rows that repeat the largest id are all responses; a row with a
    null id refers to the largest id, if there is one.
    """
    p = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"),
        F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"),
    )
    p = p.withColumn("sha1", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    top = p.filter(F.col("size") >= min_bytes).groupBy("sha1", "size").agg(F.max("page_id").alias("top"))
    return p.join(top, ["sha1", "size"], "left").select(
        "page_id", "url", "payload",
        F.when(~F.col("top").eqNullSafe(F.col("page_id")), F.col("top")).alias("refers_to"),
    )


def write_warc(records: DataFrame, folder: str) -> DataFrame:
    """Write (page_id, url, payload, refers_to), a file for each partition; returns (path, size, n_records).

    A file is written under an attempt's name and then moved to the partition's,
    so a task that runs again replaces what an earlier attempt left.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        context = TaskContext.get()
        store, top = pafs.FileSystem.from_uri(folder)
        store.create_dir(top, recursive=True)
        name = f"{top}/pages-{context.partitionId():05d}.warc.gz"
        attempt = f"{top}/.attempt-{context.taskAttemptId()}-{context.partitionId()}"
        count, size, date = 0, 0, _DATE.strftime("%Y-%m-%dT%H:%M:%SZ")
        with store.open_output_stream(attempt) as out:
            for batch in batches:
                for row in zip(*(batch.column(c) for c in ("page_id", "url", "payload", "refers_to"))):
                    page_id, url, payload, refers_to = (x.as_py() for x in row)
                    member = page_record(page_id, url, payload, base32_sha1(payload), refers_to, date)
                    out.write(member)
                    count, size = count + 1, size + len(member)
        store.move(attempt, name)
        yield pa.RecordBatch.from_pylist([{"path": f"pages-{context.partitionId():05d}.warc.gz", "size": size, "n_records": count}])

    ship(records.sparkSession)
    return records.select("page_id", "url", "payload", "refers_to").mapInArrow(run, "path string, size long, n_records long")


def _fields(lines: list[bytes]) -> dict[str, str]:
    pairs = (x.decode("utf-8", "replace").partition(":") for x in lines)
    return {k.strip().lower(): v.strip() for k, _, v in pairs}


def _read_member(src, at: int, data: bytes = b"") -> tuple[dict[str, str], bytes, int] | None:
    """The record of the gzip member at ``at`` and where the member ends; None if none starts there."""
    inflate, plain, head, need = zlib.decompressobj(31), bytearray(), None, None
    src.seek(at)
    while not inflate.eof:
        chunk = data or src.read(_BLOCK)
        data = b""
        if not chunk:
            return None
        try:
            plain += inflate.decompress(chunk)
        except zlib.error:
            return None
        if head is None:
            if plain[:5] != VERSION[: min(5, len(plain))]:
                return None
            if (end := plain.find(b"\r\n\r\n")) >= 0:
                lines = bytes(plain[:end]).split(b"\r\n")
                head = _fields(lines[1:])
                if not re.fullmatch(rb"WARC/\d\.\d", lines[0]) or not head.get("content-length", "").isdigit():
                    return None
                need = end + 4 + int(head["content-length"])
    if head is None or bytes(plain[need:]) != b"\r\n\r\n":
        return None
    return head, bytes(plain[need - int(head["content-length"]) : need]), src.tell() - len(inflate.unused_data)


def records_in_range(src, start: int, end: int, size: int) -> Iterator[tuple[int, dict[str, str], bytes]]:
    """(offset, headers, block) of the records that start in [start, end).

    Once a record is found the next starts where it ends; bytes that are no
    record are skipped up to the next magic that is one.
    """
    at = start
    while at < end:
        if (found := _read_member(src, at)) is not None:
            head, block, after = found
            yield at, head, block
            at = after
            continue
        at += 1
        while at < end:  # the next magic that begins inside
            src.seek(at)
            window = src.read(min(_BLOCK, end - at) + len(MAGIC) - 1)
            hit = window.find(MAGIC)
            if hit >= 0 and at + hit < end:
                at += hit
                break
            at += max(1, len(window) - len(MAGIC) + 1)


def read_warc(files: DataFrame, folder: str, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """(path, offset, record_type, record_id, target_uri, refers_to, declared_digest, http_length, payload) of all records.

    ``files`` is (path, size), paths below ``folder``.  An empty file has no
    records.  A payload is what follows the block's HTTP headers, null for a
    revisit; a record that isn't HTTP has its whole block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for path, size, start in zip(*(batch.column(c).to_pylist() for c in ("path", "size", "start"))):
                out, held = [], 0
                with store.open_input_file(f"{top}/{path}") as src:
                    for at, head, block in records_in_range(src, start, min(start + split_bytes, size), size):
                        kind, http, payload = head.get("warc-type"), {}, block
                        if head.get("content-type", "").startswith("application/http"):
                            http_head, _, payload = block.partition(b"\r\n\r\n")
                            http = _fields(http_head.split(b"\r\n")[1:])
                        length = http.get("content-length", "")
                        out.append({
                            "path": path, "offset": at, "record_type": kind, "record_id": head.get("warc-record-id", "").strip("<>"),
                            "target_uri": head.get("warc-target-uri"), "refers_to": head.get("warc-refers-to", "").strip("<>") or None,
                            "declared_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") or None,
                            "http_length": int(length) if length.isdigit() else None, "payload": None if kind == "revisit" else payload,
                        })
                        held += len(block)
                        if held > 4 << 20:
                            yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)
                            out, held = [], 0
                if out:
                    yield pa.RecordBatch.from_pylist(out, schema=_RECORDS)

    ship(files.sparkSession)
    ranges = files.filter("size > 0").select(
        "path", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))).alias("start")
    )
    # an explicit number: adaptive execution would join the ranges, of some 80 bytes each, into one task
    n_ranges = ranges.count()
    ranges = ranges.repartition(max(1, min(n_ranges, MOST_TASKS)), "path", "start")
    return ranges.mapInArrow(run, ", ".join(f"{f.name} {_DDL[f.type]}" for f in _RECORDS))


_RECORDS = pa.schema([
    ("path", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("target_uri", pa.string()),
    ("refers_to", pa.string()), ("declared_digest", pa.string()), ("http_length", pa.int64()), ("payload", pa.binary()),
])
_DDL = {pa.string(): "string", pa.int64(): "long", pa.binary(): "binary"}


def page_digests(records: DataFrame) -> DataFrame:
    """(page_id, payload_bytes, payload_digest, record_type, refers_to); a response's figures come from its payload."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [None if p is None else base32_sha1(p) for p in batch.column("payload").to_pylist()]
            yield batch.drop_columns(["payload"]).append_column("digest", pa.array(names, pa.string()))

    page = lambda c: F.regexp_extract(c, rf"^{_PREFIX}(-?\d+)$", 1).try_cast("long")
    r = records.select(
        page("record_id").alias("page_id"), "record_type", page("refers_to").alias("refers_to"),
        F.coalesce(F.octet_length("payload"), "http_length").cast("long").alias("payload_bytes"), "declared_digest", "payload",
    )
    r = r.mapInArrow(run, "page_id long, record_type string, refers_to long, payload_bytes long, declared_digest string, digest string")
    return r.select(
        "page_id", "payload_bytes", F.coalesce("digest", "declared_digest").alias("payload_digest"), "record_type", "refers_to"
    )


def archive_round_trip(pages: DataFrame, min_bytes: int = 0, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Write ``pages`` as archives in the shared folder and return what the reader finds in them.

    One row per page row, also for repeated rows and null ids or urls; null html
    is an empty payload, and payloads may be of any length.  Other columns are not read; an empty table gives
    archives without records.  Raises if the reader finds another number of records
    than were written.
    """
    folder = new_folder(pages.sparkSession, "warc")
    uri = folder if "://" in folder else folder.replace("file:/", "file:///", 1) if folder.startswith("file:") else f"file://{folder}"
    files = stored(write_warc(plan_records(pages, min_bytes), uri), "warc-files")
    found = stored(page_digests(read_warc(files, uri, split_bytes)), "warc-digests")
    written, read = files.agg(F.sum("n_records")).first()[0] or 0, found.count()
    if read != written:
        raise RuntimeError(f"{written} records were written to {folder}, but {read} read")
    return found


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(table(spark, sf_dir, "pages"))


OP3_SQL = """
with p as (select page_id, encode(coalesce(html, '')) as payload from pages),
d as (select page_id, octet_length(payload) as size, sha1(payload) as sha from p),
t as (select sha, size, max(page_id) as top from d group by all)
select page_id, size::bigint as payload_bytes,
 array_to_string(list_transform(generate_series(0, 31), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[
   1 + ((('0x' || sha[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::bigint >> (15 - 5 * (i % 4))::int) & 31)::int]), '') as payload_digest,
 case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to
from d join t using (sha, size)"""
