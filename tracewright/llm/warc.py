"""WARC: archives written from a table of pages, and a reader that salvages what damaged files still hold."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import get_file, put_file, settle, shared_dir

GZIP, VERSION = b"\x1f\x8b\x08", b"WARC/1."
IDENTICAL = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
RECORD = re.compile(rb"<urn:page:(-?\d*)>")
LINE = re.compile(rb"([^:\r\n]+):[ \t]*([^\r\n]*)\Z")
ROWS = "path string, offset long, length long, kind string, reason string, record_id string, target_uri string, payload_digest string, payload_bytes long, payload binary, refers_to string"


def base32_sha1(raw: bytes) -> str:
    return base64.b32encode(hashlib.sha1(raw).digest()).decode("ascii")


def record(page_id: int | None, url: str | None, payload: bytes, winner: int | None, digest: str, date: str) -> bytes:
    """One record, as a gzip member. ``winner``: the page that a revisit refers to."""
    uri = re.sub(r"[\r\n]", "", url or "")
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    revisit = winner is not None
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Date: {date}",
        f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{base32_sha1(block)}",
        *([f"WARC-Profile: {IDENTICAL}", f"WARC-Refers-To: <urn:page:{winner}>"] if revisit else []),
        "Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}",
    ]
    z = zlib.compressobj(1, zlib.DEFLATED, 31)
    return z.compress("\r\n".join([*head, "", ""]).encode("utf-8") + block + b"\r\n\r\n") + z.flush()


def write_warc(pages: DataFrame, min_bytes: int = 0, roll_bytes: int = 16 << 20, date: str = "2000-01-01T00:00:00Z") -> DataFrame:
    """Writes one record for each row of ``pages`` (page_id, url, html; others are not written) and
    returns a table of the files' paths (``path``); no rows give no files.

    The payload is the html in UTF-8 (null: empty). Of rows with equal payloads of ``min_bytes`` or more
    the one with the largest page_id is a response and the others revisit it; smaller payloads are all
    responses. Repeated rows that share the largest id are all responses, as are rows with a null id.
    The largest id of each digest that repeats comes from a pre-aggregated count of (digest, page_id)
    alone; pages meet it by digest, and stay where they are if Spark sees that these are few. Files are closed at ``roll_bytes``; a repeated task writes files
    of other names, and only those of tasks that ended well are returned.
    """
    spark = pages.sparkSession
    out = shared_dir(spark, "warc")
    html = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", html.alias("html"), F.sha1(html.cast("binary")).alias("digest"), (F.octet_length(html) >= min_bytes).alias("large"))
    winners = rows.filter("large and page_id is not null").groupBy("digest").agg(F.max("page_id").alias("winner"), F.count("*").alias("n")).filter("n > 1").select(F.col("digest").alias("w_digest"), "winner")
    winners = settle(winners, "winners")
    joined = rows.join(winners, (F.col("digest") == F.col("w_digest")) & F.col("large"), "left").select("page_id", "url", "html", "winner")

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size, paths = [], 0, []

        def close() -> None:
            nonlocal size
            paths.append(f"{out}/{uuid.uuid4().hex}.warc.gz")
            put_file(paths[-1], b"".join(held))
            held.clear()
            size = 0

        for batch in batches:
            for page_id, url, text, winner in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                payload = text.encode("utf-8")
                refers = winner if winner is not None and page_id is not None and page_id != winner else None
                held.append(record(page_id, url, payload, refers, base32_sha1(payload), date))
                size += len(held[-1])
                if size >= roll_bytes:
                    close()
        if held:
            close()
        yield pa.RecordBatch.from_arrays([pa.array(paths, pa.string())], ["path"])

    return settle(joined.mapInArrow(task, "path string"), "warc-files")


class Damaged(Exception):
    pass


def _parse(raw: bytes, at: int, end: int) -> tuple[int, dict[bytes, bytes], bytes]:
    """(end, headers, block) of the plain record at ``at``; checks its form and block digest."""
    if not raw.startswith(VERSION, at):
        raise Damaged("no version line")
    stop = raw.find(b"\r\n\r\n", at, end)
    if stop < 0:
        raise Damaged("headers don't end")
    lines = raw[at:stop].split(b"\r\n")[1:]
    found = [LINE.match(x) for x in lines]
    if not all(found):
        raise Damaged("malformed header")
    head = {m[1].strip().lower(): m[2].strip() for m in found}
    size = head.get(b"content-length", b"")
    if not size.isdigit():
        raise Damaged("no content length")
    begin, past = stop + 4, stop + 4 + int(size)
    if raw[past : past + 4] != b"\r\n\r\n" or past + 4 > end:
        raise Damaged("record is cut short or overlong")
    block = raw[begin:past]
    digest = head.get(b"warc-block-digest", b"")
    if digest.startswith(b"sha1:") and digest[5:].decode("ascii", "replace") != base32_sha1(block):
        raise Damaged("block digest differs")
    return past + 4, head, block


def _inflate(raw: bytes, at: int) -> tuple[int, bytes, str]:
    """(end, content, damage) of the gzip member at ``at``; its length and CRC are checked by zlib. A damaged
    member gives what could be inflated before the damage, and no end."""
    z, out, k = zlib.decompressobj(31), [], at
    view = memoryview(raw)
    try:
        while not z.eof and k < len(raw):
            step = view[k : k + 65536]
            out.append(z.decompress(step))
            k += len(step)
    except zlib.error as e:
        return -1, b"".join([*out, _rest(raw, at, k, sum(map(len, out)))]), f"gzip: {e}"
    if not z.eof:
        return -1, b"".join(out), "gzip member is cut short"
    return k - len(z.unused_data), b"".join(out), ""


def _rest(raw: bytes, at: int, upto: int, known: int) -> bytes:
    """What a member that fails between ``upto`` and 65536 bytes later still gives beyond ``known`` bytes:
    inflated again up to there, then byte by byte."""
    z = zlib.decompressobj(31)
    size, out = len(z.decompress(raw[at:upto])) if upto > at else 0, []
    try:
        for k in range(upto, min(upto + 65536, len(raw))):
            out.append(z.decompress(raw[k : k + 1]))
    except zlib.error:
        pass
    return b"".join(out)[known - size :]


def _inside(content: bytes, sure: bool) -> tuple[list[tuple[dict[bytes, bytes], bytes]], str]:
    """(records, reason of the first gap) of a member's content. After a failed check the search goes on at
    the next version line. Content that isn't ``sure`` gives only records whose block digest can be checked and
    that another record follows: the damage may lie in the last one."""
    records, reason, at = [], "", 0
    while at < len(content):
        try:
            past, head, block = _parse(content, at, len(content))
            if not sure and not (head.get(b"warc-block-digest", b"").startswith(b"sha1:") and content.startswith(VERSION, past)):
                raise Damaged("not to be trusted in a damaged member")
            records.append((head, block))
            at = past
        except Damaged as e:
            reason = reason or str(e)
            at = content.find(VERSION, at + 1)
            if at < 0:
                break
    return records, reason


def _at(raw: bytes, at: int) -> tuple[int, list[tuple[dict[bytes, bytes], bytes]], str]:
    """(end, records, reason) of the member or plain record at ``at``; with a reason, something of it is
    lost, and with an end of -1 it isn't known where it ends."""
    if raw.startswith(GZIP, at):
        end, content, damage = _inflate(raw, at)
        records, reason = _inside(content, not damage)
        if (damage or reason) and not records:
            raise Damaged(damage or reason)
        return end, records, damage or reason
    end, head, block = _parse(raw, at, len(raw))
    return end, [(head, block)], ""


def salvage(raw: bytes) -> Iterator[tuple[int, int, str, list]]:
    """(offset, length, reason, records) of a file's parts in order. A part with a reason is quarantined as
    a gap; its records are those that pass all checks in a damaged member. After a failed check
    the search goes on from the next byte to the next member or version line that holds good records."""
    at = 0
    while at < len(raw):
        records: list = []
        try:
            end, records, reason = _at(raw, at)
            if end >= 0:
                yield at, end - at, reason, records
                at = end
                continue
        except Damaged as e:
            reason = str(e)
        look, begin = at + 1, at
        while True:
            found = [p for p in (raw.find(GZIP, look), raw.find(VERSION, look)) if p >= 0]
            if not found:
                at = len(raw)
                break
            try:
                _at(raw, min(found))
                at = min(found)
                break
            except Damaged:
                look = min(found) + 1
        yield begin, at - begin, reason, records


def _row(path: str, offset: int, length: int, head: dict[bytes, bytes], block: bytes) -> dict:
    kind = head.get(b"warc-type", b"").decode("utf-8", "replace")
    split = block.find(b"\r\n\r\n")
    http, payload = (block[:split], block[split + 4 :]) if head.get(b"content-type", b"").startswith(b"application/http") and split >= 0 else (b"", block)
    said = re.search(rb"(?im)^content-length:[ \t]*(\d+)", http)
    digest = head.get(b"warc-payload-digest", b"").decode("ascii", "replace").removeprefix("sha1:")
    whole = kind != "revisit"
    wrong = whole and digest and digest != base32_sha1(payload)
    text = lambda name: head[name].decode("utf-8", "replace") if name in head else None
    return {
        "path": path, "offset": offset, "length": length, "kind": "gap" if wrong else kind, "reason": "payload digest differs" if wrong else None, "record_id": text(b"warc-record-id"),
        "target_uri": text(b"warc-target-uri"), "payload_digest": digest or None, "payload_bytes": len(payload) if whole else int(said[1]) if said else None,
        "payload": payload if whole and not wrong else None, "refers_to": text(b"warc-refers-to"),
    }


def read_warc(files: DataFrame) -> DataFrame:
    """Records of WARC files, gzip members or plain, with the path, offset and length of the part that
    holds each; ``kind`` is the record's type, or ``gap`` with a ``reason`` for quarantined bytes. Records of a
    damaged part say so in ``reason``: their blocks passed their digests, their headers have no such check.
    ``files`` has ``path`` alone (files of the shared folder, which tasks open) or with ``content``, as
    Spark's binaryFile source gives them. Empty and null files have no rows, no files give none; a file
    listed twice is read twice. A file's records don't depend on other files."""
    held = "content" in files.columns

    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(n, {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[t]) for n, t in (x.split() for x in ROWS.split(", "))])
        for batch in batches:
            for path, *content in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                raw = content[0] if held else get_file(path)
                rows = []
                for offset, length, reason, records in salvage(raw or b""):
                    if reason:
                        rows.append({"path": path, "offset": offset, "length": length, "kind": "gap", "reason": reason})
                    found = [_row(path, offset, length, head, block) for head, block in records]
                    rows += [r | {"reason": r["reason"] or f"beside damage: {reason}"} for r in found] if reason else found
                    if len(rows) >= 500:
                        yield pa.RecordBatch.from_pylist(rows, schema)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return files.select("path", "content").mapInArrow(task, ROWS) if held else files.select("path").filter("path is not null").mapInArrow(task, ROWS)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` and reads the archives back: the rows of :func:`read_warc` with ``page_id`` and
    ``refers_to`` as numbers. No pages, no rows. Paths stay a table; a task reads about four files."""
    paths = write_warc(pages, min_bytes)
    tasks = max(pages.sparkSession.sparkContext.defaultParallelism, -(-paths.count() // 4))
    number = lambda c: F.nullif(F.regexp_extract(c, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")
    rows = read_warc(paths.repartition(tasks))
    return rows.withColumn("page_id", number(F.col("record_id"))).withColumn("refers_to", number(F.col("refers_to")))
