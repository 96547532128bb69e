"""WARC archives: a distributed writer and a salvage reader.

The writer makes one record per page: a response with its payload, or a revisit (identical payload digest) that
refers to the response that has it. Archives are plain WARC/1.1, written by Spark's text sink as raw bytes, so
any file system that Spark writes to will do.

The salvage reader takes a whole archive (gzip members or plain, mixed, damaged) and goes on after any failed check:
version line, header, length, trailer, block digest, payload digest (hexadecimal or base32), gzip stream. It searches for
the next version line or gzip member after the bad record's start. A member is inflated as far as its stream goes, in
bounded steps, and its content is searched in the same way, so that good records before, between and after bad ones
are recovered, also from a member that is cut off. Bytes that gave no record are logged as gaps, in the file or in a
member's content. Nothing limits the size of a header. Time is linear in the archive: the places of the next version line, member
and end of header are remembered, and a header's lines are read once however many version lines they follow.

Archives are read whole by the binary file source, one row per file (so up to 2 GB); the writer keeps a file
to a few hundred records so that such a row stays small.

Edge cases: null html is an empty payload; a null or empty url becomes 'urn:page:<id>', characters outside printable ASCII
are percent-encoded; a null page_id is written without a page header and read back as null; rows that repeat a
page_id are written each; an empty table gives no archive and an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64
import binascii
import bisect
import gzip
import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import cut, new_path
from tessera.sources.ship import ship_package

CRLF, END = b"\r\n", b"\r\n\r\n"
_VERSION = re.compile(rb"WARC/\d\.\d\r?\n")
_MEMBER = b"\x1f\x8b\x08"
_NAME = re.compile(rb"[!#$%&'*+.^_`|~0-9A-Za-z-]+")
_CONTROL = re.compile(rb"[\x00-\x08\x0b-\x1f\x7f]")
#: Digest algorithms that are checked, with their sizes in bytes.
_SIZES = {"md5": 16, "sha1": 20, "sha256": 32}
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


@dataclass
class Record:
    offset: int  # in the file: of the record, or of the member that holds it
    headers: dict[str, str]
    block: bytes
    inner: int | None = None  # in the member's content


@dataclass
class Salvage:
    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)  # start, end, reason: bytes of the file
    inner_gaps: list[tuple[int, int, int, str]] = field(default_factory=list)  # member's place, start, end, reason: bytes of its content


class Damaged(ValueError):
    """A record or member that fails a check."""


def _digest_fails(stated: str, content: bytes) -> bool:
    """Whether content has another digest than stated (hexadecimal or base32); other algorithms can't be checked."""
    name, _, text = stated.partition(":")
    size = _SIZES.get(name.strip().lower())
    if size is None:
        return False
    text = text.strip()
    try:
        want = bytes.fromhex(text) if len(text) == 2 * size else base64.b32decode(text.rstrip("=").upper() + "=" * (-len(text.rstrip("=")) % 8))
    except (ValueError, binascii.Error):
        return True
    return want != hashlib.new(name.strip().lower(), content).digest()


def _payload(headers: dict[str, str], block: bytes) -> bytes | None:
    """What a payload digest is of; None where that can't be told."""
    if headers["warc-type"] not in ("response", "resource", "conversion") or "warc-truncated" in headers or "warc-segment-number" in headers:
        return None
    if not headers.get("content-type", "").lower().startswith("application/http"):
        return block
    head, found, body = block.partition(END)
    return None if not found or b"transfer-encoding" in head.lower() else body


class _Plain:
    """Records in plain bytes. What was searched or read ahead is kept, so that many faults cost no more than one pass."""

    def __init__(self, data: bytes):
        self.data = data
        self.version = self.stop = -2  # places of the next version line and end of header, -1 for none
        self.lines: list[int] = []  # line starts of the header read last

    def next_version(self, at: int) -> int:
        if self.version != -1 and self.version < at:
            found = _VERSION.search(self.data, at)
            self.version = found.start() if found else -1
        return self.version

    def _header(self, start: int) -> tuple[int, int]:
        """The end of the header whose lines begin at `start`, and which of the lines read it begins with."""
        if self.stop != -1 and self.stop < start - 2:
            self.stop, self.lines = self.data.find(END, start - 2), []
        if self.stop < 0:
            raise Damaged("header without end")
        if not self.lines or start < self.lines[0]:
            at, self.lines, self.fields = start, [], []
            while at < self.stop + 2:
                end = self.data.find(b"\n", at, self.stop + 2)
                line = self.data[at : end if end >= 0 else self.stop].rstrip(b"\r")
                name, colon, value = line.partition(b":")
                folded = line[:1] in (b" ", b"\t")
                good = folded or bool(colon) and _NAME.fullmatch(name.strip()) is not None and not _CONTROL.search(value)
                self.lines.append(at)
                self.fields.append((good, None if folded else name.strip().decode("utf-8", "replace").lower(), (line if folded else value).strip().decode("utf-8", "replace")))
                at = end + 1 if end >= 0 else self.stop + 2
            bad = [k for k, f in enumerate(self.fields) if not f[0]]
            self.last_bad = bad[-1] if bad else -1
            self.last = {f[1]: k for k, f in enumerate(self.fields) if f[1]}
        return self.stop, bisect.bisect_left(self.lines, start)

    def record(self, at: int) -> tuple[Record, int]:
        """The record at `at` and where the next one begins; raises Damaged."""
        first = _VERSION.match(self.data, at)
        if not first:
            raise Damaged("no version line")
        stop, k = self._header(first.end())
        if self.last_bad >= k:
            raise Damaged("bad header line")
        known = lambda name: self.last.get(name, -1) >= k
        length = self.fields[self.last["content-length"]][2] if known("content-length") else ""
        if not (length.isascii() and length.isdigit()) or not known("warc-type"):
            raise Damaged("no length or type")
        start = stop + 4
        end = start + int(length) if len(length) < 19 else len(self.data)
        if self.data[end : end + 4] != END:
            raise Damaged("wrong length or trailer")
        headers: dict[str, str] = {}
        name = None
        for _, own, value in self.fields[k:]:
            if own is None:
                if name:
                    headers[name] += " " + value
            else:
                name, headers[own] = own, value
        block = self.data[start:end]
        if _digest_fails(headers.get("warc-block-digest", ""), block):
            raise Damaged("wrong block digest")
        if "warc-payload-digest" in headers and (payload := _payload(headers, block)) is not None and _digest_fails(headers["warc-payload-digest"], payload):
            raise Damaged("wrong payload digest")
        return Record(at, headers, block), end + 4


def _inflate(data: memoryview, at: int) -> tuple[bytes, int, list[tuple[int, int]], str]:
    """A member's content as far as its stream goes, where it ends or fails, (bytes read, bytes made) on the way, the fault or ''."""
    work, out, made, place, step = zlib.decompressobj(31), [], 0, at, 512
    marks = [(at, 0)]
    while place < len(data) and not work.eof:
        held = work.copy()
        chunk = data[place : place + step]
        try:
            got = work.decompress(chunk)
        except zlib.error:
            work = held  # byte by byte to the fault
            for k in range(len(chunk)):
                try:
                    got = work.decompress(chunk[k : k + 1])
                except zlib.error:
                    return b"".join(out), place + k, marks, "bad gzip member"
                out.append(got)
            return b"".join(out), place + len(chunk), marks, "bad gzip member"
        out.append(got)
        made += len(got)
        place += len(chunk) - len(work.unused_data)
        marks.append((place, made))
        step = min(2 * step, 1 << 16)
    if not work.eof:
        return b"".join([*out, work.flush()]), place, marks, "cut gzip member"
    return b"".join(out), place, marks, ""


def _search(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """The records of a member's content, and the gaps between them."""
    plain, at, records, gaps = _Plain(data), 0, [], []
    bad, why = -1, ""
    while at < len(data):
        try:
            record, after = plain.record(at)
        except Damaged as e:
            if bad < 0:
                bad, why = at, str(e)
            at = plain.next_version(at + 1)
            if at < 0:
                break
            continue
        if bad >= 0:
            gaps.append((bad, at, why))
            bad = -1
        records.append(record)
        at = after
    if bad >= 0:
        gaps.append((bad, len(data), why))
    return records, gaps


def salvage(data: bytes) -> Salvage:
    """Every record that passes its checks, in order, and the bytes that were left out."""
    found, view, plain = Salvage(), memoryview(data), _Plain(data)
    at, n, bad, why, member_at = 0, len(data), -1, "", -2
    while at < n:
        records: list[Record] = []
        after, lost = at, None  # where to go on; from where on bytes are lost
        if data.startswith(_MEMBER, at):
            content, end, marks, fault = _inflate(view, at)
            records, inner = _search(content)
            upto = records[-1].inner if records else 0
            for r in records:
                r.inner, r.offset = r.offset, at
            if records:
                upto = inner[-1][0] if inner and inner[-1][1] == len(content) else len(content)
                found.inner_gaps += [(at, a, b, w) for a, b, w in inner]
            if fault or content and not records:
                why_now = fault or inner[-1][2]
                lost = max((read for read, made in marks if made <= upto and read < end), default=at) if records else at
                after = -1
            else:
                after = end
        else:
            try:
                record, after = plain.record(at)
                records = [record]
            except Damaged as e:
                why_now, lost, after = str(e), at, -1
        if bad >= 0 and records:
            found.gaps.append((bad, at, why))
            bad = -1
        found.records += records
        if after >= 0:
            if bad >= 0 and not records:
                found.gaps.append((bad, at, why))
                bad = -1
            at = after
            continue
        if bad < 0:
            bad, why = lost, why_now
        if member_at != -1 and member_at <= at:
            member_at = data.find(_MEMBER, at + 1)
        at = min((x for x in (plain.next_version(at + 1), member_at) if x >= 0), default=n)
        bad = min(bad, at)
    if bad >= 0 and bad < n:
        found.gaps.append((bad, n, why))
    return found


def member(record: bytes) -> bytes:
    """One record as a gzip member of its own."""
    return gzip.compress(record, mtime=0)


def records_of(pages: DataFrame, least: int = 1000) -> DataFrame:
    """page_id, payload_digest, record_type, refers_to, record (raw bytes, without the trailer)."""
    digest = F.sha1(F.col("payload"))
    base = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", F.coalesce(F.encode("html", "UTF-8"), F.lit(b"")).alias("payload"))
    base = base.select("*", F.octet_length("payload").cast("long").alias("bytes"), digest.alias("digest"))
    big = base.where(F.col("bytes") >= least)
    same = F.unhex(F.sha2("payload", 256))
    heads = big.groupBy(same.alias("same")).agg(F.max("page_id").alias("head"), F.count(F.lit(1)).alias("uses")).where("uses > 1").select("same", "head")
    # a table of its own: while it is below the broadcast threshold, payloads are written without a shuffle
    heads = cut(heads, "warc-heads")
    # small payloads get keys of eight bytes, which equal no digest and don't meet in one place
    keyed = base.withColumn("full", F.when(F.col("bytes") >= least, same).otherwise(F.unhex(F.lpad(F.hex(F.xxhash64("page_id", "digest")), 16, "0"))))
    rows = keyed.join(heads, F.col("full") == F.col("same"), "left")
    revisit = F.col("head").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("head"))
    target = F.coalesce(F.nullif(F.regexp_replace(F.col("url"), "[^\\x21-\\x7E]", "%20"), F.lit("")), F.concat(F.lit("urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("none"))))
    urn = lambda c: F.concat(F.lit("<urn:page:"), c.cast("string"), F.lit(">"))
    block = F.when(revisit, F.lit(b"")).otherwise(F.col("payload"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit("\r\n"))
    header = F.concat(
        F.lit("WARC/1.1\r\n"),
        line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        line("WARC-Record-ID", F.coalesce(urn(F.col("page_id")), F.concat(F.lit("<urn:sha1:"), F.col("digest"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", target),
        F.when(F.col("page_id").isNotNull(), line("X-Page-ID", F.col("page_id").cast("string"))).otherwise(F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        line("WARC-Block-Digest", F.concat(F.lit("sha1:"), F.sha1(block))),
        line("X-Payload-Length", F.col("bytes").cast("string")),
        F.when(revisit, F.concat(line("WARC-Refers-To", urn(F.col("head"))), line("WARC-Profile", F.lit(PROFILE)))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html")),
        line("Content-Length", F.octet_length(block).cast("string")),
        F.lit("\r\n"),
    )
    return rows.select("page_id", F.col("digest").alias("payload_digest"), F.when(revisit, "revisit").otherwise("response").alias("record_type"), F.when(revisit, F.col("head")).alias("refers_to"), F.concat(header.cast("binary"), block).alias("record"))


def write_archives(pages: DataFrame, path: str, least: int = 1000, per_file: int = 256) -> None:
    """Plain WARC files under path; a file holds at most `per_file` records."""
    rows = records_of(pages, least).select(F.col("record").cast("string").alias("value"))
    rows.write.option("lineSep", "\r\n\r\n").option("maxRecordsPerFile", per_file).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """file, offset, kind ('record', 'gap' or 'gap in member'), end, reason, page_id, record_type, uri, payload_bytes, payload_digest, refers_to, payload."""
    ship_package(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = "file string, kind string, offset long, end long, reason string, page_id long, record_type string, uri string, payload_bytes long, payload_digest string, refers_to long, payload binary"
    names = [c.split()[0] for c in schema.split(", ")]

    def parse(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            for file, content in zip(f["path"], f["content"], strict=True):
                got = salvage(content)
                rows = [(file, "gap", a, b, why, None, None, None, None, None, None, None) for a, b, why in got.gaps]
                rows += [(file, "gap in member", at, None, f"{why}: bytes {a} to {b} of its content", None, None, None, None, None, None, None) for at, a, b, why in got.inner_gaps]
                for r in got.records:
                    h = r.headers
                    kind = h["warc-type"]
                    own = kind != "revisit"
                    digest = h.get("warc-payload-digest", "").removeprefix("sha1:")
                    size = len(r.block) if own else int(h.get("x-payload-length", 0))
                    refers = re.fullmatch(r"<urn:page:(-?\d+)>", h.get("warc-refers-to", ""))
                    page = h.get("x-page-id")
                    rows.append((file, "record", r.offset, None, None, int(page) if page else None, kind, h.get("warc-target-uri"), size, hashlib.sha1(r.block).hexdigest() if own else digest, int(refers[1]) if refers else None, r.block if own else None))
                out = pd.DataFrame(rows, columns=names)
                yield out.astype({c: "Int64" for c in ("offset", "end", "page_id", "payload_bytes", "refers_to")})

    return files.mapInPandas(parse, schema)


def round_trip(pages: DataFrame, least: int = 1000) -> DataFrame:
    """Write pages as archives in the shared folder, read them back: one row per record."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path, least)
    return read_archives(spark, path).where("kind = 'record'").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
