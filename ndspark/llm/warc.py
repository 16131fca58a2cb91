"""WARC archives: written with revisit records, read by boundary-chain verification.

A task that scans a byte range can't tell a record's first line from the same bytes inside a
payload. So each task only proposes candidates: every place where a record header parses,
with the offset of its successor. Within its own range it follows these to where each chain
leaves the range. Pointer jumping over those exits, from the start of each file, then tells
the one true entry of every range in a logarithmic number of rounds, and only records on the
chain from an entry are read; a header inside a payload is never reached. Files of any size
go this way. Only exits from places that some chain leads to are kept for the jumping, which
is a few rows for each range.
"""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import binary_texts, new_folder, small_batches, stage, unstage
from .tokenfiles import open_fs, publish

# Fixed values of the archive format.
VERSION = b"WARC/1.1\r\n"
CANDIDATE = re.compile(rb"WARC/1\.[01]\r\n")
REVISIT_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END_OF_RECORD = b"\r\n\r\n"
HTTP_HEAD = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: %d\r\n\r\n"

MIN_REVISIT_BYTES = 1000
FILE_BYTES = 1 << 30  # an archive is closed once it has so many
SPLIT_BYTES = 256 << 10  # of a range, of which a chain tells the entry
TASK_BYTES = 4 << 20  # of neighbouring ranges for a task at least
MOST_TASKS = 10_000  # ranges of a larger total are dealt to so many tasks
READ_BYTES = 256 << 10
BROADCAST_ROWS = 1 << 20  # repeated payloads, of about 100 bytes each, that are sent to all tasks
FILTER_BITS = 1 << 26  # of the bit map that is sent instead of more
DATE = "2024-01-01T00:00:00Z"  # the input has no capture time


def _header(kind: str, page_id: int | None, url: str | None, digest: str, n: int, refers: int | None) -> bytes:
    fields = [("WARC-Type", kind)]
    name = f"urn:page:{page_id}" if page_id is not None else f"urn:uuid:{uuid.uuid4()}"
    fields += [("WARC-Record-ID", f"<{name}>"), ("WARC-Date", DATE)]
    if url is not None:  # control characters and spaces can't stand in a header
        fields.append(("WARC-Target-URI", quote(url, safe="!#$%&'()*+,/:;=?@[]~-._")))
    fields.append(("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(digest)).decode()))
    fields.append(("X-Payload-Length", str(n)))
    if kind == "revisit":
        fields += [("WARC-Refers-To", f"<urn:page:{refers}>"), ("WARC-Profile", REVISIT_PROFILE)]
    block = len(HTTP_HEAD % n) + (n if kind == "response" else 0)
    fields += [("Content-Type", "application/http; msgtype=response"), ("Content-Length", str(block))]
    return VERSION + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _write(uri: str, file_bytes: int):
    def run(batches):
        fs, base = open_fs(uri)
        task, rows, out, seq, at = TaskContext.get().partitionId(), [], None, 0, 0
        name = temporary = ""

        def close():
            out.close()
            publish(fs, temporary, f"{base}/{name}")
            rows.append((name, at))

        for batch in small_batches(batches, "html"):
            cols = [batch.column(c).to_pylist() for c in ("page_id", "url", "digest", "refers_to")]
            for page, url, digest, refers, body in zip(*cols, binary_texts(batch, "html"), strict=True):
                body = body or b""
                if out is not None and at >= file_bytes:
                    close()
                    out, seq = None, seq + 1
                if out is None:
                    name = f"pages-{task:06d}-{seq:04d}.warc"
                    temporary, at = f"{base}/_{name}-{uuid.uuid4().hex}", 0
                    out = fs.open_output_stream(temporary)
                kind = "response" if refers is None else "revisit"
                head = _header(kind, page, url, digest, len(body), refers) + HTTP_HEAD % len(body)
                parts = (head, body, END_OF_RECORD) if refers is None else (head, END_OF_RECORD)
                for part in parts:
                    out.write(part)
                    at += len(part)
        if out is not None:
            close()
        cols = list(zip(*rows, strict=True)) or [(), ()]
        yield pa.RecordBatch.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int64())], names=["name", "size"]
        )

    return run


def _marked(rows: DataFrame, kept: DataFrame) -> DataFrame:
    """Rows with `kept` of their digest. Few repeated digests are broadcast. Of many, a bit map of
    FILTER_BITS is: rows whose bit is not set stay where they are, and only the others are dealt
    out by digest with their bodies."""
    if kept.count() <= BROADCAST_ROWS:
        return rows.join(F.broadcast(kept), ["digest", "n"], "left")
    bit = f"pmod(xxhash64(digest), {FILTER_BITS})"
    word, mask = F.expr(f"{bit} div 64").alias("word"), F.expr(f"shiftleft(1L, cast({bit} % 64 as int))").alias("mask")
    # at most FILTER_BITS / 64 rows
    bits = kept.select(word, mask).groupBy("word").agg(F.bit_or("mask").alias("bits"))
    tried = rows.select("*", word, mask).join(F.broadcast(bits), "word", "left")
    may = F.coalesce(F.col("bits").bitwiseAND(F.col("mask")) != 0, F.lit(False))
    alone = tried.where(~may).select(*rows.columns, F.lit(None).cast(dict(kept.dtypes)["kept"]).alias("kept"))
    return tried.where(may).select(rows.columns).join(kept, ["digest", "n"], "left").select(alone.columns).unionAll(alone)


def write_warc(
    pages: DataFrame,
    uri: str,
    key: str = "page_id",
    url: str = "url",
    html: str = "html",
    min_revisit: int = MIN_REVISIT_BYTES,
    file_bytes: int = FILE_BYTES,
) -> list[tuple[str, int]]:
    """Write a record for each row of pages to archives below `uri`; returns (file, bytes) of
    each. Of rows with equal payloads of at least min_revisit bytes, those with the largest
    key are responses and all others revisit it; a null key always is a response. Only
    payload digests that occur more than once take part in the join."""
    fs, base = open_fs(uri)
    fs.create_dir(base, recursive=True)
    body = F.coalesce(F.col(html), F.lit(""))
    rows = pages.select(
        F.col(key).alias("page_id"), F.col(url).alias("url"), body.alias("html"),
        F.sha1(body.cast("binary")).alias("digest"), F.octet_length(body).alias("n"),
    )
    kept = (
        rows.where(F.col("page_id").isNotNull() & (F.col("n") >= min_revisit))
        .groupBy("digest", "n")
        .agg(F.max("page_id").alias("kept"), F.min("page_id").alias("first"))
        .where("kept > first")
        .select("digest", "n", "kept")
    )
    kept = stage(kept, "warc-kept")
    marked = _marked(rows, kept).select(
        "page_id", "url", "html", "digest", F.expr("if(page_id < kept, kept, null)").alias("refers_to")
    )
    files = marked.mapInArrow(_write(uri, file_bytes), "name string, size long").collect()
    return sorted((r["name"], r["size"]) for r in files)


def parse_header(read, at: int) -> tuple[dict[str, str], int] | None:
    """The fields of a record header at an offset and where its block starts; None if no
    header parses there. `read(at, n)` gives bytes."""
    size, raw = 4096, b""
    while True:
        raw = read(at, size)
        if not CANDIDATE.match(raw):
            return None
        end = raw.find(b"\r\n\r\n")
        if end >= 0:
            break
        # lines of a header have a colon or continue the one before; else this isn't one
        lines = raw.split(b"\r\n")[1:-1]
        if len(raw) < size or any(b":" not in x and x[:1] not in (b" ", b"\t") for x in lines):
            return None
        size *= 4
    fields: dict[str, str] = {}
    for line in raw[:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            return None
        fields[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = fields.get("content-length", "")
    if not (length.isascii() and length.isdigit()):
        return None
    return fields, at + end + 4


class _Window:
    """Reads from a file through one buffer."""

    def __init__(self, fs: pafs.FileSystem, path: str):
        self.file, self.at, self.raw = fs.open_input_file(path), 0, b""
        self.size = self.file.size()

    def read(self, at: int, n: int) -> bytes:
        lo = at - self.at
        if lo < 0 or lo + n > len(self.raw):
            want = max(n, READ_BYTES)
            self.raw, self.at, lo = self.file.read_at(min(want, max(0, self.size - at)), at), at, 0
        return self.raw[lo : lo + n]

    def close(self) -> None:
        self.file.close()


def _candidates(window: _Window, lo: int, hi: int) -> Iterator[tuple[int, int]]:
    """(offset, successor) of every header that parses at an offset in [lo, hi)."""
    at = lo
    while at < hi:
        raw = window.read(at, min(READ_BYTES, window.size - at))
        found = [at + m.start() for m in CANDIDATE.finditer(raw) if at + m.start() < hi]
        for start in found:
            if parsed := parse_header(window.read, start):
                fields, block = parsed
                yield start, block + int(fields["content-length"]) + len(END_OF_RECORD)
        if len(raw) < READ_BYTES:
            return
        at = max(at + len(raw) - len(VERSION) + 1, found[-1] + 1 if found else 0)


def _windows(uri: str, batches, columns: int) -> Iterator[tuple]:
    """The rows of batches of (name, ...), each with a window on its file. Rows of a file that
    come one after the other share the window and what it has read."""
    (fs, base), window, opened = open_fs(uri), None, None
    for batch in batches:
        for row in zip(*(c.to_pylist() for c in batch.columns[:columns]), strict=True):
            if row[0] != opened:
                if window:
                    window.close()
                window, opened = _Window(fs, f"{base}/{row[0]}"), row[0]
            yield (window, *row)
    if window:
        window.close()


def _exits(uri: str):
    def run(batches):
        for window, name, lo, hi in _windows(uri, batches, 3):
            found = list(_candidates(window, lo, hi))
            leaves: dict[int, int] = {}
            for start, after in reversed(found):
                # a successor inside the range that is no candidate ends the chain
                leaves[start] = after if after >= hi else leaves.get(after, -1)
            yield pa.RecordBatch.from_arrays(
                [pa.array([name] * len(leaves), pa.string()), pa.array(list(leaves), pa.int64()),
                 pa.array(list(leaves.values()), pa.int64())], names=["name", "at", "leaves"],
            )

    return run


def _records(uri: str, split: int, strict: bool):
    def run(batches):
        for window, name, at in _windows(uri, batches, 2):
            hi, rows = min((at // split + 1) * split, window.size), []
            while at < hi and (parsed := parse_header(window.read, at)):
                fields, block = parsed
                end = block + int(fields["content-length"])
                if end + (len(END_OF_RECORD) if strict else 0) > window.size:
                    break
                rows.append(_row(window, fields, block, end))
                at = end + len(END_OF_RECORD)
            if strict and at < hi:
                raise ValueError(f"{name}: the chain of records breaks at byte {at} of {window.size}")
            cols = list(zip(*rows, strict=True)) or [()] * 6
            kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, kinds, strict=True)],
                names=["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to"],
            )

    return run


def _page(value: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", value or "")
    return int(m[1]) if m else None


def _row(window: _Window, fields: dict[str, str], block: int, end: int) -> tuple:
    """A record's page, with the digest of the payload as stored; a revisit, which stores
    none, gives what its header says."""
    kind, page = fields.get("warc-type"), _page(fields.get("warc-record-id"))
    url = fields.get("warc-target-uri")
    if kind == "revisit":
        said = fields["warc-payload-digest"].partition(":")[2]
        digest = base64.b32decode(said).hex()
        return page, url, int(fields["x-payload-length"]), digest, kind, _page(fields["warc-refers-to"])
    head = window.read(block, min(4096, end - block)).find(b"\r\n\r\n")
    body, sha = block + head + 4 if head >= 0 else block, hashlib.sha1()
    for at in range(body, end, READ_BYTES):
        sha.update(window.read(at, min(READ_BYTES, end - at)))
    return page, url, end - body, sha.hexdigest(), kind, None


def _dealt(rows: DataFrame, files: list[tuple[str, int]], at: str) -> DataFrame:
    """Rows of (name, offset, ...) with neighbouring offsets of a file in one task, in order."""
    total = sum(size for _, size in files)
    task = max(TASK_BYTES, total // MOST_TASKS)
    place = F.floor(F.col(at) / task)
    return rows.repartition(max(1, total // task + len(files)), "name", place).sortWithinPartitions("name", at)


def entries(spark: SparkSession, uri: str, files: list[tuple[str, int]], split: int = SPLIT_BYTES) -> DataFrame:
    """(name, at): the first true record of every range of `split` bytes that has one. A chain
    that breaks leaves the ranges after it without an entry."""
    sizes = spark.createDataFrame([x for x in files if x[1]], "name string, size long")
    ranges = sizes.select(
        "name", "size", F.explode(F.expr(f"sequence(0L, size - 1, {split}L)")).alias("lo")
    ).select("name", "lo", F.least(F.col("lo") + split, "size").alias("hi"))
    exits = stage(_dealt(ranges, files, "lo").mapInArrow(_exits(uri), "name string, at long, leaves long"), "warc-exits")
    starts = sizes.select("name", F.lit(0).cast("long").alias("at"))
    # an entry is the file's start or where a chain leads to from another range
    led = exits.where("leaves >= 0").select("name", F.col("leaves").alias("at")).unionAll(starts).distinct()
    jumps = stage(exits.join(led, ["name", "at"], "left_semi"), "warc-jumps")
    unstage(exits)
    reached, longest = starts, max((-(-size // split) for _, size in files), default=0)
    for i in range((max(1, longest) - 1).bit_length()):
        ahead = reached.join(jumps, ["name", "at"]).select("name", F.col("leaves").alias("at"))
        step = stage(reached.unionAll(ahead.where("at >= 0")).distinct(), "warc-entries")
        if 2 << i < longest:
            then = jumps.select("name", F.col("at").alias("leaves"), F.col("leaves").alias("next"))
            further = jumps.join(then, ["name", "leaves"]).select("name", "at", F.col("next").alias("leaves"))
            further = stage(further, "warc-jumps")
            unstage(jumps)
            jumps = further
        unstage(reached)
        reached = step
    unstage(jumps)
    return reached.join(sizes, "name").where("at < size").select("name", "at")


def read_warc(
    spark: SparkSession, uri: str, files: list[tuple[str, int]], split: int = SPLIT_BYTES, strict: bool = False
) -> DataFrame:
    """(page_id, url, payload_bytes, payload_digest, record_type, refers_to) of every record
    that is reachable from the start of its file. Where a record is cut short or a header
    does not parse, its file's chain ends; with `strict` that is an error."""
    schema = (
        "page_id long, url string, payload_bytes long, payload_digest string, record_type string, "
        "refers_to long"
    )
    if not any(size for _, size in files):
        return spark.createDataFrame([], schema)
    return _dealt(entries(spark, uri, files, split), files, "at").mapInArrow(_records(uri, split, strict), schema)


def warc_round_trip(
    pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html"
) -> DataFrame:
    """Write pages to archives in the shared folder and read them back, a row for each row.

    payload_bytes and payload_digest (hex SHA-1) are of the full payload, the html in UTF-8;
    null html is an empty payload. refers_to is null for responses. Rows that repeat the
    largest page_id of equal payloads are responses, each; a null page_id is a response and
    stays null. Other columns are not read, and an empty table gives an empty result. An archive
    whose records do not reach from its start to its end is an error.
    """
    uri = new_folder(pages.sparkSession, "warc")
    files = write_warc(pages, uri, key, url, html)
    return read_warc(pages.sparkSession, uri, files, strict=True)
