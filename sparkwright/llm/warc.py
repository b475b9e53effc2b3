"""WARC archives: writing with revisit records, and reading with boundary-chain verification.

Writing uses Spark's text writer with the record terminator as line separator, so archives get its commit protocol: a
repeated or lost task leaves no half file. Of records with equal payloads, that with the smallest id is a response and
the others are revisits without a payload.

Reading must not trust the magic inside payloads. Tasks scan fixed blocks of a file for the magic and emit candidate
records with their successor offsets. Inside a block, chains are followed at once, so each candidate knows the first
offset at which its chain leaves the block; only candidates that some chain (or the file's start) enters matter after
that. Pointer jumping over those from offset 0 doubles the steps per round and retains only reachable entries. A second
pass reads each block's records from its verified entry. No task holds more than a block and a record.
"""

from __future__ import annotations

import hashlib
import math
import re
from urllib.parse import urlsplit

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkwright.llm.workspace import Workspace, ship

MAGIC = b"WARC/1.1\r\n"
END = "\r\n\r\n"
#: Bytes scanned by a task; payload bytes from which equal ones are stored once; records of a file at most.
BLOCK, REVISIT_FROM, FILE_RECORDS = 8 << 20, 100, 20_000
#: Bytes of a header that are read at first; longer ones are read on, four times as far each time.
HEADER = 64 << 10
DATE = "2024-01-01T00:00:00Z"


def _record(url: Column, page: Column, kind: Column, refers: Column, digest: Column, payload: Column, size: Column) -> Column:
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), size.cast("string"), F.lit("\r\n\r\n"))
    revisit = kind == "revisit"
    name = F.coalesce(page.cast("string"), F.lit("none"))
    length = F.length(http) + F.when(revisit, 0).otherwise(size)
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "),
        kind,
        F.lit(f"\r\nWARC-Date: {DATE}\r\nWARC-Record-ID: <urn:page:"),
        name,
        F.lit(">\r\nWARC-Target-URI: "),
        F.regexp_replace(F.coalesce(url, F.lit("urn:none")), r"[\x00-\x20\x7F]", "%20"),
        F.lit("\r\nWARC-Payload-Digest: sha256:"),
        digest,
        F.lit("\r\nX-Payload-Length: "),
        size.cast("string"),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), refers.cast("string"), F.lit(">"))).otherwise(F.lit("")),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        length.cast("string"),
        F.lit("\r\n\r\n"),
        http,
        F.when(revisit, F.lit("")).otherwise(payload),
    )


def write_warc(ws: Workspace, pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> None:
    """One record per row. Null html is an empty payload. A null id is always a response that nothing refers to; rows
    that repeat the smallest id of a payload are all responses. Other columns are not read."""
    payload = F.coalesce(F.col(html_col).cast("string"), F.lit(""))
    own = pages.select(F.col(id_col).cast("long").alias("page"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload.cast("binary"), 256).alias("digest"))
    # one row per payload that at least two rows hold; map-side combining leaves a row per task and payload
    held = own.where((F.col("size") >= REVISIT_FROM) & F.col("page").isNotNull()).groupBy("digest").agg(F.min("page").alias("first"), F.count("*").alias("rows"))
    first = ws.keep(held.where("rows > 1").select("digest", "first"), "first")
    # payloads held once are most; those held often are split by adaptive execution, as both sides are dealt for the join
    small = F.when((F.col("size") < REVISIT_FROM) | F.col("page").isNull(), F.concat(F.lit("x"), F.coalesce(F.col("page").cast("string"), F.col("digest")))).otherwise(F.col("digest"))
    joined = own.withColumn("key", small).join(first.withColumnRenamed("digest", "key"), "key", "left")
    kind = F.when(F.col("first").isNotNull() & (F.col("first") < F.col("page")), "revisit").otherwise("response")
    text = _record(F.col("url"), F.col("page"), kind, F.col("first"), F.col("digest"), F.col("payload"), F.col("size"))
    joined.select(text.alias("value")).write.mode("overwrite").option("lineSep", END).option("maxRecordsPerFile", FILE_RECORDS).text(path)


def _open(path: str):
    where = urlsplit(path)
    if where.scheme in ("", "file"):
        return fs.LocalFileSystem().open_input_file(where.path)
    system, inner = fs.FileSystem.from_uri(path)
    return system.open_input_file(inner)


_LENGTH = re.compile(rb"\r\nContent-Length: *(\d+)\r\n", re.IGNORECASE)


def _header(data: bytes, at: int) -> tuple[int, int] | None:
    """(bytes of the header with its blank line, content length) of a record at this place, if it is well formed."""
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        return None
    found = _LENGTH.search(data, at, end + 2)
    return (end + 4 - at, int(found[1])) if found else None


def _long_header(f, at: int, size: int, more: int = HEADER) -> tuple[int, int] | None:
    """The same of the record at this place of a file, however long its header is."""
    while True:
        data = f.read_at(min(more, size - at), at)
        if b"\r\n\r\n" in data or more >= size - at:
            return _header(data, 0)
        more *= 4


def _scan(batches):
    """Candidate records of each block (file, from, to, size): offset, and the offset where its chain leaves the block."""
    for b in batches:
        for name, lo, hi, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            with _open(name) as f:
                data = f.read_at(min(size, hi + HEADER) - lo, lo)
                at = [m.start() for m in re.finditer(re.escape(MAGIC), data[: hi - lo + len(MAGIC) - 1])]
                last = data.rfind(b"\r\n\r\n")
                if at and at[-1] > last and lo + len(data) < size:
                    # headers that the read cuts off end at the same blank line: it is looked for once, from the first of them
                    begin = next(k for k in at if k > last)
                    head_end, more = -1, 4 * (len(data) - begin)
                    while head_end < 0 and lo + len(data) < size:
                        data += f.read_at(min(more, size - lo - len(data)), lo + len(data))
                        head_end, more = data.find(b"\r\n\r\n", begin), 4 * more
            leave: dict[int, int] = {}
            for k in reversed(at):
                head = _header(data, k)
                if head:
                    after = lo + k + sum(head) + len(END)
                    if after <= size:
                        leave[lo + k] = leave.get(after, after)
            rows = sorted(leave.items())
            yield pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.int64())], names=["file", "at", "leave"])


_FIELDS = "page_id long, url string, record_type string, refers_to long, payload_digest string, payload_bytes long, payload binary"


def _read(batches):
    """The records of a block from its verified entry (file, entry, to, size)."""
    names = [x.split(" ")[0] for x in _FIELDS.split(", ")]
    types = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary()]
    for b in batches:
        for name, at, hi, size in zip(*(c.to_pylist() for c in b.columns), strict=True):
            rows, held = [], 0
            with _open(name) as f:
                while at < min(hi, size):
                    head = _long_header(f, at, size)
                    if head is None:
                        raise ValueError(f"no record at byte {at} of {name}")
                    skip, length = head
                    block = f.read_at(skip + length, at)
                    rows.append(_fields(block[:skip], block[skip:]))
                    held += length
                    at += skip + length + len(END)
                    if held > 4 << 20:
                        yield _batch(rows, names, types)
                        rows, held = [], 0
            yield _batch(rows, names, types)


def _batch(rows, names, types):
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(types)], names=names)


def _fields(head: bytes, block: bytes) -> tuple:
    own = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:] if ": " in line)
    payload = block[block.index(b"\r\n\r\n") + 4 :]
    page = re.search(r"<urn:page:(-?\d+)>", own["WARC-Record-ID"])
    refers = re.search(r"<urn:page:(-?\d+)>", own.get("WARC-Refers-To", ""))
    digest = own["WARC-Payload-Digest"].removeprefix("sha256:")
    if own["WARC-Type"] == "response" and hashlib.sha256(payload).hexdigest() != digest:
        raise ValueError(f"record {own['WARC-Record-ID']}: the payload doesn't have the digest of its header")
    return (int(page[1]) if page else None, own["WARC-Target-URI"], own["WARC-Type"], int(refers[1]) if refers else None, digest, int(own["X-Payload-Length"]), payload)


def read_warc(ws: Workspace, path: str, block: int = BLOCK) -> DataFrame:
    """All records that the chain from each file's start reaches; an error if one does not end at its file's end. Gives page_id, url, record_type, refers_to, payload_digest,
    payload_bytes (of the full payload), payload (empty for revisits)."""
    spark = ws.spark
    ship(spark)
    listed = spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), F.col("length").alias("size")).where("size > 0")
    files = ws.keep(listed, "files")
    longest = files.agg(F.max("size")).first()[0]
    if longest is None:
        return spark.createDataFrame([], _FIELDS)
    cut = files.select("file", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(block).cast("long"))).alias("lo"))
    cut = cut.select("file", "lo", F.least(F.col("lo") + block, F.col("size")).alias("hi"), "size")
    cut = ws.keep(cut.repartition("file", "lo"), "blocks")
    candidates = ws.keep(cut.mapInArrow(_scan, "file string, at long, leave long"), "candidates")
    starts = files.select("file", F.lit(0).cast("long").alias("at"))
    # entries: candidates that a chain leaves another block to, or that start a file
    entered = candidates.select("file", F.col("leave").alias("at")).unionByName(starts).distinct()
    jump = jump0 = ws.keep(candidates.join(entered, ["file", "at"]), "jump0")
    reached = ws.keep(starts.join(jump.select("file", "at"), ["file", "at"]), "reached0")
    for turn in range(1, math.ceil(math.log2(-(-longest // block) + 1)) + 1):
        ahead = reached.join(jump, ["file", "at"]).select("file", F.col("leave").alias("at")).join(jump.select("file", "at"), ["file", "at"])
        reached = ws.keep(reached.unionByName(ahead).distinct(), f"reached{turn}")
        on = jump.select("file", F.col("at").alias("leave"), F.col("leave").alias("further"))
        jump = ws.keep(jump.join(on, ["file", "leave"], "left").select("file", "at", F.coalesce("further", "leave").alias("leave")), f"jump{turn}")
    # the chain of every file must leave its last block at the file's end, or records would be lost
    ended = reached.join(jump0, ["file", "at"]).join(files, "file").where(F.col("leave") == F.col("size")).select("file")
    broken = files.join(ended, "file", "left_anti").select("file").first()
    if broken:
        raise ValueError(f"the records of {broken['file']} don't end where the file does")
    place = F.floor(F.col("at") / block) * block
    entries = reached.join(files, "file").select("file", "at", F.least(place + block, F.col("size")).alias("hi"), "size")
    return entries.repartition("file", "at").mapInArrow(_read, _FIELDS)


def warc_round_trip(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Write all rows as WARC records, read the archives back, and return per record page_id, payload_bytes,
    payload_digest, record_type, refers_to. An empty table gives an empty one."""
    ws = Workspace(pages.sparkSession, "warc")
    path = ws.file("archive")
    write_warc(ws, pages, path, id_col, url_col, html_col)
    return read_warc(ws, path).select(F.col("page_id").alias(id_col), "payload_bytes", "payload_digest", "record_type", "refers_to")
