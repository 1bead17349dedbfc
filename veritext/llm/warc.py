"""WARC archives that are read through an index.

Writing gives, besides the archives, an index table with one row a record:
archive, offset, length, URL and payload digest.  Reading starts from rows of
that table: they are range-partitioned and sorted by archive and offset,
neighbouring ranges become one read, and each record is cut out of the bytes.

Archives go to a folder that all executors share.  Each attempt of a task
writes files of its own names, and the index (written by Spark) names only
those of attempts that succeeded, so a lost executor leaves unused files at
worst and never a record twice.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator
from datetime import UTC, datetime
from urllib.parse import quote, unquote

import pandas as pd
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from veritext.llm.shared import new_folder, stored, text_or_empty

#: An archive is closed at this size.
ARCHIVE_BYTES = 1 << 30
#: Bytes between two wanted records that are read along; most bytes of one read.
GAP_BYTES, READ_BYTES = 64 << 10, 8 << 20
#: Archive bytes of one reading task.
TASK_BYTES = 64 << 20
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
URN = "urn:record:"

INDEX = T.StructType([T.StructField(n, T.StringType() if t == "s" else T.LongType()) for n, t in (
    ("archive", "s"), ("offset", "l"), ("length", "l"), ("url", "s"), ("digest", "s"), ("record_type", "s"), ("record_id", "s"))])


def filesystem(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or URI and the path on it."""
    if re.match(r"file:/|/", uri):
        return fs.LocalFileSystem(), re.sub(r"^file:/+", "/", uri)
    return fs.FileSystem.from_uri(uri)


def _name(value) -> str:
    return "" if value is None else quote(str(value), safe="")


def _record(kind: str, record_id, url, digest: str, n_bytes: int, payload: bytes, refers_to, date: str) -> bytes:
    """One record: WARC header, HTTP header, and the payload unless it is a revisit."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n".encode()
    block = http + (payload if kind == "response" else b"")
    head = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <{URN}{_name(record_id)}>", f"WARC-Date: {date}"]
    if url is not None:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if kind == "revisit":
        head += [f"WARC-Refers-To: <{URN}{_name(refers_to)}>", f"WARC-Profile: {REVISIT}"]
    head += ["Content-Type: application/http;msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """What a record's bytes say: type, id, url, digest, refers_to, n_bytes, payload (None for a revisit)."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    http, _, payload = rest[:int(fields["Content-Length"])].partition(b"\r\n\r\n")
    n_bytes = next(int(x[15:]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    urn = lambda k: unquote(fields[k].strip("<>").removeprefix(URN)) if k in fields else None
    kind = fields["WARC-Type"]
    return {"record_type": kind, "record_id": urn("WARC-Record-ID"), "url": fields.get("WARC-Target-URI"),
            "digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"), "refers_to": urn("WARC-Refers-To"),
            "n_bytes": n_bytes, "payload": payload if kind == "response" else None}


class _Archive:
    """The archive that a task writes to, gzip member by gzip member."""

    def __init__(self, base: str, part: int):
        self.fs, path = filesystem(base)
        self.name = f"part-{part:05d}-{uuid.uuid4().hex[:12]}.warc.gz"
        self.fs.create_dir(path, recursive=True)
        self.out, self.at = self.fs.open_output_stream(f"{path}/{self.name}", compression=None), 0

    def add(self, record: bytes) -> tuple[int, int]:
        member = gzip.compress(record, 6, mtime=0)
        self.out.write(member)
        at, self.at = self.at, self.at + len(member)
        return at, len(member)


def write_warc(pages: DataFrame, base: str, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html",
               revisit_min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row as a record below ``base``; returns the index table.

    The payload is the text in UTF-8 (null: empty).  Of rows with equal
    payloads of at least ``revisit_min_bytes`` bytes, that with the smallest
    id is a response and the others are revisits that refer to it; rows that
    repeat the smallest id are responses too, rows without id are revisits
    where any row of the group has an id, else responses.  Payloads are equal
    if length and SHA-1 are.  A null URL leaves its header out; control
    characters and spaces in a URL are percent-encoded in the header, while
    the index keeps the URL as it is.  An empty table gives an empty index.
    Further columns are left out.

    Roles are found on (id, digest) rows alone; payloads move once, by id and
    digest, so a payload that a third of the rows share stays spread out.
    """
    payload = text_or_empty(payload_col)
    rows = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"),
                        F.octet_length(payload).cast("long").alias("n_bytes"), F.sha1(F.encode(payload, "UTF-8")).alias("digest"))
    narrow = rows.filter(F.col("n_bytes") >= revisit_min_bytes).select("id", "digest", "n_bytes")
    shared = (narrow.groupBy("digest", "n_bytes").agg(F.min("id").alias("first"), F.count("*").alias("n"))
              .filter((F.col("n") > 1) & F.col("first").isNotNull()).drop("n"))
    revisits = (narrow.join(shared, ["digest", "n_bytes"]).filter(~F.col("id").eqNullSafe(F.col("first")))
                .select(F.col("id").alias("r_id"), F.col("digest").alias("r_digest"), "first").distinct())
    roles = rows.join(revisits, F.col("id").eqNullSafe(F.col("r_id")) & (F.col("digest") == F.col("r_digest")), "left")
    date = datetime.now(UTC).strftime("%Y-%m-%dT%H:%M:%SZ")

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        archive = None
        for pdf in batches:
            index = []
            for r in pdf.itertuples(index=False):
                if archive is None or archive.at >= archive_bytes:
                    if archive is not None:
                        archive.out.close()
                    archive = _Archive(base, TaskContext.get().partitionId())
                kind, digest = "response" if r.first is None else "revisit", base64.b32encode(bytes.fromhex(r.digest)).decode()
                record = _record(kind, r.id, r.url, digest, r.n_bytes, r.payload.encode(), r.first, date)
                index.append((archive.name, *archive.add(record), r.url, digest, kind, _name(r.id)))
            yield pd.DataFrame(index, columns=INDEX.names)
        if archive is not None:
            archive.out.close()

    # ids travel as strings: beside a null, pandas would make numbers floats
    sent = roles.select(F.col("id").cast("string").alias("id"), "url", F.when(F.col("first").isNull(), F.col("payload")).otherwise("").alias("payload"),
                        "n_bytes", "digest", F.col("first").cast("string").alias("first"))
    return stored(sent.mapInPandas(write, INDEX), "warc-index")


READ = (T.StructType().add("record_id", "string").add("record_type", "string").add("url", "string").add("digest", "string")
        .add("refers_to", "string").add("n_bytes", "long").add("payload", "binary").add("intact", "boolean"))


def runs(rows: Iterator[tuple], gap: int = GAP_BYTES, most: int = READ_BYTES) -> Iterator[tuple[str, int, list[tuple[int, int]]]]:
    """Sorted (archive, offset, length) rows as reads: archive, first byte, ranges."""
    held, end = None, 0
    for archive, offset, length in rows:
        if held and held[0] == archive and offset - end <= gap and offset + length - held[1] <= most:
            held[2].append((offset, length))
        else:
            if held:
                yield held
            held = (archive, offset, [(offset, length)])
        end = offset + length
    if held:
        yield held


def read_warc(index: DataFrame, base: str, task_bytes: int = TASK_BYTES) -> DataFrame:
    """The records of index rows: record_id, record_type, url, digest,
    refers_to, n_bytes (of the full payload, as its HTTP header has it),
    payload (null for a revisit), intact (a response's payload has that length
    and digest).

    Any selection of rows can be read; equal rows are read each on its own.
    """
    spark = index.sparkSession
    wanted = index.select("archive", "offset", "length")
    total = wanted.agg(F.sum("length")).head()[0] or 0
    tasks = max(spark.sparkContext.defaultParallelism, -(-total // task_bytes))
    placed = wanted.repartitionByRange(int(tasks), "archive", "offset").sortWithinPartitions("archive", "offset")

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        system, path = filesystem(base)
        name, source = None, None
        for archive, first, ranges in runs(r for pdf in batches for r in pdf.itertuples(index=False, name=None)):
            if archive != name:
                if source is not None:
                    source.close()
                name, source = archive, system.open_input_file(f"{path}/{archive}")
            data = source.read_at(ranges[-1][0] + ranges[-1][1] - first, first)
            rows = []
            for offset, length in ranges:
                r = parse_record(zlib.decompress(data[offset - first:offset - first + length], wbits=31))
                body = r["payload"]
                r["intact"] = body is None or (len(body) == r["n_bytes"] and base64.b32encode(hashlib.sha1(body).digest()).decode() == r["digest"])
                rows.append(r)
            yield pd.DataFrame(rows, columns=READ.names)
        if source is not None:
            source.close()

    return placed.mapInPandas(read, READ)


def archive_folder(spark) -> str:
    """A fresh folder for archives in the shared checkpoint folder."""
    return new_folder(spark, "warc")
