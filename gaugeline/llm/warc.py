"""WARC archives: written by tasks, read back in ranges with boundary-chain verification.

Records are gzip members of their own. A reading task takes a byte range of a file, tries every gzip magic in it, and
emits a candidate for each complete record: its offset, that of its successor and, for the chain inside the range, the
offset where the chain leaves it. Pointer jumping from the start of each file over these exits finds the candidate at
which the chain enters each range; only records on the chain from there are kept. A member that merely lies inside
another record's payload is never reached.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .files import RangeReader, attempt_name, open_fs
from .shared import discard, shared_dir, stage

MAGIC = b"\x1f\x8b\x08"
#: Bytes of a file that one task reads for candidates, and bytes fed to the inflater at a time.
RANGE_BYTES, FEED = 4 << 20, 1 << 15
#: Bytes of files that a reading task gets, about: several ranges.
TASK_BYTES = 16 << 20
FILE_BYTES = 1 << 30
DATE = "1970-01-01T00:00:00Z"
END = b"\r\n\r\n"
MAX_ROUNDS = 40


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _clean(value: str) -> str:
    """A header value without characters that would end the line."""
    return "".join(c if c.isprintable() and ord(c) < 127 else "".join(f"%{b:02X}" for b in c.encode()) for c in value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None) -> bytes:
    """A response, or a revisit without its payload; both carry the digest and length of the full payload."""
    head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = head if refers_to is not None else head + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha1:{digest32(payload)}",
        f"WARC-Payload-Length: {len(payload)}",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + END + block + END


def member(body: bytes, level: int = 6) -> bytes:
    """A gzip member without a time stamp."""
    packer = zlib.compressobj(level, zlib.DEFLATED, 31)
    return packer.compress(body) + packer.flush()


class _Archive:
    def __init__(self, folder: str) -> None:
        self.name = attempt_name("pages", ".warc.gz")
        system, path = open_fs(folder)
        system.create_dir(path)
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.size = 0
        self.add(f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: <urn:page:>\r\nWARC-Date: {DATE}\r\nContent-Length: 0".encode() + END + END, 6)

    def add(self, body: bytes, level: int) -> None:
        packed = member(body, level)
        self.stream.write(packed)
        self.size += len(packed)


def _write_batches(folder: str, level: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        archive, done = None, []
        for batch in batches:
            for page_id, url, payload, first in zip(*batch.columns):
                if archive is None or archive.size > FILE_BYTES:
                    if archive is not None:
                        archive.stream.close()
                        done.append((archive.name, archive.size))
                    archive = _Archive(folder)
                archive.add(record(page_id.as_py(), url.as_py(), payload.as_py(), first.as_py()), level)
        if archive is not None:
            archive.stream.close()
            done.append((archive.name, archive.size))
        yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in done], pa.string()), pa.array([s for _, s in done], pa.int64())], ["file", "size"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0, level: int = 6) -> DataFrame:
    """Write a record for each row of (page_id, url, payload) and return (file, size).

    Of the records whose equal payloads have at least ``least`` bytes, the one with the smallest page_id is a response
    and the others revisit it; smaller payloads, and rows without page_id, are always responses.
    """
    rows = pages.select("page_id", "url", "payload", F.sha1("payload").alias("digest"))
    first = rows.filter((F.octet_length("payload") >= least) & F.col("page_id").isNotNull()).groupBy("digest")
    # Payloads that occur once need no partner. Staged, so that Spark can split the join at a frequent payload.
    first = stage(first.agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("pages")).filter("pages > 1").drop("pages"), "firsts")
    refers = F.when((F.octet_length("payload") >= least) & (F.col("page_id") > F.col("first")), F.col("first"))
    joined = rows.join(first, "digest", "left").select("page_id", "url", "payload", refers.alias("first"))
    return stage(joined.mapInArrow(_write_batches(folder, level), "file string, size long"), "archives")


def parse(body: bytes) -> dict | None:
    """Fields of a whole record, or None if the bytes are no record."""
    if not body.startswith(b"WARC/1."):
        return None
    cut = body.find(END)
    if cut < 0 or not body.endswith(END):
        return None
    fields = dict(line.split(": ", 1) for line in body[:cut].decode("utf-8", "replace").split("\r\n")[1:] if ": " in line)
    block = body[cut + 4 : -4]
    if fields.get("Content-Length") != str(len(block)):
        return None
    kind = fields.get("WARC-Type", "")
    number = lambda s: int(x) if (x := s.removeprefix("<urn:page:").removesuffix(">")) else None
    out = {"type": kind, "page_id": number(fields.get("WARC-Record-ID", "")), "refers_to": None, "payload_bytes": 0, "digest": ""}
    if kind in ("response", "revisit"):
        out["digest"] = fields["WARC-Payload-Digest"].removeprefix("sha1:")
        out["payload_bytes"] = int(fields["WARC-Payload-Length"])
        if kind == "response":
            payload = block[block.find(END) + 4 :]
            if digest32(payload) != out["digest"] or len(payload) != out["payload_bytes"]:
                return None
        else:
            out["refers_to"] = number(fields["WARC-Refers-To"])
    return out


def _inflate(reader: RangeReader, file: str, offset: int, held: memoryview, start: int, size: int) -> tuple[bytes, int] | None:
    """The member at an offset and the offset after it; None if there is no whole member."""
    unpacker, parts, at = zlib.decompressobj(31), [], offset
    try:
        while not unpacker.eof:
            if at >= size:
                return None
            inside = at - start
            feed = held[inside : inside + FEED] if inside < len(held) else reader.read(file, at, FEED)
            parts.append(unpacker.decompress(feed))
            if at == offset and len(parts[0]) >= 7 and not parts[0].startswith(b"WARC/1."):
                return None
            at += len(feed)
    except zlib.error:
        return None
    return b"".join(parts), at - len(unpacker.unused_data)


def _candidate_batches(folder: str):
    names = ["file", "start", "offset", "successor", "leaves", "type", "page_id", "refers_to", "payload_bytes", "digest"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            for file, start, stop, size in zip(*(c.to_pylist() for c in batch.columns)):
                data = reader.read(file, start, min(stop + len(MAGIC) - 1, size) - start)
                held, rows = memoryview(data), []
                at = data.find(MAGIC)
                while 0 <= at < stop - start:
                    whole = _inflate(reader, file, start + at, held, start, size)
                    fields = parse(whole[0]) if whole else None
                    if fields:
                        rows.append({"file": file, "start": start, "offset": start + at, "successor": whole[1], **fields})
                    at = data.find(MAGIC, at + 1)
                leaves: dict[int, int] = {}
                for row in reversed(rows):
                    row["leaves"] = leaves[row["offset"]] = leaves.get(row["successor"], row["successor"])
                types = [pa.string(), *[pa.int64()] * 4, pa.string(), *[pa.int64()] * 3, pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array([r[n] for r in rows], t) for n, t in zip(names, types)], names)
        reader.close()

    return run


def _walk(group: pd.DataFrame) -> pd.DataFrame:
    """The candidates of a range that lie on the chain from where it enters."""
    follows = dict(zip(group["offset"], group["successor"]))
    at = group.loc[group["entered"], "offset"]
    kept, here = [], at.iloc[0] if len(at) else None
    while here in follows:
        kept.append(here)
        here = follows[here]
    return pd.DataFrame({"id": np.full(len(kept), group["id"].iloc[0], np.int64), "offset": np.array(kept, np.int64)})


def reading_ranges(files: DataFrame, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """(file, start, stop, size) of every range, dealt evenly to a number of tasks that grows with the bytes. The rows are
    so short that Spark would merge them into one task; a given number it keeps."""
    total = files.agg(F.sum("size")).first()[0] or 0
    starts = F.explode(F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(range_bytes).cast("long"))).alias("start")
    ranges = files.filter("size > 0").select("file", "size", starts)
    stop = F.least(F.col("start") + range_bytes, F.col("size")).alias("stop")
    return ranges.select("file", "start", stop, "size").repartition(max(1, -(-total // TASK_BYTES)))


def read_archives(spark: SparkSession, files: DataFrame, folder: str, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """The records of (file, size): file, offset, type, page_id, refers_to, payload_bytes, digest.

    Digests of responses are recomputed from the payloads read. A file whose chain does not end at its last byte is
    damaged, and reading fails.
    """
    found = stage(
        reading_ranges(files, range_bytes).mapInArrow(
            _candidate_batches(folder),
            "file string, start long, offset long, successor long, leaves long, type string, page_id long, refers_to long, payload_bytes long, digest string",
        ),
        "candidates",
    )
    exits = found.select("file", F.col("offset").alias("at"), F.col("leaves").alias("to"))
    entries = exits.select("file", "at")
    jumps = exits.join(entries.withColumnRenamed("at", "to"), ["file", "to"]).select("file", "at", "to")
    reached = stage(entries.filter("at = 0"), "reached")
    old: list[DataFrame] = []
    for _ in range(MAX_ROUNDS):
        more = stage(reached.join(jumps, ["file", "at"]).select("file", F.col("to").alias("at")).join(reached, ["file", "at"], "left_anti").distinct(), "more")
        if more.isEmpty():
            break
        twice = jumps.select("file", F.col("at").alias("to"), F.col("to").alias("then"))
        further = stage(jumps.join(twice, ["file", "to"]).select("file", "at", F.col("then").alias("to")), "jumps")
        wider = stage(reached.unionByName(more), "reached")
        discard(more, reached, *old)
        jumps, reached, old = further, wider, [further]
    else:
        raise RuntimeError("pointer jumping did not end")
    ends = exits.join(reached, ["file", "at"]).groupBy("file").agg(F.max("to").alias("last"))
    damaged = files.filter("size > 0").join(ends, "file", "left").filter("last IS NULL OR last <> size")
    if not damaged.isEmpty():
        raise ValueError(f"the record chain breaks in {damaged.first()['file']}")
    entered = found.join(reached.withColumnRenamed("at", "offset").withColumn("entered", F.lit(True)), ["file", "offset"], "left")
    slim = entered.select(F.xxhash64("file").alias("id"), "start", "offset", "successor", F.coalesce("entered", F.lit(False)).alias("entered"))
    kept = slim.groupBy("id", "start").applyInPandas(_walk, "id long, offset long")
    return found.withColumn("id", F.xxhash64("file")).join(kept, ["id", "offset"]).drop("id", "start", "successor", "leaves")


def archive_pages(pages: DataFrame, least: int = 0) -> DataFrame:
    """One row per page: page_id, payload_bytes, payload_digest, record_type, refers_to.

    The html in UTF-8 (null: empty) is written and the archives are read back; all columns come from what was read.
    Rows that repeat a page_id and its html give repeated records, of one type; rows that repeat a page_id with another
    html are records of their own. A null page_id stays and is always a response. A null url is an empty one. A payload
    of any length is one record, which a task holds whole. Extra columns are ignored; an empty table gives an empty
    table.
    """
    folder = f"{shared_dir(pages.sparkSession)}/warc"
    payload = F.encode(F.coalesce(F.col("html").cast("string"), F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    read = read_archives(pages.sparkSession, write_archives(rows, folder, least), folder)
    read = read.filter("type IN ('response', 'revisit')")
    return read.select("page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("type").alias("record_type"), "refers_to")
