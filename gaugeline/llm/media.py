"""Media columns: content-addressed payloads in tar shards, with rows that hold digest, offset and length.

A task encodes its payloads as grayscale PNG images and appends each distinct one to a tar shard of its own. Rows with
equal digests then agree on one stored copy. Metadata columns are filled by reading image headers only; features by
reading whole ranges back.
"""

from __future__ import annotations

import hashlib
import io
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .files import RangeReader, attempt_name, open_fs
from .shared import shared_dir, stage

#: Samples in an image row. Payloads are padded to whole rows.
WIDTH = 576
PAD = 255
SIGNATURE = b"\x89PNG\r\n\x1a\n"
HEADER = 33
LEVEL = 3
#: Bytes after which a task starts another shard, and stored bytes that a reading task gets, about.
SHARD_BYTES, TASK_BYTES = 1 << 30, 16 << 20


def pad(raw: bytes) -> bytes:
    """The payload of a text's bytes: padded to a positive multiple of WIDTH."""
    return raw + bytes([PAD]) * (WIDTH * max(1, -(-len(raw) // WIDTH)) - len(raw))


def _chunk(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def encode_png(payload: bytes) -> bytes:
    """An 8-bit grayscale image, WIDTH samples to a row, without row filters."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _chunk(b"IHDR", head) + _chunk(b"IDAT", zlib.compress(lines, LEVEL)) + _chunk(b"IEND", b"")


def png_header(head: bytes) -> tuple[int, int, int]:
    """Width, height and bits of a sample, from the first HEADER bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR" or zlib.crc32(head[12:29]) != struct.unpack(">I", head[29:33])[0]:
        raise ValueError("not a PNG header")
    width, height, bits = struct.unpack(">IIB", head[16:25])
    return width, height, bits


def decode_png(image: bytes) -> bytes:
    """The samples of an image that encode_png has made."""
    width, height, _ = png_header(image[:HEADER])
    at, body = HEADER, []
    while at < len(image):
        size, kind = struct.unpack(">I4s", image[at : at + 8])
        if zlib.crc32(image[at + 4 : at + 8 + size]) != struct.unpack(">I", image[at + 8 + size : at + 12 + size])[0]:
            raise ValueError("damaged PNG chunk")
        if kind == b"IDAT":
            body.append(image[at + 8 : at + 8 + size])
        at += 12 + size
    lines = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, width + 1)
    if lines[:, 0].any():
        raise ValueError("row filters are not used here")
    return lines[:, 1:].tobytes()


def features(payload: bytes) -> str:
    """Rows, mean, spread and entropy of the samples, and their shares in sixteen equal ranges, in thousandths."""
    counts = np.bincount(np.frombuffer(payload, np.uint8), minlength=256)
    n = counts.sum()
    level = np.arange(256)
    mean = (counts * level).sum() / n
    spread = np.sqrt((counts * (level - mean) ** 2).sum() / n)
    p = counts[counts > 0] / n
    bins = np.rint(counts.reshape(16, 16).sum(axis=1) * 1000 / n).astype(int)
    return f"{len(payload) // WIDTH};{mean:.3f};{spread:.3f};{-(p * np.log2(p)).sum():.3f};" + ",".join(map(str, bins))


class _Shard:
    """A tar file that is written from start to end."""

    def __init__(self, folder: str) -> None:
        self.name = attempt_name("media", ".tar")
        system, path = open_fs(folder)
        system.create_dir(path)
        self.stream = system.open_output_stream(f"{path}/{self.name}", compression=None)
        self.offset = 0

    def add(self, name: str, body: bytes) -> int:
        """Offset of the member's first byte."""
        info = tarfile.TarInfo(name)
        info.size = len(body)
        head = info.tobuf(tarfile.USTAR_FORMAT)
        self.stream.write(head)
        self.stream.write(body)
        self.stream.write(b"\0" * (-len(body) % 512))
        at = self.offset + len(head)
        self.offset = at + len(body) + -len(body) % 512
        return at

    def close(self) -> None:
        self.stream.write(b"\0" * 1024)
        self.stream.close()


def _write_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard: _Shard | None = None
        stored: dict[bytes, tuple[str, int, int]] = {}
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = []
                for value in batch.column(1):
                    raw = (value.as_py() or "").encode()
                    payload = pad(raw)
                    key = hashlib.sha256(payload).digest()
                    if key not in stored:
                        if shard is None or shard.offset > SHARD_BYTES:
                            if shard is not None:
                                shard.close()
                            shard = _Shard(folder)
                        image = encode_png(payload)
                        stored[key] = (shard.name, shard.add(f"{key.hex()}.png", image), len(image))
                    rows.append((len(raw), key.hex(), *stored[key]))
                n, digest, name, at, size = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(n, pa.int64()), pa.array(digest), pa.array(name), pa.array(at, pa.int64()), pa.array(size, pa.int64())],
                    ["doc_id", "n_bytes", "digest", "shard", "offset", "length"],
                )
        if shard is not None:
            shard.close()

    return run


def store(docs: DataFrame, folder: str) -> DataFrame:
    """Write the payloads below ``folder``: doc_id, n_bytes, digest, and shard, offset and length of the stored copy.

    Equal payloads are stored once per task, under their digest. addresses() picks one copy for all rows of a digest.
    """
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(
        _write_batches(folder), "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
    )
    return stage(rows, "media-rows")


def addresses(rows: DataFrame) -> DataFrame:
    """digest, shard, offset, length: the first copy of each digest by shard name and offset, in the order of places.
    Dealt to a number of tasks that grows with the stored bytes, which Spark does not see in rows this short."""
    one = rows.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("at")).select("digest", "at.*")
    one = stage(one, "addresses")
    total = one.agg(F.sum("length")).first()[0] or 0
    return one.repartitionByRange(max(1, -(-total // TASK_BYTES)), "shard", "offset").sortWithinPartitions("shard", "offset")


def _header_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for batch in batches:
            rows = [png_header(reader.read(s, o, HEADER)) for s, o in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist())]
            columns = [pa.array([r[i] for r in rows], pa.int32()) for i in range(3)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *columns], [*batch.schema.names, "width", "height", "bits"])
        reader.close()

    return run


def _payload_batches(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = RangeReader(folder)
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                rows = []
                for name, at, size in zip(*(batch.column(i).to_pylist() for i in (1, 2, 3))):
                    image = reader.read(name, at, size)
                    payload = decode_png(image)
                    rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(image), hashlib.sha256(image).hexdigest(), features(payload)))
                n, digest, tail, size, stored, said = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), *batch.columns[4:], pa.array(n, pa.int64()), pa.array(digest), pa.array(tail, pa.int64()), pa.array(size, pa.int64()), pa.array(stored), pa.array(said)],
                    ["digest", *batch.schema.names[4:], "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"],
                )
        reader.close()

    return run


def read_headers(places: DataFrame, folder: str) -> DataFrame:
    """(digest, shard, offset, length) with width, height and bits of each stored image, from ranges of HEADER bytes."""
    return places.mapInArrow(_header_batches(folder), "digest string, shard string, offset long, length long, width int, height int, bits int")


def read_payloads(headed: DataFrame, folder: str) -> DataFrame:
    """Features of each stored payload, from the bytes read back, beside what its header says."""
    return headed.mapInArrow(
        _payload_batches(folder),
        "digest string, width int, height int, bits int, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string",
    )


def media_columns(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256,
    feature, and width, height and bits from the image header.

    Payloads are whole texts in UTF-8, padded; null counts as empty and has a payload of padding; a text of any length
    is one image, which a task holds whole. Equal texts have equal values. Repeated rows give repeated rows; a null
    doc_id stays; extra columns are ignored; an empty table gives an empty table. Files are named by task attempt, so
    rows of a repeated task never mix with those of another.
    """
    folder = f"{shared_dir(docs.sparkSession)}/media"
    rows = store(docs, folder)
    read = stage(read_payloads(read_headers(addresses(rows), folder), folder), "read")
    # Both sides are staged, so Spark can split the join at a frequent digest.
    return rows.select("doc_id", "n_bytes", "digest").join(read, "digest").drop("digest")


def unpack(shard: bytes) -> dict[str, bytes]:
    """Members of a shard, as any tar reader sees them."""
    with tarfile.open(fileobj=io.BytesIO(shard)) as tar:
        return {m.name: tar.extractfile(m).read() for m in tar}
