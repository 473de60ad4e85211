"""What several operators share: the shared folder, staged tables, and vectorised scans of whole texts.

The scans work on Arrow string buffers, a block of documents at a time, so no Python object is made per word.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Documents of a block together have at most so many bytes; a longer document is a block of its own.
BLOCK_BYTES = 1 << 19
#: Multiplier of the rolling polynomial hash, odd and so invertible modulo 2**64.
BASE = 0x9E3779B97F4A7C15
_INVERSE = pow(BASE, -1, 1 << 64)
_U = np.uint64
#: Shuffle files of a staged table's own query are of no use once it is written.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Folders that this driver has made in the shared folder.
_MADE: list[str] = []


def shared_dir(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which every executor sees. Where that is unset, as in tests, a
    temporary folder of this machine is set as checkpoint folder first; on a cluster that is an error, since executors
    would write to folders of their own."""
    base = spark.conf.get("spark.checkpoint.dir", "") or ""
    if not base:
        base = spark.sparkContext.getCheckpointDir() or ""
    if not base:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        base = f"file://{tempfile.mkdtemp(prefix='spark-', dir='/tmp')}"
        spark.sparkContext.setCheckpointDir(base)
    base = base if "://" in base or base.startswith("file:") else f"file://{base}"
    made = f"{base.rstrip('/')}/{uuid.uuid4().hex}"
    _MADE.append(made)
    # What nobody has cleaned goes when the driver ends.
    _path_of(spark, made, lambda system, path: system.deleteOnExit(path))
    return made


def _path_of(spark: SparkSession, name: str, act) -> None:
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
    act(path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), path)


def clean(spark: SparkSession) -> int:
    """Delete all that operators have staged in the shared folder so far, to be called once their results are written.
    Returns how many folders that were."""
    gone = 0
    while _MADE:
        _path_of(spark, _MADE.pop(), lambda system, path: system.delete(path, True))
        gone += 1
    return gone


@contextmanager
def brief_shuffles(spark: SparkSession) -> Iterator[None]:
    """Shuffle files of the queries run inside go when each ends."""
    was = spark.conf.get(_CLEANUP)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEANUP, was)


def stage(df: DataFrame, tag: str, codec: str = "snappy") -> DataFrame:
    """Write a table to the shared folder and read it back: cuts the lineage, and outlives a lost executor. ``codec`` is
    for tables whose size on disk matters more than the time to write them."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{tag}"
    with brief_shuffles(spark):
        df.write.option("compression", codec).parquet(path)
    staged = spark.read.schema(df.schema).parquet(path)
    staged.staged_at = path
    return staged


def discard(*frames: DataFrame) -> None:
    """Delete staged tables that nothing reads any more."""
    for df in frames:
        _path_of(df.sparkSession, df.staged_at, lambda system, path: system.delete(path, True))


def carried(docs: DataFrame, names: tuple[str, ...]) -> list[str]:
    """Schema entries of columns that an operator passes through beside doc_id and text."""
    return [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in names]


def mix64(h: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over all 64 output bits."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h ^= h >> _U(27)
    h *= _U(0x94D049BB133111EB)
    h ^= h >> _U(31)
    return h


def byte_codes(seed: int) -> np.ndarray:
    """A random 64-bit code for each byte value."""
    return np.random.default_rng(seed).integers(0, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)


class Powers:
    """Powers of BASE and of its inverse; they grow with the longest block seen."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, _U)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, BLOCK_BYTES + 1)
            self.up = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, BASE, _U)]))
            self.down = np.multiply.accumulate(np.concatenate([np.ones(1, _U), np.full(n - 1, _INVERSE, _U)]))
        return self.up[:n], self.down[:n]


_POWERS = Powers()


def text_blocks(column: pa.Array, rows: int = 1 << 30) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Blocks (first row, row after the last, bytes, offsets from 0) of a string column, each of ``rows`` rows at
    most; null counts as empty."""
    if column.null_count:
        column = column.fill_null("")
    column = column.cast(pa.large_string())
    n = len(column)
    if not n:
        return
    bounds = np.frombuffer(column.buffers()[1], np.int64, n + 1, column.offset * 8)
    raw = column.buffers()[2]
    data = np.frombuffer(raw, np.uint8) if raw is not None else np.zeros(0, np.uint8)
    start = 0
    while start < n:
        stop = int(np.searchsorted(bounds, bounds[start] + BLOCK_BYTES, "right")) - 1
        stop = min(n, start + rows, max(stop, start + 1))
        yield start, stop, data[bounds[start] : bounds[stop]], bounds[start : stop + 1] - bounds[start]
        start = stop


def lower_table() -> np.ndarray:
    """Byte to byte: A-Z in lower case."""
    t = np.arange(256, dtype=np.uint8)
    t[65:91] += 32
    return t


def white_space() -> np.ndarray:
    """True for the bytes 0x20 and 0x09 to 0x0D."""
    t = np.zeros(256, bool)
    t[[0x20, *range(0x09, 0x0E)]] = True
    return t


class Words:
    """Words of a block: bounds, the document of each, and hashes of whole words or of their prefixes."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, breaks: np.ndarray, codes: np.ndarray) -> None:
        n = len(data)
        inside = ~breaks[data]
        begins, ends = inside.copy(), inside.copy()
        if n:
            begins[1:] &= ~inside[:-1]
            ends[:-1] &= ~inside[1:]
            edge = offsets[1:-1]
            edge = edge[(edge > 0) & (edge < n)]
            begins[edge] = inside[edge]
            ends[edge - 1] = inside[edge - 1]
        self.begin = np.flatnonzero(begins)
        self.end = np.flatnonzero(ends) + 1
        #: Index of the first word of each document; one more entry than documents.
        self.first = np.searchsorted(self.begin, offsets)
        up, self._down = _POWERS.get(n + 1)
        self._sums = np.zeros(n + 1, _U)
        if n:
            np.cumsum(codes[data] * up[:n], out=self._sums[1:])

    def hashes(self, prefix: int = 0) -> np.ndarray:
        """64-bit hashes of the words, or of their first bytes."""
        end = np.minimum(self.end, self.begin + prefix) if prefix else self.end
        return mix64((self._sums[end] - self._sums[self.begin]) * self._down[self.begin] + (end - self.begin).astype(_U))
