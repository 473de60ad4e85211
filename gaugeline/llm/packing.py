"""Packing documents into token sequences of fixed capacity, best two fit.

A bin is filled greedily with the largest document that fits, until none does. Then its smallest document gives way to
two unpacked ones that together fit the gap so expanded more tightly, if there are two such.

Only lengths matter to that, and there are no more of them than a sequence has tokens, so one histogram of all documents
is packed: bins of equal make-up are made as many at a time as the counts allow, with the result of making them one by
one. What comes out is a short list of patterns for any number of documents. A document finds its place by its rank among
those of its length, which tasks count for themselves and a running total over tasks completes; so the whole corpus is
packed as one, and no document passes the driver.
"""

from __future__ import annotations

import unicodedata
import zlib
from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bpe import LETTER, NUMBER, TextEncoder
from .shared import stage, text_blocks

CAPACITY = 2048
#: Token that ends every document.
END = 0
_RANKS = 48


@dataclass
class Pattern:
    """So many bins that hold the same lengths: (length, how many of it), the longest first."""

    items: list[tuple[int, int]]
    times: int


def best_two_fit(counts: dict[int, int], capacity: int = CAPACITY) -> list[Pattern]:
    """Patterns of bins that hold all documents, from the number of documents of each length.

    A pattern is repeated until it would come out otherwise: while every length has as many left as filling and replacing
    look for. So each repetition ends with a length short of what one bin takes of it, and there are at most about
    capacity * log(capacity) patterns, however many documents there are.
    """
    left = {length: n for length, n in counts.items() if n > 0}
    lengths = sorted(left)
    patterns = []
    while lengths:
        taken: dict[int, int] = {}
        gap, bound = capacity, capacity
        while (at := bisect_right(lengths, min(gap, bound)) - 1) >= 0:
            length = lengths[at]
            taken[length] = min(left[length], gap // length)
            gap -= taken[length] * length
            bound = length - 1
        if not taken:
            raise ValueError(f"a document is longer than {capacity}")
        looked, final = dict(taken), dict(taken)
        smallest = min(taken)
        if gap and sum(taken.values()) > 1 and (pair := _tightest_pair(lengths, left, taken, smallest, gap + smallest)):
            final[smallest] -= 1
            for length in pair:
                looked[length] = looked.get(length, 0) + 1
                final[length] = final.get(length, 0) + 1
        times = min((left[n] - looked[n]) // k + 1 for n, k in final.items() if k)
        patterns.append(Pattern(sorted(((n, k) for n, k in final.items() if k), reverse=True), times))
        for n, k in final.items():
            left[n] -= k * times
        if not all(left[n] for n in final):
            lengths = [n for n in lengths if left[n]]
    return patterns


def _tightest_pair(lengths: list[int], left: dict[int, int], taken: dict[int, int], smallest: int, room: int) -> tuple[int, int] | None:
    """Two unpacked documents with the largest sum up to ``room`` that is above ``smallest``; of equal sums, the pair
    with the longest document."""
    spare = [(n, left[n] - taken.get(n, 0)) for n in lengths[: bisect_right(lengths, room - 1)]]
    spare = [(n, k) for n, k in spare if k > 0]
    free = [n for n, _ in spare]
    best, pair = smallest, None
    for n, k in reversed(spare):
        if 2 * n <= best:
            break
        at = bisect_right(free, min(n, room - n)) - 1
        if at >= 0 and free[at] == n and k < 2:
            at -= 1
        if at >= 0 and n + free[at] > best:
            best, pair = n + free[at], (n, free[at])
            if best == room:
                break
    return pair


class Places:
    """Where the document of a length and rank goes: patterns as sorted runs of ranks."""

    def __init__(self, patterns: list[Pattern]) -> None:
        rows, used, bins = [], {}, 0
        for pattern in patterns:
            offset = 0
            for length, each in pattern.items:
                first = used.get(length, 0)
                rows.append((length << _RANKS | first, length, first, each, bins, offset))
                used[length] = first + each * pattern.times
                offset += each * length
            bins += pattern.times
        self.bins, self.used = bins, used
        rows.sort()
        self.key, self.length, self.first, self.each, self.bin, self.offset = np.array(rows, np.int64).reshape(-1, 6).T.copy()

    def find(self, length: np.ndarray, rank: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bin and offset of each document."""
        at = np.searchsorted(self.key, length << _RANKS | rank, "right") - 1
        turn, slot = np.divmod(rank - self.first[at], self.each[at])
        return self.bin[at] + turn, self.offset[at] + slot * length


def unsettled_characters(kinds: np.ndarray) -> np.ndarray:
    """True for code points that versions of Unicode may class differently: unassigned ones, and letters and numbers
    that came after version 3.2."""
    out = np.zeros(0x110000, bool)
    for code in range(0x80, 0x110000):
        c = chr(code)
        out[code] = unicodedata.category(c) == "Cn" or (kinds[code] in (LETTER, NUMBER) and unicodedata.ucd_3_2_0.category(c) == "Cn")
    return out


class PieceCoder:
    """Ids of whole texts: by the automaton, and by the tokenizers library where a text has unsettled characters."""

    def __init__(self, spec: str) -> None:
        self.spec, self.encoder = spec, TextEncoder(spec)
        self.unsettled = unsettled_characters(self.encoder.kinds)

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k != "library"}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        odd = [self._odd(t) for t in texts]
        out = self.encoder.encode(["" if o else t for t, o in zip(texts, odd)])
        for i in (i for i, o in enumerate(odd) if o):
            if not hasattr(self, "library"):
                self.library = Tokenizer.from_str(self.spec)
                self.library.no_truncation()
                self.library.no_padding()
            out[i] = np.array(self.library.encode(texts[i], add_special_tokens=False).ids, np.int32)
        return out

    def _odd(self, text: str) -> bool:
        return not text.isascii() and bool(self.unsettled[np.frombuffer(text.encode("utf-32-le"), np.uint32)].any())


def _piece_batches(shared, capacity: int, keep_ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, task = shared.value, TaskContext.get().partitionId()
        ranks = np.zeros(capacity + 1, np.int64)
        for batch in batches:
            for lo, hi, _, _ in text_blocks(batch.column(1)):
                rows, of = [], []
                for i, ids in enumerate(coder.encode([t or "" for t in batch.column(1).slice(lo, hi - lo).to_pylist()])):
                    raw = np.append(ids, END).astype("<u4").tobytes()
                    for piece, start in enumerate(range(0, len(raw), 4 * capacity)):
                        own = raw[start : start + 4 * capacity]
                        length = len(own) // 4
                        rows.append((piece, start // 4, length, zlib.crc32(own), task, int(ranks[length]), own))
                        ranks[length] += 1
                        of.append(lo + i)
                columns = list(zip(*rows))
                types = (pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64()) + (pa.binary(),) * keep_ids
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(of)), *(pa.array(c, t) for c, t in zip(columns, types))],
                    ["doc_id", "piece", "start", "length", "ids_crc32", "task", "rank", "ids"][: 1 + len(types)],
                )

    return run


def _place_batches(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rank = batch.column("rank").to_numpy() + batch.column("ahead").to_numpy()
            bins, offset = shared.value.find(batch.column("length").to_numpy(), rank)
            kept = [c for c in batch.schema.names if c not in ("task", "rank", "ahead")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(bins), pa.array(offset)], [*kept, "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset, and with keep_ids the ids.

    A document is its text's ids and an END. Those longer than ``capacity`` are cut into pieces of it, of which the last may
    be shorter; every other document is one piece. Pieces of a sequence follow each other without gaps. A null text counts
    as empty and is an END alone; a null doc_id stays; rows that repeat a doc_id are documents of their own; texts of any
    length are encoded whole. Extra columns are ignored; an empty table gives an empty table. The driver holds the
    histogram of lengths, ``capacity`` numbers, and the patterns, a few times as many; both are bounded whatever the
    number of documents.
    """
    spark = docs.sparkSession
    with open(tokenizer_file, encoding="utf-8") as f:
        coder = spark.sparkContext.broadcast(PieceCoder(f.read()))
    columns = "doc_id long, piece int, start long, length long, ids_crc32 long"
    more = ", ids binary" * keep_ids
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # Written once, so ranks hold even if a task is repeated later.
    pieces = stage(texts.mapInArrow(_piece_batches(coder, capacity, keep_ids), f"{columns}, task int, rank long{more}"), "pieces")
    counts = stage(pieces.groupBy("task", "length").agg(F.count(F.lit(1)).alias("n")), "counts")
    histogram = {r["length"]: r["n"] for r in counts.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places = spark.sparkContext.broadcast(Places(best_two_fit(histogram, capacity)))
    before = Window.partitionBy("length").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    ahead = counts.select("task", "length", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("ahead"))
    return pieces.join(ahead, ["task", "length"]).select(*pieces.columns, "ahead").mapInArrow(_place_batches(places), f"{columns}{more}, sequence_id long, offset long")


def sequences(packed: DataFrame) -> DataFrame:
    """sequence_id, ids: the packed pieces (with ids) joined in order. A sequence is bounded by its capacity."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return packed.groupBy("sequence_id").agg(F.aggregate(parts, F.lit(b""), lambda done, x: F.concat(done, x["ids"])).alias("ids"))
