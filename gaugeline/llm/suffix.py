"""Removal of repeated passages by longest-previous-factor arrays over bucketed suffixes.

A suffix is the part of a text from some byte on, cut at the match length. Every suffix belongs to the bucket of its
anchor, the gram with the smallest hash inside it, so equal suffixes meet in one bucket wherever they lie. Suffixes
that share an anchor are stored once, as one context. Buckets whose gram occurs once are dropped before any text
moves. Inside a bucket the suffixes are sorted, neighbours give the lengths of common prefixes, and for each suffix the
previous and the next smaller position in suffix order give its longest previous factor, cut at the match length. Where
it reaches that length, the bytes occur earlier and go.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import _POWERS, byte_codes, discard, mix64, stage, text_blocks

_U = np.uint64
#: Bytes of a gram. Longer grams repeat less often by chance, but leave fewer to choose an anchor from.
GRAM = 20
#: Bytes of suffixes sorted at once in a task, about: whole buckets.
CHUNK_BYTES = 24 << 20
#: A bucket with more bytes of suffixes does not fit a task: equal suffixes, which are those whose longest previous
#: factor reaches the match length, are found by their hashes in a distributed aggregation instead.
MAX_BUCKET = 64 << 20


def _anchors(data: np.ndarray, offsets: np.ndarray, length: int, codes: np.ndarray):
    """Valid suffix starts of a block, the anchor of each, and prefix sums for hashes of any stretch."""
    n = len(data)
    up, down = _POWERS.get(n + 1)
    sums = np.zeros(n + 1, _U)
    np.cumsum(codes[data] * up[:n], out=sums[1:])
    if n < length:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), sums, down
    grams = n - GRAM + 1
    h = mix64((sums[GRAM:] - sums[:grams]) * down[:grams])
    # High bits of the hash decide, and of equal ones the leftmost gram: the same choice in blocks of any size.
    mask = _U((1 << 32) - 1)
    low = (h & ~mask) | np.arange(grams, dtype=_U)
    width, step = length - GRAM + 1, 1
    while step * 2 <= width:
        low = np.minimum(low[:-step], low[step:])
        step *= 2
    if width > step:
        low = np.minimum(low[: len(low) - (width - step)], low[width - step :])
    ok = np.zeros(len(low) + 1, np.int32)
    for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
        if b - a >= length:
            ok[a] += 1
            ok[b - length + 1] -= 1
    starts = np.flatnonzero(np.cumsum(ok[:-1]))
    return starts, (low[starts] & mask).astype(np.int64), sums, down


def _runs(starts: np.ndarray, anchors: np.ndarray, offsets: np.ndarray):
    """First and last suffix start, anchor and document of each stretch of suffixes with one anchor."""
    doc = np.searchsorted(offsets, starts, "right") - 1
    cut = np.flatnonzero((np.diff(anchors) != 0) | (np.diff(doc) != 0)) + 1
    first = np.concatenate([[0], cut]).astype(np.int64)
    last = np.concatenate([cut, [len(starts)]]).astype(np.int64) - 1
    return starts[first], starts[last], anchors[first], doc[first]


def _hash_of(sums: np.ndarray, down: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix64((sums[b] - sums[a]) * down[a] + (b - a).astype(_U)).view(np.int64)


def _anchor_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(31)
        # A text seen before in this partition adds nothing unless its doc_id is smaller: copies are settled by digest.
        seen: dict[bytes, int] = {}
        for batch in batches:
            ids, rows = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                starts, anchors, sums, down = _anchors(data, offsets, length, codes)
                if not len(starts):
                    continue
                _, _, at, doc = _runs(starts, anchors, offsets)
                fresh = np.ones(hi - lo, bool)
                for i in range(hi - lo):
                    key = hashlib.blake2b(data[offsets[i] : offsets[i + 1]], digest_size=16).digest()
                    if seen.get(key, ids[lo + i] + 1) <= ids[lo + i]:
                        fresh[i] = False
                    else:
                        seen[key] = ids[lo + i]
                keep = fresh[doc]
                at, doc = at[keep], doc[keep]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(_hash_of(sums, down, at, at + GRAM)), pa.array(rows[lo:hi][doc]), pa.array((at - offsets[doc]).astype(np.int32))],
                    ["gram", "row", "pos"],
                )

    return run


def _slices(data: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of many stretches, one after the other, and their bounds."""
    ends = np.concatenate([[0], np.cumsum(b - a)])
    where = np.repeat(a - ends[:-1], b - a) + np.arange(ends[-1])
    return data[where], ends


def _context_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes = byte_codes(31)
        for batch in batches:
            ids, hits, rows = batch.column(0).to_numpy(), batch.column(2), batch.column(3).to_numpy()
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                starts, anchors, sums, down = _anchors(data, offsets, length, codes)
                if not len(starts):
                    continue
                marked = np.zeros(len(data), bool)
                own = hits.slice(lo, hi - lo)
                counts = np.diff(own.offsets.to_numpy())
                where = own.flatten().to_numpy() + np.repeat(offsets[:-1], counts)
                marked[where[where < len(data)]] = True
                a, b, at, doc = _runs(starts, anchors, offsets)
                keep = marked[at]
                a, b, at, doc = a[keep], b[keep] + length, at[keep], doc[keep]
                content, ends = _slices(data, a, b)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(_hash_of(sums, down, at, at + GRAM)),
                        pa.array(_hash_of(sums, down, a, b)),
                        pa.array(ids[lo:hi][doc]),
                        pa.array(rows[lo:hi][doc]),
                        pa.array((a - offsets[doc]).astype(np.int32)),
                        pa.array((b - a).astype(np.int32)),
                        pa.Array.from_buffers(pa.binary(), len(a), [None, pa.py_buffer(ends.astype(np.int32)), pa.py_buffer(np.ascontiguousarray(content))]),
                    ],
                    ["gram", "context", "doc_id", "row", "start", "size", "bytes"],
                )

    return run


def _factors(order: np.ndarray, common: np.ndarray, step: int, length: int) -> np.ndarray:
    """Length of the match of each suffix with the nearest one of smaller position, on the side that ``step`` (-1 or 1)
    says. Suffixes are given in suffix order: ``order`` holds their positions, ``common`` their match with the neighbour
    on that side (0 where there is none).

    A suffix points to its neighbour; while that has a larger position, all suffixes it has passed over have larger ones
    too, so the pointer moves on to where that one points, and the match is the smallest passed. All pointers move
    together, so their jumps double. Those whose match has become shorter than ``length`` stop.
    """
    n = len(order)
    points, match = np.arange(n) + step, common.copy()
    live = np.flatnonzero(match >= length)
    while len(live := live[order[points[live]] > order[live]]):
        through = points[live]
        shorter, further = np.minimum(match[live], match[through]), points[through]
        match[live], points[live] = shorter, further
        live = live[shorter >= length]
    return match


def previous_factors(suffixes: np.ndarray, length: int) -> np.ndarray:
    """Longest previous factor of each row of ``suffixes``, which are in text order and ``length`` bytes each; only those
    that reach the length are followed to the end."""
    order = np.argsort(suffixes.view(f"S{length}").ravel())
    common = np.zeros(len(order) + 1, np.int32)
    for at in range(1, len(order), 1 << 14):
        own = order[at : at + (1 << 14)]
        differ = suffixes[own] != suffixes[order[at - 1 : at - 1 + len(own)]]
        common[at : at + len(own)] = np.where(differ.any(axis=1), differ.argmax(axis=1), length)
    factor = np.empty(len(order), np.int32)
    factor[order] = np.maximum(_factors(order, common[:-1], -1, length), _factors(order, common[1:], 1, length))
    return factor


def repeated_suffixes(doc: np.ndarray, row: np.ndarray, start: np.ndarray, data: np.ndarray, bounds: np.ndarray, length: int) -> tuple[np.ndarray, ...]:
    """Stretches (context, first byte, byte after the last) of contexts whose longest previous factor reaches the length.

    data and bounds hold the contexts' bytes, doc, row and start say where each begins. Their suffixes are brought into
    text order, in which a position is smaller that lies in a smaller doc_id or further ahead.
    """
    order = np.lexsort((start, row, doc))
    count = (np.diff(bounds) - length + 1)[order]
    context = np.repeat(order, count)
    within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    suffixes = np.ascontiguousarray(np.lib.stride_tricks.sliding_window_view(data, length)[bounds[:-1][context] + within])
    hit = np.flatnonzero(previous_factors(suffixes, length) >= length)
    cut = np.flatnonzero((np.diff(hit) != 1) | (np.diff(context[hit]) != 0)) + 1
    first = hit[np.concatenate([[0], cut])] if len(hit) else hit
    last = hit[np.concatenate([cut, [len(hit)]]) - 1] if len(hit) else hit
    own = context[first]
    return own, start[own] + within[first], start[own] + within[last] + length


def _suffix_batches(length: int, chunk: int):
    def solve(table: pa.Table) -> pa.RecordBatch:
        table = table.combine_chunks()
        column = table.column("bytes").cast(pa.large_binary()).combine_chunks()
        column = column.chunk(0) if isinstance(column, pa.ChunkedArray) else column
        bounds = np.frombuffer(column.buffers()[1], np.int64, len(column) + 1, column.offset * 8)
        data = np.frombuffer(column.buffers()[2], np.uint8)
        doc, row, start = (table.column(n).to_numpy() for n in ("doc_id", "row", "start"))
        own, a, b = repeated_suffixes(doc, row, start.astype(np.int64), data, bounds, length)
        return pa.RecordBatch.from_arrays([pa.array(doc[own], pa.int64()), pa.array(row[own], pa.int64()), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32))], ["doc_id", "row", "first", "stop"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        weight = 0
        for whole in batches:
            weights = np.cumsum((whole.column("size").to_numpy().astype(np.int64) - length + 1) * length)
            at = 0
            while at < whole.num_rows:
                before = int(weights[at - 1]) if at else 0
                stop = max(at + 1, int(np.searchsorted(weights, before + chunk // 4, "right")))
                held.append(whole.slice(at, stop - at))
                weight += int(weights[min(stop, whole.num_rows) - 1]) - before
                at = stop
                if weight < chunk:
                    continue
                table = pa.Table.from_batches(held)
                grams = table.column("gram").to_numpy()
                edge = np.flatnonzero(grams != grams[-1])  # the last bucket may go on in the next batch
                if len(edge):
                    yield solve(table.slice(0, int(edge[-1]) + 1))
                    held = table.slice(int(edge[-1]) + 1).to_batches()
                    weight = sum(int((x.column("size").to_numpy().astype(np.int64) - length + 1).sum()) * length for x in held)
        if held:
            yield solve(pa.Table.from_batches(held))

    return run


def _exploded_batches(length: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, row, start, content in zip(*(batch.column(n).to_pylist() for n in ("doc_id", "row", "start", "bytes"))):
                keys = [hashlib.blake2b(content[i : i + length], digest_size=16).digest() for i in range(len(content) - length + 1)]
                at = np.arange(start, start + len(keys), dtype=np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(np.full(len(keys), doc)), pa.array(np.full(len(keys), row)), pa.array(at)], ["suffix", "doc_id", "row", "first"])

    return run


def _removal_batches():
    empty = hashlib.sha256().hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            spans = batch.column(2)
            n_removed, n_spans, digest = [], [], []
            row = 0
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                for i in range(hi - lo):
                    text = data[offsets[i] : offsets[i + 1]]
                    pairs = spans[row]
                    row += 1
                    a, b = pairs.values.field(0).to_numpy(), pairs.values.field(1).to_numpy()
                    change = np.zeros(len(text) + 1, np.int32)
                    np.add.at(change, np.minimum(a, len(text)), 1)
                    np.add.at(change, np.minimum(b, len(text)), -1)
                    gone = np.cumsum(change[:-1]) > 0
                    kept = text[~gone]
                    n_removed.append(len(text) - len(kept))
                    n_spans.append(int((np.diff(np.concatenate([[0], gone.astype(np.int8)])) == 1).sum()))
                    digest.append(hashlib.sha256(np.ascontiguousarray(kept)).hexdigest() if len(kept) else empty)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(3), pa.array(n_removed, pa.int64()), pa.array(n_spans, pa.int64()), pa.array(digest)], ["doc_id", "sha", "n_removed", "n_spans", "kept_sha256"])

    return run


def _row() -> Column:
    """Tells texts apart that repeat one doc_id; equal rows share it."""
    return F.xxhash64("doc_id", F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("row")


def repeated_spans(docs: DataFrame, length: int = 100, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """(doc_id, row, spans): stretches (first, stop) of UTF-8 bytes that some earlier text holds too; they may overlap.

    Later copies of a whole text are not listed: remove_repeats settles them by digest. Tables that a gram or a context
    with very many rows is joined with are staged, so that Spark can split those joins.
    """
    texts = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"), _row()).filter("doc_id IS NOT NULL")
    anchors = stage(texts.mapInArrow(_anchor_batches(length), "gram long, row long, pos int"), "anchors")
    often = stage(anchors.groupBy("gram").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("gram"), "often")
    hits = anchors.join(often, "gram", "left_semi").groupBy("row").agg(F.collect_set("pos").alias("hits"))
    hits = stage(hits, "hits")
    discard(anchors, often)
    contexts = texts.join(hits, "row").select("doc_id", "text", "hits", "row")
    contexts = stage(
        contexts.mapInArrow(_context_batches(length), "gram long, context long, doc_id long, row long, start int, size int, bytes binary"),
        "contexts",
        "zstd",
    )
    discard(hits)
    at = F.struct("doc_id", "row", "start")
    slim = contexts.select("gram", "context", "doc_id", "row", "start", "size")
    firsts = stage(slim.groupBy("gram", "context").agg(F.min(at).alias("at"), F.max("size").alias("size")), "firsts")
    copies = slim.drop("size").join(firsts, ["gram", "context"]).filter(at != F.col("at"))
    copies = stage(copies.select("doc_id", "row", F.col("start").alias("first"), (F.col("start") + F.col("size")).alias("stop")), "copies")

    weight = F.sum((F.col("size") - length + 1).cast("long") * length).alias("weight")
    buckets = stage(firsts.groupBy("gram").agg(F.count(F.lit(1)).alias("n"), weight).filter("n > 1").drop("n"), "weights")
    known = firsts.join(buckets, "gram").select("gram", "context", "at.*", "weight")
    keys = ["gram", "context", "doc_id", "row", "start"]
    # Equal rows of the table give a context twice.
    several = contexts.join(known, keys).dropDuplicates(keys).select("gram", "doc_id", "row", "start", "size", "bytes", "weight")
    several = stage(several, "several", "zstd")
    # Only short rows and the buckets' bytes are left when these are shuffled once more.
    discard(contexts, firsts, buckets)
    sorted_ = several.filter(F.col("weight") <= max_bucket).drop("weight").repartition("gram").sortWithinPartitions("gram")
    inner = sorted_.mapInArrow(_suffix_batches(length, CHUNK_BYTES), "doc_id long, row long, first int, stop int")

    exploded = several.filter(F.col("weight") > max_bucket).select("doc_id", "row", "start", "bytes")
    exploded = exploded.mapInArrow(_exploded_batches(length), "suffix binary, doc_id long, row long, first int")
    place = F.struct("doc_id", "row", "first")
    earliest = exploded.groupBy("suffix").agg(F.min(place).alias("at"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    wide = exploded.join(earliest, "suffix").filter(place != F.col("at"))
    wide = wide.select("doc_id", "row", "first", (F.col("first") + length).alias("stop"))
    spans = copies.unionByName(inner).unionByName(wide).groupBy("doc_id", "row").agg(F.collect_set(F.struct("first", "stop")).alias("spans"))
    spans = stage(spans, "spans")
    discard(copies, several)
    return spans


def remove_repeats(docs: DataFrame, length: int = 100, max_bucket: int = MAX_BUCKET) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    A byte goes when a string of ``length`` bytes that covers it also starts earlier, in a document with a smaller
    doc_id or further ahead in the same one. Matches never cross documents, overlaps count, and strings are judged on
    the input. Null text counts as empty. Texts shorter than the length lose nothing; a text of any length is read whole.
    A row with null doc_id is kept whole. Rows that repeat a doc_id with the same text are one document and get equal
    results; with another text they are documents of their own, and of those under one doc_id the order is that of a
    hash. Extra columns are ignored; an empty table gives an empty table.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = stage(docs.select("doc_id", F.sha2(text, 256).alias("sha"), F.octet_length(text).cast("long").alias("n_bytes")), "digests")
    spans = repeated_spans(docs, length, max_bucket)
    changed = docs.select("doc_id", text.alias("text"), F.sha2(text, 256).alias("sha"), _row()).join(spans, ["doc_id", "row"])
    changed = changed.select("doc_id", "text", "spans", "sha").mapInArrow(
        _removal_batches(), "doc_id long, sha string, n_removed long, n_spans long, kept_sha256 string"
    )
    changed = stage(changed, "changed").dropDuplicates(["doc_id", "sha"])
    originals = stage(rows.groupBy("sha").agg(F.min("doc_id").alias("original")), "originals")
    out = rows.join(originals, "sha").join(changed, ["doc_id", "sha"], "left")
    copy = (F.col("doc_id") > F.col("original")) & (F.col("n_bytes") >= length)
    return out.select(
        "doc_id",
        "n_bytes",
        F.when(copy, F.col("n_bytes")).otherwise(F.coalesce("n_removed", F.lit(0))).cast("long").alias("n_removed"),
        F.when(copy, F.lit(1)).otherwise(F.coalesce("n_spans", F.lit(0))).cast("long").alias("n_spans"),
        F.when(copy, F.lit(hashlib.sha256().hexdigest())).otherwise(F.coalesce("kept_sha256", "sha")).alias("kept_sha256"),
    )
