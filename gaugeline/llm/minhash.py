"""Near-duplicate documents by min-max hashing.

Each permutation of a document's shingle hashes gives two signature values, its minimum and its maximum, so half as
many permutations are evaluated as signature values are kept. Bands of these values propose candidates; a link
counts only when the full shingle sets confirm it.

The members of a bucket are compared with its leader first, the one that shares buckets with most others: in a group of
near copies that is the text they come from, so a group costs about one comparison per member. Where a bucket still
holds several components, the members outside its largest one are then compared exactly with all others.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .graph import components
from .shared import Words, byte_codes, carried, discard, lower_table, mix64, stage, text_blocks, white_space

_U = np.uint64
#: A band holds both values of so many permutations; a pair at 0.8 meets in a band with probability 0.8**6.
BAND_PERMUTATIONS = 3
#: With 40 bands a pair at similarity 0.8 is missed with probability 5e-6, one at 0.85 with 2e-9.
BANDS = 40
#: Documents in a block of the exact comparison; buckets with more than so many are divided by rare shingles first.
BLOCK, LARGE = 512, 8192
#: Shingles of a block, about, so that long texts make smaller ones.
BLOCK_SHINGLES = 1_000_000
#: Bytes of a word above which its hash is a digest: a polynomial hash of long words is easily made to collide.
LONG = 32
#: Rows and shingles, about, that a task of the exact comparison holds at once.
PACK_ROWS, PACK_SHINGLES = 1024, 2_000_000


def _digest(data: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(data, digest_size=8, key=b"shingles").digest(), "little")


def _shingles(data: np.ndarray, offsets: np.ndarray, size: int, codes: np.ndarray, lower: np.ndarray, breaks: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Sorted distinct 64-bit shingle hashes of each document of a block; and for sets of one shingle, 0 for others, a
    digest of its words."""
    words = Words(data, offsets, breaks, codes[lower])
    h, first = words.hashes(), words.first
    for w in np.flatnonzero(words.end - words.begin > LONG):
        h[w] = _digest(lower[data[words.begin[w] : words.end[w]]].tobytes())
    keys = np.random.default_rng(7).integers(0, 2**63, size, dtype=np.uint64) * _U(2) + _U(1)
    rolled = np.zeros(max(0, len(h) - size + 1), _U)
    for j in range(size):
        rolled += h[j : j + len(rolled)] * keys[j]
    rolled = mix64(rolled + _U(size))
    out, alone = [], np.zeros(len(first) - 1, _U)
    for d, (a, b) in enumerate(zip(first[:-1].tolist(), first[1:].tolist())):
        if b - a >= size:
            out.append(np.unique(rolled[a : b - size + 1]))
        elif b > a:
            out.append(mix64((h[a:b] * keys[: b - a]).sum(dtype=_U, keepdims=True) + _U(b - a)))
        else:
            out.append(rolled[:0])
        if len(out[-1]) == 1:
            alone[d] = _digest(b" ".join(lower[data[words.begin[w] : words.end[w]]].tobytes() for w in range(a, min(b, a + size))))
    return out, alone


def _set_keys(values: np.ndarray, sizes: np.ndarray, alone: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two hashes of each document's whole shingle set, 128 bits together; 0 for empty sets."""
    full = np.flatnonzero(sizes)
    keys = []
    for salt in (0xA5A5A5A5, 0x3C3C3C3C3C3C3C3C):
        key = np.zeros(len(sizes), _U)
        if len(full):
            starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
            key[full] = mix64(np.add.reduceat(mix64(values ^ _U(salt)), starts) + sizes[full].astype(_U))
        keys.append(key)
    return keys[0].view(np.int64), np.where(sizes == 1, alone, keys[1]).view(np.int64)


def _signature_batches(size: int, bands: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lower, breaks = byte_codes(11), lower_table(), white_space()
        rng = np.random.default_rng(23)
        perms = bands * BAND_PERMUTATIONS
        flips = rng.integers(0, 2**63, perms, dtype=np.uint64)
        odds = rng.integers(0, 2**63, perms, dtype=np.uint64) * _U(2) + _U(1)
        mixers = rng.integers(0, 2**63, (BAND_PERMUTATIONS, 2), dtype=np.uint64) * _U(2) + _U(1)
        for batch in batches:
            ids = batch.column(0)
            for lo, hi, data, offsets in text_blocks(batch.column(1)):
                sets, alone = _shingles(data, offsets, size, codes, lower, breaks)
                sizes = np.array([len(s) for s in sets], np.int64)
                full = np.flatnonzero(sizes)
                values = np.concatenate(sets)
                starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64) if len(full) else full
                key, check = _set_keys(values, sizes, alone)
                hashes = np.zeros((len(full), bands), _U)
                if len(full):
                    buffer = np.empty_like(values)
                    for p in range(perms):
                        np.bitwise_xor(values, flips[p], out=buffer)
                        np.multiply(buffer, odds[p], out=buffer)
                        band, row = divmod(p, BAND_PERMUTATIONS)
                        hashes[:, band] += np.minimum.reduceat(buffer, starts) * mixers[row, 0]
                        hashes[:, band] += np.maximum.reduceat(buffer, starts) * mixers[row, 1]
                    hashes = mix64(hashes + np.arange(1, bands + 1, dtype=_U))
                lengths = np.zeros(len(sets) + 1, np.int64)
                lengths[1:][full] = bands
                yield pa.RecordBatch.from_arrays(
                    [
                        ids.slice(lo, hi - lo),
                        pa.array(sizes),
                        pa.array(key),
                        pa.array(check),
                        pa.ListArray.from_arrays(pa.array(np.cumsum(lengths), pa.int32()), pa.array(hashes.ravel().view(np.int64))),
                        *(c.slice(lo, hi - lo) for c in batch.columns[2:]),
                    ],
                    ["doc_id", "n_shingles", "key", "check", "bands", *batch.schema.names[2:]],
                )

    return run


def _set_batches(size: int):
    """Shingle sets of (id, key, check, text) rows; a text whose own keys are others, under a doc_id that repeats, goes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codes, lower, breaks = byte_codes(11), lower_table(), white_space()
        for batch in batches:
            for lo, hi, data, offsets in text_blocks(batch.column(3)):
                sets, alone = _shingles(data, offsets, size, codes, lower, breaks)
                ids, *asked = (batch.column(i).slice(lo, hi - lo) for i in range(3))
                sizes = np.array([len(s) for s in sets], np.int64)
                own = sizes > 0
                for found, wanted in zip(_set_keys(np.concatenate(sets), sizes, alone), asked):
                    own &= found == wanted.to_numpy()
                if not own.any():
                    continue
                ids, sets = ids.filter(pa.array(own)), [s for s, o in zip(sets, own) if o]
                ends = np.concatenate([[0], np.cumsum(sizes[own])])
                yield pa.RecordBatch.from_arrays(
                    [ids, pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(sets).view(np.int64)))],
                    ["key", "shingles"],
                )

    return run


def signatures(docs: DataFrame, shingle: int = 5, bands: int = BANDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """doc_id, n_shingles, key and check (two hashes of the whole shingle set), the hash of each band (none for empty sets),
    ``carry``."""
    columns = ["doc_id long", "n_shingles long", "key long", "check long", "bands array<long>", *carried(docs, carry)]
    return docs.select("doc_id", F.col("text").cast("string").alias("text"), *carry).mapInArrow(_signature_batches(shingle, bands), ", ".join(columns))


def _close(percent: int):
    """Size bound that any pair with that similarity keeps."""
    return F.expr(f"100 * least(na, nb) >= {percent} * greatest(na, nb)")


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of candidate pairs (a, b, na, nb), those whose full shingle sets are similar enough."""
    one = sets.select(F.col("key").alias("a"), F.col("shingles").alias("sa"))
    two = sets.select(F.col("key").alias("b"), F.col("shingles").alias("sb"))
    shared = F.size(F.array_intersect("sa", "sb"))
    return (
        pairs.join(one, "a").join(two, "b")
        .filter(100 * shared >= percent * (F.col("na") + F.col("nb") - shared))
        .select("a", "b")
    )


def _similar(one: list[np.ndarray], two: list[np.ndarray], percent: int) -> np.ndarray:
    """Which pairs of two lists of shingle sets are linked: shared shingles of all pairs by matrix products."""
    na, nb = (np.array([len(x) for x in side]) for side in (one, two))
    ta, tb = np.concatenate(one), np.concatenate(two)
    ra, rb = np.repeat(np.arange(len(one)), na), np.repeat(np.arange(len(two)), nb)
    common = np.intersect1d(ta, tb)
    same = np.zeros((len(one), len(two)), np.float32)
    if len(common):
        ca, cb = np.searchsorted(common, ta), np.searchsorted(common, tb)
        ia = common[np.minimum(ca, len(common) - 1)] == ta
        ib = common[np.minimum(cb, len(common) - 1)] == tb
        ra, ca, rb, cb = ra[ia], ca[ia], rb[ib], cb[ib]
        for at in range(0, len(common), 4096):
            width = min(4096, len(common) - at)
            left, right = np.zeros((len(one), width), np.float32), np.zeros((len(two), width), np.float32)
            pa_, pb_ = (ca >= at) & (ca < at + width), (cb >= at) & (cb < at + width)
            left[ra[pa_], ca[pa_] - at] = 1
            right[rb[pb_], cb[pb_] - at] = 1
            same += left @ right.T
    return 100 * same >= percent * (na[:, None] + nb[None, :] - same)


def _block_links(percent: int):
    """Links between the blocks i and j of each bucket in a pack; of those found only as many as it takes to join the
    components they connect. Rows go by key, so a rerun finds the same links."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        found_a, found_b = [], []
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while root.get(x, x) != x:
                x = root[x]
            return x

        for (_, i, j), part in rows.sort_values("key", kind="stable").groupby(["bucket", "i", "j"], sort=True):
            one, two = part[part["block"] == i], part[part["block"] == j]
            if not len(one) or not len(two):
                continue
            comp_a, comp_b = one["comp"].to_numpy(), two["comp"].to_numpy()
            linked = _similar(one["shingles"].to_list(), two["shingles"].to_list(), percent) & (comp_a[:, None] != comp_b[None, :])
            key_a, key_b = one["key"].to_numpy(), two["key"].to_numpy()
            for r, c in zip(*np.nonzero(linked)):
                x, y = top(comp_a[r]), top(comp_b[c])
                if x != y:
                    root[max(x, y)] = min(x, y)
                    found_a.append(key_a[r])
                    found_b.append(key_b[c])
        return pd.DataFrame({"a": np.array(found_a, np.int64), "b": np.array(found_b, np.int64)})

    return run


def _unsettled(members: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Rows of (bucket, key, n, weight) in buckets that hold several components, with the component so far of each key
    and the number of members. Of buckets with the same members one is enough."""
    comp = F.col("key")
    if labels is not None:
        members, comp = members.join(labels, members.key == labels.node, "left"), F.coalesce("comp", "key")
    known = stage(members.select("bucket", "key", "n", "weight", comp.alias("comp")), "known")
    who = F.struct(F.sum(F.xxhash64("key") % (1 << 40)), F.bit_xor(F.xxhash64("key", F.lit(1)))).alias("who")
    every = known.groupBy("bucket").agg(F.min("comp").alias("x"), F.max("comp").alias("y"), F.count(F.lit(1)).alias("members"), who)
    one = every.filter("x < y").groupBy("members", "who").agg(F.min("bucket").alias("bucket")).select("bucket", "members")
    # Staged, so that Spark can split the join at a bucket with very many members.
    one = stage(one, "unsettled")
    rows = stage(known.join(one, "bucket"), "mixed")
    discard(known, one)
    return rows


def _leader_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of each bucket's leader, the key with the largest weight, and its other members."""
    best = F.struct("weight", "key")
    lead = rows.groupBy("bucket").agg(F.max_by(F.struct(F.col("key").alias("a"), F.col("n").alias("na")), best).alias("lead"))
    lead = stage(lead.select("bucket", "lead.*"), "leaders")
    pairs = rows.join(lead, "bucket").filter("key <> a").select("a", F.col("key").alias("b"), "na", F.col("n").alias("nb"))
    pairs = stage(pairs.filter(_close(percent)).distinct(), "pairs")
    discard(lead)
    return pairs


def _by_rare_shingles(large: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Divide large buckets: (bucket, key, n, weight) rows whose buckets are those of a bucket and one of its shingles.

    A set of n shingles that is linked with another shares one of its first n - ceil(percent * n / 100) + 1 shingles
    with it, in any order that is the same for both. With the rarest of the bucket first, these are seldom shared by
    texts that merely follow one pattern, so no link is lost and few pairs are left. Shingles of one member go.
    """
    full = large.join(sets, "key").select("bucket", "key", "n", "weight", F.explode("shingles").alias("shingle"))
    often = stage(full.groupBy("bucket", "shingle").agg(F.count(F.lit(1)).alias("times")), "often")
    rarest = Window.partitionBy("bucket", "key").orderBy("times", "shingle")
    first = F.col("n") - F.ceil(F.col("n") * percent / F.lit(100)) + 1
    rows = full.join(often, ["bucket", "shingle"]).withColumn("place", F.row_number().over(rarest)).filter((F.col("place") <= first) & (F.col("times") > 1))
    return rows.select(F.xxhash64("bucket", "shingle").alias("bucket"), "key", "n", "weight")


def _links_inside(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between members of one bucket that lie in different components so far, from (bucket, key, n, comp, members).

    Members outside the bucket's largest component are cut into blocks, and so is that component. Each of the former
    blocks is compared exactly with all blocks: memory is bounded, and only links leave the task, never the pairs
    compared. Small buckets share a task.
    """
    def blocks(members: Column, shingles: Column) -> Column:
        return F.greatest(F.ceil(members / BLOCK), F.ceil(shingles / BLOCK_SHINGLES)).cast("int")

    parts = rows.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("own"), F.sum("n").alias("mass")).groupBy("bucket")
    most = parts.agg(F.max(F.struct("own", "comp", "mass")).alias("most"), F.sum("own").alias("all"), F.sum("mass").alias("weighs"))
    out = blocks(F.col("all") - F.col("most.own"), F.col("weighs") - F.col("most.mass")).alias("outside")
    most = stage(most.select("bucket", F.col("most.comp").alias("largest"), out, blocks(F.col("most.own"), F.col("most.mass")).alias("within")), "largest")
    dealt = rows.join(most, "bucket")
    inside = F.col("comp") == F.col("largest")
    count = F.when(inside, F.col("within")).otherwise(F.col("outside"))
    block = F.when(inside, F.col("outside")).otherwise(0) + F.pmod(F.xxhash64("key"), count).cast("int")
    dealt = dealt.withColumn("block", block)
    others = F.when(inside, F.col("outside")).otherwise(F.col("outside") + F.col("within"))
    dealt = dealt.select("*", F.explode(F.sequence(F.lit(0), others - 1)).alias("other"))
    dealt = dealt.withColumn("i", F.least("block", "other")).withColumn("j", F.greatest("block", "other"))
    size = dealt.agg(F.count(F.lit(1)), F.coalesce(F.sum("n"), F.lit(0))).first()
    packs = max(1, size[0] // PACK_ROWS, size[1] // PACK_SHINGLES)
    dealt = dealt.select("bucket", "i", "j", "block", "key", "comp", F.pmod(F.xxhash64("bucket", "i", "j"), F.lit(packs)).alias("pack"))
    return dealt.join(sets, "key").groupBy("pack").applyInPandas(_block_links(percent), "a long, b long")


def _class_labels(docs: DataFrame, heads: DataFrame, shingle: int, percent: int) -> DataFrame:
    """(node, comp): the component of each class (id, key, check, rep, n, bands) that has a link. From here on a class's
    key is its id."""
    members = heads.select(F.col("id").alias("key"), "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
    sizes = stage(sizes, "sizes")
    shared = stage(members.join(sizes, "bucket"), "buckets")
    weights = stage(shared.groupBy("key").agg(F.sum("size").alias("weight")), "weights")
    rows = shared.join(weights, "key").drop("size")
    texts = heads.join(weights.select(F.col("key").alias("id")), "id").select(F.col("rep").alias("doc_id"), "id", "key", "check")
    sets = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(texts, "doc_id").select("id", "key", "check", "text")
    sets = sets.mapInArrow(_set_batches(shingle), "key long, shingles array<long>")
    # Rows that repeat a doc_id and its text give one set.
    sets = stage(sets.groupBy("key").agg(F.any_value("shingles").alias("shingles")), "sets")

    first = _unsettled(rows, None)
    pairs = _leader_pairs(first, percent)
    links = stage(_confirmed(pairs, sets, percent), "links")
    labels = components(links)

    left = _unsettled(first.drop("comp", "members"), labels)
    found = [_links_inside(left.filter(F.col("members") <= LARGE), sets, percent)]
    large = left.filter(F.col("members") > LARGE)
    divided = [] if large.isEmpty() else [_unsettled(_by_rare_shingles(large, sets, percent), labels)]
    found += [_links_inside(rows, sets, percent) for rows in divided]
    more = stage(reduce(DataFrame.unionByName, found), "more")
    # A component so far counts as a star around its label.
    after = components(more.unionByName(labels.toDF("a", "b")))
    discard(sizes, shared, weights, sets, first, pairs, links, left, labels, more, *divided)
    return after


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept, group_key, and the columns of ``carry``.

    Words are split at ASCII white space and A-Z are lower-cased. A document's set holds its distinct word shingles;
    with fewer words than a shingle the whole sequence is its one member; without words it is empty. Documents are
    linked when ``100 * shared >= percent * united``; component_id is the smallest doc_id reachable over links. group_key,
    a number that may be another in another run, tells components apart even where rows of two texts repeat one doc_id;
    it is null where component_id is, and for empty sets.

    Documents with equal sets, by two hashes of 64 bits, form a class with an id of its own first, so copies are never expanded into pairs, and a class is joined with
    its documents only through tables that Spark can split at a hot key. In each band bucket classes are compared with
    one leader, and only pairs that then still lie in different components of a bucket are compared afterwards, so no
    link between different texts is lost.

    Null or blank text: empty set, linked with nothing. Null doc_id: a row with null component_id, kept. Rows that
    repeat a doc_id stay separate rows, each with the component of its own text. Extra columns are ignored; an empty
    table gives an empty table.
    """
    found = stage(signatures(docs, shingle, bands, carry), "signatures")
    heads = found.filter("n_shingles > 0 AND doc_id IS NOT NULL").groupBy("key", "check")
    # Equal sets have equal sizes and bands, so any row of a class may give them. Ids hold once they are written.
    heads = heads.agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("n"), F.any_value("bands").alias("bands"))
    heads = stage(heads.withColumn("id", F.monotonically_increasing_id()), "classes")
    labels = _class_labels(docs, heads, shingle, percent)

    linked = stage(labels.join(heads.select(F.col("id").alias("node"), "rep"), "node"), "linked")
    lowest = stage(linked.groupBy("comp").agg(F.min("rep").alias("component_id")), "lowest")
    of_link = linked.join(lowest, "comp").select(F.col("node").alias("id"), "component_id", F.col("comp").alias("group_key"))
    of_class = heads.select("id", "key", "check", "rep").join(of_link, "id", "left")
    of_class = stage(of_class.select("key", "check", F.coalesce("component_id", "rep").alias("component_id"), F.coalesce("group_key", "id").alias("group_key")), "groups")
    discard(heads, labels, linked, lowest)
    own = F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    own = F.when(F.col("doc_id").isNotNull(), own)
    return (
        found.select("doc_id", "n_shingles", "key", "check", *carry)
        .join(of_class, ["key", "check"], "left")
        .withColumn("component_id", own)
        .withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))
        .withColumn("group_key", F.when(F.col("doc_id").isNotNull() & (F.col("n_shingles") > 0), F.col("group_key")))
        .select("doc_id", "n_shingles", "component_id", "kept", "group_key", *carry)
    )
