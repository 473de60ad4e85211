"""Packing: bins made one by one, ids by the tokenizers library, and whole sequences put together again."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from gaugeline.llm import packing, queries

DIR = "/root/testdata/sf0.001"
FILE = public_tokenizers.path("word_bpe_49k.json")


def one_by_one(items, capacity):
    """Best two fit on a list of documents, a bin at a time, all pairs tried."""
    left, bins = sorted(items, reverse=True), []
    while left:
        own, gap = [], capacity
        for x in list(left):
            if x <= gap:
                own.append(x)
                left.remove(x)
                gap -= x
        if gap and len(own) > 1:
            room, best, pair = gap + own[-1], own[-1], None
            for i, a in enumerate(left):
                for b in left[i + 1 :]:
                    if best < a + b <= room:
                        best, pair = a + b, (a, b)
            if pair:
                left.append(own.pop())
                left.sort(reverse=True)
                for x in pair:
                    own.append(x)
                    left.remove(x)
        bins.append(sorted(own, reverse=True))
    return bins


def spread(patterns):
    return [[n for n, k in p.items for _ in range(k)] for p in patterns for _ in range(p.times)]


@pytest.mark.parametrize("seed", range(60))
def test_patterns_are_bins_made_one_by_one(seed):
    rng = random.Random(seed)
    capacity = rng.choice((7, 20, 64))
    kinds = [rng.randint(1, capacity) for _ in range(rng.randint(1, 12))]
    items = [rng.choice(kinds) for _ in range(rng.randint(0, 120))]
    counts = {n: items.count(n) for n in set(items)}
    got = spread(packing.best_two_fit(counts, capacity))
    assert got == one_by_one(items, capacity)
    assert sorted(x for b in got for x in b) == sorted(items)


def test_few_patterns_and_full_bins():
    rng = np.random.default_rng(1)
    lengths = np.minimum(2048, (rng.lognormal(6, 1, 300_000)).astype(int) + 1)
    counts = dict(zip(*(x.tolist() for x in np.unique(lengths, return_counts=True))))
    small = packing.best_two_fit(counts)
    assert sum(p.times for p in small) <= -(-int(lengths.sum()) // 2048) * 1.001 + 1
    large = packing.best_two_fit({n: 10**6 * k for n, k in counts.items()})
    assert len(large) < 20_000 and max(sum(n * k for n, k in p.items) for p in large) <= 2048
    with pytest.raises(ValueError):
        packing.best_two_fit({9: 1}, 8)


def by_library(texts):
    tok = Tokenizer.from_file(FILE)
    tok.no_truncation()
    tok.no_padding()
    return [e.ids + [0] for e in tok.encode_batch([t or "" for t in texts], add_special_tokens=False)]


def check(rows, got, capacity):
    """rows: (doc_id, text) with unique ids."""
    ids = dict(zip([i for i, _ in rows], by_library([t for _, t in rows])))
    seen, bins = {}, {}
    for r in got:
        own = ids[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert r["start"] == r["piece"] * capacity and len(own) == r["length"] and r["ids_crc32"] == zlib.crc32(np.array(own, "<u4").tobytes())
        seen.setdefault(r["doc_id"], []).append((r["piece"], r["length"]))
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for i, of in ids.items():
        assert sorted(seen[i]) == [(p, min(capacity, len(of) - p * capacity)) for p in range(-(-len(of) // capacity))]
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return bins


ODD = [(1, None), (2, ""), (3, "a few words"), (4, "word " * 9000), (5, "ÀÉ ß İ ﬁ naïve"), (6, "\U0001f600 fine \U00010d50\U0001ccf0 ͸ odd"), (7, "x" * 30_000), (8, "<|endoftext|> marks"), *((i, "same text here") for i in range(20, 60))]


@pytest.mark.parametrize("capacity", [16, 2048])
def test_pieces_and_places(spark, capacity):
    table = spark.createDataFrame(ODD, "doc_id long, text string").repartition(5).withColumns({c: F.lit(1) for c in ("task", "rank", "length", "n", "piece")})
    got = packing.pack(table, FILE, capacity, keep_ids=True)
    rows = got.collect()
    bins = check(ODD, rows, capacity)
    lengths = [length for own in bins.values() for _, length in own]
    assert sorted(sorted(n for _, n in own)[::-1] for own in bins.values()) == sorted(one_by_one(lengths, capacity))
    whole = {r["sequence_id"]: np.frombuffer(r["ids"], "<u4") for r in packing.sequences(got).collect()}
    for r in rows:
        assert (whole[r["sequence_id"]][r["offset"] : r["offset"] + r["length"]] == np.frombuffer(r["ids"], "<u4")).all()
    assert packing.pack(table.limit(0), FILE).count() == 0


def test_repeated_rows_and_rows_without_id(spark):
    table = spark.createDataFrame([(None, "a b"), (None, "a b"), (3, "c"), (3, "c"), (3, "d e f")], "doc_id long, text string")
    got = packing.pack(table, FILE).collect()
    assert sorted((r["doc_id"] or 0, r["length"]) for r in got) == [(0, 3), (0, 3), (3, 2), (3, 2), (3, 4)]
    assert {r["sequence_id"] for r in got} == {0} and sorted(r["offset"] + r["length"] for r in got)[-1] == 14


def test_query(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{DIR}/documents.parquet").collect()]
    bins = check(rows, queries.op11_packing(spark, DIR).collect(), 2048)
    assert len(bins) <= sum(length for own in bins.values() for _, length in own) / 2048 * 1.01 + 1
