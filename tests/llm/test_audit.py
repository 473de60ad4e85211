"""The filter audit against applying the filters one by one, and its Shapley values against averaging all orders."""

import re
from fractions import Fraction
from itertools import permutations
from math import factorial

import duckdb
import pytest
from pyspark.sql import functions as F

from gaugeline.llm import audit, queries

DIR = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(60))
DOCS = [
    (1, LONG, "a"), (2, LONG, "b"), (2, LONG, "b"), (3, LONG, None), (None, LONG, "a"), (4, None, "a"), (5, "", "b"), (6, None, ""), (7, "A B $ " * 40, "a"), (8, "word " * 60, "b"),
    (9, LONG + " é😀" * 40, "b"), (10, " x " * 55, "c"), (11, LONG.upper(), "c"), (12, LONG.upper(), "c"), (12, "other text under this id", "c"), (None, None, None), (1, LONG, "c"), (13, "y" * 200_000 + " z", "c"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (2, 1, None), (4, 1, 1), (None, 1, 1), (11, None, 1), (12, 1, 0), (99, 1, 1)]


def brute(docs, labels):
    first, good, toxic = {}, set(), set()
    for i, t, _ in docs:
        if i is not None:
            first[t or ""] = min(i, first.get(t or "", i))
    for i, q, x in labels:
        if i is not None:
            good |= {i} if q == 1 else set()
            toxic |= {i} if x == 1 else set()
    rows: dict = {}
    for i, t, s in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        bad = {c for c, f in zip("ABCDE", (len(w) < 50, 100 * len(set(w)) < 65 * len(w), 100 * len(re.findall("[A-Z]", t)) > 5 * len(t), re.search("[#$%&*|]", t), i is not None and i > first[t])) if f}
        rows.setdefault(s or "", []).append((bad, i in good, i in toxic))
    out = []
    for part, members in rows.items():
        per = []
        for order in permutations("ABCDE"):
            left = members
            for step, c in enumerate(order, 1):
                gone, stay = [r for r in left if c in r[0]], [r for r in left if c not in r[0]]
                redundant = sum(c in r[0] for r in members) - len(gone)
                alone = sum(r[0] == {c} for r in members)
                per.append((part, "".join(order), step, len(stay), len(gone), redundant, alone, sum(r[1] for r in gone), sum(r[2] for r in gone)))
                left = stay
        total = {c: sum(r[4] for r in per if r[1][r[2] - 1] == c) for c in "ABCDE"}
        out += [(*r, total[r[1][r[2] - 1]]) for r in per]
    return sorted(out)


def test_against_filters_one_by_one(spark):
    docs = spark.createDataFrame(DOCS, "doc_id long, text string, source string").withColumns({c: F.lit(7) for c in ("part", "mask", "n", "key", "good", "toxic", "first", "_id")})
    labels = spark.createDataFrame(LABELS, "doc_id long, quality int, toxic int").withColumn("part", F.lit("x"))
    got = audit.audit(docs, labels)
    assert sorted(map(tuple, got.collect())) == brute(DOCS, LABELS)
    assert got.columns == ["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"]
    assert audit.audit(docs.limit(0), labels).count() == 0
    assert {(r["good_lost"], r["toxic_lost"]) for r in audit.audit(docs, labels.limit(0)).collect()} == {(0, 0)}


def test_query_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "labels"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DIR}/{t}.parquet'")
    got = queries.op13_filter_audit(spark, DIR)
    want = con.execute(queries.ORACLE_SQL["op13_filter_audit"])
    assert [c[0] for c in want.description] == got.columns and sorted(map(tuple, got.collect())) == sorted(want.fetchall())


def test_shapley_weights_are_those_of_the_definition():
    for i, row in enumerate(audit.shapley_weights()):
        for s, x in enumerate(row):
            size, bit = s.bit_count(), s >> i & 1
            want = Fraction(factorial(size - 1) * factorial(5 - size), 120) if bit else -Fraction(factorial(size) * factorial(4 - size), 120)
            assert x == (want if s else 0)


@pytest.mark.parametrize("part", ["hot"])
def test_a_frequent_text_is_a_few_rows(spark, part):
    docs = spark.range(20_000).select(F.col("id").alias("doc_id"), F.lit("one text").alias("text"), F.lit(part).alias("source"))
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    cells = {r["mask"]: r["n"] for r in audit.failures(docs, labels).collect()}
    assert cells == {1: 1, 17: 19_999}
