"""Filter interaction audit: what five filters remove in every order, alone and together.

A document's failures are five bits, so all orders follow from 32 numbers per part: how many documents each coalition
of filters removes. Differences of coalitions give every step's counts. Shapley values are the solution of a weighted
least squares problem over the coalitions whose values sum to what all filters remove together; its normal equations
are solved exactly, in rationals.
"""

from __future__ import annotations

import json
from fractions import Fraction
from itertools import permutations
from math import comb, factorial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import discard, stage

FILTERS = "ABCDE"
FULL = (1 << len(FILTERS)) - 1
ORDERS = factorial(len(FILTERS))
#: What is counted of every coalition: documents, those of good quality, toxic ones.
COUNTS = ("n", "good", "toxic")


def _mask(text: Column) -> Column:
    """Bits of the failing filters A to D of a text."""
    words = F.regexp_extract_all(text, F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))
    number = F.size(words)
    fails = (
        number < 50,
        F.lit(100) * F.size(F.array_distinct(words)) < F.lit(65) * number,
        F.lit(100).cast("long") * F.regexp_count(text, F.lit("[A-Z]")) > F.lit(5).cast("long") * F.length(text),
        text.rlike("[#$%&*|]"),
    )
    return sum((F.when(f, 1 << i).otherwise(0) for i, f in enumerate(fails)), F.lit(0))


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(part, mask, n, good, toxic): documents by their part and the bits of all filters that they fail.

    Copies of a text are counted together before they meet, so a frequent text is a few rows; only the smallest doc_id of
    each text is compared between them.
    """
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = docs.select("doc_id", F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"), text.alias("text"))
    rows = rows.select("doc_id", "part", F.unhex(F.sha2("text", 256)).alias("key"), _mask(F.col("text")).alias("mask"))
    known = labels.filter("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("_id"), F.lit(0).cast("long").alias("_salt"))
    known = known.agg(*[F.max(F.coalesce(F.col(c) == 1, F.lit(False)).cast("long")).alias(name) for c, name in (("quality", "good"), ("toxic", "toxic"))])
    # Rows without doc_id have no label; their key spreads them over the join.
    salt = F.when(F.col("doc_id").isNull(), F.xxhash64("key")).otherwise(0)
    marked = rows.withColumn("_own", salt).join(known, (F.col("doc_id") == F.col("_id")) & (F.col("_own") == F.col("_salt")), "left")
    marked = marked.groupBy("key", "part", "mask", "doc_id").agg(
        F.count(F.lit(1)).alias("n"), *[F.sum(F.coalesce(c, F.lit(0))).alias(c) for c in COUNTS[1:]]
    )
    count = F.struct(*COUNTS)
    nameless = F.col("doc_id").isNull()
    texts = marked.groupBy("key", "part", "mask").agg(
        F.min("doc_id").alias("first"), F.min_by(count, "doc_id").alias("of_first"), *[F.sum(c).alias(c) for c in COUNTS],
        *[F.sum(F.when(nameless, F.col(c)).otherwise(0)).alias(f"{c}_null") for c in COUNTS],
    )
    texts = stage(texts, "texts")
    smallest = texts.groupBy("key").agg(F.min("first").alias("smallest"))
    both = texts.join(smallest, "key")
    original = {c: F.when(F.col("first") == F.col("smallest"), F.col(f"of_first.{c}")).otherwise(0) + F.col(f"{c}_null") for c in COUNTS}
    split = F.array(
        F.struct("mask", *[original[c].alias(c) for c in COUNTS]),
        F.struct((F.col("mask") + (1 << FILTERS.index("E"))).alias("mask"), *[(F.col(c) - original[c]).alias(c) for c in COUNTS]),
    )
    cells = both.select("part", F.explode(split).alias("s")).select("part", "s.*").filter("n > 0")
    cells = stage(cells.groupBy("part", "mask").agg(*[F.sum(c).cast("long").alias(c) for c in COUNTS]), "cells")
    discard(texts)
    return cells


def coalitions(cells: DataFrame) -> DataFrame:
    """(part, n, good, toxic), each an array of 32: what the coalition with that number of filters removes; at 0, where
    nothing is removed, the whole part."""
    every = F.filter(F.sequence(F.lit(0), F.lit(FULL)), lambda s: (s == 0) | (s.bitwiseAND(F.col("mask")) != 0))
    sums = cells.select("part", F.explode(every).alias("s"), *COUNTS).groupBy("part", "s").agg(F.struct(*[F.sum(c).alias(c) for c in COUNTS]).alias("v"))
    table = sums.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("s", "v"))).alias("m"))
    values = F.transform(F.sequence(F.lit(0), F.lit(FULL)), lambda s: F.try_element_at("m", s))
    fill = lambda c: F.transform("v", lambda x: F.coalesce(x[c], F.lit(0).cast("long"))).alias(c)
    return table.select("part", values.alias("v")).select("part", *map(fill, COUNTS))


def shapley_weights() -> list[list[Fraction]]:
    """For each filter the factor of every coalition's removal in the filter's Shapley value.

    Minimise the sum over proper coalitions S of w(S) * (v(S) - sum of phi over S) ** 2, with w(S) = (M - 1) / (C(M, s) *
    s * (M - s)), where the phi of all M filters sum to v(all). The normal equations with a multiplier for that
    constraint have one matrix for all parts; they are solved once for each coalition's unit value.
    """
    m = len(FILTERS)
    proper = range(1, FULL)
    weight = {s: Fraction(m - 1, comb(m, s.bit_count()) * s.bit_count() * (m - s.bit_count())) for s in proper}
    inside = lambda s, i: s >> i & 1
    rows = []
    for i in range(m):
        left = [sum((weight[s] for s in proper if inside(s, i) and inside(s, j)), Fraction(0)) for j in range(m)]
        rows.append([*left, Fraction(1), *(weight[s] * inside(s, i) if s in weight else Fraction(0) for s in range(FULL + 1))])
    rows.append([Fraction(1)] * m + [Fraction(0)] + [Fraction(int(s == FULL)) for s in range(FULL + 1)])
    for at in range(m + 1):
        pivot = next(r for r in range(at, m + 1) if rows[r][at])
        rows[at], rows[pivot] = rows[pivot], rows[at]
        rows[at] = [x / rows[at][at] for x in rows[at]]
        for r in range(m + 1):
            if r != at and rows[r][at]:
                rows[r] = [x - rows[r][at] * y for x, y in zip(rows[r], rows[at])]
    return [row[m + 1 :] for row in rows[:m]]


def _steps() -> list[dict]:
    """All steps of all orders: the filter's number and the filters before it."""
    out = []
    for order in permutations(range(len(FILTERS))):
        name, before = "".join(FILTERS[i] for i in order), 0
        for step, i in enumerate(order, 1):
            out.append({"filter_order": name, "step": step, "own": i, "before": before})
            before |= 1 << i
    return out


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per part, filter_order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley.

    Parts are the values of source, null and the empty string being one part. Filters: A under 50 words, B fewer than 65
    distinct words in 100, C more than 5 letters A-Z in 100 code points, D a special sign, E a text that a smaller doc_id
    has too, wherever it is. Null text counts as empty: it fails A, and E beside a smaller empty one. A null doc_id is not
    smaller than another and fails no E, and has no label. Rows that repeat a doc_id count one by one; of equal texts those
    under the smallest doc_id pass E together. Repeated labels count as good or toxic if one of them is. shapley is the
    sum over the 120 orders. Extra columns are ignored; an empty table gives an empty table. Everything beyond the
    failures is a few dozen rows per part.
    """
    factor = [[int(ORDERS * x) for x in row] for row in shapley_weights()]
    dot = lambda own: F.aggregate(F.zip_with("n", F.array(*[F.lit(x).cast("long") for x in factor[own]]), lambda v, x: v * x), F.lit(0).cast("long"), lambda a, x: a + x)
    table = coalitions(failures(docs, labels)).withColumn("values", F.array(*map(dot, range(len(FILTERS)))))
    steps = F.from_json(F.lit(json.dumps(_steps())), "array<struct<filter_order:string,step:int,own:int,before:int>>")
    rows = table.select("*", F.explode(steps).alias("at")).select("part", *COUNTS, "values", "at.*")
    bit = F.element_at(F.array(*[F.lit(1 << i) for i in range(len(FILTERS))]), F.col("own") + 1)
    rows = rows.withColumn("after", F.col("before") + bit).withColumn("bit", bit)
    # At 0 the arrays hold the whole part, which an empty coalition does not remove.
    gone = lambda c, s: F.when(s == 0, 0).otherwise(F.get(c, s))
    step = lambda c: F.get(c, F.col("after")) - gone(c, F.col("before"))
    return rows.select(
        "part", "filter_order", "step",
        (F.get("n", F.lit(0)) - F.get("n", F.col("after"))).alias("kept"),
        step("n").alias("removed"),
        (F.get("n", F.col("bit")) - step("n")).alias("redundant"),
        (F.get("n", F.lit(FULL)) - F.get("n", F.lit(FULL) - F.col("bit"))).alias("unique_fails"),
        step("good").alias("good_lost"),
        step("toxic").alias("toxic_lost"),
        F.get("values", F.col("own")).alias("shapley"),
    )


ORACLE_SQL = r"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS x, coalesce(source, '') AS part FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS words, min(doc_id) OVER (PARTITION BY x) AS first FROM t),
l AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS bad FROM labels GROUP BY 1),
f AS (SELECT part, coalesce(good, FALSE) AS good, coalesce(bad, FALSE) AS bad,
  CASE WHEN len(words) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * list_unique(words) < 65 * len(words) THEN 'B' ELSE '' END
  || CASE WHEN 100 * length(regexp_replace(x, '[^A-Z]', '', 'g')) > 5 * length(x) THEN 'C' ELSE '' END
  || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END || CASE WHEN w.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN l USING (doc_id)),
m AS (SELECT part, fails, count(*) AS n, count(*) FILTER (good) AS g, count(*) FILTER (bad) AS b FROM f GROUP BY 1, 2),
u AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS c),
o AS (SELECT v.c || w.c || x.c || y.c || z.c AS filter_order FROM u v, u w, u x, u y, u z WHERE len(list_distinct([v.c, w.c, x.c, y.c, z.c])) = 5),
r AS (SELECT part, filter_order, fails, n, g, b, CASE WHEN fails = '' THEN 9 ELSE list_min(list_transform(string_split(fails, ''), lambda c: strpos(filter_order, c))) END AS hit
  FROM m, o),
s AS (SELECT part, filter_order, CAST(step AS INTEGER) AS step, filter_order[step] AS own,
  CAST(sum(n) FILTER (hit > step) AS BIGINT) AS kept, CAST(sum(n) FILTER (hit = step) AS BIGINT) AS removed,
  CAST(sum(n) FILTER (hit < step AND contains(fails, filter_order[step])) AS BIGINT) AS redundant, CAST(sum(n) FILTER (fails = filter_order[step]) AS BIGINT) AS unique_fails,
  CAST(sum(g) FILTER (hit = step) AS BIGINT) AS good_lost, CAST(sum(b) FILTER (hit = step) AS BIGINT) AS toxic_lost
  FROM r, unnest([1, 2, 3, 4, 5]) AS q(step) GROUP BY ALL)
SELECT part, filter_order, step, coalesce(kept, 0) AS kept, coalesce(removed, 0) AS removed, coalesce(redundant, 0) AS redundant, coalesce(unique_fails, 0) AS unique_fails,
 coalesce(good_lost, 0) AS good_lost, coalesce(toxic_lost, 0) AS toxic_lost, CAST(sum(coalesce(removed, 0)) OVER (PARTITION BY part, own) AS BIGINT) AS shapley FROM s"""
