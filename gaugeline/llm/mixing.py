"""Mixing sources to target weights by weighted fair queueing, with DataFrame functions only.

Every source is a flow of its documents in shuffled order, repeated as often as its target asks. A document's virtual
finish time is the number of words its source has served by its end, divided by the source's target, so every source
reaches time 1 when it has served its target. A document in service at time 1 is split there into two packets. All
packets are range-sorted by finish time and cut off where the running total reaches the budget.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import discard, stage

#: Rows of a range-sorted part, about.
PART_ROWS = 20_000


def word_count(text: Column) -> Column:
    """Number of maximal stretches without ASCII white space; null counts 0."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """(source, size) to source, source_size, target.

    Sources by code point, null last, take the weights in turn and share ``share`` times all words. A target stops
    at ``most`` times its source's size; the excess goes to the others by weight until none is above. With sources in
    order of size over weight, those that stop are a prefix: the first source whose level, what is left over the
    weights left, does not exceed its own bound ends it.
    """
    per = stage(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), "sources")
    one = F.lit(1).alias("_one")
    # Nulls come last in the order of names: a flag before the name says so.
    named = _sorted(per.select("*", one, F.col("source").isNull().alias("_null")), ["_null", "source"])
    named = _running(named, ["_one"], ["_null", "source"], "_one", "_place")
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_place") % len(weights) + 1).cast("int"))
    weighed = named.select("source", "source_size", "_null", "_one", weight.alias("weight"), (most * F.col("source_size")).alias("cap"))
    weighed = stage(weighed.withColumn("_bound", F.col("cap") / F.col("weight")), "weighed")
    order = ["_bound", "_null", "source"]
    rows = _sorted(weighed, order)
    rows = stage(_running(_running(rows, ["_one"], order, "cap", "_caps"), ["_one"], order, "weight", "_weights"), "levels")
    total = rows.agg(F.sum("source_size").alias("_words"), F.sum("weight").alias("_all")).first()
    left = F.lit(share * (total["_words"] or 0)) - F.col("_caps")
    rows = rows.withColumn("level", left / (F.lit(total["_all"]) - F.col("_weights")))
    # The level of the first source that does not stop; null where all stop.
    water = rows.filter(F.col("level") * F.col("weight") <= F.col("cap")).agg(F.min(F.struct(*order, "level")).alias("at")).first()["at"]
    target = F.col("cap") if water is None else F.least(F.lit(water["level"]) * F.col("weight"), F.col("cap"))
    return rows.select("source", "source_size", target.cast("double").alias("target"))


def _sorted(df: DataFrame, order: list[str]) -> DataFrame:
    """The table range-sorted, with the number of the part in which each row lies as _part. Parts are cut at ties too
    where ``order`` tells the rows apart; results do not depend on where they are cut. ``df`` is computed three times, so
    it is to follow from a staged table at little cost."""
    parts = max(1, df.count() // PART_ROWS)
    return stage(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()), "sorted")


def _running(df: DataFrame, keys: list[str], order: list[str], size: str, out: str) -> DataFrame:
    """Sum of ``size`` over the rows before each row within keys, from a table sorted by keys and order."""
    totals = df.groupBy(*keys, "_part").agg(F.sum(size).alias("_sum"))
    ahead = Window.partitionBy(*keys).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    totals = totals.withColumn("_ahead", F.coalesce(F.sum("_sum").over(ahead), F.lit(0))).drop("_sum")
    totals = totals.select(*[F.col(k).alias(f"_{k}") for k in [*keys, "_part"]], "_ahead")
    inner = Window.partitionBy(*keys, "_part").orderBy(*order)
    within = F.coalesce(F.sum(size).over(inner.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    same = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*keys, "_part"]]
    joined = df.withColumn("_within", within).join(totals, same)
    return joined.withColumn(out, F.col("_ahead") + F.col("_within")).drop("_ahead", "_within", *[f"_{k}" for k in [*keys, "_part"]])


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), share: float = 1.5, most: int = 2, seed: int = 42, carry: tuple[str, ...] = ()) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken, source, and the columns of ``carry``.

    taken is the number of words the mix takes from the document, repeats counted, at most ``most`` times its size.
    Each source's taken words come to its target but for rounding. Order within a source is a hash of doc_id, ties by
    doc_id, size and ``carry``, so reruns agree and repeated rows, alike in all that is returned, may stand in for each other.
    Null or blank text has size 0 and gives nothing; null source and null doc_id are values like any other. A table
    without words has targets 0; an empty table gives an empty table. Texts of any length are counted whole. Extra
    columns are ignored.
    """
    sized = stage(docs.select("doc_id", F.col("source").cast("string").alias("source"), word_count(F.col("text")).alias("size"), *carry), "sizes")
    goals = stage(targets(sized, weights, share, float(most)), "targets")
    rows = sized.withColumn("_hash", F.xxhash64(F.coalesce("doc_id", F.lit(-1)), F.lit(seed)))
    order = ["_hash", "doc_id", "size", *carry]
    line = _sorted(rows, ["source", *order])
    served = _running(line, ["source"], order, "size", "_before")
    place = Window.partitionBy("source", "_part").orderBy(*order)
    served = served.withColumn("_rank", F.row_number().over(place))
    own = goals.select(F.col("source").alias("_source"), "source_size", "target")
    # One row per source: small enough to broadcast in most tables, and Spark checks its size before it does.
    served = stage(served.join(own, F.col("source").eqNullSafe(F.col("_source"))).drop("_source"), "served")
    discard(sized, line)

    # A source's words before and after each round of a document, in whole words of its target.
    goal = F.round("target").cast("long")
    rounds = F.explode(F.sequence(F.lit(0), F.lit(most - 1))).alias("_round")
    packets = served.filter("size > 0 AND target > 0").select("*", rounds)
    begin = F.col("_round") * F.col("source_size") + F.col("_before")
    packets = packets.withColumn("_goal", goal).withColumn("_begin", begin).withColumn("_end", begin + F.col("size"))
    # The document in service at time 1 is split there.
    bounds = F.when((F.col("_begin") < F.col("_goal")) & (F.col("_end") > F.col("_goal")), F.array("_begin", "_goal", "_end")).otherwise(F.array("_begin", "_end"))
    packets = packets.withColumn("_bounds", bounds).select("*", F.explode(F.sequence(F.lit(1), F.size("_bounds") - 1)).alias("_piece"))
    stop = F.element_at("_bounds", F.col("_piece") + 1)
    words = stop - F.element_at("_bounds", F.col("_piece"))
    packets = packets.select("source", F.col("_part").alias("_of"), "_rank", words.alias("_words"), (stop / F.col("target")).alias("_finish"))
    # A goal is its target rounded, so goals of a word or more are served by time 2 and fill the budget: later packets
    # get nothing and need no place in the line.
    packets = packets.filter("_finish <= 2").withColumn("_one", F.lit(1))
    # Of one source no two packets finish together.
    order = ["_finish", "source"]
    queue = _sorted(packets, order)
    line = _running(queue, ["_one"], order, "_words", "_start")
    total = goals.agg(F.sum(goal)).first()[0] or 0
    kept = F.greatest(F.lit(0), F.least(F.col("_words"), F.lit(int(total)) - F.col("_start")))
    taken = line.groupBy("source", "_of", "_rank").agg(F.sum(kept).alias("taken"))
    taken = stage(taken.select(F.col("source").alias("_s"), "_of", F.col("_rank").alias("_place"), "taken"), "taken")
    discard(queue)
    on = F.col("source").eqNullSafe(F.col("_s")) & (F.col("_part") == F.col("_of")) & (F.col("_rank") == F.col("_place"))
    return served.join(taken, on, "left").select(
        "doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"), "source", *carry
    )
