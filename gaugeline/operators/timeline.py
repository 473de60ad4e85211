"""Clocks of a boot session: anchors, estimates, clock steps, gaps and pauses."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

SESSION = ["id_do_dispositivo", "id_da_sessao_de_boot"]


def anchors(journal: DataFrame) -> DataFrame:
    """The first record of each session by arrival; never changed afterwards."""
    return journal.groupBy(*SESSION).agg(F.min_by(F.struct("tempo_ligado_ms", "instante_observado"), "id").alias("a")).select(
        *SESSION, F.col("a.tempo_ligado_ms").alias("ancora_ms"), F.col("a.instante_observado").alias("instante_da_ancora")
    )


def arrival_ordinals(rows: DataFrame, instant: str, ties: list[str], slice_ms: int = 1000) -> DataFrame:
    """Adds _ordinal, from 1 without gaps, by ``instant`` and then ``ties``; together these tell rows apart.

    The order is cut into slices of time, so no task sorts more than one: rows are numbered inside slices, and slices take
    their offsets from running totals, first inside stretches of ten thousand slices and then over the stretches. Nothing
    depends on how rows lie in partitions, so a repeated batch gets the same numbers. Null instants come first.
    """
    rows = rows.withColumn("_slice", F.floor(F.unix_millis(instant) / slice_ms)).withColumn("_stretch", F.floor(F.col("_slice") / 10_000))
    sizes = rows.groupBy("_stretch", "_slice").agg(F.count(F.lit(1)).alias("_size"))
    stretches = sizes.groupBy("_stretch").agg(F.sum("_size").alias("_sum"))
    before = lambda *keys: Window.partitionBy(*keys[:-1]).orderBy(keys[-1]).rowsBetween(Window.unboundedPreceding, -1)
    ahead = stretches.select(F.col("_stretch").alias("_of"), F.coalesce(F.sum("_sum").over(before("_stretch")), F.lit(0)).alias("_far"))
    offsets = sizes.withColumn("_near", F.coalesce(F.sum("_size").over(before("_stretch", "_slice")), F.lit(0)))
    offsets = offsets.join(ahead, F.col("_stretch").eqNullSafe(F.col("_of"))).select(F.col("_slice").alias("_at"), (F.col("_near") + F.col("_far")).alias("_offset"))
    inside = F.row_number().over(Window.partitionBy("_slice").orderBy(instant, *ties))
    numbered = rows.withColumn("_inside", inside).join(offsets, F.col("_slice").eqNullSafe(F.col("_at")))
    return numbered.withColumn("_ordinal", F.col("_offset") + F.col("_inside")).drop("_slice", "_stretch", "_inside", "_at", "_offset")


def first_receipts(receipts: DataFrame) -> DataFrame:
    """Anchors with the clocks of the receipt that made them, for ``clock_steps``: the session's first receipt by id."""
    clocks = F.struct("tempo_ligado_ms", F.col("instante").alias("instante_da_ancora"), F.col("decorrido_ns").alias("decorrido_da_ancora_ns"), "id_da_execucao", "id")
    first = receipts.groupBy(*SESSION).agg(F.min_by(clocks, "id").alias("a"))
    return first.select(*SESSION, F.col("a.tempo_ligado_ms").alias("ancora_ms"), "a.instante_da_ancora", "a.decorrido_da_ancora_ns", "a.id_da_execucao", "a.id")


def estimate(journal: DataFrame, anchor: DataFrame) -> DataFrame:
    """Adds instante_estimado; null without an anchor and for an uptime before it."""
    later = F.col("tempo_ligado_ms") >= F.col("ancora_ms")
    at = F.timestamp_millis(F.unix_millis("instante_da_ancora") + F.col("tempo_ligado_ms") - F.col("ancora_ms"))
    return journal.join(anchor, SESSION, "left").withColumn("instante_estimado", F.when(later, at))


def sequence_gaps(journal: DataFrame) -> DataFrame:
    """Missing sequences between kept ones: first, last and number."""
    before = F.lag("numero_de_sequencia").over(Window.partitionBy(*SESSION).orderBy("numero_de_sequencia"))
    rows = journal.select(*SESSION, "numero_de_sequencia", before.alias("_before")).filter("numero_de_sequencia - _before > 1")
    return rows.select(*SESSION, (F.col("_before") + 1).alias("primeira"), (F.col("numero_de_sequencia") - 1).alias("ultima"), (F.col("numero_de_sequencia") - F.col("_before") - 1).alias("perdidos"))


def sequence_gaps_bucketed(journal: DataFrame, width: int = 100_000) -> DataFrame:
    """The same gaps for sessions too long for one window: inside buckets of sequences, then across bucket edges."""
    bucket = F.expr(f"numero_de_sequencia div {width}")
    rows = journal.select(*SESSION, "numero_de_sequencia", bucket.alias("_b"))
    inner = F.lag("numero_de_sequencia").over(Window.partitionBy(*SESSION, "_b").orderBy("numero_de_sequencia"))
    inside = rows.withColumn("_before", inner).select(*SESSION, "_before", F.col("numero_de_sequencia").alias("_at"))
    edges = rows.groupBy(*SESSION, "_b").agg(F.min("numero_de_sequencia").alias("_at"), F.max("numero_de_sequencia").alias("_last"))
    across = edges.withColumn("_before", F.lag("_last").over(Window.partitionBy(*SESSION).orderBy("_b"))).select(*SESSION, "_before", "_at")
    gaps = inside.unionByName(across).filter("_at - _before > 1")
    return gaps.select(*SESSION, (F.col("_before") + 1).alias("primeira"), (F.col("_at") - 1).alias("ultima"), (F.col("_at") - F.col("_before") - 1).alias("perdidos"))


def sampling_pauses(samples: DataFrame, nominal_ms: int, factor: int = 3) -> DataFrame:
    """Largest uptime step between samples of a channel, and whether it exceeds ``factor`` times the nominal one."""
    channel = [*SESSION, "modulo", "canal"]
    step = F.col("tempo_ligado_ms") - F.lag("tempo_ligado_ms").over(Window.partitionBy(*channel).orderBy("tempo_ligado_ms", "numero_de_sequencia"))
    rows = samples.withColumn("_step", step).groupBy(*channel).agg(F.max("_step").alias("maior_passo_ms"))
    return rows.filter("maior_passo_ms IS NOT NULL").withColumn("alarme", F.col("maior_passo_ms") > factor * nominal_ms)


def lag_bucketed(rows: DataFrame, keys: list[str], value: str, order: str, ties: list[str], width: int, out: str) -> DataFrame:
    """Adds the ``value`` of the row before within keys, by a whole number ``order`` and then ``ties``, for keys with too
    many rows for one task: inside buckets of ``order``, and for a bucket's first row from the last row of the nearest
    bucket before it. Only one row per bucket crosses buckets."""
    kept = [F.col(f"`{c}`") for c in rows.columns]
    at = F.struct(order, *ties)
    here = rows.withColumn("_bucket", F.expr(f"{order} div {width}"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order, *ties)
    # A struct tells a null value from no row before.
    here = here.withColumn("_inner", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    last = here.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), at).alias("_last"))
    edge = F.lag("_last").over(Window.partitionBy(*keys).orderBy("_bucket"))
    edges = last.select(*[F.col(k).alias(f"_of_{k}") for k in [*keys, "_bucket"]], edge.alias("_edge"))
    both = here.join(edges, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in [*keys, "_bucket"]])
    return both.select(*kept, F.coalesce("_inner", "_edge")["v"].alias(out))


def sampling_pauses_bucketed(samples: DataFrame, nominal_ms: int, factor: int = 3, width: int = 86_400_000) -> DataFrame:
    """The same pauses for channels with too many samples for one task, in buckets of uptime."""
    channel = [*SESSION, "modulo", "canal"]
    rows = lag_bucketed(samples.select(*channel, "tempo_ligado_ms", "numero_de_sequencia"), channel, "tempo_ligado_ms", "tempo_ligado_ms", ["numero_de_sequencia"], width, "_before")
    steps = rows.groupBy(*channel).agg(F.max(F.col("tempo_ligado_ms") - F.col("_before")).alias("maior_passo_ms"))
    return steps.filter("maior_passo_ms IS NOT NULL").withColumn("alarme", F.col("maior_passo_ms") > factor * nominal_ms)


def clock_steps(receipts: DataFrame, anchor: DataFrame, tolerance_ms: int = 1000) -> DataFrame:
    """Marks receipts whose wall clock has moved away from the monotonic one since the anchor, within one gateway run.
    receipts: session columns, instante, decorrido_ns, id_da_execucao; anchor: instante_da_ancora, decorrido_da_ancora_ns,
    id_da_execucao."""
    a = anchor.select(*SESSION, "instante_da_ancora", "decorrido_da_ancora_ns", F.col("id_da_execucao").alias("_run"))
    wall = (F.unix_micros("instante") - F.unix_micros("instante_da_ancora")) * 1000
    drift = F.abs(wall - (F.col("decorrido_ns") - F.col("decorrido_da_ancora_ns")))
    step = (F.col("id_da_execucao") == F.col("_run")) & (drift > tolerance_ms * 1_000_000)
    return receipts.join(a, SESSION, "left").withColumn("salto_de_relogio", F.coalesce(step, F.lit(False))).drop("_run")


def transitions(rows: DataFrame, keys: list[str], value: str, order: list[str]) -> DataFrame:
    """Rows whose value differs from the one before, and the first of each key."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(*order))
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("_b", before).withColumn("_n", first).filter((F.col("_n") == 1) | ~F.col(value).eqNullSafe(F.col("_b"))).drop("_b", "_n")


def transitions_bucketed(rows: DataFrame, keys: list[str], value: str, order: str, width: int = 1_000_000) -> DataFrame:
    """The same transitions, by a whole number ``order`` that no two rows of a key share, for keys with too many rows for
    one task: inside buckets of ``order``, then each bucket's first row against the last value before it."""
    rows = rows.withColumn("_bucket", F.expr(f"{order} div {width}"))
    last = rows.groupBy(*keys, "_bucket").agg(F.max_by(F.struct(F.col(value).alias("v")), order).alias("_last"))
    across = Window.partitionBy(*keys).orderBy("_bucket")
    edges = last.select(*keys, "_bucket", F.lag("_last").over(across).alias("_edge"))
    inner = Window.partitionBy(*keys, "_bucket").orderBy(order)
    here = rows.withColumn("_inner", F.lag(F.struct(F.col(value).alias("v"))).over(inner))
    found = here.join(edges, [*keys, "_bucket"]).withColumn("_before", F.coalesce("_inner", "_edge"))
    return found.filter(F.col("_before").isNull() | ~F.col(value).eqNullSafe(F.col("_before.v"))).drop("_bucket", "_inner", "_edge", "_before")
