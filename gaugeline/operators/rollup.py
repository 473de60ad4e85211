"""Aggregation of windows, retention by data class, counter increments and time in states."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .timeline import lag_bucketed

CHANNEL = ["id_do_dispositivo", "id_da_sessao_de_boot", "modulo", "canal"]


def reaggregate(rows: DataFrame, keys: list[str], bucket: str = "1 hour") -> DataFrame:
    """Windows of (quantidade, minimo, maximo, media, valor_eficaz) joined into larger ones, means weighted by count."""
    n = F.sum("quantidade")
    grouped = rows.groupBy(*keys, F.window("instante_observado", bucket).start.alias("janela"))
    return grouped.agg(
        n.alias("quantidade"), F.min("minimo").alias("minimo"), F.max("maximo").alias("maximo"),
        (F.sum(F.col("media") * F.col("quantidade")) / n).alias("media"),
        F.sqrt(F.sum(F.col("valor_eficaz") ** 2 * F.col("quantidade")) / n).alias("valor_eficaz"),
    )


def reaggregate_by_end(rows: DataFrame, keys: list[str], end: str, bucket_ms: int = 3_600_000) -> DataFrame:
    """The same for windows of which ``end`` is the end, as a source's uptime states it, and janela_ms the length. A window
    that crosses the edge of a bucket counts in each by its share of the length, so quantidade is a number of samples with
    a fraction; its minimum and maximum count in all of them."""
    stop = F.unix_millis(end)
    spans = rows.withColumn("_stop", stop).withColumn("_start", stop - F.greatest("janela_ms", F.lit(1)))
    number = F.explode(F.sequence(F.floor(F.col("_start") / bucket_ms), F.floor((F.col("_stop") - 1) / bucket_ms)))
    parts = spans.withColumn("_bucket", number)
    inside = F.least(F.col("_stop"), (F.col("_bucket") + 1) * bucket_ms) - F.greatest(F.col("_start"), F.col("_bucket") * bucket_ms)
    parts = parts.withColumn("_n", F.col("quantidade") * inside / (F.col("_stop") - F.col("_start")))
    n = F.sum("_n")
    return parts.groupBy(*keys, F.timestamp_millis(F.col("_bucket") * bucket_ms).alias("janela")).agg(
        n.alias("quantidade"), F.min("minimo").alias("minimo"), F.max("maximo").alias("maximo"),
        (F.sum(F.col("media") * F.col("_n")) / n).alias("media"), F.sqrt(F.sum(F.col("valor_eficaz") ** 2 * F.col("_n")) / n).alias("valor_eficaz"),
    )


#: What a roll-up keeps of a group, so that groups can be joined later without the rows.
PARTS = ("quantidade", "soma", "quadrados", "minimo", "maximo")


def day_parts(readings: DataFrame, keys: list[str]) -> DataFrame:
    """Per day, hour and keys of numeric samples: number, sum, sum of squares, minimum and maximum."""
    v = F.col("valor_numerico")
    rows = readings.filter((F.col("classe_de_dado") == "sample") & v.isNotNull())
    return rows.groupBy(*keys, F.to_date("instante_observado").alias("dia"), F.date_trunc("hour", "instante_observado").alias("hora")).agg(
        F.count(F.lit(1)).alias("quantidade"), F.sum(v).alias("soma"), F.sum(v * v).alias("quadrados"), F.min(v).alias("minimo"), F.max(v).alias("maximo")
    )


def merge_parts(parts: DataFrame, keys: list[str]) -> DataFrame:
    """Parts of finer groups joined into coarser ones: columns of PARTS, mean and root mean square."""
    out = parts.groupBy(*keys).agg(*[(F.min if c == "minimo" else F.max if c == "maximo" else F.sum)(c).alias(c) for c in PARTS])
    n = F.col("quantidade")
    return out.withColumns({"media": F.col("soma") / n, "valor_eficaz": F.sqrt(F.col("quadrados") / n)})


def write_days(readings: DataFrame, days: list[str], path: str, keys: list[str]) -> None:
    """Compute the roll-up of some days, and of no other, from all readings of those days, and put it in the place of what
    the table has of them: in whatever order days come, and however often, the table ends the same."""
    own = readings.filter(F.to_date("instante_observado").isin([F.lit(d).cast("date") for d in days]))
    parts = day_parts(own, keys)
    parts.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dia").parquet(path)


def retain(readings: DataFrame, now, raw_days: int = 7, sample_days: int = 365, event_days: int = 1825) -> tuple[DataFrame, DataFrame]:
    """Raw rows that stay, and hourly sums of numeric samples older than the raw period."""
    age = F.datediff(F.lit(now).cast("timestamp"), F.col("instante_observado"))
    sample = F.col("classe_de_dado") == "sample"
    raw = readings.filter(F.when(sample, age <= raw_days).otherwise(age <= event_days))
    old = readings.filter(sample & (age > raw_days) & (age <= sample_days) & F.col("valor_numerico").isNotNull())
    keys = ["id_do_dispositivo", "id_do_ponto_de_medicao", "nome_do_campo"]
    hourly = old.groupBy(*keys, F.date_trunc("hour", "instante_observado").alias("hora")).agg(
        F.count(F.lit(1)).alias("quantidade"), F.min("valor_numerico").alias("minimo"), F.max("valor_numerico").alias("maximo"), F.avg("valor_numerico").alias("media")
    )
    return raw, hourly


def increments(counters: DataFrame) -> DataFrame:
    """Pieces since the reading before in the session; the first counts from zero, so a lost reading heals."""
    w = Window.partitionBy(*CHANNEL).orderBy("numero_de_sequencia")
    return counters.withColumn("incremento", F.col("contagem_acumulada") - F.coalesce(F.lag("contagem_acumulada").over(w), F.lit(0)))


def increments_bucketed(counters: DataFrame, width: int = 1_000_000) -> DataFrame:
    """The same increments for channels with too many readings for one task, in buckets of sequences."""
    rows = lag_bucketed(counters, CHANNEL, "contagem_acumulada", "numero_de_sequencia", [], width, "_before")
    return rows.withColumn("incremento", F.col("contagem_acumulada") - F.coalesce("_before", F.lit(0))).drop("_before")


def time_in_state(states: DataFrame, subject: str) -> DataFrame:
    """Milliseconds that each subject spent in each state between transitions; the last interval is open and not counted."""
    w = Window.partitionBy(subject).orderBy("instante_observado", "id_da_sessao_de_boot", "numero_de_sequencia")
    rows = states.withColumn("_until", F.lead("instante_observado").over(w)).filter("_until IS NOT NULL")
    return rows.groupBy(subject, "estado").agg(F.sum(F.unix_millis("_until") - F.unix_millis("instante_observado")).alias("duracao_ms"), F.count(F.lit(1)).alias("intervalos"))


def time_in_state_bucketed(states: DataFrame, subject: str) -> DataFrame:
    """The same times for subjects with too many transitions for one task: inside days, then the last transition of each
    day until the first of the next day with any."""
    order = ["instante_observado", "id_da_sessao_de_boot", "numero_de_sequencia"]
    days = states.withColumn("_dia", F.to_date("instante_observado"))
    inner = Window.partitionBy(subject, "_dia").orderBy(*order)
    rows = days.withColumn("_until", F.lead("instante_observado").over(inner))
    firsts = days.groupBy(subject, "_dia").agg(F.min("instante_observado").alias("_first"))
    following = firsts.select(subject, "_dia", F.lead("_first").over(Window.partitionBy(subject).orderBy("_dia")).alias("_next"))
    rows = rows.join(following, [subject, "_dia"]).withColumn("_until", F.coalesce("_until", "_next")).filter("_until IS NOT NULL")
    return rows.groupBy(subject, "estado").agg(F.sum(F.unix_millis("_until") - F.unix_millis("instante_observado")).alias("duracao_ms"), F.count(F.lit(1)).alias("intervalos"))
