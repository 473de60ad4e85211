"""Questions that dashboards ask of the long table. ``between`` bounds are inclusive; ties are broken before limits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import series_label

SAMPLES = ("amostra_escalar", "leitura_de_contador", "transicao_digital", "amostra_agregada")


def between(readings: DataFrame, start, end) -> DataFrame:
    return readings.filter(F.col("instante_observado").between(F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")))


def field(name: str, column: str = "valor_numerico") -> Column:
    """One field as a column again."""
    return F.max(F.when(F.col("nome_do_campo") == name, F.col(column)))


def records_per_minute(readings: DataFrame) -> DataFrame:
    return readings.groupBy(F.date_trunc("minute", "instante_observado").alias("minuto"), "id_do_dispositivo").agg(F.count(F.lit(1)).alias("registros"))


def silent_hours(readings: DataFrame) -> DataFrame:
    """Every device and hour between its first and last minute with rows: minutes of the hour in that span, silent ones,
    and rows. Silent minutes are what is left of the span, so no row is made for one."""
    minutes = records_per_minute(readings)
    hour = F.date_trunc("hour", "minuto").alias("hora")
    full = minutes.groupBy("id_do_dispositivo", hour).agg(F.count(F.lit(1)).alias("_full"), F.sum("registros").alias("registros"))
    span = minutes.groupBy("id_do_dispositivo").agg(F.min("minuto").alias("_a"), F.max("minuto").alias("_z"))
    hours = F.explode(F.sequence(F.date_trunc("hour", "_a"), F.date_trunc("hour", "_z"), F.expr("INTERVAL 1 HOUR"))).alias("hora")
    spine = span.select("id_do_dispositivo", "_a", "_z", hours)
    last = F.least(F.col("_z"), F.col("hora") + F.expr("INTERVAL 59 MINUTES"))
    count = ((F.unix_seconds(last) - F.unix_seconds(F.greatest("_a", "hora"))) / 60).cast("long") + 1
    rows = spine.join(full, ["id_do_dispositivo", "hora"], "left").withColumn("minutos", count)
    return rows.select("id_do_dispositivo", "hora", "minutos", (F.col("minutos") - F.coalesce("_full", F.lit(0))).alias("silenciosos"), F.coalesce("registros", F.lit(0)).alias("registros"))


def silent_stretches(readings: DataFrame) -> DataFrame:
    """Runs of minutes without rows between two minutes with rows of a device: found from the counted minutes alone, so
    no row is made for a silent one."""
    minutes = readings.select("id_do_dispositivo", F.date_trunc("minute", "instante_observado").alias("minuto")).distinct()
    before = F.lag("minuto").over(Window.partitionBy("id_do_dispositivo").orderBy("minuto"))
    steps = minutes.withColumn("antes", before).withColumn("minutos", ((F.unix_micros("minuto") - F.unix_micros("antes")) / 60_000_000).cast("long") - 1)
    one = F.expr("INTERVAL 1 MINUTE")
    return steps.filter("minutos > 0").select("id_do_dispositivo", (F.col("antes") + one).alias("primeiro"), (F.col("minuto") - one).alias("ultimo"), "minutos")


def discarded(readings: DataFrame) -> DataFrame:
    rows = readings.filter("nome_do_campo = 'discarded_record_count'")
    return rows.groupBy("id_do_dispositivo").agg(F.max("valor_numerico").alias("descartados")).orderBy(F.desc("descartados"), "id_do_dispositivo")


def admitted_gaps(readings: DataFrame, limit: int = 50, per_record: bool = False) -> DataFrame:
    """Newest gaps that sources admit. Gaps of one device received at one instant merge, unless ``per_record``."""
    keys = ["instante_observado", "id_do_dispositivo", *(["id_da_sessao_de_boot", "numero_de_sequencia"] if per_record else [])]
    rows = readings.filter("tipo_de_conteudo = 'lacuna_de_buffer'").groupBy(*keys)
    rows = rows.agg(field("lost_record_count").alias("perdidos"), field("first_lost_sequence").alias("da_sequencia"), field("last_lost_sequence").alias("ate"))
    return rows.orderBy(F.desc("instante_observado"), *keys[1:]).limit(limit)


def unconfigured(readings: DataFrame, limit: int = 50) -> DataFrame:
    """As the dashboards show it: channels of one device within a thousand sequences are merged."""
    rows = readings.filter(F.col("id_do_ponto_de_medicao").isNull() & F.col("tipo_de_conteudo").isin(*SAMPLES))
    rows = rows.withColumn("milhar", F.expr("numero_de_sequencia div 1000")).groupBy("id_do_dispositivo", "milhar")
    rows = rows.agg(field("module_index").alias("modulo"), field("channel_index").alias("canal"), F.count(F.lit(1)).alias("registros"), F.max("instante_observado").alias("ultimo"))
    return rows.orderBy(F.desc("ultimo"), "id_do_dispositivo", "milhar").limit(limit)


def unconfigured_channels(readings: DataFrame) -> DataFrame:
    """Per channel: fields come together per record first, so that no channel hides another."""
    rows = readings.filter(F.col("id_do_ponto_de_medicao").isNull() & F.col("tipo_de_conteudo").isin(*SAMPLES))
    record = rows.groupBy("id_do_dispositivo", "id_da_sessao_de_boot", "numero_de_sequencia", "instante_observado").agg(field("module_index").alias("modulo"), field("channel_index").alias("canal"))
    return record.groupBy("id_do_dispositivo", "modulo", "canal").agg(F.count(F.lit(1)).alias("registros"), F.max("instante_observado").alias("ultimo"))


def out_of_range_points(readings: DataFrame, limit: int = 50) -> DataFrame:
    rows = readings.filter("fora_de_faixa AND nome_do_campo = 'value'").groupBy("id_do_ponto_de_medicao", "grandeza", "unidade")
    rows = rows.agg(F.count(F.lit(1)).alias("ocorrencias"), F.min("valor_numerico").alias("minimo_visto"), F.max("valor_numerico").alias("maximo_visto"))
    return rows.orderBy(F.desc("ocorrencias"), "id_do_ponto_de_medicao").limit(limit)


def declared_sources(readings: DataFrame, latest: bool = False) -> DataFrame:
    """Firmware, hardware and channels per device: the largest texts, or with ``latest`` the last ones."""
    rows = readings.filter("tipo_de_conteudo = 'descritor_da_origem'").groupBy("id_do_dispositivo")

    def text(name: str) -> Column:
        value = F.when(F.col("nome_do_campo") == name, F.col("valor_texto"))
        when = F.when(F.col("nome_do_campo") == name, F.struct("instante_observado", "numero_de_sequencia"))
        return F.max_by(value, when) if latest else F.max(value)

    return rows.agg(text("firmware_version").alias("firmware"), text("hardware_model").alias("hardware"), field("channel_count").alias("canais"), F.max("instante_observado").alias("ultima"))


def points(readings: DataFrame) -> DataFrame:
    return readings.select("id_do_ponto_de_medicao").filter("id_do_ponto_de_medicao IS NOT NULL").distinct().orderBy("id_do_ponto_de_medicao")


def value_series(readings: DataFrame, chosen: list[str] | None = None) -> DataFrame:
    rows = readings.filter("nome_do_campo = 'value' AND id_do_ponto_de_medicao IS NOT NULL")
    rows = rows if chosen is None else rows.filter(F.col("id_do_ponto_de_medicao").isin(*chosen))
    label = series_label(F.col("id_do_ponto_de_medicao"), F.col("unidade"))
    return rows.select("instante_observado", label.alias("serie"), F.col("valor_numerico").alias("valor")).orderBy("instante_observado", "serie")


def state_changes(readings: DataFrame, limit: int = 200) -> DataFrame:
    subject = F.coalesce("id_do_ponto_de_medicao", "id_do_dispositivo")
    rows = readings.filter("nome_do_campo = 'machine_state'").orderBy(F.desc("instante_observado"), "id_do_dispositivo", "id_da_sessao_de_boot", "numero_de_sequencia")
    return rows.limit(limit).select("instante_observado", subject.alias("ponto"), F.col("valor_texto").alias("estado"), F.col("rotulo_do_motivo").alias("motivo"))


def count_series(readings: DataFrame) -> DataFrame:
    subject = F.coalesce("id_do_ponto_de_medicao", "id_do_dispositivo")
    return readings.filter("nome_do_campo = 'accumulated_count'").select("instante_observado", subject.alias("serie"), F.col("valor_numerico").alias("valor")).orderBy("instante_observado", "serie")


def memory_series(readings: DataFrame) -> DataFrame:
    kind = F.when(F.col("nome_do_campo") == "heap_free_bytes", "livre total").otherwise("maior bloco")
    rows = readings.filter(F.col("nome_do_campo").isin("heap_free_bytes", "heap_largest_free_block_bytes"))
    return rows.select("instante_observado", F.concat("id_do_dispositivo", F.lit(" — "), kind).alias("serie"), F.col("valor_numerico").alias("valor")).orderBy("instante_observado", "serie")


def fragmentation(readings: DataFrame) -> DataFrame:
    """Largest block over free memory per health record."""
    rows = readings.filter("tipo_de_conteudo = 'saude_da_origem'").groupBy("id_do_dispositivo", "id_da_sessao_de_boot", "numero_de_sequencia")
    rows = rows.agg(field("heap_free_bytes").alias("livre"), field("heap_largest_free_block_bytes").alias("maior_bloco"))
    return rows.withColumn("razao", F.when(F.col("livre") > 0, F.col("maior_bloco") / F.col("livre")))


def last_samples(addressed: DataFrame) -> DataFrame:
    """The last instant of each channel in journal records with an address (modulo, canal)."""
    rows = addressed.filter("modulo IS NOT NULL").groupBy("id_do_dispositivo", "modulo", "canal")
    return rows.agg(F.max("instante_observado").alias("ultimo"))


def mute_channels(declared: DataFrame, last_samples: DataFrame, now, periods: int = 3) -> DataFrame:
    """Declared channels (id_do_dispositivo, modulo, canal, periodo_ms) silent for more than so many periods. A channel
    without samples is mute; one that declares no period, 0, claims nothing."""
    rows = declared.join(last_samples, ["id_do_dispositivo", "modulo", "canal"], "left")
    age = F.unix_millis(F.lit(now).cast("timestamp")) - F.unix_millis("ultimo")
    return rows.withColumn("mudo", (F.col("periodo_ms") > 0) & F.coalesce(age > periods * F.col("periodo_ms"), F.lit(True)))
