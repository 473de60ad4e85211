"""Commissioning: what sources declare against what the installation configures."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import ACTIONS, channel_key, in_force, labels


def latest_descriptors(journal: DataFrame) -> DataFrame:
    """The descriptor with the largest journal id of each device."""
    rows = journal.filter("descritor_da_origem IS NOT NULL")
    return rows.groupBy("id_do_dispositivo").agg(F.max_by(F.struct("descritor_da_origem", "instante_observado", "id"), "id").alias("d")).select(
        "id_do_dispositivo", "d.descritor_da_origem", F.col("d.instante_observado").alias("declarado_em"), "d.id"
    )


def declared_channels(descriptors: DataFrame) -> DataFrame:
    return descriptors.select("id_do_dispositivo", "declarado_em", F.explode("descritor_da_origem.canais").alias("c")).select("id_do_dispositivo", "declarado_em", "c.*")


def configured_at(mapping: DataFrame, at) -> DataFrame:
    return mapping.filter(in_force(F.col("vigente_de"), F.col("vigente_ate"), F.lit(at).cast("timestamp")))


def divergences(descriptors: DataFrame, mapping: DataFrame, at) -> DataFrame:
    """Both directions of the comparison at an instant, for devices that declared something.

    A channel is unconfigured, or missing, or its quantity differs, or else its unit; a source that states no quantity
    or unit claims nothing. Ordered by channel text, then kind.
    """
    d = declared_channels(descriptors).select("id_do_dispositivo", "modulo", "canal", F.col("grandeza").alias("dg"), F.col("unidade").alias("du"), F.lit(True).alias("declarado_"))
    m = configured_at(mapping, at).select(F.col("dispositivo").alias("id_do_dispositivo"), "modulo", "canal", "ponto", F.col("grandeza").alias("cg"), F.col("unidade").alias("cu"))
    both = d.join(m, ["id_do_dispositivo", "modulo", "canal"], "full_outer")
    # Devices without a declared channel drop out here, so that the descriptors are read once.
    both = both.withColumn("_said", F.max("declarado_").over(Window.partitionBy("id_do_dispositivo"))).filter("_said")
    kind = (
        F.when(F.col("ponto").isNull(), 1)
        .when(F.col("declarado_").isNull(), 2)
        .when((F.col("dg") != "nao_especificado") & (F.col("dg") != F.col("cg")), 3)
        .when((F.col("du") != "") & (F.col("du") != F.col("cu")), 4)
    )
    both = both.withColumn("n", kind).filter("n IS NOT NULL")
    name = F.element_at(F.array(*map(F.lit, ACTIONS)), F.col("n"))
    said = F.when(F.col("n") == 1, F.concat("dg", F.lit(" em "), "du")).when(F.col("n") == 3, F.col("dg")).when(F.col("n") == 4, F.col("du"))
    want = F.when(F.col("n") == 2, F.concat("cg", F.lit(" em "), "cu")).when(F.col("n") == 3, F.col("cg")).when(F.col("n") == 4, F.col("cu"))
    out = both.select(
        "id_do_dispositivo", channel_key(F.col("id_do_dispositivo"), F.col("modulo"), F.col("canal")).alias("canal_texto"), name.alias("especie"), F.col("n").alias("numero"),
        "ponto", said.alias("declarado"), want.alias("esperado"),
    )
    return out.withColumn("acao", labels(ACTIONS, F.col("especie"))).orderBy("canal_texto", "numero")


def source_summary(descriptors: DataFrame, installed_version: int) -> DataFrame:
    """Channels declared, time of the declaration, and whether its reason catalogue has drifted."""
    version = F.col("descritor_da_origem.versao_do_catalogo")
    return descriptors.select(
        "id_do_dispositivo", F.size("descritor_da_origem.canais").alias("canais"), "declarado_em", ((version != 0) & (version != installed_version)).alias("catalogo_divergente")
    )


def configured_channels(mapping: DataFrame) -> DataFrame:
    """Keys of the configured channels, in text order."""
    return mapping.select(channel_key(F.col("dispositivo"), F.col("modulo"), F.col("canal")).alias("canal_texto")).distinct().orderBy("canal_texto")


def bindings(mapping: DataFrame, point: str | None = None) -> DataFrame:
    """Binding history of points, by start; an open start is shown as the epoch."""
    rows = mapping if point is None else mapping.filter(F.col("ponto") == point)
    start = F.coalesce("vigente_de", F.lit("1970-01-01 00:00:00").cast("timestamp"))
    return rows.select("ponto", "dispositivo", "modulo", "canal", start.alias("desde"), F.col("vigente_ate").alias("ate")).orderBy("ponto", "desde")


def draft_mapping(descriptors: DataFrame, mapping: DataFrame, at) -> DataFrame:
    """Rows of a draft installation from what sources declare: the configured point, or a name to be filled in."""
    d = declared_channels(descriptors)
    m = configured_at(mapping, at).select(F.col("dispositivo").alias("id_do_dispositivo"), "modulo", "canal", "ponto")
    address = F.concat_ws("/", F.col("modulo").cast("string"), F.col("canal").cast("string"))
    rows = d.join(m, ["id_do_dispositivo", "modulo", "canal"], "left").withColumn("_a", address)
    name = F.coalesce("ponto", F.concat(F.lit("AJUSTAR-"), "id_do_dispositivo", F.lit("-canal-"), F.col("canal").cast("string")))
    fill = lambda c, none: F.when(F.trim(c) == none, "AJUSTAR").otherwise(F.col(c))
    return rows.orderBy("id_do_dispositivo", "_a").select(
        "id_do_dispositivo", "modulo", "canal", name.alias("ponto"), fill("grandeza", "nao_especificado").alias("grandeza"), fill("unidade", "").alias("unidade")
    )
