"""Validation of envelopes: the first failing rule names the reason, everything else goes on."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import CATALOG, QUANTITIES

MAX_UPTIME_MS = 100 * 365 * 86_400_000
NAME = r"^[a-z0-9]([a-z0-9-]*[a-z0-9])?\z"
POINT = r"^[a-z0-9]([a-z0-9.-]*[a-z0-9])?\z"


def name_ok(column: Column, pattern: str = NAME, most: int = 64) -> Column:
    return F.coalesce(column.rlike(pattern) & (F.octet_length(column) <= most), F.lit(False))


def reason(rows: DataFrame) -> Column:
    """Null for an accepted envelope, otherwise the first rule it breaks. Optional columns: conteudo_bruto."""
    known = F.col("tipo_de_conteudo").isin(*CATALOG.by_name)
    rules: list[tuple[Column, str]] = [
        (F.col("tipo_de_conteudo").isNull(), "sem conteudo"),
        (~F.coalesce(F.col("versao_do_esquema").between(1, 1), F.lit(False)), "versao do esquema"),
        (~name_ok(F.col("id_do_dispositivo")), "dispositivo"),
        (~name_ok(F.col("id_da_sessao_de_boot")), "sessao de boot"),
        (~F.coalesce(F.col("tempo_ligado_ms").between(0, MAX_UPTIME_MS), F.lit(False)), "tempo ligado"),
        (F.when(F.col("instante_observado").isNull(), F.raise_error(F.lit("an envelope without receipt instant is the gateway's fault"))).otherwise(False), ""),
    ]
    if "conteudo_bruto" in rows.columns:
        rules.append((~F.coalesce(F.octet_length("conteudo_bruto").between(1, 8192), F.lit(False)), "tamanho do conteudo"))
    rules.append((~known, "tipo de conteudo"))
    for c in CATALOG.by_name.values():
        mine = F.col("tipo_de_conteudo") == c.name
        rules.append((mine & F.col(c.name).isNull(), "conteudo indecifravel"))
        if c.rule != "true":
            rules.append((mine & ~F.coalesce(F.expr(c.rule.format(c=c.name)), F.lit(False)), f"regra de {c.name}"))
    out = F.when(rules[0][0], rules[0][1])
    for broken, text in rules[1:]:
        out = out.when(broken, text)
    return out


def validate(rows: DataFrame) -> DataFrame:
    """Adds motivo; accepted rows have none."""
    return rows.withColumn("motivo", reason(rows))


def same_identity(receipts: DataFrame) -> DataFrame:
    """Shipments whose claimed device is the authenticated one."""
    return receipts.filter(F.col("id_do_dispositivo").eqNullSafe(F.col("id_autenticado")))


def mapping_faults(mapping: DataFrame) -> DataFrame:
    """Rows of the installation that are refused, with the first reason."""
    names = [v for k, v in QUANTITIES.items() if k]
    fault = (
        F.when(~name_ok(F.col("dispositivo")), "dispositivo")
        .when(~name_ok(F.col("ponto"), POINT, 128), "ponto")
        .when(~F.coalesce(F.lower(F.trim("grandeza")).isin(*names), F.lit(False)), "grandeza")
        .when(F.coalesce(F.trim("unidade"), F.lit("")) == "", "unidade")
        .when(F.col("faixa_minima") > F.col("faixa_maxima"), "faixa")
        .when(F.col("vigente_de") >= F.col("vigente_ate"), "vigencia")
    )
    return mapping.withColumn("motivo", fault).filter("motivo IS NOT NULL")


def overlaps(mapping: DataFrame, keys: list[str]) -> DataFrame:
    """Rows that begin before another with equal keys ends (_id2), each with the earlier row that reaches furthest (_id);
    keys are the channel, or the point. Rows are walked once by their start, carrying the largest end so far."""
    rows = mapping.withColumn("_a", F.coalesce("vigente_de", F.lit("0001-01-01").cast("timestamp"))).withColumn("_z", F.coalesce("vigente_ate", F.lit("9999-01-01").cast("timestamp")))
    rows = rows.withColumn("_id", F.struct("dispositivo", "modulo", "canal", "ponto", "_a", "_z"))
    walk = Window.partitionBy(*keys).orderBy("_a", "_z", "_id").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.dropna(subset=keys).withColumn("_far", F.max(F.struct("_z", "_id")).over(walk))
    return rows.filter("_a < _far._z").select(*keys, F.col("_far._id").alias("_id"), F.col("_id").alias("_id2"))

