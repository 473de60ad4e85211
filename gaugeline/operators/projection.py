"""From journal records to the long table of readings: resolve, enrich, unpivot, write once."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import CATALOG, COMMON, in_force, out_of_range, struct_of
from ..sources.wire import decode_contents
from .journal import read_days

DERIVED = ("instante_estimado", "id_do_ponto_de_medicao", "grandeza", "unidade", "fora_de_faixa", "rotulo_do_motivo")
ROW_KEY = ["id_do_dispositivo", "id_da_sessao_de_boot", "numero_de_sequencia", "nome_do_campo", "instante_observado"]
#: Tasks that a day's readings are spread over while they are written.
SHARES = 16


def with_address(journal: DataFrame) -> DataFrame:
    """Adds modulo and canal, null for contents without an address; an absent index is 0."""
    addressed = [c.name for c in CATALOG.by_name.values() if c.addressed]
    out = journal
    for part in ("modulo", "canal"):
        value = None
        for name in addressed:
            one = F.coalesce(F.col(f"{name}.{part}"), F.lit(0).cast("long"))
            value = F.when(F.col(name).isNotNull(), one) if value is None else value.when(F.col(name).isNotNull(), one)
        out = out.withColumn(part, value)
    return out


def resolve(journal: DataFrame, mapping: DataFrame) -> DataFrame:
    """Adds the measurement point in force at the observed instant, and its range; null where there is none.

    An equi-join on the channel with the validity as a residual condition: rows are never multiplied, since overlaps
    are refused beforehand. Spark broadcasts the mapping while it is small and sorts by channel beyond that.
    """
    m = mapping.select(
        F.col("dispositivo").alias("_d"), F.col("modulo").alias("_m"), F.col("canal").alias("_c"), "vigente_de", "vigente_ate",
        F.col("ponto").alias("id_do_ponto_de_medicao"), "grandeza", "unidade", "faixa_minima", "faixa_maxima",
    )
    rows = journal if "modulo" in journal.columns else with_address(journal)
    on = (F.col("id_do_dispositivo") == F.col("_d")) & (F.col("modulo") == F.col("_m")) & (F.col("canal") == F.col("_c"))
    return rows.join(m, on & in_force(F.col("vigente_de"), F.col("vigente_ate"), F.col("instante_observado")), "left").drop("_d", "_m", "_c", "vigente_de", "vigente_ate")


def enrich(resolved: DataFrame, reasons: DataFrame, strict_null_range: bool = False) -> DataFrame:
    """Adds fora_de_faixa and rotulo_do_motivo, both only for resolved channels, and motivo_desconhecido.

    fora_de_faixa is set for scalar samples, false where no range is declared; with ``strict_null_range`` it is null
    there. A reason that the catalogue does not know keeps its event and counts as an anomaly; 0 is no reason. Spark
    broadcasts the catalogue while it is small. Beyond that records without a reason do not meet in one task: each joins
    under a number below zero, which no reason has.
    """
    value = F.col("amostra_escalar.valor").cast("double")
    flag = F.when(F.col("id_do_ponto_de_medicao").isNotNull() & F.col("amostra_escalar").isNotNull(), out_of_range(value, F.col("faixa_minima"), F.col("faixa_maxima")))
    if strict_null_range:
        flag = F.when(F.col("faixa_minima").isNotNull() | F.col("faixa_maxima").isNotNull(), flag)
    code = F.when(F.col("id_do_ponto_de_medicao").isNotNull(), F.col("mudanca_de_estado_de_maquina.codigo_do_motivo"))
    known = reasons.select(F.col("codigo").alias("_codigo"), F.col("rotulo").alias("rotulo_do_motivo"))
    rows = resolved.withColumn("fora_de_faixa", flag).withColumn("_motivo", F.when(code != 0, code))
    none = -1 - F.pmod(F.xxhash64("id_do_dispositivo", "numero_de_sequencia"), F.lit(1 << 40))
    joined = rows.withColumn("_junta", F.coalesce("_motivo", none)).join(known, F.col("_junta") == F.col("_codigo"), "left").drop("_junta")
    return joined.withColumn("motivo_desconhecido", F.col("_motivo").isNotNull() & F.col("_codigo").isNull()).drop("_motivo", "_codigo")


def decode_error() -> Column:
    """Why a record cannot be decoded: its type is not known, or its content is missing. Null for the others."""
    missing = None
    for c in CATALOG.by_name.values():
        lost = (F.col("tipo_de_conteudo") == c.name) & F.col(c.name).isNull()
        missing = lost if missing is None else missing | lost
    unknown = ~F.coalesce(F.col("tipo_de_conteudo").isin(*CATALOG.by_name), F.lit(False))
    return F.when(unknown, "tipo de conteudo").when(F.coalesce(missing, F.lit(False)), "conteudo indecifravel")


def split_decodable(journal: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Records of a known type whose content could be decoded, and the rest with a reason, to be tried again later."""
    marked = journal.withColumn("motivo", decode_error())
    return marked.filter("motivo IS NULL").drop("motivo"), marked.filter("motivo IS NOT NULL")


def _entries(fields: tuple[str, ...] = ()):
    """An array of (field, three typed values) for a record, by its content; with ``fields`` only those."""
    def entry(name: str, kind: str, value) -> Column:
        return F.struct(
            F.lit(name).alias("nome_do_campo"),
            (value.cast("double") if kind == "n" else F.lit(None).cast("double")).alias("valor_numerico"),
            (value.cast("string") if kind == "t" else F.lit(None).cast("string")).alias("valor_texto"),
            (value.cast("boolean") if kind == "b" else F.lit(None).cast("boolean")).alias("valor_logico"),
        )

    out = None
    for c in CATALOG.by_name.values():
        at = struct_of(c)
        items = [entry(n, "n", F.coalesce(at("{c}." + p), F.lit(0))) for n, p in (("module_index", "modulo"), ("channel_index", "canal"))] if c.addressed else []
        items += [entry(n, k, at(sql)) for n, k, sql in c.fields]
        names = [*(("module_index", "channel_index") if c.addressed else ()), *(n for n, _, _ in c.fields)]
        items = [i for n, i in zip(names, items) if not fields or n in fields]
        if not items:
            continue
        array = F.array(*items)
        if "asserted_batch_id" in names and (not fields or "asserted_batch_id" in fields):
            array = F.filter(array, lambda x: (x["nome_do_campo"] != "asserted_batch_id") | x["valor_texto"].isNotNull())
        out = F.when(F.col(c.name).isNotNull(), array) if out is None else out.when(F.col(c.name).isNotNull(), array)
    return out


def unpivot(enriched: DataFrame, fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per projected field with exactly one of three value columns set. Badges are never projected."""
    extra = [c for c in DERIVED if c in enriched.columns]
    keep = [c for c in COMMON if c in enriched.columns]
    return enriched.select(*keep, *extra, F.inline(_entries(fields)))


def field_map(journal: DataFrame) -> DataFrame:
    """Per record a map of its fields as text; a record that cannot be decoded has none, and says why."""
    text = F.transform(_entries(), lambda x: F.struct(x["nome_do_campo"], F.coalesce(x["valor_texto"], x["valor_numerico"].cast("string"), x["valor_logico"].cast("string"))))
    error = decode_error().alias("erro_de_decodificacao")
    return journal.select(*[c for c in COMMON if c in journal.columns], F.map_from_entries(F.when(error.isNull(), text)).alias("campos"), error)


def project(journal: DataFrame, mapping: DataFrame, reasons: DataFrame, strict_null_range: bool = False, fields: tuple[str, ...] = ()) -> DataFrame:
    """Journal to readings; joins run once per record, before the rows multiply. With ``fields`` only readings of those
    are made, and records of contents without any of them are left out before the joins."""
    ok, _ = split_decodable(journal)
    if fields:
        own = [c.name for c in CATALOG.by_name.values() if {n for n, _, _ in c.fields} & {*fields} or (c.addressed and {*fields} & {"module_index", "channel_index"})]
        ok = ok.filter(F.col("tipo_de_conteudo").isin(*own))
    return unpivot(enrich(resolve(with_address(ok), mapping), reasons, strict_null_range), fields)


def reprocess(quarantine: DataFrame, mapping: DataFrame, reasons: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Decode quarantined records again from their raw bytes: the readings of those that can be decoded now, and the
    records that stay, each with its reason."""
    again = decode_contents(quarantine.drop("motivo"))
    _, rest = split_decodable(again)
    return project(again, mapping, reasons), rest


def write_readings(rows: DataFrame, path: str, days: tuple | None = None) -> None:
    """Append readings that the table does not hold yet: a folder per day, and in it one of this write, which
    ``journal.compact`` joins. Only the days at hand are read back, so a repeated write changes nothing. ``days`` are the
    first and the last one, where the caller knows them.

    Keys of the table and new rows meet in one shuffle, by day and share of the keys, and in one sort that begins with the
    day and with a hash of the key, whose eight bytes tell rows apart where device names do not."""
    new = rows.withColumns({"dt": F.to_date("instante_observado"), "_new": F.lit(1)})
    known = read_days(new, path, span=days)
    if known is not None:
        new = new.unionByName(known.select("dt", *ROW_KEY, F.lit(0).alias("_new")), allowMissingColumns=True)
    new = new.withColumn("_key", F.xxhash64(*ROW_KEY)).withColumn("_share", F.pmod("_key", F.lit(SHARES))).repartition("dt", "_share")
    first = F.row_number().over(Window.partitionBy("dt", "_share", "_key", *ROW_KEY).orderBy("_new"))
    new = new.withColumn("_n", first).filter("_n = 1 AND _new = 1").drop("_n", "_new", "_key", "_share")
    new.withColumn("batch_id", F.lit(f"lot-{uuid.uuid4().hex[:8]}")).write.mode("append").partitionBy("dt", "batch_id").parquet(path)
