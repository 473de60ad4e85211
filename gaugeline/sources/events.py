"""Deliveries of telemetry envelopes, derived from the events table."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.catalog import CATALOG, data_class, idempotency_key

WEEK_MS = 7 * 86_400_000
EPOCH = "2024-01-01"
#: Sampling period that channel n declares, times n; channel 0 declares none.
PERIOD_MS = 40 * 3_600_000


def _content(kind: str, *fields: Column) -> Column:
    return F.when(F.col("tipo_de_conteudo") == kind, F.struct(*fields)).alias(kind)


def numbered(events: DataFrame) -> DataFrame:
    """Events with k, w, the sequence within (user, week), and the content type."""
    rows = events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), "user_id", "event_type", "value", F.get_json_object("props", "$.k").cast("int").alias("k"))
    rows = rows.withColumn("w", F.expr(f"datediff(ts, DATE '{EPOCH}') div 7").cast("int"))
    rows = rows.withColumn("seq", F.row_number().over(Window.partitionBy("user_id", "w").orderBy("event_id")).cast("long"))
    error = F.element_at(F.array(*map(F.lit, ("saude_da_origem", "lacuna_de_buffer", "descritor_da_origem", "transicao_digital"))), F.col("k") % 4 + 1)
    kind = F.when(F.col("event_type") == "view", "amostra_escalar").when(F.col("event_type") == "click", "leitura_de_contador")
    kind = kind.when(F.col("event_type") == "purchase", "amostra_agregada").when(F.col("event_type") == "signup", "mudanca_de_estado_de_maquina").otherwise(error)
    return rows.withColumn("tipo_de_conteudo", kind)


def channels() -> Column:
    """The four channels that a descriptor declares; some devices swap, omit or rename one."""
    def one(n: int, name: Column, unit: Column) -> Column:
        place = F.lit(n % 2).cast("long").alias("modulo"), F.lit(n).cast("long").alias("canal")
        return F.struct(*place, name.alias("grandeza"), unit.alias("unidade"), F.lit(n * PERIOD_MS).cast("long").alias("periodo_de_amostragem_ms"))

    swap = F.col("user_id") % 5 == 0
    a, b = F.lit("temperatura"), F.lit("pressao")
    ua, ub = F.lit("Cel"), F.when(F.col("user_id") % 11 == 0, "psi").otherwise("kPa")
    every = F.array(
        one(0, F.when(swap, b).otherwise(a), F.when(swap, ub).otherwise(ua)),
        one(1, F.when(swap, a).otherwise(b), F.when(swap, ua).otherwise(ub)),
        one(2, F.lit("estado_digital"), F.lit("1")),
        one(3, F.lit("contagem_de_pecas"), F.lit("1")),
    )
    return F.when(F.col("user_id") % 7 == 0, F.slice(every, 1, 3)).otherwise(every)


def deliveries(events: DataFrame) -> DataFrame:
    """One row per delivered envelope, with redeliveries and undeclared gaps."""
    k, seq = F.col("k"), F.col("seq")
    mod, can = (k % 2).cast("long").alias("modulo"), (k % 4).cast("long").alias("canal")
    value = F.col("value")
    free = (F.lit(100000) - k * 500).cast("long")
    reason = F.element_at(F.array(*map(F.lit, (0, 10, 40, 41, 999))), k % 5 + 1).cast("long")
    device = F.concat(F.lit("dev-"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    session = F.concat(F.lit("boot-w"), F.col("w").cast("string"))
    rows = numbered(events).filter(F.col("event_id") % 37 != 0)
    rows = rows.select(
        (F.col("event_id") + 1).alias("id"),
        "event_id", "user_id", "k", "w",
        F.lit(1).alias("versao_do_esquema"),
        device.alias("id_do_dispositivo"),
        session.alias("id_da_sessao_de_boot"),
        seq.alias("numero_de_sequencia"),
        (F.unix_millis("ts") - F.unix_millis(F.lit(f"{EPOCH} 00:00:00").cast("timestamp")) - F.col("w") * F.lit(WEEK_MS).cast("long")).alias("tempo_ligado_ms"),
        F.col("ts").alias("instante_observado"),
        "tipo_de_conteudo",
        data_class(F.col("tipo_de_conteudo")).alias("classe_de_dado"),
        F.concat(device, F.lit("/"), session, F.lit("/"), F.expr("(seq - 1) div 5").cast("string")).alias("shipment_id"),
        _content("amostra_escalar", mod, can, value.alias("valor")),
        _content("leitura_de_contador", mod, can, (seq * 10).alias("contagem_acumulada")),
        _content("transicao_digital", mod, can, (k % 8 >= 4).alias("ativo")),
        _content("amostra_agregada", mod, can, F.lit(1000).cast("long").alias("janela_ms"), (k + 1).cast("long").alias("quantidade"), (value * 0.5).alias("minimo"),
                 (value * 1.5).alias("maximo"), value.alias("media"), (value * 1.1).alias("valor_eficaz")),
        _content("mudanca_de_estado_de_maquina", mod, can, (k % 6 + 1).alias("estado"), reason.alias("codigo_do_motivo"), F.when(k % 3 == 0, "cracha-1").otherwise("").alias("cracha"),
                 F.when(k % 7 == 0, F.concat(F.lit("lote-"), k.cast("string"))).otherwise("").alias("lote")),
        _content("saude_da_origem", free.alias("livre"), F.expr("(100000 - k * 500) div (1 + k % 5)").cast("long").alias("maior_bloco"), (F.lit(-40) - k).cast("long").alias("dbm"),
                 F.col("w").cast("long").alias("reinicios"), seq.alias("descartados"), (k * 64).cast("long").alias("buffer")),
        _content("lacuna_de_buffer", (k + 1).cast("long").alias("perdidos"), seq.alias("primeira"), (seq + k).alias("ultima")),
        _content("descritor_da_origem", F.concat(F.lit("1."), (k % 12).cast("string")).alias("firmware"), F.concat(F.lit("hw-"), (F.col("user_id") % 3).cast("string")).alias("modelo"),
                 (k % 2 + 1).cast("long").alias("versao_do_catalogo"), channels().alias("canais")),
    ).withColumn("chave_de_idempotencia", idempotency_key(F.col("id_do_dispositivo"), F.col("id_da_sessao_de_boot"), F.col("numero_de_sequencia")))
    again = rows.filter(F.col("event_id") % 10 == 0).withColumns(
        {"id": F.col("id") + 10_000_000, "instante_observado": F.col("instante_observado") + F.expr("INTERVAL 1 MINUTE"), "shipment_id": F.concat("shipment_id", F.lit("/r"))}
    )
    return rows.unionByName(again)


def corrupted(rows: DataFrame) -> DataFrame:
    """Deliveries with the faults that validation looks for, in the order of its rules, and raw contents."""
    e = F.col("event_id")

    def spoiled(name: str, field: str, value: Column) -> Column:
        return F.when(e % 71 == 0, F.col(name).withField(field, value)).otherwise(F.col(name))

    long = F.transform("descritor_da_origem.canais", lambda c: c.withField("unidade", F.repeat(F.lit("u"), 65)))
    out = rows.withColumns(
        {
            "versao_do_esquema": F.when(e % 59 == 0, 2).otherwise(F.col("versao_do_esquema")),
            "id_do_dispositivo": F.when(e % 53 == 0, F.upper("id_do_dispositivo")).otherwise(F.col("id_do_dispositivo")),
            "id_da_sessao_de_boot": F.when(e % 73 == 0, "").otherwise(F.col("id_da_sessao_de_boot")),
            "tempo_ligado_ms": F.when(e % 61 == 0, F.lit(1 << 62)).otherwise(F.col("tempo_ligado_ms")),
            "conteudo_bruto": F.repeat(F.lit("x"), F.when(e % 89 == 0, F.when(e % 2 == 0, 0).otherwise(8193)).otherwise(8192)).cast("binary"),
            "amostra_agregada": spoiled("amostra_agregada", "quantidade", F.lit(0).cast("long")),
            "mudanca_de_estado_de_maquina": spoiled("mudanca_de_estado_de_maquina", "estado", F.lit(9)),
            "saude_da_origem": spoiled("saude_da_origem", "maior_bloco", F.col("saude_da_origem.livre") + 1),
            "lacuna_de_buffer": spoiled("lacuna_de_buffer", "ultima", F.col("lacuna_de_buffer.primeira") - 1),
            "descritor_da_origem": spoiled("descritor_da_origem", "canais", long),
            "tipo_de_conteudo": F.when(e % 83 != 0, F.when(e % 67 == 0, "desconhecido").otherwise(F.col("tipo_de_conteudo"))),
        }
    )
    return out.withColumns({name: F.when(e % 79 != 0, F.col(name)) for name in CATALOG.by_name})


def mapping(events: DataFrame) -> DataFrame:
    """Configured channels of the even devices; channel 0 in two validities."""
    users = events.filter(F.col("user_id") % 2 == 0).select("user_id").distinct()
    cut = F.lit("2024-01-15 00:00:00").cast("timestamp")
    none = F.lit(None).cast("timestamp")
    specs = [(0, 0, "temperatura", "Cel", None, cut), (0, 0, "temperatura", "Cel", cut, None), (1, 1, "pressao", "kPa", None, None), (0, 2, "estado_digital", "1", None, None), (1, 3, "contagem_de_pecas", "1", None, None)]
    rows = F.array(
        *[
            F.struct(
                F.lit(m).cast("long").alias("modulo"), F.lit(c).cast("long").alias("canal"), F.lit(g).alias("grandeza"), F.lit(u).alias("unidade"),
                (F.lit(0.0) if c % 2 == 0 else F.lit(None).cast("double")).alias("faixa_minima"), (F.lit(100.0) if c % 2 == 0 else F.lit(None).cast("double")).alias("faixa_maxima"),
                (none if a is None else a).alias("vigente_de"), (none if b is None else b).alias("vigente_ate"),
            )
            for m, c, g, u, a, b in specs
        ]
    )
    device = F.concat(F.lit("dev-"), F.lpad(F.col("user_id").cast("string"), 6, "0"))
    one = users.select(device.alias("dispositivo"), F.explode(rows).alias("r")).select("dispositivo", "r.*")
    return one.withColumn("ponto", F.concat(F.lit("ponto."), "dispositivo", F.lit("."), F.col("canal").cast("string")))


def faulty_mapping(events: DataFrame) -> DataFrame:
    """The mapping with a fault of each kind, by device: names, quantity, unit, range, validity, and for a sixth of the
    devices two validities of channel 0 that meet."""
    u = F.substring("dispositivo", 5, 6).cast("int")
    late = F.lit("2024-01-20 00:00:00").cast("timestamp")
    return mapping(events).withColumns(
        {
            "ponto": F.when(u % 14 == 0, F.concat(F.lit("-"), "ponto")).otherwise(F.col("ponto")),
            "grandeza": F.when((u % 10 == 0) & (F.col("canal") == 1), "nao_especificado").otherwise(F.concat(F.lit(" "), F.upper("grandeza"))),
            "unidade": F.when((u % 22 == 0) & (F.col("canal") == 2), "  ").otherwise(F.col("unidade")),
            "faixa_minima": F.when((u % 26 == 0) & (F.col("canal") == 2), 101.0).otherwise(F.col("faixa_minima")),
            "vigente_de": F.when((u % 34 == 0) & F.col("vigente_ate").isNotNull(), F.col("vigente_ate")).otherwise(F.col("vigente_de")),
            "vigente_ate": F.when((u % 6 == 0) & (u % 34 != 0) & F.col("vigente_ate").isNotNull(), late).otherwise(F.col("vigente_ate")),
        }
    )


def receipts(delivered: DataFrame) -> DataFrame:
    """Receipts of the deliveries: the gateway's clocks and run, and the device that authenticated."""
    late = F.when(F.col("event_id") % 19 == 0, 5_000_000_000).otherwise(0)
    return delivered.select(
        "id", "event_id", "id_do_dispositivo", "id_da_sessao_de_boot", "tempo_ligado_ms", F.col("instante_observado").alias("instante"), (F.col("tempo_ligado_ms") * 1_000_000 + late).alias("decorrido_ns"),
        F.when(F.col("event_id") % 3 == 0, "run-b").otherwise("run-a").alias("id_da_execucao"),
        F.when(F.col("event_id") % 43 == 0, "dev-outro").otherwise(F.col("id_do_dispositivo")).alias("id_autenticado"),
    )


def legacy_buffer(events: DataFrame) -> DataFrame:
    """Events as rows of the first version's text buffer, some of which cannot be parsed."""
    at = F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss")
    return events.select(
        F.col("event_id").alias("id"), F.when(F.col("event_id") % 5 == 0, "x").otherwise(at).alias("timestamp"), F.col("event_type").alias("tag"),
        F.when(F.col("event_id") % 7 == 0, "1,5").otherwise((F.col("event_id") % 100).cast("string")).alias("value"), F.lit("C").alias("unit"), (F.col("event_id") % 2).cast("int").alias("synced"),
    )


def reasons(events: DataFrame) -> DataFrame:
    """The stop-reason catalogue, version 1."""
    # From Arrow, Spark knows the table's size and so may broadcast it.
    return events.sparkSession.createDataFrame(pa.table({"codigo": [10, 40, 41], "rotulo": ["Troca de ferramenta", "Falha eletrica", "Falha mecanica"]}))
