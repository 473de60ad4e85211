"""The library's queries over the events table, and the same questions in SQL for the oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.catalog import CATALOG, page_limit, policy
from ..operators import commissioning, journal, monitoring, projection, rollup, timeline, validate
from ..sources import events as source
from ..sources import legacy, wire
from ..sources.state import Cursors, kept, scratch
from ..streaming import ingest

NOW = "2024-02-01 00:00:00"


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/events.parquet")


def _journal(e: DataFrame, by_session: bool = False) -> DataFrame:
    return journal.deduplicate(source.deliveries(e), by_session)


def _readings(e: DataFrame, *fields: str) -> DataFrame:
    return projection.project(_journal(e), source.mapping(e), source.reasons(e), fields=fields)


def _plain(df: DataFrame) -> DataFrame:
    """Timestamps without zone, as the oracle has them."""
    return df.select(*[F.col(c).cast("timestamp_ntz").alias(c) if t == "timestamp" else F.col(c) for c, t in df.dtypes])


Q: dict[str, Callable[[DataFrame], DataFrame]] = {}
SQL: dict[str, str] = {}


def _query(name: str, sql: str) -> Callable:
    def keep(f: Callable[[DataFrame], DataFrame]) -> Callable:
        Q[name], SQL[name] = f, BASE + sql
        return f

    return keep


BASE = """
WITH e AS (
  SELECT event_id, ts, user_id, event_type, value, CAST(json_extract(props, '$.k') AS INTEGER) AS k,
         CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) // 7 AS INTEGER) AS w FROM events),
n AS (SELECT *, row_number() OVER (PARTITION BY user_id, w ORDER BY event_id) AS seq FROM e),
d0 AS (
  SELECT event_id + 1 AS id, event_id, user_id, k, w, value, seq AS s, 1 AS versao,
         'dev-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS dev, 'boot-w' || w AS ses,
         epoch_us(ts) // 1000 - epoch_ms(TIMESTAMP '2024-01-01') - w * 604800000::BIGINT AS up, ts AS obs,
         CASE event_type WHEN 'view' THEN 'amostra_escalar' WHEN 'click' THEN 'leitura_de_contador' WHEN 'purchase' THEN 'amostra_agregada'
              WHEN 'signup' THEN 'mudanca_de_estado_de_maquina'
              ELSE ['saude_da_origem', 'lacuna_de_buffer', 'descritor_da_origem', 'transicao_digital'][k % 4 + 1] END AS tipo,
         'dev-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '/boot-w' || w || '/' || ((seq - 1) // 5) AS ship
  FROM n WHERE event_id % 37 <> 0),
d AS (
  SELECT * FROM d0
  UNION ALL SELECT * REPLACE (id + 10000000 AS id, obs + INTERVAL 1 MINUTE AS obs, ship || '/r' AS ship) FROM d0 WHERE event_id % 10 = 0),
j AS (SELECT *, dev || ':' || ses || ':' || s AS chave, CASE WHEN tipo IN ('amostra_escalar', 'amostra_agregada', 'saude_da_origem', 'descritor_da_origem') THEN 'sample' ELSE 'discrete_event' END AS classe
      FROM d QUALIFY row_number() OVER (PARTITION BY dev, ses, s ORDER BY id) = 1),
spec(mm, cc, g, u, lo, hi, de, ate) AS (VALUES
  (0, 0, 'temperatura', 'Cel', 0.0::DOUBLE, 100.0::DOUBLE, NULL::TIMESTAMP, TIMESTAMP '2024-01-15'), (0, 0, 'temperatura', 'Cel', 0.0, 100.0, TIMESTAMP '2024-01-15', NULL),
  (1, 1, 'pressao', 'kPa', NULL, NULL, NULL, NULL), (0, 2, 'estado_digital', '1', 0.0, 100.0, NULL, NULL), (1, 3, 'contagem_de_pecas', '1', NULL, NULL, NULL, NULL)),
map AS (SELECT 'dev-' || lpad(CAST(user_id AS VARCHAR), 6, '0') AS mdev, mm, cc, g, u, lo, hi, de, ate, 'ponto.dev-' || lpad(CAST(user_id AS VARCHAR), 6, '0') || '.' || cc AS ponto
        FROM (SELECT DISTINCT user_id FROM events WHERE user_id % 2 = 0), spec),
motivos(codigo, rotulo) AS (VALUES (10, 'Troca de ferramenta'), (40, 'Falha eletrica'), (41, 'Falha mecanica')),
r AS (
  SELECT j.*, map.ponto, map.g, map.u, map.lo, map.hi, tipo IN ('amostra_escalar', 'leitura_de_contador', 'transicao_digital', 'amostra_agregada', 'mudanca_de_estado_de_maquina') AS tem
  FROM j LEFT JOIN map ON j.dev = mdev AND j.k % 2 = mm AND j.k % 4 = cc AND (de IS NULL OR obs >= de) AND (ate IS NULL OR obs < ate)
       AND tipo IN ('amostra_escalar', 'leitura_de_contador', 'transicao_digital', 'amostra_agregada', 'mudanca_de_estado_de_maquina')),
x AS (
  SELECT r.*, CASE WHEN ponto IS NOT NULL AND tipo = 'amostra_escalar' THEN coalesce(value < lo, FALSE) OR coalesce(value > hi, FALSE) END AS fora,
         [0, 10, 40, 41, 999][k % 5 + 1] AS motivo, rotulo
  FROM r LEFT JOIN motivos ON ponto IS NOT NULL AND tipo = 'mudanca_de_estado_de_maquina' AND codigo = [0, 10, 40, 41, 999][k % 5 + 1]),
leitura AS (
  SELECT x.*, f.campo, f.n AS num, f.t AS txt, f.b AS log FROM x, LATERAL (
    SELECT 'module_index' AS campo, CAST(k % 2 AS DOUBLE) AS n, NULL::VARCHAR AS t, NULL::BOOLEAN AS b WHERE tem
    UNION ALL SELECT 'channel_index', k % 4, NULL, NULL WHERE tem
    UNION ALL SELECT 'value', value, NULL, NULL WHERE tipo = 'amostra_escalar'
    UNION ALL SELECT 'accumulated_count', s * 10, NULL, NULL WHERE tipo = 'leitura_de_contador'
    UNION ALL SELECT 'active', NULL, NULL, k % 8 >= 4 WHERE tipo = 'transicao_digital'
    UNION ALL SELECT 'window_ms', 1000, NULL, NULL WHERE tipo = 'amostra_agregada'
    UNION ALL SELECT 'sample_count', k + 1, NULL, NULL WHERE tipo = 'amostra_agregada'
    UNION ALL SELECT 'minimum', value * 0.5::DOUBLE, NULL, NULL WHERE tipo = 'amostra_agregada'
    UNION ALL SELECT 'maximum', value * 1.5::DOUBLE, NULL, NULL WHERE tipo = 'amostra_agregada'
    UNION ALL SELECT 'mean', value, NULL, NULL WHERE tipo = 'amostra_agregada'
    UNION ALL SELECT 'rms', value * 1.1::DOUBLE, NULL, NULL WHERE tipo = 'amostra_agregada'
    UNION ALL SELECT 'machine_state', NULL, ['running', 'stopped', 'setup', 'idle', 'planned_maintenance', 'breakdown'][k % 6 + 1], NULL WHERE tipo = 'mudanca_de_estado_de_maquina'
    UNION ALL SELECT 'reason_code', motivo, NULL, NULL WHERE tipo = 'mudanca_de_estado_de_maquina'
    UNION ALL SELECT 'operator_acknowledged', NULL, NULL, k % 3 = 0 WHERE tipo = 'mudanca_de_estado_de_maquina'
    UNION ALL SELECT 'asserted_batch_id', NULL, 'lote-' || k, NULL WHERE tipo = 'mudanca_de_estado_de_maquina' AND k % 7 = 0
    UNION ALL SELECT 'heap_free_bytes', 100000 - k * 500, NULL, NULL WHERE tipo = 'saude_da_origem'
    UNION ALL SELECT 'heap_largest_free_block_bytes', (100000 - k * 500) // (1 + k % 5), NULL, NULL WHERE tipo = 'saude_da_origem'
    UNION ALL SELECT 'radio_signal_dbm', -40 - k, NULL, NULL WHERE tipo = 'saude_da_origem'
    UNION ALL SELECT 'reboot_count', w, NULL, NULL WHERE tipo = 'saude_da_origem'
    UNION ALL SELECT 'discarded_record_count', s, NULL, NULL WHERE tipo = 'saude_da_origem'
    UNION ALL SELECT 'buffer_used_bytes', k * 64, NULL, NULL WHERE tipo = 'saude_da_origem'
    UNION ALL SELECT 'lost_record_count', k + 1, NULL, NULL WHERE tipo = 'lacuna_de_buffer'
    UNION ALL SELECT 'first_lost_sequence', s, NULL, NULL WHERE tipo = 'lacuna_de_buffer'
    UNION ALL SELECT 'last_lost_sequence', s + k, NULL, NULL WHERE tipo = 'lacuna_de_buffer'
    UNION ALL SELECT 'firmware_version', NULL, '1.' || (k % 12), NULL WHERE tipo = 'descritor_da_origem'
    UNION ALL SELECT 'hardware_model', NULL, 'hw-' || (user_id % 3), NULL WHERE tipo = 'descritor_da_origem'
    UNION ALL SELECT 'channel_count', CASE WHEN user_id % 7 = 0 THEN 3 ELSE 4 END, NULL, NULL WHERE tipo = 'descritor_da_origem'
    UNION ALL SELECT 'channel_signature', NULL,
      '0/0=' || CASE WHEN user_id % 5 = 0 THEN 'pressao/' || CASE WHEN user_id % 11 = 0 THEN 'psi' ELSE 'kPa' END ELSE 'temperatura/Cel' END ||
      ';1/1=' || CASE WHEN user_id % 5 = 0 THEN 'temperatura/Cel' ELSE 'pressao/' || CASE WHEN user_id % 11 = 0 THEN 'psi' ELSE 'kPa' END END ||
      ';0/2=estado_digital/1' || CASE WHEN user_id % 7 = 0 THEN '' ELSE ';1/3=contagem_de_pecas/1' END, NULL WHERE tipo = 'descritor_da_origem'
    UNION ALL SELECT 'reason_catalog_version', k % 2 + 1, NULL, NULL WHERE tipo = 'descritor_da_origem') f),
des AS (SELECT * FROM j WHERE tipo = 'descritor_da_origem' QUALIFY row_number() OVER (PARTITION BY dev ORDER BY id DESC) = 1),
dec AS (
  SELECT dev, user_id, 0 AS m, 0 AS c, CASE WHEN user_id % 5 = 0 THEN 'pressao' ELSE 'temperatura' END AS dg, CASE WHEN user_id % 5 <> 0 THEN 'Cel' WHEN user_id % 11 = 0 THEN 'psi' ELSE 'kPa' END AS du FROM des
  UNION ALL SELECT dev, user_id, 1, 1, CASE WHEN user_id % 5 = 0 THEN 'temperatura' ELSE 'pressao' END, CASE WHEN user_id % 5 = 0 THEN 'Cel' WHEN user_id % 11 = 0 THEN 'psi' ELSE 'kPa' END FROM des
  UNION ALL SELECT dev, user_id, 0, 2, 'estado_digital', '1' FROM des
  UNION ALL SELECT dev, user_id, 1, 3, 'contagem_de_pecas', '1' FROM des WHERE user_id % 7 <> 0)
"""


@_query("w1_deduplicate", "SELECT id, chave AS chave_de_idempotencia, tipo AS tipo_de_conteudo, up AS tempo_ligado_ms, obs AS instante_observado FROM j")
def w1(e):
    return _journal(e).select("id", "chave_de_idempotencia", "tipo_de_conteudo", "tempo_ligado_ms", "instante_observado")


@_query("r2_long_projection", """SELECT chave AS chave_de_idempotencia, obs AS instante_observado, tipo AS tipo_de_conteudo, classe AS classe_de_dado, campo AS nome_do_campo, num AS valor_numerico,
 txt AS valor_texto, log AS valor_logico, ponto AS id_do_ponto_de_medicao, g AS grandeza, u AS unidade, fora AS fora_de_faixa, rotulo AS rotulo_do_motivo FROM leitura""")  # fmt: skip
def r2(e):
    return _readings(e).select(
        "chave_de_idempotencia", "instante_observado", "tipo_de_conteudo", "classe_de_dado", "nome_do_campo", "valor_numerico", "valor_texto", "valor_logico",
        "id_do_ponto_de_medicao", "grandeza", "unidade", "fora_de_faixa", "rotulo_do_motivo",
    )


@_query("j1_resolve_points", "SELECT chave AS chave_de_idempotencia, ponto AS id_do_ponto_de_medicao, g AS grandeza, u AS unidade, fora AS fora_de_faixa FROM x")
def j1(e):
    rows = projection.enrich(projection.resolve(_journal(e), source.mapping(e)), source.reasons(e))
    return rows.select("chave_de_idempotencia", "id_do_ponto_de_medicao", "grandeza", "unidade", "fora_de_faixa")


@_query("j2_reason_anomalies", "SELECT motivo AS codigo, count(*) AS registros, count(rotulo) AS com_rotulo FROM x WHERE tipo = 'mudanca_de_estado_de_maquina' AND ponto IS NOT NULL GROUP BY 1")
def j2(e):
    rows = projection.enrich(projection.resolve(_journal(e), source.mapping(e)), source.reasons(e)).filter("mudanca_de_estado_de_maquina IS NOT NULL AND id_do_ponto_de_medicao IS NOT NULL")
    return rows.groupBy(F.col("mudanca_de_estado_de_maquina.codigo_do_motivo").cast("int").alias("codigo")).agg(F.count(F.lit(1)).alias("registros"), F.count("rotulo_do_motivo").alias("com_rotulo"))


@_query("a1_acknowledge", """, m AS (SELECT *, row_number() OVER (PARTITION BY dev, ses, s ORDER BY id) = 1 AS novo FROM d)
SELECT ship AS shipment_id, max(s) AS duravel_ate, count(*) FILTER (novo) AS gravados, count(*) FILTER (NOT novo) AS duplicados FROM m GROUP BY 1""")
def a1(e):
    return journal.acknowledge(source.deliveries(e))


@_query("a2_durable_sequence", "SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, max(s) AS duravel_ate FROM j GROUP BY 1, 2")
def a2(e):
    return journal.durable_until(_journal(e))


@_query("a3_records_per_minute", "SELECT date_trunc('minute', obs) AS minuto, dev AS id_do_dispositivo, count(*) AS registros FROM leitura GROUP BY 1, 2")
def a3(e):
    return monitoring.records_per_minute(_readings(e))


@_query("a4_discarded", "SELECT dev AS id_do_dispositivo, max(num) AS descartados FROM leitura WHERE campo = 'discarded_record_count' GROUP BY 1")
def a4(e):
    return monitoring.discarded(_readings(e, "discarded_record_count"))


_GAPS = """max(CASE WHEN campo = 'lost_record_count' THEN num END) AS perdidos, max(CASE WHEN campo = 'first_lost_sequence' THEN num END) AS da_sequencia,
 max(CASE WHEN campo = 'last_lost_sequence' THEN num END) AS ate FROM leitura WHERE tipo = 'lacuna_de_buffer'"""


@_query("a5_admitted_gaps", f"SELECT obs AS instante_observado, dev AS id_do_dispositivo, {_GAPS} GROUP BY 1, 2 ORDER BY 1 DESC, 2 LIMIT 50")
def a5(e):
    return monitoring.admitted_gaps(_readings(e, "lost_record_count", "first_lost_sequence", "last_lost_sequence"))


@_query("a6_unconfigured", """SELECT dev AS id_do_dispositivo, s // 1000 AS milhar, max(CASE WHEN campo = 'module_index' THEN num END) AS modulo, max(CASE WHEN campo = 'channel_index' THEN num END) AS canal,
 count(*) AS registros, max(obs) AS ultimo FROM leitura WHERE ponto IS NULL AND tipo IN ('amostra_escalar', 'leitura_de_contador', 'transicao_digital', 'amostra_agregada')
 GROUP BY 1, 2 ORDER BY ultimo DESC, 1, 2 LIMIT 50""")
def a6(e):
    return monitoring.unconfigured(_readings(e))


@_query("a6_unconfigured_channels", """SELECT dev AS id_do_dispositivo, CAST(k % 2 AS DOUBLE) AS modulo, CAST(k % 4 AS DOUBLE) AS canal, count(*) AS registros, max(obs) AS ultimo FROM x
 WHERE ponto IS NULL AND tipo IN ('amostra_escalar', 'leitura_de_contador', 'transicao_digital', 'amostra_agregada') GROUP BY 1, 2, 3""")
def a6b(e):
    return monitoring.unconfigured_channels(_readings(e))


@_query("a7_out_of_range", """SELECT ponto AS id_do_ponto_de_medicao, g AS grandeza, u AS unidade, count(*) AS ocorrencias, min(num) AS minimo_visto, max(num) AS maximo_visto FROM leitura
 WHERE fora AND campo = 'value' GROUP BY 1, 2, 3 ORDER BY ocorrencias DESC, 1 LIMIT 50""")
def a7(e):
    return monitoring.out_of_range_points(_readings(e, "value"))


@_query("a8_declared_sources", """SELECT dev AS id_do_dispositivo, max(CASE WHEN campo = 'firmware_version' THEN txt END) AS firmware, max(CASE WHEN campo = 'hardware_model' THEN txt END) AS hardware,
 max(CASE WHEN campo = 'channel_count' THEN num END) AS canais, max(obs) AS ultima FROM leitura WHERE tipo = 'descritor_da_origem' GROUP BY 1""")
def a8(e):
    return monitoring.declared_sources(_readings(e, "firmware_version", "hardware_model", "channel_count"))


@_query("a8_latest_sources", "SELECT dev AS id_do_dispositivo, arg_max('1.' || (k % 12), (obs, s)) AS firmware, 'hw-' || any_value(user_id % 3) AS hardware, CAST(any_value(CASE WHEN user_id % 7 = 0 THEN 3 ELSE 4 END) AS DOUBLE) AS canais, max(obs) AS ultima FROM j WHERE tipo = 'descritor_da_origem' GROUP BY 1")
def a8b(e):
    return monitoring.declared_sources(_readings(e, "firmware_version", "hardware_model", "channel_count"), latest=True)


@_query("a9_journal_count", "SELECT classe AS classe_de_dado, count(*) AS registros FROM j GROUP BY 1")
def a9(e):
    return _journal(e).groupBy("classe_de_dado").agg(F.count(F.lit(1)).alias("registros"))


@_query("a10_points", "SELECT DISTINCT ponto AS id_do_ponto_de_medicao FROM leitura WHERE ponto IS NOT NULL")
def a10(e):
    return monitoring.points(_readings(e))


@_query("a11_source_summary", "SELECT dev AS id_do_dispositivo, CAST(CASE WHEN user_id % 7 = 0 THEN 3 ELSE 4 END AS INTEGER) AS canais, obs AS declarado_em, k % 2 + 1 <> 1 AS catalogo_divergente FROM des")
def a11(e):
    return commissioning.source_summary(commissioning.latest_descriptors(_journal(e)), 1)


@_query("a12_configured_channels", "SELECT DISTINCT mdev || '@' || mm || '/' || cc AS canal_texto FROM map")
def a12(e):
    return commissioning.configured_channels(source.mapping(e))


@_query("w2_latest_descriptors", "SELECT dev AS id_do_dispositivo, id, obs AS declarado_em FROM des")
def w2(e):
    return commissioning.latest_descriptors(_journal(e)).select("id_do_dispositivo", "id", "declarado_em")


@_query("w3_anchors", "SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, arg_min(up, id) AS ancora_ms, arg_min(obs, id) AS instante_da_ancora FROM j GROUP BY 1, 2")
def w3(e):
    return timeline.anchors(_journal(e, by_session=True))


_ARRIVED = """, r0 AS (SELECT *, max(obs) OVER (PARTITION BY ship) AS recebida FROM d), o AS (SELECT *, row_number() OVER (ORDER BY recebida, ship, s) AS n FROM r0)
"""


def _arrived(e):
    """Envelopes of the binary path, with ids in order of arrival."""
    return ingest.identified(wire.split_refused(wire.decode_shipments(wire.encode_shipments(source.deliveries(e))))[0])


@_query("w3_arrival_ids", _ARRIVED + "SELECT ship AS shipment_id, s AS numero_de_sequencia, n AS id FROM o")
def w3b(e):
    return _arrived(e).select("shipment_id", "numero_de_sequencia", "id")


@_query("w3_arrival_anchors", _ARRIVED + "SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, arg_min(up, n) AS ancora_ms, arg_min(recebida, n) AS instante_da_ancora FROM o GROUP BY 1, 2")
def w3c(e):
    return timeline.anchors(_arrived(e))


@_query("t1_held_runs", """, i AS (SELECT dev, ses, s, s - row_number() OVER (PARTITION BY dev, ses ORDER BY s) AS g FROM j)
SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, 0::BIGINT AS pagina, min(s) AS primeira, max(s) AS ultima FROM i GROUP BY dev, ses, g""")
def t1(e):
    rows = source.deliveries(e)
    # Held batch by batch, as the stream merges them.
    held = journal.held_sequences(rows.filter("id % 3 = 0"))
    return journal.held_sequences(rows.filter("id % 3 <> 0"), held)


@_query("t1_new_beside_held", """, b AS (SELECT * FROM d WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY dev, ses, s ORDER BY id) = 1)
 SELECT id FROM b WHERE (dev, ses, s) NOT IN (SELECT (dev, ses, s) FROM d WHERE id % 3 <> 0)""")
def t1b(e):
    rows = source.deliveries(e)
    return journal.not_held(journal.deduplicate(rows.filter("id % 3 = 0")), journal.held_sequences(rows.filter("id % 3 <> 0"))).select("id")


@_query("d1_estimated_instant", """, a AS (SELECT dev, ses, arg_min(up, id) AS a0, arg_min(obs, id) AS ao FROM j GROUP BY 1, 2)
SELECT chave AS chave_de_idempotencia, CASE WHEN up >= a0 THEN epoch_us(ao) // 1000 + up - a0 END AS estimado_ms FROM j JOIN a USING (dev, ses)""")
def d1(e):
    rows = _journal(e, by_session=True)
    return timeline.estimate(rows, timeline.anchors(rows)).select("chave_de_idempotencia", F.unix_millis("instante_estimado").alias("estimado_ms"))


_W4 = """, g AS (SELECT dev, ses, s, lag(s) OVER (PARTITION BY dev, ses ORDER BY s) AS b FROM j)
SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, b + 1 AS primeira, s - 1 AS ultima, s - b - 1 AS perdidos FROM g WHERE s - b > 1"""


@_query("w4_sequence_gaps", _W4)
def w4(e):
    return timeline.sequence_gaps(_journal(e, by_session=True))


@_query("w4_sequence_gaps_bucketed", _W4)
def w4b(e):
    return timeline.sequence_gaps_bucketed(_journal(e), 4)


_W5 = """, p AS (SELECT dev, ses, k % 2 AS m, k % 4 AS c, up - lag(up) OVER (PARTITION BY dev, ses, k % 2, k % 4 ORDER BY up, s) AS passo FROM j WHERE tipo = 'amostra_escalar')
SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, CAST(m AS BIGINT) AS modulo, CAST(c AS BIGINT) AS canal, max(passo) AS maior_passo_ms, max(passo) > 10800000 AS alarme FROM p WHERE passo IS NOT NULL GROUP BY 1, 2, 3, 4"""


@_query("w5_sampling_pauses", _W5)
def w5(e):
    return timeline.sampling_pauses(projection.with_address(_journal(e, by_session=True).filter("amostra_escalar IS NOT NULL")), 3_600_000)


@_query("w5_sampling_pauses_bucketed", _W5)
def w5b(e):
    return timeline.sampling_pauses_bucketed(projection.with_address(_journal(e).filter("amostra_escalar IS NOT NULL")), 3_600_000)


@_query("w6_bindings", "SELECT ponto, mdev AS dispositivo, CAST(mm AS BIGINT) AS modulo, CAST(cc AS BIGINT) AS canal, coalesce(de, TIMESTAMP '1970-01-01') AS desde, ate FROM map")
def w6(e):
    return commissioning.bindings(source.mapping(e))


_W7 = """, t AS (SELECT *, k % 6 + 1 AS estado, lag(k % 6 + 1) OVER (PARTITION BY dev, k % 4 ORDER BY id) AS antes FROM j WHERE tipo = 'mudanca_de_estado_de_maquina')
SELECT chave AS chave_de_idempotencia, CAST(estado AS INTEGER) AS estado FROM t WHERE antes IS NULL OR antes <> estado"""


def _changes(e):
    return projection.with_address(_journal(e).filter("mudanca_de_estado_de_maquina IS NOT NULL")).withColumn("estado", F.col("mudanca_de_estado_de_maquina.estado"))


@_query("w7_transitions", _W7)
def w7(e):
    return timeline.transitions(_changes(e), ["id_do_dispositivo", "canal"], "estado", ["id"]).select("chave_de_idempotencia", F.col("estado").cast("int").alias("estado"))


@_query("w7_transitions_bucketed", _W7)
def w7b(e):
    return timeline.transitions_bucketed(_changes(e), ["id_do_dispositivo", "canal"], "estado", "id", 500).select("chave_de_idempotencia", F.col("estado").cast("int").alias("estado"))


@_query("j5_commissioning", """, dm AS (SELECT * FROM map WHERE mdev IN (SELECT dev FROM dec) AND (de IS NULL OR de <= TIMESTAMP '2024-02-01') AND (ate IS NULL OR TIMESTAMP '2024-02-01' < ate)),
b AS (SELECT coalesce(dev, mdev) AS dv, coalesce(m, mm) AS m, coalesce(c, cc) AS c, dg, du, g, u, ponto, CASE WHEN ponto IS NULL THEN 1 WHEN dev IS NULL THEN 2 WHEN dg <> g THEN 3 WHEN du <> u THEN 4 END AS n
 FROM dec FULL OUTER JOIN dm ON dev = mdev AND m = mm AND c = cc)
SELECT dv AS id_do_dispositivo, dv || '@' || m || '/' || c AS canal_texto, ['unconfigured_channel', 'missing_channel', 'quantity_mismatch', 'unit_mismatch'][n] AS especie, ponto,
 CASE n WHEN 1 THEN dg || ' em ' || du WHEN 3 THEN dg WHEN 4 THEN du END AS declarado, CASE n WHEN 2 THEN g || ' em ' || u WHEN 3 THEN g WHEN 4 THEN u END AS esperado, ['nenhum ponto usa este canal; inclua-o na instalacao ou desligue-o na origem', 'a origem nao declara este canal; verifique ligacao e numero do canal',
 'grandeza declarada nao e a do ponto; compare os fios com o desenho', 'unidade declarada nao e a do ponto; ajuste o instrumento ou a instalacao'][n] AS acao FROM b WHERE n IS NOT NULL""")
def j5(e):
    rows = commissioning.divergences(commissioning.latest_descriptors(_journal(e)), source.mapping(e), NOW)
    return rows.select("id_do_dispositivo", "canal_texto", "especie", "ponto", "declarado", "esperado", "acao")


@_query("j6_overlaps", "SELECT DISTINCT ponto FROM map a WHERE EXISTS (SELECT 1 FROM map b WHERE a.mdev = b.mdev AND a.cc = b.cc AND a.de IS DISTINCT FROM b.de AND coalesce(a.de, TIMESTAMP '0001-01-01') < coalesce(b.ate, TIMESTAMP '9999-01-01') AND coalesce(b.de, TIMESTAMP '0001-01-01') < coalesce(a.ate, TIMESTAMP '9999-01-01'))")
def j6(e):
    return validate.overlaps(source.mapping(e), ["ponto"]).select("ponto").distinct()


@_query("j6_overlaps_found", """ SELECT DISTINCT ponto FROM map WHERE cc = 0 AND CAST(substr(mdev, 5) AS INTEGER) % 6 = 0 AND CAST(substr(mdev, 5) AS INTEGER) % 34 <> 0""")
def j6b(e):
    rows = source.faulty_mapping(e).withColumn("ponto", F.ltrim("ponto", F.lit("-")))
    return validate.overlaps(rows, ["ponto"]).select("ponto").distinct()


@_query("c1_draft_mapping", """SELECT dev AS id_do_dispositivo, CAST(m AS BIGINT) AS modulo, CAST(c AS BIGINT) AS canal, coalesce(ponto, 'AJUSTAR-' || dev || '-canal-' || c) AS ponto, dg AS grandeza, du AS unidade FROM dec
 LEFT JOIN map ON dev = mdev AND m = mm AND c = cc AND (de IS NULL OR de <= TIMESTAMP '2024-02-01') AND (ate IS NULL OR TIMESTAMP '2024-02-01' < ate)""")
def c1(e):
    return commissioning.draft_mapping(commissioning.latest_descriptors(_journal(e)), source.mapping(e), NOW)


@_query("o1_journal_page", "SELECT id, chave AS chave_de_idempotencia FROM j WHERE id > 1000 ORDER BY id LIMIT 500")
def o1(e):
    return journal.page(_journal(e), 1000, 500).select("id", "chave_de_idempotencia")


@_query("o2_oldest_page", "SELECT id, chave AS chave_de_idempotencia FROM j ORDER BY id LIMIT 100")
def o2(e):
    return journal.readings_page(_journal(e)).select("id", "chave_de_idempotencia")


@_query("o4_value_series", "SELECT obs AS instante_observado, ponto || ' (' || coalesce(u, '?') || ')' AS serie, num AS valor FROM leitura WHERE campo = 'value' AND ponto IS NOT NULL AND obs BETWEEN TIMESTAMP '2024-01-05' AND TIMESTAMP '2024-01-20'")
def o4(e):
    return monitoring.value_series(monitoring.between(_readings(e, "value"), "2024-01-05", "2024-01-20"))


@_query("o5_state_changes", "SELECT obs AS instante_observado, coalesce(ponto, dev) AS ponto, txt AS estado, rotulo AS motivo FROM leitura WHERE campo = 'machine_state' ORDER BY obs DESC, dev, ses, s LIMIT 200")
def o5(e):
    return monitoring.state_changes(_readings(e, "machine_state"))


@_query("o6_count_series", "SELECT obs AS instante_observado, coalesce(ponto, dev) AS serie, num AS valor FROM leitura WHERE campo = 'accumulated_count'")
def o6(e):
    return monitoring.count_series(_readings(e, "accumulated_count"))


@_query("o7_memory_series", "SELECT obs AS instante_observado, dev || ' — ' || CASE campo WHEN 'heap_free_bytes' THEN 'livre total' ELSE 'maior bloco' END AS serie, num AS valor FROM leitura WHERE campo IN ('heap_free_bytes', 'heap_largest_free_block_bytes')")
def o7(e):
    return monitoring.memory_series(_readings(e, "heap_free_bytes", "heap_largest_free_block_bytes"))


@_query("t8_prune", "SELECT id FROM j WHERE NOT (id <= 5000 AND obs < TIMESTAMP '2024-01-20')")
def t8(e):
    cursors = e.sparkSession.createDataFrame([("a", 5000), ("b", 7000)], "nome string, ultimo_id_projetado long")
    return journal.prune(_journal(e), cursors, "2024-01-20").select("id")


@_query("d2_reaggregate", """SELECT dev AS id_do_dispositivo, date_trunc('hour', obs) AS janela, sum(k + 1) AS quantidade, round(min(value * 0.5::DOUBLE), 6) AS minimo, round(max(value * 1.5::DOUBLE), 6) AS maximo,
 round(sum(value * (k + 1)) / sum(k + 1), 6) AS media, round(sqrt(sum(power(value * 1.1::DOUBLE, 2) * (k + 1)) / sum(k + 1)), 6) AS valor_eficaz FROM j WHERE tipo = 'amostra_agregada' GROUP BY 1, 2""")
def d2(e):
    rows = _journal(e).filter("amostra_agregada IS NOT NULL").select("id_do_dispositivo", "instante_observado", "amostra_agregada.*")
    out = rollup.reaggregate(rows, ["id_do_dispositivo"])
    return out.select("id_do_dispositivo", "janela", "quantidade", *[F.round(c, 6).alias(c) for c in ("minimo", "maximo", "media", "valor_eficaz")])


@_query("d2_windows_by_end", """, a AS (SELECT dev, ses, arg_min(up, id) AS a0, arg_min(obs, id) AS ao FROM j GROUP BY 1, 2),
p AS (SELECT dev, k + 1 AS n, value, (k + 1) * 60000 AS w, epoch_us(ao) // 1000 + up - a0 AS z FROM j JOIN a USING (dev, ses) WHERE tipo = 'amostra_agregada' AND up >= a0),
b AS (SELECT *, n * CAST(least(z, (h + 1) * 3600000) - greatest(z - w, h * 3600000) AS DOUBLE) / w AS f FROM p, LATERAL (SELECT unnest(generate_series((z - w) // 3600000, (z - 1) // 3600000)) AS h))
SELECT dev AS id_do_dispositivo, make_timestamp(h * 3600000000) AS janela, round(sum(f), 6) AS quantidade, round(min(value * 0.5::DOUBLE), 6) AS minimo, round(max(value * 1.5::DOUBLE), 6) AS maximo,
 round(sum(value * f) / sum(f), 6) AS media, round(sqrt(sum(power(value * 1.1::DOUBLE, 2) * f) / sum(f)), 6) AS valor_eficaz FROM b GROUP BY 1, 2""")
def d2b(e):
    rows = _journal(e, by_session=True)
    # Windows of up to 100 minutes, so that many cross an hour.
    rows = timeline.estimate(rows, timeline.anchors(rows)).filter("amostra_agregada IS NOT NULL AND instante_estimado IS NOT NULL").select("id_do_dispositivo", "instante_estimado", "amostra_agregada.*")
    out = rollup.reaggregate_by_end(rows.withColumn("janela_ms", F.col("quantidade") * 60_000), ["id_do_dispositivo"], "instante_estimado")
    return out.select("id_do_dispositivo", "janela", *[F.round(c, 6).alias(c) for c in ("quantidade", "minimo", "maximo", "media", "valor_eficaz")])


@_query("d3_merged_days", """SELECT dev AS id_do_dispositivo, campo AS nome_do_campo, date_trunc('week', obs)::TIMESTAMP AS semana, count(*) AS quantidade, round(min(num), 6) AS minimo, round(max(num), 6) AS maximo,
 round(avg(num), 6) AS media, round(sqrt(avg(num * num)), 6) AS valor_eficaz FROM leitura WHERE classe = 'sample' AND num IS NOT NULL GROUP BY 1, 2, 3""")
def d3c(e):
    keys = ["id_do_dispositivo", "nome_do_campo"]
    days = rollup.day_parts(_readings(e), keys)
    weeks = rollup.merge_parts(days.withColumn("semana", F.date_trunc("week", "hora")), [*keys, "semana"])
    return weeks.select(*keys, "semana", "quantidade", *[F.round(c, 6).alias(c) for c in ("minimo", "maximo", "media", "valor_eficaz")])


@_query("d3_retained_rows", "SELECT classe AS classe_de_dado, count(*) AS linhas FROM leitura WHERE CASE WHEN classe = 'sample' THEN date_diff('day', CAST(obs AS DATE), DATE '2024-02-01') <= 7 ELSE date_diff('day', CAST(obs AS DATE), DATE '2024-02-01') <= 1825 END GROUP BY 1")
def d3(e):
    return rollup.retain(_readings(e), NOW)[0].groupBy("classe_de_dado").agg(F.count(F.lit(1)).alias("linhas"))


@_query("d3_hourly_samples", """SELECT dev AS id_do_dispositivo, ponto AS id_do_ponto_de_medicao, campo AS nome_do_campo, date_trunc('hour', obs) AS hora, count(*) AS quantidade, min(num) AS minimo, max(num) AS maximo,
 round(avg(num), 6) AS media FROM leitura WHERE classe = 'sample' AND num IS NOT NULL AND date_diff('day', CAST(obs AS DATE), DATE '2024-02-01') BETWEEN 8 AND 365 GROUP BY 1, 2, 3, 4""")
def d3b(e):
    return rollup.retain(_readings(e), NOW)[1].withColumn("media", F.round("media", 6))


_D4 = "SELECT chave AS chave_de_idempotencia, s * 10 - coalesce(lag(s * 10) OVER (PARTITION BY dev, ses, k % 2, k % 4 ORDER BY s), 0) AS incremento FROM j WHERE tipo = 'leitura_de_contador'"


def _counters(e):
    return projection.with_address(_journal(e).filter("leitura_de_contador IS NOT NULL")).withColumn("contagem_acumulada", F.col("leitura_de_contador.contagem_acumulada"))


@_query("d4_increments", _D4)
def d4(e):
    return rollup.increments(_counters(e)).select("chave_de_idempotencia", "incremento")


@_query("d4_increments_bucketed", _D4)
def d4b(e):
    return rollup.increments_bucketed(_counters(e), 3).select("chave_de_idempotencia", "incremento")


@_query("d6_silent_minutes", """, c AS (SELECT date_trunc('minute', obs) AS minuto, dev, count(*) AS n FROM leitura GROUP BY 1, 2),
sp AS (SELECT dev, unnest(generate_series(min(minuto), max(minuto), INTERVAL 1 MINUTE)) AS minuto FROM c GROUP BY 1)
SELECT sp.dev AS id_do_dispositivo, date_trunc('hour', sp.minuto)::TIMESTAMP AS hora, count(*) AS minutos, count(*) FILTER (n IS NULL) AS silenciosos, CAST(coalesce(sum(n), 0) AS BIGINT) AS registros
FROM sp LEFT JOIN c USING (dev, minuto) GROUP BY 1, 2""")
def d6(e):
    return monitoring.silent_hours(_readings(e))


@_query("d6_silent_stretches", """, c AS (SELECT DISTINCT dev, date_trunc('minute', obs) AS minuto FROM leitura),
l AS (SELECT *, lag(minuto) OVER (PARTITION BY dev ORDER BY minuto) AS antes FROM c)
SELECT dev AS id_do_dispositivo, antes + INTERVAL 1 MINUTE AS primeiro, minuto - INTERVAL 1 MINUTE AS ultimo, date_diff('minute', antes, minuto) - 1 AS minutos FROM l WHERE date_diff('minute', antes, minuto) > 1""")
def d6b(e):
    return monitoring.silent_stretches(_readings(e))


_D7 = """, t AS (SELECT dev, txt AS estado, epoch_us(lead(obs) OVER (PARTITION BY dev ORDER BY obs, ses, s)) // 1000 - epoch_us(obs) // 1000 AS dur FROM leitura WHERE campo = 'machine_state')
SELECT dev AS id_do_dispositivo, estado, CAST(sum(dur) AS BIGINT) AS duracao_ms, count(*) AS intervalos FROM t WHERE dur IS NOT NULL GROUP BY 1, 2"""


def _states(e):
    return _readings(e, "machine_state").withColumn("estado", F.col("valor_texto"))


@_query("d7_time_in_state", _D7)
def d7(e):
    return rollup.time_in_state(_states(e), "id_do_dispositivo")


@_query("d7_time_in_state_bucketed", _D7)
def d7b(e):
    return rollup.time_in_state_bucketed(_states(e), "id_do_dispositivo")


@_query("d9_fragmentation", "SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, s AS numero_de_sequencia, CAST(100000 - k * 500 AS DOUBLE) AS livre, CAST((100000 - k * 500) // (1 + k % 5) AS DOUBLE) AS maior_bloco, CAST((100000 - k * 500) // (1 + k % 5) AS DOUBLE) / (100000 - k * 500) AS razao FROM j WHERE tipo = 'saude_da_origem'")
def d9(e):
    return monitoring.fragmentation(_readings(e, "heap_free_bytes", "heap_largest_free_block_bytes"))


_FAULT = """CASE WHEN event_id % 83 = 0 THEN 'sem conteudo' WHEN event_id % 59 = 0 THEN 'versao do esquema' WHEN event_id % 53 = 0 THEN 'dispositivo' WHEN event_id % 73 = 0 THEN 'sessao de boot'
 WHEN event_id % 61 = 0 THEN 'tempo ligado' WHEN event_id % 89 = 0 THEN 'tamanho do conteudo' WHEN event_id % 67 = 0 THEN 'tipo de conteudo' WHEN event_id % 79 = 0 THEN 'conteudo indecifravel'
 WHEN event_id % 71 = 0 AND tipo IN ('amostra_agregada', 'mudanca_de_estado_de_maquina', 'saude_da_origem', 'lacuna_de_buffer', 'descritor_da_origem') THEN 'regra de ' || tipo END"""


@_query("v_validate", f"SELECT id, {_FAULT} AS motivo FROM d")
def v(e):
    return validate.validate(source.corrupted(source.deliveries(e))).select("id", "motivo")


@_query("v_acknowledge_rejected", f""", z AS (SELECT ship, s, {_FAULT} IS NOT NULL AS mau FROM d)
SELECT ship AS shipment_id, coalesce(max(s) FILTER (NOT mau), 0) AS duravel_ate, coalesce(array_to_string(list_sort(list(DISTINCT s) FILTER (mau)), ','), '') AS rejeitadas FROM z GROUP BY 1""")
def va(e):
    rows = journal.acknowledge_validated(validate.validate(source.corrupted(source.deliveries(e))))
    return rows.withColumn("rejeitadas", F.array_join(F.transform("rejeitadas", lambda x: x.cast("string")), ","))


@_query("v15_same_identity", "SELECT id FROM d WHERE event_id % 43 <> 0")
def v15(e):
    return validate.same_identity(source.receipts(source.deliveries(e))).select("id")


_FAULTY = """, f AS (SELECT mdev, mm, cc, CAST(substr(mdev, 5) AS INTEGER) AS n, ponto, ate, de,
 CASE WHEN CAST(substr(mdev, 5) AS INTEGER) % 34 = 0 AND ate IS NOT NULL THEN ate ELSE de END AS de2,
 CASE WHEN CAST(substr(mdev, 5) AS INTEGER) % 6 = 0 AND CAST(substr(mdev, 5) AS INTEGER) % 34 <> 0 AND ate IS NOT NULL THEN TIMESTAMP '2024-01-20' ELSE ate END AS ate2 FROM map)"""


@_query("v16_mapping_faults", _FAULTY + """ SELECT mdev AS dispositivo, CAST(cc AS BIGINT) AS canal, motivo FROM (SELECT *, CASE WHEN n % 14 = 0 THEN 'ponto' WHEN n % 10 = 0 AND cc = 1 THEN 'grandeza'
 WHEN n % 22 = 0 AND cc = 2 THEN 'unidade' WHEN n % 26 = 0 AND cc = 2 THEN 'faixa' WHEN de2 >= ate2 THEN 'vigencia' END AS motivo FROM f) WHERE motivo IS NOT NULL""")  # fmt: skip
def v16(e):
    return validate.mapping_faults(source.faulty_mapping(e)).select("dispositivo", "canal", "motivo")


@_query("j3_quarantine", """ SELECT id, CASE WHEN event_id % 83 = 0 OR event_id % 67 = 0 THEN 'tipo de conteudo' ELSE 'conteudo indecifravel' END AS motivo FROM d
 WHERE event_id % 83 = 0 OR event_id % 67 = 0 OR event_id % 79 = 0""")
def j3(e):
    return projection.split_decodable(source.corrupted(source.deliveries(e)))[1].select("id", "motivo")


@_query("d8_reprocess", """ SELECT id FROM d WHERE event_id % 79 = 0""")
def d8(e):
    sent = source.deliveries(e)
    whole = wire.split_refused(wire.decode_shipments(wire.encode_shipments(sent)))[0].select("shipment_id", "numero_de_sequencia", "conteudo_bruto")
    names = [c for c in sent.columns if c in CATALOG.by_name]
    lost = sent.filter("event_id % 79 = 0 OR event_id % 67 = 0").drop(*names).join(whole, ["shipment_id", "numero_de_sequencia"])
    lost = lost.withColumn("tipo_de_conteudo", F.when(F.col("event_id") % 79 == 0, F.col("tipo_de_conteudo")).otherwise("desconhecido"))
    again = wire.decode_contents(lost)
    return projection.split_decodable(again)[0].select("id")


@_query("j7_not_yet_written", """, b AS (SELECT * FROM d WHERE id % 3 = 0 QUALIFY row_number() OVER (PARTITION BY dev, ses, s ORDER BY id) = 1)
 SELECT id FROM b WHERE (dev, ses, s) NOT IN (SELECT (dev, ses, s) FROM d WHERE id % 3 <> 0)""")
def j7(e):
    rows = source.deliveries(e)
    return journal.not_yet_written(journal.deduplicate(rows.filter("id % 3 = 0")), journal.deduplicate(rows.filter("id % 3 <> 0"))).select("id")


@_query("t9_clock_steps", """, a AS (SELECT dev, ses, arg_min(up, id) AS a0, arg_min(obs, id) AS ao FROM j GROUP BY 1, 2)
 SELECT id, event_id % 3 <> 0 AND abs((epoch_us(obs) - epoch_us(ao)) * 1000 - (up * 1000000 + CASE WHEN event_id % 19 = 0 THEN 5000000000 ELSE 0 END - a0 * 1000000)) > 1000000000 AS salto_de_relogio
 FROM d JOIN a USING (dev, ses)""")
def t9(e):
    first = timeline.anchors(_journal(e, by_session=True))
    first = first.select(*timeline.SESSION, "instante_da_ancora", (F.col("ancora_ms") * 1_000_000).alias("decorrido_da_ancora_ns"), F.lit("run-a").alias("id_da_execucao"))
    return timeline.clock_steps(source.receipts(source.deliveries(e)), first).select("id", "salto_de_relogio")


@_query("t9_clock_state", """, q AS (SELECT *, up * 1000000 + CASE WHEN event_id % 19 = 0 THEN 5000000000 ELSE 0 END AS ns, CASE WHEN event_id % 3 = 0 THEN 'run-b' ELSE 'run-a' END AS run FROM d),
 a AS (SELECT dev, ses, arg_min(obs, id) AS ao, arg_min(ns, id) AS an, arg_min(run, id) AS ar FROM q GROUP BY 1, 2)
 SELECT id, run = ar AND abs((epoch_us(obs) - epoch_us(ao)) * 1000 - (ns - an)) > 1000000000 AS salto_de_relogio FROM q JOIN a USING (dev, ses)""")
def t9b(e):
    got = source.receipts(source.deliveries(e))
    return timeline.clock_steps(got, timeline.first_receipts(got).drop("ancora_ms", "id")).select("id", "salto_de_relogio")


@_query("d5_mute_channels", """, u AS (SELECT dev AS d2, k % 2 AS m2, k % 4 AS c2, max(obs) AS ultimo FROM j WHERE tipo IN ('amostra_escalar', 'leitura_de_contador', 'transicao_digital', 'amostra_agregada', 'mudanca_de_estado_de_maquina') GROUP BY 1, 2, 3)
 SELECT dev AS id_do_dispositivo, CAST(m AS BIGINT) AS modulo, CAST(c AS BIGINT) AS canal, c * 144000000::BIGINT AS periodo_ms, ultimo,
 c > 0 AND (ultimo IS NULL OR epoch_us(TIMESTAMP '2024-02-01') // 1000 - epoch_us(ultimo) // 1000 > 3 * c * 144000000::BIGINT) AS mudo FROM dec LEFT JOIN u ON dev = d2 AND m = m2 AND c = c2""")  # fmt: skip
def d5(e):
    rows = _journal(e)
    declared = commissioning.declared_channels(commissioning.latest_descriptors(rows))
    declared = declared.select("id_do_dispositivo", "modulo", "canal", F.col("periodo_de_amostragem_ms").alias("periodo_ms"))
    return monitoring.mute_channels(declared, monitoring.last_samples(projection.with_address(rows)), NOW)


@_query("s7_legacy_replay", """ SELECT event_id AS id, CASE WHEN event_id % 5 = 0 OR event_id % 7 = 0 THEN 'corrupt' ELSE 'ok' END AS estado, CASE WHEN event_id % 5 <> 0 AND event_id % 7 <> 0 THEN CAST(event_id % 100 AS DOUBLE) END AS valor
 FROM (SELECT event_id FROM e WHERE event_id % 2 = 0 ORDER BY 1 LIMIT 1000)""")
def s7(e):
    ok, corrupt, _ = legacy.replay_buffer(source.legacy_buffer(e), 1000)
    good = ok.select("id", F.lit("ok").alias("estado"), F.col("value").cast("double").alias("valor"))
    return good.unionByName(corrupt.select("id", F.lit("corrupt").alias("estado"), F.lit(None).cast("double").alias("valor")))


@_query("o3_legacy_latest", " SELECT ts AS time, event_type AS tag, round(value, 6) AS value FROM e ORDER BY ts DESC, event_type LIMIT 100")
def o3(e):
    rows = legacy.read_legacy(e.select(F.col("ts").alias("time"), F.col("event_type").alias("tag"), "value", F.lit("C").alias("unit")))
    return legacy.latest(rows).select("time", "tag", F.round(F.col("value").cast("double"), 6).alias("value"))


@_query("f5_policies", """SELECT chave AS chave_de_idempotencia, CASE classe WHEN 'sample' THEN 'best_effort' ELSE 'at_least_once' END AS entrega, CASE classe WHEN 'sample' THEN 'drop_oldest' ELSE 'record_gap' END AS saturacao,
 CAST(CASE classe WHEN 'sample' THEN 5000 ELSE 200 END AS INTEGER) AS latencia_maxima_ms, CASE classe WHEN 'sample' THEN 'memory' ELSE 'disk' END AS durabilidade,
 CAST(CASE classe WHEN 'sample' THEN 7 ELSE 1825 END AS INTEGER) AS retencao_bruta_dias, classe = 'sample' AS agregavel, CAST(CASE classe WHEN 'sample' THEN 365 ELSE 1825 END AS INTEGER) AS retencao_final_dias FROM j""")
def f5(e):
    return _journal(e).select("chave_de_idempotencia", policy(F.col("classe_de_dado")).alias("p")).select("chave_de_idempotencia", "p.*")


@_query("r3_field_map", "SELECT chave AS chave_de_idempotencia, string_agg(campo, ',' ORDER BY campo) AS campos, max(CASE WHEN campo IN ('machine_state', 'firmware_version') THEN txt WHEN campo = 'active' THEN CAST(log AS VARCHAR) WHEN campo = 'lost_record_count' THEN CAST(CAST(num AS INTEGER) AS VARCHAR) END) AS valor FROM leitura GROUP BY 1")
def r3(e):
    value = F.coalesce(*[F.col("campos")[n] for n in ("machine_state", "firmware_version", "active")], F.col("campos")["lost_record_count"].cast("double").cast("int").cast("string"))
    rows = projection.field_map(_journal(e))
    return rows.select("chave_de_idempotencia", F.array_join(F.sort_array(F.map_keys("campos")), ",").alias("campos_"), value.alias("valor")).withColumnRenamed("campos_", "campos")


@_query("r3_field_map_errors", """ SELECT dev || ':' || ses || ':' || s AS chave_de_idempotencia, CASE WHEN event_id % 83 = 0 OR event_id % 67 = 0 THEN 'tipo de conteudo' ELSE 'conteudo indecifravel' END AS erro_de_decodificacao
 FROM d WHERE event_id % 83 = 0 OR event_id % 67 = 0 OR event_id % 79 = 0""")
def r3b(e):
    rows = projection.field_map(source.corrupted(source.deliveries(e))).filter("erro_de_decodificacao IS NOT NULL AND campos IS NULL")
    return rows.select("chave_de_idempotencia", "erro_de_decodificacao")


@_query("f13_default_page", "SELECT id, chave AS chave_de_idempotencia FROM j ORDER BY id DESC LIMIT 100")
def f13(e):
    return journal.readings_page(_journal(e), page_limit("-3"), latest=True).select("id", "chave_de_idempotencia")


@_query("t5_counts_per_minute", "SELECT date_trunc('minute', obs) AS minuto, dev AS id_do_dispositivo, count(*) AS registros FROM leitura GROUP BY 1, 2")
def t5(e):
    return ingest.counts_per_minute(_readings(e))


@_query("r5_declared_channels", "SELECT dev AS id_do_dispositivo, CAST(m AS BIGINT) AS modulo, CAST(c AS BIGINT) AS canal, dg AS grandeza, du AS unidade, c * 144000000::BIGINT AS periodo_de_amostragem_ms FROM dec")
def r5(e):
    return commissioning.declared_channels(commissioning.latest_descriptors(_journal(e))).drop("declarado_em")


@_query("r6_content_types", """, c(tipo, classe) AS (SELECT DISTINCT tipo, classe FROM j)
SELECT tipo AS tipo_de_conteudo, classe AS classe_de_dado, CASE tipo WHEN 'amostra_escalar' THEN 'scalar sample' WHEN 'leitura_de_contador' THEN 'counter reading' WHEN 'transicao_digital' THEN 'digital transition'
 WHEN 'amostra_agregada' THEN 'aggregated sample' WHEN 'mudanca_de_estado_de_maquina' THEN 'machine state change' WHEN 'saude_da_origem' THEN 'source health' WHEN 'lacuna_de_buffer' THEN 'buffer gap'
 WHEN 'descritor_da_origem' THEN 'source descriptor' END AS descricao,
 (SELECT count(*) FROM j WHERE j.tipo = c.tipo) AS registros FROM c""")
def r6(e):
    types = [(c.name, c.data_class, c.description) for c in CATALOG.by_name.values()]
    types = e.sparkSession.createDataFrame(types, "tipo_de_conteudo string, classe_de_dado string, descricao string")
    counts = _journal(e).groupBy("tipo_de_conteudo").agg(F.count(F.lit(1)).alias("registros"))
    return counts.join(types, "tipo_de_conteudo").select("tipo_de_conteudo", "classe_de_dado", "descricao", "registros")


@_query("s1_decode_shipments", """SELECT ship AS shipment_id, s AS numero_de_sequencia, up AS tempo_ligado_ms, versao AS versao_do_esquema, dev AS id_do_dispositivo, tipo AS tipo_de_conteudo,
 CASE WHEN tipo = 'amostra_escalar' THEN CAST(CAST(value AS FLOAT) AS DOUBLE) END AS valor, CASE WHEN tipo = 'leitura_de_contador' THEN s * 10 END AS contagem_acumulada,
 CASE WHEN tipo = 'transicao_digital' THEN k % 8 >= 4 END AS ativo, CASE WHEN tipo = 'saude_da_origem' THEN -40 - k END AS dbm,
 CASE WHEN tipo = 'descritor_da_origem' THEN CASE WHEN user_id % 7 = 0 THEN 3 ELSE 4 END END AS canais FROM d""")  # fmt: skip
def s1(e):
    envelopes, _ = wire.split_refused(wire.decode_shipments(wire.encode_shipments(source.deliveries(e))))
    return envelopes.select(
        "shipment_id", "numero_de_sequencia", "tempo_ligado_ms", F.col("versao_do_esquema").cast("int").alias("versao_do_esquema"), "id_do_dispositivo", "tipo_de_conteudo",
        "amostra_escalar.valor", "leitura_de_contador.contagem_acumulada", "transicao_digital.ativo", F.col("saude_da_origem.dbm").cast("int").alias("dbm"),
        F.when(F.col("descritor_da_origem").isNotNull(), F.size("descritor_da_origem.canais")).alias("canais"),
    )


# Stored tables: what the writers of the library leave behind, read again.


@_query("s2_journal_table", "SELECT id, chave AS chave_de_idempotencia, tipo AS tipo_de_conteudo, obs AS instante_observado FROM j WHERE CAST(obs AS DATE) BETWEEN DATE '2024-01-05' AND DATE '2024-01-20'")
def s2(e):
    rows, path = _journal(e), scratch(e.sparkSession)
    for half in ("id % 2 = 0", "id % 2 = 1"):
        journal.append(rows.filter(half), path)
    return journal.read(e.sparkSession, path, "2024-01-05", "2024-01-20").select("id", "chave_de_idempotencia", "tipo_de_conteudo", "instante_observado")


_READINGS = "SELECT chave AS chave_de_idempotencia, campo AS nome_do_campo, num AS valor_numerico, txt AS valor_texto, log AS valor_logico, ponto AS id_do_ponto_de_medicao FROM leitura"
_READ = ("chave_de_idempotencia", "nome_do_campo", "valor_numerico", "valor_texto", "valor_logico", "id_do_ponto_de_medicao")


@_query("s3_readings_written_once", _READINGS)
def s3(e):
    rows, path = kept(_readings(e)), scratch(e.sparkSession)
    for part in ("numero_de_sequencia % 3 <> 0", "numero_de_sequencia % 3 <> 1", "true"):
        projection.write_readings(rows.filter(part), path)
    rows.unpersist()
    return e.sparkSession.read.parquet(path).select(*_READ)


@_query("s6_legacy_table", " SELECT ts AS time, event_type AS tag, round(value, 6) AS value, 'C' AS unit FROM e")
def s6(e):
    path = scratch(e.sparkSession)
    legacy.append(e.select(F.col("ts").alias("time"), F.col("event_type").alias("tag"), "value", F.lit("C").alias("unit")), path)
    rows = legacy.read_legacy(e.sparkSession.read.parquet(path))
    return rows.select("time", "tag", F.round(F.col("value").cast("double"), 6).alias("value"), "unit")


@_query("t1_ingested_batches", "SELECT id, dev || ':' || ses || ':' || s AS chave_de_idempotencia FROM d QUALIFY row_number() OVER (PARTITION BY dev, ses, s ORDER BY id % 3, id) = 1")
def t1c(e):
    rows, path = source.deliveries(e), scratch(e.sparkSession)
    ingest_batch = ingest.journal_batch(path)
    for n in range(3):
        ingest_batch(rows.filter(f"id % 3 = {n}"), n)
    return journal.read(e.sparkSession, path).select("id", "chave_de_idempotencia")


@_query("t2_projection_cycles", _READINGS)
def t2(e):
    spark, path = e.sparkSession, scratch(e.sparkSession)
    rows, ingest_batch = source.deliveries(e), ingest.journal_batch(f"{path}/journal")
    for n, sent in enumerate(("id < 10000000", "id >= 10000000")):  # redeliveries come later
        ingest_batch(rows.filter(sent), n)
    cursors, mapping, reasons = Cursors(spark, f"{path}/cursors"), source.mapping(e), source.reasons(e)
    ingest.project_backlog(spark, f"{path}/journal", cursors, "leitura", mapping, reasons, f"{path}/readings", f"{path}/quarantine", 5000)
    return spark.read.parquet(f"{path}/readings").select(*_READ)


@_query("t6_anchor_table", "SELECT dev AS id_do_dispositivo, ses AS id_da_sessao_de_boot, arg_min(up, (id % 2, id)) AS ancora_ms, arg_min(obs, (id % 2, id)) AS instante_da_ancora FROM j GROUP BY 1, 2")
def t6(e):
    rows, path = kept(_journal(e).select(*timeline.SESSION, "id", "tempo_ligado_ms", "instante_observado")), scratch(e.sparkSession)
    for n in range(2):
        ingest.anchor_batch(path)(rows.filter(f"id % 2 = {n}"), n)
    rows.unpersist()
    return ingest.read_anchors(e.sparkSession, path).drop("decorrido_da_ancora_ns", "id_da_execucao", "id")


@_query("t7_descriptor_table", "SELECT dev AS id_do_dispositivo, id, obs AS declarado_em FROM des")
def t7(e):
    rows, path = kept(_journal(e).filter("descritor_da_origem IS NOT NULL")), scratch(e.sparkSession)
    for n in range(3):
        ingest.descriptor_batch(path)(rows.filter(f"id % 3 = {n}"), n)
    rows.unpersist()
    return ingest.read_descriptors(e.sparkSession, path, rows.schema).select("id_do_dispositivo", "id", "declarado_em")


@_query("t8_pruned_table", "SELECT id FROM j WHERE NOT (id <= 5000 AND obs < TIMESTAMP '2024-01-20 12:00:00')")
def t8b(e):
    path = scratch(e.sparkSession)
    journal.append(_journal(e), path)
    cursors = e.sparkSession.createDataFrame([("a", 5000), ("b", 7000)], "nome string, ultimo_id_projetado long")
    journal.prune_table(e.sparkSession, path, cursors, "2024-01-20 12:00:00")
    return journal.read(e.sparkSession, path).select("id")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    name: (lambda spark, sf_dir, f=f: _plain(f(_events(spark, sf_dir)))) for name, f in Q.items()
}
ORACLE_SQL = SQL
