"""Content types, labels, data-class policies and small column functions of the telemetry model."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

# Labels and numbers of the contract.
MACHINE_STATES = {1: "running", 2: "stopped", 3: "setup", 4: "idle", 5: "planned_maintenance", 6: "breakdown"}
QUANTITIES = {
    0: "nao_especificado", 1: "temperatura", 2: "pressao", 3: "umidade_do_ar", 4: "vazao", 5: "massa", 6: "nivel", 7: "corrente_eletrica",
    8: "aceleracao_de_vibracao", 9: "estado_digital", 10: "contagem_de_pecas", 11: "ph", 12: "condutividade_eletrica", 13: "umidade_de_grao",
    14: "brix", 15: "rotacao", 16: "torque", 17: "velocidade_linear", 18: "tensao", 19: "potencia_ativa", 20: "energia_eletrica",
}
DIVERGENCES = {1: "unconfigured_channel", 2: "missing_channel", 3: "quantity_mismatch", 4: "unit_mismatch"}
#: What to do about each divergence.
ACTIONS = {
    "unconfigured_channel": "nenhum ponto usa este canal; inclua-o na instalacao ou desligue-o na origem",
    "missing_channel": "a origem nao declara este canal; verifique ligacao e numero do canal",
    "quantity_mismatch": "grandeza declarada nao e a do ponto; compare os fios com o desenho",
    "unit_mismatch": "unidade declarada nao e a do ponto; ajuste o instrumento ou a instalacao",
}
DAY_MS = 86_400_000
#: Per class: delivery, saturation, latency ms, local durability, raw days, aggregable, final days.
POLICIES = {
    "sample": ("best_effort", "drop_oldest", 5000, "memory", 7, True, 365),
    "discrete_event": ("at_least_once", "record_gap", 200, "disk", 1825, False, 1825),
}


@dataclass(frozen=True)
class Content:
    """A content type: its class, whether it has a channel address, and its projected fields (name, value kind, SQL over
    the content's struct column). Kinds: n numeric, t text, b boolean. A null text is not projected."""

    name: str
    data_class: str
    addressed: bool
    description: str
    fields: tuple[tuple[str, str, str], ...]
    rule: str = "true"


class Catalog:
    """The content types in use. Refuses an empty type, an unknown class, missing fields and a repeated type."""

    def __init__(self, contents: tuple[Content, ...] = ()) -> None:
        self.by_name: dict[str, Content] = {}
        for c in contents:
            self.add(c)

    def add(self, content: Content) -> None:
        if not content.name:
            raise ValueError("a content type needs a name")
        if content.data_class not in POLICIES:
            raise ValueError(f"{content.name}: unknown data class {content.data_class!r}")
        if not content.fields:
            raise ValueError(f"{content.name}: nothing to decode")
        if content.name in self.by_name:
            raise ValueError(f"{content.name} is registered already")
        self.by_name[content.name] = content


STATE_SQL = "CASE {c}.estado " + " ".join(f"WHEN {k} THEN '{v}'" for k, v in MACHINE_STATES.items()) + " END"
SIGNATURE_SQL = "array_join(transform({c}.canais, x -> concat(x.modulo, '/', x.canal, '=', x.grandeza, '/', x.unidade)), ';')"

CATALOG = Catalog(
    (
        Content("amostra_escalar", "sample", True, "scalar sample", (("value", "n", "{c}.valor"),)),
        Content("leitura_de_contador", "discrete_event", True, "counter reading", (("accumulated_count", "n", "{c}.contagem_acumulada"),)),
        Content("transicao_digital", "discrete_event", True, "digital transition", (("active", "b", "{c}.ativo"),)),
        Content(
            "amostra_agregada", "sample", True, "aggregated sample",
            (("window_ms", "n", "{c}.janela_ms"), ("sample_count", "n", "{c}.quantidade"), ("minimum", "n", "{c}.minimo"),
             ("maximum", "n", "{c}.maximo"), ("mean", "n", "{c}.media"), ("rms", "n", "{c}.valor_eficaz")),
            # NaN compares false upstream, so it never breaks the order of the bounds.
            "{c}.quantidade <> 0 AND {c}.janela_ms <> 0 AND ({c}.minimo <= {c}.maximo OR isnan({c}.minimo) OR isnan({c}.maximo))",
        ),
        Content(
            "mudanca_de_estado_de_maquina", "discrete_event", True, "machine state change",
            (("machine_state", "t", STATE_SQL), ("reason_code", "n", "{c}.codigo_do_motivo"), ("operator_acknowledged", "b", "{c}.cracha <> ''"),
             ("asserted_batch_id", "t", "nullif({c}.lote, '')")),
            "{c}.estado BETWEEN 1 AND 6 AND octet_length({c}.cracha) <= 64 AND octet_length({c}.lote) <= 64",
        ),
        Content(
            "saude_da_origem", "sample", False, "source health",
            (("heap_free_bytes", "n", "{c}.livre"), ("heap_largest_free_block_bytes", "n", "{c}.maior_bloco"), ("radio_signal_dbm", "n", "{c}.dbm"),
             ("reboot_count", "n", "{c}.reinicios"), ("discarded_record_count", "n", "{c}.descartados"), ("buffer_used_bytes", "n", "{c}.buffer")),
            "{c}.maior_bloco <= {c}.livre",
        ),
        Content(
            "lacuna_de_buffer", "discrete_event", False, "buffer gap",
            (("lost_record_count", "n", "{c}.perdidos"), ("first_lost_sequence", "n", "{c}.primeira"), ("last_lost_sequence", "n", "{c}.ultima")),
            "{c}.perdidos <> 0 AND {c}.ultima >= {c}.primeira",
        ),
        Content(
            "descritor_da_origem", "sample", False, "source descriptor",
            (("firmware_version", "t", "{c}.firmware"), ("hardware_model", "t", "{c}.modelo"), ("channel_count", "n", "size({c}.canais)"),
             ("channel_signature", "t", SIGNATURE_SQL), ("reason_catalog_version", "n", "{c}.versao_do_catalogo")),
            "size({c}.canais) <= 256 AND octet_length({c}.firmware) <= 64 AND octet_length({c}.modelo) <= 64 AND "
            "forall({c}.canais, x -> octet_length(coalesce(x.unidade, '')) <= 64) AND "
            "size(array_distinct(transform({c}.canais, x -> struct(x.modulo, x.canal)))) = size({c}.canais)",
        ),
    )
)

COMMON = (
    "chave_de_idempotencia", "id_do_dispositivo", "id_da_sessao_de_boot", "numero_de_sequencia", "tempo_ligado_ms", "instante_observado",
    "tipo_de_conteudo", "classe_de_dado",
)


def labels(values: dict, key: Column, other: str | None = None) -> Column:
    """The label of a key; ``other`` for keys without one."""
    found = F.create_map(*[F.lit(x) for kv in values.items() for x in kv])[key]
    return found if other is None else F.coalesce(found, F.lit(other))


def machine_state(number: Column) -> Column:
    """Null for 0 and for unknown numbers, which are rejected."""
    return labels(MACHINE_STATES, number)


def quantity(number: Column) -> Column:
    return labels(QUANTITIES, number, "desconhecida")


def data_class(content_type: Column) -> Column:
    return labels({c.name: c.data_class for c in CATALOG.by_name.values()}, content_type)


def policy(column: Column) -> Column:
    """Policies of a data class; an unknown class takes those of events."""
    def struct(p: tuple) -> Column:
        names = ("entrega", "saturacao", "latencia_maxima_ms", "durabilidade", "retencao_bruta_dias", "agregavel", "retencao_final_dias")
        return F.struct(*[F.lit(v).alias(n) for n, v in zip(names, p)])

    return F.when(column == "sample", struct(POLICIES["sample"])).otherwise(struct(POLICIES["discrete_event"]))


def idempotency_key(device: Column, session: Column, sequence: Column) -> Column:
    return F.concat_ws(":", device, session, sequence.cast("string"))


def address_text(module: Column, channel: Column) -> Column:
    return F.concat_ws("/", F.coalesce(module, F.lit(0)).cast("string"), F.coalesce(channel, F.lit(0)).cast("string"))


def channel_key(device: Column, module: Column, channel: Column) -> Column:
    return F.concat(device, F.lit("@"), address_text(module, channel))


def in_force(start: Column, end: Column, at: Column) -> Column:
    """Validity closed at its start and open at its end; a null bound is open."""
    return (start.isNull() | (at >= start)) & (end.isNull() | (at < end))


def out_of_range(value: Column, low: Column, high: Column) -> Column:
    """An absent bound never fires, and NaN is never out of range."""
    above = F.coalesce(value > high, F.lit(False))
    return ~F.isnan(value) & (F.coalesce(value < low, F.lit(False)) | above)


def series_label(point: Column, unit: Column) -> Column:
    return F.concat(point, F.lit(" ("), F.coalesce(unit, F.lit("?")), F.lit(")"))


def page_limit(asked: object, default: int = 100, most: int = 1000) -> int:
    """A page size: the default for anything that is no positive number, and never above the maximum."""
    try:
        n = int(asked)  # type: ignore[call-overload]
    except (TypeError, ValueError):
        return default
    return min(n, most) if n > 0 else default


def struct_of(content: Content, prefix: str = "") -> Callable[[str], Column]:
    """SQL over a content's struct as a column."""
    return lambda sql: F.expr(sql.format(c=f"{prefix}{content.name}"))
