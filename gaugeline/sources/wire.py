"""Binary shipments of the telemetry contract: decoding to envelope rows, and encoding of envelope rows.

A shipment is a protocol buffer message. A slice of an Arrow batch is decoded level by level, all its shipments, envelopes
and contents together, into columns; what is malformed or says a thing twice is read again message by message, which also
states what must come out. Envelopes are encoded field by field, all rows of a batch together. Spreading, grouping and validation are left to Spark.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from ..functions.catalog import QUANTITIES
from .scan import PAD, Fields, column, packed, scan, slices, varint_bytes

# Limits and field numbers of the contract. Kinds: u unsigned, i signed, f float, b boolean, s text.
MAX_BODY = 4 << 20
MAX_ENVELOPES = 1000
#: Bytes of shipments, about, and number of them at most, that are decoded together.
SLICE_BYTES, SLICE = 8 << 20, 4096
SHIPMENT = {1: ("versao_do_esquema", "u"), 2: ("id_da_instalacao", "s"), 3: ("id_do_dispositivo", "s"), 4: ("id_da_sessao_de_boot", "s")}
ENVELOPES = 5
ENVELOPE = {1: ("numero_de_sequencia", "u"), 2: ("tempo_ligado_ms", "u")}
ADDRESS = {1: ("modulo", "u"), 2: ("canal", "u")}
CHANNEL = {2: ("grandeza", "u"), 3: ("unidade", "s"), 4: ("periodo_de_amostragem_ms", "u")}
CONTENTS: dict[int, tuple[str, bool, dict[int, tuple[str, str]]]] = {
    3: ("amostra_escalar", True, {2: ("valor", "f")}),
    4: ("leitura_de_contador", True, {2: ("contagem_acumulada", "u")}),
    5: ("transicao_digital", True, {2: ("ativo", "b")}),
    6: ("amostra_agregada", True, {2: ("janela_ms", "u"), 3: ("quantidade", "u"), 4: ("minimo", "f"), 5: ("maximo", "f"), 6: ("media", "f"), 7: ("valor_eficaz", "f")}),
    7: ("mudanca_de_estado_de_maquina", True, {2: ("estado", "i"), 3: ("codigo_do_motivo", "u"), 4: ("cracha", "s"), 5: ("lote", "s")}),
    8: ("saude_da_origem", False, {1: ("livre", "u"), 2: ("maior_bloco", "u"), 3: ("dbm", "i"), 4: ("reinicios", "u"), 5: ("descartados", "u"), 6: ("buffer", "u")}),
    9: ("lacuna_de_buffer", False, {1: ("perdidos", "u"), 2: ("primeira", "u"), 3: ("ultima", "u")}),
    10: ("descritor_da_origem", False, {1: ("firmware", "s"), 2: ("modelo", "s"), 4: ("versao_do_catalogo", "u")}),
}
DESCRIPTOR, CHANNELS = 10, 3
WIRE = {"u": 0, "i": 0, "b": 0, "f": 5, "s": 2}
EMPTY = {"u": 0, "i": 0, "b": False, "f": 0.0, "s": ""}
SQL_TYPE = {"u": "bigint", "i": "bigint", "b": "boolean", "f": "double", "s": "string"}


class Malformed(ValueError):
    """Bytes that are no message."""


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = 0
    for shift in range(0, 70, 7):
        if at >= len(data):
            break
        value |= (data[at] & 127) << shift
        at += 1
        if data[at - 1] < 128:
            return value & (1 << 64) - 1, at
    raise Malformed("varint")


def _fields(data: bytes) -> Iterator[tuple[int, int, int | bytes]]:
    """(number, wire type, value) of each field; groups, which the contract never uses, count as malformed."""
    at = 0
    while at < len(data):
        tag, at = _varint(data, at)
        number, wire = tag >> 3, tag & 7
        if not number:
            raise Malformed("field number")
        if wire == 0:
            value, at = _varint(data, at)
            yield number, wire, value
            continue
        if wire == 2:
            size, at = _varint(data, at)
        elif wire in (1, 5):
            size = 8 if wire == 1 else 4
        else:
            raise Malformed("wire type")
        if at + size > len(data):
            raise Malformed("cut short")
        yield number, wire, data[at : at + size]
        at += size


def _value(kind: str, raw: int | bytes):
    if kind == "f":
        return struct.unpack("<f", raw)[0]
    if kind == "s":
        try:
            return raw.decode("utf-8")
        except UnicodeDecodeError as bad:
            raise Malformed("text") from bad
    if kind == "b":
        return raw != 0
    # Beyond 63 bits a number wraps to a negative one, which validation then refuses.
    return raw - (1 << 64) if raw >> 63 else raw


def _message(data: bytes, spec: dict[int, tuple[str, str]], inner: tuple[int, ...] = ()) -> tuple[dict, dict[int, list[bytes]]]:
    """Scalar fields, absent ones with their default and the last of repeated ones, and the bytes of inner messages.
    A known number with another wire type is an unknown field, and is passed over like all unknown fields."""
    out = {name: EMPTY[kind] for name, kind in spec.values()}
    nested: dict[int, list[bytes]] = {n: [] for n in inner}
    for number, wire, raw in _fields(data):
        if number in nested and wire == 2:
            nested[number].append(raw)
        elif number in spec and wire == WIRE[spec[number][1]]:
            out[spec[number][0]] = _value(spec[number][1], raw)
    return out, nested


def _addressed(data: bytes, spec: dict[int, tuple[str, str]]) -> dict:
    fields, nested = _message(data, spec, (1,))
    return _message(b"".join(nested[1]), ADDRESS)[0] | fields


def _content(number: int, data: bytes) -> dict:
    _, addressed, spec = CONTENTS[number]
    if addressed:
        return _addressed(data, spec)
    if number != DESCRIPTOR:
        return _message(data, spec)[0]
    fields, nested = _message(data, spec, (CHANNELS,))
    channels = [_addressed(c, CHANNEL) for c in nested[CHANNELS]]
    return fields | {"canais": [c | {"grandeza": QUANTITIES.get(c["grandeza"], "desconhecida")} for c in channels]}


def _envelopes(body: bytes | None) -> list[dict]:
    """Rows of one shipment, or a single row with the reason why all of it is refused."""
    if body is None or len(body) > MAX_BODY:
        return [{"recusa": "corpo ausente" if body is None else "corpo acima do limite"}]
    try:
        head, nested = _message(body, SHIPMENT, (ENVELOPES,))
        rows = []
        for position, raw in enumerate(nested[ENVELOPES]):
            row, _ = _message(raw, ENVELOPE)
            kind, content, fields = 0, b"", {}
            for number, wire, value in _fields(raw):
                if number in CONTENTS and wire == 2:
                    fields = _content(number, value)
                    # Repeats of one content merge, another content takes the place of the one before.
                    content = content + value if number == kind else value
                    if number == kind:
                        fields = _content(number, content)
                    kind = number
            row |= head | {"posicao": position}
            if kind:
                row |= {"tipo_de_conteudo": CONTENTS[kind][0], "conteudo_bruto": content, CONTENTS[kind][0]: fields}
            rows.append(row)
    except Malformed:
        return [{"recusa": "remessa malformada"}]
    if not rows:
        return [{"recusa": "remessa sem envelopes"}]
    return rows if len(rows) <= MAX_ENVELOPES else [{"recusa": "envelopes demais"}]


def _content_type(number: int) -> str:
    name, addressed, spec = CONTENTS[number]
    columns = [f"{n}: {SQL_TYPE[k]}" for n, k in ([*ADDRESS.values()] if addressed else []) + [*spec.values()]]
    if number == DESCRIPTOR:
        columns.append("canais: array<struct<modulo: bigint, canal: bigint, grandeza: string, unidade: string, periodo_de_amostragem_ms: bigint>>")
    return f"{name} struct<{', '.join(columns)}>"


DECODED = ", ".join(
    ["recusa string", "posicao int", *[f"{n} {SQL_TYPE[k]}" for n, k in [*SHIPMENT.values(), *ENVELOPE.values()]], "tipo_de_conteudo string", "conteudo_bruto binary", *map(_content_type, CONTENTS)]
)


def _bytes_of(array: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column, with PAD bytes after them, and the offsets of its values."""
    offsets = np.frombuffer(array.buffers()[1], np.int32, len(array) + 1, array.offset * 4).astype(np.int64)
    raw = array.buffers()[2]
    data = np.frombuffer(raw, np.uint8)[: offsets[-1]] if raw is not None else np.zeros(0, np.uint8)
    return np.concatenate([data[offsets[0] :], np.zeros(PAD, np.uint8)]), offsets - offsets[0]


def _count(fields: Fields, mask: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(fields.message[mask], minlength=n)


def _addresses(data: np.ndarray, fields: Fields, n: int, odd: np.ndarray) -> list[pa.Array]:
    """modulo and canal of n messages; marks those with a malformed or a second address."""
    inner = (fields.number == 1) & (fields.wire == 2)
    own = fields.where(inner)
    found, bad = scan(data, own.at, own.at + own.size)
    odd[own.message[bad]] = True
    odd |= _count(fields, inner, n) > 1
    found.message = own.message[found.message]
    return [column(data, found, n, number, kind) for number, (_, kind) in ADDRESS.items()]


def _content_columns(data: np.ndarray, start: np.ndarray, stop: np.ndarray, number: int, kind: pa.StructType) -> tuple[pa.Array, np.ndarray]:
    """Contents of one type as structs, and which of them must be read one by one."""
    _, addressed, spec = CONTENTS[number]
    n = len(start)
    fields, odd = scan(data, start, stop)
    columns = _addresses(data, fields, n, odd) if addressed else []
    columns += [column(data, fields, n, f, k) for f, (_, k) in spec.items()]
    if number == DESCRIPTOR:
        inner = (fields.number == CHANNELS) & (fields.wire == 2)
        own = fields.where(inner)
        found, bad = scan(data, own.at, own.at + own.size)
        places = _addresses(data, found, len(own.at), bad)
        quantity, *others = (column(data, found, len(own.at), f, k) for f, (_, k) in CHANNEL.items())
        odd[own.message[bad]] = True
        names = [*QUANTITIES.values(), "desconhecida"]
        at = {k: i for i, k in enumerate(QUANTITIES)}
        which = np.array([at.get(q, len(names) - 1) for q in quantity.to_pylist()], np.int32)
        of = kind.field("canais").type.value_type
        each = pa.StructArray.from_arrays([*places, pa.array(names).take(pa.array(which)), *others], fields=list(of))
        ends = np.concatenate([[0], np.cumsum(_count(fields, inner, n))])
        columns.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each).cast(kind.field("canais").type))
    return pa.StructArray.from_arrays(columns, fields=list(kind)), odd


def _spread(small: pa.Array, rows: np.ndarray, n: int) -> pa.Array:
    """A column of n rows with values at some of them and nulls elsewhere."""
    index = np.full(n, -1, np.int64)
    index[rows] = np.arange(len(rows))
    return small.take(pa.array(index, mask=index < 0))


def _decode_columns(bodies: pa.Array, types: pa.Schema) -> tuple[list[pa.Array], np.ndarray, np.ndarray]:
    """Envelopes of all well-formed shipments of a slice as columns, the shipment of each, and the shipments to be read one
    by one: absent, refused or malformed ones, and those in which an envelope or a content says a thing twice."""
    data, offsets = _bytes_of(bodies)
    n = len(bodies)
    slow = bodies.is_null().to_numpy(zero_copy_only=False) | (np.diff(offsets) > MAX_BODY)
    top, bad = scan(data, offsets[:-1], np.where(slow, offsets[:-1], offsets[1:]))
    slow |= bad
    inner = (top.number == ENVELOPES) & (top.wire == 2)
    own, many = top.where(inner), _count(top, inner, n)
    slow |= (many == 0) | (many > MAX_ENVELOPES)
    of, rows = own.message, len(own.at)
    place = np.arange(rows) - (np.cumsum(many) - many)[of]
    fields, bad = scan(data, own.at, own.at + own.size)
    slow[of[bad]] = True
    content = np.isin(fields.number, list(CONTENTS)) & (fields.wire == 2)
    slow[of[_count(fields, content, rows) > 1]] = True
    body = fields.where(content)
    kind = np.zeros(rows, np.int64)
    kind[body.message] = body.number
    heads = {name: column(data, top, n, number, k).take(pa.array(of)) for number, (name, k) in SHIPMENT.items()}
    heads |= {name: column(data, fields, rows, number, k) for number, (name, k) in ENVELOPE.items()}
    names = pa.array([CONTENTS[c][0] for c in CONTENTS])
    heads["posicao"] = pa.array(place, pa.int32())
    heads["tipo_de_conteudo"] = names.take(pa.array(kind - min(CONTENTS), mask=kind == 0))
    heads["conteudo_bruto"] = _spread(slices(data, body.at, body.size), body.message, rows)
    for number, (name, _, _) in CONTENTS.items():
        mine = body.where(body.number == number)
        structs, odd = _content_columns(data, mine.at, mine.at + mine.size, number, types.field(name).type)
        slow[of[mine.message[odd]]] = True
        heads[name] = _spread(structs, mine.message, rows)
    heads["recusa"] = pa.nulls(rows, pa.string())
    keep = pa.array(~slow[of])
    return [heads[f.name].filter(keep) for f in types], of[~slow[of]], np.flatnonzero(slow)


def decode_shipments(shipments: DataFrame) -> DataFrame:
    """One row per envelope of the shipments' ``payload``, beside the other columns of its shipment.

    A shipment without body or above 4 MiB, a malformed one, and one with no or more than 1000 envelopes is refused
    whole: a single row with ``recusa``. An envelope without content has null tipo_de_conteudo, which validation
    refuses by itself. The bytes of a content are kept, so unknown fields survive. Absent fields have their defaults.
    An input column named like a decoded one gives way to it; an empty table gives an empty table.
    """
    new = StructType.fromDDL(DECODED)
    kept = shipments.drop("payload", *new.names).columns
    rows = shipments.select("payload", *[F.col(f"`{c}`") for c in kept])
    schema = StructType([*rows.schema.fields[1:], *new.fields])
    types = to_arrow_schema(new)

    def one_by_one(bodies: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        found = [_envelopes(body) for body in bodies.to_pylist()]
        flat = [row for rows in found for row in rows]
        return [pa.array([row.get(f.name) for row in flat], f.type) for f in types], np.repeat(np.arange(len(found)), [len(rows) for rows in found])

    def both(bodies: pa.Array) -> tuple[list[pa.Array], np.ndarray]:
        try:
            fast, of, slow = _decode_columns(bodies, types)
        except pa.ArrowInvalid:  # text that is none, in one of them
            return one_by_one(bodies)
        if not len(slow):
            return fast, of
        rest, at = one_by_one(bodies.take(pa.array(slow)))
        of = np.concatenate([of, slow[at]])
        order = np.argsort(of, kind="stable")
        return [pa.concat_arrays([a, b]).take(pa.array(order)) for a, b in zip(fast, rest)], of[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            _, offsets = _bytes_of(batch.column(0)) if batch.num_rows else (None, np.zeros(1, np.int64))
            at = 0
            while at < batch.num_rows:
                stop = int(np.searchsorted(offsets, offsets[at] + SLICE_BYTES, "right")) - 1
                part = batch.slice(at, max(1, min(stop - at, SLICE)))
                at += part.num_rows
                decoded, of = both(part.column(0))
                beside = [part.column(i).take(pa.array(of)) for i in range(1, part.num_columns)]
                yield pa.RecordBatch.from_arrays(beside + decoded, names=[*kept, *types.names])

    return rows.mapInArrow(run, schema)


def decode_contents(records: DataFrame) -> DataFrame:
    """Records with the structs of their contents decoded again from tipo_de_conteudo and conteudo_bruto. A type that is
    not known, and bytes that are no such content, leave all of them null. Other columns stay."""
    names = [name for name, _, _ in CONTENTS.values()]
    new = StructType.fromDDL(", ".join(map(_content_type, CONTENTS)))
    rows = records.drop(*names)
    schema, types = StructType([*rows.schema.fields, *new.fields]), to_arrow_schema(new)

    def one(number: int, body: bytes) -> dict | None:
        try:
            return _content(number, body)
        except Malformed:
            return None

    def contents(bodies: pa.Array, number: int, kind: pa.StructType) -> pa.Array:
        data, offsets = _bytes_of(bodies)
        try:
            fast, odd = _content_columns(data, offsets[:-1], offsets[1:], number, kind)
        except pa.ArrowInvalid:
            return pa.array([one(number, b) for b in bodies.to_pylist()], kind)
        if not odd.any():
            return fast
        slow = pa.array([one(number, b) for b in bodies.filter(pa.array(odd)).to_pylist()], kind)
        index = np.arange(len(bodies))
        index[odd] = len(bodies) + np.arange(int(odd.sum()))
        return pa.concat_arrays([fast, slow]).take(pa.array(index))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, bodies = batch.column("tipo_de_conteudo"), batch.column("conteudo_bruto")
            there = bodies.is_valid().to_numpy(zero_copy_only=False)
            decoded = []
            for number, (name, _, _) in CONTENTS.items():
                mine = np.flatnonzero(there & np.array([k == name for k in kinds.to_pylist()], bool))
                decoded.append(_spread(contents(bodies.take(pa.array(mine)), number, types.field(name).type), mine, batch.num_rows))
            yield pa.RecordBatch.from_arrays([*batch.columns, *decoded], names=[*batch.schema.names, *types.names])

    return rows.mapInArrow(run, schema)


def split_refused(decoded: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Envelopes, and the shipments that were refused whole."""
    return decoded.filter("recusa IS NULL").drop("recusa"), decoded.filter("recusa IS NOT NULL").drop(*StructType.fromDDL(DECODED).names[1:])


def _number(value: int) -> bytes:
    out = bytearray()
    value &= (1 << 64) - 1
    while value > 127:
        out.append(value & 127 | 128)
        value >>= 7
    out.append(value)
    return bytes(out)


def _sized(number: int, bodies: pa.Array) -> pa.Array:
    """Bodies as inner messages or texts of a field; null where there is none."""
    size = pc.binary_length(bodies).fill_null(0).to_numpy().astype(np.uint64)
    heads = packed(_number(number << 3 | 2), *varint_bytes(size))
    return pc.binary_join_element_wise(heads, bodies, b"")


def _encoded(columns: dict[str, pa.Array], spec: dict[int, tuple[str, str]]) -> dict[int, pa.Array]:
    """The fields of a message that have a column, by number; null where the value is."""
    out = {}
    for number, (name, kind) in spec.items():
        if (values := columns.get(name)) is None:
            continue
        if kind == "s":
            out[number] = _sized(number, values.cast(pa.binary()))
            continue
        if kind == "f":
            given = values.cast(pa.float64()).fill_null(0.0).to_numpy()
            with np.errstate(over="ignore"):
                short = given.astype("<f4")
            if (np.isinf(short) & np.isfinite(given)).any():
                raise OverflowError(f"{name}: too large for a float of 4 bytes")
            body = np.ascontiguousarray(short).view(np.uint8).reshape(-1, 4), np.full(len(short), 4)
        else:
            body = varint_bytes(pc.cast(values, pa.int64(), safe=False).fill_null(0).to_numpy().view(np.uint64))
        out[number] = packed(_number(number << 3 | WIRE[kind]), *body, values.is_valid().to_numpy(zero_copy_only=False))
    return out


def _joined(fields: dict[int, pa.Array], n: int) -> pa.Array:
    """Messages from their fields, in order of their numbers."""
    none = pa.array([b""], pa.binary()).take(pa.array(np.zeros(n, np.int64)))
    return pc.binary_join_element_wise(none, *(fields[k] for k in sorted(fields)), b"", null_handling="skip")


def _with_address(columns: dict[str, pa.Array], spec: dict[int, tuple[str, str]], n: int) -> pa.Array:
    return _joined({1: _sized(1, _joined(_encoded(columns, ADDRESS), n))} | _encoded(columns, spec), n)


def _columns(structs: pa.Array) -> dict[str, pa.Array]:
    return {structs.type.field(i).name: structs.field(i) for i in range(structs.type.num_fields)}


def _encode_contents(number: int, structs: pa.Array) -> pa.Array:
    """Bytes of contents of one type, none of them null."""
    _, addressed, spec = CONTENTS[number]
    n, columns = len(structs), _columns(structs)
    if addressed:
        return _with_address(columns, spec, n)
    fields = _encoded(columns, spec)
    if number == DESCRIPTOR:
        lists = columns["canais"]
        each = lists.flatten()
        if each.null_count:
            raise TypeError("canais: a channel is null")
        numbers = {v: k for k, v in QUANTITIES.items()}
        channel = _columns(each)
        at = pc.index_in(channel["grandeza"], value_set=pa.array(list(numbers)))
        channel["grandeza"] = pa.array(list(numbers.values()), pa.int64()).take(at).fill_null(0)
        bodies = _sized(CHANNELS, _with_address(channel, CHANNEL, len(each)))
        ends = np.concatenate([[0], np.cumsum(pc.list_value_length(lists).fill_null(0).to_numpy())]).astype(np.int64)
        data, offsets = _bytes_of(bodies)
        fields[CHANNELS] = slices(data, offsets[ends[:-1]], np.diff(offsets[ends]))
    return _joined(fields, n)


def _encode_envelopes(batch: pa.RecordBatch, contents: list[str]) -> pa.Array:
    """Each row of a batch as an envelope of a shipment: one pass of array operations a field, over all rows."""
    fields = _encoded({name: batch.column(name) for name, _ in ENVELOPE.values()}, ENVELOPE)
    for number, (name, _, _) in CONTENTS.items():
        mine = np.flatnonzero(batch.column(name).is_valid().to_numpy(zero_copy_only=False)) if name in contents else []
        if len(mine):
            own = _sized(number, _encode_contents(number, batch.column(name).take(pa.array(mine))))
            fields[number] = _spread(own, mine, batch.num_rows)
    return _sized(ENVELOPES, _joined(fields, batch.num_rows))


def encode_shipments(envelopes: DataFrame, keys: tuple[str, ...] = ("shipment_id",)) -> DataFrame:
    """The keys, instante_observado (the latest of the shipment) and payload: envelopes in order of their sequence.

    Envelopes of one shipment share device, session and schema version; with more than 1000 of them the receiver
    refuses it. Null fields are left out. An empty table gives an empty table.
    """
    contents = [name for name, _, _ in CONTENTS.values()]
    heads = [n for n, _ in SHIPMENT.values() if n in envelopes.columns]
    carried = [*keys, "instante_observado", *heads, "numero_de_sequencia", "tempo_ligado_ms"]
    rows = envelopes.select(*carried, *contents)
    schema = StructType([*rows.schema.fields[: len(carried)], *StructType.fromDDL("envelope binary, cabecalho binary").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bodies = _encode_envelopes(batch, contents)
            tops = _joined(_encoded({name: batch.column(name) for name in heads}, SHIPMENT), batch.num_rows)
            same = [batch.column(i) for i in range(len(carried))]
            yield pa.RecordBatch.from_arrays([*same, bodies, tops], names=[*carried, "envelope", "cabecalho"])

    parts = F.array_sort(F.collect_list(F.struct("numero_de_sequencia", "envelope")))
    body = F.aggregate(parts, F.first("cabecalho"), lambda done, x: F.concat(done, x["envelope"]))
    return rows.mapInArrow(run, schema).groupBy(*keys).agg(F.max("instante_observado").alias("instante_observado"), body.alias("payload"))
