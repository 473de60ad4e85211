"""Binary shipments, the installation file and the relational read model."""

import random
import struct
import time
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaugeline.operators import journal, projection, validate
from gaugeline.sources import events as source
from gaugeline.sources import installation, relational, wire

DIR = "/root/testdata/sf0.001"
# A shipment by hand: version 1, device "d", session "s", one counter reading of 300 at module 0, channel 2.
HEAD = b"\x08\x01\x1a\x01d\x22\x01s"
COUNTER = b"\x22\x07\x0a\x02\x10\x02\x10\xac\x02"
ENVELOPE = b"\x08\x05\x10\x64" + COUNTER


def sized(body, tag=b"\x2a"):
    assert len(body) < 128
    return tag + bytes([len(body)]) + body


def decode(spark, *bodies):
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None, "clash") for i, b in enumerate(bodies)], "n int, payload binary, tipo_de_conteudo string")
    return wire.decode_shipments(rows.withColumn("instante_observado", F.lit("2024-01-01 00:00:00").cast("timestamp"))).orderBy("n", "posicao")


def test_known_bytes(spark):
    row = decode(spark, HEAD + sized(ENVELOPE)).first()
    assert (row["numero_de_sequencia"], row["tempo_ligado_ms"], row["id_do_dispositivo"], row["recusa"]) == (5, 100, "d", None)
    assert row["tipo_de_conteudo"] == "leitura_de_contador" and row["leitura_de_contador"].asDict() == {"modulo": 0, "canal": 2, "contagem_acumulada": 300}
    assert bytes(row["conteudo_bruto"]) == COUNTER[2:]


def test_refusals(spark):
    unknown = sized(ENVELOPE[:4] + b"\x22\x09\x0a\x02\x10\x02\x10\xac\x02\x78\x01")
    many = HEAD + sized(b"\x08\x05") * 1001
    bodies = [None, b"", HEAD, HEAD + b"\x2a\x7f", HEAD + sized(b"\x08\x05"), HEAD + unknown, many, HEAD[:4] + b"\x01\xff" + sized(ENVELOPE), bytes(wire.MAX_BODY + 1)]
    got = {r["n"]: r for r in decode(spark, *bodies).collect()}
    assert [got[i]["recusa"] for i in range(9)] == [
        "corpo ausente", "remessa sem envelopes", "remessa sem envelopes", "remessa malformada", None, None, "envelopes demais", "remessa malformada", "corpo acima do limite",
    ]
    assert got[4]["tipo_de_conteudo"] is None
    # An unknown field passes, and its bytes stay.
    assert got[5]["leitura_de_contador"]["contagem_acumulada"] == 300 and bytes(got[5]["conteudo_bruto"]).endswith(b"\x78\x01")


def test_a_bad_envelope_only_rejects_itself(spark):
    wide = b"\x08\x06\x10" + b"\xff" * 9 + b"\x01" + COUNTER
    envelopes, refused = wire.split_refused(decode(spark, HEAD + sized(ENVELOPE) + sized(b"\x08\x07") + sized(wide) + sized(b"\x08\x08\x1a\x00")))
    found = validate.validate(envelopes).orderBy("posicao").collect()
    assert [r["motivo"] for r in found] == [None, "sem conteudo", "tempo ligado", "tamanho do conteudo"] and refused.count() == 0


def test_empty_tables(spark):
    none = spark.createDataFrame([], "payload binary")
    assert wire.decode_shipments(none).count() == 0
    assert wire.encode_shipments(source.deliveries(spark.read.parquet(f"{DIR}/events.parquet")).limit(0)).count() == 0


def test_round_trip_keeps_every_content(spark):
    sent = source.deliveries(spark.read.parquet(f"{DIR}/events.parquet"))
    got, _ = wire.split_refused(wire.decode_shipments(wire.encode_shipments(sent)))
    for name in ("leitura_de_contador", "mudanca_de_estado_de_maquina", "saude_da_origem", "lacuna_de_buffer", "descritor_da_origem"):
        key = ["shipment_id", "numero_de_sequencia", F.to_json(name).alias("c")]
        a, b = sent.filter(F.col(name).isNotNull()).select(*key), got.filter(F.col(name).isNotNull()).select(*key)
        assert a.count() == b.count() > 0
        # A descriptor's columns come in another order; the next lines look at those.
        assert name == "descritor_da_origem" or a.exceptAll(b).count() == 0
    assert got.filter(F.col("descritor_da_origem").isNotNull()).select(F.explode("descritor_da_origem.canais.grandeza")).distinct().count() == 4
    periods = got.filter(F.col("descritor_da_origem").isNotNull()).select(F.explode("descritor_da_origem.canais.periodo_de_amostragem_ms").alias("p")).distinct()
    assert sorted(r["p"] for r in periods.collect()) == [n * source.PERIOD_MS for n in range(4)]
    again = wire.decode_contents(got)
    assert again.select("posicao", "shipment_id", "descritor_da_origem").exceptAll(got.select("posicao", "shipment_id", "descritor_da_origem")).count() == 0


FILE = """
instalacao: planta
motivos_de_parada: {versao: 2, codigos: {10: "Troca"}}
pontos_de_medicao:
  - {dispositivo: dev-1, modulo: 0, canal: 1, ponto: linha.a, grandeza: Temperatura, unidade: Cel, faixa_minima: -20, vigente_ate: 2026-08-27}
  - {dispositivo: dev-2, modulo: 0, canal: 1, ponto: linha.a, grandeza: temperatura, unidade: Cel, vigente_de: "2026-08-26T21:00:00-03:00"}
"""


def load(spark, tmp_path, text):
    (tmp_path / "i.yaml").write_text(text)
    return installation.load_installation(spark, str(tmp_path / "i.yaml"))


def test_installation_file(spark, tmp_path):
    pytest.importorskip("yaml")
    mapping, reasons, meta = load(spark, tmp_path, FILE)
    rows = mapping.orderBy("dispositivo").select("grandeza", "faixa_minima", F.unix_seconds("vigente_de").alias("de"), F.unix_seconds("vigente_ate").alias("ate")).collect()
    assert [tuple(r) for r in rows] == [("temperatura", -20.0, None, 1787788800), ("temperatura", None, 1787788800, None)]
    assert [tuple(r) for r in reasons.collect()] == [(10, "Troca")] and meta == {"id": "planta", "versao_dos_motivos": 2}


@pytest.mark.parametrize(
    "old, new, message",
    [
        ("unidade: Cel", "unidad: Cel", r"ponto_de_medicao\[0\]: unknown keys"), ("dev-1", "Dev", r"\[0\]: invalid dispositivo"), ("Temperatura", "nada", "unknown quantity"),
        ("2026-08-27", "27/08/2026", "neither a day"), ("2026-08-27", "2026-02-31", "does not exist"), ("2026-08-27", "2026-09-27", "overlap"), ("10:", "0:", "reserved"),
        ("instalacao: planta", "instalacao: ' '", "1 to 64"), ("unidade: Cel, faixa", "unidade: ' ', faixa", "unidade"), ("faixa_minima: -20", "faixa_minima: 9, faixa_maxima: 1", "faixa"),
        ("canal: 1", "canal: -1", "unsigned"),
    ],
)
def test_installation_refusals(spark, tmp_path, old, new, message):
    pytest.importorskip("yaml")
    with pytest.raises(ValueError, match=message):
        load(spark, tmp_path, FILE.replace(old, new, 1))


def test_relational_write_is_idempotent(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet").limit(200)
    rows = projection.project(journal.deduplicate(source.deliveries(e)), source.mapping(e), source.reasons(e))
    rows.write.parquet(str(tmp_path / "rows"))
    rows = spark.read.parquet(str(tmp_path / "rows")).select(*projection.ROW_KEY, "valor_numerico")
    url = f"jdbc:derby:{tmp_path}/db;create=true"
    try:
        rows.limit(0).write.format("jdbc").options(url=url, dbtable="leitura", driver="org.apache.derby.jdbc.EmbeddedDriver",
            createTableColumnTypes="id_do_dispositivo VARCHAR(64), id_da_sessao_de_boot VARCHAR(64), nome_do_campo VARCHAR(64)").save()
    except Exception as missing:
        if "EmbeddedDriver" in str(missing):
            pytest.skip("no Derby driver")
        raise
    derby = {"driver": "org.apache.derby.jdbc.EmbeddedDriver"}
    wanted = rows.dropDuplicates(projection.ROW_KEY).count()
    assert relational.write_readings(rows, url, partitions=2, **derby) == wanted
    assert relational.write_readings(rows.withColumn("valor_numerico", F.lit(1.0)), url, partitions=2, **derby) == 0
    assert relational.read_readings(spark, url, **derby).count() == wanted
    # Two writers at once, with keys in common.
    moved = rows.withColumn("instante_observado", F.col("instante_observado") + F.expr("INTERVAL 1 YEAR"))
    with ThreadPoolExecutor(3) as pool:
        added = list(pool.map(lambda part: relational.write_readings(part, url, partitions=1, **derby), [moved, moved.filter("numero_de_sequencia < 3"), moved.unionByName(rows)]))
    got = relational.read_readings(spark, url, **derby)
    assert sum(added) == wanted and got.count() == got.select(*projection.ROW_KEY).distinct().count() == 2 * wanted
    tables = spark.read.format("jdbc").options(url=url, query="SELECT TABLENAME FROM SYS.SYSTABLES WHERE TABLETYPE = 'T'", **derby).load()
    assert [r[0].lower() for r in tables.collect()] == ["leitura"]


def random_message(rng, depth=0):
    """Bytes that are often a message of the contract and often nearly one."""
    out = b""
    for _ in range(rng.randint(0, 4)):
        number, wire = rng.choice((1, 1, 2, 2, 3, 4, 5, 6, 7, 8, 9, 10, 77)), rng.choice((0, 0, 2, 2, 2, 5, 1))
        out += wire_number(number << 3 | wire)
        if wire == 0:
            out += wire_number(rng.choice((0, 1, 5, 300, 2**31, 2**63, 2**64 - 1)))
        elif wire == 2:
            body = random_message(rng, depth + 1) if depth < 4 and rng.random() < 0.8 else rng.choice((b"", b"abc", b"\xff", "é".encode()))
            out += wire_number(len(body)) + body
        else:
            out += rng.randbytes(8 if wire == 1 else 4)
    if rng.random() < 0.03:
        out += rng.choice((b"\x0b", b"\x00", b"\xff", b"\x0a\x7f", b"\x80" * 11, b"\x0a" + b"\xff" * 9 + b"\x01"))
    return out


wire_number = wire._number


def shipment(rng):
    body = HEAD if rng.random() < 0.8 else b""
    for _ in range(rng.choice((0, 1, 1, 2, 5))):
        head = wire_number(1 << 3) + wire_number(rng.randint(0, 400)) + wire_number(2 << 3) + wire_number(rng.choice((7, 2**62, 2**64 - 1)))
        for _ in range(rng.choice((0, 1, 1, 1, 1, 2))):
            content = random_message(rng, 2)
            head += wire_number(rng.randint(3, 10) << 3 | 2) + wire_number(len(content)) + content
        body += wire_number(5 << 3 | 2) + wire_number(len(head)) + head
    return body if rng.random() < 0.97 else body[:-1]


@pytest.mark.parametrize("seed", range(8))
def test_columns_decode_as_single_messages_do(spark, seed):
    rng = random.Random(seed)
    bodies = [None if rng.random() < 0.02 else shipment(rng) for _ in range(300)]
    if seed % 2:  # texts that are none send a whole slice the slow way
        bodies = [b for b in bodies if wire._envelopes(b)[0].get("recusa") != "remessa malformada"]
    types = wire.to_arrow_schema(wire.StructType.fromDDL(wire.DECODED))
    want = [(i, {f.name: row.get(f.name) for f in types}) for i, b in enumerate(bodies) for row in wire._envelopes(b)]
    want = [(i, pa.RecordBatch.from_arrays([pa.array([row[f.name]], f.type) for f in types], names=types.names).to_pylist()[0]) for i, row in want]
    column = pa.array([b"offset", *bodies], pa.binary()).slice(1)
    try:
        columns, of, slow = wire._decode_columns(column, types)
    except pa.ArrowInvalid:
        assert not seed % 2 and any(row["recusa"] == "remessa malformada" for _, row in want)
        return
    got = pa.RecordBatch.from_arrays(columns, names=types.names).to_pylist()
    fast = [(i, row) for i, row in want if i not in set(slow.tolist())]
    assert repr(list(zip(of.tolist(), got))) == repr(fast) and len(fast) > 40
    assert all(row["recusa"] is None for _, row in fast)


def test_mixed_slices_keep_their_order(spark):
    rng = random.Random(99)
    bodies = [shipment(rng) for _ in range(400)] + [None]
    rows = spark.createDataFrame([(i, bytearray(b) if b is not None else None) for i, b in enumerate(bodies)], "n int, payload binary").coalesce(1)
    got = [(r["n"], r["recusa"], r["posicao"], r["tipo_de_conteudo"], None if r["conteudo_bruto"] is None else bytes(r["conteudo_bruto"])) for r in wire.decode_shipments(rows).collect()]
    want = [(i, *(row.get(c) for c in ("recusa", "posicao", "tipo_de_conteudo", "conteudo_bruto"))) for i, b in enumerate(bodies) for row in wire._envelopes(b)]
    assert got == want


def test_contents_decode_again_as_single_ones_do(spark):
    rng = random.Random(4)
    kinds = [name for name, _, _ in wire.CONTENTS.values()]
    rows = [(i, rng.choice([*kinds, "other", None]), rng.choice([None, *[bytearray(random_message(rng, 2)) for _ in range(9)]])) for i in range(500)]
    got = wire.decode_contents(spark.createDataFrame(rows, "n int, tipo_de_conteudo string, conteudo_bruto binary")).collect()
    number = {name: n for n, (name, _, _) in wire.CONTENTS.items()}
    seen = 0
    for r in got:
        kind, body = r["tipo_de_conteudo"], r["conteudo_bruto"]
        try:
            want = wire._content(number[kind], bytes(body)) if kind in number and body is not None else None
        except wire.Malformed:
            want = None
        assert [name for name in kinds if r[name] is not None] == ([kind] if want is not None else [])
        if want is not None:
            seen += 1
            assert repr({k: v for k, v in r[kind].asDict(True).items()}) == repr({k: want[k] for k in r[kind].asDict()})
    assert seen > 100


def by_rows(row, spec):
    """The fields of one message, value by value, as the contract writes them."""
    out = {}
    for n, (name, kind) in spec.items():
        if (value := row.get(name)) is not None:
            tag = wire_number(n << 3 | wire.WIRE[kind])
            text = value.encode() if kind == "s" else b""
            out[n] = tag + (wire_number(len(text)) + text if kind == "s" else struct.pack("<f", value) if kind == "f" else wire_number(int(value)))
    return out


def content_by_rows(number, row, spec, addressed):
    whole = lambda n, body: wire_number(n << 3 | 2) + wire_number(len(body)) + body
    fields = by_rows(row, spec)
    if addressed:
        fields[1] = whole(1, b"".join(by_rows(row, wire.ADDRESS).values()))
    if number == wire.DESCRIPTOR:
        codes = {v: k for k, v in wire.QUANTITIES.items()}
        channels = [c | {"grandeza": codes.get(c["grandeza"], 0)} for c in row["canais"] or []]
        fields[wire.CHANNELS] = b"".join(whole(wire.CHANNELS, content_by_rows(0, c, wire.CHANNEL, True)) for c in channels)
    return b"".join(fields[n] for n in sorted(fields))


def test_envelopes_are_encoded_by_columns(spark):
    """The same bytes as value by value, for nulls, numbers of every length, repeated contents and empty lists too, and in
    far less time."""
    rng = random.Random(3)
    kinds = [name for name, _, _ in wire.CONTENTS.values()]
    types = wire.to_arrow_schema(wire.StructType.fromDDL(", ".join(["numero_de_sequencia bigint, tempo_ligado_ms bigint", *map(wire._content_type, wire.CONTENTS)])))

    def value(t):
        if rng.random() < 0.15:
            return None
        if pa.types.is_struct(t):
            return {f.name: value(f.type) for f in t}
        if pa.types.is_list(t):
            return [{f.name: value(f.type) for f in t.value_type} for _ in range(rng.choice([0, 1, 3]))]
        return rng.choice({"int64": [0, 1, 127, 128, 300, 2**31, 2**62, -1, -(2**63)], "bool": [False, True], "string": ["", "é€", "x" * 200, "pressao"], "double": [0.0, -0.0, 1.1, 1e-46, float("inf")]}[str(t)])

    rows = [{"numero_de_sequencia": value(pa.int64()), "tempo_ligado_ms": value(pa.int64())} | {k: value(types.field(k).type) for k in rng.sample(kinds, rng.choice([0, 1, 1, 1, 2]))} for _ in range(20_000)]
    batch = pa.RecordBatch.from_pylist(rows, types)
    began = time.perf_counter()
    want = []
    for row in batch.to_pylist():
        fields = by_rows(row, wire.ENVELOPE)
        for number, (name, addressed, spec) in wire.CONTENTS.items():
            if row[name] is not None:
                body = content_by_rows(number, row[name], spec, addressed)
                fields[number] = wire_number(number << 3 | 2) + wire_number(len(body)) + body
        body = b"".join(fields[n] for n in sorted(fields))
        want.append(wire_number(wire.ENVELOPES << 3 | 2) + wire_number(len(body)) + body)
    middle = time.perf_counter()
    got = wire._encode_envelopes(batch, kinds)
    end = time.perf_counter()
    assert got.to_pylist() == want and (end - middle) * 2 < middle - began
    assert wire._encode_envelopes(batch.slice(7, 100), kinds).to_pylist() == want[7:107]
    wide = pa.RecordBatch.from_pylist([{"amostra_escalar": {"valor": 1e39}}], types)
    with pytest.raises(OverflowError):
        wire._encode_envelopes(wide, kinds)
