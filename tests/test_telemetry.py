"""Rules on small frames, each query against DuckDB, and batch results against stream results."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from gaugeline.functions.catalog import CATALOG, Catalog, Content, in_force, out_of_range, page_limit
from gaugeline.operators import commissioning, journal, projection, rollup, timeline, validate
from gaugeline.plans import telemetry
from gaugeline.sources import events as source
from gaugeline.sources import legacy, wire
from gaugeline.streaming import ingest

DIR = "/root/testdata/sf0.001"


def rows_of(frame):
    frame = frame[sorted(frame)].astype(object)
    return sorted(tuple("~" if pd.isna(v) else f"{v:.9g}" if isinstance(v, float) else str(v) for v in r) for r in frame.itertuples(index=False))


@pytest.fixture(scope="module")
def oracle():
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{DIR}/events.parquet'")
    return con


@pytest.mark.parametrize("name", sorted(telemetry.QUERIES))
def test_query_matches_sql(spark, oracle, name):
    got = telemetry.QUERIES[name](spark, DIR).toPandas()
    assert rows_of(got) == rows_of(oracle.execute(telemetry.ORACLE_SQL[name]).df())


@pytest.fixture(scope="module")
def delivered(spark):
    return source.deliveries(spark.read.parquet(f"{DIR}/events.parquet"))


def test_replay_changes_nothing(spark, delivered):
    kept = journal.deduplicate(delivered)
    assert journal.not_yet_written(kept, kept).count() == 0
    assert journal.deduplicate(delivered.unionByName(delivered)).count() == kept.count()


def test_accepted_and_rejected_are_all(delivered):
    checked = validate.validate(source.corrupted(delivered))
    assert checked.filter("motivo IS NULL").count() + checked.filter("motivo IS NOT NULL").count() == delivered.count()


@pytest.mark.parametrize("value, ok", [("prensa-01", True), ("abc\n", False), ("", False), ("-a", False), ("a" * 65, False), ("Prensa", False), ("a", True)])
def test_names(spark, value, ok):
    assert spark.range(1).select(validate.name_ok(F.lit(value))).first()[0] is ok


@pytest.mark.parametrize("value, low, high, flag", [(65.4, -20.0, 200.0, False), (900.0, -20.0, 200.0, True), (-100.0, -20.0, 200.0, True), (999999.0, None, None, False), (float("nan"), 0.0, 1.0, False)])
def test_range(spark, value, low, high, flag):
    assert spark.range(1).select(out_of_range(F.lit(value), F.lit(low).cast("double"), F.lit(high).cast("double"))).first()[0] is flag


def test_validity_is_closed_then_open(spark):
    t = lambda s: F.lit(s).cast("timestamp")
    got = spark.range(1).select(
        in_force(t("2024-01-01"), t("2024-02-01"), t("2024-01-01")), in_force(t("2024-01-01"), t("2024-02-01"), t("2024-02-01")), in_force(t(None), t(None), t("2024-02-01"))
    )
    assert list(got.first()) == [True, False, True]


def test_prune_without_cursor_keeps_all(spark, delivered):
    none = spark.createDataFrame([], "nome string, ultimo_id_projetado long")
    assert journal.prune(delivered, none, "2030-01-01").count() == delivered.count()


def test_badge_is_never_projected(spark, delivered):
    out = projection.unpivot(projection.with_address(delivered))
    assert out.filter("valor_texto LIKE 'cracha%'").count() == 0
    assert out.filter("int(valor_numerico IS NOT NULL) + int(valor_texto IS NOT NULL) + int(valor_logico IS NOT NULL) <> 1").count() == 0


def test_estimate_refuses_earlier_uptime(spark):
    j = spark.createDataFrame([(1, "d", "s", 30000, "2024-01-01 00:00:00"), (2, "d", "s", 90000, "2024-01-01 00:05:00"), (3, "d", "s", 29000, "2024-01-01 00:06:00")], "id long, id_do_dispositivo string, id_da_sessao_de_boot string, tempo_ligado_ms long, t string")
    j = j.withColumn("instante_observado", F.col("t").cast("timestamp"))
    out = {r["id"]: r["instante_estimado"] for r in timeline.estimate(j, timeline.anchors(j)).collect()}
    assert str(out[2]) == "2024-01-01 00:01:00" and out[3] is None


def test_clock_step(spark):
    a = spark.createDataFrame([("d", "s", 0, "run-a")], "id_do_dispositivo string, id_da_sessao_de_boot string, decorrido_da_ancora_ns long, id_da_execucao string").withColumn("instante_da_ancora", F.lit("2024-01-01 00:00:00").cast("timestamp"))
    r = spark.createDataFrame([(1, "d", "s", 10**9, "run-a", 1.2), (2, "d", "s", 10**9, "run-a", 46.0), (3, "d", "s", 10**9, "run-b", 46.0)], "n int, id_do_dispositivo string, id_da_sessao_de_boot string, decorrido_ns long, id_da_execucao string, s double")
    r = r.withColumn("instante", F.timestamp_millis((F.unix_millis(F.lit("2024-01-01 00:00:00").cast("timestamp")) + F.col("s") * 1000).cast("long")))
    assert {x["n"]: x["salto_de_relogio"] for x in timeline.clock_steps(r, a).collect()} == {1: False, 2: True, 3: False}


def test_weighted_windows(spark):
    w = spark.createDataFrame([(1, 1.0, 2.0, 1.0, 1.0), (3, 0.5, 4.0, 3.0, 3.0)], "quantidade long, minimo double, maximo double, media double, valor_eficaz double")
    w = w.withColumn("instante_observado", F.lit("2024-01-01 00:10:00").cast("timestamp")).withColumn("k", F.lit(1))
    r = rollup.reaggregate(w, ["k"]).first()
    assert (r["quantidade"], r["minimo"], r["maximo"], r["media"]) == (4, 0.5, 4.0, 2.5) and abs(r["valor_eficaz"] - 7**0.5) < 1e-9


def test_catalog_refusals():
    for bad in (Content("", "sample", True, "", (("v", "n", "1"),)), Content("x", "other", True, "", (("v", "n", "1"),)), Content("x", "sample", True, "", ())):
        with pytest.raises(ValueError):
            Catalog().add(bad)
    with pytest.raises(ValueError):
        Catalog((CATALOG.by_name["amostra_escalar"], CATALOG.by_name["amostra_escalar"]))


def test_page_limit():
    assert [page_limit(x) for x in (None, "x", 0, -1, 7, 5000)] == [100, 100, 100, 100, 7, 1000]


def test_mapping_faults_and_draft(spark, delivered):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    good = source.mapping(e)
    assert validate.mapping_faults(good).count() == 0
    assert validate.mapping_faults(good.withColumn("unidade", F.lit(" "))).count() == good.count()
    assert commissioning.draft_mapping(commissioning.latest_descriptors(journal.deduplicate(delivered)), good, telemetry.NOW).count() > 0


def test_legacy_buffer_never_blocks(spark):
    b = spark.createDataFrame([(1, "2024-01-01T00:00:00", "t", "1.5", "C", 0), (2, "x", "t", "1", "C", 0), (3, "2024-01-01T00:00:00", "t", "1,5", "C", 0), (4, "2024-01-01T00:00:00", "t", "2", "C", 1)], "id long, timestamp string, tag string, value string, unit string, synced int")
    ok, corrupt, marks = legacy.replay_buffer(b)
    assert ok.count() == 1 and corrupt.count() == 2 and marks.count() == 3


def keys_of(df):
    return sorted(r[0] for r in df.select("chave_de_idempotencia").collect())


def test_stream_equals_batch(spark, delivered, tmp_path):
    delivered.repartitionByRange(3, "id").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(delivered.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.ingest(stream, str(tmp_path / "journal"), str(tmp_path / "cp")).awaitTermination()
    got = journal.read(spark, str(tmp_path / "journal"))
    want = journal.deduplicate(delivered)
    assert keys_of(got) == keys_of(want) and got.select("batch_id").distinct().count() == 3
    # A new checkpoint sends everything again, and a repeated batch writes its rows in their place.
    ingest.ingest(stream, str(tmp_path / "journal"), str(tmp_path / "cp2")).awaitTermination()
    ingest.journal_batch(str(tmp_path / "journal"))(delivered.filter("id < 500"), 7)
    again = journal.read(spark, str(tmp_path / "journal"))
    assert keys_of(again.dropDuplicates(["chave_de_idempotencia"])) == keys_of(want) == keys_of(again)


def test_binary_stream_anchors_descriptors_and_projection(spark, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    delivered, mapping, reasons = source.deliveries(e), source.mapping(e), source.reasons(e)
    sent = wire.encode_shipments(delivered).select("shipment_id", "instante_observado", "payload")
    for early in ("instante_observado < '2024-01-15'", "instante_observado >= '2024-01-15'"):
        sent.filter(early).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(sent.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    path = {n: str(tmp_path / n) for n in ("journal", "anchors", "descriptors", "readings", "quarantine")}
    ingest.ingest_shipments(stream, path["journal"], str(tmp_path / "c1")).awaitTermination()
    rows = journal.read(spark, path["journal"])
    assert keys_of(rows) == keys_of(journal.deduplicate(delivered))

    def records():
        return ingest.read_journal_stream(spark, path["journal"], rows.schema, 20)

    ingest.track(records(), path["anchors"], path["descriptors"], str(tmp_path / "c2")).awaitTermination()
    got = ingest.read_anchors(spark, path["anchors"])
    assert sorted(map(str, got.select(*timeline.anchors(rows).columns).collect())) == sorted(map(str, timeline.anchors(rows).collect()))
    # The anchor is the first envelope of the first shipment to arrive.
    uptimes = lambda df: {tuple(r[:2]): r[2] for r in df.select(*timeline.SESSION, "ancora_ms").collect()}
    arrived = Window.partitionBy("shipment_id")
    order = F.struct(F.max("instante_observado").over(arrived).alias("a"), F.col("shipment_id").alias("b"), F.col("numero_de_sequencia").alias("c"))
    want = delivered.withColumn("_order", order).groupBy(*timeline.SESSION).agg(F.min_by("tempo_ligado_ms", "_order").alias("ancora_ms"))
    assert uptimes(got) == uptimes(want)
    ids = [r[0] for r in rows.select("id").orderBy("id").collect()]
    assert len(set(ids)) == len(ids) and ids[-1] <= delivered.count()
    latest = commissioning.latest_descriptors(rows).select("id_do_dispositivo", "id")
    assert sorted(latest.collect()) == sorted(ingest.read_descriptors(spark, path["descriptors"], rows.schema).select("id_do_dispositivo", "id").collect())

    # Without redeliveries shipments arrive in the order of ids: the same anchors as on the decoded path, and no estimate is lost.
    once = wire.split_refused(wire.decode_shipments(wire.encode_shipments(delivered.filter("id < 10000000"))))[0]
    once = journal.deduplicate(ingest.identified(once))
    assert uptimes(timeline.anchors(once)) == uptimes(timeline.anchors(delivered))
    assert timeline.estimate(once, timeline.anchors(once)).filter("instante_estimado IS NULL").count() == 0

    for checkpoint in ("c3", "c4"):  # the second consumer reads everything again and writes nothing
        ingest.projection(records(), mapping, reasons, path["readings"], path["quarantine"], str(tmp_path / checkpoint)).awaitTermination()
        want = projection.project(rows, mapping, reasons)
        assert spark.read.parquet(path["readings"]).count() == want.count()

    lost = rows.drop("dt", "batch_id").filter("tipo_de_conteudo = 'leitura_de_contador'").withColumn("leitura_de_contador", F.lit(None).cast(rows.schema["leitura_de_contador"].dataType))
    assert projection.split_decodable(lost)[0].count() == 0
    lost.withColumn("motivo", F.lit("x")).withColumn("dt", F.to_date("instante_observado")).withColumn("batch_id", F.lit(99)).write.mode("append").partitionBy("dt", "batch_id").parquet(path["quarantine"])
    rest = ingest.reprocess_quarantine(spark, path["quarantine"], mapping, reasons, str(tmp_path / "mended"))
    mended = spark.read.parquet(str(tmp_path / "mended"))
    assert rest.count() == 0 and mended.filter("nome_do_campo = 'accumulated_count'").count() == lost.count() > 0


def test_journal_table_readings_and_pruning(spark, delivered, tmp_path):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    rows, path = journal.deduplicate(delivered), str(tmp_path / "journal")
    journal.append(rows, path)
    assert journal.read(spark, path).count() == rows.count()
    day = journal.read(spark, path, "2024-01-10", "2024-01-10")
    assert day.count() == rows.filter("to_date(instante_observado) = DATE '2024-01-10'").count() > 0
    assert "PartitionFilters: [isnotnull(dt" in day._jdf.queryExecution().toString()
    readings = projection.project(rows, source.mapping(e), source.reasons(e))
    for part in (readings.filter("numero_de_sequencia < 4"), readings, readings):
        projection.write_readings(part, str(tmp_path / "readings"))
    assert spark.read.parquet(str(tmp_path / "readings")).count() == readings.dropDuplicates(projection.ROW_KEY).count()
    cursors = spark.createDataFrame([("a", 10**9)], "nome string, ultimo_id_projetado long")
    assert journal.prune_days(spark, path, cursors.withColumn("ultimo_id_projetado", F.lit(0).cast("long")), "2024-01-11") == []
    gone = journal.prune_days(spark, path, cursors, "2024-01-11")
    assert gone and max(gone) == "2024-01-10" and journal.read(spark, path).filter("dt < DATE '2024-01-11'").count() == 0
    moved = journal.advance(journal.advance(cursors.withColumn("atualizado_em", F.lit(None).cast("timestamp")), "a", 42, None), "b", 7, None)
    assert {r["nome"]: r["ultimo_id_projetado"] for r in moved.collect()} == {"a": 42, "b": 7}


def test_legacy_table(spark, tmp_path):
    rows = spark.createDataFrame([("2024-01-01 00:00:00", "t", "1.5", "C")], "time string, tag string, value string, unit string")
    legacy.append(rows, str(tmp_path / "old"))
    legacy.append(rows, str(tmp_path / "old"))
    assert legacy.latest(legacy.read_legacy(spark.read.parquet(str(tmp_path / "old"))), 5).count() == 2


def test_reasons_never_gather_the_journal(spark):
    plan = telemetry.QUERIES["r2_long_projection"](spark, DIR)._jdf.queryExecution().executedPlan().toString()
    assert "_motivo" in plan and not [line for line in plan.split("\n") if "Exchange hashpartitioning(_motivo" in line or "Exchange hashpartitioning(_junta" in line]
    e = spark.read.parquet(f"{DIR}/events.parquet")
    rows = projection.resolve(journal.deduplicate(source.deliveries(e)), source.mapping(e))
    want = projection.enrich(rows, source.reasons(e)).select("chave_de_idempotencia", "rotulo_do_motivo", "motivo_desconhecido")
    want = sorted(map(tuple, want.collect()), key=str)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        got = projection.enrich(rows, source.reasons(e))
        assert "Exchange hashpartitioning(_junta" in got._jdf.queryExecution().executedPlan().toString()
        # Records without a reason are spread, not gathered under one key.
        tasks = got.filter("rotulo_do_motivo IS NULL").groupBy(F.spark_partition_id()).count().collect()
        assert len(tasks) > 1 and sorted(map(tuple, got.select("chave_de_idempotencia", "rotulo_do_motivo", "motivo_desconhecido").collect()), key=str) == want
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert [r for r in want if r[2]]


def test_sessions_share_one_exchange(spark):
    for name in ("w3_anchors", "w4_sequence_gaps"):
        plan = telemetry.QUERIES[name](spark, DIR)._jdf.queryExecution().executedPlan().toString().split("== Initial")[0]
        assert plan.count("Exchange hashpartitioning(id_do_dispositivo") == 1, name


def test_fields_are_filtered_before_the_joins(spark):
    e = spark.read.parquet(f"{DIR}/events.parquet")
    args = journal.deduplicate(source.deliveries(e)), source.mapping(e), source.reasons(e)
    some = projection.project(*args, fields=("value", "machine_state"))
    want = projection.project(*args).filter("nome_do_campo IN ('value', 'machine_state')")
    assert some.exceptAll(want).count() == want.exceptAll(some).count() == 0 and some.count() > 0


@pytest.mark.parametrize("unit, ok", [("u" * 64, True), ("u" * 65, False), (None, True)])
def test_unit_length_of_a_descriptor(spark, delivered, unit, ok):
    rows = delivered.filter("descritor_da_origem IS NOT NULL").limit(3)
    channels = F.transform("descritor_da_origem.canais", lambda c: c.withField("unidade", F.lit(unit)))
    checked = validate.validate(rows.withColumn("descritor_da_origem", F.col("descritor_da_origem").withField("canais", channels)))
    assert {r["motivo"] for r in checked.collect()} == ({None} if ok else {"regra de descritor_da_origem"})
