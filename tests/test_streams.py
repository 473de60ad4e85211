"""Streams and their durable state: redeliveries of any age, failures between writes, cursors, folds, clocks and late rows."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from gaugeline.operators import journal, projection, rollup, timeline, validate
from gaugeline.sources import events as source
from gaugeline.sources.state import Cursors, Folder, KeyedTable, Moved, Versions
from gaugeline.streaming import ingest

DIR = "/root/testdata/sf0.001"
SESSION = journal.SESSION


@pytest.fixture(scope="module")
def events(spark):
    return spark.read.parquet(f"{DIR}/events.parquet")


@pytest.fixture(scope="module")
def delivered(spark, events, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("delivered"))
    source.deliveries(events).write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def small(spark, rows):
    """Journal rows from (id, session, sequence, hour)."""
    frame = spark.createDataFrame([(*r[:3], float(r[3])) for r in rows], "id long, id_da_sessao_de_boot string, numero_de_sequencia long, hora double")
    return frame.select(
        "id", F.lit("dev-1").alias("id_do_dispositivo"), "id_da_sessao_de_boot", "numero_de_sequencia", F.lit(1).alias("versao_do_esquema"), F.lit(0).cast("long").alias("tempo_ligado_ms"),
        F.timestamp_millis((F.lit(1_704_067_200_000) + F.col("hora") * 3_600_000).cast("long")).alias("instante_observado"), F.lit("transicao_digital").alias("tipo_de_conteudo"),
        F.struct(F.lit(0).cast("long").alias("modulo"), F.lit(0).cast("long").alias("canal"), F.lit(True).alias("ativo")).alias("transicao_digital"),
        *[F.lit(None).cast("string").alias(c) for c in ("amostra_escalar", "leitura_de_contador", "amostra_agregada", "mudanca_de_estado_de_maquina", "saude_da_origem", "lacuna_de_buffer", "descritor_da_origem")],
    )


@pytest.fixture
def loose(monkeypatch):
    """Content rules off: ``small`` has no structs for the other contents."""
    monkeypatch.setattr(ingest, "validate", lambda rows: rows.withColumn("motivo", F.lit(None).cast("string")))


@pytest.mark.parametrize("moved", ["INTERVAL 40 DAYS", "-INTERVAL 40 DAYS", "INTERVAL 1 HOUR"])
def test_redeliveries_of_any_age_are_known(spark, delivered, tmp_path, moved):
    path = str(tmp_path / "journal")
    first = delivered.filter("id < 10000000")
    again = delivered.withColumns({"id": F.col("id") + 50_000_000, "instante_observado": F.col("instante_observado") + F.expr(moved)})
    for n, batch in enumerate((first, again, first)):
        ingest.journal_batch(path)(batch, n)
    rows = journal.read(spark, path)
    assert rows.count() == rows.select(*SESSION, "numero_de_sequencia").distinct().count() == 972


def test_held_runs_against_sets(spark):
    rng = random.Random(5)
    journal_page = journal.PAGE
    near = [*range(journal_page - 6, journal_page + 6), *range(12)]
    held_set: set = set()
    held = journal.held_sequences(spark.createDataFrame([], "id_do_dispositivo string, id_da_sessao_de_boot string, numero_de_sequencia long"))
    for _ in range(3):
        batch = [("d", rng.choice("ab"), rng.choice(near)) for _ in range(9)]
        df = spark.createDataFrame(batch, "id_do_dispositivo string, id_da_sessao_de_boot string, numero_de_sequencia long").withColumn("extra", F.lit(1))
        new = {tuple(r)[:3] for r in journal.not_held(df, held).collect()}
        assert new == set(batch) - held_set
        held_set |= set(batch)
        held = spark.createDataFrame(journal.held_sequences(df, held).collect(), journal.HELD)
        runs = held.collect()
        assert {(r[0], r[1], s) for r in runs for s in range(r["primeira"], r["ultima"] + 1)} == held_set
        # Runs are as long as they can be inside a page.
        starts = {(r[0], r[1], r["primeira"]) for r in runs}
        assert not [r for r in runs if (r[0], r[1], r["ultima"] + 1) in starts and (r["ultima"] + 1) % journal_page]


def test_ordinals_have_no_gaps_and_do_not_depend_on_partitions(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(5)]), f"s{i % 7}", i) for i in range(200)]
    df = spark.createDataFrame(rows, "m int, ship string, place int").withColumn("at", F.timestamp_millis(F.col("m").cast("long") * 40_000_000))
    want = {r[2]: n for n, r in enumerate(sorted(rows, key=lambda r: (-1 if r[0] is None else r[0], r[1], r[2])), 1)}
    for parts in (1, 7):
        got = timeline.arrival_ordinals(df.repartition(parts), "at", ["ship", "place"]).collect()
        assert {r["place"]: r["_ordinal"] for r in got} == want


def test_a_batch_that_fails_after_its_rows_is_repeated(spark, loose, tmp_path, monkeypatch):
    path = str(tmp_path / "journal")
    one, two = small(spark, [(i, "s", i, i) for i in range(1, 6)]), small(spark, [(10 + i, "s", i, 30 + i) for i in range(3, 9)])
    ingest.journal_batch(path)(one, 0)
    with monkeypatch.context() as broken:
        broken.setattr(Versions, "commit", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            ingest.journal_batch(path)(two, 1)
    ingest.journal_batch(path)(two, 1)
    assert sorted(r[0] for r in journal.read(spark, path).select("numero_de_sequencia").collect()) == list(range(1, 9))


def test_two_writers_of_one_journal(spark, loose, tmp_path, monkeypatch):
    path = str(tmp_path / "journal")
    ingest.journal_batch(path)(small(spark, [(1, "s", 1, 0)]), 0)
    stale = ingest._held_now(spark, path)
    ingest.journal_batch(path)(small(spark, [(2, "s", 2, 0), (3, "s", 3, 0)]), 1)
    late = small(spark, [(4, "s", 3, 1), (5, "s", 4, 1)])
    with monkeypatch.context() as raced:
        raced.setattr(ingest, "_held_now", lambda *a: stale)
        with pytest.raises(Moved):
            ingest.journal_batch(path)(late, 2)
    assert sorted(r[0] for r in journal.read(spark, path).select("numero_de_sequencia").collect()) == [1, 2, 3]
    ingest.journal_batch(path)(late, 2)
    assert sorted(r[0] for r in journal.read(spark, path).select("numero_de_sequencia").collect()) == [1, 2, 3, 4]


def test_a_journal_of_other_writers_is_taken_over(spark, loose, tmp_path):
    path = str(tmp_path / "journal")
    journal.append(small(spark, [(i, "s", i, i) for i in range(1, 5)]), path)
    ingest.journal_batch(path)(small(spark, [(9, "s", 4, 90), (10, "s", 5, 90)]), 0)
    assert sorted(r[0] for r in journal.read(spark, path).select("numero_de_sequencia").collect()) == [1, 2, 3, 4, 5]


def test_a_stream_names_its_folders(spark, delivered, tmp_path):
    delivered.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(delivered.schema).parquet(str(tmp_path / "in"))
    query = ingest.ingest(stream, str(tmp_path / "journal"), str(tmp_path / "cp"))
    query.awaitTermination()
    assert [r[0] for r in journal.read(spark, str(tmp_path / "journal")).select("batch_id").distinct().collect()] == [f"{query.id[:8]}-0"]
    assert ingest.held_table(spark, str(tmp_path / "journal")).snapshot().has(query.id, 0)


def test_keyed_table_reads_and_writes_only_its_buckets(spark, tmp_path):
    table = KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", buckets=8)
    add = lambda old, new: old.unionByName(new).groupBy("k").agg(F.sum("v").alias("v"))
    for n in range(6):
        table.merge(spark.createDataFrame([(n % 3, 1), (n, 10)], "k long, v long"), add, "w", n)
    table.merge(spark.createDataFrame([(0, 1000)], "k long, v long"), add, "w", 5)  # that batch is in it already
    want: dict = {}
    for n in range(6):
        for k, v in ((n % 3, 1), (n, 10)):
            want[k] = want.get(k, 0) + v
    assert {r["k"]: r["v"] for r in table.read().collect()} == want
    assert KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", buckets=99).buckets == 8
    now = table.snapshot()
    assert len({f for f in now.state["buckets"].values()}) > 1
    folders = [n for n in Folder(spark, str(tmp_path / "t")).names() if n[0] == "v"]
    assert len(folders) <= 8 + 3


def test_cursors_do_not_lose_each_others_moves(spark, tmp_path):
    one, two = Cursors(spark, str(tmp_path / "c")), Cursors(spark, str(tmp_path / "c"))
    assert one.position("a") == 0
    stale = one.versions.latest()
    two.advance("b", 7)
    latest = one.versions.latest
    one.versions.latest = lambda: (setattr(one.versions, "latest", latest), stale)[1]  # it has read before the other moved
    one.advance("a", 42, expected=0)
    two.advance("a", 99)
    assert {r["nome"]: r["ultimo_id_projetado"] for r in one.table().collect()} == {"a": 99, "b": 7}
    with pytest.raises(Moved):
        one.advance("a", 43, expected=42)
    assert one.position("a") == 99 and one.table().filter("atualizado_em IS NULL").count() == 0


def test_projection_cycles_are_bounded_and_move_after_the_write(spark, events, delivered, tmp_path, monkeypatch):
    path = {n: str(tmp_path / n) for n in ("journal", "cursors", "readings", "quarantine")}
    kept = journal.deduplicate(delivered)
    journal.append(kept, path["journal"])
    cursors, mapping, reasons = Cursors(spark, path["cursors"]), source.mapping(events), source.reasons(events)

    def cycle(limit=400):
        return ingest.project_cycle(spark, path["journal"], cursors, "leitura", mapping, reasons, path["readings"], path["quarantine"], limit)

    with monkeypatch.context() as broken:
        broken.setattr(ingest, "write_readings", lambda *a: (_ for _ in ()).throw(OSError("lost")))
        with pytest.raises(OSError):
            cycle()
    assert cursors.position("leitura") == 0
    counts, at = [], []
    ingest.project_forever(lambda: counts.append(cycle()) or at.append(cursors.position("leitura")) or counts[-1], 0.0, lambda: bool(counts) and counts[-1] == 0)
    assert counts == [400, 400, 172, 0] and at == sorted(at)
    want = projection.project(kept, mapping, reasons)
    assert spark.read.parquet(path["readings"]).count() == want.count()


def test_the_next_rows_come_from_their_own_folders(spark, loose, tmp_path):
    path = str(tmp_path / "journal")
    for n in range(6):
        ingest.journal_batch(path)(small(spark, [(10 * n + i, "s", 10 * n + i, 5 * n + i) for i in range(1, 9)]), n)
    # A batch whose ids lie between others', as redelivered ones of the decoded path may.
    ingest.journal_batch(path)(small(spark, [(19, "s", 99, 2), (45, "t", 1, 2)]), 6)
    every = [r[0] for r in journal.read(spark, path).select("id").orderBy("id").collect()]

    def pages(limit):
        at, found, files = 0, [], []
        while True:
            page = journal.next_rows(spark, path, at, limit)
            rows = [r[0] for r in page.select("id").orderBy("id").collect()]
            if not rows:
                break
            found.append(rows)
            files.append(len(page.inputFiles()))
            at = rows[-1]
        return found, files

    for limit in (3, 8, 20, 100):
        found, _ = pages(limit)
        assert sum(found, []) == every and [len(p) for p in found[:-1]] == [limit] * (len(found) - 1)
    everything = len(journal.read(spark, path).inputFiles())
    assert max(pages(3)[1]) < everything
    journal.compact(spark, path, "2024-01-02")
    assert sum(pages(7)[0], []) == every
    journal.clear_folds(spark, path)
    assert sum(pages(7)[0], []) == every
    cursors = spark.createDataFrame([("a", 30)], "nome string, ultimo_id_projetado long")
    journal.prune_table(spark, path, cursors, "2024-01-01 12:00:00")
    left = [r[0] for r in journal.read(spark, path).select("id").orderBy("id").collect()]
    assert sum(pages(7)[0], []) == left and len(left) < len(every)


def test_clock_marks_of_a_stream(spark, delivered, tmp_path):
    got = source.receipts(delivered)
    for low, high in ((0, 400), (400, 10**8)):
        got.filter(f"id >= {low} AND id < {high}").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(got.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    ingest.mark_clocks(stream, str(tmp_path / "anchors"), str(tmp_path / "marks"), str(tmp_path / "cp")).awaitTermination()
    marks = {r["id"]: r["salto_de_relogio"] for r in spark.read.parquet(str(tmp_path / "marks")).collect()}
    want = timeline.clock_steps(got, timeline.first_receipts(got).drop("ancora_ms", "id"))
    assert marks == {r["id"]: r["salto_de_relogio"] for r in want.collect()} and sum(marks.values()) > 0
    columns = [*SESSION, "ancora_ms", "decorrido_da_ancora_ns", "id_da_execucao", "id"]
    assert sorted(ingest.read_anchors(spark, str(tmp_path / "anchors")).select(*columns).collect()) == sorted(timeline.first_receipts(got).select(*columns).collect())


def folders_of(path):
    return sorted(str(p.relative_to(path)) for p in path.glob("dt=*/batch_id=*"))


def test_compaction_keeps_rows_and_running_readers(spark, loose, tmp_path):
    path = tmp_path / "journal"
    for n in range(50):
        journal.append(small(spark, [(n, "s", n, n / 3)]).coalesce(1), str(path))
    before = journal.read(spark, str(path))
    want = sorted(r[0] for r in before.select("id").collect())
    assert journal.compact(spark, str(path), "2024-01-02") == ["2024-01-01"]
    got = journal.read(spark, str(path))
    assert sorted(r[0] for r in got.select("id").collect()) == want == sorted(r[0] for r in before.select("id").collect())
    assert journal.clear_folds(spark, str(path)) > 0 and len([f for f in folders_of(path) if f.startswith("dt=2024-01-01")]) == 1
    assert sorted(r[0] for r in journal.read(spark, str(path)).select("id").collect()) == want
    ingest.journal_batch(str(path))(small(spark, [(90, "s", 49, 2), (91, "s", 50, 2)]), 0)
    assert sorted(r[0] for r in journal.read(spark, str(path)).select("id").collect()) == [*want, 91]


def test_readings_are_compacted_and_still_written_once(spark, events, delivered, tmp_path):
    path = str(tmp_path / "readings")
    readings = projection.project(journal.deduplicate(delivered), source.mapping(events), source.reasons(events)).filter("instante_observado < '2024-01-04'").persist()
    for n in range(4):
        projection.write_readings(readings.filter(f"numero_de_sequencia % 4 <= {n}"), path)
    want = sorted(map(str, readings.select(*projection.ROW_KEY, "valor_numerico").collect()))
    assert len(folders_of(tmp_path / "readings")) > 6
    assert len(journal.compact(spark, path, "2024-01-04")) == 3 and journal.clear_folds(spark, path) > 3
    assert len(folders_of(tmp_path / "readings")) == 3
    projection.write_readings(readings, path)
    assert sorted(map(str, journal.read(spark, path).select(*projection.ROW_KEY, "valor_numerico").collect())) == want
    readings.unpersist()


def test_pruning_rewrites_only_what_it_must(spark, delivered, tmp_path):
    path, kept = tmp_path / "journal", journal.deduplicate(delivered)
    journal.append(kept.filter("id % 2 = 0"), str(path))
    journal.append(kept.filter("id % 2 = 1"), str(path))
    cursors = spark.createDataFrame([("a", 500), ("b", 700)], "nome string, ultimo_id_projetado long")
    files = {f: sorted(p.name for p in (path / f).iterdir()) for f in folders_of(path)}
    deleted, rewritten = journal.prune_table(spark, str(path), cursors, "2024-01-15 12:00:00")
    want = sorted(r[0] for r in journal.prune(kept, cursors, "2024-01-15 12:00:00").select("id").collect())
    assert sorted(r[0] for r in journal.read(spark, str(path)).select("id").collect()) == want and len(want) < kept.count()
    assert deleted and rewritten and not set(deleted) & set(rewritten)
    for f, names in files.items():
        if f[3:13] not in deleted:
            assert sorted(p.name for p in (path / f).iterdir()) == names
    none = spark.createDataFrame([], "nome string, ultimo_id_projetado long")
    assert journal.prune_table(spark, str(path), none, "2030-01-01") == ([], [])


def test_late_rows_reach_the_journal_but_not_the_counts(spark, tmp_path):
    minute = lambda m: datetime(2024, 1, 1) + timedelta(minutes=m)
    schema = "id_do_dispositivo string, instante_observado timestamp"
    for rows in ([("d", minute(0)), ("d", minute(0)), ("d", minute(200))], [("d", minute(190)), ("e", minute(200))], [("d", minute(1)), ("d", minute(600))], [("d", minute(601))]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    counts = ingest.counts_per_minute(stream, "1 hour").writeStream.format("memory").queryName("per_minute").outputMode("append")
    counts.trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start().awaitTermination()
    got = {(r["id_do_dispositivo"], r["minuto"]): r["registros"] for r in spark.table("per_minute").collect()}
    assert got == {("d", minute(0)): 2, ("d", minute(190)): 1, ("d", minute(200)): 1, ("e", minute(200)): 1}


def test_days_of_a_roll_up_in_any_order(spark, events, delivered, tmp_path):
    readings = projection.project(journal.deduplicate(delivered), source.mapping(events), source.reasons(events)).filter("instante_observado < '2024-01-05'").persist()
    keys = ["id_do_dispositivo", "nome_do_campo"]
    days = sorted(str(r[0]) for r in readings.select(F.to_date("instante_observado")).distinct().collect())
    late = readings.filter("numero_de_sequencia % 4 <> 0")
    tables = []
    for name, steps in (("a", [(readings, days)]), ("b", [(readings, [d]) for d in reversed(days)]), ("c", [(late, days), (readings, days[:1]), (readings, days)])):
        for rows, own in steps:
            rollup.write_days(rows, own, str(tmp_path / name), keys)
        tables.append(sorted(map(str, spark.read.parquet(str(tmp_path / name)).select(*keys, "hora", "quantidade", "minimo", "maximo").collect())))
    assert tables[0] == tables[1] == tables[2] and tables[0]


def test_overlaps_name_a_witness_and_join_nothing(spark, events):
    found = validate.overlaps(source.faulty_mapping(events).withColumn("ponto", F.ltrim("ponto", F.lit("-"))), ["ponto"])
    assert "Join" not in found._jdf.queryExecution().executedPlan().toString().split("Initial")[0].replace("JoinedRow", "")
    day = lambda d: None if d is None else datetime(2024, 1, d)
    spans = [("p", 1, 9), ("p", 2, 3), ("p", 4, 5), ("p", 9, None), ("q", None, 4), ("q", 4, 6), ("r", 1, None), ("r", 20, 21), (None, 1, 5), (None, 2, 5)]
    rows = [(p, f"d{n}", 0, 0, day(a), day(z)) for n, (p, a, z) in enumerate(spans)]
    df = spark.createDataFrame(rows, "ponto string, dispositivo string, modulo long, canal long, vigente_de timestamp, vigente_ate timestamp")
    got = {(r["_id"]["dispositivo"], r["_id2"]["dispositivo"]) for r in validate.overlaps(df, ["ponto"]).collect()}
    assert got == {("d0", "d1"), ("d0", "d2"), ("d6", "d7")}


def test_an_envelope_without_receipt_instant_is_an_error(spark, delivered):
    with pytest.raises(Exception, match="receipt instant"):
        validate.validate(delivered.limit(1).withColumn("instante_observado", F.lit(None).cast("timestamp"))).collect()


def test_a_backlog_is_projected_in_few_cycles_and_whole(spark, events, delivered, tmp_path, monkeypatch):
    path = {n: str(tmp_path / n) for n in ("journal", "cursors", "readings", "quarantine")}
    ingest.journal_batch(path["journal"])(delivered, 0)
    cursors, mapping, reasons = Cursors(spark, path["cursors"]), source.mapping(events), source.reasons(events)
    sizes, cycle = [], ingest.project_cycle
    monkeypatch.setattr(journal, "SORTED", 50)
    monkeypatch.setattr(ingest, "project_cycle", lambda *a: sizes.append(cycle(*a)) or sizes[-1])
    total = ingest.project_backlog(spark, path["journal"], cursors, "leitura", mapping, reasons, path["readings"], path["quarantine"], 20)
    assert sizes == [20, 80, 320, 552, 0] and total == 972
    want = projection.project(journal.deduplicate(delivered), mapping, reasons)
    key = [*projection.ROW_KEY, "valor_numerico"]
    assert sorted(map(str, spark.read.parquet(path["readings"]).select(*key).collect())) == sorted(map(str, want.select(*key).collect()))


@pytest.mark.parametrize("limit", [1, 3, 40, 41, 500])
def test_the_next_rows_are_found_by_counting(spark, limit):
    ids = [*range(5, 30), 77, *range(5000, 5040), 10**9, 10**12]
    rows = spark.createDataFrame([(i,) for i in ids], "id long")
    for cursor in (0, 5, 29, 5010, 10**12):
        assert sorted(r[0] for r in journal.up_to(rows, cursor, limit).collect()) == [i for i in ids if i > cursor][:limit]


def test_new_rows_of_a_batch_in_one_pass(spark):
    rng = random.Random(9)
    rows = [(i, rng.choice("ab"), rng.choice((rng.randint(0, 30), journal.PAGE + rng.randint(-3, 3))), i) for i in range(120)]
    batch = small(spark, rows)
    held = journal.held_sequences(small(spark, [(0, "a", s, 0) for s in (3, 4, 5, 9, journal.PAGE)]))
    for known in (held, held.limit(0)):
        want = journal.not_held(journal.deduplicate(batch), known)
        assert sorted(r[0] for r in journal.first_not_held(batch, known).select("id").collect()) == sorted(r[0] for r in want.select("id").collect())
    assert journal.first_not_held(batch).count() == len({r[1:3] for r in rows})


def test_a_small_batch_is_kept_in_few_partitions(spark, delivered):
    from gaugeline.sources.state import kept

    was = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "200")
    try:
        rows = kept(journal.deduplicate(delivered))
        assert rows.count() == 972 and rows.rdd.getNumPartitions() < 20
        rows.unpersist()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", was)


def test_readings_of_repeated_and_null_keys_are_written_once(spark, tmp_path):
    path = str(tmp_path / "readings")
    rows = spark.createDataFrame([("d", s, n, "value", float(n)) for s in ("s", None) for n in (1, 1, 2)], "id_do_dispositivo string, id_da_sessao_de_boot string, numero_de_sequencia long, nome_do_campo string, valor_numerico double")
    rows = rows.withColumn("instante_observado", F.lit("2024-01-03 01:00:00").cast("timestamp"))
    for _ in range(2):
        projection.write_readings(rows, path)
    assert spark.read.parquet(path).count() == 4


def test_a_merged_batch_is_made_once(spark, tmp_path):
    made = spark.sparkContext.accumulator(0)
    rows = spark.range(40).rdd.map(lambda r: made.add(1) or (r[0], 1)).toDF("k long, v long")
    KeyedTable(spark, str(tmp_path / "t"), ["k"], "k long, v long", buckets=4).merge(rows, lambda old, new: old.unionByName(new), "w", 0)
    assert made.value == 40
