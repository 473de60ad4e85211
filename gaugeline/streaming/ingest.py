"""Stream drivers over the batch functions: same rows in, same rows out.

Tables that a micro-batch writes have a folder per batch below the folder of the day, named after the stream and the
batch, which a repeated batch replaces. What tables must hold once, whatever the checkpoint says, is guarded by keys: the
journal by the runs of sequences that each session holds, in a keyed table beside it.
"""

from __future__ import annotations

import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.catalog import data_class, idempotency_key
from ..operators import journal as table
from ..operators.commissioning import latest_descriptors
from ..operators.projection import project, reprocess, split_decodable, write_readings
from ..operators.timeline import SESSION, anchors, arrival_ordinals, clock_steps, first_receipts
from ..operators.validate import validate
from ..sources.wire import decode_shipments, split_refused
from ..sources.state import Cursors, Folder, KeyedTable, Moved, Snapshot, kept

#: Records of a projection cycle at most.
CYCLE = 500
#: How many times as many the next cycle takes of a backlog.
GROWTH = 4
ANCHORS = "id_do_dispositivo string, id_da_sessao_de_boot string, ancora_ms long, instante_da_ancora timestamp, decorrido_da_ancora_ns long, id_da_execucao string, id long"


def stream_of(spark: SparkSession) -> str:
    """The running stream's id, which its checkpoint keeps; empty outside a stream."""
    return spark.sparkContext.getLocalProperty("sql.streaming.queryId") or ""


def _name(spark: SparkSession, batch_id: int) -> str:
    return f"{stream_of(spark)[:8] or 'batch'}-{batch_id}"


def _replace(rows: DataFrame, path: str, batch_id: int) -> None:
    """Write a batch's rows to folders of its own, of which a repeated batch leaves none behind."""
    name = _name(rows.sparkSession, batch_id)
    rows.withColumn("batch_id", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(path)


def held_table(spark: SparkSession, journal_path: str) -> KeyedTable:
    """The sequences that a journal table holds, by session, in a folder of it that readers of the table pass over."""
    return KeyedTable(spark, f"{journal_path}/_held", SESSION, table.HELD)


def _held_now(spark: SparkSession, journal_path: str) -> Snapshot:
    """The held sequences as they are; a journal table without them, as other writers leave it, is read once for it."""
    now = held_table(spark, journal_path).snapshot()
    if not now.number and any(n.startswith("dt=") for n in Folder(spark, journal_path).names()):
        rows = table.read(spark, journal_path)
        last = rows.agg(F.max("id")).first()[0]
        now.commit(table.held_sequences(rows), list(range(now.table.buckets)), "rebuilt", 0, last_id=last or 0)
    return now


def _append_new(batch: DataFrame, batch_id: int, journal_path: str, prepare: Callable[[DataFrame, int], DataFrame]) -> None:
    """Validate, deduplicate and append a batch, whenever its records were sent first.

    A session's held sequences tell what is new, so redeliveries of any age are found without reading the journal. Rows are
    written first and the held sequences after them: a batch that fails in between is repeated against what was held
    before it, and gives the same rows in the place of the first attempt's. One that is in the table already is passed over.
    Where another writer of the same journal came first, the rows go again and Moved is raised, for the batch to be repeated.
    """
    spark, stream = batch.sparkSession, stream_of(batch.sparkSession)
    now = _held_now(spark, journal_path)
    if stream and now.has(stream, batch_id):
        return
    ok = kept(validate(prepare(batch, now.fact("last_id", 0))).filter("motivo IS NULL").drop("motivo").withColumn("dt", F.to_date("instante_observado")))
    buckets, held = now.near(ok)
    last, days = ok.agg(F.max("id"), F.collect_set(F.col("dt").cast("string"))).first()
    if last is not None:
        name = _name(spark, batch_id)
        _replace(table.first_not_held(ok, held if now.number else None), journal_path, batch_id)
        table.note_ids(spark, journal_path, days, name)
        try:
            # Runs take rows of one sequence together, so these need not be deduplicated for them.
            now.commit(table.held_sequences(ok, held), buckets, stream, batch_id, last_id=max(last, now.fact("last_id", 0)))
        except Moved:
            table.forget_ids(spark, journal_path, name)
            for day in days:
                Folder(spark, journal_path).delete(f"dt={day}/batch_id={name}")
            raise
    ok.unpersist()


def journal_batch(journal_path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch of decoded envelopes with ids into the journal."""
    def run(batch: DataFrame, batch_id: int) -> None:
        _append_new(batch, batch_id, journal_path, lambda rows, _: rows)

    return run


def identified(envelopes: DataFrame, last_id: int = 0) -> DataFrame:
    """Envelopes decoded from shipments as journal rows: key, class, and the ids after ``last_id`` in order of arrival,
    which is the shipments' receipt instant, the shipment, and the place in it."""
    key = idempotency_key(F.col("id_do_dispositivo"), F.col("id_da_sessao_de_boot"), F.col("numero_de_sequencia"))
    rows = arrival_ordinals(envelopes, "instante_observado", ["shipment_id", "posicao"])
    return rows.withColumns({"id": F.col("_ordinal") + last_id, "chave_de_idempotencia": key, "classe_de_dado": data_class(F.col("tipo_de_conteudo"))}).drop("_ordinal")


def shipment_batch(journal_path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch of binary shipments (shipment_id, instante_observado, payload) into the journal. A shipment that is
    refused whole has no rows."""
    def run(batch: DataFrame, batch_id: int) -> None:
        envelopes, _ = split_refused(decode_shipments(batch))
        envelopes = kept(envelopes)
        _append_new(envelopes, batch_id, journal_path, identified)
        envelopes.unpersist()

    return run


def _start(stream: DataFrame, run: Callable[[DataFrame, int], None], checkpoint: str, every: str | None) -> StreamingQuery:
    """``every`` is the time between micro-batches; without it the stream ends when all that is there has been read."""
    trigger = {"availableNow": True} if every is None else {"processingTime": every}
    return stream.writeStream.foreachBatch(run).option("checkpointLocation", checkpoint).trigger(**trigger).start()


def ingest(deliveries: DataFrame, journal_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Validate, deduplicate and append envelopes. Nothing is refused for being late."""
    return _start(deliveries, journal_batch(journal_path), checkpoint, every)


def ingest_shipments(shipments: DataFrame, journal_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """The same from binary shipments."""
    return _start(shipments, shipment_batch(journal_path), checkpoint, every)


def read_journal_stream(spark: SparkSession, path: str, schema, files: int = 16) -> DataFrame:
    """The journal as a stream, so many files a micro-batch at most: what bounds a projection cycle."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(path)


def projection(journal: DataFrame, mapping: DataFrame, reasons: DataFrame, readings_path: str, quarantine_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Journal records into readings, and records that cannot be decoded into quarantine. The checkpoint moves after the
    write; readings are guarded by their row key, so neither a repeated batch nor a new checkpoint writes one twice. Each
    consumer of the journal has a checkpoint of its own."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = kept(batch.drop("dt", "batch_id"))
        write_readings(project(batch, mapping, reasons), readings_path)
        _, lost = split_decodable(batch)
        _replace(lost.withColumn("dt", F.to_date("instante_observado")), quarantine_path, batch_id)
        batch.unpersist()

    return _start(journal, run, checkpoint, every)


def reprocess_quarantine(spark: SparkSession, quarantine_path: str, mapping: DataFrame, reasons: DataFrame, readings_path: str) -> DataFrame:
    """Write the readings of quarantined records that can be decoded now; returns those that stay."""
    readings, rest = reprocess(spark.read.parquet(quarantine_path).drop("dt", "batch_id"), mapping, reasons)
    write_readings(readings, readings_path)
    return rest


def project_cycle(spark: SparkSession, journal_path: str, cursors: Cursors, name: str, mapping: DataFrame, reasons: DataFrame, readings_path: str, quarantine_path: str, limit: int = CYCLE) -> int:
    """Project the next records of a consumer, ``limit`` of them at most, and move its cursor after the write. Returns how
    many there were. A cycle that fails, or whose cursor another has moved, is repeated without harm: readings and
    quarantine are guarded by their keys."""
    at = cursors.position(name)
    page = kept(table.next_rows(spark, journal_path, at, limit).drop("dt", "batch_id"))
    day = F.to_date("instante_observado")
    count, last, *days = page.agg(F.count(F.lit(1)), F.max("id"), F.min(day), F.max(day)).first()
    if count:
        write_readings(project(page, mapping, reasons), readings_path, tuple(days))
        _, lost = split_decodable(page)
        # Pages of one consumer begin at different ids, so a repeated page replaces its own folder.
        lost.withColumns({"dt": F.to_date("instante_observado"), "batch_id": F.lit(f"{name}-{at}")}).write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("dt", "batch_id").parquet(quarantine_path)
        cursors.advance(name, last, at)
    page.unpersist()
    return count


def project_backlog(spark: SparkSession, journal_path: str, cursors: Cursors, name: str, mapping: DataFrame, reasons: DataFrame, readings_path: str, quarantine_path: str, limit: int = CYCLE) -> int:
    """Cycles until a consumer has caught up; returns how many records there were. The first takes ``limit`` records at most and
    each one after it GROWTH times as many as the one before, spread over tasks: a consumer far behind needs a number of
    cycles that grows with the logarithm of what waits, and what the cycles read back is in proportion to it."""
    total = 0
    while count := project_cycle(spark, journal_path, cursors, name, mapping, reasons, readings_path, quarantine_path, limit):
        total, limit = total + count, limit * GROWTH
    return total


def project_forever(cycle: Callable[[], int], every: float = 2.0, until: Callable[[], bool] = lambda: False) -> None:
    """Run cycles: one after the other while there are records, and otherwise after a pause."""
    while not until():
        if not cycle():
            time.sleep(every)


def anchor_table(spark: SparkSession, path: str) -> KeyedTable:
    return KeyedTable(spark, path, SESSION, ANCHORS)


def _first_wins(old: DataFrame, new: DataFrame) -> DataFrame:
    """A session's anchor stays; of several new ones the first by id counts."""
    return old.unionByName(new.join(old.select(*SESSION), SESSION, "left_anti"))


def anchor_batch(path: str) -> Callable[[DataFrame, int], None]:
    """Anchors of the sessions that a micro-batch of the journal begins: the first record of a session is its anchor for
    good. Only buckets of sessions at hand are read and written."""
    def run(batch: DataFrame, batch_id: int) -> None:
        ids = batch.groupBy(*SESSION).agg(F.min("id").alias("id"))
        new = anchors(batch).join(ids, SESSION).withColumns({"decorrido_da_ancora_ns": F.lit(None).cast("long"), "id_da_execucao": F.lit(None).cast("string")})
        anchor_table(batch.sparkSession, path).merge(new, _first_wins, stream_of(batch.sparkSession), batch_id)

    return run


def clock_batch(path: str, marks_path: str) -> Callable[[DataFrame, int], None]:
    """A micro-batch of receipts (id, session, tempo_ligado_ms, instante, decorrido_ns, id_da_execucao): sessions without
    an anchor get one with the clocks of their first receipt, and every receipt is marked where the gateway's wall clock
    has moved away from its monotonic one since. Marked, never dropped."""
    def run(batch: DataFrame, batch_id: int) -> None:
        batch = kept(batch)
        known = anchor_table(batch.sparkSession, path).merge(first_receipts(batch), _first_wins, stream_of(batch.sparkSession), batch_id)
        _replace(clock_steps(batch, known.drop("id", "ancora_ms")).withColumn("dt", F.to_date("instante")), marks_path, batch_id)
        batch.unpersist()

    return run


def mark_clocks(receipts: DataFrame, anchors_path: str, marks_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Anchor sessions and mark clock steps as receipts arrive."""
    return _start(receipts, clock_batch(anchors_path, marks_path), checkpoint, every)


def descriptor_table(spark: SparkSession, path: str, schema) -> KeyedTable:
    kind = schema["descritor_da_origem"].dataType.simpleString()
    return KeyedTable(spark, path, ["id_do_dispositivo"], f"id_do_dispositivo string, descritor_da_origem {kind}, declarado_em timestamp, id long")


def _latest_wins(old: DataFrame, new: DataFrame) -> DataFrame:
    both = old.unionByName(new).groupBy("id_do_dispositivo").agg(F.max_by(F.struct("descritor_da_origem", "declarado_em", "id"), "id").alias("d"))
    return both.select("id_do_dispositivo", "d.*")


def descriptor_batch(path: str) -> Callable[[DataFrame, int], None]:
    """The latest descriptor of each device, merged into a table with one row per device."""
    def run(batch: DataFrame, batch_id: int) -> None:
        rows = latest_descriptors(batch)
        descriptor_table(batch.sparkSession, path, rows.schema).merge(rows, _latest_wins, stream_of(batch.sparkSession), batch_id)

    return run


def track(journal: DataFrame, anchors_path: str, descriptors_path: str, checkpoint: str, every: str | None = None) -> StreamingQuery:
    """Keep the tables of anchors and of latest descriptors up to the journal's stream."""
    first, last = anchor_batch(anchors_path), descriptor_batch(descriptors_path)

    def run(batch: DataFrame, batch_id: int) -> None:
        batch = kept(batch.drop("dt", "batch_id"))
        first(batch, batch_id)
        last(batch, batch_id)
        batch.unpersist()

    return _start(journal, run, checkpoint, every)


def read_anchors(spark: SparkSession, path: str) -> DataFrame:
    return anchor_table(spark, path).read()


def read_descriptors(spark: SparkSession, path: str, schema) -> DataFrame:
    """The latest descriptor of each device; ``schema`` is the journal's."""
    return descriptor_table(spark, path, schema).read()


def counts_per_minute(readings: DataFrame, late: str = "1 hour") -> DataFrame:
    """Device counts per minute of a stream; only this view drops rows later than the watermark."""
    minutes = readings.withWatermark("instante_observado", late).groupBy(F.window("instante_observado", "1 minute"), "id_do_dispositivo")
    # The window itself is the key: only then does the watermark close it.
    return minutes.agg(F.count(F.lit(1)).alias("registros")).select(F.col("window.start").alias("minuto"), "id_do_dispositivo", "registros")
