"""The journal: first arrival wins, acknowledgements, pages, cursors and pruning."""

from __future__ import annotations

import uuid
from datetime import timedelta

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..sources.state import Folder, Versions

SESSION = ["id_do_dispositivo", "id_da_sessao_de_boot"]


def deduplicate(rows: DataFrame, by_session: bool = False) -> DataFrame:
    """One row per idempotency key, which is device, session and sequence: the one with the smallest id, also inside a
    batch. With ``by_session`` a session's rows come to one task, for what groups by session next and then needs no
    further shuffle; without it, a session with very many rows is spread."""
    if by_session:
        rows = rows.repartition(*SESSION)
    first = Window.partitionBy(*SESSION, "numero_de_sequencia").orderBy("id")
    return rows.withColumn("_n", F.row_number().over(first)).filter("_n = 1").drop("_n")


#: Sequences of a page: runs of held sequences are cut at page ends, so that a long session is spread over tasks.
PAGE = 1 << 16
HELD = "id_do_dispositivo string, id_da_sessao_de_boot string, pagina long, primeira long, ultima long"


def _spans(rows: DataFrame) -> DataFrame:
    """Rows as runs of one sequence each."""
    at = F.col("numero_de_sequencia")
    return rows.select(*SESSION, F.floor(at / PAGE).cast("long").alias("pagina"), at.alias("primeira"), at.alias("ultima"))


def held_sequences(rows: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """Runs of consecutive sequences (SESSION, pagina, primeira, ultima) that rows, and the runs held before, cover
    together. A window sees one page of a session: no more runs than a page has sequences."""
    spans = _spans(rows) if held is None else _spans(rows).unionByName(held)
    order = Window.partitionBy(*SESSION, "pagina").orderBy("primeira", "ultima")
    reach = F.max("ultima").over(order.rowsBetween(Window.unboundedPreceding, -1))
    begins = F.when(F.coalesce(F.col("primeira") <= reach + 1, F.lit(False)), 0).otherwise(1)
    runs = spans.withColumn("_begins", begins).withColumn("_run", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    return runs.groupBy(*SESSION, "pagina", "_run").agg(F.min("primeira").alias("primeira"), F.max("ultima").alias("ultima")).drop("_run")


def not_held(batch: DataFrame, held: DataFrame) -> DataFrame:
    """Rows of a batch whose sequence no run of its session covers. Rows and runs of a page are walked in one sorted pass
    that carries the last end so far, so the work does not multiply with the number of runs."""
    rows = batch.select(*SESSION, F.floor(F.col("numero_de_sequencia") / PAGE).cast("long").alias("pagina"), F.col("numero_de_sequencia").alias("primeira"),
                        F.lit(None).cast("long").alias("ultima"), F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_row"))
    runs = held.withColumn("_row", F.lit(None).cast(rows.schema["_row"].dataType))
    order = Window.partitionBy(*SESSION, "pagina").orderBy("primeira", F.col("ultima").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    both = rows.unionByName(runs).withColumn("_until", F.max("ultima").over(order))
    return both.filter("_row IS NOT NULL AND (_until IS NULL OR _until < primeira)").select("_row.*")


def first_not_held(batch: DataFrame, held: DataFrame | None = None) -> DataFrame:
    """``not_held`` of the deduplicated batch in one sorted pass: a row is new where neither a run of its session nor an
    earlier row reaches its sequence, and of rows of one sequence the smallest id comes first."""
    rows = batch.select(*SESSION, F.floor(F.col("numero_de_sequencia") / PAGE).cast("long").alias("pagina"), F.col("numero_de_sequencia").alias("primeira"), F.col("numero_de_sequencia").alias("ultima"),
                        F.lit(1).alias("_own"), F.col("id").alias("_id"), F.struct(*[F.col(f"`{c}`") for c in batch.columns]).alias("_row"))
    if held is not None:
        rows = rows.unionByName(held.withColumns({"_own": F.lit(0), "_id": F.lit(None).cast("long"), "_row": F.lit(None).cast(rows.schema["_row"].dataType)}))
    before = Window.partitionBy(*SESSION, "pagina").orderBy("primeira", "_own", "_id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("_until", F.max("ultima").over(before)).filter("_own = 1 AND (_until IS NULL OR _until < primeira)").select("_row.*")


def not_yet_written(batch: DataFrame, journal: DataFrame) -> DataFrame:
    """Rows of a deduplicated batch whose key the journal does not hold. Only sessions present in the batch are read."""
    sessions = batch.select(*SESSION).distinct()
    known = journal.join(sessions, SESSION, "left_semi").select("chave_de_idempotencia")
    return batch.join(known, "chave_de_idempotencia", "left_anti")


def exists(spark: SparkSession, path: str) -> bool:
    """Whether there is a folder, on any file system that Spark knows."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(at)


def append(rows: DataFrame, path: str) -> None:
    """Append to the journal table: a folder per day of observation, and in it one of this write."""
    rows = rows.withColumns({"dt": F.to_date("instante_observado"), "batch_id": F.lit(f"append-{uuid.uuid4().hex[:8]}")})
    rows.write.mode("append").partitionBy("dt", "batch_id").parquet(path)


def read(spark: SparkSession, path: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """The journal table, without folders that a fold has replaced; with days, only their folders are read."""
    rows = spark.read.parquet(path)
    if exists(spark, f"{path}/_folds"):
        for day, names in Versions(spark, f"{path}/_folds").latest()[1].items():
            if names:
                rows = rows.filter((F.col("dt") != F.lit(day).cast("date")) | ~F.col("batch_id").isin(names))
    rows = rows if since is None else rows.filter(F.col("dt") >= F.lit(since).cast("date"))
    return rows if until is None else rows.filter(F.col("dt") <= F.lit(until).cast("date"))


def read_days(new: DataFrame, path: str, days_before: int = 0, span: tuple | None = None) -> DataFrame | None:
    """What a table with a folder per day holds of the days of ``new`` (its column dt; ``span`` where they are known), and so
    many before; None before the first write or without rows."""
    if not exists(new.sparkSession, path):
        return None
    span = new.agg(F.min("dt"), F.max("dt")).first() if span is None else span
    if span[0] is None:
        return None
    return read(new.sparkSession, path, str(span[0] - timedelta(days=days_before)), str(span[1]))


def acknowledge(rows: DataFrame) -> DataFrame:
    """Per shipment: the highest sequence including duplicates, rows written and rows that were duplicates."""
    first = Window.partitionBy(*SESSION, "numero_de_sequencia").orderBy("id")
    marked = rows.withColumn("_new", F.row_number().over(first) == 1)
    return marked.groupBy("shipment_id").agg(
        F.max("numero_de_sequencia").alias("duravel_ate"), F.count_if("_new").alias("gravados"), F.count_if(~F.col("_new")).alias("duplicados")
    )


def acknowledge_validated(rows: DataFrame) -> DataFrame:
    """Per shipment of validated rows (motivo null: accepted): highest accepted sequence, 0 if none, and rejected ones."""
    ok = F.col("motivo").isNull()
    return rows.groupBy("shipment_id").agg(
        F.coalesce(F.max(F.when(ok, F.col("numero_de_sequencia"))), F.lit(0)).alias("duravel_ate"),
        F.sort_array(F.collect_set(F.when(~ok, F.col("numero_de_sequencia")))).alias("rejeitadas"),
    )


def durable_until(journal: DataFrame) -> DataFrame:
    return journal.groupBy("id_do_dispositivo", "id_da_sessao_de_boot").agg(F.max("numero_de_sequencia").alias("duravel_ate"))


def page(journal: DataFrame, cursor: int, limit: int = 500) -> DataFrame:
    return journal.filter(F.col("id") > cursor).orderBy("id").limit(limit)


#: Rows of a page that one task may sort; larger ones are found by counting.
SORTED = 20_000


def up_to(rows: DataFrame, cursor: int, limit: int) -> DataFrame:
    """The next ``limit`` rows after a cursor, by id and unordered, of any number: the last one's id is found by counting ids
    in ever narrower stretches, so no task sees more than its own rows."""
    ahead = rows.filter(F.col("id") > cursor).select("id")
    low, high = ahead.agg(F.min("id"), F.max("id")).first()
    want = limit
    while low is not None and low < high:
        width = -(-(high - low + 1) // 4096)
        counts = ahead.filter(F.col("id").between(low, high)).groupBy(F.expr(f"(id - {low}L) div {width}L").alias("_at")).count().collect()
        for at, n in sorted(map(tuple, counts)):
            if n >= want:
                low, high = low + at * width, min(high, low + (at + 1) * width - 1)
                break
            want -= n
        else:
            break  # fewer rows than wanted
        if width == 1:
            break
    return rows.filter((F.col("id") > cursor) & (F.col("id") <= high)) if high is not None else rows.limit(0)


def note_ids(spark: SparkSession, path: str, days: list[str], batch: str) -> None:
    """Note which ids a batch's rows have and in which of ``days`` they lie, for ``next_rows``; its folders tell, so what was
    written is not made again. The ids are in the note's name, so finding the next ones takes a list of names."""
    folder = Folder(spark, path)
    days = [d for d in sorted(days) if folder.names(f"dt={d}/batch_id={batch}")]
    if days:
        rows = spark.read.schema("id long").parquet(*(f"{path}/dt={d}/batch_id={batch}" for d in days))
        n, first, last = rows.agg(F.count(F.lit(1)), F.min("id"), F.max("id")).first()
        folder.replace(f"_ids/{first:019d}-{last:019d}-{n}-{batch}", "\n".join(days))


def forget_ids(spark: SparkSession, path: str, batch: str) -> None:
    folder = Folder(spark, path)
    for name in folder.names("_ids"):
        if name.split("-", 3)[3] == batch:
            folder.delete(f"_ids/{name}")


def next_rows(spark: SparkSession, path: str, cursor: int, limit: int = 500) -> DataFrame:
    """The journal's next ``limit`` rows after a cursor, by id. Where batches have noted their ids, only the folders are read
    that can hold these rows, however long the journal is; a folder that a fold has replaced is read by its day."""
    folder = Folder(spark, path)
    notes = sorted((int(first), int(last), int(n), name) for name in folder.names("_ids") for first, last, n, _ in [name.split("-", 3)])
    if not notes:
        return page(read(spark, path), cursor, limit) if limit <= SORTED else up_to(read(spark, path), cursor, limit)
    ahead = [note for note in notes if note[1] > cursor]
    bound, whole, at = cursor, 0, 0
    while True:
        # As many batches as hold the wanted number of rows past the cursor; rows beyond their last id wait.
        while at < len(ahead) and whole < limit:
            first, last, n, _ = ahead[at]
            bound, whole, at = max(bound, last), whole + (n if first > cursor else 0), at + 1
        # Batches whose ids overlap those count too.
        paths, sure = _folders_of(folder, [name for first, _, _, name in ahead if first <= bound])
        rows = spark.read.option("basePath", path).parquet(*paths).filter(F.col("id") <= bound) if paths else read(spark, path).limit(0)
        rows = page(rows, cursor, limit) if limit <= SORTED else up_to(rows, cursor, limit)
        # Notes do not know what has been pruned: where it is all of these batches, the next ones have a turn.
        if sure or at == len(ahead) or not rows.isEmpty():
            return rows
        whole = 0


def _folders_of(folder: Folder, notes: list[str]) -> tuple[list[str], bool]:
    """Folders that hold the rows of noted batches, and whether all are still as they were noted."""
    wanted: dict[str, set[str]] = {}
    for name in notes:
        for day in folder.text(f"_ids/{name}").split():
            wanted.setdefault(day, set()).add(f"batch_id={name.split('-', 3)[3]}")
    hidden = Versions(folder.spark, f"{folder.path}/_folds").latest()[1]
    paths, sure = [], True
    for day, batches in wanted.items():
        there = set(folder.names(f"dt={day}")) - {f"batch_id={n}" for n in hidden.get(day, [])}
        sure &= batches <= there
        paths += [f"{folder.path}/dt={day}/{n}" for n in sorted(batches if batches <= there else there)]
    return paths, sure


def readings_page(journal: DataFrame, limit: int = 100, latest: bool = False) -> DataFrame:
    """The oldest rows, or with ``latest`` the newest ones."""
    return journal.orderBy(F.desc("id") if latest else F.asc("id")).limit(limit)


def advance(cursors: DataFrame, name: str, last: int, at) -> DataFrame:
    """The cursor table after a named consumer has moved."""
    spark = cursors.sparkSession
    row = spark.createDataFrame([(name, last, at)], "nome string, ultimo_id_projetado long, atualizado_em timestamp")
    return cursors.filter(F.col("nome") != name).unionByName(row)


def prune(journal: DataFrame, cursors: DataFrame, before) -> DataFrame:
    """What stays: rows go when every consumer is past them and they are older than ``before``. No cursor, or one at
    zero, and nothing goes."""
    safe = cursors.agg(F.coalesce(F.min("ultimo_id_projetado"), F.lit(0)).alias("_safe"))
    gone = (F.col("id") <= F.col("_safe")) & (F.col("instante_observado") < F.lit(before).cast("timestamp"))
    return journal.join(F.broadcast(safe)).filter(~gone).drop("_safe")  # one row by construction


def fold_day(spark: SparkSession, path: str, day: str, keep: Column | None = None) -> None:
    """Rewrite a day's folders as one, with the rows for which ``keep`` holds.

    The list of replaced folders is a versioned document: the new folder is on it while it is written, and one commit takes
    it off and puts the old ones on, so readers see either. Old folders stay for readers that have listed them, until
    ``clear_folds``. Folders that a stream adds meanwhile are not on the list and not touched.
    """
    folder, versions = Folder(spark, path), Versions(spark, f"{path}/_folds")
    number, hidden = versions.latest()
    old = hidden.get(day, [])
    now = [n.removeprefix("batch_id=") for n in folder.names(f"dt={day}") if n.startswith("batch_id=")]
    now, new = [n for n in now if n not in old], f"fold-{uuid.uuid4().hex[:8]}"
    if not now:
        return
    versions.commit(number + 1, hidden | {day: [*old, new]})
    rows = spark.read.parquet(*(f"{path}/dt={day}/batch_id={n}" for n in now))
    rows = rows if keep is None else rows.filter(keep)
    rows.coalesce(1 + len(now) // 1000).write.parquet(f"{path}/dt={day}/batch_id={new}")
    versions.commit(number + 2, hidden | {day: [*old, *now]})


def clear_folds(spark: SparkSession, path: str) -> int:
    """Delete the folders that folds have replaced, once no reader of before needs them. Returns how many."""
    folder, versions = Folder(spark, path), Versions(spark, f"{path}/_folds")
    number, hidden = versions.latest()
    gone = [(day, n) for day, names in hidden.items() for n in names]
    for day, n in gone:
        folder.delete(f"dt={day}/batch_id={n}")
    if gone:
        versions.commit(number + 1, {})
    return len(gone)


def compact(spark: SparkSession, path: str, before: str) -> list[str]:
    """Fold the days before ``before`` that have more than one folder; what earlier folds replaced is deleted first. Returns
    the days folded."""
    clear_folds(spark, path)
    folder = Folder(spark, path)
    days = [n.removeprefix("dt=") for n in folder.names() if n.startswith("dt=")]
    days = [d for d in days if d < before and len([n for n in folder.names(f"dt={d}") if n.startswith("batch_id=")]) > 1]
    for day in days:
        fold_day(spark, path, day)
    return days


def prune_table(spark: SparkSession, path: str, cursors: DataFrame, before) -> tuple[list[str], list[str]]:
    """``prune`` on the journal table: days of which all rows go are deleted, and days of which some go are rewritten; other
    folders are not touched. Returns both lists of days; only counts by day reach the driver."""
    safe = cursors.agg(F.coalesce(F.min("ultimo_id_projetado"), F.lit(0))).first()[0]
    limit = F.lit(before).cast("timestamp")
    gone = (F.col("id") <= safe) & (F.col("instante_observado") < limit)
    days = read(spark, path).filter(F.col("dt") <= F.to_date(limit)).groupBy("dt").agg(F.count(F.lit(1)).alias("all"), F.count_if(gone).alias("gone"))
    deleted, rewritten = [], []
    for day, every, some in sorted((str(r["dt"]), r["all"], r["gone"]) for r in days.filter("gone > 0").collect()):
        if some == every:
            Folder(spark, path).delete(f"dt={day}")
            deleted.append(day)
        else:
            fold_day(spark, path, day, ~gone)
            rewritten.append(day)
    return deleted, rewritten


def prune_days(spark: SparkSession, path: str, cursors: DataFrame, before: str) -> list[str]:
    """Delete whole days of the journal table: those before ``before`` whose records every consumer has passed. Other
    rows stay as they are. Returns the days deleted; only ids and counts of days reach the driver."""
    safe = cursors.agg(F.coalesce(F.min("ultimo_id_projetado"), F.lit(0))).first()[0]
    days = read(spark, path).filter(F.col("dt") < F.lit(before).cast("date")).groupBy("dt").agg(F.max("id").alias("last")).filter(F.col("last") <= safe)
    gone = sorted(str(r["dt"]) for r in days.select("dt").collect())
    for day in gone:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/dt={day}")
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
    return gone
