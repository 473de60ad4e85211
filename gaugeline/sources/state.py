"""Small durable state beside the big tables: numbered versions, cursors, and keyed tables that are merged batch by batch.

A version is a JSON document under a number that can be taken once: a writer that finds its number taken lost a race and
must look again. Keyed tables keep rows in buckets by a hash of their keys; a batch reads and rewrites the buckets of its
own keys and then takes the next number, so readers see all of a batch or nothing of it.
"""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Versions that stay readable behind the latest, with the folders they name.
KEPT = 3


class Moved(RuntimeError):
    """Another writer was first."""


class Folder:
    """A folder on any file system that Spark knows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.jvm, self.path = spark, spark.sparkContext._jvm, path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.at().getFileSystem(self.conf)

    def at(self, name: str = ""):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def names(self, below: str = "") -> list[str]:
        where = self.at(below)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []

    def text(self, name: str) -> str:
        stream = self.fs.open(self.at(name))
        try:
            return self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def replace(self, name: str, text: str) -> None:
        """Write a file, in the place of one of that name."""
        stream = self.fs.create(self.at(name), True)
        stream.write(bytearray(text.encode()))
        stream.close()

    def create(self, name: str, text: str) -> None:
        """Write a file that is not there yet: it appears whole under its name, or Moved is raised."""
        held = self.at(f".{uuid.uuid4().hex}")
        self.replace(held.getName(), text)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.at().toUri(), self.conf)
        rename = getattr(self.jvm.org.apache.hadoop.fs, "Options$Rename")
        never = self.jvm.java.lang.reflect.Array.newInstance(rename.NONE.getClass(), 1)
        never[0] = rename.NONE
        source, target = (self.fs.makeQualified(p) for p in (held, self.at(name)))
        try:
            context.rename(source, target, never)
        except Py4JJavaError as taken:
            self.fs.delete(held, False)
            if "FileAlreadyExists" in taken.java_exception.getClass().getName():
                raise Moved(f"{self.path}/{name}") from taken
            raise


#: Whether Spark may choose the partitions of a kept frame by its size, as it does for other frames.
_SIZED = "spark.sql.optimizer.canChangeCachedPlanOutputPartitioning"


def kept(df: DataFrame) -> DataFrame:
    """The frame, persisted in partitions by its size: a small one would else keep all of spark.sql.shuffle.partitions, and
    each shuffle of it would write a file for every pair of them."""
    conf = df.sparkSession.conf
    was = conf.get(_SIZED)
    conf.set(_SIZED, "true")
    try:
        return df.persist()
    finally:
        conf.set(_SIZED, was)


def scratch(spark: SparkSession) -> str:
    """A new folder below spark.checkpoint.dir, which all executors see, for tables that go when the driver ends. Where that
    is unset a folder of this machine is taken in local mode; on a cluster that is an error."""
    base = spark.conf.get("spark.checkpoint.dir", "") or spark.sparkContext.getCheckpointDir() or ""
    if not base and not spark.sparkContext.master.startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    base = base or tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    folder = Folder(spark, f"{base if '://' in base or base.startswith('file:') else 'file://' + base}/tables-{uuid.uuid4().hex}")
    folder.fs.deleteOnExit(folder.at())
    return folder.path


class Versions:
    """Numbered JSON documents, of which the largest number counts."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.folder = Folder(spark, path)

    def _numbers(self) -> list[int]:
        return sorted(int(n.removesuffix(".json")) for n in self.folder.names() if n.endswith(".json"))

    def latest(self) -> tuple[int, dict]:
        """Number and content; 0 and nothing before the first."""
        numbers = self._numbers()
        return (numbers[-1], json.loads(self.folder.text(f"{numbers[-1]:012d}.json"))) if numbers else (0, {})

    def kept(self) -> list[dict]:
        return [json.loads(self.folder.text(f"{n:012d}.json")) for n in self._numbers()[-KEPT:]]

    def commit(self, number: int, content: dict) -> None:
        """Take a number, the one after that which was read; raises Moved where it is taken."""
        self.folder.create(f"{number:012d}.json", json.dumps(content))
        for old in self._numbers()[:-KEPT]:
            self.folder.delete(f"{old:012d}.json")


class Cursors:
    """How far each named consumer of the journal has come. A move is compared and swapped: consumers that move at the same
    time do not lose each other's moves, and one that believes an old position is told so."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.versions = spark, Versions(spark, path)

    def position(self, name: str) -> int:
        """0 for a consumer that has not begun."""
        return self.versions.latest()[1].get(name, [0])[0]

    def advance(self, name: str, last: int, expected: int | None = None, at: str | None = None) -> None:
        """Set a consumer's position; with ``expected``, only if that is where it stands, else Moved."""
        while True:
            number, content = self.versions.latest()
            if expected is not None and content.get(name, [0])[0] != expected:
                raise Moved(f"{name} stands at {content.get(name, [0])[0]}, not at {expected}")
            now = at or str(self.spark.range(1).select(F.current_timestamp().cast("string")).first()[0])
            try:
                self.versions.commit(number + 1, content | {name: [last, now]})
                return
            except Moved:
                continue

    def table(self) -> DataFrame:
        """nome, ultimo_id_projetado, atualizado_em."""
        rows = [(name, last, at) for name, (last, at) in sorted(self.versions.latest()[1].items())]
        frame = self.spark.createDataFrame(rows, "nome string, ultimo_id_projetado long, em string")
        return frame.select("nome", "ultimo_id_projetado", F.col("em").cast("timestamp").alias("atualizado_em"))


@dataclass
class Snapshot:
    """A keyed table as one version has it."""

    table: KeyedTable
    number: int
    state: dict = field(default_factory=dict)

    def has(self, writer: str, batch_id: int) -> bool:
        """Whether that writer's batch, or a later one, is in it."""
        return self.state.get("writers", {}).get(writer, -1) >= batch_id

    def fact(self, name: str, other=None):
        return self.state.get("facts", {}).get(name, other)

    def rows(self, buckets: Iterable[int] | None = None) -> DataFrame:
        """All rows, or those of some buckets: no other folder is read."""
        of = self.state.get("buckets", {})
        wanted = [b for b in of if buckets is None or int(b) in set(buckets)]
        paths = [f"{self.table.path}/{of[b]}/bucket={b}" for b in wanted]
        spark = self.table.spark
        return spark.read.schema(self.table.schema).parquet(*paths) if paths else spark.createDataFrame([], self.table.schema)

    def near(self, keys: DataFrame) -> tuple[list[int], DataFrame]:
        """The buckets of some rows' keys, and what the table holds there. Only bucket numbers reach the driver."""
        buckets = sorted(r[0] for r in keys.select(self.table.bucket()).distinct().collect())
        return buckets, self.rows(buckets)

    def commit(self, rows: DataFrame, buckets: list[int], writer: str = "", batch_id: int = 0, **facts) -> None:
        """Put rows in the place of those buckets, as the next version."""
        name = f"v{self.number + 1}-{uuid.uuid4().hex[:8]}"
        folder = self.table.folder
        if buckets:
            dealt = rows.select(*self.table.schema.names, self.table.bucket()).repartition(len(buckets), "bucket")
            dealt.write.partitionBy("bucket").parquet(f"{self.table.path}/{name}")
        written = {n.removeprefix("bucket=") for n in folder.names(name) if n.startswith("bucket=")}
        of = {b: f for b, f in self.state.get("buckets", {}).items() if int(b) not in buckets} | {b: name for b in written}
        state = {"buckets": of, "writers": self.state.get("writers", {}) | {writer: batch_id}, "facts": self.state.get("facts", {}) | facts, "number": self.table.buckets}
        try:
            self.table.versions.commit(self.number + 1, state)
        except Moved:
            folder.delete(name)
            raise
        self.state, self.number = state, self.number + 1
        used = {f for content in self.table.versions.kept() for f in content["buckets"].values()}
        for old in folder.names():
            # Folders of writers that are not done yet bear higher numbers.
            if old[0] == "v" and old not in used and int(old[1:].split("-")[0]) <= self.number - KEPT:
                folder.delete(old)


class KeyedTable:
    """Rows by keys in ``buckets`` buckets, a number that a table keeps for good."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], schema: str, buckets: int = 64) -> None:
        self.spark, self.path, self.keys = spark, path, keys
        self.schema = StructType.fromDDL(schema)
        self.folder, self.versions = Folder(spark, path), Versions(spark, f"{path}/_versions")
        self.buckets = self.versions.latest()[1].get("number", buckets)

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    def snapshot(self) -> Snapshot:
        return Snapshot(self, *self.versions.latest())

    def read(self) -> DataFrame:
        return self.snapshot().rows()

    def merge(self, batch: DataFrame, merged: Callable[[DataFrame, DataFrame], DataFrame], writer: str = "", batch_id: int | None = None) -> DataFrame:
        """Merge a batch: ``merged`` makes the new rows of its buckets from the old ones and the batch. A batch that is in
        the table already changes nothing. Returns the rows of the batch's buckets afterwards."""
        now, batch = self.snapshot(), kept(batch)  # made once for its buckets and for its rows
        buckets, old = now.near(batch)
        if batch_id is None or not now.has(writer, batch_id):
            now.commit(merged(old, batch), buckets, writer, -1 if batch_id is None else batch_id)
        batch.unpersist()
        return now.rows(buckets)
