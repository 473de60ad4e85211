"""The read model in a relational database over JDBC. The database's driver jar is the user's to supply."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.projection import ROW_KEY

#: How often a merge is tried again that another writer's has made impossible.
TRIES = 20


def read_readings(spark: SparkSession, url: str, table: str = "leitura", since: str | None = None, until: str | None = None, partitions: int = 8, **options: str) -> DataFrame:
    """The table; with both instants, only rows from since to until, inclusive, read in parallel time stretches."""
    reader = spark.read.format("jdbc").options(url=url, dbtable=table, fetchsize="10000", **options)
    if since is None or until is None:
        return reader.load()
    reader = reader.options(partitionColumn="instante_observado", lowerBound=since, upperBound=until, numPartitions=str(partitions))
    return reader.load().filter(F.col("instante_observado").between(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")))


@contextmanager
def _connection(spark: SparkSession, url: str, table: str, options: dict[str, str]) -> Iterator:
    """A connection of the driver's own, made as Spark makes those of its tasks."""
    jvm = spark.sparkContext._jvm
    asked = jvm.PythonUtils.toScalaMap({"url": url, "dbtable": table, **options})
    connect = jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).createConnectionFactory(jvm.org.apache.spark.sql.execution.datasources.jdbc.JDBCOptions(asked))
    connection = connect.apply(-1)
    try:
        yield connection
    finally:
        connection.close()


def _run(connection, sql: str) -> int:
    statement = connection.createStatement()
    try:
        return statement.executeUpdate(sql)
    finally:
        statement.close()


def write_readings(rows: DataFrame, url: str, table: str = "leitura", partitions: int = 8, **options: str) -> int:
    """Add the readings whose key is not there yet, and return how many.

    Tasks write all rows to a table of this lot, in parallel; one statement, in one serializable transaction, then adds
    those of absent keys. So readers see all of a lot or none of it, a repeated lot changes nothing, and of two writers
    at once the database lets one wait or fail; that one tries again and finds the other's rows. Keys are not null. Large
    tables want the unique index of the key: the statement looks every key of the lot up.
    """
    spark, lot = rows.sparkSession, f"{table}_lote_{uuid.uuid4().hex[:8]}"
    with _connection(spark, url, table, options) as own:
        mark = own.getMetaData().getIdentifierQuoteString().strip()
        quoted = lambda name: f"{mark}{name}{mark}"
        _run(own, f"CREATE TABLE {lot} AS SELECT * FROM {table} WITH NO DATA")
        try:
            named = {c.lower(): c for c in spark.read.format("jdbc").options(url=url, dbtable=lot, **options).load().columns}
            rows.dropDuplicates(list(ROW_KEY)).coalesce(partitions).write.format("jdbc").options(url=url, dbtable=lot, batchsize="10000", **options).mode("append").save()
            columns = ", ".join(quoted(named[c.lower()]) for c in rows.columns)
            same = " AND ".join(f"t.{quoted(named[k])} = s.{quoted(named[k])}" for k in ROW_KEY)
            own.setAutoCommit(False)
            own.setTransactionIsolation(spark.sparkContext._jvm.java.sql.Connection.TRANSACTION_SERIALIZABLE)
            for left in reversed(range(TRIES)):
                try:
                    added = _run(own, f"INSERT INTO {table} ({columns}) SELECT {columns} FROM {lot} s WHERE NOT EXISTS (SELECT 1 FROM {table} t WHERE {same})")
                    own.commit()
                    return added
                except Py4JJavaError:
                    own.rollback()
                    if not left:
                        raise
            return 0
        finally:
            own.setAutoCommit(True)
            _run(own, f"DROP TABLE {lot}")
