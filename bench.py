"""Times the headline queries and prints one JSON line."""

from __future__ import annotations

import importlib.util
import json
import os
import tempfile
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.operators import journal, validate
from gaugeline.plans import telemetry
from gaugeline.sources import events, wire

HEADLINES = ("w1_deduplicate", "r2_long_projection", "a7_out_of_range", "a1_acknowledge", "w4_sequence_gaps", "j5_commissioning", "d2_reaggregate", "v_validate")
#: Corpus operators that are timed once each, beside the headline.
OPERATORS = ("op12_whitening", "op13_filter_audit")
#: Copies of the deliveries, each with devices of its own, over which rates are measured.
COPIES = 10


def seconds(df: DataFrame) -> float:
    at = time.time()
    df.write.format("noop").mode("overwrite").save()
    return time.time() - at


def rates(spark: SparkSession, sf_dir: str, folder: str) -> dict[str, int]:
    """Envelopes a second of single steps over stored deliveries, where fixed costs of a job weigh little."""
    rows = spark.read.parquet(f"{sf_dir}/events.parquet")
    rows = rows.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(COPIES - 1)))).withColumn("user_id", F.col("user_id") + F.col("copy") * 10_000)
    rows = rows.withColumn("event_id", F.col("event_id") * COPIES + F.col("copy")).drop("copy")
    events.deliveries(rows).write.parquet(f"{folder}/deliveries")
    stored = spark.read.parquet(f"{folder}/deliveries")
    wire.encode_shipments(stored).write.parquet(f"{folder}/shipments")
    count, shipments = stored.count(), spark.read.parquet(f"{folder}/shipments")
    steps = {"validate": validate.validate(stored), "deduplicate": journal.deduplicate(stored), "acknowledge": journal.acknowledge(stored), "decode": wire.decode_shipments(shipments)}
    return {name: round(count / min(seconds(df) for _ in range(2))) for name, df in steps.items()}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    folder = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    spark = (
        SparkSession.builder.master(f"local[{os.environ.get('BENCH_CPUS', '8')}]")
        .config("spark.sql.shuffle.partitions", "8").config("spark.sql.session.timeZone", "UTC").config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.driver.memory", "4g")
        .config("spark.sql.warehouse.dir", folder).getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    rows = events.deliveries(spark.read.parquet(f"{sf_dir}/events.parquet")).count()
    took, spread = {}, {}
    for name in HEADLINES:
        runs = [seconds(telemetry.QUERIES[name](spark, sf_dir)) for _ in range(3)]
        took[name], spread[name] = round(min(runs), 3), round(max(runs) - min(runs), 3)
    beside = {}
    if importlib.util.find_spec("gaugeline.llm"):
        corpus = importlib.import_module("gaugeline.llm.queries").QUERIES
        for name in (n for n in OPERATORS if n in corpus):
            at = time.time()
            corpus[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            beside[name] = round(time.time() - at, 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1], "spread": spread,
                      "deliveries_per_s": {n: round(rows / s) for n, s in took.items()}, "envelopes_per_s": rates(spark, sf_dir, folder), "operators": beside}))


if __name__ == "__main__":
    main()
