"""A corpus pipeline: toxic documents go, one of each near-duplicate group stays, personal data is masked, sources are
mixed to target weights, and the mix is encoded."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gaugeline.llm.bpe import encode
from gaugeline.llm.minhash import near_duplicates
from gaugeline.llm.mixing import mix
from gaugeline.llm.pii import find, redacted
from gaugeline.llm.shared import stage
from gaugeline.llm.toxicity import score

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Helper column of the stages, taken off again.
MARK = "_mark"
#: None: no SQL expresses a trained classifier or the tokenizer; tests compare the stages with brute force.
ORACLE_SQL = None


def _marked(docs: DataFrame) -> DataFrame:
    """The columns of documents and a mark: doc_id and mark together, nulls included, tell rows apart that repeat a
    doc_id with another text or source."""
    return docs.select(*COLUMNS, F.xxhash64("text", "lang", "source", "n_chars").alias(MARK))


def _same_row(other: DataFrame) -> tuple[DataFrame, Column]:
    """The other table with its keys renamed, and the condition that its row is the document's."""
    renamed = other.withColumnRenamed("doc_id", "_id").withColumnRenamed(MARK, "_other")
    return renamed, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col(MARK) == F.col("_other"))


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not call toxic. It learns from labels of the documents at hand; without rows of
    both labels all stay. Null and empty texts and null doc_ids are scored like others; rows that repeat a doc_id go or
    stay by their own text. An empty table gives an empty table."""
    rows, labels = docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/labels.parquet")
    return score(rows, labels, carry=tuple(COLUMNS[1:])).filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by a similarity of 0.8 on shingles of five words: the smallest doc_id, of its
    texts the smallest mark, of equal rows one. Blank texts and texts without doc_id belong to no group and stay."""
    rows = _marked(docs)
    found = stage(near_duplicates(rows, shingle=5, percent=80, carry=(MARK,)).select("doc_id", "kept", "group_key", MARK), "groups")
    # Kept rows of one group share its smallest doc_id; there is more than one only where rows repeat that doc_id.
    kept = found.filter("kept AND group_key IS NOT NULL").groupBy("group_key", "doc_id", MARK).agg(F.count(F.lit(1)).alias("_copies"))
    ties = kept.groupBy("group_key").agg(F.min(MARK).alias("_first"), F.sum("_copies").alias("_rows")).filter("_rows > 1")
    tied = kept.join(ties, "group_key").select("doc_id", MARK, (F.col(MARK) == F.col("_first")).alias("_stays"))
    gone = found.filter("NOT kept").select("doc_id", MARK, F.lit(False).alias("_stays")).distinct()
    marked = stage(gone.unionByName(tied), "marked")
    others = rows.join(*_same_row(marked), "left_anti").select(*COLUMNS)
    repeated = rows.join(*_same_row(marked.filter("_stays").drop("_stays")), "left_semi").select(*COLUMNS).dropDuplicates()
    return others.unionByName(repeated)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data spans replaced by their kind; n_chars follows the text. A null text stays null, with null n_chars;
    every row stays, repeated ones and those without doc_id too, each masked by its own text."""
    found = find(docs.select(*COLUMNS), carry=tuple(COLUMNS[1:]))
    return redacted(found.select("spans", *COLUMNS)).select(*COLUMNS).withColumn("n_chars", F.length("text").cast("long"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words the mix takes: a document appears once for each round it is taken in, the last time cut to its share.
    Documents of which nothing is taken go. Equal rows without doc_id all take what the largest share among them is."""
    rows = _marked(docs)
    taken = mix(rows, carry=(MARK,)).filter("taken > 0").groupBy("doc_id", MARK, "size").agg(F.max("taken").alias("taken"))
    taken = stage(taken, "taken")
    rounds = taken.select("doc_id", MARK, "size", F.explode(F.expr("sequence(0, (taken - 1) div size)")).alias("_round"), "taken")
    words = rounds.select("doc_id", MARK, "size", F.least(F.col("size"), F.col("taken") - F.col("_round") * F.col("size")).alias("_words"))
    # The first words of a text with the white space before each of them.
    pieces = F.regexp_extract_all("text", F.lit(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+"), F.lit(0))
    cut = F.array_join(F.slice(pieces, F.lit(1), F.col("_words").cast("int")), "")
    text = F.when(F.col("_words") < F.col("size"), cut).otherwise(F.col("text"))
    mixed = rows.join(*_same_row(words)).withColumn("text", text).withColumn("n_chars", F.length("text").cast("long"))
    return mixed.select(*COLUMNS)


def encode_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and the ids of every row of the mix, repeated ones and those without
    doc_id too; a null text has no tokens."""
    return encode(docs, public_tokenizers.path("word_bpe_49k.json"), keep_ids=True)


Stage = Callable[[SparkSession, DataFrame, str], DataFrame]
STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("personal_data", mask_personal_data),
    ("mixing", mix_sources),
    ("encoding", encode_texts),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, function in STAGES:
        docs = stage(function(spark, docs, sf_dir), name)
    return docs
