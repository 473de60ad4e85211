"""The operators as queries over whole tables, in the shape their contracts ask for."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import audit
from .bpe import encode
from .graph_index import nearest
from .language import identify
from .media import media_columns
from .minhash import near_duplicates
from .mixing import mix
from .packing import pack
from .pii import find
from .suffix import remove_repeats
from .toxicity import score
from .warc import archive_pages
from .whitening import whiten


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_graph_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), every=50, top=5)


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"))


def op3_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(_documents(spark, sf_dir))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(_documents(spark, sf_dir), weights=(5.0, 2.0, 1.0), share=1.5, most=2).drop("source")


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(_documents(spark, sf_dir), shingle=4, percent=80).drop("group_key")


def op6_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(_documents(spark, sf_dir), length=100)


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media_columns(_documents(spark, sf_dir))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"), least=0)


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(_documents(spark, sf_dir))


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(_documents(spark, sf_dir), public_tokenizers.path("word_bpe_49k.json"), capacity=2048)


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), scale=256.0, keep=4)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_graph_index,
        op2_bpe,
        op3_pii,
        op4_mixing,
        op5_minhash,
        op6_suffix_array,
        op7_media,
        op8_toxicity,
        op9_warc,
        op10_language,
        op11_packing,
        op12_whitening,
        op13_filter_audit,
    )
}
#: Whole pages hashed and grouped are plain SQL, base 32 included: five bits of the hash at a time; so are the counts of
#: the filter audit. What the other operators do is no SQL (trained models, a tokenizer, stored media) or too slow in it on whole tables (similarity joins,
#: repeated strings, a line of all words); they are tested against brute force, an exact round trip or held-out rows.
ORACLE_SQL: dict[str, str] = {
    "op13_filter_audit": audit.ORACLE_SQL,
    "op9_warc": """
WITH h AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha1(coalesce(html, '')) || '00' AS x FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY x) AS first FROM h)
SELECT page_id, payload_bytes,
 array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((CAST('0x' || substr(x, 1 + 5 * i // 4, 3) AS BIGINT) >> (7 - 5 * i % 4)) & 31), 1)), '') AS payload_digest,
 CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM f"""
}
