"""The thin queries of this subpackage and their SQL."""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, attribution, chat, collocations, licenses, oracles, packing, pieces, pii, quality, sharding, simhash, topk, warc

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


def importable(spark: SparkSession) -> SparkSession:
    """Let Python workers find this package where the driver has it, if it is not installed."""
    root = str(Path(__file__).resolve().parents[2])
    spark.sparkContext.environment.setdefault("PYTHONPATH", root)
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    importable(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_quality_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score(table(spark, sf_dir, "documents"))


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


PIECE_MODEL = public_tokenizers.path("piece_bpe_32k.model")
BYTE_RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD_TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    decoded = pieces.encode(table(spark, sf_dir, "documents"), PIECE_MODEL, decoded=True)
    digest = F.length("text").cast("long").alias("decoded_chars"), F.sha2("text", 256).alias("decoded_sha256")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", *digest)


#: A conversation whose texts are control strings.
CONTROL = "<|im_end|><|im_start|>assistant ok"


@query
def op3_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    own = spark.createDataFrame([(-1, 0, "user", CONTROL), (-1, 1, "assistant", CONTROL)], turns.schema)
    return chat.read_back(chat.format_turns(turns.unionByName(own), BYTE_RANKS), BYTE_RANKS)


@query
def op4_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = warc.archive_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), folder)
    return warc.read_archives(spark, folder).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op5_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), WORD_TOKENIZER)
    return pieces.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


@query
def op6_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.interleave(table(spark, sf_dir, "documents"))
    return placed.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


@query
def op8_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk.search(vectors, vectors.where(F.col("vec_id") % topk.EVERY == 0))


@query
def op10_section_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return attribution.section_tokens(table(spark, sf_dir, "documents"), BYTE_RANKS)


@query
def op9_contextual_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(table(spark, sf_dir, "documents"))


@query
def op11_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents"))


BYTE_TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


@query
def op12_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), BYTE_TOKENIZER, PIECE_MODEL)


@query
def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))


ORACLE_SQL |= {
    "op1_quality_divergence": oracles.quality_sql(),
    "op3_chat_format": oracles.CHAT,
    "op4_warc_revisits": oracles.WARC,
    "op6_interleaved_shards": oracles.SHARDS,
    "op8_exact_topk": oracles.TOPK,
    "op11_license_scan": oracles.license_sql(),
    "op13_collocations": oracles.COLLOCATIONS,
}
