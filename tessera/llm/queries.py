"""The operators applied, with production parameters, to the standard tables."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import oracle
from tessera.llm.chat import chat_format
from tessera.llm.common import shared_dir
from tessera.llm.decontaminate import contamination
from tessera.llm.fill_middle import fill_in_middle, restored
from tessera.llm.near_dedup import near_duplicates
from tessera.llm.pieces import encode
from tessera.llm.quality import quality
from tessera.llm.resampling import resample
from tessera.llm.secrets import KINDS, secret_spans, written
from tessera.llm.substring import remove_repeats
from tessera.llm.top_k import top_k
from tessera.llm.toxicity import toxicity
from tessera.llm.training_order import domain, read_training_order, write_training_order
from tessera.llm.warc import read_warc, write_warc

Query = Callable[[SparkSession, str], DataFrame]

#: Where tokenizer files lie; they are never copied.
TOKENIZERS = os.environ.get("TOKENIZER_DIR", "/opt/tokenizers")
PIECE_MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_dir(spark)
    write_warc(table(spark, sf_dir, "pages"), folder)
    return read_warc(spark, folder, blocks=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % 100 == 0), k=10, scale=1024)


def op3_training_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, folder = table(spark, sf_dir, "documents"), shared_dir(spark)
    at = domain(docs, F.octet_length("text") + 3)
    write_training_order(encode(docs, PIECE_MODEL), folder, key="epoch-0", at=at)
    return read_training_order(spark, folder).withColumn("tokens", F.sha2("tokens", 256)).withColumnRenamed("tokens", "tokens_sha256")


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format(table(spark, sf_dir, "conversations"))


def op5_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), threshold=85, k=5)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)
    sha = F.sha2(F.array_join(F.array_sort("items"), ","), 256)
    return rows.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), sha.alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), PIECE_MODEL)


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.3)


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), k=13, texts=False).drop("kept")


def op10_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = secret_spans(table(spark, sf_dir, "documents"))
    counts = [F.size(F.filter(F.transform("base_spans", lambda s: s["kind"]), F.lit(kind).eqNullSafe)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return rows.select("doc_id", *counts, F.sha2(written("base_spans"), 256).alias("base_sha256"), written("spans").alias("spans"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), seed=7, share=(25, 100))


def op12_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fill_in_middle(table(spark, sf_dir, "documents"), seed=1)
    sha = lambda text: F.sha2(text.cast("binary"), 256)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", sha(F.col("output")).alias("output_sha256"), sha(restored(F.col("output"), F.col("form"))).alias("restored_sha256"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), threshold=0.7)


def queries() -> dict[str, Query]:
    found = (op1_warc, op2_exact_top_k, op3_training_order, op4_chat_format, op5_minhash_near_dedup, op6_decontaminate, op7_sentencepiece, op8_toxicity, op9_substring_dedup, op10_secret_scan, op11_importance_resampling, op12_fill_in_middle, op13_quality)
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {
        "op1_warc": oracle.WARC,
        "op2_exact_top_k": oracle.TOP_K,
        "op4_chat_format": oracle.CHAT,
        "op5_minhash_near_dedup": oracle.near_dedup(),
        "op6_decontaminate": oracle.decontaminate(),
        "op9_substring_dedup": oracle.substring_dedup(),
        "op11_importance_resampling": oracle.resampling(),
        "op12_fill_in_middle": oracle.FILL_IN_MIDDLE,
    }
