"""The queries of this package, each over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rasterloom.llm import byte_bpe, licenses, merkle, toxicity
from rasterloom.llm.ann import search
from rasterloom.llm.chunk_dedup import substring_dedup
from rasterloom.llm.html_extract import extract
from rasterloom.llm.minhash import near_duplicates
from rasterloom.llm.mixing import mix
from rasterloom.llm.packing import pack
from rasterloom.llm.pii import find_pii
from rasterloom.llm.prefix_trie import conversation_trie
from rasterloom.llm.quality import quality


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"))


def op2_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract(table(spark, sf_dir, "pages"))


def op3_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, 20)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_pii(table(spark, sf_dir, "documents"))


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.severity(docs, toxicity.train(docs, table(spark, sf_dir, "labels")))


def op9_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents have no paths; their source and language serve as directories."""
    path = F.concat_ws("/", "source", "lang", F.col("doc_id").cast("string"))
    return licenses.scan(table(spark, sf_dir, "documents"), path)


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(table(spark, sf_dir, "conversations"))


def op12_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = byte_bpe.decode(byte_bpe.encode(table(spark, sf_dir, "documents")))
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The copy that is checked lacks the line ends of every document whose id's crc32 is even."""
    touched = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    found = merkle.audited(table(spark, sf_dir, "documents"), touched, F.replace(F.col("text"), F.lit("\n"), F.lit("")))
    return found.drop("proof")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_best_fit_packing": op1_best_fit_packing,
        "op2_html_extraction": op2_html_extraction,
        "op3_nearest_neighbours": op3_nearest_neighbours,
        "op4_substring_dedup": op4_substring_dedup,
        "op5_mixing": op5_mixing,
        "op6_pii": op6_pii,
        "op7_quality_rules": op7_quality_rules,
        "op8_toxicity": op8_toxicity,
        "op9_minhash": op9_minhash,
        "op10_licenses": op10_licenses,
        "op11_prefix_trie": op11_prefix_trie,
        "op12_byte_bpe": op12_byte_bpe,
        "op13_merkle_manifest": op13_merkle_manifest,
    }
