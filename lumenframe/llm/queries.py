"""Queries of the training-data operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lumenframe.llm.bpe import bpe_encode, bpe_round_trip
from lumenframe.llm.collocations import collocations
from lumenframe.llm.exact_dedup import exact_dedup
from lumenframe.llm.kneser_ney import quality_by_perplexity
from lumenframe.llm.lattice import lattice_scores
from lumenframe.llm.near_dedup import near_groups
from lumenframe.llm.packing import pack_documents
from lumenframe.llm.pii import personal_spans
from lumenframe.llm.quality_rules import quality_rules
from lumenframe.llm.sharding import shard_documents
from lumenframe.llm.sstable import token_shards
from lumenframe.llm.sql import ORACLE_SQL
from lumenframe.llm.vector_codes import compress_vectors
from lumenframe.llm.word_bpe import word_bpe_encode, word_bpe_round_trip

Query = Callable[[SparkSession, str], DataFrame]


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_minhash_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The near-duplicate group of every document, over 4-word shingles at 0.8."""
    return near_groups(_docs(spark, sf_dir), width=4)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the run that holds it after two arrivals and their compactions."""
    table = shard_documents(_docs(spark, sf_dir))
    runs = table.runs().select("run", "tier", "n_rows", "n_bytes")
    return table.rows().select("doc_id", F.col("_run").alias("run"), F.octet_length("text").cast("long").alias("bytes")).join(runs, "run")


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every piece of every document with the bin that best fit puts it in."""
    return pack_documents(_docs(spark, sf_dir))


def op4_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and verdict of the threshold table for every document."""
    return quality_rules(_docs(spark, sf_dir))


def op5_sstable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token ids written to sorted-string tables and read back."""
    return token_shards(_docs(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"), end_id=2).drop("shard")


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The row that stays for every document, by a heavy-hitter split of digests."""
    return exact_dedup(_docs(spark, sf_dir))


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by the transducer and decoded as a stream."""
    ranks = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return bpe_round_trip(bpe_encode(_docs(spark, sf_dir), ranks, public_tokenizers.PATTERN), ranks)


def op8_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's perplexity under a model of trusted text, and its language's threshold."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    return quality_by_perplexity(_docs(spark, sf_dir), labels, is_table=True)


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data of every document: base counts and digest, and all spans."""
    return personal_spans(_docs(spark, sf_dir))


def op10_lattice(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's marginal probability over all segmentations, and its add-one base."""
    return lattice_scores(_docs(spark, sf_dir), public_tokenizers.path("piece_bpe_32k.model"), is_table=True)


def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best phrases of each language, by level-wise passes."""
    return collocations(_docs(spark, sf_dir))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every vector's code and error under codebooks trained on all vectors."""
    return compress_vectors(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op13_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded by tree concatenation over words with end marks, and decoded."""
    path = public_tokenizers.path("word_bpe_49k.json")
    return word_bpe_round_trip(word_bpe_encode(_docs(spark, sf_dir), path), path)


QUERIES: dict[str, Query] = {
    "op1_minhash_forest": op1_minhash_forest,
    "op2_sharding": op2_sharding,
    "op3_packing": op3_packing,
    "op4_quality_rules": op4_quality_rules,
    "op5_sstable": op5_sstable,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_bpe": op7_bpe,
    "op8_kneser_ney": op8_kneser_ney,
    "op9_pii": op9_pii,
    "op10_lattice": op10_lattice,
    "op11_collocations": op11_collocations,
    "op12_vector_codes": op12_vector_codes,
    "op13_tree_bpe": op13_tree_bpe,
}


def llm_queries() -> dict[str, Query]:
    return dict(QUERIES)


def llm_oracles() -> dict[str, str]:
    return {k: v for k, v in ORACLE_SQL.items() if k in QUERIES}
