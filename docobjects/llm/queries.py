"""The queries of this subpackage: thin contracts over the operators, with production parameters and whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .alignment import align_tokenizers
from .contamination import contaminated
from .embeddings import near_duplicate_vectors
from .filters import audit_filters
from .jaccard import jaccard_components
from .licenses import scan_licenses
from .lm import score_corpus
from .mixing import mixed_sizes
from .oracles import OP3, OP4, OP5, OP6, OP11, OP13
from .quality import score_quality
from .sharding import shard_by_bytes
from .substrings import remove_repeats
from .topk import nearest_vectors
from .toxicity import score_toxicity


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"), n_shards=24)


def op2_deleted_interpolation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_corpus(table(spark, sf_dir, "documents"))


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_components(table(spark, sf_dir, "documents"))


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed_sizes(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_tokenizers(table(spark, sf_dir, "documents"))[0]


def op13_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_vectors(table(spark, sf_dir, "embeddings"), every=50, k=5)


QUERIES = {
    f.__name__: f
    for f in (
        op1_sharding,
        op2_deleted_interpolation,
        op3_suffix_dedup,
        op4_ngram_jaccard,
        op5_embeddings,
        op6_licenses,
        op7_mixing,
        op8_toxicity,
        op9_decontamination,
        op10_quality,
        op11_filter_audit,
        op12_tokenizer_alignment,
        op13_exact_topk,
    )
}
#: DuckDB SQL of the queries that SQL can express; the others are tested against brute force.
ORACLES = {"op3_suffix_dedup": OP3, "op4_ngram_jaccard": OP4, "op5_embeddings": OP5, "op6_licenses": OP6, "op11_filter_audit": OP11, "op13_exact_topk": OP13}
