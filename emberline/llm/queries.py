"""Driver queries of the corpus operators, over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontaminate, html_extract, line_dedup, near_dedup, ngram_lm, packing, periodic_runs, quality, sharding, spelling_variants, toxicity, url_filter, vector_search


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_gated_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digest(line_dedup.dedup_lines(_table(spark, sf_dir, "documents").select("doc_id", "text")))


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.digest(_table(spark, sf_dir, "pages"))


def op4_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.digest(decontaminate.contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark")))


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(_table(spark, sf_dir, "documents"), tokenizer_path())


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.digest(_table(spark, sf_dir, "pages"), _table(spark, sf_dir, "labels"))


def op7_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(_table(spark, sf_dir, "documents"), shingle=2)


def op8_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vector_search.top_k(vectors, F.col("vec_id") % 50 == 0)


def op9_kneser_ney_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_lm.digest(_table(spark, sf_dir, "documents"), order=3)


def op10_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.digest(_table(spark, sf_dir, "documents"))


def op11_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.digest(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.digest(_table(spark, sf_dir, "documents"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_variants.digest(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_gated_toxicity, op2_line_dedup, op3_html_extraction, op4_benchmark_decontamination, op5_best_fit_packing, op6_url_filter, op7_minhash_near_dedup, op8_exact_top_k, op9_kneser_ney_scores, op10_interleaved_shards, op11_quality_classifier, op12_periodic_runs, op13_spelling_variants)}
ORACLE_SQL = {"op2_line_dedup": line_dedup.SQL, "op4_benchmark_decontamination": decontaminate.SQL, "op6_url_filter": url_filter.SQL, "op7_minhash_near_dedup": near_dedup.sql(2), "op8_exact_top_k": vector_search.SQL, "op10_interleaved_shards": sharding.SQL, "op13_spelling_variants": spelling_variants.SQL}
