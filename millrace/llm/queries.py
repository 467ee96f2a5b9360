"""The registered queries of this subpackage and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import (align, decontaminate, html_main, language, licenses, mixing, ngram_join, oracles, phrases,
                          quality, token_files, topk, url_rules, whitening)
from millrace.llm.common import held_out, table
from millrace.session import prepare


def tokenizer_file(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


def op1_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(prepare(spark), sf_dir, "documents"), licenses.templates(spark))


def op2_html_main_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(prepare(spark), sf_dir, "pages")
    return html_main.extract(pages, html_main.fit(pages))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(table(prepare(spark), sf_dir, "documents"))


def op5_source_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.taken_words(table(prepare(spark), sf_dir, "documents"))


def op6_repeated_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.dedup(table(prepare(spark), sf_dir, "documents"))


def op7_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = topk.quantized(table(prepare(spark), sf_dir, "embeddings"))
    asked = vectors.where("vec_id % 100 = 0").withColumnRenamed("vec_id", "query_id")
    return topk.search(vectors, asked)


def op8_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.digest(table(prepare(spark), sf_dir, "documents"), tokenizer_file())


def op9_benchmark_leaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(table(prepare(spark), sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    told = language.classify(docs.select("doc_id", "text"), language.dictionaries(docs))
    return told.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "accepted")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.align(table(prepare(spark), sf_dir, "documents"), tokenizer_file(),
                       tokenizer_file("piece_bpe_32k.model"))


def op12_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_rules.judge(table(prepare(spark), sf_dir, "pages"),
                           url_rules.rules(spark, url_rules.SITE_RULES, url_rules.PATTERNS))


def op13_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(prepare(spark), sf_dir, "embeddings"))


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline
    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    """Every query by its name."""
    own = [op1_license_scan, op2_html_main_text, op3_quality_rules, op4_ngram_join, op5_source_mix,
           op6_repeated_phrases, op7_exact_top_k, op8_token_files, op9_benchmark_leaks, op10_language_id,
           op11_token_alignment, op12_url_filter, op13_embedding_whitening, pipeline]
    return {f.__name__: f for f in own}


def oracle_sql() -> dict[str, str]:
    return oracles.oracle_sql()
