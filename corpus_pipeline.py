"""The corpus pipeline: from raw documents to token files, a stage at a time.

STAGES lists (name, function). A function takes (spark, docs, sf_dir), where docs has the columns of
`documents`, and returns a DataFrame that is written and read again as the next one's docs. All but the last
return the columns of `documents`. SQL cannot express compression, edit distances or a tokenizer, so
ORACLE_SQL is None; tests hold each stage against a brute-force version.

Edge cases, beside those of the operators: extra columns of docs are carried along until the last stage.
Rows with a null id pass the join, and a null text is rejected by language ID.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language, mixing, ngram_join, token_files
from millrace.llm.common import table
from millrace.llm.queries import tokenizer_file
from millrace.session import prepare, settle


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is clear; lang becomes the predicted one."""
    told = language.classify(docs, language.dictionaries(table(spark, sf_dir, "documents")))
    kept = told.where("accepted")
    return kept.select(*(F.col("lang_pred").alias("lang") if c == "lang" else F.col(f"`{c}`") for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one of smallest id. Near copies share four fifths of their
    shingles of five words; op4 has a rule of its own."""
    table(spark, sf_dir, "documents")  # settings
    return ngram_join.keep_one(docs, width=5, num=80, den=100).select(docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no passage of the benchmark."""
    return decontaminate.clean(docs, table(spark, sf_dir, "benchmark"))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each pass of the mix over a document."""
    table(spark, sf_dir, "documents")  # settings
    return mixing.mixed_documents(docs).select(docs.columns)


def write_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, read back from the token files."""
    table(spark, sf_dir, "documents")  # settings
    return token_files.digest(docs, tokenizer_file())


STAGES = [("language ID", identify_language), ("n-gram Jaccard join", drop_near_copies),
          ("benchmark decontamination", drop_leaks), ("mixing sources to target weights", mix_sources),
          ("token-ID / binary output", write_tokens)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(prepare(spark), sf_dir, "documents")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name.split()[0].lower())
    return docs
