"""A training corpus from raw documents: accept by language, clean, deduplicate, mix, encode.

Each stage is one operator of ``quarry.llm`` and takes all that the stage before it
kept. Its result is written as Parquet in the shared folder and read back, so that
a lost executor costs the stage it works on and nothing before it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.llm import bpe, langid, line_dedup, mixing, simhash
from quarry.llm.storage import Table, scope


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop the documents of which no language has a clear share of the words, those without a word (null and empty texts) among them.

    All other rows and all columns stay as they are; repeated rows go or stay together.
    """
    return langid.accept(docs)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop each site's boilerplate lines; ``n_chars`` follows the text, null for a null one. Every row stays, if with an empty text; a null source is no site."""
    return line_dedup.line_dedup(docs).withColumn("n_chars", F.length("text").cast("bigint")).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, that of the least id, of each group of near duplicates; empty texts are duplicates of each other. Rows without an id or a text stay."""
    return simhash.near_dedup(docs)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Draw documents so that the sources meet their shares of the tokens; one that is drawn in several epochs is there as often. A null source is one of its own."""
    return mixing.mix(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, lang, source, n_tokens, tokens, round_trip) of the whole texts, null for a null one; one row a row."""
    return bpe.bpe_encode(docs, keep=("doc_id", "lang", "source"))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language", language),
    ("lines", lines),
    ("near_duplicates", near_duplicates),
    ("mixture", mixture),
    ("encode", encode),
]

#: The first stage, a fitted random field, can't be expressed in SQL; ``tests/llm/test_pipeline.py`` holds run() against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the whole of ``documents``; between stages there is a written table, and what a stage made on the way, like its input, goes once that is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES[:-1]:
        with scope("stage-"):
            now = Table(stage(spark, docs, sf_dir), f"stage-{name}", after=[before] if before else [])
        docs, before = now.df, now
    return STAGES[-1][1](spark, docs, sf_dir)
