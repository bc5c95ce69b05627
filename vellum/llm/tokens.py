"""Token totals per source, language and topic, and stored counts that are wrong (problem 7).

Method: exact counts by the automaton of :mod:`vellum.llm.bpe` in an Arrow UDF, once per row, then one
aggregate over the cleaned labels and a cube over its few rows, so the cube never expands the corpus.

Null text has no count and adds nothing; empty text counts 0. Repeated rows of a chunk count once.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.bpe import TOKENIZER_DIR, VOCABULARY, counter
from vellum.tables import load, spread

FAR = 2.5

# Spellings of language codes that the tables hold besides two-letter ones (ISO 639-2).
LONG_CODES = {
    "eng": "en", "ger": "de", "deu": "de", "fre": "fr", "fra": "fr", "spa": "es", "jpn": "ja",
}


def token_count(text: Column, folder: str = TOKENIZER_DIR, vocabulary: str = VOCABULARY) -> Column:
    """Exact number of byte-pair tokens, as bigint."""

    @F.pandas_udf("bigint")
    def count(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        one = counter(folder, vocabulary)
        for texts in batches:
            yield pd.Series([one.count(t) for t in texts], dtype="Int64")

    return count(text)


def clean_language(lang: Column) -> Column:
    """``en`` for ``EN``, ``en-US``, ``eng`` and the like; ``und`` for null and blank."""
    code = F.regexp_extract(F.lower(F.trim(lang)), r"^([a-z]+)", 1)
    for long, short in LONG_CODES.items():  # each names the code once, so the expression grows with the list only
        code = F.regexp_replace(code, f"^{long}$", short)
    return F.coalesce(F.nullif(code, F.lit("")), F.lit("und"))


def clean_label(label: Column) -> Column:
    """Lower case, ends trimmed, ``_`` and white space as ``-``; ``unknown`` for null and blank."""
    name = F.regexp_replace(F.lower(F.trim(label)), r"[_\s]+", "-")
    return F.coalesce(F.nullif(name, F.lit("")), F.lit("unknown"))


def document_tokens(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", token_count(F.col("text")).alias("n_tokens"))


def token_cube(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """Rows and tokens for every combination of table, source, language and topic; null means all."""
    of_documents = documents.select(
        F.lit("documents").alias("tbl"),
        clean_label(F.col("source")).alias("source"),
        clean_language(F.col("lang")).alias("lang"),
        clean_label(F.col("topic")).alias("topic"),
        token_count(F.col("text")).alias("n_tokens"),
    )
    of_chunks = (
        chunks.select("chunk_id", "source", "lang", token_count(F.col("text")).alias("n_tokens"))
        .dropDuplicates(["chunk_id"])
        .select(
            F.lit("chunks").alias("tbl"),
            F.coalesce(F.trim("source"), F.lit("unknown")).alias("source"),
            clean_language(F.col("lang")).alias("lang"),
            F.lit("unknown").alias("topic"),
            "n_tokens",
        )
    )
    fine = (
        of_documents.unionByName(of_chunks)
        .groupBy("tbl", "source", "lang", "topic")
        .agg(F.count("*").alias("n"), F.sum("n_tokens").alias("t"))
    )
    return fine.cube("tbl", "source", "lang", "topic").agg(
        F.grouping_id().cast("bigint").alias("level"),
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum("t"), F.lit(0)).cast("bigint").alias("n_tokens"),
    )


def wrong_counts(metrics: DataFrame, documents: DataFrame, far: float = FAR) -> DataFrame:
    """(doc_id, tokens, n_tokens) of stored counts that can't be right."""
    stored = metrics.where(F.col("tokens").isNotNull()).select("doc_id", "tokens").distinct()
    n, t = F.col("n_tokens"), F.col("tokens")
    return (
        stored.join(document_tokens(documents), "doc_id", "left")
        .where((t <= 0) | (t > far * n) | (t * far < n))
        .select("doc_id", "tokens", "n_tokens")
    )


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = wrong_counts(load(spark, folder, "doc_metrics"), spread(load(spark, folder, "documents")))
    return rows.select("doc_id").distinct()


def p7_totals(spark: SparkSession, folder: str) -> DataFrame:
    return token_cube(spread(load(spark, folder, "documents")), spread(load(spark, folder, "chunks")))


QUERIES = {"p7_found": p7_found, "p7_totals": p7_totals}
SQL: dict[str, str] = {}
