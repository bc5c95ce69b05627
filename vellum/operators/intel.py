"""Readability, language and kind of content."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.words import CATEGORY_SIGNALS, LANGUAGE_MARKERS
from vellum.operators.textstats import _DOCS, _TOK, documents


def _sum(array: Column, f) -> Column:
    return F.aggregate(array, F.lit(0).cast("bigint"), lambda s, x: s + f(x))


def readability(docs: DataFrame) -> DataFrame:
    """Counts, Flesch reading ease and Flesch-Kincaid grade; a text without words counts as one word."""
    rows = docs.select(
        "doc_id", tx.tokens("text").alias("w"), tx.sentence_count("text").alias("n_sentences")
    ).select("doc_id", "n_sentences", F.size("w").cast("bigint").alias("n_words"), _sum(F.col("w"), tx.syllables).alias("n_syllables"))
    words = F.greatest(F.col("n_words"), F.lit(1))
    wps, spw = words / F.col("n_sentences"), F.col("n_syllables") / words
    ease = F.round(206.835 - 1.015 * wps - 84.6 * spw, 4)
    return rows.select(
        "doc_id", "n_words", "n_sentences", "n_syllables",
        ease.alias("reading_ease"),
        F.round(0.39 * wps + 11.8 * spw - 15.59, 4).alias("grade"),
        band(ease).alias("interpretation"),
    )


# Least reading ease of each band.
BANDS = [
    (90, "Very easy (5th grade)"), (80, "Easy (6th grade)"), (70, "Fairly easy (7th grade)"), (60, "Standard (8th-9th grade)"),
    (50, "Fairly difficult (10th-12th grade)"), (30, "Difficult (college)"),
]
LAST_BAND = "Very difficult (graduate)"


def band(ease: Column) -> Column:
    whole = ease.cast("bigint")
    out = F.lit(LAST_BAND)
    for least, name in reversed(BANDS):
        out = F.when(whole >= least, name).otherwise(out)
    return out


def _signals(words: dict[str, list[str]], spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(k, w, len(ws)) for k, ws in words.items() for w in ws], "label string, word string, of int")


def _words(docs: DataFrame) -> DataFrame:
    """(doc_id, n, word); the array is made below the explode, so that its size is not worked out again for every word."""
    return docs.select("doc_id", tx.tokens("text").alias("w")).select("doc_id", F.size("w").alias("n"), F.explode("w").alias("word"))


def language_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, language, confidence): 0.7 x share of marker words + 0.3 x share of the language's markers that occur."""
    markers = F.broadcast(_signals(LANGUAGE_MARKERS, docs.sparkSession))
    words = _words(docs)
    hits = words.join(markers, "word").groupBy("doc_id", F.col("label").alias("language"))
    share = 0.7 * F.count("*") / F.max("n") + 0.3 * F.countDistinct("word") / F.max("of")
    return hits.agg(F.round(share, 6).alias("confidence"))


def category_scores(docs: DataFrame) -> DataFrame:
    """(doc_id, category, score): signal words per hundred words; categories without any have no row."""
    signals = F.broadcast(_signals(CATEGORY_SIGNALS, docs.sparkSession))
    words = _words(docs)
    hits = words.join(signals, "word").groupBy("doc_id", F.col("label").alias("category"))
    return hits.agg(F.round(100.0 * F.count("*") / F.max("n"), 6).alias("score"))


def q_readability(spark: SparkSession, folder: str) -> DataFrame:
    return readability(documents(spark, folder))


def q_detect_language(spark: SparkSession, folder: str) -> DataFrame:
    scores = language_scores(documents(spark, folder))
    best = scores.groupBy("doc_id").agg(F.min(F.struct((-F.col("confidence")).alias("c"), "language")).alias("best"))
    return best.select("doc_id", (-F.col("best.c")).alias("confidence"), "best.language")


def q_language_scores(spark: SparkSession, folder: str) -> DataFrame:
    return language_scores(documents(spark, folder))


def q_classify(spark: SparkSession, folder: str) -> DataFrame:
    return category_scores(documents(spark, folder))


def _values(words: dict[str, list[str]]) -> str:
    return ", ".join(f"('{k}', '{w}', {len(ws)})" for k, ws in words.items() for w in ws)


_HITS = "SELECT doc_id, label, round({}, 6) AS s FROM (SELECT doc_id, len(w) AS n, unnest(w) AS word FROM (SELECT doc_id, {} AS w FROM {})) JOIN (VALUES {}) v(label, word, of) USING (word) GROUP BY doc_id, label"
_LANG = _HITS.format("0.7::DOUBLE * count(*) / max(n) + 0.3::DOUBLE * count(DISTINCT word) / max(of)", _TOK, _DOCS, _values(LANGUAGE_MARKERS))
_CATS = _HITS.format("100.0::DOUBLE * count(*) / max(n)", _TOK, _DOCS, _values(CATEGORY_SIGNALS))
_L = r"regexp_replace(x, '[^\p{L}]', '', 'g')"
_SYL = (
    f"CASE WHEN {_L} = '' THEN 0 ELSE greatest(1, len(regexp_extract_all({_L}, '[aeiouy]+')) - "
    f"CASE WHEN length({_L}) > 2 AND regexp_matches({_L}, '[^aeiouyl]e$') THEN 1 ELSE 0 END) END"
)
_BANDS = " ".join(f"WHEN trunc(reading_ease) >= {n} THEN '{b}'" for n, b in BANDS)

QUERIES = {
    "readability": q_readability,
    "detect_language": q_detect_language,
    "language_scores": q_language_scores,
    "classify_document": q_classify,
}
SQL = {
    "readability": rf"""SELECT doc_id, n_words, n_sentences, n_syllables, reading_ease, grade, CASE {_BANDS} ELSE '{LAST_BAND}' END AS interpretation FROM (
  SELECT doc_id, n_words, n_sentences, n_syllables,
  round(206.835::DOUBLE - 1.015::DOUBLE * (greatest(n_words, 1) / n_sentences::DOUBLE) - 84.6::DOUBLE * (n_syllables::DOUBLE / greatest(n_words, 1)), 4) AS reading_ease,
  round(0.39::DOUBLE * (greatest(n_words, 1) / n_sentences::DOUBLE) + 11.8::DOUBLE * (n_syllables::DOUBLE / greatest(n_words, 1)) - 15.59::DOUBLE, 4) AS grade
  FROM (SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: {_SYL})), 0)::BIGINT AS n_syllables,
    greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_matches(s, '[^\t-\r \x{{85}}\x{{a0}}\x{{3000}}]'))))::BIGINT AS n_sentences
    FROM (SELECT doc_id, text, {_TOK} AS w FROM {_DOCS})))""",
    "language_scores": f"SELECT doc_id, label AS language, s AS confidence FROM ({_LANG})",
    "detect_language": f"SELECT doc_id, min(label) AS language, s AS confidence FROM ({_LANG}) x WHERE s = (SELECT max(s) FROM ({_LANG}) y WHERE y.doc_id = x.doc_id) GROUP BY doc_id, s",
    "classify_document": f"SELECT doc_id, label AS category, s AS score FROM ({_CATS})",
}
