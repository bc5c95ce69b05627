"""Counts, frequencies and term weights."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.words import STOPWORDS
from vellum.operators.skew import salted_join
from vellum.tables import load, spread

KEYWORDS = 10


def documents(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "documents").select("doc_id", "text").where(F.col("text").isNotNull())
    return spread(rows)


def words_of(docs: DataFrame) -> DataFrame:
    """(doc_id, word), a row per occurrence."""
    return docs.select("doc_id", F.explode(tx.tokens("text")).alias("word"))


def term_frequency(docs: DataFrame) -> DataFrame:
    """(doc_id, term, tf): words of at least three bytes that aren't stopwords."""
    terms = words_of(docs).where((F.octet_length("word") >= 3) & ~F.col("word").isin(STOPWORDS))
    return terms.groupBy("doc_id", F.col("word").alias("term")).agg(F.count("*").alias("tf"))


def keywords(docs: DataFrame, most: int = KEYWORDS) -> DataFrame:
    """(doc_id, rank, term, score): per document the terms of most tf x (ln((N + 1) / (df + 1)) + 1), ties by term."""
    tf = term_frequency(docs)
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    n = docs.count()
    weight = F.col("tf") * (F.log((F.lit(n) + 1) / (F.col("df") + 1)) + 1)
    scored = salted_join(tf, df, ["term"], df, "df").select("doc_id", "term", F.round(weight, 6).alias("score"))
    best = Window.partitionBy("doc_id").orderBy(F.desc("score"), "term")
    ranked = scored.withColumn("rank", F.row_number().over(best).cast("bigint"))
    return ranked.where(F.col("rank") <= most).select("doc_id", "rank", "term", "score")


def q_word_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return words_of(documents(spark, folder)).groupBy("word").agg(F.count("*").alias("n"))


def q_text_statistics(spark: SparkSession, folder: str) -> DataFrame:
    found = tx.tokens("text")
    return documents(spark, folder).select(
        "doc_id",
        F.size(found).cast("bigint").alias("n_words"),
        F.size(F.array_distinct(found)).cast("bigint").alias("n_distinct"),
        tx.char_count("text").alias("n_chars"),
        tx.sentence_count("text").alias("n_sentences"),
        tx.paragraph_count("text").alias("n_paragraphs"),
    )


def q_text_metrics(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select(
        "doc_id",
        tx.word_count("text").alias("words"),
        tx.char_count("text").alias("chars"),
        tx.space_count("text").alias("spaces"),
        tx.estimate_tokens("text").alias("token_estimate"),
    )


def q_char_frequency(spark: SparkSession, folder: str) -> DataFrame:
    chars = documents(spark, folder).select(F.explode(F.split("text", "")).alias("ch"))
    return chars.where("ch <> ''").groupBy("ch").agg(F.count("*").alias("n"))


#: Context windows, in tokens, that a document is measured against.
WINDOWS = [("small", 8_000), ("medium", 32_000), ("large", 200_000)]


def q_count_tokens(spark: SparkSession, folder: str) -> DataFrame:
    windows = F.array(*[F.struct(F.lit(m).alias("model"), F.lit(c).alias("context")) for m, c in WINDOWS])
    used = documents(spark, folder).select("doc_id", tx.estimate_tokens("text").alias("token_estimate"))
    return used.withColumn("w", F.explode(windows)).select(
        "doc_id", "w.model", "token_estimate", (F.col("token_estimate") <= F.col("w.context")).alias("fits")
    )


def q_corpus_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Word counts per document and word, per word, and in total; null means all."""
    words = words_of(documents(spark, folder)).where(~F.col("word").isin(STOPWORDS))
    fine = words.groupBy("doc_id", "word").agg(F.count("*").alias("c"))
    per_word = fine.groupBy("word").agg(F.sum("c").alias("n"), F.count("*").alias("n_documents"))
    total = fine.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.countDistinct("doc_id").alias("n_documents"))
    all_ = total.select(F.lit(None).cast("string").alias("word"), "n", "n_documents")
    return per_word.unionByName(all_)


def q_term_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency(documents(spark, folder))


def q_document_frequency(spark: SparkSession, folder: str) -> DataFrame:
    return term_frequency(documents(spark, folder)).groupBy("term").agg(F.count("*").alias("df"))


def q_keywords(spark: SparkSession, folder: str) -> DataFrame:
    return keywords(documents(spark, folder))


def summary(docs: DataFrame, most: int = 3) -> DataFrame:
    """(doc_id, pos, sentence): the sentences of densest terms, discounted by place, in their order."""
    cut = docs.select("doc_id", F.posexplode(tx.sentences("text")).alias("pos", "sentence"))
    cut = cut.withColumn("words", tx.tokens("sentence"))
    tf = term_frequency(docs)
    scores = (
        cut.select("doc_id", "pos", F.size("words").alias("n"), F.explode("words").alias("term"))
        .join(tf, ["doc_id", "term"])
        .groupBy("doc_id", "pos")
        .agg((F.sum("tf") / F.max("n") / (1 + 0.1 * F.col("pos"))).alias("score"))
    )
    best = Window.partitionBy("doc_id").orderBy(F.desc(F.round("score", 9)), "pos")
    kept = scores.withColumn("r", F.row_number().over(best)).where(F.col("r") <= most).select("doc_id", "pos")
    return cut.join(kept, ["doc_id", "pos"]).select("doc_id", F.col("pos").cast("bigint").alias("pos"), "sentence")


def q_summarize(spark: SparkSession, folder: str) -> DataFrame:
    return summary(documents(spark, folder))


_TOK = r"list_filter(list_transform(regexp_split_to_array(text, '[^\p{L}\p{N}''-]+'), lambda t: lower(trim(t, '''-'))), lambda t: t <> '')"
_DOCS = "(SELECT doc_id, text FROM documents WHERE text IS NOT NULL)"
_STOP = "(" + ", ".join(f"'{w}'" for w in STOPWORDS) + ")"
_SPACE = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"
_SOME = r"[^\t-\r \x{85}\x{a0}\x{3000}]"
_TF = (
    f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM {_DOCS}) "
    f"WHERE octet_length(encode(term)) >= 3 AND term NOT IN {_STOP} GROUP BY ALL)"
)
_WORDS = f"(SELECT doc_id, unnest({_TOK}) AS word FROM {_DOCS})"

QUERIES = {
    "word_frequency": q_word_frequency,
    "text_statistics": q_text_statistics,
    "text_metrics": q_text_metrics,
    "char_frequency": q_char_frequency,
    "count_tokens": q_count_tokens,
    "corpus_statistics": q_corpus_statistics,
    "term_frequency": q_term_frequency,
    "document_frequency": q_document_frequency,
    "keywords_tfidf": q_keywords,
    "summarize_document": q_summarize,
}
SQL = {
    "word_frequency": f"SELECT word, count(*) AS n FROM {_WORDS} GROUP BY word",
    "text_statistics": f"""SELECT doc_id, len(w)::BIGINT AS n_words, len(list_distinct(w))::BIGINT AS n_distinct, length(text)::BIGINT AS n_chars,
  greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_matches(s, '{_SOME}'))))::BIGINT AS n_sentences,
  greatest(1, len(list_filter(string_split(text, chr(10) || chr(10)), lambda s: regexp_matches(s, '{_SOME}'))))::BIGINT AS n_paragraphs
  FROM (SELECT doc_id, text, {_TOK} AS w FROM {_DOCS})""",
    "text_metrics": f"""SELECT doc_id, n AS words, length(text)::BIGINT AS chars, (length(text) - length(replace(text, ' ', '')))::BIGINT AS spaces,
  ceil(n * 1.3::DOUBLE)::BIGINT AS token_estimate FROM (SELECT doc_id, text, len(regexp_extract_all(text, '{_SPACE}'))::BIGINT AS n FROM {_DOCS})""",
    "char_frequency": f"SELECT ch, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '(?s).')) AS ch FROM {_DOCS}) GROUP BY ch",
    "count_tokens": f"""SELECT doc_id, model, t AS token_estimate, t <= context AS fits FROM
  (SELECT doc_id, ceil(len(regexp_extract_all(text, '{_SPACE}')) * 1.3::DOUBLE)::BIGINT AS t FROM {_DOCS}),
  (VALUES {", ".join(f"('{m}', {c})" for m, c in WINDOWS)}) v(model, context)""",
    "corpus_statistics": f"""SELECT word, count(*) AS n, count(DISTINCT doc_id) AS n_documents FROM {_WORDS} WHERE word NOT IN {_STOP}
  GROUP BY GROUPING SETS ((word), ())""",
    "term_frequency": f"SELECT doc_id, term, tf FROM {_TF}",
    "document_frequency": f"SELECT term, count(*) AS df FROM {_TF} GROUP BY term",
    "keywords_tfidf": f"""WITH tf AS {_TF}, df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), n AS (SELECT count(*) AS n FROM {_DOCS}),
  s AS (SELECT doc_id, term, round(tf * (ln((n + 1)::DOUBLE / (df + 1)) + 1), 6) AS score FROM tf JOIN df USING (term), n)
  SELECT doc_id, rank, term, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, term) AS rank FROM s) WHERE rank <= {KEYWORDS}""",
    "summarize_document": f"""WITH tf AS {_TF},
  cut AS (SELECT doc_id, unnest(list_filter(list_transform(regexp_extract_all(replace(text, chr(10), ' '), '[^.!?]*[.!?]|[^.!?]+$'), lambda s: trim(s)),
    lambda s: octet_length(encode(s)) > 1)) AS text, generate_subscripts(list_filter(list_transform(regexp_extract_all(replace(text, chr(10), ' '),
    '[^.!?]*[.!?]|[^.!?]+$'), lambda s: trim(s)), lambda s: octet_length(encode(s)) > 1), 1) - 1 AS pos FROM {_DOCS}),
  w AS (SELECT doc_id, pos, text, {_TOK} AS w FROM cut),
  s AS (SELECT doc_id, pos, sum(tf) / max(n) / (1 + 0.1 * pos) AS score FROM (SELECT doc_id, pos, len(w)::DOUBLE AS n, unnest(w) AS term FROM w)
    JOIN tf USING (doc_id, term) GROUP BY doc_id, pos)
  SELECT doc_id, pos::BIGINT AS pos, text AS sentence FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY doc_id ORDER BY round(score, 9) DESC, pos) AS r FROM s)
  JOIN cut USING (doc_id, pos) WHERE r <= 3""",
}
