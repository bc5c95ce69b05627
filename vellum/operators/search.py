"""Searching documents and fetching context for a query."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.textstats import _DOCS, documents

QUERY = "paper lantern"
PHRASE = "the usual"


def occurrences(text: Column, term: str) -> Column:
    """How often ``term`` occurs in lower-case ``text``, occurrences not overlapping."""
    gone = F.length(F.replace(F.lower(text), F.lit(term.lower()), F.lit("")))
    return ((F.length(text) - gone) / len(term)).cast("bigint")


def search_content(docs: DataFrame, query: str, most: int = 10) -> DataFrame:
    """(doc_id, score): documents by how often they hold the query's terms; ties by id."""
    score = sum((occurrences(F.col("text"), t) for t in query.split()), F.lit(0).cast("bigint"))
    return docs.select("doc_id", score.alias("score")).where("score > 0").orderBy(F.desc("score"), "doc_id").limit(most)


def search_files(docs: DataFrame, query: str, context: int = 150, most: int = 5) -> DataFrame:
    """(doc_id, snippet): the first documents by id that hold the query, with text around its first place."""
    at = F.instr(F.lower("text"), query.lower())
    start = F.greatest(F.lit(1), F.col("at") - context)
    return (
        docs.withColumn("at", at)
        .where("at > 0")
        .select("doc_id", F.substr("text", start, F.col("at") - start + len(query) + context).alias("snippet"))
        .orderBy("doc_id")
        .limit(most)
    )


def rank_chunks(chunks: DataFrame, query: str) -> DataFrame:
    """(chunk_id, source, chunk_index, text, token_estimate, score): 100 x share of query words + how many of them occur."""
    terms = sorted({t.strip("'-").lower() for t in query.split()} - {""})
    wanted = F.array(*map(F.lit, terms))
    words = tx.tokens("text")
    rows = chunks.where(F.col("text").isNotNull()).withColumn("w", words)
    hits = F.size(F.filter("w", lambda t: F.array_contains(wanted, t)))
    score = F.round(100.0 * hits / F.greatest(F.size("w"), F.lit(1)) + F.size(F.array_intersect("w", wanted)), 6)
    ranked = rows.select("chunk_id", "source", "chunk_index", "text", tx.estimate_tokens("text").alias("token_estimate"), score.alias("score"))
    return ranked.where("score > 0")


def retrieve_context(chunks: DataFrame, query: str, max_tokens: int = 2000, top_k: int = 8) -> DataFrame:
    """(pick, chunk_id, source, text, score): the best chunks that fit a token budget.

    Chunks are taken in order of score; one that would exceed the budget is passed over unless it is the first. The answer
    holds at most ``top_k`` chunks, so the fold works on the few best of every length: of the chunks with an equal estimate
    only the first ``top_k`` can ever be taken.
    """
    ranked = rank_chunks(chunks.dropDuplicates(["chunk_id"]), query)
    best = [F.desc("score"), F.asc("source"), F.asc("chunk_index"), F.asc("chunk_id")]
    cost = F.least(F.col("token_estimate"), F.lit(max_tokens + 1))
    few = ranked.withColumn("r", F.row_number().over(Window.partitionBy(cost).orderBy(*best))).where(F.col("r") <= top_k)
    order = F.struct((-F.col("score")).alias("o"), "source", "chunk_index", "chunk_id", "token_estimate", "text", "score")
    listed = few.agg(F.sort_array(F.collect_list(order)).alias("all"))
    empty = F.struct(F.lit(0).cast("bigint").alias("used"), F.slice("all", 1, 0).alias("picks"))
    def step(a, x):
        taken = F.struct((a["used"] + x["token_estimate"]).alias("used"), F.array_append(a["picks"], x).alias("picks"))
        full = (F.size(a["picks"]) >= top_k) | (a["used"] >= max_tokens)
        over = (a["used"] + x["token_estimate"] > max_tokens) & (F.size(a["picks"]) > 0)
        return F.when(full | over, a).otherwise(taken)
    picked = listed.select(F.aggregate("all", empty, step).alias("a")).select(F.posexplode("a.picks").alias("p", "x"))
    return picked.select((F.col("p") + 1).cast("bigint").alias("pick"), "x.chunk_id", "x.source", "x.text", "x.score")


def _chunks(spark: SparkSession, folder: str) -> DataFrame:
    from vellum.tables import load, spread

    return spread(load(spark, folder, "chunks").select("chunk_id", "source", "chunk_index", "text"))


def q_search_content(spark: SparkSession, folder: str) -> DataFrame:
    return search_content(documents(spark, folder), QUERY)


def q_search_files(spark: SparkSession, folder: str) -> DataFrame:
    return search_files(documents(spark, folder), PHRASE)


def q_rank_chunks(spark: SparkSession, folder: str) -> DataFrame:
    return rank_chunks(_chunks(spark, folder).dropDuplicates(["chunk_id"]), QUERY).select("chunk_id", "score")


def q_retrieve_context(spark: SparkSession, folder: str) -> DataFrame:
    return retrieve_context(_chunks(spark, folder), QUERY)


_COUNT = " + ".join(f"((length(text) - length(replace(lower(text), '{t}', ''))) // {len(t)})" for t in QUERY.split())
_TERMS = "(" + ", ".join(f"'{t}'" for t in QUERY.split()) + ")"
QUERIES = {
    "search_content": q_search_content,
    "search_files": q_search_files,
    "rank_chunks": q_rank_chunks,
    "retrieve_context": q_retrieve_context,
}
SQL = {
    "search_content": f"SELECT doc_id, ({_COUNT})::BIGINT AS score FROM {_DOCS} WHERE {_COUNT} > 0 ORDER BY score DESC, doc_id LIMIT 10",
    "search_files": f"""SELECT doc_id, substr(text, greatest(1, p - 150), p - greatest(1, p - 150) + {len(PHRASE)} + 150) AS snippet
  FROM (SELECT *, instr(lower(text), '{PHRASE}') AS p FROM {_DOCS}) WHERE p > 0 ORDER BY doc_id LIMIT 5""",
    "rank_chunks": rf"""SELECT * FROM (SELECT chunk_id, round(100.0::DOUBLE * len(list_filter(w, lambda t: t IN {_TERMS})) / greatest(len(w), 1)
    + len(list_distinct(list_filter(w, lambda t: t IN {_TERMS}))), 6) AS score
  FROM (SELECT chunk_id, list_filter(list_transform(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}''-]+'), lambda t: lower(trim(t, '''-'))), lambda t: t <> '') AS w
    FROM (SELECT chunk_id, any_value(text) AS text FROM chunks WHERE text IS NOT NULL GROUP BY chunk_id))) WHERE score > 0""",
}
