"""Fingerprints, sparse cosine and dense vectors."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.functions.words import STOPWORDS
from vellum.operators.skew import salted_join
from vellum.operators.textstats import _DOCS, _STOP, _TOK, documents, term_frequency
from vellum.session import materialize
from vellum.tables import load

THRESHOLD = 3


class _Prints(dict):
    """FNV-1a of words, each worked out once."""

    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = 0xCBF29CE484222325
        for byte in word.encode():
            h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
        self[word] = h
        return h


_PRINT = _Prints()


def simhash(docs: DataFrame) -> DataFrame:
    """(doc_id, fingerprint): 64-bit SimHash of a document's words, each weighing its count; 0 without words.

    A document's words are hashed where it is read, so no word of the corpus is a key and nothing is shuffled.
    """

    @F.pandas_udf("bigint")
    def prints(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        places = np.arange(64, dtype=np.uint64)
        for rows in batches:
            out = np.zeros(len(rows), np.uint64)
            for k, words in enumerate(rows):
                if words is None or not len(words):
                    continue
                counts = Counter(words)
                h = np.fromiter(map(_PRINT.__getitem__, counts), np.uint64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                ones = (((h[:, None] >> places) & np.uint64(1)).astype(np.int64) * n[:, None]).sum(0)
                out[k] = ((ones * 2 > n.sum()).astype(np.uint64) << places).sum()
            yield pd.Series(out.view(np.int64))

    return docs.select("doc_id", prints(tx.tokens("text")).alias("fingerprint"))


#: Blocks of a fingerprint that a key of the multi-index combines, beside those that may differ.
TOGETHER = 3


def near_duplicate_links(prints: DataFrame, threshold: int = THRESHOLD) -> tuple[DataFrame, DataFrame]:
    """Representatives of equal fingerprints, and links between fingerprints within ``threshold`` bits.

    Two fingerprints that differ in at most t of t + 3 blocks agree in three of them at least, so an equi-join on every choice of
    three blocks misses none; three blocks are half the bits, which keeps the buckets small however large the corpus.
    Equal fingerprints are one class, so copies are never paired with each other.
    """
    classes = prints.where(F.col("fingerprint") != 0).groupBy("fingerprint").agg(F.min("doc_id").alias("class_id"), F.count("*").alias("n_documents"))
    n = threshold + TOGETHER
    edges = [round(64 * i / n) for i in range(n + 1)]
    masks = [((1 << (high - low)) - 1) << low for low, high in zip(edges, edges[1:])]
    signed = lambda m: m - (1 << 64) if m >> 63 else m
    keys = F.array(*[F.col("fingerprint").bitwiseAND(F.lit(signed(sum(some)))) for some in combinations(masks, TOGETHER)])
    rows = classes.select("class_id", "fingerprint", F.posexplode(keys).alias("block", "value"))
    a, b = rows.alias("a"), rows.alias("b")
    distance = F.bit_count(F.col("a.fingerprint").bitwiseXOR(F.col("b.fingerprint")))
    same = (F.col("a.block") == F.col("b.block")) & (F.col("a.value") == F.col("b.value"))
    links = a.join(b, same & (F.col("a.class_id") < F.col("b.class_id")) & (distance <= threshold)).select(
        F.col("a.class_id").alias("a"), F.col("b.class_id").alias("b"), distance.cast("bigint").alias("distance")
    )
    return classes, links.distinct()


def terms(text: Column | str) -> Column:
    """Words of at least three bytes that aren't stopwords, as an array."""
    return F.filter(tx.tokens(text), lambda w: (F.octet_length(w) >= 3) & ~w.isin(STOPWORDS))


def related(docs: DataFrame, target: int, most: int | None = 5) -> DataFrame:
    """(doc_id, score): documents of most cosine of term counts with one document; ties by id. All of them in no order without ``most``.

    The terms of the one document travel to the others, which are read once and not shuffled."""
    row = docs.where(F.col("doc_id") == target).select(terms("text").alias("t")).first()
    own = Counter(row["t"] if row and row["t"] else [])
    own_norm = sum(n * n for n in own.values()) ** 0.5

    @F.pandas_udf("double")
    def cosine(rows: pd.Series) -> pd.Series:
        out = []
        for words in rows:
            counts = Counter(words)
            dot = sum(n * own[w] for w, n in counts.items() if w in own)
            out.append(dot / (sum(n * n for n in counts.values()) ** 0.5 * own_norm) if dot else 0.0)
        return pd.Series(out, dtype="float64")

    scored = docs.where(F.col("doc_id") != target).select("doc_id", F.round(cosine(terms("text")), 6).alias("score"))
    scored = scored.where("score > 0")
    return scored if most is None else scored.orderBy(F.desc("score"), "doc_id").limit(most)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def vector_search(vectors: DataFrame, target: int, most: int = 10) -> DataFrame:
    """(vec_id, score): rows of most cosine with one row; the single query vector becomes a constant of the plan."""
    norm = lambda c: F.sqrt(dot(c, c))
    row = vectors.where(F.col("vec_id") == target).select("embedding").first()
    query = F.array(*map(F.lit, row["embedding"] if row and row["embedding"] else [])).cast("array<double>")
    score = F.round(dot(F.col("embedding"), query) / (norm(F.col("embedding")) * norm(query)), 5)
    return vectors.where(F.col("vec_id") != target).select("vec_id", score.alias("score")).orderBy(
        F.desc("score"), "vec_id"
    ).limit(most)


def file_vectors(vectors: DataFrame) -> DataFrame:
    """(label, dim, mean): mean vector of each label, as one row per dimension."""
    rows = vectors.select("label", F.posexplode("embedding").alias("dim", "x"))
    return rows.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("mean"))


def cluster(docs: DataFrame, least: float = 0.2) -> DataFrame:
    """(doc_id, cluster_id, score): documents around leaders found by their strongest term.

    A one-pass assignment that depends on the order of documents can't be distributed; here each document's first keyword names a
    group, the document of most weight leads it, and documents whose cosine with the leader is below ``least`` stand alone.
    """
    tf = term_frequency(docs)
    norms = tf.groupBy("doc_id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("norm"))
    top = Window.partitionBy("doc_id").orderBy(F.desc("tf"), "term")
    first = tf.withColumn("r", F.row_number().over(top)).where("r = 1").select("doc_id", F.col("term").alias("label"), "tf")
    leader = first.groupBy("label").agg(F.max_by("doc_id", F.struct("tf", -F.col("doc_id"))).alias("leader"))
    member = first.join(leader, "label").select("doc_id", "label", "leader")
    led = tf.select(F.col("doc_id").alias("leader"), "term", F.col("tf").alias("ltf")).join(leader.select("leader"), "leader", "left_semi")
    # all documents of a leader bring their terms to the leader's, so the leader's frequent terms are hot
    brought = tf.join(member, "doc_id")
    weights = brought.groupBy("leader", "term").agg(F.count("*").alias("n"))
    dots = salted_join(brought, led, ["leader", "term"], weights, "n").groupBy("doc_id", "leader", "label").agg(F.sum(F.col("tf") * F.col("ltf")).alias("dot"))
    scored = dots.join(norms, "doc_id").join(norms.select(F.col("doc_id").alias("leader"), F.col("norm").alias("lnorm")), "leader")
    score = F.round(F.col("dot") / (F.col("norm") * F.col("lnorm")), 6)
    return scored.withColumn("score", score).select(
        "doc_id", F.when(F.col("score") >= least, F.col("leader")).otherwise(F.col("doc_id")).alias("cluster_id"), "score"
    )


def q_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash(documents(spark, folder))


def q_near_duplicates(spark: SparkSession, folder: str) -> DataFrame:
    """One row per class of equal fingerprints: its documents and its links to other classes."""
    # written once, as the classes are asked for twice and so would the texts be read
    classes, links = near_duplicate_links(materialize(simhash(documents(spark, folder)), "similarity-prints"))
    ends = links.select(F.explode(F.array("a", "b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    return classes.join(ends, "class_id", "left").select("class_id", "n_documents", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))


def q_related(spark: SparkSession, folder: str) -> DataFrame:
    return related(documents(spark, folder), 1)


def q_vector_search(spark: SparkSession, folder: str) -> DataFrame:
    return vector_search(load(spark, folder, "embeddings"), 0)


def q_file_vectors(spark: SparkSession, folder: str) -> DataFrame:
    return file_vectors(load(spark, folder, "embeddings"))


def q_cluster(spark: SparkSession, folder: str) -> DataFrame:
    return cluster(documents(spark, folder))


_TF = (
    f"(SELECT doc_id, term, count(*) AS tf FROM (SELECT doc_id, unnest({_TOK}) AS term FROM {_DOCS}) "
    f"WHERE octet_length(encode(term)) >= 3 AND term NOT IN {_STOP} GROUP BY ALL)"
)
_PRINTS = f"""
w AS (SELECT doc_id, word, count(*) AS w FROM (SELECT doc_id, unnest({_TOK}) AS word FROM {_DOCS}) GROUP BY ALL),
h AS (SELECT word, list_reduce(list_concat([14695981039346656037::UHUGEINT], list_transform(range(1, octet_length(encode(word)) + 1), lambda i:
  ('0x' || substr(hex(encode(word)), 2 * i - 1, 2))::UHUGEINT)), lambda h, b: (xor(h, b) * 1099511628211::UHUGEINT) % 18446744073709551616::UHUGEINT) AS h
  FROM (SELECT DISTINCT word FROM w)),
v AS (SELECT doc_id, b, sum(CASE WHEN (h::UBIGINT >> b::UBIGINT) & 1::UBIGINT = 1 THEN w ELSE -w END) AS v FROM w JOIN h USING (word), range(64) r(b) GROUP BY ALL),
u AS (SELECT doc_id, sum(CASE WHEN v > 0 THEN (1::HUGEINT << b::INT) ELSE 0 END) AS f FROM v GROUP BY doc_id),
p AS (SELECT d.doc_id, coalesce(CASE WHEN f >= 9223372036854775808 THEN f - 18446744073709551616 ELSE f END, 0)::BIGINT AS fingerprint FROM {_DOCS} d LEFT JOIN u USING (doc_id))"""

QUERIES = {
    "simhash": q_simhash,
    "near_duplicate_classes": q_near_duplicates,
    "related_documents": q_related,
    "vector_search": q_vector_search,
    "mean_vectors": q_file_vectors,
    "cluster_documents": q_cluster,
}
SQL = {
    "simhash": f"WITH {_PRINTS} SELECT doc_id, fingerprint FROM p",
    "near_duplicate_classes": f"""WITH {_PRINTS}, c AS (SELECT fingerprint, min(doc_id) AS class_id, count(*) AS n_documents FROM p WHERE fingerprint <> 0 GROUP BY fingerprint),
  l AS (SELECT a.class_id AS a, b.class_id AS b FROM c a JOIN c b ON a.class_id < b.class_id AND bit_count(xor(a.fingerprint, b.fingerprint)) <= {THRESHOLD}),
  e AS (SELECT a AS class_id FROM l UNION ALL SELECT b FROM l)
  SELECT class_id, n_documents, (SELECT count(*) FROM e WHERE e.class_id = c.class_id) AS n_links FROM c""",
    "related_documents": f"""WITH tf AS {_TF}, n AS (SELECT doc_id, sqrt(sum(tf * tf)) AS norm FROM tf GROUP BY doc_id)
  SELECT a.doc_id, round(sum(a.tf * b.tf) / (any_value(n.norm) * (SELECT norm FROM n WHERE doc_id = 1)), 6) AS score FROM tf a JOIN tf b ON a.term = b.term AND b.doc_id = 1
  JOIN n ON n.doc_id = a.doc_id WHERE a.doc_id <> 1 GROUP BY a.doc_id ORDER BY score DESC, a.doc_id LIMIT 5""",
    "vector_search": """SELECT vec_id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings WHERE vec_id = 0)), 5) AS score
  FROM embeddings WHERE vec_id <> 0 ORDER BY score DESC, vec_id LIMIT 10""",
    "mean_vectors": """SELECT label, dim, round(avg(x::DOUBLE), 6) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY label, dim""",
}
