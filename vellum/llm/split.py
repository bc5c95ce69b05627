"""Splitting oversized chunks at natural boundaries (problem 1).

Method: one bounded-quantifier regular expression, applied by ``regexp_extract_all``. Its alternatives
are ordered by the strength of the boundary they end at (blank line, sentence end, line end, word end)
and consume as many words as the limit allows; a second pass of the same form over characters, ending in
a plain character fallback, bounds pieces without white space. Overlap is a lookback into the piece
before. All of it is SQL array functions; nothing leaves the JVM.

A size is ``ceil(1.3 x words)`` tokens, words being runs of characters that are not Unicode white space,
and code points. A chunk within both limits comes out as one piece, unchanged; null text gives no piece,
empty text one empty piece. Without overlap the pieces of a chunk, joined, are its text. A null heading
path stays null. Rows repeated with the same ``chunk_id`` and text count once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.session import materialize
from vellum.tables import load, spread

MAX_TOKENS = 512
MAX_CHARS = 4096
OVERLAP_TOKENS = 64
OVERLAP_CHARS = 400
#: Ids that come again are broadcast up to this many.
MAX_BROADCAST_IDS = 1_000_000


def words(text: Column) -> Column:
    """Number of words, as bigint."""
    return F.regexp_count(text, F.lit(r"(?U)\S+")).cast("bigint")


def tokens(n_words: Column) -> Column:
    return F.ceil(n_words * F.lit(1.3)).cast("bigint")


def max_words(limit: int) -> int:
    """The most words whose estimate is within ``limit`` tokens."""
    n = int(limit / 1.3) + 1
    while -(-n * 13 // 10) > limit:
        n -= 1
    return max(1, n)


def oversized(text: Column, max_tokens: int = MAX_TOKENS, max_chars: int = MAX_CHARS) -> Column:
    return (words(text) > max_words(max_tokens)) | (F.length(text) > max_chars)


def _by_words(most: int) -> str:
    """A piece of up to ``most`` words with the white space around them."""
    least = max(1, most // 2)
    word = r"(?:\s*+\S++)"
    return (
        r"(?sU)"
        + rf"{word}{{{least},{most}}}(?=\s*\n\s*\n|\s*\z)\s*+"
        + rf"|{word}{{{least},{most}}}(?<=[.!?…。！？][\"'»”)\]]?)\s++"
        + rf"|{word}{{{least},{most}}}(?=[^\S\n]*\n)\s++"
        + rf"|{word}{{1,{most}}}\s*+"
        + r"|\s++"
    )


def _by_chars(most: int) -> str:
    least = max(1, most // 2)
    return (
        r"(?sU)"
        + rf".{{{least},{most}}}(?<=\n\s?\n)|.{{1,{most}}}\z"
        + rf"|.{{{least},{most}}}(?<=[。！？…]|[.!?]\s)|.{{{least},{most}}}(?<=\n)"
        + rf"|.{{{least},{most}}}(?<=\s)|.{{1,{most}}}"
    )


def pieces(text: Column, max_tokens: int, max_chars: int, overlap_tokens: int, overlap_chars: int) -> Column:
    """Array of the pieces of ``text``, each within both limits with its overlap."""
    back_words = max_words(overlap_tokens) if overlap_tokens else 0
    core_words = max(1, max_words(max_tokens) - back_words)
    core_chars = max(1, max_chars - overlap_chars)
    cores = F.flatten(
        F.transform(
            F.regexp_extract_all(text, F.lit(_by_words(core_words)), F.lit(0)),
            lambda p: F.when(F.length(p) <= core_chars, F.array(p)).otherwise(
                F.regexp_extract_all(p, F.lit(_by_chars(core_chars)), F.lit(0))
            ),
        )
    )
    if not back_words or not overlap_chars:
        return cores
    # at most so many of the last characters, from a word's start where there is one, and so many words
    tail = rf"(?sU)(?:(?<=\s)\S++\s*+){{1,{back_words}}}\z"
    shared = lambda p: F.right(p, F.lit(overlap_chars))
    lookback = lambda p: F.when(
        F.regexp_like(shared(p), F.lit(r"(?U)\s\S")), F.regexp_extract(shared(p), tail, 0)
    ).otherwise(F.when(F.regexp_like(shared(p), F.lit(r"(?U)\s")), F.lit("")).otherwise(shared(p)))
    return F.transform(
        cores, lambda p, i: F.when(i == 0, p).otherwise(F.concat(lookback(F.get(cores, i - 1)), p))
    )


def split_oversized(
    chunks: DataFrame,
    max_tokens: int = MAX_TOKENS,
    max_chars: int = MAX_CHARS,
    overlap_tokens: int = OVERLAP_TOKENS,
    overlap_chars: int = OVERLAP_CHARS,
) -> DataFrame:
    """(chunk_id, piece_no, n_pieces, heading_path, text, token_estimate, is_oversized)."""
    rows = chunks.select("chunk_id", "heading_path", "text").where(F.col("text").isNotNull())
    big = oversized(F.col("text"), max_tokens, max_chars)
    cut = F.when(big, pieces(F.col("text"), max_tokens, max_chars, overlap_tokens, overlap_chars)).otherwise(
        F.array("text")
    )
    return (
        rows.withColumn("is_oversized", big)
        .withColumn("cut", cut)
        .select(
            "chunk_id",
            "heading_path",
            "is_oversized",
            F.size("cut").cast("bigint").alias("n_pieces"),
            F.posexplode("cut").alias("piece_no", "piece"),
        )
        .select(
            "chunk_id",
            F.col("piece_no").cast("bigint").alias("piece_no"),
            "n_pieces",
            "heading_path",
            F.col("piece").alias("text"),
            tokens(words(F.col("piece"))).alias("token_estimate"),
            "is_oversized",
        )
    )


def once(chunks: DataFrame) -> DataFrame:
    """Each chunk_id and text once. Only ids are shuffled to find those that come again, and only the texts of these are brought
    together; beyond ``MAX_BROADCAST_IDS`` of them all texts are."""
    again = materialize(chunks.groupBy("chunk_id").agg(F.count("*").alias("n")).where("n > 1").select("chunk_id"), "split-again")
    if again.count() > MAX_BROADCAST_IDS:
        return chunks.dropDuplicates(["chunk_id", "text"])
    # a null id equals no other in a join, so it is marked by itself
    marked = chunks.join(F.broadcast(again.withColumn("_again", F.lit(True))), chunks["chunk_id"].eqNullSafe(again["chunk_id"]), "left").drop(again["chunk_id"])
    alone, repeated = marked.where("_again is null"), marked.where("_again")
    return alone.unionByName(repeated.dropDuplicates(["chunk_id", "text"])).drop("_again")


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = split_oversized(spread(load(spark, folder, "chunks")))
    return rows.where("is_oversized and piece_no = 0").select("chunk_id").distinct()


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return split_oversized(once(spread(load(spark, folder, "chunks").select("chunk_id", "heading_path", "text"))))


_SPACE = r"\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"

QUERIES = {"p1_found": p1_found, "p1_pieces": p1_pieces}
SQL = {
    "p1_found": f"SELECT DISTINCT chunk_id FROM chunks WHERE ceil(1.3 * len(regexp_extract_all(text, '[^{_SPACE}]+'))) > 512 OR length(text) > 4096"
}
