"""Queries of the small text forms, over inputs built from the tables."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import format as fm
from vellum.functions import text as tx
from vellum.operators.textstats import _DOCS, _SPACE, documents
from vellum.tables import load

CLOCK = dt.datetime(2026, 7, 1, 9, 5, 0)
TEMPLATE = "# {{title}}\n{{date}} {{time}} {{date:DD.MM.YYYY}} {{time:HHmm}} {{unknown}} {{open"


def q_bare_words(spark: SparkSession, folder: str) -> DataFrame:
    words = documents(spark, folder).select(F.explode(tx.whitespace_words("text")).alias("w"))
    return words.groupBy(fm.bare_word("w").alias("word")).agg(F.count("*").alias("n"))


def q_shown_tokens(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of white space and of other characters, as they are shown, with their counts."""
    parts = F.regexp_extract_all("text", F.lit(r"(?U)\s+|\S+"), F.lit(0))
    tokens = documents(spark, folder).select(F.explode(parts).alias("t")).groupBy("t").agg(F.count("*").alias("n"))
    return tokens.groupBy(fm.shown_token("t").alias("token")).agg(F.sum("n").alias("n"))


def q_sizes(spark: SparkSession, folder: str) -> DataFrame:
    rows = load(spark, folder, "attachments").select("attachment_id", fm.human_size("n_bytes").alias("size"))
    return rows.distinct()


def q_ages(spark: SparkSession, folder: str) -> DataFrame:
    """How long ago notes were changed, by a fixed clock; those changed after it are left out."""
    age = F.timestamp_diff("SECOND", F.col("mtime"), F.lit(CLOCK).cast("timestamp_ntz"))
    rows = load(spark, folder, "notes").select("note_id", "loaded_at", age.alias("s")).where("s >= 0")
    return rows.select("note_id", "loaded_at", fm.relative_age("s").alias("age")).distinct()


def q_truncated(spark: SparkSession, folder: str) -> DataFrame:
    return documents(spark, folder).select("doc_id", fm.truncated("text", 200).alias("prompt"))


def q_templates(spark: SparkSession, folder: str) -> DataFrame:
    at = F.lit(CLOCK).cast("timestamp_ntz")
    return load(spark, folder, "nation").select("n_nationkey", fm.rendered(TEMPLATE, "n_name", at).alias("note"))


def q_offered_names(spark: SparkSession, folder: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey")
    header = (
        F.when(k % 4 == 0, F.concat(F.lit('attachment; FileName="'), n, F.lit('.pdf"; x=1'))).when(k % 4 == 1, F.concat(F.lit("inline; filename="), n, F.lit(".txt; x=1")))
        .when(k % 4 == 2, F.concat(F.lit('attachment; filename="../'), n, F.lit('"'))).otherwise(F.concat(F.lit("inline; name="), n))
    )
    return load(spark, folder, "nation").select("n_nationkey", fm.offered_name(header).alias("file_name"))


def q_source_kinds(spark: SparkSession, folder: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey")
    source = F.when(k % 4 == 0, F.concat(F.lit("https://x.example/"), n)).when(k % 4 == 1, F.lit("-")).when(k % 4 == 2, F.concat(F.lit("http://"), F.lit(""))).otherwise(n)
    return load(spark, folder, "nation").select("n_nationkey", fm.source_kind(source).alias("kind"))


def q_named_files(spark: SparkSession, folder: str) -> DataFrame:
    names = sorted(x for xs in fm.NAMED_FILES.values() for x in xs)
    every = F.explode(F.array(*[F.lit(x) for x in [*names, "README", "a.py"]])).alias("name")
    rows = load(spark, folder, "nation").where("n_nationkey < 2").select("n_nationkey", every)
    name = F.when(F.col("n_nationkey") == 1, F.upper("name")).otherwise(F.col("name"))
    return rows.select(name.alias("name"), fm.language_of_name(name).alias("language"))


def q_style_hints(spark: SparkSession, folder: str) -> DataFrame:
    k = F.col("n_nationkey")
    style = F.concat(
        F.lit("Color: "), F.when(k % 3 == 0, "inherit").otherwise(F.concat(F.lit("rgb("), k, F.lit(")"))), F.lit("; display:"), F.when(k % 2 == 0, "block").otherwise("flex"),
        F.lit(";margin: 0;font-size: "), k, F.lit("px; x-y: 1; ; background: url(a:b)"),
    )
    return load(spark, folder, "nation").select("n_nationkey", F.explode(fm.style_hints(style)).alias("h")).select("n_nationkey", "h.property", "h.value")


def q_formatting_hints(spark: SparkSession, folder: str) -> DataFrame:
    n, k = F.col("n_name"), F.col("n_nationkey")
    text = F.when(k % 3 == 0, F.upper(n)).when(k % 3 == 1, F.concat(F.lit("a **"), n, F.lit("**"))).otherwise(F.concat(F.lit("a_"), n))
    return load(spark, folder, "nation").select("n_nationkey", F.array_join(fm.formatting_hints(text), "; ").alias("hints"))


def q_data_urls(spark: SparkSession, folder: str) -> DataFrame:
    name = F.concat("n_name", F.when(F.col("n_nationkey") % 3 == 0, ".JPG").when(F.col("n_nationkey") % 3 == 1, ".svg").otherwise(".bin"))
    return load(spark, folder, "nation").select("n_nationkey", fm.data_url(name, F.encode("n_name", "UTF-8")).alias("url"))


def q_unit_vectors(spark: SparkSession, folder: str) -> DataFrame:
    """The mean vector of each label at length one, a row per dimension."""
    rows = load(spark, folder, "embeddings").select("label", F.posexplode("embedding").alias("dim", "x"))
    means = rows.groupBy("label", F.col("dim").cast("bigint").alias("dim")).agg(F.avg(F.col("x").cast("double")).alias("mean"))
    norms = means.groupBy("label").agg(F.sqrt(F.sum(F.col("mean") * F.col("mean"))).alias("norm"))
    value = F.when(F.col("norm") > 0, F.col("mean") / F.col("norm")).otherwise(0.0)
    return means.join(norms, "label").select("label", "dim", F.round(value, 5).alias("value"))


HASH_BUCKETS = 512


def hash_embedding(docs: DataFrame, buckets: int = HASH_BUCKETS) -> DataFrame:
    """(doc_id, bucket, value): words hashed into so many buckets, at length one; the embedder that needs no model.

    A word's bucket is the first 24 bits of its MD5 modulo the buckets, the same in every engine."""
    bucket = F.pmod(F.conv(F.substr(F.md5("word"), F.lit(1), F.lit(6)), 16, 10).cast("bigint"), F.lit(buckets))
    words = docs.select("doc_id", F.explode(tx.tokens("text")).alias("word"))
    counts = words.groupBy("doc_id", bucket.alias("bucket")).agg(F.count("*").alias("n"))
    # at most as many entries as buckets a document
    lists = counts.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "n")).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x["n"] * x["n"]))
    return lists.select("doc_id", norm.alias("norm"), F.explode("v").alias("x")).select("doc_id", F.col("x.bucket").alias("bucket"), F.round(F.col("x.n") / F.col("norm"), 6).alias("value"))


def q_hash_embedding(spark: SparkSession, folder: str) -> DataFrame:
    return hash_embedding(documents(spark, folder))


_ENDS = r"[^\p{L}\p{N}]+"
_SHOWN = r"CASE WHEN c IN (' ', 'Ġ', '▁') THEN '␣' WHEN c = chr(10) THEN '\n' WHEN c = chr(9) THEN '\t' WHEN c = chr(13) THEN '\r' WHEN unicode(c) < 32 OR unicode(c) BETWEEN 127 AND 159 THEN '\u{' || printf('%x', unicode(c)) || '}' ELSE c END"
_NAMES = ", ".join(f"('{n}', '{k}')" for k, ns in fm.NAMED_FILES.items() for n in ns)
_WS = _SPACE[1:-2].replace("^", "")

QUERIES = {
    "bare_words": q_bare_words, "shown_tokens": q_shown_tokens, "human_sizes": q_sizes, "relative_ages": q_ages, "truncated_prompts": q_truncated,
    "rendered_templates": q_templates, "offered_names": q_offered_names, "source_kinds": q_source_kinds, "named_file_languages": q_named_files,
    "style_hints": q_style_hints, "formatting_hints": q_formatting_hints, "image_data_urls": q_data_urls, "unit_mean_vectors": q_unit_vectors, "hash_embedding": q_hash_embedding,
}
SQL = {
    "bare_words": f"SELECT lower(regexp_replace(regexp_replace(w, '^{_ENDS}', ''), '{_ENDS}$', '')) AS word, count(*) AS n FROM (SELECT unnest(regexp_extract_all(text, '{_SPACE}')) AS w FROM {_DOCS}) GROUP BY 1",
    "shown_tokens": f"""SELECT CASE WHEN t = '' THEN '(empty)' ELSE array_to_string(list_transform(string_split(t, ''), lambda c: {_SHOWN}), '') END AS token, count(*) AS n
  FROM (SELECT unnest(regexp_extract_all(text, '[{_WS}]+|{_SPACE}')) AS t FROM {_DOCS}) GROUP BY 1""",
    "human_sizes": """SELECT DISTINCT attachment_id, CASE WHEN n_bytes < 1024 THEN n_bytes || ' B' WHEN n_bytes < 1048576 THEN printf('%.1f', floor(n_bytes / 1024.0::DOUBLE * 10 + 0.5) / 10) || ' KB'
  WHEN n_bytes IS NOT NULL THEN printf('%.1f', floor(n_bytes / 1048576.0::DOUBLE * 10 + 0.5) / 10) || ' MB' END AS size FROM attachments""",
    "relative_ages": f"""SELECT DISTINCT note_id, loaded_at, CASE WHEN s < 60 THEN s || ' sec ago' WHEN s < 3600 THEN s // 60 || ' min ago' WHEN s < 86400 THEN s // 3600 || ' hrs ago' ELSE s // 86400 || ' days ago' END AS age
  FROM (SELECT note_id, loaded_at, datesub('second', mtime, TIMESTAMP '{CLOCK}') AS s FROM notes) WHERE s >= 0""",
    "truncated_prompts": f"SELECT doc_id, CASE WHEN length(text) > 200 THEN substr(text, 1, 200) || chr(10) || chr(10) || '[...truncated...]' ELSE text END AS prompt FROM {_DOCS}",
    "rendered_templates": "SELECT n_nationkey, '# ' || n_name || chr(10) || '2026-07-01 09:05 01.07.2026 0905 {{unknown}} {{open' AS note FROM nation",
    "offered_names": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN n_name || '.pdf' WHEN 1 THEN n_name || '.txt' END AS file_name FROM nation",
    "source_kinds": "SELECT n_nationkey, CASE n_nationkey % 4 WHEN 0 THEN 'url' WHEN 1 THEN 'stdin' ELSE 'path' END AS kind FROM nation",
    "named_file_languages": f"SELECT name, language FROM (VALUES {_NAMES}, ('README', ''), ('a.py', '')) v(name, language) UNION ALL SELECT upper(name), language FROM (VALUES {_NAMES}, ('README', ''), ('a.py', '')) v(name, language)",
    "style_hints": """SELECT n_nationkey, 'color' AS property, 'rgb(' || n_nationkey || ')' AS value FROM nation WHERE n_nationkey % 3 <> 0 UNION ALL
  SELECT n_nationkey, 'display', 'flex' FROM nation WHERE n_nationkey % 2 <> 0 UNION ALL SELECT n_nationkey, 'font-size', n_nationkey || 'px' FROM nation UNION ALL
  SELECT n_nationkey, 'background', 'url(a:b)' FROM nation""",
    "formatting_hints": """SELECT n_nationkey, CASE n_nationkey % 3 WHEN 0 THEN CASE WHEN regexp_matches(upper(n_name), '[^A-Z ]') THEN CASE WHEN contains(n_name, '_') THEN 'font-style: italic' ELSE '' END ELSE 'text-transform: uppercase' END
  WHEN 1 THEN 'font-weight: bold; font-style: italic' ELSE 'font-style: italic' END AS hints FROM nation""",
    "image_data_urls": "SELECT n_nationkey, 'data:' || CASE n_nationkey % 3 WHEN 0 THEN 'image/jpeg' WHEN 1 THEN 'image/svg+xml' ELSE 'application/octet-stream' END || ';base64,' || base64(encode(n_name)) AS url FROM nation",
    "unit_mean_vectors": """WITH m AS (SELECT label, dim, avg(x::DOUBLE) AS mean FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY ALL)
  SELECT label, dim::BIGINT AS dim, round(mean / sqrt(sum(mean * mean) OVER (PARTITION BY label)), 5) AS value FROM m""",
    "hash_embedding": f"""WITH w AS (SELECT doc_id, ('0x' || substr(md5(word), 1, 6))::BIGINT % {HASH_BUCKETS} AS bucket, count(*) AS n FROM
  (SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[^\\p{{L}}\\p{{N}}''-]+'), lambda t: lower(trim(t, '''-'))), lambda t: t <> '')) AS word FROM {_DOCS}) GROUP BY ALL)
  SELECT doc_id, bucket, round(n / sqrt(sum(n * n) OVER (PARTITION BY doc_id)), 6) AS value FROM w""",
}
