"""Keeping an index current, and counting a stream.

The index of a corpus is a table of (path, mtime, model, ...). Refreshing it is a left-anti join on (path, mtime): only files that
are new or changed are worked on again, files that are gone are dropped, and another model clears it.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.session import keep, shared_dir
from vellum.tables import load


def refresh(index: DataFrame, files: DataFrame, model: str, work: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """The index after a change of ``files`` (path, mtime, ...). ``work`` turns changed files into index rows.

    Files with null path are left out; a null mtime never counts as unchanged.
    """
    there = files.where(F.col("path").isNotNull()).select("path", "mtime").distinct()
    kept = index.where(F.col("model") == model).join(there, ["path", "mtime"], "left_semi")
    changed = files.where(F.col("path").isNotNull()).join(
        index.where(F.col("model") == model).select("path", "mtime").distinct(), ["path", "mtime"], "left_anti"
    )
    return kept.unionByName(work(changed).withColumn("model", F.lit(model)), allowMissingColumns=True)


def word_index(files: DataFrame) -> DataFrame:
    """(path, mtime, n_words) of files with text."""
    return files.select("path", "mtime", tx.word_count("text").alias("n_words"))


def stream_counts(spark: SparkSession, folder: str, table: str = "events", minutes: int = 60) -> DataFrame:
    """Events per type and window, read as a stream to its end; rows up to a day late are counted, later ones are dropped.

    In update mode every micro-batch writes the windows it changed, to the shared folder, and the watermark lets go of the state
    of closed windows; a window's last writing is its result.
    """
    schema = load(spark, folder, table).schema
    out = f"{shared_dir(spark)}/vellum-stream-{uuid.uuid4().hex}"
    rows = spark.readStream.schema(schema).parquet(f"{folder}/{table}.parque[t]")
    counts = (
        rows.withColumn("at", F.col("ts").cast("timestamp"))
        .withWatermark("at", "1 day")
        .groupBy(F.window("at", f"{minutes} minutes").alias("w"), "event_type")
        .agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
        .select(F.col("w.start").cast("timestamp_ntz").alias("start"), "event_type", "n", "total")
    )
    query = (
        counts.writeStream.outputMode("update")
        # by number, so a batch that is run again after a failure writes what it wrote before
        .foreachBatch(lambda batch, n: batch.write.mode("overwrite").parquet(f"{out}/result/batch={n}"))
        .option("checkpointLocation", f"{out}/progress")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    keep(f"{out}")
    last = F.struct("batch", "n", "total")
    rows = spark.read.parquet(f"{out}/result").groupBy("start", "event_type").agg(F.max(last).alias("last"))
    return rows.select("start", "event_type", "last.n", "last.total")


def q_stream(spark: SparkSession, folder: str) -> DataFrame:
    return stream_counts(spark, folder)


def _versions(rows: DataFrame) -> DataFrame:
    """(path, mtime, text): the latest version of each path."""
    rows = rows.where("path is not null and text is not null")
    by = F.struct("mtime", "text")
    return rows.groupBy("path").agg(F.max_by("mtime", by).alias("mtime"), F.max_by("text", by).alias("text"))


def earlier_index(documents: DataFrame, notes: DataFrame) -> DataFrame:
    """An index as an earlier run would have left it: documents loaded before the middle of the loads, notes kept as files
    then and gone now, and rows of another model. Documents have no older versions, so a third of the rows (by a hash of
    the path) stand for such: a day older, and with a count no text has."""
    cut = documents.agg(F.expr("percentile_approx(loaded_at, 0.5)").alias("cut"))
    first = _versions(documents.join(F.broadcast(cut), F.col("loaded_at") < F.col("cut")))
    older = F.pmod(F.xxhash64("path"), F.lit(3)) == 0
    had = word_index(first).select(
        "path",
        F.when(older, F.col("mtime") - F.expr("interval 1 day")).otherwise(F.col("mtime")).alias("mtime"),
        F.when(older, F.lit(-1)).otherwise(F.col("n_words")).cast("bigint").alias("n_words"),
    )
    gone = notes.where("path is not null and body is not null").select("path", "mtime", F.col("body").alias("text"))
    gone = word_index(gone.join(documents.select("path"), "path", "left_anti"))
    other = word_index(_versions(documents)).withColumn("n_words", F.lit(-2).cast("bigint")).withColumn("model", F.lit("other"))
    return had.unionByName(gone).withColumn("model", F.lit("words")).unionByName(other)


def q_refresh(spark: SparkSession, folder: str) -> DataFrame:
    """An earlier index brought up to date: new and changed files are done again, those gone and other models' rows dropped."""
    documents = load(spark, folder, "documents")
    index = earlier_index(documents, load(spark, folder, "notes"))
    return refresh(index, _versions(documents), "words", word_index).select("path", "n_words")


QUERIES = {"stream_event_counts": q_stream, "incremental_index": q_refresh}
SQL = {
    "stream_event_counts": "SELECT time_bucket(INTERVAL 60 MINUTE, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "incremental_index": r"""SELECT path, len(regexp_extract_all(text, '[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+'))::BIGINT AS n_words FROM
  (SELECT path, text, row_number() OVER (PARTITION BY path ORDER BY mtime DESC NULLS LAST, text DESC) AS r FROM documents WHERE path IS NOT NULL AND text IS NOT NULL) WHERE r = 1""",
}
