"""Corpora from folders, and writing them back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions.format import language_of_name
from vellum.sources.convert import LIMIT, language_of_ending, to_markdown

# What a scan leaves out, what counts as a note.
SKIPPED = r"/(\.[^/]*|target|node_modules|__pycache__|\.git|dist|build|venv)/"
NOTES = ("md", "markdown", "mdown", "txt")


# What a scan of code takes, by ending and by name, and the folders it leaves out.
CODE_ENDINGS = (
    "rs py js ts go java cs cpp c h hpp rb php swift kt scala groovy lua perl pl sh bash zsh fish ps1 cmd bat html css scss sass less jsx tsx vue svelte json yaml yml xml "
    "toml ini conf cfg sql makefile dockerfile gradle cmake md rst tex svg"
).split()
CODE_NAMES = ("Dockerfile", "Makefile", "Rakefile", "Gemfile", "Procfile", ".gitignore", ".dockerignore", ".bashrc", ".zshrc", "package.json", "tsconfig.json")
CODE_SKIPPED = (
    "node_modules target .git .svn .hg dist build out __pycache__ .venv venv .env vendor .idea .vscode coverage .pytest_cache .cargo Pods .bundle"
).split()


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))


def scan(spark: SparkSession, folder: str, extensions: tuple[str, ...] | None = None) -> DataFrame:
    """(path, ext, mtime, n_bytes, content) of the files below ``folder``; hidden and build folders are left out. No cap."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    rows = rows.select("path", extension(F.col("path")).alias("ext"), F.col("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"), "content")
    rows = rows.where(~F.regexp_like("path", F.lit(SKIPPED)))
    return rows.where(F.col("ext").isin(*extensions)) if extensions else rows


def is_code(path: Column) -> Column:
    """Whether a scan of code takes a file: by its ending in any case or by its name, outside folders of builds and tools and hidden ones."""
    name = F.regexp_extract(path, r"([^/]*)$", 1)
    folders = F.split(F.regexp_replace(path, r"[^/]*$", ""), "/")
    out = F.exists(folders, lambda f: f.isin(*CODE_SKIPPED) | F.regexp_like(f, F.lit(r"^\.[^./]")))
    return (extension(path).isin(*CODE_ENDINGS) | name.isin(*CODE_NAMES)) & ~out


def code(spark: SparkSession, folder: str) -> DataFrame:
    """(path, ext, mtime, n_bytes, content, language) of the code below ``folder``."""
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    name = F.regexp_extract("path", r"([^/]*)$", 1)
    by_ending = language_of_ending(extension(F.col("path")))
    return rows.where(is_code(F.col("path"))).select(
        "path", extension(F.col("path")).alias("ext"), F.col("modificationTime").alias("mtime"), F.col("length").alias("n_bytes"), "content",
        F.when(by_ending == "", language_of_name(name)).otherwise(by_ending).alias("language"),
    )


def notes(spark: SparkSession, folder: str) -> DataFrame:
    """The notes below ``folder``, as :func:`scan` gives them."""
    return scan(spark, folder, NOTES)


def corpus(spark: SparkSession, folder: str, limit: int | None = LIMIT) -> DataFrame:
    """(path, ext, mtime, n_bytes, markdown, error): every file as Markdown; what can't be converted has an error instead.

    Structured formats above ``limit`` bytes have an error, as they must be held whole; without a limit all are converted.
    """
    rows = scan(spark, folder)
    done = to_markdown(F.col("ext"), F.col("content"), limit)
    return rows.select("path", "ext", "mtime", "n_bytes", done.alias("r")).select("path", "ext", "mtime", "n_bytes", "r.markdown", "r.error")


def recent(rows: DataFrame, most: int = 10) -> DataFrame:
    return rows.orderBy(F.desc("mtime"), "path").limit(most)


def read_lines(rows: DataFrame, first: int = 1, last: int | None = None) -> DataFrame:
    """``rows`` with ``markdown`` cut to the lines from ``first`` to ``last``, counted from 1."""
    lines = F.split("markdown", "\n")
    size = F.greatest(F.lit(0), (F.lit(last) if last is not None else F.size(lines)) - first + 1)
    return rows.withColumn("markdown", F.array_join(F.slice(lines, F.lit(first), size), "\n"))


def write_corpus(rows: DataFrame, folder: str, mode: str = "errorifexists") -> None:
    """Write a corpus as parquet by extension; ``mode`` is errorifexists, append or overwrite."""
    rows.write.mode(mode).partitionBy("ext").parquet(folder)
