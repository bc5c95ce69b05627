"""Reading the parquet tables of a data folder."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def load(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def key_columns(df: DataFrame) -> list[str]:
    """The columns a row can be compared by; maps can't be and are left out."""
    return [f.name for f in df.schema.fields if not isinstance(f.dataType, T.MapType)]


def latest(df: DataFrame, keys: list[str], by: str, columns: list[str]) -> DataFrame:
    """One row per ``keys``: the one with the latest ``by``; ties fall to the greatest ``columns``.

    An aggregate rather than a window, so rows of a hot key are combined before the shuffle.
    """
    best = F.max(F.struct(F.col(by).alias("_by"), *[F.col(c) for c in columns]))
    grouped = df.groupBy(*keys).agg(best.alias("_best"))
    return grouped.select(*keys, F.col("_best._by").alias(by), *[F.col(f"_best.{c}") for c in columns])


def spread(df: DataFrame, *columns: str | Column) -> DataFrame:
    """Spread a scan of few files over all cores before expensive row-wise work.

    A table in one file is one split whatever the cores; a table in many files is left as it is,
    so at scale nothing is shuffled.
    """
    spark = df.sparkSession
    cores = spark.sparkContext.defaultParallelism
    if len(df._jdf.inputFiles()) * 4 >= cores:  # counted in the JVM, where the names stay
        return df
    return df.repartition(cores, *columns) if columns else df.repartition(cores)
