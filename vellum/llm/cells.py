"""Self-joins of rows that meet in cells (buckets, bands), where a cell may hold any share of the rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vellum.operators.skew import salted_join
from vellum.session import materialize

#: Crowded cells are broadcast up to this many (some 24 bytes each), else joined by shuffle.
MAX_BROADCAST_CELLS = 300_000


def crowded(rows: DataFrame, cell: list[str], most: int) -> DataFrame:
    """(cell, n) of the cells that more than ``most`` rows hold, counted on the map side first."""
    return materialize(rows.groupBy(*cell).agg(F.count("*").alias("n")).where(F.col("n") > most), "cells-crowded")


def marked(rows: DataFrame, crowd: DataFrame, cell: list[str]) -> DataFrame:
    """``rows`` with the count of their cell if it is crowded, else null."""
    if crowd.count() <= MAX_BROADCAST_CELLS:
        return rows.join(F.broadcast(crowd), cell, "left")
    return salted_join(rows, crowd, cell, crowd, "n", "left")


def meetings(rows: DataFrame, cell: list[str], crowd: DataFrame, block: int, able: Column, out: Callable[[], list]) -> DataFrame:
    """Pairs ``a``, ``b`` of rows of one cell with ``a.id < b.id`` that ``able`` allows, as the columns ``out`` gives.

    ``crowd`` holds the cells of more than ``block`` rows: these are split into blocks by a hash of the id, and each block meets
    each other, so a cell of n rows costs (n / block) squared tasks' worth of work and not one task.
    """

    def meet(left: DataFrame, right: DataFrame, on: list[str]) -> DataFrame:
        a, b = left.alias("a"), right.alias("b")
        same = F.col("a.id") < F.col("b.id")
        for c in on:
            same = same & (F.col(f"a.{c}") == F.col(f"b.{c}"))
        return a.join(b, same & able).select(*out())

    if crowd.isEmpty():
        return meet(rows, rows, cell)
    every = marked(rows, crowd, cell)
    calm, packed = every.where("n is null").drop("n"), every.where("n is not null")
    parts = F.ceil(F.col("n") / block).cast("int")
    packed = packed.withColumn("own", F.pmod(F.xxhash64("id", F.lit(9)), parts).cast("int"))
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    left = packed.withColumn("x", F.col("own")).withColumn("y", other).drop("n", "own")
    right = packed.withColumn("y", F.col("own")).withColumn("x", other).drop("n", "own")
    return meet(calm, calm, cell).unionByName(meet(left, right, [*cell, "x", "y"]))
