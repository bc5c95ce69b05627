"""Joins whose keys may be hot."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vellum.tables import key_columns

#: No more than this many keys can each hold a 1/HOT_SHARE part of the rows, which bounds the broadcast.
HOT_SHARE = 400


def salted_join(
    big: DataFrame, small: DataFrame, keys: list[str], weights: DataFrame, weight: str, how: str = "inner", total: int | None = None
) -> DataFrame:
    """Join ``big`` with ``small`` on ``keys``, splitting hot keys of ``big``. ``total`` is the sum of the weights, if known.

    ``weights`` has one row per key with its number of ``big`` rows. A key that holds more than one
    in ``HOT_SHARE`` of all rows is hot, so there are fewer than ``HOT_SHARE`` of them and their list
    may be broadcast. Rows of a hot key go to as many partitions as its share asks for; its row of
    ``small`` is repeated as often. Other keys are joined as they are.
    """
    if total is None:
        total = weights.agg(F.sum(weight)).first()[0] or 0
    least = max(2000, total // HOT_SHARE)
    hot = weights.where(F.col(weight) > least).select(
        *keys, F.ceil(F.col(weight) / F.lit(least)).cast("int").alias("_parts")
    )
    hot = F.broadcast(hot)  # fewer than HOT_SHARE rows, as their weights sum to the total at most
    # by the row itself and not by chance: a task that is run again must send its rows where it sent them before
    spread_by = F.xxhash64(*[F.col(c) for c in key_columns(big)])
    left = big.join(hot, keys, "left").withColumn(
        "_salt", F.when(F.col("_parts").isNull(), 0).otherwise(F.pmod(spread_by, F.col("_parts"))).cast("int")
    ).drop("_parts")
    right = (
        small.join(hot, keys, "left")
        .withColumn("_salt", F.explode(F.sequence(F.lit(0), F.coalesce(F.col("_parts"), F.lit(1)) - 1)))
        .drop("_parts")
    )
    return left.join(right, [*keys, "_salt"], how).drop("_salt")
