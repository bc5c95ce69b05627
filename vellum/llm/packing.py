"""Filling containers of fixed capacity with documents (problem 8).

Method, a linear grouping scheme that plans on the histogram of sizes alone (at most ``capacity`` rows,
whatever the corpus) and leaves the documents where they are:

1. A document above the capacity is cut into full containers and a rest; nothing else is cut.
2. Large sizes, in falling order, form ``groups`` of equal cardinality; each is rounded up to the largest
   size in it. The configuration programme over these few sizes is solved by column generation (a simplex
   over patterns, priced by a knapsack), rounded down, and what is left over is packed first-fit.
3. The actual sizes take the places of the rounded ones, largest first; room that appears is known per run
   of equal containers.
4. Small sizes fill the room best-fit, largest first; what finds no room opens new containers.

The plan is, for every size, a list of rank ranges with the container they start at. Each item finds its
container from its size and its rank among the items of the size. Ranks come from counts per (size,
bucket of ids), so a size that very many documents share is not ranked in one task.

Null text and text without tokens takes no room: such documents are given no container and no row.
``doc_id`` is taken as unique.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm.tokens import document_tokens
from vellum.session import materialize
from vellum.tables import load, spread

CAPACITY = 3072
GROUPS = 16
#: Sizes above this part of the capacity are large.
LARGE = 1 / 6
#: Items of one size and bucket that are ranked in one task, about.
RANKED = 50_000


def _best_pattern(sizes: list[int], worth: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The pattern of most worth within the capacity (an unbounded knapsack)."""
    best = np.zeros(capacity + 1)
    take = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room], take[room] = best[room - 1], -1
        for i, s in enumerate(sizes):
            if s <= room and best[room - s] + worth[i] > best[room] + 1e-12:
                best[room], take[room] = best[room - s] + worth[i], i
    pattern, room = np.zeros(len(sizes), int), capacity
    while room > 0:
        if take[room] < 0:
            room -= 1
        else:
            pattern[take[room]] += 1
            room -= sizes[take[room]]
    return best[capacity], pattern


def configurations(sizes: list[int], demand: list[int], capacity: int) -> list[tuple[list[int], int]]:
    """Patterns and how often each is used, to hold ``demand`` items of the few ``sizes``."""
    k = len(sizes)
    columns = [np.eye(k, dtype=int)[i] * (capacity // sizes[i]) for i in range(k)]
    basis = np.array(columns, float).T
    x = np.linalg.solve(basis, np.array(demand, float))
    for _ in range(40 * k):
        dual = np.linalg.solve(basis.T, np.ones(k))
        worth, pattern = _best_pattern(sizes, dual, capacity)
        if worth <= 1 + 1e-7:
            break
        step = np.linalg.solve(basis, pattern.astype(float))
        ratio = [(x[i] / step[i], i) for i in range(k) if step[i] > 1e-9]
        if not ratio:
            break
        t, out = min(ratio)
        x = x - t * step
        x[out] = t
        basis[:, out] = pattern
    x = np.clip(x, 0, None)
    used = [([int(v) for v in basis[:, i]], int(x[i] + 1e-9)) for i in range(k) if x[i] >= 1]
    left = np.array(demand)
    for pattern, n in used:
        left = left - n * np.array(pattern)
    # the fractional rest, first-fit over the rounded sizes: fewer than a few containers a size
    rest: dict[tuple[int, ...], int] = {}
    left = np.clip(left, 0, None)
    while left.any():
        pattern, room = [0] * k, capacity
        for i in np.argsort([-s for s in sizes], kind="stable"):
            n = min(int(left[i]), room // sizes[i])
            pattern[i], room = n, room - n * sizes[i]
            left[i] -= n
        times = min([1 << 60, *[int(left[i]) // n for i, n in enumerate(pattern) if n]]) + 1
        left = left - (times - 1) * np.array(pattern)
        rest[tuple(pattern)] = rest.get(tuple(pattern), 0) + times
    return used + [(list(p), n) for p, n in rest.items()]


class Plan:
    """For each size: rank ranges and where they go. A range's item of rank r is in container
    ``first + (r - start + skip) // per``."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, int, int, int, int]] = []
        self.containers = 0

    def add(self, size: int, start: int, n: int, first: int, per: int, skip: int = 0) -> None:
        if n > 0:
            self.rows.append((size, start, start + n, first, per, skip))


def plan(histogram: dict[int, int], capacity: int = CAPACITY, groups: int = GROUPS, large: float = LARGE) -> Plan:
    out = Plan()
    room: dict[int, list[tuple[int, int]]] = {}  # free tokens: runs of (first container, containers)
    free: list[int] = []

    def keep(left: int, first: int, n: int) -> None:
        if n > 0 and left > 0:
            if left not in room:
                room[left] = []
                insort(free, left)
            room[left].append((first, n))

    bound = capacity * large
    big = sorted((s for s in histogram if s > bound), reverse=True)
    small = sorted((s for s in histogram if 0 < s <= bound), reverse=True)
    if big:
        total = sum(histogram[s] for s in big)
        share = -(-total // groups)
        group: list[list[list[int]]] = [[]]  # group: [size, first rank in size, n]
        filled = 0
        for s in big:
            done = 0
            while done < histogram[s]:
                if filled == share:
                    group.append([])
                    filled = 0
                n = min(histogram[s] - done, share - filled)
                group[-1].append([s, done, n])
                done, filled = done + n, filled + n
        # groups that round up to the same size are one
        merged: dict[int, list[list[int]]] = {}
        for g in group:
            merged.setdefault(g[0][0], []).extend(g)
        tops = list(merged)
        members = [merged[t] for t in tops]
        demand = [sum(n for _, _, n in m) for m in members]
        ends = [np.cumsum([n for _, _, n in m]) for m in members]
        at = [0] * len(tops)
        for pattern, times in configurations(tops, demand, capacity):
            # cut the run of equal containers where a group's actual size changes
            cuts = {0, times}
            for g, per in enumerate(pattern):
                if per:
                    for e in ends[g]:
                        q = (int(e) - at[g]) / per
                        cuts |= {c for c in (int(np.floor(q)), int(np.ceil(q))) if 0 < c < times}
            marks = sorted(cuts)
            for a, b in zip(marks, marks[1:]):
                load_ = 0
                for g, per in enumerate(pattern):
                    for j in range(per):
                        r = at[g] + a * per + j
                        if r < demand[g]:
                            load_ += members[g][int(np.searchsorted(ends[g], r, side="right"))][0]
                keep(capacity - load_, out.containers + a, b - a)
            for g, per in enumerate(pattern):
                if not per:
                    continue
                low, high = at[g], min(at[g] + per * times, demand[g])
                begin = 0
                for (s, first_rank, n), end in zip(members[g], ends[g]):
                    lo, hi = max(low, begin), min(high, int(end))
                    if lo < hi:
                        slot = lo - low
                        out.add(s, first_rank + lo - begin, hi - lo, out.containers + slot // per, per, slot % per)
                    begin = int(end)
                at[g] = high if high == demand[g] else at[g] + per * times
            out.containers += times
    for s in small:
        rank, n = 0, histogram[s]
        while n:
            i = bisect_left(free, s)
            if i == len(free):
                per = capacity // s
                m = -(-n // per)
                out.add(s, rank, n, out.containers, per)
                keep(capacity - per * s, out.containers, n // per)
                if n % per:
                    keep(capacity - (n % per) * s, out.containers + m - 1, 1)
                out.containers += m
                break
            left = free[i]
            first, count = room[left].pop()
            if not room[left]:
                del room[left]
                free.pop(i)
            per = left // s
            full = min(count, n // per)
            if full:
                out.add(s, rank, full * per, first, per)
                keep(left - per * s, first, full)
                rank, n = rank + full * per, n - full * per
                keep(left, first + full, count - full)
            else:
                out.add(s, rank, n, first, per)
                keep(left - n * s, first, 1)
                keep(left, first + 1, count - 1)
                n = 0
    return out


def pack(sizes: DataFrame, capacity: int = CAPACITY, groups: int = GROUPS) -> DataFrame:
    """(doc_id, n_tokens) to (doc_id, n_tokens, piece_no, n_pieces, piece_tokens, container_id)."""
    spark = sizes.sparkSession
    n = F.col("n_tokens")
    items = (
        sizes.where(n > 0)
        .withColumn("n_pieces", F.ceil(n / F.lit(capacity)).cast("bigint"))
        .withColumn("piece_no", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n_pieces") - 1)))
        .withColumn("size", F.least(F.lit(capacity).cast("bigint"), n - F.col("piece_no") * capacity).cast("int"))
    )
    total = sizes.count()
    buckets = max(4, total // RANKED)
    items = items.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece_no"), F.lit(buckets)))
    counts = items.groupBy("size", "bucket").agg(F.count("*").alias("n"))
    before = Window.partitionBy("size").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select("size", "bucket", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    # at most `capacity` rows come to the driver: one per size
    made = plan({r["size"]: r["n"] for r in counts.groupBy("size").agg(F.sum("n").alias("n")).collect()}, capacity, groups)
    rows = np.array(made.rows or [(0, 0, 0, 0, 1, 0)], np.int64)
    rows = rows[np.lexsort((rows[:, 1], rows[:, 0]))]
    shared = spark.sparkContext.broadcast(rows)

    @F.pandas_udf("bigint")
    def container(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        table = shared.value
        key = table[:, 0].astype(np.float64) * 2.0**40 + table[:, 1]
        for size, rank in batches:
            r = rank.to_numpy(np.int64)
            i = np.searchsorted(key, size.to_numpy(np.float64) * 2.0**40 + r, side="right") - 1
            _, start, _, first, per, skip = table[i].T
            yield pd.Series(first + (r - start + skip) // per)

    within = Window.partitionBy("size", "bucket").orderBy("doc_id", "piece_no")
    ranked = items.withColumn("_r", F.row_number().over(within) - 1).join(offsets, ["size", "bucket"])
    return ranked.select(
        "doc_id",
        "n_tokens",
        "piece_no",
        "n_pieces",
        F.col("size").cast("bigint").alias("piece_tokens"),
        container("size", F.col("_r") + F.col("offset")).alias("container_id"),
    )


def _packed(spark: SparkSession, folder: str) -> DataFrame:
    return pack(materialize(document_tokens(spread(load(spark, folder, "documents"))), "packing-sizes"))


def p8_found(spark: SparkSession, folder: str) -> DataFrame:
    """Documents the packing had to cut, being larger than a container."""
    return _packed(spark, folder).where("n_pieces > 1 and piece_no = 0").select("doc_id")


def p8_packing(spark: SparkSession, folder: str) -> DataFrame:
    return _packed(spark, folder)


QUERIES = {"p8_found": p8_found, "p8_packing": p8_packing}
SQL: dict[str, str] = {}
