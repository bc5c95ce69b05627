"""Most similar vectors of the same model (problem 6).

Method, multiprobe p-stable hashing: a table hashes a unit vector by ``functions`` quantised Gaussian projections,
``floor((a.x + b) / width)``. A query visits its own bucket and then the buckets next to it, in the order of
their estimated success, which follows from how near the projections lie to the edges of their cells. Candidates
of all tables are merged and reranked by exact cosine.

Two uses of the one index:

* :func:`close_pairs` finds, for every vector, the neighbours of at least a given cosine. Every vector goes to its few likeliest
  buckets of each table, so a pair meets if any bucket of the one is any of the other: few probes on both sides stand for their
  square on one side. Only (bucket, id, 128 sign bits) are shuffled; the bits drop candidates that can't be close (bound 4 standard
  deviations out), and vectors are joined to what is left. Buckets of more than ``BLOCK`` rows are split into blocks.
* :func:`nearest` answers a query set with the k nearest. Vectors travel with their buckets and a bucket's queries and
  rows meet as matrices. A bucket is worked off in blocks of at most ``BLOCK`` rows and queries, so a hot one is split.

Equal vectors form a class that is indexed once; of a class only its ``k + 1`` least ids can be among anyone's k nearest,
ties being broken by the lesser id, so the rest of a class need not travel. That is exact.

Unusable vectors (null, empty, another length, all zero, not finite, or with null inside) take no part. Rows repeated with the
same id count once. Null models form no group and take no part.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.llm import cells
from vellum.session import materialize
from vellum.tables import load, spread

DIMENSION = 64
K = 10
COSINE = 0.9
QUERY_EVERY = 50
BLOCK = 4096

#: Width of cells and probes of a table for close pairs, and the share of pairs at exactly the cosine that the tables must find.
CLOSE_WIDTH, CLOSE_PROBES, CLOSE_RECALL = 2.0, 5, 0.985


def close_index(rows: int, cosine: float) -> tuple[int, int, float, int]:
    """(tables, functions, width, probes) for close pairs among so many rows.

    One function more for each doubling keeps the buckets as small as they are; tables are added until, of random pairs at
    exactly the cosine, the share ``CLOSE_RECALL`` meets.
    """
    functions = 12 + max(0, round(np.log2(max(1, rows) / 500_000)))
    rng = np.random.default_rng(11)
    x, y = (rng.standard_normal((4000, DIMENSION)) for _ in range(2))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    y -= (x * y).sum(1, keepdims=True) * x
    y = cosine * x + np.sqrt(1 - cosine**2) * y / np.linalg.norm(y, axis=1, keepdims=True)
    none = np.zeros(len(x), np.uint64)
    tables = 4
    while True:
        a, b = (buckets(v, none, tables, functions, CLOSE_WIDTH, CLOSE_PROBES) for v in (x, y))
        if (a[..., :, None] == b[..., None, :]).any((1, 2, 3)).mean() >= CLOSE_RECALL:
            return tables, functions, CLOSE_WIDTH, CLOSE_PROBES
        tables += 1


def near_index(rows: int) -> tuple[int, int, float, int]:
    """(tables, functions, width, probes) for the k nearest among so many rows: one function more for each threefold of the rows,
    and twice the probes with it, so that a query visits a share of the rows that falls as they grow."""
    more = max(0, round(np.log(max(1, rows) / 200_000) / np.log(3)))
    return 4, 4 + more, 1.1, 60 << min(more, 6)


_MIX = np.uint64(0xFF51AFD7ED558CCD)
_PLANES = np.random.default_rng(77).standard_normal((DIMENSION, 128))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


@lru_cache(maxsize=8)
def projections(tables: int, functions: int, width: float) -> tuple[np.ndarray, np.ndarray]:
    rng = np.random.default_rng(4242)
    return rng.standard_normal((DIMENSION, tables * functions)), rng.uniform(0, width, tables * functions)


@lru_cache(maxsize=8)
def probe_sets(functions: int, probes: int) -> list[list[int]]:
    """Sets of ranks of perturbations in the order of their expected score; the first is empty.

    A query's ``2 x functions`` perturbations, one either way per function, are ranked by the squared distance to the edge
    they cross. Rank j and rank ``2 x functions - 1 - j`` belong to the same function, so a set never holds both.
    """
    m = functions
    j = np.arange(1, 2 * m + 1)
    low = j * (j + 1) / (4 * (m + 1) * (m + 2))
    high = 1 - (2 * m + 1 - j) / (m + 1) + (2 * m + 1 - j) * (2 * m + 2 - j) / (4 * (m + 1) * (m + 2))
    cost = np.where(j <= m, low, high)
    out: list[list[int]] = [[]]
    heap = [(cost[0], [0])]
    while heap and len(out) < probes:
        score, ranks = heapq.heappop(heap)
        if all(2 * m - 1 - r not in ranks for r in ranks):
            out.append(ranks)
        last = ranks[-1]
        if last + 1 < 2 * m:
            heapq.heappush(heap, (score - cost[last] + cost[last + 1], [*ranks[:-1], last + 1]))
            heapq.heappush(heap, (score + cost[last + 1], [*ranks, last + 1]))
    return out


def buckets(x: np.ndarray, model: np.ndarray, tables: int, functions: int, width: float, probes: int) -> np.ndarray:
    """Bucket keys of unit vectors, (rows, tables, probes); the first probe is the vector's own bucket."""
    a, b = projections(tables, functions, width)
    place = (x @ a + b) / width
    cell = np.floor(place)
    to_low = place - cell
    cell = cell.astype(np.int64).reshape(len(x), tables, functions)
    low = (to_low**2).reshape(len(x), tables, functions)
    high = ((1 - to_low) ** 2).reshape(len(x), tables, functions)
    rank = np.argsort(np.concatenate([low, high], axis=2), axis=2)
    function = rank % functions
    step = np.where(rank < functions, -1, 1)
    factor = _mixed(np.arange(1, functions + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
    base = (cell.astype(np.uint64) * factor).sum(axis=2, dtype=np.uint64)
    moved = step.astype(np.int64).astype(np.uint64) * factor[function]
    salt = _mixed(model.astype(np.uint64)[:, None] + np.arange(tables, dtype=np.uint64)[None, :] * np.uint64(0xC2B2AE3D27D4EB4F))
    out = np.empty((len(x), tables, min(probes, len(probe_sets(functions, probes)))), np.uint64)
    for i, ranks in enumerate(probe_sets(functions, probes)):
        key = base
        for r in ranks:
            key = key + moved[:, :, r]
        out[:, :, i] = _mixed(_mixed(key) ^ salt)
    return out.view(np.int64)


def signs(x: np.ndarray) -> np.ndarray:
    """128 sign bits of random projections, as two int64."""
    return np.packbits(x @ _PLANES > 0, axis=1, bitorder="little").view(np.int64)


def sign_bound(cosine: float) -> int:
    p = float(np.arccos(cosine) / np.pi)
    return int(128 * p + 4 * (128 * p * (1 - p)) ** 0.5)


def _matrix(lists: pa.ListArray, width: int) -> np.ndarray:
    flat = np.asarray(lists.flatten(), np.float64)
    return flat.reshape(-1, width)


def usable(vector: Column) -> Column:
    """Whether the vector has the right length, is finite throughout and not all zero."""
    fine = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return (F.size(vector) == DIMENSION) & fine & F.exists(vector, lambda v: v != 0)


def unit_classes(vectors: DataFrame, k: int = K) -> tuple[DataFrame, DataFrame]:
    """Classes of equal directions (class_id, model, x), and their members (class_id, vec_id, place)."""
    rows = vectors.where(F.col("model").isNotNull() & usable(F.col("vector"))).select("vec_id", "model", "vector")

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("vector"), DIMENSION)
            x = x / np.abs(x).max(axis=1, keepdims=True)
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            name = np.zeros((2, len(x)), np.uint64)
            rounded = np.round(x.astype(np.float64) * 1e6).astype(np.int64).astype(np.uint64)
            for i in range(DIMENSION):
                for h in range(2):
                    name[h] = _mixed(name[h] * np.uint64(2 * h + 3) + rounded[:, i] + np.uint64(i + h))
            ends = np.arange(len(x) + 1, dtype=np.int32) * DIMENSION
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("vec_id"), batch.column("model"), pa.ListArray.from_arrays(pa.array(ends), pa.array(x.ravel())),
                    pa.array(name[0].view(np.int64)), pa.array(name[1].view(np.int64)),
                ],
                names=["vec_id", "model", "x", "n0", "n1"],
            )

    rows = materialize(
        rows.mapInArrow(unit, "vec_id bigint, model string, x array<float>, n0 bigint, n1 bigint"), "knn-unit"
    )
    key = ["model", "n0", "n1"]
    # the k + 1 least ids of a class, combined before the shuffle; an array never grows beyond that
    least = rows.select(*key, "vec_id").distinct().groupBy(*key).agg(F.min("vec_id").alias("class_id"), F.count("*").alias("size"))
    classes = rows.join(least.select("model", F.col("class_id").alias("vec_id")), ["model", "vec_id"], "left_semi")
    classes = classes.dropDuplicates(["vec_id"]).select(F.col("vec_id").alias("class_id"), "model", "x")
    members = rows.select(*key, "vec_id").distinct().join(least, key).select("model", "class_id", "size", "vec_id")
    return materialize(classes, "knn-classes"), materialize(members, "knn-members")


def close_pairs(classes: DataFrame, cosine: float = COSINE, index: tuple | None = None) -> DataFrame:
    """(a, b, cosine) with a < b: classes of the same model at least that close."""
    tables, functions, width, probes = index or close_index(classes.count(), cosine)

    def hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x = _matrix(batch.column("x"), DIMENSION)
            model = np.array([hash_name(m) for m in batch.column("model").to_pylist()], np.uint64)
            keys = buckets(x, model, tables, functions, width, probes)
            s = signs(x)
            ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (tables * keys.shape[2]))
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("class_id"), pa.array(s[:, 0].copy()), pa.array(s[:, 1].copy()),
                    pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1))),
                ],
                names=["id", "s0", "s1", "keys"],
            )

    signed = classes.mapInArrow(hashed, "id bigint, s0 bigint, s1 bigint, keys array<bigint>")
    signed = materialize(signed, "knn-signed")
    rows = signed.select("id", "s0", "s1", F.explode("keys").alias("key"))
    differ = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
    crowd = cells.crowded(rows, ["key"], BLOCK)
    pair = lambda: [F.col("a.id").alias("a"), F.col("b.id").alias("b")]
    candidates = cells.meetings(rows, ["key"], crowd, BLOCK, differ <= sign_bound(cosine), pair).distinct()
    side = lambda n: classes.select(F.col("class_id").alias(n), F.col("x").alias(f"x{n}"), F.col("model").alias(f"m{n}"))
    dot = F.aggregate(F.arrays_zip("xa", "xb"), F.lit(0.0), lambda s, z: s + z["xa"].cast("double") * z["xb"].cast("double"))
    return (
        candidates.join(side("a"), "a")
        .join(side("b"), "b")
        .where(F.col("ma") == F.col("mb"))
        .select("a", "b", dot.alias("cosine"))
        .where(F.col("cosine") >= cosine)
    )


def hash_name(name: str) -> int:
    h = 0xCBF29CE484222325
    for byte in name.encode():
        h = (h ^ byte) * 0x100000001B3 & 0xFFFFFFFFFFFFFFFF
    return h


def mutual_neighbours(vectors: DataFrame, k: int = K, cosine: float = COSINE) -> DataFrame:
    """(vec_a, vec_b, cosine): pairs at least that close, each among the k most similar of the other."""
    classes, members = unit_classes(vectors, k)
    links = materialize(close_pairs(classes, cosine), "knn-links")
    by_id = Window.partitionBy("model", "class_id").orderBy("vec_id")
    # only the k + 1 least ids of a class can be anyone's neighbours
    leading = members.where(F.col("size") > 1).withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1)
    single = members.where(F.col("size") == 1).withColumn("place", F.lit(1))
    leading = materialize(leading.unionByName(single).select("class_id", "vec_id"), "knn-leading")
    both = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"), "cosine"))
    same = members.where(F.col("size") > 1).select("class_id").distinct()
    both = both.unionByName(same.select(F.col("class_id").alias("a"), F.col("class_id").alias("b"), F.lit(1.0).alias("cosine")))
    neighbours = (
        both.join(leading.select(F.col("class_id").alias("a"), F.col("vec_id").alias("v")), "a")
        .join(leading.select(F.col("class_id").alias("b"), F.col("vec_id").alias("u")), "b")
        .where(F.col("v") != F.col("u"))
    )
    nearest_first = Window.partitionBy("v").orderBy(F.desc("cosine"), "u")
    best = materialize(
        neighbours.select("v", "u", "cosine").withColumn("r", F.row_number().over(nearest_first)).where(F.col("r") <= k).drop("r"),
        "knn-best",
    )
    back = best.select(F.col("u").alias("v"), F.col("v").alias("u"))
    return best.join(back, ["v", "u"]).where(F.col("v") < F.col("u")).select(
        F.col("v").alias("vec_a"), F.col("u").alias("vec_b"), "cosine"
    )


def nearest(vectors: DataFrame, queries: DataFrame, k: int = K, index: tuple | None = None) -> DataFrame:
    """(vec_id, rank, neighbour, cosine): the k most similar rows of the same model for each query row."""
    classes, members = unit_classes(vectors, k)
    tables, functions, width, probes = index or near_index(classes.count())
    asked = members.join(queries.select("vec_id").distinct(), "vec_id", "left_semi").select("vec_id", "class_id")

    def keyed(n_probes: int):
        def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                x = _matrix(batch.column("x"), DIMENSION)
                model = np.array([hash_name(m) for m in batch.column("model").to_pylist()], np.uint64)
                keys = buckets(x, model, tables, functions, width, n_probes)
                ends = pa.array(np.arange(len(x) + 1, dtype=np.int32) * (tables * keys.shape[2]))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("class_id"), batch.column("x"), pa.ListArray.from_arrays(ends, pa.array(keys.reshape(-1)))],
                    names=["id", "x", "keys"],
                )

        return work

    schema = "id bigint, x array<float>, keys array<bigint>"
    rows = classes.mapInArrow(keyed(1), schema).select("id", "x", F.explode("keys").alias("key"))
    held = classes.join(asked.select("class_id").distinct(), "class_id", "left_semi")
    probing = held.mapInArrow(keyed(probes), schema).select("id", "x", F.explode("keys").alias("key"))
    # a bucket is split into blocks of rows, and of queries; every block of one meets every block of the other
    sizes = rows.groupBy("key").agg(F.count("*").alias("n"))
    sizes = sizes.join(probing.groupBy("key").agg(F.count("*").alias("q")), "key")
    sizes = materialize(
        sizes.select(
            "key",
            F.ceil(F.col("n") / BLOCK).cast("int").alias("row_blocks"),
            F.ceil(F.col("q") / BLOCK).cast("int").alias("query_blocks"),
        ),
        "knn-blocks",
    )
    blocked = lambda df, mine, other: (
        df.join(sizes, "key")
        .withColumn(f"{mine}_block", F.pmod(F.xxhash64("id", F.lit(5)), F.col(f"{mine}_blocks")).cast("int"))
        .withColumn(f"{other}_block", F.explode(F.sequence(F.lit(0), F.col(f"{other}_blocks") - 1)))
        .select("key", "row_block", "query_block", "id", "x")
    )
    at = ["key", "row_block", "query_block"]

    def rerank(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({"q": pd.Series(dtype="int64"), "c": pd.Series(dtype="int64"), "cosine": pd.Series(dtype="float64")})
        rows_, asks = np.stack(left["x"].to_numpy()), np.stack(right["x"].to_numpy())
        score = asks.astype(np.float64) @ rows_.astype(np.float64).T
        most = min(k + 1, score.shape[1])
        best = np.argpartition(-score, most - 1, axis=1)[:, :most]
        take = np.take_along_axis(score, best, axis=1).ravel()
        return pd.DataFrame(
            {"q": np.repeat(right["id"].to_numpy(), most), "c": left["id"].to_numpy()[best.ravel()], "cosine": take}
        )

    found = (
        blocked(rows, "row", "query").groupBy(*at).cogroup(blocked(probing, "query", "row").groupBy(*at))
        .applyInPandas(rerank, "q bigint, c bigint, cosine double")
        .groupBy("q", "c").agg(F.max("cosine").alias("cosine"))
    )
    first = Window.partitionBy("q").orderBy(F.desc("cosine"), "c")
    found = found.withColumn("r", F.row_number().over(first)).where(F.col("r") <= k + 1).drop("r")
    by_id = Window.partitionBy("class_id").orderBy("vec_id")
    leading = members.withColumn("place", F.row_number().over(by_id)).where(F.col("place") <= k + 1).select("class_id", "vec_id")
    out = (
        found.join(asked.select(F.col("class_id").alias("q"), "vec_id"), "q")
        .join(leading.select(F.col("class_id").alias("c"), F.col("vec_id").alias("neighbour")), "c")
        .where(F.col("vec_id") != F.col("neighbour"))
    )
    ranked = Window.partitionBy("vec_id").orderBy(F.desc("cosine"), "neighbour")
    return (
        out.withColumn("rank", F.row_number().over(ranked).cast("bigint"))
        .where(F.col("rank") <= k)
        .select("vec_id", "rank", "neighbour", "cosine")
    )


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return mutual_neighbours(spread(load(spark, folder, "chunk_vectors"))).select("vec_a", "vec_b")


def p6_nearest(spark: SparkSession, folder: str) -> DataFrame:
    vectors = spread(load(spark, folder, "chunk_vectors"))
    return nearest(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


QUERIES = {"p6_found": p6_found, "p6_nearest": p6_nearest}
SQL = {
    "p6_found": """
WITH v AS (
  SELECT vec_id, any_value(model) AS model, any_value(vector) AS x FROM chunk_vectors
  WHERE model IS NOT NULL AND len(vector) = 64 AND len(list_filter(vector, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0
    AND len(list_filter(vector, lambda e: e <> 0)) > 0 GROUP BY vec_id),
pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b, list_cosine_similarity(a.x::DOUBLE[], b.x::DOUBLE[]) AS s
  FROM v a JOIN v b ON a.model = b.model AND a.vec_id <> b.vec_id),
best AS (SELECT a, b, s FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY round(s, 6) DESC, b) AS r FROM pairs WHERE s >= 0.9) WHERE r <= 10)
SELECT x.a AS vec_a, x.b AS vec_b FROM best x JOIN best y ON x.a = y.b AND x.b = y.a WHERE x.a < x.b"""
}
