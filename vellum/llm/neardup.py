"""Near-duplicate records by their sets of terms (problem 5).

Method, tensored banding: each of two small collections holds ``ROWS``-long bands of minhashes, and a table's
key is a pair of one band from either, so ``BANDS`` squared tables of ``2 x ROWS`` hashes cost only
``2 x BANDS x ROWS`` minhashes. A pair of records is a candidate if it agrees in a key of any table. The
tables are not all written out: records meet on the band of the first collection, and the second half of the
key is compared in the join, so most records are shuffled ``BANDS`` times, not ``BANDS`` squared. Only where more than ``HOT``
records share a first band (minhashes that fell on common terms) do they go to the full keys of both bands, and where more
than ``BLOCK`` share a full key they are split into blocks, every block meeting every other. Both keep all candidates.

A pair of similarity s meets with probability ``(1 - (1 - s^ROWS)^BANDS)^2``: 0.9969 at 0.8, 0.9997 at 0.85.
Candidates must have sizes and a 128-bit one-bit minhash sketch that similarity 0.8 allows (the sketch
bound lies 4.5 standard deviations out); the rest is verified exactly on the sets.

Records with equal sets form a class first; only one of a class is hashed into tables, so a group of
copies of any size costs one record. Sets are compared by 64-bit hashes of their terms. Joins on classes are salted by their sizes.

Null terms and sets of fewer than ``LEAST_TERMS`` distinct terms take no part. Rows repeated with the same id
count once.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm import cells
from vellum.operators.skew import salted_join
from vellum.session import materialize
from vellum.tables import load, spread

SIMILARITY = 0.8
LEAST_TERMS = 10
ROWS = 3
BANDS = 9
SKETCH = 128
#: Records that may meet on a first band, and on a full key, before they are split further.
HOT = 256
BLOCK = 2048
#: Candidate ids are broadcast to the scan that fetches their sets up to this many, else joined by shuffle.
MAX_BROADCAST_IDS = 500_000

_rng = np.random.default_rng(20_240_601)
_A = _rng.integers(1, 2**63, 2 * BANDS * ROWS + SKETCH // 2, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _rng.integers(0, 2**63, len(_A), dtype=np.uint64)
_MIX = np.uint64(0xFF51AFD7ED558CCD)


def text_terms(text: Column) -> Column:
    """Distinct lower-case runs of letters or digits."""
    return F.array_distinct(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda t: t != ""))


def term_hashes(terms: Column) -> Column:
    return F.transform(terms, lambda t: F.xxhash64(t))


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(33))) * _MIX
    return x ^ (x >> np.uint64(29))


def signatures(values: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bands of the first collection, of the second, and sketches of the sets ``values[offsets[i]:offsets[i+1]]``."""
    n = len(offsets) - 1
    starts = offsets[:-1]
    x = _mixed(values.view(np.uint64))
    k = 2 * BANDS * ROWS
    mins = np.empty((k, n), np.uint64)
    for i in range(k):
        mins[i] = np.minimum.reduceat(_mixed(x * _A[i] + _B[i]) >> np.uint64(16), starts)
    bands = np.zeros((2 * BANDS, n), np.uint64)
    for b in range(2 * BANDS):
        for r in range(ROWS):
            bands[b] = _mixed(bands[b] * _A[r] + mins[b * ROWS + r] + np.uint64(b + 1))
    # one multiplication gives two minhashes of 32 bits, and each of them one bit of the sketch
    sketch = np.zeros((SKETCH // 64, n), np.uint64)
    low = np.uint64(0xFFFFFFFF)
    for i in range(SKETCH // 2):
        h = _mixed(x * _A[k + i] + _B[k + i])
        for half, part in enumerate((h >> np.uint64(32), h & low)):
            bit = np.minimum.reduceat(part, starts) & np.uint64(1)
            at = 2 * i + half
            sketch[at // 64] |= bit << np.uint64(at % 64)
    return bands[:BANDS], bands[BANDS:], sketch


_SIGNED = "tbl string, id bigint, set_a bigint, set_b bigint, n_terms int, first array<bigint>, second array<int>, s0 bigint, s1 bigint"


def _sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if not batch.num_rows:
            continue
        lists = batch.column("terms")
        offsets = np.asarray(lists.offsets, np.int64)
        values = np.asarray(lists.values, np.int64)[offsets[0] : offsets[-1]]
        offsets = offsets - offsets[0]
        first, second, sketch = signatures(values, offsets)
        u = values.view(np.uint64)
        # two independent sums name the set
        set_a = np.add.reduceat(_mixed(u * _A[0]), offsets[:-1])
        set_b = np.add.reduceat(_mixed(u * _A[1] + _B[1]), offsets[:-1])
        n = batch.num_rows
        lists_of = lambda m, t: pa.ListArray.from_arrays(
            pa.array(np.arange(n + 1, dtype=np.int32) * BANDS), pa.array(np.ascontiguousarray(m.T).ravel().astype(t))
        )
        yield pa.RecordBatch.from_arrays(
            [
                batch.column("tbl"), batch.column("id"), pa.array(set_a.view(np.int64)), pa.array(set_b.view(np.int64)),
                pa.array(np.diff(offsets).astype(np.int32)),
                lists_of(first.view(np.int64), np.int64),
                lists_of((second >> np.uint64(33)).astype(np.int64), np.int32),
                pa.array(sketch[0].view(np.int64)), pa.array(sketch[1].view(np.int64)),
            ],
            names=["tbl", "id", "set_a", "set_b", "n_terms", "first", "second", "s0", "s1"],
        )


def sketch_bound(similarity: float) -> int:
    """The most sketch bits that a pair of at least this similarity differs in."""
    p = (1 - similarity) / 2
    return int(SKETCH * p + 4.5 * (SKETCH * p * (1 - p)) ** 0.5)


def sets_of(documents: DataFrame, chunks: DataFrame) -> DataFrame:
    """(tbl, id, terms): hashed sets of both tables that have enough terms."""
    of_documents = documents.where(F.col("tf").isNotNull()).select(
        F.lit("documents").alias("tbl"), F.col("doc_id").alias("id"), F.map_keys("tf").alias("terms")
    )
    of_chunks = chunks.where(F.col("text").isNotNull()).select(
        F.lit("chunks").alias("tbl"), F.col("chunk_id").alias("id"), text_terms(F.col("text")).alias("terms")
    )
    rows = of_documents.unionByName(of_chunks).where(F.size("terms") >= LEAST_TERMS)
    return rows.withColumn("terms", term_hashes(F.col("terms")))


class NearDuplicates:
    """Members of classes, and the links between classes, of one run over a table of sets."""

    def __init__(self, sets: DataFrame, similarity: float = SIMILARITY):
        signed = sets.mapInArrow(_sign, _SIGNED)
        self.similarity = similarity
        # every class is led by its least id; its signature is the same for all members
        signed = materialize(signed, "neardup-signed")
        of = ["tbl", "set_a", "set_b"]
        leader = materialize(signed.groupBy(*of).agg(F.min("id").alias("class_id"), F.count("*").alias("size")), "neardup-leaders")
        self.members = materialize(
            salted_join(signed.select("tbl", "id", "set_a", "set_b"), leader.drop("size"), of, leader, "size")
            .select("tbl", "id", "class_id")
            .distinct(),
            "neardup-members",
        )
        self.sizes = leader.select("tbl", "class_id", "size")
        leaders = signed.join(
            leader.select("tbl", F.col("class_id").alias("id")).distinct(), ["tbl", "id"], "left_semi"
        ).dropDuplicates(["tbl", "id"])
        self.links = materialize(self._verified(sets, self._candidates(leaders)), "neardup-links")

    def _candidates(self, leaders: DataFrame) -> DataFrame:
        cell = ["tbl", "band", "key"]
        first = leaders.select("tbl", "id", "n_terms", "second", "s0", "s1", F.posexplode("first").alias("band", "key"))
        marked = cells.marked(first, cells.crowded(first, cell, HOT), cell)
        # the full keys of hot first bands, one for each band of the second collection
        full = marked.where("n is not null").withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(BANDS - 1))))
        full = full.withColumn("key", F.xxhash64("key", "band", "j", F.get("second", F.col("j")))).withColumn("band", F.lit(BANDS)).drop("n", "j")
        rows = materialize(marked.where("n is null").drop("n").unionByName(full), "neardup-cells")
        crowd = cells.crowded(rows.where(F.col("band") == BANDS), cell, BLOCK)
        size = lambda x, y: F.col(x) >= F.col(y) * F.lit(self.similarity)
        differ = F.bit_count(F.col("a.s0").bitwiseXOR(F.col("b.s0"))) + F.bit_count(F.col("a.s1").bitwiseXOR(F.col("b.s1")))
        second = reduce(lambda x, y: x | y, [F.get("a.second", F.lit(i)) == F.get("b.second", F.lit(i)) for i in range(BANDS)])
        able = size("a.n_terms", "b.n_terms") & size("b.n_terms", "a.n_terms") & (differ <= sketch_bound(self.similarity)) & second
        pair = lambda: [F.col("a.tbl").alias("tbl"), F.col("a.id").alias("a"), F.col("b.id").alias("b")]
        return cells.meetings(rows, cell, crowd, BLOCK, able, pair).distinct()

    def _verified(self, sets: DataFrame, candidates: DataFrame) -> DataFrame:
        candidates = materialize(candidates, "neardup-candidates")
        ids = candidates.select("tbl", F.explode(F.array("a", "b")).alias("id")).distinct()
        n = ids.count()
        wanted = sets.join(F.broadcast(ids) if n <= MAX_BROADCAST_IDS else ids, ["tbl", "id"], "left_semi")
        wanted = wanted.dropDuplicates(["tbl", "id"])
        side = lambda x: wanted.select("tbl", F.col("id").alias(x), F.col("terms").alias(f"of_{x}"))
        both = F.size(F.array_intersect("of_a", "of_b"))
        return (
            candidates.join(side("a"), ["tbl", "a"])
            .join(side("b"), ["tbl", "b"])
            .withColumn("both", both)
            .withColumn("similarity", F.col("both") / (F.size("of_a") + F.size("of_b") - F.col("both")))
            .where(F.col("similarity") >= self.similarity)
            .select("tbl", "a", "b", "similarity")
        )

    def pairs(self) -> DataFrame:
        """(tbl, id_a, id_b): all pairs of records, copies included, as the problem defines its result."""
        m = self.members
        other = lambda x: m.select("tbl", F.col("id").alias(f"id_{x}"), F.col("class_id").alias(x))
        sizes = lambda x: self.sizes.withColumnRenamed("class_id", x)
        between = salted_join(other("a"), self.links, ["tbl", "a"], sizes("a"), "size")
        between = salted_join(other("b"), between, ["tbl", "b"], sizes("b"), "size")
        within = salted_join(other("a"), other("b").withColumnRenamed("b", "a"), ["tbl", "a"], sizes("a"), "size")
        within = within.where(F.col("id_a") < F.col("id_b"))
        columns = ["tbl", F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")]
        return between.select(*columns).unionByName(within.select(*columns))

    def groups(self) -> DataFrame:
        """(tbl, id, class_id, group_id, n_links): one row per record. ``group_id`` is the least id of the records
        that chains of links connect; ``n_links`` counts other classes linked to the record's own.

        Labels only fall and are ids of the records, so the rounds end; they go on until none changes."""
        edges = self.links.select("tbl", F.col("a").alias("x"), F.col("b").alias("y"))
        edges = materialize(edges.unionByName(edges.select("tbl", F.col("y").alias("x"), F.col("x").alias("y"))), "neardup-edges")
        degree = materialize(edges.groupBy("tbl", F.col("x").alias("class_id")).agg(F.count("*").alias("n_links")), "neardup-degree")
        n_edges = edges.count()
        far_ends = degree.select("tbl", F.col("class_id").alias("y"), "n_links")
        label = materialize(edges.groupBy("tbl", "x").agg(F.least(F.min("y"), F.col("x")).alias("g")), "neardup-label")
        while True:
            # the least label among the neighbours, then the label of that label
            near = (
                salted_join(edges, label.select("tbl", F.col("x").alias("y"), "g"), ["tbl", "y"], far_ends, "n_links", total=n_edges)
                .groupBy("tbl", "x")
                .agg(F.min("g").alias("near"))
            )
            new = label.join(near, ["tbl", "x"]).select("tbl", "x", F.col("g").alias("old"), F.least("g", "near").alias("g"))
            jump = label.select("tbl", F.col("x").alias("g"), F.col("g").alias("far"))
            new = materialize(
                new.join(jump, ["tbl", "g"], "left").select(
                    "tbl", "x", "old", F.least("g", F.coalesce("far", "g")).alias("g")
                ),
                "neardup-label",
            )
            label = new.select("tbl", "x", "g")
            if new.where(F.col("old") != F.col("g")).isEmpty():
                break
        named = label.select("tbl", F.col("x").alias("class_id"), F.col("g").alias("group_id")).join(degree, ["tbl", "class_id"])
        return salted_join(self.members, named, ["tbl", "class_id"], self.sizes, "size", "left").select(
            "tbl",
            "id",
            "class_id",
            F.coalesce("group_id", "class_id").alias("group_id"),
            F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"),
        )


def _of(spark: SparkSession, folder: str) -> NearDuplicates:
    documents = load(spark, folder, "documents").select("doc_id", "tf")
    chunks = load(spark, folder, "chunks").select("chunk_id", "text")
    return NearDuplicates(sets_of(spread(documents), spread(chunks)))


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return _of(spark, folder).pairs()


def p5_groups(spark: SparkSession, folder: str) -> DataFrame:
    return _of(spark, folder).groups()


QUERIES = {"p5_found": p5_found, "p5_groups": p5_groups}
SQL = {
    "p5_found": """
WITH sets AS (
  SELECT DISTINCT 'documents' AS tbl, doc_id AS id, unnest(map_keys(tf)) AS t FROM documents WHERE tf IS NOT NULL
  UNION SELECT 'chunks', chunk_id, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')) FROM chunks WHERE text IS NOT NULL),
sized AS (SELECT tbl, id, count(*) AS n FROM sets GROUP BY ALL HAVING count(*) >= 10),
held AS (SELECT s.tbl, s.id, s.t, z.n FROM sets s JOIN sized z USING (tbl, id)),
ranked AS (
  SELECT h.tbl, h.id, h.t, h.n, row_number() OVER (PARTITION BY h.tbl, h.id ORDER BY d.df, h.t) AS r
  FROM held h JOIN (SELECT tbl, t, count(*) AS df FROM held GROUP BY ALL) d USING (tbl, t)),
prefix AS (SELECT tbl, id, t, n FROM ranked WHERE r <= n - ceil(0.8 * n) + 1),
candidate AS (
  SELECT DISTINCT a.tbl, a.id AS id_a, b.id AS id_b, a.n AS na, b.n AS nb FROM prefix a JOIN prefix b USING (tbl, t)
  WHERE a.id < b.id AND a.n >= 0.8 * b.n AND b.n >= 0.8 * a.n),
shared AS (
  SELECT c.tbl, c.id_a, c.id_b, c.na, c.nb, count(*) AS k FROM candidate c
  JOIN held a ON a.tbl = c.tbl AND a.id = c.id_a JOIN held b ON b.tbl = c.tbl AND b.id = c.id_b AND b.t = a.t GROUP BY ALL)
SELECT tbl, id_a, id_b FROM shared WHERE k::DOUBLE / (na + nb - k) >= 0.8"""
}
