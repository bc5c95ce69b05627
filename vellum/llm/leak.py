"""Evaluation passages in training documents (problem 9).

Method: items and documents are cut into windows of words, at every place, in two sizes. *Item-sized* windows have the largest
size of ``SIZES`` that the item holds, so the whole of an item, or nearly, is compared at once; *passage-sized* windows have
``WINDOW`` words, the least that counts as leaked, as an item may leak in part only. A window's fingerprint is the 64-bit SimHash
of its words. Fingerprints within ``RADIUS`` bits of an item window's are found by a multi-index: the 64 bits form ``RADIUS + 1``
blocks, and two fingerprints that differ in at most ``RADIUS`` bits agree in one block at least, so no such pair is missed.

Candidates are verified exactly. Item-sized ones by the weighted similarity of their shingles of ``SHINGLE`` words
(:func:`similarity`), from ``SIMILARITY`` on: this finds items whose copy was edited, which may share no passage unchanged.
Passage-sized ones must have the same words in the same order; since equal windows have equal fingerprints, none is missed.

:func:`leaks` gives both; ``p9_found`` takes the pairs that share a passage, as the problem defines it.

The items are a fixed table; its windows are broadcast if they are at most ``MAX_ITEM_WINDOWS``, else the
items are worked off in blocks of that many windows, each block one more pass over the documents.

Words are maximal runs of letters or digits, in lower case. Null and short texts share nothing. An item
of fewer than ``WINDOW`` words can't leak.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pandas as pd
import regex
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.tables import load, spread

WINDOW = 12
#: Sizes of item-sized windows, each about half as large again as the one before; lanes of a byte count up to 127 words.
SIZES = (12, 18, 27, 40, 60, 90)
RADIUS = 3
#: Words of a shingle, and the similarity from which a window is a near copy.
SHINGLE = 5
SIMILARITY = 0.8
MAX_ITEM_WINDOWS = 2_000_000
#: Words of documents fingerprinted at once; bounds a worker's memory, not what is read.
AT_ONCE = 60_000

_WORD = regex.compile(r"[\p{L}\p{N}]+")
_PRIME = np.uint64(0x9E3779B97F4A7C15)


class _Hashes(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


_HASH = _Hashes()


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def hashes(tokens: list[str]) -> np.ndarray:
    return np.fromiter(map(_HASH.__getitem__, tokens), np.uint64, len(tokens))


def simhashes(h: np.ndarray, windows: tuple[int, ...]) -> list[np.ndarray]:
    """SimHash of every run of as many word hashes, for each size of window; the sign of each bit's votes.

    A number holds the votes of eight bits in lanes of a byte. Running sums overflow from lane to lane, but the difference of two
    of them is the sum over a window, whose lanes don't overflow, so it comes out right.
    """
    if max(windows) > 127:
        raise ValueError(f"windows of at most 127 words, not {max(windows)}")
    out = [np.zeros(max(0, len(h) - w + 1), np.uint64) for w in windows]
    ones, top = np.uint64(0x0101010101010101), np.uint64(0x8080808080808080)
    for bit in map(np.uint64, range(8)):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum((h >> bit) & ones, out=total[1:])
        for w, to in zip(windows, out):
            if len(to):
                votes = total[w:] - total[:-w]
                votes += np.uint64(128 - (w // 2 + 1)) * ones
                votes &= top
                to |= votes >> (np.uint64(7) - bit)
    return out


def simhash(h: np.ndarray, window: int) -> np.ndarray:
    return simhashes(h, (window,))[0]


def rolling(h: np.ndarray, window: int) -> np.ndarray:
    """Order-sensitive hash of every run of ``window`` word hashes."""
    n = len(h) - window + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out = np.zeros(n, np.uint64)
    for i in range(window):
        out = out * _PRIME + h[i : i + n]
    return out


def similarity(a: tuple[str, ...], b: tuple[str, ...]) -> float:
    """Weighted Jaccard similarity of the shingles of ``SHINGLE`` words of two windows; a shingle weighs the characters of
    its words, each time it occurs."""
    counts = [Counter(zip(*(w[i:] for i in range(min(SHINGLE, len(w)))))) for w in (a, b)]
    weigh = lambda c: sum(n * sum(map(len, s)) for s, n in c.items())
    either = weigh(counts[0] | counts[1])
    return weigh(counts[0] & counts[1]) / either if either else 0.0


class MultiIndex:
    """Fingerprints of the windows of one size of some items, found by any within ``radius`` bits."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW, radius: int = RADIUS):
        self.window, self.radius = window, radius
        rows = [(item, tokens[i : i + window]) for item, tokens in items for i in range(len(tokens) - window + 1)]
        self.item = np.array([r[0] for r in rows], np.int64)
        self.words = [tuple(r[1]) for r in rows]
        grams = [hashes(list(w)) for w in self.words]
        self.print = np.array([simhash(g, window)[0] for g in grams], np.uint64)
        self.shingle = np.array([rolling(g, window)[0] for g in grams], np.uint64)
        edges = np.linspace(0, 64, radius + 2).astype(int)
        self.blocks = []
        for low, high in zip(edges, edges[1:]):
            mask = np.uint64((1 << int(high - low)) - 1)
            key = (self.print >> np.uint64(low)) & mask
            order = np.argsort(key, kind="stable")
            values, starts = np.unique(key[order], return_index=True)
            there = np.zeros(1 << int(high - low), bool) if high - low <= 20 else None
            if there is not None:
                there[values.astype(np.int64)] = True
            self.blocks.append((np.uint64(low), mask, values, np.append(starts, len(order)), order, there))

    def candidates(self, prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs (position, item window) within ``radius`` bits."""
        at, window = [], []
        for low, mask, values, starts, order, there in self.blocks:
            key = (prints >> low) & mask
            if there is not None:
                hit = np.flatnonzero(there[key.astype(np.int64)])
                slot = np.searchsorted(values, key[hit])
            else:
                slot = np.minimum(np.searchsorted(values, key), max(0, len(values) - 1))
                hit = np.flatnonzero(values[slot] == key) if len(values) else np.empty(0, np.int64)
                slot = slot[hit]
            counts = starts[slot + 1] - starts[slot]
            total = int(counts.sum())
            if not total:
                continue
            left = np.repeat(hit, counts)
            inside = np.arange(total) - np.repeat(np.cumsum(counts) - counts, counts)
            right = order[np.repeat(starts[slot], counts) + inside]
            near = np.bitwise_count(prints[left] ^ self.print[right]) <= self.radius
            at.append(left[near])
            window.append(right[near])
        if not at:
            return np.empty(0, np.int64), np.empty(0, np.int64)
        pairs = np.unique(np.concatenate(at) * len(self.print) + np.concatenate(window))
        return pairs // len(self.print), pairs % len(self.print)


class Indexes:
    """The multi-indexes of some items: one of passage-sized windows, and one for each size of item."""

    def __init__(self, items: list[tuple[int, list[str]]], window: int = WINDOW, radius: int = RADIUS):
        self.window = window
        self.parts = MultiIndex(items, window, radius)
        by_size: dict[int, list[tuple[int, list[str]]]] = {}
        for item, tokens in items:
            if fits := [s for s in SIZES if s <= len(tokens)]:
                by_size.setdefault(fits[-1], []).append((item, tokens))
        self.whole = [MultiIndex(some, size, radius) for size, some in sorted(by_size.items())]
        self.shingles = np.unique(np.concatenate([np.empty(0, np.uint64), *[rolling(hashes(t), SHINGLE) for _, t in items]]))

    def look(self, pending: list[tuple[int, list[str]]]) -> pd.DataFrame:
        """Pairs of these documents and items with their shared passages and greatest similarity."""
        h = hashes([w for _, tokens in pending for w in tokens])
        ends = np.cumsum([len(tokens) for _, tokens in pending])
        part, *prints = simhashes(h, (self.window, *[m.window for m in self.whole]))
        passages: dict[tuple[int, int], set] = {}
        at, window = self.parts.candidates(part)
        same = rolling(h, self.window)[at] == self.parts.shingle[window]
        for key, words_, w in _placed(self.parts, at[same], window[same], ends, pending):
            if words_ == self.parts.words[w]:
                passages.setdefault(key, set()).add(words_)
        near: dict[tuple[int, int], float] = {}
        bound = self._bound(h, pending)
        for index, some in zip(self.whole, prints):
            at, window = index.candidates(some)
            able = bound(at, index.window) >= SIMILARITY
            for key, words_, w in _placed(index, at[able], window[able], ends, pending):
                if near.get(key, 0.0) < 1.0 and (found := similarity(words_, index.words[w])) >= SIMILARITY:
                    near[key] = max(found, near.get(key, 0.0))
        rows = [(d, i, len(passages.get((d, i), ())), near.get((d, i), 0.0)) for d, i in {**passages, **near}]
        made = pd.DataFrame(rows, columns=["doc_id", "item_id", "n_shared", "similarity"])
        return made.astype({"doc_id": "int64", "item_id": "int64", "n_shared": "int64", "similarity": "float64"})


    def _bound(self, h: np.ndarray, pending: list[tuple[int, list[str]]]) -> Callable[[np.ndarray, int], np.ndarray]:
        """The most that a window can be similar to any item: the weight of its shingles that some item holds."""
        if not len(self.shingles) or len(h) < SHINGLE:
            return lambda at, window: np.zeros(len(at))
        sizes = np.zeros(len(h) + 1, np.int64)
        np.cumsum(np.fromiter((len(w) for _, tokens in pending for w in tokens), np.int64, len(h)), out=sizes[1:])
        weight = sizes[SHINGLE:] - sizes[:-SHINGLE]
        g = rolling(h, SHINGLE)
        held = self.shingles[np.minimum(np.searchsorted(self.shingles, g), len(self.shingles) - 1)] == g
        every, known = (np.concatenate([[0], np.cumsum(x)]) for x in (weight, weight * held))

        def bound(at: np.ndarray, window: int) -> np.ndarray:
            end = at + max(1, window - SHINGLE + 1)
            return (known[end] - known[at]) / np.maximum(1, every[end] - every[at])

        return bound


def _placed(index: MultiIndex, at: np.ndarray, window: np.ndarray, ends: np.ndarray, pending: list) -> Iterator[tuple]:
    """((document, item), words of the document's window, item window) of candidates; a window across two documents is none."""
    doc = np.searchsorted(ends, at, side="right")
    inside = at + index.window <= ends[doc]
    for d, a, w in zip(doc[inside], at[inside], window[inside]):
        number, tokens = pending[d]
        i = a - (ends[d] - len(tokens))
        yield (int(number), int(index.item[w])), tuple(tokens[i : i + index.window]), w


def leaks(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, n_shared, similarity): pairs that share ``n_shared`` passages of ``window`` words, and how similar the
    document's most similar item-sized window is, 0 below ``SIMILARITY``. Rows repeated with the same ids count once."""
    spark = documents.sparkSession
    # the bound is checked on a count before anything is brought over; an item's windows are twice its words at most
    n_words = F.size(F.split("text", r"[^\p{L}\p{N}]+")) * 2
    sized = items.where(F.col("text").isNotNull()).select("item_id", "text", n_words.alias("n"))
    total = sized.agg(F.sum("n")).first()[0] or 0
    passes = max(1, -(-total // MAX_ITEM_WINDOWS))
    found = []
    for part in range(passes):
        block = sized.where(F.pmod(F.xxhash64("item_id"), F.lit(passes)) == part)
        indexes = Indexes([(r["item_id"], words(r["text"])) for r in block.distinct().collect()], window, radius)
        shared = spark.sparkContext.broadcast(indexes)

        def look(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            indexes: Indexes = shared.value
            for batch in batches:
                pending, count = [], 0
                for doc, text in zip(batch["doc_id"].to_numpy(), batch["text"]):
                    tokens = words(text)
                    if len(tokens) < indexes.window:
                        continue
                    pending.append((doc, tokens))
                    count += len(tokens)
                    if count >= AT_ONCE:
                        yield indexes.look(pending)
                        pending, count = [], 0
                if pending:
                    yield indexes.look(pending)

        some = documents.where(F.col("text").isNotNull()).select("doc_id", "text")
        found.append(some.mapInPandas(look, "doc_id bigint, item_id bigint, n_shared bigint, similarity double"))
    rows = reduce(DataFrame.unionByName, found)
    return rows.groupBy("doc_id", "item_id").agg(F.max("n_shared").alias("n_shared"), F.max("similarity").alias("similarity"))


def shared_passages(documents: DataFrame, items: DataFrame, window: int = WINDOW, radius: int = RADIUS) -> DataFrame:
    """(doc_id, item_id, n_shared): pairs that share a passage, with how many windows of the item they share."""
    return leaks(documents, items, window, radius).where("n_shared > 0").select("doc_id", "item_id", "n_shared")


def _of(spark: SparkSession, folder: str) -> DataFrame:
    return leaks(spread(load(spark, folder, "documents")), load(spark, folder, "bench_items"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return _of(spark, folder).where("n_shared > 0").select("doc_id", "item_id")


def p9_items(spark: SparkSession, folder: str) -> DataFrame:
    """For each item: in how many documents a passage of it leaked, how much of it at most, and how many hold a near copy of it."""
    items = load(spark, folder, "bench_items").select("item_id", "task", "lang").dropDuplicates(["item_id"])
    found = _of(spark, folder).groupBy("item_id").agg(
        F.count_if(F.col("n_shared") > 0).alias("n_documents"),
        F.max("n_shared").alias("most_windows"),
        F.count_if(F.col("similarity") > 0).alias("n_near_copies"),
    )
    counts = [F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("n_documents", "most_windows", "n_near_copies")]
    return items.join(found, "item_id", "left").select("item_id", "task", "lang", *counts)


_GRAMS = """
WITH w AS (SELECT {key} AS id, regexp_extract_all(lower(text), '[\\p{{L}}\\p{{N}}]+') AS ws FROM {table} WHERE text IS NOT NULL)
SELECT DISTINCT id, array_to_string(ws[i:i+11], ' ') AS g FROM (SELECT id, ws, unnest(range(1, len(ws) - 10)) AS i FROM w WHERE len(ws) >= 12)
"""

QUERIES = {"p9_found": p9_found, "p9_items": p9_items}
SQL = {
    "p9_found": f"SELECT DISTINCT d.id AS doc_id, b.id AS item_id FROM ({_GRAMS.format(key='doc_id', table='documents')}) d"
    f" JOIN ({_GRAMS.format(key='item_id', table='bench_items')}) b USING (g)"
}
