"""The main body of web pages (problem 4).

Method, a recurrent block labeller: a page is read as the sequence of its leaf blocks. Each block is a vector of its tag path
(hashed), its words (hashed: the first and last by themselves, all of them as an average) and a few measures (length, link
share, place), all taken from the whole block; a bidirectional LSTM in numpy reads the whole
sequence both ways and labels every block as article or not, so a block is judged by all that stands around it.

No page comes labelled. The network is trained on a bounded sample of pages (about ``TRAIN_PAGES``, taken by a hash of their id)
that :func:`seed` labels by their structure; seeding uses what a page's tags say, which not every page says clearly, so tags, marks
and words are randomly hidden in training, and the network learns to judge by the rest. It is trained on the driver at the
start of a run, from a fixed seed, and broadcast: some tens of thousands of numbers.

Lines are those of the decoded text, split at newline characters, from 1. Null, empty and non-HTML data have no lines, nor have
resources that aren't main. Rows repeated with the same id and data count once.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.blocks import Block, blocks, decode
from vellum.tables import load, spread

TRAIN_PAGES = 900
#: Longer pages are trained on in windows of so many blocks, whose measures are those of the whole page.
TRAIN_BLOCKS = 400
#: Passes over the sample, and the batches a training has at least, however few pages there are.
EPOCHS, STEPS = 12, 240
HIDDEN = 40
TAG_BUCKETS, WORD_BUCKETS, WIDTH = 1024, 4096, 20
BATCH = 48

_DATE = re.compile(r"\b\d{4}-\d\d-\d\d\b|\b\d{1,2}[./]\d{1,2}[./]\d{2,4}\b")
_WORD = re.compile(r"[^\W\d_]+|©|»")
_LANDMARKS = ("article", "main", "nav", "aside", "footer", "header", "form")


# ------------------------------------------------------------------ seeding


def _body_of(page: list[Block]) -> int | None:
    """The element that holds the article, by the structure of the page; None if there seems to be none."""
    for tag in ("article", "main"):
        sizes: dict[int, int] = {}
        for b in page:
            for t, i in zip(b.path, b.ids):
                if t == tag:
                    sizes[i] = sizes.get(i, 0) + len(b.text)
        if sizes:
            return max(sizes, key=lambda i: sizes[i])
    held: dict[int, list[Block]] = {}
    tags: dict[int, str] = {}
    for b in page:
        for t, i in zip(b.path, b.ids):
            if t in ("div", "section", "td"):
                held.setdefault(i, []).append(b)
                tags[i] = t
    for b in page:
        if b.path[-1:] == ("h1",) and len(b.ids) > 1 and b.ids[-2] in held:
            return b.ids[-2]
    best, most = None, 0
    for i, inside in held.items():
        first = inside[0]
        if any(b.path[-1] in ("button", "h3", "h4") and i in b.ids[:-1] and len(b.ids) - b.ids.index(i) <= 2 for b in inside):
            continue
        text = sum(len(b.text.strip()) for b in inside)
        linked = sum(b.linked for b in inside)
        if linked > 0.3 * text or "©" in "".join(b.text for b in inside) or first.bold_first:
            continue
        alone = len(inside) == 1 and first.ids[-1] == i  # bare text: an article only where it stands by itself
        if len(inside) < 2 and not (alone and len(first.ids) <= 3 and text >= 80) and (alone or text < 60):
            continue
        if any(t in ("nav", "aside", "footer", "form") for b in inside for t in b.path):
            continue
        if text > most:
            best, most = i, text
    return best


def layout(page: list[Block]) -> str:
    """The kind of element that holds the article."""
    body = _body_of(page)
    for b in page:
        if body in b.ids:
            return "/".join(b.path[: b.ids.index(body) + 1])
    return ""


def seed(page: list[Block]) -> list[int]:
    """A label for each block by the structure of its page."""
    body = _body_of(page)
    if body is None:
        return [0] * len(page)
    out = []
    for b in page:
        if body not in b.ids:
            out.append(0)
            continue
        at = b.ids.index(body)
        tags, marks = b.path[at + 1 :], b.marked[at + 1 :]
        if not tags:
            label = not b.bold_first
        elif set(tags) & {"nav", "aside", "footer", "form", "button", "section", "header"} or b.jumps:
            label = False
        elif tags[0] == "p":
            label = not marks[0]
        elif tags[0] == "div":
            label = len(tags) == 1 and b.image and not b.bold_first
        elif tags[0] in ("h3", "h4", "h5") and b.links:
            label = False
        else:
            label = True
        out.append(int(label))
    return out


# ------------------------------------------------------------------ features


def _bucket(name: str, size: int) -> int:
    return zlib.crc32(name.encode()) % size


class _Known(dict):
    def __init__(self, size: int):
        super().__init__()
        self.size = size

    def __missing__(self, name: str) -> int:
        if len(self) > 200_000:
            self.clear()
        n = self[name] = 1 + _bucket(name, self.size - 1)
        return n


_TAG, _TERM = _Known(TAG_BUCKETS), _Known(WORD_BUCKETS)
TAGS, WORDS, MEASURES = 6, 10, 32


#: All words of blocks as hashed words with their share: which block, which word, its share of the block's words.
Bag = tuple[np.ndarray, np.ndarray, np.ndarray]


def features(page: list[Block]) -> tuple[np.ndarray, np.ndarray, np.ndarray, Bag]:
    """Hashed tag paths (blocks, TAGS), the first and last words hashed (blocks, WORDS), measures (blocks, MEASURES) and
    all words; bucket 0 is none."""
    n = len(page)
    tags = np.zeros((n, TAGS), np.int32)
    words = np.zeros((n, WORDS), np.int32)
    num = np.zeros((n, MEASURES), np.float32)
    inside: dict[int, int] = {}
    parents: set[int] = set()
    with_h1: set[int] = set()
    linked: dict[int, int] = {}
    chars: dict[int, int] = {}
    for b in page:
        for i in b.ids:
            inside[i] = inside.get(i, 0) + 1
            chars[i] = chars.get(i, 0) + len(b.text)
            linked[i] = linked.get(i, 0) + b.linked
        parents.update(b.ids[:-1])
        if b.path[-1:] == ("h1",):
            with_h1.update(b.ids[1:-1])
    before: Block | None = None
    at: list[int] = []
    term: list[int] = []
    share: list[float] = []
    for k, b in enumerate(page):
        path = [t + ("." if m else "") for t, m in zip(b.path, b.marked) if t != "html"]
        tags[k] = [
            _TAG[path[-1] if path else "-"], _TAG["<".join(path[-2:])], _TAG["<<".join(path[-3:])], _TAG["/".join(path)],
            _TAG["#" + "/".join(b.path[1:])], _TAG["^" + "/".join(path[1:3])],
        ]
        text = b.text.strip()
        found = _WORD.findall(text.lower())
        first, last = found[:7], found[7:][-3:]
        words[k, : len(first)] = [_TERM[w] for w in first]
        words[k, 7 : 7 + len(last)] = [_TERM["$" + w] for w in last]
        if found:
            counts = Counter(map(_TERM.__getitem__, found))
            at += [k] * len(counts)
            term += counts
            share += [c / len(found) for c in counts.values()]
        size = max(1, len(text))
        own = b.ids[-1] if b.ids else 0
        up = b.ids[-2] if len(b.ids) > 1 else 0
        top = b.ids[2] if len(b.ids) > 2 else own
        shared = len(set(b.ids) & set(before.ids)) if before else 0
        num[k] = [
            np.log(size) / 5, b.linked / size, min(b.links, 6) / 6, min(b.jumps, 3) / 3, b.bold_first, b.image, b.span,
            _DATE.search(text) is not None, text[-1:] in ".!?…", "©" in text, "»" in text or "|" in text, 1 / (1 + text.index(":") / 12) if ":" in text else 0.0,
            len(b.path) / 6, k / n, (n - k) / n, k / 40, own in parents, np.log1p(inside.get(own, 0)) / 3,
            np.log1p(inside.get(up, 0)) / 3, np.log1p(inside.get(top, 0)) / 3, linked.get(top, 0) / max(1, chars.get(top, 0)),
            linked.get(up, 0) / max(1, chars.get(up, 0)), own in with_h1 or up in with_h1, top in with_h1,
            (b.marked[-1] if b.marked else 0), (b.marked[-2] if len(b.marked) > 1 else 0), shared / 6,
            bool(before and before.ids[-1:] == b.ids[-1:]), bool(before and before.ids[-2:-1] == b.ids[-2:-1]),
            sum(t in _LANDMARKS for t in b.path), sum(map(str.isdigit, text)) / size,
            bool(b.path) and b.path[-1] in ("h1", "h2", "h3", "h4"),
        ]
        before = b
    return tags, words, num, (np.array(at, np.int32), np.array(term, np.int32), np.array(share, np.float32))


def _joined(bags: list[Bag]) -> Bag:
    if not bags:
        return np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32)
    at, term, share = (np.concatenate(x) for x in zip(*bags))
    return at, term, share


# ------------------------------------------------------------------ network


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Labeller:
    """A bidirectional LSTM over blocks with one logistic output per block."""

    def __init__(self, hidden: int = HIDDEN, width: int = WIDTH, random: int = 5):
        rng = np.random.default_rng(random)
        inputs = 3 * width + MEASURES
        draw = lambda *s: (rng.standard_normal(s) * (1 / np.sqrt(s[0]))).astype(np.float32)
        self.p = {
            "tag": (rng.standard_normal((TAG_BUCKETS, width)) * 0.1).astype(np.float32),
            "word": (rng.standard_normal((WORD_BUCKETS, width)) * 0.1).astype(np.float32),
            "out": draw(2 * hidden + inputs, 1),
            "bias": np.zeros(1, np.float32),
        }
        self.p["tag"][0] = self.p["word"][0] = 0
        for d in "fb":
            self.p["x" + d], self.p["h" + d] = draw(inputs, 4 * hidden), draw(hidden, 4 * hidden)
            self.p["b" + d] = np.zeros(4 * hidden, np.float32)
            self.p["b" + d][hidden : 2 * hidden] = 1
        self.hidden = hidden

    @classmethod
    def of(cls, numbers: dict[str, np.ndarray]) -> Labeller:
        """A labeller that was trained before."""
        model = cls.__new__(cls)
        model.p, model.hidden = numbers, len(numbers["hf"])
        return model

    def _inputs(self, tags, words, num, bag=None):
        nt = np.maximum(1, (tags > 0).sum(-1, keepdims=True))
        nw = np.maximum(1, (words > 0).sum(-1, keepdims=True))
        every = np.zeros((tags.shape[0] * tags.shape[1], self.p["word"].shape[1]), np.float32)
        if bag is not None and len(bag[0]):
            at, term, share = bag
            first = np.flatnonzero(np.diff(at, prepend=-1))  # a block's words stand together
            every[at[first]] = np.add.reduceat(self.p["word"][term] * share[:, None], first, axis=0)
        every = every.reshape(*tags.shape[:2], -1)
        x = np.concatenate([self.p["tag"][tags].sum(-2) / nt, self.p["word"][words].sum(-2) / nw, every, num], axis=-1)
        return x.astype(np.float32), nt, nw

    def _run(self, x, mask, d):
        """Hidden states of one direction; x is (batch, steps, inputs)."""
        n, steps, _ = x.shape
        hid = self.hidden
        order = range(steps) if d == "f" else range(steps - 1, -1, -1)
        pre = x @ self.p["x" + d] + self.p["b" + d]
        h, c = np.zeros((n, hid), np.float32), np.zeros((n, hid), np.float32)
        out = np.zeros((n, steps, hid), np.float32)
        kept = []
        for t in order:
            z = pre[:, t] + h @ self.p["h" + d]
            i, f, o = _sigmoid(z[:, :hid]), _sigmoid(z[:, hid : 2 * hid]), _sigmoid(z[:, 2 * hid : 3 * hid])
            g = np.tanh(z[:, 3 * hid :])
            m = mask[:, t : t + 1]
            c2 = f * c + i * g
            tc = np.tanh(c2)
            kept.append((t, h, c, i, f, o, g, tc, m))
            c = m * c2 + (1 - m) * c
            h = m * (o * tc) + (1 - m) * h
            out[:, t] = h
        return out, kept

    def scores(self, tags, words, num, mask, bag=None):
        x, _, _ = self._inputs(tags, words, num, bag)
        f, _ = self._run(x, mask, "f")
        b, _ = self._run(x, mask, "b")
        return _sigmoid((np.concatenate([f, b, x], axis=-1) @ self.p["out"])[..., 0] + self.p["bias"])

    def gradients(self, tags, words, num, mask, y, bag=None):
        hid = self.hidden
        x, nt, nw = self._inputs(tags, words, num, bag)
        f, kept_f = self._run(x, mask, "f")
        b, kept_b = self._run(x, mask, "b")
        every = np.concatenate([f, b, x], axis=-1)
        s = _sigmoid((every @ self.p["out"])[..., 0] + self.p["bias"])
        d_s = ((s - y) * mask / max(1, mask.sum()))[..., None].astype(np.float32)
        g = {"out": np.einsum("bti,btj->ij", every, d_s), "bias": d_s.sum((0, 1))}
        d_every = d_s @ self.p["out"].T
        d_x = d_every[..., 2 * hid :].copy()
        for d, kept, d_h_out in (("f", kept_f, d_every[..., :hid]), ("b", kept_b, d_every[..., hid : 2 * hid])):
            d_z = np.zeros((*x.shape[:2], 4 * hid), np.float32)
            d_h = np.zeros((len(x), hid), np.float32)
            d_c = np.zeros((len(x), hid), np.float32)
            g_h = np.zeros_like(self.p["h" + d])
            for t, h, c, i, f_, o, gg, tc, m in reversed(kept):
                d_h = d_h + d_h_out[:, t]
                dh, dc = d_h * m, d_c * m
                dc = dc + dh * o * (1 - tc**2)
                z = np.concatenate(
                    [dc * gg * i * (1 - i), dc * c * f_ * (1 - f_), dh * tc * o * (1 - o), dc * i * (1 - gg**2)], axis=1
                )
                d_z[:, t] = z
                g_h += h.T @ z
                d_h = z @ self.p["h" + d].T + d_h * (1 - m)
                d_c = dc * f_ + d_c * (1 - m)
            g["h" + d] = g_h
            g["x" + d] = np.einsum("bti,btj->ij", x, d_z)
            g["b" + d] = d_z.sum((0, 1))
            d_x += d_z @ self.p["x" + d].T
        w = self.p["tag"].shape[1]
        for name, ids, part, n in (("tag", tags, d_x[..., :w], nt), ("word", words, d_x[..., w : 2 * w], nw)):
            grad = np.zeros_like(self.p[name])
            each = np.broadcast_to((part / n)[..., None, :], (*ids.shape, w))
            np.add.at(grad, ids.reshape(-1), each.reshape(-1, w))
            if name == "word" and bag is not None:
                at, term, share = bag
                np.add.at(grad, term, d_x[..., 2 * w : 3 * w].reshape(-1, w)[at] * share[:, None])
            grad[0] = 0
            g[name] = grad
        return g


def _padded(pages: list[tuple], labels: list[list[int]] | None = None):
    steps = max(len(p[0]) for p in pages)
    n = len(pages)
    tags, words = np.zeros((n, steps, TAGS), np.int32), np.zeros((n, steps, WORDS), np.int32)
    num, mask, y = np.zeros((n, steps, MEASURES), np.float32), np.zeros((n, steps), np.float32), np.zeros((n, steps), np.float32)
    bags = []
    for k, (a, b, c, (at, term, share)) in enumerate(pages):
        bags.append((at + k * steps, term, share))
        tags[k, : len(a)], words[k, : len(a)], num[k, : len(a)], mask[k, : len(a)] = a, b, c, 1
        if labels is not None:
            y[k, : len(a)] = labels[k]
    return tags, words, num, mask, y, _joined(bags)


def _windows(made: tuple, labels: list[int], size: int = TRAIN_BLOCKS) -> list[tuple[tuple, list[int]]]:
    """The features and labels of a page, cut into windows of at most ``size`` blocks."""
    tags, words, num, (at, term, share) = made
    out = []
    for low in range(0, len(labels), size):
        high = low + size
        inside = (at >= low) & (at < high)
        bag = (at[inside] - low, term[inside], share[inside])
        out.append(((tags[low:high], words[low:high], num[low:high], bag), labels[low:high]))
    return out


def train(pages: list[list[Block]], epochs: int = EPOCHS, random: int = 5, steps: int = STEPS) -> Labeller:
    """A labeller trained on the pages that can be seeded."""
    rng = np.random.default_rng(random)
    pages = [p for p in pages if p]
    model = Labeller(random=random)
    if not pages:
        return model
    # pages of a rare layout are repeated, so that each layout has a fair share
    layouts = [layout(p) for p in pages]
    times = {k: min(6, max(1, round(len(pages) / (12 * layouts.count(k))))) for k in set(layouts)}
    made = [_windows(features(p), seed(p)) for p in pages]
    seeded = [w for m, k in zip(made, layouts) for _ in range(times[k]) for w in m]
    first = {k: np.zeros_like(v) for k, v in model.p.items()}
    second = {k: np.zeros_like(v) for k, v in model.p.items()}
    step = 0
    lengths = np.array([len(s[1]) for s in seeded])
    epochs = max(epochs, -(-steps // -(-len(seeded) // BATCH)))
    total = epochs * -(-len(seeded) // BATCH)
    for epoch in range(epochs):
        # batches of pages about as long, in random order
        order = np.argsort(lengths + rng.uniform(0, 6, len(seeded)), kind="stable")
        batches = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for j in rng.permutation(len(batches)):
            batch = [seeded[i] for i in batches[j]]
            tags, words, num, mask, y, bag = _padded([b[0] for b in batch], [b[1] for b in batch])
            tags = np.where(rng.random(tags.shape) < 0.15, 0, tags)
            tags[..., 1:] *= rng.random((len(batch), 1, 1)) > 0.4  # a page known by its last tags only
            words = np.where(rng.random(words.shape) < 0.3, 0, words)
            seen = rng.random(len(bag[0])) >= 0.3
            bag = bag[0][seen], bag[1][seen], bag[2][seen]
            num = num * (rng.random((len(batch), 1, MEASURES)) > 0.05)
            grads = model.gradients(tags, words, num.astype(np.float32), mask, y, bag)
            norm = np.sqrt(sum(float((g**2).sum()) for g in grads.values()))
            step += 1
            rate = 0.012 * min(1, step / 20) * (0.1 + 0.9 * (1 - step / total))
            for k, g in grads.items():
                g = g * min(1, 2 / (norm + 1e-9))
                first[k] = 0.9 * first[k] + 0.1 * g
                second[k] = 0.98 * second[k] + 0.02 * g**2
                model.p[k] -= rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.98**step)) + 1e-8)
    return model


def label(model: Labeller, pages: list[list[Block]]) -> list[np.ndarray]:
    """The probability of being article, for each block of each page."""
    out: list[np.ndarray] = [np.zeros(0)] * len(pages)
    order = sorted((i for i, p in enumerate(pages) if p), key=lambda i: len(pages[i]))
    at = 0
    while at < len(order):
        # a batch is bounded by its padded size, so one very long page doesn't blow it up
        some = [order[at]]
        while len(some) < 128 and at + len(some) < len(order) and len(pages[order[at + len(some)]]) * (len(some) + 1) <= 20_000:
            some.append(order[at + len(some)])
        found = [features(pages[i]) for i in some]
        tags, words, num, mask, _, bag = _padded(found)
        s = model.scores(tags, words, num, mask, bag)
        for k, i in enumerate(some):
            out[i] = s[k, : len(pages[i])]
        at += len(some)
    return out


# ------------------------------------------------------------------ Spark


def page_blocks(data: bytes | None) -> list[Block]:
    return [b for b in blocks(decode(data)) if b.path]


def html_resources(resources: DataFrame) -> DataFrame:
    mime = F.lower(F.coalesce("mime_type", F.lit("text/html")))
    return resources.where(
        F.coalesce("is_main", F.lit(True)) & F.col("data").isNotNull() & (mime.contains("html") | mime.contains("xml"))
    ).select("resource_id", "data")


def fit(resources: DataFrame, most: int = TRAIN_PAGES) -> Labeller:
    """A labeller fitted on about ``most`` pages, the same ones at every run: those whose ids hash low enough.

    The share to take follows from a count of the ids, so only the pages of the sample are brought over. It may be kept with
    :func:`save` and given to later runs."""
    n = resources.select("resource_id").distinct().count()
    part = 1 << 30
    low = F.pmod(F.xxhash64("resource_id", F.lit(4)), F.lit(part)) < int(part * min(1.0, most / max(1, n)))
    sample = resources.where(low).dropDuplicates(["resource_id"]).collect()
    return train([page_blocks(r["data"]) for r in sorted(sample, key=lambda r: (r["resource_id"], bytes(r["data"])))])


def save(model: Labeller, path: str) -> None:
    """Keep a labeller's numbers in a file."""
    np.savez_compressed(path, **model.p)


def restore(path: str) -> Labeller:
    with np.load(path) as kept:
        return Labeller.of(dict(kept))


def main_body_lines(resources: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(resource_id, line_no) of the lines that show text of the page's article; repeated rows repeat."""
    pages = html_resources(resources)
    shared = resources.sparkSession.sparkContext.broadcast((model or fit(pages)).p)

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net = Labeller.of(shared.value)
        for batch in batches:
            for start in range(0, len(batch), 256):
                some = batch.iloc[start : start + 256]
                parsed = [page_blocks(d) for d in some["data"]]
                ids, lines = [], []
                for rid, page, score in zip(some["resource_id"], parsed, label(net, parsed)):
                    kept = sorted({n for b, s in zip(page, score) if s >= 0.5 for n in b.lines})
                    ids += [rid] * len(kept)
                    lines += kept
                yield pd.DataFrame({"resource_id": ids, "line_no": lines}, dtype="int64")

    return pages.mapInPandas(work, "resource_id bigint, line_no bigint")


def lines_per_page(resources: DataFrame, model: Labeller | None = None) -> DataFrame:
    """(resource_id, n_lines): one row for each main resource, 0 where nothing is found, as in those empty or not HTML."""
    pages = resources.where(F.coalesce("is_main", F.lit(True))).select("resource_id").distinct()
    lines = main_body_lines(resources, model).distinct().groupBy("resource_id").agg(F.count("*").alias("n"))
    return pages.join(lines, "resource_id", "left").select("resource_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_lines"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return main_body_lines(spread(load(spark, folder, "web_resources"))).distinct()


def p4_pages(spark: SparkSession, folder: str) -> DataFrame:
    """For each page: how many of its lines show text of its article."""
    return lines_per_page(spread(load(spark, folder, "web_resources")))


QUERIES = {"p4_found": p4_found, "p4_pages": p4_pages}
SQL: dict[str, str] = {}
