"""Reading level of a text against graded reference texts (problem 3).

Method: one smoothed unigram language model per grade; a text gets the grade under which its words are likeliest. Grades are in
order, so a grade's model also takes in the words of the grades next to it (weights ``KERNEL``): a word that only the texts of
grade 2 hold speaks for grade 1 rather than for grade 5. The share of a word's *class* (its length and last two letters, or its
length alone where few words end so) speaks for words that no text holds.

The models are trained on the graded texts and then on seeded ones: all texts at hand are levelled, and the words of those whose
level leads by ``SEED_MARGIN`` are added to their grade; this is done ``ROUNDS`` times. Sixty short texts hold about half of the
words that occur; the seeds bring in the rest. Rows repeated with the same key count as one text: each has its share.

The model is a table of words with one log-probability per grade, made and kept as a Spark table whatever its size. Up to
``MAX_VOCABULARY`` words are broadcast; of a larger table the most frequent are, and the words left over meet the others by a
shuffle. The texts are exploded to words, joined and summed per row, all in the JVM.

Only English prose is levelled: enough words, enough English function words among them, and more of those than
of any other language; code, lists of names and tables have few. Front matter, headings, bullets, quotes, link targets and
wrapping don't matter. Other texts get a null level. Null and empty texts have none. Rows repeated with the
same id count once. Without graded texts all grades are equally likely and the lowest is given.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.llm.quality import COMMON_WORDS
from vellum.session import materialize
from vellum.tables import load, spread

GRADES = (1, 2, 3, 4, 5)
SEED_MARGIN = 0.05
#: How often the texts are levelled anew for seeds.
ROUNDS = 2
#: So many words of the model are broadcast; more are joined by a shuffle.
MAX_VOCABULARY = 200_000
#: A text's count is this; it is divided evenly among up to 16 rows of one key, so that counts stay whole and sums exact.
WHOLE = 720_720
#: Weight of a grade's own words and of those of a grade next to it.
KERNEL = (1.0, 0.3)
#: Weight of a word's own share against that of its class.
OWN = 0.85
#: So many words of the vocabulary must share length and ending to be a class.
LEAST_ALIKE = 5
LONGEST = 14
LEAST_WORDS = 8
LEAST_COMMON = 0.2

_WORD = re.compile(r"[^\W\d_]+")
#: What stands between words: link targets, addresses, and all that is no letter. ``++`` never goes back: Java matches it in a
#: loop, but ``+`` by a call for each character, and a few thousand of them overflow the stack and end the executor.
SPLIT = r"(?:\]\([^()\s]*\)|https?://\S+|[^\p{L}])++"
_COLUMNS = [f"g{g}" for g in GRADES]
_UNSEEN = [f"e{g}" for g in GRADES]
_COUNTS = [f"n{g}" for g in GRADES]

Counts = Mapping[int, Counter]


@dataclass
class Model:
    """(word, n, g1 to g5) of the words counted, (ending, e1 to e5) of the endings that are classes, and e1 to e5 by length."""

    seen: DataFrame
    ends: DataFrame
    sizes: list[list[float]]


def count_words(texts: list[tuple[int, str]]) -> dict[int, Counter]:
    """Words per grade."""
    words = {g: Counter() for g in GRADES}
    for grade, text in texts:
        if text is not None and grade in words:
            words[grade].update(_WORD.findall(text.lower()))
    return words


def classes_of(word: str) -> tuple[str, str]:
    """The classes a word may be in: length and ending, length; 14 letters and more are one length."""
    n = min(len(word), LONGEST)
    return f"{n}:{word[-2:]}", str(n)


def _near(kernel: tuple[float, ...]) -> list[list[float]]:
    """Weights of all grades in the model of each."""
    near = [[kernel[abs(i - j)] if abs(i - j) < len(kernel) else 0.0 for j in GRADES] for i in GRADES]
    return [[x / sum(row) for x in row] for row in near]


def fit(words: Counts, own: float = OWN, kernel: tuple[float, ...] = KERNEL) -> tuple[dict[str, list[float]], dict[str, list[float]]]:
    """Log-probabilities per grade: of each word counted, and of one that isn't, by its class. :func:`fit_table` is the same over a table."""
    near = _near(kernel)
    smooth = lambda shares: [sum(k * s for k, s in zip(row, shares)) for row in near]
    totals = [max(1, sum(words[g].values())) for g in GRADES]
    vocabulary = sorted(set().union(*words.values()))
    alike = Counter(c for w in vocabulary for c in classes_of(w))
    class_of = lambda w: next((c for c in classes_of(w) if alike[c] >= LEAST_ALIKE), classes_of(w)[1])
    members = Counter(map(class_of, vocabulary))
    names = sorted(set(members) | {str(n) for n in range(LONGEST + 1)})
    held = {c: [0.0] * len(GRADES) for c in names}
    for i, g in enumerate(GRADES):
        for w, n in words[g].items():
            held[class_of(w)][i] += n / totals[i]
    each = {c: [(0.98 * s + 0.02 / len(names)) / (members[c] + 20) for s in smooth(held[c])] for c in names}
    seen = {}
    for w in vocabulary:
        shares = smooth([words[g][w] / total for g, total in zip(GRADES, totals)])
        seen[w] = [math.log(own * s + (1 - own) * e) for s, e in zip(shares, each[class_of(w)])]
    return seen, {c: [math.log((1 - own) * e) for e in es] for c, es in each.items()}


def _size() -> Column:
    return F.least(F.length("word"), F.lit(LONGEST))


def _ending() -> Column:
    return F.concat(_size(), F.lit(":"), F.right("word", F.lit(2)))


def _by_size(sizes: list[list[float]], i: int) -> Column:
    return F.element_at(F.array(*[F.lit(row[i]) for row in sizes]), _size() + 1)


def fit_table(counts: DataFrame) -> Model:
    """:func:`fit` over (word, n1 to n5), whole numbers of ``WHOLE`` a word; the words stay a table."""
    near = _near(KERNEL)
    sums = [F.sum(c).alias(c) for c in _COUNTS]
    alike = counts.groupBy(_ending().alias("ending"), _size().alias("size")).agg(F.count("*").alias("alike"), *sums)
    alike = materialize(alike, "level-endings")
    groups = alike.groupBy("size", (F.col("alike") >= LEAST_ALIKE).alias("own")).agg(
        F.count("*").alias("classes"), F.sum("alike").alias("alike"), *sums
    ).collect()
    totals = [float(max(WHOLE, sum(r[c] for r in groups))) for c in _COUNTS]
    names = sum(r["classes"] for r in groups if r["own"]) + LONGEST + 1
    floor = 0.02 / names

    def smooth(shares: list, row: list[float]) -> Column | float:
        return sum(k * s for k, s in zip(row, shares) if k)

    short = {r["size"]: r for r in groups if not r["own"]}
    held = [[short[n][c] / t if n in short else 0.0 for c, t in zip(_COUNTS, totals)] for n in range(LONGEST + 1)]
    members = [short[n]["alike"] if n in short else 0 for n in range(LONGEST + 1)]
    sizes = [[(0.98 * smooth(h, row) + floor) / (m + 20) for row in near] for h, m in zip(held, members)]
    shares = [F.col(c) / F.lit(t) for c, t in zip(_COUNTS, totals)]
    ends = alike.where(F.col("alike") >= LEAST_ALIKE).select(
        "ending", *[((0.98 * smooth(shares, row) + F.lit(floor)) / (F.col("alike") + 20)).alias(e) for row, e in zip(near, _UNSEEN)]
    )
    few = names <= MAX_VOCABULARY
    each = [F.coalesce(F.col(e), _by_size(sizes, i)) for i, e in enumerate(_UNSEEN)]
    seen = (
        counts.withColumn("ending", _ending()).join(F.broadcast(ends) if few else ends, "ending", "left")
        .select("word", sum(map(F.col, _COUNTS)).alias("n"), *[F.log(OWN * smooth(shares, row) + (1 - OWN) * e).alias(c) for row, e, c in zip(near, each, _COLUMNS)])
    )
    return Model(
        materialize(seen, "level-model"),
        ends.select("ending", *[F.log((1 - OWN) * F.col(e)).alias(e) for e in _UNSEEN]),
        [[math.log((1 - OWN) * x) for x in row] for row in sizes],
    )


def _as_tables(spark: SparkSession, model: tuple[dict, dict]) -> Model:
    """A model of :func:`fit` or :func:`train` as tables."""
    seen, unseen = model
    doubles = lambda names: ", ".join(f"{c} double" for c in names)
    return Model(
        spark.createDataFrame([(w, 0, *v) for w, v in seen.items()], f"word string, n long, {doubles(_COLUMNS)}"),
        spark.createDataFrame([(c, *v) for c, v in unseen.items() if ":" in c], f"ending string, {doubles(_UNSEEN)}"),
        [unseen[str(n)] for n in range(LONGEST + 1)],
    )


def _words() -> Column:
    """The words of a text; the first of those that it begins or ends with may be empty."""
    return F.split(F.lower("text"), SPLIT)


def _word_rows(texts: DataFrame, key: str) -> DataFrame:
    """(key, word): every word of every text, and one mark a row, which counts the rows of a key."""
    return texts.where(F.col("text").isNotNull()).select(key, F.explode(F.concat(F.array(F.lit("\x01")), _words())).alias("word")).where("word <> ''")


def _with_model(words: DataFrame, model: Model, marked: list[str]) -> DataFrame:
    """The rows with g1 to g5 of their word, null where the model hasn't counted it; ``marked`` are words looked up most."""
    spark = words.sparkSession
    known = spark.range(1).select(F.explode(F.split(F.lit(" ".join(marked)), " ")).alias("word"))
    table = materialize(model.seen.join(known.withColumn("known", F.lit(True)), "word", "full"), "level-words")
    if table.count() <= MAX_VOCABULARY:
        return words.join(F.broadcast(table.drop("n", "known")), "word", "left")
    often = table.orderBy(F.col("known").isNull(), F.desc("n"), "word").limit(MAX_VOCABULARY)
    often = materialize(often.select("word", *_COLUMNS, F.lit(True).alias("often")), "level-often")
    seldom = table.drop("n", "known").join(often.select("word"), "word", "left_anti")
    met = words.join(F.broadcast(often), "word", "left")
    rest = met.where("often is null").select(*words.columns).join(seldom, "word", "left")
    return met.where("often").drop("often").unionByName(rest)


def _scored(texts: DataFrame, key: str, model: Model, least_words: int) -> DataFrame:
    others = {w for lang in ("de", "fr", "es") for w in COMMON_WORDS[lang].split()}
    english = set(COMMON_WORDS["en"].split()) - {"me", "man", "an", "am", "die"}
    english |= {"i", "do", "go", "see", "put", "now", "here", "she", "is", "not"}
    others -= english
    few = model.ends.count() <= MAX_VOCABULARY
    real = F.col("word") != "\x01"
    times = lambda which: F.sum(F.when(which, 1).otherwise(0))
    value = lambda i, c: F.coalesce(c, _UNSEEN[i], _by_size(model.sizes, i))
    sums = (
        _with_model(_word_rows(texts, key), model, sorted(english | others))
        .withColumn("ending", F.when(F.col("g1").isNull() & real, _ending()))
        .join(F.broadcast(model.ends) if few else model.ends, "ending", "left")
        .groupBy(key)
        .agg(
            times(~real).alias("n_rows"),
            times(real).alias("n"),
            times(F.col("word").isin(*sorted(english))).alias("n_en"),
            times(F.col("word").isin(*sorted(others))).alias("n_other"),
            times(real & (F.length("word") == 1)).alias("n_single"),
            *[F.sum(F.when(real, value(i, c))).alias(c) for i, c in enumerate(_COLUMNS)],
        )
    )
    n = F.when(F.col("n") > 0, F.col("n"))
    lead = F.array_max(F.array(*_COLUMNS)) - F.get(F.sort_array(F.array(*_COLUMNS), asc=False), F.lit(1))
    return sums.select(
        key,
        "n_rows",
        (F.col("n") / F.col("n_rows")).cast("bigint").alias("n_words"),
        (F.col("n_en") / n).alias("common_words"),
        F.when(_is_english(least_words), _best(_COLUMNS)).alias("level"),
        (lead / n).alias("margin"),
    )


def _seed_counts(texts: DataFrame, key: str, levels: DataFrame) -> DataFrame:
    """(word, n1 to n5) over the texts whose level leads clearly; the rows of a key share its count."""
    sure = levels.where(F.col("level").isNotNull() & (F.col("margin") > SEED_MARGIN))
    sure = sure.select(key, "level", F.round(F.lit(WHOLE) / F.col("n_rows")).cast("bigint").alias("times"))
    words = texts.where(F.col("text").isNotNull()).join(sure.hint("shuffle_hash"), key)
    return _counts(words.select("level", "times", F.explode(_words()).alias("word")), "level")


def _counts(words: DataFrame, grade: str) -> DataFrame:
    """(word, n1 to n5) of (word, times, grade)."""
    each = [F.sum(F.when(F.col(grade) == g, F.col("times")).otherwise(0)).alias(c) for g, c in zip(GRADES, _COUNTS)]
    return words.where("word <> ''").groupBy("word").agg(*each)


def _trained(texts: DataFrame, key: str, graded: DataFrame, rounds: int) -> Model:
    """The models of the grades, trained on all graded texts and on seeds out of all ``texts``."""
    texts = texts.select(key, "text")
    rows = graded.where(F.col("grade").isin(*GRADES) & F.col("text").isNotNull())
    rows = rows.select("grade", F.lit(WHOLE).cast("bigint").alias("times"), F.explode(_words()).alias("word"))
    labelled = materialize(_counts(rows, "grade"), "level-graded")
    model = fit_table(labelled)
    if not model.seen.head(1):
        return model
    for _ in range(rounds):
        seeds = _seed_counts(texts, key, _scored(texts, key, model, LEAST_WORDS))
        both = labelled.unionByName(seeds).groupBy("word").agg(*[F.sum(c).alias(c) for c in _COUNTS])
        model = fit_table(materialize(both, "level-counts"))
    return model


def train(texts: DataFrame, key: str, graded: DataFrame, rounds: int = ROUNDS) -> tuple[dict, dict]:
    """The trained model as :func:`fit` gives it, brought to the driver: for a look at it, or for a later :func:`reading_level`."""
    model = _trained(texts, key, graded, rounds)
    seen = {r["word"]: [r[c] for c in _COLUMNS] for r in model.seen.collect()}
    return seen, {r["ending"]: [r[c] for c in _UNSEEN] for r in model.ends.collect()} | {str(n): row for n, row in enumerate(model.sizes)}


def reading_level(
    texts: DataFrame, key: str, graded: DataFrame, least_words: int = LEAST_WORDS, rounds: int = ROUNDS, model: tuple[dict, dict] | None = None
) -> DataFrame:
    """(key, n_words, common_words, level, margin) for each distinct ``key`` with text.

    ``level`` is null where the text isn't English prose; ``margin`` is the log-likelihood per word by which
    the level leads the next. A ``model`` of an earlier :func:`train` may be given, else one is trained.
    """
    tables = _as_tables(texts.sparkSession, model) if model else _trained(texts, key, graded, rounds)
    return _scored(texts, key, tables, least_words).drop("n_rows")


def _is_english(least_words: int) -> Column:
    n = F.col("n")
    return (
        (n >= least_words * F.col("n_rows"))
        & (F.col("n_en") >= LEAST_COMMON * n)
        & (F.col("n_en") > 2 * F.col("n_other"))
        & (F.col("n_single") <= 0.25 * n)
    )


def _best(columns: list[str]) -> Column:
    """The grade of the greatest sum; the lower of equals."""
    return F.array_position(F.array(*columns), F.greatest(*columns)).cast("int")


def _levels(spark: SparkSession, folder: str) -> DataFrame:
    chunks = spread(load(spark, folder, "chunks").select("chunk_id", "text"))
    return reading_level(chunks, "chunk_id", load(spark, folder, "graded_texts"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    band = F.when(F.col("level") == 1, "basic").when(F.col("level") == 5, "expert")
    return _levels(spark, folder).select("chunk_id", band.alias("band")).where("band is not null")


def p3_profile(spark: SparkSession, folder: str) -> DataFrame:
    """Chunks per source and level; null is no English prose."""
    source = load(spark, folder, "chunks").select("chunk_id", "source").dropDuplicates(["chunk_id"])
    return (
        source.join(_levels(spark, folder), "chunk_id", "left")
        .groupBy("source", "level")
        .agg(F.count("*").alias("n_chunks"), F.sum("n_words").alias("n_words"))
    )


QUERIES = {"p3_found": p3_found, "p3_profile": p3_profile}
SQL: dict[str, str] = {}
