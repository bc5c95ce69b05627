"""Text quality statistics per document, and prose told from lists, tables and junk (problem 10).

Method: two parts that meet in :func:`describe`.

* Word, symbol and punctuation ratios.
* Layout: vertical alignment of delimiters (how often neighbouring lines have the same separators at the same
  count or column), periodicity of indentation and autocorrelation of line lengths, measured per line and
  over the document.

Every line gets one of the classes prose, list, table or junk from its own ratios and from how it aligns with
its neighbours. Lines that read like prose by their words are then judged by the layout of the whole document:
they are entries of a list if :func:`_entry_score` says so, from their ends and starts, the document's ratios, the
period of its indentation and the autocorrelation of its line lengths; they are rows of a table if delimiters or
columns align over at least ``ALIGNED`` of the lines. A document is what most of its characters are. It is prose
if half of them are.

Null or blank text has null ratios and no kind. Texts of any length are read whole, line by line.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.tables import load, spread

# Common function words of the four languages with spaces between words.
COMMON_WORDS = {
    "en": "a after all an and any are as at be because been before both but by can could did do each enough few for "
    "from had has have he her his how if in instead into is it its many me more most my no nobody none not of often "
    "on one only or other others our out over she since so some than that the their them then there these they this "
    "those to too until up us was we were what when where which while who why will with would you your",
    "de": "aber alle als am an auch auf aus bei bis da das dem den denn der des die diese doch ein eine einem einen "
    "einer er es für gegen gibt hat haben heute ich ihr im in ist ja jede kann kaum kein keine man mehr mit morgen "
    "muss nach nicht noch nur ob oder ohne ohnehin schon seit sich sie sind so um und uns unter vom von vor war waren was "
    "wenn wer wie wir wird zu zum zur über",
    "fr": "à après au aux avant avec avons c'est car ce ces cette chaque comme dans de des deux du elle elles en encore est "
    "et eu il ils je jamais la le les leur lui mais ne ni nos notre nous on ont ou où par pas personne plus pour quand que "
    "qui sa sans se ses si son sont sous sur tout toutes très un une vers vous y déjà",
    "es": "a al ante aunque bajo como con cuando cual de del desde donde el ella ellos en entre era es esta este está "
    "están fue ha hace hacia han hasta hay la las lo los más me mi muy nadie ni no nos o otra otras otro para pero por porque "
    "que quien quién qué se según si sin sobre son su sus también tan te un una uno unos y ya",
}
_COMMON = frozenset(w for s in COMMON_WORDS.values() for w in s.split())
COMMON = sorted(_COMMON)

# What lines of each notation begin with or hold.
_MARKER = re.compile(r"\s*(?:[-*+•‣◦·–]|\d{1,4}[.)]|\(?[a-zA-Z][.)])\s+(?:\[.\]\s)?|\s*(?:\[\[|!\[\[|\[.\]\s|\* \[)")
_HEADING = re.compile(r"\s*(?:#{1,6}\s|=+\s|---+\s*$|===+\s*$|```|\|===)")
_HTML_ROW = re.compile(r"\s*</?(?:table|thead|tbody|tr|td|th|caption)\b", re.I)
_HTML_ITEM = re.compile(r"\s*</?(?:ul|ol|li|dl|dt|dd)\b", re.I)
_RULE_ROW = re.compile(r"\s*[+|¦][-=+|¦: ]{2,}$|\s*=+(?: +=+)+\s*$|\s*-+(?: +-+)+\s*$")
_HEX = re.compile(r"\s*(?:0x)?[0-9a-fA-F]{4,}:?\s+(?:[0-9a-fA-F]{2,8}\s*){3,}(?:\S{0,20})?$")
_LOG = re.compile(
    r"\s*[\[(<]?\d[\d.:,/T+ Z-]{3,}[\])>]?\s+.{0,20}\b(?:TRACE|DEBUG|INFO|NOTICE|WARN|WARNING|ERR|ERROR|FATAL|CRIT)\b"
    r"|\s*(?:TRACE|DEBUG|INFO|WARN|ERR|ERROR)\b.*\d"
    r"|\s*at [\w.$<>]+\(|\s*\d{1,3}(?:\.\d{1,3}){3}\s.*\d{3}"
)
_DATA = re.compile(r'\s*[\[{]\s*["{].*[\]}],?\s*$|\s*"[\w-]+"\s*:')
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)?")
_CJK = re.compile(r"[぀-ヿ㐀-鿿]")
_SENTENCE_JA = re.compile(r"[。！？]|(?:ます|ました|です|でした|ください|ません)")
_VOWEL = re.compile(r"[aeiouyáàâäéèêëíîïóôöúùûüœæ]", re.I)
_MOJIBAKE = re.compile(r"[ÂÃâ€™�ƒ¤¢\u0080-\u009f]")
_SOLID = re.compile(r"[A-Za-z0-9+/=_-]{24,}")
_GAP = re.compile(r"(?<=\S) {2,}(?=\S)")
_ALNUM = re.compile(r"[^\W_]")
_SYMBOL = re.compile(r"[^\w\s]|_")
_END = ".!?…。！？:;»\"”')"
#: The end of a sentence, in a line or at its end; initials and short forms such as "Dr." are none.
_SENTENCE_END = re.compile(
    r"[^\W\d_]{3}[\"'”’»)\]]*[.!?…]+(?:[\"'”’»)\]]*(?:\s+\S|\s*$)|\s)|[.!?…:;][\"'”’»)\]]*\s*$|\s[!?]\s*$|"
    + _SENTENCE_JA.pattern
)
_QUOTED = re.compile(r"[>\s]*(?:(?:[-*+•‣◦·–]|\d{1,4}[.)]|\(?[a-zA-Z][.)])\s+)?[\"'“„«(\[]*")
#: Share of the lines that align from which lines of words are rows, and the score from which they are entries.
ALIGNED, ENTRIES = 0.5, 0.6
#: Autocorrelation from which indentation or line lengths recur.
RECURS = 0.5
_DELIMITERS = "|¦\t;,"


def _delimiters(line: str) -> tuple[str, int]:
    """The separator a line has most of, and its count; fixed-width columns count as gaps."""
    s = line.strip(" ").rstrip(";,")
    best, n = "", 0
    for d in _DELIMITERS:
        c = s.count(d)
        if c > n and (d != "," or c > s.count(", ")):
            best, n = d, c
    if "  " in s:
        gaps = len(_GAP.findall(s))
        if gaps >= n:
            return "gap", gaps
    return best, n


def _columns(line: str) -> frozenset[int]:
    """Where the columns after a gap begin; the wide space between two sentences is no gap."""
    return frozenset(m.end() for m in _GAP.finditer(line) if line[m.start() - 1] not in ".!?…:;")


def _autocorrelation(values: list[int], lag: int = 1) -> float:
    n = len(values)
    if n <= lag + 1:
        return 0.0
    mean = sum(values) / n
    spread_ = sum((v - mean) ** 2 for v in values)
    if not spread_:
        return 1.0
    return sum((values[i] - mean) * (values[i + lag] - mean) for i in range(n - lag)) / spread_


def _common_share(tokens: list[str]) -> float:
    return len([1 for t in tokens if t in _COMMON]) / len(tokens) if tokens else 0.0


def _own_class(line: str, tokens: list[str]) -> str:
    """Class of a line by itself: prose, item, row, menu, junk, loose, none (either way) or short."""
    if _HEX.match(line):
        return "junk"
    first = line.lstrip()[:1]
    common = _common_share(tokens)
    garbled = _MOJIBAKE.search(line) is not None
    if common >= 0.25 and len(tokens) >= 6 and not garbled and first not in "|¦<{[":
        return "prose"
    if _HTML_ROW.match(line) or _RULE_ROW.match(line):
        return "row"
    if _HEADING.match(line):
        return "none"
    n = len("".join(line.split()))
    if _LOG.match(line) or _DATA.match(line):
        return "junk"
    letters = sum(map(len, tokens))
    cjk = len(_CJK.findall(line)) if not line.isascii() else 0
    if garbled and n >= 12 and len(_MOJIBAKE.findall(line)) > 0.06 * n and cjk < 0.2 * n:
        return "junk"
    if letters >= 20 and not cjk and common < 0.14:
        plain = [t for t in tokens if len(t) > 2]
        mute = sum(len(t) for t in plain if len(_VOWEL.findall(t)) < 0.15 * len(t))
        if mute > 0.35 * max(1, sum(map(len, plain))):
            return "junk"
    if first and first in "|¦" and line.count(first) >= 2:
        return "row"
    if n >= 6 and len(_ALNUM.findall(line)) < 0.45 * n and "http" not in line:
        return "junk"
    if line.count("|") >= 2:
        return "menu" if "»" in line or "›" in line or not any(map(str.isdigit, line)) else "row"
    if n >= 24 and "http" not in line and "[[" not in line:
        if sum(map(len, _SOLID.findall(line))) > 0.5 * n and "/" not in line[:9]:
            return "junk"
    if cjk > 0.3 * n:
        if _SENTENCE_JA.search(line):
            return "prose"
        return "item" if _MARKER.match(line) else "short"
    if _HTML_ITEM.match(line):
        return "item"
    if _MARKER.match(line):
        return "prose" if common >= 0.25 and len(tokens) >= 8 else "item"
    if common >= 0.14:
        return "prose"
    return "loose" if len(tokens) > 14 and common < 0.08 else "short"


def _row_like(kind: str, mark: tuple[str, int], n_tokens: int, line: str) -> bool:
    """Whether a line aligned with a neighbour is a record rather than text that holds the separator."""
    d, c = mark
    if d == "\t":
        return True
    if kind == "prose" or kind == "item":
        return False
    return d == "gap" or d in "|¦" or (d == ";" and c * 8 >= n_tokens) or (d == "," and c >= 2 and ", " not in line)


def _entry_score(
    lines: list[str], tokens: list[list[str]], words: list[int], indent_period: float, length_period: float, ratios: dict
) -> float:
    """How much the lines at ``words``, which hold words and no other notation, look like entries rather than running text.

    An entry ends no sentence and neither runs on nor is the rest of the line before: it doesn't end with a comma or, where
    some lines begin in lower case, with a function word, nor begin in lower case where others don't, unless the layout
    recurs. The score is the share of entries, more with periodic indentation or line lengths, many symbols and long words,
    less with lines that end as sentences do.
    """
    starts = [lines[i][_QUOTED.match(lines[i]).end() :][:1] for i in words]
    lower = sum(map(str.islower, starts))
    ended = [_SENTENCE_END.search(lines[i]) is not None for i in words]
    # where few sentences end, indentation or line lengths that recur set the lines apart, whatever they begin with
    apart = max(indent_period, length_period) >= RECURS and sum(ended) <= 0.1 * len(words)
    mixed = 0.1 * len(words) < lower < 0.9 * len(words) and not apart
    runs_on = [
        not e and (lines[i].rstrip()[-1] in ",-–—" or lower > 0 and bool(tokens[i]) and tokens[i][-1] in _COMMON)
        for i, e in zip(words, ended)
    ]
    total = entries = 0
    for k, i in enumerate(words):
        size = len(lines[i].strip())
        total += size
        after = k + 1 < len(words) and words[k + 1] == i + 1 and mixed and starts[k + 1].islower()
        rest = k > 0 and words[k - 1] == i - 1 and runs_on[k - 1] or mixed and starts[k].islower()
        entries += size * (not (ended[k] or runs_on[k] or after or rest))
    if not total:
        return 0.0
    return (
        entries / total
        + 0.4 * max(0.0, indent_period)
        + 0.3 * max(0.0, length_period)
        + 0.5 * min(max(ratios["symbol_ratio"] - 0.04, 0.0), 0.2)
        + 0.05 * min(max((ratios["mean_word_length"] or 0) - 4.5, 0.0), 1.5)
        - 0.3 * ratios["end_punctuation"]
    )


def describe(text: str | None) -> dict:
    """Statistics and kind of one text."""
    if text is None or not text.strip():
        return {}
    lines = [x for x in text.splitlines() if x and not x.isspace()]
    tokens = [_WORD.findall(x) for x in map(str.lower, lines)]
    own = list(map(_own_class, lines, tokens))
    marks = list(map(_delimiters, lines))
    sizes = [len(x.strip()) for x in lines]
    n = len(lines)
    words_ = [t for ts in tokens for t in ts]
    indents = [len(x) - len(x.lstrip()) for x in lines]
    indent_period = max(_autocorrelation(indents, lag) for lag in (1, 2, 3)) if any(indents) else 0.0
    ratios = {
        "mean_word_length": sum(map(len, words_)) / len(words_) if words_ else None,
        "symbol_ratio": len(_SYMBOL.findall(text)) / len("".join(text.split())),
        "end_punctuation": sum(x.rstrip()[-1] in _END for x in lines) / n,
    }
    length_autocorrelation = _autocorrelation(sizes)
    beside = [[j for j in (i - 1, i + 1) if 0 <= j < n] for i in range(n)]
    same = [
        bool(d) and any(marks[j][0] == d if d == "gap" else marks[j] == (d, c) for j in beside[i])
        for i, (d, c) in enumerate(marks)
    ]
    # lines of words are rows only where the document aligns, by columns that begin at the same place
    columns = {i: _columns(lines[i]) for i, (d, _) in enumerate(marks) if d == "gap"}
    in_column = [
        same[i]
        and _row_like("short", marks[i], len(tokens[i]), lines[i])
        and (i not in columns or any(columns[i] & columns.get(j, frozenset()) for j in beside[i]))
        for i in range(n)
    ]
    by_column = sum(in_column) >= ALIGNED * n
    words = [i for i, k in enumerate(own) if k in ("prose", "short")]
    length_period = max(length_autocorrelation, *(_autocorrelation(sizes, lag) for lag in (2, 3)))
    as_entries = len(words) > 2 and _entry_score(lines, tokens, words, indent_period, length_period, ratios) >= ENTRIES
    weight = {"prose": 0, "list": 0, "table": 0, "junk": 0}
    repeated = Counter(lines)
    paragraph = False  # whether the line before belongs to running text
    for i, kind in enumerate(own):
        if kind != "row" and sizes[i] > 8 and repeated[lines[i]] >= 4:
            kind = "junk"
        elif same[i] and kind in ("short", "loose", "item", "prose") and _row_like(kind, marks[i], len(tokens[i]), lines[i]):
            kind = "row"
        elif kind == "prose" and by_column and in_column[i]:
            kind = "row"
        elif kind == "prose" and as_entries and not _SENTENCE_END.search(lines[i]):
            kind = "item"
        if kind == "row":
            weight["table"] += sizes[i]
        elif kind == "item":
            weight["list"] += sizes[i]
        elif kind in ("junk", "loose", "menu"):
            weight["junk"] += sizes[i]
        elif kind == "prose":
            weight["prose"] += sizes[i]
        elif kind == "short":
            # the rest of a sentence if running text comes before, else an entry
            rest = paragraph and lines[i].rstrip()[-1:] in _END and sizes[i - 1] > 40
            weight["prose" if rest else "list"] += sizes[i]
        paragraph = kind == "prose"
    total = sum(weight.values())
    grams = 1 - len(set(zip(words_, words_[1:], words_[2:], words_[3:]))) / max(1, len(words_) - 3) if len(words_) > 3 else 0.0
    kind = "prose"
    if grams > 0.6 and (n < 3 or weight["table"] + weight["list"] < 0.5 * total):
        kind = "junk"
    elif total and weight["prose"] < 0.5 * total:
        kind = max(("junk", "table", "list"), key=lambda k: weight[k])
    share = lambda k: weight[k] / total if total else None
    return {
        "n_words": len(words_),
        **ratios,
        "common_words": _common_share(words_) if words_ else None,
        "repeated": grams,
        "delimiter_alignment": sum(same) / n,
        "indent_period": indent_period,
        "length_autocorrelation": length_autocorrelation,
        "prose_share": share("prose"),
        "list_share": share("list"),
        "table_share": share("table"),
        "junk_share": share("junk"),
        "kind": kind,
    }


_LONGS = ("n_words",)
_STRINGS = ("kind",)
_FIELDS = (
    "n_words", "mean_word_length", "symbol_ratio", "end_punctuation", "common_words", "repeated",
    "delimiter_alignment", "indent_period", "length_autocorrelation", "prose_share", "list_share",
    "table_share", "junk_share", "kind",
)
SCHEMA = T.StructType(
    [T.StructField(f, T.LongType() if f in _LONGS else T.StringType() if f in _STRINGS else T.DoubleType()) for f in _FIELDS]
)


@F.pandas_udf(SCHEMA)
def text_quality(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
    for texts in batches:
        out = pd.DataFrame([describe(t) for t in texts], columns=list(_FIELDS))
        for f in _FIELDS:
            out[f] = out[f].astype("Int64" if f in _LONGS else "object" if f in _STRINGS else "float64")
        yield out


def document_quality(documents: DataFrame) -> DataFrame:
    """One row per document: its statistics and kind."""
    # declared non-deterministic so that a filter on the result doesn't have every text described twice
    once = text_quality.asNondeterministic()
    return documents.select("doc_id", once("text").alias("q")).select("doc_id", "q.*")


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    rows = document_quality(spread(load(spark, folder, "documents")))
    return rows.where("kind <> 'prose'").select("doc_id", "kind").distinct()


def p10_quality(spark: SparkSession, folder: str) -> DataFrame:
    return document_quality(spread(load(spark, folder, "documents")))


def p10_ratios(spark: SparkSession, folder: str) -> DataFrame:
    """The word, symbol and punctuation ratios alone, as expressions that stay in the JVM."""
    text = F.col("text")
    words_ = F.filter(F.split(F.lower(text), r"[^\p{L}]+"), lambda w: w != "")
    lines = F.filter(F.transform(F.split(text, "\n"), lambda x: F.rtrim(x)), lambda x: x != "")
    common = F.array(*map(F.lit, COMMON))
    n = F.size("w")
    return (
        spread(load(spark, folder, "documents"))
        .where(text.isNotNull())
        .select("doc_id", text, words_.alias("w"), lines.alias("l"))
        .select(
            "doc_id",
            n.cast("bigint").alias("n_words"),
            F.round(F.aggregate("w", F.lit(0).cast("bigint"), lambda s, x: s + F.length(x)) / F.when(n > 0, n), 6).alias(
                "mean_word_length"
            ),
            F.round(F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")) / F.when(F.length(text) > 0, F.length(text)), 6).alias(
                "symbol_ratio"
            ),
            F.round(
                F.size(F.filter("l", lambda x: F.regexp_like(x, F.lit(r"[.!?]$"))))
                / F.when(F.size("l") > 0, F.size("l")),
                6,
            ).alias("end_punctuation"),
            F.round(F.size(F.filter("w", lambda x: F.array_contains(common, x))) / F.when(n > 0, n), 6).alias("common_words"),
        )
    )


_LIST = ", ".join("'" + w.replace("'", "''") + "'" for w in COMMON)
QUERIES = {"p10_found": p10_found, "p10_quality": p10_quality, "p10_ratios": p10_ratios}
SQL = {
    "p10_ratios": f"""
SELECT doc_id, len(w)::BIGINT AS n_words,
  round(list_sum(list_transform(w, lambda x: length(x)))::DOUBLE / nullif(len(w), 0), 6) AS mean_word_length,
  round(len(regexp_extract_all(text, '[!-/:-@\\[-`{{-~]'))::DOUBLE / nullif(length(text), 0), 6) AS symbol_ratio,
  round(len(list_filter(l, lambda x: regexp_matches(x, '[.!?]$')))::DOUBLE / nullif(len(l), 0), 6) AS end_punctuation,
  round(len(list_filter(w, lambda x: x IN ({_LIST})))::DOUBLE / nullif(len(w), 0), 6) AS common_words
FROM (SELECT doc_id, text, list_filter(regexp_split_to_array(lower(text), '[^\\p{{L}}]+'), lambda x: x <> '') AS w,
  list_filter(list_transform(string_split(text, chr(10)), lambda x: rtrim(x, ' ')), lambda x: x <> '') AS l
  FROM documents WHERE text IS NOT NULL)"""
}
