"""Text functions as column expressions; all stay in the JVM.

Null text gives null (arrays: null), unless a docstring says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

LETTER = r"\p{IsAlphabetic}"
TOKEN_SPLIT = rf"[^{LETTER}\p{{N}}'-]+"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def tokens(text: Column | str) -> Column:
    """Lower-case words: runs of letters, digits, ``'`` and ``-``, with the last two trimmed off the ends."""
    parts = F.transform(F.split(_col(text), TOKEN_SPLIT), lambda t: F.lower(F.trim(t, F.lit("'-"))))
    return F.filter(parts, lambda t: t != "")


def whitespace_words(text: Column | str) -> Column:
    return F.filter(F.split(_col(text), r"(?U)\s+"), lambda w: w != "")


def lines(text: Column | str) -> Column:
    return F.split(F.regexp_replace(_col(text), "\r\n", "\n"), "\n")


def word_count(text: Column | str) -> Column:
    return F.regexp_count(_col(text), F.lit(r"(?U)\S+")).cast("bigint")


def estimate_tokens(text: Column | str) -> Column:
    """``ceil(1.3 x words)``."""
    return F.ceil(word_count(text) * F.lit(1.3)).cast("bigint")


def char_count(text: Column | str) -> Column:
    return F.length(_col(text)).cast("bigint")


def space_count(text: Column | str) -> Column:
    t = _col(text)
    return (F.length(t) - F.length(F.replace(t, F.lit(" "), F.lit("")))).cast("bigint")


def _pieces(text: Column, pattern: str) -> Column:
    return F.size(F.filter(F.split(text, pattern), lambda s: F.regexp_like(s, F.lit(r"(?U)\S")))).cast("bigint")


def sentence_count(text: Column | str) -> Column:
    """Pieces between ``.``, ``!`` and ``?`` that aren't blank; 1 at least."""
    return F.greatest(F.lit(1).cast("bigint"), _pieces(_col(text), "[.!?]"))


def paragraph_count(text: Column | str) -> Column:
    return F.greatest(F.lit(1).cast("bigint"), _pieces(_col(text), "\n\n"))


def sentences(text: Column | str) -> Column:
    """Sentences cut after ``.``, ``!`` or ``?``; pieces of one byte are dropped."""
    flat = F.replace(_col(text), F.lit("\n"), F.lit(" "))
    cut = F.regexp_extract_all(flat, F.lit(r"[^.!?]*[.!?]|[^.!?]+$"), F.lit(0))
    return F.filter(F.transform(cut, lambda s: F.trim(s)), lambda s: F.octet_length(s) > 1)


def letters(word: Column) -> Column:
    return F.regexp_replace(word, f"[^{LETTER}]", "")


def syllables(word: Column) -> Column:
    """Vowel groups less a silent final e; 1 at least, 0 without letters."""
    only = letters(F.lower(word))
    groups = F.regexp_count(only, F.lit("[aeiouy]+"))
    silent = F.when((F.length(only) > 2) & F.regexp_like(only, F.lit("[^aeiouyl]e$")), 1).otherwise(0)
    return F.when(only == "", 0).otherwise(F.greatest(F.lit(1), groups - silent)).cast("bigint")


def slug(title: Column | str) -> Column:
    kept = F.regexp_replace(F.lower(_col(title)), rf"[^{LETTER}\p{{N}} -]", "")
    return F.regexp_replace(kept, " ", "-")


def strip_markdown(text: Column | str) -> Column:
    bare = F.regexp_replace(_col(text), "(?m)^#+", "")
    return F.translate(bare, "|*`>", " ")


def frontmatter(text: Column | str) -> Column:
    """The block between leading ``---`` lines, empty if there is none."""
    return F.regexp_extract(_col(text), r"(?s)\A---\r?\n(.*?)\r?\n---", 1)


def is_date_like(token: Column | str) -> Column:
    return F.regexp_like(_col(token), F.lit(r"^\d{4}[-/]\d+[-/]\d+$"))


def fnv1a(text: Column | str) -> Column:
    """64-bit FNV-1a of the UTF-8 bytes, as a signed bigint; the product is taken in halves so that it can't overflow."""
    raw = F.hex(F.encode(_col(text), "UTF-8"))

    def step(h: Column, i: Column) -> Column:
        byte = F.conv(F.substr(raw, i * 2 - 1, F.lit(2)), 16, 10).cast("bigint")
        x = h.bitwiseXOR(byte)
        low = x.bitwiseAND(F.lit(4294967295)) * 435
        high = F.shiftrightunsigned(x, 32) * 435 + F.shiftrightunsigned(low, 32) + F.shiftleft(x.bitwiseAND(F.lit(16777215)), 8)
        return F.shiftleft(high, 32).bitwiseOR(low.bitwiseAND(F.lit(4294967295)))

    n = F.octet_length(_col(text))
    return F.aggregate(
        F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>")), F.lit(-3750763034362895579), step
    )
