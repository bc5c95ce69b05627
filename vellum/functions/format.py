"""Small text forms as column expressions: tokens shown, sizes and ages, templates, styles, file names.

Null gives null throughout.
"""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from vellum.functions.text import LETTER

# Languages of files that are known by their whole name.
NAMED_FILES = {
    "apache": (".htaccess", "apache.conf"),
    "bash": ("procfile", ".bashrc", ".bash_profile", ".zshrc", ".bash_aliases"),
    "dockerfile": ("dockerfile",),
    "ini": ("setup.cfg",),
    "json": (".eslintrc", ".eslintrc.json", ".prettierrc", "tsconfig.json", "jsconfig.json", "package.json", "package-lock.json", "composer.json"),
    "makefile": ("makefile", "gnumakefile"),
    "nginx": ("nginx.conf",),
    "properties": (".gitignore", ".gitattributes", ".dockerignore", ".editorconfig", "requirements.txt"),
    "python": ("pipfile", "setup.py"),
    "ruby": ("rakefile", "gemfile", "podfile", "fastfile", "capfile", "thorfile", "berksfile", "cheffile"),
    "toml": ("cargo.toml", "cargo.lock", "pyproject.toml"),
    "yaml": ("pubspec.yaml",),
}
# Style properties that say something, and the values of them that don't.
STYLE_PROPERTIES = (
    "color background-color background font-weight font-style text-align text-decoration font-size text-transform letter-spacing line-height margin padding "
    "border display font-family"
).split()
STYLE_DEFAULTS = {
    "display": ("block", "inline"), "margin": ("0", "auto"), "padding": ("0", "auto"), "font-weight": ("normal", "400"), "font-style": ("normal",),
    "text-align": ("left",), "text-decoration": ("none",), "line-height": ("1", "1.2", "normal"),
}
# Letters of date patterns in notes and what they are here.
DATE_LETTERS = {"YYYY": "yyyy", "YY": "yy", "MM": "MM", "DD": "dd", "HH": "HH", "mm": "mm", "ss": "ss"}
ENDS = rf"^[^{LETTER}\p{{N}}]+|[^{LETTER}\p{{N}}]+$"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def bare_word(word: Column | str) -> Column:
    """A word in lower case without what is no letter or digit at its ends; may be empty."""
    return F.lower(F.regexp_replace(_col(word), ENDS, ""))


def shown_token(token: Column | str) -> Column:
    """A token as it can be printed: spaces and the marks tokenizers use for them as an open box, control characters by name or number."""

    def shown(c: Column) -> Column:
        return (
            F.when(c.isin(" ", "Ġ", "▁"), "␣").when(c == "\n", r"\n").when(c == "\t", r"\t").when(c == "\r", r"\r")
            .when(F.regexp_like(c, F.lit(r"^[\x00-\x1f\x7f-\x9f]$")), F.concat(F.lit(r"\u{"), F.lower(F.hex(F.ascii(c))), F.lit("}"))).otherwise(c)
        )

    t = _col(token)
    return F.when(t == "", "(empty)").otherwise(F.array_join(F.transform(F.split(t, ""), shown), ""))


def one_decimal(x: Column) -> Column:
    """Half up, so that it doesn't depend on a runtime's way of printing."""
    return F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)


def human_size(n: Column | str) -> Column:
    n = _col(n)
    return (
        F.when(n < 1024, F.concat(n.cast("string"), F.lit(" B"))).when(n < 1024 * 1024, F.concat(one_decimal(n / 1024), F.lit(" KB")))
        .when(n.isNotNull(), F.concat(one_decimal(n / (1024 * 1024)), F.lit(" MB")))
    )


def relative_age(seconds: Column | str) -> Column:
    s = _col(seconds).cast("bigint")
    part = lambda per, name: F.concat(F.floor(s / per).cast("string"), F.lit(f" {name} ago"))
    return F.when(s < 60, part(1, "sec")).when(s < 3600, part(60, "min")).when(s < 86400, part(3600, "hrs")).when(s.isNotNull(), part(86400, "days"))


def truncated(text: Column | str, most: int) -> Column:
    """At most ``most`` characters, and a mark where more were."""
    t = _col(text)
    return F.when(F.length(t) > most, F.concat(F.left(t, F.lit(most)), F.lit("\n\n[...truncated...]"))).otherwise(t)


def date_pattern(pattern: str) -> str:
    """A date pattern of notes as one of Spark's; other letters are quoted."""
    out = []
    for part in re.findall("|".join(sorted(DATE_LETTERS, key=len, reverse=True)) + r"|[A-Za-z]+|[^A-Za-z]+", pattern):
        out.append(DATE_LETTERS.get(part) or (f"'{part}'" if part.isalpha() else part))
    return "".join(out)


def rendered(template: str, title: Column | str, at: Column) -> Column:
    """A template with ``{{title}}``, ``{{date}}`` and ``{{time}}`` filled in, the last two also ``:PATTERN``; others stay."""
    parts = []
    for piece in re.split(r"(\{\{.*?\}\})", template):
        name, _, pattern = piece[2:-2].partition(":") if piece.startswith("{{") and piece.endswith("}}") else ("", "", "")
        if name == "title" and not pattern:
            parts.append(_col(title))
        elif name in ("date", "time"):
            default = "yyyy-MM-dd" if name == "date" else "HH:mm"
            parts.append(F.date_format(at, date_pattern(pattern) if pattern else default))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts) if parts else F.lit("")


def offered_name(header: Column | str) -> Column:
    """The file name of a Content-Disposition header; null if there is none or it holds a path."""
    h = _col(header)
    quoted = F.regexp_extract(h, r'(?i)filename="([^"]*)', 1)
    bare = F.regexp_extract(h, r"(?i)filename=([^\";][^;]*)", 1)
    name = F.trim(F.when(F.regexp_like(h, F.lit(r'(?i)filename="')), quoted).otherwise(bare))
    return F.when((name != "") & ~F.regexp_like(name, F.lit(r"[/\\]|\.\.")), name)


def source_kind(source: Column | str) -> Column:
    """``url``, ``stdin`` or ``path``; whether a path is a folder is known only where it is read."""
    s = _col(source)
    return F.when(F.regexp_like(s, F.lit(r"^https?://[^\s/]+")), "url").when(s.isin("-", "stdin"), "stdin").when(s.isNotNull(), "path")


def language_of_name(name: Column | str) -> Column:
    """The language of a file known by its whole name; empty for others."""
    low = F.lower(_col(name))
    out = F.when(low.isNotNull(), F.lit(""))
    for language, names in NAMED_FILES.items():
        out = F.when(low.isin(*names), language).otherwise(out)
    return out


def style_hints(style: Column | str) -> Column:
    """Array of (property, value) of a style attribute that say something."""
    declared = F.filter(F.split(_col(style), ";"), lambda d: F.contains(d, F.lit(":")))
    pairs = F.transform(
        declared, lambda d: F.struct(F.lower(F.trim(F.substring_index(d, ":", 1))).alias("property"), F.trim(F.regexp_replace(d, r"^[^:]*:", "")).alias("value"))
    )

    def says(p: Column) -> Column:
        default = (p["property"] == "color") & F.contains(p["value"], F.lit("inherit"))
        for name, values in STYLE_DEFAULTS.items():
            default = default | ((p["property"] == name) & p["value"].isin(*values))
        return p["property"].isin(*STYLE_PROPERTIES) & ~default

    return F.filter(pairs, says)


def formatting_hints(text: Column | str) -> Column:
    """Styles that a text's form stands for."""
    t = _col(text)
    hint = lambda on, name: F.when(on, F.lit(name))
    return F.array_compact(
        F.array(
            hint((F.length(t) > 3) & ~F.regexp_like(t, F.lit(r"[^\p{Lu}\s]")), "text-transform: uppercase"),
            hint(F.contains(t, F.lit("**")), "font-weight: bold"),
            hint(F.regexp_like(t, F.lit("[_*]")), "font-style: italic"),
        )
    )


def data_url(name: Column | str, content: Column | str) -> Column:
    """Bytes of an image as a data URL, typed by the ending of its name."""
    ext = F.lower(F.regexp_extract(_col(name), r"\.([^./]+)$", 1))
    kind = F.when(ext.isin("jpg", "jpeg"), "jpeg").when(ext == "svg", "svg+xml").when(ext.isin("png", "gif", "webp", "bmp"), ext)
    mime = F.coalesce(F.concat(F.lit("image/"), kind), F.lit("application/octet-stream"))
    return F.concat(F.lit("data:"), mime, F.lit(";base64,"), F.base64(_col(content)))


def unit(vector: Column | str) -> Column:
    """A vector of length one in the same direction; one of zeros stays."""
    v = _col(vector)
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm > 0, F.transform(v, lambda x: x.cast("double") / norm)).otherwise(F.transform(v, lambda x: x.cast("double")))
