"""File formats to Markdown, row by row, with the standard library.

Formats without an offline reader (PDF, XLS, PPT, MSG, MOBI) give a null text and an error, never a failure of the job; so does a
file that can't be parsed. Null content gives null and no error.
"""

from __future__ import annotations

import csv
import email
import email.policy
import io
import plistlib
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import htmltree as ht

LIMIT = 10 * 1024 * 1024

# Languages of files by ending.
LANGUAGES = {
    "html": "html htm", "css": "css", "scss": "scss", "sass": "sass", "less": "less", "javascript": "js jsx mjs cjs", "typescript": "ts tsx mts", "vue": "vue",
    "svelte": "svelte", "astro": "astro", "python": "py pyx scons", "ruby": "rb erb", "php": "php phtml", "java": "java", "csharp": "cs csharp",
    "cpp": "cpp cc cxx c++ hpp hxx", "c": "c h", "rust": "rs", "go": "go", "kotlin": "kt kts", "swift": "swift", "objc": "m mm", "scala": "scala", "groovy": "groovy",
    "gradle": "gradle", "vbnet": "vb vbs", "asp": "asp aspx", "jsp": "jsp", "bash": "sh bash zsh fish", "powershell": "ps1 psm1", "batch": "cmd bat", "perl": "pl pm",
    "awk": "awk", "sed": "sed", "json": "json jsonc", "yaml": "yaml yml", "xml": "xml", "toml": "toml", "ini": "ini cfg conf", "properties": "properties",
    "sql": "sql psql", "graphql": "graphql gql", "protobuf": "proto", "markdown": "md markdown mdown", "rst": "rst", "latex": "tex latex", "asciidoc": "adoc",
    "dockerfile": "dockerfile", "makefile": "makefile mk", "cmake": "cmake", "ninja": "ninja", "r": "r rmd", "lua": "lua", "julia": "julia jl", "clojure": "clj cljs",
    "elixir": "ex exs", "erlang": "erl hrl", "haxe": "hx", "haskell": "hs", "ocaml": "ml mli", "fsharp": "fs fsx fsi", "forth": "fth", "vim": "vim", "diff": "diff patch",
    "dart": "dart", "nim": "nim", "zig": "zig", "d": "d", "lisp": "lisp lsp", "scheme": "scm", "racket": "rkt", "cypher": "cypher", "sparql": "sparql", "aql": "aql",
    "asm": "asm s", "hex": "hex",
}
_LANGUAGE = {ext: lang for lang, exts in LANGUAGES.items() for ext in exts.split()}


def decoded(data: bytes) -> str:
    for encoding in ("utf-8-sig", "utf-8"):
        try:
            return data.decode(encoding)
        except UnicodeDecodeError:
            continue
    return data.decode("iso-8859-1")


def fenced(code: str, language: str = "", title: str | None = None, numbers: bool = False) -> str:
    lines = code.rstrip("\n").split("\n")
    body = "\n".join(f"{i:4} | {x}" for i, x in enumerate(lines, 1)) if numbers else "\n".join(lines)
    return (f"# {title}\n\n" if title else "") + f"```{language}\n{body}\n```\n"


def _local(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _attr(node, name: str) -> str | None:
    return next((v for k, v in node.attrib.items() if _local(k) == name), None)


def from_csv(data: bytes) -> str:
    rows = [r for r in csv.reader(io.StringIO(decoded(data))) if r]
    if not rows:
        return ""
    width = max(map(len, rows))
    return ht.pipe_table([[c.replace("|", "\\|").replace("\n", " ") for c in r + [""] * (width - len(r))] for r in rows])


def from_docx(data: bytes) -> str:
    root = ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("word/document.xml"))
    out = []
    for p in root.iter():
        if _local(p.tag) != "p":
            continue
        style, listed, parts = "", False, []
        for n in p.iter():
            name = _local(n.tag)
            if name == "pStyle":
                style = _attr(n, "val") or ""
            elif name == "numPr":
                listed = True
            elif name == "r":
                kinds = {_local(x.tag) for x in n.iter() if _attr(x, "val") not in ("0", "false")}
                text = "".join(x.text or "" if _local(x.tag) == "t" else "\t" if _local(x.tag) == "tab" else "\n" if _local(x.tag) == "br" else "" for x in n.iter())
                if text.strip():
                    text = f"**{text}**" if "b" in kinds else f"*{text}*" if "i" in kinds else text
                parts.append(text)
        text = "".join(parts).strip()
        if not text:
            continue
        level = re.fullmatch(r"[Hh]eading\s*(\d)", style)
        out.append("#" * int(level.group(1)) + " " + text if level else f"# {text}" if style == "Title" else f"- {text}" if listed else text)
    return "\n\n".join(out)


def _odf(data: bytes):
    return ElementTree.fromstring(zipfile.ZipFile(io.BytesIO(data)).read("content.xml"))


def from_odt(data: bytes) -> str:
    out: list[str] = []

    def visit(node, depth: int) -> None:
        name = _local(node.tag)
        text = " ".join("".join(node.itertext()).split())
        if name == "h":
            out.append("#" * int(_attr(node, "outline-level") or 1) + " " + text)
        elif name == "p":
            if text:
                out.append(("  " * (depth - 1) + "- " if depth else "") + text)
        else:
            for c in node:
                visit(c, depth + (name == "list"))

    body = next((n for n in _odf(data).iter() if _local(n.tag) == "text"), None)
    if body is not None:
        visit(body, 0)
    return "\n\n".join(out)


def from_ods(data: bytes) -> str:
    out = []
    for table in (n for n in _odf(data).iter() if _local(n.tag) == "table"):
        rows = []
        for row in (n for n in table.iter() if _local(n.tag) == "table-row"):
            runs = [
                (" ".join("".join(c.itertext()).split()), int(_attr(c, "number-columns-repeated") or 1))
                for c in row if _local(c.tag) in ("table-cell", "covered-table-cell")
            ]
            while runs and not runs[-1][0]:  # sheets end in a run of empty cells up to the last possible column
                runs.pop()
            if runs:
                rows += [[text for text, times in runs for _ in range(times)]] * int(_attr(row, "number-rows-repeated") or 1)
        if rows:
            width = max(map(len, rows))
            out.append(f"## {_attr(table, 'name') or 'Sheet'}\n\n" + ht.pipe_table([r + [""] * (width - len(r)) for r in rows]))
    return "\n\n".join(out)


def from_xlsx(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    names = book.namelist()
    strings = []
    if "xl/sharedStrings.xml" in names:
        root = ElementTree.fromstring(book.read("xl/sharedStrings.xml"))
        strings = ["".join(t.text or "" for t in si.iter() if _local(t.tag) == "t") for si in root if _local(si.tag) == "si"]
    sheets = [s for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter() if _local(s.tag) == "sheet"]
    links = {}
    if "xl/_rels/workbook.xml.rels" in names:
        links = {r.attrib.get("Id"): r.attrib.get("Target", "") for r in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    files = sorted((n for n in names if re.fullmatch(r"xl/worksheets/sheet\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    out = []
    for n, sheet in enumerate(sheets):
        # a sheet's file is named by the workbook's relations; by their order in a book without them
        target = links.get(next((v for k, v in sheet.attrib.items() if k.startswith("{") and _local(k) == "id"), None))
        file = (target.lstrip("/") if target.startswith("/") else "xl/" + target) if target else files[n] if n < len(files) else ""
        if file not in names:
            continue
        rows = []
        for row in (n for n in ElementTree.fromstring(book.read(file)).iter() if _local(n.tag) == "row"):
            cells: list[str] = []
            for c in (x for x in row if _local(x.tag) == "c"):
                ref = re.match(r"[A-Z]+", c.attrib.get("r", ""))
                if ref:
                    at = 0
                    for letter in ref.group():
                        at = at * 26 + ord(letter) - 64
                    cells += [""] * (min(at, 16_384) - 1 - len(cells))
                value = "".join(t.text or "" for t in c.iter() if _local(t.tag) in ("v", "t"))
                if c.attrib.get("t") == "s" and value:
                    value = strings[int(value)]
                elif re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                cells.append(value.replace("|", "\\|"))
            if any(cells):
                rows.append(cells)
        if rows:
            width = max(map(len, rows))
            out.append(f"## {sheet.attrib.get('name', 'Sheet')}\n\n" + ht.pipe_table([r + [""] * (width - len(r)) for r in rows]))
    return "\n\n".join(out)


def _slides(pages: list) -> str:
    out = []
    for n, page in enumerate(pages, 1):
        paragraphs = ["".join(t.text or "" for t in p.iter() if _local(t.tag) in ("t", "span", "p")).strip() for p in page.iter() if _local(p.tag) == "p"]
        out.append("\n".join([f"## Slide {n}", "", *[f"- {p}" for p in paragraphs if p]]))
    return "\n\n".join(out)


def from_pptx(data: bytes) -> str:
    deck = zipfile.ZipFile(io.BytesIO(data))
    files = sorted((n for n in deck.namelist() if re.fullmatch(r"ppt/slides/slide\d+\.xml", n)), key=lambda n: int(re.findall(r"\d+", n)[-1]))
    return _slides([ElementTree.fromstring(deck.read(f)) for f in files])


def from_odp(data: bytes) -> str:
    return _slides([n for n in _odf(data).iter() if _local(n.tag) == "page"])


def from_epub(data: bytes) -> str:
    book = zipfile.ZipFile(io.BytesIO(data))
    opf = next(n for n in book.namelist() if n.endswith(".opf"))
    root = ElementTree.fromstring(book.read(opf))
    base = opf.rsplit("/", 1)[0] + "/" if "/" in opf else ""
    items = {i.attrib.get("id"): i.attrib.get("href", "") for i in root.iter() if _local(i.tag) == "item"}
    first = lambda name: next(("".join(n.itertext()) for n in root.iter() if _local(n.tag) == name), "")
    out = [f"# {first('title')}"] if first("title") else []
    if first("creator"):
        out.append(f"*{first('creator')}*")
    for ref in (n for n in root.iter() if _local(n.tag) == "itemref"):
        file = base + items.get(ref.attrib.get("idref"), "")
        if file in book.namelist():
            out.append(ht.to_markdown(decoded(book.read(file))))
    return "\n\n".join(out)


def from_rtf(data: bytes) -> str:
    """Text of the groups that are shown; ``par`` ends a paragraph, ``line`` a line."""
    out: list[str] = []
    stack: list[bool] = [False]
    for word, number, hexed, brace, text in re.findall(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|([{}])|(\\[^a-zA-Z]|[^\\{}]+)", data.decode("latin-1")):
        if brace == "{":
            stack.append(stack[-1])
        elif brace == "}":
            if len(stack) > 1:
                stack.pop()
        elif text == "\\*" or word in ("fonttbl", "colortbl", "stylesheet", "info", "pict"):
            stack[-1] = True
        elif stack[-1]:
            continue
        elif word == "u" and number:
            out.append(chr(int(number) % 65536))
        elif word in ("par", "line", "tab"):
            out.append({"par": "\n\n", "line": "\n", "tab": "\t"}[word])
        elif hexed:
            out.append(bytes.fromhex(hexed).decode("cp1252", "replace"))
        elif text:
            out.append(text[1:] if text.startswith("\\") else text.replace("\r", "").replace("\n", ""))
    return re.sub(r"\n{3,}", "\n\n", "".join(out)).strip()


def from_doc(data: bytes) -> str:
    found = [x.decode("ascii").strip() for x in re.findall(rb"[\x20-\x7e\t]{4,}", data)]
    text = "\n".join(x for x in found if x)
    return text if len(text) >= 20 else "*No readable text found.*"


def from_eml(data: bytes) -> str:
    mail = email.message_from_bytes(data, policy=email.policy.default)
    fields = {k.lower(): str(mail[k]) for k in ("From", "To", "Cc", "Subject", "Date") if mail[k]}
    part = mail.get_body(("html", "plain"))
    body = part.get_content() if part is not None else ""
    if part is not None and part.get_content_type() == "text/html":
        body = ht.to_markdown(body)
    title = [f"# {fields['subject']}"] if fields.get("subject") else []
    return ht.front_matter(fields) + "\n" + "\n\n".join([*title, body.strip()])


def from_mhtml(data: bytes) -> str:
    mail = email.message_from_bytes(data, policy=email.policy.default)
    page = next((p for p in mail.walk() if p.get_content_type() == "text/html"), None)
    if page is None:
        raise ValueError("no HTML part")
    return ht.to_markdown(page.get_content())


def from_webarchive(data: bytes) -> str:
    main = plistlib.loads(data)["WebMainResource"]
    return ht.to_markdown(decoded(main["WebResourceData"]))


def from_feed(data: bytes) -> str:
    root = ElementTree.fromstring(data)
    child = lambda n, *names: next((c for name in names for c in n if _local(c.tag) == name), None)
    text = lambda n: "" if n is None else "".join(n.itertext()).strip()
    top = child(root, "channel") if child(root, "channel") is not None else root
    out = [f"# {text(child(top, 'title'))}"]
    for item in (n for n in root.iter() if _local(n.tag) in ("item", "entry")):
        out.append(f"## {text(child(item, 'title'))}")
        link = child(item, "link")
        if link is not None:
            out.append(link.attrib.get("href") or text(link))
        if when := text(child(item, "pubDate", "published", "updated", "date")):
            out.append(f"*{when}*")
        if body := text(child(item, "encoded", "content", "description", "summary")):
            out.append(ht.to_markdown(body) if "<" in body else body)
    return "\n\n".join(out)


def _per_line(rules: list[tuple[str, str | Callable]]) -> Callable[[bytes], str]:
    """Rules are applied one after the other, so those for a leading ``#`` come before those that make headings."""
    compiled = [(re.compile(p), r) for p, r in rules]

    def convert(data: bytes) -> str:
        out = []
        for line in decoded(data).replace("\r\n", "\n").split("\n"):
            for pattern, to in compiled:
                line = pattern.sub(to, line)
            out.append(line)
        return "\n".join(out).strip() + "\n"

    return convert


_hashes = lambda m: "#" * len(m.group(1)) + " " + m.group(2).strip()
from_mediawiki = _per_line([
    (r"^(#+)\s+(?=[^#])", lambda m: "  " * (len(m.group(1)) - 1) + "1. "), (r"^(={1,6})\s*(.+?)\s*=+\s*$", _hashes), (r"^(\*+)\s*", lambda m: "  " * (len(m.group(1)) - 1) + "- "),
    (r"'''(.+?)'''", r"**\1**"), (r"''(.+?)''", r"*\1*"), (r"\[\[([^\]|]+)\|([^\]]+)\]\]", r"[\2](\1)"), (r"\[(https?://\S+)\s+([^\]]+)\]", r"[\2](\1)"),
])
from_asciidoc = _per_line([
    (r"^(={1,6})\s+(.+)$", _hashes), (r"^(\*+)\s+", lambda m: "  " * (len(m.group(1)) - 1) + "- "), (r"^(NOTE|TIP|IMPORTANT|WARNING|CAUTION):\s*(.*)$", r"> **\1:** \2"),
    (r"^\[source,\s*(\w+)\]\s*$", ""), (r"^----\s*$", "```"), (r"(https?://\S+)\[([^\]]+)\]", r"[\2](\1)"),
])
from_textile = _per_line([
    (r"^(#+)\s+", lambda m: "  " * (len(m.group(1)) - 1) + "1. "), (r"^h([1-6])\.\s+(.+)$", lambda m: "#" * int(m.group(1)) + " " + m.group(2)), (r"^(\*+)\s+", lambda m: "  " * (len(m.group(1)) - 1) + "- "),
    (r"@([^@]+)@", r"`\1`"), (r"\"([^\"]+)\":(https?://\S+)", r"[\1](\2)"),
])


def from_org(data: bytes) -> str:
    out = []
    code = False  # lines of a source block stay as they are
    for line in decoded(data).splitlines():
        if code:
            code = re.match(r"\s*#\+(?:END_SRC|end_src)", line) is None
            out.append(line if code else "```")
            continue
        if m := re.match(r"#\+(?:TITLE|title):\s*(.+)", line):
            line = f"# {m.group(1)}"
        elif m := re.match(r"\s*#\+(?:BEGIN_SRC|begin_src)\s*(\S*)", line):
            out.append(f"```{m.group(1)}")
            code = True
            continue
        elif m := re.match(r"(\*+)\s+(.+)", line):
            line = "#" * len(m.group(1)) + " " + m.group(2)
        elif line.startswith("#+"):
            continue
        line = re.sub(r"\[\[([^\]]+)\]\[([^\]]+)\]\]", r"[\2](\1)", line)
        out.append(re.sub(r"\[\[([^\]]+)\]\]", r"<\1>", line))
    return "\n".join(out).strip() + "\n"


def from_rst(data: bytes) -> str:
    """Underlined titles rank by the order in which their characters first appear."""
    lines, out, marks = decoded(data).splitlines(), [], []
    i = 0
    while i < len(lines):
        below = lines[i + 1] if i + 1 < len(lines) else ""
        if lines[i].strip() and re.fullmatch(r"([=\-~^\"'`#*+.:_])\1{2,}\s*", below) and len(below.rstrip()) >= len(lines[i].rstrip()):
            if below[0] not in marks:
                marks.append(below[0])
            out.append("#" * min(6, marks.index(below[0]) + 1) + " " + lines[i].strip())
            i += 2
            continue
        line = re.sub(r"``([^`]+)``", r"`\1`", lines[i])
        line = re.sub(r"`([^`<]+?)\s*<([^>]+)>`_+", r"[\1](\2)", line)
        out.append(re.sub(r"^(\s*)[*+]\s", r"\1- ", line))
        i += 1
    return "\n".join(out).strip() + "\n"


def from_latex(data: bytes) -> str:
    text = decoded(data)
    body = re.search(r"\\begin\{document\}(.*?)(?:\\end\{document\}|\Z)", text, re.S)
    text = re.sub(r"(?<!\\)%.*", "", body.group(1) if body else text)
    for n, name in enumerate(("section", "subsection", "subsubsection", "paragraph"), 1):
        text = re.sub(rf"\\{name}\*?\{{([^{{}}]*)\}}", lambda m, n=n: "#" * n + " " + m.group(1), text)
    text = re.sub(r"\\item\s*", "- ", text)
    text = re.sub(r"\\(?:textbf|bf)\{([^{}]*)\}", r"**\1**", text)
    text = re.sub(r"\\(?:emph|textit)\{([^{}]*)\}", r"*\1*", text)
    text = re.sub(r"\\texttt\{([^{}]*)\}", r"`\1`", text)
    text = re.sub(r"\\(?:begin|end)\{[^{}]*\}|\\(?:maketitle|noindent|newpage)\b", "", text)
    return re.sub(r"\n{3,}", "\n\n", text).strip() + "\n"


CONVERTERS: dict[str, Callable[[bytes], str]] = {
    "csv": from_csv, "docx": from_docx, "odt": from_odt, "ods": from_ods, "xlsx": from_xlsx, "xlsm": from_xlsx, "pptx": from_pptx, "odp": from_odp, "epub": from_epub,
    "rtf": from_rtf, "doc": from_doc, "eml": from_eml, "mhtml": from_mhtml, "mht": from_mhtml, "webarchive": from_webarchive, "rss": from_feed, "atom": from_feed,
    "feed": from_feed, "wiki": from_mediawiki, "mediawiki": from_mediawiki, "rst": from_rst, "adoc": from_asciidoc, "asciidoc": from_asciidoc, "org": from_org,
    "tex": from_latex, "latex": from_latex, "textile": from_textile, "html": lambda d: ht.to_markdown(decoded(d)), "htm": lambda d: ht.to_markdown(decoded(d)),
}
UNREADABLE = frozenset("pdf xls ppt msg mobi azw azw3".split())


def convert(ext: str | None, data: bytes | None, limit: int | None = LIMIT) -> tuple[str | None, str | None]:
    """(markdown, error) of one file; structured formats of more than ``limit`` bytes have an error, without a limit none has."""
    if data is None:
        return None, None
    ext = (ext or "").lower()
    if ext in UNREADABLE:
        return None, f"no reader for {ext}"
    try:
        if ext in CONVERTERS:
            if limit is not None and len(data) > limit:
                return None, f"{len(data)} bytes; at most {limit} are converted"
            return CONVERTERS[ext](bytes(data)), None
        text = decoded(bytes(data))
        # Markdown is what it is; other text in a known language is fenced
        return (fenced(text, _LANGUAGE[ext]) if _LANGUAGE.get(ext, "markdown") != "markdown" else text), None
    except Exception as e:  # a broken file is a row with an error
        return None, f"{type(e).__name__}: {e}"[:300]


def language_of_ending(ext: Column) -> Column:
    """The language of a file by its ending in any case; empty where it says none."""
    known = F.create_map(*[F.lit(x) for pair in sorted(_LANGUAGE.items()) for x in pair])
    return F.when(ext.isNotNull(), F.coalesce(F.try_element_at(known, F.lower(ext)), F.lit("")))


RESULT = T.StructType([T.StructField("markdown", T.StringType()), T.StructField("error", T.StringType())])


def to_markdown(ext: Column, content: Column, limit: int | None = LIMIT) -> Column:
    """Struct (markdown, error) of a file's content; ``limit`` as in :func:`convert`."""

    @F.pandas_udf(RESULT)
    def run(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        for exts, contents in batches:
            yield pd.DataFrame([convert(e, c, limit) for e, c in zip(exts, contents)], columns=["markdown", "error"])

    return run(ext, content)
