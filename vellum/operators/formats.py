"""Queries of the format converters: files of every format built from a table, whose Markdown is known."""

from __future__ import annotations

import io
import zipfile

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.sources import convert, files
from vellum.tables import load

#: Contents of a file of each text format and its Markdown; ``@`` stands for a nation's name, the first control character for ``@``.
TEXTS = {
    "csv": ('k,v\n"@, x",1|2\nz\n', "| k | v |\n| --- | --- |\n| @, x | 1\\|2 |\n| z |  |"),
    "rst": ("@ and more\n====================\n\nSub\n---\n\n* ``c``\n`t <u>`_\n\n@ and more\n====================\n", "# @ and more\n\n## Sub\n\n- `c`\n[t](u)\n\n# @ and more\n"),
    "org": ("#+TITLE: @\n* A\n** B\n#+BEGIN_SRC sh\n* c\n#+END_SRC\n[[u][t]] [[v]]\n", "# @\n# A\n## B\n```sh\n* c\n```\n[t](u) <v>\n"),
    "wiki": ("== @ ==\n* a\n** b\n'''x''' ''y'' [[p|q]] [https://e.example t]\n", "## @\n- a\n  - b\n**x** *y* [q](p) [t](https://e.example)\n"),
    "adoc": ("= @\n* a\nNOTE: n\nhttps://e.example[t]\n----\nc\n----\n", "# @\n- a\n> **NOTE:** n\n[t](https://e.example)\n```\nc\n```\n"),
    "tex": ("\\section{Out}\n\\begin{document}\n\\section{@} % no\n\\subsection{B}\n\\item a \\textbf{b} \\emph{c} \\texttt{d}\n\\end{document}\n", "# @ \n## B\n- a **b** *c* `d`\n"),
    "textile": ("h2. @\n* a\n# b\n@c@ \"t\":https://e.example\n".replace("@c@", "\x01c\x01"), "## @\n- a\n1. b\n`c` [t](https://e.example)\n"),
    "html": ("<title>@</title><p>a <b>b</b>", "# @\n\na **b**"),
    "eml": ("Subject: @\nFrom: a\x01b.example\nContent-Type: text/html\n\n<p>x <i>y</i>\n", "---\nfrom: \"a\x01b.example\"\nsubject: @\n---\n\n# @\n\nx *y*"),
    "mhtml": ("MIME-Version: 1.0\nContent-Type: multipart/related; boundary=b\n\n--b\nContent-Type: text/html\n\n<h1>@</h1>\n--b\nContent-Type: text/css\n\np {}\n--b--\n", "# @"),
    "rss": ("<rss><channel><title>@</title><item><title>I</title><link>u</link><pubDate>D</pubDate><description>&lt;p&gt;x&lt;/p&gt;</description></item></channel></rss>", "# @\n\n## I\n\nu\n\n*D*\n\nx"),
    "atom": ('<feed xmlns="a"><title>@</title><entry><title>E</title><link href="h"/><updated>D</updated><content>c</content></entry></feed>', "# @\n\n## E\n\nh\n\n*D*\n\nc"),
    "rtf": ("{\\rtf1{\\fonttbl x}@\\par\nb\\line c\\tab d\\u233 ?}", "@\n\nb\nc\tdé?"),
    "doc": ("\x00@ has enough of it to read\x00\x01ab\x00and the rest\x02", "@ has enough of it to read\nand the rest"),
    "webarchive": ("<?xml version=\"1.0\"?><plist version=\"1.0\"><dict><key>WebMainResource</key><dict><key>WebResourceData</key><data>PGgxPng8L2gxPjxwPnk=</data></dict></dict></plist>", "# x\n\ny"),
    "py": ("x = '@'\n", "```python\nx = '@'\n```\n"),
    "md": ("# @\n", "# @\n"),
    "pdf": ("%PDF-1.4 @", None),
}

_W = 'xmlns:w="w"'
_O = 'xmlns:t="t" xmlns:d="d" xmlns:p="p" xmlns:o="o"'
#: Members of a file of each zipped format and its Markdown.
ZIPPED = {
    "docx": ({"word/document.xml": f'<w:document {_W}><w:body><w:p><w:pPr><w:pStyle w:val="Heading2"/></w:pPr><w:r><w:t>@</w:t></w:r></w:p><w:p><w:pPr><w:numPr/></w:pPr><w:r><w:rPr><w:i/></w:rPr><w:t>i</w:t></w:r><w:r><w:tab/><w:t>t</w:t></w:r></w:p></w:body></w:document>'}, "## @\n\n- *i*\tt"),
    "odt": ({"content.xml": f'<o:body {_O}><o:text><t:h t:outline-level="2">@</t:h><t:list><t:list-item><t:p>a</t:p><t:list><t:list-item><t:p>b</t:p></t:list-item></t:list></t:list-item></t:list></o:text></o:body>'}, "## @\n\n- a\n\n  - b"),
    "ods": ({"content.xml": f'<o:body {_O}><d:table d:name="@"><d:table-row><d:table-cell d:number-columns-repeated="2"><t:p>a</t:p></d:table-cell></d:table-row><d:table-row><d:table-cell/><d:table-cell><t:p>b</t:p></d:table-cell></d:table-row></d:table></o:body>'}, "## @\n\n| a | a |\n| --- | --- |\n|  | b |"),
    "xlsx": ({"xl/workbook.xml": '<workbook><sheets><sheet name="@"/></sheets></workbook>', "xl/sharedStrings.xml": "<sst><si><t>s|t</t></si></sst>", "xl/worksheets/sheet1.xml": '<worksheet><sheetData><row><c r="A1" t="s"><v>0</v></c><c r="C1"><v>2.0</v></c></row></sheetData></worksheet>'}, "## @\n\n| s\\|t |  | 2 |\n| --- | --- | --- |"),
    "pptx": ({"ppt/slides/slide2.xml": '<a xmlns:a="a"><a:p><a:t>two</a:t></a:p></a>', "ppt/slides/slide1.xml": '<a xmlns:a="a"><a:p><a:t>@</a:t></a:p></a>'}, "## Slide 1\n\n- @\n\n## Slide 2\n\n- two"),
    "odp": ({"content.xml": f"<o:body {_O}><p:page><t:p><t:span>@</t:span></t:p></p:page></o:body>"}, "## Slide 1\n\n- @"),
    "epub": ({"a/b.opf": '<package><title>@</title><creator>c</creator><item id="i" href="x.html"/><itemref idref="i"/></package>', "a/x.html": "<h1>One</h1>"}, "# @\n\n*c*\n\n# One"),
}


def _named(text: str | None, name: str) -> str | None:
    return None if text is None else text.replace("@", name).replace("\x01", "@")


def q_text_formats(spark: SparkSession, folder: str) -> DataFrame:
    """A file of every text format for each nation, converted."""
    formats = F.explode(F.array(*[F.struct(F.lit(e).alias("ext"), F.lit(t).alias("t")) for e, (t, _) in TEXTS.items()]))
    rows = load(spark, folder, "nation").select("n_nationkey", "n_name", formats.alias("f"))
    content = F.encode(F.replace(F.replace("f.t", F.lit("@"), F.col("n_name")), F.lit("\x01"), F.lit("@")), "UTF-8")
    done = rows.select("n_nationkey", "f.ext", convert.to_markdown(F.col("f.ext"), content).alias("r"))
    return done.select("n_nationkey", "ext", "r.markdown", "r.error")


@F.pandas_udf(T.BinaryType())
def _zipped(exts: pd.Series, names: pd.Series) -> pd.Series:
    out = []
    for ext, name in zip(exts, names):
        box = io.BytesIO()
        with zipfile.ZipFile(box, "w") as z:
            for member, text in ZIPPED[ext][0].items():
                z.writestr(member, _named(text, name))
        out.append(box.getvalue())
    return pd.Series(out)


def q_zipped_formats(spark: SparkSession, folder: str) -> DataFrame:
    """A file of every zipped format for each nation, converted."""
    rows = load(spark, folder, "nation").select("n_nationkey", "n_name", F.explode(F.array(*map(F.lit, ZIPPED))).alias("ext"))
    done = rows.select("n_nationkey", "ext", convert.to_markdown(F.col("ext"), _zipped("ext", "n_name")).alias("r"))
    return done.select("n_nationkey", "ext", "r.markdown", "r.error")


def q_ending_languages(spark: SparkSession, folder: str) -> DataFrame:
    """The language of every ending that has one, of some that have none, in lower and upper case."""
    endings = F.explode(F.array(*map(F.lit, [*sorted(convert._LANGUAGE), "bin", "txt"]))).alias("e")
    rows = load(spark, folder, "nation").where("n_nationkey < 2").select("n_nationkey", endings)
    ext = F.when(F.col("n_nationkey") == 1, F.upper("e")).otherwise(F.col("e"))
    return rows.select(ext.alias("ext"), convert.language_of_ending(ext).alias("language"))


def q_code_paths(spark: SparkSession, folder: str) -> DataFrame:
    """Which of the paths of documents and attachments a scan of code would take."""
    paths = load(spark, folder, "documents").select("path").unionByName(load(spark, folder, "attachments").select("path"))
    return paths.where("path is not null").select("path", files.is_code(F.col("path")).alias("is_code")).distinct()


def _literal(text: str | None) -> str:
    if text is None:
        return "NULL"
    escaped = text.replace("'", "''").replace("\n", "' || chr(10) || '").replace("\t", "' || chr(9) || '")
    return "'" + escaped.replace("@", "' || n_name || '").replace("\x01", "@") + "'"


def _sql(formats: dict) -> str:
    error = lambda e: "'no reader for pdf'" if e == "pdf" else "NULL"
    return " UNION ALL ".join(f"SELECT n_nationkey, '{e}' AS ext, {_literal(m)} AS markdown, {error(e)} AS error FROM nation" for e, (_, m) in formats.items())


_ENDINGS = ", ".join(f"('{e}', '{name}')" for name, es in convert.LANGUAGES.items() for e in es.split())
_IN = lambda xs: "(" + ", ".join(f"'{x}'" for x in xs) + ")"

QUERIES = {"text_formats": q_text_formats, "zipped_formats": q_zipped_formats, "ending_languages": q_ending_languages, "code_paths": q_code_paths}
SQL = {
    "text_formats": _sql(TEXTS),
    "zipped_formats": _sql(ZIPPED),
    "ending_languages": f"WITH v AS (SELECT * FROM (VALUES {_ENDINGS}, ('bin', ''), ('txt', '')) t(ext, language)) SELECT ext, language FROM v UNION ALL SELECT upper(ext), language FROM v",
    "code_paths": f"""SELECT DISTINCT path, (lower(regexp_extract(path, '\\.([^./]+)$', 1)) IN {_IN(files.CODE_ENDINGS)} OR regexp_extract(path, '([^/]*)$', 1) IN {_IN(files.CODE_NAMES)})
  AND len(list_filter(string_split(regexp_replace(path, '[^/]*$', ''), '/'), lambda f: f IN {_IN(files.CODE_SKIPPED)} OR regexp_matches(f, '^\\.[^./]'))) = 0 AS is_code
  FROM (SELECT path FROM documents UNION ALL SELECT path FROM attachments) WHERE path IS NOT NULL""",
}
