"""Structure of web pages as tables: one Arrow pass over a page gives all extracts, which are exploded where asked for.

Null and empty pages have no rows. Comments and the removal of silent elements are expressions that stay in the JVM.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.functions import htmltree as ht
from vellum.tables import load, spread

_S, _L, _B = T.StringType(), T.LongType(), T.BooleanType()


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


EXTRACT = _struct(
    links=T.ArrayType(_struct(href=_S, text=_S, title=_S, target=_S, rel=_S)),
    headings=T.ArrayType(_struct(level=_L, text=_S, id=_S)),
    images=T.ArrayType(_struct(src=_S, alt=_S, title=_S)),
    tables=T.ArrayType(T.ArrayType(T.ArrayType(_S))),
    forms=T.ArrayType(_struct(action=_S, method=_S, enctype=_S, fields=T.ArrayType(_struct(type=_S, name=_S, label=_S, value=_S, required=_B)))),
    definitions=T.ArrayType(_struct(term=_S, definition=_S)),
    quotes=T.ArrayType(_struct(text=_S, cite=_S, author=_S)),
    code=T.ArrayType(_struct(language=_S, code=_S)),
    metadata=T.MapType(_S, _S),
)
_PARTS = {
    "links": ht.links, "headings": ht.heads, "images": ht.images, "tables": ht.tables, "forms": ht.forms, "definitions": ht.definitions,
    "quotes": ht.quotes, "code": ht.code_blocks, "metadata": ht.metadata,
}


def extract(html: Column, *parts: str) -> Column:
    """The named extracts of a page, parsed once, as a struct; null for null."""
    wanted = parts or tuple(_PARTS)
    schema = T.StructType([EXTRACT[p] for p in wanted])

    @F.pandas_udf(schema)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for pages in batches:
            rows = []
            for page in pages:
                root = _attempt(ht.parse, page)[0] if page else None
                rows.append([None if root is None else _plain(_attempt(_PARTS[p], root)[0], EXTRACT[p].dataType) for p in wanted])
            yield pd.DataFrame(rows, columns=list(wanted))

    return run(html)


def _plain(value, kind: T.DataType):
    if value is None:
        return None
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.StructType):
        names = kind.elementType.names
        return [
            {n: _plain(x, f.dataType) for n, x, f in zip(names, row, kind.elementType.fields)} for row in value
        ]
    return value


def _attempt(f, *values):
    """(result, error): a page that can't be read is a row with an error, never a failed job."""
    try:
        return f(*values), None
    except Exception as e:
        return None, f"{type(e).__name__}: {e}"[:300]


def _text_udf(f, name: str):
    @F.pandas_udf(_struct(**{name: _S, "error": _S}))
    def run(pages: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([(None, None) if p is None else _attempt(f, p) for p in pages], columns=[name, "error"])

    return run


def to_markdown(html: Column) -> Column:
    """Struct (markdown, error)."""
    return _text_udf(ht.to_markdown, "markdown")(html)


def to_text(html: Column) -> Column:
    """Struct (text, error)."""
    return _text_udf(ht.to_text, "text")(html)


def comments(html: Column) -> Column:
    return F.regexp_extract_all(html, F.lit(r"(?s)<!--(.*?)-->"), F.lit(1))


def strip_comments(html: Column) -> Column:
    return F.regexp_replace(html, r"(?s)<!--.*?-->", "")


def strip_silent(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<(script|style|noscript|template)[\s/>].*?(</\1[^>]*>|\z)", "")


def strip_images(html: Column) -> Column:
    return F.regexp_replace(html, r"(?is)<img[^>]*>", "")


def page_text(data: Column) -> Column:
    """Bytes of a page as text: UTF-8 if valid, else ISO-8859-1; without a byte-order mark."""
    text = F.coalesce(F.try_validate_utf8(data.cast("string")), F.decode(data, "ISO-8859-1"))
    return F.regexp_replace(text, "^\ufeff", "")


def pages(spark: SparkSession, folder: str) -> DataFrame:
    """(resource_id, url, html). Repeated rows repeat: what is read off the pages is small, so that is where repeats are dropped."""
    rows = load(spark, folder, "web_resources").where("coalesce(is_main, true) and data is not null").select("resource_id", "url", "data")
    return spread(rows).select("resource_id", "url", page_text(F.col("data")).alias("html"))


def external(href: Column) -> Column:
    return F.regexp_like(href, F.lit(r"^(https?:)?//"))


def _rows(spark: SparkSession, folder: str, part: str) -> DataFrame:
    rows = pages(spark, folder).select("resource_id", F.posexplode(extract(F.col("html"), part)[part]).alias("pos", "x"))
    return rows.dropDuplicates(["resource_id", "pos"])


def q_links(spark, folder):
    return _rows(spark, folder, "links").select("resource_id", F.col("pos").cast("bigint").alias("pos"), "x.*", external(F.col("x.href")).alias("external"))


def q_link_statistics(spark, folder):
    return link_statistics(q_links(spark, folder), "resource_id")


def link_statistics(links: DataFrame, key: str) -> DataFrame:
    return links.groupBy(key).agg(
        F.count("*").alias("total"), F.count_if("external").alias("n_external"), F.count_if(~F.col("external")).alias("n_internal"),
        F.count_if(F.col("title").isNotNull()).alias("with_title"), F.count_if(F.col("target").isNotNull()).alias("with_target"), F.count_if(F.col("href") == "").alias("broken"),
    )


def q_html_headings(spark, folder):
    return _rows(spark, folder, "headings").select("resource_id", F.col("pos").cast("bigint").alias("pos"), "x.*")


def q_images(spark, folder):
    return _rows(spark, folder, "images").select("resource_id", F.col("pos").cast("bigint").alias("pos"), "x.*")


def q_tables(spark, folder):
    cells = _rows(spark, folder, "tables").select("resource_id", "pos", F.posexplode("x").alias("row", "cells"))
    return cells.select("resource_id", F.col("pos").cast("bigint").alias("table_no"), F.col("row").cast("bigint").alias("row_no"), F.array_join("cells", " | ").alias("cells"))


def q_forms(spark, folder):
    return _rows(spark, folder, "forms").select("resource_id", "x.action", "x.method", F.explode("x.fields").alias("f")).select("resource_id", "action", "method", "f.*")


def q_definitions(spark, folder):
    return _rows(spark, folder, "definitions").select("resource_id", "x.*")


def q_quotes(spark, folder):
    return _rows(spark, folder, "quotes").select("resource_id", "x.*")


def q_code(spark, folder):
    return _rows(spark, folder, "code").select("resource_id", "x.*")


def q_metadata(spark, folder):
    return pages(spark, folder).select("resource_id", F.explode(extract(F.col("html"), "metadata")["metadata"]).alias("name", "content")).distinct()


def q_comments(spark, folder):
    rows = pages(spark, folder).select("resource_id", F.posexplode(comments(F.col("html"))).alias("pos", "text")).dropDuplicates(["resource_id", "pos"])
    text = F.trim("text")
    return rows.select(
        "resource_id", F.col("pos").cast("bigint").alias("pos"), text.alias("text"),
        (F.startswith(text, F.lit("[")) | F.contains(text, F.lit("DOCTYPE"))).alias("directive"),
        (F.contains(text, F.lit("[if ")) | F.contains(text, F.lit("[endif]"))).alias("conditional"),
    )


# ------------------------------------------------------------------ pages built from a table, whose rows are known

_BUILT = (
    "<!DOCTYPE html>\n<html lang='en'><head><title>{p_name}</title><meta name='Brand' content='{p_brand}'><meta property='og:type' content='{p_type}'><style>p {{}}</style></head>\n"
    "<body><h1 id='top'>{p_name}</h1><h4>Kind</h4><p>See <a href='/part/{p_partkey}' title='{p_brand}'>{p_name}</a> or <a href='https://x.example/{p_partkey}' rel=nofollow>the <b>list</b></a><a href='#top'>up</a>."
    "<p><img src='/{p_partkey}.png'><img alt='none'><!-- [if part {p_partkey}] --><table><tr><td>size<td>kind<tr><th>a<th>b<tr><td>{p_size}<td>x|{p_type}<td>more</table>"
    "<form method=post action='/buy'><label for=q>Count</label><input id=q name=n value='{p_size}' required><input type=hidden name=h value=1><input value=2><select name=s title=Pick><option>{p_brand}</select></form>"
    "<dl><dt>brand<dt>make<dd>{p_brand}<dd>{p_type}</dl><blockquote cite='/src'>So <i>it</i> is<cite>Book</cite><footer>{p_brand}</footer></blockquote>"
    "<pre><code class='language-py'>x = {p_size}\n  y</code></pre><p>or <code data-lang=sql>select {p_size}</code><ul><li>one<ul><li>{p_size}</ul><li>two</ul><script>'</p>'</script></body></html>"
)


def built(spark: SparkSession, folder: str) -> DataFrame:
    """(p_partkey, html): a page for each part with one of everything."""
    names = ["p_partkey", "p_name", "p_brand", "p_type", "p_size"]
    pieces = re.split(r"\{(p_\w+)\}", _BUILT.replace("{{", "\x01").replace("}}", "\x02"))
    whole = [F.col(x).cast("string") if x in names else F.lit(x.replace("\x01", "{").replace("\x02", "}")) for x in pieces]
    return load(spark, folder, "part").select("p_partkey", F.concat(*whole).alias("html"))


def _built_rows(spark: SparkSession, folder: str, part: str) -> DataFrame:
    rows = built(spark, folder).select("p_partkey", F.posexplode(extract(F.col("html"), part)[part]).alias("pos", "x"))
    return rows.withColumn("pos", F.col("pos").cast("bigint"))


def q_built(part: str):
    return lambda spark, folder: _built_rows(spark, folder, part).select("p_partkey", "pos", "x.*")


def q_built_links(spark, folder):
    rows = _built_rows(spark, folder, "links").select("p_partkey", "pos", "x.*")
    return rows.withColumn("external", external(F.col("href")))


def q_built_link_statistics(spark, folder):
    return link_statistics(q_built_links(spark, folder), "p_partkey")


def q_built_tables(spark, folder):
    cells = _built_rows(spark, folder, "tables").select("p_partkey", F.posexplode("x").alias("row_no", "cells"))
    return cells.select("p_partkey", F.col("row_no").cast("bigint").alias("row_no"), F.array_join("cells", " ~ ").alias("cells"))


def q_built_forms(spark, folder):
    return _built_rows(spark, folder, "forms").select("p_partkey", "x.action", "x.method", F.posexplode("x.fields").alias("pos", "f")).select(
        "p_partkey", "action", "method", F.col("pos").cast("bigint").alias("pos"), "f.*"
    )


def q_built_metadata(spark, folder):
    return built(spark, folder).select("p_partkey", F.explode(extract(F.col("html"), "metadata")["metadata"]).alias("name", "content"))


def q_built_comments(spark, folder):
    found = built(spark, folder).select("p_partkey", F.explode(comments(F.col("html"))).alias("c"))
    return found.select("p_partkey", F.trim("c").alias("text"), F.contains("c", F.lit("[if ")).alias("conditional"))


def q_built_stripped(spark, folder):
    html = strip_images(strip_comments(strip_silent(F.col("html"))))
    return built(spark, folder).select("p_partkey", html.alias("html"))


def q_built_markdown(spark, folder):
    return built(spark, folder).select("p_partkey", to_markdown(F.col("html")).alias("r")).select("p_partkey", "r.markdown", "r.error")


def q_built_text(spark, folder):
    return built(spark, folder).select("p_partkey", to_text(F.col("html")).alias("r")).select("p_partkey", "r.text", "r.error")


def link_summary(links: DataFrame, key: str) -> DataFrame:
    """(key, summary): how many links a page has, then its outer and its inner ones as Markdown, in order."""
    item = F.concat(F.lit("- ["), "text", F.lit("]("), "href", F.lit(")"))
    lists = links.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", "external", item.alias("item")))).alias("l"))
    some = lambda on: F.array_join(F.transform(F.filter("l", lambda x: x["external"] == on), lambda x: x["item"]), "\n")
    return lists.select(key, F.concat_ws("\n", F.concat(F.size("l").cast("string"), F.lit(" links")), F.lit("## External"), some(True), F.lit("## Internal"), some(False)).alias("summary"))


def q_built_link_summary(spark, folder):
    return link_summary(q_built_links(spark, folder), "p_partkey")


def heading_outline(heads: DataFrame, key: str) -> DataFrame:
    """(key, outline): the headings of a page as an indented list, in order."""
    line = F.concat(F.repeat(F.lit("  "), (F.col("level") - 1).cast("int")), F.lit("- "), "text", F.lit(" (h"), F.col("level").cast("string"), F.lit(")"))
    lists = heads.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    return lists.select(key, F.array_join(F.transform("l", lambda x: x["line"]), "\n").alias("outline"))


def q_built_outline(spark, folder):
    return heading_outline(q_built("headings")(spark, folder), "p_partkey")


def form_text(forms: DataFrame, key: str) -> DataFrame:
    """(key, markdown): the fields of forms (key, action, method, pos and a field's columns) as a list under the form's method and address."""
    item = F.concat(
        F.lit("- "), F.coalesce("label", "name"), F.lit(" ("), "type", F.lit(")"), F.when(F.col("required"), " *").otherwise(""), F.coalesce(F.concat(F.lit(": "), "value"), F.lit(""))
    )
    lists = forms.groupBy(key, "action", "method").agg(F.sort_array(F.collect_list(F.struct("pos", item.alias("item")))).alias("l"))
    head = F.concat(F.lit("**Form** "), "method", F.lit(" "), F.coalesce("action", F.lit("")))
    return lists.select(key, F.concat(head, F.lit("\n"), F.array_join(F.transform("l", lambda x: x["item"]), "\n")).alias("markdown"))


def q_built_form_text(spark, folder):
    return form_text(q_built_forms(spark, folder), "p_partkey")


def q_stripped(spark, folder):
    html = strip_images(strip_comments(strip_silent(F.col("html"))))
    return pages(spark, folder).select("resource_id", F.length("html").cast("bigint").alias("n_before"), F.length(html).cast("bigint").alias("n_after")).distinct()


def q_markdown(spark, folder):
    return pages(spark, folder).select("resource_id", to_markdown(F.col("html")).alias("r")).select("resource_id", "r.markdown", "r.error").dropDuplicates(["resource_id"])


def q_text(spark, folder):
    return pages(spark, folder).select("resource_id", to_text(F.col("html")).alias("r")).select("resource_id", "r.text", "r.error").dropDuplicates(["resource_id"])


QUERIES = {
    "html_links": q_links, "html_link_statistics": q_link_statistics, "html_headings": q_html_headings, "html_images": q_images, "html_tables": q_tables,
    "html_forms": q_forms, "html_definitions": q_definitions, "html_quotes": q_quotes, "html_code": q_code, "html_metadata": q_metadata,
    "html_comments": q_comments, "html_stripped": q_stripped, "html_to_markdown": q_markdown, "html_to_text": q_text,
    "built_links": q_built_links, "built_link_statistics": q_built_link_statistics, "built_link_summary": q_built_link_summary, "built_headings": q_built("headings"), "built_outline": q_built_outline,
    "built_images": q_built("images"), "built_tables": q_built_tables, "built_forms": q_built_forms, "built_form_text": q_built_form_text, "built_definitions": q_built("definitions"),
    "built_quotes": q_built("quotes"), "built_code": q_built("code"), "built_metadata": q_built_metadata, "built_comments": q_built_comments, "built_stripped": q_built_stripped,
    "built_markdown": q_built_markdown, "built_text": q_built_text,
}


def _sql_of(template: str) -> str:
    """A template with columns in braces as a SQL expression."""
    parts = [f"{x}" if k % 2 else "'" + x.replace("'", "''").replace("\x01", "{").replace("\x02", "}") + "'" for k, x in enumerate(re.split(r"\{(p_\w+)\}", template.replace("{{", "\x01").replace("}}", "\x02")))]
    return " || ".join(parts).replace("\n", "' || chr(10) || '")


def _values(*rows: tuple, names: tuple[str, ...]) -> str:
    """Rows of a part's page; strings are templates over the part's columns, None is null."""
    cell = lambda x: "NULL" if x is None else str(x).lower() if isinstance(x, bool) else f"{x}::BIGINT" if isinstance(x, int) else _sql_of(x)
    return " UNION ALL ".join("SELECT p_partkey, " + ", ".join(f"{cell(x)} AS {n}" for n, x in zip(names, row)) + " FROM part" for row in rows)


_MARKDOWN = (
    "# {p_name}\n\n#### Kind\n\nSee [{p_name}](/part/{p_partkey}) or [the **list**](https://x.example/{p_partkey})[up](#top).\n\n![Image](/{p_partkey}.png)\n\n| a | b |\n| --- | --- |\n| size | kind |\n| {p_size} | x\\|{p_type} |"
    "\n\nCount{p_brand}\n\n**brand**\n: {p_brand}\n\n**make**\n: {p_brand}\n\n**brand**\n: {p_type}\n\n**make**\n: {p_type}\n\n> So *it* isBook\n> \n> {p_brand}\n\n```python\nx = {p_size}\n  y\n```\n\nor `select {p_size}`\n\n- one\n  - {p_size}\n- two"
)
SQL = {
    "built_links": _values(
        (0, "/part/{p_partkey}", "{p_name}", "{p_brand}", None, None, False), (1, "https://x.example/{p_partkey}", "the list", None, None, "nofollow", True),
        names=("pos", "href", "text", "title", "target", "rel", "external")),
    "built_link_statistics": _values((2, 1, 1, 1, 0, 0), names=("total", "n_external", "n_internal", "with_title", "with_target", "broken")),
    "built_link_summary": _values(("2 links\n## External\n- [the list](https://x.example/{p_partkey})\n## Internal\n- [{p_name}](/part/{p_partkey})",), names=("summary",)),
    "built_headings": _values((0, 1, "{p_name}", "top"), (1, 4, "Kind", None), names=("pos", "level", "text", "id")),
    "built_outline": _values(("- {p_name} (h1)\n      - Kind (h4)",), names=("outline",)),
    "built_images": _values((0, "/{p_partkey}.png", "Image", None), names=("pos", "src", "alt", "title")),
    "built_tables": _values((0, "a ~ b"), (1, "size ~ kind"), (2, "{p_size} ~ x\\|{p_type}"), names=("row_no", "cells")),
    "built_forms": _values(("/buy", "POST", 0, "text", "n", "Count", "{p_size}", True), ("/buy", "POST", 1, "select", "s", "Pick", "{p_brand}", False), names=("action", "method", "pos", "type", "name", "label", "value", "required")),
    "built_form_text": _values(("**Form** POST /buy\n- Count (text) *: {p_size}\n- Pick (select): {p_brand}",), names=("markdown",)),
    "built_definitions": _values((0, "brand", "{p_brand}"), (1, "make", "{p_brand}"), (2, "brand", "{p_type}"), (3, "make", "{p_type}"), names=("pos", "term", "definition")),
    "built_quotes": _values((0, "So it is", "/src", "{p_brand}"), names=("pos", "text", "cite", "author")),
    "built_code": _values((0, "python", "x = {p_size}\n  y"), (1, "sql", "select {p_size}"), names=("pos", "language", "code")),
    "built_metadata": _values(("title", "{p_name}"), ("language", "en"), ("brand", "{p_brand}"), ("og_type", "{p_type}"), names=("name", "content")),
    "built_comments": _values(("[if part {p_partkey}]", True), names=("text", "conditional")),
    "built_stripped": _values((_BUILT.replace("<style>p {{}}</style>", "").replace("<script>'</p>'</script>", "").replace("<!-- [if part {p_partkey}] -->", "").replace("<img src='/{p_partkey}.png'><img alt='none'>", ""),), names=("html",)),
    "built_markdown": _values((_MARKDOWN, None), names=("markdown", "error")),
    "built_text": _values(("{p_name} Kind See {p_name} or the list up . size kind a b {p_size} x|{p_type} more Count {p_brand} brand make {p_brand} {p_type} So it is Book {p_brand} x = {p_size} y or select {p_size} one {p_size} two", None), names=("text", "error")),
}
