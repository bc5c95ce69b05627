"""Operators on small hand-written inputs."""

import datetime as dt
import io
import zipfile

from pyspark.sql import functions as F

from vellum.functions import htmltree as ht
from vellum.functions import text as tx
from vellum.operators import markdown as md
from vellum.operators import orphans, skew, vault
from vellum.plans import relational as rel
from vellum.sources import convert, files
from vellum.streaming import incremental


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "text string").select(column.alias("x")).first()["x"]


def test_text_functions(spark):
    assert one(spark, tx.tokens("text"), "Hello, world! Rust-lang is great.") == ["hello", "world", "rust-lang", "is", "great"]
    assert one(spark, tx.slug("text"), "Section 1.2") == "section-12"
    assert [one(spark, tx.syllables(F.col("text")), w) for w in ("cat", "apple", "readability", "make", "")] == [1, 2, 5, 1, 0]
    assert one(spark, tx.word_count("text"), "a bb a") == 3 and one(spark, tx.space_count("text"), "a bb a") == 2
    assert one(spark, tx.tokens("text"), None) is None and one(spark, tx.tokens("text"), "") == []
    assert one(spark, tx.sentence_count("text"), "the cat sat on the mat. the cat ran.") == 2
    assert one(spark, tx.fnv1a("text"), "") == -3750763034362895579
    assert one(spark, tx.fnv1a("text"), "a") == 0xAF63DC4C8601EC8C - 2**64


def test_outline_and_chunks(spark):
    rows = spark.createDataFrame([(1, "# A\none\n## B\ntwo\n## C\n### D\nx\n# E\n# E"), (2, None), (3, "")], "doc_id long, text string")
    got = {(r.title, r.anchor): r.path for r in md.headings(rows).collect()}
    assert got[("D", "d")] == ["A", "C", "D"] and got[("E", "e")] == ["E"] and ("E", "e-1") in got
    long = spark.createDataFrame([(1, "# T\n" + "w " * 400, "clash")], "doc_id long, text string, w string")
    pieces = md.chunks(long, max_tokens=100, overlap=10).collect()
    assert len(pieces) > 1 and all(p.token_estimate <= 100 and p.heading_path == ["T"] for p in pieces)


def test_rows_from_notes(spark):
    body = "- [ ] open #todo\n- [x] done ✅ 2026-07-01\n```\n- [ ] no\n[[No]]\n```\nfield:: v\n> [!tip]- Folded\n> body\n\nline ^q1\n[[A#H|b]] `[[x]]` ![[c.png#^d]]"
    rows = spark.createDataFrame([(1, body)], "id long, body string")
    tasks = md.tasks(rows, "id", "body").orderBy("line").collect()
    assert [(t.status, t.done) for t in tasks] == [("todo", None), ("done", "2026-07-01")] and tasks[0].tags == ["todo"]
    links = md.wikilinks(rows, "id", "body").orderBy("ord").collect()
    assert [(x.target, x.heading, x.block, x.alias, x.embed) for x in links] == [("A", "H", None, "b", False), ("c.png", None, "d", None, True)]
    assert [(c.kind, c.title, c.fold, c.body) for c in md.callouts(rows, "id", "body").collect()] == [("tip", "Folded", "-", "body")]
    assert [(f.field, f.value) for f in md.inline_fields(rows, "id", "body").collect()] == [("field", "v")]
    assert [b.block for b in md.block_ids(rows, "id", "body").collect()] == ["q1"]


def test_orphans_at_times(spark):
    t = lambda m, d: dt.datetime(2024, m, d)
    notes = spark.createDataFrame(
        [(1, "v", "a/N.md", ["Al", None], None, t(2, 10), t(4, 20), t(9, 1)), (1, "v", "a/N.md", None, None, None, None, t(8, 1)), (2, "v", "M.md", None, None, None, None, t(1, 1))],
        "note_id long, vault string, path string, aliases array<string>, title string, created_at timestamp_ntz, deleted_at timestamp_ntz, loaded_at timestamp_ntz",
    )
    attachments = spark.createDataFrame([("v", "x/p.png")], "vault string, path string")
    cases = [(1, " AL ", t(2, 9), True), (2, "al", t(2, 10), False), (3, "a/n", t(3, 5), False), (4, "N.md", t(4, 20), True), (5, "p.png", t(1, 1), False), (6, "", t(1, 1), None), (7, None, t(1, 1), None), (8, "zzz", t(1, 1), True)]
    links = spark.createDataFrame([(i, "v", "M.md", x, s, "clash") for i, x, s, _ in cases] * 2, "link_id long, vault string, src string, target string, seen_at timestamp_ntz, key string")
    backlinks = spark.createDataFrame([(1, "v", "gone.md", t(1, 1)), (2, None, "M.md", t(1, 1))], "backlink_id long, vault string, from_path string, seen_at timestamp_ntz")
    got = {(r.ref_field, r.ref_id) for r in orphans.orphan_references(links, backlinks, notes, attachments).distinct().collect()}
    assert got == {("links.target", i) for i, _, _, o in cases if o} | {("backlinks.from_path", 1), ("backlinks.from_path", 2)}


def test_salted_join_keeps_all_rows(spark):
    big = spark.range(20_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), "id")
    small = big.select("k").distinct().withColumn("v", F.col("k") + 1)
    weights = big.groupBy("k").agg(F.count("*").alias("n"))
    got = skew.salted_join(big, small, ["k"], weights, "n")
    assert got.count() == 20_000 and got.where("v <> k + 1").count() == 0


def test_edits(spark):
    notes = spark.createDataFrame([(1, {"a": "1", "b": "2"}, "# H\nx\n## K\ny\n# Z\nz"), (2, None, None)], "id long, frontmatter map<string,string>, body string")
    got = vault.update_properties(notes, {"a": None, "c": "3"}).orderBy("id").collect()
    assert got[0].frontmatter == {"b": "2", "c": "3"} and got[1].frontmatter == {"c": "3"}
    assert vault.edit_section(notes, "H", "new").orderBy("id").first().body == "# H\nx\n## K\ny\nnew\n# Z\nz"
    assert vault.edit_section(notes, "K", "new", "overwrite").orderBy("id").first().body == "# H\nx\n## K\nnew\n# Z\nz"


def test_canvas(spark):
    canvas = '{"nodes":[{"id":"n","type":"text","x":1,"y":1,"width":2,"height":2,"text":"# Idea\\nmore"},{"id":"g","type":"group","x":0,"y":0,"width":9,"height":9,"label":"W"}],"edges":[]}'
    rows = spark.createDataFrame([(1, canvas)], "id long, c string")
    got = {r.title: r.group_id for r in vault.canvas_nodes(rows.withColumnRenamed("id", "cid"), "cid", "c").collect()}
    assert got == {"Idea": "g", "W": None}


def test_html():
    page = "<title>T</title><body><h1>Hi</h1><p>a <b>b</b><p>c<br>d<ul><li>x<li>y</ul><table><tr><th>k<th>v<tr><td>1</table><dl><dt>t<dd>d</dl><pre><code class='language-js'>let x</code></pre><script>'</p>'</script>"
    assert ht.to_markdown(page) == "# Hi\n\na **b**\n\nc\nd\n\n- x\n- y\n\n| k | v |\n| --- | --- |\n| 1 |  |\n\n**t**\n: d\n\n```javascript\nlet x\n```"
    root = ht.parse(page + "<form method=post><label for=i>L</label><input id=i name=q><input type=hidden name=h></form><a href='#'>x</a><a href=/y>y</a>")
    assert ht.forms(root)[0][1] == "POST" and [f[2] for f in ht.forms(root)[0][3]] == ["L"]
    assert [x[0] for x in ht.links(root)] == ["/y"] and ht.metadata(root) == {"title": "T"}
    assert ht.to_text("") == "" and ht.to_markdown("<p>" * 3000 + "x").strip().endswith("x")


def test_converters():
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="w"><w:body><w:p><w:pPr><w:pStyle w:val="Heading1"/></w:pPr><w:r><w:t>T</w:t></w:r></w:p><w:p><w:r><w:rPr><w:b/></w:rPr><w:t>x</w:t></w:r></w:p></w:body></w:document>')
    assert convert.convert("docx", box.getvalue()) == ("# T\n\n**x**", None)
    assert convert.convert("csv", b"a,b\n1")[0] == "| a | b |\n| --- | --- |\n| 1 |  |"
    assert convert.convert("docx", b"junk")[1].startswith("BadZipFile") and convert.convert("pdf", b"x") == (None, "no reader for pdf")
    assert convert.convert(None, None) == (None, None) and convert.convert("py", b"x = 1")[0] == "```python\nx = 1\n```\n"
    assert convert.convert("rst", b"T\n===\n\n``c``")[0] == "# T\n\n`c`\n" and convert.convert("org", b"* A\n[[u][t]]")[0] == "# A\n[t](u)\n"
    assert convert.convert("rtf", rb"{\rtf1{\fonttbl x}Hello\par W\'e9}")[0] == "Hello\n\nWé"
    assert "# S" in convert.convert("eml", b"Subject: S\nContent-Type: text/plain\n\nbody")[0]
    assert convert.convert("rss", b"<rss><channel><title>F</title><item><title>I</title><link>u</link></item></channel></rss>")[0] == "# F\n\n## I\n\nu"
    assert convert.convert("tex", rb"\begin{document}\section{A}\textbf{b}\end{document}")[0] == "# A**b**\n"


def test_scan_and_refresh(spark, tmp_path):
    (tmp_path / "a.md").write_text("# A")
    (tmp_path / ".hidden").mkdir()
    (tmp_path / ".hidden" / "b.md").write_text("no")
    rows = files.corpus(spark, str(tmp_path))
    assert [r.markdown for r in rows.collect()] == ["# A"]
    now = spark.createDataFrame([("p", 1, "a b"), ("q", 2, "c"), (None, 1, "x")], "path string, mtime long, text string")
    index = spark.createDataFrame([("p", 1, 99, "m"), ("gone", 1, 5, "m")], "path string, mtime long, n_words long, model string")
    got = {r.path: r.n_words for r in incremental.refresh(index, now, "m", incremental.word_index).collect()}
    assert got == {"p": 99, "q": 1}


def test_asof_and_range(spark):
    left = spark.createDataFrame([(1, "a", 5), (2, "a", 1)], "id long, k string, t long")
    right = spark.createDataFrame([("a", 2, 7.0), ("a", 5, 9.0)], "k string, t long, v double")
    assert {r.id: r.v for r in rel.asof_join(left, right, ["k"], "t", "v").collect()} == {1: 9.0, 2: None}
    points = spark.createDataFrame([(1.0,), (5.0,), (9.0,)], "x double")
    ranges = spark.createDataFrame([(0.0, 5.0), (4.0, 10.0)], "lo double, hi double")
    assert rel.range_join(points, ranges, "x", "lo", "hi", 3.0).count() == 3


def test_earlier_index_has_every_outcome(spark):
    from vellum.streaming import incremental

    read = lambda t: spark.read.parquet(f"/root/testdata/sf0.001/{t}.parquet")
    documents = read("documents")
    index = incremental.earlier_index(documents, read("notes")).collect()
    files = {r.path: r.mtime for r in documents.where("path is not null and text is not null").collect()}
    own = {r.path: r.mtime for r in index if r.model == "words"}
    assert set(files) - set(own) and set(own) - set(files) and any(r.model == "other" for r in index)
    assert {files[p] == m for p, m in own.items() if p in files} == {True, False}
    got = incremental.q_refresh(spark, "/root/testdata/sf0.001").collect()
    assert {r.path for r in got} == set(files) and len(got) == len(files) and min(r.n_words for r in got) >= 0
