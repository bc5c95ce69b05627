"""What is put together from notes and documents, on small hand-written inputs with nulls, ties and empty texts."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from vellum.functions import format as fm
from vellum.functions import register
from vellum.operators import compose, forms, html
from vellum.operators import markdown as md


def docs(spark, *texts):
    return spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)], "doc_id long, text string, line string")


def test_fences_split_lines_into_runs(spark):
    text = "a\n```\nb\n```\n```\n~~~\nc\n```"
    got = [(r.pos, r.fenced) for r in md.line_rows(docs(spark, text, None, "", "x"), "doc_id", "text").orderBy("doc_id", "pos").collect()]
    assert got[:8] == [(0, False), (1, True), (2, True), (3, True), (4, True), (5, True), (6, False), (7, True)] and got[8:] == [(0, False), (0, False)]


def test_sections_by_brute_force(spark):
    import random

    rng = random.Random(4)
    texts = ["\n".join(rng.choice(["# a", "## b", "### c", "###### d", "x", "", "y z"]) for _ in range(rng.randrange(1, 14))) for _ in range(60)]
    want = set()
    for i, text in enumerate(texts):
        stack, body, n = [None] * 6, [], 0
        for line in [*text.split("\n"), "# end"]:
            level = len(line) - len(line.lstrip("#"))
            if level:
                want.add((i, n, tuple(t for t in stack if t), "\n".join(body)))
                stack = [*stack[: level - 1], line.lstrip("# "), *[None] * (6 - level)]
                body, n = [], n + 1
            else:
                body.append(line)
    got = {(r.doc_id, r.section, tuple(r.path), r.body) for r in md.sections(docs(spark, *texts, None), "doc_id", "text").collect()}
    assert got == want


def test_contents_and_outline(spark):
    rows = docs(spark, "# A b!\n## C #\n## C\n#### É--x\n# Z", None, "", "none")
    assert [(r.doc_id, r.toc) for r in compose.contents(rows).collect()] == [(0, "## Table of Contents\n\n- [A b!](#a-b)\n- [C](#c)\n- [C](#c-1)\n    - [É--x](#é-x)\n- [Z](#z)\n\n")]
    assert compose.contents(rows, most=1).first().toc.count("\n- ") == 2
    with pytest.raises(ValueError):
        compose.contents(rows, most=7)
    assert [(r.pos, r.parent) for r in compose.outline(rows).orderBy("pos").collect()] == [(0, None), (1, 0), (2, 0), (3, 2), (4, None)]


def test_questions(spark):
    text = "Q: one?\nQ: two?\n# Three?\nA: yes\n# Four?\n\n x \nQ: in it\n# Five\n## Six?\n**Q:** last"
    got = [(r.line, r.question, r.answer) for r in compose.questions(docs(spark, text, None, "", "Q: a\nb")).orderBy("doc_id", "line").collect()]
    assert got == [(1, "one?", "yes"), (5, "Four?", "x Q: in it"), (10, "Six?", "**Q:** last"), (1, "a", "")]


def test_tables_are_put(spark):
    notes = spark.createDataFrame([(1, "# H\n| a |\n| b |"), (2, "# H"), (3, "x\n"), (4, None), (5, "# H\n## K\n| a |")], "id long, body string")
    got = {r.id: r.body for r in compose.put_table(notes, "H", ["k"], [["v"]]).collect()}
    table = "| k |\n|---|\n| v |\n"
    assert got == {1: f"# H\n{table}", 2: f"# H\n\n{table}", 3: f"x\n\n## H\n\n{table}", 4: f"## H\n\n{table}", 5: f"# H\n\n{table}\n## K\n| a |"}


def test_notes_are_created(spark):
    notes = spark.createDataFrame([("v", "a.md", "old", "t")], "vault string, path string, body string, title string")
    new = spark.createDataFrame([("v", "a.md", "new"), ("v", "b.md", "1"), ("v", "b.md", "2"), ("v", "../c", "x"), ("v", None, "x"), (None, "d.md", "x")], "vault string, path string, body string")
    rows, report = compose.created(notes, new)
    assert {(r.path, r.body) for r in rows.collect()} == {("a.md", "old"), ("b.md", "1")}
    assert sorted((r.path or "", r.error or "") for r in report.collect()) == [("", "not a path of a vault"), ("../c", "not a path of a vault"), ("a.md", "there already"), ("b.md", ""), ("b.md", "given twice"), ("d.md", "not a path of a vault")]
    assert {(r.path, r.body) for r in compose.created(notes, new, overwrite=True)[0].collect()} == {("a.md", "new"), ("b.md", "1")}


def test_callouts_as_markdown(spark):
    rows = docs(spark, "> [!tip] Title\n> a\n> b\n\n> [!note]\n> quoted\nx\n> plain", None)
    assert [r.markdown for r in compose.callouts_as_markdown(rows, "doc_id", "text").orderBy("line").collect()] == ["> **Tip: Title**\n> a\n> b\n", "> **Note**\n> quoted\n"]


def test_related_notes_and_search(spark):
    rows = docs(spark, "red apple pie #food", "red apple tart #food", "nothing at all", "---\ntags: [food, x]\n---\nsteel", None)
    got = [(r.doc_id, r.shared_tags, r.shared_terms) for r in compose.related_notes(rows, 0).collect()]
    assert got == [(1, 1, "apple, food, red"), (3, 1, "food")]
    assert compose.related_notes(rows, 99).count() == 0
    notes = spark.createDataFrame([("v", "a.md", ["area/work", "areas"], ["Al", None], {"k": "Value"}, "one\nTWO two"), ("v", "b.md", None, None, None, None)], "vault string, path string, tags array<string>, aliases array<string>, frontmatter map<string,string>, body string")
    hits = lambda q, m: [r.hit for r in compose.search_vault(notes, q, m).collect()]
    assert hits("#Area", "tag") == ["area/work"] and hits("a", "alias") == ["Al"] and hits("k=val", "field") == ["Value"] and hits("k", "field") == ["Value"]
    assert hits("two", "text") == ["TWO two"]
    with pytest.raises(ValueError):
        hits("x", "other")


def test_links_to_places(spark):
    notes = spark.createDataFrame([("v", "a.md", "# One\n```\n# No\n```\nx ^q"), ("v", "b.md", None)], "vault string, path string, body string")
    links = spark.createDataFrame([(1, "one", None), (2, "no", None), (3, None, "q"), (4, None, "z"), (5, None, None), (1, "one", None)], "link_id long, heading string, block string")
    resolved = spark.createDataFrame([(i, "v", "a.md", "resolved") for i in range(1, 6)], "link_id long, vault string, path string, status string")
    got = {r.link_id: (r.heading_found, r.block_line) for r in compose.link_places(links, resolved, notes).collect()}
    assert got == {1: (True, None), 2: (False, None), 3: (None, 5), 4: (None, None)}


def test_forms(spark):
    one = lambda c, **v: spark.createDataFrame([tuple(v.values())], ", ".join(f"{k} {'string' if not isinstance(x, int) else 'long'}" for k, x in v.items())).select(c.alias("x")).first().x
    assert one(fm.shown_token("t"), t="a\x07 \n") == r"a\u{7}␣\n" and one(fm.shown_token("t"), t="") == "(empty)" and one(fm.shown_token("t"), t=None) is None
    assert [one(fm.human_size("n"), n=n) for n in (1023, 1280, 3 << 20)] == ["1023 B", "1.3 KB", "3.0 MB"]
    assert [one(fm.relative_age("n"), n=n) for n in (59, 3599, 7200, 86400)] == ["59 sec ago", "59 min ago", "2 hrs ago", "1 days ago"]
    assert fm.date_pattern("YYYY-MM-DD at HH") == "yyyy-MM-dd 'at' HH"
    at = F.lit(dt.datetime(2026, 1, 2, 3, 4)).cast("timestamp_ntz")
    assert one(fm.rendered("{{title}} {{date:YYYY}} {{x}}", F.col("t"), at), t="T") == "T 2026 {{x}}"
    assert one(fm.offered_name("t"), t='a; filename="x y.pdf"') == "x y.pdf" and one(fm.offered_name("t"), t="a; filename=..x") is None
    vectors = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None)], "id long, v array<double>")
    assert [r.u for r in vectors.select("id", fm.unit("v").alias("u")).orderBy("id").collect()] == [[0.6, 0.8], [0.0, 0.0], None]
    embedded = forms.hash_embedding(docs(spark, "a a b", None, "")).collect()
    assert sorted(r.value for r in embedded) == [0.447214, 0.894427]


def test_registered_functions(spark):
    assert register.register(spark) == sorted(register.FUNCTIONS)
    got = spark.sql("SELECT vellum_tokens(\"It's a Rust-lang -x-\") AS a, vellum_slug('Section 1.2') AS b, vellum_estimate_tokens('a b c') AS c, vellum_tokens(NULL) AS d").first()
    assert got.a == ["it's", "a", "rust-lang", "x"] and got.b == "section-12" and got.c == 4 and got.d is None


def test_page_renderings_of_nothing(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "<p>x")], "p_partkey long, html string")
    parts = rows.select("p_partkey", html.extract(F.col("html"), "links", "forms", "metadata").alias("x")).select("x.*").collect()
    assert [r.links for r in parts] == [None, None, []] and [r.forms for r in parts] == [None, None, []]
