"""What goes wrong at the edges: deep pages, wide sheets, limits, missing parts."""

import io
import subprocess
import sys
import zipfile
from pathlib import Path

from pyspark.sql import functions as F

from vellum import session
from vellum.functions import htmltree as ht
from vellum.operators import html
from vellum.sources import convert


def zipped(**files):
    box = io.BytesIO()
    with zipfile.ZipFile(box, "w") as z:
        for name, text in files.items():
            z.writestr(name.replace("__", "/"), text)
    return box.getvalue()


def test_deep_pages(spark):
    assert ht.to_markdown("<p>" + "<b>" * 20_000 + "x").endswith("x" + "**" * 20_000)
    assert ht.to_markdown("<div>" * 20_000 + "<p>in <i>it</i>") == "in *it*"
    assert ht.to_markdown("<blockquote>" * 70 + "<p>a</p><p>b</p>").startswith("> " * 70 + "a\n")
    rows = spark.createDataFrame([(1, "<b>" * 5000 + "x"), (2, None), (3, ""), (4, "<p>a")], "id long, page string")
    got = {r.id: r.r for r in rows.select("id", html.to_markdown(F.col("page")).alias("r")).collect()}
    assert got[1].error is None and got[2].markdown is None and got[3].markdown == "" and got[4].markdown == "a"


def test_a_page_that_fails_is_a_row_with_an_error(spark):
    def breaks(page):
        raise ValueError("no")

    rows = spark.createDataFrame([("x",), (None,)], "page string").coalesce(1)
    got = rows.select(html._text_udf(breaks, "text")("page").alias("r")).collect()
    assert [(r.r.text, r.r.error) for r in got] == [(None, "ValueError: no"), (None, None)]


def test_sheets_keep_every_cell():
    ods = '<d xmlns:t="t"><t:table t:name="S"><t:table-row t:number-rows-repeated="2"><t:table-cell t:number-columns-repeated="70">x</t:table-cell><t:table-cell t:number-columns-repeated="3"/><t:table-cell>z</t:table-cell><t:table-cell t:number-columns-repeated="9000"/></t:table-row><t:table-row t:number-rows-repeated="99999"><t:table-cell/></t:table-row></t:table></d>'
    got = convert.convert("ods", zipped(**{"content.xml": ods}))[0].splitlines()
    assert got[2] == got[4] == "| " + " | ".join(["x"] * 70 + [""] * 3 + ["z"]) + " |" and len(got) == 5
    sheet = '<worksheet><sheetData><row r="1"><c r="B1" t="str"><v>{}</v></c></row></sheetData></worksheet>'
    book = zipped(
        **{
            "xl/workbook.xml": '<workbook xmlns:r="r"><sheets><sheet name="First" r:id="b"/><sheet name="Second" r:id="a"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="a" Target="worksheets/sheet1.xml"/><Relationship Id="b" Target="worksheets/sheet2.xml"/></Relationships>',
            "xl/worksheets/sheet1.xml": sheet.format("one"), "xl/worksheets/sheet2.xml": sheet.format("two"),
        }
    )
    assert convert.convert("xlsx", book)[0] == "## First\n\n|  | two |\n| --- | --- |\n\n## Second\n\n|  | one |\n| --- | --- |"


def test_limit_is_a_parameter():
    data = b"a,b\n" * 10
    assert convert.convert("csv", data, limit=8)[1] == "40 bytes; at most 8 are converted"
    assert convert.convert("csv", data, limit=None)[1] is None


def test_org_code_stays():
    text = b"* A\n#+BEGIN_SRC c++\n* not a heading\n#+define X\n[[a][b]]\n#+END_SRC\n[[a][b]]"
    assert convert.convert("org", text)[0] == "# A\n```c++\n* not a heading\n#+define X\n[[a][b]]\n```\n[b](a)\n"


def test_entry_without_the_optional_part():
    """A dependency of the training-data operators that is missing leaves the core's queries."""
    code = "import sys; sys.modules['ahocorasick'] = None; import __spark_entry__ as e; q = e.queries(); assert 'p2_found' in q and 'p8_found' not in q and set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], check=True, cwd=Path(__file__).parents[1], timeout=120)


def test_only_a_local_master_makes_its_own_folder():
    class Context:
        def __init__(self, master):
            self.master, self.made = master, None

        def getCheckpointDir(self):
            return None

        def setCheckpointDir(self, folder):
            self.made = folder

    class Spark:
        def __init__(self, master):
            self.sparkContext = Context(master)
            self.conf = {}

    for master in ("local-cluster[3,2,1024]", "spark://host:7077", "yarn"):
        try:
            session.shared_dir(Spark(master))
        except RuntimeError:
            continue
        raise AssertionError(master)
    assert session.shared_dir(Spark("local[8]")).startswith("file://")
