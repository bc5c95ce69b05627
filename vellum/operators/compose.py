"""What is put together from notes and documents: contents, outlines, contexts, tables, profiles; and vault searches and link checks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import MapType

from vellum.functions import text as tx
from vellum.operators import markdown as md
from vellum.operators import search, vault
from vellum.operators.markdown import _FENCED, _LEVELS, _LINES
from vellum.operators.skew import salted_join
from vellum.operators.textstats import _DOCS, _SOME, _STOP, _TOK, documents, words_of
from vellum.operators.vault import _RESOLVE, _VALID
from vellum.tables import load


def _found_headings(rows: DataFrame, key: str, text: str) -> DataFrame:
    cut = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(tx.lines(text)).alias("pos", "line"))
    found = cut.withColumn("level", md.heading_level(F.col("line"))).where("level is not null")
    return found.select(key, "pos", "level", md.title_of(F.col("line")).alias("title"))


def contents(rows: DataFrame, key: str = "doc_id", text: str = "text", most: int = 6, title: str = "Table of Contents") -> DataFrame:
    """(key, toc): a Markdown list of links to a text's headings down to level ``most``; texts without any have no row.

    Anchors are runs of letters and digits in lower case, joined by hyphens, numbered from the second on."""
    if not 1 <= most <= 6:
        raise ValueError(most)
    found = _found_headings(rows, key, text).where(F.col("level") <= most)
    found = found.withColumn("title", F.trim(F.regexp_replace("title", r"#+\s*$", "")))
    anchor = F.regexp_replace(F.regexp_replace(F.lower("title"), rf"[^{tx.LETTER}\p{{N}}]+", "-"), "^-|-$", "")
    found = found.withColumn("anchor", anchor)
    nth = F.row_number().over(Window.partitionBy(key, "anchor").orderBy("pos")) - 1
    found = found.withColumn("anchor", F.when(nth > 0, F.concat_ws("-", "anchor", nth.cast("string"))).otherwise(F.col("anchor")))
    line = F.concat(F.repeat(F.lit("  "), F.greatest(F.col("level") - 2, F.lit(0))), F.lit("- ["), "title", F.lit("](#"), "anchor", F.lit(")\n"))
    # the headings of one text, in their order
    lines = found.groupBy(key).agg(F.sort_array(F.collect_list(F.struct("pos", line.alias("line")))).alias("l"))
    toc = F.concat(F.lit(f"## {title}\n\n"), F.array_join(F.transform("l", lambda x: x["line"]), ""), F.lit("\n"))
    return lines.select(key, toc.alias("toc"))


def outline(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, pos, level, title, anchor, parent): each heading with the place of the one it stands under, null at the top.

    That is the last heading before of a lower level, which six running maxima tell."""
    here = Window.partitionBy(key).orderBy("pos")
    found = _found_headings(rows, key, text)
    for k in range(1, 6):
        found = found.withColumn(f"m{k}", F.max(F.when(F.col("level") == k, F.col("pos"))).over(here))
    parent = F.greatest(F.lit(-1), *[F.when(F.col("level") > k, F.coalesce(f"m{k}", F.lit(-1))).otherwise(-1) for k in range(1, 6)])
    return found.select(
        key, F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "title", tx.slug("title").alias("anchor"),
        F.nullif(parent, F.lit(-1)).cast("bigint").alias("parent"),
    )


def questions(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, line, question, answer): ``Q:`` lines with the next ``A:`` line, and headings that ask with the lines up to the next heading.

    A ``Q:`` takes everything up to its answer, other questions too; without one it takes the rest of the text and its answer is empty.
    Likewise ``Q:`` lines below a heading that asks belong to its answer. One pass over a text's lines keeps only places, which are
    looked up afterwards."""
    cut = rows.where(F.col(text).isNotNull()).select(key, F.transform(tx.lines(text), lambda x: F.trim(F.translate(x, "\t\r", "  "))).alias("l"))
    asks = lambda x: F.regexp_like(x, F.lit(r"^(\*\*Q:\*\*|Q:)"))
    answers = lambda x: F.regexp_like(x, F.lit(r"^(\*\*A:\*\*|A:)"))
    head = lambda x: F.startswith(x, F.lit("#"))
    event = "struct<at:int,end:int,kind:string>"

    def step(acc: Column, x: Column) -> Column:
        line, i = x["l"], x["i"]
        open_q, open_h = acc["mode"] == "q", acc["mode"] == "h"
        ends = (open_q & answers(line)) | (open_h & head(line))
        done = F.struct(acc["at"].alias("at"), i.alias("end"), acc["mode"].alias("kind"))
        fresh = ~open_q & ~(open_h & ~head(line))
        mode = F.when(fresh & asks(line), "q").when(fresh & head(line) & F.endswith(line, F.lit("?")), "h").when(fresh | ends, "").otherwise(acc["mode"])
        return F.struct(
            mode.alias("mode"), F.when(fresh, i).otherwise(acc["at"]).alias("at"), F.when(ends, F.array_append(acc["out"], done)).otherwise(acc["out"]).alias("out")
        )

    start = F.struct(F.lit("").alias("mode"), F.lit(-1).alias("at"), F.array().cast(f"array<{event}>").alias("out"))
    last = lambda acc: F.when(
        acc["mode"] != "", F.array_append(acc["out"], F.struct(acc["at"].alias("at"), F.size("l").alias("end"), acc["mode"].alias("kind")))
    ).otherwise(acc["out"])
    numbered = F.transform("l", lambda x, i: F.struct(x.alias("l"), i.alias("i")))
    each = cut.withColumn("e", F.explode(F.aggregate(numbered, start, step, last))).select(key, "l", "e.*")
    asked = F.get("l", F.col("at"))
    said = lambda x, mark: F.trim(F.regexp_replace(x, rf"^(\*\*{mark}:\*\*|{mark}:)", ""))
    body = F.array_join(F.filter(F.slice("l", F.col("at") + 2, F.col("end") - F.col("at") - 1), lambda x: x != ""), " ")
    return each.select(
        key, (F.col("at") + 1).cast("bigint").alias("line"),
        F.when(F.col("kind") == "q", said(asked, "Q")).otherwise(F.trim(F.regexp_replace(asked, "^#+", ""))).alias("question"),
        F.when(F.col("kind") == "h", body).otherwise(F.coalesce(said(F.get("l", F.col("end")), "A"), F.lit(""))).alias("answer"),
    )


def assembled(picks: DataFrame) -> DataFrame:
    """(context): the picked chunks as one text, each under its number and source. A few chunks within a token budget."""
    part = F.concat(F.lit("["), F.col("pick").cast("string"), F.lit("] "), "source", F.lit("\n"), F.regexp_replace("text", r"(?U)^\s+|\s+$", ""))
    parts = picks.agg(F.sort_array(F.collect_list(F.struct("pick", part.alias("part")))).alias("p"))
    return parts.select(F.array_join(F.transform("p", lambda x: x["part"]), "\n\n").alias("context"))


def put_table(notes: DataFrame, heading: str, headers: list[str], rows: list[list[str]], text: str = "body") -> DataFrame:
    """``notes`` with a table in place of the first one under ``heading``, else after the heading, else under a new heading at the end.

    Null text counts as empty."""
    cell = lambda x: x.replace("|", "\\|")
    row = lambda r: "| " + " | ".join(map(cell, r)) + " |"
    table = "\n".join([row(headers), "|" + "---|" * len(headers), *map(row, rows)]) + "\n"
    l = F.split(F.coalesce(text, F.lit("")), "\n")  # noqa: E741
    is_head = lambda x: F.regexp_like(x, F.lit("^#+"))
    at = F.array_position(F.transform(l, lambda x: is_head(x) & (F.trim(F.regexp_replace(x, "^#+", "")) == heading)), True).cast("int")
    out = notes.withColumn("_l", l).withColumn("_h", at)
    # the first row of a table below the heading and before the next one
    after = F.transform("_l", lambda x, i: (i >= F.col("_h")) & (is_head(x) | F.startswith(x, F.lit("|"))))
    out = out.withColumn("_s", F.array_position(after, True).cast("int"))
    out = out.withColumn("_t", (F.col("_h") > 0) & (F.col("_s") > 0) & F.startswith(F.get("_l", F.col("_s") - 1), F.lit("|")))
    past = F.transform("_l", lambda x, i: (i >= F.col("_s")) & ~F.startswith(x, F.lit("|")))
    out = out.withColumn("_e", F.when(F.array_position(past, True) > 0, F.array_position(past, True).cast("int")).otherwise(F.size("_l") + 1))
    join = lambda *parts: F.array_join(F.concat(*parts), "\n")
    replaced = join(F.slice("_l", F.lit(1), F.col("_s") - 1), F.array(F.lit(table)), F.slice("_l", F.col("_e"), F.size("_l")))
    inserted = join(F.slice("_l", F.lit(1), F.col("_h")), F.array(F.lit(""), F.lit(table)), F.slice("_l", F.col("_h") + 1, F.size("_l")))
    body = F.coalesce(text, F.lit(""))
    added = F.concat(body, F.when(body == "", "").when(F.endswith(body, F.lit("\n")), "\n").otherwise("\n\n"), F.lit(f"## {heading}\n\n{table}"))
    new = F.when(F.col("_t"), replaced).when(F.col("_h") > 0, inserted).otherwise(added)
    return out.withColumn(text, new).drop("_l", "_h", "_s", "_t", "_e")


def created(notes: DataFrame, new: DataFrame, overwrite: bool = False) -> tuple[DataFrame, DataFrame]:
    """``notes`` with the rows ``new`` (vault, path, body) added, and (vault, path, error) of each of them; null error is done.

    A path that is there already, or comes again in ``new`` (the least body holds), is an error unless ``overwrite``; so is one
    that is null, empty or leads out of its vault."""
    bad = F.col("path").isNull() | (F.col("path") == "") | F.regexp_like("path", F.lit(r"^/|(^|/)\.\.(/|$)")) | F.col("vault").isNull()
    n = F.row_number().over(Window.partitionBy("vault", "path").orderBy("body"))
    there = notes.select("vault", "path").distinct().withColumn("there", F.lit(True))
    judged = new.select("vault", "path", "body").withColumn("n", n).join(there, ["vault", "path"], "left")
    error = F.when(bad, "not a path of a vault").when((F.col("n") > 1), "given twice")
    if not overwrite:
        error = F.when(bad, "not a path of a vault").when(F.col("n") > 1, "given twice").when(F.col("there"), "there already")
    judged = judged.withColumn("error", error)
    done = judged.where("error is null").select("vault", "path", "body")
    kept = notes.join(done.select("vault", "path"), ["vault", "path"], "left_anti") if overwrite else notes
    return kept.unionByName(done, allowMissingColumns=True), judged.select("vault", "path", "error")


def callouts_as_markdown(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, markdown): callouts as plain quotes under a bold label; a title that only repeats the kind is left out."""
    found = md.callouts(rows, key, text)
    label = F.initcap("kind")
    label = F.concat(F.lit("> **"), F.when(F.col("title") == label, label).otherwise(F.concat(label, F.lit(": "), "title")), F.lit("**\n"))
    quoted = F.when(F.col("body") == "", "").otherwise(F.concat(F.array_join(F.transform(F.split("body", "\n"), lambda x: F.concat(F.lit("> "), x)), "\n"), F.lit("\n")))
    return found.select(key, "line", F.concat(label, quoted).alias("markdown"))


def flat_tags(text: Column | str) -> Column:
    """Distinct tags of a text: those its front matter lists and ``#tags`` at the start of words."""
    c = F.col(text) if isinstance(text, str) else text
    listed = F.regexp_replace(F.regexp_extract(tx.frontmatter(c), r"(?m)^tags:(.*)$", 1), r"[\[\]\"']", "")
    inline = F.regexp_extract_all(c, F.lit(rf"(?<!\S)#({md.TAG_CHAR}*{tx.LETTER}{md.TAG_CHAR}*)"), F.lit(1))
    return F.array_distinct(F.concat(F.filter(F.split(listed, r"[,\s]+"), lambda t: t != ""), inline))


def related_notes(docs: DataFrame, target: int, most: int = 5) -> DataFrame:
    """(doc_id, score, shared_tags, shared_terms): documents by the cosine of their term counts with one document and 0.05 for each
    tag they share with it; ties by id. The one document's terms and tags travel, the others are read once."""
    from vellum.operators.similarity import related, terms

    row = docs.where(F.col("doc_id") == target).select(F.array_distinct(terms("text")).alias("t"), flat_tags("text").alias("g")).first()
    own_terms, own_tags = (sorted(row["t"] or []), row["g"] or []) if row else ([], [])
    constant = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    tags = F.size(F.array_intersect(flat_tags("text"), constant(own_tags))).cast("bigint")
    scored = related(docs, target, None).join(docs.where(F.col("doc_id") != target).select("doc_id", "text", tags.alias("shared_tags")), "doc_id", "right")
    score = F.round(F.coalesce("score", F.lit(0.0)) + 0.05 * F.col("shared_tags"), 6)
    best = scored.select("doc_id", score.alias("score"), "shared_tags", "text").where("score > 0").orderBy(F.desc("score"), "doc_id").limit(most)
    shared = F.array_sort(F.array_intersect(F.array_distinct(terms("text")), constant(own_terms)))
    return best.select("doc_id", "score", "shared_tags", F.array_join(shared, ", ").alias("shared_terms"))


def search_vault(notes: DataFrame, query: str, mode: str, most: int | None = 50) -> DataFrame:
    """(vault, path, hit) of the first notes by path: ``tag`` (that tag or one nested in it), ``alias`` (holds the query), ``field``
    (front matter key, or key=part of the value) or ``text`` (a row per line that holds the query)."""
    low = query.strip().lower()
    if mode == "tag":
        want = low.lstrip("#")
        rows = notes.select("vault", "path", F.explode("tags").alias("hit"))
        rows = rows.where((F.lower("hit") == want) | F.startswith(F.lower("hit"), F.lit(want + "/")))
    elif mode == "alias":
        rows = notes.select("vault", "path", F.explode("aliases").alias("hit")).where(F.contains(F.lower("hit"), F.lit(low)))
    elif mode == "field":
        key, _, value = query.partition("=")
        entries = F.map_entries("frontmatter") if isinstance(notes.schema["frontmatter"].dataType, MapType) else F.col("frontmatter")
        rows = notes.select("vault", "path", F.explode(entries).alias("f")).where(F.col("f.key") == key.strip())
        rows = rows.where(F.contains(F.lower("f.value"), F.lit(value.strip().lower()))) if value else rows
        rows = rows.select("vault", "path", F.col("f.value").alias("hit"))
    elif mode == "text":
        rows = notes.select("vault", "path", F.explode(tx.lines("body")).alias("line")).where(F.contains(F.lower("line"), F.lit(low)))
        rows = rows.select("vault", "path", F.trim("line").alias("hit"))
    else:
        raise ValueError(f"{mode}: tag, alias, field or text")
    rows = rows.orderBy("vault", "path", "hit")
    return rows if most is None else rows.limit(most)


def link_places(links: DataFrame, resolved: DataFrame, notes: DataFrame) -> DataFrame:
    """(link_id, heading_found, block_line): for resolved links with a heading or a block, whether and where the note has it."""
    asked = links.dropDuplicates(["link_id"]).where("heading is not null or block is not null").select("link_id", F.lower("heading").alias("heading"), "block")
    asked = asked.join(resolved.where("status = 'resolved'").select("link_id", "vault", "path"), "link_id")
    named = notes.select(F.struct("vault", "path").alias("id"), "body")
    heads = md.line_rows(named, "id", "body").where("not fenced").select("id.vault", "id.path", md.heading_level(F.col("line")).alias("level"), F.lower(md.title_of(F.col("line"))).alias("heading"))
    heads = heads.where("level is not null").select("vault", "path", "heading").distinct().withColumn("there", F.lit(True))
    blocks = md.block_ids(named, "id", "body").groupBy("id.vault", "id.path", "block").agg(F.min("line").alias("block_line"))
    # links to one heading of one note may be any share of all
    to = asked.groupBy("vault", "path", "heading").agg(F.count("*").alias("n"))
    found = salted_join(asked, heads, ["vault", "path", "heading"], to, "n", "left")
    to = asked.groupBy("vault", "path", "block").agg(F.count("*").alias("n"))
    found = salted_join(found, blocks, ["vault", "path", "block"], to, "n", "left")
    return found.select("link_id", F.when(F.col("heading").isNotNull(), F.coalesce("there", F.lit(False))).alias("heading_found"), "block_line")


def outlinks(notes: DataFrame) -> DataFrame:
    """(note_id, target, n): what stands in double brackets, by count."""
    found = F.explode(F.regexp_extract_all("body", F.lit(r"\[\[([^\[\]]+)\]\]"), F.lit(1)))
    return notes.select("note_id", found.alias("target")).groupBy("note_id", "target").agg(F.count("*").alias("n"))


def backlink_lines(links: DataFrame, resolved: DataFrame, notes: DataFrame) -> DataFrame:
    """(vault, path, src, line, context): inbound links of notes with the line they stand in; empty where the source has no such line."""
    rows = resolved.where("status = 'resolved' and path <> src").join(links.dropDuplicates(["link_id"]).select("link_id", "line"), "link_id")
    wanted = rows.select("vault", "src", "line").distinct()
    # only the lines that are asked for, each once; the bodies stay where they are read
    lines = notes.select("vault", F.col("path").alias("src"), F.posexplode(tx.lines("body")).alias("pos", "context"))
    lines = lines.select("vault", "src", (F.col("pos") + 1).cast("int").alias("line"), "context").join(wanted, ["vault", "src", "line"])
    rows = rows.join(lines, ["vault", "src", "line"], "left")
    return rows.select("vault", "path", "src", F.col("line").cast("bigint").alias("line"), F.coalesce("context", F.lit("")).alias("context"))


def profile(docs: DataFrame) -> DataFrame:
    """(doc_id, n_headings, n_tasks, n_links, n_tags, n_questions, n_sentences): what a knowledge index counts, in one scan."""
    l = tx.lines("text")  # noqa: E741
    matching = lambda pattern: F.size(F.filter(l, lambda x: F.regexp_like(x, F.lit(pattern)))).cast("bigint")
    return docs.select(
        "doc_id", matching(r"^\s*#{1,6} ").alias("n_headings"), matching(r"^\s*(?:[-*+]|\d+[.)])\s+\[.\]\s").alias("n_tasks"),
        F.regexp_count("text", F.lit(r"\[\[[^\[\]]+\]\]")).cast("bigint").alias("n_links"), F.size(flat_tags("text")).cast("bigint").alias("n_tags"),
        matching(r"^\s*Q:").alias("n_questions"), tx.sentence_count("text").alias("n_sentences"),
    )


def q_contents(spark, folder):
    return contents(documents(spark, folder))


def q_outline(spark, folder):
    return outline(documents(spark, folder))


def q_questions(spark, folder):
    return questions(documents(spark, folder))


def q_assembled(spark, folder):
    return assembled(search.q_retrieve_context(spark, folder))


def q_put_table(spark, folder):
    """Notes built from nations, a third of them with a table under the heading, a third with the heading alone, a third without."""
    k = F.col("n_nationkey") % 3
    body = F.when(k == 0, "# Top\n\n## Sizes\ntext\n| a |\n|---|\n| 1 |\nrest\n## End\n| b |").when(k == 1, "# Sizes\ntext\n# End\n| b |").otherwise(F.concat(F.lit("# "), "n_name"))
    notes = load(spark, folder, "nation").select("n_nationkey", body.alias("body"))
    return put_table(notes, "Sizes", ["name", "n|m"], [["x", "1"], ["y", "2"]])


def q_callouts_markdown(spark, folder):
    return callouts_as_markdown(documents(spark, folder), "doc_id", "text")


def q_related_notes(spark, folder):
    return related_notes(documents(spark, folder), 1)


def _vault(spark, folder, query, mode):
    return search_vault(vault._tables(spark, folder)[0], query, mode)


def q_link_places(spark, folder):
    notes, attachments, links = vault._tables(spark, folder)
    return link_places(links, vault.resolve_links(links, notes, attachments), notes)


def q_outlinks(spark, folder):
    return outlinks(vault._tables(spark, folder)[0])


def q_backlink_lines(spark, folder):
    notes, attachments, links = vault._tables(spark, folder)
    return backlink_lines(links, vault.resolve_links(links, notes, attachments), notes)


def q_profile(spark, folder):
    return profile(documents(spark, folder))


def q_frequent_words(spark, folder):
    return words_of(documents(spark, folder)).groupBy("word").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "word").limit(25)


def q_topic_terms(spark, folder):
    """The five most frequent words of each topic; they are counted before they are ranked, so a large topic is no large group."""
    docs = load(spark, folder, "documents").where("text is not null and topic is not null").select("doc_id", "topic", "text")
    counts = docs.select("topic", F.explode(tx.tokens("text")).alias("term")).groupBy("topic", "term").agg(F.count("*").alias("n"))
    best = Window.partitionBy("topic").orderBy(F.desc("n"), "term")
    return counts.withColumn("rank", F.row_number().over(best).cast("bigint")).where("rank <= 5")


_TAGS = (
    r"list_distinct(list_concat(list_filter(regexp_split_to_array(regexp_replace(regexp_extract(regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---', 1), '(?m)^tags:(.*)$', 1), '[\[\]\"'']', '', 'g'), '[,\s]+'), lambda t: t <> ''), "
    r"list_filter(list_transform(regexp_split_to_array(text, '\s+'), lambda t: regexp_extract(t, '^#([\p{L}\p{N}/_-]+)', 1)), lambda t: regexp_matches(t, '\p{L}'))))"
)
_SLUG = r"replace(regexp_replace(lower(title), '[^\p{L}\p{N} -]', '', 'g'), ' ', '-')"
_T = "'| name | n\\|m |' || chr(10) || '|---|---|' || chr(10) || '| x | 1 |' || chr(10) || '| y | 2 |' || chr(10)"
_TERMS = "(" + ", ".join(f"'{t}'" for t in search.QUERY.split()) + ")"
_RANKED = rf"""ranked AS (SELECT *, row_number() OVER (ORDER BY score DESC, source, chunk_index, chunk_id) AS r FROM (
  SELECT chunk_id, source, chunk_index, text, t, round(100.0::DOUBLE * len(list_filter(w, lambda t: t IN {_TERMS})) / greatest(len(w), 1) + len(list_distinct(list_filter(w, lambda t: t IN {_TERMS}))), 6) AS score
  FROM (SELECT chunk_id, source, chunk_index, text, ceil(1.3::DOUBLE * len(regexp_extract_all(text, '[^\t-\r \x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+')))::BIGINT AS t,
    list_filter(list_transform(regexp_split_to_array(text, '[^\p{{L}}\p{{N}}''-]+'), lambda t: lower(trim(t, '''-'))), lambda t: t <> '') AS w
    FROM (SELECT DISTINCT ON (chunk_id) * FROM chunks WHERE text IS NOT NULL))) WHERE score > 0),
pick AS (SELECT 0::BIGINT AS r, 0::BIGINT AS used, 0::BIGINT AS n, false AS took UNION ALL
  SELECT k.r, CASE WHEN k.ok THEN used + k.t ELSE used END, CASE WHEN k.ok THEN n + 1 ELSE n END, k.ok FROM
  (SELECT c.r, c.t, p.used, p.n, p.n < 8 AND p.used < 2000 AND (p.used + c.t <= 2000 OR p.n = 0) AS ok FROM pick p JOIN ranked c ON c.r = p.r + 1) k)"""
_STEP = r"""CASE WHEN mode = 'q' THEN CASE WHEN ans THEN '' ELSE 'q' END WHEN mode = 'h' AND NOT head THEN 'h' WHEN ask THEN 'q' WHEN head AND right(x, 1) = '?' THEN 'h' ELSE '' END"""

QUERIES = {
    "table_of_contents": q_contents, "outline": q_outline, "questions": q_questions, "assembled_context": q_assembled, "table_upsert": q_put_table,
    "callouts_as_markdown": q_callouts_markdown, "related_notes": q_related_notes,
    "vault_search_tag": lambda s, f: _vault(s, f, "#project", "tag"), "vault_search_alias": lambda s, f: _vault(s, f, "a", "alias"),
    "vault_search_field": lambda s, f: _vault(s, f, "status=a", "field"), "vault_search_text": lambda s, f: _vault(s, f, "the ", "text"),
    "link_places": q_link_places, "outlinks": q_outlinks, "backlink_lines": q_backlink_lines, "document_profile": q_profile, "frequent_words": q_frequent_words,
    "topic_terms": q_topic_terms,
}
SQL = {
    "table_of_contents": rf"""WITH h AS (SELECT doc_id, pos, level, trim(regexp_replace(title, '#+\s*$', '')) AS title FROM {_LEVELS} WHERE level IS NOT NULL),
  a AS (SELECT *, regexp_replace(regexp_replace(lower(title), '[^\p{{L}}\p{{N}}]+', '-', 'g'), '^-|-$', '', 'g') AS anchor FROM h),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, anchor ORDER BY pos) - 1 AS nth FROM a)
  SELECT doc_id, '## Table of Contents' || chr(10) || chr(10) || string_agg(repeat('  ', greatest(level - 2, 0)::INT) || '- [' || title || '](#' || anchor || CASE WHEN nth > 0 THEN '-' || nth ELSE '' END || ')' || chr(10), '' ORDER BY pos) || chr(10) AS toc
  FROM n GROUP BY doc_id""",
    "outline": rf"""WITH h AS (SELECT doc_id, pos, level, title FROM {_LEVELS} WHERE level IS NOT NULL)
  SELECT a.doc_id, a.pos::BIGINT AS pos, a.level::BIGINT AS level, a.title, {_SLUG.replace("title", "a.title")} AS anchor, (SELECT max(b.pos) FROM h b WHERE b.doc_id = a.doc_id AND b.pos < a.pos AND b.level < a.level)::BIGINT AS parent FROM h a""",
    "questions": rf"""WITH RECURSIVE l AS (SELECT doc_id, pos, trim(translate(line, chr(9) || chr(13), '  ')) AS x FROM {_LINES}),
  f AS (SELECT doc_id, pos, x, regexp_matches(x, '^(\*\*Q:\*\*|Q:)') AS ask, regexp_matches(x, '^(\*\*A:\*\*|A:)') AS ans, starts_with(x, '#') AS head FROM l),
  d AS (SELECT doc_id, max(pos) AS last FROM f WHERE doc_id IN (SELECT doc_id FROM f WHERE ask OR (head AND right(x, 1) = '?')) GROUP BY doc_id),
  s AS (SELECT d.doc_id, -1::BIGINT AS pos, '' AS mode, -1::BIGINT AS q_at, -1::BIGINT AS e_at, '' AS e_kind FROM d UNION ALL
    SELECT f.doc_id, f.pos, {_STEP}, CASE WHEN mode = 'q' OR mode = 'h' AND NOT head THEN q_at ELSE f.pos END,
      CASE WHEN mode = 'q' AND ans OR mode = 'h' AND head THEN q_at ELSE -1 END, mode FROM s JOIN f ON f.doc_id = s.doc_id AND f.pos = s.pos + 1),
  e AS (SELECT doc_id, e_at AS q_at, e_kind AS kind, pos AS stop FROM s WHERE e_at >= 0 UNION ALL SELECT s.doc_id, q_at, mode, s.pos + 1 FROM s JOIN d ON d.doc_id = s.doc_id AND s.pos = d.last WHERE mode <> '')
  SELECT e.doc_id, (e.q_at + 1)::BIGINT AS line, CASE WHEN kind = 'q' THEN trim(regexp_replace(a.x, '^(\*\*Q:\*\*|Q:)', '')) ELSE trim(regexp_replace(a.x, '^#+', '')) END AS question,
    CASE WHEN kind = 'q' THEN coalesce((SELECT trim(regexp_replace(b.x, '^(\*\*A:\*\*|A:)', '')) FROM f b WHERE b.doc_id = e.doc_id AND b.pos = e.stop), '')
    ELSE coalesce((SELECT string_agg(b.x, ' ' ORDER BY b.pos) FROM f b WHERE b.doc_id = e.doc_id AND b.pos > e.q_at AND b.pos < e.stop AND b.x <> ''), '') END AS answer
  FROM e JOIN f a ON a.doc_id = e.doc_id AND a.pos = e.q_at""",
    "retrieve_context": f"WITH RECURSIVE {_RANKED} SELECT p.n AS pick, c.chunk_id, c.source, c.text, c.score FROM pick p JOIN ranked c USING (r) WHERE p.took",
    "assembled_context": f"WITH RECURSIVE {_RANKED} SELECT coalesce(string_agg('[' || p.n || '] ' || c.source || chr(10) || trim(c.text, ' ' || chr(10) || chr(9) || chr(13)), chr(10) || chr(10) ORDER BY p.n), '') AS context FROM pick p JOIN ranked c USING (r) WHERE p.took",
    "table_upsert": f"""SELECT n_nationkey, replace(CASE n_nationkey % 3 WHEN 0 THEN '# Top~~## Sizes~text~' || {_T} || '~rest~## End~| b |' WHEN 1 THEN '# Sizes~~' || {_T} || '~text~# End~| b |'
  ELSE '# ' || n_name || '~~## Sizes~~' || {_T} END, '~', chr(10)) AS body FROM nation""",
    "vault_search_tag": f"SELECT vault, path, hit FROM (SELECT vault, path, unnest(tags) AS hit FROM {_VALID}) WHERE lower(hit) = 'project' OR starts_with(lower(hit), 'project/') ORDER BY vault, path, hit LIMIT 50",
    "vault_search_alias": f"SELECT vault, path, hit FROM (SELECT vault, path, unnest(aliases) AS hit FROM {_VALID}) WHERE contains(lower(hit), 'a') ORDER BY vault, path, hit LIMIT 50",
    "vault_search_field": f"SELECT vault, path, hit FROM (SELECT vault, path, unnest(map_keys(frontmatter)) AS k, unnest(map_values(frontmatter)) AS hit FROM {_VALID}) WHERE k = 'status' AND contains(lower(hit), 'a') ORDER BY vault, path, hit LIMIT 50",
    "vault_search_text": f"SELECT vault, path, trim(hit) AS hit FROM (SELECT vault, path, unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) AS hit FROM {_VALID}) WHERE contains(lower(hit), 'the') ORDER BY vault, path, trim(hit) LIMIT 50",
    "outlinks": rf"SELECT note_id, target, count(*) AS n FROM (SELECT note_id, unnest(regexp_extract_all(body, '\[\[([^\[\]]+)\]\]', 1)) AS target FROM {_VALID}) GROUP BY ALL",
    "backlink_lines": f"""WITH {_RESOLVE}, b AS (SELECT vault, path, string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM v)
  SELECT r.vault, r.path, r.src, k.line::BIGINT AS line, coalesce(b.l[k.line], '') AS context FROM res r JOIN (SELECT DISTINCT ON (link_id) link_id, line FROM links) k USING (link_id)
  LEFT JOIN b ON b.vault = r.vault AND b.path = r.src WHERE r.status = 'resolved' AND r.path <> r.src""",
    "link_places": rf"""WITH {_RESOLVE}, l AS (SELECT vault, path, unnest(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(body, chr(13) || chr(10), chr(10)), chr(10)), 1) AS pos FROM v),
  m AS (SELECT *, regexp_matches(line, '^\s*(```|~~~)') OR count(*) FILTER (WHERE regexp_matches(line, '^\s*(```|~~~)')) OVER (PARTITION BY vault, path ORDER BY pos) % 2 = 1 AS fenced FROM l),
  h AS (SELECT DISTINCT vault, path, lower(trim(regexp_replace(line, '^\s*#{{1,6}} ', ''))) AS heading FROM m WHERE NOT fenced AND regexp_matches(line, '^\s*#{{1,6}} ')),
  b AS (SELECT vault, path, regexp_extract(line, '(?:^|\s)\^([\p{{L}}\p{{N}}-]+)\s*$', 1) AS block, min(pos)::BIGINT AS block_line FROM m WHERE NOT fenced GROUP BY ALL)
  SELECT r.link_id, CASE WHEN k.heading IS NOT NULL THEN h.heading IS NOT NULL END AS heading_found, b.block_line FROM res r
  JOIN (SELECT DISTINCT ON (link_id) link_id, lower(heading) AS heading, block FROM links) k USING (link_id)
  LEFT JOIN h ON h.vault = r.vault AND h.path = r.path AND h.heading = k.heading LEFT JOIN b ON b.vault = r.vault AND b.path = r.path AND b.block = k.block
  WHERE r.status = 'resolved' AND (k.heading IS NOT NULL OR k.block IS NOT NULL)""",
    "callouts_as_markdown": rf"""SELECT doc_id, line, '> **' || kind || CASE WHEN title = kind THEN '' ELSE ': ' || title END || '**' || chr(10) ||
  CASE WHEN body = '' THEN '' ELSE '> ' || replace(body, chr(10), chr(10) || '> ') || chr(10) END AS markdown FROM (SELECT doc_id, line, title, body, upper(kind[1]) || kind[2:] AS kind FROM ({md._CALLOUTS}))""",
    "document_profile": rf"""SELECT doc_id, len(list_filter(l, lambda x: regexp_matches(x, '^\s*#{{1,6}} ')))::BIGINT AS n_headings, len(list_filter(l, lambda x: regexp_matches(x, '^\s*(?:[-*+]|\d+[.)])\s+\[.\]\s')))::BIGINT AS n_tasks,
  len(regexp_extract_all(text, '\[\[[^\[\]]+\]\]'))::BIGINT AS n_links, len({_TAGS})::BIGINT AS n_tags, len(list_filter(l, lambda x: regexp_matches(x, '^\s*Q:')))::BIGINT AS n_questions,
  greatest(1, len(list_filter(regexp_split_to_array(text, '[.!?]'), lambda s: regexp_matches(s, '{_SOME}'))))::BIGINT AS n_sentences
  FROM (SELECT doc_id, text, string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)) AS l FROM {_DOCS})""",
    "related_notes": rf"""WITH t AS (SELECT doc_id, text, {_TAGS} AS tags, list_filter({_TOK}, lambda w: octet_length(encode(w)) >= 3 AND w NOT IN {_STOP}) AS w FROM {_DOCS}),
  tf AS (SELECT doc_id, term, count(*) AS n FROM (SELECT doc_id, unnest(w) AS term FROM t) GROUP BY ALL), norm AS (SELECT doc_id, sqrt(sum(n * n)) AS norm FROM tf GROUP BY doc_id),
  dots AS (SELECT b.doc_id, sum(a.n * b.n) AS dot FROM tf a JOIN tf b USING (term) WHERE a.doc_id = 1 AND b.doc_id <> 1 GROUP BY b.doc_id),
  s AS (SELECT t.doc_id, len(list_intersect(t.tags, o.tags))::BIGINT AS shared_tags, round(coalesce(round(dot / (norm * (SELECT norm FROM norm WHERE doc_id = 1)), 6), 0) + 0.05::DOUBLE * len(list_intersect(t.tags, o.tags)), 6) AS score,
    array_to_string(list_sort(list_distinct(list_intersect(t.w, o.w))), ', ') AS shared_terms FROM t JOIN t o ON o.doc_id = 1 AND t.doc_id <> 1 LEFT JOIN dots ON dots.doc_id = t.doc_id LEFT JOIN norm ON norm.doc_id = t.doc_id)
  SELECT doc_id, score, shared_tags, shared_terms FROM s WHERE score > 0 ORDER BY score DESC, doc_id LIMIT 5""",
    "frequent_words": f"SELECT word, count(*) AS n FROM (SELECT unnest({_TOK}) AS word FROM {_DOCS}) GROUP BY word ORDER BY n DESC, word LIMIT 25",
    "topic_terms": f"""SELECT topic, term, n, rank FROM (SELECT topic, term, count(*) AS n, row_number() OVER (PARTITION BY topic ORDER BY count(*) DESC, term) AS rank
  FROM (SELECT topic, unnest({_TOK}) AS term FROM documents WHERE text IS NOT NULL AND topic IS NOT NULL) GROUP BY topic, term) WHERE rank <= 5""",
}
