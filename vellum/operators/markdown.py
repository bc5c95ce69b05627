"""Rows from Markdown: headings, sections, chunks, links, tags, tasks, fields, callouts, blocks, questions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.tables import load, spread

MAX_TOKENS = 256
OVERLAP = 32


def fence_mask(lines: Column) -> Column:
    """For each line whether it lies in a code fence or opens or closes one.

    The places of the fences cut the lines into runs that are outside and inside by turns, so the mask is made run by run and
    nothing has to be shuffled to count fences."""
    marks = F.transform(lines, lambda x, i: F.when(F.regexp_like(x, F.lit(r"^\s*(```|~~~)")), i))
    places = F.array_compact(marks)
    inside = lambda k: k % 2 == 1
    start = lambda p, k: F.when(k == 0, 0).when(inside(k), F.get(p, k - 1)).otherwise(F.get(p, k - 1) + 1)
    end = lambda p, k, n: F.when(k == F.size(p), n).when(inside(k), F.get(p, k) + 1).otherwise(F.get(p, k))
    runs = lambda p: F.transform(F.sequence(F.lit(0), F.size(p)), lambda k: F.array_repeat(inside(k), end(p, k, F.size(lines)) - start(p, k)))
    return F.flatten(F.get(F.transform(F.array(places), runs), F.lit(0)))


def line_rows(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, pos, line, fenced): one row per line; ``fenced`` if it lies in a code fence or opens or closes one."""
    cut = rows.where(F.col(text).isNotNull()).select(key, tx.lines(text).alias("_lines")).withColumn("_fenced", fence_mask(F.col("_lines")))
    each = cut.select(key, F.posexplode(F.arrays_zip("_lines", "_fenced")).alias("pos", "z"))
    return each.select(key, "pos", F.col("z._lines").alias("line"), F.col("z._fenced").alias("fenced"))


def heading_level(line: Column) -> Column:
    """1 to 6 for a line of as many ``#`` and a space, else null."""
    found = F.length(F.regexp_extract(line, r"^\s*(#{1,6}) ", 1))
    return F.when(found > 0, found)


def title_of(line: Column) -> Column:
    return F.trim(F.regexp_replace(line, r"^\s*#{1,6} ", ""))


def headings(rows: DataFrame, key: str = "doc_id", text: str = "text", fences: bool = False) -> DataFrame:
    """(key, pos, level, title, anchor, path): headings in order with their ancestors' titles.

    A heading is on another's path if it is the last of its level before and no heading of a lower level came since; six running
    maxima decide that without a stack. Anchors are slugs, numbered from the second on.
    """
    cut = line_rows(rows, key, text) if fences else rows.where(F.col(text).isNotNull()).select(
        key, F.posexplode(tx.lines(text)).alias("pos", "line")
    ).withColumn("fenced", F.lit(False))
    found = cut.withColumn("level", heading_level(F.col("line"))).where("level is not null and not fenced")
    found = found.withColumn("title", title_of(F.col("line")))
    here = Window.partitionBy(key).orderBy("pos")
    out = found
    for k in range(1, 7):
        out = out.withColumn(f"m{k}", F.max(F.when(F.col("level") == k, F.struct("pos", "title"))).over(here))
    on = []
    for k in range(1, 7):
        before = [F.coalesce(F.col(f"m{j}.pos"), F.lit(-1)) for j in range(1, k)]
        above = F.greatest(F.lit(-1), *before) if before else F.lit(-1)
        on.append(F.when((F.col(f"m{k}.pos") > above) & (F.lit(k) <= F.col("level")), F.col(f"m{k}.title")))
    nth = F.row_number().over(Window.partitionBy(key, "slug").orderBy("pos")) - 1
    return (
        out.withColumn("path", F.array_compact(F.array(*on)))
        .withColumn("slug", tx.slug("title"))
        .withColumn("nth", nth)
        .select(
            key, F.col("pos").cast("bigint").alias("pos"), F.col("level").cast("bigint").alias("level"), "title",
            F.when(F.col("nth") > 0, F.concat_ws("-", "slug", F.col("nth").cast("string"))).otherwise(F.col("slug")).alias("anchor"), "path",
        )
    )


def heading_audit(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Counts per level, jumps of more than one level, and whether there is one first-level heading and it comes first."""
    found = headings(rows, key, text)
    before = F.lag("level").over(Window.partitionBy(key).orderBy("pos"))
    found = found.withColumn("jump", F.col("level") > before + 1).withColumn("first", F.row_number().over(Window.partitionBy(key).orderBy("pos")) == 1)
    return found.groupBy(key).agg(
        F.count("*").alias("n_headings"), *[F.count_if(F.col("level") == k).alias(f"h{k}") for k in range(1, 7)],
        F.min("level").alias("min_level"), F.max("level").alias("max_level"), F.count_if("jump").alias("n_jumps"),
        (F.max(F.when(F.col("first"), F.col("level"))) == 1).alias("starts_at_h1"), (F.count_if(F.col("level") == 1) == 1).alias("one_h1"),
    )


def sections(rows: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, section, path, body): the lines between headings with the titles above them; section 0 has no heading.

    A text is cut within its row, by the places of its headings; nothing is shuffled."""
    cut = rows.where(F.col(text).isNotNull()).select(key, tx.lines(text).alias("l"))
    head = lambda x, i: F.when(heading_level(x).isNotNull(), F.struct(i.alias("at"), heading_level(x).alias("level"), title_of(x).alias("title")))
    cut = cut.withColumn("h", F.array_compact(F.transform("l", head)))
    none = F.array_repeat(F.lit(None).cast("string"), 6)

    def step(acc: Column, h: Column) -> Column:
        stack = F.transform(acc["stack"], lambda t, i: F.when(i + 1 < h["level"], t).when(i + 1 == h["level"], h["title"]))
        return F.struct(stack.alias("stack"), F.array_append(acc["paths"], F.array_compact(stack)).alias("paths"))

    first = F.struct(none.alias("stack"), F.array(F.array().cast("array<string>")).alias("paths"))
    paths = F.aggregate("h", first, step, lambda acc: acc["paths"])
    start = lambda k: F.when(k == 0, 0).otherwise(F.get("h", k - 1)["at"] + 1)
    end = lambda k: F.when(k == F.size("h"), F.size("l")).otherwise(F.get("h", k)["at"])
    body = lambda k: F.array_join(F.slice("l", start(k) + 1, end(k) - start(k)), "\n")
    bodies = F.transform(F.sequence(F.lit(0), F.size("h")), body)
    each = cut.select(key, F.posexplode(F.arrays_zip(bodies.alias("body"), paths.alias("path"))).alias("section", "z"))
    return each.select(key, "section", F.col("z.path").alias("path"), F.col("z.body").alias("body"))


def chunks(rows: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = MAX_TOKENS, overlap: int = OVERLAP) -> DataFrame:
    """(key, chunk_index, heading_path, text, token_estimate): bodies of sections, long ones in overlapping windows of words.

    A window has ``floor(max_tokens / 1.3)`` words and starts that less ``overlap`` after the one before; the last reaches the
    end. Empty sections give none.
    """
    most = max(32, max_tokens)
    per = max(1, int(most / 1.3))
    step = max(1, per - overlap)
    bodies = sections(rows, key, text).withColumn("body", F.regexp_replace("body", r"(?U)^\s+|\s+$", "")).where("body <> ''")
    words = tx.whitespace_words("body")
    bodies = bodies.withColumn("w", words).withColumn("n", F.size("w"))
    starts = F.when(F.ceil(F.col("n") * F.lit(1.3)) <= most, F.array(F.lit(0))).otherwise(
        F.filter(F.sequence(F.lit(0), F.col("n") - 1, F.lit(step)), lambda s: (s == 0) | (s - step + per < F.col("n")))
    )
    pieces = bodies.select(key, "section", "path", "body", "w", "n", F.explode(starts).alias("s"))
    whole = F.ceil(F.col("n") * F.lit(1.3)) <= most
    piece = F.when(whole, F.col("body")).otherwise(F.array_join(F.slice("w", F.col("s") + 1, F.lit(per)), " "))
    pieces = pieces.select(key, "section", "s", "path", piece.alias("text"))
    order = Window.partitionBy(key).orderBy("section", "s")
    return pieces.select(
        key, (F.row_number().over(order) - 1).cast("bigint").alias("chunk_index"),
        F.coalesce("path", F.array().cast("array<string>")).alias("heading_path"), "text", tx.estimate_tokens("text").alias("token_estimate"),
    )


def wikilinks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, ord, raw, embed, target, heading, block, alias): links outside fences and inline code, lines from 1."""
    plain = line_rows(rows, key, text).where("not fenced").withColumn("line_text", F.regexp_replace("line", r"`[^`]*`", ""))
    found = plain.select(key, (F.col("pos") + 1).cast("bigint").alias("line"), F.posexplode(
        F.regexp_extract_all("line_text", F.lit(r"!?\[\[[^\[\]]+\]\]"), F.lit(0))).alias("ord", "raw"))
    inside = F.regexp_replace("raw", r"^!?\[\[|\]\]$", "")
    inside = F.replace(inside, F.lit("\\|"), F.lit("|"))
    out = found.withColumn("inside", inside)
    place = F.regexp_extract("inside", r"^([^|]*)", 1)
    anchor = F.regexp_extract(place, r"#(.*)$", 1)
    null_if_empty = lambda c: F.nullif(F.trim(c), F.lit(""))
    return out.select(
        key, "line", F.col("ord").cast("bigint").alias("ord"), "raw", F.startswith("raw", F.lit("!")).alias("embed"),
        F.trim(F.regexp_extract(place, r"^([^#]*)", 1)).alias("target"),
        F.when(~F.startswith(anchor, F.lit("^")), null_if_empty(anchor)).alias("heading"),
        F.when(F.startswith(anchor, F.lit("^")), null_if_empty(F.substr(anchor, F.lit(2)))).alias("block"),
        null_if_empty(F.regexp_extract("inside", r"\|(.*)$", 1)).alias("alias"),
    )


TAG_CHAR = rf"[{tx.LETTER}\p{{N}}/_-]"


def inline_tags(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, tag): ``#tag`` at the start of a word, with a letter in it, outside fences."""
    found = F.regexp_extract_all("line", F.lit(rf"(?<!\S)#({TAG_CHAR}*{tx.LETTER}{TAG_CHAR}*)"), F.lit(1))
    return line_rows(rows, key, text).where("not fenced").select(key, (F.col("pos") + 1).cast("bigint").alias("line"), F.explode(found).alias("tag"))


# What the character in a task's brackets means.
TASK_STATES = {" ": "todo", "x": "done", "X": "done", "/": "in-progress", "-": "cancelled", ">": "forwarded", "<": "scheduled", "!": "important", "?": "question"}
_TASK_DATES = {"due": "📅", "done": "✅", "scheduled": "⏳", "start": "🛫"}


def tasks(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, indent, state, status, text, tags, due, done, scheduled, start, recurrence): check-box items outside fences."""
    pattern = r"^(\s*)(?:[-*+]|\d+[.)])\s+\[(.)\]\s+(.*)$"
    state, body = F.regexp_extract("line", pattern, 2), F.regexp_extract("line", pattern, 3)
    status = F.lit("other")
    for mark, name in TASK_STATES.items():
        status = F.when(state == mark, name).otherwise(status)
    date = lambda sign: F.nullif(F.regexp_extract(body, rf"{sign}\s*(\d{{4}}-\d{{2}}-\d{{2}})", 1), F.lit(""))
    return line_rows(rows, key, text).where(~F.col("fenced") & F.regexp_like("line", F.lit(pattern))).select(
        key, (F.col("pos") + 1).cast("bigint").alias("line"),
        F.floor(F.length(F.regexp_extract("line", pattern, 1)) / 2).cast("bigint").alias("indent"), state.alias("state"), status.alias("status"),
        F.trim(F.regexp_replace(body, r"\s*(?:[📅✅⏳🛫]\s*\d{4}-\d{2}-\d{2}|🔁\s*[^📅✅⏳🛫#]*)", "")).alias("text"),
        F.regexp_extract_all(body, F.lit(rf"(?<!\S)#({TAG_CHAR}*{tx.LETTER}{TAG_CHAR}*)"), F.lit(1)).alias("tags"),
        *[date(sign).alias(name) for name, sign in _TASK_DATES.items()],
        F.nullif(F.trim(F.regexp_extract(body, r"🔁\s*([^📅✅⏳🛫#]*)", 1)), F.lit("")).alias("recurrence"),
    )


def inline_fields(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, field, value): ``[k:: v]`` and ``(k:: v)``, and lines that are ``k:: v``; names of at most 60 characters."""
    name = rf"[{tx.LETTER}\p{{N}}_ -]{{1,60}}"
    pair = rf"[\[(]\s*({name})::\s*([^\])]*)[\])]"
    whole = rf"^\s*(?:[-*+]\s+)?({name})::\s*(.+)$"
    plain = line_rows(rows, key, text).where("not fenced")
    inside = F.arrays_zip(F.regexp_extract_all("line", F.lit(pair), F.lit(1)), F.regexp_extract_all("line", F.lit(pair), F.lit(2)))
    a = plain.select(key, "pos", F.explode(inside).alias("z")).select(key, "pos", F.col("z.0").alias("k"), F.col("z.1").alias("v"))
    b = plain.where(F.regexp_like("line", F.lit(whole)) & ~F.regexp_like("line", F.lit(pair))).select(
        key, "pos", F.regexp_extract("line", whole, 1).alias("k"), F.regexp_extract("line", whole, 2).alias("v"))
    return a.unionByName(b).select(key, (F.col("pos") + 1).cast("bigint").alias("line"), F.trim("k").alias("field"), F.trim("v").alias("value"))


def callouts(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, kind, title, fold, body): ``> [!kind]± title`` and the quoted lines that follow it."""
    head = r"^\s*>\s*\[!([^\]]+)\]([+-]?)\s*(.*)$"
    cut = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(tx.lines(text)).alias("pos", "line"))
    cut = cut.where(F.regexp_like("line", F.lit(r"^\s*>"))).withColumn("starts", F.regexp_like("line", F.lit(head)))
    here = Window.partitionBy(key).orderBy("pos")
    # an island begins at every head and after every line that isn't quoted; only quoted lines are brought together
    begins = F.col("starts") | (F.col("pos") != F.coalesce(F.lag("pos").over(here), F.lit(-2)) + 1)
    cut = cut.withColumn("begins", begins).withColumn("island", F.count_if("begins").over(here))
    folded = cut.groupBy(key, "island").agg(
        F.min_by("line", "pos").alias("head"), F.min("pos").alias("pos"), F.bool_or("starts").alias("is_callout"),
        F.sort_array(F.collect_list(F.struct("pos", "line"))).alias("all"),
    ).where("is_callout")
    body = F.transform(F.slice("all", F.lit(2), F.greatest(F.size("all") - 1, F.lit(0))), lambda x: F.regexp_replace(x["line"], r"^\s*>\s?", ""))
    kind = F.lower(F.trim(F.regexp_extract("head", head, 1)))
    title = F.trim(F.regexp_extract("head", head, 3))
    return folded.select(
        key, (F.col("pos") + 1).cast("bigint").alias("line"), kind.alias("kind"), F.when(title != "", title).otherwise(F.initcap(kind)).alias("title"),
        F.nullif(F.regexp_extract("head", head, 2), F.lit("")).alias("fold"), F.array_join(body, "\n").alias("body"),
    )


def block_ids(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, block): ``^id`` at the end of a line."""
    found = F.regexp_extract("line", rf"(?:^|\s)\^([{tx.LETTER}\p{{N}}-]+)\s*$", 1)
    return line_rows(rows, key, text).where("not fenced").select(key, (F.col("pos") + 1).cast("bigint").alias("line"), found.alias("block")).where("block <> ''")


def qa_pairs(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, line, question, answer): a ``Q:`` line with the next ``A:`` line.

    Questions between a question and its answer are passed over; a question with no later answer takes the rest of its text.
    """
    cut = rows.where(F.col(text).isNotNull()).select(key, F.posexplode(tx.lines(text)).alias("pos", "line"))
    kind = F.when(F.regexp_like("line", F.lit(r"^\s*Q:")), "q").when(F.regexp_like("line", F.lit(r"^\s*A:")), "a")
    said = cut.withColumn("kind", kind).where("kind is not null")
    here = Window.partitionBy(key).orderBy("pos")
    said = said.withColumn("before", F.lag("kind").over(here))
    # of a run of questions the first stands; of a run of answers too
    said = said.where(F.col("before").isNull() | (F.col("before") != F.col("kind")))
    said = said.withColumn("answer", F.lead("line").over(here)).where("kind = 'q'")
    said_text = lambda c: F.trim(F.regexp_replace(c, r"^\s*[QA]:", ""))
    return said.where("answer is not null").select(key, (F.col("pos") + 1).cast("bigint").alias("line"), said_text("line").alias("question"), said_text("answer").alias("answer"))


def entities(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, kind, value, n): web addresses, mail addresses, dates, and runs of capitalised words within a sentence."""
    word = F.regexp_replace("w", r"^[^\p{L}\p{N}]+|[^\p{L}\p{N}/]+$", "")
    cut = rows.where(F.col(text).isNotNull()).select(key, text)
    each = cut.select(key, F.explode(tx.whitespace_words(text)).alias("w")).select(key, word.alias("value"))
    kind = (
        F.when(F.regexp_like("value", F.lit(r"^https?://\S+\.\S+")), "url")
        .when(F.regexp_like("value", F.lit(r"^[^@\s]+@[^@\s]+\.[^@\s]+$")), "email")
        .when(tx.is_date_like("value"), "date")
    )
    a = each.withColumn("kind", kind).where("kind is not null")
    names = F.regexp_extract_all(text, F.lit(r"(?<![.!?]\s{1,3})(?<=\s)\p{Lu}[\p{Ll}\p{M}]+(?: \p{Lu}[\p{Ll}\p{M}]+)+"), F.lit(0))
    b = cut.select(key, F.explode(names).alias("value")).withColumn("kind", F.lit("name"))
    return a.select(key, "kind", "value").unionByName(b.select(key, "kind", "value")).groupBy(key, "kind", "value").agg(F.count("*").alias("n"))


def _notes(spark: SparkSession, folder: str) -> DataFrame:
    from vellum.tables import latest

    rows = load(spark, folder, "notes").where("vault is not null and path is not null")
    rows = latest(rows, ["vault", "path"], "loaded_at", ["note_id", "body"])
    return spread(rows.select("note_id", "body"))


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spread(load(spark, folder, "documents").select("doc_id", "text"))


def q_headings(spark, folder):
    return headings(_documents(spark, folder)).withColumn("path", F.array_join("path", " > "))


def q_heading_audit(spark, folder):
    return heading_audit(_documents(spark, folder))


def q_chunks(spark, folder):
    return chunks(_documents(spark, folder)).withColumn("heading_path", F.array_join("heading_path", " > "))


def q_wikilinks(spark, folder):
    return wikilinks(_notes(spark, folder), "note_id", "body")


def q_inline_tags(spark, folder):
    return inline_tags(_documents(spark, folder), "doc_id", "text")


def q_tasks(spark, folder):
    return tasks(_documents(spark, folder), "doc_id", "text").withColumn("tags", F.array_join("tags", " "))


def q_task_status(spark, folder):
    return tasks(_documents(spark, folder), "doc_id", "text").groupBy("status").agg(F.count("*").alias("n"))


def q_todos(spark, folder):
    rows = _documents(spark, folder).where("text is not null").select("doc_id", F.posexplode(tx.lines("text")).alias("pos", "line"))
    return rows.where(F.contains("line", F.lit("- [ ]"))).select("doc_id", (F.col("pos") + 1).cast("bigint").alias("line"), F.trim("line").alias("todo"))


def q_inline_fields(spark, folder):
    """Fields of documents under lines that hold their language and source as fields."""
    rows = load(spark, folder, "documents")
    head = F.concat(F.lit("lang:: "), "lang", F.lit("\n- see (source:: "), "source", F.lit(") and [n:: 1]\n"), "text")
    return inline_fields(spread(rows.select("doc_id", head.alias("text"))), "doc_id", "text")


def q_callouts(spark, folder):
    return callouts(_documents(spark, folder), "doc_id", "text")


def q_qa_pairs(spark, folder):
    return qa_pairs(_documents(spark, folder), "doc_id", "text")


def q_entities(spark, folder):
    return entities(_documents(spark, folder), "doc_id", "text")


def q_frontmatter(spark, folder):
    """Scalar fields of the block between leading ``---`` lines."""
    rows = _documents(spark, folder).where("text is not null").select("doc_id", F.explode(F.split(tx.frontmatter("text"), "\n")).alias("line"))
    pattern = r"^([A-Za-z][\w -]*):\s*(.*)$"
    return rows.where(F.regexp_like("line", F.lit(pattern))).select("doc_id", F.regexp_extract("line", pattern, 1).alias("field"), F.trim(F.regexp_extract("line", pattern, 2)).alias("value"))


_LINES = "(SELECT doc_id, unnest(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10))) AS line, generate_subscripts(string_split(replace(text, chr(13) || chr(10), chr(10)), chr(10)), 1) - 1 AS pos FROM documents WHERE text IS NOT NULL)"
_FENCED = rf"(SELECT *, regexp_matches(line, '^\s*(```|~~~)') OR count(*) FILTER (WHERE regexp_matches(line, '^\s*(```|~~~)')) OVER (PARTITION BY doc_id ORDER BY pos) % 2 = 1 AS fenced FROM {_LINES})"
_LEVELS = rf"(SELECT *, nullif(length(regexp_extract(line, '^\s*(#{{1,6}}) ', 1)), 0) AS level, trim(regexp_replace(line, '^\s*#{{1,6}} ', '')) AS title FROM {_LINES})"
_STATUS = " ".join(f"WHEN '{m}' THEN '{n}'" for m, n in TASK_STATES.items())
_TASK = r"^(\s*)(?:[-*+]|\d+[.)])\s+\[(.)\]\s+(.*)$"

_CALLOUTS = r"""SELECT doc_id, (min(pos) + 1)::BIGINT AS line, lower(trim(regexp_extract(min_by(line, pos), '^\s*>\s*\[!([^\]]+)\]', 1))) AS kind,
  coalesce(nullif(trim(regexp_extract(min_by(line, pos), '^\s*>\s*\[!([^\]]+)\]([+-]?)\s*(.*)$', 3)), ''), upper(kind[1]) || kind[2:]) AS title,
  nullif(regexp_extract(min_by(line, pos), '^\s*>\s*\[!([^\]]+)\]([+-]?)', 2), '') AS fold,
  coalesce(string_agg(regexp_replace(line, '^\s*>\s?', ''), chr(10) ORDER BY pos) FILTER (WHERE NOT starts), '') AS body
  FROM (SELECT *, count(*) FILTER (WHERE starts OR before IS NULL OR before <> pos - 1) OVER (PARTITION BY doc_id ORDER BY pos) AS island FROM
    (SELECT *, regexp_matches(line, '^\s*>\s*\[!([^\]]+)\]([+-]?)\s*(.*)$') AS starts, lag(pos) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM """ + _LINES + r""" WHERE regexp_matches(line, '^\s*>')))
  GROUP BY doc_id, island HAVING bool_or(starts)"""
_FIELD_NAME = r"[\p{L}\p{N}_ -]{1,60}"


def _fields_sql(key: str, rows: str) -> str:
    """Inline fields of ``rows`` (key, pos, line, fenced)."""
    pair, whole = rf"[\[(]\s*({_FIELD_NAME})::\s*([^\])]*)[\])]", rf"^\s*(?:[-*+]\s+)?({_FIELD_NAME})::\s*(.+)$"
    return (
        f"SELECT {key}, line_no AS line, trim(k) AS field, trim(v) AS value FROM (SELECT {key}, (pos + 1)::BIGINT AS line_no, unnest(regexp_extract_all(line, '{pair}', 1)) AS k, unnest(regexp_extract_all(line, '{pair}', 2)) AS v FROM {rows} WHERE NOT fenced "
        f"UNION ALL SELECT {key}, (pos + 1)::BIGINT, regexp_extract(line, '{whole}', 1), regexp_extract(line, '{whole}', 2) FROM {rows} WHERE NOT fenced AND regexp_matches(line, '{whole}') AND NOT regexp_matches(line, '{pair}'))"
    )


def _fenced_sql(key: str, text: str, table: str) -> str:
    """(key, pos, line, fenced) of the lines of a table's texts."""
    split = f"string_split(replace({text}, chr(13) || chr(10), chr(10)), chr(10))"
    return (
        rf"(SELECT *, regexp_matches(line, '^\s*(```|~~~)') OR count(*) FILTER (WHERE regexp_matches(line, '^\s*(```|~~~)')) OVER (PARTITION BY {key} ORDER BY pos) % 2 = 1 AS fenced FROM "
        rf"(SELECT {key}, unnest({split}) AS line, generate_subscripts({split}, 1) - 1 AS pos FROM {table} WHERE {text} IS NOT NULL))"
    )


_NOTES = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault, path ORDER BY loaded_at DESC, note_id DESC) AS rn FROM notes WHERE vault IS NOT NULL AND path IS NOT NULL) WHERE rn = 1)"
_WITH_FIELDS = "(SELECT doc_id, 'lang:: ' || lang || chr(10) || '- see (source:: ' || source || ') and [n:: 1]' || chr(10) || text AS text FROM documents)"
_MARKS = "📅✅⏳🛫"
_ITEM = r"^(\s*)(?:[-*+]|\d+[.)])\s+\[(.)\]\s+(.*)$"
_WORDS_OF = r"[^\t-\r \x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]+"

QUERIES = {
    "headings": q_headings, "heading_audit": q_heading_audit, "chunk_markdown": q_chunks, "wikilinks": q_wikilinks, "inline_tags": q_inline_tags,
    "tasks": q_tasks, "task_status": q_task_status, "active_todos": q_todos, "inline_fields": q_inline_fields, "callouts": q_callouts,
    "qa_pairs": q_qa_pairs, "entities": q_entities, "frontmatter_fields": q_frontmatter,
}
SQL = {
    "heading_audit": f"""WITH h AS (SELECT *, lag(level) OVER w AS before, row_number() OVER w AS r FROM {_LEVELS} WHERE level IS NOT NULL WINDOW w AS (PARTITION BY doc_id ORDER BY pos))
  SELECT doc_id, count(*) AS n_headings, {", ".join(f"count(*) FILTER (WHERE level = {k}) AS h{k}" for k in range(1, 7))}, min(level)::BIGINT AS min_level, max(level)::BIGINT AS max_level,
  count(*) FILTER (WHERE level > before + 1) AS n_jumps, max(CASE WHEN r = 1 THEN level END) = 1 AS starts_at_h1, count(*) FILTER (WHERE level = 1) = 1 AS one_h1 FROM h GROUP BY doc_id""",
    "headings": rf"""WITH h AS (SELECT *, lower(title) AS t FROM {_LEVELS} WHERE level IS NOT NULL),
  s AS (SELECT *, replace(regexp_replace(t, '[^\p{{L}}\p{{N}} -]', '', 'g'), ' ', '-') AS slug FROM h),
  n AS (SELECT *, row_number() OVER (PARTITION BY doc_id, slug ORDER BY pos) - 1 AS nth FROM s),
  up AS (SELECT a.doc_id, a.pos, b.pos AS bpos, b.title AS btitle FROM n a JOIN n b ON b.doc_id = a.doc_id AND b.pos <= a.pos AND b.level <= a.level
    AND NOT EXISTS (SELECT 1 FROM n c WHERE c.doc_id = a.doc_id AND c.pos > b.pos AND c.pos <= a.pos AND c.level <= b.level))
  SELECT n.doc_id, n.pos::BIGINT AS pos, level::BIGINT AS level, title, CASE WHEN nth > 0 THEN slug || '-' || nth ELSE slug END AS anchor,
  (SELECT string_agg(btitle, ' > ' ORDER BY bpos) FROM up WHERE up.doc_id = n.doc_id AND up.pos = n.pos) AS path FROM n""",
    "callouts": _CALLOUTS,
    "inline_fields": _fields_sql("doc_id", _fenced_sql("doc_id", "text", _WITH_FIELDS)),
    "tasks": rf"""SELECT doc_id, (pos + 1)::BIGINT AS line, (length(regexp_extract(line, '{_ITEM}', 1)) // 2)::BIGINT AS indent, regexp_extract(line, '{_ITEM}', 2) AS state,
  CASE regexp_extract(line, '{_ITEM}', 2) {_STATUS} ELSE 'other' END AS status, trim(regexp_replace(b, '\s*(?:[{_MARKS}]\s*\d{{4}}-\d{{2}}-\d{{2}}|🔁\s*[^{_MARKS}#]*)', '', 'g')) AS text,
  array_to_string(list_filter(list_transform(regexp_split_to_array(b, '\s+'), lambda t: regexp_extract(t, '^#([\p{{L}}\p{{N}}/_-]+)', 1)), lambda t: regexp_matches(t, '\p{{L}}')), ' ') AS tags,
  {", ".join(f"nullif(regexp_extract(b, '{m}\\s*(\\d{{{{4}}}}-\\d{{{{2}}}}-\\d{{{{2}}}})', 1), '') AS {n}".replace("{{", "{").replace("}}", "}") for n, m in _TASK_DATES.items())},
  nullif(trim(regexp_extract(b, '🔁\s*([^{_MARKS}#]*)', 1)), '') AS recurrence FROM (SELECT *, regexp_extract(line, '{_ITEM}', 3) AS b FROM {_FENCED} WHERE NOT fenced AND regexp_matches(line, '{_ITEM}'))""",
    "wikilinks": rf"""WITH r AS (SELECT note_id, (pos + 1)::BIGINT AS line, unnest(m) AS raw, (generate_subscripts(m, 1) - 1)::BIGINT AS ord FROM
    (SELECT note_id, pos, regexp_extract_all(regexp_replace(line, '`[^`]*`', '', 'g'), '!?\[\[[^\[\]]+\]\]') AS m FROM {_fenced_sql("note_id", "body", _NOTES)} WHERE NOT fenced)),
  i AS (SELECT *, replace(regexp_replace(raw, '^!?\[\[|\]\]$', '', 'g'), '\|', '|') AS inside FROM r),
  p AS (SELECT *, regexp_extract(inside, '^([^|]*)', 1) AS place, regexp_extract(regexp_extract(inside, '^([^|]*)', 1), '#(.*)$', 1) AS anchor FROM i)
  SELECT note_id, line, ord, raw, starts_with(raw, '!') AS embed, trim(regexp_extract(place, '^([^#]*)', 1)) AS target, CASE WHEN NOT starts_with(anchor, '^') THEN nullif(trim(anchor), '') END AS heading,
  CASE WHEN starts_with(anchor, '^') THEN nullif(trim(anchor[2:]), '') END AS block, nullif(trim(regexp_extract(inside, '\|(.*)$', 1)), '') AS alias FROM p""",
    "chunk_markdown": rf"""WITH h AS (SELECT * FROM {_LEVELS} WHERE level IS NOT NULL),
  up AS (SELECT a.doc_id, a.pos, b.pos AS bpos, b.title AS btitle FROM h a JOIN h b ON b.doc_id = a.doc_id AND b.pos <= a.pos AND b.level <= a.level
    AND NOT EXISTS (SELECT 1 FROM h c WHERE c.doc_id = a.doc_id AND c.pos > b.pos AND c.pos <= a.pos AND c.level <= b.level)),
  paths AS (SELECT doc_id, pos, string_agg(btitle, ' > ' ORDER BY bpos) AS path FROM up GROUP BY ALL),
  l AS (SELECT *, max(CASE WHEN level IS NOT NULL THEN pos END) OVER (PARTITION BY doc_id ORDER BY pos) AS under FROM {_LEVELS}),
  b AS (SELECT doc_id, coalesce(under, -1) AS under, regexp_replace(string_agg(line, chr(10) ORDER BY pos), '^[\t-\r \x{{85}}\x{{a0}}\x{{3000}}]+|[\t-\r \x{{85}}\x{{a0}}\x{{3000}}]+$', '', 'g') AS body FROM l WHERE level IS NULL GROUP BY ALL),
  w AS (SELECT *, regexp_extract_all(body, '{_WORDS_OF}') AS w FROM b WHERE body <> ''),
  s AS (SELECT *, unnest(CASE WHEN ceil(len(w) * 1.3::DOUBLE) <= {MAX_TOKENS} THEN [0] ELSE list_filter(range(0, len(w), {int(MAX_TOKENS / 1.3) - OVERLAP}), lambda s: s = 0 OR s + {OVERLAP} < len(w)) END) AS s FROM w),
  c AS (SELECT *, CASE WHEN ceil(len(w) * 1.3::DOUBLE) <= {MAX_TOKENS} THEN body ELSE array_to_string(w[s + 1:s + {int(MAX_TOKENS / 1.3)}], ' ') END AS text FROM s)
  SELECT c.doc_id, row_number() OVER (PARTITION BY c.doc_id ORDER BY under, s) - 1 AS chunk_index, coalesce(path, '') AS heading_path, text, ceil(len(regexp_extract_all(text, '{_WORDS_OF}')) * 1.3::DOUBLE)::BIGINT AS token_estimate
  FROM c LEFT JOIN paths ON paths.doc_id = c.doc_id AND paths.pos = under""",
    "active_todos": f"SELECT doc_id, (pos + 1)::BIGINT AS line, trim(line) AS todo FROM {_LINES} WHERE contains(line, '- [ ]')",
    "task_status": rf"""SELECT CASE regexp_extract(line, '{_TASK}', 2) {_STATUS} ELSE 'other' END AS status, count(*) AS n FROM {_FENCED} WHERE NOT fenced AND regexp_matches(line, '{_TASK}') GROUP BY 1""",
    "qa_pairs": rf"""WITH s AS (SELECT *, CASE WHEN regexp_matches(line, '^\s*Q:') THEN 'q' ELSE 'a' END AS kind FROM {_LINES} WHERE regexp_matches(line, '^\s*[QA]:')),
  b AS (SELECT *, lag(kind) OVER (PARTITION BY doc_id ORDER BY pos) AS before FROM s),
  f AS (SELECT *, lead(line) OVER (PARTITION BY doc_id ORDER BY pos) AS answer FROM b WHERE before IS NULL OR before <> kind)
  SELECT doc_id, (pos + 1)::BIGINT AS line, trim(regexp_replace(line, '^\s*[QA]:', '')) AS question, trim(regexp_replace(answer, '^\s*[QA]:', '')) AS answer FROM f WHERE kind = 'q' AND answer IS NOT NULL""",
    "frontmatter_fields": r"""SELECT doc_id, regexp_extract(line, '^([A-Za-z][\w -]*):\s*(.*)$', 1) AS field, trim(regexp_extract(line, '^([A-Za-z][\w -]*):\s*(.*)$', 2)) AS value FROM
  (SELECT doc_id, unnest(string_split(regexp_extract(text, '(?s)\A---\r?\n(.*?)\r?\n---', 1), chr(10))) AS line FROM documents WHERE text IS NOT NULL) WHERE regexp_matches(line, '^([A-Za-z][\w -]*):\s*(.*)$')""",
    "inline_tags": rf"""SELECT doc_id, (pos + 1)::BIGINT AS line, regexp_extract(t, '^#([\p{{L}}\p{{N}}/_-]+)', 1) AS tag FROM (SELECT doc_id, pos, unnest(regexp_split_to_array(line, '\s+')) AS t FROM {_FENCED} WHERE NOT fenced)
  WHERE regexp_matches(t, '^#[\p{{L}}\p{{N}}/_-]*\p{{L}}[\p{{L}}\p{{N}}/_-]*')""",
}
