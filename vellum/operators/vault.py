"""The note graph: resolving links, backlinks, indexes, statistics, lookups and edits.

Names are compared in lower case within a vault. Notes are their valid rows (loaded last per path); deleted ones still count, as
the graph is of what the table holds.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from vellum.functions import text as tx
from vellum.operators.markdown import _fenced_sql, _fields_sql
from vellum.operators.skew import salted_join
from vellum.session import materialize
from vellum.tables import latest, load

NOTE_ENDING = r"\.(md|markdown)$"


def folder_of(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def depth_of(path: Column) -> Column:
    return (F.size(F.split(path, "/")) - 1).cast("bigint")


def notes_of(notes: DataFrame, columns: list[str]) -> DataFrame:
    return latest(notes.where("vault is not null and path is not null"), ["vault", "path"], "loaded_at", columns)


def target_keys(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(vault, key, prio, path): what a lower-case target may name, the least priority first.

    1 a full path, with or without its ending; 2 an attachment's path; 3 a note's name without ending; 4 its name with ending;
    5 an alias; 6 an attachment's name.
    """
    low = F.lower("path")
    name = F.regexp_extract(low, r"([^/]*)$", 1)
    bare = lambda c: F.regexp_replace(c, NOTE_ENDING, "")
    row = lambda k, p: F.struct(k.alias("key"), F.lit(p).alias("prio"))
    of_notes = notes.select(
        "vault", "path",
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(row(low, 1), row(bare(low), 1), row(bare(name), 3), row(name, 4)),
                    F.transform(F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()), lambda a: row(F.lower(a), 5)),
                )
            )
        ).alias("k"),
    )
    of_attachments = attachments.where("vault is not null and path is not null").select("vault", "path", F.explode(F.array(row(low, 2), row(name, 6))).alias("k"))
    return of_notes.unionByName(of_attachments).select("vault", "k.key", "k.prio", "path").distinct()


def resolve_links(links: DataFrame, notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(link_id, status, path): ``resolved`` with a path, ``ambiguous`` or ``broken``.

    An empty target is the note itself. With ``/`` a target is a path, else a name. Of several candidates of the best priority one in the
    link's own folder wins, else the only shallowest one. Candidates are never listed per link: links are first reduced to their
    distinct (vault, target, folder), and candidates to counts and minima per key, so a name shared by many notes costs no more than others.
    """
    target = F.lower(F.trim(F.coalesce("target", F.lit(""))))
    asked = links.select("link_id", "vault", "src", target.alias("key"), folder_of(F.col("src")).alias("folder")).dropDuplicates(["link_id"])
    keys = target_keys(notes, attachments)
    by_path = keys.where(F.contains("key", F.lit("/")) & F.col("prio").isin(1, 2))
    by_name = keys.where(~F.contains("key", F.lit("/")) & (F.col("prio") >= 3))
    keys = by_path.unionByName(by_name)
    least = keys.groupBy("vault", "key").agg(F.min("prio").alias("prio"))
    keys = keys.join(least, ["vault", "key", "prio"]).withColumn("depth", depth_of(F.col("path")))
    at_depth = keys.groupBy("vault", "key", "depth").agg(F.count("*").alias("n"), F.min("path").alias("first"))
    overall = at_depth.groupBy("vault", "key").agg(F.sum("n").alias("n"), F.min_by(F.struct("n", "first"), "depth").alias("top"))
    own = keys.groupBy("vault", "key", folder_of(F.col("path")).alias("folder")).agg(F.min("path").alias("own"))
    # counted on the map side; the counts tell which keys are hot in the join back
    counts = asked.where("key <> ''").groupBy("vault", "key", "folder").agg(F.count("*").alias("n_asked"))
    distinct = counts.drop("n_asked")
    found = (
        distinct.join(overall, ["vault", "key"])
        .join(own, ["vault", "key", "folder"], "left")
        .select(
            "vault", "key", "folder",
            F.when(F.col("n") == 1, F.col("top.first")).when(F.col("own").isNotNull(), F.col("own")).when(F.col("top.n") == 1, F.col("top.first")).alias("found"),
            F.lit(True).alias("any"),
        )
    )
    out = salted_join(asked, found, ["vault", "key", "folder"], counts, "n_asked", "left")
    path = F.when(F.col("key") == "", F.col("src")).otherwise(F.col("found"))
    return out.select(
        "link_id", "vault", "src", path.alias("path"),
        F.when(path.isNotNull(), "resolved").when(F.col("any"), "ambiguous").otherwise("broken").alias("status"),
    )


def _tables(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    # a map can't be compared, so the front matter travels as its entries
    rows = load(spark, folder, "notes").withColumn("frontmatter", F.map_entries("frontmatter"))
    notes = notes_of(rows, ["note_id", "title", "aliases", "tags", "frontmatter", "mtime", "body"])
    return notes, load(spark, folder, "attachments"), load(spark, folder, "links")


def q_resolve(spark: SparkSession, folder: str) -> DataFrame:
    notes, attachments, links = _tables(spark, folder)
    return resolve_links(links, notes, attachments).select("link_id", "status", "path")


def q_link_status(spark: SparkSession, folder: str) -> DataFrame:
    notes, attachments, links = _tables(spark, folder)
    return resolve_links(links, notes, attachments).groupBy("vault", "status").agg(F.count("*").alias("n"))


def q_backlinks(spark: SparkSession, folder: str) -> DataFrame:
    """Inbound links per note and source note."""
    notes, attachments, links = _tables(spark, folder)
    rows = resolve_links(links, notes, attachments).where("status = 'resolved' and path <> src")
    return rows.groupBy("vault", "path", "src").agg(F.count("*").alias("n_links"))


def q_unlinked(spark: SparkSession, folder: str) -> DataFrame:
    """Notes that no other note links to."""
    notes, attachments, links = _tables(spark, folder)
    hit = resolve_links(links, notes, attachments).where("status = 'resolved' and path <> src").select("vault", "path").distinct()
    return notes.join(hit, ["vault", "path"], "left_anti").select("vault", "path")


def q_tag_index(spark: SparkSession, folder: str) -> DataFrame:
    """Notes per tag, from the tag lists and from ``#tags`` in the bodies."""
    from vellum.operators.markdown import inline_tags

    notes, _, _ = _tables(spark, folder)
    listed = notes.select("vault", "note_id", F.explode("tags").alias("tag")).where("tag is not null")
    inline = inline_tags(notes.select(F.struct("vault", "note_id").alias("id"), "body"), "id", "body").select("id.vault", "id.note_id", "tag")
    return listed.unionByName(inline).distinct().groupBy("vault", "tag").agg(F.count("*").alias("n_notes"))


def q_alias_index(spark: SparkSession, folder: str) -> DataFrame:
    notes, _, _ = _tables(spark, folder)
    rows = notes.select("vault", "path", F.explode("aliases").alias("alias")).where("alias is not null")
    return rows.groupBy("vault", F.lower("alias").alias("alias")).agg(F.countDistinct("path").alias("n_notes"))


def q_statistics(spark: SparkSession, folder: str) -> DataFrame:
    """Notes and attachments per vault, ending and top-level folder."""
    notes, attachments, _ = _tables(spark, folder)
    rows = notes.select("vault", "path").unionByName(attachments.select("vault", "path"))
    top = F.when(F.contains("path", F.lit("/")), F.regexp_extract("path", r"^([^/]+)/", 1)).otherwise(".")
    return rows.select("vault", F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1)).alias("ext"), top.alias("top")).groupBy("vault", "ext", "top").agg(F.count("*").alias("n"))


def q_recent(spark: SparkSession, folder: str) -> DataFrame:
    notes, _, _ = _tables(spark, folder)
    return notes.where("mtime is not null").select("vault", "path", "mtime").orderBy(F.desc("mtime"), "vault", "path").limit(10)


def find_note(notes: DataFrame, term: str, most: int = 5) -> DataFrame:
    """(vault, path, score): 30 for a name equal to the term, 20 for an alias, 15 for a name and 5 for a body that holds it."""
    low = term.lower()
    name = F.regexp_replace(F.regexp_extract(F.lower("path"), r"([^/]*)$", 1), NOTE_ENDING, "")
    alias = F.exists(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: F.lower(a) == low)
    score = (
        F.when(name == low, 30).when(F.coalesce(alias, F.lit(False)), 20).when(F.contains(name, F.lit(low)), 15)
        .when(F.contains(F.lower("body"), F.lit(low)), 5).otherwise(0)
    )
    return notes.select("vault", "path", score.cast("bigint").alias("score")).where("score > 0").orderBy(F.desc("score"), "vault", "path").limit(most)


def q_find_note(spark: SparkSession, folder: str) -> DataFrame:
    return find_note(_tables(spark, folder)[0], "home")


def q_fields(spark: SparkSession, folder: str) -> DataFrame:
    """Front matter fields and inline fields of notes."""
    from vellum.operators.markdown import inline_fields

    notes, _, _ = _tables(spark, folder)
    front = notes.select("note_id", F.explode("frontmatter").alias("e")).select("note_id", F.col("e.key").alias("field"), F.col("e.value").alias("value"))
    inline = inline_fields(notes, "note_id", "body").select("note_id", "field", "value")
    return front.unionByName(inline)


def rename_changes(links: DataFrame, resolved: DataFrame, vault: str, old: str, new: str) -> DataFrame:
    """(link_id, src, raw, new_raw): how links to a note read after its renaming; a dry run, nothing is written.

    A target written as a path stays a path; aliases, headings and blocks are kept.
    """
    bare = lambda p: re.sub(NOTE_ENDING, "", p)
    name = bare(new).rsplit("/", 1)[-1]
    target = F.when(F.contains("target", F.lit("/")), F.lit(bare(new))).otherwise(F.lit(name))
    rest = F.concat(
        F.coalesce(F.concat(F.lit("#"), "heading"), F.lit("")), F.coalesce(F.concat(F.lit("#^"), "block"), F.lit("")),
        F.coalesce(F.concat(F.lit("|"), "alias"), F.lit("")),
    )
    hit = resolved.where((F.col("vault") == vault) & (F.col("path") == old) & (F.col("status") == "resolved")).select("link_id")
    rows = links.dropDuplicates(["link_id"]).where("trim(target) <> ''").join(hit, "link_id", "left_semi")
    return rows.select("link_id", "src", "raw", F.concat(F.when(F.col("embed"), "!").otherwise(""), F.lit("[["), target, rest, F.lit("]]")).alias("new_raw"))


def update_properties(notes: DataFrame, changes: dict[str, str | None]) -> DataFrame:
    """``notes`` with front matter keys set, or removed where the new value is null. A null map counts as empty."""
    kept = F.map_filter(F.coalesce("frontmatter", F.create_map().cast("map<string,string>")), lambda k, v: ~k.isin(list(changes)))
    new = [F.lit(x) for k, v in changes.items() if v is not None for x in (k, v)]
    return notes.withColumn("frontmatter", F.map_concat(kept, F.create_map(*new).cast("map<string,string>")) if new else kept)


def edit_section(notes: DataFrame, heading: str, content: str, mode: str = "append", text: str = "body") -> DataFrame:
    """``notes`` with ``content`` put at the end of the section under ``heading``, or in place of its body.

    A section ends before the next heading of its level or a higher one. Notes without the heading stay as they are.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(mode)
    split = tx.lines(text)
    level = lambda x: F.length(F.regexp_extract(x, r"^(#{1,6})\s", 1))
    title = lambda x: F.trim(F.regexp_replace(x, r"^#{1,6}\s+", ""))
    start = F.array_position(F.transform(split, lambda x: (level(x) > 0) & (title(x) == heading)), True).cast("int")
    rows = notes.withColumn("_l", split).withColumn("_s", start).withColumn("_k", level(F.get("_l", F.col("_s") - 1)))
    ends = F.transform("_l", lambda x, i: (i >= F.col("_s")) & (level(x) > 0) & (level(x) <= F.col("_k")))
    rows = rows.withColumn("_e", F.when(F.array_position(ends, True) > 0, F.array_position(ends, True).cast("int") - 1).otherwise(F.size("_l")))
    head = F.slice("_l", F.lit(1), F.col("_e") if mode == "append" else F.col("_s"))
    tail = F.slice("_l", F.col("_e") + 1, F.size("_l"))
    new = F.array_join(F.concat(head, F.array(F.lit(content)), tail), "\n")
    return rows.withColumn(text, F.when(F.col("_s") > 0, new).otherwise(F.col(text))).drop("_l", "_s", "_k", "_e")


CANVAS = "nodes array<struct<id string, type string, x double, y double, width double, height double, text string, file string, url string, label string>>, edges array<struct<id string, fromNode string, toNode string, label string>>"


def canvas_nodes(rows: DataFrame, key: str, text: str) -> DataFrame:
    """(key, id, type, title, group_id): the nodes of a canvas in reading order, with the smallest group that holds each."""
    parsed = rows.select(key, F.from_json(text, CANVAS).alias("c"))
    nodes = parsed.select(key, F.explode("c.nodes").alias("n")).select(key, "n.*")
    title = F.coalesce("label", F.regexp_replace(F.regexp_extract("text", r"^\s*([^\n]*)", 1), r"^#+\s*", ""), "file", "url", "id")
    groups = nodes.where("type = 'group'").select(key, F.col("id").alias("gid"), *[F.col(c).alias(f"g{c}") for c in ("x", "y", "width", "height")])
    inside = (
        (F.col("x") >= F.col("gx")) & (F.col("y") >= F.col("gy")) & (F.col("x") + F.col("width") <= F.col("gx") + F.col("gwidth"))
        & (F.col("y") + F.col("height") <= F.col("gy") + F.col("gheight")) & (F.col("id") != F.col("gid"))
    )
    held = nodes.join(groups, key).where(inside).groupBy(key, "id").agg(F.min_by("gid", F.struct(F.col("gwidth") * F.col("gheight"), "gid")).alias("group_id"))
    return nodes.join(held, [key, "id"], "left").select(key, "id", "type", title.alias("title"), "x", "y", "group_id")


def transclude(notes: DataFrame, links: DataFrame, depth: int = 3) -> DataFrame:
    """(vault, path, level, embedded): notes that a note embeds, directly or through others, up to ``depth`` levels; each once, at its least level."""
    step = links.where("status = 'resolved' and embed and path <> src").select("vault", F.col("src").alias("a"), F.col("path").alias("b")).distinct()
    seen = step.select("vault", F.col("a").alias("path"), F.col("b").alias("embedded"), F.lit(1).cast("bigint").alias("level"))
    last = seen
    for k in range(2, depth + 1):
        last = last.join(step.withColumnRenamed("a", "embedded").withColumnRenamed("b", "next"), ["vault", "embedded"]).select(
            "vault", "path", F.col("next").alias("embedded"), F.lit(k).cast("bigint").alias("level")).distinct()
        seen = seen.unionByName(last)
    return seen.where("path <> embedded").groupBy("vault", "path", "embedded").agg(F.min("level").alias("level"))


def q_transclusions(spark: SparkSession, folder: str) -> DataFrame:
    notes, attachments, links = _tables(spark, folder)
    status = resolve_links(links, notes, attachments)
    embeds = status.join(links.select("link_id", "embed").dropDuplicates(["link_id"]), "link_id")
    return transclude(notes, embeds)


def q_rename(spark: SparkSession, folder: str) -> DataFrame:
    """Changes that renaming the first note by vault and path would make."""
    notes, attachments, links = _tables(spark, folder)
    resolved = materialize(resolve_links(links, notes, attachments), "vault-resolved")
    most = resolved.where("status = 'resolved'").groupBy("vault", "path").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "vault", "path").first()
    vault, path = (most["vault"], most["path"]) if most else ("", "")
    return rename_changes(links, resolved, vault, path, "archive/Renamed note.md")


_VALID = "(SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY vault, path ORDER BY loaded_at DESC) AS rn FROM notes WHERE vault IS NOT NULL AND path IS NOT NULL) WHERE rn = 1)"
_RESOLVE = rf"""
v AS {_VALID},
keys AS (
  SELECT vault, lower(path) AS key, 1 AS prio, path FROM v UNION SELECT vault, regexp_replace(lower(path), '{NOTE_ENDING}', ''), 1, path FROM v
  UNION SELECT vault, lower(path), 2, path FROM attachments
  UNION SELECT vault, regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '{NOTE_ENDING}', ''), 3, path FROM v
  UNION SELECT vault, regexp_extract(lower(path), '([^/]*)$', 1), 4, path FROM v
  UNION SELECT vault, lower(a), 5, path FROM (SELECT vault, path, unnest(aliases) AS a FROM v) WHERE a IS NOT NULL
  UNION SELECT vault, regexp_extract(lower(path), '([^/]*)$', 1), 6, path FROM attachments),
asked AS (SELECT link_id, vault, src, regexp_extract(src, '^(.*)/[^/]*$', 1) AS folder, lower(trim(coalesce(target, ''))) AS key, embed FROM (SELECT DISTINCT ON (link_id) * FROM links)),
cand AS (SELECT a.link_id, k.path, k.prio, len(string_split(k.path, '/')) AS depth, regexp_extract(k.path, '^(.*)/[^/]*$', 1) = a.folder AS own
  FROM asked a JOIN keys k ON k.vault = a.vault AND k.key = a.key AND (contains(k.key, '/') AND k.prio <= 2 OR NOT contains(k.key, '/') AND k.prio >= 3) WHERE a.key <> ''),
best AS (SELECT * FROM cand c WHERE prio = (SELECT min(prio) FROM cand d WHERE d.link_id = c.link_id)),
pick AS (SELECT link_id, CASE WHEN count(*) = 1 THEN min(path) WHEN count(*) FILTER (WHERE own) > 0 THEN min(path) FILTER (WHERE own)
  WHEN count(*) FILTER (WHERE depth = m) = 1 THEN min(path) FILTER (WHERE depth = m) END AS path
  FROM (SELECT *, min(depth) OVER (PARTITION BY link_id) AS m FROM best) GROUP BY link_id),
res AS (SELECT a.link_id, a.vault, a.src, a.embed, CASE WHEN a.key = '' THEN a.src ELSE p.path END AS path,
  CASE WHEN a.key = '' AND a.src IS NOT NULL OR p.path IS NOT NULL THEN 'resolved' WHEN p.link_id IS NOT NULL THEN 'ambiguous' ELSE 'broken' END AS status FROM asked a LEFT JOIN pick p USING (link_id))"""

QUERIES = {
    "resolve_links": q_resolve, "link_status": q_link_status, "backlinks": q_backlinks, "unlinked_notes": q_unlinked, "tag_index": q_tag_index,
    "alias_index": q_alias_index, "vault_statistics": q_statistics, "recent_notes": q_recent, "find_note": q_find_note, "note_fields": q_fields,
    "transclusions": q_transclusions, "rename_dry_run": q_rename,
}
SQL = {
    "resolve_links": f"WITH {_RESOLVE} SELECT link_id, status, path FROM res",
    "link_status": f"WITH {_RESOLVE} SELECT vault, status, count(*) AS n FROM res GROUP BY ALL",
    "backlinks": f"WITH {_RESOLVE} SELECT vault, path, src, count(*) AS n_links FROM res WHERE status = 'resolved' AND path <> src GROUP BY ALL",
    "unlinked_notes": f"WITH {_RESOLVE} SELECT vault, path FROM v WHERE NOT EXISTS (SELECT 1 FROM res r WHERE r.vault = v.vault AND r.path = v.path AND r.status = 'resolved' AND r.path <> r.src)",
    "transclusions": f"""WITH RECURSIVE {_RESOLVE.lstrip()}, e AS (SELECT DISTINCT vault, src AS a, path AS b FROM res WHERE status = 'resolved' AND embed AND path <> src),
  t AS (SELECT vault, a AS path, b AS embedded, 1 AS level FROM e UNION SELECT t.vault, t.path, e.b, level + 1 FROM t JOIN e ON e.vault = t.vault AND e.a = t.embedded WHERE level < 3)
  SELECT vault, path, embedded, min(level)::BIGINT AS level FROM t WHERE path <> embedded GROUP BY ALL""",
    "tag_index": rf"""WITH v AS {_VALID}, t AS (SELECT vault, note_id, unnest(tags) AS tag FROM v UNION
  SELECT vault, note_id, regexp_extract(w, '^#([\p{{L}}\p{{N}}/_-]+)', 1) FROM (SELECT vault, note_id, unnest(regexp_split_to_array(line, '\s+')) AS w FROM
    (SELECT vault, note_id, line, regexp_matches(line, '^\s*(```|~~~)') OR count(*) FILTER (WHERE regexp_matches(line, '^\s*(```|~~~)')) OVER (PARTITION BY vault, note_id ORDER BY pos) % 2 = 1 AS fenced
    FROM (SELECT vault, note_id, unnest(string_split(body, chr(10))) AS line, generate_subscripts(string_split(body, chr(10)), 1) AS pos FROM v)) WHERE NOT fenced)
  WHERE regexp_matches(w, '^#[\p{{L}}\p{{N}}/_-]*\p{{L}}[\p{{L}}\p{{N}}/_-]*'))
  SELECT vault, tag, count(DISTINCT note_id) AS n_notes FROM t WHERE tag IS NOT NULL GROUP BY ALL""",
    "alias_index": f"SELECT vault, lower(a) AS alias, count(DISTINCT path) AS n_notes FROM (SELECT vault, path, unnest(aliases) AS a FROM {_VALID}) WHERE a IS NOT NULL GROUP BY ALL",
    "vault_statistics": f"""SELECT vault, lower(regexp_extract(path, '\\.([^./]+)$', 1)) AS ext, CASE WHEN contains(path, '/') THEN regexp_extract(path, '^([^/]+)/', 1) ELSE '.' END AS top,
  count(*) AS n FROM (SELECT vault, path FROM {_VALID} UNION ALL SELECT vault, path FROM attachments) GROUP BY ALL""",
    "note_fields": f"SELECT note_id, unnest(map_keys(frontmatter)) AS field, unnest(map_values(frontmatter)) AS value FROM {_VALID} UNION ALL SELECT note_id, field, value FROM ({_fields_sql('note_id', _fenced_sql('note_id', 'body', _VALID))})",
    "rename_dry_run": f"""WITH {_RESOLVE}, top AS (SELECT vault, path FROM res WHERE status = 'resolved' GROUP BY ALL ORDER BY count(*) DESC, vault, path LIMIT 1)
  SELECT l.link_id, l.src, l.raw, CASE WHEN l.embed THEN '!' ELSE '' END || '[[' || CASE WHEN contains(l.target, '/') THEN 'archive/Renamed note' ELSE 'Renamed note' END || coalesce('#' || l.heading, '') || coalesce('#^' || l.block, '') || coalesce('|' || l.alias, '') || ']]' AS new_raw
  FROM (SELECT DISTINCT ON (link_id) * FROM links) l JOIN res r USING (link_id) JOIN top ON top.vault = r.vault AND top.path = r.path WHERE r.status = 'resolved' AND trim(l.target) <> ''""",
    "recent_notes": f"SELECT vault, path, mtime FROM {_VALID} WHERE mtime IS NOT NULL ORDER BY mtime DESC, vault, path LIMIT 10",
    "find_note": rf"""SELECT vault, path, score FROM (SELECT vault, path, CASE WHEN name = 'home' THEN 30 WHEN coalesce(list_contains(list_transform(aliases, lambda a: lower(a)), 'home'), false) THEN 20
  WHEN contains(name, 'home') THEN 15 WHEN contains(lower(body), 'home') THEN 5 ELSE 0 END::BIGINT AS score FROM
  (SELECT *, regexp_replace(regexp_extract(lower(path), '([^/]*)$', 1), '{NOTE_ENDING}', '') AS name FROM {_VALID})) WHERE score > 0 ORDER BY score DESC, vault, path LIMIT 5""",
}
