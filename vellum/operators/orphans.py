"""References to notes and attachments that are not there (problem 2).

Method: the keys that references use are numbered, each (range of 32,768 numbers, month) becomes a
bitmap of the keys referenced in it and a bitmap of the keys whose parent is there all month, and
``referenced AND NOT parent`` leaves the few (key, month) that need a look at exact times.

* A key is a typed string: ``P`` an exact path, ``F`` a lower-case path of a target with ``/``,
  ``N`` a lower-case bare name.
* Bitmaps are built by Spark's ``bitmap_construct_agg``, on the map side first, so a hot key costs one
  bit. The two bitmaps of a range and month meet in an Arrow UDF that decodes what survives.
* A key there for a part of the month only is decided against its merged intervals of that month.

Nulls: a null or blank target, path or ``seen_at`` is no reference; a null vault matches no note, so
its references are orphans. Repeated rows count once.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from vellum.operators.skew import salted_join
from vellum.session import materialize
from vellum.tables import latest, load

FIELDS = ("links.target", "links.src", "backlinks.from_path")
NOTE_ENDING = r"\.(md|markdown)$"
BLANK_ENDS = r"(?U)^\s+|\s+$"


def _key(kind: str, vault: Column, name: Column) -> Column:
    return F.concat(F.lit(kind), F.coalesce(vault, F.lit("\x01")), F.lit("\x00"), name)


def _file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def references(links: DataFrame, backlinks: DataFrame) -> DataFrame:
    """(ref_field, ref_id, vault, seen_at, period, key), one row per reference."""
    target = F.lower(F.regexp_replace("target", BLANK_ENDS, ""))
    of_links = links.select("link_id", "vault", "seen_at", "src", target.alias("target")).select(
        F.col("link_id").alias("ref_id"),
        "vault",
        "seen_at",
        F.explode(
            F.array(
                F.struct(
                    F.lit(FIELDS[0]).alias("ref_field"),
                    F.when(
                        F.col("target") != "",
                        F.when(F.contains("target", F.lit("/")), _key("F", F.col("vault"), F.col("target"))).otherwise(
                            _key("N", F.col("vault"), F.col("target"))
                        ),
                    ).alias("key"),
                ),
                F.struct(
                    F.lit(FIELDS[1]).alias("ref_field"),
                    F.when(F.col("src") != "", _key("P", F.col("vault"), F.col("src"))).alias("key"),
                ),
            )
        ).alias("r"),
    )
    of_backlinks = backlinks.select(
        F.lit(FIELDS[2]).alias("ref_field"),
        F.col("backlink_id").alias("ref_id"),
        "vault",
        "seen_at",
        F.when(F.col("from_path") != "", _key("P", F.col("vault"), F.col("from_path"))).alias("key"),
    )
    rows = of_links.select("r.ref_field", "ref_id", "vault", "seen_at", "r.key").unionByName(of_backlinks)
    return rows.where(F.col("key").isNotNull() & F.col("seen_at").isNotNull()).withColumn(
        "period", F.date_format("seen_at", "yyyy-MM")
    )


def valid_notes(notes: DataFrame) -> DataFrame:
    """One row per (vault, path): the one loaded last."""
    rows = notes.where(F.col("vault").isNotNull() & F.col("path").isNotNull())
    return latest(rows, ["vault", "path"], "loaded_at", ["aliases", "created_at", "deleted_at"])


def parents(notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(key, since, until): from when until when something the key denotes is there; null is open."""
    path = F.lower(F.col("path"))
    name = _file_name(path)
    bare = lambda c: F.regexp_replace(c, NOTE_ENDING, "")
    vault = F.col("vault")
    of_notes = valid_notes(notes).select(
        F.col("created_at").alias("since"),
        F.col("deleted_at").alias("until"),
        F.explode(
            F.array_distinct(
                F.concat(
                    F.array(
                        _key("P", vault, F.col("path")),
                        _key("F", vault, path),
                        _key("F", vault, bare(path)),
                        _key("N", vault, name),
                        _key("N", vault, bare(name)),
                    ),
                    F.transform(
                        F.filter(F.coalesce("aliases", F.array().cast("array<string>")), lambda a: a.isNotNull()),
                        lambda a: _key("N", vault, F.lower(a)),
                    ),
                )
            )
        ).alias("key"),
    )
    of_attachments = (
        attachments.where(F.col("vault").isNotNull() & F.col("path").isNotNull())
        .select(F.explode(F.array(_key("F", vault, path), _key("N", vault, name))).alias("key"))
        .distinct()
        .withColumn("since", F.lit(None).cast("timestamp_ntz"))
        .withColumn("until", F.lit(None).cast("timestamp_ntz"))
    )
    return of_notes.select("key", "since", "until").unionByName(of_attachments)


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def and_not(referenced: pd.Series, there: pd.Series) -> pd.Series:
    """The positions set in the first bitmap and not in the second; a null second is empty."""
    out = []
    for a, b in zip(referenced, there):
        bits = np.frombuffer(a, np.uint8)
        if b is not None:
            bits = bits & ~np.frombuffer(b, np.uint8)
        out.append(np.flatnonzero(np.unpackbits(bits, bitorder="little")).astype(np.int32))
    return pd.Series(out)


def orphan_references(links: DataFrame, backlinks: DataFrame, notes: DataFrame, attachments: DataFrame) -> DataFrame:
    """(ref_field, ref_id, vault, period, seen_at) of every reference that denotes nothing there."""
    refs = references(links, backlinks)
    used = materialize(refs.groupBy("key", "period").agg(F.count("*").alias("n")), "orphan-used")
    numbered = materialize(
        used.select("key").distinct().withColumn("id", F.monotonically_increasing_id() + 1), "orphan-keys"
    )
    known = parents(notes, attachments).join(numbered, "key").select("id", "since", "until")
    known = materialize(known, "orphan-known")

    bits = F.bitmap_construct_agg(F.bitmap_bit_position("id"))
    slot = F.bitmap_bucket_number("id").alias("slot")
    referenced = used.join(numbered, "key").groupBy(slot, "period").agg(bits.alias("referenced"))

    # the months in use, bounded by the calendar and not by the rows
    months = sorted(r["period"] for r in used.select("period").distinct().collect())
    calendar = F.array(*map(F.lit, months)) if months else F.array().cast("array<string>")
    first = lambda p: F.to_timestamp_ntz(F.concat(p, F.lit("-01")), F.lit("yyyy-MM-dd"))
    after = lambda p: F.add_months(F.to_date(F.concat(p, F.lit("-01"))), 1).cast("timestamp_ntz")
    whole = (
        known.select(
            "id",
            F.explode(
                F.filter(
                    calendar,
                    lambda p: (F.col("since").isNull() | (F.col("since") <= first(p)))
                    & (F.col("until").isNull() | (F.col("until") >= after(p))),
                )
            ).alias("period"),
        )
        .groupBy(slot, "period")
        .agg(bits.alias("there"))
    )
    left = (
        referenced.join(whole, ["slot", "period"], "left")
        .select("slot", "period", F.explode(and_not("referenced", "there")).alias("bit"))
        .select(((F.col("slot") - 1) * 32768 + F.col("bit") + 1).alias("id"), "period")
    )

    # what is there for a part of a month begins or ends in it
    edges = (
        known.select("id", "since", "until", F.explode(F.array("since", "until")).alias("edge"))
        .where(F.col("edge").isNotNull())
        .select("id", F.date_format("edge", "yyyy-MM").alias("period"), "since", "until")
        .distinct()
        .groupBy("id", "period")
        .agg(F.sort_array(F.collect_set(F.struct("since", "until"))).alias("spans"))
    )
    doubtful = (
        left.join(edges, ["id", "period"], "left")
        .join(numbered, "id")
        .join(used, ["key", "period"])
        .select("key", "period", "n", "spans")
    )
    doubtful = materialize(doubtful, "orphan-doubtful")
    there = F.exists(
        "spans",
        lambda x: (x["since"].isNull() | (x["since"] <= F.col("seen_at")))
        & (x["until"].isNull() | (x["until"] > F.col("seen_at"))),
    )
    return (
        salted_join(refs, doubtful.drop("n"), ["key", "period"], doubtful.select("key", "period", "n"), "n")
        .where(~F.coalesce(there, F.lit(False)))
        .select("ref_field", "ref_id", "vault", "period", "seen_at")
    )


def _of(spark: SparkSession, folder: str) -> DataFrame:
    return orphan_references(*[load(spark, folder, t) for t in ("links", "backlinks", "notes", "attachments")])


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return _of(spark, folder).select("ref_field", "ref_id", "period").distinct()


def p2_report(spark: SparkSession, folder: str) -> DataFrame:
    """Orphans counted per reference field, vault and month; repeated rows count once."""
    rows = _of(spark, folder).select("ref_field", "vault", "period", "ref_id").distinct()
    return rows.groupBy("ref_field", "vault", "period").agg(F.count("*").alias("n_orphans"))


_TREE = """
WITH valid AS (
  SELECT * FROM (SELECT vault, path, aliases, created_at, deleted_at,
    row_number() OVER (PARTITION BY vault, path ORDER BY loaded_at DESC) AS rn FROM notes
    WHERE vault IS NOT NULL AND path IS NOT NULL) WHERE rn = 1),
named AS (
  SELECT vault, lower(path) AS p, regexp_extract(lower(path), '([^/]*)$', 1) AS f, aliases, created_at, deleted_at FROM valid),
keys AS (
  SELECT vault, 'F' AS kind, p AS k, created_at, deleted_at FROM named
  UNION ALL SELECT vault, 'F', regexp_replace(p, '\\.(md|markdown)$', ''), created_at, deleted_at FROM named
  UNION ALL SELECT vault, 'N', f, created_at, deleted_at FROM named
  UNION ALL SELECT vault, 'N', regexp_replace(f, '\\.(md|markdown)$', ''), created_at, deleted_at FROM named
  UNION ALL SELECT vault, 'N', lower(a), created_at, deleted_at FROM (SELECT vault, unnest(aliases) AS a, created_at, deleted_at FROM named) WHERE a IS NOT NULL
  UNION ALL SELECT vault, 'P', path, created_at, deleted_at FROM valid
  UNION ALL SELECT vault, 'F', lower(path), NULL, NULL FROM attachments
  UNION ALL SELECT vault, 'N', regexp_extract(lower(path), '([^/]*)$', 1), NULL, NULL FROM attachments),
refs AS (
  SELECT 'links.target' AS ref_field, link_id AS ref_id, vault, seen_at, CASE WHEN contains(t, '/') THEN 'F' ELSE 'N' END AS kind, t AS k
    FROM (SELECT *, lower(trim(target, ' ' || chr(9) || chr(10) || chr(13) || chr(160))) AS t FROM links) WHERE t <> ''
  UNION ALL SELECT 'links.src', link_id, vault, seen_at, 'P', src FROM links WHERE src <> ''
  UNION ALL SELECT 'backlinks.from_path', backlink_id, vault, seen_at, 'P', from_path FROM backlinks WHERE from_path <> ''),
orphan AS (
  SELECT DISTINCT ref_field, ref_id, vault, strftime(seen_at, '%Y-%m') AS period FROM refs r
  WHERE seen_at IS NOT NULL AND NOT EXISTS (SELECT 1 FROM keys q WHERE q.vault = r.vault AND q.kind = r.kind AND q.k = r.k
    AND (q.created_at IS NULL OR q.created_at <= r.seen_at) AND (q.deleted_at IS NULL OR q.deleted_at > r.seen_at)))
"""

QUERIES = {"p2_found": p2_found, "p2_report": p2_report}
SQL = {
    "p2_found": _TREE + "SELECT DISTINCT ref_field, ref_id, period FROM orphan",
    "p2_report": _TREE + "SELECT ref_field, vault, period, count(*) AS n_orphans FROM orphan GROUP BY ALL",
}
