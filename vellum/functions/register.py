"""The text functions under SQL names."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: Name, arguments and body of each function; the bodies are SQL, so they are optimised with the query that calls them.
FUNCTIONS = {
    "vellum_tokens": ("t STRING", r"filter(transform(split(t, '[^\\p{IsAlphabetic}\\p{N}\'-]+'), x -> lower(trim('\'-' FROM x))), x -> x <> '')"),
    "vellum_word_count": ("t STRING", r"CAST(regexp_count(t, '(?U)\\S+') AS BIGINT)"),
    "vellum_estimate_tokens": ("t STRING", r"CAST(ceil(regexp_count(t, '(?U)\\S+') * 1.3D) AS BIGINT)"),
    "vellum_slug": ("t STRING", r"replace(regexp_replace(lower(t), '[^\\p{IsAlphabetic}\\p{N} -]', ''), ' ', '-')"),
    "vellum_heading_level": ("t STRING", r"nullif(length(regexp_extract(t, '^\\s*(#{1,6}) ', 1)), 0)"),
    "vellum_is_date_like": ("t STRING", r"t RLIKE '^\\d{4}[-/]\\d+[-/]\\d+$'"),
    "vellum_frontmatter": ("t STRING", r"regexp_extract(t, '(?s)\\A---\\r?\\n(.*?)\\r?\\n---', 1)"),
    "vellum_cosine": ("a ARRAY<DOUBLE>, b ARRAY<DOUBLE>", "aggregate(zip_with(a, b, (x, y) -> x * y), 0D, (s, x) -> s + x) / "
                      "sqrt(aggregate(a, 0D, (s, x) -> s + x * x) * aggregate(b, 0D, (s, x) -> s + x * x))"),
}


def register(spark: SparkSession) -> list[str]:
    """Publish the functions to a session; their names are given back."""
    for name, (arguments, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({arguments}) RETURN {body}")
    return sorted(FUNCTIONS)
