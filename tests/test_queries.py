"""Every query of the core: against its SQL, or at least that it runs; and over empty tables."""

import pytest

from vellum import registry

DATA = "/root/testdata/sf0.001"
QUERIES, SQL = registry.queries(), registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, check, name):
    check(spark, QUERIES[name], SQL[name], DATA)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    frame = QUERIES[name](spark, DATA)
    assert frame.columns and len(set(frame.columns)) == len(frame.columns)
    frame.collect()


@pytest.mark.parametrize("name", ["p2_found", "keywords_tfidf", "near_duplicate_classes", "resolve_links", "chunk_markdown", "html_links", "retrieve_context", "vector_search"])
def test_empty_tables(spark, empty_folder, name):
    assert QUERIES[name](spark, str(empty_folder)).count() == 0


def test_core_stands_alone():
    import pathlib

    for p in pathlib.Path(registry.__file__).parent.rglob("*.py"):
        if "llm" not in p.parts:
            assert "vellum.llm" not in p.read_text(), p
