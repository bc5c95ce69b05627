import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parents[1]))

from vellum.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session("tests", 8, spark__sql__shuffle__partitions="4")


@pytest.fixture(scope="session")
def check():
    """Compares a query with its SQL over a folder."""
    import duckdb

    def cell(x):
        if isinstance(x, float):
            return "null" if x != x else f"{x:.6g}"
        if x is None or str(x) in ("NaT", "<NA>"):
            return "null"
        return str(x.tolist() if hasattr(x, "tolist") else x)

    def rows(frame):
        return sorted(tuple(cell(x) for x in r) for r in frame[sorted(frame.columns)].itertuples(index=False, name=None))

    def run(spark, query, sql, folder):
        con = duckdb.connect()
        for p in Path(folder).glob("*.parquet"):
            con.execute(f"create view {p.stem} as select * from '{p}'")
        got, want = query(spark, str(folder)).toPandas(), con.execute(sql).df()
        assert sorted(got.columns) == sorted(want.columns)
        assert rows(got) == rows(want)

    return run


@pytest.fixture(scope="session")
def empty_folder(spark, tmp_path_factory):
    """All tables of the smallest folder, with no rows."""
    import pyarrow.parquet as pq

    out = tmp_path_factory.mktemp("empty")
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        pq.write_table(pq.read_table(p).slice(0, 0), out / p.name)
    return out
