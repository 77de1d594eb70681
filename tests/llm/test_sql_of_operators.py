"""Each query that has SQL against it, over the small tables."""

from pathlib import Path

import duckdb
import pytest

from corpuslens.llm import queries


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_sql(spark, small, name):
    db = duckdb.connect()
    for file in Path(small).glob("*.parquet"):
        db.execute(f"CREATE VIEW {file.stem} AS SELECT * FROM '{file}'")
    sql = db.sql(queries.ORACLES[name])
    got = queries.QUERIES[name](spark, small)
    assert sorted(got.columns) == sorted(sql.columns)
    flat = lambda rows: sorted(repr(tuple(round(x, 9) if isinstance(x, float) else x for x in r)) for r in rows)
    assert flat(got.select(*sql.columns).collect()) == flat(sql.fetchall())
