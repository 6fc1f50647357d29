"""Every query with an oracle against DuckDB on the smallest tables."""

from pathlib import Path

import duckdb
import pytest
from lodestone.plans.catalog import ORACLES, QUERIES


def _plain(v):
    return float(v) if isinstance(v, int) and not isinstance(v, bool) else round(v, 6) if isinstance(v, float) else str(v)


def _rows(rows, columns, names):
    at = [names.index(c) for c in columns]
    return sorted(tuple(str(_plain(r[i])) for i in at) for r in rows)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_duckdb(spark, small, name):
    con = duckdb.connect()
    for p in Path(small).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    df = QUERIES[name](spark, small)
    cursor = con.execute(ORACLES[name])
    names = [d[0] for d in cursor.description]
    columns = sorted(df.columns)
    assert sorted(names) == columns
    assert _rows([tuple(r) for r in df.collect()], columns, df.columns) == _rows(cursor.fetchall(), columns, names)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs(spark, small, name):
    assert QUERIES[name](spark, small).count() > 0
