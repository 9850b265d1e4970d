"""Every query of the engine's own operators against its DuckDB statement, row by row."""

import os
from pathlib import Path

import duckdb
import pytest

from wayfarer.plans.queries import ORACLE_SQL, QUERIES

DATA = Path(os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001"))


@pytest.fixture(scope="module")
def tables():
    db = duckdb.connect()
    for f in DATA.glob("*.parquet"):
        db.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'").fetchall()
    return db


def test_each_query_has_a_statement():
    assert QUERIES.keys() == ORACLE_SQL.keys()


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, tables, name):
    db = tables.cursor()
    found = QUERIES[name](spark, str(DATA)).toArrow()
    db.register("found", found)
    db.execute(f"CREATE OR REPLACE TEMP TABLE wanted AS {ORACLE_SQL[name]}").fetchall()
    kinds = lambda t: {r[0]: r[1] for r in db.execute(f"DESCRIBE {t}").fetchall()}
    assert kinds("found") == kinds("wanted")
    columns = ", ".join(f'"{c}"' for c in sorted(kinds("found")))
    for a, b in (("wanted", "found"), ("found", "wanted")):
        assert db.execute(f"SELECT {columns} FROM {a} EXCEPT ALL SELECT {columns} FROM {b} LIMIT 3").fetchall() == []
    assert db.execute("SELECT count(*) FROM wanted").fetchone()[0] > 0
