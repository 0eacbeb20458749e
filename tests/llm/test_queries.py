"""Every corpus query runs on the smallest tables; those with SQL give its rows."""

import math

import duckdb
import pytest

from grainmill.llm import queries

SF = "/root/testdata/sf0.001"
KEYS = {"op1_url_templates": "pages", "op3_arc_to_warc": "pages", "op7_chat": "conversations", "chat_built_calls": "conversations"}


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark", "labels", "conversations"):
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def text(v) -> str:
    return "nan" if isinstance(v, float) and math.isnan(v) else f"{v:.9g}" if isinstance(v, float) else str(v)


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rows = df.collect()
    more = len(queries._licence_variants()) if name == "license_known_texts" else 0
    assert len(rows) - more == duck.sql(f"SELECT count(*) FROM {KEYS.get(name, 'documents')}").fetchall()[0][0]
    if name in queries.ORACLES:
        want = duck.sql(queries.ORACLES[name])
        cols = sorted(df.columns)
        at = [want.columns.index(c) for c in cols]
        assert sorted(want.columns) == cols
        assert sorted(tuple(text(r[c]) for c in cols) for r in rows) == sorted(tuple(text(r[i]) for i in at) for r in want.fetchall())
