"""Every query against its DuckDB equivalent on the small tables; queries without one must run and give rows."""

import math

import duckdb
import pytest

from folioforge.plans.registry import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(data):
    c = duckdb.connect()
    c.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        c.sql(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    return c


def shown(v):
    if v is None or isinstance(v, float) and math.isnan(v):
        return "null"
    if isinstance(v, float):
        return str(int(v)) if v == int(v) else f"{v:.6f}"
    return str(v)


def rows(columns, data):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(shown(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(name, spark, data, con):
    got = QUERIES[name](spark, data)
    found = got.collect()
    if name not in ORACLES:
        assert got.columns
        return
    want = con.sql(ORACLES[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert rows(got.columns, found) == rows(want.columns, want.fetchall())


def test_prompts_and_columns_hold_every_row(spark, data, con):
    got = QUERIES["system_prompt_registries"](spark, data).collect()
    n = con.sql("SELECT count(*) FROM part").fetchall()[0][0]
    assert sum(r["n_types"] for r in got) == sum(len(r["instructions"].split("\n")) for r in got) == n > 20
    pages = QUERIES["column_detect_all"](spark, data).collect()
    assert len(pages) == con.sql("SELECT count(DISTINCT (l_orderkey // 4, l_linenumber % 2)) FROM lineitem").fetchall()[0][0]
    assert {r["layout"] for r in pages} == {"single", "two_column"}


def test_entry_and_contract(spark):
    import __spark_entry__ as entry

    assert set(ORACLES) <= set(entry.oracle_sql())
    assert set(QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())
