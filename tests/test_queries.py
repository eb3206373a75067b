"""Every query against its DuckDB oracle, on whole tables of the smallest scale."""

import duckdb
import pytest

from quadloom.plans.catalog import ORACLES, QUERIES

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, con, sf_dir, name):
    got = QUERIES[name](spark, sf_dir).toArrow()
    if name not in ORACLES:
        assert got.num_rows > 0
        return
    want = con.sql(ORACLES[name]).to_arrow_table()
    columns = sorted(got.column_names)
    assert columns == sorted(want.column_names)
    con.register("got", got)
    con.register("want", want)
    listed = ", ".join(f'"{c}"' for c in columns)
    assert not con.sql(f"SELECT {listed} FROM got EXCEPT ALL SELECT {listed} FROM want").fetchall()
    assert not con.sql(f"SELECT {listed} FROM want EXCEPT ALL SELECT {listed} FROM got").fetchall()


def test_plans_prune_columns(spark, sf_dir):
    """Id-only work reads the id's columns only."""
    plan = QUERIES["align_three"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<event_id:bigint,user_id:bigint,event_type:string>" in plan
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan
