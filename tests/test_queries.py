"""Every registered query of the engine against its SQL on DuckDB, over whole tables of the smallest scale."""

import datetime
import decimal
import os

import pytest

from casewright.plans import registry

SF_DIR = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

pytestmark = pytest.mark.skipif(not os.path.isdir(SF_DIR), reason="the driver's tables are not here")


@pytest.fixture(scope="module")
def duck():
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF_DIR}/{t}.parquet'")
    return con


def plain(v):
    if hasattr(v, "asDict"):
        v = v.asDict(True)
    if isinstance(v, (float, decimal.Decimal)):
        return f"{float(v):.9g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, dict):
        return [(str(k), plain(v[k])) for k in sorted(v, key=str)]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return str(v)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, duck, name):
    df = registry.QUERIES[name](spark, SF_DIR)
    columns = sorted(df.columns)
    found = duck.execute(registry.ORACLES[name])
    names = [d[0] for d in found.description]
    assert sorted(names) == columns
    want = [[plain(r[names.index(c)]) for c in columns] for r in found.fetchall()]
    got = [[plain(r[c]) for c in columns] for r in df.collect()]
    assert sorted(got) == sorted(want)


def test_queries_without_sql_give_rows(spark):
    for name in registry.QUERIES.keys() - registry.ORACLES.keys():
        assert registry.QUERIES[name](spark, SF_DIR).count() > 0


def test_links_times_parameters_are_never_spelled_out(spark):
    """Joins of the upsert and of the deletion stay within the sizes of their inputs."""
    for name in ("upsert_results", "delete_stale"):
        plan = registry.QUERIES[name](spark, SF_DIR)._jdf.queryExecution().optimizedPlan().toString()
        assert "Join LeftSemi, ((application_id" in plan or "Join LeftSemi, ((checklist_id" in plan
