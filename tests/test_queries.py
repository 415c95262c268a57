"""Every registered query against DuckDB on the same tables."""

import datetime
import math
import os

import pytest

from brindle.plans import registry

duckdb = pytest.importorskip("duckdb")
SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for f in os.listdir(SF):
        name = f.split(".")[0]
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{SF}/{f}')")
    return con


def plain(x):
    if isinstance(x, bool):
        return int(x)
    if isinstance(x, float):
        return None if math.isnan(x) else round(x, 5) + 0.0
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return x


def rows(names, table):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in table), key=repr)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query_agrees_with_sql(spark, duck, name):
    got = registry.queries()[name](spark, SF)
    want = duck.execute(registry.oracle_sql()[name])
    want_names = [c[0] for c in want.description]
    assert rows(got.columns, [tuple(r) for r in got.collect()]) == rows(want_names, want.fetchall())


def test_queries_without_sql_give_rows(spark):
    for name in set(registry.queries()) - set(registry.oracle_sql()):
        assert registry.queries()[name](spark, SF).count() > 0, name


def test_postings_are_not_paired_with_all_projects_or_resumes(spark, sf):
    """Neither a row for each posting and project, nor one for each posting and résumé that share a skill."""
    import re

    from brindle.plans import registry

    plan = lambda name: registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert not re.search(r"Aggregate \[posting_id#\d+L?, project", plan("project_ranking"))
    assert "Join Inner, (skill" not in plan("resume_choice")
