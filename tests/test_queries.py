import pytest
from tidemark import oracles, queries

from .conftest import DATA

QUERIES, SQL = queries.queries(), oracles.oracle_sql()


@pytest.mark.parametrize("name", [n for n in QUERIES if n in SQL])
def test_as_sql(spark, same_as_sql, name):
    same_as_sql(QUERIES[name](spark, DATA), SQL[name])


def test_every_query_has_sql():
    assert set(QUERIES) == set(SQL)


def test_insert_decisions(spark):
    got = {r.pos: r.decision for r in queries.insert_decisions(spark, DATA).collect()}
    rows = sorted(queries._titled(spark, DATA).collect(), key=lambda r: r.pos)
    mark = lambda r: (r.institution, r.title_key, r.pos % 2)
    known = {mark(r) for r in rows if r.pos % 10 in (0, 1)}
    kept = [r for r in rows if r.pos % 10 == 0]
    want = {}
    for r in (r for r in rows if r.pos % 10 > 1):
        near = any((k.institution, k.title_key) == (r.institution, r.title_key) and abs(k.published_at - r.published_at) <= 7 * 86400000 for k in kept)
        want[r.pos] = "duplicate_url" if mark(r) in known else "duplicate_title" if r.title_key and near else "inserted"
        if want[r.pos] == "inserted":
            known.add(mark(r))
            kept.append(r)
    assert got == want


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() > 0
