"""Each map query against its SQL in DuckDB, on the smallest tables."""

import os

import duckdb
import pytest

import __spark_entry__ as entry
from quadrille.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events".split()
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are missing")


@pytest.fixture(scope="module")
def con():
    found = duckdb.connect()
    for t in TABLES:
        found.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    return found


def canon(rows):
    def value(v):
        return round(float(v), 6) if isinstance(v, float) else v

    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_query(spark, con, name):
    df = catalog.queries()[name](spark, SF)
    columns = sorted(df.columns)
    got = canon(df.select(*columns).collect())
    relation = con.execute(catalog.oracle_sql()[name])
    order = [d[0] for d in relation.description]
    assert sorted(order) == columns
    want = canon([tuple(r[order.index(c)] for c in columns) for r in relation.fetchall()])
    assert got == want


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_query_without_sql(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_tree_invariants(spark):
    tree = catalog.queries()["tile_tree"](spark, SF)
    assert all(bin(r["mask"]).count("1") == r.children for r in tree.collect())
    leaves = catalog.queries()["leaf_index"](spark, SF).agg({"n": "sum", "w": "sum", "r": "sum"}).first()
    located = {r.kind: r["count"] for r in entry_planet(spark).located.groupBy("kind").count().collect()}
    assert (leaves["sum(n)"], leaves["sum(w)"], leaves["sum(r)"]) == (located["node"], located["way"], located["relation"])


def entry_planet(spark):
    from quadrille.sources import star

    return star.planet(spark, SF)
