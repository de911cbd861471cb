"""Bindings read every order and part: queries over tables without any row that the old filters kept."""

import pytest

from quarryline.plans import service_queries as plans

#: (order, part, supplier, line): no order is 1 modulo 40 or a multiple of 9 or 5
LINES = [(2, 165, 7, 1), (3, 165, 7, 2), (4, 201, 8, 2), (7, 201, 9, 2), (8, 201, 9, 1)]
#: no part below 150; library 15 has one repository, library 51 two
PARTS = [165, 201, 351]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("whole"))
    spark.createDataFrame(LINES, "l_orderkey long, l_partkey long, l_suppkey long, l_linenumber int").write.parquet(f"{out}/lineitem.parquet")
    spark.createDataFrame([(p,) for p in PARTS], "p_partkey long").write.parquet(f"{out}/part.parquet")
    return out


def rows(spark, folder, name):
    return sorted(tuple(r) for r in plans.QUERIES[name](spark, folder).collect())


def test_dependencies_of_every_order(spark, folder):
    edges = {(f"s{s}", f"n{p % 40}") for _, p, s, _ in LINES} | {(f"n{p % 40}", f"c{p % 7}") for _, p, _, _ in LINES}
    want = {(a, b): 1 for a, b in edges}
    for a, b in edges:
        for c, d in edges:
            if b == c:
                want.setdefault((a, d), 2)
    assert rows(spark, folder, "dependencies_of_all") == sorted((a, b, n) for (a, b), n in want.items())


def test_access_of_every_order(spark, folder):
    assert rows(spark, folder, "shared_tables") == [("s8", "s9", 1)]
    assert rows(spark, folder, "readers_only") == []
    assert rows(spark, folder, "owned_tables") == [("db", "t1", "s8", "s9"), ("db", "t165", "s7", "")]


def test_versions_and_libraries_of_every_order_and_part(spark, folder):
    assert rows(spark, folder, "version_drift") == [("com.x:lib15", "1.1,1.2"), ("com.x:lib51", "1.1,1.2")]
    assert set(rows(spark, folder, "link_libraries")) == {("repo7", "com.x:lib15", "repo5", "exact")}
