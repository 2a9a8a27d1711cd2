"""Every registered query against its SQL statement, rows, names and types."""

import pytest

from compare import compare, oracle
from conftest import SMALL
from rosterlake.registry import REGISTRY, statement


@pytest.fixture(scope="module")
def con():
    return oracle(SMALL)


@pytest.mark.parametrize("name", REGISTRY)
def test_query_equals_sql(spark, con, name):
    verdict, _, _ = compare(spark, con, name, SMALL)
    assert verdict == "ok"


def test_entry_points(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    rows = entry.entry(spark)
    assert rows.columns == REGISTRY["k02_top_performers"](spark, SMALL).columns
    assert rows.count() > 0


def test_statement_defines_what_it_mentions():
    text = statement("select count(*) from dim_department")
    for step in ("people", "staging_employees", "departments", "dim_department"):
        assert f"{step} as (" in text
    assert "fact_performance_reviews" not in text


def test_every_inventory_section_is_covered():
    sizes = dict(a=14, b=23, c=20, d=18, e=12, f=7, g=4, h=21, i=15, j=21, k=14, l=15, m=4)
    have = {q.split("_")[0] for q in REGISTRY}
    for section, n in sizes.items():
        for i in range(1, n + 1):
            assert f"{section}{i:02d}" in have or f"{section}{i}" in have
