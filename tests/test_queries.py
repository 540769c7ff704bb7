from __future__ import annotations

import pytest
from compare import rows_of, sql_rows
from conftest import SMALL

from opsloom.plans import registry

#: Queries that may have no rows on the smallest tables, as what they look for is rare there.
MAY_BE_EMPTY = {"repeated_questions", "duplicate_contents", "log_levels", "duplicate_uploads"}


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_query_matches_its_sql(spark, duck, name):
    got, want = rows_of(registry.QUERIES[name](spark, SMALL)), sql_rows(duck, registry.SQL[name])
    assert got == want
    assert got[1] or name in MAY_BE_EMPTY


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_query_without_sql_has_rows(spark, name):
    assert registry.QUERIES[name](spark, SMALL).count() > 0


@pytest.mark.parametrize("name", ["p2_found", "p3_found", "p5_found"])
def test_problem_query_on_empty_and_null_tables(spark, empty_tables, null_tables, name):
    assert registry.QUERIES[name](spark, empty_tables).count() == 0
    assert registry.QUERIES[name](spark, null_tables).count() == 0


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_every_query_runs_on_empty_and_null_tables(spark, empty_tables, null_tables, name):
    for folder in (empty_tables, null_tables):
        registry.QUERIES[name](spark, folder).collect()


def test_nothing_but_the_subpackage_imports_it():
    from pathlib import Path

    import opsloom

    root = Path(opsloom.__file__).parent
    for path in root.rglob("*.py"):
        if "llm" not in path.relative_to(root).parts:
            assert "opsloom.llm" not in path.read_text()


def test_topology_reach_takes_its_edge_rule(spark):
    from opsloom.plans import series_queries

    few, all_ = (series_queries.topology(spark, SMALL, *rule).filter("hops = 1").count() for rule in ((), (0, 1)))
    assert few < all_
