"""Every query of the library against its DuckDB counterpart."""

import pytest
from conftest import SF, plain

from sieveline.plans import registry


def number_text(rows):
    def one(v):
        try:
            return f"{float(v):.5g}"
        except ValueError:
            return v

    return sorted(tuple(map(one, r)) for r in rows)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_matches_sql(spark, duck, name):
    columns, rows = plain(registry.QUERIES[name](spark, SF).toPandas())
    want_columns, want = plain(duck.sql(registry.ORACLE[name]).df())
    assert columns == want_columns
    assert number_text(rows) == number_text(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLE)))
def test_runs(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_names():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert "freeze_source_pool" in e.queries()
