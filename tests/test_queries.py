"""Every core query against its SQL."""

import pytest

from quern.plans import registry

from .conftest import SMALL, rows

SQL = registry.oracle_sql()


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_query(spark, duck, name):
    got = registry.queries()[name](spark, SMALL).toPandas()
    if name in SQL:
        want = duck.execute(SQL[name]).df()
        assert rows(got) == rows(want)
    else:
        assert len(got)


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_llm_is_optional():
    """Nothing outside the subpackage and the entry imports it."""
    import pathlib

    top = pathlib.Path(__file__).parent.parent
    for p in (top / "quern").rglob("*.py"):
        if "llm" not in p.relative_to(top).parts:
            assert "quern.llm" not in p.read_text(), p
