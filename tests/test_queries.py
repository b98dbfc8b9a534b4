"""Every query of the library against its SQL on the smallest tables; those without SQL run and have rows."""

from __future__ import annotations

import compare
import pytest

from folioflow.plans import catalog

SF = f"{compare.DATA}/sf0.001"


@pytest.fixture(scope="module")
def tables():
    return compare.connection(SF)


@pytest.mark.parametrize("name", catalog.QUERIES)
def test_query(spark, tables, name):
    rows = catalog.QUERIES[name](spark, SF)
    if name in catalog.ORACLE:
        assert compare.differences(rows, catalog.ORACLE[name], tables) == ""
    else:
        assert rows.count() > 0


def test_names_of_sql():
    assert set(catalog.ORACLE) <= set(catalog.QUERIES)
