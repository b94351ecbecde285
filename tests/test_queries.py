"""Every query against its SQL, or that it runs where SQL has no word for it."""

from __future__ import annotations

import pytest

from tapeworks.plans import catalog
from tests.conftest import SF, SF_ORACLE, sorted_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_matches_sql(spark, duck, name):
    import pandas as pd

    ours = catalog.QUERIES[name](spark, SF_ORACLE).toPandas()
    theirs = duck.execute(catalog.ORACLE_SQL[name]).df()
    fix = lambda df: df.astype({c: object for c in df}).where(pd.notna(df), None)
    a, b = sorted_rows(fix(ours)), sorted_rows(fix(theirs))
    assert a[0] == b[0]
    assert len(a[1]) == len(b[1])
    for x, y in zip(a[1], b[1], strict=True):
        assert x == pytest.approx(y, rel=0, abs=2e-5) if all(isinstance(v, float) for v in x) else x == y


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLE_SQL)))
def test_runs(spark, name):
    df = catalog.QUERIES[name](spark, SF)
    assert df.columns
    assert df.count() >= 1


def test_entry(spark):
    import __spark_entry__ as entry

    df = entry.entry(spark)
    assert {"symbol", "label_rate"} <= set(df.columns)
    assert df.count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
