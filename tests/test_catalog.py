"""Every registered query against its SQL twin on the smallest tables."""

import pytest

from docquarry.plans import catalog
from tests.helpers import duck, rows


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_same_as_sql(spark, sf, name):
    got = catalog.queries()[name](spark, sf).toPandas()
    want = duck(sf).execute(catalog.oracle_sql()[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    columns = sorted(got.columns)
    assert rows(got, columns) == rows(want, columns)


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_gives_rows(spark, sf, name):
    assert catalog.queries()[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__

    hits = __spark_entry__.entry(spark).collect()
    assert 0 < len(hits) <= 20
    assert [h.score for h in hits] == sorted((h.score for h in hits), reverse=True)
