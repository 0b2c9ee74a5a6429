"""Every registered query of the core against its SQL, and that those without SQL run."""

import pytest

from conftest import SF, rows_of
from tesserae.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, duck, name):
    ours = catalog.QUERIES[name](spark, SF).toPandas()
    if name in catalog.ORACLE_SQL:
        assert rows_of(ours) == rows_of(duck.execute(catalog.ORACLE_SQL[name]).df())
    else:
        assert len(ours)


def test_flagship(spark):
    assert len(catalog.flagship(spark, SF).collect()) == 20
