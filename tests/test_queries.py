"""Every core query against its SQL; those without SQL must run and give rows."""

import pytest
from ledgerloom.plans import catalog

from oracle import connect, same

#: Sets that may be empty on small data.
MAY_BE_EMPTY = {"a38_duplicate_refs"}


@pytest.fixture(scope="module")
def con(sf_dir):
    return connect(sf_dir)


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = catalog.QUERIES[name](spark, sf_dir)
    if name in catalog.SQL:
        same(df, con.execute(catalog.SQL[name]))
    else:
        assert name in MAY_BE_EMPTY or df.count() > 0
