"""Every query of the core library against its SQL on the smallest tables."""

import pytest

from foliospark.plans import registry

NAMES = sorted(registry.oracle_sql())


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_sql(name, same):
    same(registry.queries()[name], registry.oracle_sql()[name])


def test_entry_point(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).schema.names == ["doc_id", "n_matches"]
