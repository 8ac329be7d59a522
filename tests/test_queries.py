"""Every query with an oracle gives the oracle's rows; the others run."""

from __future__ import annotations

import oracle
import pytest

from cohortlens.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_matches_oracle(spark, data, name):
    oracle.same(catalog.QUERIES[name](spark, data).toPandas(), oracle.run(catalog.ORACLES[name], data))


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.ORACLES)))
def test_runs(spark, data, name):
    assert catalog.QUERIES[name](spark, data).limit(5).count() > 0


def test_entry_imports():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
