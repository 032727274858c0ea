"""Every registered query against its SQL counterpart on the smallest tables."""

import pytest
from compare import compare
from conftest import SF

from papertrawl import plans

QUERIES, ORACLES = plans.queries(), plans.oracles()


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_same_as_sql(spark, name):
    outcome = compare(spark, SF, name, QUERIES[name], ORACLES[name])
    assert outcome.startswith("ok"), outcome


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_runs_without_sql(spark, name):
    QUERIES[name](spark, SF).write.format("noop").mode("overwrite").save()
