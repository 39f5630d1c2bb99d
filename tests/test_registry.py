"""Every registered query against its SQL, on the smallest data."""

import os
import sys

import pytest

import __spark_entry__ as contract
import registry

sys.path.insert(0, os.path.join(os.path.dirname(__file__), "..", "tools"))

from compare import differences, oracle_connection  # noqa: E402


@pytest.fixture(scope="module")
def con(small):
    return oracle_connection(small)


@pytest.mark.parametrize("name", contract.oracle_sql())
def test_query_equals_its_sql(spark, con, small, name):
    assert differences(spark, con, name, small) == ""


def test_every_query_has_sql_or_is_of_the_other_subpackage():
    """What SQL cannot express is tested against brute force in tests/llm."""
    without = set(contract.queries()) - set(contract.oracle_sql())
    assert not without & set(registry.QUERIES)


def test_entry(spark):
    assert contract.entry(spark).first().num_events == 1000


def test_poll_lines_decode_back_to_the_flights(spark, small):
    import fixtures
    from aerovox.operators import polls

    expected = fixtures.flights(spark, small)
    decoded = polls.to_flight_rows(polls.decode_polls(fixtures.poll_lines(spark, small)))
    decoded = decoded.select(*[decoded[c].cast(kind) for c, kind in expected.dtypes])
    assert decoded.exceptAll(expected).count() == 0 and expected.exceptAll(decoded).count() == 0
