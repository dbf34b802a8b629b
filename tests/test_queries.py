import os

import pytest

import __spark_entry__ as entry
from eventloom.plans import queries as q
from tests.conftest import SF


@pytest.mark.parametrize("name", sorted(q.oracle_sql()))
def test_query_equals_its_oracle(spark, same, name):
    same(q.queries()[name](spark, SF), q.oracle_sql()[name])


def test_entry_and_registry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    if not os.path.isdir(os.path.join(os.path.dirname(q.__file__), "..", "llm")):
        assert not any(n.startswith("op") for n in entry.queries())
