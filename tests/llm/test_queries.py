"""The queries of this subpackage that have SQL, against it."""

import pytest

from pagewright.llm.queries import ORACLE_SQL, QUERIES
from tests.oracle import connect, differences


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_query(spark, sf_dir, name):
    assert differences(QUERIES[name](spark, sf_dir), connect(sf_dir), ORACLE_SQL[name])[:3] == []


def test_all_are_registered():
    assert sorted(int(n[2:].split("_")[0]) for n in QUERIES) == list(range(1, 14))
