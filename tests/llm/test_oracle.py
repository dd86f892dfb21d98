"""Queries against their DuckDB SQL."""

import pytest

from cosignal.llm.oracle import ORACLE
from cosignal.llm.queries import QUERIES
from tests.oracle_compare import compare, duck

from .helpers import SF


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_oracle(spark, name):
    r = compare(spark, duck(SF), name, QUERIES[name], ORACLE[name], SF)
    assert r["ok"], r
