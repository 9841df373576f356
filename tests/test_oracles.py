"""Every registered query against its oracle at the smallest scale."""

from __future__ import annotations

import pytest
from compare import compare, connect

from codeloom.plans.all import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    return connect(sf)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query_matches_oracle(spark, duck, sf, name):
    same, note = compare(spark, duck, QUERIES[name], ORACLES.get(name), sf)
    assert same, note


def test_every_query_has_an_oracle():
    assert set(QUERIES) == set(ORACLES)
