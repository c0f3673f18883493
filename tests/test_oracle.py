"""Named queries against their SQL.  PASSAGEMILL_ALL=1 runs every one of them."""

import os

import pytest

from oracle import connect, differences
from passagemill.plans import registry
from passagemill.session import ship

SOME = ["bm25_top20", "bm25_postings_phrases", "mode_rrf", "cascade_fast_and_slow", "chunk_children", "html_blocks", "heading_stack", "tau_abstain"]
NAMES = list(registry.queries()) if os.environ.get("PASSAGEMILL_ALL") else SOME


@pytest.fixture(scope="session")
def duck(data):
    return connect(data)


@pytest.mark.parametrize("name", NAMES)
def test_query_equals_sql(spark, data, duck, name):
    ship(spark)
    problem, *_ = differences(spark, duck, name, registry.queries()[name], registry.oracle_sql().get(name), data)
    assert problem is None, problem


def test_every_query_has_sql():
    assert set(registry.queries()) == set(registry.oracle_sql())
