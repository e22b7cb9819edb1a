from __future__ import annotations

import pytest

from quern.plans.oracles import ORACLES
from quern.plans.queries import QUERIES

SLOW = {"pipeline_full_stats", "pipeline_similar_comp_stats", "pipeline_elc_stats", "pipeline_mle_stats"}


@pytest.mark.parametrize("name", sorted(set(QUERIES) & set(ORACLES)))
def test_query_equals_its_sql(name, spark, sf, compare):
    compare(QUERIES[name](spark, sf), ORACLES[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_without_sql_gives_rows(name, spark, sf):
    rows = QUERIES[name](spark, sf)
    assert rows.count() > 0 and len(set(rows.columns)) == len(rows.columns)


def test_every_oracle_has_its_query():
    assert set(ORACLES) <= set(QUERIES)
