"""Homes are scored once for what is made of their scores, in as many tasks as there are cores."""

import pytest

from foyer.operators import learning
from foyer.plans import catalogue, portals  # noqa: F401  the queries of portals are registered by their import

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_candidates_are_scored_once_and_dealt(spark):
    text = plan(spark, "o11_backfill_candidates")
    assert text.count("ArrowEvalPython") == 1 and "RepartitionByExpression [id#" in text


@pytest.mark.parametrize("name", ["l06_l07_cards", "l08_rescored"])
def test_scores_are_stored(spark, name):
    assert "ArrowEvalPython" not in plan(spark, name)


@pytest.mark.parametrize("least, limit, want", [(40, 2, [2, 1]), (40, 9, [2, 1]), (90, 2, [2, 1]), (90, 9, [2, 1, 3, 5, 4]), (-5, 9, [2, 1, 3, 4])])
def test_candidates_reach_or_all(spark, least, limit, want):
    pending = spark.createDataFrame([(1, 50.0), (2, 60.0), (3, 10.0), (4, -1.0), (5, None)], "id long, score double")
    found = learning.backfill_candidates(pending, least, limit)
    assert [r.id for r in found.collect()] == want and found.columns == ["id", "score"]
