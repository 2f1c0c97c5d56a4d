"""Every registered query of the listing engine against its SQL in DuckDB, over the driver's tables."""

import pytest
from oracle import duck_rows, spark_rows

from foyer.plans import catalogue

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalogue.ORACLE_SQL))
def test_matches_sql(spark, name):
    names, rows = spark_rows(catalogue.QUERIES[name](spark, SF))
    want_names, want = duck_rows(SF, catalogue.ORACLE_SQL[name])
    assert names == want_names
    assert rows == want


def test_rows_of_queries_without_sql(spark):
    """They run; tests/test_upsert.py holds the operators of the upserts against plain versions."""
    found = {name: catalogue.QUERIES[name](spark, SF).collect() for name in sorted(set(catalogue.QUERIES) - set(catalogue.ORACLE_SQL))}
    assert set(found) == {"m01_upsert_outcomes", "m01_s21_upserted_properties", "o12_pick"} and all(found.values())
    scores = {r.id: (r.score, r.tier) for r in catalogue.QUERIES["o12_pick"](spark, SF).collect()}
    assert all(score >= 90 or tier == "weak" for score, tier in scores.values())
