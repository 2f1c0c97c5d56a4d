"""What a page or an ad is read for is worked out once, and in as many tasks as there are cores, however few row groups the file has."""

import pytest
from pyspark.sql import functions as F

from foyer.functions import scalars as S
from foyer.plans import catalogue, portals  # noqa: F401  the queries of portals are registered by their import

SF = "/root/testdata/sf0.001"


def plan(spark, name):
    return catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()


def test_let_makes_its_value_once(spark):
    rows = spark.createDataFrame([("a",), ("",), (None,)], "t string").select(S.let(F.upper("t"), lambda x: F.concat(x, x, x)), S.filled(F.col("t")), S.some(F.split("t", "x")))
    assert [tuple(r) for r in rows.collect()] == [("AAA", "a", ["a"]), ("", None, [""]), (None, None, None)]
    one = spark.range(1).select(S.let(F.concat("id", F.lit("x")), lambda x: F.concat_ws(",", x, x, x)).alias("v"))
    assert one._jdf.queryExecution().optimizedPlan().toString().count("concat(") == 1


def test_patterns_of_details_are_sought_once(spark):
    text = plan(spark, "s14_f19_f21_f22_f23_f24_details")
    assert text.count("regexp_extract(") < 80  # 311 when each use of a find sought it again
    assert text.count("from_json") == 5


def test_ads_of_pages_are_parsed_once(spark):
    assert plan(spark, "s10_leboncoin_details").count("from_json") == 1


@pytest.mark.parametrize("name", ["s14_f19_f21_f22_f23_f24_details", "s10_leboncoin_details", "s09_p22_f25_leboncoin_search", "s12_s13_p22_f20_search_cards", "p06_filtered_cards", "p07_cards_of_a_code"])
def test_rows_are_dealt_before_pages_are_made(spark, name):
    assert "RepartitionByExpression [id#" in plan(spark, name)


def test_text_of_a_card_is_made_once(spark):
    """Classes, land and metrics are sought in one column, not in a text that each search makes again."""
    from foyer.plans.fixtures import Tables
    from foyer.sources import payloads

    cards = payloads.search_cards(portals._search_pages(Tables(spark, SF))).select("card.dpe", "card.ges", "card.land", "card.consumption", "card.emission")
    setting = "spark.sql.debug.maxToStringFields"
    before = spark.conf.get(setting)
    spark.conf.set(setting, "1000")
    try:
        assert cards._jdf.queryExecution().optimizedPlan().toString().count("concat_ws(") == 1
    finally:
        spark.conf.set(setting, before)


def test_years_of_texts(spark):
    rows = spark.createDataFrame([("bâti en 1987",), ("sans",), ("",), (None,)], "t string").select(S.year_from_text(F.col("t")))
    assert [r[0] for r in rows.collect()] == [1987, None, None, None]
