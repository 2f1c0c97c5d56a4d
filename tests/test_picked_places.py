"""Places that were asked for meet the first place of each key."""

from pyspark.sql import functions as F

from foyer.operators import geo


def test_places_are_met_by_their_first(spark):
    places = spark.range(300).select(F.lit(1).alias("query"), F.col("id").alias("pos"), (F.col("id") + 1000).alias("place_id"), F.lit(" Evry ").alias("name"), F.array(F.lit("91000"), F.lit("")).alias("postal_codes"), (F.col("id") > 0).alias("usable"))
    asked = spark.createDataFrame([(1, 1, "evry", "91000"), (2, 1, "x", ""), (3, 1, None, None), (4, 2, "evry", "91000"), (5, None, "evry", "91000"), (6, 1, "EVRY", "1")], "ask_id long, query int, city string, postal_code string")
    found = geo.picked_places(asked, places)
    assert sorted((r.ask_id, r.place_id) for r in found.collect()) == [(1, 1001), (2, 1001), (3, 1001), (4, None), (5, None), (6, 1001)]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Aggregate") == 5  # one for each way, and the last
