"""Postings are made by as many tasks as there are cores, and a large bucket is written by several."""

from pyspark.sql import functions as F

from foyer.operators import textindex
from foyer.sources.versions import Store


def test_large_bucket_is_several_files(spark, tmp_path):
    names = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "64k", "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        store = Store(spark, str(tmp_path / "store"), {"t": "id"}, buckets=2)
        store.publish({"t": spark.range(0, 200_000, 2, 8).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))})
    finally:
        for name in names:
            spark.conf.unset(name)
    assert len(store.read("t").inputFiles()) > 2 and store.read("t").select("id").distinct().count() == 100_000


def test_postings_are_dealt_and_whole(spark):
    texts = spark.range(2500).select("id", F.when(F.col("id") % 100 > 0, F.concat(F.lit("Ab"), F.col("id"))).alias("text")).coalesce(1)
    found = textindex.postings(texts)
    assert "RepartitionByExpression [id#" in found._jdf.queryExecution().optimizedPlan().toString()
    want = {(g, r.id) for r in texts.filter("text is not null").collect() for g in textindex.grams(r.text)}
    rows = [(r.gram, r.id) for r in found.collect()]
    assert len(rows) == len(want) and set(rows) == want
