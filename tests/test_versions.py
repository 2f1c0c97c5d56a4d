"""Stores whose versions share the buckets that a batch doesn't meet."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F
from test_upsert import tables

from foyer.operators import upsert
from foyer.sources.versions import Conflict, Store


def files(root, name):
    return {str(p): (p.stat().st_mtime_ns, p.read_bytes()) for p in Path(root, name).rglob("*.parquet")}


def test_versions_conflicts_and_readers(spark, tmp_path):
    root = str(tmp_path / "store")
    store = Store(spark, root, {"a": "id", "b": "id"}, buckets=4)
    assert store.sequence() == 0
    with pytest.raises(ValueError):
        store.read("a")
    assert store.publish({"a": spark.range(40).withColumn("v", F.lit(1)), "b": spark.range(2)}) == 1
    was = files(root, "a")
    old = store.read("a")
    changed = store.read("a").withColumn("v", F.when(F.col("id") == 5, 2).otherwise(F.col("v")))
    assert store.publish({"a": changed}, {"a": spark.createDataFrame([(5,)], "id long")}) == 2
    assert {r.bucket: r.since for r in store.since("a").collect()} == {0: 1, 1: 2, 2: 1, 3: 1}
    assert {r.since for r in store.since("b").collect()} == {1}
    assert was.items() <= files(root, "a").items()
    assert store.read("a").filter("v = 2").count() == 1 and store.read("a").count() == 40 and store.read("a", 1).filter("v = 2").count() == old.filter("v = 2").count() == 0
    # a writer that began before another published
    other = Store(spark, root, {"a": "id", "b": "id"}, buckets=4)
    with pytest.raises(Conflict):
        other.publish({"b": spark.range(9)}, base=1)
    # and one whose number is taken between its look and its claim
    other.sequence = lambda: 1
    with pytest.raises(Conflict):
        other.publish({"b": spark.range(9)}, base=1)
    assert store.sequence() == 2 and store.read("b").count() == 2
    # buckets that become empty, and tables that do
    assert store.publish({"a": store.read("a").filter("id % 4 <> 2")}, {"a": spark.createDataFrame([(2,)], "id long")}) == 3
    assert store.read("a").count() == 30 and {r.bucket for r in store.since("a").collect()} == {0, 1, 3}
    assert store.publish({"b": spark.range(0)}) == 4 and store.read("b").count() == 0 and store.read("b").columns == ["id"]
    assert store.publish({"b": spark.createDataFrame([(None,), (6,)], "id long")}) == 5 and store.read("b").count() == 2
    assert store.prune(keep=1) > 0 and store.read("a").count() == 30 and store.sequence() == 5


@pytest.mark.parametrize("seed", [3])
def test_upsert_publishes_the_buckets_that_it_meets(spark, tmp_path, seed):
    new, props, pubs = tables(spark, seed, n_new=3, n_known=40)
    root = str(tmp_path / "homes")
    store = Store(spark, root, {"properties": "id", "publications": "id"}, buckets=32)
    store.publish({"properties": props, "publications": pubs})
    was = {name: files(root, name) for name in ("properties", "publications")}
    want, want_pubs, _ = upsert.upsert(new, props, pubs)
    version, placed = upsert.published(new, store)
    assert version == 2 and placed.count() == 3
    rows = lambda df: sorted(map(str, (r.asDict() for r in df.select(sorted(df.columns)).collect())))
    assert rows(store.read("properties")) == rows(want) and rows(store.read("publications")) == rows(want_pubs)
    met = {r[0] % 32 for r in placed.select("property_id").collect()}
    assert {r.bucket for r in store.since("properties").filter("since = 2").collect()} <= met and len(met) < 4
    assert all(was[name].items() <= files(root, name).items() for name in was)
    assert rows(store.read("properties", 1)) == rows(props)
