"""Medians by selection, the score cache, and dumps of pages with broken ones among them."""

import gzip
import json
import random

import pytest
from oracle import duck_rows, spark_rows
from pyspark.sql import functions as F

from foyer.operators import learning, scorecache
from foyer.operators.selection import percentiles
from foyer.plans import catalogue
from foyer.sources import connectors, payloads


def test_percentiles_as_spark_interpolates_them(spark):
    r = random.Random(2)
    shares = [0.0, 0.25, 0.5, 0.9, 1.0]
    tables = [[r.randint(0, 30) for _ in range(n)] for n in (1, 2, 3, 500, 501)] + [[7] * 300, [None, 5, None], [None], [], [r.random() * 1e6 for _ in range(999)] + [None] * 50]
    for values in tables:
        df = spark.createDataFrame([(v if v is None else float(v),) for v in values], "v double").repartition(5)
        want = df.select(*(F.percentile("v", p) for p in shares)).first()
        found = percentiles(df, "v", shares).first()
        assert found.n == sum(v is not None for v in values)
        assert [x if x is None else pytest.approx(x) for x in want] == list(found[1:]), values[:5]


def test_medians_have_no_buffer_of_all_prices(spark):
    plan = catalogue.QUERIES["a07_price_stats"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan.lower()


WEIGHTS = {"price": 50, "rooms": 30, "heating": 20}


def homes(spark, changes=()):
    rows = [(k, 100_000.0 + 1000 * k, k % 6, "gaz" if k % 2 else None, f"t{k}") for k in range(60)]
    for k, column, value in changes:
        row = list(rows[k])
        row[column] = value
        rows[k] = tuple(row)
    return spark.createDataFrame(rows, "id long, price double, rooms int, heating string, title string")


def test_only_what_changed_is_scored_again(spark):
    pick = lambda df, ids: df.filter(F.col("id").isin(*ids))
    own = homes(spark)
    first = scorecache.refreshed(own, pick(own, [1, 2, 3]), pick(own, [9]), WEIGHTS).cache()
    want = {r.id: r.score for r in learning.score(own, pick(own, [1, 2, 3]), pick(own, [9]), WEIGHTS).collect()}
    assert {r.id: r.score for r in first.collect()} == want and first.filter("rescored").count() == 60

    # a price, a value that nothing compares, a value that becomes null, one home gone and one new
    after = homes(spark, [(20, 1, 5.0), (21, 4, "other title"), (23, 3, None)]).filter("id <> 30").unionByName(own.filter("id = 30").withColumn("id", F.lit(99)))
    args = pick(after, [1, 2, 3]), pick(after, [9]), WEIGHTS
    second = scorecache.refreshed(after, *args, first.drop("rescored")).cache()
    assert {r.id for r in second.filter("rescored").collect()} == {20, 23, 99}
    assert {r.id: r.score for r in second.collect()} == {r.id: r.score for r in learning.score(after, *args).collect()}

    # another reaction, another weight, another value of a training row: another model, nothing is kept
    for likes, weights, table in (([1, 2, 3, 4], WEIGHTS, after), ([1, 2, 3], WEIGHTS | {"rooms": 31}, after), ([1, 2, 3], WEIGHTS, homes(spark, [(2, 1, 1.0)]))):
        third = scorecache.refreshed(table, pick(table, likes), pick(table, [9]), weights, second.drop("rescored"))
        assert third.filter("rescored").count() == third.count()
    back = scorecache.refreshed(after, *args, second.drop("rescored"))
    assert back.filter("rescored").count() == 0
    assert scorecache.refreshed(after.limit(0), *args, second.drop("rescored")).count() == 0


def test_scores_of_two_reactions(spark):
    names, rows = spark_rows(catalogue.QUERIES["l08_rescored"](spark, "/root/testdata/sf0.001"))
    want_names, want = duck_rows("/root/testdata/sf0.001", catalogue.ORACLE_SQL["l08_rescored"])
    assert names == want_names and rows == want


def test_one_broken_page_leaves_the_others(spark, tmp_path):
    ad = lambda k: {"id": f"ag-{k}", "title": f"Maison {k}", "price": 100_000 + k, "city": "Rouen", "surfaceArea": 80.0}
    a, b, c = (tmp_path / x for x in "abc")
    for folder in (a, b):
        folder.mkdir()
    for k in range(1, 8):
        (a / f"page-{k}.json").write_text(json.dumps({"realEstateAds": [ad(10 * k), ad(10 * k + 1)]}))
    (a / "page-4.json").write_text('{"realEstateAds": [{"id": "ag')  # broke off
    (a / "notes.txt").write_text("no page")
    (b / "page-1.json.gz").write_bytes(gzip.compress(json.dumps({"realEstateAds": [ad(900)]}).encode()))
    (b / "page-2.json.gz").write_bytes(gzip.compress(b"[]")[:9])
    (b / "page-3.json").write_bytes(b'"\xff"')

    def parsed(pages):
        ads = pages.select("_at", F.explode(F.from_json("body", f"realEstateAds array<struct<{BIENICI}>>")["realEstateAds"]).alias("ad")).select("_at", "ad.*")
        return payloads.bienici_listings(ads, F.col("_at"), "")

    BIENICI = spark.createDataFrame([], payloads.BIENICI_AD).schema.simpleString().removeprefix("struct<").removesuffix(">")
    rows, errors = connectors.gathered_pages(spark, {"a": str(a), "b": f"file://{b}", "c": str(c)}, dict.fromkeys("abc", parsed), per_task=2)
    assert sorted(r.external_id for r in rows.collect()) == sorted([f"ag-{10 * k + i}" for k in (1, 2, 3, 5, 6, 7) for i in (0, 1)] + ["ag-900"])
    found = sorted((r.source, r.page or 0, r.error.split(":")[0]) for r in errors.collect())
    assert found == [("a", 4, "JSONDecodeError"), ("b", 2, "EOFError"), ("b", 3, "UnicodeDecodeError"), ("c", 0, "FileNotFoundError")]
