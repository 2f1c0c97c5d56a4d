"""Centers by cells, the text index, whole answers, counters and lines of certificates, beyond what their queries show."""

import math
import random

import pytest
from oracle import spark_rows
from pyspark.sql import functions as F
from test_upsert import tables

from foyer.functions.scalars import EARTH_KM
from foyer.operators import answers, cells, certificates, photos, upsert
from foyer.operators.search import SearchFilters
from foyer.operators.textindex import TextIndex, grams
from foyer.plans import catalogue
from foyer.plans.fixtures import Tables


def km(a, b, c, d):
    a, b, c, d = map(math.radians, (a, b, c, d))
    x = math.sin((c - a) / 2) ** 2 + math.cos(a) * math.cos(c) * math.sin((d - b) / 2) ** 2
    return EARTH_KM * 2 * math.atan2(math.sqrt(x), math.sqrt(1 - x))


def test_centers_anywhere_on_the_sphere(spark):
    r = random.Random(4)
    spots = [(r.uniform(-90, 90), r.uniform(-180, 180)) for _ in range(300)] + [(r.uniform(48, 49), r.uniform(2, 3)) for _ in range(200)]
    spots += [(90.0, 0.0), (-90.0, 50.0), (89.9, 179.0), (0.0, 180.0), (0.0, -180.0), (0.01, 179.99), (-0.01, -179.99), (60.0, 179.95), (60.0, -179.95), (48.5, 2.5)]
    rows = [(k, *s) for k, s in enumerate(spots)] + [(9000, None, 1.0), (9001, 91.0, 1.0)]
    radii = [0.0, 0.4, 1.0, 3.0, 10.0, 45.0, 120.0, 900.0, 6000.0, 16000.0, 25000.0]
    centers = [(k, *s, r.choice(radii)) for k, s in enumerate(r.sample(spots, 150))] + [(500 + k, *s, x) for k, s in enumerate(spots[-10:]) for x in (20.0,)]
    centers += [(900, 48.5, 2.5, None), (901, 48.5, 2.5, -1.0), (902, None, 2.5, 5.0)]
    found = cells.near_centers(spark.createDataFrame(rows, "id long, latitude double, longitude double"), spark.createDataFrame(centers, "center_id long, latitude double, longitude double, radius_km double")).collect()
    near = {(x.center_id, x.id) for x in found}
    assert len(near) == len(found)
    for c, lat, lng, radius in centers:
        for k, a, b in rows:
            if None in (lat, radius, a) or radius < 0 or abs(a) > 90:
                assert (c, k) not in near
            elif abs(km(lat, lng, a, b) - radius) > 1e-6:
                assert ((c, k) in near) == (km(lat, lng, a, b) <= radius), (c, k, lat, lng, radius, a, b)
    assert cells.near_centers(spark.createDataFrame(rows, "id long, latitude double, longitude double"), spark.createDataFrame([], "center_id long, latitude double, longitude double, radius_km double")).count() == 0


def test_text_index_over_batches(spark, tmp_path):
    r = random.Random(6)
    words = ["maison", "Jardin", "garage", "éCUrie", "vue", "MER", "calme", "a", "été"]
    text = lambda: " ".join(r.choice(words) for _ in range(r.randint(0, 6)))
    index, now = TextIndex(spark, str(tmp_path / "texts"), buckets=8), {}
    for k in range(3):
        batch = {i: r.choice([None, "", text(), text(), text()]) for i in r.sample(range(120), 60)}
        assert index.add(spark.createDataFrame(list(batch.items()), "id long, text string")) == k + 1
        now |= batch
        fold = lambda s: "".join(c.lower() if "A" <= c <= "Z" else c for c in s)
        for needle in ("jardin", "MAISON", "éCUr", "e V", "garage calme", "nowhere", "été"):
            want = {i for i, s in now.items() if s and fold(needle) in fold(s)}
            assert {x.id for x in index.search(needle).collect()} == want
            assert {x.id for x in index.candidates(needle).collect()} >= want
    before = index.candidates("maison").count()
    index.compact()
    assert {x.id for x in index.candidates("maison").collect()} == {i for i, s in now.items() if s and grams("maison") <= grams(s)} and index.candidates("maison").count() <= before
    with pytest.raises(ValueError):
        index.search("ab")


def test_a_search_reads_only_the_buckets_that_it_needs(spark, tmp_path):
    index = TextIndex(spark, str(tmp_path / "texts"), buckets=32)
    index.add(spark.range(300).select("id", F.concat(F.lit("common text "), F.when(F.col("id") == 77, "needle").otherwise("hay")).alias("text")))
    found = index.search("needle")
    files = {f.rpartition("/")[0] for f in found.inputFiles()}
    assert [x.id for x in found.collect()] == [77] and sum("/texts/" in f for f in files) == 1


SF = "/root/testdata/sf0.001"


def leaves(df):
    plan = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    return [plan.apply(k).toString() for k in range(plan.size())]


def test_answers_read_each_table_once(spark, monkeypatch):
    t, plans = Tables(spark, SF), []
    kept = answers.stored
    monkeypatch.setattr(answers, "stored", lambda df, name: plans.append(df) or kept(df, name))
    ranks = t.properties.limit(0).select("id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(1).alias("rank_total"))
    page = answers.list_answer(t.properties, t.publications, t.reactions, ranks, SearchFilters(source="seloger", text="high", limit=5))
    assert page.count() <= 5
    answers.statistics_answer(t.properties, t.publications).collect()
    # an empty table of ranks is folded away; properties, publications and reactions are read from part, orders and events
    assert [len([x for x in leaves(p) if "parquet" in x.lower()]) for p in plans] == [3, 2]
    empty = answers.statistics_answer(t.properties.limit(0), t.publications.limit(0)).collect()
    assert all(x.value == 0 for x in empty) and {x.section for x in empty} == {"overview", "sources"}


def test_list_answers_agree_with_their_filters(spark):
    t = Tables(spark, SF)
    ranks = t.properties.limit(0).select("id", F.lit(1.0).alias("score"), F.lit(1).alias("rank"), F.lit(1).alias("rank_total"))
    for f in (SearchFilters(limit=100), SearchFilters(source="seloger"), SearchFilters(without_reaction=True, sort="price_desc"), SearchFilters(min_price=10**9), SearchFilters(offset=10**6)):
        page = answers.list_answer(t.properties, t.publications, t.reactions, ranks, f).collect()
        reacted = {x.property_id for x in t.reactions.collect()}
        assert len(page) <= f.limit and [x.at for x in page] == list(range(f.offset + 1, f.offset + 1 + len(page)))
        assert not f.source or all(f.source in x.sources for x in page)
        assert not f.without_reaction or all(x.id not in reacted and x.reaction is None for x in page)
        assert len({x.total for x in page}) <= 1


def test_counters_are_those_of_the_outcomes(spark, tmp_path):
    new, props, pubs = tables(spark, 2)
    bad = new.withColumn("price", F.when(F.col("pos") % 7 == 3, 0).otherwise(F.col("price")))
    totals = {x.source: x for x in upsert.recorded(bad, props, pubs, str(tmp_path / "run")).collect()}
    log = spark.read.parquet(str(tmp_path / "run"))
    assert log.count() == bad.count() and set(totals) == {"bienici", "seloger", "logicimmo", "leboncoin"}
    want = upsert.outcomes(bad.filter("pos % 7 <> 3"), props, pubs).join(new.select("pos", "source"), "pos").groupBy("source", "outcome").count().collect()
    for x in want:
        assert totals[x.source][x.outcome] == x["count"]
    assert sum(x.inserted + x.linked + x.updated + x.skipped for x in totals.values()) == sum(x["count"] for x in want)
    assert sum(x.invalid for x in totals.values()) == bad.filter("pos % 7 = 3").count() == log.filter("size(invalid) > 0").count()
    assert totals["leboncoin"].found == 0
    refreshed = {x.property_id for x in upsert.to_refresh(upsert.outcomes(new, props, pubs)).collect()}
    assert refreshed == {x.property_id for x in upsert.outcomes(new, props, pubs).collect() if x.property_id is not None and (x.outcome in ("inserted", "linked") or x.price_drop)}


def test_looks_of_three_batches_give_the_pairs_of_one(spark, tmp_path):
    r = random.Random(12)
    bases = [r.getrandbits(64) for _ in range(12)]
    looks = [f"{r.choice(bases) ^ sum(1 << b for b in r.sample(range(64), r.randint(0, 6))):016x}" for _ in range(300)] + ["short", None, "0" * 16]
    rows = [(k, look) for k, look in zip(r.sample(range(1000), len(looks)), looks)]
    every = spark.createDataFrame(rows, "id long, look string")
    want = {tuple(x) for x in photos.near_looks(every, "id", "look")[0].collect()}
    index = photos.LookIndex(spark, str(tmp_path / "looks"), buckets=8)
    for k in range(3):
        assert index.add(spark.createDataFrame(rows[k::3], "id long, look string"), "id", "look") == k + 1
    found = [tuple(x) for x in index.pairs().collect()]
    assert set(found) == want and len(found) == len(want) and want
    version = index.add(every, "id", "look")  # nothing is new
    assert {tuple(x) for x in index.pairs().collect()} == want
    assert index.store.since("pairs").filter(F.col("since") == version).count() == 0


def test_lines_of_certificates(spark):
    rows = [("1", "48.5,2.5"), ("2", " 48.5 , 2 "), ("3", "48.5"), ("4", "x,2"), ("5", None), ("6", "1,2,3"), ("7", "nan,1"), (None, "1,2"), ("", "1,2")]
    found = certificates.mapped(spark.createDataFrame(rows, "numero_dpe string, _geopoint string"), certificates.RECENT, "recent").collect()
    assert {x.number_: (x.latitude, x.longitude) for x in found} == {"1": (48.5, 2.5), "2": (48.5, 2), "3": (None, None), "4": (None, None), "5": (None, None), "6": (1, 2), "7": (None, None)}
    assert {x.address for x in found} == {"Adresse inconnue"} and {x.postal_code for x in found} == {None}
    texts = ["1 rue du Port 76190 Yvetot", "76190", "761900 Yvetot", "12345 and 54321", "", None]
    codes = spark.createDataFrame(list(enumerate(texts)), "k int, t string").orderBy("k").select(certificates.postal_code(F.col("t"))).collect()
    assert [x[0] for x in codes] == ["76190", "76190", None, "12345", None, None]


def test_search_pages_are_parsed_once(spark):
    """Four JSON parses in the plan, whatever is made of the cards: an inferred filter would repeat them for each use."""
    for name in ("s12_s13_p22_f20_search_cards", "p06_filtered_cards", "p07_cards_of_a_code"):
        plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") == 4, name


def test_more_rows_of_answers(spark):
    names, rows = spark_rows(catalogue.QUERIES["s13_statistics_answer"](spark, SF))
    assert names == ["key", "section", "value"] and sum(rows.values()) == 24
