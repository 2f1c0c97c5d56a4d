"""Cases with known answers: histogram, reactions, certificates, tags, page texts, connectors."""

import datetime
import json

import pytest
from pyspark.sql import functions as F

from foyer.functions import portal as P
from foyer.functions import scalars as S
from foyer.operators import certificates, geo, reactions, search, stats
from foyer.sources import connectors, payloads


def test_histogram_of_known_prices(spark):
    rows = spark.createDataFrame([(p,) for p in (100, 110, 125, 150, 180)], "price long")
    found = [(r.bucket, r.low, r.high, r.n) for r in stats.price_histogram(rows, 4).orderBy("bucket").collect()]
    assert found == [(0, 100, 119, 2), (1, 120, 139, 1), (2, 140, 159, 1), (3, 160, 180, 1)]
    alone = stats.price_histogram(spark.createDataFrame([(7,), (7,)], "price long")).collect()
    assert [(r.low, r.high, r.n, r.label) for r in alone] == [(7, 7, 2, "7\u00a0€")]
    assert stats.price_histogram(rows.limit(0)).count() == 0


@pytest.mark.parametrize(
    "log, want",
    [
        ([("toggle", "like", 0)], ("like", False)),
        ([("toggle", "like", 0), ("toggle", "like", 1)], None),
        ([("toggle", "dislike", 0), ("archive", None, 1)], ("dislike", False)),  # only likes are archived
        ([("toggle", "like", 0), ("archive", None, 1)], ("like", True)),
        ([("toggle", "like", 0), ("archive", None, 1), ("add", "like", 2)], ("like", False)),
        ([("toggle", "like", 0), ("archive", None, 1), ("unarchive", None, 2)], ("like", False)),
        ([("toggle", "like", 0), ("remove", "dislike", 1)], ("like", False)),  # another type stays
        ([("toggle", "like", 0), ("remove", "like", 1)], None),
        ([("toggle", "like", 0), ("toggle", "dislike", 9), ("undo", None, 14)], None),  # within five seconds; the like doesn't come back
        ([("toggle", "dislike", 0), ("undo", None, 6)], ("dislike", False)),
        ([("toggle", "like", 0), ("undo", None, 1)], ("like", False)),
        ([("toggle", "dislike", 0), ("add", "dislike", 4), ("undo", None, 7)], ("dislike", False)),  # adding again doesn't renew it
    ],
)
def test_reaction_logs(spark, log, want):
    start = datetime.datetime(2026, 1, 1)
    rows = [(k, 1, a, t, start + datetime.timedelta(seconds=s)) for k, (a, t, s) in enumerate(log)]
    found = reactions.current(spark.createDataFrame(rows, "event_id long, property_id long, action string, type string, ts timestamp_ntz")).collect()
    assert [(r.type, r.archived) for r in found] == ([want] if want else [])


def test_certificates_of_homes_that_know_little(spark):
    home = "id long, postal_code string, title string, description string, dpe_class string, ges_class string, consumption double, emission double, surface double, latitude double, longitude double, construction_year int"
    homes = spark.createDataFrame([(1, "76190", "Maison au hameau des Fougères", None, "C", None, None, None, 100.0, None, None, 1970), (2, "76190", "t", None, None, None, 120.4, None, None, None, None, None), (3, None, "t", None, "C", None, None, None, None, None, None, None)], home)
    cert = "number_ long, address string, department string, dpe_class string, ges_class string, consumption double, emission double, surface double, latitude double, longitude double, construction_year int, established timestamp"
    at = datetime.datetime(2025, 6, 1)
    rows = [
        (10, "1 Hameau des FOUGÈRES", "76", "C", "A", 130.0, None, 110.0, None, None, 1972, at),
        (11, "1 hameau  des fougeres", None, "C", "B", 122.4, 3.0, None, None, None, None, None),  # no department: may lie anywhere; the same address
        (12, "2 rue X", "75", "C", "A", 120.0, None, None, None, None, None, at),
        (13, "3 rue Y", "76", "D", None, 118.4, None, None, None, None, None, None),
    ]
    found = certificates.rank(homes, spark.createDataFrame(rows, cert), "2026-01-15 00:00:00").collect()
    score = {(r.home_id, r.number_): round(r.score, 6) for r in found}
    # class 30, surface 20 * (1 - 10 / 25), place names "hameau" 16 and "fougeres" 18, year 5, recency 5
    assert score == {(1, 10): 30 + 12 + 16 + 18 + 5 + 5, (2, 11): 0, (2, 13): 0}


def test_tags_and_texts(spark):
    rows = spark.createDataFrame([(["90 m²", "90 m²x", "5 pièces", "Terrain de 300 m²", " Cave "], "Classe énergie C, Classe climat D. Consommation : 100,5 kWh/m²"), (None, "GES : e"), (["Garage"], "rien")], "tags array<string>, text string")
    dpe, ges = P.energy_classes(F.col("text"))
    found = rows.select(S.highlights_from_tags(F.col("tags")), P.rooms_from_tags(F.col("tags")), P.parking_from_tags(F.col("tags")), dpe, ges, S.consumption_from_text(F.col("text"))).collect()
    assert [tuple(r) for r in found] == [(["90 m²", "Cave"], 5, None, "C", "D", 100.5), (None, None, None, None, "E", None), (["Garage"], None, 1, None, None, None)]


def test_page_texts(spark):
    long_ = "Une belle maison de charme au calme absolu, " + "avec jardin " * 4000
    escaped = '"x \\"mainDescription\\":{\\"headline\\":\\"h\\",\\"description\\":\\"' + long_ + '\\"}"'
    pages = [
        (1, f'<p data-testid="cdp-main-description-expandable-text">{long_}<br/>fin &amp; suite</p>'),
        (2, escaped),
        (3, '"mainDescription":{"headline":"h","description":"trop court"}'),
        (4, "<title>SeLoger</title>"),
        (5, "<title>504 Gateway Time-out</title>"),
        (6, '<script>window["__UFRN_FETCHER__"]=JSON.parse("{\\"data\\": {}}")</script> "data":{}'),
    ]
    found = {r.id: r for r in spark.createDataFrame(pages, "id int, html string").select("id", P.page_description(F.col("html")).alias("said"), P.health(F.col("html"), "seloger").alias("health"), P.search_failure(F.col("html"), "SeLoger").alias("why")).collect()}
    assert found[1].said == long_.strip() + " \nfin & suite".replace(" \n", "\n") and found[2].said == long_.strip() and found[3].said is None
    assert (found[4].why, found[5].why, found[6].health) == ("empty shell", "gateway timeout", "incomplete")


def test_search_answer_in_a_page(spark):
    answer = {"cards": {"list": [{"id": "7", "cardType": "classified", "title": "T", "pricing": {"rawPrice": "250000"}, "tags": ["4 pièces"], "gallery": {"images": [{"url": "/a.jpg"}]}, "zipCode": "76000", "description": 'dit "oui"\nDPE : B'}, {"id": "8", "cardType": "ad"}]}, "navigation": {"counts": {"count": 40}}}
    quoted = json.dumps(json.dumps(answer))
    cards = payloads.search_cards(spark.createDataFrame([(f"<script>window[\"initialData\"] = JSON.parse({quoted})</script>",), ("<p>no data</p>",)], "html string"))
    rows = payloads.classified_listings(cards, "seloger", "2026-01-15T10:00:00", "Rouen").collect()
    assert [(r.external_id, r.price, r.rooms, r.city, r.image_url, r.dpe_class, r.description) for r in rows] == [("7", 250000, 4, "Rouen", "https://mms.seloger.com/a.jpg", "B", 'dit "oui"\nDPE : B')]
    assert [r.total for r in cards.select("total").collect()] == [40]


def test_connectors_keep_a_failing_source_apart(spark, tmp_path):
    (tmp_path / "a.json").write_text(json.dumps({"id": "ag1-2", "title": "Maison", "price": 100000, "city": "Rouen", "surfaceArea": 80.0}))
    readers = connectors.connectors(("bienici", "leboncoin"))
    rows, errors = connectors.gathered(spark, {"bienici": str(tmp_path / "a.json"), "leboncoin": str(tmp_path / "none.json")}, readers)
    assert [(r.source, r.external_id, r.surface) for r in rows.collect()] == [("bienici", "ag1-2", 80.0)]
    assert [r.source for r in errors.collect()] == ["leboncoin"]
    with pytest.raises(ValueError):
        connectors.connectors(("unknown",))
    near = spark.createDataFrame([(1, 1, 5, 0.8, None), (1, 2, 4, 0.76, "x")], "listing_id long, rank int, property_id long, score double, veto string")
    for _ in range(2):
        connectors.append_diagnostics(near, str(tmp_path / "near"), "2026-01-15 10:00:00")
    assert [len(r.near_misses) for r in spark.read.parquet(str(tmp_path / "near")).collect()] == [2, 2]


def test_filters_of_a_query_string():
    f = search.parse_filters({"min_price": "100000", "city": " Rouen ", "new_only": "1", "radius_km": "x", "limit": "5000", "offset": "-3", "sort": "odd", "unknown": "1"})
    assert (f.min_price, f.city, f.new_only, f.radius_km, f.limit, f.offset, f.sort) == (100000, "Rouen", True, None, search.PAGE_MOST, 0, "price_asc")
    assert search.parse_filters(search.serialize_filters(f)) == f
    with pytest.raises(ValueError):
        search.SearchFilters(new_only=True, old_only=True)


def test_meaning_of_a_geographic_filter():
    center = (49.61, 0.51)
    assert geo.resolved(search.SearchFilters(travel_minutes=60, radius_km=3), center) == (center, 50)
    assert geo.resolved(search.SearchFilters(radius_km=3), center) == (center, 3)
    assert geo.resolved(search.SearchFilters(radius_km=3), None) == geo.resolved(search.SearchFilters(city="x"), center) == (None, None)
