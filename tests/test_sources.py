"""Reading ads of connectors."""

import json

from foyer.sources.listings import read_listings, write_publications

GOOD = {"external_id": "ext-1", "source": "bienici", "title": "Maison", "price": 300000, "surface": 90.0, "city": "Paris", "url": "https://example.org/1", "scraped_at": "2026-01-15T10:00:00Z", "unknown": 1}


def test_reads_validates_and_writes_by_source(spark, tmp_path):
    rows = [GOOD, GOOD | {"external_id": "ext-2", "price": -5}, GOOD | {"external_id": "ext-3", "source": "seloger"}]
    (tmp_path / "ads.json").write_text("\n".join(map(json.dumps, rows)))
    valid, rejected = read_listings(spark, str(tmp_path / "ads.json"))
    assert sorted(r.external_id for r in valid.collect()) == ["ext-1", "ext-3"]
    assert [r.external_id for r in rejected.collect()] == ["ext-2"]
    write_publications(valid, str(tmp_path / "out"))
    write_publications(valid.filter("source = 'bienici'"), str(tmp_path / "out"))
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2
