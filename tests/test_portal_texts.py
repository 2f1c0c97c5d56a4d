"""A case for each pattern and rule by which pages and texts of ads are read."""

import pytest
from pyspark.sql import functions as F

from foyer.functions import portal as P
from foyer.functions import scalars as S


def each(spark, texts, *columns):
    rows = spark.createDataFrame(list(enumerate(texts)), "k int, t string").select("k", *(c.alias(f"c{n}") for n, c in enumerate(columns))).orderBy("k").collect()
    return [tuple(r[1:]) if len(columns) > 1 else r[1] for r in rows]


def test_classes_and_land_in_texts(spark):
    texts = ["Classe énergie C, Classe climat d", "DPE : e", "GES: b", "classe énergie F", "Climat  A", "rien", None]
    assert each(spark, texts, *P.energy_classes(F.col("t"))) == [("C", "D"), ("E", None), (None, "B"), ("F", None), (None, "A"), (None, None), (None, None)]
    texts = ["terrain de 1 250 m²", "Terrain 80 m²", "600 m² de terrain", "9 m² terrain", "90 m²", None]
    assert each(spark, texts, P.land_surface(F.col("t"))) == [1250, 80, 600, 9, None, None]


def test_metrics_years_and_bathrooms(spark):
    texts = ["Consommation d'énergie : 120,5 kWh/m²", "210 kWh / m² . an", "90 kwh/m²/an", "90 kWh/m²", None]
    assert each(spark, texts, S.consumption_from_text(F.col("t"))) == [120.5, 210, 90, None, None]
    texts = ["Émission : 12 kg", "émissions: 3.5 kg", "7 kg CO₂/m²", "8 kg co / m²", "9 kg", None]
    assert each(spark, texts, S.emission_from_text(F.col("t"))) == [12, 3.5, 7, 8, None, None]
    assert each(spark, ["bâtie en 1885", "de 1930 à 2011", "2029", "1879", "20301", None], S.year_from_text(F.col("t"))) == [1885, 1930, 2029, None, None, None]
    tags = ["2 salles de bain|3 sdb", "SDB|1 sdb", "2 salle d'eau", "1 salles d’eau", "salle de bains", None]
    assert each(spark, tags, S.bathrooms_from_tags(F.split("t", r"\|"))) == [2, 1, 2, 1, None, None]
    assert each(spark, ["3 pièces", "2 chambres", "2 chambresx", "Terrain de 5", "90 m²x", "90 m²", "Classe énergie", "Cave"], S.highlights_from_tags(F.array("t"))) == [None, None, ["2 chambresx"], None, None, ["90 m²"], None, ["Cave"]]


def test_ratings_beside_their_scales(spark):
    pages = [
        r'{\"rating\":\"A\"} {\"rating\":\"c\",\"type\":\"FR_ENERGY_AFTER_2021\",\"value\":\"120,5 kWh/m²\"} {\"rating\":\"B\",\"type\":\"FR_GHG_AFTER_2021\",\"value\":\"7 kg CO₂/m²\"}',
        '{"rating":"D","type":"FR_ENERGY_AFTER_2021"} {"type":"FR_GHG_AFTER_2021","value":"9 kg CO₂/m²"}',  # plain JSON; what a scale lacks isn't taken from its neighbor
        '"rating":"E" and no scale',
        '"FR_GHG_AFTER_2021" "value":"soon"',
        None,
    ]
    energy, climate = (P.rated(P.bare(F.col("t")), s) for s in (P.ENERGY_SCALE, P.CLIMATE_SCALE))
    assert each(spark, pages, *energy, *climate) == [("C", 120.5, "B", 7), ("D", None, None, 9), (None,) * 4, (None,) * 4, (None,) * 4]
    assert each(spark, ["DPE : F " + pages[0]], *P.page_energy(F.col("t")).values()) == [("F", "B", 120.5, 7)]


def test_places_in_pages(spark):
    pages = [
        "x/static/pin/3.5,46.5,12 y",
        r'{\"type\":\"Point\",\"coordinates\":[2.5,47.5]}',
        '{"type":"Point","coordinates":[47.5,2.5]}',  # turned around
        '"latitude" : 48.25, "zoom": 3, "longitude":2.25',
        '"longitude": 1.25, "latitude": 46',
        '"latitude": 48.25}, {"longitude": 2.25',  # not of one object
        "/static/a/100.5,80.5,1 " + r'\"latitude\":48,\"longitude\":2',  # outside, so the next way counts
        '"latitude": 10, "longitude": 80',
        "nowhere",
        None,
    ]
    found = each(spark, pages, P.page_point(F.col("t")))
    assert [x and (x.lat, x.lng) for x in found] == [(46.5, 3.5), (47.5, 2.5), (47.5, 2.5), (48.25, 2.25), (46, 1.25), None, (48, 2), None, None, None]


def test_text_of_elements(spark):
    html = ["a<br>b<BR/>c<br />d", "<p>one</p><p>two</p>", "x &amp; y &lt;z&gt; &quot;q&quot; &#39;s&#39;&nbsp;!", "&amp;lt; R&D & &unknown; &", "1 < 2 and <b>3</b>", "", None]
    assert each(spark, html, P.plain_text(F.col("t"))) == ["a\nb\nc\nd", "one\n\ntwo\n\n", "x & y <z> \"q\" 's' !", "&lt; R&D & &unknown; &", "1 < 2 and 3", "", None]
    texts = ["\n a b \t\n\n\n\n c  \nd\n\n", "x", " \n ", "", None]
    assert each(spark, texts, P.tidy(F.col("t"))) == ["a b\n\n c\nd", "x", "", "", None]


LONG = "Une belle maison de charme au calme absolu, vue dégagée"


def test_what_counts_as_a_description(spark):
    texts = [LONG, "trop court", LONG + '","canonical":"x', LONG + ' \\"fin', "Achat Maison 5 pièces  120 m² 250 000 € Rouen la belle (76000)", "Achat Terrain 5 pièces 120 m² 250 000 € Rouen belle (76000)", "Achat Maison à Rouen pour 250 000 €, proche de la gare et calme", None]
    assert each(spark, texts, P.plausible_description(F.col("t"))) == [True, False, False, False, False, True, True, None]
    assert each(spark, ["", " ", None, "fin...", "fin…", LONG, LONG + '","canonical"'], P.cut_off(F.col("t"))) == [True, True, True, True, True, False, True]


@pytest.mark.parametrize("escape", [False, True])
def test_descriptions_of_payloads(spark, escape):
    def page(object_):
        text = f'{{"classified":{{"mainDescription":{object_},"x":1}}}}'
        return '<script>y("' + text.replace("\\", "\\\\").replace('"', '\\"') + '")</script>' if escape else f"<script>{text}</script>"

    pages = [
        page(f'{{"headline":"h","description":"{LONG}"}}'),
        page(f'{{"description":"{LONG} dit \\"oui\\"\\n\\n\\n\\nfin \\u00e9","headline":null}}'),
        page('{"description":"court"}'),
        page('{"headline":"h"}') + page(f'{{"description":"{LONG}"}}') + page(f'{{"description":"{LONG} et plus"}}'),
        page('{"description":"' + LONG),  # broke off
        f'<div data-testid="cdp-main-description-expandable-text" class="a">{LONG} &amp; plus long</div>' + page(f'{{"description":"{LONG}"}}'),
    ]
    want = [LONG, f'{LONG} dit "oui"\n\nfin é', None, LONG + " et plus", None, LONG + " & plus long"]
    assert each(spark, pages, P.page_description(F.col("t"))) == want
