"""Queries of portal payloads, places, enrichment and answers, and the same in SQL.

Pages and payloads are made from the derived tables; the SQL says from the same tables
what reading them must give, so each query is a round trip.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.functions import legacy as L
from foyer.functions import portal as P
from foyer.functions import scalars as S
from foyer.functions import texts as X
from foyer.operators import enrichment, geo, learning, projection, reactions, search, serialize, stats
from foyer.plans import catalogue as C
from foyer.plans.fixtures import Tables
from foyer.plans.registry import query, rounded
from foyer.session import spread, stored
from foyer.sources import payloads

AT = "2024-01-15T10:00:00"


def _quoted(json: Column) -> Column:
    """A JSON text as a JavaScript string's inside."""
    return F.replace(F.replace(json, F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"'))


def _letter(n: int) -> Column:
    return F.substring(F.lit("ABCDEFG"), (F.col("id") % n + 1).cast("int"), F.lit(1))


def _whole(name: str) -> Column:
    return F.col(name).cast("long").cast("string")


def _tags() -> Column:
    facts = (F.concat(_whole("rooms"), F.lit(" pièces")), F.concat(_whole("bedrooms"), F.lit(" chambres")), F.concat(F.lit("Terrain de "), _whole("land_surface"), F.lit(" m²")), F.concat(F.lit("Classe énergie "), _letter(7)), F.lit("Chauffage gaz"), F.lit("2 places de parking"))
    return F.array_compact(F.array(*facts))


_TAGGED = "concat_ws(',', 'Chauffage gaz', '2 places de parking')"


def _search_pages(t: Tables) -> DataFrame:
    data = F.struct(
        F.col("external_id").alias("id"), F.concat(F.lit("/ad/"), F.col("id").cast("string")).alias("url"), F.struct(F.concat(F.lit("Une \"belle\" maison\n"), F.col("title")).alias("description")).alias("mainDescription"),
        F.struct(F.col("title").alias("title"), _tags().alias("keyfacts")).alias("hardFacts"),
        F.struct(F.col("property_type").alias("propertyTypeLabel"), F.col("price").cast("double").alias("price"), F.struct(F.col("surface").alias("main")).alias("surface"), F.when(F.col("id") % 2 == 0, F.col("rooms")).alias("nbroom")).alias("rawData"),
        F.struct(F.col("is_new_property").alias("isNew")).alias("tags"), F.struct(F.struct(F.col("city"), F.col("postal_code").alias("zipCode")).alias("address"), F.struct((F.col("id") % 60).cast("double").alias("lat"), F.lit(2.5).alias("lng")).alias("coordinates")).alias("location"),
        F.struct(F.array(F.struct(F.lit("").alias("url")), F.struct(F.concat(F.lit("photo"), F.col("id").cast("string"), F.lit(".jpg")).alias("url"))).alias("images")).alias("gallery"),
    )
    own = spread(t.publications, "id").filter("external_id <> ''").withColumn("data", data).groupBy(F.floor(F.col("id") / 25).alias("page")).agg(F.sort_array(F.collect_list("external_id")).alias("ids"), F.map_from_entries(F.collect_list(F.struct("external_id", "data"))).alias("all"))
    props = F.struct(F.lit(777).alias("totalCount"), F.concat("ids", F.array(F.lit("unknown"))).alias("classifieds"), F.col("all").alias("classifiedsData"))
    json = F.to_json(F.struct(F.struct(F.struct(props.alias("pageProps")).alias("classified-serp-init-data")).alias("data")))
    return own.select("page", F.concat(F.lit('<html><title>Ads</title><script>window["__UFRN_FETCHER__"]=JSON.parse("'), _quoted(json), F.lit('");</script></html>')).alias("html"))


@query(f"""select external_id, title, price, surface, rooms, bedrooms, land_surface, substr('ABCDEFG', cast(id % 7 + 1 as int), 1) as dpe_class, is_new_property, city, postal_code, 'https://www.logic-immo.com/ad/' || id as url,
  'https://mms.logic-immo.com/photo' || id || '.jpg' as image_url, 'Une "belle" maison' || chr(10) || title as description, property_type, 'Chauffage gaz' as heating, 2 as parking_spaces, {_TAGGED} as highlights,
  case when id % 60 between 41 and 52 then cast(id % 60 as double) end as latitude from publications where external_id <> ''""")
def s12_s13_p22_f20_search_cards(t):
    rows = payloads.classified_listings(payloads.search_cards(_search_pages(t)), "logicimmo", AT, "Nowhere")
    return rows.select("external_id", "title", "price", "surface", "rooms", "bedrooms", "land_surface", "dpe_class", "is_new_property", "city", "postal_code", "url", "image_url", "description", "property_type", "heating", "parking_spaces", F.array_join("highlights", ",").alias("highlights"), "latitude")


@query("select external_id from publications where external_id <> '' and price between 100000 and 300000 and (surface is null or surface >= 60) and (rooms is null or rooms >= 2) and (is_new_property is null or not is_new_property)")
def p06_filtered_cards(t):
    cards = payloads.filtered_cards(payloads.search_cards(_search_pages(t)), min_price=100000, max_price=300000, min_surface=60, min_rooms=2, new=False)
    return cards.select(F.col("card.id").alias("external_id"))


@query("select external_id from publications where external_id <> '' and postal_code = '76013'")
def p07_cards_of_a_code(t):
    return payloads.filtered_cards(payloads.search_cards(_search_pages(t)), postal_code="76013").select(F.col("card.id").alias("external_id"))


def _leboncoin_ads(t: Tables) -> DataFrame:
    pair = lambda key, value, label=None: F.struct(F.lit(key).alias("key"), value.cast("string").alias("value"), (F.lit(None).cast("string") if label is None else label).alias("value_label"))
    attributes = F.array(pair("square", F.col("surface")), pair("land_plot_surface", F.col("land_surface")), pair("rooms", F.col("rooms")), pair("rooms", F.lit(99)), pair("bedrooms", F.col("bedrooms")), pair("energy_rate", _letter(7)), pair("building_year", F.col("id") % 400 + 1700),
                         pair("real_estate_type", F.lit("1"), F.col("property_type")), pair("immo_sell_type", F.when(F.col("is_new_property"), "new").when(~F.col("is_new_property"), "old")), pair("specificities", F.lit("x"), F.lit("Piscine, Cave ,")), pair("elevator", F.when(F.col("id") % 2 == 0, "oui").otherwise("Non")))
    body = F.concat(F.lit("Consommation : "), (F.col("id") % 300).cast("string"), F.lit(",5 kWh/m² et émissions : "), (F.col("id") % 60).cast("string"), F.lit(" kg"))
    images = F.struct(F.array(F.lit(" ")).alias("urls_large"), F.array(F.concat(F.lit("https://i.e/"), F.col("id").cast("string"))).alias("urls"))
    location = F.struct(F.lit(48.5).alias("lat"), F.lit(2.5).alias("lng"), F.when(F.col("id") % 3 > 0, F.col("city")).otherwise("").alias("city"), F.col("postal_code").alias("zipcode"))
    return spread(t.publications, "id").select("id", F.struct(F.col("id").alias("list_id"), F.col("title").alias("subject"), body.alias("body"), F.array("price").alias("price"), F.col("url"), attributes.alias("attributes"), location.alias("location"), images.alias("images")).alias("ad"))


_LEBONCOIN = """select cast(id as varchar) as external_id, title, price, surface, land_surface, rooms, bedrooms, is_new_property, case when id % 3 > 0 then city else 'Ici' end as city, postal_code, coalesce(property_type, '1') as property_type, substr('ABCDEFG', cast(id % 7 + 1 as int), 1) as dpe_class,
  id % 300 + 0.5::double as dpe_consumption_kwh_m2, cast(id % 60 as double) as ges_emission_kg_m2, case when id % 400 + 1700 >= 1800 then cast(id % 400 + 1700 as int) end as construction_year, case when id % 2 = 0 then 'Piscine,Cave,Ascenseur' else 'Piscine,Cave' end as highlights, 'https://i.e/' || id as image_url from publications"""


def _leboncoin_rows(ads: DataFrame) -> DataFrame:
    names = ("external_id", "title", "price", "surface", "land_surface", "rooms", "bedrooms", "is_new_property", "city", "postal_code", "property_type", "dpe_class", "dpe_consumption_kwh_m2", "ges_emission_kg_m2", "construction_year")
    return payloads.leboncoin_listings(ads, AT, "Ici").select(*names, F.array_join("highlights", ",").alias("highlights"), "image_url")


@query(_LEBONCOIN)
def s09_p22_f25_leboncoin_search(t):
    answers = _leboncoin_ads(t).groupBy(F.floor(F.col("id") / 35).alias("page")).agg(F.to_json(F.struct(F.collect_list("ad").alias("ads"))).alias("body"))
    return _leboncoin_rows(payloads.leboncoin_search(answers))


@query(f"select * from ({_LEBONCOIN}) where cast(external_id as bigint) % 4 <> 0")
def s10_leboncoin_details(t):
    good = F.concat(F.lit('<html><script id="__NEXT_DATA__" type="application/json">'), F.to_json(F.struct(F.struct(F.struct("ad").alias("pageProps")).alias("props"))), F.lit("</script></html>"))
    pages = _leboncoin_ads(t).select("id", F.when(F.col("id") % 4 == 0, "<html><title>leboncoin.fr</title></html>").otherwise(good).alias("html"))
    return _leboncoin_rows(payloads.leboncoin_detail(pages)[0])


@query("select id, case when id % 3 = 0 then 'blocked as a robot' when id % 3 = 1 then 'empty shell' else 'no data tag' end as reason from publications")
def s15_leboncoin_failures(t):
    html = F.when(F.col("id") % 3 == 0, "<p>Vous avez ÉTÉ BLOQUÉ</p>").when(F.col("id") % 3 == 1, "<title> leboncoin.fr </title>").otherwise("<title>Maison</title>")
    return payloads.leboncoin_detail(t.publications.select("id", html.alias("html")))[1].select("id", "reason")


def _bienici_ads(t: Tables) -> DataFrame:
    spot = F.struct((F.lit(48) + F.col("id") % 3).cast("double").alias("lat"), F.lit(2.5).alias("lon"))
    return t.publications.select(F.col("external_id").alias("id"), F.when(F.col("id") % 4 == 0, "  ").otherwise(F.col("title")).alias("title"), "price", F.when(F.col("id") % 10 == 0, 0.0).otherwise(F.col("surface")).alias("surfaceArea"), F.when(F.col("id") % 2 == 0, F.col("land_surface")).alias("landSurfaceArea"), F.col("land_surface").alias("gardenSurfaceArea"),
                                 F.col("rooms").alias("roomsQuantity"), F.col("bedrooms").alias("bedroomsQuantity"), F.col("is_new_property").alias("newProperty"), F.struct(F.when(F.col("id") % 2 == 0, spot).alias("position"), F.when(F.col("id") % 3 > 0, spot).alias("centroid")).alias("blurInfo"), "city", F.col("postal_code").alias("postalCode"),
                                 F.lit("DPE : 12,5 kWh/m²/an").alias("description"), F.array(F.struct(F.lit(" ").alias("url_photo")), F.struct(F.col("image_b").alias("url_photo"))).alias("photos"), F.col("property_type").alias("propertyType"), F.lower(_letter(7)).alias("energyClassification"), F.lit(None).cast("string").alias("greenhouseGazClassification"),
                                 F.when(F.col("id") % 2 == 0, (F.col("id") % 200).cast("double")).alias("energyConsumption"), F.lit(None).cast("double").alias("greenhouseGazConsumption"), F.when(F.col("id") % 5 > 0, F.col("url")).alias("url"), F.lit(2).alias("bathroomsQuantity"), (F.col("id") % 3).cast("int").alias("showerRoomsQuantity"), F.lit(1799.6).alias("yearOfConstruction"),
                                 F.lit("gaz").alias("heating"), F.lit(None).cast("string").alias("exposition"), F.lit(1).alias("parkingPlacesQuantity"), (F.col("id") % 2 == 0).alias("hasGarden"), F.lit(False).alias("hasCellar"), F.lit(True).alias("hasPool"), F.lit(None).cast("boolean").alias("hasAirConditioning"), (F.col("id") % 4).cast("int").alias("terracesQuantity"), (F.col("id") % 7 == 0).alias("workToDo"))


@query("""select external_id, case when id % 4 > 0 then title else coalesce(trim(property_type), 'Property listing') end as title, price, case when id % 10 > 0 then surface end as surface, land_surface, rooms, bedrooms, is_new_property, case when id % 2 = 0 or id % 3 > 0 then cast(48 + id % 3 as double) end as latitude,
  city, postal_code, case when id % 5 > 0 then url else 'https://www.bienici.com/annonce/' || external_id end as url, image_b as image_url, substr('ABCDEFG', cast(id % 7 + 1 as int), 1) as dpe_class, case when id % 2 = 0 then cast(id % 200 as double) else 12.5 end as dpe_consumption_kwh_m2, 1800 as construction_year, case when id % 7 = 0 then 'Work required' end as property_condition,
  concat_ws(',', case when id % 2 = 0 then 'Garden' end, 'Pool', case id % 4 when 1 then 'Terrace' when 2 then '2 terraces' when 3 then '3 terraces' end, case id % 3 when 1 then 'Shower room' when 2 then '2 shower rooms' end) as highlights from publications""")
def p22_f26_bienici_listings(t):
    rows = payloads.bienici_listings(_bienici_ads(t), AT, "Ici")
    return rows.select("external_id", "title", "price", "surface", "land_surface", "rooms", "bedrooms", "is_new_property", "latitude", "city", "postal_code", "url", "image_url", "dpe_class", "dpe_consumption_kwh_m2", "construction_year", "property_condition", F.array_join("highlights", ",").alias("highlights"))


@query("select external_id, case when id % 10 = 0 then 0.0 else surface end as surface, land_surface, rooms, 2 as bathrooms from publications")
def p23_bienici_patches(t):
    return payloads.bienici_patches(_bienici_ads(t)).select("external_id", "surface", "land_surface", "rooms", "bathrooms")


def _details(t: Tables) -> DataFrame:
    """Detail pages in four shapes: payload and text; escaped payload; element; bare."""
    said = F.concat(F.lit("Une maison de charme au calme, numéro "), F.col("id").cast("string"), F.lit(", avec terrain de 1 "), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" m² et vue."))
    data = F.struct(F.col("external_id").alias("id"), F.struct(F.lit(None).cast("string").alias("description")).alias("mainDescription"), F.struct(F.col("title").alias("title"), _tags().alias("keyfacts")).alias("hardFacts"), F.struct(F.struct(F.col("surface").alias("main")).alias("surface"), F.lit(48.25).alias("latitude"), F.lit(2.25).alias("longitude")).alias("rawData"))
    payload = F.to_json(F.struct(F.struct(F.struct(F.struct(data.alias("classifiedData")).alias("pageProps")).alias("classified-detail-init-data")).alias("data")))
    scales = F.concat(F.lit(r'x \"rating\":\"A\" y \"rating\":\"'), _letter(7), F.lit(r'\" \"type\":\"FR_ENERGY_AFTER_2021\",\"value\":\"'), (F.col("id") % 300).cast("string"), F.lit(r' kWh/m²\" \"rating\":\"'), _letter(5), F.lit(r'\" FR_GHG_AFTER_2021 \"value\":\"'), (F.col("id") % 60).cast("string"), F.lit(r' kg CO₂/m²\"'))
    shapes = (
        F.concat(F.lit('<script>window["__UFRN_FETCHER__"]=JSON.parse("'), _quoted(payload), F.lit('")</script>"mainDescription":{"headline":"h","description":"'), said, F.lit('"}')),
        F.concat(F.lit(r'"{\"mainDescription\":{\"headline\":\"h\",\"description\":\"'), said, F.lit(r'\"}" '), F.lit(r'\"type\":\"Point\",\"coordinates\":[2.5,47.5]')),
        F.concat(F.lit('<p data-testid="cdp-main-description-expandable-text" class="x">'), F.replace(said, F.lit("au calme"), F.lit("au calme &amp; au vert")), F.lit('</p> <img src="https://m.x/static/pin/3.5,46.5,12"> <meta property="og:image" content="https://i.x/'), F.col("id").cast("string"), F.lit('.jpg">')),
        F.concat(F.lit('<html>"longitude": 46.25, "zoom": 1, "latitude": 1.25 Terrain de 1 '), F.lpad((F.col("id") % 1000).cast("string"), 3, "0"), F.lit(" m² ")),
    )
    html = F.concat(scales, F.lit(" "), F.element_at(F.array(*shapes), (F.col("id") % 4 + 1).cast("int")))
    return spread(t.publications, "id").filter("external_id <> ''").select("id", html.alias("html"))


@query(f"""select id, substr('ABCDEFG', cast(id % 7 + 1 as int), 1) as dpe_class, case when id % 4 = 0 then null else substr('ABCDEFG', cast(id % 5 + 1 as int), 1) end as ges_class, cast(id % 300 as double) as dpe_consumption_kwh_m2,
  case id % 4 when 0 then 48.25 when 1 then 47.5 when 2 then 46.5 else 46.25 end as latitude, case id % 4 when 0 then 2.25 when 1 then 2.5 when 2 then 3.5 else 1.25 end as longitude, case when id % 4 = 0 then coalesce(land_surface, 1000 + id % 1000) else cast(1000 + id % 1000 as double) end as land_surface,
  case when id % 4 = 3 then null else concat('Une maison de charme au calme', case when id % 4 = 2 then ' & au vert' else '' end, ', numéro ', id, ', avec terrain de 1 ', lpad(cast(id % 1000 as varchar), 3, '0'), ' m² et vue.') end as description,
  case when id % 4 = 0 then rooms end as rooms, case when id % 4 = 0 then surface end as surface, case when id % 4 = 0 then 'Chauffage gaz' end as heating, case when id % 4 = 2 then 'https://i.x/' || id || '.jpg' end as image_url from publications where external_id <> ''""")
def s14_f19_f21_f22_f23_f24_details(t):
    rows = payloads.detail_pages(_details(t))
    return rows.select("id", "dpe_class", F.when(F.col("id") % 4 > 0, F.col("ges_class")).alias("ges_class"), "dpe_consumption_kwh_m2", "latitude", "longitude", "land_surface", "description", "rooms", "surface", "heating", "image_url")


@query(r"""select page_id, trim(regexp_extract(html, '(?i)<title>([^<]*)</title>', 1)) as title, case when regexp_matches(html, '(?i)datadome|captcha|access denied') then 'blocked' when length(html) > 50000 and not contains(html, '__UFRN_FETCHER__') and not contains(html, 'window["initialData"]') and not contains(html, 'classified-serp-init-data') then 'incomplete' else 'ok' end as health,
  case when regexp_matches(html, '(?i)datadome|captcha-delivery|vous avez été bloqué') then 'blocked' when contains(html, '__NEXT_DATA__') then 'ok' when length(html) < 10000 then 'incomplete' else 'ok' end as next_health,
  coalesce(nullif(regexp_extract(html, '(?i)<meta[^>]+property=["'']og:image["''][^>]+content=["'']([^"'']+)["'']', 1), ''), '') as og_image from pages""")
def s15_f24_page_health(t):
    html = F.col("html")
    return t.pages.select("page_id", F.coalesce(P.page_title(html), F.lit("")).alias("title"), P.health(html, "seloger").alias("health"), P.health(html, "leboncoin").alias("next_health"), F.coalesce(P.og_image(html), F.lit("")).alias("og_image"))


# ---------------------------------------------------------------- places

_COMMUNES = "select id as pos, case when id % 5 = 0 then concat('Évry ', cast(id % 40 as varchar)) else concat('evry ', cast(id % 40 as varchar)) end as name, lpad(cast(75000 + id % 30 as varchar), 5, '0') as c1, lpad(cast(75000 + id % 45 as varchar), 5, '0') as c2, latitude, longitude from properties"


def _communes(t: Tables) -> DataFrame:
    code = lambda n: F.lpad((F.lit(75000) + F.col("id") % n).cast("string"), 5, "0")
    name = F.concat(F.when(F.col("id") % 5 == 0, "Évry ").otherwise("evry "), (F.col("id") % 40).cast("string"))
    return t.properties.select(F.col("id").alias("pos"), name.alias("name"), F.array(code(30), code(45)).alias("postal_codes"), "latitude", "longitude")


_INDEX = f"c as ({_COMMUNES}), e as (select pos, name, c1 as postal_code, latitude, longitude from c union all select pos, name, c2, latitude, longitude from c), n as (select *, trim(strip_accents(lower(name))) as norm from e where latitude is not null), f as (select * from n qualify row_number() over (partition by postal_code, norm order by pos) = 1), ix as (select postal_code, cast(row_number() over (partition by postal_code order by pos) - 1 as int) as \"at\", name as city, latitude, longitude, norm from f)"


@query(f"with {_INDEX} select postal_code, \"at\", city, latitude, longitude from ix")
def s17_postal_index(t):
    return geo.postal_index(_communes(t))


@query(f"with {_INDEX}, r as (select id, postal_code, 'EVRY ' || id % 50 as city from properties) select r.id, coalesce(a.city, b.city) as place_city, coalesce(a.latitude, b.latitude) as place_latitude from r left join ix a on a.postal_code = r.postal_code and a.norm = lower(r.city) left join ix b on b.postal_code = r.postal_code and b.at = 0")
def j11_located(t):
    rows = t.properties.select("id", "postal_code", F.concat(F.lit("EVRY "), (F.col("id") % 50).cast("string")).alias("city"))
    return geo.located(rows, geo.postal_index(_communes(t))).select("id", "place_city", "place_latitude")


@query("""with places as (select id % 60 as query, id as pos, id as place_id, 'Ville ' || id % 7 as name, lpad(cast(id % 11 as varchar), 5, '0') as code, id % 4 > 0 as usable from properties), asked as (select id as ask_id, id % 70 as query, 'ville ' || id % 9 as city, case when id % 3 > 0 then lpad(cast(id % 13 as varchar), 5, '0') end as postal_code from properties)
  select ask_id, first(place_id order by case when lower(name) = city and code = postal_code then 0 when code = postal_code then 1 when lower(name) = city then 2 else 3 end, pos) as place_id from asked left join (select * from places where usable) p using (query) group by ask_id""")
def j16_picked_places(t):
    code = lambda n: F.lpad((F.col("id") % n).cast("string"), 5, "0")
    places = t.properties.select((F.col("id") % 60).alias("query"), F.col("id").alias("pos"), F.col("id").alias("place_id"), F.concat(F.lit(" Ville "), (F.col("id") % 7).cast("string")).alias("name"), F.array(code(11)).alias("postal_codes"), (F.col("id") % 4 > 0).alias("usable"))
    asked = t.properties.select(F.col("id").alias("ask_id"), (F.col("id") % 70).alias("query"), F.concat(F.lit("ville "), (F.col("id") % 9).cast("string")).alias("city"), F.when(F.col("id") % 3 > 0, code(13)).alias("postal_code"))
    return geo.picked_places(asked, places)


@query(f"with d as (select id, {C._km('48.4', '2.4')} as km from properties where latitude is not null) select id from d where km <= 30 / 60.0 * 50")
def p03_p04_within_travel(t):
    center, radius = geo.resolved(search.SearchFilters(travel_minutes=30, city="x"), (48.4, 2.4))
    assert center and radius == 25
    return geo.within_travel(t.properties, center, 30).select("id")


# ---------------------------------------------------------------- enrichment

_ENRICHED = """pubs as (select *, case when id % 3 = 0 then null else scraped_at end as enriched_at, case when id % 4 = 0 then 'Coupé...' when id % 4 = 1 then null else 'Une description entière' end as said,
  case id % 5 when 0 then null when 1 then 'https://mms.seloger.com/a.jpg?ci_seal=x' when 2 then 'https://mms.seloger.com/a.jpg' when 3 then 'https://v.seloger.com/s/width/1/a.jpg' else 'https://i.x/a.jpg' end as picture from publications),
  flags as (select property_id, bool_or(is_active and (enriched_at is null or (id % 7 = 0 and image_a is not null))) as pending, bool_or(is_active and enriched_at is not null and source in ('seloger', 'logicimmo') and (id % 4 < 2 or id % 5 in (0, 2, 3))) as stale, bool_or(source in ('seloger', 'logicimmo')) as html from pubs group by 1)"""


def _enriched(t: Tables) -> DataFrame:
    pictures = F.array_compact(F.array("image_a", "image_b"))
    stored = F.when(F.col("id") % 7 == 0, F.filter(pictures, lambda u: u == F.col("image_b"))).otherwise(pictures)
    urls = ("https://mms.seloger.com/a.jpg?ci_seal=x", "https://mms.seloger.com/a.jpg", "https://v.seloger.com/s/width/1/a.jpg", "https://i.x/a.jpg")
    return t.publications.withColumns({"enriched_at": F.when(F.col("id") % 3 > 0, F.col("scraped_at")), "description": F.when(F.col("id") % 4 == 0, "Coupé...").when(F.col("id") % 4 > 1, "Une description entière"), "image_url": F.get(F.array(F.lit(None).cast("string"), *map(F.lit, urls)), (F.col("id") % 5).cast("int")), "image_urls": pictures, "image_local_hashes": F.map_from_arrays(stored, F.transform(stored, F.md5))})


@query(f"""with {_ENRICHED} select p.id, coalesce(pending, false) as backfill, coalesce(pending or stale, false) as display, p.id % 2 = 0 and (true or surface is null) as address from properties p left join flags on property_id = p.id""")
def p08_p09_p10_enrichment_status(t):
    rows = t.properties.withColumns({"address_enriched_at": F.when(F.col("id") % 2 > 0, F.lit(1)), "dpe_consumption_kwh_m2": F.lit(None).cast("double"), "ges_emission_kg_m2": F.lit(1.0)})
    return enrichment.enrichment_status(rows, _enriched(t))


@query(f"with {_ENRICHED} select count(*) as n from properties where id in (select property_id from flags where pending)")
def a04_pending(t):
    return enrichment.count_pending(t.properties, _enriched(t))


@query("select id, source, surface from publications")
def p24_patch_for_address(t):
    return enrichment.patch_for(t.publications.select("id", "source", "title", "surface", "description"), "address")


@query(f"""with o as (select id, coalesce(new.description, p.description) is distinct from p.description as changed_text, p.rooms is distinct from coalesce(new.rooms, p.rooms) as changed_rooms, p.description, new.description as nd, new.rooms as nr, p.rooms from publications p join (select id, case id % 4 when 0 then 'court' when 1 then 'une longue description nouvelle' when 2 then 'Texte...' end as description, case when id % 3 > 0 then cast(id % 6 + 1 as int) end as rooms from publications where is_active) new using (id)),
  w as (select *, nd is not null and (description is null or (regexp_matches(description, '(?:[.][.][.]|…)\\s*$') and not regexp_matches(nd, '(?:[.][.][.]|…)\\s*$')) or length(nd) > length(description)) as wins from o)
  select p.id, case when wins then nd else p.description end as description, coalesce(nr, p.rooms) as rooms, case when w.id is null then '' else concat_ws(',', case when wins then 'description' end, case when nr is not null and nr is distinct from p.rooms then 'rooms' end) end as changed from publications p left join w on w.id = p.id""")
def m15_m16_applied_patches(t):
    said = F.when(F.col("id") % 4 == 0, "court").when(F.col("id") % 4 == 1, "une longue description nouvelle").when(F.col("id") % 4 == 2, "Texte...")
    patches = t.publications.filter("is_active").select("id", said.alias("description"), F.when(F.col("id") % 3 > 0, (F.col("id") % 6 + 1).cast("int")).alias("rooms"))
    names = ["description", "rooms"]
    what = enrichment.patch_changes(t.publications, patches, names).select("id", F.array_join("changed", ",").alias("changed"))
    return enrichment.applied(t.publications, patches, names).select("id", "description", "rooms").join(what, "id", "left").na.fill("", ["changed"])


@query("select id, case when id % 2 = 0 and image_a is null then 0 when id % 2 = 0 then -1 else 1 end as n from publications")
def m17_u06_repaired_markers(t):
    urls = F.when(F.col("image_a").isNotNull(), F.array("image_a"))
    hashes = F.when(F.col("id") % 2 > 0, F.create_map(F.lit("x"), F.lit("y"), F.lit("k"), F.lit("z")))
    rows = enrichment.repaired_markers(t.publications.select("id", urls.alias("image_urls"), hashes.alias("image_local_hashes")))
    kept = enrichment.pruned_hashes(F.col("image_local_hashes"), F.array(F.lit("k")))
    return rows.select("id", F.coalesce(F.size(kept), F.lit(-1)).cast("long").alias("n")).withColumn("n", F.when(F.col("n") < 0, -1).otherwise(F.col("n")))


@query("select distinct md5(image_a) as hash from publications where image_a not in (select image_a from publications where source = 'bienici' and image_a is not null)")
def u06_orphan_images(t):
    stored = t.publications.filter("image_a is not null").select(F.md5("image_a").alias("hash")).distinct()
    return enrichment.orphan_images(stored, t.publications.filter("source = 'bienici' and image_a is not null").select(F.create_map("image_a", F.md5("image_a")).alias("image_local_hashes")))


@query("select distinct postal_code from properties where id % 4 = 1 and postal_code <> ''")
def m21_touched_postal_codes(t):
    changes = t.properties.select(F.col("id").alias("property_id"), F.when(F.col("id") % 4 == 1, F.array(F.lit("rooms"), F.lit("title"))).otherwise(F.array(F.lit("description"))).alias("changed"))
    return enrichment.touched_postal_codes(changes, t.properties)


# ---------------------------------------------------------------- answers


@query(f"""with d as (select property_id, description, row_number() over (partition by property_id {C._FIRST}) as n, source from publications where is_active and trim(description) <> '') select property_id, string_agg(source || ':' || description, '|' order by n) as descriptions from d group by 1""")
def p21_descriptions(t):
    return serialize.descriptions(t.publications).withColumn("descriptions", F.array_join(F.transform("descriptions", lambda x: F.concat_ws(":", x["source"], x["description"])), "|"))


@query(f"""with d as (select u.property_id, row_number() over (partition by u.property_id order by {C.RANK.replace('source', 'u.source')}, u.scraped_at desc, u.id) as n, u.id, u.price is distinct from p.price as a, u.surface is distinct from p.surface as b, u.rooms is distinct from p.rooms as c, u.bedrooms is distinct from p.bedrooms as d, u.land_surface is distinct from p.land_surface as e, u.title is distinct from p.title as f from publications u join properties p on p.id = u.property_id where u.is_active)
  select property_id, string_agg(id || ':' || concat_ws(',', case when a then 'price' end, case when b then 'surface' end, case when c then 'rooms' end, case when d then 'bedrooms' end, case when e then 'land_surface' end, case when f then 'title' end), '|' order by n) as publications from d group by 1""")
def p20_publication_details(t):
    rows = serialize.publication_details(t.properties, t.publications)
    return rows.withColumn("publications", F.array_join(F.transform("publications", lambda x: F.concat_ws(":", x["id"].cast("string"), F.array_join(x["fields"], ","))), "|"))


@query(f"""with page as (select * from properties order by price, id limit 100), s as (select property_id, string_agg(distinct source, ',' order by source) as sources, count(*) as n from publications where is_active group by 1)
  select p.id, {C._label('price')} as price_label, case when first_price > 0 and price < first_price then cast(floor((first_price - price) * 100.0 / first_price + 0.5) as int) end as price_drop_percent, r.type as reaction, coalesce(s.n, 0) as n_publications, coalesce(list_sum(list_transform(string_split(s.sources, ','), lambda x: case x when 'bienici' then 1 when 'seloger' then 10 when 'logicimmo' then 100 else 1000 end)), 0) as sources, case when p.id % 2 = 0 then p.id end as rank
  from page p left join s on s.property_id = p.id left join reactions r on r.property_id = p.id""")
def p19_listing_rows(t):
    page = t.properties.orderBy("price", "id").limit(100)
    ranks = t.properties.filter("id % 2 = 0").select("id", F.lit(1.0).alias("score"), F.col("id").alias("rank"), F.lit(9).alias("rank_total"))
    rows = serialize.listing_rows(page, t.publications, C._reactions(t), ranks)
    weight = F.aggregate(F.transform("sources", lambda x: F.when(x == "bienici", 1).when(x == "seloger", 10).when(x == "logicimmo", 100).otherwise(1000)), F.lit(0), lambda s, x: s + x)
    return rows.select("id", "price_label", "price_drop_percent", "reaction", "n_publications", weight.alias("sources"), "rank")


@query("(select id as rank, title from properties where id < 3 union all select -1 as rank, '+' || (count(*) - 5) as title from properties) union all select id as rank, title from properties where id in (3, 4)")
def s25_notices(t):
    rows = reactions.notices(t.properties.select(F.col("id").alias("rank"), "title"))
    return rows.select(F.when(F.col("rank") == 6, -1).otherwise(F.col("rank")).alias("rank"), "title")


# ---------------------------------------------------------------- learning, functions

_COUNTED = ("price", "surface", "land_surface", "rooms", "bedrooms")


@query(f"""with l as ({C._TRAIN.format('like')}) {' union all '.join(f"select '{c}' as criterion, cast(floor(case when count(case when {c} > 0 then {c} end) < 2 then 0 else stddev_pop(case when {c} > 0 then {c} end) / avg(case when {c} > 0 then {c} end) end * 1000000 + 0.5) as bigint) as spread, count(case when {c} > 0 then 1 end) as present from l" for c in _COUNTED)}""")
def a21_spread(t):
    row = learning.signals(C._training(t, "like"), _COUNTED)
    each = [row.select(F.lit(c).alias("criterion"), F.col(f"s_{c}").alias("spread"), F.col(f"p_{c}").alias("present")) for c in _COUNTED]
    found = each[0]
    for more in each[1:]:
        found = found.unionByName(more)
    return rounded(found, "spread")


def _weights_sql() -> str:
    """65 % by spread and distance of the medians, 35 % even, over criteria that more than half of the likes have."""
    number = {c: c for c in _COUNTED} | {"dpe": "ascii(dpe_class)", "distance": "latitude"}
    has = {c: f"{c} > 0" for c in _COUNTED} | {"dpe": "dpe_class is not null", "distance": "latitude is not null and longitude is not null", "ancien": "is_new_property is not null"}
    parts = []
    for c in has:
        v = f"case when {number[c]} > 0 then {number[c]} end" if c in number else "cast(is_new_property as int)"
        parts.append(f"""select '{c}' as criterion, a.spread, b.spread as other, a.median as x, b.median as y, a.share, a.n as likes, b.n as dislikes, {'true' if c in number else 'false'} as numeric from
          (select count(*) as n, count(case when {has[c]} then 1 end) / cast(count(*) as double) as share, case when count({v}) < 2 or avg({v}) = 0 then 0 else stddev_pop({v}) / abs(avg({v})) end as spread, quantile_cont({v}, 0.5) as median from l) a,
          (select count(*) as n, case when count({v}) < 2 or avg({v}) = 0 then 0 else stddev_pop({v}) / abs(avg({v})) end as spread, quantile_cont({v}, 0.5) as median from d) b""")
    return f"""l as ({C._TRAIN.format('like')}), d as ({C._TRAIN.format('dislike')}), s as ({' union all '.join(parts)}),
      w as (select criterion, spread * case when likes >= 5 and dislikes >= 2 then case when not numeric then greatest(spread, other, 0.1) when x is null or y is null then 0.1 else abs(x - y) / greatest(abs(x), abs(y), 1) end else 1 end as raw from s where share > 0.5),
      b as (select criterion, raw / sum(raw) over () * 65 + 35.0 / count(*) over () as blended from w where raw > 0)"""


@query(f"with {_weights_sql()} select criterion, cast(floor(blended / sum(blended) over () * 100 * 1000000 + 0.5) as bigint) as weight from b")
def l02_weights(t):
    weights = learning.learn_weights(C._training(t, "like"), C._training(t, "dislike"))
    return rounded(t.spark.createDataFrame(list(weights.items()), "criterion string, weight double"), "weight")


@query("""with i as (select distinct p.id, lower(trim(h.x)) as highlight from publications p, (values (1), (2)) k(i), lateral (select case i when 1 then highlight_a else highlight_b end as x) h where p.is_active and trim(h.x) <> '') select highlight, count(*) as n from i group by 1 having count(*) >= 2""")
def a25_frequent_highlights(t):
    return learning.frequent_highlights(C._with_arrays(t.publications.filter("is_active")))


@query("select id, cast(floor(case when coalesce(list_count(list_filter([highlight_a, highlight_b], lambda x: x is not null)), 0) = 0 then 0.0 else (case when trim(highlight_a) = 'Garage' or trim(highlight_b) = 'Garage' then 1 else 0 end + case when highlight_b = 'Piscine' then 1 else 0 end) / 2.0 end * 1000 + 0.5) as bigint) as ratio from publications")
def u07_highlight_overlap(t):
    preferred = F.array(F.lit("garage"), F.lit("PISCINE "))
    return rounded(C._with_arrays(t.publications).select("id", S.highlight_overlap(F.col("highlights"), preferred).alias("ratio")), "ratio", digits=3)


@query("select id, concat_ws('|', case when image_a is not null then image_a end, case when image_a is null or regexp_replace(image_a, '[?#].*$', '') <> image_b then image_b end, 'https://n.x/1') as urls from publications")
def u10_merged_urls(t):
    have = F.array_compact(F.array("image_a"))
    return t.publications.select("id", F.array_join(S.merged_urls(have, F.array(F.col("image_b"), F.concat("image_b", F.lit("?again")), F.lit("https://n.x/1"))), "|").alias("urls"))


@query("select id, id % 4 = 0 or id % 4 = 1 as same from publications")
def f32_equivalent_descriptions(t):
    base = F.concat(F.lit("Une belle maison de ville au cœur du bourg, numéro "), F.col("id").cast("string"))
    other = F.when(F.col("id") % 4 == 0, F.concat(F.lit(" Une  belle maison de ville au cœur du bourg, numéro\n"), F.col("id").cast("string"))).when(F.col("id") % 4 == 1, F.lit("Une belle maison de ville au cœur du bou…")).when(F.col("id") % 4 == 2, "Autre").otherwise(None)
    return t.publications.select("id", S.descriptions_equivalent(base, other).alias("same"))


@query("select id, case id % 9 when 0 then 5 when 1 then 10 when 2 then 15 when 3 then 20 when 4 then 25 when 5 then 30 when 6 then 45 else 60 end as minutes, case when id % 5 = 0 then 'DPE C' when id % 5 = 1 then 'GES D' when id % 5 = 2 then 'DPE C · GES D' end as label, greatest(0, id % 9 - 2) as low, case when id % 3 = 0 then 'positive' when id % 3 = 1 then 'negative' else 'neutral' end as mood from properties")
def f04_f09_f11_f36_small_functions(t):
    minutes = F.element_at(F.array(*map(F.lit, (4.5, 10.0, 11.0, 19.0, 25.0, 26.0, 31.0, 60.0, 99.0))), (F.col("id") % 9 + 1).cast("int"))
    dpe, ges = F.when(F.col("id") % 5 == 0, "C").when(F.col("id") % 5 == 2, "C"), F.when((F.col("id") % 5).isin(1, 2), "D")
    mood = learning.sentiment(F.when(F.col("id") % 3 == 0, 70.0).when(F.col("id") % 3 == 1, 40.0).otherwise(55.0))
    return t.properties.select("id", S.ceil_travel_minutes(minutes).alias("minutes"), S.energy_label(dpe, ges).alias("label"), S.tolerance_range((F.col("id") % 9).cast("double"), 2)[0].alias("low"), mood.alias("mood"))


@query("select id, case id % 4 when 0 then 150.5 when 1 then 95.0 end as consumption, case id % 4 when 0 then 12.0 when 2 then 7.5 end as emission, case id % 3 when 0 then 2 when 1 then 1 end as bathrooms, case id % 3 when 0 then 'Cave,90 m² au sol' when 1 then 'Cave' end as highlights from publications")
def f10_f18_text_metrics(t):
    text = F.when(F.col("id") % 4 == 0, "CONSOMMATION énergétique : 150,5 kWh / m² ÉMISSIONS : 12 kg").when(F.col("id") % 4 == 1, "95 kWh/m²/an").when(F.col("id") % 4 == 2, "7,5 kg CO₂/m²").otherwise("rien")
    tags = F.when(F.col("id") % 3 == 0, F.array(F.lit("5 pièces"), F.lit(" Cave "), F.lit("2 salles de bains"), F.lit("90 m² au sol"))).when(F.col("id") % 3 == 1, F.array(F.lit("Cave"), F.lit("1 salle d'eau"), F.lit("Terrain de 500 m²")))
    kept = F.filter(S.highlights_from_tags(tags), lambda x: ~x.contains("salle"))
    return t.publications.select("id", S.consumption_from_text(text).alias("consumption"), S.emission_from_text(text).alias("emission"), S.bathrooms_from_tags(tags).alias("bathrooms"), F.array_join(kept, ",").alias("highlights"))


@query("select strftime(date '2024-01-01' + cast(g as int), '%Y-%m-%d') as date, (select count(*) from properties) as active_properties from range(0, 20) r(g) union all select '2023-12-31', 0")
def m18_backfilled_snapshots(t):
    have = t.spark.createDataFrame([("2023-12-31", 0)], "date string, active_properties long")
    row = t.properties.agg(F.count("*").alias("active_properties")).select(F.lit("x").alias("date"), "active_properties")
    return stats.backfill(have, row, "2023-12-31", "2024-01-20")


@query("select property_id, string_agg(id::varchar, ',' order by scraped_at, id) as ids from publications group by 1")
def o14_publications_by_scrape(t):
    rows = search.with_publications(t.publications.select(F.col("property_id").alias("id")).distinct(), t.publications)
    return rows.select(F.col("id").alias("property_id"), F.array_join(F.transform("publications", lambda x: x["id"].cast("string")), ",").alias("ids"))


@query("select id, source as label_of, case source when 'bienici' then 0 when 'seloger' then 1 when 'logicimmo' then 2 else 3 end as rank from publications")
def f39_source_rank(t):
    return t.publications.select("id", F.col("source").alias("label_of"), S.source_rank(F.col("source"), projection.SOURCES).alias("rank"))


# ---------------------------------------------------------------- single scores

_KM = C._km("48.5", "2.5")


@query(f"""select id, cast(floor(1000 * case when price <= 95000 then 100 when price >= 100000 then 0 else 100 * (1 - (price - 95000) / 5000.0) end + 0.5) as bigint) as price,
  cast(floor(1000 * case when surface is null then null when surface < 40 then 50 * surface / 40.0 when surface >= 90 then 100 else 50 + 50 * (surface - 40) / 50.0 end + 0.5) as bigint) as size,
  cast(floor(1000 * case when rooms is null then null when rooms >= 5 then 100 when rooms < 3 then 60 * rooms / 3.0 else 60 + 40 * (rooms - 3) / 2.0 end + 0.5) as bigint) as rooms,
  cast(floor(1000 * case when rooms is null then null when rooms >= 5 then 100 else 60 * rooms / 5.0 end + 0.5) as bigint) as rooms_alone,
  case dpe_class when 'A' then 100 when 'B' then 100 when 'C' then 100 when 'D' then 80 when 'E' then 60 when 'F' then 40 else 20 end as dpe, case when is_new_property is null then 50 when is_new_property then 0 else 100 end as old,
  cast(floor(1000 * case when abs(1955 + id % 60 - 1990) <= 5 then 100 when abs(1955 + id % 60 - 1990) >= 50 then 0 else 100 - (abs(1955 + id % 60 - 1990) - 5) / 45.0 * 100 end + 0.5) as bigint) as year,
  case id % 3 when 0 then 75 when 1 then 0 else 100 end as renovation, case id % 4 when 0 then 100 when 1 then 80 when 2 then 0 end as heating,
  cast(floor(1000 * case when latitude is null then null when {_KM} >= 40 then 0 else greatest(0, least(100, 100 * (1 - {_KM} / 40))) end + 0.5) as bigint) as distance from properties""")
def f35_single_scores(t):
    c, lit = F.col, F.lit
    condition = F.when(c("id") % 3 == 1, "Travaux à PRÉVOIR").when(c("id") % 3 == 2, "Bon état")
    heating = F.when(c("id") % 4 == 0, " GAZ ").when(c("id") % 4 == 1, "gaz de ville").when(c("id") % 4 == 2, "bois")
    km = S.haversine_km(lit(48.5), lit(2.5), c("latitude"), c("longitude"))
    rows = t.properties.select(
        "id", L.price_score(c("price"), lit(95000), lit(100000)).alias("price"), L.size_score(c("surface"), lit(40), lit(90)).alias("size"), L.rooms_score(c("rooms"), lit(3), lit(5)).alias("rooms"),
        L.rooms_score(c("rooms"), lit(None).cast("int"), lit(5)).alias("rooms_alone"), L.class_score(c("dpe_class"), lit("C")).cast("int").alias("dpe"), L.old_build_score(c("is_new_property"), lit(True)).cast("int").alias("old"),
        L.year_score(c("id") % 60 + 1955, lit(1990)).alias("year"), L.renovation_score(condition, lit(True)).cast("int").alias("renovation"), L.text_score(heating, lit("Gaz")).cast("int").alias("heating"), L.distance_score(km, lit(40)).alias("distance"),
    )
    return rounded(rows, "price", "size", "rooms", "rooms_alone", "year", "distance", digits=3)


_NUMBERS = {"price": 2.0, "surface": 1.5, "land_surface": 1.5, "rooms": 1.0, "bedrooms": 1.0}


def _likeness_sql() -> str:
    parts = [(C._similar_sql(n), w) for n, w in _NUMBERS.items()] + [(C._similar_sql("distance"), 2.0), (C._similar_sql("dpe"), 1.0), ("case when p.is_new_property = t.is_new_property then 1 end", 1.0)]
    gained = " + ".join(f"coalesce(({v}) * cast({w} as double), 0)" for v, w in parts)
    total = " + ".join(f"case when ({v}) is null then 0 else cast({w} as double) end" for v, w in parts)
    return f"({gained}) / nullif({total}, 0)"


@query(f"with d as ({C._TRAIN.format('dislike')}) select p.id, cast(floor(max({_likeness_sql()}) * 40 * 1000 + 0.5) as bigint) as penalty from properties p cross join d t group by p.id")
def f35_dislike_penalties(t):
    none = {"bathrooms": F.lit(None).cast("int"), "parking_spaces": F.lit(None).cast("int"), "construction_year": F.lit(None).cast("int"), "highlights": F.lit(None).cast("array<string>")}
    return rounded(learning.dislike_penalties(t.properties.withColumns(none), C._training(t, "dislike").withColumns(none)), "penalty", digits=3)


# ---------------------------------------------------------------- models


def _calibration_sql() -> str:
    """Each training row judged by the others, then the limits of the tiers."""
    def side(own: str, other: str, how: str) -> str:
        values = ", ".join(f"{how}({C._similar_sql(c)}) as v_{c}" for c in C.WEIGHTS)
        return f"select p.id, {values} from {own} p join {other} t on p.id <> t.id group by p.id"

    one = lambda c: f"greatest(0, least(100, 100 * case when d.v_{c} is null then m.v_{c} else greatest(0, m.v_{c} - d.v_{c} * 0.5) end))"
    gained = " + ".join(f"case when m.v_{c} is null then 0 else {one(c)} * {w} end" for c, w in C.WEIGHTS.items())
    total = " + ".join(f"case when m.v_{c} is null then 0 else {w} end" for c, w in C.WEIGHTS.items())
    judged = lambda own: f"select m.id, ({gained}) / cast(nullif({total}, 0) as double) as score from ({side(own, 'likes', 'avg')}) m left join ({side(own, 'dislikes', 'max')}) d using (id)"
    return f"""ls as ({judged('likes')}), ds as ({judged('dislikes')}), q as (select count(score) as n, quantile_cont(score, 0.75) as p75, quantile_cont(score, 0.5) as p50, min(score) as least from ls), r as (select count(score) as dn, quantile_cont(score, 0.25) as d25, quantile_cont(score, 0.5) as d50 from ds),
      k as (select *, case when n >= 5 then p75 else p50 end as top, case when dn >= 3 then d25 when dn > 0 then d50 else least * 0.85 end as low from q cross join r where n > 0)"""


@query(f"with {C._scores_sql()}, {_calibration_sql()} select cast(floor(low * 10000 + 0.5) as bigint) as score_min, cast(floor(top * 10000 + 0.5) as bigint) as score_max, top - low >= 10 or (n >= 3 and dn >= 2) as strong, n as likes, dn as dislikes from k")
def l04_w11_calibration(t):
    likes, dislikes = C._training(t, "like"), C._training(t, "dislike")
    limits = learning.calibrate(learning.leave_one_out(likes, likes, dislikes, C.WEIGHTS), learning.leave_one_out(dislikes, likes, dislikes, C.WEIGHTS))
    return rounded(limits.select("score_min", "score_max", "strong", "likes", "dislikes"), "score_min", "score_max", digits=4)


@query(f"""with {C._scores_sql()}, {_calibration_sql()}, z as (select s.id, score, top, low, n, dn, p75, p50, d50, case when top - low <= 0 then 50 else (score - low) / (top - low) * 100 end as share from s cross join k)
  select id, case when (top - low >= 10) then case when share >= 75 then 'strong' when share >= 50 then 'good' when share >= 25 then 'moderate' else 'weak' end when n >= 3 and dn >= 2 then case when score >= p75 then 'strong' when score >= p50 then 'good' when score >= d50 then 'moderate' else 'weak' end end as tier from z""")
def l05_tiers(t):
    likes, dislikes = C._training(t, "like"), C._training(t, "dislike")
    limits = learning.calibrate(learning.leave_one_out(likes, likes, dislikes, C.WEIGHTS), learning.leave_one_out(dislikes, likes, dislikes, C.WEIGHTS))
    scored = learning.score(t.properties, likes, dislikes, C.WEIGHTS).select("id", "score")
    return scored.crossJoin(F.broadcast(limits)).select("id", learning.tier(F.col("score")).alias("tier"))


@query(f"""with {C._scores_sql()}, {_calibration_sql()}, rk as (select id, row_number() over (order by round(coalesce(score, 0), 9) desc, id) as rank, count(*) over () as rank_total from s),
  z as (select s.id, score, top, low, n, dn, p75, p50, d50, case when top - low <= 0 then 50 else (score - low) / (top - low) * 100 end as share, case when n < 3 or (not (top - low >= 10 or (n >= 3 and dn >= 2)) and dn < 2) then 'scoring' when n >= 5 then 'full' else 'tier' end as readiness from s cross join k where score is not null)
  select z.id, readiness, case when readiness = 'scoring' then null when (top - low >= 10) then case when share >= 75 then 'strong' when share >= 50 then 'good' when share >= 25 then 'moderate' else 'weak' end when n >= 3 and dn >= 2 then case when score >= p75 then 'strong' when score >= p50 then 'good' when score >= d50 then 'moderate' else 'weak' end end as tier,
    case when readiness = 'full' then rank end as rank, case when readiness = 'full' then rank_total end as rank_total from z join rk using (id)""")
def l06_l07_cards(t):
    likes, dislikes = C._training(t, "like"), C._training(t, "dislike")
    limits = learning.calibrate(learning.leave_one_out(likes, likes, dislikes, C.WEIGHTS), learning.leave_one_out(dislikes, likes, dislikes, C.WEIGHTS))
    scored = stored(learning.score(t.properties, likes, dislikes, C.WEIGHTS).select("id", "score"), "scores")  # ranked and shown: scored once
    return learning.cards(scored, limits, learning.rank_all(scored.withColumn("score", F.round("score", 9))))


# ---------------------------------------------------------------- backfills


@query("""with r as (select user_id as property_id, case event_type when 'purchase' then 'like' else 'dislike' end as type, ts, rank() over (partition by user_id order by ts desc) as k from events where event_type in ('purchase', 'error')) select property_id, type from r where k = 1""")
def j12_latest_reactions(t):
    log = t.events.filter("event_type in ('purchase', 'error')").select(F.col("user_id").alias("property_id"), F.when(F.col("event_type") == "purchase", "like").otherwise("dislike").alias("type"), "ts")
    return reactions.latest(log)


@query("select u.id, coalesce(u.rooms, p.rooms) as rooms, coalesce(u.surface, p.surface) as surface from publications u join properties p on p.id = u.property_id")
def j13_filled_from_property(t):
    return projection.filled(t.publications, t.properties, ("rooms", "surface")).select("id", "rooms", "surface")


@query("select id, coalesce(case when id % 3 > 0 then first_price end, price) as first_price, coalesce(case when id % 3 > 0 then first_price end, price) > price as has_price_drop from properties")
def m19_backfilled_prices(t):
    return projection.with_first_price(t.properties.withColumn("first_price", F.when(F.col("id") % 3 > 0, F.col("first_price")))).select("id", "first_price", "has_price_drop")


@query("select source, count(*) as found, count(*) filter (id % 10 = 0) as invalid from publications group by 1")
def u01_s20_a31_run_counts(t):
    from foyer.sources.connectors import run_counts

    return run_counts(t.publications.withColumns({"price": F.when(F.col("id") % 10 > 0, F.col("price")), "scraped_at": F.col("scraped_at").cast("timestamp")}))


# ---------------------------------------------------------------- texts and urls


@query(f"""with s as (select property_id, string_agg(label, ', ' order by r) as sources from (select distinct property_id, {C.RANK} as r, case source when 'bienici' then 'Bien''ici' when 'seloger' then 'SeLoger' when 'logicimmo' then 'Logic-Immo' else 'LeBonCoin' end as label from publications where is_active) group by 1),
  u as (select property_id, first(url {C._FIRST}) as url from publications where is_active group by 1), page as (select * from properties order by price, id limit 100)
  select id, concat_ws(chr(10), {C._label('price')} || ' · ' || city || ' (' || postal_code || ')', nullif(concat_ws(' · ', case when surface > 0 then cast(surface as int) || ' m²' end, case when land_surface > 0 then 'terrain ' || cast(land_surface as int) || ' m²' end, rooms || ' pièces', bedrooms || ' ch.'), ''),
    'DPE DPE ' || dpe_class || ' · GES ' || ges_class, case when price < first_price then 'Baisse : ' || {C._label('first_price')} || ' → ' || {C._label('price')} || ' (−' || {C._label('(first_price - price)')} || ', −' || cast(floor((first_price - price) * 100.0 / first_price + 0.5) as int) || ' %)' end,
    coalesce(sources, 'Annonces retirées'), url) as message from page left join s on s.property_id = id left join u on u.property_id = id""")
def f38_s25_notices(t):
    page = t.properties.orderBy("price", "id").limit(100)
    none = t.properties.limit(0).select("id", F.lit(1.0).alias("score"), F.col("id").alias("rank"), F.lit(9).alias("rank_total"))
    return serialize.listing_rows(page, t.publications, C._reactions(t), none).select("id", X.notice(price_drop=True).alias("message"))


@query("""select id, 'https://www.seloger.com/immobilier/achat/immo-l-isle-d-ete-' || id % 7 || '-' || case when id % 3 = 0 then '2A' else '75' end || '/bien-maison/' || case when id % 4 > 1 then '?LISTING-LISTpg=' || id % 4 else '' end as city_page,
  'https://www.seloger.com/classified-search?distributionTypes=Buy&estateTypes=House&locations=AD08FR75' || case when id % 2 = 0 then '&priceMax=' || price else '' end || case when surface is not null then '&spaceMin=' || cast(surface as int) else '' end || coalesce('&numberOfRoomsMin=' || rooms, '') || case when not is_new_property then '&projectTypes=Resale' else '' end || case when id % 4 > 1 then '&page=' || id % 4 else '' end as search,
  'https://www.leboncoin.fr/recherche?category=9&real_estate_type=1' || case when id % 3 = 0 then '&locations=d_75' else '&text=' || replace(replace(city, '#', '%23'), ' ', '+') end || case when id % 2 = 0 then '&price=0-' || price else '' end || case when surface is not null then '&square=' || cast(surface as int) || '-max' else '' end || coalesce('&rooms=' || rooms || '-max', '') || case when not is_new_property then '&immo_sell_type=old' else '' end || case when id % 4 > 1 then '&page=' || id % 4 else '' end as leboncoin from properties""")
def f28_f29_search_urls(t):
    c, none = F.col, F.lit(None).cast("int")
    page = (c("id") % 4).cast("int")
    asked = t.properties.withColumns({"max_price": F.when(c("id") % 2 == 0, c("price")), "min_surface": c("surface"), "min_land_surface": none, "min_rooms": c("rooms"), "min_bedrooms": none, "old_only": ~c("is_new_property")})
    name, code = F.concat(F.lit("L Isle d’Été "), (c("id") % 7).cast("string")), F.when(c("id") % 3 == 0, "AD08FR2A004").otherwise("ad08fr75056")
    return asked.select("id", X.city_page_url("https://www.seloger.com", F.replace(name, F.lit("d’É"), F.lit("d É")), code, page).alias("city_page"), X.classified_search_url("https://www.seloger.com", F.lit("AD08FR75"), page).alias("search"), X.leboncoin_search_url(F.when(c("id") % 3 == 0, "d_75"), c("city"), page).alias("leboncoin"))


@query("select id, 'P' || id as place, price as radius from properties")
def f28_locations_there_and_back(t):
    coded = t.properties.select("id", X.encoded_location(F.struct(F.concat(F.lit("P"), F.col("id").cast("string")).alias("placeId"), F.col("price").alias("radius"), F.lit("é?>~").alias("x"))).alias("coded"))
    return coded.filter(~F.col("coded").rlike("[+/=]")).withColumn("d", X.decoded_location(F.col("coded"), "placeId string, radius long, x string")).filter("d.x = 'é?>~'").select("id", F.col("d.placeId").alias("place"), F.col("d.radius").alias("radius"))
