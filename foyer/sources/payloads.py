"""Payloads of the portals as listings: one function for each source, over columns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.functions import portal as P
from foyer.functions.scalars import consumption_from_text, emission_from_text, energy_class, half_up, merged_highlights, positive, positive_int, sane_year, some
from foyer.schemas import listing_schema

_PLACE = "struct<lat:double,lon:double>"
# The fields of the portals' payloads.
BIENICI_AD = (
    "id string, title string, price long, surfaceArea double, landSurfaceArea double, gardenSurfaceArea double, roomsQuantity int, bedroomsQuantity int, newProperty boolean, "
    f"blurInfo struct<position:{_PLACE},centroid:{_PLACE}>, city string, postalCode string, description string, photos array<struct<url_photo:string>>, propertyType string, "
    "energyClassification string, greenhouseGazClassification string, energyConsumption double, greenhouseGazConsumption double, url string, bathroomsQuantity int, showerRoomsQuantity int, "
    "yearOfConstruction double, heating string, exposition string, parkingPlacesQuantity int, hasGarden boolean, hasCellar boolean, hasPool boolean, hasAirConditioning boolean, terracesQuantity int, workToDo boolean"
)
LEBONCOIN_AD = (
    "list_id long, subject string, body string, price array<long>, url string, attributes array<struct<key:string,value:string,value_label:string>>, "
    "location struct<lat:double,lng:double,city:string,zipcode:string>, images struct<urls_large:array<string>,urls:array<string>,thumb_url:string>"
)
_PAIR = "struct<lat:double,lng:double,latitude:double,longitude:double>"
_CLASSIFIED = (
    "id:string,url:string,energyClass:string,gesClass:string,metadata:struct<legacyId:string>,mainDescription:struct<description:string>,"
    "hardFacts:struct<title:string,keyfacts:array<string>,price:struct<formatted:string>>,rawData:struct<propertyTypeLabel:string,price:double,surface:struct<main:double>,nbroom:int,nbbedroom:int,latitude:double,longitude:double>,"
    f"tags:struct<isNew:boolean>,location:struct<address:struct<city:string,zipCode:string>,coordinates:{_PAIR},geo:{_PAIR}>,gallery:struct<images:array<struct<url:string>>,reorderedImages:array<struct<url:string>>>"
)
_CARD = (
    "id:string,cardType:string,title:string,estateType:string,pricing:struct<rawPrice:string>,surface:double,rooms:int,bedroomCount:int,isNew:boolean,cityLabel:string,zipCode:string,description:string,"
    "photos:array<string>,gallery:struct<images:array<struct<url:string>>,reorderedImages:array<struct<url:string>>>,pictureUrl:string,imageUrl:string,classifiedURL:string,tags:array<string>,energyClass:string,gesClass:string,landSurface:double,latitude:double,longitude:double"
)
_SEARCH = f"cards struct<list:array<struct<{_CARD}>>>, navigation struct<counts:struct<count:long>,pagination:struct<resultsPerPage:int>>"
_FETCHER = (
    f"data struct<`classified-serp-init-data`:struct<pageProps:struct<totalCount:long,classifieds:array<string>,classifiedsData:map<string,struct<{_CLASSIFIED}>>>>,"
    f"`classified-detail-init-data`:struct<pageProps:struct<classifiedData:struct<{_CLASSIFIED}>>>>"
)
#: Base urls of the portals that share one page format, for urls and pictures that are relative.
PORTALS = {"seloger": ("https://www.seloger.com", "https://mms.seloger.com"), "logicimmo": ("https://www.logic-immo.com", "https://mms.logic-immo.com")}


def _listing(rows: DataFrame, values: dict[str, Column], *more: str) -> DataFrame:
    """rows as listings; fields that a payload doesn't have are null."""
    columns = [F.coalesce(values[f.name].cast(f.dataType)).alias(f.name) if f.name in values else F.lit(None).cast(f.dataType).alias(f.name) for f in listing_schema()]
    return rows.select(*more, *columns)


def _time(at: str | Column) -> Column:
    return F.lit(at) if isinstance(at, str) else at


def _urls(urls: Column) -> dict[str, Column]:
    """image_urls without blanks, null if none, and the first as image_url."""
    kept = F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u != "")
    return {"image_urls": some(kept), "image_url": F.get(kept, F.lit(0))}


def _plural(n: Column, one: str, many: str) -> Column:
    return F.when(n == 1, one).when(n > 1, F.concat(n.cast("string"), F.lit(f" {many}")))


def _bienici_fields(f) -> dict[str, Column]:
    at = F.coalesce(f("blurInfo")["position"], f("blurInfo")["centroid"])
    flags = [F.when(f(n), label) for n, label in (("hasGarden", "Garden"), ("hasCellar", "Cellar"), ("hasPool", "Pool"), ("hasAirConditioning", "Air conditioning"))]
    counted = [_plural(f("terracesQuantity"), "Terrace", "terraces"), _plural(f("showerRoomsQuantity"), "Shower room", "shower rooms")]
    return {
        "description": f("description"),
        "latitude": at["lat"],
        "longitude": at["lon"],
        "dpe_class": energy_class(f("energyClassification")),
        "ges_class": energy_class(f("greenhouseGazClassification")),
        "dpe_consumption_kwh_m2": F.coalesce(f("energyConsumption"), consumption_from_text(f("description"))),
        "ges_emission_kg_m2": F.coalesce(f("greenhouseGazConsumption"), emission_from_text(f("description"))),
        "bathrooms": half_up(positive(f("bathroomsQuantity"))),
        "construction_year": sane_year(f("yearOfConstruction")),
        "heating": f("heating"),
        "orientation": f("exposition"),
        "property_condition": F.when(f("workToDo"), "Work required"),
        "parking_spaces": f("parkingPlacesQuantity"),
        "highlights": merged_highlights(F.array(F.array_compact(F.array(*flags, *counted)))),
    } | _urls(F.transform(f("photos"), lambda p: p["url_photo"]))


def bienici_listings(ads: DataFrame, scraped_at: str | Column, fallback_city: str) -> DataFrame:
    """Listings of portal A's ads (BIENICI_AD)."""
    f = F.col
    title = F.trim("title")
    return _listing(ads, _bienici_fields(f) | {
        "external_id": f("id"), "source": F.lit("bienici"),
        "title": F.when(title != "", title).otherwise(F.coalesce(F.trim("propertyType"), F.lit("Property listing"))),
        "price": f("price"), "surface": positive(f("surfaceArea")), "land_surface": positive(F.coalesce("landSurfaceArea", "gardenSurfaceArea")),
        "rooms": positive(f("roomsQuantity")), "bedrooms": positive(f("bedroomsQuantity")), "is_new_property": f("newProperty"),
        "city": F.coalesce(F.nullif(F.trim("city"), F.lit("")), F.lit(fallback_city)), "postal_code": f("postalCode"),
        "url": F.coalesce("url", F.concat(F.lit("https://www.bienici.com/annonce/"), "id")), "property_type": f("propertyType"), "scraped_at": _time(scraped_at),
    })


def bienici_patches(ads: DataFrame) -> DataFrame:
    """external_id and the fields that portal A's ads can enrich; numbers as they are."""
    f = F.col
    more = {"surface": f("surfaceArea"), "land_surface": F.coalesce("landSurfaceArea", "gardenSurfaceArea"), "rooms": f("roomsQuantity"), "bedrooms": f("bedroomsQuantity")}
    return ads.select(F.col("id").alias("external_id"), *(c.alias(n) for n, c in (_bienici_fields(f) | more).items()))


def attribute(attributes: Column, key: str, label: bool = False) -> Column:
    """The value (or label, else value) of the first attribute of a key."""
    one = F.get(attributes, (F.array_position(attributes["key"], F.lit(key)) - 1).cast("int"))
    if not label:
        return one["value"]
    return F.coalesce(F.nullif(F.trim(one["value_label"]), F.lit("")), F.nullif(F.trim(one["value"]), F.lit("")))


def _leboncoin_fields(f) -> dict[str, Column]:
    own = f("attributes")
    number = lambda *keys: F.coalesce(*(attribute(own, k).try_cast("double") for k in keys))
    parts = F.filter(F.transform(F.split(attribute(own, "specificities", True), r",\s*"), lambda p: F.trim(p)), lambda p: p != "")
    lift = attribute(own, "elevator", True)
    more = F.array_compact(F.array(attribute(own, "outside_access", True), F.when(~lift.rlike("(?i)^non$"), "Ascenseur")))
    images = f("images")
    filled = lambda urls: F.filter(F.transform(urls, lambda u: F.trim(u)), lambda u: u != "")
    thumb = F.nullif(F.trim(images["thumb_url"]), F.lit(""))
    urls = F.when(F.size(filled(images["urls_large"])) > 0, images["urls_large"]).when(F.size(filled(images["urls"])) > 0, images["urls"]).when(thumb.isNotNull(), F.array(thumb))
    return {
        "description": f("body"),
        **{n: positive(number(k)) for n, k in (("surface", "square"), ("land_surface", "land_plot_surface"), ("rooms", "rooms"), ("bedrooms", "bedrooms"))},
        "latitude": f("location")["lat"],
        "longitude": f("location")["lng"],
        "dpe_class": energy_class(attribute(own, "energy_rate")),
        "ges_class": energy_class(attribute(own, "ges")),
        "dpe_consumption_kwh_m2": F.coalesce(number("energy_consumption", "dpe_consumption"), consumption_from_text(f("body"))),
        "ges_emission_kg_m2": F.coalesce(number("ges_emission", "ghg_emission"), emission_from_text(f("body"))),
        "bathrooms": half_up(positive(number("nb_bathrooms", "bathrooms"))),
        "construction_year": sane_year(positive_int(attribute(own, "building_year"))),
        "heating": attribute(own, "heating", True),
        "orientation": attribute(own, "orientation", True),
        "property_condition": attribute(own, "global_condition", True),
        "parking_spaces": positive_int(attribute(own, "nb_parkings")),
        "highlights": merged_highlights(F.array(parts, more)),
    } | _urls(urls)


def leboncoin_listings(ads: DataFrame, scraped_at: str | Column, fallback_city: str) -> DataFrame:
    """Listings of portal B's ads (LEBONCOIN_AD)."""
    f = F.col
    sold, kind = attribute(f("attributes"), "immo_sell_type"), F.get("attributes", (F.array_position(F.col("attributes")["key"], F.lit("real_estate_type")) - 1).cast("int"))
    return _listing(ads, _leboncoin_fields(f) | {
        "external_id": f("list_id"), "source": F.lit("leboncoin"), "title": f("subject"), "price": F.coalesce(F.get("price", F.lit(0)), F.lit(0)),
        "is_new_property": F.when(sold == "new", True).when(sold == "old", False), "city": F.coalesce(F.nullif(f("location")["city"], F.lit("")), F.lit(fallback_city)),
        "postal_code": f("location")["zipcode"], "url": f("url"), "property_type": F.coalesce(kind["value_label"], kind["value"]), "scraped_at": _time(scraped_at),
    })


def leboncoin_patches(ads: DataFrame) -> DataFrame:
    return ads.select(F.col("list_id").cast("string").alias("external_id"), *(c.alias(n) for n, c in _leboncoin_fields(F.col).items()))


def leboncoin_search(responses: DataFrame, text: str = "body") -> DataFrame:
    """The ads of portal B's search responses, JSON texts with a list of ads."""
    return responses.select(F.explode_outer(F.from_json(text, _ads_schema())["ads"]).alias("ad")).filter("ad is not null").select("ad.*")  # outer: see search_cards


def _ads_schema() -> str:
    """LEBONCOIN_AD as the items of an array."""
    depth, parts, start = 0, [], 0
    for k, c in enumerate(LEBONCOIN_AD):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            parts.append(LEBONCOIN_AD[start:k])
            start = k + 1
    parts.append(LEBONCOIN_AD[start:])
    return f"ads array<struct<{','.join(p.strip().replace(' ', ':', 1) for p in parts)}>>"


def leboncoin_detail(pages: DataFrame, html: str = "html") -> tuple[DataFrame, DataFrame]:
    """(pages with portal B's ad columns, pages without an ad and their reason)."""
    item = _ads_schema().removeprefix("ads array<").removesuffix(">")
    ad = F.from_json(P.next_data(F.col(html)), f"props struct<pageProps:struct<ad:{item}>>")["props"]["pageProps"]["ad"]
    parsed = pages.select("*", F.explode_outer(F.array(ad)).alias("ad"))  # outer: see search_cards; a filter would parse each page again
    own = [c for c in pages.columns if c != "url"]  # an ad has its own
    return parsed.filter("ad is not null").select(*own, "ad.*"), parsed.filter("ad is null").drop("ad").withColumn("reason", P.next_data_failure(F.col(html)))


def _photos(gallery: Column) -> Column:
    urls = F.transform(F.coalesce(gallery["reorderedImages"], gallery["images"]), lambda i: i["url"])
    return F.filter(urls, lambda u: F.coalesce(u != "", F.lit(False)))


def _data_point(data: Column) -> Column:
    """Coordinates of a classified's location, else of its raw data; not turned around."""
    pairs = [data["location"]["coordinates"], data["location"]["geo"], data["rawData"]]
    both = [(F.coalesce(p["lat"], p["latitude"]), F.coalesce(p["lng"], p["longitude"])) for p in pairs[:2]] + [(pairs[2]["latitude"], pairs[2]["longitude"])]
    return F.coalesce(*(F.when(P.in_france(a, b), F.struct(a.alias("lat"), b.alias("lng"))) for a, b in both))


_CARD_FIELDS = ("id", "title", "estate_type", "raw_price", "surface", "rooms", "bedrooms", "is_new", "city", "zip", "description", "photos", "path", "tags", "dpe", "ges", "land", "lat", "lng")


def _card_of_data(d: Column) -> Column:
    """A card from a classified's data."""
    at, facts = _data_point(d), d["hardFacts"]
    values = (
        F.coalesce(d["metadata"]["legacyId"], d["id"]), facts["title"], d["rawData"]["propertyTypeLabel"], d["rawData"]["price"].cast("string"), d["rawData"]["surface"]["main"], d["rawData"]["nbroom"], d["rawData"]["nbbedroom"],
        d["tags"]["isNew"], d["location"]["address"]["city"], d["location"]["address"]["zipCode"], d["mainDescription"]["description"], _photos(d["gallery"]), d["url"], facts["keyfacts"], d["energyClass"], d["gesClass"], F.lit(None).cast("double"), at["lat"], at["lng"],
    )
    return F.struct(*(v.alias(n) for n, v in zip(_CARD_FIELDS, values)))


def _card_of_search(c: Column) -> Column:
    """A card from a search's list."""
    photos = F.when(F.size(c["photos"]) > 0, c["photos"]).when(F.size(_photos(c["gallery"])) > 0, _photos(c["gallery"])).otherwise(F.filter(F.array(F.coalesce(c["pictureUrl"], c["imageUrl"])), lambda u: u.isNotNull()))
    values = (c["id"], c["title"], c["estateType"], c["pricing"]["rawPrice"], c["surface"], c["rooms"], c["bedroomCount"], c["isNew"], c["cityLabel"], c["zipCode"], c["description"], photos, c["classifiedURL"], c["tags"], c["energyClass"], c["gesClass"], c["landSurface"], c["latitude"], c["longitude"])
    return F.struct(*(v.alias(n) for n, v in zip(_CARD_FIELDS, values)))


def card_text(card: str = "card") -> Column:
    c = F.col(card)
    return F.concat_ws("\n", F.nullif(c["description"], F.lit("")), c["tags"])


def enriched_card(card: str = "card", text: Column | None = None, both: Column | None = None) -> Column:
    """A card with what its text tells where it has no value itself: classes, metrics, land.

    text, both: card_text() and its both_classes(), where they are columns already.
    """
    c = F.col(card)
    text = card_text(card) if text is None else text
    dpe, ges = P.energy_classes(text, both)
    new = {"dpe": F.coalesce(c["dpe"], dpe), "ges": F.coalesce(c["ges"], ges), "land": F.coalesce(c["land"], P.land_surface(text))}
    more = {"consumption": consumption_from_text(text), "emission": emission_from_text(text)}
    return F.struct(*((new.get(n, c[n])).alias(n) for n in _CARD_FIELDS), *(v.alias(n) for n, v in more.items()))


def search_cards(pages: DataFrame, html: str = "html") -> DataFrame:
    """The cards of portal C's and D's search pages, a row each: pages' columns, at (place on the page), total, card.

    A page carries them as the search's answer, or as ids and a map of classifieds.
    The explode is an outer one: from a plain one Spark infers a filter on the size of the
    list and writes all that the list is made of into it, so every page would be parsed
    once more for each use of its JSON.
    """
    answer = F.from_json(P.window_json(F.col(html), "initialData"), _SEARCH)
    fetched = F.from_json(P.window_json(F.col(html), "__UFRN_FETCHER__"), _FETCHER)["data"]["classified-serp-init-data"]["pageProps"]
    parsed = pages.withColumn("_a", answer).withColumn("_f", F.when(F.col("_a").isNull(), fetched))
    listed = F.transform(F.filter(F.col("_a")["cards"]["list"], lambda c: c["cardType"] == "classified"), _card_of_search)
    named = F.transform(F.filter(F.transform(F.col("_f")["classifieds"], lambda i: F.try_element_at(F.col("_f")["classifiedsData"], i)), lambda d: d.isNotNull()), _card_of_data)
    cards = F.filter(F.coalesce(listed, named), lambda c: F.coalesce(c["id"] != "", F.lit(False)))
    total = F.coalesce(F.col("_a")["navigation"]["counts"]["count"], F.col("_f")["totalCount"], F.size("_cards").cast("long"))
    out = parsed.withColumn("_cards", cards).withColumn("total", total)
    each = out.select(*pages.columns, "total", F.posexplode_outer("_cards").alias("at", "card")).filter("card is not null")
    # a card's text is read in several ways, so it is made once
    each = each.withColumn("_text", card_text()).withColumn("_both", P.both_classes(F.col("_text")))
    return each.withColumn("card", enriched_card(text=F.col("_text"), both=F.col("_both"))).drop("_text", "_both")


def _absolute(base: Column, path: Column) -> Column:
    return F.when(path.startswith("http"), path).otherwise(F.concat(base, F.when(path.startswith("/"), path).otherwise(F.concat(F.lit("/"), path))))


def classified_listings(cards: DataFrame, source: str, scraped_at: str | Column, fallback_city: str) -> DataFrame:
    """Listings of the cards of portal C or D; a card without a place, title or price keeps it empty."""
    c, (base, media) = F.col("card"), PORTALS[source]
    urls = F.transform(F.filter(c["photos"], lambda u: F.coalesce(u != "", F.lit(False))), lambda u: _absolute(F.lit(media), u))
    path = c["path"]
    url = F.when(path.startswith("http"), path).when(path != "", F.concat(F.lit(base), path)).otherwise(F.concat(F.lit(f"{base}/annonces/achat/maison/"), c["id"], F.lit(".htm")))
    return _listing(cards, P.tag_extras(c["description"], c["tags"]) | _urls(urls) | {
        "external_id": c["id"], "source": F.lit(source), "title": c["title"], "price": F.coalesce(c["raw_price"].try_cast("double"), F.lit(0)), "surface": positive(c["surface"]), "land_surface": positive(c["land"]),
        "rooms": F.coalesce(c["rooms"], P.rooms_from_tags(c["tags"])), "bedrooms": F.coalesce(c["bedrooms"], P.bedrooms_from_tags(c["tags"])), "is_new_property": c["is_new"], "latitude": c["lat"], "longitude": c["lng"],
        "city": F.coalesce(F.nullif(c["city"], F.lit("")), F.lit(fallback_city)), "postal_code": c["zip"], "url": url, "description": c["description"], "property_type": c["estate_type"],
        "dpe_class": energy_class(c["dpe"]), "ges_class": energy_class(c["ges"]), "dpe_consumption_kwh_m2": c["consumption"], "ges_emission_kg_m2": c["emission"], "scraped_at": _time(scraped_at),
    })


def detail_pages(pages: DataFrame, html: str = "html") -> DataFrame:
    """pages with the fields that portal C's and D's detail pages can enrich, from their payload, their text and their head."""
    page = F.col(html)
    payload = F.coalesce(F.from_json(P.window_json(page, "__UFRN_FETCHER__"), _FETCHER)["data"]["classified-detail-init-data"]["pageProps"]["classifiedData"], F.from_json(P.window_json(page, "initialData"), f"classified struct<{_CLASSIFIED}>")["classified"])
    read = pages.withColumns({"_d": payload, "_bare": P.bare(page)}).withColumn("card", F.when(F.coalesce(F.col("_d")["metadata"]["legacyId"], F.col("_d")["id"]).isNotNull(), _card_of_data(F.col("_d")))).withColumn("card", F.when(F.col("card").isNotNull(), enriched_card()))
    c, d = F.col("card"), F.col("_d")
    text = F.concat_ws("\n", F.nullif(c["description"], F.lit("")), c["tags"], page)
    own = F.col("_bare")
    gallery = _urls(_photos(d["gallery"]))
    # what is used more than once is a column of its own
    read = read.withColumns({"_at": F.coalesce(_data_point(d), P.page_point(page, own)), "_image": F.coalesce(gallery["image_url"], P.og_image(page))})
    at, image = F.col("_at"), F.col("_image")
    extras = {n: F.when(c.isNotNull(), v) for n, v in P.tag_extras(c["description"], c["tags"]).items()}
    values = P.page_energy(page, own) | extras | {
        "description": P.longest(F.array(c["description"], P.page_description(page, own))), "surface": c["surface"], "land_surface": P.land_surface(text), "latitude": at["lat"], "longitude": at["lng"],
        "rooms": F.coalesce(c["rooms"], P.rooms_from_tags(c["tags"])), "bedrooms": F.coalesce(c["bedrooms"], P.bedrooms_from_tags(c["tags"])),
        "image_url": image, "image_urls": F.coalesce(gallery["image_urls"], F.when(image.isNotNull(), F.array(image))),
        "construction_year": F.coalesce(extras["construction_year"], P.year_from_text(text)),
    }
    return read.select(*pages.columns, *(v.alias(n) for n, v in values.items()))


def filtered_cards(cards: DataFrame, min_price: float | None = None, max_price: float | None = None, min_surface: float | None = None, min_land: float | None = None, min_rooms: int | None = None, min_bedrooms: int | None = None, new: bool | None = None, postal_code: str | None = None) -> DataFrame:
    """Cards that meet what a search asked; a value that a card doesn't have meets it, but for the postal code, which must be there."""
    c = F.col("card")
    price = F.nullif(F.coalesce(c["raw_price"].try_cast("double"), F.lit(0.0)), F.lit(0.0))
    rooms, bedrooms = F.coalesce(c["rooms"], P.rooms_from_tags(c["tags"])), F.coalesce(c["bedrooms"], P.bedrooms_from_tags(c["tags"]))
    asked = [(min_price, lambda v: price >= v), (max_price, lambda v: price <= v), (min_surface, lambda v: c["surface"] >= v), (min_land, lambda v: c["land"] >= v), (min_rooms, lambda v: rooms >= v), (min_bedrooms, lambda v: bedrooms >= v), (new, lambda v: c["is_new"] == v)]
    for value, condition in asked:
        if value is not None:
            cards = cards.filter(F.coalesce(condition(value), F.lit(True)))
    return cards if postal_code is None else cards.filter(c["zip"] == postal_code)
