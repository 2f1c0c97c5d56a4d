"""Texts and urls made of columns: notices, and the portals' search pages."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from foyer.functions.scalars import drop_percent, energy_label, euros, unaccent

# How sources are named, and what a property without ads is called.
SOURCE_LABELS = {"bienici": "Bien'ici", "seloger": "SeLoger", "logicimmo": "Logic-Immo", "leboncoin": "LeBonCoin"}
WITHDRAWN = "Annonces retirées"


def plain_number(value: Column) -> Column:
    """A number without a decimal part if that is zero."""
    return F.regexp_replace(value.cast("string"), r"\.0$", "")


def source_label(source: Column) -> Column:
    return F.coalesce(F.create_map(*(F.lit(x) for pair in SOURCE_LABELS.items() for x in pair))[source], source)


def specs_line() -> Column:
    """Sizes of a home, null if none is known."""
    parts = (("surface", "{} m²"), ("land_surface", "terrain {} m²"), ("rooms", "{} pièces"), ("bedrooms", "{} ch."))
    said = [F.when(F.col(n) > 0, F.concat(F.lit(text.split("{}")[0]), plain_number(F.col(n)), F.lit(text.split("{}")[1]))) for n, text in parts]
    return F.nullif(F.concat_ws(" · ", *said), F.lit(""))


def drop_line() -> Column:
    """How far a price fell, null if it didn't."""
    first, price = F.col("first_price"), F.col("price")
    return F.when(price < first, F.concat(F.lit("Baisse : "), euros(first), F.lit(" → "), euros(price), F.lit(" (−"), euros(first - price), F.lit(", −"), drop_percent(first, price).cast("string"), F.lit(" %)")))


def notice(header: str | None = None, price_drop: bool = False) -> Column:
    """The text of a notice on a list row: price and place, sizes, energy, drop, sources, the first ad's url; unknown lines are left out."""
    place = F.concat(F.col("city"), F.coalesce(F.concat(F.lit(" ("), F.nullif(F.col("postal_code"), F.lit("")), F.lit(")")), F.lit("")))
    sources = F.when(F.size("sources") > 0, F.array_join(F.transform("sources", source_label), ", ")).otherwise(WITHDRAWN)
    lines = [F.concat(euros(F.col("price")), F.lit(" · "), place), specs_line(), F.concat(F.lit("DPE "), energy_label(F.col("dpe_class"), F.col("ges_class"))), drop_line() if price_drop else F.lit(None).cast("string"), sources, F.col("primary_url")]
    body = F.concat_ws("\n", *lines)
    return body if header is None else F.concat(F.lit(f"{header}\n\n"), body)


def location_department(code: Column) -> Column:
    """The department of a commune's place code."""
    insee = F.regexp_replace(code, "(?i)^AD08FR", "")
    return F.upper(F.substring(insee, 1, 2))


def encoded_location(payload: Column) -> Column:
    """A struct as the portals put it into a url: JSON in url-safe base64 without padding."""
    return F.regexp_replace(F.translate(F.base64(F.to_json(payload).cast("binary")), "+/\r\n", "-_"), "=+$", "")


def decoded_location(text: Column, schema: str) -> Column:
    padded = F.rpad(F.translate(text, "-_", "+/"), F.ceil(F.length(text) / 4).cast("int") * 4, F.lit("="))
    return F.from_json(F.unbase64(padded).cast("string"), schema)


def _query(base: Column, pairs: list[tuple[str, Column]]) -> Column:
    return F.concat(base, F.lit("?"), F.concat_ws("&", *(F.concat(F.lit(f"{name}="), F.url_encode(value.cast("string"))) for name, value in pairs)))


_ASKED = (("max_price", "priceMax", "price", "0-{}"), ("min_surface", "spaceMin", "square", "{}-max"), ("min_land_surface", "plotSpaceMin", "land_plot_surface", "{}-max"), ("min_rooms", "numberOfRoomsMin", "rooms", "{}-max"), ("min_bedrooms", "numberOfBedroomsMin", "bedrooms", "{}-max"))


def classified_search_url(base: str, location: Column, page: Column) -> Column:
    """The search page of portal C or D for rows with the asked criteria; what is null isn't asked."""
    pairs = [("distributionTypes", F.lit("Buy")), ("estateTypes", F.lit("House")), ("locations", location), *((theirs, plain_number(F.col(own))) for own, theirs, _, _ in _ASKED)]
    return _query(F.lit(f"{base}/classified-search"), [*pairs, ("projectTypes", F.when(F.col("old_only"), "Resale")), ("page", F.when(page > 1, page))])


def city_page_url(base: str, name: Column, code: Column, page: Column) -> Column:
    """The page of a commune's houses on portal C or D."""
    slug = F.regexp_replace(F.regexp_replace(F.regexp_replace(unaccent(name), "['’]", ""), "[^a-z0-9]+", "-"), "^-|-$", "")
    url = F.concat(F.lit(f"{base}/immobilier/achat/immo-"), slug, F.lit("-"), location_department(code), F.lit("/bien-maison/"))
    return F.when(page > 1, F.concat(url, F.lit("?LISTING-LISTpg="), page.cast("string"))).otherwise(url)


def leboncoin_search_url(location: Column, text: Column, page: Column) -> Column:
    """The search page of portal B: by its location, else by a text."""
    asked = [(theirs, F.format_string(pattern.replace("{}", "%s"), plain_number(F.col(own)))) for own, _, theirs, pattern in _ASKED]
    pairs = [("category", F.lit("9")), ("real_estate_type", F.lit("1")), ("locations", location), ("text", F.when(location.isNull(), text)), *((n, F.when(F.col(own).isNotNull(), v)) for (n, v), (own, *_) in zip(asked, _ASKED))]
    return _query(F.lit("https://www.leboncoin.fr/recherche"), [*pairs, ("immo_sell_type", F.when(F.col("old_only"), "old")), ("page", F.when(page > 1, page))])
