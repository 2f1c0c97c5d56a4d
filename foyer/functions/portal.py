"""Expressions over a portal's page or text: energy, surfaces, tags, coordinates, descriptions, page health."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from foyer.functions.scalars import bathrooms_from_tags, consumption_from_text, emission_from_text, filled, highlights_from_tags, let, year_from_text


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return filled(F.regexp_extract(text, pattern, group))


def _number(text: Column) -> Column:
    return F.replace(text, F.lit(","), F.lit(".")).try_cast("double")


# How an ad's text names its classes, both at once or each by itself, and its land.  tests/test_portal_texts.py has a case for each.
BOTH_CLASSES = r"(?iu)Classe énergie\s+([A-G])[\s,]+Classe climat\s+([A-G])"
ENERGY_CLASS = r"(?iu)(?:DPE|énergie)\s*[:\s]*([A-G])"
CLIMATE_CLASS = r"(?iu)(?:GES|climat)\s*[:\s]*([A-G])"
LAND_BEFORE, LAND_AFTER = r"(?iu)terrain\s*(?:de\s+)?(\d[\d\s]*)\s*m²", r"(?iu)(\d[\d\s]*)\s*m²\s*(?:de\s+)?terrain"


def both_classes(text: Column) -> Column:
    """The phrase of a text that names both classes."""
    return _found(text, BOTH_CLASSES, 0)


def energy_classes(text: Column, both: Column | None = None) -> tuple[Column, Column]:
    """(dpe, ges) that a text names: both in one phrase, else each by its own; both: both_classes(), where it is a column already."""
    both = both_classes(text) if both is None else both
    named = lambda group, alone: F.upper(F.coalesce(_found(both, BOTH_CLASSES, group), _found(text, alone)))
    return named(1, ENERGY_CLASS), named(2, CLIMATE_CLASS)


def land_surface(text: Column) -> Column:
    """Square meters of land, said before or after the number."""
    digits = F.array_join(F.split(F.coalesce(_found(text, LAND_BEFORE), _found(text, LAND_AFTER)), r"\s+"), "")
    return digits.try_cast("double")


def _first_tag(tags: Column, pattern: str) -> Column:
    return F.get(F.filter(tags, lambda t: t.rlike(pattern)), F.lit(0))


def heating_from_tags(tags: Column) -> Column:
    return F.trim(_first_tag(tags, "(?iu)chauffage"))


def condition_from_tags(tags: Column) -> Column:
    return F.trim(_first_tag(tags, r"(?iu)travaux|bon\s+état|à\s+rafraîchir|neuf"))


def count_from_tags(tags: Column, pattern: str) -> Column:
    """The number that the first tag of this kind starts with, as pattern's group."""
    return _found(_first_tag(tags, pattern), pattern).try_cast("int")


def rooms_from_tags(tags: Column) -> Column:
    return count_from_tags(tags, r"(?iu)(\d+)\s*pièces?(?![A-Za-z0-9_])")


def bedrooms_from_tags(tags: Column) -> Column:
    return count_from_tags(tags, r"(?iu)(\d+)\s*chambres?(?![A-Za-z0-9_])")


def parking_from_tags(tags: Column) -> Column:
    """The number of the first tag on parking; one that names it without a number counts as 1."""
    counted = lambda t: F.coalesce(_found(t, r"(?iu)(\d+)\s*(?:places?\s+de\s+)?parkings?"), _found(t, r"(?iu)(\d+)\s*places?\s+(?:de\s+)?stationnement"))
    one = lambda t: F.coalesce(counted(t), F.when(t.rlike(r"(?iu)\b(?:garage|parking|stationnement)\b") & ~t.rlike(r"\d"), "1"))
    return F.get(F.filter(F.transform(tags, one), lambda x: x.isNotNull()), F.lit(0)).try_cast("int")


def tag_extras(description: Column, tags: Column) -> dict[str, Column]:
    """What a card's description and tags tell beyond its fields."""
    text = F.concat_ws("\n", F.nullif(description, F.lit("")), tags)
    return {
        "bathrooms": bathrooms_from_tags(tags),
        "construction_year": year_from_text(text),
        "heating": heating_from_tags(tags),
        "orientation": F.lit(None).cast("string"),
        "property_condition": condition_from_tags(tags),
        "parking_spaces": parking_from_tags(tags),
        "highlights": highlights_from_tags(tags),
    }


def bare(html: Column) -> Column:
    """The page with JSON that stands inside strings as plain JSON: one level of escapes before quotes, slashes and backslashes is gone."""
    return F.regexp_replace(html, r'\\(["\\/])', "$1")


# Names of the scales that a page rates a home on, and how a rating and a metric stand in its payload.
ENERGY_SCALE, CLIMATE_SCALE = "FR_ENERGY_AFTER_2021", "FR_GHG_AFTER_2021"
RATING, METRIC = r'"rating":"[A-Ga-g]"', r'"value":"\d+(?:[.,]\d+)?\s*(?:kWh/m²|kg CO₂/m²)'


def _scale_marks(page: Column) -> Column:
    """Ratings, scales and metrics of a page in their order; page: bare()."""
    return F.regexp_extract_all(page, F.lit("|".join((RATING, ENERGY_SCALE, CLIMATE_SCALE, METRIC))), F.lit(0))


def rated(page: Column, scale: str) -> tuple[Column, Column]:
    """(class, metric) on a scale: the rating that is the last mark before the scale's name, and the metric that is the next after it."""

    def around(marks: Column) -> Column:
        at = F.array_position(marks, F.lit(scale)).cast("int")
        return F.when(at > 0, F.struct(F.get(marks, at - 2).alias("before"), F.get(marks, at).alias("after")))

    both = let(_scale_marks(page), around)
    rating = let(both["before"], lambda x: F.when(x.startswith('"rating"'), F.upper(F.substring(x, -2, 1))))
    return rating, let(both["after"], lambda x: F.when(x.startswith('"value"'), _number(_found(x, r"(\d+(?:[.,]\d+)?)"))))


def page_energy(html: Column, page: Column | None = None) -> dict[str, Column]:
    """Classes and metrics of a detail page: from its text, else from its scales; page: bare()."""
    page = bare(html) if page is None else page
    dpe, ges = energy_classes(html)
    (dpe_rated, consumed), (ges_rated, emitted) = (rated(page, s) for s in (ENERGY_SCALE, CLIMATE_SCALE))
    return {
        "dpe_class": F.coalesce(dpe, dpe_rated),
        "ges_class": F.coalesce(ges, ges_rated),
        "dpe_consumption_kwh_m2": F.coalesce(consumption_from_text(html), consumed),
        "ges_emission_kg_m2": F.coalesce(emission_from_text(html), emitted),
    }


# The bounds of France's mainland in degrees.
LATITUDES, LONGITUDES = (41, 52), (-5.5, 10)
_DECIMAL = r"-?\d+(?:\.\d+)?"
# Where a page says its place: the center of a static map, a GeoJSON point (both longitude first), two fields of one object.
STATIC_MAP, GEO_POINT = rf"(?i)/static/[^/]+/({_DECIMAL}),({_DECIMAL}),", rf'(?i)"Point"[^\[]*"coordinates":\[({_DECIMAL}),({_DECIMAL})\]'
PLACE_FIELDS = rf'(?i)"(?:latitude|longitude)"\s*:\s*{_DECIMAL}[^}}]{{0,120}}"(?:latitude|longitude)"\s*:\s*{_DECIMAL}'


def in_france(lat: Column, lng: Column) -> Column:
    return F.coalesce(lat.between(*LATITUDES) & lng.between(*LONGITUDES), F.lit(False))


def point(lat: Column, lng: Column) -> Column:
    """struct(lat, lng) of a pair in either order, null outside France."""
    make = lambda a, b: F.struct(a.alias("lat"), b.alias("lng"))
    return F.when(in_france(lat, lng), make(lat, lng)).when(in_france(lng, lat), make(lng, lat))


def page_point(html: Column, page: Column | None = None) -> Column:
    """Coordinates that a page names, the first of its ways that lies in France; page: bare()."""
    page = bare(html) if page is None else page
    fields = _found(page, PLACE_FIELDS, 0)
    value = lambda name: _found(fields, rf'(?i)"{name}"\s*:\s*({_DECIMAL})')
    pairs = [(_found(page, p, 2), _found(page, p)) for p in (STATIC_MAP, GEO_POINT)] + [(value("latitude"), value("longitude"))]
    both = lambda lat, lng: F.struct(lat.try_cast("double").alias("lat"), lng.try_cast("double").alias("lng"))
    return F.coalesce(*(let(both(lat, lng), lambda p: point(p["lat"], p["lng"])) for lat, lng in pairs))


def unescaped_json(text: Column) -> Column:
    """The text that a JSON string's escapes stand for, decoded by the JSON reader."""
    lenient = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.from_json(F.concat(F.lit('{"v":"'), text, F.lit('"}')), "v string", lenient)["v"]


# The entities that descriptions hold.
ENTITIES = {"nbsp": " ", "amp": "&", "lt": "<", "gt": ">", "quot": '"', "#39": "'"}


def decoded(text: Column) -> Column:
    """Text whose entities of ENTITIES are the characters they name, in one pass; other ampersands stay."""
    table = F.create_map(*(F.lit(x) for pair in ENTITIES.items() for x in pair))
    parts = F.split(text, "&")
    name = lambda part: F.substring_index(part, ";", 1)
    known = lambda part: F.when(F.contains(part, F.lit(";")), F.try_element_at(table, name(part)))
    each = F.transform(parts, lambda part, k: F.when(k == 0, part).otherwise(F.coalesce(F.concat(known(part), F.substr(part, F.length(name(part)) + 2)), F.concat(F.lit("&"), part))))
    return F.array_join(each, "")


def plain_text(html: Column) -> Column:
    """Text without tags: the text between them decoded, a break for a line's end, an empty line after a paragraph."""
    tokens = F.split(html, r"(?=<[^>]+>)|(?<=>)")
    is_tag = lambda t: t.startswith("<") & t.endswith(">")
    tag = lambda t: F.lower(F.btrim(t, F.lit("<> /")))
    shown = lambda t: F.when(~is_tag(t), decoded(t)).when(tag(t) == "br", "\n").when((tag(t) == "p") & t.startswith("</"), "\n\n").otherwise("")
    return F.array_join(F.transform(tokens, shown), "")


def tidy(text: Column) -> Column:
    """Plain spaces, no spaces at the end of a line, no two empty lines in a row, none around."""
    lines = F.transform(F.split(F.translate(text, "\u00a0", " "), "\n"), lambda x: F.rtrim(x, F.lit(" \t")))
    kept = let(lines, lambda own: F.filter(own, lambda x, k: (x != "") | (k == 0) | (F.get(own, k - 1) != "")))
    return F.btrim(F.array_join(kept, "\n"), F.lit(" \t\n\r\f"))


# The length from which a text counts as a description, and what shows that a payload was cut into it.
LEAST_DESCRIPTION, PAYLOAD_RESTS = 40, ('","canonical"', '\\"')


def has_payload_rest(text: Column) -> Column:
    return reduce(lambda a, b: a | b, (F.contains(text, F.lit(x)) for x in PAYLOAD_RESTS))


def plausible_description(text: Column) -> Column:
    """Long enough, no rest of a payload, and not the title of an ad: what is sold, its price and the postal code at the end."""
    titled = lambda words: (F.get(words, F.lit(0)) == "Achat") & F.get(words, F.lit(1)).isin("Maison", "Appartement") & F.contains(text, F.lit("€")) & F.element_at(words, -1).rlike(r"^\(\d{5}\)$")
    title = let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), lambda words: F.when(F.size(words) > 2, titled(words)))
    return (F.length(text) >= LEAST_DESCRIPTION) & ~has_payload_rest(text) & ~F.coalesce(title, F.lit(False))


#: A field of a payload with an object of texts and numbers.  Possessive loops: Java matches other groups by recursion, and payloads are long.
_DESCRIPTIONS = r'"mainDescription"\s*:\s*(\{(?:[^{}"]++|"(?:[^"\\]++|\\.)*+")*+\})'


def _payload_descriptions(html: Column, page: Column) -> Column:
    """Descriptions that a page's payloads hold, read by the JSON reader: of plain JSON, and of JSON inside a string."""
    objects = F.concat(*(F.regexp_extract_all(x, F.lit(_DESCRIPTIONS), F.lit(1)) for x in (html, page)))
    lenient = {"allowUnquotedControlChars": "true", "allowBackslashEscapingAnyCharacter": "true"}
    return F.array_distinct(F.transform(objects, lambda o: F.from_json(o, "description string", lenient)["description"]))


def longest(texts: Column) -> Column:
    """The longest filled text of an array; of equals the first."""
    sized = F.transform(texts, lambda t, k: F.struct(F.length(t).alias("n"), (-k).alias("first"), t.alias("t")))
    return F.array_max(F.filter(sized, lambda x: F.coalesce(F.trim(x["t"]) != "", F.lit(False))))["t"]


# Fixed value: the element that shows a page's main description.
DESCRIPTION_ELEMENT = r'(?is)data-testid="cdp-main-description-expandable-text"[^>]*>(.*?)</'


def page_description(html: Column, page: Column | None = None) -> Column:
    """The main description of a page, from its element or its payload; the longest plausible one.  page: bare()."""
    page = bare(html) if page is None else page
    shown = tidy(plain_text(_found(html, DESCRIPTION_ELEMENT)))
    every = F.concat(F.array(shown), F.transform(_payload_descriptions(html, page), tidy))
    return longest(F.filter(every, lambda t: F.coalesce(plausible_description(t), F.lit(False))))


def cut_off(description: Column) -> Column:
    """A description that is missing, ends in dots or holds a rest of a payload."""
    own = F.trim(description)
    return F.coalesce((own == "") | has_payload_rest(own) | own.endswith("...") | own.endswith("…"), F.lit(True))


def og_image(html: Column) -> Column:
    """The picture that a page's head names for sharing."""
    return F.coalesce(_found(html, r"""(?i)<meta[^>]+property=["']og:image["'][^>]+content=["']([^"']+)["']"""), _found(html, r"""(?i)<meta[^>]+content=["']([^"']+)["'][^>]+property=["']og:image["']"""))


def page_title(html: Column) -> Column:
    return F.trim(_found(html, r"(?i)<title>([^<]*)</title>"))


def stale_image(url: Column) -> Column:
    """A picture's url that must be fetched anew: missing, a resized copy, or one of the media hosts without its seal."""
    host = F.try_parse_url(url, F.lit("HOST"))
    sealed = F.coalesce(F.contains(F.try_parse_url(url, F.lit("QUERY")), F.lit("ci_seal=")), F.lit(False))
    media = host.isin("mms.logic-immo.com", "mms.seloger.com")
    return F.coalesce((url == "") | F.contains(url, F.lit("v.seloger.com/s/width/")) | host.isNull() | (media & ~sealed), F.lit(True))


# What says that a page holds the data of a search.
_DATA_MARKS = ('window["initialData"]', "classified-serp-init-data")


def incomplete_search(html: Column) -> Column:
    """A search page of portals C and D that broke off or is a shell without data."""
    has = lambda t: F.contains(html, F.lit(t))
    shell = has("__UFRN_FETCHER__") & (has('"data":{}') | has('"data": {}'))
    broken = (F.length(html) > 50_000) & (~has("__UFRN_FETCHER__") | ~html.rlike("(?i)</html>"))
    return html.rlike(r"(?i)504\s+Gateway\s+Time-?out") | (~(has(_DATA_MARKS[0]) | has(_DATA_MARKS[1])) & (shell | broken))


def search_failure(html: Column, label: str) -> Column:
    """Why a search page of portals C and D gave no data, in words."""
    title = page_title(html)
    return (
        F.when(html.rlike(r"(?i)504\s+Gateway\s+Time-?out"), "gateway timeout")
        .when(html.rlike("(?i)datadome|captcha|access denied"), "blocked as a robot")
        .when(title.isin(label, "SeLoger"), "empty shell")
        .when(incomplete_search(html), "incomplete page")
        .when(title.isNotNull(), F.concat(F.lit("no data under the title "), title))
        .otherwise("no data")
    )


def blocked(html: Column) -> Column:
    """Portal B's page for robots."""
    return html.rlike("(?iu)datadome|captcha-delivery|vous avez été bloqué")


def health(html: Column, portal: str, label: str = "") -> Column:
    """ok, incomplete or blocked, for a portal's page: bad ones go to quarantine with their reason."""
    if portal == "leboncoin":
        return F.when(blocked(html), "blocked").when(F.contains(html, F.lit("__NEXT_DATA__")), "ok").when(F.length(html) < 10_000, "incomplete").otherwise("ok")
    return F.when(html.rlike("(?i)datadome|captcha|access denied"), "blocked").when(incomplete_search(html), "incomplete").otherwise("ok")


def next_data_failure(html: Column) -> Column:
    """Why a page of portal B gave no data, in words."""
    return F.when(blocked(html), "blocked as a robot").when(page_title(html) == "leboncoin.fr", "empty shell").when(~F.contains(html, F.lit("__NEXT_DATA__")), "no data tag").otherwise("unexpected structure")


def next_data(html: Column) -> Column:
    """The JSON text of a page's data tag."""
    return _found(html, r'(?is)<script id="__NEXT_DATA__"[^>]*>(.*?)</script>')


def window_json(html: Column, name: str) -> Column:
    """The JSON text that a page parses into a variable of its window; nothing of the page is run."""
    return unescaped_json(_found(html, rf'window\["{name}"\]\s*=\s*JSON\.parse\("((?:[^"\\]++|\\.)*+)"'))
