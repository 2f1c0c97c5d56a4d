"""Scalar expressions: geography, text, types, energy, keys, urls, dates, formats."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

# ---------------------------------------------------------------- geography

EARTH_KM, KM_PER_DEGREE, KM_PER_HOUR = 6371, 111.32, 50


def haversine_km(lat1: Column, lng1: Column, lat2: Column, lng2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lng2 - lng1) / 2), 2)
    return F.lit(EARTH_KM) * 2 * F.atan2(F.sqrt(a), F.sqrt(1 - a))


def bounding_box(lat: float, lng: float, radius_km: float) -> tuple[float, float, float, float]:
    """(min_lat, max_lat, min_lng, max_lng): literal bounds, so they reach the Parquet statistics."""
    import math

    d_lat = radius_km / KM_PER_DEGREE
    d_lng = radius_km / (KM_PER_DEGREE * math.cos(math.radians(lat)))
    return lat - d_lat, lat + d_lat, lng - d_lng, lng + d_lng


def within_box(lat: Column, lng: Column, box: tuple[float, float, float, float]) -> Column:
    return lat.between(box[0], box[1]) & lng.between(box[2], box[3])


def travel_radius_km(minutes: float) -> float:
    return minutes / 60 * KM_PER_HOUR


# Travel minutes that a portal offers.
TRAVEL_MINUTES = (5, 10, 15, 20, 25, 30, 45, 60)


def ceil_travel_minutes(minutes: Column) -> Column:
    options = F.array(*map(F.lit, TRAVEL_MINUTES))
    return F.coalesce(F.array_min(F.filter(options, lambda o: o >= minutes)), F.lit(TRAVEL_MINUTES[-1]))


# ---------------------------------------------------------------- text

def _accents() -> tuple[str, str]:
    """Letters of the Latin blocks that canonical decomposition turns into an ASCII letter and marks, and these letters."""
    import unicodedata

    pairs = {}
    for code in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00)):
        plain = "".join(c for c in unicodedata.normalize("NFD", chr(code)) if not unicodedata.combining(c))
        if len(plain) == 1 and plain.isascii():
            pairs[chr(code)] = plain
    return "".join(pairs), "".join(pairs.values())


_ACCENTS = _accents()


def unaccent(text: Column) -> Column:
    """Lower case without accents: letters with marks become the letter, marks of their own go."""
    return F.regexp_replace(F.translate(F.lower(text), *_ACCENTS), r"\p{M}", "")


def contains_ascii_ci(text: Column, needle: str) -> Column:
    """LIKE '%needle%' where only ASCII letters ignore case."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.contains(F.translate(text, upper, lower), F.lit(needle.translate(str.maketrans(upper, lower))))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where the value is made once, however often it is used; elsewhere Spark may make it again for each use."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def filled(text: Column) -> Column:
    """The text, null if it is empty."""
    return let(text, lambda x: F.when(x != "", x))


def some(items: Column) -> Column:
    """The array, null if it is empty."""
    return let(items, lambda x: F.when(F.size(x) > 0, x))


def blank_to_null(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def squeeze(text: Column) -> Column:
    return F.regexp_replace(F.trim(F.regexp_replace(text, r"\s+", " ")), r"^ | $", "")


def normalize_address(text: Column) -> Column:
    """Lower case without accents, one space between words."""
    return F.trim(F.regexp_replace(unaccent(text), r"\s+", " "))


def normalize_city(text: Column) -> Column:
    """Lower case without accents, only letters and digits, one space between words."""
    return F.trim(F.regexp_replace(unaccent(text), "[^a-z0-9]+", " "))


def place_token(text: Column) -> Column:
    """Lower case without accents, only letters and digits."""
    return F.regexp_replace(unaccent(text), "[^a-z0-9]", "")


# Words of a title that name no place, and words that a street's name follows.
PLACE_STOPWORDS = (
    "albatre", "annonce", "arr", "avec", "axe", "chambre", "chambres", "comprenant", "cote", "cuisine", "exclusivite", "hab",
    "habitable", "jeux", "longere", "maison", "pieces", "rdc", "salon", "sejour", "superbe", "terrain", "vendre",
)
STREET_NAME = (
    r"(?iu)\b(?:rue|route|chemin|impasse|avenue|allee|allée|boulevard|place|lieu[- ]dit|hameau)\s+"
    r"(?:de\s+|du\s+|des\s+|d['']|l['']|la\s+)?([a-zàâäéèêëïîôùûüç0-9][\wàâäéèêëïîôùûüç'-]{2,})"
)


def place_hints(*texts: Column) -> Column:
    """Distinct tokens of texts that may stand in an address: words, and names that follow a word for a street; 4 characters at least."""
    parts = [F.coalesce(F.concat(F.split(t, r"[\s,-]+"), F.regexp_extract_all(t, F.lit(STREET_NAME), F.lit(1))), F.array().cast("array<string>")) for t in texts]
    tokens = F.transform(F.flatten(F.array(*parts)), place_token)
    return F.array_distinct(F.filter(tokens, lambda t: (F.length(t) >= 4) & ~t.isin(*PLACE_STOPWORDS)))


def hint_points(hints: Column, address: Column) -> Column:
    """10 and a hint's length, 25 at most, for each hint that a normalized address contains."""
    points = F.transform(hints, lambda h: F.when(F.contains(address, h), F.least(F.lit(25), F.length(h) + 10)).otherwise(0))
    return F.aggregate(points, F.lit(0), lambda s, x: s + x)


def slug(text: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(unaccent(text), "[^a-z0-9]+", "-"), "^-+|-+$", "")


def descriptions_equivalent(left: Column, right: Column) -> Column:
    """Equal up to white space, one a prefix of the other, or one contained without its ellipsis (40 characters at least)."""
    a, b = squeeze(left), squeeze(right)
    core = lambda x: F.rtrim(F.regexp_replace(x, r"(?:\.\.\.|…)$", ""))
    ca, cb = core(a), core(b)
    short, long_ = F.when(F.length(ca) <= F.length(cb), ca).otherwise(cb), F.when(F.length(ca) <= F.length(cb), cb).otherwise(ca)
    filled = (F.coalesce(left, F.lit("")) != "") & (F.coalesce(right, F.lit("")) != "")
    alike = (a == b) | F.startswith(a, b) | F.startswith(b, a) | (ca == cb) | ((F.length(short) >= 40) & F.contains(long_, short))
    return left.eqNullSafe(right) | (filled & F.coalesce(alike, F.lit(False)))


# ---------------------------------------------------------------- types, keys

# Names of property types.
PROPERTY_TYPES = {
    "house": "house", "maison": "house", "pavillon": "house", "propriété": "house", "propriete": "house",
    "flat": "apartment", "apartment": "apartment", "appartement": "apartment", "loft": "loft",
    "castle": "castle", "chateau": "castle", "château": "castle",
    "townhouse": "townhouse", "maison de ville": "townhouse", "villa": "villa",
}


def canonical_type(value: Column) -> Column:
    """One name for the spellings of a property type; '' for none."""
    name = F.lower(squeeze(value))
    known = F.create_map(*(F.lit(x) for pair in PROPERTY_TYPES.items() for x in pair))[name]
    house = F.startswith(name, F.lit("maison")) | F.startswith(name, F.lit("propriété")) | F.startswith(name, F.lit("propriete"))
    return F.coalesce(known, F.when(house, "house"), name, F.lit(""))


def one_decimal(value: Column) -> Column:
    """A non-negative number with one decimal: the exact binary value is rounded, exact ties upward."""
    x = value.cast("double")
    tie = (x * 4 == F.floor(x * 4)) & (F.floor(x * 4) % 2 == 1)
    return F.when(tie, F.format_string("%.1f", F.floor(x * 10 + 0.5) / 10)).otherwise(F.call_function("format_number", x, F.lit("0.0")))


def property_key(postal_code: Column, price: Column, surface: Column, rooms: Column, bedrooms: Column, property_type: Column, land_surface: Column, is_new: Column) -> Column:
    """The fingerprint of a home: 32 hex digits over eight parts."""
    text = lambda c: F.coalesce(c.cast("string"), F.lit(""))
    parts = [text(postal_code), text(price), F.coalesce(one_decimal(surface), F.lit("")), text(rooms), text(bedrooms), canonical_type(property_type), F.coalesce(one_decimal(land_surface), F.lit("")), F.coalesce(F.when(is_new, "1").when(~is_new, "0"), F.lit(""))]
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 32)


def source_rank(source: Column, order: Iterable[str]) -> Column:
    names = list(order)
    at = F.array_position(F.array(*map(F.lit, names)), source)
    return F.when(at > 0, at - 1).otherwise(len(names)).cast("int")


# Agency names that hold dashes.
AGENCY_PREFIXES = ("square-habitat-immo-facile", "laforet-immo-facile", "dr-house-immo-1", "century-21", "iad-france", "immo-facile", "adapt-immo", "safti-1")


def agency(external_id: Column) -> tuple[Column, Column]:
    """(slug, ref) of an ad id: a known name, or else what stands before the first dash; nulls if either is empty."""
    own = F.trim(external_id)
    pattern = rf"^({'|'.join(AGENCY_PREFIXES)}|[^-]+)-(.*)$"
    slug_, ref = F.regexp_extract(own, pattern, 1), F.regexp_extract(own, pattern, 2)
    whole = (slug_ != "") & (ref != "")
    return F.when(whole, slug_), F.when(whole, ref)


def department(postal_code: Column) -> Column:
    """The department of a postal code, with Corsica's two and the three digits of overseas ones."""
    own = F.trim(postal_code)
    corsica = F.when(F.substring(own, 3, 1) == "0", "2A").otherwise("2B")
    two = F.substring(own, 1, 2)
    return F.when(own.startswith("20"), corsica).when(own.rlike("^97[1-8]"), F.substring(own, 1, 3)).when(two.rlike(r"^\d{2}$"), two)


# ---------------------------------------------------------------- energy

ENERGY_CLASSES = ("A", "B", "C", "D", "E", "F", "G", "N", "V")
CONSUMPTION_TOLERANCE, EMISSION_TOLERANCE = 2, 1


def energy_class(value: Column) -> Column:
    letter = F.upper(F.substring(F.trim(value), 1, 1))
    return F.when(letter.isin(*ENERGY_CLASSES), letter)


def energy_label(dpe: Column, ges: Column) -> Column:
    filled = lambda c, name: F.when(c != "", F.concat(F.lit(f"{name} "), c))
    return F.nullif(F.concat_ws(" · ", filled(dpe, "DPE"), filled(ges, "GES")), F.lit(""))


def _metric(text: Column, *patterns: str) -> Column:
    found = [filled(F.regexp_extract(text, p, 1)) for p in patterns]
    return F.replace(F.coalesce(*found), F.lit(","), F.lit(".")).try_cast("double")


# How a text states consumption and emission; tests/test_portal_texts.py has a case for each.
CONSUMPTION = (r"(?iu)consommation[^:]{0,40}:\s*(\d+(?:[.,]\d+)?)\s*kwh\s*/\s*m²", r"(?iu)(\d+(?:[.,]\d+)?)\s*kwh\s*/\s*m²\s*(?:\.\s*an|/\s*an)")
EMISSION = (r"(?iu)émissions?\s*:\s*(\d+(?:[.,]\d+)?)\s*kg", r"(?iu)(\d+(?:[.,]\d+)?)\s*kg\s*co₂?\s*/\s*m²")


def consumption_from_text(text: Column) -> Column:
    return _metric(text, *CONSUMPTION)


def emission_from_text(text: Column) -> Column:
    return _metric(text, *EMISSION)


def half_up(value: Column) -> Column:
    """Rounds halves toward positive infinity."""
    return F.floor(value + F.lit(0.5))


def tolerance_range(value: Column, tolerance: int) -> tuple[Column, Column]:
    return F.greatest(F.lit(0), half_up(value) - tolerance), half_up(value) + tolerance


# ---------------------------------------------------------------- amenities

# Tags that say what a listing's own fields say.
STRUCTURAL_TAGS = (
    r"\d+\s*(?:pièces?|chambres?)(?![A-Za-z0-9_])",
    r"terrain\s*(?:de\s+)?\d",
    r"^\d+\s*m²(?=[A-Za-z0-9_])",
    r"classe\s+(?:énergie|climat)",
)
STRUCTURAL_TAG = "(?iu)" + "|".join(STRUCTURAL_TAGS)


def highlights_from_tags(tags: Column) -> Column:
    return some(F.filter(F.transform(tags, lambda t: F.trim(t)), lambda t: (t != "") & ~t.rlike(STRUCTURAL_TAG)))


def merged_highlights(lists: Column) -> Column:
    """The distinct trimmed items of an array of arrays, in order; null if none."""
    return some(F.array_distinct(F.filter(F.transform(F.flatten(F.array_compact(lists)), lambda t: F.trim(t)), lambda t: t != "")))


def highlight_overlap(actual: Column, preferred: Column) -> Column:
    """Share of preferred items that contain an actual one or lie in one."""
    norm = lambda c: F.transform(c, lambda x: F.lower(F.trim(x)))
    hits = F.filter(norm(preferred), lambda p: F.exists(norm(actual), lambda a: F.contains(a, p) | F.contains(p, a)))
    return F.when(F.coalesce(F.size(preferred), F.lit(0)) <= 0, None).when(F.coalesce(F.size(actual), F.lit(0)) <= 0, 0.0).otherwise(F.size(hits) / F.size(preferred))


def same_set(left: Column, right: Column) -> Column:
    as_set = lambda c: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast("array<string>"))))
    return as_set(left) == as_set(right)


# A year of construction in a text, and tags that count bathrooms; tests/test_portal_texts.py has a case for each.
YEAR = r"\b(18[89]\d|19\d{2}|20[0-2]\d)\b"
BATHROOMS = (r"(?iu)(\d+)\s*(?:salles?\s*de\s*bains?|sdb)\b", r"(?iu)(\d+)\s*salles?\s*d['’]eau")


def year_from_text(text: Column) -> Column:
    return filled(F.regexp_extract(text, YEAR, 1)).try_cast("int")  # a cast of '' fails by an exception, which costs more than the search


def bathrooms_from_tags(tags: Column) -> Column:
    """The number of the first tag that counts bathrooms."""
    said = lambda t: F.coalesce(*(filled(F.regexp_extract(t, p, 1)) for p in BATHROOMS))
    return F.get(F.array_compact(F.transform(tags, said)), F.lit(0)).try_cast("int")


def positive(value: Column) -> Column:
    return F.when((value > 0) & ~F.isnan(value.cast("double")), value)


def positive_int(text: Column) -> Column:
    return half_up(positive(text.try_cast("double"))).cast("int")


def sane_year(value: Column) -> Column:
    year = half_up(value.cast("double"))
    return F.when(year.between(1800, 2100), year.cast("int"))


# ---------------------------------------------------------------- images, urls

PHOTO_HASH_BITS = 8


def photo_key(url: Column) -> Column:
    """Origin and path of a url."""
    return F.regexp_replace(url, r"[?#].*$", "")


def photo_url(url: Column, hashes: Column) -> Column:
    local = F.try_element_at(hashes, url)
    return F.when(local != "", F.concat(F.lit("/api/media/"), local)).otherwise(url)


def hex_hamming(a: Column, b: Column) -> Column:
    """Differing bits of two hex strings; of different lengths, all bits of the longer."""
    byte = lambda c, i: F.conv(F.substring(c, i, F.lit(8)), 16, 10).cast("long")
    parts = F.sequence(F.lit(1), F.greatest(F.length(a), F.lit(1)), F.lit(8))
    bits = F.aggregate(F.transform(parts, lambda i: F.bit_count(byte(a, i).bitwiseXOR(byte(b, i)))), F.lit(0), lambda s, x: s + x)
    return F.when(F.length(a) != F.length(b), F.greatest(F.length(a), F.length(b)) * 4).otherwise(bits)


def merged_urls(existing: Column, incoming: Column) -> Column:
    """Both lists in order without urls whose key stood before."""
    both = F.concat(F.coalesce(existing, F.array().cast("array<string>")), F.coalesce(incoming, F.array().cast("array<string>")))
    keys = F.transform(both, lambda u: photo_key(u))
    return F.filter(both, lambda u, i: F.array_position(keys, photo_key(u)) == i + 1)


# ---------------------------------------------------------------- dates, formats


def week_label(day: Column) -> Column:
    """%Y-W%W: weeks begin on Monday, days before the first Monday are in week 00."""
    week = F.floor((F.dayofyear(day) + 6 - F.weekday(day)) / 7).cast("string")
    return F.concat(F.year(day).cast("string"), F.lit("-W"), F.lpad(week, 2, "0"))


def grouped(value: Column, mark: str = " ") -> Column:
    return F.replace(F.format_number(value, 0), F.lit(","), F.lit(mark))


def euros(value: Column) -> Column:
    """French format: narrow no-break spaces between groups, a no-break space before the sign."""
    return F.concat(grouped(value), F.lit(" €"))


def price_short(value: Column) -> Column:
    million = F.regexp_replace(F.call_function("format_number", value / 1e6, F.lit("0.0")), r"\.0$", "")
    return F.when(value >= 1_000_000, F.concat(million, F.lit("M"))).when(value >= 1000, F.concat(half_up(value / 1000).cast("string"), F.lit("k"))).otherwise(value.cast("string"))


def drop_percent(first: Column, price: Column) -> Column:
    return F.when((first > 0) & (price < first), half_up((first - price) / first * 100).cast("int"))
