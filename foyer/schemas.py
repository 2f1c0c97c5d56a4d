"""Schemas and field manifests."""

from __future__ import annotations

from pyspark.sql import types as T

# Sources in the order of projection, and in the order of enrichment.
SOURCES = ("bienici", "seloger", "logicimmo", "leboncoin")
ENRICHMENT_SOURCES = ("seloger", "logicimmo", "leboncoin", "bienici")

_LISTING = """external_id string, source string, title string, price long, surface double, land_surface double,
rooms int, bedrooms int, is_new_property boolean, latitude double, longitude double, city string,
postal_code string, url string, description string, image_url string, image_urls array<string>,
property_type string, dpe_class string, ges_class string, dpe_consumption_kwh_m2 double,
ges_emission_kg_m2 double, bathrooms int, construction_year int, heating string, orientation string,
property_condition string, parking_spaces int, highlights array<string>"""


def _struct(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)  # needs an active session


def listing_schema() -> T.StructType:
    """A normalized ad as a connector gives it."""
    return _struct(f"{_LISTING}, scraped_at timestamp")


def publication_schema() -> T.StructType:
    """A stored ad of a source."""
    return _struct(f"id long, property_id long, {_LISTING}, scraped_at timestamp, address string, dpe_numero string, image_local_hashes map<string,string>, image_perceptual_hashes map<string,string>, enriched_at timestamp, agency_slug string, agency_ref string, is_active boolean, created_at timestamp, updated_at timestamp")


#: Projected columns that a property stores for search.
SEARCH_FIELDS = ("title", "price", "surface", "land_surface", "rooms", "bedrooms", "is_new_property", "latitude", "longitude", "city", "postal_code", "dpe_class", "ges_class")
#: Projected columns that are computed when a property is read.
DISPLAY_FIELDS = ("address", "dpe_numero", "property_type", "dpe_consumption_kwh_m2", "ges_emission_kg_m2", "bathrooms", "construction_year", "heating", "orientation", "property_condition", "parking_spaces", "highlights")
#: Columns whose change makes a scraped ad an update.
COMPARABLE_FIELDS = ("title", "price", "surface", "land_surface", "rooms", "bedrooms", "is_new_property", "latitude", "longitude", "city", "postal_code", "description", "image_url", "property_type", "dpe_class", "ges_class", "dpe_consumption_kwh_m2", "ges_emission_kg_m2", "bathrooms", "construction_year", "heating", "orientation", "property_condition", "parking_spaces", "highlights")
#: Columns that an update from a scrape keeps when the new value is null.
PRESERVED_FIELDS = ("description", "image_url", "image_urls", "address", "dpe_numero")
