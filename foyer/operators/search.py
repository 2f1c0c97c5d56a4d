"""Filtered, sorted, paged and geographic search."""

from __future__ import annotations

from dataclasses import dataclass, fields
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer import session
from foyer.functions.scalars import bounding_box, contains_ascii_ci, haversine_km, travel_radius_km, within_box

PAGE, PAGE_MOST, MAP_MOST = 20, 100, 5000


@dataclass(frozen=True)
class SearchFilters:
    """What a caller may ask; None leaves a condition out."""

    city: str | None = None
    postal_code: str | None = None
    min_price: int | None = None
    max_price: int | None = None
    min_surface: float | None = None
    min_land_surface: float | None = None
    min_rooms: int | None = None
    min_bedrooms: int | None = None
    new_only: bool = False
    old_only: bool = False
    source: str | None = None
    text: str | None = None
    without_reaction: bool = False
    price_drop_only: bool = False
    travel_minutes: float | None = None
    radius_km: float | None = None
    sort: str = "price_asc"
    offset: int = 0
    limit: int = PAGE

    def __post_init__(self) -> None:
        if self.new_only and self.old_only:
            raise ValueError("new_only and old_only exclude each other")


def parse_filters(query: dict[str, str]) -> SearchFilters:
    """Filters from a query string; values that don't parse are left out, limits are held to their range."""
    kinds = {f.name: f.type for f in fields(SearchFilters)}
    found: dict = {}
    for name, value in query.items():
        kind = kinds.get(name)
        if kind is None or value in ("", None):
            continue
        try:
            if "bool" in kind:
                found[name] = value.lower() in ("1", "true")
            elif "float" in kind:
                found[name] = float(value)
            elif "int" in kind:
                found[name] = int(value)
            else:
                found[name] = value.strip()
        except ValueError:
            continue
    if found.get("sort") not in (None, *SORTS):
        del found["sort"]
    found["limit"] = max(1, min(found.get("limit", PAGE), PAGE_MOST))
    found["offset"] = max(0, found.get("offset", 0))
    return SearchFilters(**found)


def serialize_filters(f: SearchFilters) -> dict[str, str]:
    """The query string that parse_filters() reads back: what differs from the defaults."""
    plain = SearchFilters()
    shown = lambda v: ("1" if v else "0") if isinstance(v, bool) else str(v)
    return {x.name: shown(getattr(f, x.name)) for x in fields(f) if getattr(f, x.name) != getattr(plain, x.name)}


SORTS = {
    "price_asc": (F.asc, "price"),
    "price_desc": (F.desc, "price"),
    "date_desc": (F.desc, "first_seen_at"),
    "surface_desc": (F.desc, "surface"),
}


def conditions(f: SearchFilters, geographic: bool) -> list[Column]:
    found = [F.col(c) >= v for c, v in (("price", f.min_price), ("surface", f.min_surface), ("land_surface", f.min_land_surface), ("rooms", f.min_rooms), ("bedrooms", f.min_bedrooms)) if v is not None]
    if f.max_price is not None:
        found.append(F.col("price") <= f.max_price)
    if not geographic:  # with a center, city and postal code only say where it is
        found += [contains_ascii_ci(F.col(c), v) for c, v in (("city", f.city), ("postal_code", f.postal_code)) if v]
    if f.new_only:
        found.append(F.col("is_new_property"))
    elif f.old_only:
        found.append(~F.col("is_new_property"))
    if f.price_drop_only:
        found.append(F.col("has_price_drop"))
    return found


def matching(properties: DataFrame, publications: DataFrame, reactions: DataFrame | None, f: SearchFilters, center: tuple[float, float] | None = None) -> DataFrame:
    """Properties that meet f, unordered; with a center also their distance_km within the radius.

    Conditions on the property's columns and the box around the circle reach the
    scan; publications and reactions are semi and anti joins on the property's id.
    """
    radius = travel_radius_km(f.travel_minutes) if f.travel_minutes is not None else f.radius_km
    geographic = center is not None and radius is not None
    found = properties
    if own := conditions(f, geographic):
        found = found.filter(reduce(lambda a, b: a & b, own))
    if geographic:
        found = found.filter(within_box(F.col("latitude"), F.col("longitude"), bounding_box(*center, radius)))
        distance = haversine_km(F.lit(center[0]), F.lit(center[1]), F.col("latitude"), F.col("longitude"))
        found = found.withColumn("distance_km", distance).filter(F.col("distance_km") <= radius)
    on = publications.filter("is_active")
    if f.source:
        on = on.filter(F.col("source") == f.source)
    found = found.join(on.select(F.col("property_id").alias("_pid")), F.col("id") == F.col("_pid"), "left_semi")
    if f.without_reaction and reactions is not None:
        found = found.join(reactions.select(F.col("property_id").alias("_rid")), F.col("id") == F.col("_rid"), "left_anti")
    if f.text:
        said = publications.filter(F.col("is_active") & contains_ascii_ci(F.col("description"), f.text)).select(F.col("property_id").alias("_tid")).distinct()
        found = found.join(said, F.col("id") == F.col("_tid"), "left").filter(contains_ascii_ci(F.col("title"), f.text) | F.col("_tid").isNotNull()).drop("_tid")
    return found


def ordering(sort: str, geographic: bool) -> list[Column]:
    direction, name = SORTS[sort]
    if not geographic:
        return [direction(name), F.asc("id")]
    return [direction(F.coalesce(F.col(name), F.lit(0))) if name == "surface" else direction(name), F.asc("distance_km"), F.asc("id")]


def numbered(rows: DataFrame, order: list[Column], name: str = "at", offset: int = 0) -> DataFrame:
    """The rows of a page (a few hundred at most, so one task orders them) with their places, which outlive a shuffle or a file."""
    return rows.withColumn(name, (F.row_number().over(W.orderBy(*order)) + offset).cast("long"))


def page(found: DataFrame, f: SearchFilters) -> DataFrame:
    """The page that f asks of matching rows, in order, with at, the place among all; ties by distance and id."""
    order = ordering(f.sort, "distance_km" in found.columns)
    return numbered(found.orderBy(*order).offset(f.offset).limit(f.limit), order, offset=f.offset)


def search(properties: DataFrame, publications: DataFrame, reactions: DataFrame | None, f: SearchFilters, center: tuple[float, float] | None = None) -> DataFrame:
    return page(matching(properties, publications, reactions, f, center), f)


def total(found: DataFrame) -> DataFrame:
    return found.agg(F.count("*").alias("total"))


def by_ids(properties: DataFrame, ids: list[int]) -> DataFrame:
    """Rows of these ids in their order, with at, the place of an id in the list from 1; unknown ids are left out."""
    wanted = properties.sparkSession.createDataFrame([(k, int(i)) for k, i in enumerate(ids, 1)], "at long, id long")
    return properties.join(F.broadcast(wanted), "id").orderBy("at")


def by_id(properties: DataFrame, id_: int) -> DataFrame:
    """The row of an id, or none; the condition reaches the scan."""
    return properties.filter(F.col("id") == id_).limit(1)


def lean(found: DataFrame) -> DataFrame:
    """What a geographic order needs; nothing else is read."""
    return found.select("id", "latitude", "longitude", "price", "first_seen_at", "surface")


def of_keys(properties: DataFrame, listings: DataFrame, *names: str) -> DataFrame:
    """Properties that share the values of these columns (a postal code, a fingerprint) with some listing; null meets nothing."""
    keys = listings.select(*(F.col(n).alias(f"_{n}") for n in names)).distinct()
    return properties.join(keys, [F.col(n) == F.col(f"_{n}") for n in names], "left_semi")


def ranked_ids(found: DataFrame, f: SearchFilters) -> DataFrame:
    """id and at of all matching rows in the order that f asks; no page."""
    return session.numbered(found, ordering(f.sort, "distance_km" in found.columns), "at").select("id", "at")


def recent(properties: DataFrame, limit: int) -> DataFrame:
    """The rows seen last, the newest first."""
    order = [F.desc("first_seen_at"), F.asc("id")]
    return numbered(properties.orderBy(*order).limit(limit), order)


def added_since(properties: DataFrame, since: str, limit: int) -> DataFrame:
    """Rows first seen after a time, the newest first."""
    return recent(properties.filter(F.col("first_seen_at") > F.lit(since).cast("timestamp")), limit)


def with_reactions(properties: DataFrame, reactions: DataFrame) -> DataFrame:
    """properties with reaction (type) and reaction_archived; null where there is none."""
    own = reactions.select(F.col("property_id").alias("_rid"), F.col("type").alias("reaction"), F.col("archived").alias("reaction_archived"))
    return properties.join(own, F.col("id") == F.col("_rid"), "left").drop("_rid")


def with_publications(properties: DataFrame, publications: DataFrame) -> DataFrame:
    """Properties with the array of their publications by time of scrape."""
    nested = publications.groupBy("property_id").agg(F.array_sort(F.collect_list(F.struct("scraped_at", "id", "source", "price", "is_active"))).alias("publications"))
    return properties.join(nested, F.col("id") == F.col("property_id"), "left").drop("property_id")


def mappable(df: DataFrame) -> DataFrame:
    return df.filter("latitude is not null and longitude is not null")


def window_then_rank(found: DataFrame, score: Column, f: SearchFilters, window: int = PAGE_MOST) -> DataFrame:
    """Sorting by compatibility: the first ``window`` rows by price, ranked by score, then paged."""
    first = found.orderBy("price", "id").limit(window)
    order = [F.desc(F.coalesce("score", F.lit(0.0))), F.asc("price"), F.asc("id")]
    return numbered(first.withColumn("score", score).orderBy(*order).offset(f.offset).limit(f.limit), order, offset=f.offset)


def keyset_page(log: DataFrame, limit: int, before_id: int | None = None, **equal) -> DataFrame:
    """limit + 1 rows older than an id whose columns have these values, with their places; the last row says if there are more."""
    own = log if before_id is None else log.filter(F.col("id") < before_id)
    for name, value in equal.items():
        own = own if value is None else own.filter(F.col(name) == value)
    order = [F.desc("created_at"), F.desc("id")]
    return numbered(own.orderBy(*order).limit(limit + 1), order)
