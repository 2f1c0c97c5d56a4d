"""Places: the postal-code dimension, lookups in it, suggested places, and what a geographic filter means."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from foyer.functions.scalars import KM_PER_HOUR, half_up, haversine_km, travel_radius_km, unaccent
from foyer.operators.search import SearchFilters

RADIUS_MOST_KM = 500


def _city(name: str):
    return F.trim(unaccent(F.col(name)))


def postal_index(communes: DataFrame) -> DataFrame:
    """postal_code, at, city, latitude, longitude of communes(pos, name, postal_codes, latitude, longitude).

    A code has an entry for each city name (case and accents apart), from the commune
    that comes first; at counts them from 0.  Communes without coordinates are left out.
    """
    each = communes.filter("latitude is not null and longitude is not null").select(F.explode("postal_codes").alias("postal_code"), F.struct("pos", F.col("name").alias("city"), "latitude", "longitude").alias("e"), _city("name").alias("_city"))
    first = each.groupBy("postal_code", "_city").agg(F.min_by("e", "e.pos").alias("e"))
    at = F.row_number().over(W.partitionBy("postal_code").orderBy("e.pos")) - 1
    return first.select("postal_code", at.alias("at"), "e.city", "e.latitude", "e.longitude")


def located(rows: DataFrame, index: DataFrame) -> DataFrame:
    """rows(postal_code, city, ...) with place_city, place_latitude, place_longitude: the entry of the code with the row's city, else its first; null for an unknown code."""
    keyed = rows.withColumn("_code", F.when(F.trim("postal_code").rlike(r"^\d{5}$"), F.trim("postal_code"))).withColumn("_name", _city("city"))
    named = index.select(F.col("postal_code").alias("_c1"), _city("city").alias("_n1"), *(F.col(n).alias(f"_x_{n}") for n in ("city", "latitude", "longitude")))
    first = index.filter("at = 0").select(F.col("postal_code").alias("_c0"), *(F.col(n).alias(f"_y_{n}") for n in ("city", "latitude", "longitude")))
    joined = keyed.join(named, (F.col("_code") == F.col("_c1")) & (F.col("_name") == F.col("_n1")), "left").join(first, F.col("_code") == F.col("_c0"), "left")
    met = F.col("_c1").isNotNull()
    return joined.select(*rows.columns, *(F.when(met, F.col(f"_x_{n}")).otherwise(F.col(f"_y_{n}")).alias(f"place_{n}") for n in ("city", "latitude", "longitude")))


def picked_places(asked: DataFrame, places: DataFrame) -> DataFrame:
    """asked(ask_id, query, city, postal_code) with place_id: the best of the places that its query was answered with.

    places(query, pos, place_id, name, postal_codes, usable): a place of that name and
    code; else of that code; else of that name; else any, each the first by pos; only
    usable ones count.
    """
    usable = places.filter("usable").select(F.col("query").alias("_q"), F.lower(F.trim("name")).alias("_name"), F.array_distinct("postal_codes").alias("_codes"), F.struct("pos", "place_id").alias("_place"))
    coded = usable.withColumn("_code", F.explode("_codes")).filter("_code <> ''")
    own = asked.select("ask_id", "query", F.lower(F.trim("city")).alias("city"), F.nullif("postal_code", F.lit("")).alias("code"))
    ways = ((coded, {"_q": "query", "_name": "city", "_code": "code"}), (coded, {"_q": "query", "_code": "code"}), (usable, {"_q": "query", "_name": "city"}), (usable, {"_q": "query"}))
    for k, (df, keys) in enumerate(ways):  # the first place of each key, not each place, meets what was asked
        first = df.groupBy(*(F.col(n).alias(f"{n}{k}") for n in keys)).agg(F.min_by("_place", F.struct("_place.pos")).alias(f"_place{k}"))
        own = own.join(first, [F.col(f"{n}{k}") == F.col(c) for n, c in keys.items()], "left")
    rank = F.coalesce(*(F.when(F.col(f"_place{k}").isNotNull(), k) for k in range(len(ways))))
    place = F.coalesce(*(F.col(f"_place{k}") for k in range(len(ways))))
    return own.select("ask_id", rank.alias("r"), place.alias("p")).groupBy("ask_id").agg(F.min_by("p.place_id", F.when(F.col("r").isNotNull(), F.struct("r", "p.pos"))).alias("place_id"))


def resolved(f: SearchFilters, center: tuple[float, float] | None) -> tuple[tuple[float, float] | None, float | None]:
    """(center, radius in km) that a filter means: travel time first, then a radius, else none; no center, no circle."""
    radius = travel_radius_km(f.travel_minutes) if f.travel_minutes is not None else f.radius_km
    if radius is None or not 0 < radius <= RADIUS_MOST_KM or center is None:
        return None, None
    return center, radius


def within_travel(rows: DataFrame, center: tuple[float, float], minutes: float) -> DataFrame:
    """rows(latitude, longitude, ...) that can be reached; those without coordinates go."""
    km = haversine_km(F.lit(center[0]), F.lit(center[1]), F.col("latitude"), F.col("longitude"))
    return rows.filter(F.coalesce(km <= travel_radius_km(minutes), F.lit(False)))


def filter_label(travel_minutes: Column, radius_km: Column, supports_travel: bool = True) -> Column:
    """What a geographic filter means, in words: minutes by car first, then a radius, else the city.

    A portal without travel times searches by the radius that the minutes are about.
    """
    minutes = F.concat(_plain(travel_minutes), F.lit(" min drive"))
    if not supports_travel:
        minutes = F.concat(minutes, F.lit(" (~"), half_up(travel_minutes / 60 * KM_PER_HOUR).cast("string"), F.lit(" km)"))
    return F.coalesce(minutes, F.concat(_plain(radius_km), F.lit(" km radius")), F.lit("city"))


def _plain(number: Column) -> Column:
    return F.regexp_replace(number.cast("string"), r"\.0$", "")
