"""Scores of single criteria against learned targets, 0 to 100; null where nothing can be said."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.functions.scalars import energy_class, haversine_km, highlight_overlap

# The rank of an energy class, points a class costs, the largest penalty of a dislike, what a similarity weighs.
CLASS_RANK = {"A": 7, "B": 6, "C": 5, "D": 4, "E": 3, "F": 2, "G": 1, "N": 0, "V": 0}
CLASS_STEP, DISLIKE_MOST, NEAR_KM = 20, 40, 25
SIMILAR = {"price": 2.0, "surface": 1.5, "land_surface": 1.5, "rooms": 1.0, "bedrooms": 1.0, "bathrooms": 1.0, "parking_spaces": 1.0, "construction_year": 1.0}
HIGHLIGHTS, DISTANCE = 1.5, 2.0
RENOVATION = "(?iu)travaux|rafraîchir|rénov"


def held(value: Column) -> Column:
    """Held to 0..100; null stays null, which greatest() and least() would pass over."""
    return F.when(value.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(100.0), value)))


def line(x: Column, at: tuple, to: tuple) -> Column:
    """The value at x of the straight line through two points."""
    (x0, y0), (x1, y1) = at, to
    return y0 + (x - x0) / (x1 - x0) * (F.lit(y1) - F.lit(y0))


def price_score(price: Column, ideal: Column, most: Column) -> Column:
    """Falls from the ideal price to the highest."""
    return F.when(price <= ideal, 100.0).when(price >= most, F.when((most <= ideal) & (price <= most), 100.0).otherwise(0.0)).when(most > ideal, held(line(price, (ideal, 100), (most, 0)))).otherwise(0.0)


def size_score(value: Column, least: Column, ideal: Column) -> Column:
    """Half of the points up to the least size, the rest up to the ideal one."""
    flat = F.when(value >= ideal, 100.0).otherwise(held(value / ideal * 100))
    return F.when(value.isNull(), None).when(ideal <= least, flat).when(value < least, held(value / least * 50)).when(value >= ideal, 100.0).otherwise(held(line(value, (least, 50), (ideal, 100))))


def rooms_score(value: Column, least: Column, ideal: Column) -> Column:
    """60 points up to the least number, the rest up to the ideal one; without a least one the ideal stands for it."""
    floor = F.coalesce(least, ideal)
    low = F.when(value < floor, held(value / floor * 60)).otherwise(held(line(value, (floor, 60), (ideal, 100))))
    return F.when(ideal.isNull() | value.isNull(), None).when(value >= ideal, 100.0).otherwise(low)


def class_score(actual: Column, ideal: Column) -> Column:
    rank = F.create_map(*(F.lit(x) for pair in CLASS_RANK.items() for x in pair))
    steps = rank[ideal] - rank[energy_class(actual)]
    return F.when(steps <= 0, 100.0).otherwise(held(100.0 - steps * CLASS_STEP))


def old_build_score(is_new: Column, wanted: Column) -> Column:
    return F.when(F.coalesce(wanted, F.lit(False)), F.when(is_new.isNull(), 50.0).when(is_new, 0.0).otherwise(100.0))


def year_score(value: Column, ideal: Column) -> Column:
    """Within five years all points, none from fifty on."""
    gap = F.abs(value - ideal)
    return F.when(gap <= 5, 100.0).when(gap >= 50, 0.0).otherwise(held(line(gap, (5, 100), (50, 0))))


def highlights_score(actual: Column, preferred: Column) -> Column:
    return held(highlight_overlap(actual, preferred) * 100)


def renovation_score(condition: Column, avoided: Column) -> Column:
    said = F.when(F.coalesce(condition, F.lit("")) == "", 75.0).when(condition.rlike(RENOVATION), 0.0).otherwise(100.0)
    return F.when(F.coalesce(avoided, F.lit(False)), said)


def text_score(actual: Column, ideal: Column) -> Column:
    a, b = F.lower(F.trim(actual)), F.lower(F.trim(ideal))
    return F.when((actual == "") | (ideal == ""), None).when(a == b, 100.0).when(F.contains(a, b) | F.contains(b, a), 80.0).when(a.isNotNull() & b.isNotNull(), 0.0)


def distance_score(km: Column, most_km: Column) -> Column:
    return F.when(most_km.isNull() | (most_km <= 0), None).when(km <= 0, 100.0).when(km >= most_km, 0.0).otherwise(held((1 - km / most_km) * 100))


def likeness(a: str, b: str) -> Column:
    """0 to 1 of two homes whose columns have the prefixes a and b: the weighted mean over what both know."""
    x, y = (lambda n: F.col(f"{a}{n}")), (lambda n: F.col(f"{b}{n}"))
    parts: list[tuple[Column, float]] = []
    for name, weight in SIMILAR.items():
        u, v = x(name).cast("double"), y(name).cast("double")
        parts.append((F.when(u.isNotNull() & v.isNotNull(), 1 - F.least(F.lit(1.0), F.abs(u - v) / F.greatest(F.abs(u), F.abs(v), F.lit(1.0)))), weight))
    parts.append((highlight_overlap(x("highlights"), y("highlights")), HIGHLIGHTS))
    km = haversine_km(x("latitude"), x("longitude"), y("latitude"), y("longitude"))
    parts.append((F.when(km.isNotNull(), F.greatest(F.lit(0.0), 1 - km / NEAR_KM)), DISTANCE))
    rank = F.create_map(*(F.lit(n) for pair in CLASS_RANK.items() for n in pair))
    parts.append((1 - F.abs(rank[energy_class(x("dpe_class"))] - rank[energy_class(y("dpe_class"))]) / 6, 1.0))
    parts.append((F.when(x("is_new_property") == y("is_new_property"), 1.0), 1.0))
    zero = F.lit(0.0)
    gained = sum((F.coalesce(v * w, zero) for v, w in parts), zero)
    total = sum((F.when(v.isNotNull(), w).otherwise(zero) for v, w in parts), zero)
    return F.when(total > 0, gained / total)
