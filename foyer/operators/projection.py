"""The canonical row of a property from its publications."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foyer.functions.scalars import merged_highlights, photo_key, photo_url, source_rank
from foyer.schemas import SEARCH_FIELDS, SOURCES

#: Fields of the first publication, whatever it holds; the others are the first value that isn't null.
PRIMARY = ("title", "price", "city")


def order(publication: Column | None = None) -> Column:
    """Sorts publications: source, then the latest scrape, then id."""
    f = (lambda n: publication[n]) if publication is not None else F.col
    return F.struct(source_rank(f("source"), SOURCES).alias("rank"), (-F.unix_micros(f("scraped_at").cast("timestamp"))).alias("age"), f("id").alias("id"))


def first_values(publications: DataFrame, names: Sequence[str]) -> DataFrame:
    """property_id and, for each name, its value in the first publication that has one; one pass, partial aggregates."""
    at = F.col("_order")
    aggs = [F.min_by(n, F.when(F.col(n).isNotNull() | F.lit(n in PRIMARY), at)).alias(n) for n in names]
    return publications.withColumn("_order", order()).groupBy("property_id").agg(*aggs)


def project(publications: DataFrame, names: Sequence[str] = SEARCH_FIELDS) -> DataFrame:
    """The projection over active publications; a property without any has no row."""
    own = [n for n in names if n in publications.columns]
    return first_values(publications.filter("is_active"), own)


def display(publications: DataFrame, names: Sequence[str]) -> DataFrame:
    """As project(), but from inactive publications where a property has no active one."""
    live = publications.filter("is_active").select(F.col("property_id").alias("_pid")).distinct()
    marked = publications.join(live, F.col("property_id") == F.col("_pid"), "left")
    return first_values(marked.filter(F.col("is_active") | F.col("_pid").isNull()), names)


def refresh(properties: DataFrame, publications: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """properties with projected columns and has_price_drop renewed (for ids, else all); without active publications a row stays as it is."""
    scope = publications if ids is None else publications.join(ids.select(F.col("id").alias("property_id")), "property_id", "left_semi")
    names = [n for n in SEARCH_FIELDS if n in publications.columns and n in properties.columns]
    new = project(scope, names).select(F.col("property_id").alias("_pid"), *(F.col(n).alias(f"_{n}") for n in names))
    joined = properties.join(new, F.col("id") == F.col("_pid"), "left")
    live = F.col("_pid").isNotNull()
    price = F.when(live, F.col("_price")).otherwise(F.col("price"))
    out = joined.withColumn("has_price_drop", F.when(live, F.col("first_price") > price).otherwise(F.col("has_price_drop")))
    return out.withColumns({n: F.when(live, F.col(f"_{n}")).otherwise(F.col(n)) for n in names}).select(*properties.columns)


def highlights(publications: DataFrame) -> DataFrame:
    """property_id, highlights: the union over active publications in order; null if empty."""
    lists = F.transform(F.array_sort(F.collect_list(F.struct(order().alias("o"), F.col("highlights").alias("h")))), lambda x: x["h"])
    return publications.filter("is_active").groupBy("property_id").agg(merged_highlights(lists).alias("highlights"))


def longest_description(publications: DataFrame) -> DataFrame:
    """property_id, description: the longest of active publications, the earliest id of equals."""
    filled = publications.filter("is_active and trim(description) <> ''")
    return filled.groupBy("property_id").agg(F.min_by("description", F.struct((-F.length("description")).alias("l"), F.col("id"))).alias("description"))


def deltas(properties: DataFrame, publications: DataFrame, names: Sequence[str]) -> DataFrame:
    """Publications that differ from their property in one of the fields."""
    own = properties.select(F.col("id").alias("_pid"), *(F.col(n).alias(f"_{n}") for n in names))
    differs = F.lit(False)
    for n in names:
        differs = differs | ~F.col(n).eqNullSafe(F.col(f"_{n}"))
    return publications.join(own, F.col("property_id") == F.col("_pid")).filter(differs).select("property_id", "id", "source", *names)


def photos(publications: DataFrame, most_bits: int = 8, active_only: bool = True) -> DataFrame:
    """property_id, photos: pictures in order of source and id, without those that repeat an earlier one.

    A picture repeats if its url without query, its content hash, or its perceptual
    hash within most_bits was there.  Each decision depends on those before, so a
    property's pictures (a few dozen) are folded in order, inside the JVM.
    """
    rows = publications.filter("is_active") if active_only else publications
    each = rows.select("property_id", F.struct(source_rank(F.col("source"), SOURCES).alias("rank"), F.col("id"), F.col("source"), F.col("image_urls"), F.col("image_local_hashes").alias("local"), F.col("image_perceptual_hashes").alias("look")).alias("p"))
    before = lambda a, b: F.when((a["rank"] < b["rank"]) | ((a["rank"] == b["rank"]) & (a["id"] < b["id"])), -1).when((a["rank"] == b["rank"]) & (a["id"] == b["id"]), 0).otherwise(1)
    grouped = each.groupBy("property_id").agg(F.array_sort(F.collect_list("p"), before).alias("ps"))
    picture = lambda p: F.transform(F.coalesce(p["image_urls"], F.array().cast("array<string>")), lambda u: F.struct(u.alias("remote"), photo_key(u).alias("key"), F.try_element_at(p["local"], u).alias("content"), F.try_element_at(p["look"], u).alias("look"), p["source"].alias("source"), p["id"].alias("id"), photo_url(u, p["local"]).alias("url")))
    flat = F.flatten(F.transform("ps", picture))
    kind = "array<struct<remote:string,key:string,content:string,look:string,source:string,id:bigint,url:string>>"

    def alike(a: Column, b: Column) -> Column:
        from foyer.functions.scalars import hex_hamming

        same_look = (a["look"] != "") & (b["look"] != "") & (F.length(a["look"]) == F.length(b["look"])) & (hex_hamming(a["look"], b["look"]) <= most_bits)
        return (a["key"] == b["key"]) | F.coalesce((a["content"] != "") & (a["content"] == b["content"]), F.lit(False)) | F.coalesce(same_look, F.lit(False))

    folded = F.aggregate(flat, F.array().cast(kind), lambda kept, x: F.when(F.exists(kept, lambda k: alike(k, x)), kept).otherwise(F.concat(kept, F.array(x))))
    return grouped.select("property_id", F.transform(folded, lambda x: F.struct(x["url"].alias("url"), x["source"].alias("source"), x["id"].alias("publication_id"))).alias("photos"))


def filled(publications: DataFrame, properties: DataFrame, names: Sequence[str]) -> DataFrame:
    """publications with their property's values where they have none; those without a property go."""
    own = properties.select(F.col("id").alias("_pid"), *(F.col(n).alias(f"_{n}") for n in names))
    joined = publications.join(own, F.col("property_id") == F.col("_pid"))
    return joined.withColumns({n: F.coalesce(n, f"_{n}") for n in names}).select(*publications.columns)


def with_first_price(properties: DataFrame) -> DataFrame:
    """properties where an unknown first price is the present one, and has_price_drop says if the first is higher."""
    first = F.coalesce("first_price", "price")
    return properties.withColumns({"has_price_drop": first > F.col("price"), "first_price": first})
